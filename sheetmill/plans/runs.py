"""Runs: identifiers, a registry guard, results cached by content, and a summary for people."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_token(text: str | None) -> str:
    """A run's name as a token: the last part of a path, lower case, anything but letters and digits as '_', with the
    prefix 'run_'; '' for nothing."""
    name = re.sub(r"[^a-z0-9]+", "_", (text or "").rstrip("/").rsplit("/", 1)[-1].lower()).strip("_")
    return "" if not name else name if name.startswith("run_") else f"run_{name}"


def fingerprint(df: DataFrame) -> str:
    """Of the rows and the schema, whatever their order: equal tables have equal fingerprints."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]) if df.columns else F.lit(0)
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(f"{df.schema.json()}|{r['n']}|{r['s']}|{r['x']}".encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, inputs: list[DataFrame], version: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work`` from ``folder`` if one of these inputs and this version is there, else made and kept."""
    key = hashlib.sha256("|".join([version, *[fingerprint(i) for i in inputs]]).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        work().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def summary_markdown(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A report of small result tables; a longer one shows its first ``most`` rows and says so."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        out += ["", f"First {most} rows."] if len(rows) > most else []
        out.append("")
    return "\n".join(out)
