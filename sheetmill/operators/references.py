"""References to records that do not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .skew import HOT_SHARE, hot_keys


@dataclass(frozen=True)
class Reference:
    """``columns`` of ``rows`` point at ``target_columns`` of ``target``; a row with a null among them points nowhere."""

    source_table: str
    rows: DataFrame
    record_id: str
    columns: tuple[str, ...]
    target_table: str
    target: DataFrame
    target_columns: tuple[str, ...]
    at: str


def _key(columns: tuple[str, ...]) -> list[Column]:
    """The reference's parts as text, padded with '' to two; compared exactly as written."""
    parts = [F.col(c).cast("string") for c in columns]
    if len(parts) > 2:
        parts = [parts[0], F.to_json(F.array(*parts[1:]))]
    return [parts[0].alias("k1"), (parts[1] if len(parts) > 1 else F.lit("")).alias("k2")]


def _whole(columns: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def tagged_children(references: list[Reference]) -> DataFrame:
    """All references in long form: source_table, record_id, target_table, k1, k2, period_month."""
    parts = [
        r.rows.filter(_whole(r.columns)).select(
            F.lit(r.source_table).alias("source_table"), F.col(r.record_id).cast("bigint").alias("record_id"), F.lit(r.target_table).alias("target_table"),
            *_key(r.columns), F.date_format(r.at, "yyyy-MM").alias("period_month"),
        )
        for r in references
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tagged_parents(references: list[Reference]) -> DataFrame:
    """The keys of every target in long form, each target once."""
    seen: dict[tuple, DataFrame] = {}
    for r in references:
        seen.setdefault(
            (r.target_table, r.target_columns),
            r.target.filter(_whole(r.target_columns)).select(F.lit(r.target_table).alias("target_table"), *_key(r.target_columns)),
        )
    out = None
    for p in seen.values():
        out = p if out is None else out.unionByName(p)
    return out


def key_census(references: list[Reference]) -> DataFrame:
    """Tagged parent and child keys in one long table, grouped by target and key (partial sums before the shuffle):
    target_table, k1, k2, held (a parent has the key), n (references to it)."""
    both = tagged_children(references).select("target_table", "k1", "k2", F.lit(0).alias("parent"), F.lit(1).cast("bigint").alias("child")).unionByName(
        tagged_parents(references).select("target_table", "k1", "k2", F.lit(1).alias("parent"), F.lit(0).cast("bigint").alias("child"))
    )
    return both.groupBy("target_table", "k1", "k2").agg((F.max("parent") == 1).alias("held"), F.sum("child").alias("n"))


def orphan_references(references: list[Reference], share: float = HOT_SHARE) -> DataFrame:
    """One row for each reference without a matching record, whenever that record arrives.

    Columns: source_table, record_id, target_table, period_month. Tagged parent and child keys are grouped in long
    form; groups without a parent are the orphan keys. References to hot keys (more than ``share`` of all, so at most
    1 / share keys) are told apart by a broadcast of those keys and never shuffled; the others meet the orphan keys in
    a shuffled semi-join. Null references are none; a period is null where the time is null; repeated rows with one
    record_id give one row; an empty table gives none; further columns of the tables are not read.
    """
    children = tagged_children(references)
    census = key_census(references)
    keys = ["target_table", "k1", "k2"]
    total = children.count()
    if total == 0:
        return children.select("source_table", "record_id", "target_table", "period_month")
    hot = hot_keys(census, keys, "n", total, share).select(*keys, F.col("held").alias("hot_held"))
    told = children.join(F.broadcast(hot), keys, "left")
    sure = told.filter(~F.col("hot_held"))
    orphans = census.filter(~F.col("held") & (F.col("n") > 0)).select(*keys)
    rest = told.filter(F.col("hot_held").isNull()).join(orphans, keys, "left_semi")
    out = sure.unionByName(rest).select("source_table", "record_id", "target_table", "period_month")
    return out.dropDuplicates(["source_table", "record_id", "target_table"])


def orphans_by_period(references: list[Reference], share: float = HOT_SHARE) -> DataFrame:
    """Orphan references counted per table pair and month: source_table, target_table, period_month, n_orphans."""
    return orphan_references(references, share).groupBy("source_table", "target_table", "period_month").agg(F.count("*").alias("n_orphans"))
