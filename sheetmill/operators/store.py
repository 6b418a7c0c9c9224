"""Upserts, run-scoped tables and cohort upkeep on immutable tables: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column], per_column: bool = False) -> DataFrame:
    """One row a key: the last by ``order``, or with ``per_column`` each column's last value that isn't null.
    Both are aggregates with partial sums, so a key holding a third of the rows stays cheap."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*order)
    if not per_column:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), at).alias("__r")).select(*keys, "__r.*")
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), at)).alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: bool = True) -> DataFrame:
    """``old`` after ``new``: new keys are added, known ones updated. Columns unknown to ``old`` are ignored, columns
    ``new`` lacks stay; with ``preserve`` a null doesn't overwrite. ``new`` has one row a key (see last_per_key); rows
    of either side with a null among the keys match nothing and are kept."""
    both = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, *[F.col(f"`{c}`").alias(f"__o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(f"`{c}`").alias(f"__n_{c}") for c in both], F.lit(True).alias("__new"))
    joined = a.join(b, keys, "full_outer")

    def value(c: str) -> Column:
        o = F.col(f"__o_{c}")
        if c not in both:
            return o
        n = F.col(f"__n_{c}")
        return F.coalesce(n, o) if preserve else F.when(F.col("__new"), n).otherwise(o)

    return joined.select(*[F.col(c) if c in keys else value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks; columns that one side lacks are null."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True).select(*old.columns)


def replace_run(old: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """``old`` with the runs that ``new`` has replaced as wholes."""
    return old.join(new.select(run).distinct(), run, "left_anti").unionByName(new.select(*old.columns))


def prune_run(old: DataFrame, new: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """``old`` without the rows of ``new``'s runs whose keys ``new`` no longer has."""
    touched = old.join(new.select(run).distinct(), run, "left_semi")
    return old.join(new.select(run).distinct(), run, "left_anti").unionByName(touched.join(new.select(run, *keys), [run, *keys], "left_semi").select(*old.columns))


def cascade_delete(tables: list[tuple[DataFrame, list[str]]], gone: DataFrame) -> list[DataFrame]:
    """Each table without the rows whose key columns are in ``gone`` (columns in the same order)."""
    out = []
    for df, keys in tables:
        renamed = gone.select(*[F.col(a).alias(b) for a, b in zip(gone.columns, keys, strict=True)]).distinct()
        out.append(df.join(renamed, keys, "left_anti").select(*df.columns))
    return out


def conform(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """``df`` in the shape of ``spec`` (name → type): missing columns null, others dropped, types leniently cast."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`").try_cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c) for c, t in spec.items()])


def expand_cohort(cohort: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    """(key, part) of each cohort row: its own part where it names one, else every known part of the key, else 0.
    Repeated keys count once."""
    known = parts.select(key, F.col(part).alias("__p")).distinct()
    own = cohort.filter(F.col(part).isNotNull()).select(key, part)
    open_keys = cohort.filter(F.col(part).isNull()).select(key).distinct()
    return own.unionByName(open_keys.join(known, key, "left").select(key, F.coalesce("__p", F.lit(0)).alias(part))).distinct()


def merge_registry(old: DataFrame, new: DataFrame, key: str, first: list[str]) -> DataFrame:
    """Run registry: columns in ``first`` keep their first value, the others take the latest that isn't null."""
    a = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in old.columns if c != key])
    joined = a.join(new, key, "full_outer")
    return joined.select(key, *[(F.coalesce(f"__o_{c}", c) if c in first else F.coalesce(c, f"__o_{c}")).alias(c) for c in old.columns if c != key])
