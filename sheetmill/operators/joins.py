"""Hierarchical, prioritised and ranked joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_by_individual(base: DataFrame, right: DataFrame, key: str, part: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` of ``right``, filling only nulls: from the row of the same key and part, else from the
    key's part 0, else from the key's only row. ``right`` has one row a key and part. Repeated keys of ``base`` stay
    as they are; null keys match nothing."""
    exact = right.select(key, part, *[F.col(c).alias(f"__x_{c}") for c in columns])
    sheet = right.filter(F.col(part) == 0).select(key, *[F.col(c).alias(f"__s_{c}") for c in columns])
    single = right.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__1_{c}") for c in columns]).filter("__n = 1").drop("__n")
    joined = base.join(exact, [key, part], "left").join(sheet, key, "left").join(single, key, "left")

    def value(c: str) -> Column:
        own = [F.col(c)] if c in base.columns else []
        return F.coalesce(*own, f"__x_{c}", f"__s_{c}", f"__1_{c}").alias(c)

    return joined.select(*[F.col(c) for c in base.columns if c not in columns], *[value(c) for c in columns])


def exact_or_default(base: DataFrame, child: DataFrame, key: str, part: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` of the child row of the same key and part where there is one, be its values null or
    not, else of the child row of part 0: a switch on the row's presence, not on its values."""
    exact = child.select(key, part, F.lit(True).alias("__there"), *[F.col(c).alias(f"__x_{c}") for c in columns])
    default = child.filter(F.col(part) == 0).select(key, *[F.col(c).alias(f"__d_{c}") for c in columns])
    joined = base.join(exact, [key, part], "left").join(default, key, "left")
    return joined.select(*base.columns, *[F.when(F.col("__there"), F.col(f"__x_{c}")).otherwise(F.col(f"__d_{c}")).alias(c) for c in columns])


def ranked_pick(rows: DataFrame, by: list[str], order: list[Column], count_as: str | None = None) -> DataFrame:
    """The first row of each group by ``order`` (end it in a unique column); ``count_as`` names the group's size."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    if count_as:  # an aggregate with partial sums, so that the ranking keeps its limit before the shuffle
        sizes = rows.groupBy(*by).agg(F.count("*").alias(count_as))
        return out.filter("__rn = 1").drop("__rn").join(sizes, by)
    return out.filter("__rn = 1").drop("__rn")


def first_match(base: DataFrame, candidates: list[tuple[DataFrame, list[str]]], columns: list[str], source: str) -> DataFrame:
    """``base`` with ``columns`` from the first candidate table that has its keys, and in ``source`` that table's
    number from 1; null where none has. Each candidate has one row a key."""
    out = base
    for i, (df, keys) in enumerate(candidates):
        marked = df.select(*keys, F.lit(i + 1).alias(f"__n{i}"), *[F.col(c).alias(f"__{i}_{c}") for c in columns])
        out = out.join(marked, keys, "left")
    number = F.coalesce(*[F.col(f"__n{i}") for i in range(len(candidates))])
    pick = lambda c: reduce(lambda acc, i: acc.when(number == i + 1, F.col(f"__{i}_{c}")), range(1, len(candidates)), F.when(number == 1, F.col(f"__0_{c}")))
    return out.select(*base.columns, number.alias(source), *[pick(c).alias(c) for c in columns])


def join_and_append(base: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fills only nulls of shared columns and appends the right rows without a partner."""
    shared = [c for c in right.columns if c not in keys and c in base.columns]
    extra = [c for c in right.columns if c not in keys and c not in base.columns]
    renamed = right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in shared + extra])
    joined = base.join(renamed, keys, "left").select(*[F.coalesce(c, f"__r_{c}").alias(c) if c in shared else F.col(c) for c in base.columns], *[F.col(f"__r_{c}").alias(c) for c in extra])
    return joined.unionByName(right.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def unanimous_propagation(receivers: DataFrame, donors: DataFrame, key: str, value: str) -> DataFrame:
    """``receivers`` with ``value`` of their key's donors where all donors that have one agree."""
    agreed = donors.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).filter("__a = __b").select(key, F.col("__a").alias(value))
    return receivers.drop(value).join(agreed, key, "left")
