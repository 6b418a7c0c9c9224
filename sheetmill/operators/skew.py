"""Hot-key helpers: a join that survives one key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot when it holds more than this share of the rows; so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 20_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """The keys of pre-aggregated ``counts`` holding more than ``share`` of ``total`` rows: at most ``1 / share``
    rows by arithmetic, whatever the input, so the result may be broadcast."""
    return counts.filter(F.col(n) > F.lit(max(1.0, total * share)))


def left_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which has one row a key and, in ``n``, how many of the ``total`` rows have
    it. Rows of hot keys meet their lookup row by broadcast, where they lie; the others meet theirs in a shuffle.
    ``lookup`` must be materialised: it is counted first."""
    hot = hot_keys(lookup, keys, n, total, share)
    if hot.isEmpty():
        return rows.join(lookup.drop(n), keys, "left")
    tagged = rows.join(F.broadcast(hot.drop(n).withColumn("__hot", F.lit(True))), keys, "left")
    cold = tagged.filter(F.col("__hot").isNull()).select(*rows.columns).join(lookup.drop(n), keys, "left")
    return tagged.filter(F.col("__hot")).drop("__hot").unionByName(cold)


#: A lookup estimated at up to so many bytes is broadcast; a larger one is joined by a shuffle. Held in memory it takes
#: some three times as much.
BROADCAST_BYTES = 4 << 20


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row by its types: strings count 20, arrays and structs 60, the row itself 8."""
    width = {"string": 20, "bigint": 8, "double": 8, "int": 4, "boolean": 1}
    return 8 + sum(width.get(t, 60) for _, t in df.dtypes)


def checked_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, n: str, total: int, most: int | None = None, counted: int | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row a key, materialised): by broadcast if its rows, ``counted`` here or before,
    are estimated at no more than ``most`` bytes (BROADCAST_BYTES), or else as left_lookup does, with only the hot keys
    broadcast. ``how``: 'inner', 'left' or 'left_semi'."""
    counted = lookup.count() if counted is None else counted
    if counted * row_bytes(lookup.drop(n)) <= (BROADCAST_BYTES if most is None else most):
        return rows.join(F.broadcast(lookup.drop(n)), keys, how)
    if how == "left":
        return left_lookup(rows, lookup, keys, n, total)
    found = left_lookup(rows, lookup.withColumn("__there", F.lit(True)), keys, n, total).filter(F.col("__there")).drop("__there")
    return found.select(*rows.columns) if how == "left_semi" else found
