"""Agreement, reliability and robust aggregates, all as partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_table


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, n over rows that have both."""
    return rows.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).cast("string").alias("truth"), F.col(guess).cast("string").alias("guess")).agg(F.count("*").alias("n"))


def cohens_kappa(rows: DataFrame, truth: str, guess: str, least: int = 2, low: float | None = None, high: float | None = None) -> DataFrame:
    """n, kappa: null for fewer than ``least`` rows or where chance alone agrees fully; clamped where limits are given."""
    c = confusion(rows, truth, guess)
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    t = c.groupBy("truth").agg(F.sum("n").alias("a"))
    g = c.groupBy("guess").agg(F.sum("n").alias("b"))
    chance = t.join(g, t["truth"] == g["guess"]).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    both = total.crossJoin(chance)  # two single rows
    po, pe = F.col("same") / F.col("n"), F.coalesce("ab", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when((F.col("n") >= least) & (pe < 1), (po - pe) / (1 - pe))
    if low is not None:
        kappa = F.when(kappa.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), kappa)))
    return both.select("n", kappa.alias("kappa"))


def class_precision(rows: DataFrame, truth: str, guess: str, alpha: float = 0.5) -> DataFrame:
    """guess, n, precision: smoothed share of a guess that was right, over k classes of the truth."""
    c = confusion(rows, truth, guess)
    k = c.select("truth").distinct().count()
    right = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    return c.groupBy("guess").agg(F.sum("n").alias("n"), ((right + alpha) / (F.sum("n") + alpha * max(k, 1))).alias("precision"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, ari of two labellings."""
    c = confusion(rows, a, b)
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n").cast("double")
    cells = c.agg(F.sum(pairs(n)).alias("ij"), F.sum("n").alias("n"))
    rows_ = c.groupBy("truth").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(pairs(n)).alias("i"))
    cols = c.groupBy("guess").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(pairs(n)).alias("j"))
    one = cells.crossJoin(rows_).crossJoin(cols)  # three single rows
    expected = F.col("i") * F.col("j") / F.nullif(pairs(F.col("n").cast("double")), F.lit(0.0))
    most = (F.col("i") + F.col("j")) / 2
    return one.select("n", F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def modal_value(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals, and how often it occurs."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    first = F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value)))
    return counts.groupBy(*by).agg(first.alias(f"modal_{value}"), F.max("n").alias("n_mode"))


def inverse_frequency_weights(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``rows`` with n / (k · n of the class), scaled to mean 1; rows without a class get null."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    # over all rows, n / (k · n_c) already has mean 1
    total = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return rows.join(counts.crossJoin(total).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias(out)), label, "left")


def robust_z(rows: DataFrame, by: list[str], value: str, least: int = 6) -> DataFrame:
    """``rows`` with the group's median, MAD and robust z of ``value``; null for groups of fewer than ``least`` or
    without spread. Two aggregates joined back: no group is gathered in one task beyond the values Spark's exact
    median buffers, which are pre-counted by value."""
    mid = rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    spread = rows.join(mid, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    joined = rows.join(mid.join(spread, by), by, "left")
    return joined.withColumn("robust_z", F.when((F.col("n") >= least) & (F.col("mad") > 0), (F.col(value) - F.col("median")) / (1.4826 * F.col("mad"))))


def shrunken_centering(rows: DataFrame, by: str, value: str, least: int = 10, k: float = 10.0) -> DataFrame:
    """``rows`` with ``value`` moved towards the grand mean by the group's shrunken offset, n / (n + k) of it, for
    groups of at least ``least`` values."""
    grand = rows.agg(F.avg(value).alias("__m"))
    groups = rows.groupBy(by).agg(F.avg(value).alias("__g"), F.count(value).alias("__n")).crossJoin(grand)
    offset = F.when(F.col("__n") >= least, (F.col("__g") - F.col("__m")) * F.col("__n") / (F.col("__n") + k)).otherwise(0.0)
    return rows.join(groups.select(by, offset.alias("__o")), by, "left").withColumn("centred", F.col(value) - F.coalesce("__o", F.lit(0.0))).drop("__o")


def leave_one_out_mean(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``rows`` with the mean of the group's other values; null where there are none."""
    sums = rows.groupBy(by).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    others = F.col("__n") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return rows.join(sums, by, "left").withColumn("loo_mean", F.when(others > 0, (F.col("__s") - F.coalesce(value, F.lit(0.0))) / others)).drop("__s", "__n")


def roc_auc(rows: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """n, auc: weighted, ties counting half. Scores are summed first, so the running sum has one row a score; it runs
    over a range-partitioned order (running totals within partitions plus the partitions' totals before)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    per = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("q"))
    before = running_total(per, "s", "q")
    return before.agg((F.sum(F.col("p") * (F.col("total_q") - F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))


def running_total(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with ``total_<value>``, the sum of ``value`` up to and including each row by ``order`` (unique):
    a range partitioning, sums within partitions, and the totals of the partitions before. No single task sees all."""
    # written once, so that both uses see one assignment of rows to partitions
    parts = cut_table(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()))
    within = parts.withColumn("__w", F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = parts.groupBy("__p").agg(F.sum(value).alias("__t"))  # one row a partition
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return within.join(F.broadcast(offsets.select("__p", "__before")), "__p").withColumn(f"total_{value}", F.col("__w") + F.col("__before")).drop("__p", "__w", "__before")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over rows that have both."""
    ok = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0.0))
