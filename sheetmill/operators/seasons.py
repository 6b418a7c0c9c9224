"""Seasons: tests and models of days of the year as angles. Rows are summed on the executors; models see sums only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.circular import radians_of_day
from .aggregates import running_total
from .stats import PASS_NUMBERS, f_tail, permuted

#: Days later for each degree of latitude, and the slopes that are searched.
DAYS_A_DEGREE = 4.0
SLOPES = (-15.0, 25.0, 0.25)


def _bessel_ratio(k: np.ndarray) -> np.ndarray:
    """I1(k) / I0(k), by its continued fraction."""
    out = np.zeros_like(k)
    for m in range(60 + int(np.max(k, initial=0.0)), 0, -1):
        out = 1.0 / (2.0 * m / k + out)
    return out


def _log_bessel(k: np.ndarray) -> np.ndarray:
    """log I0(k)."""
    return np.where(k < 500, np.log(np.i0(np.minimum(k, 500))), k - 0.5 * np.log(2 * np.pi * np.maximum(k, 1.0)))


def concentration(r: np.ndarray) -> np.ndarray:
    """The concentration whose mean resultant length is ``r``: the usual start and six Newton steps, at most 500."""
    r = np.clip(np.asarray(r, float), 0.0, 1 - 1e-8)
    start = np.where(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6, np.where(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r), 1 / np.maximum(1e-8, r**3 - 4 * r**2 + 3 * r)))
    k = np.clip(start, 1e-6, 500.0)
    for _ in range(6):
        a = _bessel_ratio(k)
        k = np.clip(k - (a - r) / np.maximum(1e-12, 1 - a * a - a / k), 1e-6, 500.0)
    return np.where(r > 0, k, 0.0)


def phase_test(rows: DataFrame, doy: str, group: str, key: str, times: int = 999, least: int = 3, seed: int = 42) -> DataFrame:
    """f, p, perm_p, k, n: whether the groups of at least ``least`` days have one mean direction: the Watson–Williams
    statistic with its correction for concentration, its F probability, and the share of label permutations (true ones,
    numbered by the unique ``key``) whose resultants are as long. Nulls for fewer than two groups."""
    spark, t = rows.sparkSession, radians_of_day(F.col(doy))
    base = rows.filter(F.col(doy).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("id"), F.col(group).cast("string").alias("g"), F.cos(t).alias("c"), F.sin(t).alias("s"), F.lit(1.0).alias("one"))
    sizes = {r["g"]: r["n"] for r in base.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("g").collect()}  # one row a group
    n, k, schema = sum(sizes.values()), len(sizes), "f double, p double, perm_p double, k int, n bigint"
    if k < 2 or n < k + 2:
        return spark.createDataFrame([(None, None, None, k, n)], schema)
    kept = running_total(base.filter(F.col("g").isin(*sizes)), "id", "one").select((F.col("total_one") - 1).cast("bigint").alias("i"), "g", "c", "s")
    code, edges, squares = {g: i for i, g in enumerate(sizes)}, np.cumsum(list(sizes.values())), {}
    step = max(1, PASS_NUMBERS // (2 * k))
    for first in range(0, times + 1, step):
        turns = range(first, min(times + 1, first + step))

        def partial(batches: Iterator[pd.DataFrame], turns=turns) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(turns), k, 2))
            for pdf in batches:
                x, at = pdf[["c", "s"]].to_numpy(), pdf["i"].to_numpy()
                for j, b in enumerate(turns):
                    label = pdf["g"].map(code).to_numpy() if b == 0 else np.searchsorted(edges, permuted(at, n, seed * 1_000_003 + b), side="right")
                    for c in (0, 1):
                        sums[j, :, c] += np.bincount(label, x[:, c], k)
            yield pd.DataFrame({"b": list(turns), "v": [v.ravel().tolist() for v in sums]})

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.sum([np.array(x) for x in pdf["v"]], axis=0).reshape(k, 2)
            return pd.DataFrame({"b": [pdf["b"].iloc[0]], "r": [float(np.hypot(v[:, 0], v[:, 1]).sum())]})

        squares |= {r["b"]: r["r"] for r in kept.mapInPandas(partial, "b int, v array<double>").groupBy("b").applyInPandas(whole, "b int, r double").collect()}  # one row a permutation
    c, s = kept.agg(F.sum("c"), F.sum("s")).first()
    r, whole_r = squares[0], math.hypot(c, s)
    kappa = float(concentration(np.array([min(1 - 1e-8, r / n)]))[0])
    f = max(0.0, (1 + 3 / (8 * kappa)) * (n - k) * (r - whole_r) / ((k - 1) * (n - r))) if kappa > 1e-4 and n - r > 1e-10 else 0.0
    larger = sum(v >= r - 1e-12 for b, v in squares.items() if b)
    return spark.createDataFrame([(f, f_tail(f, k - 1, n - k), (larger + 1) / (times + 1), k, n)], schema)


def seasonal_models(rows: DataFrame, doy: str, lat: str, group: str) -> DataFrame:
    """group, model, k, n, slope, kappa, loglik, aicc, weight, best: von Mises models of the day of the year of each
    group: one constant day; DAYS_A_DEGREE days later for each degree of latitude north of the group's median; a fitted
    slope within SLOPES (groups of ten rows or more whose latitudes differ). The best has the smallest AICc; weights are
    Akaike's. Days outside 1 to 366 and latitudes outside ±90 don't count.

    The likelihood of a slope needs two sums over the rows: all slopes of a grid are summed in one pass, and two more
    passes over ever finer grids around the best settle it."""
    known = rows.select(F.col(group).cast("string").alias("g"), F.col(doy).cast("double").alias("d"), F.col(lat).cast("double").alias("y")).filter(F.col("g").isNotNull() & F.col("d").between(1, 366) & F.col("y").between(-90, 90))
    middle = known.groupBy("g").agg(F.median("y").alias("m"), F.count("*").alias("n"), F.stddev("y").alias("sd"))
    one = known.join(middle, "g").select("g", radians_of_day(F.col("d")).alias("t"), (F.col("y") - F.col("m")).alias("y"))
    info = {r["g"]: (r["n"], r["sd"]) for r in middle.collect()}  # one row a group

    def likelihoods(slopes: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """group → (log-likelihood, concentration) of each of its slopes."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for pdf in batches:
                for g, at in pdf.groupby("g").indices.items():
                    if g in slopes:
                        for lo in range(0, len(at), 10_000):
                            t, y = pdf["t"].to_numpy()[at[lo : lo + 10_000]], pdf["y"].to_numpy()[at[lo : lo + 10_000]]
                            angle = t[:, None] - 2 * np.pi / 365.25 * y[:, None] * slopes[g]
                            sums[g] = sums.get(g, 0.0) + np.concatenate([np.cos(angle).sum(axis=0), np.sin(angle).sum(axis=0)])
            for g, v in sums.items():
                yield pd.DataFrame({"g": g, "i": np.arange(len(v)), "v": v})

        got: dict[str, np.ndarray] = {g: np.zeros(2 * len(b)) for g, b in slopes.items()}
        for r in one.mapInPandas(partial, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect():  # groups × slopes
            got[r["g"]][r["i"]] = r["v"]
        out = {}
        for g, v in got.items():
            n, half = info[g][0], len(v) // 2
            long = np.hypot(v[:half], v[half:])
            kappa = concentration(long / n)
            out[g] = (np.where(kappa > 1e-8, kappa * long - n * (math.log(2 * math.pi) + _log_bessel(np.maximum(kappa, 1e-8))), -n * math.log(2 * math.pi)), kappa)
        return out

    lo, hi, width = SLOPES
    free = [g for g, (n, sd) in info.items() if n >= 10 and sd is not None and sd > 0.05]
    grid = {g: np.arange(lo, hi + width / 2, width) for g in free}
    for _ in range(3):
        if not grid:
            break
        best = {g: (grid[g], *v) for g, v in likelihoods(grid).items()}
        at = {g: float(b[np.argmax(ll)]) for g, (b, ll, _) in best.items()}
        width /= 10
        grid = {g: np.clip(np.arange(a - 10 * width, a + 10.5 * width, width), lo, hi) for g, a in at.items()}
    fixed = likelihoods({g: np.array([0.0, DAYS_A_DEGREE]) for g in info}) if info else {}
    out = []
    for g, (ll, kappa) in sorted(fixed.items()):
        n = info[g][0]
        models = [("constant", 2, 0.0, ll[0], kappa[0]), ("fixed_slope", 2, DAYS_A_DEGREE, ll[1], kappa[1])]
        if g in free:
            b, l3, k3 = best[g]
            j = int(np.argmax(l3))
            models.append(("fitted_slope", 3, float(b[j]), l3[j], k3[j]))
        aicc = [-2 * m[3] + 2 * m[1] + 2 * m[1] * (m[1] + 1) / (n - m[1] - 1) if n > m[1] + 1 else math.inf for m in models]
        least = min(aicc)
        weights = [math.exp(-0.5 * min(a - least, 500.0)) if math.isfinite(a) else 0.0 for a in aicc]
        out += [(g, m[0], m[1], n, float(m[2]), float(m[4]), float(m[3]), float(a) if math.isfinite(a) else None, float(w / sum(weights)) if sum(weights) else None, int(a == least)) for m, a, w in zip(models, aicc, weights, strict=True)]
    return rows.sparkSession.createDataFrame(out, f"{group} string, model string, k int, n bigint, slope double, kappa double, loglik double, aicc double, weight double, best int")


def flowering(state: Column, verified: Column, heads: Column, doy: Column, first: int, last: int) -> Column:
    """Whether a sheet flowers: by its state; where that is unknown by ``verified``, then by a count of open heads; never
    before ``first`` or after ``last``. 'Bud', 'fruit', 'sterile' and the like are not, nor what is before or after."""
    text = F.lower(F.trim(state))
    unknown = text.isNull() | text.isin("", "unknown")
    no = text.isin("bud", "fruit", "sterile", "vegetative", "fruiting", "senescent") | text.rlike("(?:pre|post|non)[_-]?anthesis")
    by_state = F.when(no, False).otherwise(text.rlike("anthesis|flower"))
    open_ = F.when(unknown, F.coalesce(verified, heads >= 1, F.lit(False))).otherwise(by_state)
    return open_ & F.coalesce(doy.between(first, last), F.lit(True))


def season_affinity(rows: DataFrame, doy: str, group: str, spread: float = 21.0, weight: str | None = None) -> DataFrame:
    """a < b, days, affinity: how far the mean days of two groups lie apart, and exp(−days² / 2 spread²). Groups without
    a day have no row. The pairs are those of groups, not of rows."""
    t, w = radians_of_day(F.col(doy)), F.lit(1.0) if weight is None else F.col(weight)
    mean = rows.filter(F.col(doy).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.atan2(F.sum(w * F.sin(t)), F.sum(w * F.cos(t))).alias("m"))
    x, y = mean.alias("x"), mean.alias("y")
    gap = F.abs(F.atan2(F.sin(F.col("x.m") - F.col("y.m")), F.cos(F.col("x.m") - F.col("y.m")))) * (365.25 / (2 * math.pi))
    met = x.join(y, F.col("x.g") < F.col("y.g")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), gap.alias("days"))
    return met.withColumn("affinity", F.exp(-F.col("days") * F.col("days") / (2 * spread * spread)))
