"""Multivariate statistics on vectors: moments as distributed aggregates, small algebra on the driver.

A model is fitted from moments (counts, means, cross products), whose size depends on the number of columns and
classes only; the rows themselves never leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Columns of a model: moments have the square of it, so it is what bounds the driver's part.
MOST_COLUMNS = 2000


def moments(rows: DataFrame, vector: str, group: str | None = None, weight: str | None = None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """group → (weight, mean, scatter about the mean) of the complete vectors; one partial row a partition and group."""
    width = rows.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).agg(F.max("n")).first()[0] or 0
    if width > MOST_COLUMNS:
        raise ValueError(f"vectors of {width} columns; at most {MOST_COLUMNS}")
    df = rows.select(
        (F.col(group).cast("string") if group else F.lit("all")).alias("g"), F.col(vector).cast("array<double>").alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    ).filter(F.col("g").isNotNull() & F.col("x").isNotNull() & (F.size("x") == width) & (F.col("w") > 0))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), width)
            ok = np.isfinite(x).all(axis=1)
            for g, at in pdf[ok].groupby("g").indices.items():
                v, w = x[ok][at], pdf["w"].to_numpy()[ok][at]
                new = [w.sum(), w @ v, (v * w[:, None]).T @ v]
                held[g] = [a + b for a, b in zip(held[g], new, strict=True)] if g in held else new
        yield pd.DataFrame([(g, float(n), s.tolist(), q.ravel().tolist()) for g, (n, s, q) in held.items()], columns=["g", "n", "s", "q"])

    parts = df.mapInPandas(partial, "g string, n double, s array<double>, q array<double>")
    flat = parts.select("g", F.posexplode(F.concat(F.array("n"), "s", "q")).alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in flat.collect():  # groups × (1 + columns + columns²) numbers
        out.setdefault(r["g"], np.zeros(1 + width + width * width))[r["i"]] = r["v"]
    result = {}
    for g, a in sorted(out.items()):
        n, s, q = a[0], a[1 : 1 + width], a[1 + width :].reshape(width, width)
        result[g] = (float(n), s / n, q - np.outer(s, s) / n)
    return result


def shrink(covariance: np.ndarray, share: float) -> np.ndarray:
    """Towards the mean variance times identity."""
    p = len(covariance)
    return (1 - share) * covariance + share * np.trace(covariance) / p * np.eye(p)


def oracle_shrinkage(covariance: np.ndarray, n: float) -> float:
    """The share of shrinkage that minimises the expected error for normal data."""
    p, t, t2 = len(covariance), float(np.trace(covariance)), float((covariance * covariance).sum())
    down = (n + 1 - 2 / p) * (t2 - t * t / p)
    return 1.0 if down <= 0 else float(min(1.0, ((1 - 2 / p) * t2 + t * t) / down))


@dataclass
class Axes:
    """A linear projection fitted from moments."""

    centre: np.ndarray
    axes: np.ndarray
    values: np.ndarray

    def scores(self, rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """``keep`` and the scores as an array, by column expressions only."""
        x = F.col(vector).cast("array<double>")
        centred = F.zip_with(x, F.array(*[F.lit(float(c)) for c in self.centre]), lambda a, b: a - b)
        dot = lambda axis: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return rows.select(*keep, F.array(*[dot(a) for a in self.axes]).alias("scores"))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive, so that signs don't depend on the platform."""
    at = np.abs(vectors).argmax(axis=1)
    return vectors * np.sign(vectors[np.arange(len(vectors)), at])[:, None]


def principal_axes(rows: DataFrame, vector: str, share: float = 0.95, weight: str | None = None) -> Axes:
    """The fewest principal axes that hold ``share`` of the variance."""
    n, mean, scatter = moments(rows, vector, weight=weight)["all"]
    values, vectors = np.linalg.eigh(scatter / max(n - 1, 1))
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    return Axes(mean, _signed(vectors[:k]), values[:k])


@dataclass
class Discriminant:
    """Shrinkage discriminant with equal priors."""

    classes: list[str]
    means: np.ndarray
    precision: np.ndarray

    def predict(self, rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """``keep``, predicted, posterior, second, margin, d2 (squared distance to the predicted class)."""
        x = F.col(vector).cast("array<double>")
        linear, constant = self.means @ self.precision, np.einsum("ij,jk,ik->i", self.means, self.precision, self.means)
        dot = lambda a: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in a]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        scores = F.array(*[F.struct((dot(w) - float(c) / 2).alias("s"), F.lit(k).alias("c")) for k, w, c in zip(self.classes, linear, constant, strict=True)])
        ranked = rows.select(*keep, F.sort_array(scores, asc=False).alias("r"))
        top = F.col("r")[0]["s"]
        total = F.aggregate("r", F.lit(0.0), lambda s, v: s + F.exp(v["s"] - top))
        second = F.exp(F.col("r")[1]["s"] - top) / total
        return ranked.select(*keep, F.col("r")[0]["c"].alias("predicted"), (1 / total).alias("posterior"), F.col("r")[1]["c"].alias("second"), (1 / total - second).alias("margin"))


def shrinkage_discriminant(rows: DataFrame, vector: str, label: str, share: float | None = None) -> Discriminant:
    """Fitted from the classes' moments; the pooled covariance shrunk by ``share``, or by the oracle share."""
    per = moments(rows, vector, label)
    n = sum(m[0] for m in per.values())
    pooled = sum(m[2] for m in per.values()) / max(n - len(per), 1)
    share = oracle_shrinkage(pooled, n) if share is None else share
    return Discriminant(list(per), np.array([m[1] for m in per.values()]), np.linalg.inv(shrink(pooled, share) + 1e-12 * np.eye(len(pooled))))


def mahalanobis(rows: DataFrame, vector: str, keep: list[str], share: float | None = None) -> DataFrame:
    """``keep`` and d2, the squared distance from the mean under the shrunken covariance."""
    n, mean, scatter = moments(rows, vector)["all"]
    cov = scatter / max(n - 1, 1)
    inverse = np.linalg.inv(shrink(cov, oracle_shrinkage(cov, n) if share is None else share) + 1e-12 * np.eye(len(cov)))
    root = np.linalg.cholesky(inverse).T
    scores = Axes(mean, root, np.ones(len(root))).scores(rows, vector, keep)
    return scores.select(*keep, F.aggregate("scores", F.lit(0.0), lambda s, v: s + v * v).alias("d2"))


def chi2_quantile(p: float, k: int) -> float:
    """By bisection on the regularised lower incomplete gamma function."""

    def lower(a: float, x: float) -> float:
        if x <= 0:
            return 0.0
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h

    lo, hi = 0.0, float(k) + 200 + 10 * k
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower(k / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + step * d) or 1e-300), (1 + step / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """The probability of an F statistic of at least ``f``."""
    return 1.0 if f <= 0 else beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): each distinct value with its average rank from 1; one row a value, ranked over sorted
    partitions."""
    from .aggregates import running_total

    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").cast("double").alias("n"))
    total = running_total(counts, value, "n")
    return total.select(value, "n", (F.col("total_n") - (F.col("n") - 1) / 2).alias("rank"))


def kruskal_wallis(rows: DataFrame, value: str, group: str) -> DataFrame:
    """h, k, n: tie-corrected rank test of the groups."""
    ranks = average_ranks(rows.filter(F.col(group).isNotNull()), value)
    per = rows.filter(F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("m")).join(ranks.select(value, "rank"), value)
    sums = per.groupBy(group).agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("m"))
    ties = ranks.agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("t"))
    one = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.count("*").alias("k")).crossJoin(ties)  # single rows
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return one.select((h / F.nullif(1 - F.col("t") / (F.pow(n, F.lit(3.0)) - n), F.lit(0.0))).alias("h"), "k", n.cast("bigint").alias("n"))


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The splitmix64 finaliser of x and a key."""
    x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudo-random permutation of 0 … n - 1, one for each ``key``, puts each index: an eight-round balanced
    Feistel network over the next even power of two (256 at least), applied again to what falls beyond n."""
    half = np.uint64(max(4, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, top = (np.uint64(1) << half) - np.uint64(1), np.uint64(64) - half
    keys = [int(_mixed(np.array([key * 8 + r], np.uint64), 0)[0]) for r in range(8)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) >> top)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


#: Numbers that a task holds for the relabellings of one pass.
PASS_NUMBERS = 8_000_000


def permutation_f(rows: DataFrame, vector: str, group: str, key: str, times: int = 999, seed: int = 42) -> DataFrame:
    """f, p, times: the trace ratio between and within groups, against relabellings; p = (1 + as large) / (1 + times).

    Each relabelling is a true permutation of the labels, so the groups keep their sizes: rows are numbered in the order
    of the unique ``key`` and a seeded permutation of the numbers deals the labels. A task sums its rows by relabelling
    and label; passes hold as many relabellings as PASS_NUMBERS allows. Rows without group or vector don't count; fewer
    than two groups, or no more rows than groups, give nulls."""
    from .aggregates import running_total

    base = rows.filter(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("x"), F.lit(1.0).alias("one"))
    base = running_total(base, "k", "one").select((F.col("total_one") - 1).cast("bigint").alias("i"), "g", "x")
    sizes = {r["g"]: r["n"] for r in base.groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect()}  # one row a group
    n, names = sum(sizes.values()), list(sizes)
    out = "f double, p double, times int"
    if len(names) < 2 or n <= len(names):
        return rows.sparkSession.createDataFrame([(None, None, times)], out)
    total = base.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    width, q, c = total.agg(F.count("*"), F.sum("q"), F.sum(F.col("s") * F.col("s") / F.lit(n))).first()
    code, edges, counts = {g: i for i, g in enumerate(names)}, np.cumsum(list(sizes.values())), np.array(list(sizes.values()), float)
    step = max(1, PASS_NUMBERS // (len(names) * width))
    squares: dict[int, float] = {}
    for first in range(0, times + 1, step):
        turns = range(first, min(times + 1, first + step))

        def partial(batches: Iterator[pd.DataFrame], turns=turns) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(turns), len(names), width))
            for pdf in batches:
                x, at = np.array(pdf["x"].tolist(), float).reshape(len(pdf), width), pdf["i"].to_numpy()
                for k, b in enumerate(turns):
                    label = pdf["g"].map(code).to_numpy() if b == 0 else np.searchsorted(edges, permuted(at, n, seed * 1_000_003 + b), side="right")
                    one = np.zeros((len(names), len(pdf)))
                    one[label, np.arange(len(pdf))] = 1.0
                    sums[k] += one @ x
            yield pd.DataFrame({"b": list(turns), "s": [v.ravel().tolist() for v in sums]})

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            s = np.sum([np.array(v) for v in pdf["s"]], axis=0).reshape(len(names), width)
            return pd.DataFrame({"b": [pdf["b"].iloc[0]], "ss": [float((s * s / counts[:, None]).sum())]})

        for r in base.mapInPandas(partial, "b int, s array<double>").groupBy("b").applyInPandas(whole, "b int, ss double").collect():  # one row a relabelling
            squares[r["b"]] = r["ss"]
    f = {b: (ss - c) / (len(names) - 1) / ((q - ss) / (n - len(names))) if q > ss else math.inf for b, ss in squares.items()}
    return rows.sparkSession.createDataFrame([(f[0], (1 + sum(f[b] >= f[0] for b in f if b)) / (1 + times), times)], out)


def collinear_prune(rows: DataFrame, columns: list[str], scores: dict[str, float], most: float = 0.7) -> list[str]:
    """Columns accepted from the highest score down while |r| with all accepted stays below ``most``; correlations over
    complete pairs, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    r = {frozenset(p): got[f"r{i}"] for i, p in enumerate(pairs)}
    kept: list[str] = []
    for c in sorted(columns, key=lambda c: (-scores.get(c, 0.0), c)):
        if all((v := r[frozenset((c, k))]) is None or v != v or abs(v) < most for k in kept):
            kept.append(c)
    return kept


def schoener_overlap(rows: DataFrame, group: str, value: str, bins: int = 50) -> DataFrame:
    """a < b, d, i: niche overlap of each pair of groups over ``bins`` equal steps of the value's range."""
    known = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    span = known.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = known.crossJoin(span).select(group, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)).alias("bin"))  # one row
    counts = step.groupBy(group, "bin").agg(F.count("*").alias("n"))
    share = counts.join(counts.groupBy(group).agg(F.sum("n").alias("t")), group).select(F.col(group).alias("g"), "bin", (F.col("n") / F.col("t")).alias("p"))
    x, y = share.alias("x"), share.alias("y")
    met = x.join(y, (F.col("x.bin") == F.col("y.bin")) & (F.col("x.g") < F.col("y.g")))
    # Σ|p − q| = 2 − 2 Σ min(p, q) over shared bins
    return met.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.sum(F.least("x.p", "y.p")).alias("d"), F.sum(F.sqrt(F.col("x.p") * F.col("y.p"))).alias("i"))


def _spearman(a: np.ndarray, b: np.ndarray) -> float:
    rank = lambda x: pd.Series(x).rank().to_numpy()
    return float(np.corrcoef(rank(a), rank(b))[0, 1])


def boyce_index(rows: DataFrame, score: str, present: str, bins: int = 20) -> DataFrame:
    """rho: Spearman correlation of the predicted-to-expected ratio with suitability, to four places.

    The ratio is that of presences (``present`` = 1) to all rows in ``bins`` overlapping windows a tenth of the range
    wide (a quarter, and at least six and at most as many windows as presences, below 25 presences). Where fewer than
    five windows have rows, or their ratios are all equal, windows between every other quantile stand in. Null below two
    presences or four rows; 0 where the scores or the ratios are all equal. Rows with a null or infinite score, or null
    presence, don't count. One aggregate of as many counts as windows."""
    spark = rows.sparkSession
    s, y = F.col("s"), F.col("y")
    known = rows.select(F.col(score).cast("double").alias("s"), F.col(present).cast("int").alias("y")).filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < math.inf) & y.isNotNull())
    lo, hi, n_all, n_here = known.agg(F.min("s"), F.max("s"), F.count("*"), F.count_if(y == 1)).first()
    answer = lambda v: spark.createDataFrame([(v,)], "rho double")
    if n_here < 2 or n_all < 4:
        return answer(None)
    if hi - lo < 1e-8:
        return answer(0.0)

    def ratios(windows: list[tuple[float, float]]) -> np.ndarray:
        inside = [s.between(F.lit(a), F.lit(b)) for a, b in windows]
        got = known.agg(*[F.count_if(w).alias(f"a{i}") for i, w in enumerate(inside)], *[F.count_if(w & (y == 1)).alias(f"p{i}") for i, w in enumerate(inside)]).first()
        return np.array([(got[f"p{i}"] / n_here) / (got[f"a{i}"] / n_all) if got[f"a{i}"] else np.nan for i in range(len(windows))])

    few = n_here < 25
    k = min(max(6, n_here), bins) if few else max(5, bins)
    w = max((hi - lo) / (4.0 if few else 10.0), 1e-4)
    centres = np.array([lo + 0.5 * w + i * (hi - lo - w) / (k - 1.0) for i in range(k)])
    ratio = ratios([(m - 0.5 * w, m + 0.5 * w) for m in centres.tolist()])
    ok = np.isfinite(ratio)
    flat = lambda r: len(r) < 2 or np.std(r, ddof=1) < 1e-10
    if ok.sum() < 5 or flat(ratio[ok]):
        n_values = known.select(F.round("s", 6)).distinct().count()
        if n_values >= 6:
            n_q = min(12, max(5, n_values // 4))
            edges = known.agg(F.percentile("s", F.array(*[F.lit(i / (n_q + 1)) for i in range(n_q + 2)]))).first()[0]
            other = ratios([(edges[i], edges[i + 2]) for i in range(n_q)])
            if np.isfinite(other).sum() >= 4 and not flat(other[np.isfinite(other)]):
                ratio, ok = other, np.isfinite(other)
                centres = np.array([(edges[i] + edges[i + 2]) / 2 for i in range(n_q)])
    if ok.sum() < 3 or flat(ratio[ok]):
        return answer(0.0)
    rho = _spearman(centres[ok], ratio[ok])
    return answer(round(rho, 4) if math.isfinite(rho) else 0.0)


def variogram(pairs: DataFrame, metres: str, a: str, b: str, step_m: float) -> DataFrame:
    """lag, n, gamma: half the mean squared difference by distance class of neighbouring pairs."""
    return pairs.groupBy(F.floor(F.col(metres) / step_m).alias("lag")).agg(F.count("*").alias("n"), (F.avg(F.pow(F.col(a) - F.col(b), F.lit(2.0))) / 2).alias("gamma"))


@dataclass
class Mixture:
    """A fitted diagonal Gaussian mixture; ``entropy`` is that of the rows' shares in the components, over all rows."""

    k: int
    weights: list[float]
    means: np.ndarray
    variances: np.ndarray
    like: float
    entropy: float
    n: float

    @property
    def bic(self) -> float:
        """−2 log-likelihood and log n for each free number: smaller is better."""
        return -2 * self.like + (2 * self.k * self.means.shape[1] + self.k - 1) * math.log(max(self.n, 1))

    @property
    def icl(self) -> float:
        """BIC that also charges components that overlap."""
        return self.bic + 2 * self.entropy


def fit_mixtures(rows: DataFrame, vector: str, ks: Iterable[int], rounds: int = 150) -> list[Mixture]:
    """A mixture for each number of components, by expectation-maximisation until its log-likelihood settles (``rounds``
    at most). A round is one pass over the rows for all mixtures not settled, with partial sums on the executors only;
    vectors with a value that is not finite don't count. All start along the first principal axis."""
    axes = principal_axes(rows, vector, 0.0)
    n, mean, scatter = moments(rows, vector)["all"]
    var, p = np.maximum(np.diag(scatter) / n, 1e-9), len(mean)
    spread = np.sqrt(axes.values[0])
    state = {k: (np.full(k, 1 / k), np.array([mean + axes.axes[0] * spread * (2 * (i + 0.5) / k - 1) * 1.5 for i in range(k)]), np.tile(var, (k, 1))) for k in ks}
    fits: dict[int, Mixture] = {}
    df = rows.select(F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    moving = dict(state)
    for _ in range(rounds):

        def step(batches: Iterator[pd.DataFrame], moving: dict = dict(moving)) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), p)
                x = x[np.isfinite(x).all(axis=1)]
                for k, (w, m, v) in moving.items():
                    log = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + (x * x) @ (1 / v).T - 2 * x @ (m / v).T + (m * m / v).sum(axis=1))
                    top = log.max(axis=1, keepdims=True)
                    total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
                    r = np.exp(log - total[:, None])
                    unsure = -(r * np.log(np.maximum(r, 1e-300))).sum()
                    part = np.concatenate([[total.sum(), unsure], r.sum(axis=0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()])
                    sums[k] = part + sums.get(k, 0.0)
            for k, part in sums.items():
                yield pd.DataFrame({"k": k, "i": np.arange(len(part)), "v": part})

        got = df.mapInPandas(step, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()  # model-sized
        settled = []
        for k, (weights, means, variances) in moving.items():
            sums = got[got["k"] == k].sort_values("i")["v"].to_numpy()
            size = np.maximum(sums[2 : 2 + k], 1e-12)
            first, second = (sums[2 + k + j * k * p : 2 + k + (j + 1) * k * p].reshape(k, p) / size[:, None] for j in (0, 1))
            before, fits[k] = fits.get(k), Mixture(k, weights.tolist(), means, variances, float(sums[0]), float(sums[1]), n)
            state[k] = (size / size.sum(), first, np.maximum(second - first**2, 1e-9))
            if before and abs(fits[k].like - before.like) < 1e-6 * abs(fits[k].like):
                settled.append(k)
        moving = {k: state[k] for k in moving if k not in settled}
        if not moving:
            break
    return [Mixture(k, state[k][0].tolist(), state[k][1], state[k][2], fits[k].like, fits[k].entropy, n) for k in state]


def mixture(rows: DataFrame, vector: str, k: int, rounds: int = 150) -> tuple[list[float], np.ndarray, np.ndarray, float]:
    """(weights, means, variances, log-likelihood) of one mixture of fit_mixtures."""
    m = fit_mixtures(rows, vector, [k], rounds)[0]
    return m.weights, m.means, m.variances, m.like



def group_differences(rows: DataFrame, vector: str, group: str, weight: str | None = None) -> DataFrame:
    """pillai, f, p, wilks, groups, n: a multivariate analysis of variance of the groups' mean vectors, from the groups'
    moments alone. Nulls for fewer than two groups or too few rows."""
    per = moments(rows, vector, group, weight)
    spark, n, k = rows.sparkSession, sum(m[0] for m in per.values()), len(per)
    schema = "pillai double, f double, p double, wilks double, groups int, n double"
    width = len(next(iter(per.values()))[1]) if per else 0
    if k < 2 or n - k <= width:
        return spark.createDataFrame([(None, None, None, None, k, float(n))], schema)
    centre = sum(m[0] * m[1] for m in per.values()) / n
    within = sum(m[2] for m in per.values())
    between = sum(m[0] * np.outer(m[1] - centre, m[1] - centre) for m in per.values())
    total = within + between + 1e-12 * np.trace(within) / width * np.eye(width)
    pillai = float(np.trace(np.linalg.solve(total, between)))
    wilks = float(np.exp(np.linalg.slogdet(within)[1] - np.linalg.slogdet(total)[1]))
    s = min(width, k - 1)
    m, r = (abs(width - k + 1) - 1) / 2, (n - k - width - 1) / 2
    d1, d2 = s * (2 * m + s + 1), s * (2 * r + s + 1)
    f = (2 * r + s + 1) / (2 * m + s + 1) * pillai / max(s - pillai, 1e-12)
    return spark.createDataFrame([(pillai, float(f), f_tail(f, d1, d2), wilks, k, float(n))], schema)


def niche_identity(rows: DataFrame, value: str, group: str, key: str, a: str, b: str, bins: int = 50, times: int = 999, seed: int = 42) -> DataFrame:
    """d, i, p_d, p_i, times: niche overlap of two groups over equal steps of the value's range (Schoener's d and the
    Hellinger-based i), and how often relabelled rows overlap no more: (1 + as small) / (1 + times). Relabellings are true
    permutations in the order of the unique ``key``. Nulls unless both groups have rows of different values."""
    from .aggregates import running_total

    base = rows.filter(F.col(group).cast("string").isin(a, b) & F.col(value).isNotNull()).select(F.col(key).alias("k"), (F.col(group).cast("string") == a).cast("int").alias("g"), F.col(value).cast("double").alias("v"), F.lit(1.0).alias("one"))
    lo, hi, n, n_a = base.agg(F.min("v"), F.max("v"), F.count("*"), F.coalesce(F.sum("g"), F.lit(0))).first()
    schema = "d double, i double, p_d double, p_i double, times int"
    if not n or n_a in (0, n) or hi <= lo:
        return rows.sparkSession.createDataFrame([(None, None, None, None, times)], schema)
    kept = running_total(base, "k", "one").select((F.col("total_one") - 1).cast("bigint").alias("i"), "g", F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * bins)).cast("int").alias("bin"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((times + 1, bins))
        for pdf in batches:
            at, step = pdf["i"].to_numpy(), pdf["bin"].to_numpy()
            for t in range(times + 1):
                first = pdf["g"].to_numpy() == 1 if t == 0 else permuted(at, n, seed * 1_000_003 + t) < n_a
                sums[t] += np.bincount(step[first], minlength=bins)
        yield pd.DataFrame({"t": np.arange(times + 1), "c": sums.tolist()})

    whole = np.zeros(bins)
    for r in kept.groupBy("bin").agg(F.count("*").alias("n")).collect():  # one row a bin
        whole[r["bin"]] = r["n"]

    def overlap(pdf: pd.DataFrame) -> pd.DataFrame:
        one = np.sum([np.array(c) for c in pdf["c"]], axis=0)
        p, q = one / n_a, (whole - one) / (n - n_a)
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "d": [float(np.minimum(p, q).sum())], "i": [float(np.sqrt(p * q).sum())]})

    got = kept.mapInPandas(partial, "t int, c array<double>").groupBy("t").applyInPandas(overlap, "t int, d double, i double").toPandas().set_index("t")  # one row a relabelling
    share = lambda c: float((1 + (got[c].drop(0) <= got[c][0] + 1e-12).sum()) / (1 + times))
    return rows.sparkSession.createDataFrame([(float(got["d"][0]), float(got["i"][0]), share("d"), share("i"), times)], schema)


def batch_effects(rows: DataFrame, response: str, batch: str, group: str, weight: str | None = None, least: int = 5) -> DataFrame:
    """df, ss, rss, f, p, partial_eta_sq, n: what the batches (those of at least ``least`` rows) explain of the response
    beside the groups: the rise in weighted residual squares when the batches are dropped from the additive model. Fitted
    from the sums of each combination of group and batch. Nulls for fewer than two batches or six rows."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = rows.select(F.trim(F.col(batch).cast("string")).alias("b"), F.trim(F.col(group).cast("string")).alias("g"), F.col(response).cast("double").alias("y"), w.alias("w")).filter("b <> '' AND g <> '' AND y IS NOT NULL AND w > 0")
    cells = known.groupBy("b", "g").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy")).toPandas()  # batches × groups
    enough = cells.groupby("b")["n"].sum()
    cells = cells[cells["b"].isin(enough[enough >= least].index)].reset_index(drop=True)
    n, batches, groups = int(cells["n"].sum()), cells["b"].nunique(), cells["g"].nunique()
    schema = "df int, ss double, rss double, f double, p double, partial_eta_sq double, n bigint"
    rest = n - batches - groups + 1
    if batches < 2 or n < 6 or rest < 1:
        return rows.sparkSession.createDataFrame([(None, None, None, None, None, None, n)], schema)

    def residual(*factors: str) -> float:
        x = np.hstack([pd.get_dummies(cells[f]).to_numpy(float) for f in factors])
        root = np.sqrt(cells["w"].to_numpy())
        mean = cells["wy"].to_numpy() / cells["w"].to_numpy()
        fitted = x @ np.linalg.lstsq(x * root[:, None], mean * root, rcond=None)[0]
        return float(cells["wyy"].sum() - 2 * (fitted * cells["wy"]).sum() + (fitted**2 * cells["w"]).sum())

    rss, without = residual("g", "b"), residual("g")
    ss = max(0.0, without - rss)
    f = ss / (batches - 1) / (rss / rest) if rss > 0 else math.inf
    p = f_tail(f, batches - 1, rest) if math.isfinite(f) else 0.0
    return rows.sparkSession.createDataFrame([(batches - 1, ss, rss, f, p, ss / (ss + rss) if ss + rss > 0 else 0.0, n)], schema)
