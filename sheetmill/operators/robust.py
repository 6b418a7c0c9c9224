"""Robust centres, anchors with fallbacks, sequence clusters and tree distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_table, release
from .genomics import Packed, _Pairs, mean_difference
from .stats import chi2_quantile

#: Rows that one task fits at once. A larger group is fitted in hash parts, which only give the candidates for the one
#: fit of the whole group; at most CANDIDATES of its parts are fitted, as more candidates don't make more rows count.
PART_ROWS = 20_000
CANDIDATES = 32
#: Rows of a range of distances that is small enough to be listed value by value.
LISTED_ROWS = 4_096


def minimum_covariance(x: np.ndarray, starts: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(centre, covariance) of the half of the rows with the smallest determinant found by concentration steps, made
    consistent for normal data by the median distance."""
    n, p = x.shape
    h = max((n + p + 1) // 2, p + 1)
    rng = np.random.default_rng(seed)
    best = (math.inf, np.arange(n))

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows.mean(axis=0), np.cov(rows.T).reshape(p, p) + 1e-9 * np.eye(p)

    for _ in range(starts):
        keep = rng.choice(n, min(n, p + 2), replace=False)
        for _ in range(30):
            centre, cov = fit(x[keep])
            d = x - centre
            fresh = np.sort(np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d), kind="stable")[:h])
            if np.array_equal(fresh, keep):
                break
            keep = fresh
        best = min(best, (float(np.linalg.slogdet(fit(x[keep])[1])[1]), keep), key=lambda b: b[0])
    centre, cov = fit(x[best[1]])
    d = x - centre
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)
    return centre, cov * max(float(np.median(d2)) / chi2_quantile(0.5, p), 1e-12)


Fits = dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]


def _distances(batches: Iterator[pa.RecordBatch], fits: Fits) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray, np.ndarray]]:
    """(group, candidate), its keys, their offsets from the centre and squared distances, batch by batch."""
    of: dict[str, list] = {}
    for (g, c), (centre, cov) in fits.items():
        of.setdefault(g, []).append((c, centre, np.linalg.pinv(cov)))
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for g, at in pd.DataFrame({"g": batch.column("g").to_pandas()}).groupby("g").indices.items():
            keys = batch.column("k").take(pa.array(at))
            for c, centre, inverse in of.get(g, ()):
                d = v[at] - centre
                yield (g, c), keys, d, np.maximum(((d @ inverse) * d).sum(axis=1), 0.0)


def _smallest(rows: DataFrame, fits: Fits, rank: dict[tuple[str, int], int]) -> dict[tuple[str, int], tuple[float, int, int]]:
    """(value, rows below it, rows at it) of the rank-th smallest distance under each fit, exact: counts of ever
    narrower ranges of the distances' bits, which order as the distances do; only the counts reach the driver."""
    left = {at: (0, 63, 44, 0) for at in fits}  # range, its width and the next one's in bits, rows below it
    found: dict[tuple[str, int], tuple[float, int, int]] = {}
    while left:

        def count(batches: Iterator[pa.RecordBatch], left=dict(left)) -> Iterator[pa.RecordBatch]:
            for (g, c), _, _, d2 in _distances(batches, {at: fits[at] for at in left}):
                prefix, width, shift, _ = left[g, c]
                bits = d2.view(np.int64)
                b, n = np.unique(bits[bits >> width == prefix] >> shift, return_counts=True)
                yield pa.RecordBatch.from_pydict({"g": [g] * len(b), "c": [c] * len(b), "b": b, "n": n}, schema=pa.schema({"g": pa.string(), "c": pa.int64(), "b": pa.int64(), "n": pa.int64()}))

        got = rows.mapInArrow(count, "g string, c bigint, b bigint, n bigint").groupBy("g", "c", "b").agg(F.sum("n").alias("n")).toPandas()
        for at, part in got.sort_values("b").groupby(["g", "c"]):
            _, _, shift, below = left.pop(at)
            run = below + part["n"].cumsum().to_numpy()
            i = int(np.searchsorted(run, rank[at]))
            b, n = int(part["b"].iloc[i]), int(part["n"].iloc[i])
            if shift:
                left[at] = (b, shift, 0 if n <= LISTED_ROWS else max(shift - 20, 0), int(run[i]) - n)
            else:
                found[at] = (float(np.int64(b).view(np.float64)), int(run[i]) - n, n)
    return found


def _concentrate(rows: DataFrame, fits: Fits, half: dict[str, int]) -> Fits:
    """One concentration step of every fit over all rows of its group: mean and covariance of the ``half`` nearest
    rows; rows tied at the limit share what is left of it."""
    limits = _smallest(rows, fits, {at: half[at[0]] for at in fits})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for at, _, d, d2 in _distances(batches, fits):
            value, below, tied = limits[at]
            w = (d2 < value) + (d2 == value) * (half[at[0]] - below) / tied
            sums = held.setdefault(at, [0.0, 0.0])
            sums[0] = sums[0] + w @ d
            sums[1] = sums[1] + (d * w[:, None]).T @ d
        for (g, c), (s, q) in held.items():
            yield pa.RecordBatch.from_pydict({"g": [g], "c": [c], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    out: dict[tuple[str, int], list] = {}
    for r in rows.mapInArrow(partial, "g string, c bigint, s array<double>, q array<double>").collect():  # one row a partition and fit
        sums = out.setdefault((r["g"], r["c"]), [0.0, 0.0])
        sums[0], sums[1] = sums[0] + np.array(r["s"]), sums[1] + np.array(r["q"])
    fresh: Fits = {}
    for at, (s, q) in out.items():
        h, p = half[at[0]], len(s)
        fresh[at] = (fits[at][0] + s / h, (q.reshape(p, p) - np.outer(s, s) / h) / (h - 1) + 1e-9 * np.eye(p))
    return fresh


def _whole_fits(rows: DataFrame, sizes: dict[str, int], least: int) -> Fits:
    """(group, 0) → (centre, covariance) of groups too large for one task (g, k, v; finite): parts by a hash of the key
    give candidates, all take two concentration steps over all rows of the group, and the one with the smallest
    determinant takes them until it settles. One covariance estimate for all rows, as minimum_covariance."""
    count = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, math.ceil(n / PART_ROWS))])
    cut = rows.withColumn("part", F.pmod(F.xxhash64(F.col("k").cast("string")), count[F.col("g")]).cast("int")).filter(F.col("part") < CANDIDATES)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("k")["v"].tolist(), float)
        if len(x) < max(least, x.shape[1] + 2):
            return pd.DataFrame(columns=["g", "c", "centre", "cov"])
        centre, cov = minimum_covariance(x)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "c": [pdf["part"].iloc[0]], "centre": [centre.tolist()], "cov": [cov.ravel().tolist()]})

    fits: Fits = {}
    for r in cut.groupBy("g", "part").applyInPandas(fit, "g string, c int, centre array<double>, cov array<double>").collect():
        fits[r["g"], r["c"]] = (np.array(r["centre"]), np.array(r["cov"]).reshape(len(r["centre"]), -1))
    size = lambda f: float(np.linalg.slogdet(f[1])[1])
    half = {g: (sizes[g] + len(f[0]) + 1) // 2 for (g, _), f in fits.items()}
    for _ in range(2):
        fits = _concentrate(rows, fits, half)
    best: Fits = {}
    for g in half:
        best[g, 0] = min((fits[at] for at in sorted(fits) if at[0] == g), key=size)
    moving = dict(best)
    for _ in range(30):
        fresh = _concentrate(rows, moving, half)
        moving = {at: f for at, f in fresh.items() if size(f) < size(best[at]) - 1e-12}
        best |= moving
        if not moving:
            break
    middle = [_smallest(rows, best, {at: (sizes[at[0]] + up) // 2 for at in best}) for up in (1, 2)]
    consistent = lambda at, p: max((middle[0][at][0] + middle[1][at][0]) / 2 / chi2_quantile(0.5, p), 1e-12)
    return {at: (centre, cov * consistent(at, len(centre))) for at, (centre, cov) in best.items()}


def robust_outliers(rows: DataFrame, group: str, key: str, vector: str, p: float = 0.995, least: int = 20) -> DataFrame:
    """key, d2, outlier: squared robust distance within the group; groups of fewer than ``least`` complete rows give
    null, as do rows that are not complete. Every group has one fit of all its rows: groups of up to PART_ROWS are
    independent tasks, larger ones are fitted by _whole_fits and scored where the rows are."""
    kind = rows.schema[key].dataType.simpleString()
    r = rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    known = r.filter(finite)
    sizes = {g: n for g, n in known.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ROWS).collect()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.array(pdf["v"].tolist(), float)
        d2 = np.full(len(pdf), np.nan)
        if len(x) >= max(least, x.shape[1] + 2):
            centre, cov = minimum_covariance(x)
            d = x - centre
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)
        limit = chi2_quantile(p, x.shape[1])
        return pd.DataFrame({"k": pdf["k"], "d2": d2, "outlier": (d2 > limit).astype("int32")})

    shape = f"k {kind}, d2 double, outlier int"
    out = known.filter(~F.col("g").isin(*sizes)).groupBy("g").applyInPandas(fit, shape)
    if sizes:
        big = cut_table(known.filter(F.col("g").isin(*sizes)))
        fits = _whole_fits(big, sizes, least)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, keys, d, d2 in _distances(batches, fits):
                yield pa.RecordBatch.from_arrays([keys, pa.array(d2), pa.array((d2 > chi2_quantile(p, d.shape[1])).astype("int32"))], ["k", "d2", "outlier"])

        out = out.unionByName(big.mapInArrow(score, shape))
    out = out.unionByName(r.filter(~finite).select("k", F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("outlier")))
    scored = F.col("d2").isNotNull() & ~F.isnan("d2")
    return out.select(F.col("k").alias(key), F.when(scored, F.col("d2")).alias("d2"), F.when(scored, F.col("outlier")).alias("outlier"))


def core_centre(rows: DataFrame, group: str, vector: str, share: float = 0.6) -> DataFrame:
    """group, centre: the mean of the ``share`` of a group's rows nearest to its componentwise median; aggregates only."""
    flat = rows.select(F.col(group).alias("g"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v"))
    mid = flat.groupBy("g", "i").agg(F.median("v").alias("m")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    d = rows.select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("x")).join(mid, "g")
    d = d.withColumn("d", F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    limit = d.groupBy("g").agg(F.percentile("d", F.lit(share)).alias("q"))
    near = d.join(limit, "g").filter("d <= q")
    mean = near.select("g", F.posexplode("x").alias("i", "v")).groupBy("g", "i").agg(F.avg("v").alias("m"))
    return mean.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")).withColumnRenamed("g", group)


def anchors_with_fallback(rows: DataFrame, group: str, levels: list[tuple[str, Column, int]]) -> DataFrame:
    """``rows`` of each group's first level that has enough of them, with its name in ``level``; groups where none has
    keep all rows as 'all'."""
    counts = rows.groupBy(group).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__{i}") for i, (_, c, _) in enumerate(levels)])
    level = F.when(F.lit(False), F.lit(""))
    for i, (name, _, least) in enumerate(levels):
        level = level.when(F.col(f"__{i}") >= least, name)
    chosen = rows.join(counts.select(group, level.otherwise("all").alias("level")), group)
    keep = F.col("level") == "all"
    for name, c, _ in levels:
        keep = keep | ((F.col("level") == name) & F.coalesce(c, F.lit(False)))
    return chosen.filter(keep)


def sequence_clusters(seqs: DataFrame, block: str, name: str, seq: str, k: int = 12, share: float = 0.9) -> DataFrame:
    """name, representative: in order of falling length, then name, each sequence of a block joins the first
    representative that holds ``share`` of its distinct k-mers, else becomes one. Blocks are independent tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf["s"].str.len()).sort_values(["n", "m"], ascending=[False, True])
        heads: list[tuple[str, set]] = []
        where: dict[str, list[int]] = {}
        out = []
        for m, s in zip(pdf["m"], pdf["s"], strict=True):
            grams = {s[i : i + k] for i in range(len(s) - k + 1)} or {s}
            hits: dict[int, int] = {}
            for g in grams:
                for h in where.get(g, ()):
                    hits[h] = hits.get(h, 0) + 1
            found = [h for h, c in hits.items() if c >= share * len(grams)]
            if found:
                out.append((m, heads[min(found)][0]))
                continue
            heads.append((m, grams))
            for g in grams:
                where.setdefault(g, []).append(len(heads) - 1)
            out.append((m, m))
        return pd.DataFrame(out, columns=["m", "representative"])

    r = seqs.filter(F.col(seq).isNotNull() & F.col(name).isNotNull()).select(F.col(block).cast("string").alias("b"), F.col(name).cast("string").alias("m"), F.col(seq).alias("s"))
    return r.groupBy("b").applyInPandas(run, "m string, representative string").withColumnRenamed("m", name)


def harmonic_power(rows: DataFrame, coefficients: str, share: float = 0.99) -> DataFrame:
    """n_harmonics, power: the fewest harmonics that hold ``share`` of the mean power of all outlines; ``coefficients``
    is a1, b1, c1, d1, a2, …"""
    flat = rows.select(F.posexplode(coefficients).alias("i", "v")).groupBy(F.floor(F.col("i") / 4).alias("h")).agg(F.sum(F.col("v") * F.col("v") / 2).alias("p"))
    w = Window.orderBy("h")  # one row a harmonic
    run = flat.withColumn("c", F.sum("p").over(w) / F.sum("p").over(Window.partitionBy(F.lit(1))))
    return run.filter(F.col("c") >= share).agg((F.min("h") + 1).cast("int").alias("n_harmonics"), F.min("c").alias("power"))


def tip_distances(edges: DataFrame, tree: str = "file") -> DataFrame:
    """tree, a < b, distance between the labelled tips of each tree (node, parent, label, length, root 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(pdf["node"], pdf["parent"], strict=True))
        length = {n: 0.0 if v is None or v != v else float(v) for n, v in zip(pdf["node"], pdf["length"], strict=True)}
        inner = {p for p in parent.values() if p == p and p is not None}
        tips = {lab: n for n, lab in zip(pdf["node"], pdf["label"], strict=True) if n not in inner and lab}

        def path(n: int) -> dict[int, float]:
            out, d = {}, 0.0
            while n == n and n is not None:
                out[int(n)] = d
                d += length[n]
                n = parent[n]
            return out

        up = {lab: path(n) for lab, n in tips.items()}
        names = sorted(up)
        rows = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                rows.append((a, b, min(up[a][n] + d for n, d in up[b].items() if n in up[a])))
        return pd.DataFrame([(pdf[tree].iloc[0], *r) for r in rows], columns=[tree, "a", "b", "distance"])

    return edges.groupBy(tree).applyInPandas(run, f"{tree} string, a string, b string, distance double")


def nearest_donors(cells: DataFrame, block: str, width: int = 10) -> DataFrame:
    """a, b, share: how often b is a nearest other sample of a over blocks of loci; equal donors share the block.
    Distances are equal to nine places. Of each pair of sample blocks only every sample's nearest are kept."""
    need = max(1, width // 2)

    def nearest(pairs: _Pairs, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        a, b = pairs.samples(kind)
        far = pairs.n < need
        d = mean_difference(pairs.s, np.maximum(pairs.n, 1))
        d *= 1e9
        d += 0.5
        d[far] = np.inf
        if pairs.pa == pairs.pb:
            np.fill_diagonal(d, np.inf)
        for x, y, grid in [(a, b, d)] + [(b, a, d.T)] * (pairs.pa != pairs.pb):
            if not grid.size:
                continue
            least = np.floor(grid.min(axis=1))
            i, j = np.nonzero(grid < least[:, None] + 1)  # equal when rounded; none where all are infinite
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), pairs.part)), pa.array(x[i], kind), pa.array(y[j], kind), pa.array(least[i].astype("int64"))], ["blk", "a", "b", "d"])

    packed = Packed(cells, block)
    release(packed.known)
    d = packed.over_pairs(nearest, f"blk bigint, a {packed.kind}, b {packed.kind}, d bigint")
    near = d.groupBy("blk", "a").agg(F.min("d").alias("m"), F.collect_list(F.struct("d", "b")).alias("c"))
    near = near.select("a", F.filter("c", lambda x: x["d"] == F.col("m")).alias("c"))
    per = near.select("a", (1 / F.size("c")).alias("w"), F.explode("c").alias("c")).groupBy("a", F.col("c.b").alias("b")).agg(F.sum("w").alias("s"))
    per = cut_table(per)
    total = per.groupBy("a").agg(F.sum("s").alias("t"))
    return per.join(total, "a").select("a", "b", (F.col("s") / F.col("t")).alias("share"))
