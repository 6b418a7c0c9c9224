"""Tests, regressions, groupings and sequence comparisons that close the operator set."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.circular import radians_of_day
from ..session import cut_table
from .components import connected_components


# --- contingency -------------------------------------------------------------------------------------------------
def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 × 2 table: the tables of equal margins that are no more likely."""
    n, row, col = a + b + c + d, a + b, a + c

    def log_p(x: int) -> float:
        return sum(math.lgamma(v + 1) for v in (row, n - row, col, n - col)) - sum(math.lgamma(v + 1) for v in (n, x, row - x, col - x, n - row - col + x))

    lo, hi = max(0, row + col - n), min(row, col)
    seen = log_p(a)
    return min(1.0, sum(math.exp(v) for x in range(lo, hi + 1) if (v := log_p(x)) <= seen + 1e-9))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in t) else fisher_two_sided(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype="float64")


def association(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, odds_ratio, p of each combination against all others (half a case added to each cell for the ratio)."""
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = known.groupBy(a, b).agg(F.count("*").alias("n11"))
    total = n.agg(F.sum("n11").alias("t"))
    ra, rb = n.groupBy(a).agg(F.sum("n11").alias("ra")), n.groupBy(b).agg(F.sum("n11").alias("rb"))
    j = n.join(ra, a).join(rb, b).crossJoin(total)  # one row
    n10, n01 = F.col("ra") - F.col("n11"), F.col("rb") - F.col("n11")
    n00 = F.col("t") - F.col("ra") - F.col("rb") + F.col("n11")
    odds = (F.col("n11") + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))
    return j.select(a, b, F.col("n11").alias("n"), odds.alias("odds_ratio"), fisher_p("n11", n10, n01, n00).alias("p"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df, n of a contingency table, empty cells included: Σ o²/(ra·rb/n) − n."""
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    ra, rb = known.groupBy(a).agg(F.sum("o").alias("ra")), known.groupBy(b).agg(F.sum("o").alias("rb"))
    one = known.join(ra, a).join(rb, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("q"), F.sum("o").alias("n"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return one.select((F.col("n") * (F.col("q") - 1)).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.col("n").cast("bigint").alias("n"))


# --- regression and screening ------------------------------------------------------------------------------------
def allometry(rows: DataFrame, group: str, size: str, value: str, keep: list[str], gate: float = 0.05) -> DataFrame:
    """``keep``, group, residual: log value less its within-group regression on log size, back at the group's mean; the
    slope is pooled over groups and applied only where its R² reaches ``gate``. Two aggregates joined back."""
    r = rows.filter((F.col(size) > 0) & (F.col(value) > 0) & F.col(group).isNotNull()).select(*keep, group, F.ln(size).alias("__x"), F.ln(value).alias("__y"))
    per = r.groupBy(group).agg(F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"), F.sum(F.col("__x") * F.col("__x")).alias("xx"), F.sum(F.col("__x") * F.col("__y")).alias("xy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), F.count("*").alias("n"))
    sxx, sxy, syy = (F.sum(F.col(k) - F.col("n") * F.col(u) * F.col(v)) for k, u, v in (("xx", "__mx", "__mx"), ("xy", "__mx", "__my"), ("yy", "__my", "__my")))
    fit = per.agg(sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy")).select(F.when(F.col("sxy") * F.col("sxy") / F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0)) >= gate, F.col("sxy") / F.col("sxx")).otherwise(0.0).alias("__slope"))
    return r.join(per.select(group, "__mx"), group).crossJoin(fit).select(*keep, group, (F.col("__y") - F.col("__slope") * (F.col("__x") - F.col("__mx"))).alias("residual"))  # one row


def variance_inflation(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Of each column against the others, over complete rows: the diagonal of the inverse correlation matrix."""
    ok = rows.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = ok.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    r = np.eye(len(columns))
    for i, (a, b) in enumerate(pairs):
        v = got[f"r{i}"]
        r[columns.index(a), columns.index(b)] = r[columns.index(b), columns.index(a)] = 1.0 if a == b else (v or 0.0)
    return dict(zip(columns, np.diag(np.linalg.pinv(r)).tolist(), strict=True))


def weighted_z(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """``rows`` with z of ``value`` against the group's weighted mean and deviation; null without spread."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    w, x = F.when(ok, F.col(weight)), F.when(ok, F.col(value))
    per = rows.groupBy(by).agg((F.sum(w * x) / F.sum(w)).alias("__m"), (F.sum(w * x * x) / F.sum(w)).alias("__q"))
    sd = F.sqrt(F.greatest(F.col("__q") - F.col("__m") * F.col("__m"), F.lit(0.0)))
    return rows.join(per, by, "left").withColumn("weighted_z", F.when(sd > 1e-9, (F.col(value) - F.col("__m")) / sd)).drop("__m", "__q")


def timing_thresholds(rows: DataFrame, by: str, sd: str, pooled: float, low: tuple[float, float] = (10.0, 28.0), high: tuple[float, float] = (14.0, 35.0), least: int = 5) -> DataFrame:
    """by, early, late: two and two and a half deviations in days, clamped; groups of fewer than ``least`` take the pooled one."""
    s = F.when((F.col("n") >= least) & F.col(sd).isNotNull(), F.col(sd)).otherwise(pooled)
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return rows.select(by, clamp(2 * s, *low).alias("early"), clamp(2.5 * s, *high).alias("late"))


def watson_williams(rows: DataFrame, doy: str, group: str, least: int = 3) -> DataFrame:
    """f, k, n: equality of circular means of groups of at least ``least`` days."""
    t = radians_of_day(F.col(doy))
    per = rows.filter(F.col(doy).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.sin(t)).alias("s"), F.sum(F.cos(t)).alias("c")).filter(F.col("n") >= least)
    one = per.agg(F.sum(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))).alias("r"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("k"))
    whole = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    return one.select(((F.col("n") - F.col("k")) * (F.col("r") - whole) / ((F.col("k") - 1) * (F.col("n") - F.col("r")))).alias("f"), "k", "n")


# --- layers and states -------------------------------------------------------------------------------------------
def depth_means(layers: DataFrame, by: list[str], top: str, bottom: str, values: list[str], upper: float, lower: float) -> DataFrame:
    """by and the mean of each value over the depth interval, layers weighted by their overlap with it."""
    overlap = F.greatest(F.lit(0.0), F.least(F.col(bottom), F.lit(lower)) - F.greatest(F.col(top), F.lit(upper)))
    cut = layers.withColumn("__o", overlap).filter("__o > 0")
    return cut.groupBy(*by).agg(*[(F.sum(F.col(v) * F.col("__o")) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("__o"))), F.lit(0.0))).alias(v) for v in values])


def precedence_state(rows: DataFrame, by: list[str], state: str, order: list[tuple[str, int]], default: str) -> DataFrame:
    """by, state, n: the first state in ``order`` that a group has at least so often."""
    counts = [F.count_if(F.col(state) == s).alias(f"__{i}") for i, (s, _) in enumerate(order)]
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    out = F.when(F.lit(False), F.lit(""))
    for i, (s, least) in enumerate(order):
        out = out.when(F.col(f"__{i}") >= least, s)
    return g.select(*by, out.otherwise(default).alias("state"), "n")


# --- groupings ---------------------------------------------------------------------------------------------------
def planar_clusters(points: DataFrame, group: str, point: str, x: str, y: str, eps: Column) -> DataFrame:
    """group, point, cluster: points of a group chained within ``eps`` (one value a group), as density clusters whose
    core needs one point. Points are filed in cells of eps, so only neighbours meet."""
    rows = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(point).alias("p"), F.col(x).alias("x"), F.col(y).alias("y"), F.greatest(eps, F.lit(1e-9)).alias("e")).distinct()
    cell = rows.withColumns({"cx": F.floor(F.col("x") / F.col("e")), "cy": F.floor(F.col("y") / F.col("e"))})
    near = cell.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    a, b = near.alias("a"), cell.alias("b")
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    met = a.join(b, same & (F.col("a.p") <= F.col("b.p")) & (F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) <= F.col("a.e") * F.col("a.e")))
    edges = met.select(F.struct(F.col("a.g").alias("g"), F.col("a.p").alias("p")).alias("u"), F.struct(F.col("b.g").alias("g"), F.col("b.p").alias("p")).alias("v"))
    c = connected_components(edges, "u", "v")
    return c.select(F.col("node.g").alias(group), F.col("node.p").alias(point), F.col("component.p").alias("cluster"))


#: Degrees of a tile in which one task groups points.
TILE_DEGREES = 2.0


def in_tiles(state: DataFrame, reach: float, shift: tuple[float, float]) -> DataFrame:
    """``state`` with its rows listed in every tile that an angle of ``reach`` touches; ``own`` in the one it lies in."""
    lat, lon, deg = F.degrees("la"), F.degrees("lo"), math.degrees(reach) * (1 + 1e-9)
    row = lambda v: F.floor((v + 90) / TILE_DEGREES + shift[0])
    turn = lambda v: F.floor((v + 180) / TILE_DEGREES + shift[1])
    n = F.lit(round(360 / TILE_DEGREES))
    # the angle of longitude that the reach spans at most; close to a pole it is the whole circle
    ratio = math.sin(reach) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + deg, F.lit(90.0)))), F.lit(1e-12))
    wide = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    columns = F.array_distinct(F.transform(F.sequence(turn(lon - wide), F.least(turn(lon + wide), turn(lon - wide) + n - 1)), lambda c: F.pmod(c, n)))
    out = state.withColumn("ty", F.explode(F.sequence(row(lat - deg), row(lat + deg)))).withColumn("tx", F.explode(columns))
    return out.withColumn("own", (F.col("ty") == row(lat)) & (F.col("tx") == F.pmod(turn(lon), n)))


def complete_linkage_groups(points: DataFrame, block: str | None, point: str, lat: str, lon: str, km: float) -> DataFrame:
    """point, deme: in order of the point, each joins the first group all of whose members are within ``km``, else
    opens one named after it; groups never cross a ``block``, if one is given. Order is part of the rule.

    Tiles are tasks but not borders: every tile sees the points within twice ``km`` around it, which is as far as a
    group in reach can extend, and settles those of its points that no earlier open point can change. Tiles shift from
    round to round until all are settled; the smallest open point can always be, so rounds end."""
    kind = points.schema[point].dataType.simpleString()
    b = F.col(block) if block else F.lit("")
    state = points.filter((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & b.isNotNull()).select(b.cast("string").alias("b"), F.col(point).alias("p"), F.radians(lat).alias("la"), F.radians(lon).alias("lo"), F.col(point).alias("deme"), F.lit(False).alias("done"))
    reach = 2 * km / 6371.0 * (1 + 1e-9)
    chord = 2 * math.sin(min(reach, math.pi) / 2) * (1 + 1e-9)
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = ["b", "p", "la", "lo", "deme", "done"]
        if pdf.loc[pdf["own"], "done"].all():
            return pdf.loc[pdf["own"], keep]
        pdf = pdf.sort_values(["p", "la", "lo"])
        la, lo = pdf["la"].to_numpy(), pdf["lo"].to_numpy()
        cos = np.cos(la)
        cells = np.floor(np.stack([cos * np.cos(lo), cos * np.sin(lo), np.sin(la)], axis=1) / chord).astype(int)
        demes, done, own = pdf["deme"].tolist(), pdf["done"].tolist(), pdf["own"].tolist()
        filed: dict[tuple[int, int, int], list[int]] = {}

        def apart(i: int, m: list[int]) -> list[float]:
            a = np.sin((la[m] - la[i]) / 2) ** 2 + cos[i] * cos[m] * np.sin((lo[m] - lo[i]) / 2) ** 2
            return (2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(a)))).tolist()

        for i, (cx, cy, cz) in enumerate(cells.tolist()):
            if own[i] and not done[i]:
                near = sorted(j for x, y, z in around for j in filed.get((cx + x, cy + y, cz + z), ()))
                groups: dict[object, list[int]] = {}
                out: set[object] = set()
                waiting: list[tuple[int, float]] = []
                for j, far in zip(near, apart(i, near) if near else (), strict=True):
                    if far <= reach * 6371.0:
                        if not done[j]:
                            waiting.append((j, far))
                            continue
                        groups.setdefault(demes[j], []).append(j)
                        if far > km:
                            out.add(demes[j])
                home = min((g for g in groups if g not in out), default=None)
                if home is None:  # an open point in reach may yet open a group for this one
                    wait = any(far <= km for _, far in waiting)
                else:  # an open point may open an earlier group, or join this one and be too far
                    has = groups[home]
                    wait = any(j < has[0] if far <= km else j > has[0] and max(apart(j, [m for m in has if m < j])) <= km for j, far in waiting)
                if not wait:
                    demes[i], done[i] = demes[i] if home is None else home, True
            filed.setdefault((cx, cy, cz), []).append(i)
        return pdf.assign(deme=demes, done=done).loc[pdf["own"], keep]

    shape = f"b string, p {kind}, la double, lo double, deme {kind}, done boolean"
    turn = 0
    while True:
        shift = ((0.0, 0.0), (0.5, 0.5), (0.0, 0.5), (0.5, 0.0))[turn % 4]
        state = cut_table(in_tiles(state, reach, shift).groupBy("b", "ty", "tx").applyInPandas(run, shape))
        if state.filter("NOT done").isEmpty():
            return state.select(F.col("p").alias(point), "deme")
        turn += 1


def gathering_demes(points: DataFrame, point: str, lat: str, lon: str, km: float, key: Column) -> DataFrame:
    """point, deme: complete-linkage groups, those that share a ``key`` united; the deme is its smallest point."""
    groups = complete_linkage_groups(points, None, point, lat, lon, km)
    keyed = groups.join(points.select(point, key.alias("key")).filter("key IS NOT NULL").distinct(), point)
    first = keyed.groupBy("key").agg(F.min("deme").alias("first"))
    edges = keyed.join(first, "key").select("deme", "first").unionByName(groups.select("deme", F.col("deme").alias("first")))
    united = connected_components(edges.distinct(), "deme", "first")
    return groups.join(united, groups["deme"] == united["node"]).select(point, F.col("component").alias("deme"))


def silhouette(rows: DataFrame, vector: str, label: str, keep: str) -> DataFrame:
    """keep, silhouette with squared distances: from each class's size, mean and mean square, no pairs of rows."""
    flat = rows.filter(F.col(label).isNotNull()).select(F.col(label).alias("l"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v"))
    per = flat.groupBy("l", "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"))
    classes = per.groupBy("l").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.sum("q").alias("q"))
    # one row a class: the class table meets every row once
    x = F.col(vector).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    d = rows.filter(F.col(label).isNotNull()).select(F.col(keep), F.col(label).alias("own"), x.alias("x")).crossJoin(F.broadcast(classes))
    d = d.withColumn("d", dot(F.col("x"), F.col("x")) + F.col("q") - 2 * dot(F.col("x"), F.col("m")))
    mine = F.max(F.when((F.col("own") == F.col("l")) & (F.col("n") > 1), F.col("d") * F.col("n") / (F.col("n") - 1)))
    other = F.min(F.when(F.col("own") != F.col("l"), F.col("d")))
    return d.groupBy(keep).agg(mine.alias("a"), other.alias("b")).select(keep, ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


# --- sequences ---------------------------------------------------------------------------------------------------
def align(a: str, b: str, band: int = 50, match: int = 1, miss: int = -1, gap: int = -2) -> tuple[int, float]:
    """(score, identity) of a global alignment within a band around the diagonal."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m) + 1)
    low = -(10**9)
    before = {j: (j * gap, 0, j) for j in range(min(m, band) + 1)}
    for i in range(1, n + 1):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i - band), min(m, i + band) + 1):
            best = (low, 0, 0)
            if j and j - 1 in before:
                s, same, size = before[j - 1]
                hit = a[i - 1] == b[j - 1]
                best = max(best, (s + (match if hit else miss), same + hit, size + 1))
            if j in before:
                s, same, size = before[j]
                best = max(best, (s + gap, same, size + 1))
            if j and j - 1 in row:
                s, same, size = row[j - 1]
                best = max(best, (s + gap, same, size + 1))
            row[j] = best
        before = row
    score, same, size = before[m]
    return score, same / size if size else 1.0


@F.pandas_udf(DoubleType())
def identity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal columns in the alignment of two sequences: 2 for a match, −1 for a mismatch, −2 for a gap, within a
    band of 80, or 32 more than their lengths differ by."""
    return pd.Series([None if x is None or y is None else align(x, y, max(80, abs(len(x) - len(y)) + 32), 2, -1, -2)[1] for x, y in zip(a, b, strict=True)], dtype="float64")


def _locus_divergence(cells: DataFrame, members: DataFrame) -> DataFrame:
    """locus, a <= b, d: the mean allele difference within and between groups at each locus, see divergence."""
    per = cells.filter("dosage IS NOT NULL").join(members, "sample").groupBy("group", "locus").agg(F.avg("dosage").alias("p"), (F.count("*") * 2).alias("n"))
    x, y = per.alias("x"), per.alias("y")
    met = x.join(y, (F.col("x.locus") == F.col("y.locus")) & (F.col("x.group") <= F.col("y.group")))
    p, q = F.col("x.p"), F.col("y.p")
    d = F.when(F.col("x.group") == F.col("y.group"), 2 * p * (1 - p) * F.col("x.n") / F.nullif(F.col("x.n") - 1, F.lit(0))).otherwise(p * (1 - q) + q * (1 - p))
    return met.select(F.col("x.locus").alias("locus"), F.col("x.group").alias("a"), F.col("y.group").alias("b"), d.alias("d"))


def divergence(cells: DataFrame, members: DataFrame) -> DataFrame:
    """a <= b, dxy, n_loci: mean allele difference within (a = b) and between groups, from the groups' allele shares at
    each locus: p(1−q) + q(1−p), corrected for sampling within a group."""
    return _locus_divergence(cells, members).groupBy("a", "b").agg(F.avg("d").alias("dxy"), F.count("*").alias("n_loci"))


def lineages(cells: DataFrame, members: DataFrame, blocks: int = 50, draws: int = 500, seed: int = 202611) -> DataFrame:
    """group, sister, theta, theta_sister, dxy, tau, gdi, low, high, kind: each group against the group least diverged
    from it (the smaller of equals). τ is half of what dxy exceeds the two groups' mean diversity by, gdi = 1 − exp(−2τ/θ),
    with the 95 % interval of drawing the loci's blocks again. Below 0.2 one lineage, above 0.7 distinct, else ambiguous.
    The sums of blocks × pairs of groups are what reaches the driver; groups without diversity or sister have no row."""
    per = _locus_divergence(cells, members).groupBy(F.pmod(F.xxhash64("locus"), F.lit(blocks)).cast("int").alias("block"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    sums: dict[tuple[str, str], np.ndarray] = {}
    for r in per.agg(F.sum("d").alias("s"), F.count("d").alias("n")).collect():
        sums.setdefault((r["a"], r["b"]), np.zeros((blocks, 2)))[r["block"]] = r["s"] or 0.0, r["n"]
    drawn = np.random.default_rng(seed).multinomial(blocks, np.full(blocks, 1 / blocks), draws)
    mean = lambda a, b, w: (lambda t: t[..., 0] / np.where(t[..., 1] > 0, t[..., 1], np.nan))(w @ sums[min(a, b), max(a, b)])
    whole, out = np.ones(blocks), []
    groups = sorted(a for a, b in sums if a == b and mean(a, a, whole) > 0)
    for g in groups:
        others = [o for o in groups if o != g and (min(g, o), max(g, o)) in sums]
        if not others:
            continue
        sister = min(others, key=lambda o: (float(mean(g, o, whole)), o))

        def gdi(w: np.ndarray, g: str = g, sister: str = sister) -> tuple[np.ndarray, ...]:
            own, other, between = mean(g, g, w), mean(sister, sister, w), mean(g, sister, w)
            tau = np.maximum(0.0, 0.5 * (between - 0.5 * (own + other)))
            return own, other, between, tau, 1 - np.exp(-2 * tau / np.maximum(1e-4, own))

        own, other, between, tau, value = (float(v) for v in gdi(whole))
        low, high = (float(v) for v in np.nanpercentile(gdi(drawn)[4], [2.5, 97.5]))
        out.append((g, sister, own, other, between, tau, value, low, high, "single" if value < 0.2 else "distinct" if value > 0.7 else "ambiguous"))
    return cells.sparkSession.createDataFrame(out, "group string, sister string, theta double, theta_sister double, dxy double, tau double, gdi double, low double, high double, kind string")


def differentiation(pairs: DataFrame) -> DataFrame:
    """a < b, gdi: 1 − exp(−2τ/θ) with 2τ = max(dxy − θ, 0), θ the smaller of the groups' own diversities."""
    own = pairs.filter("a = b").select(F.col("a").alias("g"), F.col("dxy").alias("t"))
    j = pairs.filter("a < b").join(own.withColumnsRenamed({"g": "a", "t": "ta"}), "a").join(own.withColumnsRenamed({"g": "b", "t": "tb"}), "b")
    theta = F.greatest(F.least("ta", "tb"), F.lit(1e-9))
    return j.select("a", "b", (1 - F.exp(-F.greatest(F.col("dxy") - theta, F.lit(0.0)) / theta)).alias("gdi"))


def hybrid_index(cells: DataFrame, parents: DataFrame, least: float = 0.5) -> DataFrame:
    """sample, h, het, n: share of alleles of the second parent and heterozygosity over loci whose parents' frequencies
    differ by ``least`` or more. ``parents``: sample, parent (1 or 2)."""
    freq = cells.join(parents, "sample").groupBy("locus").agg(F.avg(F.when(F.col("parent") == 1, F.col("dosage"))).alias("p1"), F.avg(F.when(F.col("parent") == 2, F.col("dosage"))).alias("p2")).filter(F.abs(F.col("p1") - F.col("p2")) >= least)
    j = cells.filter("dosage IS NOT NULL").join(freq, "locus")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dosage") - F.col("p1")) / (F.col("p2") - F.col("p1"))))
    return j.groupBy("sample").agg(F.avg(share).alias("h"), F.avg(((F.col("dosage") > 0.05) & (F.col("dosage") < 0.95)).cast("double")).alias("het"), F.count("*").alias("n"))


def quartet_concordance(cells: DataFrame, groups: DataFrame, most: int = 120, combinations: int = 16, least_loci: int = 8, seed: int = 202611) -> DataFrame:
    """quartet, major_topology, cf_12_34, cf_13_24, cf_14_23, n_inform_loci, snaq_gamma_minor, g_test_p,
    delta_aicc_reticulation: quartets of the groups of all samples (``groups``: sample, group), at most ``most`` of them
    and ``combinations`` of samples in each, drawn by seed; combinations of fewer than ``least_loci`` loci called in all
    four don't count. All site patterns are counted in one pass; what reaches the driver is the list of samples."""
    of: dict[str, list] = {}
    for g, names in groups.filter("sample IS NOT NULL AND group IS NOT NULL").groupBy(F.col("group").cast("string").alias("g")).agg(F.array_sort(F.collect_set("sample"))).collect():
        of[g] = names
    taxa, rng = sorted(of), random.Random(seed)
    total = math.comb(len(taxa), 4)

    def unranked(r: int) -> tuple[str, ...]:
        out, at = [], 0
        for k in (4, 3, 2, 1):
            while (n := math.comb(len(taxa) - at - 1, k - 1)) <= r:
                r, at = r - n, at + 1
            out.append(taxa[at])
            at += 1
        return tuple(out)

    specs = []
    for r in range(total) if total <= most else sorted(rng.sample(range(total), most)):
        four = unranked(r)
        size = math.prod(len(of[t]) for t in four)
        for c, grid in enumerate(range(size) if size <= combinations else sorted(rng.sample(range(size), combinations))):
            for i, t in enumerate(four):
                grid, at = divmod(grid, len(of[t]))
                specs.append((";".join(four), c, i, of[t][at]))
    kind = cells.schema["sample"].dataType.simpleString()
    drawn = cells.sparkSession.createDataFrame(specs, f"quartet string, c int, i int, sample {kind}")
    x = cells.filter("dosage IS NOT NULL").select("sample", "locus", F.rint("dosage").cast("int").alias("x")).join(F.broadcast(drawn), "sample")  # at most 4 × most × combinations rows
    per = x.groupBy("quartet", "c", "locus").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"x{i}") for i in range(4)]).filter("n = 4")
    split = F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3") == 2
    same = [F.count_if(split & (F.col("x0") == F.col(f"x{i}"))).alias(f"c{i}") for i in (1, 2, 3)]
    counted = per.groupBy("quartet", "c").agg(F.count("*").alias("loci"), F.count_if(split).alias("inf"), *same).filter(F.col("loci") >= least_loci)
    means = counted.groupBy("quartet").agg(*[F.avg(F.when(F.col("inf") > 0, F.col(f"c{i}"))).alias(f"c{i}") for i in (1, 2, 3)])

    def judge(quartet: str, c: list[float]) -> tuple | None:
        a, b, d, e = quartet.split(";")
        names = (f"{a},{b}|{d},{e}", f"{a},{d}|{b},{e}", f"{a},{e}|{b},{d}")
        if any(v is None or v != v for v in c):
            return quartet, names[0], 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
        n = sum(c)
        if n <= 0:
            return None
        s = sorted(c, reverse=True)
        p0, p1 = [s[0] / n, (s[1] + s[2]) / 2 / n, (s[1] + s[2]) / 2 / n], [v / n for v in s]
        fixed = math.lgamma(n + 1) - sum(math.lgamma(v + 1) for v in s)
        like0, like1 = (fixed + sum(v * math.log(q) for v, q in zip(s, p, strict=True) if v > 0 and q > 0) for p in (p0, p1))
        p = math.erfc(math.sqrt(max(0.0, like1 - like0)))  # chi-square of one degree of freedom at twice the difference
        delta = (-2 * like0 + 2 + 4 / max(1.0, n - 2)) - (-2 * like1 + 4 + 12 / max(1.0, n - 3))
        gamma = round(s[1] / max(1e-9, s[0] + s[1]), 4) if delta >= 2 and p < 0.05 else 0.0
        return quartet, names[c.index(s[0])], *(round(v / n, 4) for v in c), round(n, 2), gamma, p, round(delta, 4)

    columns = ["quartet", "major_topology", "cf_12_34", "cf_13_24", "cf_14_23", "n_inform_loci", "snaq_gamma_minor", "g_test_p", "delta_aicc_reticulation"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [judge(q, list(c)) for q, *c in pdf[["quartet", "c1", "c2", "c3"]].itertuples(index=False)]
            yield pd.DataFrame([r for r in rows if r], columns=columns)

    return means.mapInPandas(run, ", ".join(f"{c} {'string' if i < 2 else 'double'}" for i, c in enumerate(columns)))


def ploidy_fit(cells: DataFrame, rounds: int = 25) -> DataFrame:
    """sample, ploidy, bic of the best: read ratios of heterozygotes as a mixture of normals at the shares that a
    ploidy allows, plus noise; one small task a sample."""
    centres = {2: [1 / 2], 3: [1 / 3, 2 / 3], 4: [1 / 4, 1 / 2, 3 / 4], 6: [1 / 6, 1 / 3, 1 / 2, 2 / 3, 5 / 6]}
    het = cells.filter("dosage > 0.05 AND dosage < 0.95 AND n_ref + n_alt >= 10").select("sample", (F.col("n_alt") / (F.col("n_ref") + F.col("n_alt"))).alias("r"))
    kind = cells.schema["sample"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["r"].to_numpy()
        best = (math.inf, None)
        for ploidy, mu in centres.items():
            w, s, like = np.full(len(mu), 0.95 / len(mu)), 0.07, -math.inf
            for _ in range(rounds):
                dens = np.stack([np.full(len(r), 0.05 * 1.25), *[wi * np.exp(-((r - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) for wi, m in zip(w, mu, strict=True)]])
                total = np.maximum(dens.sum(axis=0), 1e-300)
                like = float(np.log(total).sum())
                resp = dens[1:] / total
                w = np.maximum(resp.sum(axis=1) / len(r), 1e-9)
                s = max(0.01, math.sqrt(float((resp * (r - np.array(mu)[:, None]) ** 2).sum() / max(resp.sum(), 1e-9))))
            best = min(best, ((len(mu) + 1) * math.log(len(r)) - 2 * like, ploidy))
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "ploidy": [best[1]], "bic": [best[0]]})

    return het.groupBy("sample").applyInPandas(fit, f"sample {kind}, ploidy int, bic double")


# --- windows -----------------------------------------------------------------------------------------------------
def latest_reason(rows: DataFrame, key: str, at: str, reason: str) -> DataFrame:
    """key, reason: the last reason that isn't null, by time, then by the larger reason."""
    return rows.filter(F.col(reason).isNotNull()).groupBy(key).agg(F.max_by(reason, F.struct(at, reason)).alias(reason))


def point_mass(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, share: of each column the share of its most frequent value among the known ones."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").filter("v IS NOT NULL")
    counts = long.groupBy("name", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg((F.max("n") / F.sum("n")).alias("share"))


def newest_window(rows: DataFrame, by: str, order: str, size: int, value: str) -> DataFrame:
    """``rows`` with the mean of ``value`` over the last ``size`` rows of the group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - size, 0)
    return rows.withColumn("moving_mean", F.avg(value).over(w))
