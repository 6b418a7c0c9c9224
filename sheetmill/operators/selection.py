"""Ranked and stratified selection, quotas and thinning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_table
from .inference import in_tiles


def round_robin(rows: DataFrame, group: str, buckets: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a group, taken in turn from its buckets: first the best of each bucket, then the second
    best, and so on; within a round by ``order``, which must be total."""
    turn = F.row_number().over(Window.partitionBy(group, *buckets).orderBy(*order))
    # no more than `most` rows of a bucket can be chosen, and Spark drops the others before the shuffle
    ranked = rows.withColumn("turn", turn).filter(F.col("turn") <= most)
    place = F.row_number().over(Window.partitionBy(group).orderBy("turn", *order))
    return ranked.withColumn("place", place).filter(F.col("place") <= most)


def quota_then_fill(rows: DataFrame, stratum: str, order: list[Column], quota: int, total: int) -> DataFrame:
    """``total`` rows: first up to ``quota`` of each stratum, then the best of the rest."""
    within = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    # a row beyond `total` of its stratum can't be chosen; so the global ranking sees a bounded number a stratum
    ranked = rows.withColumn("__r", within).filter(F.col("__r") <= total).withColumn("first_pass", (F.col("__r") <= quota).cast("int"))
    return ranked.drop("__r").orderBy(F.desc("first_pass"), *order).limit(total)


def top_share(rows: DataFrame, group: str, name: str, value: str, share: float) -> DataFrame:
    """Of each group the rows with the largest ``value`` that together first reach ``share`` of the group's sum."""
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc(name))
    sums = rows.groupBy(group).agg(F.sum(value).alias("__t"))
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(sums, group).withColumn("__b", F.coalesce(before, F.lit(0.0)))
    return out.filter(F.col("__b") < share * F.col("__t")).drop("__t", "__b")


def hash_sample(rows: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows a group by the order of a seeded hash of a unique key: the same rows on any cluster."""
    order = [F.xxhash64(F.lit(seed), F.col(key).cast("string")).asc(), F.col(key).asc()]
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def _km(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a = np.sin((lats - lat) / 2) ** 2 + math.cos(lat) * np.cos(lats) * np.sin((lons - lon) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def greedy_thinning(points: DataFrame, group: str, point_id: str, lat: str, lon: str, rank: str, km: float, keep: str | None = None) -> DataFrame:
    """``point_id`` of the points kept: by falling ``rank``, then rising id, each is kept unless one already kept is
    nearer than ``km``; those with ``keep`` true stay anyway.

    The rule is sequential only through neighbours. Tiles are tasks but not borders: a tile also sees the points within
    ``km`` around it and settles those of its own that no earlier open point can change; tiles shift from round to round
    until all are settled. Of points of one place only the first can stay, so a crowded place is one point. Points
    without coordinates are kept.
    """
    if km <= 0:
        return points.select(point_id)
    kind = points.schema[point_id].dataType.simpleString()
    flag = F.col(keep) if keep else F.lit(False)
    rows = points.select(F.col(group).cast("string").alias("b"), F.col(point_id).alias("p"), F.radians(lat).alias("la"), F.radians(lon).alias("lo"), F.col(rank).cast("double").alias("rank"), F.coalesce(flag, F.lit(False)).alias("keep"))
    placed = F.col("la").isNotNull() & F.col("lo").isNotNull() & ~F.isnan("la") & ~F.isnan("lo")
    rows = cut_table(rows.withColumn("placed", placed))
    first = F.min(F.struct(F.col("rank").isNull(), -F.col("rank"), "p", "rank"))
    one = rows.filter("placed AND NOT keep").groupBy("b", "la", "lo").agg(first.alias("f")).select("b", "f.p", "la", "lo", "f.rank", F.lit(False).alias("keep"))
    state = one.unionByName(rows.filter("placed AND keep").select("b", "p", "la", "lo", "rank", "keep")).withColumn("status", F.when(F.col("keep"), 1).otherwise(0))
    reach = km / 6371.0 * (1 + 1e-9)
    chord = 2 * math.sin(min(reach, math.pi) / 2) * (1 + 1e-9)
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    columns = ["b", "p", "la", "lo", "rank", "keep", "status"]

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "p"], ascending=[False, True], na_position="last")
        la, lo, own, status = pdf["la"].to_numpy(), pdf["lo"].to_numpy(), pdf["own"].to_numpy(), pdf["status"].to_numpy().copy()
        if (status[own] == 0).any():
            cells = np.floor(np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1) / chord).astype(int)
            filed: dict[tuple[int, int, int], list[int]] = {}  # earlier points that are kept or open
            for i, (x, y, z) in enumerate(cells.tolist()):
                if own[i] and status[i] == 0:
                    near = np.array([j for dx, dy, dz in around for j in filed.get((x + dx, y + dy, z + dz), ())], int)
                    near = near[_km(la[i], lo[i], la[near], lo[near]) < km]
                    status[i] = 2 if (status[near] == 1).any() else 0 if len(near) else 1
                if status[i] != 2:
                    filed.setdefault((x, y, z), []).append(i)
        return pdf.assign(status=status).loc[own, columns]

    turn = 0
    while True:
        shift = ((0.0, 0.0), (0.5, 0.5), (0.0, 0.5), (0.5, 0.0))[turn % 4]
        state = cut_table(in_tiles(state, reach, shift).groupBy("b", "ty", "tx").applyInPandas(thin, f"b string, p {kind}, la double, lo double, rank double, keep boolean, status int"))
        if state.filter("status = 0").isEmpty():
            return state.filter("status = 1").select("p").unionByName(rows.filter("NOT placed").select("p")).withColumnRenamed("p", point_id)
        turn += 1


def density_weights(points: DataFrame, pairs: DataFrame, point_id: str, group: str, km: float = 25.0) -> DataFrame:
    """(``point_id``, weight): 1 / √(1 + kernel density), scaled to mean 1 a group, clipped to 0.2–3 and rescaled
    three times. ``pairs`` are the neighbours of a group at any distance that
    matters: a, b, metres (the wide kernel, 0.35 of three times ``km``, is below 1e-7 beyond eighteen times ``km``)."""
    both = pairs.select("a", "b", "metres").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres"))
    d = F.col("metres") / 1000
    kernel = F.exp(-d * d / (2 * km * km)) + 0.35 * F.exp(-d * d / (2 * (3 * km) ** 2))
    dens = both.groupBy(F.col("a").alias(point_id)).agg(F.sum(kernel).alias("k"))
    out = points.select(point_id, group).join(dens, point_id, "left").withColumn("w", 1 / F.sqrt(1 + F.coalesce("k", F.lit(0.0))))
    for _ in range(4):
        mean = out.groupBy(group).agg(F.avg("w").alias("m"))
        out = out.join(mean, group).withColumn("w", F.greatest(F.lit(0.2), F.least(F.lit(3.0), F.col("w") / F.col("m")))).drop("m")
    return out.select(point_id, F.round("w", 6).alias("weight"))


def farthest_points(points: DataFrame, group: str, point_id: str, lat: str, lon: str, most: int) -> DataFrame:
    """``point_id``, place: at most ``most`` points a group, the first with the smallest id, each next the one whose
    nearest chosen point is farthest (the smallest id of equals). One task a group; memory is one row a point."""
    kind = points.schema[point_id].dataType.simpleString()
    rows = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(group).alias("grp"), F.col(point_id).alias("pid"), F.radians(lat).alias("lat"), F.radians(lon).alias("lon"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        lat_, lon_, ids = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["pid"].to_numpy()
        chosen = [0]
        nearest = _km(lat_[0], lon_[0], lat_, lon_)
        while len(chosen) < min(most, len(ids)):
            nearest[chosen] = -1.0
            k = int(np.argmax(np.round(nearest, 9)))
            chosen.append(k)
            nearest = np.minimum(nearest, _km(lat_[k], lon_[k], lat_, lon_))
        return pd.DataFrame({"pid": ids[chosen], "place": np.arange(1, len(chosen) + 1)})

    return rows.groupBy("grp").applyInPandas(pick, f"pid {kind}, place int").withColumnRenamed("pid", point_id)


def nearest_weighted(points: DataFrame, sites: DataFrame, point_id: str, value: str, pairs: DataFrame, k: int = 5, floor_km: float = 0.25) -> DataFrame:
    """(``point_id``, estimate, n_sites): inverse-distance mean, w = 1 / max(d, floor)², of ``value`` at the k nearest
    sites. ``pairs``: point, site, metres within the reach."""
    w = Window.partitionBy("point").orderBy("metres", "site")
    near = pairs.join(sites.select(F.col("site"), F.col(value).alias("v")).filter("v IS NOT NULL"), "site").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    weight = 1 / F.pow(F.greatest(F.col("metres") / 1000, F.lit(floor_km)), 2)
    return near.groupBy(F.col("point").alias(point_id)).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("estimate"), F.count("*").alias("n_sites"))
