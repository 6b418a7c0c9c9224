"""Points near other points, and the region that contains a point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, cut_table

EARTH_M = 6_371_000.0
#: A coverage of at most so many cells (about 40 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 200_000
#: Outlines of up to so many coordinates (8 bytes each) are broadcast.
BROADCAST_VERTICES = 1_000_000


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable_point(lat: Column, lon: Column) -> Column:
    """Coordinates within ±90 and ±180, not both zero (null and NaN are not usable)."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def _columns_in(band: Column, height: float, reach_rad: float) -> Column:
    """How many cells a band of latitude has: none narrower than the reach anywhere in the band."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    widest = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    # half the angle a reach spans at that latitude; close to a pole one cell takes the whole circle
    ratio = F.sin(F.lit(reach_rad / 2)) / F.greatest(widest, F.lit(1e-12))
    span = F.when(ratio >= 1, F.lit(2 * math.pi)).otherwise(2 * F.asin(F.least(ratio, F.lit(1.0))))
    return F.greatest(F.lit(1), F.floor(F.lit(2 * math.pi) / span)).cast("int")


def near_spots(spots: DataFrame, metres: float, scale: float = 3.0) -> DataFrame:
    """lat_a, lon_a, lat_b, lon_b, each pair once: different places (lat, lon; usable, distinct) at most ``metres`` apart.

    Places fall into cells of ``scale`` times the reach, narrowed with latitude so that the cells of a band stay that
    wide; each place is also listed in the cells its reach touches in its own band and the one above, and the two
    listings meet in an equi-join with an exact distance test. Cells wrap at the antimeridian and a pole is one cell.
    """
    reach = metres / EARTH_M
    height = math.degrees(reach * scale) * (1 + 1e-9)
    rows = spots.select("lat", "lon", F.struct("lat", "lon").alias("id"))
    band = F.floor((F.col("lat") + 90) / height)
    rows = rows.withColumn("band", band).withColumn("turn", F.pmod((F.col("lon") + 180) / 360, F.lit(1.0)))

    def column(b: Column, turn: Column) -> Column:
        n = _columns_in(b, height, reach * scale)
        return F.pmod(F.floor(turn * n), n).cast("int")

    home = rows.withColumn("col", column(F.col("band"), F.col("turn"))).drop("turn")
    # the angle of longitude that the reach spans at most, anywhere in the reach
    lat_edge = F.least(F.abs(F.col("lat")) + math.degrees(reach), F.lit(90.0))
    ratio = F.sin(F.lit(reach / 2)) / F.greatest(F.cos(F.radians(lat_edge)), F.lit(1e-12))
    turn_reach = F.when(ratio >= 1, F.lit(0.5)).otherwise(F.asin(F.least(ratio, F.lit(1.0))) / math.pi * (1 + 1e-9))
    listed = rows.withColumn("reach", turn_reach).withColumn("to", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    listed = listed.filter((F.col("to") == F.col("band")) | (F.floor((F.col("lat") + math.degrees(reach) * (1 + 1e-9) + 90) / height) >= F.col("to")))
    n = _columns_in(F.col("to"), height, reach * scale)
    first, last = F.floor((F.col("turn") - F.col("reach")) * n), F.floor((F.col("turn") + F.col("reach")) * n)
    cells = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n.cast("bigint")).cast("int")))
    listed = listed.withColumn("col", F.explode(cells)).drop("turn", "reach", "band").withColumnRenamed("to", "band")
    a, b = listed.alias("a"), home.alias("b")
    # each pair is met from its southern place; at equal latitude from the western one
    order = (F.col("a.lat") < F.col("b.lat")) | ((F.col("a.lat") == F.col("b.lat")) & (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.col") == F.col("b.col")) & order)
    met = met.filter(haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= metres)
    return met.select(F.col("a.lat").alias("lat_a"), F.col("a.lon").alias("lon_a"), F.col("b.lat").alias("lat_b"), F.col("b.lon").alias("lon_b"))


def near_pairs(points: DataFrame, point_id: str, lat: str, lon: str, metres: float, carry: tuple[str, ...] = (), scale: float = 3.0) -> DataFrame:
    """All pairs of points at most ``metres`` apart, each once: <id>_a < <id>_b, with lat_a, lon_a, lat_b, lon_b and
    the ``carry`` columns of both.

    Equal coordinates count as one place while near places are searched (near_spots, which with the points of each place
    is the result in a form that a crowded place doesn't square); then the places are expanded to their points. A
    crowded place is split by adaptive skew handling; its own pairs are the result and can't be fewer. Points that
    usable_point refuses have no pair; equal ids never pair, and repeated rows with one id count once.
    """
    rows = points.filter(usable_point(F.col(lat), F.col(lon)) & F.col(point_id).isNotNull())
    # adding zero makes the two zeros one
    rows = rows.select(F.col(point_id).alias("id"), (F.col(lat).cast("double") + 0.0).alias("lat"), (F.col(lon).cast("double") + 0.0).alias("lon"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rows = cut_table(rows.groupBy("id").agg(F.min(F.struct("lat", "lon", *[f"c_{c}" for c in carry])).alias("r")).select("id", "r.*"))
    near = near_spots(rows.select("lat", "lon").distinct(), metres, scale)
    side = lambda t: rows.select(F.col("lat").alias(f"lat_{t}"), F.col("lon").alias(f"lon_{t}"), F.struct("id", *[f"c_{c}" for c in carry]).alias(t))
    # a place is near itself
    alone = rows.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.struct("id", *[f"c_{c}" for c in carry]).alias("a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    met = near.join(side("a"), ["lat_a", "lon_a"]).select("lat_a", "lon_a", "a", "lat_b", "lon_b").unionByName(alone)
    same = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    met = met.join(side("b"), ["lat_b", "lon_b"]).filter(~same | (F.col("a.id") < F.col("b.id")))
    met = met.withColumns({t: F.struct(F.col(f"lat_{t}").alias("lat"), F.col(f"lon_{t}").alias("lon"), f"{t}.*") for t in "ab"}).select("a", "b")
    first_is_a = F.col("a.id") < F.col("b.id")
    pick = lambda c: [F.when(first_is_a, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(first_is_a, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))]
    out = []
    for name, c in ((point_id, "id"), ("lat", "lat"), ("lon", "lon"), *((c, f"c_{c}") for c in carry)):
        x, y = pick(c)
        out += [x.alias(f"{name}_a"), y.alias(f"{name}_b")]
    return met.select(*out)


def near_sites(points: DataFrame, sites: DataFrame, metres: float) -> DataFrame:
    """point, site, metres of each point (point, lat, lon) and other site (site, lat, lon) at most ``metres`` apart;
    usable coordinates only. Cells as in near_pairs, one reach high."""
    reach = metres / EARTH_M
    height = math.degrees(reach) * (1 + 1e-9)
    place = lambda df: df.withColumn("band", F.floor((F.col("lat") + 90) / height)).withColumn("turn", F.pmod((F.col("lon") + 180) / 360, F.lit(1.0)))
    n = _columns_in(F.col("band"), height, reach)
    home = place(sites).withColumn("col", F.pmod(F.floor(F.col("turn") * n), n).cast("int")).select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "band", "col")
    edge = F.least(F.abs(F.col("lat")) + height, F.lit(90.0))
    ratio = F.sin(F.lit(reach / 2)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    span = F.when(ratio >= 1, F.lit(0.5)).otherwise(F.asin(F.least(ratio, F.lit(1.0))) / math.pi * (1 + 1e-9))
    listed = place(points).withColumn("span", span).withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    first, last = F.floor((F.col("turn") - F.col("span")) * n), F.floor((F.col("turn") + F.col("span")) * n)
    listed = listed.withColumn("col", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n.cast("bigint")).cast("int")))))
    met = listed.join(home, ["band", "col"]).filter(F.col("point") != F.col("site"))
    return met.select("point", "site", haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("metres")).filter(F.col("metres") <= metres)


def nearest_sites(points: DataFrame, sites: DataFrame, k: int, metres: float, rings: int = 4) -> DataFrame:
    """point, site, metres: the ``k`` nearest other sites (then smallest ids) of each point within ``metres``.

    Rings double up to the reach: a point with k sites within one is settled, so only sparse places search further.
    Sites of one place are as far from any point: its k + 1 smallest ids stand for it, which is exact."""
    spots = points.filter(usable_point(F.col("lat"), F.col("lon")) & F.col("point").isNotNull()).dropDuplicates(["point"])
    at = Window.partitionBy("lat", "lon").orderBy("site")
    sites = sites.filter(usable_point(F.col("lat"), F.col("lon")) & F.col("site").isNotNull()).dropDuplicates(["site"])
    left, sites = cut_table(spots.select("point", "lat", "lon")), cut_table(sites.select("site", "lat", "lon", F.row_number().over(at).alias("rn")).filter(F.col("rn") <= k + 1).drop("rn"))
    by = Window.partitionBy("point")
    found = None
    for ring in range(rings, -1, -1):
        near = near_sites(left, sites, metres / 2**ring).withColumn("rn", F.row_number().over(by.orderBy("metres", "site"))).filter(F.col("rn") <= k)
        if ring:
            near = near.withColumn("n", F.count("*").over(by)).filter(F.col("n") == k)
        near = cut_table(near.select("point", "site", "metres"))
        found = near if found is None else found.unionByName(near)
        left = left.join(near.select("point").distinct(), "point", "left_anti")
    return found


def _cover(ring_y: list[float], ring_x: list[float], depth: int) -> list[tuple[int, int, int, bool]]:
    """(level, iy, ix, inside) of quadtree cells of 2**-level degrees: those wholly inside the ring, as large as can
    be, and the smallest ones that its boundary runs through."""
    if len(ring_y) < 3 or len(ring_y) != len(ring_x) or not all(map(math.isfinite, (*ring_y, *ring_x))):
        return []
    edges = [(x1, y1, x2, y2) for x1, y1, x2, y2 in zip(ring_x, ring_y, ring_x[1:] + ring_x[:1], ring_y[1:] + ring_y[:1], strict=True)]
    wide = max(max(ring_y) - min(ring_y), max(ring_x) - min(ring_x), 1e-9)
    level = math.ceil(-math.log2(wide)) + 1
    size = 2.0**-level
    out = []
    stack = [
        (level, iy, ix, edges)
        for iy in range(math.floor(min(ring_y) / size), math.floor(max(ring_y) / size) + 1)
        for ix in range(math.floor(min(ring_x) / size), math.floor(max(ring_x) / size) + 1)
    ]
    deepest = level + depth
    while stack:
        lv, iy, ix, near = stack.pop()
        s = 2.0**-lv
        y0, x0, y1, x1 = iy * s, ix * s, (iy + 1) * s, (ix + 1) * s
        crossing = [e for e in near if _touches(e, x0, y0, x1, y1)]
        if not crossing:
            if _inside((y0 + y1) / 2, (x0 + x1) / 2, edges):
                out.append((lv, iy, ix, True))
        elif lv == deepest:
            out.append((lv, iy, ix, False))
        else:
            stack += [(lv + 1, 2 * iy + j, 2 * ix + i, crossing) for j in (0, 1) for i in (0, 1)]
    return out


def _touches(edge: tuple, x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether a segment meets a closed rectangle: boxes overlap and the corners aren't all on one side of the line."""
    ax, ay, bx, by = edge
    if max(ax, bx) < x0 or min(ax, bx) > x1 or max(ay, by) < y0 or min(ay, by) > y1:
        return False
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return not (all(s > 0 for s in sides) or all(s < 0 for s in sides))


def _inside(y: float, x: float, edges: list[tuple]) -> bool:
    odd = False
    for ax, ay, bx, by in edges:
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def ring_contains(lat: Column, lon: Column, ring_lat: Column, ring_lon: Column) -> Column:
    """Even-odd test of a point against a ring of straight lines in degrees, last vertex joined to first."""
    n = F.size(ring_lat)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            ((F.element_at(ring_lat, i) > lat) != (F.element_at(ring_lat, F.pmod(i, n) + 1) > lat))
            & (
                lon
                < (F.element_at(ring_lon, F.pmod(i, n) + 1) - F.element_at(ring_lon, i)) * (lat - F.element_at(ring_lat, i))
                / (F.element_at(ring_lat, F.pmod(i, n) + 1) - F.element_at(ring_lat, i))
                + F.element_at(ring_lon, i)
            ),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def coverage(regions: DataFrame, region_id: str, ring_lat: str, ring_lon: str, depth: int = 4) -> DataFrame:
    """Quadtree cells of each region: region, level, iy, ix, inside. Rings with fewer than three vertices, arrays of
    unequal length, nulls or non-finite values cover nothing. A ring must not cross the antimeridian."""

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r, ys, xs in zip(pdf["region"], pdf["ys"], pdf["xs"], strict=True):
                if r is None or ys is None or xs is None:
                    continue
                cells = _cover([math.nan if v is None else float(v) for v in ys], [math.nan if v is None else float(v) for v in xs], depth)
                found += [(r, *c) for c in cells]
            yield pd.DataFrame(found, columns=["region", "level", "iy", "ix", "inside"])

    rings = regions.select(F.col(region_id).cast("string").alias("region"), F.col(ring_lat).alias("ys"), F.col(ring_lon).alias("xs"))
    return rings.mapInPandas(cover, "region string, level int, iy bigint, ix bigint, inside boolean")


def containing_region(points: DataFrame, point_id: str, lat: str, lon: str, regions: DataFrame, region_id: str, ring_lat: str, ring_lon: str, depth: int = 4) -> DataFrame:
    """(``point_id``, ``region_id``) of each point inside a region; a point in several has the smallest region id, a
    point in none has no row. Points with null or unusable coordinates have none; regions may be empty.

    Cells wholly inside a region accept a point by the equi-join alone; only points in a boundary cell are tested
    against the ring. Coverage and outlines are broadcast after their size was checked, or else joined by a shuffle.
    """
    cells = cut(coverage(regions, region_id, ring_lat, ring_lon, depth))
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # a level is a power of two: few
    spots = points.filter(usable_point(F.col(lat), F.col(lon))).select(F.col(point_id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    at = F.array(*[F.struct(F.lit(v).alias("level"), F.floor(F.col("lat") * 2.0**v).alias("iy"), F.floor(F.col("lon") * 2.0**v).alias("ix")) for v in levels] or [F.struct(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("iy"), F.lit(0).cast("bigint").alias("ix"))])
    listed = spots.withColumn("at", F.explode(at)).select("id", "lat", "lon", "at.*")
    small = cells.count() <= BROADCAST_CELLS
    hit = listed.join(F.broadcast(cells) if small else cells, ["level", "iy", "ix"])
    rings = regions.select(F.col(region_id).cast("string").alias("region"), F.col(ring_lat).alias("ys"), F.col(ring_lon).alias("xs"))
    vertices = rings.agg(F.coalesce(F.sum(F.size("ys") + F.size("xs")), F.lit(0))).first()[0]
    edge = hit.filter(~F.col("inside")).join(F.broadcast(rings) if vertices <= BROADCAST_VERTICES else rings, "region").filter(ring_contains(F.col("lat"), F.col("lon"), F.col("ys"), F.col("xs")))
    found = hit.filter(F.col("inside")).select("id", "region").unionByName(edge.select("id", "region"))
    return found.groupBy(F.col("id").alias(point_id)).agg(F.min("region").alias(region_id))
