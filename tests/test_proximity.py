import math
import random

import pytest

from sheetmill.operators.proximity import containing_region, near_pairs, nearest_sites


def _haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize(("centre", "spread"), [((40.0, -110.0), 0.002), ((0.0, 179.9999), 0.002), ((89.9995, 0.0), 180.0), ((-89.9999, 20.0), 90.0)])
def test_pairs_against_brute_force(spark, rows, centre, spread):
    rng = random.Random(3)
    points = []
    for i in range(150):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-0.002, 0.002)))
        lon = (centre[1] + rng.uniform(-spread, spread) + 180) % 360 - 180
        points.append((i, lat, lon))
    points += [(500, points[0][1], points[0][2]), (501, None, 3.0), (502, 0.0, 0.0), (503, 91.0, 3.0), (504, math.nan, 1.0)]
    df = spark.createDataFrame([*points, points[0]], "pid long, lat double, lon double")
    got = rows(near_pairs(df, "pid", "lat", "lon", 50.0).select("pid_a", "pid_b"))
    good = [p for p in points if p[1] is not None and not math.isnan(p[1]) and abs(p[1]) <= 90 and (p[1], p[2]) != (0, 0)]
    want = sorted(((a[0], b[0]) for a in good for b in good if a[0] < b[0] and _haversine(a[1:], b[1:]) <= 50), key=repr)
    assert got == want and want


def test_region_of_a_point(spark, rows):
    def inside(lat, lon, ys, xs):
        odd = False
        for y1, x1, y2, x2 in zip(ys, xs, ys[1:] + ys[:1], xs[1:] + xs[:1], strict=True):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    regions = [("b", [0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 1.0, 0.0]), ("a", [0.5, 0.5, 1.5], [0.5, 2.0, 0.5]), ("dent", [2.0, 2.0, 2.5, 3.0, 3.0], [0.0, 1.0, 0.2, 1.0, 0.0]), ("line", [0.0, 1.0], [0.0, 1.0]), ("gone", None, None)]
    rng = random.Random(5)
    points = [(i, rng.uniform(-0.5, 3.5), rng.uniform(-0.5, 2.5)) for i in range(600)] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "p long, lat double, lon double")
    shapes = spark.createDataFrame(regions, "fips string, ys array<double>, xs array<double>")
    got = dict(rows(containing_region(df, "p", "lat", "lon", shapes, "fips", "ys", "xs")))
    want = {}
    for p, lat, lon in points[:-1]:
        hits = sorted(r for r, ys, xs in regions[:3] if inside(lat, lon, ys, xs))
        if hits:
            want[p] = hits[0]
    assert got == want
    assert rows(containing_region(df, "p", "lat", "lon", shapes.limit(0), "fips", "ys", "xs")) == []


@pytest.mark.parametrize(("centre", "spread"), [((40.0, -110.0), 0.3), ((0.0, 179.95), 0.3), ((89.99, 0.0), 180.0)])
def test_nearest_sites_against_brute_force(spark, rows, centre, spread):
    rng = random.Random(4)
    points = []
    for i in range(120):
        lat = max(-90.0, min(90.0, centre[0] + rng.choice([0.01, 0.3]) * rng.uniform(-1, 1)))
        points.append((i, lat, (centre[1] + rng.uniform(-spread, spread) + 180) % 360 - 180))
    points += [(500 + i, *points[0][1:]) for i in range(9)]
    df = spark.createDataFrame([*points, (900, None, 1.0), (901, math.nan, 1.0)], "point long, lat double, lon double")
    got = [r[:2] for r in rows(nearest_sites(df, df.withColumnRenamed("point", "site"), 5, 10_000.0))]
    want = []
    for p in points:
        near = sorted((d, q[0]) for q in points if q[0] != p[0] and (d := _haversine(p[1:], q[1:])) <= 10_000.0)
        want += [(p[0], s) for _, s in near[:5]]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_idw_whole_reaches_ten_kilometres(spark, tmp_path):
    from sheetmill.queries.measures import QUERIES

    sheets = [(1, 40.0, -110.0, 10.0), (2, 40.05, -110.0, 30.0), (3, 40.2, -110.0, 50.0)]
    spark.createDataFrame(sheets, "voucher_id long, decimalLatitude double, decimalLongitude double, coordinateUncertainty double").write.parquet(f"{tmp_path}/vouchers.parquet")
    got = {r["voucher_id"]: (r["estimate"], r["n_sites"]) for r in QUERIES["idw_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: (30.0, 1), 2: (10.0, 1)}
