import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.functions import habitat as H, scalar as S
from sheetmill.operators import cohorts as C, genomics as Q, inference as N, seasons as Y, stats as M
from sheetmill.operators.duplicates import merge_split_plants
from sheetmill.operators.proximity import near_pairs, near_spots
from sheetmill.session import shared_folder


def _value(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        seen = {tuple(M.permuted(np.arange(n), n, key)) for key in range(20)}
        assert all(sorted(p) == list(range(n)) for p in seen)
    assert len(seen) == 20
    first = np.array([M.permuted(np.arange(5), 5, key)[0] for key in range(4000)])
    assert np.abs(np.bincount(first, minlength=5) / 4000 - 0.2).max() < 0.03


def test_f_probabilities():
    assert abs(M.f_tail(4.3512, 1, 20) - 0.05) < 1e-4 and abs(M.f_tail(3.0984, 3, 20) - 0.05) < 1e-4
    assert abs(M.f_tail(1.0, 7, 7) - 0.5) < 1e-12 and M.f_tail(0.0, 2, 3) == 1.0


def test_permutation_f(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(2, 1, (30, 3))])
    rows = spark.createDataFrame([(i, "ab"[i >= 20], v.tolist()) for i, v in enumerate(x)] + [(99, None, [0.0] * 3), (98, "a", None)], "i long, g string, x array<double>")
    got = M.permutation_f(rows, "x", "g", "i", 199).first()
    means = np.vstack([x[:20].mean(axis=0)] * 20 + [x[20:].mean(axis=0)] * 30)
    within, total = ((x - means) ** 2).sum(), ((x - x.mean(axis=0)) ** 2).sum()
    assert abs(got["f"] - (total - within) / (within / 48)) < 1e-9 and got["p"] == 1 / 200
    same = M.permutation_f(rows.withColumn("g", F.when(F.col("i") % 2 == 0, "a").otherwise("b")), "x", "g", "i", 199).first()
    assert same["p"] > 0.05
    assert M.permutation_f(rows.limit(0), "x", "g", "i", 9).first()["f"] is None


@pytest.mark.parametrize(("kind", "want"), [("holotype", (2, 2.2)), ("ISOLECTOTYPE of x", (2, 2.0)), ("Syntype", (1, 1.5)), ("type", (1, 1.0)), ("cotype", (1, 1.0)), ("topotype", (0, 0.0)), ("non-type", (0, 0.0)), ("not a type", (0, 0.0)), ("", (0, 0.0)), (None, (0, 0.0)), ("possible holotype", (2, 2.2))])
def test_type_ranks(spark, kind, want):
    assert (_value(spark, kind, "string", S.type_rank), _value(spark, kind, "string", S.type_subrank)) == want


def test_heat_and_texture(spark):
    sites = [(40.0, 30.0, 225.0, 0.981), (40.0, 30.0, 45.0, 0.374), (40.0, 0.0, None, 0.7749), (80.0, 0.0, 10.0, 0.5086), (None, 1.0, 1.0, None), (40.0, None, 1.0, None)]
    for lat, slope, aspect, want in sites:
        got = spark.createDataFrame([(lat, slope, aspect)], "a double, b double, c double").select(H.heat_load(F.col("a"), F.col("b"), F.col("c"))).first()[0]
        assert got is None if want is None else abs(got - want) < 6e-4
    soils = [(60.0, 20.0, None, (20.0, 0.897, 0.0)), (60.0, 20.0, -5.0, (20.0, 0.897, 0.0)), (None, 20.0, 30.0, (None,) * 3), (0.0, 0.0, 100.0, (99.01, round(math.sqrt(2 / 3) * math.log(0.5 / math.sqrt(50)), 4), round(math.sqrt(0.5) * math.log(200), 4)))]
    for sand, clay, silt, want in soils:
        got = spark.createDataFrame([(sand, clay, silt)], "a double, b double, c double").select(H.texture_log_ratios(F.col("a"), F.col("b"), F.col("c"))).first()[0]
        assert tuple(got) == want
    assert _value(spark, "Loam, 3 to 8 percent slopes", "string", H.slope_midpoint) == 5.5 and _value(spark, "Very steep land", "string", H.slope_midpoint) == 35.0 and _value(spark, "x", "string", H.slope_midpoint) is None


def test_surnames_without_dates_and_generic_words(spark):
    cases = {"det. A. Gray Jr. 12 May 1984 (sheet); B. Hall et al.": ["gray", "hall"], "Löve, Á. & D.K.Trock 1990-05-06": ["love", "trock"], "herbarium staff": [], "Ng": [], "A. Gray and A. Gray": ["gray"], "unknown": []}
    for text, want in cases.items():
        assert _value(spark, text, "string", S.surname_list) == want


def test_allele_sharing_against_brute_force(spark):
    rng = random.Random(5)
    dosage = {(s, k): rng.choice([0.0, 0.25, 0.5, 1.0]) for s in range(12) for k in range(30) if rng.random() < (0.2 if s == 3 else 0.8)}
    cells = spark.createDataFrame([(f"s{s:02d}", k, v) for (s, k), v in dosage.items()] + [("s00", 99, None)], "sample string, locus int, dosage double")
    got = {(r["a"], r["b"]): r for r in Q.allele_sharing(cells).collect()}
    d, n = {}, {}
    for a in range(12):
        for b in range(a + 1, 12):
            both = [abs(dosage[a, k] - dosage[b, k]) for k in range(30) if (a, k) in dosage and (b, k) in dosage]
            n[a, b] = len(both)
            d[a, b] = d[b, a] = sum(both) / len(both) if len(both) >= 10 else None
    usual = np.mean([v for (a, b), v in d.items() if v is not None])
    for (a, b), m in n.items():
        via = [d[a, k] + d[k, b] for k in range(12) if k not in (a, b) and d[a, k] is not None and d[k, b] is not None]
        want = d[a, b] if d[a, b] is not None else (np.mean(via) if via else usual)
        r = got[f"s{a:02d}", f"s{b:02d}"]
        assert r["n_shared"] == m and abs(r["distance"] - want) < 1e-12 and r["measured"] == int(d[a, b] is not None)
    assert len(got) == 66 and {r["measured"] for r in got.values()} == {0, 1}
    assert Q.allele_sharing(cells.limit(0)).count() == 0


def test_pairs_across_sample_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "PAIR_SAMPLES", 8)
    monkeypatch.setattr(Q, "PAIR_LOCI", 5)
    rng = random.Random(6)
    value = {(s, k): rng.random() for s in range(40) for k in range(23) if rng.random() < 0.6}
    got = {(r["a"], r["b"]): (r["n"], r["s"]) for r in Q.pair_differences(spark.createDataFrame([(s, k, v) for (s, k), v in value.items()], "sample int, locus int, dosage double")).collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), (n, s) in got.items():
        both = [abs(value[a, k] - value[b, k]) for k in range(23) if (a, k) in value and (b, k) in value]
        assert n == len(both) and abs(s - sum(both)) < 1e-9


def test_sharing_keeps_no_table_of_pairs(spark, monkeypatch):
    written, cut = [], Q.cut_table
    monkeypatch.setattr(Q, "cut_table", lambda df: written.append(cut(df)) or written[-1])
    cells = spark.range(300 * 12).selectExpr("id div 12 AS sample", "id % 12 AS locus", "(xxhash64(id) & 3) / 4D AS dosage")
    got = Q.allele_sharing(cells)
    assert got.count() == 300 * 299 // 2 and got.filter("measured = 0").count() == 0
    assert sum(t.count() for t in written) < 300 * 299 // 4
    half = spark.createDataFrame([(s, k, v if k == 0 else 0.0) for s, v in ((1, 0.625), (2, 0.0)) for k in range(200)], "sample int, locus int, dosage double")
    assert Q.allele_sharing(half, digits=6).first()["distance"] == 0.003125 and Q.allele_sharing(half, digits=5).first()["distance"] == 0.00313


def test_detours_across_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "PAIR_SAMPLES", 8)
    rng = random.Random(8)
    dosage = {(s, k): rng.choice([0.0, 0.3, 0.5, 1.0]) for s in range(40) for k in range(30) if rng.random() < (0.45 if s % 3 else 0.8)}
    dosage |= {(40, 30): 1.0, (41, 30): 0.5}  # shares no locus with the others: no detour either
    got = {(r["a"], r["b"]): r for r in Q.allele_sharing(spark.createDataFrame([(s, k, v) for (s, k), v in dosage.items()], "sample int, locus int, dosage double")).collect()}
    d = {}
    for a in range(42):
        for b in range(a + 1, 42):
            both = [abs(dosage[a, k] - dosage[b, k]) for k in range(31) if (a, k) in dosage and (b, k) in dosage]
            d[a, b] = d[b, a] = sum(both) / len(both) if len(both) >= 10 else None
    usual = np.mean([v for (a, b), v in d.items() if v is not None])
    assert len(got) == 42 * 41 // 2 and 100 < sum(1 - r["measured"] for r in got.values()) < 800
    for (a, b), r in got.items():
        via = [d[a, k] + d[k, b] for k in range(42) if k not in (a, b) and d[a, k] is not None and d[k, b] is not None]
        assert abs(r["distance"] - (d[a, b] if d[a, b] is not None else np.mean(via) if via else usual)) < 1e-12


def test_boyce_and_mixtures(spark):
    rows = spark.range(2000).select((F.col("id") / 2000).alias("s"), ((F.col("id") * 7919) % 2000 < F.col("id")).cast("int").alias("y"))
    assert M.boyce_index(rows, "s", "y").first()[0] > 0.95
    assert M.boyce_index(rows.withColumn("s", F.lit(1.0)), "s", "y").first()[0] == 0.0 and M.boyce_index(rows.limit(3), "s", "y").first()[0] is None
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(8, 1, 300)])
    fits = M.fit_mixtures(spark.createDataFrame([([float(v)],) for v in x] + [([float("nan")],), (None,)], "x array<double>"), "x", [1, 2, 3])
    assert min(fits, key=lambda f: f.bic).k == 2 and min(fits, key=lambda f: f.icl).k == 2 and np.abs(np.sort(fits[1].means[:, 0]) - [0, 8]).max() < 0.3


def test_group_tests_against_least_squares(spark):
    rng = np.random.default_rng(7)
    b, g, w = rng.integers(0, 3, 200), rng.integers(0, 4, 200), rng.uniform(0.5, 2, 200)
    y = 1.0 * g + 0.4 * b + rng.normal(0, 1, 200)
    rows = spark.createDataFrame([(f"b{i}", f"g{j}", float(v), float(u)) for i, j, v, u in zip(b, g, y, w, strict=True)] + [("few", "g0", 9.0, 1.0)], "b string, g string, y double, w double")

    def rss(*factors):
        x = np.hstack([np.eye(f.max() + 1)[f] for f in factors]) * np.sqrt(w)[:, None]
        return float(((y * np.sqrt(w) - x @ np.linalg.lstsq(x, y * np.sqrt(w), rcond=None)[0]) ** 2).sum())

    got, full, less = M.batch_effects(rows, "y", "b", "g", "w").first(), rss(g, b), rss(g)
    f = (less - full) / 2 / (full / (200 - 3 - 4 + 1))
    assert got["n"] == 200 and got["df"] == 2 and abs(got["f"] - f) < 1e-8 and abs(got["p"] - M.f_tail(f, 2, 194)) < 1e-12
    two = M.group_differences(spark.createDataFrame([(f"{i > 0}", [float(v), float(u)]) for i, v, u in zip(b, y, w, strict=True)], "g string, x array<double>"), "x", "g").first()
    # with two groups all statistics are functions of one another
    assert abs(two["pillai"] + two["wilks"] - 1) < 1e-6 and 0 < two["p"] < 1
    assert M.group_differences(rows.select("g", F.array("y").alias("x")).limit(0), "x", "g").first()["f"] is None


def test_niche_identity(spark):
    rng = random.Random(2)
    apart = spark.createDataFrame([(i, "ab"[i % 2], (i % 2) * 10 + rng.random()) for i in range(100)], "i int, g string, v double")
    alike = spark.createDataFrame([(i, "ab"[i % 2], rng.random()) for i in range(100)], "i int, g string, v double")
    far, near = M.niche_identity(apart, "v", "g", "i", "a", "b", 10, 99).first(), M.niche_identity(alike, "v", "g", "i", "a", "b", 10, 99).first()
    assert far["d"] == 0 and far["p_d"] == 0.01 and near["d"] > 0.5 and near["p_d"] > 0.05
    assert M.niche_identity(alike.filter("g = 'a'"), "v", "g", "i", "a", "b").first()["d"] is None


def test_seasons(spark):
    k = np.array([0.1, 1.0, 5.0, 50.0])
    t = np.linspace(0, 2 * np.pi, 20001)[:-1]
    r = np.array([(np.cos(t) * np.exp(v * (np.cos(t) - 1))).mean() / np.exp(v * (np.cos(t) - 1)).mean() for v in k])
    assert np.abs(Y.concentration(r) / k - 1).max() < 1e-6
    rng = random.Random(4)
    sheets = [(i, f"g{i % 2}", 100.0 + 30 * (i % 2) + rng.gauss(0, 5) + (6 if i % 2 else 0) * (lat - 40), lat) for i in range(200) for lat in [rng.uniform(35, 45)]]
    rows = spark.createDataFrame(sheets + [(900, None, 5.0, 40.0), (901, "g0", None, 40.0), (902, "g0", 500.0, 40.0), (903, "few", 10.0, 1.0)], "i int, g string, d double, lat double")
    best = {r["g"]: r for r in Y.seasonal_models(rows, "d", "lat", "g").filter("best = 1").collect()}
    assert best["g0"]["model"] == "constant" and best["g1"]["model"] == "fitted_slope" and abs(best["g1"]["slope"] - 6) < 0.4
    test = Y.phase_test(rows.filter("i < 900"), "d", "g", "i", 99).first()
    assert test["p"] < 1e-6 and test["perm_p"] == 0.01 and test["k"] == 2 and test["n"] == 200
    assert Y.phase_test(rows.limit(0), "d", "g", "i", 9).first()["f"] is None
    state = spark.createDataFrame([("Flowering", None, None, 120, True), ("pre-anthesis", None, None, 120, False), ("", True, None, 120, True), (None, None, 2, 120, True), (None, None, None, 120, False), ("anthesis", None, None, 20, False)], "s string, v boolean, h int, d int, want boolean")
    assert state.filter(Y.flowering(F.col("s"), F.col("v"), F.col("h"), F.col("d"), 60, 240) != F.col("want")).count() == 0


def test_caps_labels_and_text_forms(spark):
    rows = spark.createDataFrame([(i, "t", "gold", 1.0, False) for i in range(6)] + [(10 + i, "t", "silver", 4.0, i == 0) for i in range(2)] + [(20, "u", "silver", 4.0, False), (21, None, "silver", 4.0, False)], "i int, g string, tier string, w double, pr boolean")
    got = {r["i"]: r["capped_weight"] for r in C.pool_cap(rows, "g", "w", F.col("tier") == "gold", F.col("tier") == "silver", F.col("pr")).collect()}
    assert abs(got[11] - 2.0) < 1e-12 and abs(got[10] - 1.7) < 1e-12 and got[0] == 1.0 and got[20] == got[21] == 4.0
    assert _value(spark, "lat 40.5, lon -110.25 m", "string", S.lat_lon) == (40.5, -110.25) and _value(spark, "91, 5", "string", S.lat_lon) == (None, None) and _value(spark, None, "string", S.lat_lon) == (None, None)
    assert _value(spark, "us, ca  us", "string", lambda c: S.code_list(c, ("X",))) == ["US", "CA"] and _value(spark, None, "string", lambda c: S.code_list(c, ("X",))) == ["X"]
    city = lambda c: S.independent_city(c, ("norfolk", "falls church"))
    assert [_value(spark, v, "string", city) for v in ("norfolk", "Falls  Church (Independent City)", "NORFOLK CITY", "Bath", " ", None)] == ["Norfolk City", "Falls Church City", "Norfolk City", "Bath", None, None]
    keys = _value(spark, ["virginia|norfolk", "ohio|norfolk"], "array<string>", lambda c: S.city_aliases(c, ("norfolk",), {"norfolk": "virginia|chesapeake"}))
    assert keys == ["ohio|norfolk", "virginia|chesapeake", "virginia|chesapeake city", "virginia|norfolk", "virginia|norfolk city"]
    assert _value(spark, "Loc7_pos12:3.4", "string", C.locus_names)[0] == "Loc7_pos12:3.4" and "Loc7" in _value(spark, "Loc7_pos12:3.4", "string", C.locus_names)
    pairs = spark.createDataFrame([("a", "b", 0.25, None, 1.0), ("a", "c", 0.0, 1.0, 1.0), ("b", "c", 1.0, 1.0, None)], "a string, b string, shape double, ground double, season double")
    joint = {(r["a"], r["b"]): r["affinity"] for r in C.joint_affinity(pairs, "shape", "ground", "season").collect()}
    assert joint == {("a", "b"): round((0.75 * 0.25 + 0.5) / 1.25, 6), ("a", "c"): 0.0, ("b", "c"): 1.0}


def test_points_crowded_on_one_place(spark):
    """A third of all rows on one place is one place in the search, whatever their number."""
    crowd = [(i, 40.0, -110.0) for i in range(3000)]
    rest = [(10_000 + i, 40.0 + (i % 60) * 0.0003, -110.0 + (i // 60) * 0.0003) for i in range(6000)]
    df = spark.createDataFrame(crowd + rest, "id long, lat double, lon double")
    spots = df.select("lat", "lon").distinct()
    met = near_spots(spots, 50.0)
    assert met.filter("lat_a = 40.0 AND lon_a = -110.0 OR lat_b = 40.0 AND lon_b = -110.0").count() < 10
    few = df.filter("id < 40 OR id >= 10000 AND id < 10100")
    pairs = near_pairs(few, "id", "lat", "lon", 50.0)
    assert pairs.filter("id_a < 40 AND id_b < 40").count() == 40 * 39 // 2 and pairs.count() == pairs.distinct().count()


def test_no_temporary_folder_on_a_cluster():
    class Fake:
        master = "spark://host:7077"
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    Fake.sparkContext = Fake
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Fake)


def test_split_plants_are_merged(spark):
    plants = [("s", 1, 0.0, 0.0, 5.0), ("s", 2, 1.0, 0.0, None), ("s", 3, 2.0, 0.0, 7.0), ("s", 4, 50.0, 0.0, 9.0), ("s", 5, None, None, None), ("t", 1, 0.0, 0.0, None), (None, 1, 0.0, 0.0, 1.0), ("s", 1, 0.0, 0.0, 5.0)]
    leaves = [(1, "s", 1, 1), (2, "s", 3, 1), (3, "s", 3, 2), (4, "s", 4, 1), (5, "s", 9, 1), (6, None, 1, 1), (7, "t", None, 1)]
    df = merge_split_plants(spark.createDataFrame(plants, "sheet string, plant int, x double, y double, h double"), spark.createDataFrame(leaves, "id int, sheet string, plant int, leaf int"), "sheet", "plant", "leaf", "x", "y", ("h",), F.lit(1.5))
    got = {r["id"]: (r["merged_plant"], r["merged_leaf"]) for r in df.collect()}
    # plant 2 is a stub between 1 and 3: without it they are not chained
    assert got == {1: (1, 1), 2: (3, 1), 3: (3, 2), 4: (4, 1), 5: (9, 1), 6: (1, None), 7: (None, None)}
    wide = merge_split_plants(spark.createDataFrame(plants, "sheet string, plant int, x double, y double, h double"), spark.createDataFrame(leaves, "id int, sheet string, plant int, leaf int"), "sheet", "plant", "leaf", "x", "y", ("h",), F.lit(2.5))
    assert {r["id"]: (r["merged_plant"], r["merged_leaf"]) for r in wide.collect() if r["id"] < 4} == {2: (3, 1), 3: (3, 2), 1: (3, 3)}


def test_lineages(spark):
    rng = random.Random(9)
    share = {"a": lambda k: 0.2, "b": lambda k: 0.2, "c": lambda k: 0.95 if k % 2 else 0.05}
    cells = [(f"{g}{i}", k, sum(rng.random() < p(k) for _ in range(2)) / 2) for g, p in share.items() for i in range(12) for k in range(300)] + [("a0", 999, None)]
    df = spark.createDataFrame(cells, "sample string, locus int, dosage double")
    members = df.select("sample").distinct().withColumn("group", F.substring("sample", 1, 1))
    got = {r["group"]: r for r in N.lineages(df, members).collect()}
    assert got["a"]["sister"] == "b" and got["b"]["sister"] == "a" and got["a"]["kind"] == "single" and got["a"]["gdi"] < 0.05
    assert got["c"]["kind"] == "distinct" and got["c"]["low"] <= got["c"]["gdi"] <= got["c"]["high"] and got["c"]["high"] - got["c"]["low"] < 0.1
    assert N.lineages(df.limit(0), members).count() == 0
