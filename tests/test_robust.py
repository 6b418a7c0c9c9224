import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import genomics as G, robust as B


def test_minimum_covariance_ignores_outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2)) @ np.array([[2, 0.5], [0, 1]])
    x[:30] += 40
    centre, cov = B.minimum_covariance(x)
    assert np.abs(centre).max() < 0.5 and 1 < cov[0, 0] < 9
    df = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)] + [(900, "h", [0.0, 1.0]), (901, None, [0.0, 1.0]), (902, "g", None)], "i long, g string, v array<double>")
    got = {r["i"]: r["outlier"] for r in B.robust_outliers(df, "g", "i", "v").collect()}
    assert all(got[i] == 1 for i in range(30)) and sum(got[i] for i in range(30, 200)) < 15 and got[900] is None and 901 not in got


def test_group_larger_than_a_task_has_one_model(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(450, 2)) @ np.array([[2, 0.5], [0, 1]])
    x[:60] += 40
    rows = [(i, "g", v.tolist()) for i, v in enumerate(x)] + [(900, "g", [float("nan"), 0.0]), (901, "h", [0.0, 1.0])]
    got = {r["i"]: r for r in B.robust_outliers(spark.createDataFrame(rows, "i long, g string, v array<double>"), "g", "i", "v").collect()}
    assert len(got) == 452 and got[900]["d2"] is None and got[901]["outlier"] is None
    d2 = np.array([got[i]["d2"] for i in range(450)])
    terms = np.column_stack([np.ones(450), x, x * x, x[:, 0] * x[:, 1]])  # a single model's distance is one quadratic form
    assert np.abs(terms @ np.linalg.lstsq(terms, d2, rcond=None)[0] - d2).max() < 1e-6
    assert np.isclose(np.median(d2), B.chi2_quantile(0.5, 2))
    assert (d2[:60] > 100).all() and sum(got[i]["outlier"] for i in range(60, 450)) < 30


def test_core_centre(spark):
    rows = [("g", [0.0, 0.0]), ("g", [1.0, 0.0]), ("g", [0.0, 1.0]), ("g", [0.5, 0.5]), ("g", [99.0, 99.0])]
    centre = B.core_centre(spark.createDataFrame(rows, "g string, v array<double>"), "g", "v").first()["centre"]
    assert max(centre) < 1.1


def test_anchor_levels(spark):
    df = spark.createDataFrame([("a", "gold")] * 3 + [("a", "x")] + [("b", "gold"), ("b", "silver"), ("b", "x")] + [("c", None)], "g string, t string")
    out = B.anchors_with_fallback(df, "g", [("gold", F.col("t") == "gold", 3), ("both", F.col("t").isin("gold", "silver"), 2)])
    assert sorted((r["g"], r["level"]) for r in out.collect()) == [("a", "gold")] * 3 + [("b", "both")] * 2 + [("c", "all")]


def test_sequence_clusters(spark):
    seqs = [("b", "one", "ACGTACGTACGTTTGACCA"), ("b", "two", "ACGTACGTACGTTTGACC"), ("b", "three", "GGGGGGGGCCCCCCCCTTTT"), ("b", "short", "AC"), ("c", "two", "ACGTACGTACGTTTGACC"), ("b", "none", None)]
    got = sorted(tuple(r) for r in B.sequence_clusters(spark.createDataFrame(seqs, "b string, n string, s string"), "b", "n", "s", 5, 0.9).collect())
    assert got == [("one", "one"), ("short", "short"), ("three", "three"), ("two", "one"), ("two", "two")]


def test_tip_distances(spark):
    edges = [("t", 0, None, None, None), ("t", 1, 0, None, 3.0), ("t", 2, 1, "a", 1.0), ("t", 3, 1, "b", 2.5), ("t", 4, 0, "d", None)]
    df = spark.createDataFrame(edges, "file string, node int, parent int, label string, length double")
    got = {(r["a"], r["b"]): r["distance"] for r in B.tip_distances(df).collect()}
    assert got == {("a", "b"): 3.5, ("a", "d"): 4.0, ("b", "d"): 5.5}


def test_donors_and_power(spark):
    cells = [(s, f"L{i}", float(v), 0) for s, vs in (("a", [0, 0, 0, 0]), ("b", [0, 0, 0, 1]), ("c", [1, 1, 1, 1])) for i, v in enumerate(vs)]
    got = {(r["a"], r["b"]): r["share"] for r in B.nearest_donors(spark.createDataFrame(cells, "sample string, locus string, dosage double, blk int"), "blk", 4).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0, ("c", "b"): 1.0}
    power = B.harmonic_power(spark.createDataFrame([([10.0, 0.0, 0.0, 5.0, 1.0, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0],)], "c array<double>"), "c").first()
    assert power["n_harmonics"] == 1 and power["power"] > 0.99


def test_donors_keep_no_table_of_pairs(spark, monkeypatch):
    written, cut = [], B.cut_table
    for module in (G, B):
        monkeypatch.setattr(module, "cut_table", lambda df: written.append(df.count()) or cut(df))
    monkeypatch.setattr(G, "PAIR_SAMPLES", 64)
    x = np.random.default_rng(4).random((200, 20)).round(3)
    x[7], x[9] = x[3], x[3]  # equal donors
    got = {(r["a"], r["b"]): r["share"] for r in B.nearest_donors(spark.createDataFrame([(s, k, float(v), k // 10) for (s, k), v in np.ndenumerate(x)], "sample int, locus int, dosage double, blk int"), "blk", 10).collect()}
    want = {}
    for blk in (0, 1):
        d = np.abs(x[:, None, blk * 10 : blk * 10 + 10] - x[None, :, blk * 10 : blk * 10 + 10]).mean(axis=2).round(9)
        np.fill_diagonal(d, np.inf)
        for a in range(200):
            near = np.flatnonzero(d[a] == d[a].min())
            for b in near:
                want[a, int(b)] = want.get((a, int(b)), 0) + 0.5 / len(near)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and got[3, 7] == 0.5
    assert max(written) < 200 * 199 // 2


def test_power_counts_fine_detail(spark, tmp_path):
    from sheetmill.queries.robusts import QUERIES

    angle = 2 * np.pi * np.arange(400) / 400
    r = 100 + 40 * np.cos(12 * angle)
    contour = str(np.column_stack([r * np.cos(angle), r * np.sin(angle)]).tolist())
    spark.createDataFrame([(contour,)], "contour_xy_json string").write.parquet(f"{tmp_path}/extracted_leaves.parquet")
    assert 10 < QUERIES["harmonic_power"](spark, str(tmp_path)).first()["n_harmonics"] <= 24
