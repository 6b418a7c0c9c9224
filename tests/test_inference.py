import math
import random

import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import inference as N
from sheetmill.plans import runs as U
from sheetmill.streaming import incremental as I


def test_fisher_and_association(spark):
    assert abs(N.fisher_two_sided(3, 1, 1, 3) - 0.48571428571428) < 1e-9
    assert abs(N.fisher_two_sided(10, 2, 3, 15) - 0.00053672411914343) < 1e-9
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 15 + [(None, "x")], "g string, h string")
    got = {(r["g"], r["h"]): r for r in N.association(df, "g", "h").collect()}
    assert got["a", "x"]["n"] == 10 and abs(got["a", "x"]["p"] - 0.00053672411914343) < 1e-9 and got["a", "x"]["odds_ratio"] > 10


def test_variance_inflation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(y), float(x + 0.1 * y)) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    got = N.variance_inflation(df, ["a", "b", "c"])
    x = np.stack([a, b, a + 0.1 * b])
    assert got["a"] > 50 or np.linalg.matrix_rank(x) < 3


def test_planar_clusters_and_demes(spark):
    rng = random.Random(6)
    pts = [("s", i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [("t", 1, 0.0, 0.0), ("t", 2, 3.0, 4.0), ("t", 3, 20.0, 0.0)]
    df = spark.createDataFrame(pts, "g string, p int, x double, y double")
    got = {(r["g"], r["p"]): r["cluster"] for r in N.planar_clusters(df, "g", "p", "x", "y", F.lit(5.0)).collect()}
    assert got["t", 1] == got["t", 2] == 1 and got["t", 3] == 3 and len(got) == 63
    for a in pts[:60]:
        for b in pts[:60]:
            if math.dist(a[2:], b[2:]) <= 5:
                assert got["s", a[1]] == got["s", b[1]]
    line = spark.createDataFrame([("k", i, 40.0, -110.0 + i * 0.05) for i in range(6)], "b string, p int, lat double, lon double")
    demes = {r["p"]: r["deme"] for r in N.complete_linkage_groups(line, "b", "p", "lat", "lon", 10.0).collect()}
    assert demes == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_demes_cross_tiles_and_share_keys(spark):
    rng = random.Random(8)
    pts = [(i, rng.uniform(39.7, 40.3), rng.uniform(-110.3, -109.7), None) for i in range(300)] + [(i, rng.uniform(-0.2, 0.2), rng.choice([-1, 1]) * rng.uniform(179.8, 180.0), None) for i in range(300, 400)]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    groups = []
    for p in pts:
        home = next((g for g in groups if all(km(p, m) <= 10.0 for m in g)), None)
        groups.append([p]) if home is None else home.append(p)
    want = {m[0]: g[0][0] for g in groups for m in g}
    df = spark.createDataFrame(pts, "p int, lat double, lon double, k string")
    got = {r["p"]: r["deme"] for r in N.gathering_demes(df, "p", "lat", "lon", 10.0, F.col("k")).collect()}
    assert got == want
    far = [(1, 40.0, -110.0, "x"), (2, 40.0, -109.999, None), (3, 10.0, 20.0, "x"), (4, 10.0, 20.01, "y"), (5, -10.0, 20.0, "z")]
    got = {r["p"]: r["deme"] for r in N.gathering_demes(spark.createDataFrame(far, df.schema), "p", "lat", "lon", 10.0, F.col("k")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_alignment():
    assert N.align("ACGT", "ACGT") == (4, 1.0)
    assert N.align("ACGT", "AGT")[1] == 0.75
    assert N.align("", "") == (0, 1.0) and N.align("A" * 300, "A" * 10)[1] == 10 / 300


def test_silhouette_against_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) + np.repeat([[0, 0, 0], [3, 0, 0]], 20, axis=0)
    label = [0] * 20 + [1] * 20
    df = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label, strict=True))], "i int, v array<double>, g int")
    got = {r["i"]: r["silhouette"] for r in N.silhouette(df, "v", "g", "i").collect()}
    for i in range(40):
        d = ((x - x[i]) ** 2).sum(axis=1)
        same = [d[j] for j in range(40) if label[j] == label[i] and j != i]
        other = [d[j] for j in range(40) if label[j] != label[i]]
        a, b = np.mean(same), np.mean(other)
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_divergence_and_ploidy(spark):
    cells = [("a", "L1", 0.0), ("b", "L1", 1.0), ("c", "L1", 0.5), ("d", "L1", 0.5), ("a", "L2", None)]
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 2)], "sample string, group int")
    got = {(r["a"], r["b"]): r["dxy"] for r in N.divergence(spark.createDataFrame(cells, "sample string, locus string, dosage double"), members).collect()}
    assert abs(got[1, 2] - (0.25 * 0.25 + 0.75 * 0.75)) < 1e-12 and abs(got[1, 1] - 2 * 0.25 * 0.75 * 4 / 3) < 1e-12
    rng = random.Random(8)
    reads = []
    for sample, shares in (("two", [0.5]), ("four", [0.25, 0.75, 0.5])):
        for i in range(300):
            n = 80
            k = sum(rng.random() < rng.choice(shares[:1] if len(shares) == 1 else [shares[i % 3]]) for _ in range(n))
            reads.append((sample, f"L{i}", 0.5, float(n - k), float(k)))
    df = spark.createDataFrame(reads, "sample string, locus string, dosage double, n_ref double, n_alt double")
    assert {r["sample"]: r["ploidy"] for r in N.ploidy_fit(df).collect()} == {"two": 2, "four": 4}


def test_runs(spark, tmp_path):
    assert U.run_token("out/Run Alder-7/") == "run_alder_7" and U.run_token(None) == ""
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert U.fingerprint(df) == U.fingerprint(df.orderBy("s")) != U.fingerprint(df.limit(1))
    made = []

    def work():
        made.append(1)
        return df.filter("i > 1")

    for _ in range(2):
        assert U.cached(spark, str(tmp_path / "cache"), [df], "v1", work).count() == 1
    assert len(made) == 1
    text = U.summary_markdown("T", {"one": df}, 1)
    assert "| 1 | a |" in text and "First 1 rows." in text


def test_streams_resume(spark, tmp_path):
    src, out, at = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "at")
    schema = "k string, v int"
    calls = []

    def work(df):
        calls.append(1)
        return df.selectExpr("k", "v * 2 AS v")

    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(src, mode="append")
    I.resume_batches(spark.readStream.schema(schema).parquet(src), "k", out, at, work)
    spark.createDataFrame([("b", 9), ("c", 3)], schema).write.parquet(src, mode="append")
    I.resume_batches(spark.readStream.schema(schema).parquet(src), "k", out, at, work)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 4), ("c", 6)]
    I.run_to_table(spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "t_at"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_quartets_of_all_groups(spark):
    # a, b, c, d, e with one sample each but a, which has two; ab|cd at 12 loci, ac|bd at 2, one locus uncalled in e
    patterns = [{"a": 1, "b": 1, "c": 0, "d": 0, "e": 0}] * 12 + [{"a": 1, "b": 0, "c": 1, "d": 0, "e": 0}] * 2
    cells = [(s, i, float(p[s[0]])) for i, p in enumerate(patterns) for s in ("a1", "a2", "b", "c", "d")] + [("e", i, 0.0) for i in range(7)]
    groups = spark.createDataFrame([(s, s[0]) for s in ("a1", "a2", "b", "c", "d", "e")], "sample string, group string")
    out = {r["quartet"]: r for r in N.quartet_concordance(spark.createDataFrame(cells, "sample string, locus int, dosage double"), groups).collect()}
    assert set(out) == {"a;b;c;d"}  # the others share seven loci
    r = out["a;b;c;d"]
    assert (r["major_topology"], r["cf_12_34"], r["cf_13_24"], r["cf_14_23"], r["n_inform_loci"]) == ("a,b|c,d", 0.8571, 0.1429, 0.0, 14.0)
    g = 2 * 2 * math.log(2)  # 2 against 0 where 1 and 1 are expected
    assert abs(r["g_test_p"] - math.erfc(math.sqrt(g / 2))) < 1e-9 and abs(r["delta_aicc_reticulation"] - round(g - 2 + 4 / 12 - 12 / 11, 4)) < 1e-4
