import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.operators import aggregates as A, duplicates as D, gates as E, genomics as Q, joins as J, rules as R, selection as T, skew as K, stats as M, store as W
from sheetmill.operators.components import connected_components
from sheetmill.plans.master import master_view


def test_upsert_keeps_or_overwrites(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "z")], "k int, x string, other string")
    assert rows(W.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", None), (None, "n", 0)]
    assert rows(W.upsert(old, new, ["k"], preserve=False)) == [(1, "a", 1), (2, None, 2), (3, "c", None), (None, "n", 0)]
    assert rows(W.upsert(old, new.limit(0), ["k"])) == rows(old) and rows(W.upsert(old.limit(0), new, ["k"])) == [(2, None, None), (3, "c", None)]


def test_last_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, None, 5), ("b", 1, "q", None)], "k string, t int, v string, w int")
    assert rows(W.last_per_key(df, ["k"], [F.col("t")])) == [("a", 2, None, 5), ("b", 1, "q", None)]
    assert rows(W.last_per_key(df, ["k"], [F.col("t")], per_column=True)) == [("a", 2, "x", 5), ("b", 1, "q", None)]


def test_cohort_and_cascade(spark, rows):
    cohort = spark.createDataFrame([("a", None), ("b", 7), ("c", None), ("a", None)], "k string, p int")
    parts = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1)], "k string, p int")
    assert rows(W.expand_cohort(cohort, parts, "k", "p")) == [("a", 0), ("a", 2), ("b", 7), ("c", 0)]
    kept = W.cascade_delete([(parts, ["k"])], spark.createDataFrame([("a",)], "gone string"))[0]
    assert rows(kept) == [("b", 1)]
    assert rows(W.conform(parts, {"K": "string", "z": "int", "p": "string"})) == [("a", None, "0"), ("a", None, "2"), ("b", None, "1")]


def test_hierarchical_joins(spark, rows):
    base = spark.createDataFrame([(1, "a", 1, None), (2, "a", 5, None), (3, "b", 4, None), (4, "c", 1, 9.0), (5, None, 1, None)], "i int, k string, p int, v double")
    right = spark.createDataFrame([("a", 1, None), ("a", 0, 2.0), ("b", 3, 3.0), ("c", 1, 4.0)], "k string, p int, v double")
    assert rows(J.join_by_individual(base, right, "k", "p", ["v"]).select("i", "v")) == [(1, 2.0), (2, 2.0), (3, 3.0), (4, 9.0), (5, None)]
    assert rows(J.exact_or_default(base.drop("v"), right, "k", "p", ["v"]).select("i", "v")) == [(1, None), (2, 2.0), (3, None), (4, 4.0), (5, None)]
    agreed = J.unanimous_propagation(base, spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "k string, v double"), "k", "v")
    assert rows(agreed.select("i", "v")) == [(1, 1.0), (2, 1.0), (3, None), (4, None), (5, None)]


def test_master_view_has_one_row_a_cohort_row(spark):
    cohort = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0)], "catalogNumber string, plant_individual_id int")
    vouchers = spark.createDataFrame([("A", 1, "x", "2020-01-01"), ("A", 2, "y", "2021-01-01")], "catalogNumber string, voucher_id long, county string, updated_at string")
    vouchers = vouchers.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("species_raw", "string"), ("stateProvince", "string"), ("decimalLatitude", "double"), ("decimalLongitude", "double"), ("determiner_tier", "string"), ("type_status", "string"))])
    plants = spark.createDataFrame([("A", 0, 5.0, 1.0, 0)], "catalogNumber string, plant_individual_id int, plant_height_mm double, petiole_to_blade_ratio double, is_bent_stem int")
    leaves = spark.createDataFrame([], "catalogNumber string, plant_individual_id int, leaf_id int, solidity double, area_px double")
    samples = spark.createDataFrame([("s1", "A", 10, 0.1), ("s2", "A", 90, 0.1)], "genetic_sample_id string, catalogNumber string, mapped_reads long, missing_genotype_rate double")
    calls = spark.createDataFrame([(1, "s1", "t", 0.9), (2, "s2", "u", 0.5)], "assignment_id long, genetic_sample_id string, geno_predicted_taxon string, geno_posterior_prob double")
    got = {(r["catalogNumber"], r["plant_individual_id"]): r for r in master_view(cohort, vouchers, plants, leaves, samples, calls).collect()}
    assert len(got) == 3 and got["A", 1]["county"] == "y" and got["A", 1]["plant_height_mm"] == 5.0 and got["A", 0]["genetic_sample_id"] == "s2" and got["A", 0]["n_samples_linked"] == 2 and got["B", 0]["county"] is None
    narrow = master_view(cohort, vouchers, plants, leaves, samples, calls, columns=["county"])
    assert "genetic_sample_id" not in narrow._jdf.queryExecution().optimizedPlan().toString()


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a"), ("a", None)], "t string, g string")
    assert abs(A.cohens_kappa(df, "t", "g").first()["kappa"] - 0.4) < 1e-12
    assert A.cohens_kappa(df.limit(1), "t", "g").first()["kappa"] is None and A.cohens_kappa(df.limit(0), "t", "g").first()["kappa"] is None
    assert abs(A.adjusted_rand(df.filter("t = g"), "t", "g").first()["ari"] - 1) < 1e-12


def test_auc_and_running_total(spark):
    rng = random.Random(4)
    data = [(rng.randrange(2), rng.randrange(12) / 4) for _ in range(500)]
    auc = A.roc_auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first()[0]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(auc - want) < 1e-12


def test_lookup_with_hot_keys(spark, rows):
    data = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(600)] + [(900, None)], "i int, k int")
    lookup = spark.createDataFrame([(1, "hot", 400), (3, "cold", 1)], "k int, v string, n int")
    for share in (0.1, 10.0):
        got = {r["i"]: r["v"] for r in K.left_lookup(data, lookup, ["k"], "n", 601, share).collect()}
        assert len(got) == 601 and got[1] == "hot" and got[3] == "cold" and got[6] is None and got[900] is None


def test_components_random(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, 200), (None, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for x in list(parent)}


def test_duplicate_groups_and_primary(spark, rows):
    s = "catalogNumber string, collector string, number string, day string, lat double, lon double"
    df = spark.createDataFrame([("N1", "fuller", "1042", "1984-05-12", None, None), ("G2", "fuller", "1042", "1984-05-12", None, None), ("A", "kral", "", "1990-01-02", 35.91230, -79.05120), ("B", "unknown", "", "1990-01-02", 35.91245, -79.05125), ("C", "kral", "", "1990-01-02", 36.5, -79.0512), ("D", "hall", "", "1990-01-02", 35.9126, -79.0513)], s)
    groups = {r["catalogNumber"]: r["dup_group"] for r in D.group_sheets(df).collect()}
    assert groups["N1"] == groups["G2"] == "fuller_1042_1984-05-12"
    assert groups["A"] == groups["B"] == groups["D"] and groups["C"] != groups["A"]  # the unknown collector chains both
    t = spark.createDataFrame([("a", "g", 1, "x", True, False), ("b", "g", 3, "y", False, False), ("c", "g", 3, "x", False, True), ("d", "h", 0, "z", False, False)], "u string, g string, k int, t string, gold boolean, far boolean")
    got = {r["u"]: (r["is_primary"], r["conflict"], r["gold_taxon"]) for r in D.primary_and_conflicts(t, "g", [F.col("k")], "t", F.col("gold"), F.col("far"), "u").collect()}
    assert got == {"a": (0, 0, "x"), "b": (0, 1, "x"), "c": (1, 0, "x"), "d": (1, 0, None)}


def test_thinning_and_farthest(spark):
    rng = random.Random(2)
    pts = [(i, "t", 40 + rng.random(), -110 + rng.random(), float(rng.randrange(3)), i % 50 == 0) for i in range(150)] + [(900, "t", None, None, 0.0, False)]
    df = spark.createDataFrame(pts, "i long, g string, lat double, lon double, r double, keep boolean")
    got = {r["i"] for r in T.greedy_thinning(df, "g", "i", "lat", "lon", "r", 15.0, "keep").collect()}

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    kept = []
    for p in sorted(pts[:-1], key=lambda p: (-p[4], p[0])):
        if p[5] or all(km(p, k) >= 15 for k in kept):
            kept.append(p)
    assert got == {p[0] for p in kept} | {900}
    places = T.farthest_points(df, "g", "i", "lat", "lon", 4).orderBy("place").collect()
    assert [r["place"] for r in places] == [1, 2, 3, 4] and places[0]["i"] == 0


def test_paralogs_sharing_and_replicates(spark, rows):
    het = [(s, "het", 0.5, 20.0, 20.0) for s in "abcde"]
    bias = [("a", "bias", 0.5, 36.0, 4.0), ("b", "bias", 0.0, 10.0, 0.0), ("c", "bias", 0.0, 9.0, 0.0), ("d", "bias", 0.0, 8.0, 0.0)]
    flat = [("a", "flat", 0.0, 9.0, 0.0), ("b", "flat", 0.0, 9.0, 0.0)]
    good = [("a", "good", 0.0, 9.0, 0.0), ("b", "good", 0.5, 10.0, 11.0), ("c", "good", 1.0, 0.0, 9.0), ("d", "good", None, None, None)]
    cells = spark.createDataFrame([*het, *bias, *flat, *good, ("a", "one", 1.0, 1.0, 1.0)], "sample string, locus string, dosage double, n_ref double, n_alt double")
    assert {r["locus"]: r["reason"] for r in Q.paralog_filter(cells).collect()} == {"het": "too_heterozygous", "bias": "uneven_reads", "flat": "monomorphic_or_sparse", "good": "PASS", "one": "monomorphic_or_sparse"}
    d = {(r["a"], r["b"]): r["distance"] for r in Q.allele_sharing(cells, 0.2, 2).collect()}
    assert abs(d["a", "b"] - (0 + 0.5 + 0 + 0.5) / 4) < 1e-12 and d["a", "e"] == 0.0
    members = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", 2, 1)], "sample string, group int, reads int")
    out = {(r["sample"], r["locus"]): r["dosage"] for r in Q.collapse_replicates(cells, members, [F.desc("reads")]).collect()}
    assert out["b", "good"] == 0.25 and ("a", "good") not in out
    eb = Q.posterior_dosage(spark.createDataFrame([("t", "L", 0.25, 30.0, 10.0, 4), ("t", "L", 0.75, 10.0, 30.0, 4), ("t", "L", 0.5, 0.0, 0.0, 4)], "taxon string, locus string, dosage double, n_ref double, n_alt double, ploidy int"), "ploidy", ["taxon"])
    values = [r["eb_dosage"] for r in eb.orderBy("n_alt").collect()]
    assert values[1] < 0.4 and values[2] > 0.6 and values[1] < values[0] < values[2]


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) @ np.diag([5, 2, 1, 0.5]) + [1, 2, 3, 4]
    label = np.where(rng.random(300) < 0.5, "u", "v")
    x[label == "v"] += [8, 0, 0, 0]
    df = spark.createDataFrame([(i, a.tolist(), str(b)) for i, (a, b) in enumerate(zip(x, label, strict=True))], "i long, x array<double>, g string")
    n, mean, scatter = M.moments(df, "x")["all"]
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter / 299, np.cov(x.T))
    axes = M.principal_axes(df, "x", 0.99)
    assert np.allclose(axes.values, np.linalg.eigvalsh(np.cov(x.T))[::-1][: len(axes.values)])
    guess = M.shrinkage_discriminant(df, "x", "g").predict(df, "x", ["i", "g"])
    assert guess.filter("predicted = g").count() > 240 and guess.filter("posterior < 0.5").count() == 0
    d2 = np.array([r["d2"] for r in M.mahalanobis(df, "x", ["i"], 0.0).orderBy("i").collect()])
    assert np.allclose(d2, np.einsum("ij,jk,ik->i", x - x.mean(axis=0), np.linalg.inv(np.cov(x.T)), x - x.mean(axis=0)))
    f = M.permutation_f(df, "x", "g", "i", 19).first()
    assert f["p"] == 0.05 and f["f"] > 50
    assert abs(M.chi2_quantile(0.95, 3) - 7.814727903251179) < 1e-6 and abs(M.chi2_quantile(0.995, 64) - 96.878) < 1e-2
    w, means, _, _ = M.mixture(df.select(F.array(F.col("x")[0]).alias("x")), "x", 2, 60)
    assert abs(sum(w) - 1) < 1e-9 and means[1][0] - means[0][0] > 3


def test_rules_and_gates(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "i int, v int")
    out = R.decide(df, [R.Rule("big", F.col("v") > 10, {"w": 2}), R.Rule("any", F.col("v").isNotNull(), {"w": F.col("v")})], {"w": 0})
    assert rows(out.select("i", "rule", "w")) == [(1, "any", 5), (2, "default", 0), (3, "big", 2)]
    ranges = spark.createDataFrame([("t", "nc", "orange"), ("t", "de", ""), ("t", "va", "floyd")], "taxon string, state string, county string")
    near = spark.createDataFrame([("nc", "orange", "nc", "wake")], "state string, county string, other_state string, other_county string")
    sheets = spark.createDataFrame([("t", "nc", "orange"), ("t", "nc", "wake"), ("t", "de", "kent"), ("t", "va", "giles"), ("t", "ny", "essex"), ("u", "nc", "wake"), ("t", None, None)], "taxon string, state string, county string")
    assert [r["range_status"] for r in E.range_status(sheets, ranges, near, "taxon", "state", "county").orderBy("taxon", F.col("state").asc_nulls_last(), F.desc("county")).collect()] == ["state_only", "adjacent", "in_range", "out", "state", "unknown", "unknown"]
    refs = spark.createDataFrame([("inst", 35.9108, -79.0505)], "name string, y double, x double")
    pts = spark.createDataFrame([(1, 35.9110, -79.0505), (2, 36.0, -79.0505), (3, None, 1.0)], "i int, lat double, lon double")
    assert [r["i"] for r in E.near_reference(pts, refs, "i", "lat", "lon", "y", "x", "name", 250.0).collect()] == [1]


@pytest.mark.parametrize(("most", "want"), [(3, [1, 3, 2]), (10, [1, 3, 2, 4])])
def test_round_robin(spark, most, want):
    df = spark.createDataFrame([(1, "g", "a"), (2, "g", "a"), (3, "g", "b"), (4, "g", "a")], "i int, g string, b string")
    assert [r["i"] for r in T.round_robin(df, "g", ["b"], [F.asc("i")], most).orderBy("place").collect()] == want


def test_density_weights_and_variogram(spark):
    pts = [(i, "t", 40.0 + 0.1 * (i % 3), -110.0) for i in range(6)] + [(9, "t", 45.0, -100.0)]
    df = spark.createDataFrame(pts, "i int, g string, lat double, lon double")

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(x))

    pairs = [(a[0], b[0], metres(a, b)) for a in pts for b in pts if a[0] < b[0]]
    near = spark.createDataFrame(pairs, "a int, b int, metres double")
    got = {r["i"]: r["weight"] for r in T.density_weights(df, near, "i", "g").collect()}
    d = {(a, b): m / 1000 for a, b, m in pairs} | {(b, a): m / 1000 for a, b, m in pairs}
    w = [1 / math.sqrt(1 + sum(math.exp(-d[p[0], q[0]] ** 2 / 1250) + 0.35 * math.exp(-d[p[0], q[0]] ** 2 / 11250) for q in pts if q[0] != p[0])) for p in pts]
    for _ in range(4):
        mean = sum(w) / len(w)
        w = [min(3.0, max(0.2, x / mean)) for x in w]
    assert all(abs(got[p[0]] - x) < 1e-5 for p, x in zip(pts, w, strict=True))
    lags = M.variogram(near.withColumns({"u": F.col("a").cast("double"), "v": F.col("b").cast("double")}), "metres", "u", "v", 50_000).orderBy("lag").collect()
    assert lags[0]["lag"] == 0 and sum(r["n"] for r in lags) == len(pairs)
