"""Genotypes, shapes, statistics and decisions over whole tables.

Genotypes are written from order lines: the supplier is the sample, the part the locus, and each line one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import genotype as G, shapes as P
from ..operators import genomics as Q, rules as R, stats as M
from ..session import table


def _line_cells(spark: SparkSession, d: str) -> DataFrame:
    """One genotype call and its read counts a line."""
    li = table(spark, d, "lineitem")
    gt = F.when(F.col("l_returnflag") == "R", "1/1").when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") % 2 == 0, "0/1").otherwise("0|0|1|1")).when(F.col("l_quantity") % 10 == 0, "./.").otherwise("0/0")
    q = F.col("l_quantity").cast("int")
    cell = F.when(q % 3 == 0, F.concat_ws(":", F.lit("GT"), q, F.concat_ws(",", (q / 3).cast("int"), q - (q / 3).cast("int")))).when(q % 3 == 1, F.concat_ws(":", F.lit("GT"), q, (q / 2).cast("int"))).otherwise(F.concat_ws(":", F.lit("GT"), q, F.lit(".")))
    out = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("locus"), gt.alias("gt"), cell.alias("cell"), q.alias("dp"))
    out = out.withColumn("dosage", G.genotype_dosage(F.col("gt")))
    out = out.withColumn("depth", G.cell_depths(F.lit("GT:DP:AD"), F.col("cell"), F.col("dosage")))
    return out.select("l_orderkey", "l_linenumber", "sample", "locus", "gt", "dp", "dosage", F.col("depth.n_ref").alias("n_ref"), F.col("depth.n_alt").alias("n_alt"))


def _cells(spark: SparkSession, d: str, loci: int | None = None) -> DataFrame:
    """One cell a supplier and part, all its lines together: their mean dosage and the sums of their reads. Samples that
    are compared in pairs need loci in common: for those the parts are joined into ``loci`` loci, again with all lines."""
    locus = F.col("locus") if loci is None else F.col("locus") % loci
    return _line_cells(spark, d).groupBy("sample", locus.alias("locus")).agg(F.avg("dosage").alias("dosage"), F.sum("n_ref").alias("n_ref"), F.sum("n_alt").alias("n_alt"))


#: Loci that the parts are joined into where samples are compared in pairs.
PAIR_LOCI = 200


def q_genotype_cells(spark: SparkSession, d: str) -> DataFrame:
    return _line_cells(spark, d)


def q_paralog_filter(spark: SparkSession, d: str) -> DataFrame:
    out = Q.paralog_filter(_cells(spark, d))
    return out.select("locus", "n_called", "n_hets", F.round("h_obs", 6).alias("h_obs"), F.round("d_stat", 6).alias("d_stat"), "reason")


def q_rescaled_dosage(spark: SparkSession, d: str) -> DataFrame:
    return Q.rescaled_dosage(_cells(spark, d).withColumn("dosage", F.col("dosage") * 2)).groupBy("locus").agg(F.round(F.sum("dosage"), 6).alias("total"))


def q_allele_sharing(spark: SparkSession, d: str) -> DataFrame:
    return Q.allele_sharing(_cells(spark, d, PAIR_LOCI), digits=6).select("a", "b", "distance", "measured", "n_shared")


def q_collapse_replicates(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    members = cells.groupBy("sample").agg(F.count("dosage").alias("n_called")).withColumn("group", F.floor((F.col("sample") - 1) / 2))
    out = Q.collapse_replicates(cells, members, [F.desc("n_called"), F.asc("sample")])
    return out.groupBy("group", "sample").agg(F.count("dosage").alias("n_loci"), F.round(F.sum("dosage"), 6).alias("total"))


def q_posterior_dosage(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).filter("n_ref IS NOT NULL").withColumns({"ploidy": F.lit(4), "taxon": F.col("sample") % 5})
    return Q.posterior_dosage(cells, "ploidy", ["taxon"]).groupBy("taxon").agg(F.round(F.avg("eb_dosage"), 5).alias("mean_dosage"), F.count("*").alias("n"))


def q_kmer_match(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation item's nearest taxon name among its words."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.lower("text").alias("seq"))
    names = table(spark, d, "taxon_synonyms").select(F.col("raw_name_lower").alias("id"), F.col("raw_name_lower").alias("seq"))
    return Q.kmer_containment(names, items, 9).select("query", "reference", "shared", F.round("containment", 6).alias("containment"))


def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The consensus spelling of each synonym's canonical name from the misspelled values that share its start."""
    s = table(spark, d, "taxon_synonyms").select(F.col("canonical_packera").alias("group"), F.lit(0).alias("start"), F.col("raw_name_lower").alias("seq"))
    return Q.consensus(s)


def q_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    seq = F.translate(F.upper(F.regexp_replace("raw_name_lower", "[^acgt]", "")), "U", "T")
    return table(spark, d, "taxon_synonyms").select("raw_name_lower", G.reverse_complement(seq).alias("rc"))


def q_long_tips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("petiole_length_mm IS NOT NULL")
    return Q.long_tips(e, "leaf_zone", "leaf_row_id", "petiole_length_mm", 2.0)


def q_polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").withColumn("v", P.vertices(F.col("contour_xy_json")))
    e = e.withColumns({"area": P.polygon_area(F.col("v")), "perimeter": P.polygon_perimeter(F.col("v"))})
    return e.select("leaf_row_id", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"), F.round(P.circularity(F.col("area"), F.col("perimeter")), 6).alias("circ"), F.round(P.dissection(F.col("area"), F.col("perimeter")), 6).alias("dissection"), F.round(P.centroid_size(F.col("v")), 4).alias("csize"))


def q_hull_solidity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("contour_xy_json IS NOT NULL").withColumn("v", P.vertices(F.col("contour_xy_json")))
    return e.select("leaf_row_id", F.round(P.polygon_area(F.col("v")) / F.nullif(P.hull_area("v"), F.lit(0.0)), 6).alias("solidity"))


def q_fourier(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("contour_xy_json IS NOT NULL").withColumn("c", P.fourier_column(P.vertices(F.col("contour_xy_json")), 4))
    return e.select("leaf_row_id", *[F.round(F.col("c")[i], 4).alias(n) for i, n in enumerate(("a1", "b1", "c1", "d1"))])


def q_euler_curve(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("contour_xy_json IS NOT NULL").withColumn("c", P.euler_column(P.vertices(F.col("contour_xy_json")), 16, 12))
    return e.select("leaf_row_id", F.aggregate("c", F.lit(0), lambda s, x: s + x).alias("total"), F.array_max("c").alias("most"))


def q_principal_axes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return M.principal_axes(e, "embedding", 0.5).scores(e, "embedding", ["vec_id"]).select("vec_id", F.round(F.col("scores")[0], 4).alias("pc1"), F.round(F.col("scores")[1], 4).alias("pc2"))


def q_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return M.mahalanobis(table(spark, d, "embeddings"), "embedding", ["vec_id"]).select("vec_id", F.round("d2", 4).alias("d2"), (F.col("d2") > M.chi2_quantile(0.995, 64)).cast("int").alias("outlier"))


def q_discriminant(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return M.shrinkage_discriminant(e, "embedding", "label").predict(e, "embedding", ["vec_id", "label"]).select("vec_id", "label", "predicted", F.round("posterior", 4).alias("posterior"), F.round("margin", 4).alias("margin"))


def q_group_means(spark: SparkSession, d: str) -> DataFrame:
    """Class means and squared deviations of all vector columns through the moments operator."""
    per = M.moments(table(spark, d, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(g, i, int(n), round(float(m[i]), 5), round(float(s[i, i]), 3)) for g, (n, m, s) in per.items() for i in range(len(m))], "label string, i int, n long, mean double, scatter double")


def q_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return M.kruskal_wallis(table(spark, d, "extracted_leaves"), "solidity", "leaf_zone").select(F.round("h", 5).alias("h"), "k", "n")


def q_permutation_f(spark: SparkSession, d: str) -> DataFrame:
    return M.permutation_f(table(spark, d, "embeddings"), "embedding", "label", "vec_id").select(F.round("f", 5).alias("f"), "p", "times")


def q_collinear_prune(spark: SparkSession, d: str) -> DataFrame:
    columns = ["solidity", "circularity", "aspect_ratio", "area_px", "blade_length_mm", "petiole_length_mm"]
    kept = M.collinear_prune(table(spark, d, "extracted_leaves"), columns, {c: len(columns) - i for i, c in enumerate(columns)}, 0.5)
    return spark.createDataFrame([(c, int(c in kept)) for c in columns], "name string, kept int")


def q_schoener(spark: SparkSession, d: str) -> DataFrame:
    return M.schoener_overlap(table(spark, d, "extracted_leaves"), "leaf_zone", "solidity", 20).select("a", "b", F.round("d", 6).alias("d"), F.round("i", 6).alias("i"))


def q_boyce(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 100000).cast("double").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.boyce_index(li, "s", "y")


def q_mixture(spark: SparkSession, d: str) -> DataFrame:
    fit = M.fit_mixtures(table(spark, d, "embeddings"), "embedding", [3])[0]
    return spark.createDataFrame([(i, round(float(x), 4), j, round(float(v), 4)) for i, (x, m) in enumerate(zip(fit.weights, fit.means, strict=True)) for j, v in enumerate(m)], "component int, weight double, i int, mean double")


def q_mixture_choice(spark: SparkSession, d: str) -> DataFrame:
    """How many components describe the leaves: BIC and ICL of one to six."""
    e = table(spark, d, "extracted_leaves").filter("solidity IS NOT NULL AND circularity IS NOT NULL AND aspect_ratio IS NOT NULL").withColumn("v", F.array("solidity", "circularity", "aspect_ratio"))
    fits = M.fit_mixtures(e, "v", range(1, 7))
    return spark.createDataFrame([(f.k, round(f.bic, 2), round(f.icl, 2), int(f is min(fits, key=lambda x: x.bic)), int(f is min(fits, key=lambda x: x.icl))) for f in fits], "k int, bic double, icl double, best_bic int, best_icl int")


def q_decide(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rules = [
        R.Rule("urgent_open", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"), {"level": 3, "note": F.concat(F.lit("c"), "o_custkey")}),
        R.Rule("large", F.col("o_totalprice") > 300000, {"level": 2}),
        R.Rule("old", F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"), {"level": 1, "note": "old"}),
    ]
    return R.decide(o, rules, {"level": 0, "note": ""}).select("o_orderkey", "rule", "level", "note")


def q_consensus_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves")
    return R.score_consensus(e, {"shape": ("solidity", 0.5), "round": ("circularity", 0.3), "petiole": ("petiole_length_mm", 0.2)}).select("leaf_row_id", F.round("conflict", 8).alias("conflict"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_LINES = """(SELECT l_orderkey, l_linenumber, sample, locus, gt, dp, dosage, CASE WHEN q % 3 = 0 THEN (q // 3)::double WHEN q % 3 = 1 THEN (q - q // 2)::double WHEN dosage IS NOT NULL AND q > 0 THEN q - round_even(q * dosage, 0) END AS n_ref,
 CASE WHEN q % 3 = 0 THEN (q - q // 3)::double WHEN q % 3 = 1 THEN (q // 2)::double WHEN dosage IS NOT NULL AND q > 0 THEN round_even(q * dosage, 0) END AS n_alt
 FROM (SELECT *, q AS dp, CASE gt WHEN '1/1' THEN 1.0 WHEN '0/1' THEN 0.5 WHEN '0|0|1|1' THEN 0.5 WHEN '0/0' THEN 0.0 END::double AS dosage FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS sample, l_partkey AS locus, l_quantity::int AS q,
 CASE WHEN l_returnflag = 'R' THEN '1/1' WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN '0/1' ELSE '0|0|1|1' END WHEN l_quantity % 10 = 0 THEN './.' ELSE '0/0' END AS gt FROM lineitem)))"""
_CELL = f"(SELECT sample, locus, avg(dosage) AS dosage, sum(n_ref) AS n_ref, sum(n_alt) AS n_alt FROM {_LINES} GROUP BY 1, 2)"
_PAIR_CELL = f"(SELECT sample, locus % {PAIR_LOCI} AS locus, avg(dosage) AS dosage, sum(n_ref) AS n_ref, sum(n_alt) AS n_alt FROM {_LINES} GROUP BY 1, 2)"
_V = "from_json(contour_xy_json, '[[\"DOUBLE\"]]')"
_EDGES = f"(SELECT leaf_row_id, n, x, y, lead(x, 1, x0) OVER w AS x2, lead(y, 1, y0) OVER w AS y2 FROM (SELECT leaf_row_id, len(v) AS n, i, v[i][1] AS x, v[i][2] AS y, v[1][1] AS x0, v[1][2] AS y0 FROM (SELECT leaf_row_id, {_V} AS v, unnest(range(1, len({_V}) + 1)) AS i FROM extracted_leaves WHERE contour_xy_json IS NOT NULL)) WINDOW w AS (PARTITION BY leaf_row_id ORDER BY i))"

SQL = {
    "genotype_cells": f"SELECT * FROM {_LINES}",
    "paralog_filter": f"""SELECT locus, n_called, n_hets, round(h, 6) AS h_obs, round(d, 6) AS d_stat, CASE WHEN n_called < 2 THEN 'monomorphic_or_sparse' WHEN n_called >= 4 AND h > 0.6 THEN 'too_heterozygous' WHEN n >= 10 AND abs(d) > 4 THEN 'uneven_reads' WHEN hi - lo <= 1e-8 THEN 'monomorphic_or_sparse' ELSE 'PASS' END AS reason
 FROM (SELECT *, n_hets / nullif(n_called, 0) AS h, CASE WHEN n >= 10 THEN (na - 0.5 * n) / sqrt(0.25 * n) ELSE 0 END AS d FROM (SELECT *, na + nb AS n FROM (SELECT locus, count(dosage) AS n_called, count(*) FILTER (dosage > 0.05 AND dosage < 0.95) AS n_hets, coalesce(sum(n_ref) FILTER (dosage > 0.05 AND dosage < 0.95), 0) AS na, coalesce(sum(n_alt) FILTER (dosage > 0.05 AND dosage < 0.95), 0) AS nb, min(dosage) AS lo, max(dosage) AS hi FROM {_CELL} GROUP BY 1)))""",
    "rescaled_dosage": f"SELECT locus, round(sum(dosage), 6) AS total FROM {_CELL} GROUP BY 1",
    "allele_sharing": f"""WITH c AS (SELECT sample, locus, dosage FROM {_PAIR_CELL} WHERE dosage IS NOT NULL), need AS (SELECT CASE WHEN count(DISTINCT locus) >= 200 THEN 150 ELSE greatest(10, floor(0.2 * count(DISTINCT locus))) END AS m FROM c), s AS (SELECT DISTINCT sample FROM c),
 p AS (SELECT x.sample AS a, y.sample AS b, coalesce(n, 0) AS n_shared, CASE WHEN n >= (SELECT m FROM need) THEN d END AS d FROM s x JOIN s y ON x.sample < y.sample LEFT JOIN (SELECT u.sample AS a, v.sample AS b, count(*) AS n, avg(abs(u.dosage - v.dosage)) AS d FROM c u JOIN c v ON u.locus = v.locus AND u.sample < v.sample GROUP BY 1, 2) z ON z.a = x.sample AND z.b = y.sample),
 w AS (SELECT a, b, d FROM p WHERE d IS NOT NULL UNION ALL SELECT b, a, d FROM p WHERE d IS NOT NULL), via AS (SELECT p.a, p.b, avg(x.d + y.d) AS v FROM p JOIN w x ON x.a = p.a JOIN w y ON y.a = x.b AND y.b = p.b WHERE p.d IS NULL GROUP BY 1, 2)
 SELECT p.a, p.b, round(coalesce(p.d, v, (SELECT coalesce(avg(d), 0.25) FROM p)), 6) AS distance, (p.d IS NOT NULL)::int AS measured, n_shared FROM p LEFT JOIN via ON via.a = p.a AND via.b = p.b""",
    "collapse_replicates": f"""SELECT g AS "group", head AS sample, count(dosage) AS n_loci, round(sum(dosage), 6) AS total FROM (SELECT floor((sample - 1) / 2)::bigint AS g, locus, avg(dosage) AS dosage FROM {_CELL} GROUP BY 1, 2) JOIN (SELECT g, sample AS head FROM (SELECT floor((sample - 1) / 2)::bigint AS g, sample, count(dosage) AS n FROM {_CELL} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, sample) = 1) USING (g) GROUP BY 1, 2""",
    "kmer_match": """WITH q AS (SELECT DISTINCT raw_name_lower AS query, substr(raw_name_lower, i, 9) AS k FROM (SELECT raw_name_lower, unnest(range(1, length(raw_name_lower) - 7)) AS i FROM taxon_synonyms)), r AS (SELECT DISTINCT item_id AS reference, substr(t, i, 9) AS k FROM (SELECT item_id, lower(text) AS t, unnest(range(1, length(text) - 7)) AS i FROM eval_items)),
 f AS (SELECT k, count(*) AS df FROM r GROUP BY 1) SELECT query, reference, shared, round(shared / n, 6) AS containment FROM (SELECT query, reference, count(*) AS shared, round(sum(1 / df), 9) AS rare FROM q JOIN r USING (k) JOIN f USING (k) GROUP BY 1, 2) JOIN (SELECT query, count(*) AS n FROM q GROUP BY 1) USING (query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, rare DESC, reference) = 1""",
    "consensus": """SELECT "group", string_agg(CASE WHEN depth >= 2 THEN b ELSE 'N' END, '' ORDER BY p) AS seq FROM (SELECT "group", p, b, sum(n) OVER (PARTITION BY "group", p) AS depth, n FROM (SELECT canonical_packera AS "group", p, substr(raw_name_lower, p, 1) AS b, count(*) AS n FROM (SELECT canonical_packera, raw_name_lower, unnest(range(1, length(raw_name_lower) + 1)) AS p FROM taxon_synonyms) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY "group", p ORDER BY n DESC, b) = 1) GROUP BY 1""",
    "reverse_complement": "SELECT raw_name_lower, reverse(translate(upper(regexp_replace(raw_name_lower, '[^acgt]', '', 'g')), 'ACGT', 'TGCA')) AS rc FROM taxon_synonyms",
    "long_tips": """WITH m AS (SELECT leaf_zone, median(petiole_length_mm) AS m, count(*) AS n FROM extracted_leaves WHERE petiole_length_mm IS NOT NULL GROUP BY 1), s AS (SELECT leaf_zone, median(abs(petiole_length_mm - m)) AS mad FROM extracted_leaves JOIN m USING (leaf_zone) WHERE petiole_length_mm IS NOT NULL GROUP BY 1)
 SELECT leaf_zone, leaf_row_id, petiole_length_mm FROM extracted_leaves JOIN m USING (leaf_zone) JOIN s USING (leaf_zone) WHERE n >= 6 AND petiole_length_mm > 3 * m AND petiole_length_mm - m > 2 * 1.4826 * mad""",
    "polygon_measures": f"""SELECT e.leaf_row_id, round(a, 4) AS area, round(p, 4) AS perimeter, round(CASE WHEN p > 0 THEN least(1, 4 * pi() * a / (p * p)) END, 6) AS circ, round(CASE WHEN a > 0 THEN greatest(1, p / (2 * sqrt(pi() * a))) END, 6) AS dissection, round(c, 4) AS csize FROM extracted_leaves e LEFT JOIN
 (SELECT leaf_row_id, CASE WHEN max(n) >= 3 THEN abs(sum(x * y2 - x2 * y)) / 2 ELSE 0 END AS a, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS p, sqrt(var_pop(x) * count(*) + var_pop(y) * count(*)) AS c FROM {_EDGES} GROUP BY 1) g ON g.leaf_row_id = e.leaf_row_id""",
    "group_means": "SELECT label::varchar AS label, (i - 1)::int AS i, count(*) AS n, round(avg(x), 5) AS mean, round(var_pop(x) * count(*), 3) AS scatter FROM (SELECT label, unnest(embedding)::double AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2",
    "kruskal": """SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 5) AS h, k, n::bigint AS n FROM (SELECT sum(r * r / m) AS q, count(*) AS k FROM (SELECT leaf_zone, sum(r) AS r, count(*) AS m FROM (SELECT leaf_zone, rank() OVER (ORDER BY solidity) + (count(*) OVER (PARTITION BY solidity) - 1) / 2.0 AS r FROM extracted_leaves WHERE solidity IS NOT NULL AND leaf_zone IS NOT NULL) GROUP BY 1)),
 (SELECT sum(c)::double AS n, sum(c ** 3 - c)::double AS t FROM (SELECT count(*)::double AS c FROM extracted_leaves WHERE solidity IS NOT NULL AND leaf_zone IS NOT NULL GROUP BY solidity))""",
    "schoener": """WITH k AS (SELECT leaf_zone AS g, solidity AS v FROM extracted_leaves WHERE leaf_zone IS NOT NULL AND solidity IS NOT NULL), b AS (SELECT g, least(19, floor((v - (SELECT min(v) FROM k)) / ((SELECT max(v) FROM k) - (SELECT min(v) FROM k)) * 20)) AS bin FROM k), s AS (SELECT g, bin, count(*) / sum(count(*)) OVER (PARTITION BY g) AS p FROM b GROUP BY 1, 2)
 SELECT x.g AS a, y.g AS b, round(sum(least(x.p, y.p)), 6) AS d, round(sum(sqrt(x.p * y.p)), 6) AS i FROM s x JOIN s y ON x.bin = y.bin AND x.g < y.g GROUP BY 1, 2""",
    "boyce": """WITH v AS (SELECT (l_extendedprice / 100000)::double AS s, (l_returnflag = 'R')::int AS y FROM lineitem), k AS (SELECT min(s) AS lo, max(s) AS hi, sum(y) AS np, count(*) AS na, (max(s) - min(s)) / 10.0 AS w FROM v),
 c AS (SELECT lo + 0.5 * w + i * (hi - lo - w) / 19.0 AS c, w, np, na FROM k, range(20) r(i)), r AS (SELECT c, (count(*) FILTER (y = 1) / any_value(np)) / (count(*) / any_value(na)) AS ratio FROM c JOIN v ON v.s >= c.c - 0.5 * w AND v.s <= c.c + 0.5 * w GROUP BY 1)
 SELECT round(corr(a, b), 4) AS rho FROM (SELECT rank() OVER (ORDER BY c) AS a, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0 AS b FROM r)""",
    "decide": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'urgent_open' WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'old' ELSE 'default' END AS rule,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 3 WHEN o_totalprice > 300000 THEN 2 WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 1 ELSE 0 END AS level,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'c' || o_custkey WHEN o_totalprice > 300000 THEN '' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'old' ELSE '' END AS note FROM orders""",
    "consensus_score": "SELECT leaf_row_id, round(coalesce((coalesce(solidity * 0.5::double, 0) + coalesce(circularity * 0.3::double, 0) + coalesce(petiole_length_mm * 0.2::double, 0)) / nullif((solidity IS NOT NULL)::int * 0.5::double + (circularity IS NOT NULL)::int * 0.3::double + (petiole_length_mm IS NOT NULL)::int * 0.2::double, 0), 0), 8) AS conflict FROM extracted_leaves",
}
