"""Tests, regressions, groupings and sequence comparisons over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inference as N
from ..operators.proximity import usable_point
from ..session import table
from .models import _CELL, PAIR_LOCI, _cells


def q_association(spark: SparkSession, d: str) -> DataFrame:
    return N.association(table(spark, d, "extracted_leaves"), "leaf_zone", "qc_flag_reason").select("leaf_zone", "qc_flag_reason", "n", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 6).alias("p"))


def q_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return N.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").select(F.round("chi2", 4).alias("chi2"), "df", "n")


def q_allometry(spark: SparkSession, d: str) -> DataFrame:
    return N.allometry(table(spark, d, "extracted_leaves"), "leaf_zone", "area_px", "blade_length_mm", ["leaf_row_id"]).select("leaf_row_id", F.round("residual", 6).alias("residual"))


def q_variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    got = N.variance_inflation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in got.items()], "name string, vif double")


def q_weighted_z(spark: SparkSession, d: str) -> DataFrame:
    return N.weighted_z(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_suppkey").agg(F.round(F.max("weighted_z"), 6).alias("largest"), F.count_if(F.abs("weighted_z") > 2).alias("n_far"))


def q_watson_williams(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL").withColumn("doy", F.dayofyear(F.make_date("year", "month", "day")))
    return N.watson_williams(v, "doy", "institutionCode").select(F.round("f", 6).alias("f"), "k", "n")


def q_depth_means(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as layers: the line number is the depth, ten a step."""
    li = table(spark, d, "lineitem").select("l_partkey", ((F.col("l_linenumber") - 1) * 10.0).alias("top"), (F.col("l_linenumber") * 10.0).alias("bottom"), F.col("l_quantity").cast("double").alias("q"))
    return N.depth_means(li, ["l_partkey"], "top", "bottom", ["q"], 5.0, 25.0).select("l_partkey", F.round("q", 6).alias("q"))


def q_precedence_state(spark: SparkSession, d: str) -> DataFrame:
    return N.precedence_state(table(spark, d, "extracted_leaves").filter("catalogNumber IS NOT NULL"), ["catalogNumber"], "leaf_zone", [("cauline", 2), ("basal", 1)], "none")


def q_planar_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "plant_individuals").filter("catalogNumber IS NOT NULL")
    out = N.planar_clusters(p, "catalogNumber", "plant_individual_id", "crown_x", "crown_y", F.lit(900.0))
    return out.groupBy("catalogNumber").agg(F.countDistinct("cluster").alias("n_clusters"), F.count("*").alias("n"))


def q_demes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter((F.col("coordinateUncertainty") <= 1000) & usable_point(F.col("decimalLatitude"), F.col("decimalLongitude")))
    exsiccata, sheet = F.trim("exsiccatae_key"), F.trim("catalogNumber")
    key = F.when((exsiccata != "") & ~F.lower(exsiccata).isin("na", "none", "unknown"), F.concat(F.lit("EXS__"), exsiccata)).when(sheet != "", F.concat(F.lit("CAT__"), sheet))
    return N.gathering_demes(v, "voucher_id", "decimalLatitude", "decimalLongitude", 10.0, key)


def q_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return N.silhouette(table(spark, d, "embeddings"), "embedding", "label", "vec_id").select("vec_id", F.round("silhouette", 5).alias("silhouette"))


def q_name_identity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "taxon_synonyms")
    return s.select("raw_name_lower", F.round(N.identity("raw_name_lower", F.lower("canonical_packera")), 6).alias("identity"))


def _groups(cells: DataFrame) -> DataFrame:
    return cells.select("sample").distinct().withColumn("group", F.col("sample") % 4)


def q_divergence(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return N.divergence(cells, _groups(cells)).select("a", "b", F.round("dxy", 6).alias("dxy"), "n_loci")


def q_differentiation(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return N.differentiation(N.divergence(cells, _groups(cells))).select("a", "b", F.round("gdi", 5).alias("gdi"))


def q_lineages(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return N.lineages(cells, _groups(cells)).select("group", "sister", *[F.round(c, 5).alias(c) for c in ("theta", "dxy", "tau", "gdi", "low", "high")], "kind")


def q_hybrid_index(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    parents = _groups(cells).filter("group < 2").select("sample", (F.col("group") + 1).alias("parent"))
    return N.hybrid_index(cells, parents, 0.2).select("sample", F.round("h", 5).alias("h"), F.round("het", 5).alias("het"), "n")


def q_quartet_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Quartets of nations over the samples of all suppliers."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("group"))
    return N.quartet_concordance(_cells(spark, d, PAIR_LOCI), nations)


def q_ploidy_fit(spark: SparkSession, d: str) -> DataFrame:
    return N.ploidy_fit(_cells(spark, d)).select("sample", "ploidy", F.round("bic", 3).alias("bic"))


def q_point_mass(spark: SparkSession, d: str) -> DataFrame:
    return N.point_mass(table(spark, d, "vouchers"), ["coordinateUncertainty", "year", "month", "day", "decimalLatitude"]).select("name", F.round("share", 8).alias("share"))


def q_moving_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("value", F.round("value", 0))
    return N.newest_window(e, "user_id", "event_id", 5, "value").select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


def q_latest_reason(spark: SparkSession, d: str) -> DataFrame:
    return N.latest_reason(table(spark, d, "extracted_leaves").filter("catalogNumber IS NOT NULL"), "catalogNumber", "extracted_at", "qc_flag_reason")


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
_T = "2 * pi() * dayofyear(make_date(year, month, day)) / 365.25"
SQL = {
    "chi_square": "WITH o AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*)::double AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb, sum(o) OVER () AS n FROM o) SELECT round(sum((o - ra * rb / n) ** 2 / (ra * rb / n)), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, max(n)::bigint AS n FROM m",
    "allometry": "WITH r AS (SELECT leaf_row_id, leaf_zone, ln(area_px) AS x, ln(blade_length_mm) AS y FROM extracted_leaves WHERE area_px > 0 AND blade_length_mm > 0 AND leaf_zone IS NOT NULL), m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM r WINDOW w AS (PARTITION BY leaf_zone)), f AS (SELECT sum((x - mx) * (y - my)) AS sxy, sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy FROM m) SELECT leaf_row_id, round(y - CASE WHEN sxy * sxy / nullif(sxx * syy, 0) >= 0.05 THEN sxy / sxx ELSE 0 END * (x - mx), 6) AS residual FROM m, f",
    "weighted_z": "WITH m AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m, sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, round(max((l_extendedprice - m) / sqrt(q - m * m)), 6) AS largest, count(*) FILTER (abs((l_extendedprice - m) / sqrt(q - m * m)) > 2) AS n_far FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1",
    "watson_williams": f"SELECT round((n - k) * (r - sqrt(s * s + c * c)) / ((k - 1) * (n - r)), 6) AS f, k, n::bigint AS n FROM (SELECT sum(sqrt(s * s + c * c)) AS r, sum(s) AS s, sum(c) AS c, sum(n) AS n, count(*) AS k FROM (SELECT institutionCode, count(*) AS n, sum(sin({_T})) AS s, sum(cos({_T})) AS c FROM vouchers WHERE year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL AND institutionCode IS NOT NULL GROUP BY 1 HAVING count(*) >= 3))",
    "depth_means": "SELECT l_partkey, round(sum(l_quantity * o) / sum(o), 6) AS q FROM (SELECT l_partkey, l_quantity::double AS l_quantity, greatest(0, least(l_linenumber * 10.0, 25) - greatest((l_linenumber - 1) * 10.0, 5))::double AS o FROM lineitem) WHERE o > 0 GROUP BY 1",
    "precedence_state": "SELECT catalogNumber, CASE WHEN count(*) FILTER (leaf_zone = 'cauline') >= 2 THEN 'cauline' WHEN count(*) FILTER (leaf_zone = 'basal') >= 1 THEN 'basal' ELSE 'none' END AS state, count(*) AS n FROM extracted_leaves WHERE catalogNumber IS NOT NULL GROUP BY 1",
    "planar_clusters": "WITH RECURSIVE p AS (SELECT DISTINCT catalogNumber AS g, plant_individual_id AS p, crown_x AS x, crown_y AS y FROM plant_individuals WHERE catalogNumber IS NOT NULL AND crown_x IS NOT NULL AND crown_y IS NOT NULL), e AS (SELECT a.g, a.p AS u, b.p AS v FROM p a JOIN p b ON a.g = b.g AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 810000), c(g, n, m) AS (SELECT g, p, p FROM p UNION SELECT c.g, e.v, c.m FROM c JOIN e ON e.g = c.g AND e.u = c.n) SELECT g AS catalogNumber, count(DISTINCT m) AS n_clusters, count(*) AS n FROM (SELECT g, n, min(m) AS m FROM c GROUP BY 1, 2) GROUP BY 1",
    "divergence": f"WITH p AS (SELECT sample % 4 AS g, locus, avg(dosage) AS p, count(*) * 2 AS n FROM {_CELL} WHERE dosage IS NOT NULL GROUP BY 1, 2) SELECT x.g AS a, y.g AS b, round(avg(CASE WHEN x.g = y.g THEN 2 * x.p * (1 - x.p) * x.n / nullif(x.n - 1, 0) ELSE x.p * (1 - y.p) + y.p * (1 - x.p) END), 6) AS dxy, count(*) AS n_loci FROM p x JOIN p y ON x.locus = y.locus AND x.g <= y.g GROUP BY 1, 2",
    "point_mass": " UNION ALL ".join(f"SELECT '{c}' AS name, round(max(n) / sum(n), 8) AS share FROM (SELECT {c}, count(*) AS n FROM vouchers WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("coordinateUncertainty", "year", "month", "day", "decimalLatitude")),
    "moving_mean": "SELECT event_id, round(avg(round(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM events",
    "latest_reason": "SELECT catalogNumber, last(qc_flag_reason ORDER BY extracted_at, qc_flag_reason) AS qc_flag_reason FROM extracted_leaves WHERE catalogNumber IS NOT NULL AND qc_flag_reason IS NOT NULL GROUP BY 1",
    "differentiation": f"WITH p AS (SELECT sample % 4 AS g, locus, avg(dosage) AS p, count(*) * 2 AS n FROM {_CELL} WHERE dosage IS NOT NULL GROUP BY 1, 2), d AS (SELECT x.g AS a, y.g AS b, avg(CASE WHEN x.g = y.g THEN 2 * x.p * (1 - x.p) * x.n / nullif(x.n - 1, 0) ELSE x.p * (1 - y.p) + y.p * (1 - x.p) END) AS dxy FROM p x JOIN p y ON x.locus = y.locus AND x.g <= y.g GROUP BY 1, 2) SELECT d.a, d.b, round(1 - exp(-greatest(d.dxy - greatest(least(u.dxy, v.dxy), 1e-9), 0) / greatest(least(u.dxy, v.dxy), 1e-9)), 5) AS gdi FROM d JOIN d u ON u.a = d.a AND u.b = d.a JOIN d v ON v.a = d.b AND v.b = d.b WHERE d.a < d.b",
    "hybrid_index": f"WITH f AS (SELECT locus, avg(dosage) FILTER (sample % 4 = 0) AS p1, avg(dosage) FILTER (sample % 4 = 1) AS p2 FROM {_CELL} GROUP BY 1) SELECT sample, round(avg(greatest(0, least(1, (dosage - p1) / (p2 - p1)))), 5) AS h, round(avg((dosage > 0.05 AND dosage < 0.95)::int), 5) AS het, count(*) AS n FROM {_CELL} JOIN f USING (locus) WHERE dosage IS NOT NULL AND abs(p1 - p2) >= 0.2 GROUP BY 1",
}
