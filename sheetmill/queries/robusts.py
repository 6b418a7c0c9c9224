"""Robust centres, anchors, clusters and donors over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import shapes as P
from ..operators import robust as B
from ..session import table
from .models import _PAIR_CELL, PAIR_LOCI, _cells


def q_robust_outliers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("solidity IS NOT NULL AND circularity IS NOT NULL").withColumn("v", F.array("solidity", "circularity"))
    return B.robust_outliers(e, "leaf_zone", "leaf_row_id", "v").groupBy("outlier").agg(F.count("*").alias("n"))


def q_core_centre(spark: SparkSession, d: str) -> DataFrame:
    c = B.core_centre(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centre").alias("i", "c")).select("label", "i", F.round("c", 5).alias("c"))


def q_anchors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("species_raw IS NOT NULL")
    tier = F.lower("determiner_tier")
    out = B.anchors_with_fallback(v, "species_raw", [("gold", tier.contains("gold"), 5), ("silver", tier.rlike("gold|silver"), 3)])
    return out.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("species_raw").alias("n_taxa"))


def q_name_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "taxon_synonyms")
    return B.sequence_clusters(s.withColumn("block", F.split_part("canonical_packera", F.lit(" "), F.lit(1))), "block", "raw_name_lower", "raw_name_lower", 4, 0.6)


def q_harmonic_power(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("contour_xy_json IS NOT NULL").withColumn("c", P.fourier_column(P.vertices(F.col("contour_xy_json")), 24))
    return B.harmonic_power(e, "c").select("n_harmonics", F.round("power", 6).alias("power"))


def q_nearest_donors(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, PAIR_LOCI).withColumn("blk", F.floor(F.col("locus") / 20))
    return B.nearest_donors(cells, "blk", 10).select("a", "b", F.round("share", 6).alias("share"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
SQL = {
    "core_centre": "WITH f AS (SELECT vec_id, label, unnest(embedding)::double AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, median(x) AS m FROM f GROUP BY 1, 2), d AS (SELECT vec_id, label, sum((x - m) ** 2) AS d FROM f JOIN m USING (label, i) GROUP BY 1, 2), q AS (SELECT label, quantile_cont(d, 0.6) AS q FROM d GROUP BY 1) SELECT label, (i - 1)::int AS i, round(avg(x), 5) AS c FROM f JOIN d USING (vec_id, label) JOIN q USING (label) WHERE d <= q + 1e-12 GROUP BY 1, 2",
    "anchors": "WITH v AS (SELECT species_raw, coalesce(lower(determiner_tier) LIKE '%gold%', false) AS g, coalesce(regexp_matches(lower(determiner_tier), 'gold|silver'), false) AS s FROM vouchers WHERE species_raw IS NOT NULL), c AS (SELECT species_raw, CASE WHEN count(*) FILTER (g) >= 5 THEN 'gold' WHEN count(*) FILTER (s) >= 3 THEN 'silver' ELSE 'all' END AS level FROM v GROUP BY 1) SELECT level, count(*) AS n, count(DISTINCT species_raw) AS n_taxa FROM v JOIN c USING (species_raw) WHERE level = 'all' OR (level = 'gold' AND g) OR (level = 'silver' AND s) GROUP BY 1",
    "nearest_donors": f"WITH k AS (SELECT sample, locus, dosage, locus // 20 AS blk FROM {_PAIR_CELL} WHERE dosage IS NOT NULL), d AS (SELECT x.blk, x.sample AS a, y.sample AS b, round(avg(abs(x.dosage - y.dosage)), 9) AS d FROM k x JOIN k y ON x.locus = y.locus AND x.sample <> y.sample GROUP BY 1, 2, 3 HAVING count(*) >= 5), t AS (SELECT *, count(*) OVER (PARTITION BY blk, a) AS c FROM (SELECT * FROM d QUALIFY d = min(d) OVER (PARTITION BY blk, a))), s AS (SELECT a, b, sum(1 / c) AS s FROM t GROUP BY 1, 2) SELECT a, b, round(s / sum(s) OVER (PARTITION BY a), 6) AS share FROM s",
}
