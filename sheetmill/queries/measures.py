"""Aggregates, windows, selection and spatial measures over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import circular as C, scalar as S
from ..operators import aggregates as A, selection as T
from ..operators.components import connected_components
from ..operators.proximity import near_pairs, nearest_sites, usable_point
from ..session import table


def q_conditional_having(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves").filter("catalogNumber IS NOT NULL")
    out = e.groupBy("catalogNumber").agg(F.count("*").alias("n"), F.count_if(F.col("qc_flag_reason") == "PASS").alias("n_pass"), F.countDistinct("plant_individual_id").alias("n_plants"))
    return out.filter("n_plants > 1")


def q_run_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "genetic_lineage_assignments").filter("genetic_sample_id IS NOT NULL")
    return a.groupBy("genetic_sample_id").agg(F.countDistinct("run_id").alias("n_runs"), F.round(F.avg("q_max"), 6).alias("mean_q"), F.max("geno_posterior_prob").alias("best"))


def q_plant_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of a plant's leaves: basal leaves if it has any, else all; millimetres only where calibrated."""
    e = table(spark, d, "extracted_leaves").filter("catalogNumber IS NOT NULL AND plant_individual_id IS NOT NULL")
    e = e.withColumn("basal", (F.col("leaf_zone") == "basal").cast("int"))
    any_basal = e.groupBy("catalogNumber", "plant_individual_id").agg(F.max("basal").alias("has"))
    kept = e.join(any_basal, ["catalogNumber", "plant_individual_id"]).filter("basal = 1 OR coalesce(has, 0) = 0")
    mm = F.when(F.col("is_calibrated_mm") == 1, F.col("blade_length_mm"))
    return kept.groupBy("catalogNumber", "plant_individual_id").agg(F.count("*").alias("n"), F.round(F.median("solidity"), 6).alias("solidity"), F.round(F.median(mm), 6).alias("blade_mm"), F.round(F.percentile("aspect_ratio", F.lit(0.75)), 6).alias("aspect_q75"))


def q_circular_by_taxon(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL").select("stateProvince", F.dayofyear(F.make_date("year", "month", "day")).alias("doy"))
    g = v.groupBy("stateProvince").agg(F.count("*").alias("n"), C.mean_day(F.col("doy")).alias("mean"), C.resultant(F.col("doy")).alias("r"))
    return g.select("stateProvince", "n", F.round("mean", 4).alias("mean_doy"), F.round("r", 6).alias("r"), F.round(C.circular_sd_days(F.col("r")), 4).alias("sd_days"), F.round(C.rayleigh_p(F.col("r"), F.col("n")), 8).alias("p_uniform"), F.round(C.von_mises_kappa(F.col("r"), F.col("n")), 6).alias("kappa"))


def q_circular_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("hour_angle", F.hour("ts") * (365.25 / 24))
    return e.groupBy("event_type").agg(F.round(C.resultant(F.col("hour_angle"), F.col("value")), 6).alias("weighted_r"), F.count("*").alias("n"))


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    tier = lambda c: F.regexp_extract(F.lower(c), "gold|silver|bronze", 0)
    return v.select("voucher_id", F.nullif(tier(F.col("determiner_tier")), F.lit("")).alias("truth"), F.when(F.col("identifiedBy").isNull(), "bronze").when(F.length("identifiedBy") % 3 == 0, "gold").otherwise("silver").alias("guess"))


def q_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.cohens_kappa(_tiers(spark, d), "truth", "guess").select("n", F.round("kappa", 8).alias("kappa"))


def q_kappa_clamped(spark: SparkSession, d: str) -> DataFrame:
    return A.cohens_kappa(_tiers(spark, d), "truth", "guess", 4, 0.05, 0.99).select("n", F.round("kappa", 8).alias("kappa"))


def q_class_precision(spark: SparkSession, d: str) -> DataFrame:
    return A.class_precision(_tiers(spark, d), "truth", "guess").select("guess", "n", F.round("precision", 8).alias("precision"))


def q_adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return A.adjusted_rand(_tiers(spark, d), "truth", "guess").select("n", F.round("ari", 8).alias("ari"))


def q_modal_county(spark: SparkSession, d: str) -> DataFrame:
    return A.modal_value(table(spark, d, "vouchers").select("institutionCode", "stateProvince", "county"), ["institutionCode", "stateProvince"], "county")


def q_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.inverse_frequency_weights(table(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", F.round("weight", 8).alias("weight"))


def q_robust_z(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    z = A.robust_z(li, ["l_partkey"], "l_extendedprice")
    return z.filter(F.abs("robust_z") > 2.5).groupBy("l_partkey").agg(F.count("*").alias("n_outliers"), F.round(F.max("robust_z"), 6).alias("largest"))


def q_shrunken_centering(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    return A.shrunken_centering(li, "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(F.round(F.avg("centred"), 4).alias("mean_centred"))


def q_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).alias("cents"))
    return A.leave_one_out_mean(o, "o_custkey", "cents").select("o_orderkey", F.round("loo_mean", 4).alias("loo_mean"))


def q_auc(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("s"))
    return A.roc_auc(li.withColumn("s", F.round("s", 6)), "y", "s").select(F.round("auc", 8).alias("auc"))


def q_running_total(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 0).alias("v"))
    return A.running_total(o, "o_orderkey", "v").select("o_orderkey", "total_v")


def q_authorities(spark: SparkSession, d: str) -> DataFrame:
    """Determiners with at least five gold sheets in three collections, and how often duplicates contradict them."""
    v = table(spark, d, "vouchers").filter("identifiedBy IS NOT NULL").withColumn("gold", F.lower("determiner_tier").contains("gold"))
    g = v.groupBy("identifiedBy").agg(F.count_if("gold").alias("n_gold"), F.countDistinct(F.when(F.col("gold"), F.col("institutionCode"))).alias("n_collections"), F.countDistinct("species_raw").alias("n_names"))
    return g.filter("n_gold >= 5 AND n_collections >= 3")


def q_effective_gatherings(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    blank = F.col("exsiccatae_key").isNull() | (F.trim("exsiccatae_key") == "")
    return v.groupBy("institutionCode").agg((F.countDistinct(F.when(~blank, F.col("exsiccatae_key"))) + F.count_if(blank)).alias("n_gatherings"))


def q_unanimous(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("exsiccatae_key IS NOT NULL")
    return v.groupBy("exsiccatae_key").agg(F.when(F.min("month") == F.max("month"), F.min("month")).alias("month"), F.count("*").alias("n"))


def q_dense_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Clusters renumbered by size, the smaller old label first among equals."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return e.select("label", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("label"))).alias("new_label"))


def q_sibling_donor(spark: SparkSession, d: str) -> DataFrame:
    """Plants without a height take 0.9 of their sheet's tallest measured sibling."""
    p = table(spark, d, "plant_individuals")
    donor = p.filter("plant_height_mm IS NOT NULL").groupBy("catalogNumber").agg(F.max_by("plant_height_mm", F.struct("plant_height_mm", "plant_individual_id")).alias("h"))
    return p.join(donor, "catalogNumber", "left").select("catalogNumber", "plant_individual_id", F.round(F.coalesce("plant_height_mm", F.col("h") * 0.9), 6).alias("height"))


def q_mean_impute(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "plant_individuals")
    mid = p.groupBy("is_bent_stem").agg(F.median("plant_height_mm").alias("m"))
    return p.join(mid, p["is_bent_stem"].eqNullSafe(mid["is_bent_stem"])).select("catalogNumber", "plant_individual_id", F.round(F.coalesce("plant_height_mm", "m"), 6).alias("height"))


def q_round_robin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return T.round_robin(c, "n_regionkey", ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 40).select("n_regionkey", "c_custkey", "turn", "place")


def q_quota_then_fill(spark: SparkSession, d: str) -> DataFrame:
    return T.quota_then_fill(table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 4, 150).select("c_custkey", "c_nationkey", "first_pass")


def q_top_share(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum(F.round("o_totalprice", 0)), 0).alias("v"))
    return T.top_share(c, "c_nationkey", "c_custkey", "v", 0.5).select("c_nationkey", "c_custkey")


def q_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return T.hash_sample(table(spark, d, "part"), "p_partkey", "p_brand", 5).groupBy("p_brand").agg(F.count("*").alias("n"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.filter((F.col("coordinateUncertainty") <= 1000) & usable_point(F.col("decimalLatitude"), F.col("decimalLongitude")))


def q_thinning(spark: SparkSession, d: str) -> DataFrame:
    v = _sites(spark, d).withColumn("rank", F.when(F.lower("determiner_tier").contains("gold"), 2).otherwise(1)).withColumn("taxon", S.binomial(F.col("species_raw"))).filter("taxon IS NOT NULL")
    return T.greedy_thinning(v, "taxon", "voucher_id", "decimalLatitude", "decimalLongitude", "rank", 15.0)


def q_farthest(spark: SparkSession, d: str) -> DataFrame:
    return T.farthest_points(_sites(spark, d), "stateProvince", "voucher_id", "decimalLatitude", "decimalLongitude", 12)


def q_proximity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of one day at most 50 m apart, chained: the smallest voucher of each chain and its size."""
    v = _sites(spark, d).filter("year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL")
    pairs = near_pairs(v.withColumn("on", F.concat_ws("-", "year", "month", "day")), "voucher_id", "decimalLatitude", "decimalLongitude", 50.0, ("on",)).filter("on_a = on_b")
    return connected_components(pairs, "voucher_id_a", "voucher_id_b").groupBy("component").agg(F.count("*").alias("n"))


def q_idw_whole(spark: SparkSession, d: str) -> DataFrame:
    """Coordinate uncertainty estimated from the five nearest other sheets within 10 km."""
    v = _sites(spark, d).select("voucher_id", F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"), "coordinateUncertainty")
    sites = v.withColumnRenamed("voucher_id", "site")
    near = nearest_sites(v.withColumnRenamed("voucher_id", "point"), sites, 5, 10_000.0)
    out = T.nearest_weighted(v, sites, "voucher_id", "coordinateUncertainty", near)
    return out.select("voucher_id", F.round("estimate", 4).alias("estimate"), "n_sites")


def q_grid_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Half-degree blocks dealt to five folds in order of their first sheet."""
    v = _sites(spark, d).select("voucher_id", F.floor(F.col("decimalLatitude") * 2).alias("by"), F.floor(F.col("decimalLongitude") * 2).alias("bx"))
    blocks = v.groupBy("by", "bx").agg(F.min("voucher_id").alias("first"), F.count("*").alias("n"))
    return blocks.select("by", "bx", "n", ((F.row_number().over(Window.orderBy("first")) - 1) % 5).alias("fold"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_T = "(SELECT voucher_id, nullif(regexp_extract(lower(determiner_tier), 'gold|silver|bronze'), '') AS truth, CASE WHEN identifiedBy IS NULL THEN 'bronze' WHEN length(identifiedBy) % 3 = 0 THEN 'gold' ELSE 'silver' END AS guess FROM vouchers)"
_C = f"(SELECT truth, guess, count(*)::double AS n FROM {_T} WHERE truth IS NOT NULL GROUP BY 1, 2)"
_K = f"SELECT sum(n)::bigint AS n, (sum(n) FILTER (truth = guess) / sum(n) - (SELECT sum(a.n * b.n) FROM (SELECT truth AS k, sum(n) AS n FROM {_C} GROUP BY 1) a JOIN (SELECT guess AS k, sum(n) AS n FROM {_C} GROUP BY 1) b USING (k)) / sum(n) / sum(n)) / (1 - (SELECT sum(a.n * b.n) FROM (SELECT truth AS k, sum(n) AS n FROM {_C} GROUP BY 1) a JOIN (SELECT guess AS k, sum(n) AS n FROM {_C} GROUP BY 1) b USING (k)) / sum(n) / sum(n)) AS kappa FROM {_C}"
_SITE = "(SELECT * FROM vouchers WHERE coordinateUncertainty <= 1000 AND decimalLatitude BETWEEN -90 AND 90 AND decimalLongitude BETWEEN -180 AND 180 AND NOT (decimalLatitude = 0 AND decimalLongitude = 0))"
_HAV = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.decimalLatitude - a.decimalLatitude) / 2), 2) + cos(radians(a.decimalLatitude)) * cos(radians(b.decimalLatitude)) * pow(sin(radians(b.decimalLongitude - a.decimalLongitude) / 2), 2))))"

SQL = {
    "conditional_having": "SELECT catalogNumber, count(*) AS n, count(*) FILTER (qc_flag_reason = 'PASS') AS n_pass, count(DISTINCT plant_individual_id) AS n_plants FROM extracted_leaves WHERE catalogNumber IS NOT NULL GROUP BY 1 HAVING count(DISTINCT plant_individual_id) > 1",
    "run_counts": "SELECT genetic_sample_id, count(DISTINCT run_id) AS n_runs, round(avg(q_max), 6) AS mean_q, max(geno_posterior_prob) AS best FROM genetic_lineage_assignments WHERE genetic_sample_id IS NOT NULL GROUP BY 1",
    "plant_medians": "SELECT catalogNumber, plant_individual_id, count(*) AS n, round(median(solidity), 6) AS solidity, round(median(CASE WHEN is_calibrated_mm = 1 THEN blade_length_mm END), 6) AS blade_mm, round(quantile_cont(aspect_ratio, 0.75), 6) AS aspect_q75 FROM (SELECT *, (leaf_zone = 'basal')::int AS basal, max((leaf_zone = 'basal')::int) OVER (PARTITION BY catalogNumber, plant_individual_id) AS has FROM extracted_leaves WHERE catalogNumber IS NOT NULL AND plant_individual_id IS NOT NULL) WHERE basal = 1 OR coalesce(has, 0) = 0 GROUP BY 1, 2",
    "circular_by_taxon": """SELECT stateProvince, n, round(CASE WHEN a <= 0 THEN a + 2 * pi() ELSE a END * 365.25 / (2 * pi()), 4) AS mean_doy, round(r, 6) AS r, round(CASE WHEN r > 0 AND r < 1 THEN sqrt(-2 * ln(r)) * 365.25 / (2 * pi()) WHEN r >= 1 THEN 0 END, 4) AS sd_days,
 round(greatest(0, least(1, exp(-n * r * r) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z ** 3 - 9 * z ** 4) / (288 * n * n)))), 8) AS p_uniform,
 round(CASE WHEN n >= 16 THEN k WHEN k < 2 THEN greatest(k - 2 / (n * k), 0) ELSE (n - 1) ** 3 * k / (n * (n * n + 1)) END, 6) AS kappa
 FROM (SELECT *, CASE WHEN r < 0.53 THEN 2 * r + r ** 3 + 5 * r ** 5 / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / nullif(r ** 3 - 4 * r * r + 3 * r, 0) END AS k FROM (SELECT *, atan2(s, c) AS a, sqrt(s * s + c * c) AS r, n * (s * s + c * c) AS z FROM (SELECT stateProvince, count(*) AS n, avg(sin(2 * pi() * doy / 365.25)) AS s, avg(cos(2 * pi() * doy / 365.25)) AS c FROM (SELECT stateProvince, dayofyear(make_date(year, month, day)) AS doy FROM vouchers WHERE year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL) GROUP BY 1)))""",
    "circular_events": "SELECT event_type, round(sqrt((sum(value * sin(t)) / sum(value)) ** 2 + (sum(value * cos(t)) / sum(value)) ** 2), 6) AS weighted_r, count(*) AS n FROM (SELECT event_type, value, 2 * pi() / 365.25 * (hour(ts) * (365.25 / 24)) AS t FROM events) GROUP BY 1",
    "kappa": f"SELECT n, round(kappa, 8) AS kappa FROM ({_K})",
    "kappa_clamped": f"SELECT n, round(greatest(0.05, least(0.99, kappa)), 8) AS kappa FROM ({_K})",
    "class_precision": f"SELECT guess, sum(n)::bigint AS n, round((coalesce(sum(n) FILTER (truth = guess), 0) + 0.5) / (sum(n) + 0.5 * (SELECT count(DISTINCT truth) FROM {_C})), 8) AS precision FROM {_C} GROUP BY 1",
    "adjusted_rand": f"""SELECT n::bigint AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 8) AS ari FROM (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM {_C}),
 (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM {_C} GROUP BY truth)), (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM {_C} GROUP BY guess))""",
    "modal_county": "SELECT institutionCode, stateProvince, county AS modal_county, n AS n_mode FROM (SELECT institutionCode, stateProvince, county, count(*) AS n FROM vouchers WHERE county IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY institutionCode, stateProvince ORDER BY n DESC, county) = 1",
    "class_weights": "SELECT vec_id, round(count(*) OVER ()::double / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)), 8) AS weight FROM embeddings",
    "robust_z": """WITH m AS (SELECT l_partkey, median(l_extendedprice) AS med, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_partkey, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN m USING (l_partkey) GROUP BY 1)
 SELECT l_partkey, count(*) AS n_outliers, round(max((l_extendedprice - med) / (1.4826 * mad)), 6) AS largest FROM lineitem JOIN m USING (l_partkey) JOIN s USING (l_partkey) WHERE n >= 6 AND mad > 0 AND abs((l_extendedprice - med) / (1.4826 * mad)) > 2.5 GROUP BY 1""",
    "shrunken_centering": "SELECT l_suppkey, round(avg(l_extendedprice) - CASE WHEN count(*) >= 10 THEN (avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM lineitem)) * count(*) / (count(*) + 10.0) ELSE 0 END, 4) AS mean_centred FROM lineitem GROUP BY 1",
    "leave_one_out": "SELECT o_orderkey, round((sum(c) OVER w - c) / nullif(count(*) OVER w - 1, 0), 4) AS loo_mean FROM (SELECT *, round(o_totalprice * 100) AS c FROM orders) WINDOW w AS (PARTITION BY o_custkey)",
    "auc": "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::double * count(*) FILTER (y = 0)), 8) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT (l_returnflag = 'R')::int AS y, round(l_discount * 10 + l_tax, 6) AS s FROM lineitem))",
    "running_total": "SELECT o_orderkey, sum(round(o_totalprice, 0)) OVER (ORDER BY o_orderkey) AS total_v FROM orders",
    "authorities": "SELECT identifiedBy, count(*) FILTER (g) AS n_gold, count(DISTINCT institutionCode) FILTER (g) AS n_collections, count(DISTINCT species_raw) AS n_names FROM (SELECT *, lower(determiner_tier) LIKE '%gold%' AS g FROM vouchers WHERE identifiedBy IS NOT NULL) GROUP BY 1 HAVING n_gold >= 5 AND n_collections >= 3",
    "effective_gatherings": "SELECT institutionCode, count(DISTINCT CASE WHEN trim(exsiccatae_key) <> '' THEN exsiccatae_key END) + count(*) FILTER (exsiccatae_key IS NULL OR trim(exsiccatae_key) = '') AS n_gatherings FROM vouchers GROUP BY 1",
    "unanimous": "SELECT exsiccatae_key, CASE WHEN min(month) = max(month) THEN min(month) END AS month, count(*) AS n FROM vouchers WHERE exsiccatae_key IS NOT NULL GROUP BY 1",
    "dense_relabel": "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS new_label FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
    "sibling_donor": "SELECT catalogNumber, plant_individual_id, round(coalesce(plant_height_mm, 0.9 * max(plant_height_mm) OVER (PARTITION BY catalogNumber)), 6) AS height FROM plant_individuals",
    "mean_impute": "SELECT catalogNumber, plant_individual_id, round(coalesce(plant_height_mm, median(plant_height_mm) OVER (PARTITION BY is_bent_stem)), 6) AS height FROM plant_individuals",
    "round_robin": "SELECT n_regionkey, c_custkey, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY turn, c_acctbal DESC, c_custkey) AS place FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer JOIN nation ON c_nationkey = n_nationkey)) WHERE place <= 40",
    "quota_then_fill": "SELECT c_custkey, c_nationkey, f AS first_pass FROM (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 4)::int AS f FROM customer) ORDER BY f DESC, c_acctbal DESC, c_custkey LIMIT 150",
    "top_share": "SELECT c_nationkey, c_custkey FROM (SELECT *, coalesce(sum(v) OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v) OVER (PARTITION BY c_nationkey) AS t FROM (SELECT c_nationkey, c_custkey, round(sum(round(o_totalprice, 0)), 0) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)) WHERE b < 0.5 * t",
    "hash_sample": "SELECT p_brand, least(count(*), 5) AS n FROM part GROUP BY 1",
    "proximity_groups": f"""WITH RECURSIVE p AS (SELECT a.voucher_id AS x, b.voucher_id AS y FROM {_SITE} a JOIN {_SITE} b ON a.voucher_id <> b.voucher_id AND a.year = b.year AND a.month = b.month AND a.day = b.day AND {_HAV} <= 50),
 c(n, m) AS (SELECT DISTINCT x, x FROM p UNION SELECT p.y, c.m FROM c JOIN p ON p.x = c.n) SELECT component, count(*) AS n FROM (SELECT n, min(m) AS component FROM c GROUP BY 1) GROUP BY 1""",
    "idw_whole": f"""SELECT voucher_id, round(sum(v * w) / sum(w), 4) AS estimate, count(*) AS n_sites FROM (SELECT *, 1 / greatest(m / 1000, 0.25) ** 2 AS w FROM (SELECT a.voucher_id, b.voucher_id AS site, b.coordinateUncertainty AS v, {_HAV} AS m FROM {_SITE} a JOIN {_SITE} b ON a.voucher_id <> b.voucher_id AND abs(a.decimalLatitude - b.decimalLatitude) < 0.091 AND {_HAV} <= 10000)
 QUALIFY row_number() OVER (PARTITION BY voucher_id ORDER BY m, site) <= 5) GROUP BY 1""",
    "grid_blocks": f"SELECT \"by\", bx, n, (row_number() OVER (ORDER BY f) - 1) % 5 AS fold FROM (SELECT floor(decimalLatitude * 2)::bigint AS \"by\", floor(decimalLongitude * 2)::bigint AS bx, min(voucher_id) AS f, count(*) AS n FROM {_SITE} GROUP BY 1, 2)",
}
