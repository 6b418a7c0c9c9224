"""Cohort weights, affinities, seasons and small text forms over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators import cohorts as C, seasons as Y, stats as M
from ..session import table


def _dated(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL")
    return v.withColumn("doy", F.dayofyear(F.make_date("year", "month", "day"))).filter("doy IS NOT NULL")


def q_pool_cap(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of a state weighed by the length of their locality; silver ones are of second trust, types promoted."""
    tier = F.lower("determiner_tier")
    v = table(spark, d, "vouchers").select("voucher_id", "stateProvince", "determiner_tier", "type_status", (F.length("locality") % 9 + 1).cast("double").alias("w"))
    out = C.pool_cap(v, "stateProvince", "w", tier.contains("gold"), tier.contains("silver"), F.col("type_status").isNotNull())
    return out.select("voucher_id", F.round("capped_weight", 6).alias("capped_weight"), "capped")


def q_habitat_indices(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as sites: quantities and dates stand for depths and climate."""
    q, x = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (q * 4).alias("depth"), F.when(x % 2 == 0, q * 3).alias("buffer"), F.when(x % 3 == 0, q).alias("pct"), F.when(x == 1, q > 25).alias("out"),
        (q - 10).alias("warm"), F.when(x != 4, q * 2).alias("dry_m"), F.when(x == 5, q * 5).alias("dry_q"), (q * 11).alias("season"), (q - 30).alias("cold"), F.when(x % 2 == 1, q / 3).alias("range"),
    )
    out = C.habitat_indices(li, "depth", "buffer", "pct", "out", "warm", "dry_m", "dry_q", "season", "cold", "range")
    return out.select("l_orderkey", "l_linenumber", "lithic_index", "moisture_deficit", "maritime_index")


def q_season_affinity(spark: SparkSession, d: str) -> DataFrame:
    return Y.season_affinity(_dated(spark, d), "doy", "institutionCode").select("a", "b", F.round("days", 4).alias("days"), F.round("affinity", 6).alias("affinity"))


def _group_pairs(spark: SparkSession, d: str) -> DataFrame:
    season = Y.season_affinity(_dated(spark, d), "doy", "institutionCode").select("a", "b", F.col("affinity").alias("season"))
    shape = M.schoener_overlap(table(spark, d, "vouchers"), "institutionCode", "decimalLatitude", 20)
    both = season.join(shape.select("a", "b", F.col("d").alias("shape"), F.when(F.col("i") > 0.5, F.col("i")).alias("ground")), ["a", "b"])
    return C.joint_affinity(both, "shape", "ground", "season")


def q_joint_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Collections by the overlap of their latitudes and seasons."""
    return _group_pairs(spark, d)


def q_nearest_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest_groups(_group_pairs(spark, d)).select("group", "rank", "neighbour")


def q_supported_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.supported_labels(table(spark, d, "vouchers").select("voucher_id", "institutionCode", "stateProvince"), ["institutionCode", "stateProvince"], 5).groupBy("label").agg(F.count("*").alias("n"))


def q_clade_discordance(spark: SparkSession, d: str) -> DataFrame:
    """Samples by project as clade and raw taxon."""
    s = table(spark, d, "genomic_samples").select("genetic_sample_id", "project_id", "taxon_raw").distinct()
    return C.clade_discordance(s, "genetic_sample_id", "project_id", "taxon_raw").distinct()


def q_locus_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts as loci whose names have positions behind them, looked up in the list of brands."""
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.col("p_brand")).when(key % 4 == 1, F.concat("p_brand", F.lit(":"), key)).when(key % 4 == 2, F.concat("p_brand", F.lit("_pos"), key)).otherwise(F.concat(F.lit("x"), "p_brand"))
    p = table(spark, d, "part").select(name.alias("locus"))
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return C.locus_lookup(p, "locus", brands, "p_brand", ["n"])


def q_covered_view(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sheets cover the leaves' catalogue numbers."""
    view, cohort = table(spark, d, "vouchers").select("catalogNumber"), table(spark, d, "extracted_leaves").select("catalogNumber")
    rows, share, enough = C.covered_view(view, cohort, "catalogNumber")
    return rows.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(round(share, 8)).alias("share"), F.lit(int(enough)).alias("enough"))


CITIES = ("almouth", "alder", "birch")


def q_independent_city(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").groupBy("county").agg(F.first(S.independent_city(F.col("county"), CITIES)).alias("city"))


def q_underscore_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").groupBy("locality").agg(F.first(S.underscore_label(F.col("locality"))).alias("label"))


def q_code_list(spark: SparkSession, d: str) -> DataFrame:
    """States as lists of codes."""
    return table(spark, d, "vouchers").groupBy("stateProvince").agg(F.first(F.array_join(S.code_list(F.col("stateProvince"), ("US", "CA")), "+")).alias("codes"))


def q_bare_sample(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit(" “"), "genetic_sample_id", F.lit("_sorted” "))
    return table(spark, d, "genomic_samples").filter("genetic_sample_id IS NOT NULL").select("genetic_sample_id", S.bare_sample(quoted).alias("bare")).distinct()


def q_lat_lon(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("N "), F.round("decimalLatitude", 3), F.lit("; "), F.round("decimalLongitude", 3), F.lit(" (map)"))
    return table(spark, d, "vouchers").filter("abs(decimalLatitude) > 0.01 AND abs(decimalLongitude) > 0.01").select("voucher_id", S.lat_lon(text).alias("p")).select("voucher_id", "p.lat", "p.lon")


def q_batch_effects(spark: SparkSession, d: str) -> DataFrame:
    """What the ship mode explains of a line's price beside its flag."""
    out = M.batch_effects(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity")
    return out.select("df", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"), F.round("partial_eta_sq", 8).alias("partial_eta_sq"), "n")


def q_group_differences(spark: SparkSession, d: str) -> DataFrame:
    return M.group_differences(table(spark, d, "embeddings"), "embedding", "label").select(F.round("pillai", 5).alias("pillai"), F.round("f", 4).alias("f"), F.round("p", 6).alias("p"), F.round("wilks", 6).alias("wilks"), "groups")


def q_niche_identity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_leaves")
    return M.niche_identity(e, "solidity", "leaf_zone", "leaf_row_id", "basal", "cauline").select(F.round("d", 6).alias("d"), F.round("i", 6).alias("i"), "p_d", "p_i", "times")


def q_phase_test(spark: SparkSession, d: str) -> DataFrame:
    return Y.phase_test(_dated(spark, d), "doy", "institutionCode", "voucher_id").select(F.round("f", 6).alias("f"), F.round("p", 6).alias("p"), "perm_p", "k", "n")


def q_seasonal_models(spark: SparkSession, d: str) -> DataFrame:
    out = Y.seasonal_models(_dated(spark, d), "doy", "decimalLatitude", "institutionCode")
    return out.select("institutionCode", "model", "k", "n", *[F.round(c, 3).alias(c) for c in ("slope", "kappa", "loglik", "aicc", "weight")], "best")


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
_DATED = "(SELECT *, dayofyear(make_date(year, month, day)) AS doy FROM vouchers WHERE year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL)"
_MEANS = f"(SELECT institutionCode AS g, atan2(sum(sin(2 * pi() * doy / 365.25)), sum(cos(2 * pi() * doy / 365.25))) AS m FROM {_DATED} WHERE institutionCode IS NOT NULL GROUP BY 1)"
_SEASON = f"(SELECT x.g AS a, y.g AS b, abs(atan2(sin(x.m - y.m), cos(x.m - y.m))) * 365.25 / (2 * pi()) AS days FROM {_MEANS} x JOIN {_MEANS} y ON x.g < y.g)"
_LAT = "(SELECT institutionCode AS g, decimalLatitude AS v FROM vouchers WHERE institutionCode IS NOT NULL AND decimalLatitude IS NOT NULL)"
_BINS = f"(SELECT g, bin, count(*) / sum(count(*)) OVER (PARTITION BY g) AS p FROM (SELECT g, least(19, floor((v - (SELECT min(v) FROM {_LAT})) / ((SELECT max(v) FROM {_LAT}) - (SELECT min(v) FROM {_LAT})) * 20)) AS bin FROM {_LAT}) GROUP BY 1, 2)"
_JOINT = f"""(SELECT a, b, round((0.75 * s + coalesce(sqrt(s) * i, 0) + sqrt(s) * t) / (0.75 + CASE WHEN i IS NOT NULL THEN sqrt(s) ELSE 0 END + sqrt(s)), 6) AS affinity FROM (SELECT a, b, least(1, s) AS s, CASE WHEN i > 0.5 THEN least(1, i) END AS i, exp(-days * days / 882) AS t
 FROM {_SEASON} JOIN (SELECT x.g AS a, y.g AS b, sum(least(x.p, y.p)) AS s, sum(sqrt(x.p * y.p)) AS i FROM {_BINS} x JOIN {_BINS} y ON x.bin = y.bin AND x.g < y.g GROUP BY 1, 2) USING (a, b)))"""
SQL = {
    "pool_cap": """WITH v AS (SELECT voucher_id, stateProvince AS g, (length(locality) % 9 + 1)::double AS w, coalesce(lower(determiner_tier) LIKE '%gold%', false) AS t, coalesce(lower(determiner_tier) LIKE '%silver%', false) AS s, type_status IS NOT NULL AS p FROM vouchers),
 k AS (SELECT g, 0.4 / (1 - 0.4) * sum(w) FILTER (t) / sum(w) FILTER (s AND NOT t) AS f, min(w) FILTER (s AND NOT t) AS m FROM v WHERE g IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (t) >= 5 AND sum(w) FILTER (t) > 0 AND sum(w) FILTER (s AND NOT t) > 0.4 / (1 - 0.4) * sum(w) FILTER (t) + 1e-12)
 SELECT voucher_id, round(CASE WHEN f IS NULL THEN w WHEN p THEN least(CASE WHEN s AND NOT t THEN w * f ELSE w END, 0.85 * m * f) WHEN s AND NOT t THEN w * f ELSE w END, 6) AS capped_weight, (f IS NOT NULL AND ((s AND NOT t) OR p))::int AS capped FROM v LEFT JOIN k USING (g)""",
    "habitat_indices": """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity::double AS q, l_linenumber AS x FROM lineitem), s AS (SELECT median(abs(q * 11)) AS m FROM q), r AS (SELECT *, greatest(0, least(1, (150 - CASE WHEN x % 2 = 0 THEN least(q * 4, q * 3) ELSE q * 4 END) / 135.0)) ** 1.35 AS sh, CASE WHEN x % 3 = 0 THEN greatest(0, least(1, q / 35.0)) ELSE 0 END AS ro, CASE WHEN x = 1 AND q > 25 THEN 1.0 ELSE 0.0 END AS fl,
 CASE WHEN x = 5 THEN q * 5 / 3.0 WHEN x <> 4 THEN q * 2 END AS dry FROM q)
 SELECT l_orderkey, l_linenumber, round(least(1, greatest(sh, 0.75 * ro + 0.25 * sh, 0.65 * fl + 0.35 * sh))::double, 4) AS lithic_index, CASE WHEN dry IS NOT NULL THEN round((greatest(4, 2.5 * greatest(0, q - 10)) / greatest(dry + 10, 5))::double, 4) END AS moisture_deficit,
 round(((q - 30 + 20) / greatest(CASE WHEN (SELECT m FROM s) > 50 THEN q * 11 / 100 ELSE q * 11 END * CASE WHEN x % 2 = 1 THEN greatest(4, q / 3) / 12.0 ELSE 1 END, 1))::double, 4) AS maritime_index FROM r""",
    "season_affinity": f"SELECT a, b, round(days, 4) AS days, round(exp(-days * days / 882), 6) AS affinity FROM {_SEASON}",
    "joint_affinity": f"SELECT a, b, affinity FROM {_JOINT}",
    "nearest_groups": f"""SELECT "group", rank, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY affinity DESC, neighbour)::int AS rank FROM (SELECT a AS "group", b AS neighbour, affinity FROM {_JOINT} UNION ALL SELECT b, a, affinity FROM {_JOINT})) WHERE rank <= 2""",
    "supported_labels": "SELECT institutionCode || ' | ' || stateProvince AS label, count(*) AS n FROM vouchers WHERE institutionCode IS NOT NULL AND stateProvince IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "clade_discordance": """WITH s AS (SELECT DISTINCT genetic_sample_id, project_id, taxon_raw FROM genomic_samples), c AS (SELECT project_id, taxon_raw, count(*) AS n FROM s WHERE project_id IS NOT NULL AND taxon_raw IS NOT NULL GROUP BY 1, 2), t AS (SELECT project_id, taxon_raw AS majority, n AS m FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, taxon_raw) = 1)
 SELECT DISTINCT genetic_sample_id, s.project_id, s.taxon_raw, majority, coalesce(majority <> s.taxon_raw AND n < m, false)::int AS discordant FROM s LEFT JOIN c ON c.project_id = s.project_id AND c.taxon_raw = s.taxon_raw LEFT JOIN t ON t.project_id = s.project_id""",
    "locus_lookup": """WITH l AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ':' || p_partkey WHEN 2 THEN p_brand || '_pos' || p_partkey ELSE 'x' || p_brand END AS locus, CASE WHEN p_partkey % 4 < 3 THEN p_brand END AS b FROM part), c AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1)
 SELECT locus, (n IS NOT NULL)::int AS listed, n FROM l LEFT JOIN c USING (b)""",
    "covered_view": """WITH c AS (SELECT DISTINCT catalogNumber FROM extracted_leaves WHERE catalogNumber IS NOT NULL), h AS (SELECT count(*) FILTER (catalogNumber IN (SELECT catalogNumber FROM vouchers WHERE catalogNumber IS NOT NULL))::double / count(*) AS s FROM c)
 SELECT count(*) AS n_rows, round((SELECT s FROM h), 8) AS share, ((SELECT s FROM h) >= 0.95)::int AS enough FROM vouchers WHERE catalogNumber IN (SELECT catalogNumber FROM c)""",
    "underscore_label": "SELECT locality, CASE WHEN lower(trim(locality)) NOT IN ('', 'na', 'nan', 'none', 'null', 'unknown', 'other_us', 'unassigned_na') THEN nullif(trim(regexp_replace(trim(locality), '[^A-Za-z0-9]+', '_', 'g'), '_'), '') END AS label FROM (SELECT DISTINCT locality FROM vouchers)",
    "bare_sample": "SELECT DISTINCT genetic_sample_id, genetic_sample_id AS bare FROM genomic_samples WHERE genetic_sample_id IS NOT NULL",
    "lat_lon": "SELECT voucher_id, CASE WHEN ok THEN y END AS lat, CASE WHEN ok THEN x END AS lon FROM (SELECT voucher_id, round(decimalLatitude, 3) AS y, round(decimalLongitude, 3) AS x, abs(round(decimalLatitude, 3)) <= 90 AND abs(round(decimalLongitude, 3)) <= 180 AS ok FROM vouchers WHERE abs(decimalLatitude) > 0.01 AND abs(decimalLongitude) > 0.01)",
}
