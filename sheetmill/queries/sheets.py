"""Hygiene, ranges, duplicates and habitat over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cytology as Y, habitat as H, scalar as S
from ..operators import duplicates as D, gates as E
from ..session import table


def _located(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").filter("decimalLatitude BETWEEN -90 AND 90 AND decimalLongitude BETWEEN -180 AND 180")


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return table(spark, d, "county_outlines").select("fips_code", mean("ring_lat").alias("cy"), mean("ring_lon").alias("cx"))


def q_near_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of coarse or unknown uncertainty whose point lies within 750 m of a county's middle."""
    v = _located(spark, d).filter("coordinateUncertainty IS NULL OR coordinateUncertainty >= 2000")
    out = E.near_reference(v, _centroids(spark, d), "voucher_id", "decimalLatitude", "decimalLongitude", "cy", "cx", "fips_code", 750.0)
    return out.select("voucher_id", "fips_code", F.round("metres", 3).alias("metres"))


def q_coordinate_hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates on a coarse grid, on zero or on a spot that many counties share, counted."""
    v = _located(spark, d)
    shared = v.groupBy("decimalLatitude", "decimalLongitude").agg(F.countDistinct(S.county_name(F.col("county"))).alias("n_counties"), F.count("*").alias("n"))
    j = v.join(shared, ["decimalLatitude", "decimalLongitude"])
    coarse = E.rounded_to(F.col("decimalLatitude"), 1) & E.rounded_to(F.col("decimalLongitude"), 1)
    reason = F.when((F.col("decimalLatitude") == 0) & (F.col("decimalLongitude") == 0), "zero").when((F.col("n") >= 5) & (F.col("n_counties") >= 4), "shared_spot").when(coarse, "coarse_grid").otherwise("ok")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def q_words_only(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.groupBy(E.only_words(F.col("county"), F.col("locality"), F.col("stateProvince"), F.lit("co county saint mount"), F.regexp_replace("county", "(?i) (county|co).*", "")).alias("only")).agg(F.count("*").alias("n"))


def q_adjacent_counties(spark: SparkSession, d: str) -> DataFrame:
    return E.adjacent_regions(table(spark, d, "county_outlines"), "state_norm", "county_norm", "ring_lat", "ring_lon")


def q_range_status(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    zones = table(spark, d, "state_zones")
    names = zones.select(F.explode(F.array(F.lower("state_norm"), F.lower("state_abbrev"))).alias("k"), "state_norm").distinct()
    rows = v.select("voucher_id", F.lower(F.trim("species_raw")).alias("name"), F.lower(F.trim("stateProvince")).alias("k"), F.lower(F.trim("county")).alias("county")).join(names, "k", "left").withColumnRenamed("state_norm", "state")
    rows = rows.join(table(spark, d, "taxon_synonyms").select(F.col("raw_name_lower").alias("name"), F.col("canonical_packera").alias("taxon")), "name", "left")
    ranges = table(spark, d, "usda_county_ranges").select(F.col("canonical_packera").alias("taxon"), F.col("state_norm").alias("state"), F.col("county_norm").alias("county"))
    out = E.range_status(rows, ranges, q_adjacent_counties(spark, d), "taxon", "state", "county")
    return out.groupBy("range_status").agg(F.count("*").alias("n"))


def q_resident_taxa(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").withColumn("taxon", S.binomial(F.col("species_raw")))
    return E.resident_taxa(v, "taxon", F.col("decimalLongitude") > -113)


def q_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    g = D.group_sheets(D.sheet_fingerprints(table(spark, d, "vouchers")))
    return g.groupBy("dup_group").agg(F.count("*").alias("n"), F.min("catalogNumber").alias("first"))


def q_primary_duplicates(spark: SparkSession, d: str) -> DataFrame:
    s = D.sheet_fingerprints(table(spark, d, "vouchers")).withColumn("key", F.concat_ws("_", "collector", "number", "day")).withColumn("taxon", S.binomial(F.col("species_raw")))
    tier = F.when(F.lower("determiner_tier").contains("gold"), 3).when(F.lower("determiner_tier").contains("silver"), 2).otherwise(1)
    rank = [S.type_rank(F.col("type_status")), S.type_subrank(F.col("type_status")), tier, (F.col("institutionCode") == "TVH").cast("int"), F.col("image_path").isNotNull().cast("int")]
    return D.primary_and_conflicts(s.filter("number <> '' AND collector <> 'unknown' AND day <> 'unknown_date'"), "key", rank, "taxon", tier == 3, F.col("lon") < -114, "catalogNumber")


def q_texture(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 60).cast("double").alias("sand"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 31).cast("double").alias("clay"))
    t = H.texture_log_ratios(F.col("sand"), F.col("clay"), F.when(F.col("p_partkey") % 5 == 0, F.lit(20.0)))
    return p.select("p_partkey", t["silt"].alias("silt"), t["ilr1"].alias("ilr1"), t["ilr2"].alias("ilr2"), F.round(H.rooting_zone_mean(F.col("sand"), F.col("clay")), 6).alias("zone"))


def q_slope_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Map units written from the parts' sizes."""
    size = F.col("p_size")
    unit = F.when(size % 6 == 0, F.format_string("Loam, %d to %d percent slopes", size, size + 7)).when(size % 6 == 1, "Stony loam, very steep").when(size % 6 == 2, "Steep land").when(size % 6 == 3, "Silt, nearly level").when(size % 6 == 4, "Rock outcrop").otherwise("Water")
    return table(spark, d, "part").select("p_partkey", H.slope_midpoint(unit).alias("slope"))


def q_heat_load(spark: SparkSession, d: str) -> DataFrame:
    v = _located(spark, d).filter("month IS NOT NULL AND day IS NOT NULL")
    return v.select("voucher_id", F.round(H.heat_load(F.col("decimalLatitude"), F.col("day").cast("double"), F.col("month") * 30.0), 6).alias("heat"))


def q_habitat_class(spark: SparkSession, d: str) -> DataFrame:
    """Localities by the first matching kind of ground."""
    classes = [("carbonate", "limestone|dolomite|marl"), ("ultramafic", "serpentin|peridotite"), ("volcanic", "lava|basalt|tuff"), ("granitic", "granite|gneiss"), ("shale", "shale|clay"), ("sand", "sand|gravel|talus"), ("wet", "meadow|seep|streambank|peat|snowmelt")]
    return table(spark, d, "vouchers").groupBy(H.keyword_class(F.col("locality"), classes, "other").alias("ground")).agg(F.count("*").alias("n"))


def q_chromosome_mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+ cells of plant \d+)"), F.lit(1))).alias("m"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("m").alias("first"))


def q_chromosome_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genomic_samples").select("genetic_sample_id", F.concat(F.lit("2n = "), (F.col("ploidy_level") * 23).cast("string")).alias("t")).distinct()
    c = g.withColumn("c", Y.count_records(F.col("t"))).withColumn("p", Y.ploidy(F.col("c.n2")))
    return c.select("genetic_sample_id", F.col("c.n").alias("n"), F.col("c.n2").alias("n2"), F.col("p.base").alias("base"), F.col("p.ploidy").alias("ploidy"), F.col("p.odd").alias("odd"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_LOC = "(SELECT * FROM vouchers WHERE decimalLatitude BETWEEN -90 AND 90 AND decimalLongitude BETWEEN -180 AND 180)"
_CORNER = "(SELECT DISTINCT state_norm AS state, county_norm AS county, round(y, 5) AS y, round(x, 5) AS x FROM (SELECT state_norm, county_norm, unnest(ring_lat) AS y, unnest(ring_lon) AS x FROM county_outlines))"
_ADJ = f"(SELECT DISTINCT a.state, a.county, b.state AS other_state, b.county AS other_county FROM {_CORNER} a JOIN {_CORNER} b ON a.y = b.y AND a.x = b.x AND NOT (a.state = b.state AND a.county = b.county))"
_COUNTY = r"""CASE WHEN k IN ('unknown','unplaced','indeterminate') THEN '' ELSE k END"""
_COUNTY_FROM = r"""(SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(CASE WHEN county IS NULL OR lower(trim(county)) IN ('','na','nan','null','none') THEN '' ELSE county END)), '[\[\]\(\)]', '', 'g')), '^(county\s+of|parish\s+of|city\s+of)\s+', ''),
 '\s+(county|parish|par\.?|borough|census\s+area|municipality|co\.?)$', ''), '\s+city$', ''), '^(st\.|saint)\s+', 'st '), '[^a-z0-9]+', ' ', 'g')) AS k FROM vouchers WHERE decimalLatitude BETWEEN -90 AND 90 AND decimalLongitude BETWEEN -180 AND 180)"""
SQL = {
    "coordinate_hygiene": f"""SELECT CASE WHEN decimalLatitude = 0 AND decimalLongitude = 0 THEN 'zero' WHEN n >= 5 AND c >= 4 THEN 'shared_spot' WHEN abs(decimalLatitude * 10 - round(decimalLatitude * 10)) < 1e-6 AND abs(decimalLongitude * 10 - round(decimalLongitude * 10)) < 1e-6 THEN 'coarse_grid' ELSE 'ok' END AS reason, count(*) AS n
 FROM {_COUNTY_FROM} JOIN (SELECT decimalLatitude, decimalLongitude, count(*) AS n, count(DISTINCT {_COUNTY}) AS c FROM {_COUNTY_FROM} GROUP BY 1, 2) USING (decimalLatitude, decimalLongitude) GROUP BY 1""",
    "near_centroid": f"""SELECT voucher_id, fips_code, round(m, 3) AS metres FROM (SELECT voucher_id, fips_code, 2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(cy - decimalLatitude) / 2), 2) + cos(radians(decimalLatitude)) * cos(radians(cy)) * pow(sin(radians(cx - decimalLongitude) / 2), 2)))) AS m
 FROM {_LOC} v, (SELECT fips_code, list_avg(ring_lat) AS cy, list_avg(ring_lon) AS cx FROM county_outlines) c WHERE (coordinateUncertainty IS NULL OR coordinateUncertainty >= 2000) AND abs(cy - decimalLatitude) < 0.01) WHERE m <= 750 QUALIFY row_number() OVER (PARTITION BY voucher_id ORDER BY m, fips_code) = 1""",
    "adjacent_counties": f"SELECT * FROM {_ADJ}",
    "range_status": f"""WITH r AS (SELECT v.voucher_id, z.state_norm AS state, lower(trim(v.county)) AS county, s.canonical_packera AS taxon FROM vouchers v LEFT JOIN (SELECT lower(state_norm) AS k, state_norm FROM state_zones UNION SELECT lower(state_abbrev), state_norm FROM state_zones) z ON z.k = lower(trim(v.stateProvince)) LEFT JOIN taxon_synonyms s ON s.raw_name_lower = lower(trim(v.species_raw))),
 u AS (SELECT canonical_packera AS taxon, state_norm AS state, county_norm AS county FROM usda_county_ranges), n AS (SELECT DISTINCT u.taxon, a.other_state AS state, a.other_county AS county FROM u JOIN {_ADJ} a ON a.state = u.state AND a.county = u.county WHERE u.county <> '')
 SELECT range_status, count(*) AS n FROM (SELECT CASE WHEN r.state IS NULL OR r.taxon IS NULL OR r.taxon NOT IN (SELECT taxon FROM u) THEN 'unknown' WHEN EXISTS (SELECT 1 FROM u WHERE u.taxon = r.taxon AND u.state = r.state) AND NOT EXISTS (SELECT 1 FROM u WHERE u.taxon = r.taxon AND u.state = r.state AND u.county <> '') THEN 'state_only'
 WHEN EXISTS (SELECT 1 FROM u WHERE u.taxon = r.taxon AND u.state = r.state AND u.county = r.county AND u.county <> '') THEN 'in_range' WHEN EXISTS (SELECT 1 FROM n WHERE n.taxon = r.taxon AND n.state = r.state AND n.county = r.county) THEN 'adjacent' WHEN EXISTS (SELECT 1 FROM u WHERE u.taxon = r.taxon AND u.state = r.state) THEN 'state' ELSE 'out' END AS range_status FROM r) GROUP BY 1""",
    "texture": """SELECT p_partkey, round(100 * t / (s + c + t), 2) AS silt, round(sqrt(2.0::double / 3) * ln((100 * s / (s + c + t)) / sqrt((100 * t / (s + c + t)) * (100 * c / (s + c + t)))), 4) AS ilr1, round(sqrt(0.5::double) * ln(t / c), 4) AS ilr2, round(z, 6) AS zone FROM (SELECT *, CASE WHEN clay IS NOT NULL THEN greatest(0.5, coalesce(silt, 100 - s - c)) END AS t
 FROM (SELECT *, CASE WHEN clay IS NOT NULL THEN greatest(0.5, sand) END AS s, CASE WHEN clay IS NOT NULL THEN greatest(0.5, clay) END AS c, CASE WHEN clay IS NOT NULL THEN (5 * sand + 10 * clay) / 15 ELSE sand END AS z
 FROM (SELECT p_partkey, (p_size % 60)::double AS sand, CASE WHEN p_size % 7 <> 0 THEN (p_size % 31)::double END AS clay, CASE WHEN p_partkey % 5 = 0 THEN 20.0::double END AS silt FROM part)))""",
    "slope_midpoint": """SELECT p_partkey, CASE WHEN u LIKE '%percent%' THEN p_size + 3.5 WHEN u LIKE '%very steep%' THEN 35.0 WHEN u LIKE '%steep%' THEN 18.0 WHEN u LIKE '%level%' THEN 1.0 WHEN u LIKE '%outcrop%' THEN 6.0 END::double AS slope FROM (SELECT p_partkey, p_size, lower(u) AS u FROM (SELECT p_partkey, p_size,
 CASE p_size % 6 WHEN 0 THEN 'Loam, ' || p_size || ' to ' || (p_size + 7) || ' percent slopes' WHEN 1 THEN 'Stony loam, very steep' WHEN 2 THEN 'Steep land' WHEN 3 THEN 'Silt, nearly level' WHEN 4 THEN 'Rock outcrop' ELSE 'Water' END AS u FROM part))""",
    "heat_load": f"""SELECT voucher_id, round(CASE WHEN day < 1e-4 THEN least(1.5, greatest(0.05, exp(-1.467 + 1.582 * cos(la)))) ELSE least(1.5, greatest(0.05, exp(-1.467 + 1.582 * cos(la) * cos(sl) - 1.5 * cos(f) * sin(sl) * sin(la) - 0.262 * sin(la) * sin(sl) + 0.607 * sin(f) * sin(sl)))) END, 6) AS heat
 FROM (SELECT voucher_id, day, radians(least(60, greatest(15, abs(decimalLatitude)))) AS la, radians(least(85, greatest(0, day::double))) AS sl, abs(pi() - abs(radians((month * 30.0)::double % 360) - radians(225))) AS f FROM {_LOC} WHERE month IS NOT NULL AND day IS NOT NULL)""",
    "habitat_class": "SELECT CASE WHEN regexp_matches(l, 'limestone|dolomite|marl') THEN 'carbonate' WHEN regexp_matches(l, 'serpentin|peridotite') THEN 'ultramafic' WHEN regexp_matches(l, 'lava|basalt|tuff') THEN 'volcanic' WHEN regexp_matches(l, 'granite|gneiss') THEN 'granitic' WHEN regexp_matches(l, 'shale|clay') THEN 'shale' WHEN regexp_matches(l, 'sand|gravel|talus') THEN 'sand' WHEN regexp_matches(l, 'meadow|seep|streambank|peat|snowmelt') THEN 'wet' ELSE 'other' END AS ground, count(*) AS n FROM (SELECT lower(locality) AS l FROM vouchers) GROUP BY 1",
    "chromosome_mentions": r"SELECT doc_id, len(m) AS n, list_min(m) AS first FROM (SELECT doc_id, regexp_extract_all(text, '(\d+ cells of plant \d+)', 1) AS m FROM documents) WHERE len(m) > 0",
    "chromosome_counts": "SELECT DISTINCT genetic_sample_id, CASE WHEN (ploidy_level * 23) % 2 = 0 THEN ploidy_level * 23 // 2 END AS n, ploidy_level * 23 AS n2, CASE WHEN ploidy_level IS NULL THEN NULL WHEN (ploidy_level * 23) % 22 = 0 THEN 22 ELSE 23 END AS base, CASE WHEN (ploidy_level * 23) % 22 = 0 THEN ploidy_level * 23 // 22 ELSE ploidy_level END AS ploidy, CASE WHEN (ploidy_level * 23) % 22 = 0 THEN (ploidy_level * 23 // 22) % 2 ELSE ploidy_level % 2 END AS odd FROM genomic_samples",
    "resident_taxa": rf"""SELECT taxon, n, n_inside FROM (SELECT CASE WHEN g <> '' AND e NOT IN ('indet','spp','aff','sect') THEN upper(g[1]) || lower(g[2:]) || ' ' || e END AS taxon, count(*) AS n, count(*) FILTER (decimalLongitude > -113) AS n_inside FROM (SELECT decimalLongitude, regexp_extract(t, '^([A-Za-z]{{3,}}) (?:x )?([a-z-]{{3,}})(?:$|[ ,?])', 1) AS g, regexp_extract(t, '^([A-Za-z]{{3,}}) (?:x )?([a-z-]{{3,}})(?:$|[ ,?])', 2) AS e FROM (SELECT decimalLongitude, regexp_replace(trim(regexp_replace(species_raw, '[×_]', ' ', 'g')), '\s+', ' ', 'g') AS t FROM vouchers)) GROUP BY 1)
 WHERE taxon IS NOT NULL AND n_inside >= CASE WHEN n < 50 THEN least(3, n) ELSE 10 END AND n_inside >= 0.05 * n""",
}
