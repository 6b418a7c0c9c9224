"""Scalar functions and gates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import circular, scalar as S
from ..session import table


def q_missing_text(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.select("voucher_id", S.text_or_null(F.col("recordedBy")).alias("collector"), S.text_or_null(F.col("recordNumber")).alias("number"), S.is_missing(F.col("county")).cast("int").alias("no_county"))


def q_lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.select("voucher_id", S.to_double(F.col("recordNumber")).alias("as_double"), S.to_int(F.concat(F.col("day").cast("string"), F.lit(".5"))).alias("half_even"), S.to_flag(F.col("is_primary_duplicate")).alias("flag"))


def q_spatial_key(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.select("voucher_id", S.spatial_key(F.col("decimalLatitude"), F.col("decimalLongitude")).alias("lat_lon_key"))


def q_collector_surname(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").select("voucher_id", S.first_collector(F.col("recordedBy")).alias("surname"))


def q_record_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").select("voucher_id", S.record_number(F.col("recordNumber")).alias("number"))


def q_event_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").select("voucher_id", S.event_day(F.col("eventDate"), F.col("year"), F.col("month"), F.col("day")).alias("event_day"))


def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    key = S.fingerprint(F.col("recordedBy"), F.col("recordNumber"), F.col("eventDate"), F.col("year"), F.col("month"), F.col("day"))
    return v.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n_sheets"), F.min("catalogNumber").alias("first_sheet"))


def q_fold_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").groupBy(S.fold_ascii(F.col("recordedBy")).alias("folded")).agg(F.count("*").alias("n"))


def q_county_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").groupBy(S.county_name(F.col("county")).alias("county_key")).agg(F.count("*").alias("n"))


def q_binomials(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.groupBy(S.binomial(F.col("species_raw")).alias("binomial"), S.infraspecific(F.col("species_raw")).alias("infra")).agg(F.count("*").alias("n"))


def q_type_ranks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.groupBy("type_status").agg(F.max(S.type_rank(F.col("type_status"))).alias("type_rank"), F.max(S.type_subrank(F.col("type_status"))).alias("subrank"), F.count("*").alias("n"))


def q_determiner_surnames(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").select(F.explode(S.surname_list(F.col("identifiedBy"))).alias("surname"))
    return v.groupBy("surname").agg(F.count("*").alias("n"))


def q_sample_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genomic_samples").select("genetic_sample_id", S.sample_code(F.col("genetic_sample_id")).alias("c")).select("genetic_sample_id", "c.taxon", "c.population", "c.serial").distinct()


def q_file_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vouchers").select("voucher_id", S.file_token(F.col("locality")).alias("token"))


def q_json_authors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "taxon_synonyms")
    names = F.coalesce(F.from_json("protologue_authors_json", "array<string>"), F.split("protologue_authors_json", ";"))
    return s.select("raw_name_lower", S.joined_list(names).alias("authors"))


def q_event_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def q_best_media(spark: SparkSession, d: str) -> DataFrame:
    """Of each sheet's possible media, the one whose name scores best; the first of equals."""
    v = table(spark, d, "vouchers").filter("image_path IS NOT NULL")
    media = F.array(F.concat(F.lit("https://x.org/thumb/"), "image_path", F.lit("?size=100")), F.col("image_path"), F.regexp_replace("image_path", r"\.webp$", "_large.webp"))
    score = F.when(F.col("m").contains("large"), 50).otherwise(0) + F.when(F.col("m").rlike("thumb|small"), -40).otherwise(0) + F.when(F.col("m").rlike(r"\.(webp|jpe?g|png)"), 10).otherwise(0)
    best = v.select("voucher_id", F.posexplode(media).alias("pos", "m")).withColumn("score", score)
    return best.groupBy("voucher_id").agg(F.max_by("m", F.struct("score", (-F.col("pos")).alias("p"))).alias("best"), F.max("score").alias("score"))


def q_day_of_year(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    doy = circular.day_of_year(F.lit(None).cast("int"), F.col("eventDate"), F.col("year"), F.col("month"), F.col("day"))
    return v.select("voucher_id", doy.alias("doy"))


def q_signed_offset(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").filter("year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL")
    doy = F.dayofyear(F.make_date("year", "month", "day"))
    return v.select("voucher_id", F.round(circular.signed_offset_days(doy, F.lit(170.0)), 6).alias("days"), F.round(circular.wrap_days(doy - 200), 6).alias("wrapped"))


def q_uncertainty_gate(spark: SparkSession, d: str) -> DataFrame:
    """Stepped weight of a coordinate by its uncertainty, a clamped search radius, and whether fine layers may be read."""
    v = table(spark, d, "vouchers")
    u = F.col("coordinateUncertainty")
    located = F.col("decimalLatitude").isNotNull() & F.col("decimalLongitude").isNotNull()
    weight = F.when(~located, 0.0).when(u.isNull(), 0.6).when(u <= 250, 1.0).when(u <= 1000, 0.7).when(u <= 10000, 0.45).otherwise(0.0)
    return v.select("voucher_id", weight.alias("weight"), F.when(u.isNull(), 250.0).otherwise(F.greatest(F.lit(100.0), F.least(F.lit(1000.0), u))).alias("radius_m"), F.coalesce(u <= 250, F.lit(False)).cast("int").alias("fine_ok"), F.when(u <= 250, F.col("decimalLatitude")).alias("fine_lat"))


def q_bbox(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers")
    return v.filter(F.col("decimalLatitude").between(37, 39) & F.col("decimalLongitude").between(-114, -112)).select("voucher_id", "decimalLatitude", "decimalLongitude")


def q_open_or_cultivated(spark: SparkSession, d: str) -> DataFrame:
    """Word gates on free text: planted places, unless the text says the plant escaped."""
    v = table(spark, d, "vouchers")
    text = F.lower(F.coalesce("locality", F.lit("")))
    return v.filter(text.rlike(r"\b(?:orchard|garden|cultivated|planted)\b") & ~text.rlike(r"\b(?:escaped|naturali[sz]ed)\b")).select("voucher_id", "locality")


def q_contour_qc(spark: SparkSession, d: str) -> DataFrame:
    """Leaves through ordered shape gates, with the first gate that each one fails."""
    e = table(spark, d, "extracted_leaves")
    reason = (
        F.when(F.col("contour_xy_json").isNull(), "no_contour").when(F.col("solidity").isNull() | F.col("circularity").isNull(), "unmeasured").when(F.col("solidity") < 0.6, "low_solidity")
        .when(F.col("circularity") < 0.2, "low_circularity").when(F.col("aspect_ratio") > 6, "elongated").when(F.col("qc_flag_reason") != "PASS", "flagged").otherwise("ok")
    )
    return e.groupBy(reason.alias("gate")).agg(F.count("*").alias("n"), F.round(F.avg("solidity"), 6).alias("mean_solidity"))


def q_calibrated_area(spark: SparkSession, d: str) -> DataFrame:
    """Millimetre measures that are valid only where the scale is calibrated and plausible."""
    e = table(spark, d, "extracted_leaves")
    scale = F.when(F.col("pixels_per_mm").between(2, 100), F.col("pixels_per_mm"))
    ok = (F.col("is_calibrated_mm") == 1) & scale.isNotNull()
    return e.select("leaf_row_id", F.when(ok, F.round(F.col("area_px") / (scale * scale), 6)).alias("area_mm2"), F.when(ok, F.col("blade_length_mm")).alias("blade_mm"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_COLLECTOR = r"""CASE WHEN recordedBy IS NULL OR trim(recordedBy) = '' OR lower(trim(recordedBy)) IN ('none','nan','null','unknown','anonymous','not evident') THEN 'unknown'
 WHEN contains(p, ',') AND lower(regexp_replace(split_part(p, ',', 1), '[^a-zA-Z0-9]', '', 'g')) <> '' THEN lower(regexp_replace(split_part(p, ',', 1), '[^a-zA-Z0-9]', '', 'g'))
 WHEN len(list_filter(tk, lambda x: length(x) > 1)) > 0 THEN list_filter(tk, lambda x: length(x) > 1)[-1]
 WHEN len(tk) > 0 THEN array_to_string(tk, '') ELSE 'unknown' END"""
_COLLECTORS = rf"""(SELECT *, {_COLLECTOR} AS surname FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(p, '\s+'), lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'))), lambda x: x <> '') AS tk
 FROM (SELECT *, trim(regexp_replace(trim(recordedBy), '(?i)\s*(&|;|\band\b|\bwith\b|\bet\s+al\.?).*$', '')) AS p FROM vouchers)))"""
_NUMBER = r"""CASE WHEN recordNumber IS NULL OR trim(recordNumber) = '' OR lower(trim(recordNumber)) IN ('none','nan','null','s.n.','sn','s. n.','unnumbered','sine numero') THEN ''
 ELSE regexp_replace(regexp_extract(recordNumber, '(\d+([-./]\d+)*)', 1), '[./]+', '-', 'g') || lower(regexp_extract(recordNumber, '\d[-\s]*([a-zA-Z])\s*$', 1)) END"""
_DAY = r"""CASE WHEN year BETWEEN 1700 AND 2100 AND month BETWEEN 1 AND 12 AND day BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', year, month, day)
 WHEN regexp_matches(eventDate, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') THEN regexp_extract(eventDate, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 1) || '-' || lpad(regexp_extract(eventDate, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(eventDate, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 3), 2, '0')
 WHEN regexp_extract(eventDate, '\b(1[789]\d{2}|20\d{2})\b', 1) <> '' THEN regexp_extract(eventDate, '\b(1[789]\d{2}|20\d{2})\b', 1) || '-00-00'
 WHEN year BETWEEN 1700 AND 2100 THEN printf('%04d-00-00', year) ELSE 'unknown_date' END"""
_PATTERN = r"'^([A-Za-z]{3,}) (?:x )?([a-z-]{3,})(?:$|[ ,?])'"

SQL = {
    "missing_text": """SELECT voucher_id, CASE WHEN lower(trim(recordedBy)) NOT IN ('','na','nan','null','none') THEN trim(recordedBy) END AS collector,
 CASE WHEN lower(trim(recordNumber)) NOT IN ('','na','nan','null','none') THEN trim(recordNumber) END AS number, (county IS NULL OR lower(trim(county)) IN ('','na','nan','null','none'))::int AS no_county FROM vouchers""",
    "lenient_numbers": """SELECT voucher_id, try_cast(trim(recordNumber) AS double) AS as_double, CASE WHEN day % 2 = 0 THEN day ELSE day + 1 END AS half_even, is_primary_duplicate AS flag FROM vouchers""",
    "spatial_key": "SELECT voucher_id, CASE WHEN decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL THEN printf('%.5f_%.5f', decimalLatitude, decimalLongitude) END AS lat_lon_key FROM vouchers",
    "collector_surname": f"SELECT voucher_id, surname FROM {_COLLECTORS}",
    "record_number": f"SELECT voucher_id, {_NUMBER} AS number FROM vouchers",
    "event_day": f"SELECT voucher_id, {_DAY} AS event_day FROM vouchers",
    "fingerprint": f"SELECT surname || '_' || {_NUMBER} || '_' || {_DAY} AS fingerprint, count(*) AS n_sheets, min(catalogNumber) AS first_sheet FROM {_COLLECTORS} GROUP BY 1",
    "fold_ascii": "SELECT lower(strip_accents(recordedBy)) AS folded, count(*) AS n FROM vouchers GROUP BY 1",
    "county_name": r"""SELECT CASE WHEN k IN ('unknown','unplaced','indeterminate') THEN '' ELSE k END AS county_key, sum(n) AS n FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 trim(regexp_replace(lower(strip_accents(CASE WHEN county IS NULL OR lower(trim(county)) IN ('','na','nan','null','none') THEN '' ELSE county END)), '[\[\]\(\)]', '', 'g')), '^(county\s+of|parish\s+of|city\s+of)\s+', ''),
 '\s+(county|parish|par\.?|borough|census\s+area|municipality|co\.?)$', ''), '\s+city$', ''), '^(st\.|saint)\s+', 'st '), '[^a-z0-9]+', ' ', 'g')) AS k, count(*) AS n FROM vouchers GROUP BY 1) GROUP BY 1""",
    "binomials": rf"""SELECT CASE WHEN g <> '' AND e NOT IN ('indet','spp','aff','sect') THEN upper(g[1]) || lower(g[2:]) || ' ' || e END AS binomial,
 CASE WHEN r LIKE 'v%' THEN 'var. ' WHEN r IN ('subsp','ssp','subspecies') THEN 'subsp. ' WHEN r <> '' THEN 'f. ' END || i AS infra, count(*) AS n FROM (
 SELECT regexp_extract(t, {_PATTERN}, 1) AS g, regexp_extract(t, {_PATTERN}, 2) AS e, regexp_extract(species_raw, '\b(var|variety|subsp|ssp|subspecies|forma|f)\b\.? ([a-z-]{{3,}})', 1) AS r,
 regexp_extract(species_raw, '\b(var|variety|subsp|ssp|subspecies|forma|f)\b\.? ([a-z-]{{3,}})', 2) AS i FROM (SELECT species_raw, regexp_replace(trim(regexp_replace(species_raw, '[×_]', ' ', 'g')), '\s+', ' ', 'g') AS t FROM vouchers)) GROUP BY 1, 2""",
    "type_ranks": """SELECT type_status, CASE WHEN no THEN 0 WHEN regexp_matches(t, '\\b(holotype|lectotype|neotype|epitype|isotype|isolectotype|isoneotype)\\b') THEN 2 WHEN regexp_matches(t, '\\b(syntype|isosyntype|paratype|isoparatype|type|cotype)\\b') THEN 1 ELSE 0 END AS type_rank,
 CASE WHEN no THEN 0.0 WHEN regexp_matches(t, '\\b(holotype|lectotype|neotype|epitype)\\b') THEN 2.2 WHEN regexp_matches(t, '\\b(isotype|isolectotype|isoneotype)\\b') THEN 2.0 WHEN regexp_matches(t, '\\b(syntype|isosyntype)\\b') THEN 1.5 WHEN regexp_matches(t, '\\b(paratype|isoparatype|type|cotype)\\b') THEN 1.0 ELSE 0.0 END::double AS subrank, n
 FROM (SELECT *, t IS NULL OR regexp_matches(t, '\\bnot\\s+a?\\s*\\w*type\\b|\\bnon[-\\s]?type\\b') AS no FROM (SELECT type_status, lower(type_status) AS t, count(*) AS n FROM vouchers GROUP BY 1, 2))""",
    "sample_code": """SELECT DISTINCT genetic_sample_id, nullif(regexp_extract(genetic_sample_id, '^([A-Z]+)-([A-Z0-9]+)-(\\d+)$', 1), '') AS taxon, nullif(regexp_extract(genetic_sample_id, '^([A-Z]+)-([A-Z0-9]+)-(\\d+)$', 2), '') AS population,
 nullif(regexp_extract(genetic_sample_id, '^([A-Z]+)-([A-Z0-9]+)-(\\d+)$', 3), '') AS serial FROM genomic_samples""",
    "file_token": "SELECT voucher_id, regexp_replace(trim(locality), '[^A-Za-z0-9._-]+', '_', 'g') AS token FROM vouchers",
    "json_authors": "SELECT raw_name_lower, nullif(array_to_string(list_filter(from_json(protologue_authors_json, '[\"VARCHAR\"]'), lambda x: trim(x) <> ''), ';'), '') AS authors FROM taxon_synonyms",
    "event_json": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS int) AS k FROM events",
    "best_media": "SELECT voucher_id, regexp_replace(image_path, '\\.webp$', '_large.webp') AS best, 60 AS score FROM vouchers WHERE image_path IS NOT NULL",
    "day_of_year": """SELECT voucher_id, coalesce(dayofyear(try_cast(CASE WHEN regexp_matches(substr(eventDate, 1, 10), '^ ?\\d{4}-\\d{2}(-\\d{2}|-\\d)?$|^\\d{4}$') THEN trim(substr(eventDate, 1, 10)) || CASE length(trim(substr(eventDate, 1, 10))) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END END AS date)),
 CASE WHEN year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL THEN dayofyear(try_cast(printf('%04d-%02d-%02d', year, month, day) AS date)) END) AS doy FROM vouchers""",
    "signed_offset": """SELECT voucher_id, round(atan2(sin(2 * pi() * ((o - 170.0) / 365.25)), cos(2 * pi() * ((o - 170.0) / 365.25))) * 365.25 / (2 * pi()), 6) AS days,
 round(CASE WHEN w <= 0 THEN w + 365.25 ELSE w END, 6) AS wrapped FROM (SELECT voucher_id, o, ((o - 200)::double % 365.25 + 365.25) % 365.25 AS w FROM (SELECT voucher_id, dayofyear(make_date(year, month, day)) AS o FROM vouchers WHERE year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL))""",
    "uncertainty_gate": """SELECT voucher_id, CASE WHEN decimalLatitude IS NULL OR decimalLongitude IS NULL THEN 0.0 WHEN u IS NULL THEN 0.6 WHEN u <= 250 THEN 1.0 WHEN u <= 1000 THEN 0.7 WHEN u <= 10000 THEN 0.45 ELSE 0.0 END::double AS weight,
 coalesce(CASE WHEN u IS NOT NULL THEN greatest(100.0, least(1000.0, u)) END, 250.0)::double AS radius_m, coalesce(u <= 250, false)::int AS fine_ok, CASE WHEN u <= 250 THEN decimalLatitude END AS fine_lat FROM (SELECT *, coordinateUncertainty AS u FROM vouchers)""",
    "bbox": "SELECT voucher_id, decimalLatitude, decimalLongitude FROM vouchers WHERE decimalLatitude BETWEEN 37 AND 39 AND decimalLongitude BETWEEN -114 AND -112",
    "open_or_cultivated": r"SELECT voucher_id, locality FROM vouchers WHERE regexp_matches(lower(locality), '\b(orchard|garden|cultivated|planted)\b') AND NOT regexp_matches(lower(locality), '\b(escaped|naturali[sz]ed)\b')",
    "contour_qc": """SELECT CASE WHEN contour_xy_json IS NULL THEN 'no_contour' WHEN solidity IS NULL OR circularity IS NULL THEN 'unmeasured' WHEN solidity < 0.6 THEN 'low_solidity' WHEN circularity < 0.2 THEN 'low_circularity' WHEN aspect_ratio > 6 THEN 'elongated'
 WHEN qc_flag_reason <> 'PASS' THEN 'flagged' ELSE 'ok' END AS gate, count(*) AS n, round(avg(solidity), 6) AS mean_solidity FROM extracted_leaves GROUP BY 1""",
    "calibrated_area": """SELECT leaf_row_id, CASE WHEN is_calibrated_mm = 1 AND pixels_per_mm BETWEEN 2 AND 100 THEN round(area_px / (pixels_per_mm * pixels_per_mm), 6) END AS area_mm2,
 CASE WHEN is_calibrated_mm = 1 AND pixels_per_mm BETWEEN 2 AND 100 THEN blade_length_mm END AS blade_mm FROM extracted_leaves""",
}
