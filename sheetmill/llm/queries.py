"""The problems tagged llm over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from .canonical import map_kinds
from .leakage import clean_text, leaked_passages, leaks
from .linkage import link_samples, read_sources
from .names import link_names, name_pairs
from .packing import fill_containers
from .shared_spans import merged_intervals, shared_intervals, shared_share
from .survivors import gathering_key, surviving_records, tier_rank

FILLED = ("identifiedBy", "type_status", "county", "locality", "decimalLatitude", "decimalLongitude", "coordinateUncertainty", "image_path")


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vouchers").select(F.explode(F.array("recordedBy", "identifiedBy")).alias("name"))
    return rows.filter(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(link_names(_spellings(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vouchers")
    return surviving_records(rows, gathering_key(F.col("exsiccatae_key")), "catalogNumber", tier_rank(F.col("determiner_tier")), FILLED, "updated_at", "first_catalog_number", "survivor_catalog_number")


P2_FOUND_SQL = """
WITH k AS (
  SELECT *, lower(trim(replace(exsiccatae_key, '|', '_'))) AS t FROM vouchers WHERE exsiccatae_key IS NOT NULL AND trim(exsiccatae_key) <> ''),
g AS (
  SELECT *, regexp_replace(t, '\\d{4}-\\d{1,2}-\\d{1,2}$', '') || CASE WHEN regexp_matches(t, '\\d{4}-\\d{1,2}-\\d{1,2}$')
      THEN regexp_extract(t, '(\\d{4})-(\\d{1,2})-(\\d{1,2})$', 1) || '-' || lpad(regexp_extract(t, '(\\d{4})-(\\d{1,2})-(\\d{1,2})$', 2), 2, '0') || '-' || lpad(regexp_extract(t, '(\\d{4})-(\\d{1,2})-(\\d{1,2})$', 3), 2, '0')
      ELSE '' END AS gathering,
    CASE WHEN lower(determiner_tier) LIKE '%gold%' THEN 0 WHEN lower(determiner_tier) LIKE '%silver%' THEN 1 WHEN lower(determiner_tier) LIKE '%bronze%' THEN 2 ELSE 3 END AS trust,
    (coalesce(trim(identifiedBy), '') <> '')::int + (coalesce(trim(type_status), '') <> '')::int + (coalesce(trim(county), '') <> '')::int + (coalesce(trim(locality), '') <> '')::int
    + (decimalLatitude IS NOT NULL)::int + (decimalLongitude IS NOT NULL)::int + (coordinateUncertainty IS NOT NULL)::int + (coalesce(trim(image_path), '') <> '')::int AS filled
  FROM k)
SELECT min(catalogNumber) AS first_catalog_number,
  first(catalogNumber ORDER BY trust, filled DESC, updated_at DESC NULLS LAST, catalogNumber) AS survivor_catalog_number
FROM g GROUP BY gathering HAVING count(DISTINCT catalogNumber) > 1
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    vouchers = table(spark, d, "vouchers")
    taxa = table(spark, d, "taxon_synonyms")
    places = table(spark, d, "usda_county_ranges").filter(F.trim("county_norm") != "")
    listed = lambda df, entry, meant: df.select(F.col(entry).alias("entry"), F.col(meant).alias("meant"))
    lists = {"species_raw": (listed(taxa, "raw_name_lower", "canonical_packera"), "taxon"), "county": (listed(places, "county_norm", "county_norm"), "place")}
    typed = vouchers.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in lists])).alias("v")).select("v.*").filter(F.trim("value") != "").distinct()
    known = reduce(DataFrame.unionByName, [df.select(F.lit(f).alias("field"), F.col("entry").alias("key")) for f, (df, _) in lists.items()]).distinct()
    open_values = typed.withColumn("key", F.lower(F.trim("value"))).join(known, ["field", "key"], "left_anti").select("field", "value")
    return map_kinds(open_values, lists).select(F.col("field").alias("field_name"), F.col("value").alias("raw_value"), "canonical_value")


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    zones = table(spark, d, "state_zones")
    names = zones.select(F.explode(F.array(F.lower("state_norm"), F.lower("state_abbrev"))).alias("state_key"), "state_norm", "zone_name").distinct()
    counties = table(spark, d, "usda_county_ranges").filter(F.trim("county_norm") != "").select("county_norm")
    sheets, samples = read_sources(table(spark, d, "vouchers"), table(spark, d, "genomic_samples"), names)
    return link_samples(samples, sheets, counties, table(spark, d, "taxon_synonyms")), sheets


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links, sheets = _links(spark, d)
    return links.join(sheets.select("gathering", "catalogNumber"), "gathering").select(F.col("sample").alias("genetic_sample_id"), F.col("catalogNumber").alias("catalog_number")).distinct()


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)[0].select(F.col("sample").alias("genetic_sample_id"), "gathering", "rule", F.round("confidence", 6).alias("confidence"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaked words, without those; null where these are more than half of a document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return clean_text(docs, leaked_passages(docs, table(spark, d, "eval_items"))).filter("leaked_words > 0").select("doc_id", "leaked_words", "clean_text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return shared_share(docs, length="n_chars").select("doc_id", "shared_tenths")


def p10_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The maximal stretches to remove: characters start to stop of a document that occur in another."""
    return merged_intervals(shared_intervals(table(spark, d, "documents").select("doc_id", "text")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_links": p5_links, "p8_containers": p8_containers, "p9_found": p9_found, "p9_passages": p9_passages, "p9_clean": p9_clean, "p10_found": p10_found, "p10_intervals": p10_intervals}
_GRAMS = """SELECT DISTINCT {i}, unnest(list_transform(range(1, len(w) - 18), lambda k: array_to_string(w[k:k + 19], ' '))) AS gram
  FROM (SELECT {i}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {t})"""
P9_FOUND_SQL = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(i='doc_id', t='documents')}) JOIN ({_GRAMS.format(i='item_id', t='eval_items')}) USING (gram)"
P10_FOUND_SQL = """
WITH w AS (SELECT doc_id, n_chars, unnest(list_transform(range(1, length(text) - 198), lambda i: {'i': i, 'h': hash(substr(text, i, 200))})) AS s FROM documents WHERE length(text) >= 200),
k AS (SELECT s.h AS h FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, n_chars, s.i AS i, lead(s.i) OVER (PARTITION BY doc_id ORDER BY s.i) AS nx FROM w WHERE s.h IN (SELECT h FROM k))
SELECT doc_id, least(10, floor(10 * sum(least(200, coalesce(nx - i, 200))) / n_chars))::int AS shared_tenths FROM m GROUP BY doc_id, n_chars
"""
P10_INTERVALS_SQL = """
WITH w AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: {'i': i, 'h': hash(substr(text, i, 200))})) AS s FROM documents WHERE length(text) >= 200),
k AS (SELECT s.h AS h FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s.i AS i, coalesce(s.i - lag(s.i) OVER (PARTITION BY doc_id ORDER BY s.i) > 200, true)::int AS fresh FROM w WHERE s.h IN (SELECT h FROM k)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, (min(i) - 1)::int AS start, (max(i) + 199)::int AS stop FROM n GROUP BY doc_id, island
"""
SQL = {"p2_found": P2_FOUND_SQL, "p9_found": P9_FOUND_SQL, "p10_found": P10_FOUND_SQL, "p10_intervals": P10_INTERVALS_SQL}
