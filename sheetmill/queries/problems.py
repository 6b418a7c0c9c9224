"""The general problems over the driver tables: points (3), timestamps (6), references (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.proximity import containing_region, near_pairs, usable_point
from ..operators.references import Reference, orphan_references, orphans_by_period
from ..operators.timestamps import normalise_timestamps, written_date
from ..session import cut, table


def _references(spark: SparkSession, d: str) -> list[Reference]:
    leaves = table(spark, d, "extracted_leaves").select("leaf_row_id", "catalogNumber", "plant_individual_id", "extracted_at")
    genes = table(spark, d, "genetic_lineage_assignments").select("assignment_id", "genetic_sample_id", "assigned_at")
    return [
        Reference("extracted_leaves", leaves, "leaf_row_id", ("catalogNumber",), "vouchers", table(spark, d, "vouchers"), ("catalogNumber",), "extracted_at"),
        Reference("extracted_leaves", leaves, "leaf_row_id", ("catalogNumber", "plant_individual_id"), "plant_individuals", table(spark, d, "plant_individuals"), ("catalogNumber", "plant_individual_id"), "extracted_at"),
        Reference("genetic_lineage_assignments", genes, "assignment_id", ("genetic_sample_id",), "genomic_samples", table(spark, d, "genomic_samples"), ("genetic_sample_id",), "assigned_at"),
    ]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d))


def p7_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_references(spark, d))


#: Setting that names a folder where the dictionary of timestamps is kept from run to run; unset, a run has its own.
DICTIONARY = "spark.sheetmill.timestampDictionary"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "state_zones")
    names = zones.select(F.explode(F.array(F.lower("state_norm"), F.lower("state_abbrev"))).alias("state"), "zone_name").distinct()
    rows = table(spark, d, "vouchers").select("voucher_id", "eventDate", "year", "month", "day", F.lower(F.trim("stateProvince")).alias("state"))
    blank = F.col("eventDate").isNull() | (F.trim("eventDate") == "")
    rows = rows.filter((blank & F.col("year").isNotNull()) | (~blank & ~written_date(F.col("eventDate")))).join(names, "state", "left")
    return normalise_timestamps(rows, "eventDate", "zone_name", "year", "month", "day", path=spark.conf.get(DICTIONARY, None)).select("voucher_id", "event_norm")


def _points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vouchers").select("voucher_id", "catalogNumber", "decimalLatitude", "decimalLongitude", "coordinateUncertainty")
    return rows.filter((F.col("coordinateUncertainty") <= 1000) & usable_point(F.col("decimalLatitude"), F.col("decimalLongitude")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(_points(spark, d), "voucher_id", "decimalLatitude", "decimalLongitude", 50.0, ("catalogNumber",))
    pairs = cut(pairs.filter(F.col("catalogNumber_a") != F.col("catalogNumber_b")).select("voucher_id_a", "voucher_id_b", "lat_a", "lon_a"))
    spots = pairs.select("voucher_id_a", "lat_a", "lon_a").distinct()
    counties = containing_region(spots, "voucher_id_a", "lat_a", "lon_a", table(spark, d, "county_outlines"), "fips_code", "ring_lat", "ring_lon")
    return pairs.join(counties, "voucher_id_a", "left").select("voucher_id_a", "voucher_id_b", F.coalesce("fips_code", F.lit("")).alias("fips_code"))


def p3_county_census(spark: SparkSession, d: str) -> DataFrame:
    """Usable sheets by the county that contains them."""
    spots = _points(spark, d)
    counties = containing_region(spots, "voucher_id", "decimalLatitude", "decimalLongitude", table(spark, d, "county_outlines"), "fips_code", "ring_lat", "ring_lon")
    return counties.groupBy("fips_code").agg(F.count("*").alias("n_sheets"))


_SPOTS_SQL = """SELECT voucher_id, catalogNumber, decimalLatitude AS lat, decimalLongitude AS lon FROM vouchers
WHERE coordinateUncertainty <= 1000 AND decimalLatitude BETWEEN -90 AND 90 AND decimalLongitude BETWEEN -180 AND 180 AND NOT (decimalLatitude = 0 AND decimalLongitude = 0)"""
_COUNTY_SQL = """SELECT voucher_id, min(fips_code) AS fips_code FROM (
  SELECT s.voucher_id, e.fips_code FROM s JOIN e ON (e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lon < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1"""
_WITH_SQL = f"""WITH s AS ({_SPOTS_SQL}), e AS (
  SELECT fips_code, ring_lat[i] AS y1, ring_lon[i] AS x1, ring_lat[i % len(ring_lat) + 1] AS y2, ring_lon[i % len(ring_lon) + 1] AS x2
  FROM (SELECT *, unnest(range(1, len(ring_lat) + 1)) AS i FROM county_outlines)), c AS ({_COUNTY_SQL})"""
P3_FOUND_SQL = _WITH_SQL + """
SELECT a.voucher_id AS voucher_id_a, b.voucher_id AS voucher_id_b, coalesce(c.fips_code, '') AS fips_code
FROM s a JOIN s b ON a.voucher_id < b.voucher_id AND a.catalogNumber <> b.catalogNumber AND abs(a.lat - b.lat) < 0.001
LEFT JOIN c ON c.voucher_id = a.voucher_id
WHERE 2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50
"""


P7_FOUND_SQL = """
SELECT 'extracted_leaves' AS source_table, leaf_row_id AS record_id, 'vouchers' AS target_table, strftime(extracted_at, '%Y-%m') AS period_month
FROM extracted_leaves e WHERE catalogNumber IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vouchers v WHERE v.catalogNumber = e.catalogNumber)
UNION ALL
SELECT 'extracted_leaves', leaf_row_id, 'plant_individuals', strftime(extracted_at, '%Y-%m')
FROM extracted_leaves e WHERE catalogNumber IS NOT NULL AND plant_individual_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM plant_individuals p WHERE p.catalogNumber = e.catalogNumber AND p.plant_individual_id = e.plant_individual_id)
UNION ALL
SELECT 'genetic_lineage_assignments', assignment_id, 'genomic_samples', strftime(assigned_at, '%Y-%m')
FROM genetic_lineage_assignments a WHERE genetic_sample_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM genomic_samples g WHERE g.genetic_sample_id = a.genetic_sample_id)
"""

QUERIES = {"p3_found": p3_found, "p3_county_census": p3_county_census, "p6_found": p6_found, "p7_found": p7_found, "p7_by_period": p7_by_period}
SQL = {
    "p3_found": P3_FOUND_SQL,
    "p3_county_census": _WITH_SQL + "SELECT fips_code, count(*) AS n_sheets FROM c GROUP BY 1",
    "p7_found": P7_FOUND_SQL,
    "p7_by_period": f"SELECT source_table, target_table, period_month, count(*) AS n_orphans FROM ({P7_FOUND_SQL}) GROUP BY ALL",
}
