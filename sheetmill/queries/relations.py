"""Upserts, joins and the wide view over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins as J, store as W
from ..plans.master import master_view
from ..session import table


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stored, and a delivery: the odd ones with a changed balance (null for every seventh), and new ones."""
    c = table(spark, d, "customer")
    old = c.filter(F.col("c_custkey") % 3 != 0)
    balance = F.when(F.col("c_custkey") % 7 != 0, F.round(F.col("c_acctbal") + 1, 2))
    new = c.filter(F.col("c_custkey") % 2 == 1).select("c_custkey", balance.alias("c_acctbal"), F.upper("c_mktsegment").alias("c_mktsegment"), F.lit("x").alias("unknown_column"))
    return old, new


def q_upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    return W.upsert(*_halves(spark, d), ["c_custkey"])


def q_upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return W.upsert(*_halves(spark, d), ["c_custkey"], preserve=False)


def q_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    return W.insert_missing(*_halves(spark, d), ["c_custkey"])


def q_last_per_sheet(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").select("catalogNumber", "voucher_id", "identifiedBy", "county", "updated_at")
    return W.last_per_key(v, ["catalogNumber"], [F.col("updated_at"), F.col("voucher_id")])


def q_last_known_per_sheet(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").select("catalogNumber", "voucher_id", "identifiedBy", "county", "updated_at")
    return W.last_per_key(v, ["catalogNumber"], [F.col("updated_at"), F.col("voucher_id")], per_column=True)


def q_replace_run(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "genetic_lineage_assignments").select("run_id", "assignment_id", "genetic_sample_id", "q_max")
    new = a.filter("run_id = 'run_alder' AND assignment_id % 2 = 0").withColumn("q_max", F.lit(0.5))
    return W.replace_run(a, new, "run_id")


def q_prune_run(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "genetic_lineage_assignments").select("run_id", "assignment_id", "q_max")
    return W.prune_run(a, a.filter("run_id IN ('run_alder', 'run_cedar') AND assignment_id % 3 <> 0"), "run_id", ["assignment_id"])


def q_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "vouchers").filter("institutionCode = 'TVH'").select("catalogNumber")
    plants, leaves = W.cascade_delete([(table(spark, d, "plant_individuals"), ["catalogNumber"]), (table(spark, d, "extracted_leaves"), ["catalogNumber"])], gone)
    count = lambda df, name: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
    return count(plants, "plant_individuals").unionByName(count(leaves, "extracted_leaves"))


def q_conform(spark: SparkSession, d: str) -> DataFrame:
    return W.conform(table(spark, d, "genomic_samples"), {"genetic_sample_id": "string", "ploidy_level": "string", "project_id": "int", "habitat": "string"}).groupBy("genetic_sample_id").agg(F.max("ploidy_level").alias("ploidy"), F.max("project_id").alias("project"), F.max("habitat").alias("habitat"))


def q_expand_cohort(spark: SparkSession, d: str) -> DataFrame:
    sheets = table(spark, d, "vouchers").select("catalogNumber", F.when(F.col("voucher_id") % 5 == 0, 3).alias("plant_individual_id")).distinct()
    return W.expand_cohort(sheets, table(spark, d, "plant_individuals"), "catalogNumber", "plant_individual_id")


def q_merge_registry(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "genetic_lineage_assignments")
    runs = lambda part, end: a.filter(part).groupBy("run_id").agg(F.min("assigned_at").alias("started_at"), F.max(end).alias("ended_at"), F.count("*").alias("n"))
    return W.merge_registry(runs("assignment_id % 2 = 0", F.col("assigned_at")), runs("assignment_id % 2 = 1", F.lit(None).cast("timestamp")), "run_id", ["started_at"])


def q_join_by_individual(spark: SparkSession, d: str) -> DataFrame:
    leaves = table(spark, d, "extracted_leaves").select("leaf_row_id", "catalogNumber", "plant_individual_id")
    return J.join_by_individual(leaves, table(spark, d, "plant_individuals"), "catalogNumber", "plant_individual_id", ["plant_height_mm"]).select("leaf_row_id", "plant_height_mm")


def q_exact_or_default(spark: SparkSession, d: str) -> DataFrame:
    leaves = table(spark, d, "extracted_leaves").select("leaf_row_id", "catalogNumber", "plant_individual_id")
    return J.exact_or_default(leaves, table(spark, d, "plant_individuals"), "catalogNumber", "plant_individual_id", ["plant_height_mm"]).select("leaf_row_id", "plant_height_mm")


def q_first_match(spark: SparkSession, d: str) -> DataFrame:
    """A taxon by its full name, else by its binomial, else by its genus."""
    v = table(spark, d, "vouchers").select("voucher_id", F.lower(F.trim("species_raw")).alias("full"))
    v = v.withColumns({"two": F.array_join(F.slice(F.split("full", " "), 1, 2), " "), "genus": F.split_part("full", F.lit(" "), F.lit(1))})
    s = table(spark, d, "taxon_synonyms").select("raw_name_lower", "canonical_packera")
    genera = s.groupBy(F.split_part("raw_name_lower", F.lit(" "), F.lit(1)).alias("genus")).agg(F.min("canonical_packera").alias("canonical_packera"))
    return J.first_match(v, [(s.withColumnRenamed("raw_name_lower", "full"), ["full"]), (s.withColumnRenamed("raw_name_lower", "two"), ["two"]), (genera, ["genus"])], ["canonical_packera"], "level").select("voucher_id", "level", "canonical_packera")


def q_join_and_append(spark: SparkSession, d: str) -> DataFrame:
    return J.join_and_append(*[x.select("c_custkey", "c_acctbal", "c_mktsegment") for x in _halves(spark, d)], ["c_custkey"])


def q_unanimous_propagation(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vouchers").select("voucher_id", "exsiccatae_key", "county")
    return J.unanimous_propagation(v.filter("county IS NULL"), v, "exsiccatae_key", "county").select("voucher_id", "county")


def q_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders but without an urgent one, and those without any."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    some = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")
    calm = some.join(o.filter("o_orderpriority = '1-URGENT'"), some["c_custkey"] == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("calm").alias("kind"))
    return calm.unionByName(c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", F.lit("none").alias("kind")))


def q_master_view(spark: SparkSession, d: str) -> DataFrame:
    cohort = q_expand_cohort(spark, d)
    out = master_view(cohort, *[table(spark, d, t) for t in ("vouchers", "plant_individuals", "extracted_leaves", "genomic_samples", "genetic_lineage_assignments")], columns=["species_raw", "county", "determiner_tier", "plant_height_mm", "n_leaves", "genetic_sample_id", "geno_predicted_taxon", "n_samples_linked"])
    return out


def q_order_master(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer, nation, their best line (returned first, then dearest) and how many lines they have."""
    o, c, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    order = [F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).asc(), F.col("l_extendedprice").desc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc(), F.col("l_quantity").asc(), F.col("l_discount").asc(), F.col("l_tax").asc(), F.col("l_shipdate").asc()]
    best = J.ranked_pick(li, ["l_orderkey"], order, "n_lines").select("l_orderkey", "l_returnflag", "l_extendedprice", "n_lines")
    out = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, F.col("c_nationkey") == n["n_nationkey"], "left").join(best, o["o_orderkey"] == best["l_orderkey"], "left")
    return out.select("o_orderkey", "c_name", "n_name", F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.round("l_extendedprice", 2).alias("price"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(F.col("l_orderkey").isNull(), "empty").when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"))


def q_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Counties with sheets, with ranges, with both, and requested but not excluded."""
    v = table(spark, d, "vouchers").select(F.lower(F.trim("county")).alias("k")).filter("k IS NOT NULL").distinct()
    r = table(spark, d, "usda_county_ranges").select(F.col("county_norm").alias("k")).distinct()
    name = lambda df, s: df.select("k", F.lit(s).alias("part"))
    return name(v.intersect(r), "both").unionByName(name(r.subtract(v), "range_only")).unionByName(name(v.subtract(r), "sheet_only"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_OLD = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal + 1, 2) END AS c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 1)"
_COHORT = """(SELECT DISTINCT catalogNumber, pid AS plant_individual_id FROM (SELECT catalogNumber, 3 AS pid FROM vouchers WHERE voucher_id % 5 = 0
 UNION ALL SELECT s.catalogNumber, coalesce(p.plant_individual_id, 0) FROM (SELECT DISTINCT catalogNumber FROM vouchers WHERE voucher_id % 5 <> 0) s LEFT JOIN plant_individuals p USING (catalogNumber)))"""
_LINE_ORDER = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate"
_SHEETS = "(SELECT DISTINCT lower(trim(county)) AS k FROM vouchers WHERE county IS NOT NULL)"
_RANGES = "(SELECT DISTINCT county_norm AS k FROM usda_county_ranges)"
_ASSIGN = "genetic_lineage_assignments"

SQL = {
    "upsert_preserve": f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_name, o.c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey",
    "upsert_overwrite": f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_name, o.c_nationkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey",
    "insert_missing": f"SELECT * FROM {_OLD} UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal, c_mktsegment FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.c_custkey = n.c_custkey)",
    "last_per_sheet": "SELECT catalogNumber, voucher_id, identifiedBy, county, updated_at FROM vouchers QUALIFY row_number() OVER (PARTITION BY catalogNumber ORDER BY updated_at DESC, voucher_id DESC) = 1",
    "last_known_per_sheet": "SELECT catalogNumber, last(voucher_id ORDER BY updated_at, voucher_id) AS voucher_id, last(identifiedBy ORDER BY updated_at, voucher_id) FILTER (identifiedBy IS NOT NULL) AS identifiedBy, last(county ORDER BY updated_at, voucher_id) FILTER (county IS NOT NULL) AS county, max(updated_at) AS updated_at FROM vouchers GROUP BY 1",
    "replace_run": f"SELECT run_id, assignment_id, genetic_sample_id, q_max FROM {_ASSIGN} WHERE run_id IS DISTINCT FROM 'run_alder' UNION ALL SELECT run_id, assignment_id, genetic_sample_id, 0.5 FROM {_ASSIGN} WHERE run_id = 'run_alder' AND assignment_id % 2 = 0",
    "prune_run": f"SELECT run_id, assignment_id, q_max FROM {_ASSIGN} WHERE run_id IS NULL OR run_id NOT IN ('run_alder', 'run_cedar') OR assignment_id % 3 <> 0",
    "cascade_delete": "SELECT 'plant_individuals' AS table_name, count(*) AS n FROM plant_individuals WHERE catalogNumber IS NULL OR catalogNumber NOT IN (SELECT catalogNumber FROM vouchers WHERE institutionCode = 'TVH') UNION ALL SELECT 'extracted_leaves', count(*) FROM extracted_leaves WHERE catalogNumber IS NULL OR catalogNumber NOT IN (SELECT catalogNumber FROM vouchers WHERE institutionCode = 'TVH')",
    "conform": "SELECT genetic_sample_id, max(ploidy_level::varchar) AS ploidy, max(try_cast(project_id AS int)) AS project, NULL::varchar AS habitat FROM genomic_samples GROUP BY 1",
    "expand_cohort": f"SELECT * FROM {_COHORT}",
    "merge_registry": f"SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.s, b.s) AS started_at, a.e AS ended_at, coalesce(b.n, a.n) AS n FROM (SELECT run_id, min(assigned_at) AS s, max(assigned_at) AS e, count(*) AS n FROM {_ASSIGN} WHERE assignment_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT run_id, min(assigned_at) AS s, count(*) AS n FROM {_ASSIGN} WHERE assignment_id % 2 = 1 GROUP BY 1) b ON a.run_id = b.run_id",
    "join_by_individual": "SELECT l.leaf_row_id, coalesce(x.plant_height_mm, s.plant_height_mm, o.h) AS plant_height_mm FROM extracted_leaves l LEFT JOIN plant_individuals x USING (catalogNumber, plant_individual_id) LEFT JOIN plant_individuals s ON s.catalogNumber = l.catalogNumber AND s.plant_individual_id = 0 LEFT JOIN (SELECT catalogNumber, first(plant_height_mm) AS h FROM plant_individuals GROUP BY 1 HAVING count(*) = 1) o ON o.catalogNumber = l.catalogNumber",
    "exact_or_default": "SELECT l.leaf_row_id, CASE WHEN x.catalogNumber IS NOT NULL THEN x.plant_height_mm ELSE s.plant_height_mm END AS plant_height_mm FROM extracted_leaves l LEFT JOIN plant_individuals x ON x.catalogNumber = l.catalogNumber AND x.plant_individual_id = l.plant_individual_id LEFT JOIN plant_individuals s ON s.catalogNumber = l.catalogNumber AND s.plant_individual_id = 0",
    "first_match": "SELECT v.voucher_id, CASE WHEN a.canonical_packera IS NOT NULL THEN 1 WHEN b.canonical_packera IS NOT NULL THEN 2 WHEN g.c IS NOT NULL THEN 3 END AS level, coalesce(a.canonical_packera, b.canonical_packera, g.c) AS canonical_packera FROM (SELECT voucher_id, f, array_to_string(string_split(f, ' ')[1:2], ' ') AS t, split_part(f, ' ', 1) AS g FROM (SELECT voucher_id, lower(trim(species_raw)) AS f FROM vouchers)) v LEFT JOIN taxon_synonyms a ON a.raw_name_lower = v.f LEFT JOIN taxon_synonyms b ON b.raw_name_lower = v.t LEFT JOIN (SELECT split_part(raw_name_lower, ' ', 1) AS g, min(canonical_packera) AS c FROM taxon_synonyms GROUP BY 1) g ON g.g = v.g",
    "join_and_append": f"SELECT o.c_custkey, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM {_OLD} o LEFT JOIN {_NEW} n USING (c_custkey) UNION ALL SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.c_custkey = n.c_custkey)",
    "unanimous_propagation": "SELECT v.voucher_id, a.county FROM vouchers v LEFT JOIN (SELECT exsiccatae_key, min(county) AS county FROM vouchers WHERE county IS NOT NULL AND exsiccatae_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT county) = 1) a ON a.exsiccatae_key = v.exsiccatae_key WHERE v.county IS NULL",
    "semi_anti": "SELECT c_custkey, 'calm' AS kind FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "master_view": f"""SELECT c.catalogNumber, c.plant_individual_id, v.species_raw, v.county, v.determiner_tier, CASE WHEN i.catalogNumber IS NOT NULL THEN i.plant_height_mm ELSE i0.plant_height_mm END AS plant_height_mm, l.n_leaves, g.genetic_sample_id, g.geno_predicted_taxon, g.n_samples_linked
 FROM {_COHORT} c LEFT JOIN (SELECT * FROM vouchers QUALIFY row_number() OVER (PARTITION BY catalogNumber ORDER BY updated_at DESC, voucher_id DESC) = 1) v USING (catalogNumber)
 LEFT JOIN plant_individuals i ON i.catalogNumber = c.catalogNumber AND i.plant_individual_id = c.plant_individual_id LEFT JOIN plant_individuals i0 ON i0.catalogNumber = c.catalogNumber AND i0.plant_individual_id = 0
 LEFT JOIN (SELECT catalogNumber, plant_individual_id, count(DISTINCT coalesce(leaf_id, -1)) AS n_leaves FROM extracted_leaves GROUP BY 1, 2) l ON l.catalogNumber = c.catalogNumber AND l.plant_individual_id = c.plant_individual_id
 LEFT JOIN (SELECT s.catalogNumber, a.genetic_sample_id, a.geno_predicted_taxon, count(*) OVER (PARTITION BY s.catalogNumber) AS n_samples_linked FROM {_ASSIGN} a JOIN (SELECT genetic_sample_id, any_value(catalogNumber) AS catalogNumber, any_value(mapped_reads) AS mapped_reads, any_value(missing_genotype_rate) AS missing_genotype_rate FROM genomic_samples WHERE catalogNumber IS NOT NULL GROUP BY 1) s USING (genetic_sample_id)
  QUALIFY row_number() OVER (PARTITION BY s.catalogNumber ORDER BY (coalesce(missing_genotype_rate, 1) <= 0.3) DESC, coalesce(mapped_reads, 0) DESC, coalesce(geno_posterior_prob, -1) DESC, a.genetic_sample_id, assignment_id) = 1) g ON g.catalogNumber = c.catalogNumber""",
    "order_master": f"""SELECT o.o_orderkey, c.c_name, n.n_name, coalesce(l.l_returnflag, '-') AS flag, round(l.l_extendedprice, 2) AS price, coalesce(l.n_lines, 0) AS n_lines, CASE WHEN l.l_orderkey IS NULL THEN 'empty' WHEN o.o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state
 FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) = 1) l ON l.l_orderkey = o.o_orderkey""",
    "set_algebra": f"SELECT k, 'both' AS part FROM (FROM {_SHEETS} INTERSECT FROM {_RANGES}) UNION ALL SELECT k, 'range_only' FROM (FROM {_RANGES} EXCEPT FROM {_SHEETS}) UNION ALL SELECT k, 'sheet_only' FROM (FROM {_SHEETS} EXCEPT FROM {_RANGES})",
}
