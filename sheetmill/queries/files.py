"""Readers over files: each query writes a driver table in a file kind into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_folder, table
from ..sources import readers as R
from .models import _PAIR_CELL, PAIR_LOCI, _cells


def _written(texts: DataFrame, name: str) -> str:
    """The folder of one file for each row of ``texts`` (one text column)."""
    path = f"{scratch_folder(texts.sparkSession)}/{name}"
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _files(rows: DataFrame, line: Column, order: list[str], head: str = "", per_file: int = 5000) -> DataFrame:
    """One text a file of about ``per_file`` rows, its lines in ``order``."""
    n = max(1, -(-rows.count() // per_file))
    lines = rows.groupBy(F.pmod(F.xxhash64(*order), F.lit(n)).alias("part")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("value"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "usda_county_ranges")
    cell = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("NA"))
    line = F.concat_ws(",", *[cell(c) for c in ("usda_symbol", "canonical_packera", "state_norm", "county_norm", "fips_code", "native_status")])
    head = "Distribution report, made for a test\n\nSymbol,Scientific Name,State,County,FIPS Code,Native Status\n"
    return R.read_headed_table(spark, _written(_files(r, line, ["canonical_packera", "state_norm", "county_norm"], head), "ranges"))


def q_headed_table(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d).select("symbol", "scientific_name", "state", "county", "fips_code", "native_status")


def q_state_only(spark: SparkSession, d: str) -> DataFrame:
    return R.state_only(_ranges(spark, d))


def q_occurrence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 200 customers."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    pages = c.groupBy(F.floor(F.col("c_custkey") / 200)).agg(F.to_json(F.struct(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")).alias("results"))).alias("value")).select("value")
    return R.read_occurrence_pages(spark, _written(pages, "pages"), "c_custkey bigint, c_name string, c_acctbal double")


def q_tab_table(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    path = _written(_files(n, F.concat_ws("\t", *n.columns), ["n_name"], "\t".join(n.columns) + "\n"), "tabs")
    return R.read_tab_table(spark, path)


def q_genotype_files(spark: SparkSession, d: str) -> DataFrame:
    """Genotypes of all suppliers at the joined loci as variant files."""
    cells = _cells(spark, d, PAIR_LOCI).filter("dosage IS NOT NULL AND n_ref IS NOT NULL")
    call = F.when(F.col("dosage") < 0.25, "0/0").when(F.col("dosage") > 0.75, "1/1").otherwise("0/1")
    cell = F.concat(call, F.lit(":"), (F.col("n_ref") + F.col("n_alt")).cast("bigint"), F.lit(":"), F.col("n_ref").cast("bigint"), F.lit(","), F.col("n_alt").cast("bigint"))
    names = [r[0] for r in table(spark, d, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]  # the head of the file
    per = cells.groupBy("locus").agg(F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("c")))).alias("m"))
    line = F.concat_ws("\t", F.lit("1"), F.col("locus") + 1, F.concat(F.lit("L"), "locus"), F.lit("A\tC\t.\t.\t.\tGT:DP:AD"), F.array_join(F.transform(F.array(*[F.lit(n) for n in names]), lambda s: F.coalesce(F.element_at("m", s), F.lit("./.:.:."))), "\t"))
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(map(str, names)) + "\n"
    got = R.read_genotypes(spark, _written(_files(per.select("locus", line.alias("line")), F.col("line"), ["locus"], head, 50), "variants"))
    return got.filter("dosage IS NOT NULL").select("sample", "locus", "dosage", "n_ref", "n_alt")


def q_dosage_files(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, PAIR_LOCI).filter("dosage IS NOT NULL")
    per = cells.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("locus", F.col("dosage").cast("string").alias("v")))).alias("m"))
    line = F.concat_ws(",", F.concat(F.lit("s"), "sample"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PAIR_LOCI - 1)), lambda k: F.coalesce(F.element_at("m", k.cast("bigint")), F.lit("NA"))), ","))
    head = "sample," + ",".join(f"L{k}" for k in range(PAIR_LOCI)) + "\n"
    return R.read_dosage_table(spark, _written(_files(per.select("sample", line.alias("line")), F.col("line"), ["sample"], head, 100_000), "dosages")).filter("dosage IS NOT NULL")


def _letters() -> Column:
    return F.regexp_replace(F.lower("text"), "[^a-z]", "")


def q_sequence_files(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items as sequences in lines of 60."""
    e = table(spark, d, "eval_items").filter(F.length(_letters()) > 0)
    line = F.concat(F.lit(">item"), "item_id", F.lit(" "), "task", F.lit("\n"), F.trim(F.regexp_replace(_letters(), "(.{60})", "$1\n"), F.lit("\n")))
    return R.read_fasta(spark, _written(_files(e, line, ["item_id"], per_file=100), "sequences"))


def q_read_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").filter(F.length(_letters()) > 0)
    line = F.concat(F.lit("@r"), "item_id", F.lit(" 1\n"), F.upper(_letters()), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(_letters())))
    return R.read_fastq(spark, _written(_files(e, line, ["item_id"], per_file=100), "reads")).select("id", "seq", F.length("quality").alias("n"))


def q_alignment_files(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms as an alignment of 40 columns."""
    s = table(spark, d, "taxon_synonyms").select(F.regexp_replace("raw_name_lower", " ", "_").alias("name"), F.rpad(F.upper(F.regexp_replace("raw_name_lower", "[^a-z]", "")), 40, "-").alias("seq"))
    return R.read_alignment(spark, _written(_files(s, F.concat_ws(" ", "name", "seq"), ["name"], f"{s.count()} 40\n", 1_000_000), "alignments")).select("name", "seq")


def q_tree_files(spark: SparkSession, d: str) -> DataFrame:
    """Nations in regions as a tree; the lengths are their numbers."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clade = n.groupBy("r_name", "r_regionkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("'"), "n_name", F.lit("':"), "n_nationkey"))).alias("x"))
    tree = clade.agg(F.array_sort(F.collect_list(F.concat(F.lit("("), F.array_join("x", ","), F.lit(")'"), "r_name", F.lit("':"), "r_regionkey"))).alias("y")).select(F.concat(F.lit("("), F.array_join("y", ","), F.lit(");")).alias("value"))
    t = R.read_newick(spark, _written(tree, "trees"))
    up = t.select(F.col("node").alias("parent"), F.col("label").alias("clade"))
    return t.filter("label IS NOT NULL").join(up, "parent").select("label", "clade", "length")


def q_contour_files(spark: SparkSession, d: str) -> DataFrame:
    """County outlines as x, y files."""
    o = table(spark, d, "county_outlines")
    text = F.concat(F.lit("x,y\n"), F.array_join(F.zip_with("ring_lon", "ring_lat", lambda x, y: F.concat_ws(",", x, y)), "\n"))
    got = R.read_contours(spark, _written(o.select(text.alias("value")), "contours"))
    total = lambda i: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[i]), 4)
    return got.select(F.size("points").alias("n"), total(0).alias("sum_x"), total(1).alias("sum_y"))


def q_field_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Samples as field sheets under two sets of headings, some with both coordinates in one column."""
    s = table(spark, d, "genomic_samples").filter("genetic_sample_id IS NOT NULL").select("genetic_sample_id", F.regexp_replace("collector", '[,"\n]', " ").alias("who"), F.regexp_replace("taxon_raw", '[,"\n]', " ").alias("taxon"), "decimalLatitude", "decimalLongitude").distinct()
    odd = F.pmod(F.crc32("genetic_sample_id"), F.lit(2)) == 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = F.concat_ws(",", "genetic_sample_id", text("who"), text("taxon"), text("decimalLatitude"), text("decimalLongitude"))
    second = F.concat_ws(";", text("taxon"), "genetic_sample_id", text("who"), F.concat(text("decimalLatitude"), F.lit(" / "), text("decimalLongitude")))
    one = _files(s.filter(~odd), first, ["genetic_sample_id"], "Sample_ID,Collector,Taxon,Latitude,Longitude\n")
    two = _files(s.filter(odd), second, ["genetic_sample_id"], "ScientificName ; GENETIC_SAMPLE_ID;recordedBy;lat_lon\n")
    return R.read_field_sheets(spark, _written(one.unionByName(two), "field")).select("sample", "collector", "taxon", "lat", "lon").distinct()


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
_ITEM = "(SELECT item_id, task, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM eval_items)"
SQL = {
    "headed_table": "SELECT usda_symbol AS symbol, canonical_packera AS scientific_name, state_norm AS state, nullif(county_norm, '') AS county, fips_code, native_status FROM usda_county_ranges",
    "state_only": "SELECT usda_symbol AS symbol, lower(trim(state_norm)) AS state, (count(*) FILTER (coalesce(county_norm, '') <> '') = 0)::int AS is_state_only FROM usda_county_ranges GROUP BY 1, 2",
    "occurrence_pages": "SELECT c_custkey, c_name, c_acctbal::double AS c_acctbal FROM customer",
    "tab_table": "SELECT n_nationkey::varchar AS n_nationkey, n_name, n_regionkey::varchar AS n_regionkey FROM nation",
    "genotype_files": f"SELECT sample::varchar AS sample, 'L' || locus AS locus, CASE WHEN dosage < 0.25 THEN 0.0 WHEN dosage > 0.75 THEN 1.0 ELSE 0.5 END::double AS dosage, n_ref, n_alt FROM {_PAIR_CELL} WHERE dosage IS NOT NULL AND n_ref IS NOT NULL",
    "dosage_files": f"SELECT 's' || sample AS sample, 'L' || locus AS locus, dosage FROM {_PAIR_CELL} WHERE dosage IS NOT NULL",
    "sequence_files": f"SELECT 'item' || item_id || ' ' || task AS header, 'item' || item_id AS id, upper(s) AS seq FROM {_ITEM} WHERE s <> ''",
    "read_files": f"SELECT 'r' || item_id AS id, upper(s) AS seq, length(s)::int AS n FROM {_ITEM} WHERE s <> ''",
    "alignment_files": "SELECT replace(raw_name_lower, ' ', '_') AS name, substr(rpad(upper(regexp_replace(raw_name_lower, '[^a-z]', '', 'g')), 40, '-'), 1, 40) AS seq FROM taxon_synonyms",
    "tree_files": "SELECT n_name AS label, r_name AS clade, n_nationkey::double AS length FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, r_regionkey::double FROM region",
    "contour_files": "SELECT len(ring_lon)::int AS n, round(list_sum(ring_lon), 4) AS sum_x, round(list_sum(ring_lat), 4) AS sum_y FROM county_outlines",
    "field_sheets": """SELECT DISTINCT genetic_sample_id AS sample, CASE WHEN lower(trim(w)) NOT IN ('', 'na', 'nan', 'null', 'none') THEN trim(w) END AS collector, CASE WHEN lower(trim(t)) NOT IN ('', 'na', 'nan', 'null', 'none') THEN trim(t) END AS taxon, CASE WHEN y IS NOT NULL AND x IS NOT NULL THEN y END AS lat, CASE WHEN y IS NOT NULL AND x IS NOT NULL THEN x END AS lon
 FROM (SELECT genetic_sample_id, regexp_replace(collector, '[,"\\n]', ' ', 'g') AS w, regexp_replace(taxon_raw, '[,"\\n]', ' ', 'g') AS t, decimalLatitude AS y, decimalLongitude AS x FROM genomic_samples WHERE genetic_sample_id IS NOT NULL)""",
}
