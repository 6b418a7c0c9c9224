"""Readers of the file kinds that specimen work meets, each ending in a plain DataFrame."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.genotype import cell_depths, genotype_dosage
from ..functions.scalar import lat_lon, text_or_null, to_double

#: Heading words of range tables → column names.
RANGE_HEADINGS = {
    "symbol": "symbol", "scientific name": "scientific_name", "common name": "common_name", "state": "state", "state/province": "state", "country": "country", "county": "county",
    "fips": "fips_code", "fips code": "fips_code", "native status": "native_status", "synonym symbol": "synonym_symbol", "scientific name with author": "name_with_author", "family": "family",
}


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def _delimiter(line: str) -> str:
    return max(",\t;|", key=line.count)


def read_headed_table(spark: SparkSession, path: str, headings: dict[str, str] = RANGE_HEADINGS, least: int = 2) -> DataFrame:
    """Delimited files with a preamble: lines before the first that has ``least`` known headings are skipped, headings
    become the names in ``headings``, unknown columns are dropped, missing tokens null. Adds ``file``."""
    names = list(dict.fromkeys(headings.values()))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                lines = (text or "").lstrip("﻿").splitlines()
                for i, line in enumerate(lines):
                    found = [headings.get(c.strip().strip('"').lower()) for c in line.split(_delimiter(line))]
                    if sum(f is not None for f in found) >= least:
                        body = pd.read_csv(io.StringIO("\n".join(lines[i:])), sep=_delimiter(line), dtype=str, keep_default_na=False, header=0, names=[f or f"__{j}" for j, f in enumerate(found)], index_col=False)
                        out = body[[f for f in found if f]].copy()
                        out["file"] = file
                        yield out.reindex(columns=["file", *names]).astype(object)
                        break

    raw = whole_texts(spark, path).mapInPandas(parse, ", ".join(f"`{n}` string" for n in ["file", *names]))
    return raw.select("file", *[text_or_null(F.col(n)).alias(n) for n in names])


def state_only(ranges: DataFrame, taxon: str = "symbol") -> DataFrame:
    """taxon, state, is_state_only: 1 where the state is named but none of its counties."""
    return ranges.filter("state IS NOT NULL").groupBy(taxon, F.lower(F.trim("state")).alias("state")).agg((F.count_if(F.coalesce("county", F.lit("")) != "") == 0).cast("int").alias("is_state_only"))


def read_json_records(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Records of JSON files that hold an array, at the top or under ``field``."""
    text = whole_texts(spark, path)
    array = F.col("text") if field is None else F.get_json_object("text", f"$.{field}")
    return text.select(F.explode(F.from_json(array, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_occurrence_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages of an occurrence service: {"results": […]} a file."""
    return read_json_records(spark, path, schema, "results")


def read_tab_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited files with a heading, all columns text."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False)


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """VCF files, also compressed: sample, locus, dosage, n_ref, n_alt in long form.

    Data lines split into cells in the executors; each file's heading line is joined by file name. A locus without an
    id is 'chrom_pos'. Malformed cells give nulls.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    heads = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.posexplode(F.slice(F.split("value", "\t"), 10, 1_000_000)).alias("i", "sample"))
    cells = F.split("value", "\t")
    data = lines.filter(~F.col("value").startswith("#") & (F.size(cells) >= 10)).select("file", cells.alias("c"))
    locus = F.when(F.col("c")[2].isin(".", ""), F.concat_ws("_", F.col("c")[0], F.col("c")[1])).otherwise(F.col("c")[2])
    flat = data.select("file", locus.alias("locus"), F.col("c")[8].alias("form"), F.posexplode(F.slice("c", 10, 1_000_000)).alias("i", "cell"))
    named = flat.join(heads, ["file", "i"])
    gt = F.get(F.split("cell", ":"), F.array_position(F.split("form", ":"), F.lit("GT")).cast("int") - 1)
    named = named.withColumn("dosage", genotype_dosage(gt)).withColumn("d", cell_depths(F.col("form"), F.col("cell"), F.col("dosage")))
    return named.select("sample", "locus", "dosage", F.col("d.n_ref").alias("n_ref"), F.col("d.n_alt").alias("n_alt"))


def read_dosage_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide table (first column the sample) → sample, locus, dosage."""
    wide = read_tab_table(spark, path, sep)
    first, *loci = wide.columns
    return wide.unpivot([first], loci, "locus", "dosage").select(F.col(first).alias("sample"), "locus", F.col("dosage").try_cast("double").alias("dosage"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, id (its first word), seq."""
    text = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s", ""))
    return text.filter(F.trim(record) != "").select(head.alias("header"), F.split_part(F.trim(head), F.lit(" "), F.lit(1)).alias("id"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, id, seq, quality: reads of four lines, split at record starts."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                lines = (text or "").splitlines()
                n = len(lines) // 4
                yield pd.DataFrame({"file": [file] * n, "id": [x[1:].split(" ")[0] for x in lines[0 : 4 * n : 4]], "seq": lines[1 : 4 * n : 4], "quality": lines[3 : 4 * n : 4]})

    return whole_texts(spark, path).mapInPandas(parse, "file string, id string, seq string, quality string")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """file, name, seq of alignments in PHYLIP (sequential or interleaved), NEXUS or FASTA, told apart by content."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                rows = parse_alignment(text or "")
                yield pd.DataFrame([(file, *r) for r in rows], columns=["file", "name", "seq"])

    return whole_texts(spark, path).mapInPandas(parse, "file string, name string, seq string")


def parse_alignment(text: str) -> list[tuple[str, str]]:
    body = text.strip()
    out: dict[str, str] = {}
    if body.startswith(">"):
        for part in body[1:].split("\n>"):
            head, _, seq = part.partition("\n")
            out[head.split()[0] if head.split() else ""] = re.sub(r"\s", "", seq).upper()
    elif body.upper().startswith("#NEXUS"):
        matrix = re.search(r"(?is)\bmatrix\b(.*?);", body)
        for line in (matrix.group(1) if matrix else "").splitlines():
            name, *seq = line.split() or [""]
            if name and not name.startswith("["):
                out[name.strip("'\"")] = out.get(name.strip("'\""), "") + "".join(seq).upper()
    else:
        lines = [x for x in body.splitlines()[1:] if x.strip()]
        head = body.split("\n", 1)[0].split() if body else []
        n = int(head[0]) if head and head[0].isdigit() else 0
        names: list[str] = []
        for i, line in enumerate(lines):
            if i < n:
                name, *seq = line.split()
                names.append(name)
                out[name] = "".join(seq).upper()
            elif names:
                out[names[i % n]] += re.sub(r"\s", "", line).upper()
    return list(out.items())


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """file, node, parent, label, length: the edges of each tree; node 0 is the root."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                yield pd.DataFrame([(file, *r) for r in parse_newick(text or "")], columns=["file", "node", "parent", "label", "length"])

    return whole_texts(spark, path).mapInPandas(parse, "file string, node int, parent int, label string, length double")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, label, length); comments in brackets are skipped, quoted labels kept whole."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+", re.sub(r"\[[^\]]*\]", "", text))
    nodes: list[list] = [[0, None, None, None]] if tokens else []
    at, after_colon = 0, False
    for t in tokens:
        if t == "(":
            nodes.append([len(nodes), at, None, None])
            at = len(nodes) - 1
        elif t == ",":
            parent = nodes[at][1]
            nodes.append([len(nodes), parent, None, None])
            at = len(nodes) - 1
        elif t == ")":
            at = nodes[at][1] or 0
        elif t == ":":
            after_colon = True
            continue
        elif t == ";":
            break
        elif after_colon:
            try:
                nodes[at][3] = float(t)
            except ValueError:
                nodes[at][3] = None
        else:
            nodes[at][2] = t.strip("'").replace("''", "'")
        after_colon = False
    return [tuple(n) for n in nodes]


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """file, shape, values (row by row) of each .npy matrix."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in pdf["content"]]
            yield pd.DataFrame({"file": pdf["file"], "shape": [list(map(int, a.shape)) for a in arrays], "values": [a.astype(float).ravel().tolist() for a in arrays]})

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInPandas(parse, "file string, shape array<int>, values array<double>")


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """file, points: x,y files as vertex arrays in line order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                pairs = re.findall(r"(?m)^\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*[,;\t ]\s*(-?[\d.]+(?:[eE][-+]?\d+)?)", text or "")
                out.append((file, [[float(x), float(y)] for x, y in pairs]))
            yield pd.DataFrame(out, columns=["file", "points"])

    return whole_texts(spark, path).mapInPandas(parse, "file string, points array<array<double>>")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, bytes of each file below a folder, told by its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    kinds = (
        (r"\.vcf(\.gz)?$", "genotypes"), (r"\.(fa|fasta|fna)(\.gz)?$", "sequences"), (r"\.(fq|fastq)(\.gz)?$", "reads"), (r"\.(nwk|newick|tre|tree)$", "tree"), (r"\.(phy|nex|nexus|aln)$", "alignment"),
        (r"dosage.*\.(csv|tsv)$", "dosage"), (r"(meta|field|sample).*\.(csv|tsv|xlsx)$", "metadata"), (r"\.npy$", "matrix"), (r"\.(csv|tsv)$", "table"), (r"\.json$", "records"),
    )
    kind: Column = F.when(F.lit(False), "")
    for pattern, k in kinds:
        kind = kind.when(name.rlike(pattern), k)
    return files.select("path", kind.otherwise("other").alias("kind"), "bytes")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational store, where its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


#: Headings that field sheets have for each column, the first that a sheet has counts.
FIELD_HEADINGS = {
    "sample": ("genetic_sample_id", "sample_id"), "project_id": ("project_id",), "taxon": ("taxon", "scientificname"), "lat": ("decimallatitude", "latitude"), "lon": ("decimallongitude", "longitude"), "lat_lon": ("lat_lon",),
    "state": ("state", "stateprovince"), "county": ("county",), "date": ("date_collected", "eventdate"), "collector": ("recordedby", "collector"),
    "number": ("recordnumber", "record_number", "collector_number", "collection_number", "collector_id"), "notes": ("notes",),
}


def read_field_sheets(spark: SparkSession, path: str, headings: dict[str, tuple[str, ...]] = FIELD_HEADINGS) -> DataFrame:
    """file and the columns of ``headings``, as text without blanks, null for missing: field sheets whose headings differ
    (case and blanks around them ignored), each file with its own. ``lat`` and ``lon`` are numbers, from their own
    columns or else from the first two numbers of ``lat_lon``. Files without any known heading give no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                lines = (text or "").lstrip("﻿").splitlines()
                if not lines:
                    continue
                body = pd.read_csv(io.StringIO("\n".join(lines)), sep=_delimiter(lines[0]), dtype=str, keep_default_na=False, index_col=False, on_bad_lines="skip")
                have = {str(c).strip().lower(): c for c in body.columns}
                chosen = {name: next((have[h] for h in other if h in have), None) for name, other in headings.items()}
                if any(chosen.values()):
                    yield pd.DataFrame({"file": file, **{n: body[c] if c is not None else None for n, c in chosen.items()}}).astype(object)

    raw = whole_texts(spark, path).mapInPandas(parse, ", ".join(f"`{n}` string" for n in ["file", *headings]))
    texts = raw.select("file", *[text_or_null(F.col(n)).alias(n) for n in headings])
    if not {"lat", "lon", "lat_lon"} <= set(headings):
        return texts
    own = to_double(F.col("lat")).isNotNull() & to_double(F.col("lon")).isNotNull()
    both = lat_lon(F.col("lat_lon"))
    return texts.withColumns({"lat": F.when(own, to_double(F.col("lat"))).otherwise(both["lat"]), "lon": F.when(own, to_double(F.col("lon"))).otherwise(both["lon"])}).drop("lat_lon")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns they share with ``overrides`` replaced where that has a value for the key."""
    shared = [c for c in rows.columns if c in overrides.columns and c != key]
    other = overrides.select(F.col(key), *[F.col(c).alias(f"__o_{c}") for c in shared]).dropDuplicates([key])
    return rows.join(other, key, "left").select(*[F.coalesce(f"__o_{c}", c).alias(c) if c in shared else F.col(c) for c in rows.columns])
