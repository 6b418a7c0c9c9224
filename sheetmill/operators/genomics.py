"""Genotypes in long form (sample, locus, dosage, n_ref, n_alt): filters, distances, replicates and k-mers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.genotype import kmers
from ..session import cut_table

LEAST_READS = 10.0
#: Samples on each side of a task's pairs, and loci compared at once.
PAIR_SAMPLES = 2048
PAIR_LOCI = 256
#: Twice the least common multiple of 1 to 16: means of up to 16 calls of 0, 0.5 and 1 are multiples of 1 / UNIT.
UNIT = 1_441_440


def paralog_filter(cells: DataFrame, h_max: float = 0.6, d_max: float = 4.0) -> DataFrame:
    """locus, n_called, n_hets, h_obs, d_stat, reason: heterozygosity and read-ratio gates of each locus.

    Reasons in order: fewer than two calls; four or more calls and too many heterozygotes; ten or more reads of
    heterozygotes and too uneven a read ratio; no variance; else PASS. One aggregate with partial sums.
    """
    het = (F.col("dosage") > 0.05) & (F.col("dosage") < 0.95)
    ok = het & F.col("n_ref").isNotNull() & F.col("n_alt").isNotNull()
    per = cells.groupBy("locus").agg(
        F.count("dosage").alias("n_called"), F.count_if(het).alias("n_hets"), F.coalesce(F.sum(F.when(ok, F.col("n_ref"))), F.lit(0.0)).alias("na"),
        F.coalesce(F.sum(F.when(ok, F.col("n_alt"))), F.lit(0.0)).alias("nb"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"),
    )
    n = F.col("na") + F.col("nb")
    d = F.when(n >= LEAST_READS, (F.col("na") - 0.5 * n) / F.sqrt(0.25 * n)).otherwise(0.0)
    h = F.when(F.col("n_called") > 0, F.col("n_hets") / F.col("n_called"))
    sparse = "monomorphic_or_sparse"
    reason = F.when(F.col("n_called") < 2, sparse).when((F.col("n_called") >= 4) & (h > h_max), "too_heterozygous").when((n >= LEAST_READS) & (F.abs(d) > d_max), "uneven_reads").when(F.col("hi") - F.col("lo") <= 1e-8, sparse).otherwise("PASS")
    return per.select("locus", "n_called", "n_hets", h.alias("h_obs"), d.alias("d_stat"), reason.alias("reason"))


def rescaled_dosage(cells: DataFrame) -> DataFrame:
    """Dosages on 0–1: halved where the largest is at most 2.05, divided by the largest beyond, else unchanged."""
    top = cells.agg(F.max("dosage").alias("__m"))
    scale = F.when(F.col("__m") <= 1.05, 1.0).when(F.col("__m") <= 2.05, 2.0).otherwise(F.col("__m"))
    return cells.crossJoin(F.broadcast(top)).withColumn("dosage", F.col("dosage") / scale).drop("__m")  # one row


def _pair_sums(x: np.ndarray, y: np.ndarray, sums: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """(sums of absolute differences, in 1 / UNIT, and numbers) over the rows in which both columns are known; rows are loci,
    columns samples.

    Differences are taken over all rows with 0 for the unknown, and what the unknown added is taken off again by matrix
    products. Dosages that are multiples of 1 / UNIT, as means of up to 16 calls are, are summed as whole numbers."""
    kx, ky = ~np.isnan(x), ~np.isnan(y)
    n = kx.T.astype("f4") @ ky.astype("f4")
    if not sums:
        return None, n
    x, y = np.where(kx, x, 0.0) * UNIT, np.where(ky, y, 0.0) * UNIT
    whole = [np.rint(v) for v in (x, y)]
    if all(np.abs(v - w).max(initial=0) < 5e-10 and np.abs(w).max(initial=0) <= UNIT for v, w in zip((x, y), whole, strict=True)) and len(x) * 2 * UNIT < 2**31:
        x, y = (w.astype("i4") for w in whole)
    x, y = np.ascontiguousarray(x), np.ascontiguousarray(y)
    (rows, a), b = x.shape, y.shape[1]
    gone, other = (~ky).astype(float), np.abs(y).astype(float)
    s = np.empty((a, b))
    for i in range(0, a, 32):
        xi = x[:, i : i + 32, None]
        for j in range(0, b, 512):
            yj = y[:, None, j : j + 512]
            total = np.zeros((xi.shape[1], yj.shape[2]), x.dtype)
            diff = np.empty_like(total)
            for k in range(rows):
                np.subtract(xi[k], yj[k], out=diff)
                np.abs(diff, out=diff)
                np.add(total, diff, out=total)
            s[i : i + 32, j : j + 512] = total
    for i in range(0, a, 256):
        s[i : i + 256] -= np.abs(x[:, i : i + 256]).T.astype(float) @ gone + (~kx[:, i : i + 256]).T.astype(float) @ other
    return np.maximum(s, 0, out=s), n


class _Pairs:
    """Sums of one pair of blocks: dosage differences (in 1 / UNIT) and shared loci, samples of either side in order of arrival."""

    def __init__(self, key: tuple) -> None:
        self.pa, self.pb, self.part = key
        self.at, self.s, self.n = ({}, {}), None, None

    def add(self, sides: list[tuple | None], sums: bool) -> None:
        """``sides``: (samples, loci, dosages) of one chunk of loci, None where the block has no call in it."""
        places = [np.array([at.setdefault(x, len(at)) for x in (side[0].tolist() if side else [])], int) for at, side in zip(self.at, sides, strict=True)]
        if all(sides):
            _, i, j = np.intersect1d(sides[0][1], sides[1][1], assume_unique=True, return_indices=True)
            s, n = _pair_sums(sides[0][2][:, i].T, sides[1][2][:, j].T, sums)
        if self.n is None and all(sides):
            if all(len(at) == len(p) for at, p in zip(self.at, places, strict=True)):
                self.s, self.n = s, n
                return
        self._grow(sums)
        if all(sides):
            where = np.ix_(*places)
            self.n[where] += n
            if sums:
                self.s[where] += s

    def _grow(self, sums: bool) -> None:
        shape = tuple(len(at) for at in self.at)
        old = (0, 0) if self.n is None else self.n.shape
        more = [(0, k - o) for k, o in zip(shape, old, strict=True)]
        self.n = np.pad(np.zeros(old, "f4") if self.n is None else self.n, more)
        if sums:
            self.s = np.pad(np.zeros(old) if self.s is None else self.s, more)

    def samples(self, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
        return tuple(pa.array(list(at), kind).to_numpy(zero_copy_only=False) for at in self.at)


class Packed:
    """Called cells as dense blocks of samples by chunks of loci, each value one small code; a row a block, part and chunk."""

    def __init__(self, cells: DataFrame, by: str | None = None) -> None:
        self.kind, self.locus = (cells.schema[c].dataType.simpleString() for c in ("sample", "locus"))
        part = F.lit(0).cast("bigint") if by is None else F.col(by).cast("bigint")
        self.known = cut_table(cells.filter("dosage IS NOT NULL AND sample IS NOT NULL").select("sample", "locus", F.col("dosage").cast("double").alias("dosage"), part.alias("part")).filter("part IS NOT NULL"))
        n = self.known.agg(F.approx_count_distinct("sample")).first()[0]
        loci = self.known.groupBy("part").agg(F.approx_count_distinct("locus").alias("n")).agg(F.max("n")).first()[0]
        self.n_blocks, self.n_chunks = max(1, -(-n // PAIR_SAMPLES), min(8, -(-n // 64))), max(1, -(-(loci or 0) // PAIR_LOCI))
        self.held = cut_table(self.pack(self.known, F.pmod(F.xxhash64("sample"), F.lit(self.n_blocks))))

    def pack(self, known: DataFrame, block: Column) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            i, samples = pd.factorize(pdf["sample"])
            j, loci = pd.factorize(pdf["locus"])
            grid = np.full((len(samples), len(loci)), np.nan)
            there = j >= 0
            grid[i[there], j[there]] = pdf["dosage"].to_numpy()[there]
            levels, codes = np.unique(grid, return_inverse=True)
            if len(levels) > 65535:
                levels, codes = levels[:0], grid
            else:
                codes = codes.astype("u1" if len(levels) < 256 else "u2")
            return pd.DataFrame([(*key, list(samples), list(loci), levels.tobytes(), zlib.compress(codes.tobytes(), 1))], columns=["block", "part", "chunk", "samples", "loci", "levels", "codes"])

        chunk = F.pmod(F.xxhash64("locus"), F.lit(self.n_chunks))
        grouped = known.groupBy(block.cast("bigint").alias("block"), "part", chunk.cast("bigint").alias("chunk"))
        return grouped.applyInPandas(run, f"block bigint, part bigint, chunk bigint, samples array<{self.kind}>, loci array<{self.locus}>, levels binary, codes binary")

    def over_pairs(self, finish: Callable, schema: str, sums: bool = True) -> DataFrame:
        """The rows that ``finish(pairs, kind)`` makes of each pair of blocks and part, kind the Arrow type of samples. A
        task holds the sums of one pair of blocks and adds a chunk of loci at a time, so its memory grows neither with
        the loci nor with the samples."""
        both = self.held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1))))
        both = both.select(F.least("block", "other").alias("pa"), F.greatest("block", "other").alias("pb"), "part", "chunk", "block", "samples", "loci", "levels", "codes")
        n = min(2048, self.n_blocks * (self.n_blocks + 1) // 2)
        return both.repartition(n, "pa", "pb").sortWithinPartitions("pa", "pb", "part", "chunk").mapInArrow(lambda batches: _finished(batches, finish, sums), schema)


def mean_difference(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of sums in 1 / UNIT, divided once, so that a mean of whole sums is the double nearest to it."""
    return s / (n.astype(float) * UNIT)


def rounded_difference(s: np.ndarray, n: np.ndarray, digits: int) -> np.ndarray:
    """As mean_difference, rounded half up; whole numbers are divided, so that a half is seen as such."""
    all_, scale = n.astype(float) * UNIT, 10.0**digits
    return np.floor((s * (2 * scale) + all_) / (2 * all_)) / scale


def _unpacked(samples: pa.Array, loci: pa.Array, levels: bytes, codes: bytes) -> tuple:
    table, raw = np.frombuffer(levels), zlib.decompress(codes)
    grid = table[np.frombuffer(raw, "u1" if len(table) < 256 else "u2")] if len(table) else np.frombuffer(raw)
    names = [x.to_numpy(zero_copy_only=False) for x in (samples, loci)]
    return *names, grid.reshape(len(names[0]), len(names[1]))


def _finished(batches: Iterator[pa.RecordBatch], finish: Callable, sums: bool) -> Iterator[pa.RecordBatch]:
    """``finish`` of each (pa, pb, part) of sorted rows; a chunk has one row of either block, of one block alone the same on both sides."""
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("samples").type.value_type
            keys = batch.select(["pa", "pb", "part", "chunk", "block"]).to_pandas().to_numpy()
            samples, loci, levels, codes = (batch.column(c) for c in ("samples", "loci", "levels", "codes"))
            for i, key in enumerate(keys.tolist()):
                yield tuple(key[:4]), key[4], (samples[i].values, loci[i].values, levels[i].as_py(), codes[i].as_py())

    for key, chunks in groupby(rows(), lambda r: r[0][:3]):
        pairs = _Pairs(key)
        for _, chunk in groupby(chunks, lambda r: r[0]):
            own = {block: _unpacked(*row) for _, block, row in chunk}
            pairs.add([own.get(key[0]), own.get(key[1])], sums)
        yield from finish(pairs, kind)


def _listed(pairs: _Pairs, kind: pa.DataType, keep: Callable[[np.ndarray], np.ndarray], value: Callable | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows a < b, value and n of the pairs whose number ``keep`` takes, some rows of the grid at a time."""
    a, b = pairs.samples(kind)
    names = np.concatenate([a, b])
    rank = np.unique(names, return_inverse=True)[1]
    names, ra, rb = pa.array(names, kind), rank[: len(a)], rank[len(a) :]
    step = max(1, 2**18 // max(1, len(b)))
    for lo in range(0, len(a), step):
        n = pairs.n[lo : lo + step]
        first = ra[lo : lo + step, None] < rb[None, :]
        kept = keep(n) & first if pairs.pa == pairs.pb else keep(n)
        if not kept.any():
            continue
        i, j = np.arange(lo, lo + len(n), dtype="i4")[:, None], np.arange(len(a), len(names), dtype="i4")[None, :]
        left, right, n = (x.ravel() if kept.all() else x[kept] for x in (np.where(first, i, j), np.where(first, j, i), n))
        out = [names.take(pa.array(left)), names.take(pa.array(right))]
        if value is not None:
            s = pairs.s[lo : lo + step]
            out.append(pa.array(value(s.ravel() if kept.all() else s[kept], n)))
        out.append(pa.array(n.astype("int64")))
        if "part" in columns:
            out.insert(0, pa.array(np.full(len(n), pairs.part)))
        yield pa.RecordBatch.from_arrays(out, columns)


def pair_differences(cells: DataFrame, by: str | None = None) -> DataFrame:
    """part, a < b, s, n: the sum of absolute dosage differences over the n loci that two samples share, for all pairs of
    samples called at some locus, within each value of ``by`` (one part without)."""
    packed = Packed(cells, by)
    finish = lambda pairs, kind: _listed(pairs, kind, lambda n: n >= 0, lambda s, _: s / UNIT, ["part", "a", "b", "s", "n"])
    return packed.over_pairs(finish, f"part bigint, a {packed.kind}, b {packed.kind}, s double, n bigint")


def _detours(packed: Packed, open_: DataFrame, need: int) -> DataFrame:
    """a, b, via: for pairs of ``open_`` the mean of the detours over all third samples with a measured distance to both.

    The samples of open pairs are dealt to halves; two halves make a group, which holds the pairs between them and meets
    every block of samples in turn. What a task holds are the pairs of one group and the distances to one block."""
    ends = open_.select(F.col("a").alias("sample")).union(open_.select(F.col("b").alias("sample"))).distinct()
    halves = max(1, -(-ends.count() // (PAIR_SAMPLES // 2)))
    half = lambda c: F.pmod(F.xxhash64(c), F.lit(halves))
    grouped = cut_table(open_.select("a", "b", (F.least(half("a"), half("b")) * halves + F.greatest(half("a"), half("b"))).alias("pa")))
    members = grouped.select("pa", F.col("a").alias("sample")).union(grouped.select("pa", F.col("b").alias("sample"))).distinct()
    groups = grouped.select("pa").distinct()
    lanes = min(packed.n_blocks, max(1, -(-64 // groups.count())))
    own = packed.pack(packed.known.join(members, "sample"), F.col("pa")).withColumnRenamed("block", "pa").withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(packed.n_blocks - 1))))
    held = packed.held.withColumnRenamed("block", "pb").crossJoin(groups)  # every group meets every block
    listed = grouped.groupBy("pa").agg(F.collect_list(F.struct("a", "b")).alias("p")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    common = ["part", "chunk", "samples", "loci", "levels", "codes"]
    none = [F.lit(0).alias("part"), F.lit(0).alias("chunk")], [F.lit(None).alias(c) for c in common[3:]]
    rows = own.select("pa", "pb", F.lit(0).alias("side"), *common).union(held.select("pa", "pb", F.lit(1).alias("side"), *common)).withColumn("lane", F.pmod("pb", F.lit(lanes)))
    for side, c in enumerate("ab"):
        rows = rows.unionByName(listed.select("pa", F.lit(-1).alias("pb"), F.lit(side).alias("side"), *none[0], F.col(f"p.{c}").alias("samples"), *none[1], "lane"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state = None, None

        def entries() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("samples").type.value_type
                keys = batch.select(["pa", "lane", "pb", "chunk", "side"]).to_pandas().to_numpy()
                for i, key in enumerate(keys.tolist()):
                    yield tuple(key), [batch.column(c)[i] for c in common[2:]]

        for (group, _), per_lane in groupby(entries(), lambda r: r[0][:2]):
            for pb, per_block in groupby(per_lane, lambda r: r[0][2]):
                if pb < 0:
                    a, b = (row[0].values.to_numpy(zero_copy_only=False) for _, row in per_block)
                    state = a, b, np.zeros(len(a)), np.zeros(len(a))
                    continue
                pairs = _Pairs((group, pb, 0))
                for _, chunk in groupby(per_block, lambda r: r[0][3]):
                    sides = {key[4]: _unpacked(row[0].values, row[1].values, row[2].as_py(), row[3].as_py()) for key, row in chunk}
                    pairs.add([sides.get(0), sides.get(1)], True)
                o, k = pairs.samples(kind)
                known = pairs.n >= need
                _, i, j = np.intersect1d(o, k, assume_unique=True, return_indices=True)
                known[i, j] = False
                m, d = known.astype(float), np.where(known, mean_difference(pairs.s, np.maximum(pairs.n, 1)), 0.0)
                sums, counts = d @ m.T, m @ m.T
                order = np.argsort(o)
                ia, ib = (order[np.searchsorted(o, x, sorter=order)] for x in state[:2])
                state[2][:] += sums[ia, ib] + sums[ib, ia]
                state[3][:] += counts[ia, ib]
            yield pa.RecordBatch.from_arrays([pa.array(state[0], kind), pa.array(state[1], kind), pa.array(state[2]), pa.array(state[3])], ["a", "b", "s", "k"])

    sums = rows.repartition("pa", "lane").sortWithinPartitions("pa", "lane", "pb", "chunk", "side").mapInArrow(run, f"a {packed.kind}, b {packed.kind}, s double, k double")
    return sums.groupBy("a", "b").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0.0))).alias("via"))


def allele_sharing(cells: DataFrame, few: float = 0.2, least: int | None = None, digits: int | None = None) -> DataFrame:
    """a < b, distance, measured, n_shared: mean absolute dosage difference over the loci two samples share, for all
    pairs. It is measured where they share 150 loci, of fewer than 200 loci in all the share ``few`` of them and at least 10
    (with ``least`` given: so many loci, or that share of all where it is less). Else it is the mean of the detours over all third samples with a measured distance to both, or where there
    is none the mean of all measured distances, or 0.25 (measured 0).

    Only pairs that are not measured are kept on disk; all others are listed as they are compared. With ``digits`` the
    distances are rounded half up where they are made: for many pairs F.round takes longer than their comparison."""
    packed = Packed(cells.select("sample", "locus", "dosage"))
    n_loci = packed.known.select("locus").distinct().count()
    need = 150 if n_loci >= 200 else max(10, int(few * n_loci))
    if least is not None:
        need = min(least, max(1, int(few * n_loci)))
    kind = packed.kind
    value = mean_difference if digits is None else partial(rounded_difference, digits=digits)
    known = packed.over_pairs(lambda p, k: _listed(p, k, lambda n: n >= need, value, ["a", "b", "distance", "n_shared"]), f"a {kind}, b {kind}, distance double, n_shared bigint")
    known = known.select("a", "b", "distance", F.lit(1).alias("measured"), "n_shared")
    open_ = cut_table(packed.over_pairs(lambda p, k: _listed(p, k, lambda n: n < need, None, ["a", "b", "n_shared"]), f"a {kind}, b {kind}, n_shared bigint", sums=False))
    if open_.isEmpty():
        return known
    filled = cut_table(open_.join(_detours(packed, open_, need), ["a", "b"], "left"))
    usual = 0.25
    if not filled.filter("via IS NULL").isEmpty():

        def total(p: _Pairs, _: pa.DataType) -> Iterator[pa.RecordBatch]:
            at, twice = p.n >= need, 1
            if p.pa == p.pb:
                np.fill_diagonal(at, False)
                twice = 2  # each pair is there in both orders
            d = mean_difference(p.s[at], p.n[at])
            yield pa.RecordBatch.from_arrays([pa.array([d.sum() / twice]), pa.array([len(d) // twice])], ["s", "k"])

        s, k = packed.over_pairs(total, "s double, k bigint").agg(F.sum("s"), F.sum("k")).first()
        usual = s / k if k else usual
    distance = F.coalesce("via", F.lit(usual))
    filled = filled.select("a", "b", (distance if digits is None else F.round(distance, digits)).alias("distance"), F.lit(0).alias("measured"), "n_shared")
    return known.unionByName(filled)


def collapse_replicates(cells: DataFrame, members: DataFrame, order: list[Column]) -> DataFrame:
    """group, sample, locus, dosage: the mean of a replicate group's calls at each locus, under the group's first
    member by ``order``. ``members``: sample, group and the ordering columns, one row a sample."""
    head = members.withColumn("__rn", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter("__rn = 1").select("group", F.col("sample").alias("head"))
    mean = cells.join(members.select("sample", "group"), "sample").groupBy("group", "locus").agg(F.avg("dosage").alias("dosage"))
    return mean.join(head, "group").select("group", F.col("head").alias("sample"), "locus", "dosage")


def posterior_dosage(cells: DataFrame, ploidy: str, by: list[str], error: float = 0.005) -> DataFrame:
    """``cells`` with the expected dosage given the reads: binomial likelihood of each possible allele count under the
    prior of the group's (``by``) mean dosage at the locus, (1 + sum) / (2 + n)."""
    prior = cells.groupBy(*by, "locus").agg(((1 + F.sum(F.coalesce("dosage", F.lit(0.0)))) / (2 + F.count("dosage"))).alias("__q"))
    joined = cells.join(prior, [*by, "locus"])
    n = F.col(ploidy)

    def term(i: Column) -> Column:
        share = i / n
        p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), share * (1 - error) + (1 - share) * error))
        choose = F.factorial(n.cast("int")) / (F.factorial(i.cast("int")) * F.factorial((n - i).cast("int")))
        return choose * F.exp(i * F.ln(F.col("__q")) + (n - i) * F.ln(1 - F.col("__q")) + F.coalesce("n_alt", F.lit(0.0)) * F.ln(p) + F.coalesce("n_ref", F.lit(0.0)) * F.ln(1 - p))

    counts = F.sequence(F.lit(0), n.cast("int"))
    top = F.aggregate(counts, F.lit(0.0), lambda s, i: s + i / n * term(i))
    all_ = F.aggregate(counts, F.lit(0.0), lambda s, i: s + term(i))
    return joined.withColumn("eb_dosage", top / F.nullif(all_, F.lit(0.0))).drop("__q")


def kmer_containment(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """query, reference, shared, containment: each query's best reference by the share of its distinct k-mers found in
    it; ties by the rarer k-mers (sum of 1 / number of references with it), then the smaller reference. Inputs: id,
    seq. k-mers of one text are distinct before the shuffle; ids without a shared k-mer have no row."""
    q = queries.select(F.col("id").alias("query"), F.explode(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer"))
    r = references.select(F.col("id").alias("reference"), F.explode(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer"))
    rare = r.groupBy("kmer").agg(F.count("*").alias("df"))
    size = q.groupBy("query").agg(F.count("*").alias("n"))
    hits = q.join(r, "kmer").join(rare, "kmer").groupBy("query", "reference").agg(F.count("*").alias("shared"), F.sum(1 / F.col("df")).alias("rarity"))
    best = Window.partitionBy("query").orderBy(F.desc("shared"), F.desc(F.round("rarity", 9)), F.asc("reference"))
    return hits.withColumn("rn", F.row_number().over(best)).filter("rn = 1").join(size, "query").select("query", "reference", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def consensus(reads: DataFrame, least: int = 2) -> DataFrame:
    """group, seq: the most frequent base of each position (the smaller of equals), 'N' below ``least`` reads.
    ``reads``: group, start (from 0), seq. Positions are counted before the shuffle."""
    bases = reads.select("group", "start", F.posexplode(F.split("seq", "")).alias("i", "base")).filter("base <> ''")
    counts = bases.groupBy("group", (F.col("start") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"))
    top = counts.groupBy("group", "pos").agg(F.min_by("base", F.struct((-F.col("n")).alias("n"), F.col("base"))).alias("base"), F.sum("n").alias("depth"))
    called = top.withColumn("base", F.when(F.col("depth") >= least, F.col("base")).otherwise("N"))
    return called.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


def long_tips(tips: DataFrame, by: str, name: str, length: str, z: float = 5.0, least: int = 6) -> DataFrame:
    """Tips whose branch is an outlier: robust z above ``z`` and longer than three medians, in trees of ``least`` or more."""
    mid = tips.groupBy(by).agg(F.median(length).alias("m"), F.count("*").alias("n"))
    joined = tips.join(mid, by)
    mad = joined.groupBy(by).agg(F.median(F.abs(F.col(length) - F.col("m"))).alias("mad"))
    return joined.join(mad, by).filter((F.col("n") >= least) & (F.col(length) > 3 * F.col("m")) & (F.col(length) - F.col("m") > z * 1.4826 * F.col("mad"))).select(by, name, length)
