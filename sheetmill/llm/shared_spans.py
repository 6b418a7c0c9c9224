"""Long exact spans shared between records.

Every window of ``span`` characters of every text is hashed by a rolling polynomial. A window belongs to the smallest
hash among its shorter substrings; neighbouring windows of one such minimum form a segment, which equal texts cut
alike wherever they lie. Segments are counted in Spark: one found whole in two records is shared in all its windows.
Only segments that differ though their minimum is found in several records, that is those at the edges of shared
spans, are counted window by window. Repeated windows are then merged into maximal intervals. window_intervals counts
every window as a row of its own instead, with the same result.

Texts are sequences of characters, or of whatever numbers ``encode`` makes of them, such as tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import checked_join
from ..session import cut_table
from .texts import map_texts

SPAN = 200
#: Length of the substrings whose smallest hash a window belongs to: shorter ones make fewer, more often shared segments.
SEED = 80
#: Windows handled at once; longer texts are taken in overlapping blocks.
BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of substrings of one text by prefix sums of a polynomial over mixed code points, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.prefix[1:])

    def windows(self, k: int) -> np.ndarray:
        """The hash of each substring of length ``k``."""
        return _mix((self.prefix[k:] - self.prefix[:-k]) * self.down[: len(self.prefix) - k])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[hi] - self.prefix[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.uint64(_MASK))
    pad[:n] = x
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def characters(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


Encode = Callable[[str], np.ndarray]


def _segments(codes: np.ndarray, hasher: RollingHash, span: int, seed: int, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimum, hash of the segment, first window, number of windows) of the text's segments."""
    for lo in range(0, len(codes) - span + 1, block):
        part = codes[lo : lo + block + span - 1]
        hasher.load(part)
        least = _sliding_min(hasher.windows(seed), span - seed + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, len(least)])
        whole = hasher.spans(first, first + count + span - 1)
        yield least[first], whole, first + lo, count


def segments(docs: DataFrame, span: int = SPAN, seed: int = SEED, block: int = BLOCK, encode: Encode = characters) -> DataFrame:
    """doc_id, m, g, start, n: the segments of all texts of ``docs`` (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("g", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        hasher = RollingHash()
        for r in rows:
            codes = encode(r["text"] or "")
            if len(codes) < span:
                continue
            for m, g, start, n in _segments(codes, hasher, span, seed, block):
                yield {"doc_id": np.full(len(m), r["doc_id"], np.int64), "m": m.view(np.int64), "g": g.view(np.int64), "start": start.astype(np.int32), "n": n.astype(np.int32)}

    return map_texts(docs, kernel, "doc_id bigint, m bigint, g bigint, start int, n int", arrow)


def _window_hashes(docs: DataFrame, span: int, encode: Encode) -> DataFrame:
    """h, g, off, lo, hi: a hash for each window of the segments listed in ``docs`` (text, parts)."""
    arrow = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("off", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        hasher = RollingHash()
        for r in rows:
            codes = encode(r["text"] or "")
            for p in r["parts"]:
                n, piece = p["n"], codes[p["start"] : p["start"] + p["n"] + span - 1]
                if len(piece) < n + span - 1:
                    continue  # another text under the same id
                hasher.load(piece)
                if hasher.spans(np.array([0]), np.array([len(piece)])).view(np.int64)[0] != p["g"]:
                    continue
                yield {"h": hasher.windows(span).view(np.int64), "g": np.full(n, p["g"], np.int64), "off": np.arange(n, dtype=np.int32), "lo": np.full(n, p["lo"], np.int64), "hi": np.full(n, p["hi"], np.int64)}

    return map_texts(docs, kernel, "h bigint, g bigint, off int, lo bigint, hi bigint", arrow)


def window_intervals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, block: int = BLOCK, encode: Encode = characters) -> DataFrame:
    """As shared_intervals, from a row for every window of every text: some ten times the texts' size in the shuffle."""
    arrow = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32())])

    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        hasher = RollingHash()
        for r in rows:
            codes = encode(r["text"] or "")
            for lo in range(0, len(codes) - span + 1, block):
                hasher.load(codes[lo : lo + block + span - 1])
                h = hasher.windows(span).view(np.int64)
                yield {"doc_id": np.full(len(h), r["doc_id"], np.int64), "h": h, "start": np.arange(lo, lo + len(h), dtype=np.int32)}

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    every = map_texts(rows, kernel, "doc_id bigint, h bigint, start int", arrow)
    counts = cut_table(every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter(F.col("lo") != F.col("hi")).select("h", "rows"))
    total = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    hits = checked_join(every, counts, ["h"], "left_semi", "rows", total)
    return hits.select("doc_id", "start", (F.col("start") + span).alias("stop"))


def shared_intervals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, seed: int = SEED, block: int = BLOCK, encode: Encode = characters) -> DataFrame:
    """doc_id, start, stop: stretches of characters, each of ``span`` or more, that occur verbatim in another record.

    They may overlap within a record; merge them with shared_share or merged_intervals. Null texts and texts shorter
    than ``span`` share nothing; a text repeated within one record only is not shared; rows repeated under one id are
    one record. Texts are taken whole, long ones in overlapping blocks. Equal 64-bit hashes count as equal text.
    ``encode`` turns a text into the numbers compared (start and stop then count those), by default its characters.

    Segments are written once; everything after works on those whose minimum occurs in two records. Counts are
    partial sums before each shuffle, and lookups broadcast what was counted to be small or else only hot keys, so a
    passage that a third of all records share costs one row a partition.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    every = cut_table(segments(rows, span, seed, block, encode))
    minima = every.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter(F.col("lo") != F.col("hi"))
    minima = cut_table(minima.select("m", "rows"))
    segs = cut_table(checked_join(every, minima, ["m"], "left_semi", "rows", every.count()))
    kinds = cut_table(segs.groupBy("m", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("start", "doc_id").alias("start"), F.max("n").alias("n"), F.count("*").alias("rows")))
    several = cut_table(kinds.groupBy("m").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > 1))
    edges = checked_join(kinds, several, ["m"], "left_semi", "kinds", kinds.count())
    parts = edges.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct("start", "n", "g", "lo", "hi")).alias("parts"), F.count("*").alias("rows"))
    parts = cut_table(parts)
    some = checked_join(rows, parts.select("doc_id", "rows"), ["doc_id"], "left_semi", "rows", parts.count())
    windows = cut_table(_window_hashes(some.join(parts.drop("rows"), "doc_id").select("text", "parts"), span, encode))
    twice = windows.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("*").alias("times")).filter(F.col("a") != F.col("b"))
    twice = cut_table(twice.select("h", "times"))
    repeated = checked_join(windows.filter(F.col("lo") == F.col("hi")).select("h", "g", "off"), twice, ["h"], "left_semi", "times", windows.count())
    island = F.col("off") - F.dense_rank().over(Window.partitionBy("g").orderBy("off"))
    runs = repeated.withColumn("island", island).groupBy("g", "island").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    partly = runs.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    whole = kinds.filter(F.col("lo") != F.col("hi")).select("g", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).alias("runs"), "rows")
    found = cut_table(whole.unionByName(partly.join(kinds.select("g", "rows"), "g")).select("g", "runs", "rows"))
    hits = checked_join(segs, found, ["g"], "inner", "rows", segs.count())
    return hits.select("doc_id", "start", F.explode("runs").alias("run")).select("doc_id", (F.col("start") + F.col("run.a")).alias("start"), (F.col("start") + F.col("run.b") + span).alias("stop"))


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """doc_id, start, stop with overlapping and touching intervals of a record merged into maximal ones."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.sum(F.when(before.isNull() | (before < F.col("start")), 1).otherwise(0)).over(w)
    numbered = intervals.withColumn("island", opened)
    return numbered.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, span: int = SPAN, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, shared_chars, shared_tenths of the records with a shared stretch: its characters in such stretches, and
    floor(10 × these ÷ length), at most 10. ``length`` names a column with the text's length; it is measured without."""
    merged = merged_intervals(shared_intervals(docs, doc_id, text, span, seed, block))
    covered = merged.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    size = F.length(text) if length is None else F.col(length)
    sizes = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), size.alias("size")).dropDuplicates(["doc_id"])
    tenths = F.least(F.floor(10 * F.col("shared_chars") / F.greatest(F.col("size"), F.lit(1))), F.lit(10)).cast("int")
    return covered.join(sizes, "doc_id").select("doc_id", "shared_chars", tenths.alias("shared_tenths"))
