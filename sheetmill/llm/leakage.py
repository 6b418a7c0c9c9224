"""Evaluation passages inside training texts.

The normalised test items form a generalised suffix automaton over words. Training texts stream through it: at each
word it knows the longest passage of any item that ends there. The items are dealt to blocks of bounded size and each
block's automaton is built once, on the executors; the texts are read once, whatever the number of items.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import checked_join
from ..session import cut_table
from .texts import kept, map_texts

#: Consecutive words of an item that make a leak.
MIN_WORDS = 20
#: Words of the items in one automaton (about 400 bytes a word in a Python worker), and the automata that a worker holds
#: at once; of more blocks the one used longest ago is loaded again when its turn comes.
BLOCK_WORDS = 250_000
HELD_BLOCKS = 8
#: Words of suspicious runs gathered before they are followed through all blocks.
RUN_WORDS = 500_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers; each state knows the items its passages occur in."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int, numbers: dict[str, int] | None = None) -> None:
        self.least, self.numbers = least, {} if numbers is None else numbers
        self.length, self.link, self.next, held = [0], [-1], [{}], [set()]
        grams = set()
        for item, words in items:
            last = 0
            codes = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            grams.update(zip(codes, codes[1:], strict=False))
            for c in codes:
                last = self._extend(last, c, held)
                state = last
                while state and item not in held[state]:
                    held[state].add(item)
                    state = self.link[state]
        for state, items_of in enumerate(held):  # a state split off later holds what the states that link to it hold
            while state:
                up = self.link[state]
                if up <= 0 or items_of <= held[up]:
                    break
                held[up] |= items_of
                state = up
        # the shortest passage of at least `least` words that ends where a state's passages end decides the items
        self.items: list[tuple[int, ...]] = [()] * len(held)
        for state in sorted(range(len(held)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= least:
                self.items[state] = self.items[up] if self.length[up] >= least else tuple(sorted(held[state]))
        self.pairs = np.array(sorted(a << 32 | b for a, b in grams), np.int64)

    def _extend(self, last: int, c: int, held: list[set[int]]) -> int:
        length, link, nxt = self.length, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q, held)
        cur = self._new(length[last] + 1, held)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q, held)
        return cur

    def _new(self, length: int, held: list[set[int]]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append({})
        held.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int, held: list[set[int]]) -> int:
        clone = self._new(self.length[p] + 1, held)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        held[clone] |= held[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def dump(self) -> bytes:
        """All but the numbers of the words, as flat arrays."""
        state = np.repeat(np.arange(len(self.next)), [len(n) for n in self.next])
        key, target = [k for n in self.next for k in n], [t for n in self.next for t in n.values()]
        owned = [len(i) for i in self.items]
        return pickle.dumps((self.least, self.pairs, *(np.array(x, np.int32) for x in (self.length, self.link, state, key, target, owned)), np.array([i for held in self.items for i in held], np.int64)))

    @classmethod
    def load(cls, data: bytes) -> SuffixAutomaton:
        out = cls.__new__(cls)
        out.least, out.pairs, length, link, state, key, target, owned, items = pickle.loads(data)
        out.length, out.link, out.next = length.tolist(), link.tolist(), [{} for _ in length]
        for s, k, t in zip(state.tolist(), key.tolist(), target.tolist(), strict=True):
            out.next[s][k] = t
        ends = np.cumsum(owned).tolist()
        values = items.tolist()
        out.items = [tuple(values[b - n : b]) if n else () for b, n in zip(ends, owned.tolist(), strict=True)]
        return out

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, word after the last, items) of the passages of at least ``least`` words, each as long as the
        automaton can follow it; passages of one item that overlap may be given in several parts."""
        for codes, lo in suspicious_runs(words, self.numbers, self.pairs, self.least):
            yield from self._follow(codes, lo)

    def _follow(self, codes: list[int], lo: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        state = size = 0
        open_at: tuple[int, int, tuple[int, ...]] | None = None
        for i, c in enumerate(codes):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
                # the state of a match shorter than its longest passage may lie deeper than the match: climb
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
            found = self.items[state] if size >= self.least else ()
            if open_at and open_at[2] == found and i + 1 - size <= open_at[0]:
                open_at = (open_at[0], i + 1, found)
                continue
            if open_at:
                yield open_at[0] + lo, open_at[1] + lo, open_at[2]
            open_at = (i + 1 - size, i + 1, found) if found else None
        if open_at:
            yield open_at[0] + lo, open_at[1] + lo, open_at[2]


def suspicious_runs(words: list[str], numbers: dict[str, int], pairs: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """(word numbers, first word) of the stretches of at least ``least`` words all of whose neighbours are neighbours in
    some item: a passage lies within one of them."""
    if len(words) < least:
        return
    get = numbers.get
    codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    if least < 2:
        yield codes.tolist(), 0
        return
    pair = codes[:-1] << 32 | codes[1:]
    known = (codes[:-1] >= 0) & (codes[1:] >= 0)
    at = np.searchsorted(pairs, pair)
    known &= at < len(pairs)
    known[known] = pairs[at[known]] == pair[known]
    turn = np.flatnonzero(np.diff(np.r_[0, known.view(np.int8), 0]))
    for lo, hi in zip(turn[::2], turn[1::2], strict=True):
        if hi - lo >= least - 1:
            yield codes[lo : hi + 1].tolist(), int(lo)


def _automata(items: DataFrame, item_id: str, text: str, least: int, block: int) -> tuple[dict[str, int], np.ndarray, list[Broadcast]]:
    """The numbers of the items' words, their neighbouring pairs, and the automata of all blocks, each built in one
    task. An item longer than a block is cut into pieces that overlap by a passage less one word."""
    spark = items.sparkSession

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, block - least + 1)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item"], pdf["text"], strict=True):
                words = words_of(t)
                rows += [(i, k, words[k : k + step + least - 1]) for k in range(0, max(1, len(words) - least + 1), step)]
            yield pd.DataFrame(rows, columns=["item", "at", "words"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    pieces = cut_table(rows.mapInPandas(cut_up, "item bigint, at int, words array<string>").withColumn("n", F.size("words")).filter(F.col("n") >= least))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    numbers = {r["w"]: k for k, r in enumerate(pieces.select(F.explode("words").alias("w")).distinct().orderBy("w").toLocalIterator())}
    sent = spark.sparkContext.broadcast(numbers)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "at"], kind="stable")
        automaton = SuffixAutomaton([(i, list(w)) for i, w in zip(pdf["item"], pdf["words"], strict=True)], least, sent.value)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [automaton.dump()]})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "at"), F.lit(max(1, -(-total // block)))))
    pairs, out = [np.zeros(0, np.int64)], []
    for r in dealt.groupBy("block").applyInPandas(build, "block bigint, data binary").toLocalIterator():
        data = bytes(r["data"])
        pairs.append(pickle.loads(data)[1])
        out.append(spark.sparkContext.broadcast(data))
    return numbers, np.unique(np.concatenate(pairs)), out


def _loaded(sent: Broadcast) -> SuffixAutomaton:
    out = SuffixAutomaton.load(sent.value)
    sent.__dict__.pop("_value", None)  # the bytes stay in the worker's file
    return out


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS, block: int = BLOCK_WORDS, held: int = HELD_BLOCKS
) -> DataFrame:
    """doc_id, item_id, first_word, n_words: where a text has ``least`` or more consecutive words of an item, in order.

    Words are maximal runs of letters and digits, case ignored. Passages of one item may overlap, or come in parts
    where an item is longer than a block. Null texts and items, items or texts of fewer than ``least`` words leak
    nothing; an empty table gives no row; rows with one item_id are parts of one item. Texts are streamed whole,
    partition by partition, in one pass without a shuffle, however many items there are.

    The words and neighbouring pairs of all items are held by each Python worker (some 100 bytes a word), which bounds
    the items to what a worker can hold; of their automata ``held`` at a time.
    """
    spark = docs.sparkSession
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    schema = "doc_id bigint, item_id bigint, first_word int, n_words int"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    numbers, pairs, blocks = _automata(items, item_id, item_text, least, block)
    if not blocks:
        return spark.createDataFrame([], schema)
    words, key = spark.sparkContext.broadcast((numbers, pairs)), uuid.uuid4().hex

    def kernel(found: Iterator[dict]) -> Iterator[dict]:
        numbers, pairs = words.value
        runs: list[tuple[int | None, list[int], int]] = []
        n = 0

        def follow() -> Iterator[dict]:
            for k in range(len(blocks)):
                automaton = kept(f"{key}-{k}", lambda k=k: _loaded(blocks[k]), held)
                hits = [(d, i, a, b - a) for d, codes, lo in runs for a, b, ids in automaton._follow(codes, lo) for i in ids]
                if hits:
                    d, i, a, m = zip(*hits, strict=True)
                    yield {"doc_id": d, "item_id": i, "first_word": a, "n_words": m}

        for r in found:
            if not r["text"]:
                continue
            for codes, lo in suspicious_runs(words_of(r["text"]), numbers, pairs, least):
                runs.append((r["doc_id"], codes, lo))
                n += len(codes)
            if n >= RUN_WORDS:
                yield from follow()
                runs, n = [], 0
        if runs:
            yield from follow()

    return map_texts(rows, kernel, schema, arrow)


def leaks(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """doc_id, item_id: which items each text contains a passage of."""
    return leaked_passages(docs, items, **options).select("doc_id", "item_id").distinct()


def clean_text(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", most_covered: float = 0.5) -> DataFrame:
    """``docs`` without the leaked passages: ``clean_text`` is the text with each leaked span cut out, null where
    leaked words make more than ``most_covered`` of all words, and ``leaked_words`` counts them. A null text stays null
    with 0 leaked words, an empty table stays empty, rows repeated under one id are cleaned alike, and columns of ``docs``
    with those two names are replaced. The texts meet the
    spans by broadcast where these are few, and otherwise in a shuffle."""
    per = passages.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("__spans"), F.count("*").alias("__n"))
    per = cut_table(per.filter("__id IS NOT NULL"))
    joined = checked_join(docs.withColumn("__id", F.col(doc_id).cast("bigint")), per, ["__id"], "left", "__n", docs.count())
    names = [c for c in docs.columns if c not in ("clean_text", "leaked_words")]
    fields = [f"`{c}`" for c in names]
    schema = joined.select(*fields).withColumns({"clean_text": F.lit(None).cast("string"), "leaked_words": F.lit(None).cast("int")}).schema
    at, n_fields = names.index(text), len(names)

    def cut_out(value: str, found: list[dict]) -> tuple[str | None, int]:
        places = [m.span() for m in WORD.finditer(value)]
        gone = np.zeros(len(places), bool)
        for s in found:
            gone[s["first_word"] : s["first_word"] + s["n_words"]] = True
        if gone.sum() > most_covered * len(places):
            return None, int(gone.sum())
        turn = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        kept, last = [], 0
        for lo, hi in zip(turn[::2], turn[1::2], strict=True):
            kept.append(value[last : places[lo][0]])
            last = places[hi - 1][1]
        return "".join([*kept, value[last:]]), int(gone.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), batch.column(n_fields).to_pylist()
            clean, leaked = texts, np.zeros(batch.num_rows, np.int32)
            some = [i for i, found in enumerate(spans) if found and texts[i].is_valid]
            if some:  # untouched batches keep their text as it is
                values = texts.to_pylist()
                for i in some:
                    values[i], leaked[i] = cut_out(values[i], spans[i])
                clean = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_fields], clean, pa.array(leaked)], names=[*schema.names])

    return joined.select(*fields, "__spans").mapInArrow(run, schema)
