"""Filling containers of fixed capacity with texts by the sum-of-squares rule."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_table
from .texts import kept, map_texts

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one task packs; each such shard ends with a few containers not quite full.
SHARD_ITEMS = 50_000


def token_codes(tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> Callable[[str], np.ndarray]:
    """What turns a text into its token numbers; ``tokenizer``: a file of ranked tokens that every worker can read."""

    def make() -> object:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return np.array(kept(f"tokens {tokenizer} {pattern}", make, 4).encode_ordinary(text), np.uint32)

    return encode


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens of each row's text, counted over the whole text; a null text has none."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    encode = token_codes(tokenizer, pattern)

    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        ids: list[int] = []
        sizes: list[int] = []
        for r in rows:
            ids.append(r["doc_id"])
            sizes.append(len(encode(r["text"])) if r["text"] else 0)
            if len(ids) == 4096:
                yield {"doc_id": ids, "n_tokens": sizes}
                ids, sizes = [], []
        yield {"doc_id": ids, "n_tokens": sizes}

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, kernel, "doc_id bigint, n_tokens bigint", arrow)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0 in the order they are opened. An item goes where the sum over all
    gaps of the squared number of open containers with that gap becomes smallest; among equals into the fullest.
    Items of size 0 go into the last opened container. No item may exceed the capacity."""
    counts = np.zeros(capacity + 1, np.int64)  # open containers by gap; gap 0 is closed and doesn't count
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    opened = 0
    gaps = np.arange(capacity + 1)
    for i, w in enumerate(sizes.tolist()):
        if w == 0:
            if not opened:
                opened = 1
                counts[capacity] += 1
                open_with[capacity].append(0)
            out[i] = opened - 1
            continue
        # moving a container from gap s to s - w changes the sum by 2 (N[s - w] - N[s]) + 2; closing it by -2 N[w] + 1
        change = 2 * (counts[: capacity + 1 - w] - counts[w:]) + 2
        change[0] -= 1 + 2 * counts[0]
        fits = counts[w:] > 0
        best, at = 2 * counts[capacity - w] + 1 if w < capacity else 0, -1
        if fits.any():
            change = np.where(fits, change, np.iinfo(np.int64).max)
            k = int(change.argmin())
            if change[k] <= best:
                best, at = change[k], int(gaps[w:][k])
        if at < 0:
            box, at = opened, capacity
            opened += 1
        else:
            box = open_with[at].pop()
            counts[at] -= 1
        out[i] = box
        if at > w:
            counts[at - w] += 1
            open_with[at - w].append(box)
    return out


def fill_containers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, piece, container_id, first_token, n_tokens: where the tokens of each text lie.

    A text of at most ``capacity`` tokens is one piece; a longer one fills containers of its own and its rest is packed
    like any text. Packing runs in shards of about ``shard`` items, drawn by a hash of the id, each by the
    sum-of-squares rule in order of the hash; container_id is unique over all shards. A null or empty text is a
    piece of 0 tokens; rows repeated under one id are one text, the longest; an empty table gives none.
    """
    sized = cut_table(token_counts(docs, doc_id, text, tokenizer).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    shards = max(1, -(-sized.count() // shard))
    full = (F.col("n_tokens") / capacity).cast("bigint")
    rest = F.col("n_tokens") - full * capacity
    # containers named t-... are filled by one long text alone, those named s-... within a shard
    keyed = sized.withColumns({"full": full, "rest": rest, "order": F.xxhash64("doc_id")}).withColumn("shard", F.pmod("order", F.lit(shards)))
    whole = keyed.filter(F.col("full") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("doc_id", F.col("piece").cast("int").alias("piece"), F.concat_ws("-", F.lit("t"), "doc_id", "piece").alias("container_id"), (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        boxes = pack(pdf["rest"].to_numpy(), capacity)
        name = f"s-{pdf['shard'].iloc[0]}-"
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["full"].astype("int32"), "container_id": [name + str(b) for b in boxes], "first_token": pdf["full"] * capacity, "n_tokens": pdf["rest"]})

    items = keyed.filter((F.col("rest") > 0) | (F.col("full") == 0)).select("doc_id", "full", "rest", "order", "shard")
    shared = items.groupBy("shard").applyInPandas(per_shard, "doc_id bigint, piece int, container_id string, first_token bigint, n_tokens bigint")
    return whole.unionByName(shared)

