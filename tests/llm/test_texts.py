import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from sheetmill.llm.leakage import SuffixAutomaton, clean_text, leaked_passages, leaks
import sheetmill.operators.skew as skew
from sheetmill.llm.packing import fill_containers, pack, token_codes
from sheetmill.llm.shared_spans import merged_intervals, shared_intervals, shared_share, window_intervals

LETTERS = "abcdefgh ij\né"


def _shared(texts, span):
    """doc -> covered flags, by brute force."""
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts.items():
        flags = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                flags[i : i + span] = [True] * span
        if any(flags):
            out[d] = sum(flags)
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    passage = [text(n) for n in (40, 60, 39, 120, 400)]
    texts = {i: text(rng.randrange(0, 200)) + rng.choice(passage) + text(rng.randrange(0, 90)) for i in range(60)}
    texts |= {100: passage[4], 101: passage[4][5:300], 102: "a" * 500, 103: "a" * 41, 104: text(30) * 20, 105: "", 106: passage[0][1:], 107: passage[3][:60] + passage[1] * 2}
    df = spark.createDataFrame([*texts.items(), (200, None), (100, texts[100]), (101, texts[101])], "doc_id long, text string")
    want = _shared(texts, 40)
    for block in (64, 1 << 19):
        got = {r["doc_id"]: (r["shared_chars"], r["shared_tenths"]) for r in shared_share(df, span=40, seed=12, block=block).collect()}
        assert {d: n for d, (n, _) in got.items()} == want
        assert all(t == min(10, 10 * n // len(texts[d])) for d, (n, t) in got.items())
    spans = shared_intervals(df, span=40, seed=12).collect()
    assert all(r["stop"] - r["start"] >= 40 for r in spans)


def test_shared_spans_of_one_passage_in_all_records(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice(LETTERS) for _ in range(120))
    texts = {i: f"{rng.random()}" * 3 + passage + f"{rng.random()}" * 3 for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["shared_chars"] for r in shared_share(df, span=100, seed=40).collect()}
    assert got == _shared(texts, 100)
    assert shared_share(df.limit(0), span=100, seed=40).count() == 0


def _passages(n, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    passage = [text(k) for k in (60, 120, 400)]
    return {i: text(rng.randrange(0, 200)) + rng.choice(passage)[rng.randrange(0, 30) :] + text(rng.randrange(0, 90)) for i in range(n)}


def test_shuffled_lookups_and_all_windows_agree(spark, monkeypatch):
    """Beyond the size that is broadcast, and with a row for every window, the intervals are the same."""
    texts = _passages(60, 5) | {100: None, 101: "", 102: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = lambda d: sorted(map(tuple, merged_intervals(d).collect()))
    want = found(shared_intervals(df, span=40, seed=12))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert found(shared_intervals(df, span=40, seed=12)) == want
    assert found(window_intervals(df, span=40, block=64)) == want and len(want) > 40
    assert window_intervals(df.limit(0), span=40).count() == 0


def test_spans_of_tokens(spark):
    encode = token_codes()
    texts = {1: "alpha beta " * 3 + "the narrow leaves of the basal rosette were glabrous and thick", 2: "unlike these, the narrow leaves of the basal rosette were glabrous and thick, gamma"}
    spans = merged_intervals(shared_intervals(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), span=6, seed=3, encode=encode)).collect()
    got = {r["doc_id"]: encode(texts[r["doc_id"]])[r["start"] : r["stop"]].tolist() for r in spans}
    assert got[1] == got[2] == encode(" the narrow leaves of the basal rosette were glabrous and thick").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=14), min_size=1, max_size=5), st.text("abcd", max_size=40), st.integers(2, 5))
def test_automaton_against_brute_force(items, text, least):
    held = [(i, list(t)) for i, t in enumerate(items)]
    got = {i for _, _, ids in SuffixAutomaton(held, least).matches(list(text)) for i in ids}
    grams = {text[k : k + least] for k in range(len(text) - least + 1)}
    assert got == {i for i, t in enumerate(items) if any(t[k : k + least] in grams for k in range(len(t) - least + 1))}
    for a, b, ids in SuffixAutomaton(held, least).matches(list(text)):
        assert b - a >= least and ids
        assert all(any(text[k : k + least] in items[i] for k in range(a, b - least + 1)) for i in ids)


def test_leaks_and_cleaning(spark):
    item = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(25)) + " " + " ".join(f"w{i}" for i in range(5, 27))
    docs = [
        (1, "x " + " ".join(f"W{i}," for i in range(4, 24)) + " y", 0), (2, " ".join(f"w{i}" for i in range(19)) + " gap " + " ".join(f"w{i}" for i in range(19, 30)), 0),
        (3, other.replace(" ", "\n--"), 0), (4, None, 0), (5, "", 0), (6, "z " * 50_000 + item, 0), (1, "x " + " ".join(f"W{i}," for i in range(4, 24)) + " y", 0),
    ]
    items = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, None, 0), (4, "short one", 0), (5, item, 0)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    want = {(1, 1), (1, 5), (3, 1), (3, 2), (3, 5), (6, 1), (6, 5), (6, 2)}
    for block in (40, 250_000):
        assert {tuple(r) for r in leaks(df, items, block=block).collect()} == want
    cleaned = {r["doc_id"]: r for r in clean_text(df, leaked_passages(df, items)).collect()}
    assert cleaned[3]["clean_text"] is None and cleaned[2]["clean_text"] == docs[1][1] and cleaned[4]["clean_text"] is None
    assert re.sub(r"\s+", " ", cleaned[6]["clean_text"]).strip() == ("z " * 50_000).strip() and cleaned[6]["leaked_words"] == 30
    assert leaks(df, items.limit(0)).count() == 0 and leaks(df.limit(0), items).count() == 0


def test_texts_are_read_once_for_any_number_of_items(spark):
    """Items in many blocks, one longer than a block, few automata held: one scan of the texts and the same leaks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = {i: [word() for _ in range(40)] for i in range(30)} | {99: [word() for _ in range(400)]}
    docs = {i: [word() for _ in range(30)] + items[i][:25] + [word()] + items[(i + 1) % 30][5:24] for i in range(30)} | {50: items[99][100:330], 51: items[99][10:29]}
    frame = lambda d, k: spark.createDataFrame([(i, " ".join(w)) for i, w in d.items()], f"{k} long, text string")
    found = leaked_passages(frame(docs, "doc_id"), frame(items, "item_id"), block=60, held=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(30)} | {(50, 99)}
    covered = {w for r in found.filter("doc_id = 50").collect() for w in range(r["first_word"], r["first_word"] + r["n_words"])}
    assert covered == set(range(230))


def test_cleaning_with_shuffled_spans_and_clashing_columns(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c " * 20 + item + " end", "x"), (2, "clean", "y"), (None, item, "z")], "doc_id long, text string, clean_text string")
    passages = leaked_passages(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    for most in (1 << 20, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
        got = {r["doc_id"]: (r["clean_text"], r["leaked_words"]) for r in clean_text(docs, passages).collect()}
        assert got == {1: ("a b c " * 20 + " end", 30), 2: ("clean", 0), None: (item, 0)}
    assert clean_text(docs.limit(0), passages).count() == 0


def _slow_pack(sizes, capacity):
    bins, out = [], []
    for w in sizes:
        if w == 0:
            if not bins:
                bins.append(capacity)
            out.append(len(bins) - 1)
            continue
        count = lambda g: sum(b == g for b in bins)  # noqa: E731, B023
        total = lambda state: sum(state.count(g) ** 2 for g in set(state) if g)
        options = [(total([*bins, capacity - w]), capacity)]
        for g in sorted({b for b in bins if b >= w}):
            k = bins.index(g)
            options.append((total([*bins[:k], g - w, *bins[k + 1 :]]), g))
        best = min(o[0] for o in options)
        fits = [g for t, g in options[1:] if t == best]
        gap = min(fits) if fits else None
        if gap is None:
            bins.append(capacity - w)
            out.append(len(bins) - 1)
        else:
            k = max(i for i, b in enumerate(bins) if b == gap)
            bins[k] -= w
            out.append(k)
    return out, bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30))
def test_pack_follows_the_rule(sizes):
    boxes = pack(np.array(sizes, np.int64), 12)
    slow, gaps = _slow_pack(sizes, 12)
    # containers of one gap are interchangeable: the fills agree
    fill = lambda b: sorted(sum(s for s, x in zip(sizes, b, strict=True) if x == k) for k in set(map(int, b)))
    assert fill(boxes) == fill(slow)
    assert all(f <= 12 for f in fill(boxes))


def test_containers_hold_every_token_once(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["leaf", "stem", "blade", "node"]) for _ in range(rng.randrange(0, 300)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "leaf " * 2000), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fill_containers(df, capacity=512, shard=100).collect()
    fill, of = {}, {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        of.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
    assert max(fill.values()) <= 512
    assert set(of) == {d for d, _ in docs}
    for parts in of.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    assert sum(fill.values()) / (len(fill) * 512) > 0.9
    assert all(len(p) == 1 for d, p in of.items() if d != 902) and len(of[902]) == 4
    assert fill_containers(df.limit(0)).count() == 0
