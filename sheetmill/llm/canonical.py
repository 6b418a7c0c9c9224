"""Values typed freely, mapped to the closest entry of a reference list.

The list becomes a symmetric-delete dictionary: every entry is filed under each string left after deleting up to
``edits`` characters of it, so a lookup tests only the entries filed under a deletion of the typed word. Candidates
rank by weighted Damerau-Levenshtein cost, then by how often the reference list has the entry. The list is broadcast
in blocks of bounded size and each Python worker keeps the dictionaries it has built from task to task; the values are
read once, meet all blocks, and the best over all blocks counts, so a list of any length is looked up whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .texts import kept

#: Entries of one broadcast block (with deletions of two characters about 200 strings an entry).
BLOCK_ENTRIES = 20_000
MAX_EDITS = 2
#: Shortest words that may be one and two edits off: below, too many other words are as near.
EDIT_LENGTHS = (4, 7)
#: Words beyond that length, whose deletions would be many, are filed under pieces instead, which finds the same entries.
PIECE_WORD = 40
#: Words whose entries a dictionary remembers: the words of typed values recur.
LOOKED_WORDS = 100_000
#: Blocks whose dictionaries a worker holds at once.
HELD_BLOCKS = 8
#: Letters that Unicode does not take apart into a plain letter and a mark.
_WHOLE = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ħ": "h", "ı": "i", "ŧ": "t"})


def fold(text: str) -> str:
    """Lower case without accents, runs of space as one."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.lower().translate(_WHOLE)).strip()


def deletions(word: str, edits: int) -> set[str]:
    """The word and all strings left after deleting up to ``edits`` of its characters."""
    out, n = {word}, len(word)
    if edits >= 1:
        out.update(word[:i] + word[i + 1 :] for i in range(n))
    if edits >= 2:
        out.update(word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(n) for j in range(i + 1, n))
    for k in range(3, min(edits, n) + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(n), k))
    return out


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Damerau-Levenshtein (adjacent swaps) where a swap costs 0.8, a doubled or halved letter 0.7, any other edit 1
    and an edit of the first letter 0.3 more; ``limit`` + 1 where it is beyond the limit."""
    if a == b:
        return 0.0
    beyond, width = limit + 1, int(limit / 0.7) + 1  # a cell further off the diagonal costs more than the limit
    if abs(len(a) - len(b)) > width:
        return beyond
    before, last = {}, {j: float(j) if j == 0 else 1.3 + (j - 1) for j in range(min(len(b), width) + 1)}
    for i in range(1, len(a) + 1):
        row = {0: 1.3 + (i - 1)} if i <= width else {}
        for j in range(max(1, i - width), min(len(b), i + width) + 1):
            extra = 0.3 if i == 1 or j == 1 else 0.0
            drop = 0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0 + (0.3 if i == 1 else 0.0)
            add = 0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0 + (0.3 if j == 1 else 0.0)
            best = min(last.get(j, beyond) + drop, row.get(j - 1, beyond) + add, last.get(j - 1, beyond) + (0.0 if a[i - 1] == b[j - 1] else 1.0 + (extra if i == j == 1 else 0.0)))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, beyond) + 0.8 + (0.3 if i == j == 2 else 0.0))
            row[j] = best
        if min(row.values()) > limit + 1:
            return limit + 1
        before, last = last, row
    return last.get(len(b), beyond)


class DeleteDictionary:
    """Words under all their deletions; long words under their pieces."""

    def __init__(self, words: set[str], edits: int = MAX_EDITS) -> None:
        self.edits, self.words, self.filed, self.lengths = edits, words, {}, set()
        self.looked: dict[tuple[str, int], list[tuple[float, str]]] = {}
        for w in sorted(words):
            if len(w) <= PIECE_WORD + edits:
                for key in deletions(w, edits):
                    self.filed.setdefault(key, []).append(w)
            if len(w) > PIECE_WORD - edits:
                self.lengths.add(len(w))
                for k, (lo, hi) in enumerate(self._cuts(len(w))):
                    self.filed.setdefault((len(w), k, w[lo:hi]), []).append(w)

    def _cuts(self, n: int) -> list[tuple[int, int]]:
        """Bounds of 2 edits + 1 pieces of a word of ``n`` letters: an edit, a swap included, touches at most two of
        them, so one stays whole and moves by at most ``edits`` places."""
        parts = 2 * self.edits + 1
        return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]

    def _long(self, word: str) -> set[str]:
        found: set[str] = set()
        for n in range(len(word) - self.edits, len(word) + self.edits + 1):
            if n in self.lengths:
                for k, (lo, hi) in enumerate(self._cuts(n)):
                    for move in range(-self.edits, self.edits + 1):
                        found.update(self.filed.get((n, k, word[max(0, lo + move) : max(0, hi + move)]), ()))
        return found

    def nearest(self, word: str, edits: int) -> list[tuple[float, str]]:
        """As near, but words two edits off only where none is one edit off: those never cost less."""
        return self.near(word, 1) or self.near(word, edits) if edits > 1 else self.near(word, edits)

    def near(self, word: str, edits: int | None = None) -> list[tuple[float, str]]:
        """(cost, word) of the words within ``edits`` edits, exact first."""
        edits = self.edits if edits is None else edits
        if word in self.words:
            return [(0.0, word)]
        if not word or not edits:
            return []
        if (word, edits) not in self.looked:
            if len(self.looked) >= LOOKED_WORDS:
                self.looked.clear()
            self.looked[word, edits] = self._near(word, edits)
        return self.looked[word, edits]

    def _near(self, word: str, edits: int) -> list[tuple[float, str]]:
        found = self._long(word) if len(word) > PIECE_WORD else {w for key in deletions(word, edits) for w in self.filed.get(key, ())}
        close = [w for w in found if _plain_edits(word, w, edits) <= edits]
        costs = [(weighted_distance(word, w, edits * 1.3), w) for w in close]
        return sorted((c, w) for c, w in costs if c <= edits * 1.3)


def _plain_edits(a: str, b: str, most: int) -> int:
    """Edits with adjacent swaps, each counting one; ``most`` + 1 where there are more."""
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    lo, hi = 0, 0  # what both begin and end with needs no edit
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n = len(b)
    if not a or not b:
        return len(a) + n
    before, last = {}, {j: j for j in range(min(n, most) + 1)}
    for i in range(1, len(a) + 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(n, i + most) + 1):
            c = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before.get(j - 2, far) + 1)
            row[j] = c
        if min(row.values(), default=0) >= far:
            return far
        before, last = last, row
    return min(far, last.get(n, far))


def edits_for(word: str, lengths: tuple[int, int] = EDIT_LENGTHS) -> int:
    """How many edits a word of that length may be off."""
    return 0 if len(word) < lengths[0] else 1 if len(word) < lengths[1] else MAX_EDITS


class Texts:
    """Values of any kind (cities, brands, job titles), read by words: case, accents, punctuation and the order of the
    words don't count, nor do ``ignored`` words unless nothing else is left; ``spelled`` gives the full form of a word.
    Entries are read like values."""

    def __init__(self, entries: list[tuple[str, str, int]], ignored: tuple[str, ...] = (), spelled: dict[str, str] | None = None, lengths: tuple[int, int] = EDIT_LENGTHS) -> None:
        self.ignored, self.spelled, self.lengths = frozenset(map(fold, ignored)), spelled or {}, lengths
        self.of: dict[str, list[tuple[int, str]]] = {}
        for entry, meant, n in entries:
            for form in self.forms(entry):
                self.of.setdefault(form, []).append((-n, meant))
        self.index = DeleteDictionary(set(self.of))

    def forms(self, value: str) -> list[str]:
        words = [self.spelled.get(w, w) for w in re.findall(r"[^\W_]+", fold(value).replace("'", ""))]
        words = [w for w in words if w not in self.ignored] or words
        return list(dict.fromkeys((" ".join(words), " ".join(sorted(words))))) if words else []

    def best(self, value: str) -> tuple[float, int, str] | None:
        # another order of the words costs a little, so that the given one wins
        found = [(cost + (0.05 if k else 0.0), *min(self.of[w])) for k, form in enumerate(self.forms(value)) for cost, w in self.index.nearest(form, edits_for(form, self.lengths))]
        return min(found, default=None)


class Places:
    """Place names: 'County', 'Co.', 'cnty' and the like around them don't count, nor do accents. Entries are read like
    values, besides as they stand."""

    _AROUND = re.compile(r"^(?:county of |co\.? )|[ ,]*(?:\(co\.?\)|\(county\)|\bcounty|\bcnty\.?|\bcty\.?|\bco\.?|\bparish)$")
    _SHORT = ((re.compile(r"^mt\b\.? ?"), "mount "), (re.compile(r"^ste?\b\.? ?"), "saint "), (re.compile(r"^ft\b\.? ?"), "fort "))

    def __init__(self, entries: list[tuple[str, str, int]], lengths: tuple[int, int] = EDIT_LENGTHS) -> None:
        self.lengths = lengths
        self.of: dict[str, list[tuple[int, str]]] = {}
        for entry, meant, n in entries:
            self.of.setdefault(fold(entry), []).append((-n, meant))
        listed = set(self.of)  # another reading of an entry gives way to what is listed so
        for entry, meant, n in entries:
            for form in self.forms(entry)[1:]:
                if form and form not in listed:
                    self.of.setdefault(form, []).append((-n, meant))
        self.index = DeleteDictionary({w for w in self.of if w})

    def forms(self, value: str) -> list[str]:
        text = fold(value.replace("_", " "))
        bare = self._AROUND.sub("", self._AROUND.sub("", text)).strip(" .,?")
        for pattern, full in self._SHORT:
            bare = pattern.sub(full, bare)
        return list(dict.fromkeys((text, bare)))

    def best(self, value: str) -> tuple[float, int, str] | None:
        forms = self.forms(value)
        listed = [f for f in forms if f in self.of]  # nothing is nearer than an entry itself
        found = [(cost, *min(self.of[w])) for form in listed or forms for cost, w in self.index.nearest(form, edits_for(form, self.lengths))]
        return min(found, default=None)


class Taxa:
    """Binomials: authors, ranks below the species and marks of doubt don't count; the genus may be one letter,
    misspelled, behind the epithet or left out, the epithet misspelled or cut off with a full stop."""

    _DOUBT = re.compile(r"(?:^|(?<=[\s.]))(?:cf|aff|nr|near|prob|possibly|probably)\b\.?|\?")
    _GENUS_ONLY = re.compile(r"^(?:sp|spp|indet|species|sect|hybr?|nov|ined)\b")

    def __init__(self, entries: list[tuple[str, str, int]], lengths: tuple[int, int] = EDIT_LENGTHS) -> None:
        self.lengths = lengths
        self.of: dict[str, dict[str, list[tuple[int, str]]]] = {}
        for entry, meant, n in entries:
            words = fold(entry).split(" ")
            if len(words) >= 2:
                self.of.setdefault(words[0], {}).setdefault(words[1], []).append((-n, meant))
        self.genera = DeleteDictionary(set(self.of))
        self.epithets = {g: DeleteDictionary(set(e)) for g, e in self.of.items()}

    def forms(self, value: str) -> list[tuple[str | None, str]]:
        """(genus or None, epithet) as typed."""
        text = self._DOUBT.sub(" ", fold(value.replace("_", " "))).strip(" ,;")
        text = re.sub(r"^([a-z])\.(?=[a-z])", r"\1. ", re.sub(r"\s+", " ", text))
        turned = re.fullmatch(r"([a-z-]{4,}), ([a-z]+)", text)
        if turned:
            return [(turned.group(2), turned.group(1))]
        words = [w for w in text.split(" ") if w not in ("x", "×")]
        if not words or not re.match(r"[a-z]", words[0]):
            return []
        if len(words) == 1:
            return [(None, words[0])]
        return [] if self._GENUS_ONLY.match(words[1]) else [(words[0], words[1])]

    def best(self, value: str) -> tuple[float, int, str] | None:
        found = []
        for genus, epithet in self.forms(value):
            if genus is None:
                genera = [(0.5, g) for g in self.of]
                # one word alone is an epithet, never a misspelled genus
                if self.genera.near(epithet.rstrip("."), 1):
                    continue
            elif len(genus.rstrip(".")) == 1:
                genera = [(0.0, g) for g in self.of if g[0] == genus[0]]
            else:
                genera = self.genera.near(genus.rstrip("."), edits_for(genus, self.lengths))
            stem = epithet.rstrip(".,;")
            for cost, g in genera:
                spare = MAX_EDITS - (0 if cost == 0.5 else round(cost))
                near = self.epithets[g].near(stem, min(edits_for(stem, self.lengths), max(0, spare)))
                if not near and epithet.endswith(".") and len(stem) >= 3:
                    near = [(0.5, e) for e in self.of[g] if e.startswith(stem)]
                found += [(cost + c, *min(self.of[g][e])) for c, e in near]
        return min(found, default=None)


READERS: dict[str, Callable] = {"text": Texts, "place": Places, "taxon": Taxa}


def map_to_canonical(values: DataFrame, value: str, reference: DataFrame, entry: str, canonical: str, kind: str, block: int = BLOCK_ENTRIES, held: int = HELD_BLOCKS, **options: object) -> DataFrame:
    """(``value``, canonical_value, cost) of each distinct non-blank value: the entry meant, '' and a null cost where
    it means none of the list. ``kind``: 'text', 'place' or 'taxon', how values are read; ``options`` go to that reader
    (``lengths``: shortest words that may be one and two edits off; 'text' also takes ``ignored`` and ``spelled``).

    Values are made distinct first (partial aggregation, so one value holding a third of the rows is one row a
    partition) and read once, whatever the length of the list. Null and blank values give no row, null and blank
    entries mean nothing; an empty list leaves every value unmatched. Ties in cost go to the entry more frequent in the
    list, then to the smaller one. Values and entries of any length are compared whole.
    """
    found = map_kinds(values.select(F.lit("").alias("field"), F.col(value).alias("value")), {"": (reference.select(F.col(entry).alias("entry"), F.col(canonical).alias("meant")), kind)}, block, held, **options)
    return found.select(F.col("value").alias(value), "canonical_value", "cost")


def map_kinds(values: DataFrame, lists: dict[str, tuple[DataFrame, str]], block: int = BLOCK_ENTRIES, held: int = HELD_BLOCKS, **options: object) -> DataFrame:
    """field, value, canonical_value, cost: as map_to_canonical for the values of several fields (``values``: field, value)
    in one pass; ``lists`` has each field's list (entry, meant) and how its values are read. Fields without a list give no
    row."""
    spark: SparkSession = values.sparkSession
    distinct = values.filter((F.trim("value") != "") & F.col("field").isin(*lists)).select("field", "value").distinct()
    # looking words up costs far more than their bytes suggest: spread them over all cores
    distinct = distinct.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent: dict[str, list] = {}
    for field, (reference, _) in lists.items():
        listed = reference.filter((F.trim("entry") != "") & F.col("meant").isNotNull()).groupBy("entry", "meant").agg(F.count("*").alias("n"))
        sent[field], entries = [], []
        for r in listed.orderBy("entry", "meant").toLocalIterator():
            entries.append((r["entry"], r["meant"], r["n"]))
            if len(entries) == block:
                sent[field].append(spark.sparkContext.broadcast(entries))
                entries = []
        if entries:
            sent[field].append(spark.sparkContext.broadcast(entries))
    key, kinds = uuid.uuid4().hex, {field: kind for field, (_, kind) in lists.items()}

    def best_of(field: str, values: list[str]) -> list[tuple[float, int, str] | None]:
        best: list = [None] * len(values)
        for k, part in enumerate(sent[field]):
            book = kept(f"{key}-{field}-{k}", lambda part=part: READERS[kinds[field]](part.value, **options), held)
            best = [min((x for x in pair if x is not None), default=None) for pair in zip(best, map(book.best, values), strict=True)]
        return best

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for field, part in pdf.groupby("field"):
                best = best_of(field, part["value"].tolist())
                yield pd.DataFrame({"field": field, "value": part["value"], "canonical_value": [b[2] if b else "" for b in best], "cost": [b and b[0] for b in best]}).astype({"cost": "float64"})

    found = distinct.mapInPandas(lookup, "field string, value string, canonical_value string, cost double")
    return found.withColumn("cost", F.when(~F.isnan("cost"), F.col("cost")))
