"""Variant spellings of names typed by people, linked by merging and rematching.

Distinct spellings are parsed into profiles (surname spellings, possible first initials, further initials, given
names). Profiles meet in blocks of a possible first initial and a surname with at most one letter deleted; each points
at its best richer match, and profiles that point at one that points nowhere are merged into it. The merged profile,
which has the spellings and initials of all its parts, enters blocking again, until a round merges nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_table, release
from .canonical import PIECE_WORD, _plain_edits, deletions, fold

#: Values that name nobody.
PLACEHOLDERS = frozenset(
    "unknown|anonymous|anon|none|null|nan|na|n/a|s.n.|s. n.|sn|not evident|not recorded|not given|not stated|no collector|collector unknown|"
    "unspecified|undetermined|unnamed|illegible|[illegible]|blank|[blank]|?|-|--|.|unk|ignotus|various|several|see label|see notes".split("|")
)
#: Short names and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne anna", "art": "arthur", "barb": "barbara",
    "bea": "beatrice", "becky": "rebecca", "ben": "benjamin", "bert": "albert herbert robert", "bess": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "dave": "david", "deb": "deborah", "dick": "richard", "dolly": "dorothy dolores", "don": "donald", "dora": "dorothy theodora", "dot": "dorothy", "dottie": "dorothy", "doug": "douglas", "drew": "andrew",
    "ed": "edward edmund edwin", "eddie": "edward", "ellie": "eleanor ellen", "flo": "florence", "flora": "florence", "fran": "frances francis francisco", "frank": "francis franklin francisco", "fred": "frederick", "gene": "eugene", "geoff": "geoffrey",
    "gerry": "gerald geraldine", "gil": "gilbert", "ginny": "virginia", "greg": "gregory", "guille": "guillermo", "gus": "augustus gustav", "hal": "henry harold", "hank": "henry", "harry": "henry harold", "hattie": "harriet",
    "inge": "ingrid", "jack": "john", "jake": "jacob", "jan": "janet", "jeff": "jeffrey", "jen": "jennifer", "jerry": "gerald jerome", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "josh": "joshua",
    "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "ken": "kenneth", "kit": "christopher katherine", "kitty": "katherine", "larry": "lawrence laurence", "lena": "helena magdalena", "leo": "leopold leonard leon", "lew": "lewis", "libby": "elizabeth", "liz": "elizabeth",
    "lola": "dolores", "lou": "louis louise", "maggie": "margaret", "marge": "margaret", "marty": "martin martha", "matt": "matthew", "mattie": "martha matilda", "max": "maximilian maxwell", "meg": "margaret", "memo": "guillermo", "mike": "michael", "molly": "mary",
    "nan": "anne nancy", "nancy": "anne", "ned": "edward edmund", "nell": "eleanor helen ellen", "nellie": "eleanor helen", "nick": "nicholas", "nicky": "nicholas nicole", "nora": "eleanor", "paco": "francisco", "pancho": "francisco", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "polly": "mary",
    "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "rosie": "rosalind rose", "roz": "rosalind", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra alexandra", "steve": "stephen steven", "stu": "stuart", "sue": "susan susannah", "sukie": "susannah susan", "susie": "susannah susan", "suzy": "susannah susan",
    "ted": "theodore edward", "teddy": "theodore edward", "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tony": "anthony", "trish": "patricia", "tricia": "patricia", "trudy": "gertrude", "uli": "ulrich ulrike", "vic": "victor victoria", "vicky": "victoria", "vince": "vincent", "vonnie": "yvonne", "wally": "walter", "walt": "walter", "will": "william", "willy": "william wilhelm", "zack": "zachary", "zach": "zachary",
}
#: Words that tell an organisation, whole or as the start of an abbreviation of four letters or more.
ORGANISATION = (
    "academy", "agency", "association", "atlas", "botanical", "bureau", "center", "centre", "club", "college", "committee", "company", "council", "department", "district", "division", "expedition", "flora", "forest", "foundation",
    "garden", "gardens", "group", "herbarium", "institute", "institution", "inventory", "laboratory", "museum", "natural", "office", "park", "party", "plant", "program", "programme", "project", "rangeland", "research", "school", "service", "society", "station", "survey", "team", "trust", "university",
)
#: Words that belong to the surname behind them.
PARTICLES = frozenset("van von der den de del della di da du dos das la le las los el ter ten zu zur zum bin ibn af av".split(" "))


@dataclass(frozen=True)
class NameLists:
    """The word lists names are read with; other populations bring their own. ``nicknames``: a short name and the full
    ones it may stand for, parted by spaces."""

    placeholders: frozenset[str] = PLACEHOLDERS
    nicknames: Mapping[str, str] = None  # type: ignore[assignment]
    organisation: tuple[str, ...] = ORGANISATION
    particles: frozenset[str] = PARTICLES

    def __post_init__(self) -> None:
        if self.nicknames is None:
            object.__setattr__(self, "nicknames", NICKNAMES)

    def tells(self, word: str) -> bool:
        """Whether a word, whole or abbreviated, tells an organisation."""
        stem = word.rstrip(".")
        return stem in self.organisation or (word.endswith(".") and len(stem) >= 2 and any(o.startswith(stem) for o in self.organisation))


LISTS = NameLists()
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|miss|rev|fr|br|sr|coll|collector|col|leg|legit|det|determiner|by)(?:\.:?|:| ) *)+")
_SEVERAL = re.compile(r"\s*(?:&|;|\||\+| and | with | et al\b| y | und )\s*")
_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}(?:{_LETTER}|['’-])*"
_GENERATION = re.compile(r",? (?:jr|sr|junior|senior|iii|ii|iv)\.?(?=,|$)")
#: Shortest surname that may be one letter off.
LEAST = 4


def parse_name(value: str, lists: NameLists = LISTS) -> tuple[str, str, list[str], list[str], list[str]] | None:
    """(kind, surname or place, possible first initials, further initials, possible given names); None for a value
    that names nobody. An organisation has its acronym in place of the initial. Names may be in any script; 'Jr.', 'III'
    and the like behind a full name don't count, and 'van der' and the like belong to the surname in any order."""
    text = fold(value)
    if text in lists.placeholders or not re.search(_LETTER, text):
        return None
    text = _SEVERAL.split(text)[0].strip(" ,") or text
    short = re.fullmatch(rf"({_LETTER}{{2,8}}) \(([^)]+)\)", text)
    if short:
        return "o", short.group(2).strip(), [short.group(1)], [], []
    text = _TITLE.sub("", text).strip(" ,") if not _TITLE.fullmatch(text + " ") else text
    older = _GENERATION.sub("", text)
    if older != text and len(re.findall(_WORD, older)) >= 2:  # else it may be the initials
        text = older
    if text in lists.placeholders or not re.search(_LETTER, text):
        return None
    words = re.findall(rf"{_WORD}\.?", re.sub(r"^the ", "", text))
    if len(words) >= 3 and "," not in text and any(lists.tells(w) for w in words[1:]):
        core = [w for w in words if w.rstrip(".") not in ("of", "the", "for", "in", "and")]
        return "o", core[0].rstrip("."), ["".join(w[0] for w in core)], [], []
    comma = re.fullmatch(rf"({_WORD}(?: {_WORD})*) ?, *(.+)", text)
    behind = re.fullmatch(rf"({_WORD}) ((?:{_LETTER}\. ?)+|{_LETTER}{{1,2}})", text)
    if comma:
        surname, rest = comma.group(1).replace(" ", ""), comma.group(2)
    elif behind and len(behind.group(1)) > 1:
        surname, rest = behind.group(1), behind.group(2)
    else:
        last = re.search(rf"({_WORD})\.?$", text)
        if not last:
            return None
        surname, rest = last.group(1), text[: last.start()]
    parts = re.findall(rf"{_WORD}\.?", rest)
    if behind and not comma and len(parts) == 1 and len(parts[0]) == 2 and not parts[0].endswith("."):
        parts = list(parts[0])
    while parts and parts[-1] in lists.particles and (len(parts) > 1 or parts[0] not in lists.nicknames):
        surname = parts.pop() + surname
    if not parts:
        return "p", surname, [], [], []
    given = parts[0].rstrip(".")
    mids = [p[0] for p in parts[1:]]
    if len(given) == 1:
        return "p", surname, [given], mids, []
    formal = lists.nicknames.get(given, "").split()
    names = sorted({given, *formal})
    return "p", surname, sorted({n[0] for n in (formal or names)} | ({given[0]} if not formal else set())), mids, names


def _near(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= LEAST and _plain_edits(a, b, 1) <= 1)


def _same_given(a: str, b: str) -> bool:
    if a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))):
        return True
    return a[0] == b[0] and min(len(a), len(b)) >= 4 and _plain_edits(a, b, 1) <= 1


def compatible(p: dict, q: dict) -> bool:
    """Whether two profiles may be of one person or organisation."""
    if p["kind"] != q["kind"] or not set(p["firsts"]) & set(q["firsts"]):
        return False
    if p["mids"] and q["mids"] and not set(p["mids"]) & set(q["mids"]):
        return False
    if p["givens"] and q["givens"] and not any(_same_given(a, b) for a in p["givens"] for b in q["givens"]):
        return False
    return any(_near(a, b) for a in p["surnames"] for b in q["surnames"])


def _richness(p: dict) -> tuple:
    return (bool(p["mids"]), bool(p["givens"]), p["n"], p["pid"])


def _merge(parts: list[dict]) -> tuple[dict, list[str]]:
    """The richest profile with those of the rest that fit it and each other, and the ids of what was merged."""
    root, *rest = sorted(parts, key=_richness, reverse=True)
    root, taken = dict(root), []
    for p in rest:
        if not compatible(root, p):
            continue
        firsts = sorted(set(root["firsts"]) & set(p["firsts"]))
        if root["givens"] and p["givens"]:
            givens = sorted({x for a in root["givens"] for b in p["givens"] if _same_given(a, b) for x in (a, b)})
        else:
            givens = sorted({*root["givens"], *p["givens"]})
        root |= {"firsts": firsts, "givens": givens, "surnames": sorted({*root["surnames"], *p["surnames"]}), "mids": sorted({*root["mids"], *p["mids"]}), "n": root["n"] + p["n"]}
        taken.append(p["pid"])
    return root, taken


_PROFILE = "pid string, kind string, surnames array<string>, firsts array<string>, mids array<string>, givens array<string>, n bigint"
_FIELDS = ("pid", "kind", "surnames", "firsts", "mids", "givens", "n")


def _groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[str, list[dict]]]:
    """The rows of each group of a partition sorted by ``key``, across batches."""

    def rows() -> Iterator[dict]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                yield {k: list(v) if hasattr(v, "tolist") and k != key else v for k, v in r.items()}

    for k, g in groupby(rows(), key=lambda r: r[key]):
        yield k, list(g)


def _by_group(df: DataFrame, key: str, per_group: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``per_group`` over all groups: sorted partitions are streamed, so many small groups cost little each."""
    columns = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for _, rows in _groups(batches, key):
            held += per_group(rows)
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=columns)
                held = []
        yield pd.DataFrame(held, columns=columns)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)


def _stems(surname: str) -> set[str]:
    """Keys of which surnames one letter apart have one in common: the surname without one of its letters, or, of long
    ones, three pieces, each where an edit before it may have moved it."""
    if len(surname) < LEAST:
        return {surname}
    if len(surname) <= PIECE_WORD:
        return deletions(surname, 1)
    out = set()
    for n in range(len(surname) - 1, len(surname) + 2):
        for k in range(3):
            lo, hi = n * k // 3, n * (k + 1) // 3
            out |= {f"{n} {k} " + hashlib.md5(surname[max(0, lo + m) : max(0, hi + m)].encode("utf-8", "surrogatepass")).hexdigest() for m in (-1, 0, 1)}
    return out | (deletions(surname, 1) if len(surname) <= PIECE_WORD + 1 else set())


def _blocks(profiles: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                stems = {x for s in r["surnames"] for x in _stems(s)}
                out += [(f"{r['kind']}|{f}|{s}", *[r[c] for c in (*_FIELDS, "fresh")]) for f in r["firsts"] for s in sorted(stems)]
            yield pd.DataFrame(out, columns=["block", *_FIELDS, "fresh"])

    return profiles.mapInPandas(keys, f"block string, {_PROFILE}, fresh boolean")


def _best_richer(rows: list[dict]) -> list[tuple]:
    """In one block, each profile's best richer match. Blocks without a fresh profile were settled before.

    Profiles lie by given names and further initial, richest last, and are tried from the richest down until one of the
    same surname fits: what lies below is no better. So only the different given names of a block meet pairwise."""
    if len(rows) < 2 or not any(r["fresh"] for r in rows):
        return []
    rows = sorted(rows, key=_richness)
    at: dict[tuple, dict[str, list[int]]] = {}
    last: dict[str, int] = {}
    for j, q in enumerate(rows):
        cell = at.setdefault(tuple(q["givens"]), {})
        for m in {*q["mids"], "*"}:
            cell.setdefault(m, []).append(j)
        last |= dict.fromkeys(q["surnames"], j)
    fitting: dict[tuple, list[dict[str, list[int]]]] = {}
    out = []
    for i, p in enumerate(rows):
        given = tuple(p["givens"])
        if given not in fitting:
            fitting[given] = [c for g, c in at.items() if not g or not given or any(_same_given(a, b) for a in given for b in g)]
        some_same = any(last[s] > i for s in p["surnames"])
        best = None
        for cell in fitting[given]:
            for m in set(p["mids"]) or "*":
                for j in reversed(cell.get(m, ())):
                    if j <= i:
                        break
                    q = rows[j]
                    if not compatible(p, q):
                        continue
                    same = bool(set(p["surnames"]) & set(q["surnames"]))
                    score = (int(same), int(m != "*"), *map(int, _richness(q)[:3]))
                    if best is None or (score, q["pid"]) > best:
                        best = (score, q["pid"])
                    if same or not some_same:
                        break
        if best:
            out.append((p["pid"], best[1], *best[0]))
    return out


def _stars(point: DataFrame, turn: int) -> DataFrame:
    """pid, root: what is merged into what in one round. Profiles that point at one that points nowhere are merged into
    it. Further down a chain of pointers, half of the profiles at random may take in the other half, so that a chain of
    any length is gone after about the logarithm of its length in rounds."""
    up = point.select(F.col("pid").alias("parent"), F.col("parent").alias("over"))
    high = point.join(up, "parent", "left")
    ready = high.filter("over IS NULL").select("pid", "parent")
    deep = high.filter("over IS NOT NULL").join(point.select(F.col("pid").alias("over")), "over", "left_semi")
    head = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
    ready = ready.unionByName(deep.filter(~head("pid") & head("parent")).select("pid", "parent"))
    return ready.select("pid", F.col("parent").alias("root")).unionByName(ready.select(F.col("parent").alias("pid"), F.col("parent").alias("root")).distinct())


def link_names(names: DataFrame, name: str = "name", n: str = "n", lists: NameLists = LISTS) -> DataFrame:
    """(``name``, entity) of each distinct spelling that names somebody; equal entities mean the same person or
    organisation. ``n`` is how often a spelling occurs.

    A spelling listing several people stands for the first. Null, blank and placeholder spellings name nobody and have
    no row. People of one surname (a letter more, less, other or swapped allowed) are one where first initials,
    further initials and given names (nicknames, abbreviations, a typing error allowed) do not contradict; where a
    spelling fits several people the same surname, then shared initials, then the more frequent one decides. An
    empty table gives none; repeated spellings count once. Ends when a round merges nothing: each other round leaves
    fewer profiles.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [(v, k, parse_name(v, lists)) for v, k in zip(pdf["name"], pdf["n"], strict=True)]
            yield pd.DataFrame([(v, int(k), *p) for v, k, p in read if p], columns=["name", "n", "kind", "surname", "firsts", "mids", "givens"])

    counted = names.filter(F.trim(name) != "").groupBy(F.col(name).alias("name")).agg(F.sum(n).cast("bigint").alias("n"))
    parsed = cut_table(counted.mapInPandas(parse, "name string, n bigint, kind string, surname string, firsts array<string>, mids array<string>, givens array<string>"))
    signature = F.xxhash64("kind", "surname", F.concat_ws(",", "firsts"), F.concat_ws(",", "mids"), F.concat_ws(",", "givens")).cast("string")
    keyed = parsed.withColumn("pid", F.concat_ws("|", "kind", "surname", signature))
    profiles = keyed.groupBy("pid").agg(F.first("kind").alias("kind"), F.array(F.first("surname")).alias("surnames"), F.first("firsts").alias("firsts"), F.first("mids").alias("mids"), F.first("givens").alias("givens"), F.sum("n").alias("n"))
    profiles = cut_table(profiles.withColumn("fresh", F.lit(True)))
    members = cut_table(keyed.select("name", "pid"))
    release(parsed)
    turn = 0
    while True:
        turn += 1
        found = _by_group(_blocks(profiles), "block", _best_richer, "pid string, parent string, same int, mid int, r1 int, r2 int, r3 bigint")
        point = cut_table(found.groupBy("pid").agg(F.max(F.struct("same", "mid", "r1", "r2", "r3", "parent")).alias("b")).select("pid", F.col("b.parent").alias("parent")))
        stars = cut_table(_stars(point, turn))

        def merge(rows: list[dict]) -> list[tuple]:
            root, taken = _merge(rows)
            alone = [r for r in rows if r["pid"] != root["pid"] and r["pid"] not in taken]
            return [(*[root[c] for c in _FIELDS], bool(taken), taken)] + [(*[r[c] for c in _FIELDS], True, []) for r in alone]

        joined = profiles.join(stars, "pid")
        merged = cut_table(_by_group(joined.select("root", *_FIELDS), "root", merge, f"{_PROFILE}, fresh boolean, taken array<string>"))
        gone = merged.select(F.col("pid").alias("root"), F.explode("taken").alias("pid"))
        if gone.isEmpty():
            break
        others = profiles.join(stars.select("pid"), "pid", "left_anti").withColumn("fresh", F.lit(False))
        now = cut_table(members.join(gone, "pid", "left").select("name", F.coalesce("root", "pid").alias("pid"))), cut_table(others.unionByName(merged.drop("taken")))
        release(point, stars, merged, members, profiles)
        members, profiles = now
    release(point, stars, merged, profiles)
    return members.select(F.col("name").alias(name), F.col("pid").alias("entity"))


def name_pairs(linked: DataFrame, name: str = "name") -> DataFrame:
    """name_a < name_b: pairs of different spellings of one entity."""
    a, b = linked.select(F.col(name).alias("name_a"), "entity"), linked.select(F.col(name).alias("name_b"), "entity")
    return a.join(b, "entity").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
