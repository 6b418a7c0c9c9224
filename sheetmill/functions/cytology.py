"""Chromosome counts in text, as arrays of structs by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_records(text: Column) -> Column:
    """struct(n, n2, b, approximate) of a count: '2n = 46', 'n=23', '22II', '22II + 22I', '44+0-2B', 'ca. 92', '46'.

    n2 is the sporophytic number: 2n as written, twice n, two for each bivalent and one for each univalent; a bare
    number counts as 2n. b is the largest number of B chromosomes. Nulls where the text has no count.
    """
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    pairs, singles = number(r"\b(\d+) ?II\b"), number(r"\b(\d+) ?I\b(?!I)")
    twice, once = number(r"(?i)\b2 ?n ?=? ?(?:ca\.? ?|c\. ?)?(\d+)"), number(r"(?i)(?<![\d])\bn ?=? ?(?:ca\.? ?|c\. ?)?(\d+)")
    bare = number(r"^(?:ca\.? ?|c\. ?)?(\d+)(?:\+.*)?$")
    n2 = F.when(pairs.isNotNull(), 2 * pairs + F.coalesce(singles, F.lit(0))).otherwise(F.coalesce(twice, 2 * once, bare))
    b = F.coalesce(number(r"\+ ?\d+ ?[-–] ?(\d+) ?B"), number(r"\+ ?(\d+) ?B"), F.lit(0))
    return F.struct(F.coalesce(once, F.when(pairs.isNotNull() & singles.isNull(), pairs), F.when(n2 % 2 == 0, (n2 / 2).cast("int"))).alias("n"), n2.alias("n2"), F.when(n2.isNotNull(), b).alias("b"), t.rlike(r"(?i)\b(?:ca|c)\.? ?\d").cast("int").alias("approximate"))


def ploidy(n2: Column, bases: tuple[int, ...] = (22, 23)) -> Column:
    """struct(base, ploidy, odd): the base that divides the number best (the smaller of equals), how often, and whether
    the rounding left a rest."""
    options = F.array(*[F.struct(F.abs(n2 / b - F.round(n2 / b)).alias("rest"), F.lit(b).alias("base"), F.round(n2 / b).cast("int").alias("times")) for b in bases])
    best = F.array_min(options)
    return F.when(n2.isNotNull(), F.struct(best["base"].alias("base"), best["times"].alias("ploidy"), ((best["times"] % 2 == 1) | (best["rest"] > 0)).cast("int").alias("odd")))


def mentions(text: Column) -> Column:
    """Counts and genome sizes mentioned in running text, in order: '2n = 46', 'n = 23', '2C = 3.84 pg'; not plants,
    stems or measures that only look like them."""
    return F.regexp_extract_all(text, F.lit(r"(\b2n ?= ?(?:ca\. ?)?\d+\b(?! ?(?:cm|mm|m|plants?|stems?|individuals?))|(?<![\w=])n ?= ?(?:ca\. ?)?\d+\b(?! ?(?:cm|mm|m|plants?|stems?|individuals?))|\b[12]C ?= ?\d+(?:\.\d+)? ?pg)"), F.lit(1))
