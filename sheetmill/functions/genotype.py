"""Genotype cells and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def genotype_dosage(gt: Column) -> Column:
    """Share of alternative alleles of '0/1', '0|0|1|1' and the like, any ploidy; null for missing or malformed."""
    alleles = F.split(gt, r"[/|]")
    return F.when(gt.rlike(r"^\d+(?:[/|]\d+)*$"), F.size(F.filter(alleles, lambda a: a.cast("int") > 0)) / F.size(alleles))


def _count(c: Column) -> Column:
    x = F.when(~c.isin("", ".", "./.", ".|."), c.try_cast("double").try_cast("int"))
    return F.when(x >= 0, x)


def cell_depths(form: Column, cell: Column, dosage: Column) -> Column:
    """struct(n_ref, n_alt) of a cell: RO with AO, else AD as 'ref,alt,…', else AD alone as the alternative count
    with DP, else DP shared by the dosage; nulls where none of these is given."""
    keys, values = F.split(form, ":"), F.split(cell, ":")
    field = lambda k: F.get(values, F.array_position(keys, F.lit(k)).cast("int") - 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.coalesce(_count(x), F.lit(0)))
    some = lambda a: F.exists(a, lambda x: _count(x).isNotNull())
    ro, ao, ad, dp = field("RO"), F.split(field("AO"), ","), F.trim(field("AD")), _count(field("DP"))
    pair = F.split(ad, ",")
    rest = F.slice(pair, 2, F.greatest(F.size(pair) - 1, F.lit(1)))
    by_ro = _count(ro).isNotNull() & F.coalesce(some(ao), F.lit(False))
    by_pair = ad.contains(",") & _count(F.get(pair, F.lit(0))).isNotNull() & F.coalesce(some(rest), F.lit(False))
    by_one = ~ad.contains(",") & _count(ad).isNotNull()
    by_dp = (dp > 0) & dosage.isNotNull()
    shared = F.bround(dp * dosage)
    n_ref = F.when(by_ro, _count(ro)).when(by_pair, _count(F.get(pair, F.lit(0)))).when(by_one, F.coalesce(F.greatest(dp - _count(ad), F.lit(0)), F.lit(0))).when(by_dp, F.greatest(dp - shared, F.lit(0.0)))
    n_alt = F.when(by_ro, total(ao)).when(by_pair, total(rest)).when(by_one, _count(ad)).when(by_dp, shared)
    return F.struct(n_ref.cast("double").alias("n_ref"), n_alt.cast("double").alias("n_alt"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order; empty for a shorter sequence."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def iupac_alleles(base: Column) -> Column:
    """The two bases an IUPAC letter stands for, as 'AC'; null for gaps and wider codes."""
    pairs = {"A": "AA", "C": "CC", "G": "GG", "T": "TT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.upper(base))
