"""Entities of two sources without a common key, linked by a cascade of rules.

Each rule is an exact join on a combination of attributes, from the strongest combination to the weakest; what a rule
resolves is anti-joined before the candidates of the next are formed. Weaker rules also need the place and the taxon to
agree. Records with a catalogue number are the labels: every rule is tried on them blind, and the confidence of a rule
is its precision on those of them that it resolves, with add-one smoothing.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..operators.skew import checked_join
from ..operators.timestamps import normalise_timestamps
from ..session import cut_table
from .canonical import map_kinds
from .names import parse_name
from .survivors import gathering_key

#: Degrees within which two points count as one place (a rounded coordinate is off by less).
NEAR_DEGREES = 0.03
#: What must come together for a weak rule: a near point alone, or a county with a state, or a taxon with a state.
LEAST_AGREEMENT = 1.5


_LETTERS, _DIGITS, _BETWEEN = "abcdefghijklmnopqrstuvwxyz", "0123456789", " _-–.:;,|/\\#()[]*'\""


def catalog_key(c: Column) -> Column:
    """Collection letters and the number without zeros: 'WREN_00012', 'wren 12' and 'WREN:12' are one."""
    text = F.lower(F.trim(c))
    letters, digits = F.rtrim(text, F.lit(f"{_DIGITS}{_BETWEEN}")), F.ltrim(text, F.lit(f"{_LETTERS}{_BETWEEN}"))
    number = F.ltrim(digits, F.lit("0"))
    whole = (letters != "") & (F.translate(letters, _LETTERS, "") == "") & (digits != "") & (F.translate(digits, _DIGITS, "") == "")
    return F.when(whole, F.concat(letters, F.when(number == "", "0").otherwise(number)))


def number_key(c: Column) -> Column:
    """The collector's number: digits without leading zeros and at most one letter behind; null for 's.n.' and blank."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), r"([0-9]+ ?[a-z]?)$", 1), r"^0+| ", ""), F.lit(""))


@F.pandas_udf(StringType())
def surname_key(values: pd.Series) -> pd.Series:
    """The folded surname (or first word of an organisation) of the first name listed; null for nobody."""
    read = {v: parse_name(v) for v in values.dropna().unique()}
    return values.map(lambda v: read[v][1] if isinstance(v, str) and read[v] else None)


def read_sources(vouchers: DataFrame, samples: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheets, samples) as link_samples takes them.

    Sheets: catalogNumber, catalog, gathering, surname, number, date, lat, lon, county, state, taxon. The gathering is
    the normalised exsiccatae_key; of a sheet without one it is made of the sheet's own collector, number and local date,
    and a sheet that lacks one of these is a gathering of its own. Samples: sample, catalog, pair, surname, number, date, the surname start and number
    within the id (id_surname, id_number), lat, lon, county, state, taxon of each distinct delivery. ``zones``:
    state_key, state_norm, zone_name. Free fields of both sources are read in one pass.
    """
    parts = r"^[^_]+_.*_\d{4}-\d{2}-\d{2}$"
    state_key = lambda c: F.lower(F.trim(c)).alias("state_key")
    lat, lon = F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon")
    v = vouchers.filter(F.col("catalogNumber").isNotNull()).select(
        F.lit("sheet").alias("side"), F.col("catalogNumber").alias("id"), "catalogNumber", F.lit(None).cast("string").alias("pair"), F.col("recordedBy").alias("person"), F.col("recordNumber").alias("written"),
        "eventDate", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), F.col("day").cast("int").alias("day"), lat, lon, "county", F.col("species_raw").alias("taxon"),
        state_key("stateProvince"), gathering_key(F.col("exsiccatae_key")).alias("key"),
    )
    nothing = lambda t, name: F.lit(None).cast(t).alias(name)
    s = samples.filter(F.col("genetic_sample_id").isNotNull()).select(
        F.lit("sample").alias("side"), F.col("genetic_sample_id").alias("id"), "catalogNumber", F.col("replicate_pair_id").alias("pair"), F.col("collector").alias("person"), F.col("collector_number").alias("written"),
        "eventDate", nothing("int", "year"), nothing("int", "month"), nothing("int", "day"), lat, lon, "county", F.col("taxon_raw").alias("taxon"), state_key("stateProvince"), nothing("string", "key"),
    )
    # written once: the key's patterns are matched once a row, not once for each column made of it
    both = cut_table(v.unionByName(s).withColumn("key", F.regexp_extract("key", parts, 0)).join(zones, "state_key", "left")).withColumn("key", F.nullif("key", F.lit("")))
    surname, date = F.substring_index("key", "_", 1), F.right(F.col("key"), F.lit(10))
    number = F.substring(F.col("key"), F.length(surname) + 2, F.length("key") - F.length(surname) - 12)
    place = ["lat", "lon", "county", F.coalesce("state_norm", "state_key").alias("state"), "taxon"]
    keyed = both.filter(F.col("key").isNotNull()).select(
        F.col("id").alias("catalogNumber"), catalog_key(F.col("catalogNumber")).alias("catalog"), F.col("key").alias("gathering"), surname.alias("surname"),
        F.when(number.rlike("^[0-9]+[a-z]?$"), number).alias("number"), date.alias("date"), *place,
    )
    free = normalise_timestamps(both.filter(F.col("key").isNull()), "eventDate", "zone_name", "year", "month", "day", "event_norm")
    moment = F.col("event_norm").substr(1, 19).try_cast("timestamp_ntz")
    local = F.when(F.length("event_norm") == 20, F.convert_timezone(F.lit("UTC"), F.coalesce("zone_name", F.lit("UTC")), moment))
    given = F.when(F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("day").isNotNull(), F.format_string("%04d-%02d-%02d", "year", "month", "day"))
    date = F.coalesce(given, F.date_format(local, "yyyy-MM-dd"), F.when(F.length("event_norm") == 10, F.col("event_norm")))
    free = cut_table(free.select("side", "id", "pair", catalog_key(F.col("catalogNumber")).alias("catalog"), surname_key("person").alias("surname"), number_key(F.col("written")).alias("number"), date.alias("date"), *place))
    shared = ["catalog", "surname", "number", "date", "lat", "lon", "county", "state", "taxon"]
    made = F.coalesce(F.concat("surname", F.lit("_"), "number", F.lit("_"), "date"), F.concat(F.lit("sheet "), "id"))
    bare = free.filter("side = 'sheet'").select(F.col("id").alias("catalogNumber"), made.alias("gathering"), *shared)
    coded = r"^[A-Z]+-([A-Z]+?)([0-9]+[A-Z]?)-[0-9]+$"
    own = F.col("id").rlike(coded)
    out = free.filter("side = 'sample'").select(
        F.col("id").alias("sample"), "pair", F.when(own, F.lower(F.regexp_extract("id", coded, 1))).alias("id_surname"), F.when(own, F.regexp_replace(F.lower(F.regexp_extract("id", coded, 2)), "^0+", "")).alias("id_number"), *shared,
    ).distinct()
    # a coordinate of zero twice is none
    spot = lambda c: F.when(~((F.col("lat") == 0) & (F.col("lon") == 0)), F.col(c))
    sheets = keyed.unionByName(bare)
    return sheets.select(*[c for c in sheets.columns if c not in ("lat", "lon")], spot("lat").alias("lat"), spot("lon").alias("lon")), out


PLACE = ("lat", "lon", "county", "state", "taxon")
THEIRS = tuple(f"s_{c}" for c in PLACE)


def _masked(number: Column) -> Column:
    """The number and, for each of its characters, the number with that one masked: two numbers with a common entry
    are equal or of one length with one character different."""
    spots = F.sequence(F.lit(1), F.length(number))
    return F.concat(F.array(number), F.transform(spots, lambda i: F.concat(F.substring(number, F.lit(1), i - 1), F.lit("?"), F.substring(number, i + 1, F.length(number)))))


def _stems(surname: Column) -> Column:
    """The surname and all strings left after deleting one letter of it."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(surname)), lambda i: F.concat(F.substring(surname, F.lit(1), i - 1), F.substring(surname, i + 1, F.length(surname))))
    return F.array_distinct(F.concat(F.array(surname), cuts))


def _meant(rows: list[DataFrame], lists: dict[str, tuple[DataFrame, str]]) -> list[DataFrame]:
    """``rows`` with the columns of ``lists`` replaced by what they mean of their list (null: none of it); every distinct
    value of all of them is looked up once, in one pass."""
    typed = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in lists])).alias("v")
    values = reduce(DataFrame.unionByName, [r.select(typed).select("v.*") for r in rows]).filter("value IS NOT NULL")
    counts = cut_table(values.groupBy("field", "value").agg(F.count("*").alias("n")))
    norm = map_kinds(counts, lists).select("field", "value", F.nullif("canonical_value", F.lit("")).alias("norm"))
    book = cut_table(counts.join(norm, ["field", "value"]))
    sizes = {r["field"]: (r["rows"], r["total"]) for r in book.groupBy("field").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).collect()}  # one row a field
    for c in lists:
        counted, total = sizes.get(c, (0, 0))
        one = book.filter(F.col("field") == c).select(F.col("value").alias(c), "norm", "n")
        rows = [checked_join(r, one, [c], "left", "n", total, counted=counted).drop(c).withColumnRenamed("norm", c) for r in rows]
    return rows


def _score() -> Column:
    """How far place and taxon of a sample (columns s_...) and a sheet agree. A near point weighs 4 (a lost sign or
    swapped coordinates count as near), a same county 2.5, a same taxon 1.5 and a same state 0.5; a far point takes
    0.5, another county 2, another taxon 1 and another state 3. What is missing weighs nothing."""

    def weigh(c: str, same: float, other: float) -> Column:
        return F.when(F.col(c) == F.col(f"s_{c}"), same).when(F.col(c) != F.col(f"s_{c}"), -other).otherwise(0.0)

    def close(lat: Column, lon: Column) -> Column:
        return (F.abs(lat - F.col("s_lat")) <= NEAR_DEGREES) & (F.abs(lon - F.col("s_lon")) <= NEAR_DEGREES)

    lat, lon = F.col("lat"), F.col("lon")
    near = close(lat, lon) | close(lat, -lon) | close(-lat, lon) | close(lon, lat)
    return F.when(near, 4.0).when(~near, -0.5).otherwise(0.0) + weigh("county", 2.5, 2.0) + weigh("taxon", 1.5, 1.0) + weigh("state", 0.5, 3.0)


def _met(samples: DataFrame, sheets: DataFrame, on: list[str], least: float | None = LEAST_AGREEMENT, where: Column | None = None, key: str = "sample") -> DataFrame:
    """``key``, score, gathering: for each sample (or class of samples) the gathering that agrees best of those it meets
    on the columns ``on``, the smaller of equals; at least ``least``."""
    pairs = samples.dropna(subset=on).join(sheets.dropna(subset=on), on)
    pairs = (pairs if where is None else pairs.filter(where)).select(key, "gathering", _score().alias("score"))
    if least is not None:
        pairs = pairs.filter(F.col("score") >= least)
    return _best(pairs, key)


def _best(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "gathering")).alias("b")).select(key, (-F.col("b.s")).alias("score"), "b.gathering")


def candidates_of_rule(rule: int, rest: DataFrame, known: DataFrame) -> DataFrame:
    """sample, score, gathering: what one of the rules 2 to 7 finds for the samples of ``rest``, see link_samples."""
    mine, place = ["sample", *THEIRS], ["gathering", *PLACE]
    if rule == 2:
        on = ["surname", "number", "date"]
        return _met(rest.select(*on, *mine), known.select(*on, *place), on, None)
    if rule == 3:
        start = lambda c: F.substring(c, 1, 2).alias("start")
        coded = rest.filter("length(id_surname) >= 2").select(start("id_surname"), "id_surname", F.col("id_number").alias("number"), *mine)
        begun = F.col("surname").startswith(F.col("id_surname")) | F.col("id_surname").startswith(F.col("surname"))
        return _met(coded, known.filter("length(surname) >= 2").select(start("surname"), "surname", "number", *place), ["start", "number"], where=begun)
    if rule == 4:
        return _on_day(rest.dropna(subset=["surname", "date"]).select("surname", "date", "number", *mine), known)
    if rule in (5, 6):  # sheets without a collector or date are gatherings of their own: equal places are one class
        on, missing = (["number", "date"], "surname") if rule == 5 else (["surname", "number"], "date")
        classes = known.filter(F.col(missing).isNull()).dropna(subset=on).groupBy(*on, *PLACE).agg(F.min("gathering").alias("gathering"))
        return _met(rest.select(*on, *mine), classes, on)
    on = ["surname", "number", "date"]
    open_ = rest.filter("length(surname) >= 2").dropna(subset=on).select(*on, *mine)
    same = known.filter("length(surname) >= 2").select(*on, *place).join(open_.select("number", "date").distinct(), ["number", "date"], "left_semi")
    stem = lambda df: df.withColumn("stem", F.explode(_stems(F.col("surname")))).drop("surname")
    return _met(stem(open_), stem(same), ["stem", "number", "date"])


def _on_day(rest: DataFrame, known: DataFrame) -> DataFrame:
    """Rule 4. Gatherings of a collector's day that differ in nothing but what the sample lacks are one class, as are
    samples that differ in nothing but their id, so a day of very many sheets or samples meets its distinct places."""
    on = ["surname", "date", "mask"]
    days = known.dropna(subset=["surname", "date"]).join(rest.select("surname", "date").distinct(), ["surname", "date"], "left_semi")
    numbers = F.when(F.col("number").isNotNull(), _masked(F.col("number")))
    days = days.withColumn("mask", F.explode(F.concat(F.array(F.lit("")), F.coalesce(numbers, F.array().cast("array<string>")))))
    days = days.groupBy(*on, *PLACE).agg(F.min("gathering").alias("gathering"))
    masks = rest.withColumn("mask", F.explode(F.coalesce(numbers, F.array(F.lit(""))))).drop("number")
    shape = [F.col(c) for c in (*on, *THEIRS)]
    masks = masks.withColumn("class", F.concat_ws(" ", F.xxhash64(*shape), F.xxhash64(F.lit(1), *shape)))
    found = _met(masks.drop("sample").dropDuplicates(["class"]), days, on, key="class")
    return _best(masks.select("sample", "class").join(found, "class"), "sample")


def link_samples(samples: DataFrame, sheets: DataFrame, counties: DataFrame, taxa: DataFrame) -> DataFrame:
    """sample, gathering, rule, confidence: the gathering each sample was taken from; ``samples`` and ``sheets`` as
    read_sources gives them.

    Rules: 1 catalogue number; 2 surname, number and date; 3 surname and number within the sample's id (one surname may
    be cut off); 4 surname and date with the number missing or one character off; 5 number and date where the sheet
    names no collector; 6 surname and number where the sheet has no date; 7 number and date with a surname one letter
    off; 8 what the replicate of the sample resolved to. Rules 3 to 7 need LEAST_AGREEMENT of place and taxon; the best
    agreement wins, then the smaller gathering. Where a catalogue number stands for several gatherings, the one whose
    surname, number and date agree most counts. Nulls never match; samples without any match have no row; repeated
    deliveries of a sample count together; empty tables give no row.

    A pass forms candidates only for what no pass before it has resolved. Samples with a catalogue number are the
    labels: each of the passes 2 to 7 is tried on them as if they had none, which measures it (see _precision; pass 4
    without their number); their own result is that of rule 1. Candidates come from exact joins on at least two attributes;
    equal places of one combination are one class before the join.
    """
    keys = ["surname", "number", "date"]
    samples = cut_table(samples)
    agree = sum((F.coalesce((F.col(f"m_{c}") == F.col(c)).cast("double"), F.lit(0.0)) for c in keys), F.lit(0.0))
    labelled = samples.filter("catalog IS NOT NULL").select("sample", "catalog", *[F.col(c).alias(f"m_{c}") for c in keys])
    labels = cut_table(_best(labelled.join(sheets.select("catalog", "gathering", *keys), "catalog").select("sample", "gathering", agree.alias("score")), "sample").select("sample", "gathering", F.lit(1).alias("rule")))

    listed = lambda df, entry, meant: df.select(F.col(entry).alias("entry"), F.col(meant).alias("meant"))
    lists = {"county": (listed(counties, "county_norm", "county_norm"), "place"), "taxon": (listed(taxa, "raw_name_lower", "canonical_packera"), "taxon")}
    mine, theirs = _meant([samples, sheets], lists)
    known = cut_table(theirs.select("gathering", *keys, F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "county", "state", "taxon").distinct())
    samples = mine.select("sample", "pair", *keys, "id_surname", "id_number", *[F.col(c).alias(s) for c, s in zip(PLACE, THEIRS, strict=True)]).distinct()
    # labelled samples are tested by every rule; all others go on only while no pass has resolved them
    samples = cut_table(samples.join(labels.select("sample", F.lit(True).alias("tested")), "sample", "left"))
    blind, rest = None, samples
    for rule in range(2, 8):
        if rule == 4:  # what the rule says where the number is missing
            rest = rest.withColumn("number", F.when(F.col("tested").isNull(), F.col("number")))
        found = cut_table(candidates_of_rule(rule, rest, known).select("sample", "gathering", F.lit(rule).alias("rule")))
        blind = found if blind is None else blind.unionByName(found)
        rest = samples.filter("tested IS NULL").join(blind.select("sample"), "sample", "left_anti").unionByName(samples.filter("tested"))
    resolved = labels.unionByName(blind.join(labels.select("sample"), "sample", "left_anti"))

    pairs = samples.filter(F.trim("pair") != "").select("sample", "pair").distinct()
    told = pairs.join(resolved, "sample").select("pair", F.col("sample").alias("by"), F.struct("rule", "gathering").alias("b"))
    # the two best of a pair are enough to leave out the sample itself
    order = Window.partitionBy("pair").orderBy("b", "by")
    told = told.withColumn("rn", F.row_number().over(order)).filter("rn <= 2").drop("rn")
    twin = pairs.join(told, "pair").filter(F.col("sample") != F.col("by")).groupBy("sample").agg(F.min("b").alias("b"))
    twin = cut_table(twin.select("sample", "b.gathering", F.lit(8).alias("rule")))
    precision = _precision(labels, blind, twin)
    every = resolved.unionByName(twin.join(resolved.select("sample"), "sample", "left_anti"))
    return every.join(F.broadcast(precision), "rule", "left").select("sample", "gathering", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def _precision(labels: DataFrame, blind: DataFrame, twin: DataFrame) -> DataFrame:
    """rule, confidence of the eight rules: (right + 1) / (n + 2). Rules 2 to 7 are judged by the labelled samples they
    resolve blind, rule 8 by the labelled samples whose replicate is resolved, and rule 1, the label itself, by how
    often the strongest other rule, 2, confirms it."""
    label = labels.select("sample", F.col("gathering").alias("label"))
    judged = blind.unionByName(twin).join(label, "sample").groupBy("rule").agg(F.sum((F.col("gathering") == F.col("label")).cast("bigint")).alias("right"), F.count("*").alias("n"))
    judged = judged.withColumn("rule", F.explode(F.when(F.col("rule") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array("rule"))))
    return judged.select("rule", ((F.col("right") + 1) / (F.col("n") + 2)).alias("confidence"))
