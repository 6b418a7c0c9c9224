"""Mixed timestamp notations, precisions and zones, brought to one unambiguous form.

Distinct raw strings with their zone make a dictionary; each entry is parsed once, by JVM-side expressions only, into
a notation and its parts; rows then look their entry up. What an entry alone leaves open (the century of a two-digit
year, the order of day and month) is settled per row by the year, month and day beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .skew import left_lookup

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
#: Abbreviated zones, in minutes from UTC.
ZONE_MINUTES = {
    "utc": 0, "gmt": 0, "z": 0, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_TIME = r"(?:[ t]+(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?(?: *([ap])\.?m\.?)?(?: *(z|[a-z]{3,4}|[+-]\d{2}:?\d{2}|[+-]\d{2}))?)?"
#: name, pattern over the trimmed lower-case value (a span is cut to its first day), and what its groups are.
_MONTH = r"([a-z]{1,9})\.?"
NOTATIONS = (
    ("ymd", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$", ("y", "m", "d")),
    ("basic", r"^(\d{4})(\d{2})(\d{2})" + _TIME + "$", ("y", "m", "d")),
    ("ab", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}),?" + _TIME + "$", ("a", "b", "y")),
    ("ab2", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2}),?" + _TIME + "$", ("a", "b", "yy")),
    ("dmony", r"^(\d{1,2})(?:st|nd|rd|th)?[-/. ]+" + _MONTH + r"[-/. ,]*(\d{4}),?" + _TIME + "$", ("d", "mon", "y")),
    ("dmonyy", r"^(\d{1,2})[-/. ]+" + _MONTH + r"[-/. ,]+'?(\d{2}),?" + _TIME + "$", ("d", "mon", "yy")),
    ("mondy", "^" + _MONTH + r"[-/. ]*(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4}),?" + _TIME + "$", ("mon", "d", "y")),
    ("ymond", r"^(\d{4})[-/. ]+" + _MONTH + r"[-/. ]+(\d{1,2})" + _TIME + "$", ("y", "mon", "d")),
    ("mony", "^" + _MONTH + r"[-/., ]*(\d{4})$", ("mon", "y")),
    ("ym", r"^(\d{4})[-/.](\d{1,2})$", ("y", "m")),
    ("y", r"^(\d{4})$", ("y",)),
)
_FIELDS = ("a", "b", "d", "m", "mon", "y", "yy")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _month_number(word: Column) -> Column:
    """1 to 12 for an English month (three letters or more of it) or a Roman numeral, else null."""
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    out = reduce(lambda acc, i: acc.when(word == ROMAN[i], i + 1), range(12), F.when(F.lit(False), 0))
    for i, name in enumerate(full):
        out = out.when((F.length(word) >= 3) & F.lit(name).startswith(word), i + 1)
    return out.when(word == "sept", 9)


def _offset_minutes(zone: Column) -> Column:
    named = F.create_map(*[F.lit(x) for k, v in ZONE_MINUTES.items() for x in (k, v)])
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    return F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(named, zone))


def parse_dictionary(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """Each raw value's notation and parts, null where it doesn't have them: kind, a, b, d, m, y, yy, secs (of the
    day), off (minutes from UTC), epoch (seconds), broken (a time or zone was given that doesn't exist)."""
    text = F.lower(F.trim(F.regexp_replace(F.col(raw), r"[\s ]+", " ")))
    first = F.when(text.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?/\d"), F.substring_index(text, "/", 1)).when(
        text.rlike(r"^.*\d{4} *(?:-|–|to) *\d{1,2} .*\d{4}$"), F.trim(F.regexp_replace(text, r" *(?:-|–|to) *\d{1,2} .*$", ""))
    ).otherwise(text)
    df = entries.withColumn("__t", first)
    kind = F.when(F.col("__t").rlike(r"^-?\d{9,10}$"), "epoch_s").when(F.col("__t").rlike(r"^-?\d{11,13}$"), "epoch_ms")
    for name, pattern, _ in NOTATIONS:
        kind = kind.when(F.col("__t").rlike(pattern), name)
    df = df.withColumn("kind", kind)
    t, k = F.col("__t"), F.col("kind")

    def part(of: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern, groups in NOTATIONS:
            if of in groups:
                out = out.when(k == name, F.regexp_extract(t, pattern, groups.index(of) + 1))
        return out

    def clock(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern, groups in NOTATIONS:
            if pattern.endswith(_TIME + "$"):
                out = out.when(k == name, F.regexp_extract(t, pattern, len(groups) + i))
        return F.nullif(out, F.lit(""))

    df = df.withColumns({f"__{g}": part(g) for g in _FIELDS} | {f"__c{i}": clock(i) for i in range(1, 6)})
    hour, minute, second = (F.col(f"__c{i}").try_cast("int") for i in (1, 2, 3))
    half = F.col("__c4")
    hour = F.when(half.isNull(), hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.coalesce(second, F.lit(0))
    timed = F.col("__c1").isNotNull()
    secs = F.when(timed & (hour < 24) & (minute < 60) & (second < 60), hour * 3600 + minute * 60 + second)
    off = _offset_minutes(F.col("__c5"))
    epoch = F.when(k == "epoch_s", t.try_cast("bigint")).when(k == "epoch_ms", F.floor(t.try_cast("bigint") / 1000))
    return df.select(
        *entries.columns, "kind", *[F.col(f"__{g}").try_cast("int").alias(g) for g in ("a", "b", "d", "y", "yy")],
        F.coalesce(F.col("__m").try_cast("int"), _month_number(F.col("__mon"))).alias("m"), secs.alias("secs"), off.alias("off"), epoch.cast("bigint").alias("epoch"),
        ((timed & secs.isNull()) | (F.col("__c5").isNotNull() & off.isNull())).alias("broken"),
    )


def extend_dictionary(spark: SparkSession, path: str, entries: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Parse the entries that the dictionary in ``path`` doesn't hold yet, append them to it, and return all of it.
    So each distinct value is parsed once, in whichever run it first appears."""
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(probe)
    fresh = entries.select(*keys).distinct()
    if there:
        known = spark.read.parquet(path).select(*keys)
        fresh = fresh.join(known, [fresh[c].eqNullSafe(known[c]) for c in keys], "left_anti")
    parse_dictionary(fresh, raw).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, null where there is none (year 0 included)."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((y >= 1) & (y <= 9999) & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))


def _iso(instant: Column) -> Column:
    """'YYYY-MM-DDTHH:MM:SSZ' of a timestamp without zone."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalise_timestamps(
    rows: DataFrame, raw: str, zone: str, year: str, month: str, day: str, out: str = "event_norm", path: str | None = None, newest: int | None = None
) -> DataFrame:
    """``rows`` with ``out``: 'YYYY-MM-DDTHH:MM:SSZ' in UTC where a time of day is given, else 'YYYY-MM-DD', 'YYYY-MM'
    or 'YYYY' as far as the value goes, '' where it gives no valid date.

    ``zone`` is the row's time zone for times without one; where it is null such a time counts as its date alone.
    A local time that occurs twice is the first, one skipped uses the offset before the change. A span counts by its
    first day. ``year``, ``month``, ``day`` decide an open century or order (with them null: the century that makes
    the year at most ``newest``, by default the current one, and month before day) and stand in for a blank value. ``path``: a folder that
    keeps the dictionary between runs; without it the dictionary lives in the shared checkpoint folder for this run.
    Blank values beside a null year give ''. Rows are neither dropped nor repeated; an empty table stays empty. No
    other column is read, and the result's working columns start with two underscores.
    """
    spark = rows.sparkSession
    text = F.col(raw)
    # blank values get keys of their own, so they neither meet the dictionary nor gather in one task
    own_key = F.concat(F.lit(" "), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))
    given = rows.withColumns({"__zone": F.col(zone), "__z": F.coalesce(F.col(zone), F.lit("")), "__raw": F.when(_blank(text), own_key).otherwise(text)})
    entries = rows.filter(~_blank(text)).groupBy(text.alias("raw"), F.col(zone).alias("zone")).agg(F.count("*").alias("n"))
    if path is None:
        book = cut(_resolved(parse_dictionary(entries)))
    else:
        entries = cut(entries)
        known = extend_dictionary(spark, path, entries, ["raw", "zone"])
        book = cut(_resolved(known.join(entries.withColumnsRenamed({"raw": "r", "zone": "o"}), F.col("raw").eqNullSafe(F.col("r")) & F.col("zone").eqNullSafe(F.col("o"))).drop("r", "o")))
    total = book.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    book = book.select(F.col("raw").alias("__raw"), F.coalesce("zone", F.lit("")).alias("__z"), "n", F.struct(*[c for c in book.columns if c not in ("raw", "zone", "n")]).alias("__p"))
    joined = left_lookup(given, book.withColumnRenamed("n", "__n"), ["__raw", "__z"], "__n", total)
    y, m, d = F.col(year).cast("int"), F.col(month).cast("int"), F.col(day).cast("int")
    p = lambda c: F.col(f"__p.{c}")
    two = p("yy")
    latest = F.year(F.current_date()) if newest is None else F.lit(newest)
    century = latest - F.pmod(latest, F.lit(100))
    near = F.when(F.pmod(y, F.lit(100)) == two, y).otherwise(F.when(century + two <= latest, century + two).otherwise(century + two - 100))
    the_year = F.when(p("yy").isNotNull(), near).otherwise(p("y"))
    a, b = p("a"), p("b")
    day_first = F.when(a > 12, True).when(b > 12, False).when((a == m) & (b == d), False).when((a == d) & (b == m), True).when((a == m) | (b == d), False).when((a == d) | (b == m), True).otherwise(False)
    the_month = F.when(a.isNotNull(), F.when(day_first, b).otherwise(a)).otherwise(p("m"))
    the_day = F.when(a.isNotNull(), F.when(day_first, a).otherwise(b)).otherwise(p("d"))
    open_date = _date(the_year, the_month, the_day)
    late = _precise(open_date, p("secs"), p("off"), F.col("__zone"))
    value = (
        F.when(p("done").isNotNull(), p("done"))
        .when(open_date.isNull() | p("broken"), "")
        .otherwise(F.coalesce(late, F.date_format(open_date, "yyyy-MM-dd")))
    )
    stand_in = (
        F.when(y.isNull() | (y < 1) | (y > 9999), "")
        .when(m.isNull(), F.format_string("%04d", y))
        .when(~m.between(1, 12), "")
        .when(d.isNull(), F.format_string("%04d-%02d", y, m))
        .otherwise(F.coalesce(F.date_format(_date(y, m, d), "yyyy-MM-dd"), F.lit("")))
    )
    result = joined.withColumn(out, F.when(_blank(F.col(raw)), stand_in).otherwise(F.coalesce(value, F.lit(""))))
    return result.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], out)


def _precise(date: Column, secs: Column, off: Column, zone: Column) -> Column:
    """The UTC form of a local date and second of the day, null without a time or without any zone."""
    local = F.timestamp_add("SECOND", secs, date.cast("timestamp_ntz"))
    by_offset = F.timestamp_add("MINUTE", -off, local)
    by_zone = F.convert_timezone(zone, F.lit("UTC"), local)
    return F.when(secs.isNotNull() & off.isNotNull(), _iso(by_offset)).when(secs.isNotNull() & zone.isNotNull(), _iso(by_zone))


def _resolved(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``done``: the final form of an entry that leaves nothing open, null of one that does."""
    y, m, d, k = F.col("y"), F.col("m"), F.col("d"), F.col("kind")
    date = _date(y, m, d)
    full = F.coalesce(_precise(date, F.col("secs"), F.col("off"), F.col("zone")), F.date_format(date, "yyyy-MM-dd"), F.lit(""))
    year = F.when((y >= 1) & (y <= 9999), F.format_string("%04d", y)).otherwise("")
    year_month = F.when((year != "") & m.between(1, 12), F.format_string("%04d-%02d", y, m)).otherwise("")
    epoch = _iso(F.timestamp_add("SECOND", F.col("epoch"), F.lit("1970-01-01").cast("timestamp_ntz")))
    done = (
        F.when(k.isNull() | F.col("broken"), "")
        .when(k.isin("epoch_s", "epoch_ms"), epoch)
        .when(k == "y", year)
        .when(k.isin("ym", "mony"), F.when(m == 0, "").otherwise(year_month))
        .when(k.isin("ymd") & (m == 0) & (d == 0), year)
        .when(k.isin("ymd") & (d == 0), year_month)
        .when(k.isin("ab", "ab2", "dmonyy"), None)
        .otherwise(full)
    )
    return parsed.withColumn("done", done)


def written_date(c: Column) -> Column:
    """Whether the value is a valid date written exactly YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.substring(c, 1, 4) != "0000") & c.try_cast("date").isNotNull(), F.lit(False))
