import os

import pytest
from pyspark.sql import functions as F

from sheetmill.operators.timestamps import normalise_timestamps, written_date

DENVER, CHICAGO = "America/Denver", "America/Chicago"
CASES = [
    # value, zone, year, month, day, result
    ("2023-02-30", DENVER, None, None, None, ""),
    ("1987-00-00", DENVER, None, None, None, "1987"),
    ("1987-05-00", DENVER, None, None, None, "1987-05"),
    ("0000-00-00", DENVER, None, None, None, ""),
    ("1982-00-27", DENVER, None, None, None, ""),
    (" 1901-04-12", None, None, None, None, "1901-04-12"),
    ("19010221", None, None, None, None, "1901-02-21"),
    ("2014/3/13", None, None, None, None, "2014-03-13"),
    ("1901-02-06/1901-02-09", None, None, None, None, "1901-02-06"),
    ("1978", None, None, None, None, "1978"),
    ("1978-04", None, None, None, None, "1978-04"),
    ("April 1901", None, None, None, None, "1901-04"),
    ("May. 9, 1934", None, None, None, None, "1934-05-09"),
    ("30 viii 2017", None, None, None, None, "2017-08-30"),
    ("10.I.1925", None, None, None, None, "1925-01-10"),
    ("31 June 2023", None, None, None, None, ""),
    ("4/9/2019", DENVER, 2019, 9, 4, "2019-09-04"),
    ("4/9/2019", DENVER, 2019, 4, 9, "2019-04-09"),
    ("4/9/2019", DENVER, None, None, None, "2019-04-09"),
    ("26/7/1965", DENVER, None, None, None, "1965-07-26"),
    ("12-Jun-18", DENVER, 1918, 6, 12, "1918-06-12"),
    ("12-Jun-18", DENVER, 2018, 6, 12, "2018-06-12"),
    ("2023-11-05 01:35", CHICAGO, None, None, None, "2023-11-05T06:35:00Z"),  # twice: the first
    ("2023-03-12 02:30", CHICAGO, None, None, None, "2023-03-12T08:30:00Z"),  # skipped: offset before the change
    ("2023-07-01 12:00", "America/Phoenix", None, None, None, "2023-07-01T19:00:00Z"),
    ("2023-07-01 12:00", None, None, None, None, "2023-07-01"),
    ("9 May 2016 12:46:10", DENVER, None, None, None, "2016-05-09T18:46:10Z"),
    ("2013-07-27T23:48:34.635Z", DENVER, None, None, None, "2013-07-27T23:48:34Z"),
    ("20060403T222000Z", DENVER, None, None, None, "2006-04-03T22:20:00Z"),
    ("2023-04-02T15:08:01-06:00", CHICAGO, None, None, None, "2023-04-02T21:08:01Z"),
    ("07/21/2011 11:30 AM CDT", DENVER, None, None, None, "2011-07-21T16:30:00Z"),
    ("01/02/2021 12:05 AM MST", DENVER, 2021, 1, 2, "2021-01-02T07:05:00Z"),
    ("01/02/2021 12:05 AM QQQ", DENVER, 2021, 1, 2, ""),
    ("2021-01-02 25:10", DENVER, None, None, None, ""),
    ("904333620", DENVER, None, None, None, "1998-08-28T19:47:00Z"),
    ("1590067560982", DENVER, None, None, None, "2020-05-21T13:26:00Z"),
    ("[illegible]", DENVER, 1990, 1, 2, ""),
    (None, DENVER, 1990, 1, 2, "1990-01-02"),
    ("  ", DENVER, 1990, 1, None, "1990-01"),
    ("", DENVER, 1990, None, None, "1990"),
    (None, DENVER, None, 5, 1, ""),
    (None, DENVER, 1990, 2, 30, ""),
    ("x" * 100_000, DENVER, None, None, None, ""),
]


def _table(spark, cases):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, raw string, zone string, year int, month int, day int, n string")


def test_cases_and_repeats(spark):
    df = _table(spark, CASES * 3)
    got = normalise_timestamps(df, "raw", "zone", "year", "month", "day").orderBy("id").collect()
    assert [(r["raw"], r["event_norm"]) for r in got] == [(c[0], c[5]) for c in CASES * 3]


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = normalise_timestamps(_table(spark, CASES), "raw", "zone", "year", "month", "day").orderBy("id").collect()
        assert [r["event_norm"] for r in got] == [c[5] for c in CASES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dictionary_is_kept_and_extended(spark, tmp_path):
    path = str(tmp_path / "book")
    first = normalise_timestamps(_table(spark, CASES[:10]), "raw", "zone", "year", "month", "day", path=path).orderBy("id").collect()
    files = len(os.listdir(path))
    again = normalise_timestamps(_table(spark, CASES), "raw", "zone", "year", "month", "day", path=path).orderBy("id").collect()
    assert [r["event_norm"] for r in first] == [c[5] for c in CASES[:10]]
    assert [r["event_norm"] for r in again] == [c[5] for c in CASES]
    assert len(os.listdir(path)) > files
    book = spark.read.parquet(path)
    assert book.count() == book.select("raw", "zone").distinct().count()


def test_empty_and_clashing_columns(spark):
    empty = normalise_timestamps(_table(spark, []), "raw", "zone", "year", "month", "day")
    assert empty.count() == 0
    assert empty.columns == ["id", "raw", "zone", "year", "month", "day", "n", "event_norm"]


@pytest.mark.parametrize(("value", "want"), [("2020-02-29", True), ("2021-02-29", False), (" 2020-02-28", False), ("0000-01-01", False), (None, False), ("2020-2-28", False)])
def test_written_date(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(written_date(F.col("v"))).first()[0] is want
