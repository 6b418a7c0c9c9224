from datetime import datetime

from sheetmill.operators.references import Reference, orphan_references, orphans_by_period

AT = datetime(2022, 3, 5)


def _leaves(spark, data):
    return spark.createDataFrame(data, "leaf long, cat string, pid int, at timestamp, k1 string")


def _references(spark, leaves, sheets, plants):
    return [
        Reference("leaves", leaves, "leaf", ("cat",), "sheets", sheets, ("cat",), "at"),
        Reference("leaves", leaves, "leaf", ("cat", "pid"), "plants", plants, ("cat", "pid"), "at"),
    ]


def test_orphans_nulls_repeats_and_hot_keys(spark, rows):
    data = [(i, "hot", 0, AT, "x") for i in range(300)] + [(i, "gone", 1, AT, "x") for i in range(300, 600)]
    data += [(700, "A", 0, AT, None), (701, "a", 0, AT, None), (702, None, 0, AT, None), (703, "A", None, AT, None), (704, "A", 9, None, None), (700, "A", 0, AT, None)]
    sheets = spark.createDataFrame([("hot", 1), ("A", 2), ("A", 3), (None, 4)], "cat string, record_id int")
    plants = spark.createDataFrame([("hot", 0), ("A", 0)], "cat string, pid int")
    refs = _references(spark, _leaves(spark, data), sheets, plants)
    want = sorted(
        [("leaves", i, t, "2022-03") for i in range(300, 600) for t in ("sheets", "plants")]
        + [("leaves", 701, "sheets", "2022-03"), ("leaves", 701, "plants", "2022-03"), ("leaves", 704, "plants", None)],
        key=repr,
    )
    for share in (1 / 1000, 0.3, 1.0):  # all keys hot, some, none
        assert rows(orphan_references(refs, share)) == want
    counted = {(r[1], r[2]): r[3] for r in orphans_by_period(refs).collect()}
    assert counted == {("sheets", "2022-03"): 301, ("plants", "2022-03"): 301, ("plants", None): 1}


def test_empty_tables(spark, rows):
    none = _leaves(spark, [])
    sheets = spark.createDataFrame([], "cat string")
    plants = spark.createDataFrame([], "cat string, pid int")
    assert rows(orphan_references(_references(spark, none, sheets, plants))) == []
    one = _leaves(spark, [(1, "A", 2, AT, "")])
    assert len(rows(orphan_references(_references(spark, one, sheets, plants)))) == 2
