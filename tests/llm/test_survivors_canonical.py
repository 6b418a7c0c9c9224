from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sheetmill.llm.canonical import DeleteDictionary, _plain_edits, map_to_canonical
from sheetmill.llm.survivors import gathering_key, surviving_records, tier_rank


def _survivors(spark, data):
    df = spark.createDataFrame(data, "cat string, key string, tier string, a string, b double, at timestamp, first string")
    return sorted(tuple(r) for r in surviving_records(df, gathering_key(F.col("key")), "cat", tier_rank(F.col("tier")), ("a", "b"), "at", "first", "best").collect())


def test_rank_order(spark):
    t1, t2 = datetime(2020, 1, 1), datetime(2021, 1, 1)
    data = [
        ("A1", "x_1_1990-01-02", "Tier_3_Bronze", "f", 1.0, t2, ""), ("A2", "X|1|1990-1-2 ", "gold", None, None, t1, ""),  # trust first
        ("B1", "y_2_1990-01-02", "silver", " ", 1.0, t2, ""), ("B2", "y_2_1990-01-02", "SILVER", "f", 1.0, t1, ""),  # then completeness
        ("C1", "z_3a_1990-01-02", None, "f", None, t1, ""), ("C2", "z_3A_1990-01-02", "", "f", None, t2, ""), ("C3", "z_3a_1990-01-02", None, "f", None, None, ""),  # then recency
        ("D2", "w_4_1990-01-02", None, None, None, t1, ""), ("D1", "w_4_1990-01-02", None, None, None, t1, ""), ("D1", "w_4_1990-01-02", None, None, None, t1, ""),  # then the smaller
        ("E1", "v_5_1990-01-02", "gold", "f", 1.0, t1, ""), ("E1", "v_5_1990-01-02", "gold", "f", 1.0, t2, ""),  # one record only
        ("F1", None, "gold", "f", 1.0, t1, ""), ("F2", None, "gold", "f", 1.0, t1, ""), ("G1", "  ", "gold", "f", 1.0, t1, ""), (None, "w_4_1990-01-02", None, None, None, t1, ""),
    ]
    assert _survivors(spark, data) == [("A1", "A2"), ("B1", "B2"), ("C1", "C2"), ("D1", "D1")]
    assert _survivors(spark, []) == []


def test_one_group_holds_most_rows(spark):
    at = datetime(2020, 1, 1)
    df = spark.range(20_000).select(F.format_string("K%05d", "id").alias("cat"), F.when(F.col("id") < 15_000, "x_1_1990-01-02").otherwise(F.concat(F.lit("y_"), "id", F.lit("_1990-01-02"))).alias("key"), F.lit("gold").alias("tier"), F.lit("f").alias("a"), F.lit(1.0).alias("b"), F.lit(at).alias("at"))
    got = surviving_records(df, gathering_key(F.col("key")), "cat", tier_rank(F.col("tier")), ("a", "b"), "at", "first", "best")
    assert got.collect() == [("K00000", "K00000")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), max_size=25), st.text("abc", max_size=7))
def test_dictionary_finds_all_within_two_edits(words, word):
    got = {w for _, w in DeleteDictionary(words).near(word)}
    assert got == ({word} if word in words else {w for w in words if word and _plain_edits(word, w, 2) <= 2})


TAXA = [("packera gavalcernula", "Packera gavalcernula"), ("senecio gavalcernula", "Packera gavalcernula"), ("packera joskluklerosa", "Packera joskluklerosa"), ("senecio weindcasensis", "Packera joskluklerosa"), (None, "x"), ("", "y")]
PLACES = [("mount bonreiku", "mount bonreiku"), ("saint fraet", "saint fraet"), ("nivuguvey", "nivuguvey")]


@pytest.mark.parametrize("block", [2, 20_000])
def test_taxa_and_places(spark, block):
    cases = {
        "Packera gavalcernula Lusa.": 0, "Packera gavalcernula (Himus.) Mivand.": 0, "Packera gavalcernula var. x": 0, "P. gavalcernula": 0, "P.gavlacernula": 0, "gavalcernula": 0, "gavalcernula, Packera": 0,
        "Packera_gavalcernula": 0, "? Packera gavalcernula": 0, "Packera gavalcernula?": 0, "Packera cf. gavalcernula": 0, "Packera aff gavalcernula": 0, "Packera gaval.": 0, "Pacera gavalcernula": 0, "PACKERA  GAVALCERNULA": 0,
        "Senecio weindcasensis Vanvo.": 2, "S. weindcasensis": 2, "packera joskluklersoa": 2, "Packera sp.": None, "Packera": None, "indet.": None, "-": None, "sp. #2": None, "Kireilmia gavalcernulx": None, "composite, yellow rays": None, "Asteraceae indet.": None, "x" * 50_000: None,
    }
    values = spark.createDataFrame([(v, 1) for v in [*cases, *cases, None, "  "]], "v string, cost int")
    got = {r["v"]: r["canonical_value"] for r in map_to_canonical(values, "v", spark.createDataFrame(TAXA, "e string, c string"), "e", "c", "taxon", block).collect()}
    assert got == {v: "" if i is None else TAXA[i][1] for v, i in cases.items()}
    places = {"Mt. Bonreiku Co.": "mount bonreiku", "MOUNT BONREIKU COUNTY": "mount bonreiku", "Co. Nivuguvey": "nivuguvey", "Nivugvey (co.)": "nivuguvey", "St. Fraet cnty": "saint fraet", "Tratruthla": "", "unknown": "", "?": ""}
    values = spark.createDataFrame([(v,) for v in places], "v string")
    got = {r["v"]: r["canonical_value"] for r in map_to_canonical(values, "v", spark.createDataFrame(PLACES, "e string, c string"), "e", "c", "place", block).collect()}
    assert got == places


def test_empty_list(spark):
    values = spark.createDataFrame([("a",)], "v string")
    nothing = spark.createDataFrame([], "e string, c string")
    assert [tuple(r) for r in map_to_canonical(values, "v", nothing, "e", "c", "place").collect()] == [("a", "", None)]
    assert map_to_canonical(values.limit(0), "v", nothing, "e", "c", "place").count() == 0


def test_long_words_and_other_lists(spark):
    """Words of any length are compared whole; any list may be read by words; entries are read like values."""
    title = "senior vegetation survey coordinator for the northern great basin and the eastern sierra"
    entries = spark.createDataFrame([(title, "T"), ("Coca-Cola Company", "C"), ("Société Générale", "S"), ("x" * 3000, "X")], "e string, c string")
    cases = {title.replace("survey", "surevy"): "T", "COCA COLA": "C", "Company, Coca Cola": "C", "societe generale": "S", "x" * 2999 + "y": "X", "x" * 2990: "", "pepsi": "", "!": ""}
    values = spark.createDataFrame([(v,) for v in cases], "v string")
    for block in (1, 100):
        got = {r["v"]: r["canonical_value"] for r in map_to_canonical(values, "v", entries, "e", "c", "text", block, held=1, ignored=("company", "inc")).collect()}
        assert got == cases
    place = map_to_canonical(spark.createDataFrame([("Saint Clair Co.",)], "v string"), "v", spark.createDataFrame([("st. clair", "st. clair")], "e string, c string"), "e", "c", "place")
    assert place.first()["canonical_value"] == "st. clair"


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=36, max_size=60), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 59)), max_size=2))
def test_dictionary_finds_long_words(word, edits):
    typed = list(word)
    for kind, at in edits:
        i = at % (len(typed) - 1)
        if kind == 0:
            typed.insert(i, "z")
        elif kind == 1:
            del typed[i]
        elif kind == 2:
            typed[i] = "y"
        else:
            typed[i], typed[i + 1] = typed[i + 1], typed[i]
    typed = "".join(typed)
    if _plain_edits(typed, word, 2) <= 2:
        assert word in {w for _, w in DeleteDictionary({word}).near(typed)}
