import sheetmill.llm.linkage as linkage
from sheetmill.llm.linkage import link_samples

SAMPLE = "sample string, catalog string, pair string, surname string, number string, date string, id_surname string, id_number string, lat double, lon double, county string, state string, taxon string"
SHEET = "catalogNumber string, catalog string, gathering string, surname string, number string, date string, lat double, lon double, county string, state string, taxon string"


def _link(spark, samples, sheets):
    counties = spark.createDataFrame([("alder",), ("birch",)], "county_norm string")
    taxa = spark.createDataFrame([("packera una", "Packera una"), ("packera duo", "Packera duo")], "raw_name_lower string, canonical_packera string")
    out = link_samples(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(sheets, SHEET), counties, taxa).collect()
    assert len(out) == len({r["sample"] for r in out}) and all(0 < r["confidence"] < 1 for r in out)
    return {r["sample"]: (r["gathering"], r["rule"]) for r in out}


def test_cascade(spark):
    day = "1990-05-06"
    sheets = [
        ("A-1", "a1", "g1", "tompuenko", "17", day, 40.0, -110.0, "Alder", "kestrel", "Packera una"), ("A-2", "a2", "g1", "tompuenko", "17", day, None, None, None, "kestrel", None),
        ("B-1", "b1", "g2", "tompuenko", "18", day, 42.0, -115.0, "Birch", "kestrel", "Packera duo"), ("C-1", "c1", "g3", None, "55", day, 41.0, -111.0, "Alder", "kestrel", "Packera una"),
        ("D-1", "d1", "g4", "nutolt", "7", None, 39.0, -112.0, "Birch", "kestrel", "Packera duo"), (None, None, "g5", None, None, None, None, None, None, None, None),
    ]
    samples = [
        ("s1", "a2", None, None, None, None, None, None, None, None, None, None, None), ("s2", None, None, "tompuenko", "17", day, None, None, None, None, None, None, None),
        ("s3", None, None, None, None, None, "tompu", "18", 42.001, -115.0, None, None, None), ("s4", None, None, "tompuenko", None, day, None, None, 40.001, -110.0, "Alder Co.", "kestrel", "P. una"),
        ("s5", None, None, "tompuenko", "27", day, None, None, 40.001, -110.0, None, None, None), ("s6", None, None, "other", "55", day, None, None, 41.0, -111.0, None, None, None),
        ("s7", None, None, "nutolt", "7", "1991-01-01", None, None, 39.0, -112.0, None, None, None), ("s8", None, None, "tompunko", "17", day, None, None, None, None, "alder", "kestrel", None),
        ("s9", None, "P1", None, None, None, None, None, None, None, None, None, None), ("s10", "a1", "P1", None, None, None, None, None, None, None, None, None, None),
        ("n1", "x9", None, "nobody", "1", day, None, None, None, None, None, None, None), ("n2", None, None, "tompuenko", None, day, None, None, 30.0, -100.0, "Birch", "other", "Packera duo"),
        ("n3", None, None, None, None, None, None, None, None, None, None, None, None), ("s2", None, None, "tompuenko", "17", day, None, None, None, None, None, None, None),
    ]
    want = {"s1": ("g1", 1), "s2": ("g1", 2), "s3": ("g2", 3), "s4": ("g1", 4), "s5": ("g1", 4), "s6": ("g3", 5), "s7": ("g4", 6), "s8": ("g1", 7), "s9": ("g1", 8), "s10": ("g1", 1)}
    assert _link(spark, samples, sheets) == want
    assert _link(spark, [], sheets) == {} and _link(spark, samples, []) == {}


def test_settled_samples_form_no_candidates_and_hot_days(spark, monkeypatch):
    """A sample settled by rule 2 is in no later pass; a third of all rows on one collector's day meet as classes."""
    asked = {}
    real = linkage.candidates_of_rule

    def watched(rule, rest, known):
        asked[rule] = {r["sample"] for r in rest.select("sample").collect()}
        return real(rule, rest, known)

    monkeypatch.setattr(linkage, "candidates_of_rule", watched)
    day, n = "1990-05-06", 3000
    sheets = [(f"H-{i}", f"h{i}", f"hot_{i:05d}_{day}", "hot", str(i + 10_000), day, 40.0, -110.0, "Alder", "kestrel", "Packera una") for i in range(n)]
    sheets += [("A-1", "a1", "g1", "tompuenko", "17", day, 40.0, -110.0, "Alder", "kestrel", "Packera una")]
    samples = [("s2", None, None, "tompuenko", "17", day, None, None, None, None, None, None, None)]
    samples += [(f"m{i}", None, None, "hot", None, day, None, None, 40.0, -110.0, "Alder", "kestrel", None) for i in range(n)]
    samples += [("off", None, None, "hot", "1x007", day, None, None, 40.0, -110.0, None, None, None)]
    got = _link(spark, samples, sheets)
    assert got["s2"] == ("g1", 2) and all("s2" not in asked[r] for r in range(3, 8))
    assert all(got[f"m{i}"] == (f"hot_00000_{day}", 4) for i in range(n)) and got["off"] == (f"hot_00007_{day}", 4)


def test_labels_judge_the_rules(spark):
    """Rule 4 is measured without the number: two of three labelled samples of a day go to its smaller gathering."""
    day = "1990-05-06"
    sheets = [(f"A-{i}", f"a{i}", f"g{i}", "tompuenko", str(i), day, 40.0, -110.0, None, None, None) for i in (1, 2)]
    samples = [(f"l{i}", f"a{i % 2 + 1}", None, "tompuenko", str(i % 2 + 1), day, None, None, 40.0, -110.0, None, None, None) for i in range(3)]
    samples += [("x", None, None, "tompuenko", None, day, None, None, 40.0, -110.0, None, None, None)]
    counties, taxa = spark.createDataFrame([], "county_norm string"), spark.createDataFrame([], "raw_name_lower string, canonical_packera string")
    out = {r["sample"]: r for r in link_samples(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(sheets, SHEET), counties, taxa).collect()}
    assert (out["x"]["rule"], out["x"]["gathering"], out["x"]["confidence"]) == (4, "g1", 3 / 5) and out["l0"]["confidence"] == 4 / 5
