import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.functions import circular as C, genotype as G, scalar as S, shapes as P


def _one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (S.first_collector, "J. Brandon Fuller", "fuller"), (S.first_collector, "Fuller, J. B. & R. Kowal", "fuller"), (S.first_collector, "J. B.", "jb"), (S.first_collector, " ", "unknown"), (S.first_collector, None, "unknown"),
        (S.first_collector, "A. Other and B. More", "other"), (S.record_number, "#1042", "1042"), (S.record_number, "No. 1042-A", "1042a"), (S.record_number, "Coll. no. 2022-014", "2022-014"), (S.record_number, "s.n.", ""),
        (S.record_number, None, ""), (S.record_number, "AB12-7/3", "ab12-7-3"), (S.to_double, "inf", None), (S.to_double, " 2.5 ", 2.5), (S.to_double, "abc", None), (S.to_int, "2.5", 2), (S.to_int, "3.5", 4), (S.to_flag, "Yes", 1),
        (S.to_flag, "f", 0), (S.to_flag, "maybe", None), (S.is_missing, " NaN ", True), (S.is_missing, None, True), (S.is_missing, "x", False), (S.county_name, "St. Mary County", "st mary"), (S.county_name, "Parish of Ån", "an"),
        (S.binomial, "packera aurea (L.) X", "Packera aurea"), (S.binomial, "Packera sp.", None), (S.infraspecific, "P. x ssp. montana", "subsp. montana"), (S.type_rank, "not a holotype", 0), (S.type_rank, "Isotype", 2),
        (S.type_subrank, "isotype", 2.0), (S.type_subrank, "Holotype", 2.2), (S.surname_list, "det. A. Gray 1984; B. Hall and C. Iltis", ["gray", "hall", "iltis"]), (S.straight_quotes, "‘a’ – “b”", "'a' - \"b\""), (S.fold_ascii, "Éa ø", "ea o"),
        (G.genotype_dosage, "0|0|1|1", 0.5), (G.genotype_dosage, "./.", None), (G.genotype_dosage, "0/x", None), (G.reverse_complement, "ACGTN", "NACGT"), (G.iupac_alleles, "r", "AG"), (G.iupac_alleles, "-", None),
    ],
)
def test_text_functions(spark, fn, value, want):
    assert _one(spark, value, "string", fn) == want


def test_spatial_key_rounds_as_c(spark):
    values = [0.000005, 0.000015, 1.000005, -38.550595, 38.5505949999, 179.999995, -0.000001, 90.0, 36.850005, 2.5e-06]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.fixed5(F.col("v"))).collect()]
    assert got == [f"{v:.5f}" for v in values]
    assert spark.createDataFrame([(None, 1.0)], "a double, b double").select(S.spatial_key(F.col("a"), F.col("b"))).first()[0] is None


def test_circular(spark):
    days = spark.createDataFrame([(360.0,), (10.0,), (None,), (400.0,)], "d double")
    mean = days.select(C.mean_day(F.col("d"))).first()[0]
    assert abs(mean - (360 + 15.25 / 2) % 365.25) < 1e-6
    opposite = spark.createDataFrame([(100.0,), (100 + 365.25 / 2,)], "d double").select(C.mean_day(F.col("d"))).first()[0]
    assert abs(opposite - (100 + 365.25 / 4)) < 1e-6
    assert abs(_one(spark, 5.0, "double", lambda c: C.signed_offset_days(c, F.lit(360.0))) - 10.25) < 1e-9
    assert _one(spark, 0.0, "double", C.wrap_days) == 365.25


def test_shapes(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    df = spark.createDataFrame([(square,), ([[0.0, 0.0]],), ([],), (None,)], "v array<array<double>>")
    v = F.col("v")
    got = df.select(P.polygon_area(v), P.polygon_perimeter(v), P.hull_area(v), P.centroid_size(v)).collect()
    assert tuple(got[0]) == (4.0, 8.0, 4.0, math.sqrt(8)) and got[1][0] == 0.0 and got[2][0] == 0.0 and got[3][0] is None
    pts = np.array(square)
    ring = P.resample(pts, 64)
    back = P.fourier_outline(P.elliptic_fourier(ring, 30), 64) + pts.mean(axis=0)
    assert np.abs(back - ring).max() < 0.15
    curve = P.euler_curve(pts, 8, 4)
    assert curve.shape == (4, 8) and (curve[:, -1] == 0).all() and curve.max() >= 1


def test_depths(spark):
    cells = [("GT:DP:AD", "0/1:40:12,28", 0.5), ("GT:DP:AD", "0/1:40:18", 0.5), ("GT:DP", "0/1:5", 0.5), ("GT", "0/1", 0.5), ("GT:RO:AO", "0/1:3:4,5", 0.5), ("GT:DP:AD", "0/1:.:.", 0.5)]
    got = [tuple(r[0]) for r in spark.createDataFrame(cells, "f string, c string, d double").select(G.cell_depths(F.col("f"), F.col("c"), F.col("d"))).collect()]
    assert got == [(12.0, 28.0), (22.0, 18.0), (3.0, 2.0), (None, None), (3.0, 9.0), (None, None)]
