import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import plan_size, scalar, states


def vals(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_area_and_basis(spark):
    assert vals(spark, [(10.0, 1.0), (10.0, 6.0)], "d double, t double", scalar.area_contribution("d", "t")) == pytest.approx([0.5454, 3.2724])
    rows = [(4.0, 20.0), (5.0, 20.0), (20.0, 20.0), (30.0, None), (4.9, None)]
    assert vals(spark, rows, "d double, b double", scalar.sampling_basis("d", "b")) == ["microplot", "subplot", "macroplot", "subplot", "microplot"]


def test_bins_are_right_closed(spark):
    got = vals(spark, [(0.0,), (1.0,), (1.5,), (5.0,), (20.0,), (21.0,), (None,)], "x double", scalar.right_closed_bin("x", *scalar.COUNT_BINS))
    assert got == ["0", "1", "2-5", "2-5", "6-20", ">20", None]


def test_missing_value_rules(spark):
    assert vals(spark, [(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double", scalar.is_finite("x")) == [True, False, False, False]
    assert vals(spark, [(1,), (9,), (None,)], "x int", scalar.in_codes("x", [1, 2])) == [True, False, False]
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "g string, x int").groupBy("g")
    assert {r.g: r.s for r in df.agg(scalar.sum_or_missing("x").alias("s")).collect()} == {"a": None, "b": 5}
    assert vals(spark, [(1.0, 0.0), (1.0, None), (1.0, 4.0)], "n double, d double", scalar.ratio("n", "d")) == [None, None, 0.25]


def test_sampled_status_truth_table(spark):
    rows = [(1, None, None), (1, 1, None), (2, None, None), (3, None, None), (9, 1, None), (None, 1, None), (1, 2, None), (1, None, 10)]
    assert vals(spark, rows, "m int, l int, r int", scalar.sampled_unit("m", "l", "r")) == [True, True] + [False] * 6


def test_season_window(spark):
    w = scalar.season_window("y", "m")
    got = spark.createDataFrame([(2011, 2), (2012, 1), (2018, 12)], "y int, m int").coalesce(1).select(w.alias("w")).select("w.*").collect()
    assert [(r.first_season, r.last_season, r.january_shift) for r in got] == [(2008, 2010, False), (2008, 2010, True), (2015, 2017, False)]
    assert got[2].required_seasons == [2015, 2016, 2017]
    with pytest.raises(ValueError):
        scalar.season_window("y", "m", 0)


def test_transition_states(spark):
    rows = [(0, 0), (0, 1), (1, 0), (1, 1), (None, 1)]
    assert vals(spark, rows, "a int, b int", states.transition("a", "b")) == ["Persistent non-detection", "Appearance", "Loss", "Persistence", None]


def test_record_class_and_missing_attributes(spark):
    s = "st int, sp int, d double, r int, p string"
    rows = [(1, 318, 1.1, 1, None), (1, 318, 1.1, 3, None), (1, 318, 1.1, 1, "old"), (1, 318, 5.0, 1, None), (1, 318, 1.1, None, None), (2, 318, 1.1, 1, None),
            (None, 318, 1.2, 1, None), (1, None, 1.2, 1, None), (1, 318, None, 1, None)]
    other, tagged, unclear, new = states.RECORD_CLASSES
    assert vals(spark, rows, s, states.record_class("st", "sp", "d", "r", "p", 318)) == [new, unclear, tagged, other, unclear, other, unclear, unclear, unclear]


def test_fates(spark):
    s = "f string, st int, sp int, d double"
    rows = [("a", 1, 318, 5.0), ("b", 2, 318, None), ("c", 0, 318, 1.1), ("d", 1, 316, 1.2), ("e", 3, 318, None), (None, None, None, None), ("g", None, 318, 1.2), ("h", 1, None, 1.2)]
    assert vals(spark, rows, s, states.linked_fate("f", "st", "sp", "d", 318)) == [
        "Alive; reached 5 inches", "Recorded dead", "No longer sampled", "Species reidentified", "Recorded removed", "Unlinked", "Unresolved", "Unresolved"]


def test_planning(spark):
    rows = [(0.5, 0.05), (0.8, 0.05), (0.5, 0.1), (0.8, 0.1)]
    assert vals(spark, rows, "p double, h double", plan_size.wilson_minimal_units("p", "h")) == [381, 245, 93, 60]
    got = spark.createDataFrame([(0.1, 0.01, 1.5, 0.8)], "s double, h double, v double, r double").select(*plan_size.required_units("s", "h", "v", "r")).first()
    raw = (plan_size.normal_quantile() * 0.1 / 0.01) ** 2
    assert tuple(got) == (math.ceil(raw), math.ceil(raw * 1.5), math.ceil(math.ceil(raw * 1.5) / 0.8))
    assert plan_size.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert plan_size.chi_square_upper(40.0, 3) == pytest.approx(1.0655092e-08, rel=1e-4)
    w = spark.range(1).select(scalar.wilson(F.lit(0), F.lit(0)).alias("w")).select("w.*").first()
    assert tuple(w) == (None, None, None)


def test_tall_fraction(spark):
    assert vals(spark, [(0, 0), (4, 1), (10, 10)], "o int, t int", scalar.tall_fraction("o", "t")) == [None, 0.25, 1.0]
    rows = [(4.0, 2.0, 5.0), (4.0, 5.0, 4.0), (None, 1.0, 4.0), (4.0, 1.5, 4.0), (4.0, 1.0, 4.0)]
    assert vals(spark, rows, "o double, t double, s double", scalar.tall_fraction_conflict("o", "t", "s")) == [True, True, True, True, False]
