import pytest
from pyspark.sql import functions as F

from tallyspark.operators import measures
from tallyspark.operators.checks import AuditFailure

TREES = "plt_cn string, condid int, spcd int, dia double, tpa_unadj double, statuscd int, macro_breakpoint_dia double"
FRAMES = "plt_cn string, condid int, micrprop_unadj double, subpprop_unadj double, macrprop_unadj double"


def area(d, t):
    return 0.005454 * d * d * t


def test_frame_normalised_sums(spark):
    t = spark.createDataFrame([("a", 1, 1, 4.9, 10.0, 1, None), ("a", 1, 1, 5.0, 6.0, 1, None), ("a", 1, 2, 10.0, 6.0, 1, None), ("a", 1, 2, 10.0, 6.0, 2, None)], TREES)
    f = spark.createDataFrame([("a", 1, 0.25, 0.5, None)], FRAMES)
    m = measures.stem_metrics(t, f, 1, gate=True).first()
    assert m.total_ba_ft2_ac == pytest.approx(area(4.9, 10) / 0.25 + (area(5, 6) + area(10, 6)) / 0.5)
    assert m.maple_sapling_ba_ft2_ac == pytest.approx(area(4.9, 10) / 0.25)
    assert (m.live_tree_records, m.maple_sapling_records, m.overstory_tree_records, m.established_maple_records) == (3, 1, 2, 1)
    assert m.established_maple_ba_share == pytest.approx(area(5, 6) / (area(5, 6) + area(10, 6)))


def test_macro_frame(spark):
    t = spark.createDataFrame([("a", 1, 1, d, 1.0, 1, 20.0) for d in (4.0, 10.0, 20.0)], TREES)
    f = spark.createDataFrame([("a", 1, 0.25, 0.5, 0.75)], FRAMES)
    m = measures.stem_metrics(t, f, 1).first()
    assert m.total_ba_ft2_ac == pytest.approx(area(4, 1) / 0.25 + area(10, 1) / 0.5 + area(20, 1) / 0.75)
    assert (m.microplot_tree_records, m.subplot_tree_records, m.macroplot_tree_records) == (1, 1, 1)


def test_bad_denominator_is_an_error(spark):
    t = spark.createDataFrame([("a", 1, 1, 4.0, 1.0, 1, None)], TREES)
    f = spark.createDataFrame([("a", 1, 0.0, 0.5, None)], FRAMES)
    with pytest.raises(AuditFailure, match="microplot"):
        measures.stem_metrics(t, f, 1, gate=True)


def test_sums_that_are_not_whole_are_missing(spark):
    t = spark.createDataFrame([("a", 1, 1, 4.0, 1.0, 1, None), ("a", 1, 1, 6.0, 1.0, 1, None), ("b", 1, 1, 6.0, 1.0, 1, None)], TREES)
    f = spark.createDataFrame([("a", 1, 0.0, 0.5, None), ("b", 1, 0.0, 0.5, None)], FRAMES)
    got = {r.plt_cn: r for r in measures.stem_metrics(t, f, 1).collect()}
    a, b = got["a"], got["b"]
    assert (a.live_tree_records, a.unusable_tree_records, b.unusable_tree_records) == (2, 1, 0)
    assert [a[c] for c in ("total_ba_ft2_ac", "maple_sapling_ba_ft2_ac", "overstory_total_ba_ft2_ac", "nonmaple_ba_ft2_ac", "maple_ba_share", "established_maple_ba_share")] == [None] * 6
    assert a.total_ba_plot_basis == pytest.approx(area(4, 1) + area(6, 1)) and b.total_ba_ft2_ac == pytest.approx(area(6, 1) / 0.5)
    g = {r.plt_cn: r for r in measures.target_metrics(t, f, 1, "beech").collect()}
    assert g["a"].beech_ba_ft2_ac is None and g["a"].beech_records == 2 and g["b"].beech_sapling_ba_ft2_ac == 0.0


def test_target_grid_is_zero_filled(spark):
    t = spark.createDataFrame([("a", 1, 2, 4.0, 1.0, 1, None)], TREES)
    f = spark.createDataFrame([("a", 1, 0.5, 0.5, None), ("b", 1, 0.5, 0.5, None)], FRAMES)
    got = {r.plt_cn: r for r in measures.target_metrics(t, f, 2, "beech").collect()}
    assert got["a"].beech_sapling_ba_ft2_ac == pytest.approx(area(4, 1) / 0.5) and got["b"].beech_ba_ft2_ac == 0 and got["b"].beech_records == 0
    with pytest.raises(ValueError):
        measures.target_metrics(t, f, 2, "Bad prefix")


def test_zero_only_where_sampled(spark):
    u = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.5), ("c", 1, 0.0), ("d", 1, None)], "plt_cn string, condid int, micrprop_unadj double")
    s = spark.createDataFrame([("a", 1, 2, 10.0)], "plt_cn string, condid int, spcd int, tpa_unadj double")
    got = {r.plt_cn: r for r in measures.tally_metrics(s, u, 1).collect()}
    assert [got[k].maple_seedling_detected for k in "abcd"] == [0, 0, None, None]
    assert got["a"].all_seedling_tpa == 10.0 and got["b"].maple_seedling_tpa == 0.0 and got["c"].maple_seedling_tpa is None


def test_thresholds_use_sampled_rows_only(spark):
    d = spark.createDataFrame([(0.10, 50.0, 1), (0.20, 0.0, 0), (0.30, 0.0, 0), (0.99, None, None)],
                              "established_maple_ba_share double, maple_seedling_tpa double, maple_seedling_detected int")
    rows = measures.gap_flags(d).orderBy("established_maple_ba_share").collect()
    assert rows[0].established_threshold == pytest.approx(0.1 + 0.2 * 2 / 3)
    assert [r.potential_gap for r in rows] == [False, False, True, None]
    assert [r.established_percentile for r in rows] == [0.0, 0.5, 1.0, None]


def test_repartition_and_order_do_not_matter(spark):
    rows = [(f"p{i % 7}", i % 2, 1 + i % 3, 1.0 + i % 11, 1.0 + i / 10, 1, None) for i in range(200)]
    f = spark.createDataFrame([(f"p{i}", c, 0.5, 0.25, None) for i in range(7) for c in (0, 1)], FRAMES)
    a = measures.stem_metrics(spark.createDataFrame(rows, TREES).repartition(1), f, 1)
    b = measures.stem_metrics(spark.createDataFrame(rows[::-1], TREES).repartition(9), f, 1)
    cols = [F.round(c, 9) if t == "double" else F.col(c) for c, t in a.dtypes]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_ranks_do_not_part_ties_by_the_order_of_addition(spark):
    share = [0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1, 0.9, 0.2]
    dens = [4.5, 4.5 - 2**-50, 9.0, 0.0]
    assert share[0] != share[1] and dens[0] != dens[1]
    d = spark.createDataFrame([(i, s, x, int(x > 0)) for i, (s, x) in enumerate(zip(share, dens))], "i int, s double, x double, d int")
    r = {x.i: x for x in measures.gap_flags(d, "s", "x", "d").collect()}
    assert r[0].established_percentile == r[1].established_percentile == 1 / 3
    assert r[0].regeneration_percentile == r[1].regeneration_percentile == 1 / 3
