"""Checks that can fail: each passes on sound data and names the fault on broken data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalar
from tallyspark.operators import checks, cohorts, ranking, reconcile
from tallyspark.operators.checks import AuditFailure


def split_rows(spark, train, test, events):
    rows = [(i, i % 20, i % 5, int(i % 10 < events), 1995 + i % 3, 6.0, 1.0) for i in range(train)]
    rows += [(1000 + i, i % 9, i % 5, int(i % 10 < events), 2003, 9.0, 2.0 + i) for i in range(test)]
    return spark.createDataFrame(rows, "unit int, u2 int, cluster int, y int, year int, manual double, years double")


def test_split_support(spark):
    s = reconcile.split_support(split_rows(spark, 80, 60, 4), F.col("year") >= 2001, "u2", "cluster", "y", "year", "manual", "years")
    got = {r.split: r for r in reconcile.gate_split(s).collect()}
    a, b = got["Training"], got["Testing"]
    assert (a.conditions, a.events, a.units, a.clusters, a.year_max, a.late_manual_conditions) == (80, 32, 20, 5, 1997, 0)
    assert (b.conditions, b.events, b.units_shared, b.late_manual_conditions, b.interval_median) == (60, 24, 9, 60, 31.5)
    for train, test, events, side in ((40, 60, 9, "Training"), (80, 40, 9, "Testing"), (80, 60, 2, "Training"), (80, 60, 0, "Testing"), (80, 0, 4, "Testing")):
        with pytest.raises(AuditFailure, match=side):
            reconcile.gate_split(reconcile.split_support(split_rows(spark, train, test, events), F.col("year") >= 2001, "unit", "cluster", "y", "year", "manual", "years"))


def test_concordance_gate(spark):
    d = spark.createDataFrame([(float(i), i + 0.001) for i in range(50)], "x double, y double")
    assert checks.gate_concordance(checks.concordance(d, "x", "y")).first().observations == 50
    far = d.withColumn("y", F.when(F.col("x") == 7, 9.0).otherwise(F.col("y")))
    v = checks.concordance_verdict(checks.concordance(far, "x", "y")).first()
    assert not v.passed and not v.largest_error_small
    with pytest.raises(AuditFailure):
        checks.gate_concordance(checks.concordance(far, "x", "y"))
    with pytest.raises(AuditFailure):  # nothing to compare is no agreement
        checks.gate_concordance(checks.concordance(d.limit(0), "x", "y"))


def test_names(spark):
    a = spark.createDataFrame([("St. Clair County", 1), ("Bay", 2)], "label string, n int")
    b = spark.createDataFrame([("st clair county", 10), ("BAY", 20)], "name string, n int")
    key = {r[0] for r in a.select(scalar.plain_name("label")).collect()} & {r[0] for r in b.select(scalar.plain_name("name")).collect()}
    assert len(key) == 2
    got = cohorts.join_on_names(a, b, "label", "name")
    assert {(r.n, r.n_right) for r in got.collect()} == {(1, 10), (2, 20)}
    for other in ([("bay", 1)], [("bay", 1), ("BAY", 2), ("st clair county", 3)], [("bay", 1), ("st clair county", 3), (None, 5)]):
        with pytest.raises(AuditFailure):
            cohorts.join_on_names(a, spark.createDataFrame(other, "name string, n int"), "label", "name")


def test_stacked(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2, 0.5)], "k int, v double")
    assert {tuple(r) for r in cohorts.stacked({"a": a, "b": b}, "source").collect()} == {("a", 1, "x", None), ("b", 2, None, 0.5)}
    with pytest.raises(AuditFailure):
        cohorts.stacked({"a": a, "b": b.withColumn("s", F.lit(1))}, "source")
    with pytest.raises(AuditFailure):
        cohorts.stacked({}, "source")


def test_conflicting_counts(spark):
    d = spark.createDataFrame([(5, 2, 5), (5, 2, 6), (5, 6, 5), (None, 1, 1), (0, 0, 0)], "o int, t int, s int")
    assert [r[0] for r in d.coalesce(1).select(scalar.tall_fraction_conflict("o", "t", "s")).collect()] == [False, True, True, True, False]


def test_leaks_are_found(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "unit int, fold int")
    assert [r.unit for r in checks.groups_crossing(d, "unit", "fold").collect()] == [2]


def test_eight_metrics(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 11, "m", int(r.random() < 0.3), float(round(r.random(), 1))) for i in range(103)]
    d = spark.createDataFrame(rows, "row_id int, unit int, model string, y int, p double")
    (g,) = ranking.eight_metrics(d, ["model"], "row_id", "unit").collect()
    top = sorted(rows, key=lambda x: (-x[4], x[0]))[:25]
    hits, events = sum(x[3] for x in top), sum(x[3] for x in rows)
    assert (g.top_events, g.top_fraction, g.top_no_event_fraction, g.top_capture_fraction) == pytest.approx((hits, hits / 25, 1 - hits / 25, hits / events))


def test_model_cohort(spark):
    good = [(2, 1, 0, 3.0, 0.5, 2.0, True), (1, 1, 1, 0.0, 1.0, 5.0, False), (3, 0, None, None, None, None, None)]
    kind = "row_id int, eligible int, y int, n double, share double, years double, seen boolean"

    def ready(rows):
        d = spark.createDataFrame(rows, kind)
        return cohorts.model_ready(d, F.col("eligible") == 1, "y", ("n", "share", "years"), "share", "years", ("n",), {"n": "seen"})

    assert [(r.audit_row, r.row_id) for r in ready(good).orderBy("audit_row").collect()] == [(1, 1), (2, 2)]
    faults = [((9, 1, 2, 1.0, 0.5, 1.0, True), "binary"), ((9, 1, None, 1.0, 0.5, 1.0, True), "y missing"), ((9, 1, 1, -1.0, 0.5, 1.0, False), "negative"),
              ((9, 1, 1, float("inf"), 0.5, 1.0, True), "finite"), ((9, 1, 1, 1.5, 0.5, 1.0, True), "whole"), ((9, 1, 1, 1.0, 1.2, 1.0, True), "frame"),
              ((9, 1, 1, 1.0, 0.5, 0.0, True), "positive"), ((9, 1, 1, 1.0, 0.5, 1.0, False), "contradicts")]
    for row, word in faults:
        with pytest.raises(AuditFailure, match=word):
            ready([*good, row])
    with pytest.raises(AuditFailure):
        cohorts.model_ready(spark.createDataFrame(good, kind).drop("n"), F.lit(True), "y", ("n",), "share", "years")


def test_calibration_settles_or_is_missing(spark):
    from tallyspark.operators import logistic

    r = np.random.default_rng(7)
    x = r.normal(size=400) * 4
    y = (r.random(400) < 1 / (1 + np.exp(-0.3 * x + 2))).astype(int)
    far = 1 / (1 + np.exp(-(9 * x + 30)))  # steps from the start overshoot
    rows = [("good", float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(x, y)] + [("far", float(p), int(b)) for p, b in zip(far, y)]
    rows += [("apart", 0.2, 0), ("apart", 0.3, 0), ("apart", 0.7, 1), ("apart", 0.8, 1), ("single", 0.4, 1), ("single", 0.6, 1), ("flat", 0.5, 1), ("flat", 0.5, 0)]
    got = {c.g: c for c in logistic.calibration(spark.createDataFrame(rows, "g string, p double, y int"), ["g"]).collect()}
    for g in ("good", "far"):
        p = np.clip([q for k, q, _ in rows if k == g], 1e-12, 1 - 1e-12)
        z = np.column_stack([np.ones(400), np.log(p / (1 - p))])
        beta = np.array([got[g].calibration_intercept, got[g].calibration_slope])
        fitted = 1 / (1 + np.exp(-z @ beta))
        assert np.abs(z.T @ (fitted - y)).max() < 1e-5  # the likelihood equations hold
        assert abs(np.sum(1 / (1 + np.exp(-(z[:, 1] + got[g].offset_intercept))) - y)) < 1e-5
    assert (got["apart"].calibration_slope, got["single"].calibration_slope, got["single"].offset_intercept, got["flat"].calibration_slope) == (None, None, None, None)
    assert got["flat"].offset_intercept == pytest.approx(0.0)
