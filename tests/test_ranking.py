import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ranking, resample


def scored(spark, y, p, w=None, units=None):
    w = w or [1] * len(y)
    units = units or [f"u{i}" for i in range(len(y))]
    return spark.createDataFrame([("m", i, units[i], y[i], float(p[i]), w[i]) for i in range(len(y))], "model string, row_id long, unit string, y int, p double, w int")


def test_auc_and_precision_with_ties(spark):
    one = lambda y, p: tuple(ranking.rank_metrics(scored(spark, y, p), ["model"]).first())[1:]
    assert one([0, 0, 1, 1], [0.5] * 4) == (0.5, 0.5)
    assert one([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == (1.0, 1.0)
    assert one([1, 1], [0.1, 0.2]) == (None, None)
    assert one([0, 1, 0, 1], [0.2, 0.5, 0.5, 0.9])[0] == pytest.approx(0.875)
    assert one([0, 1, 0, 1], [0.2, 0.5, 0.5, 0.9])[1] == pytest.approx(0.5 + 0.5 * 2 / 3)


def pick(spark, y, p, f, w=None, order=None, units=None):
    d = scored(spark, y, p, w, units)
    if order:
        d = d.withColumn("row_id", F.element_at(F.array(*[F.lit(o) for o in order]), (F.col("row_id") + 1).cast("int")))
    return ranking.select_capacity(d, ["model"], "y", "p", (f,), "row_id", "unit", "w").first()


def test_capacity_ties(spark, sliced):
    a = pick(spark, [1, 0, 1, 0], [1] * 4, 0.5)
    b = pick(spark, [1, 0, 1, 0], [1] * 4, 0.5, order=[1, 3, 2, 4])
    assert (a.capacity, a.expected_targets, a.minimum_targets, a.maximum_targets) == (2, 1.0, 0, 2)
    assert b.expected_targets == a.expected_targets and (a.deterministic_targets, b.deterministic_targets) == (1, 2)
    assert a.extra_targets_vs_random == 0
    assert pick(spark, [1, 0, 1, 0], [1, 2, 3, 4], 1.0).expected_targets == 2
    assert pick(spark, [1, 0, 1, 0], [4, 3, 2, 1], 0.5, units=["a", "a", "b", "c"]).selected_units == 1


def test_weights_equal_repetition(spark, sliced):
    y, p, w = [1, 0, 1, 0], [3, 2, 2, 1], [2, 3, 0, 1]
    idx = [i for i, k in enumerate(w) for _ in range(k)]
    a = pick(spark, y, p, 0.5, w).asDict()
    b = pick(spark, [y[i] for i in idx], [p[i] for i in idx], 0.5).asDict()
    for k in ("capacity", "expected_targets", "minimum_targets", "maximum_targets", "target_capture_fraction", "deterministic_targets"):
        assert a[k] == b[k], k
    m = ranking.model_metrics(scored(spark, y, [x / 4 for x in p], w), ["model"], w="w").first()
    n = ranking.model_metrics(scored(spark, [y[i] for i in idx], [p[i] / 4 for i in idx]), ["model"]).first()
    assert [round(v, 12) if isinstance(v, float) else v for v in m] == [round(v, 12) if isinstance(v, float) else v for v in n]


def test_objective_flips_priority(spark):
    d = spark.createDataFrame([(i, u, y, float(s)) for i, (u, y, s) in enumerate([("a", 0, 1), ("a", 0, 2), ("b", 1, 3), ("c", 1, 4)])], "row_id long, unit string, y int, s double")
    r = {(x.objective, x.policy): x for x in ranking.policy_sweep(d, {"S": F.col("s")}, "y", "row_id", "unit", (0.5,)).collect()}
    assert [r[(o, "S")].expected_targets for o in ("No recorded entry", "Recorded entry")] == [2.0, 2.0]
    assert [r[(o, "S")].selected_units for o in ("No recorded entry", "Recorded entry")] == [1, 2]
    assert r[("Recorded entry", ranking.RANDOM)].expected_targets == 1.0 and r[("Recorded entry", ranking.RANDOM)].deterministic_targets is None


def test_balanced_gain(spark):
    d = spark.createDataFrame([("a", "1", 1, 0.6, 0.8), ("a", "1", 0, 0.4, 0.2), ("b", "2", 0, 0.6, 0.3)], "unit string, cluster string, y int, r double, n double").withColumn("g", F.lit(1))
    x = ranking.balanced_gain(d, "unit", "cluster", ["g"], "y", "r", "n").first()
    assert (x.reference_brier, x.new_brier, x.gain, x.units_crossing) == (pytest.approx(0.26), pytest.approx(0.065), pytest.approx(0.195), 0)


def test_draws_are_complete_and_reproducible(spark):
    d = spark.createDataFrame([(f"c{i}",) for i in range(40)], "cluster string")
    a = resample.multiplicities(d, "cluster", 5, 7)
    b = resample.multiplicities(d.repartition(6), "cluster", 5, 7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r.s for r in a.groupBy("resample").agg(F.sum("weight").alias("s")).collect()} == {40}
    idx = [r.cluster_no for r in resample.cluster_index(d, "cluster").collect()]
    assert sorted(idx) == list(range(40))


def test_a_capacity_of_zero_keeps_its_group(spark, sliced):
    rows = [("small", i, f"u{i}", i % 2, float(i), 1) for i in range(3)] + [("large", i, f"u{i}", i % 2, float(i), 1) for i in range(20)]
    d = spark.createDataFrame(rows, "model string, row_id long, unit string, y int, p double, w int")
    got = {r.model: r for r in ranking.select_capacity(d, ["model"], "y", "p", (0.1,), "row_id", "unit", "w").collect()}
    assert (got["large"].capacity, got["large"].deterministic_targets) == (2, 1)
    s = got["small"]
    assert (s.capacity, s.expected_targets, s.deterministic_targets, s.selected_units, s.cutoff_score) == (0, 0.0, 0, 0, None)
    assert s.selected_target_fraction is None


@pytest.mark.parametrize("score, weight", [(float("nan"), 1.0), (None, 1.0), (0.5, 1.5)])
def test_unusable_scores_and_weights_are_errors(spark, score, weight):
    d = spark.createDataFrame([("m", 1, "u", 1, score, weight), ("m", 2, "v", 0, 0.2, 1.0)], "model string, row_id long, unit string, y int, p double, w double")
    with pytest.raises(Exception, match="cannot be ranked|whole numbers"):
        ranking.select_capacity(d, ["model"], "y", "p", (0.5,), "row_id", "unit", "w").collect()


def test_capacity_work_is_dealt_by_rows(spark, sliced, monkeypatch):
    """Ties are ordered only where the capacity ends, and tasks that count units grow in number with the rows."""
    monkeypatch.setattr(ranking, "UNIT_ROWS", 10)
    data = [(g, (i * 7919) % 200, i % 23, float(i % 3), int(i % 5 == 0)) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(data, "g string, k long, u long, s double, t int")
    got = {(r.g, r.requested_fraction): r for r in ranking.select_capacity(df, ["g"], "t", "s", (0.1, 0.5, 0.9), "k", "u").collect()}
    for g in ("a", "b"):
        order = sorted((x for x in data if x[0] == g), key=lambda x: (-x[3], x[1]))
        for f in (0.1, 0.5, 0.9):
            top = order[:int(200 * f)]
            r = got[g, f]
            assert (r.deterministic_targets, r.selected_units) == (sum(x[4] for x in top), len({x[2] for x in top}))
    assert len(got) == 6
    cut = spark.createDataFrame([("a", 0.5, 600)], "g string, requested_fraction double, capacity long")
    taken = spark.createDataFrame([("a", 1, 0.5)], "g string, _u long, requested_fraction double")
    plan = ranking._by_unit(taken, cut, ["g"]).count()._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(g" in plan and ", 60), REPARTITION" in plan
