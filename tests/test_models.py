import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import folds, inference, logistic
from tallyspark.operators.logistic import Model

TERMS = {"a": ("a", "identity"), "b": ("b", "log1p")}


def cohort(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.gauss(5, 2), rnd.expovariate(0.2)
        y = int(rnd.random() < 1 / (1 + math.exp(-(-1 + 0.3 * (a - 5) + 0.4 * math.log1p(b)))))
        rows.append((i, f"c{i % 9}", y, a, b))
    return spark.createDataFrame(rows, "row_id int, cluster string, y int, a double, b double")


def dense(df, terms=TERMS):
    d = df.toPandas()
    x = np.column_stack([np.ones(len(d)), d["a"], np.log1p(d["b"])])
    return x, d["y"].to_numpy(float)


def newton(x, y, lam, w=None):
    w = np.ones(len(y)) if w is None else w
    mean = (w[:, None] * x[:, 1:]).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x[:, 1:] - mean) ** 2).sum(0) / (w.sum() - 1))
    z = np.column_stack([x[:, 0], (x[:, 1:] - mean) / sd])
    beta, pen = np.zeros(z.shape[1]), np.r_[0, np.full(z.shape[1] - 1, lam)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (w * (p - y)) + pen * beta)
    return beta, mean, sd


@pytest.mark.parametrize("lam", [0.0, 1.0, 100.0])
def test_matches_dense_newton(spark, lam):
    df = cohort(spark)
    f = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"), lam), "i": Model((), lam)})
    beta, mean, sd = newton(*dense(df), lam)
    got = f.get("m")
    assert got.beta == pytest.approx(beta, abs=1e-8) and got.center == pytest.approx(mean) and got.scale == pytest.approx(sd)
    assert got.max_gradient < 1e-7
    rate = df.agg(F.avg("y")).first()[0]
    assert 1 / (1 + math.exp(-f.get("i").beta[0])) == pytest.approx(rate, abs=1e-9)  # intercept is never penalised


def test_mllib_agrees(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = cohort(spark)
    f = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"), 1.0)}).get("m")
    z = [c.alias(f"z{i}") for i, c in enumerate(inference.design(f, TERMS)[1:])]
    d = VectorAssembler(inputCols=["z0", "z1"], outputCol="features").transform(df.select("y", *z))
    m = LogisticRegression(labelCol="y", regParam=1 / 400, elasticNetParam=0.0, standardization=False, tol=1e-13, maxIter=500).fit(d)
    assert [m.intercept, *m.coefficients] == pytest.approx(list(f.beta), abs=1e-5)


def test_resample_weights_equal_repetition(spark):
    df = cohort(spark)
    w = spark.createDataFrame([(r, f"c{i}", k) for r, ks in enumerate([[1] * 9, [3, 0, 2, 1, 0, 1, 1, 1, 0]]) for i, k in enumerate(ks) if k], "resample int, cluster string, weight int")
    f = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"))}, weights=w, resamples=2)
    rep = df.join(w.where("resample = 1"), "cluster").select("row_id", "cluster", "y", "a", "b", F.explode(F.sequence(F.lit(1), "weight")).alias("k"))
    one = logistic.fit_batch(rep, "y", TERMS, {"m": Model(("a", "b"))}).get("m")
    two = f.get("m", resample=1)
    assert two.beta == pytest.approx(one.beta, abs=1e-8) and two.scale == pytest.approx(one.scale)
    plain = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"))}).get("m")
    assert f.get("m", resample=0).beta == pytest.approx(plain.beta, abs=1e-8)


def test_held_out_rows_do_not_move_scaling_or_fit(spark):
    df = cohort(spark).withColumn("fold", F.col("row_id") % 2 + 1)
    wild = df.withColumn("a", F.when(F.col("fold") == 1, F.col("a") * 1000).otherwise(F.col("a"))).withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    a = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"))}, "fold", (1,)).get("m", 1)
    b = logistic.fit_batch(wild, "y", TERMS, {"m": Model(("a", "b"))}, "fold", (1,)).get("m", 1)
    assert a.beta == pytest.approx(b.beta, abs=1e-6) and a.center == pytest.approx(b.center) and a.scale == pytest.approx(b.scale)
    p = logistic.predict(df, logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"))}, "fold", (1, 2)), ["row_id"], "fold")
    assert p.count() == 400 and p.where("p <= 0 or p >= 1").isEmpty()


def test_scaling_audit(spark):
    d = spark.createDataFrame([(1, 0.0, 0.25, 5.0), (1, math.exp(2) - 1, 0.5, 6.0), (1, math.exp(4) - 1, 0.75, 7.0), (2, math.exp(8) - 1, 1.0, 9.0)], "fold int, e double, c double, i double")
    terms = {"e": ("e", "log1p"), "c": ("c", "identity"), "i": ("i", "identity")}
    got = {r.term: r for r in logistic.training_scales(d, "fold", terms).where("held_out = 2").collect()}
    assert [round(got[t].center, 9) for t in "eci"] == [2, 0.5, 6] and [round(got[t].scale, 9) for t in "eci"] == [2, 0.25, 1]


def test_one_class_is_a_failure_row(spark):
    df = cohort(spark, 40).withColumn("y", F.lit(0))
    b = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a",))})
    assert "one outcome class" in b.failures(spark).first().reason
    with pytest.raises(RuntimeError):
        b.gate(1)


def greedy(sizes, k):
    load, out = [[0, 0, i] for i in range(k)], {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(load)
        out[name] = f[2] + 1
        f[0] += n
        f[1] += 1
    return out


@pytest.mark.parametrize("sizes", [{f"g{i}": i for i in range(1, 9)}, {"big": 90, **{f"s{i:02d}": 1 for i in range(70)}}, {**{f"a{i}": 5 for i in range(7)}, **{f"b{i}": 3 for i in range(11)}, **{f"c{i:02d}": 1 for i in range(23)}}])
def test_folds_follow_the_sequential_rule(spark, sliced, sizes):
    rows = [(g, i % 2) for g, n in sizes.items() for i in range(n)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, y int")
    got = {r.g: r.fold for r in folds.balanced_folds(df, "g", 5).collect()}
    assert got == greedy(sizes, 5)
    flipped = folds.balanced_folds(df.withColumn("y", 1 - F.col("y")), "g", 5)
    assert {r.g: r.fold for r in flipped.collect()} == got


def test_calibration_of_exact_rates(spark):
    rows = [("m", int(i < 2 if p == 0.2 else i < 8), p) for p in (0.2, 0.8) for i in range(10)]
    c = logistic.calibration(spark.createDataFrame(rows, "model string, y int, p double"), ["model"]).first()
    assert (c.calibration_intercept, c.calibration_slope, c.offset_intercept) == (pytest.approx(0, abs=1e-8), pytest.approx(1), pytest.approx(0, abs=1e-8))


def test_leverages_add_up(spark):
    df = cohort(spark)
    f = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a", "b"), 0.0)}).get("m")
    d = inference.diagnostics(inference.influence(df, "y", f, TERMS, ["row_id"]), f).first()
    assert d.sum_leverage == pytest.approx(3.0, abs=1e-6)


def test_random_intercept_finds_cluster_spread(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(30):
        u = rnd.gauss(0, 1.2)
        rows += [(f"g{g}", int(rnd.random() < 1 / (1 + math.exp(-(0.3 + u)))), rnd.gauss(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "cluster string, y int, a double")
    r = inference.random_intercept(df, "y", "cluster", Model(("a",)), {"a": ("a", "identity")}).first()
    assert 0.6 < r.cluster_variance < 2.6 and r.lr_chisq > 50 and not r.singular


def test_missing_predictor_is_a_clear_error(spark):
    df = cohort(spark, 40).withColumn("a", F.when(F.col("row_id") != 7, F.col("a")))
    with pytest.raises(ValueError, match="'a': 1"):
        logistic.fit_batch(df, "y", TERMS, {"m": Model(("a",))})


def test_constant_unpenalised_term_is_a_failure_row(spark):
    df = cohort(spark, 60).withColumn("a", F.lit(2.0))
    b = logistic.fit_batch(df, "y", TERMS, {"m": Model(("a",), 0.0)})
    assert "singular" in b.failures(spark).first().reason and b.failed_resamples() == {0}


def test_a_cohort_is_scored_whole_or_not_at_all(spark):
    from tallyspark.plans import model_plans

    df = cohort(spark, 60).selectExpr("row_id", "cluster", "CAST(row_id % 5 + 1 AS INT) AS fold", "CASE WHEN row_id % 5 = 0 THEN y ELSE 0 END AS y", "a AS coverage",
                                      "b AS interval_years", "b AS seedling_count", "b AS sapling_tpa", "b AS established_ba", "cluster AS unit")
    with pytest.raises(logistic.IncompletePredictions, match="fold 1"):
        model_plans.crossfit(df)


def test_median_unbiased_quantile(spark):
    from tallyspark.operators import ordered

    x = [float(v * v) for v in range(11)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    got = ordered.exact_quantiles(df, [], "v", {"p": 0.9, "top": 0.999}, median_unbiased=True).first()
    assert got.p == pytest.approx(np.quantile(x, 0.9, method="median_unbiased")) and got.top == 100.0
