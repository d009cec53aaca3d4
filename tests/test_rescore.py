"""Resampled scoring against row-by-row repetition of each resample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import logistic, ranking, rescore, resample


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    data = [(i, i % 7, i % 7 % 3 + 1, float(r.integers(0, 40)), float(r.random()), 0) for i in range(420)]
    data = [(*d[:5], int(r.random() < 1 / (1 + np.exp(1.5 - 0.05 * d[3])))) for d in data]
    return spark.createDataFrame(data, "row_id long, cluster long, fold int, a double, b double, y int").cache()


TERMS = {"za": ("a", "log1p"), "zb": ("b", "identity")}
MODELS = {"Prevalence": logistic.Model((), 1.0), "Both": logistic.Model(("za", "zb"), 1.0)}


def test_every_resample_is_repeated(spark, rows, monkeypatch):
    monkeypatch.setattr(rescore, "BLOCK", 50)
    w = rescore.draws(rows, "cluster", 6, 3)
    batch = logistic.fit_batch(rows, "y", TERMS, MODELS, "fold", (1, 2, 3), w, 7)
    totals = rescore.resampled_totals(rows, batch, w, 7, fold="fold", scores={"Raw": F.col("a")})
    got = {(r.series, r.resample): r for r in rescore.metric_draws(totals).collect()}
    # the same from a table of rows by resamples, with exact scores
    p = logistic.predict(rows, batch, ("row_id", "y"), "fold", w)
    want = {(r.model, r.resample): r for r in ranking.model_metrics(p, ["model", "resample"], benchmark=None, w="weight").collect()}
    assert len(want) == 14 and len(got) == 21
    for k, r in want.items():
        g = got[k]
        assert (g.observations, g.events) == (r.observations, r.events)
        assert abs(g.brier_score - r.brier_score) < 1e-9 and abs(g.log_loss - r.log_loss) < 1e-9
        assert abs(g.roc_auc - r.roc_auc) < 2e-3 and abs(g.average_precision - r.average_precision) < 5e-3
    long = p.where("weight > 0").select("model", "resample", "row_id", "y", "p", "weight").collect()
    for (model, b), g in got.items():
        if model == "Raw":
            continue
        mine = sorted([(float(np.float32(r.p)), r.weight, r.y) for r in long if (r.model, r.resample) == (model, b)], reverse=True)
        n = sum(x[1] for x in mine)
        k, left, hits = n // 4, n // 4, 0.0
        score = rescore.score_bin(np.array([x[0] for x in mine]))
        for s in sorted(set(score.tolist()), reverse=True):
            tie = [x for x, v in zip(mine, score) if v == s]
            tw, tt = sum(x[1] for x in tie), sum(x[1] * x[2] for x in tie)
            take = min(left, tw)
            hits += tt * take / tw
            left -= take
        assert abs(g.top_events - hits) < 1e-9 and abs(g.top_fraction - hits / k) < 1e-9 and abs(g.top_capture_fraction - hits / g.events) < 1e-9
    plan = totals.sparkSession.createDataFrame([], totals.schema)  # the stored table itself has no plan left
    assert plan.columns == totals.columns


def test_policies_flip(spark, rows):
    w = rescore.draws(rows, "cluster", 3, 5)
    batch = logistic.fit_batch(rows, "y", TERMS, MODELS, "fold", (1, 2, 3), w, 4)
    totals = rescore.resampled_totals(rows, batch, w, 4, fold="fold", scores={"Raw": F.col("a")}).where("series = 'Raw'")
    got = {(r.resample, r.objective, r.requested_fraction): r for r in rescore.policy_draws(totals).collect()}
    x = rows.join(w, "cluster").withColumn("score", F.col("a"))
    table = ranking.policy_table(x, {"Raw": F.col("a")}, "y", ["resample", "weight", "row_id"])
    cut = ranking.cutoffs(table, ["resample", "objective", "policy"], "target", "score", (0.1, 0.25, 0.5), "weight")
    for r in cut.select("*", ranking.expected_targets().alias("e")).collect():
        g = got[r.resample, r.objective, r.requested_fraction]
        assert (g.capacity, g.target_total) == (r.capacity, r.total_t) and abs(g.expected_targets - r.e) < 1e-9
    assert len(got) == 24


@pytest.mark.parametrize("broadcast", (True, False))
def test_paired_auc(spark, rows, monkeypatch, sliced, broadcast):
    monkeypatch.setattr(rescore, "BLOCK", 13)
    if not broadcast:
        monkeypatch.setattr(rescore, "VECTOR_BYTES", 0)
    s = rows.select("cluster", "y", F.lit("m").alias("model"), F.round("b", 1).alias("p")).unionByName(rows.select("cluster", "y", F.lit("r").alias("model"), (F.col("a") / 40).alias("p")))
    w = rescore.draws(rows, "cluster", 20, 8)
    got = {(r.model, r.resample): r.auc for r in rescore.auc_by_resample(s, "model", "cluster", "y", "p", w, 21).collect()}
    want = ranking.rank_metrics(s.join(w, "cluster"), ["model", "resample"], w="weight").collect()
    assert len(got) == 42
    for r in want:
        assert abs(got[r.model, r.resample] - r.roc_auc) < 1e-9
    (d,) = rescore.paired_auc_intervals(s, "cluster", [("m", "r")], 20, 8).collect()
    assert abs(d.estimate - (got["m", 0] - got["r", 0])) < 1e-12 and d.lower <= d.upper and d.estimable_resamples == 20


def test_wide_vectors_are_not_exchanged(spark, rows):
    s = rows.select("cluster", "y", F.lit("m").alias("model"), F.col("b").alias("p"))
    seen = []

    class Stop(Exception):
        pass

    def look(df, name="stage"):
        if name == "scanned":
            seen.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
            raise Stop
        return original(df, name)

    original = rescore.stored
    rescore.stored = look
    try:
        with pytest.raises(Stop):
            rescore.auc_by_resample(s, "model", "cluster", "y", "p", rescore.draws(rows, "cluster", 5, 1), 6)
    finally:
        rescore.stored = original
    exchanges = [part for part in seen[0].split("\n\n") if ") Exchange" in part or "ShuffleQueryStage" in part]
    assert exchanges and not any("w#" in part for part in exchanges)


def test_failures(spark, rows):
    some = rows.withColumn("y", F.when(F.col("cluster") == 1, F.col("y")).otherwise(0))
    w = resample.multiplicities(some, "cluster", 30, 2).withColumn("resample", F.col("resample") + 1)
    w = w.unionByName(some.select("cluster").distinct().select(F.lit(0).cast("long").alias("resample"), "cluster", F.lit(1).cast("long").alias("weight")))
    batch = logistic.fit_batch(some, "y", TERMS, MODELS, None, (0,), w, 31)
    lost = {r.resample for r in w.groupBy("resample").agg(F.max(F.when(F.col("cluster") == 1, 1).otherwise(0)).alias("has")).where("has = 0").collect()}
    assert lost and batch.failed_resamples() == lost and {r.reason for r in batch.failures(spark).collect()} == {"Training sample has only one outcome class"}
    totals = rescore.resampled_totals(some, batch, w, 31)
    assert {r.resample for r in totals.select("resample").distinct().collect()} == set(range(31)) - lost
    with pytest.raises(RuntimeError):
        rescore.audit(batch, 30)


@pytest.mark.parametrize("matrix", (True, False))
def test_equal_rows_are_one(spark, rows, monkeypatch, matrix):
    """Repeated rows count in fits and totals, and no task is given them again and again."""
    if not matrix:
        monkeypatch.setattr(resample, "MATRIX_ENTRIES", 0)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("row_id") % 3 + 1))).drop("copy")
    w = rescore.draws(many, "cluster", 6, 3)
    batch = logistic.fit_batch(many, "y", TERMS, MODELS, "fold", (1, 2, 3), w, 7)
    assert logistic.spread(many.drop("row_id"), 840, 7).count() == rows.drop("row_id").distinct().count()
    # every resample written out as rows of its own and fitted alone
    for b in (0, 4):
        drawn = many.join(w.where(F.col("resample") == b), "cluster").withColumn("one", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
        alone = logistic.fit_batch(drawn, "y", TERMS, MODELS, "fold", (1, 2, 3))
        for f in (1, 2, 3):
            assert np.allclose(batch.get("Both", f, b).beta, alone.get("Both", f).beta, atol=1e-7)
    totals = rescore.resampled_totals(many, batch, w, 7, fold="fold", scores={"Raw": F.col("a")})
    got = {(r.series, r.resample): r for r in rescore.metric_draws(totals).collect()}
    p = logistic.predict(many, batch, ("row_id", "y"), "fold", w)
    want = ranking.model_metrics(p, ["model", "resample"], benchmark=None, w="weight").collect()
    assert len(want) == 14 and len(got) == 21
    for r in want:
        g = got[r.model, r.resample]
        assert (g.observations, g.events) == (r.observations, r.events)
        assert abs(g.brier_score - r.brier_score) < 1e-9 and abs(g.log_loss - r.log_loss) < 1e-9 and abs(g.roc_auc - r.roc_auc) < 2e-3


def test_counters_and_entries_agree(monkeypatch):
    r = np.random.default_rng(1)
    of, y = np.arange(3), r.integers(0, 2, 40)
    blocks = [(rescore.score_bin(1 / (1 + np.exp(-r.normal(0, s, (3, 40))))), r.integers(0, 4, (3, 40))) for s in (1, 1, 9)]
    out = []
    for cells in (1 << 23, 1 << 16, 0):
        monkeypatch.setattr(rescore, "CELLS", cells)
        h = rescore._Histogram(3)
        for bins, w in blocks:
            h.count(of, bins, y, w)
        h.close()
        h.merge()
        out.append([x.tolist() for x in h.parts[0]])
    assert out[0] == out[1] == out[2] and sum(out[0][1]) == sum(int(w.sum()) for _, w in blocks)
