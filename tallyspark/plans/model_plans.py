"""Model queries: scaling, folds, cross-fitting, temporal split, refit bootstrap, inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logit
from ..operators import checks, cohorts, folds, inference, logistic, ranking, reconcile, resample, rescore, summaries
from ..operators.logistic import Model
from ..session import stored
from ..settings import DEFAULTS
from . import tables as t
from .metric_plans import draws_sql
from .tables import rnd, rounded, sql

TERMS = {"z_coverage": ("coverage", "identity"), "z_interval": ("interval_years", "identity"), "z_seedling_count": ("seedling_count", "log1p"),
         "z_sapling_tpa": ("sapling_tpa", "log1p"), "z_established_ba": ("established_ba", "log1p")}
_D = ("z_coverage", "z_interval")
PREV, DESIGN, COUNT, STAGE = "Prevalence", "Observation design", "Seedling count and design", "Maple stages and design"
SPECS = {PREV: (), DESIGN: _D, COUNT: (*_D, "z_seedling_count"), STAGE: tuple(TERMS)}


def models(penalty=1.0):
    return {n: Model(x, penalty) for n, x in SPECS.items()}


PAIRS = [(COUNT, DESIGN), (STAGE, COUNT)]
FIELDS = ["brier_score", "log_loss", "roc_auc", "average_precision"]


@t.stage("folded")
def folded(spark, sf):
    c = t.cohort(spark, sf)
    a = folds.balanced_folds(c, "cluster", 5)
    return c.join(a.select("cluster", "fold"), "cluster")


def train_only_scaling(spark, sf):
    c = t.cohort(spark, sf).withColumn("fold", F.col("cluster") % 5)
    return rounded(logistic.training_scales(c, "fold", TERMS), 8)


SCALING_SQL = sql("cohort", """SELECT CAST(f AS INTEGER) AS held_out, term, count(*) AS training_n, rnd(avg(v),8) AS center, rnd(stddev_samp(v),8) AS scale, stddev_samp(v)<1e-12 AS constant
  FROM cohort, range(5) r(f), LATERAL (VALUES ('z_coverage',coverage),('z_interval',interval_years),('z_seedling_count',ln(1e0+seedling_count)),
  ('z_sapling_tpa',ln(1e0+sapling_tpa)),('z_established_ba',ln(1e0+established_ba))) x(term,v) WHERE cluster%5<>f GROUP BY f, term""")


def greedy_folds(spark, sf):
    return folds.balanced_folds(t.cohort(spark, sf), "cluster", 5)


def _greedy_sql(event: bool) -> str:
    """The sequential rule spelled out as a recursive query over the ordered groups."""
    order = "observations DESC, events DESC, cluster" if event else "observations DESC, cluster"
    ev = "CAST(sum(y) AS BIGINT)" if event else "CAST(0 AS BIGINT)"
    return sql("cohort", f"""SELECT s.cluster, s.observations, s.events, CAST(g.fold AS INTEGER) AS fold FROM greedy g JOIN seq s ON s.i=g.i WHERE g.i>0""",
               f"""seq AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM (SELECT cluster, count(*) AS observations, {ev} AS events FROM cohort GROUP BY 1)),
greedy AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS fold, [0,0,0,0,0]::BIGINT[] AS o, [0,0,0,0,0]::BIGINT[] AS e, [0,0,0,0,0]::BIGINT[] AS c
 UNION ALL SELECT i, fold, list_transform(o, lambda x, j: x+CASE WHEN j=fold THEN observations ELSE 0 END), list_transform(e, lambda x, j: x+CASE WHEN j=fold THEN events ELSE 0 END),
  list_transform(c, lambda x, j: x+CASE WHEN j=fold THEN 1 ELSE 0 END) FROM (
  SELECT s.i, s.observations, s.events, g.o, g.e, g.c, list_sort(list_transform(range(1,6), lambda j: [g.o[j], g.e[j], g.c[j], j]))[1][4] AS fold
  FROM greedy g JOIN seq s ON s.i=g.i+1))""").replace("WITH ", "WITH RECURSIVE ", 1)


def event_folds(spark, sf):
    return folds.folds_with_both_classes(t.cohort(spark, sf), "cluster", "y", 5)[0]


def fold_leakage(spark, sf):
    """Keys that cross folds, a row a kind of key: units and clusters may not, calendar years do, as the folds know nothing of them."""
    f = folded(spark, sf)
    parts = [checks.groups_crossing(f, k, "fold").agg(F.count(F.lit(1)).alias("crossing")).select(F.lit(k).alias("group_key"), "crossing") for k in ("unit", "cluster", "baseline_year")]
    return reduce(DataFrame.unionByName, parts)


_FOLDS_HEAD = _greedy_sql(False)[:_greedy_sql(False).rindex("SELECT s.cluster")].rstrip()
LEAK_SQL = _FOLDS_HEAD + """, assigned AS (SELECT c.*, g.fold FROM cohort c JOIN seq s ON s.cluster=c.cluster JOIN greedy g ON g.i=s.i)
SELECT group_key, count(*) FILTER (folds>1) AS crossing FROM (SELECT 'unit' AS group_key, unit AS k, count(DISTINCT fold) AS folds FROM assigned GROUP BY unit
  UNION ALL SELECT 'cluster', cluster, count(DISTINCT fold) FROM assigned GROUP BY cluster UNION ALL SELECT 'baseline_year', baseline_year, count(DISTINCT fold) FROM assigned GROUP BY baseline_year) GROUP BY group_key"""


def crossfit(rows, penalty=1.0, specs=None, weights=None, resamples=1, override=None, keep=("row_id", "unit", "cluster", "y")):
    batch = logistic.fit_batch(rows, "y", TERMS, specs or models(penalty), "fold", (1, 2, 3, 4, 5), weights, resamples)
    # a cohort is scored whole or not at all: failed resamples are left out, a failed fit of the cohort itself is an error
    if weights is not None:
        batch.gate(resamples)
        weights = weights.where(~F.col("resample").isin(sorted(batch.failed_resamples()))) if batch.failed_resamples() else weights
    elif len(batch.done()) < len(batch.fits):
        raise logistic.IncompletePredictions(batch)
    # several metrics read the predictions, so they are kept as a stage table
    return batch, stored(logistic.predict(rows, batch, keep, "fold", weights, override=override), "predictions")


def full_metrics(p, groups=("model",), benchmark=PREV, calibrate=True, weight=None):
    m = ranking.model_metrics(p, list(groups), benchmark=benchmark, w=weight)
    k = ranking.select_capacity(p, list(groups), "y", "p", (0.25,), "row_id", "unit", weight).select(
        *groups, F.col("capacity").alias("top_capacity"), F.col("deterministic_targets").alias("top_events"),
        F.try_divide("deterministic_targets", "capacity").alias("top_fraction"), F.col("expected_targets").alias("tie_neutral_expected"))
    m = m.join(k, list(groups))
    if calibrate:
        m = m.join(logistic.calibration(p.where(F.col("model") != benchmark), list(groups), w=weight), list(groups), "left")
    return m


def ridge_crossfit(spark, sf):
    _, p = crossfit(folded(spark, sf))
    return rounded(full_metrics(p))


def crossfit_diagnostics(spark, sf):
    batch, _ = crossfit(folded(spark, sf))
    return rounded(batch.diagnostics(spark).drop("max_gradient"))


POPULATIONS = {"All pairs": "true", "Baseline seedlings detected": "seedling_count > 0"}
# cohort filter and penalty of each sensitivity analysis; folds stay as they are
SENSITIVITIES = {"Whole coverage": ("coverage = 1", 1.0), "Follow-up manual at least 9": ("manual >= 9", 1.0), "Long interval": ("interval_years >= 0.25", 1.0),
                 "Manual at least 6": ("manual >= 6", 1.0), "Ridge penalty 4": ("true", 4.0), "Unpenalised": ("true", 0.0)}


def model_cohort(spark, sf):
    """The cohort that every model uses, numbered, after all rules on its fields hold."""
    d = t.cohort(spark, sf).withColumn("seedling_detected", F.col("seedling_count") > 0)
    ready = cohorts.model_ready(d, F.lit(True), "y", ("seedling_count", "sapling_tpa", "established_ba", "coverage", "interval_years"), "coverage", "interval_years",
                                ("seedling_count",), {"seedling_count": "seedling_detected"}, ("unit", "row_id"))
    return ready.select("audit_row", "unit", "row_id", "y")


COHORT_SQL = sql("cohort", "SELECT row_number() OVER (ORDER BY unit, row_id) AS audit_row, unit, row_id, y FROM cohort")


def sensitivity_suite(spark, sf):
    """Cohort filters and penalties on the fixed folds, for both populations; analyses that fail become rows, not errors."""
    f = folded(spark, sf)
    parts = {}
    for population, who in POPULATIONS.items():
        for label, (kept, lam) in SENSITIVITIES.items():
            try:
                _, p = crossfit(f.where(who).where(kept), lam)
                m = ranking.model_metrics(p, ["model"]).select("model", "observations", "events", "brier_score", "roc_auc", F.lit(0).alias("failed_fits"))
            except logistic.IncompletePredictions as e:
                failed = len(e.batch.fits) - len(e.batch.done())
                m = spark.createDataFrame([(n, failed) for n in SPECS], "model string, failed_fits int")
            parts[f"{population}|{label}"] = m.withColumns({"population": F.lit(population), "sensitivity": F.lit(label), "penalty": F.lit(lam)})
    return rounded(cohorts.stacked(parts, "analysis").drop("analysis"))


LATER = 2001  # first year of the later period


@t.stage("temporal_rows")
def temporal_rows(spark, sf):
    """All rows of the later period (fold 1) and all earlier rows of units that the later period does not have (fold 0)."""
    rows = reconcile.development_split(t.cohort(spark, sf), "unit", F.col("measyear") >= LATER)
    return rows.where("split IS NOT NULL").withColumn("fold", (F.col("split") == "later").cast("int")).drop("split")


def temporal_sides(rows, later):
    return reconcile.split_support(rows, later, "unit", "cluster", "y", "measyear", "manual", "interval_years")


def temporal_split_support(spark, sf):
    """Both sides of the split before and after rows of shared units are left out."""
    cut = F.col("measyear") >= LATER
    all_rows = temporal_sides(t.cohort(spark, sf), cut).withColumn("rows", F.lit("All pairs"))
    kept = temporal_sides(temporal_rows(spark, sf), cut).withColumn("rows", F.lit("Without shared units"))
    return rounded(all_rows.unionByName(kept))


SPLIT_SQL = sql("cohort", """SELECT rows, CASE WHEN measyear>=2001 THEN 'Testing' ELSE 'Training' END AS split, count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, count(DISTINCT unit) AS units,
  count(DISTINCT cluster) AS clusters, min(measyear) AS year_min, max(measyear) AS year_max, rnd(min(manual),6) AS manual_min, rnd(max(manual),6) AS manual_max,
  count(*) FILTER (manual>=9) AS late_manual_conditions, rnd(min(interval_years),6) AS interval_min, rnd(max(interval_years),6) AS interval_max, rnd(quantile_cont(interval_years,5e-1),6) AS interval_median,
  CASE rows WHEN 'All pairs' THEN (SELECT count(*) FROM (SELECT unit FROM cohort GROUP BY unit HAVING bool_or(measyear>=2001) AND bool_or(measyear<2001))) ELSE 0 END AS units_shared
  FROM (SELECT 'All pairs' AS rows, * FROM cohort UNION ALL SELECT 'Without shared units', * FROM cohort c WHERE measyear>=2001 OR NOT EXISTS (SELECT 1 FROM cohort l WHERE l.unit=c.unit AND l.measyear>=2001))
  GROUP BY ALL""")


def temporal(spark, sf, override=None):
    rows = temporal_rows(spark, sf)
    shared = checks.shared_keys(rows.where("fold=1"), rows.where("fold=0"), "unit")
    if not shared.isEmpty():
        raise checks.AuditFailure("units overlap the temporal split")
    reconcile.gate_split(temporal_sides(rows, F.col("fold") == 1))
    batch = logistic.fit_batch(rows, "y", TERMS, models(), "fold", (1,))
    return batch, stored(logistic.predict(rows, batch, ("row_id", "unit", "cluster", "y", "seedling_count", "coverage", "sapling_tpa"), "fold",
                                          override=override), "predictions")


def temporal_check(spark, sf):
    _, p = temporal(spark, sf)
    return rounded(full_metrics(p))


def temporal_support(spark, sf):
    rows = temporal_rows(spark, sf)
    per = rows.groupBy((F.col("fold") == 1).alias("later")).agg(
        F.count(F.lit(1)).alias("conditions"), F.sum("y").alias("events"), F.countDistinct("cluster").alias("clusters"), F.min("measyear").alias("year_min"), F.max("measyear").alias("year_max"))
    unseen = checks.unseen_keys(rows.where("fold=0"), rows.where("fold=1"), "cluster").agg(F.count(F.lit(1)).alias("unseen_clusters"))
    return per.crossJoin(unseen)


TSUP_SQL = sql("cohort", """SELECT measyear>=2001 AS later, count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, count(DISTINCT cluster) AS clusters, min(measyear) AS year_min, max(measyear) AS year_max,
  (SELECT count(*) FROM (SELECT cluster FROM lastrow WHERE measyear>=2001 EXCEPT SELECT cluster FROM lastrow WHERE measyear<2001)) AS unseen_clusters FROM lastrow GROUP BY 1""",
               "lastrow AS (SELECT * FROM cohort c WHERE measyear>=2001 OR NOT EXISTS (SELECT 1 FROM cohort l WHERE l.unit=c.unit AND l.measyear>=2001))")


def common_horizon(spark, sf):
    """Policies on temporal predictions, with realised and with a common scoring interval."""
    out = None
    for label, over in (("Realised interval", None), ("Common interval", {"interval_years": 1.0})):
        _, p = temporal(spark, sf, over)
        s = policy_rows(p, ["row_id", "unit", "y", "seedling_count", "coverage", "sapling_tpa"])
        m = ranking.policy_sweep(s, policy_set(), "y", "row_id", "unit").withColumn("assessment", F.lit(label))
        out = m if out is None else out.unionByName(m)
    return rounded(out.select("assessment", "objective", "policy", "requested_fraction", "capacity", "expected_targets", "selected_target_fraction"))


def policy_rows(p, keep):
    pick = [F.max(F.when(F.col("model") == m, F.col("p"))).alias(a) for m, a in ((COUNT, "p_count"), (STAGE, "p_stage"))]
    return p.groupBy(*keep).agg(*pick)


def policy_set():
    return {"Raw seedling count": F.col("seedling_count"), "Count per sampled coverage": F.col("seedling_count") / F.col("coverage"),
            "Sapling presence": (F.col("sapling_tpa") > 0).cast("int"), "Count model": F.col("p_count"), "Maple-stage model": F.col("p_stage")}


R, SEED = 300, 20260908
NAMES = {COUNT: "Count model", STAGE: "Maple-stage model"}


def refits(spark, sf, specs=None, resamples=R):
    """Scaling and every fit repeated in the sample (resample 0) and in each resample of whole clusters, folds fixed."""
    rows = folded(spark, sf)
    weights = stored(rescore.draws(rows, "cluster", resamples, SEED), "draws")
    return rows, weights, logistic.fit_batch(rows, "y", TERMS, specs or models(), "fold", (1, 2, 3, 4, 5), weights, resamples + 1)


_RUNS: dict = {}


def refit_run(spark, sf):
    """(what the metrics of all resamples need, the fits that failed): one set of fits and one scan of the rows for all queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        rows, weights, batch = refits(spark, sf)
        rescore.audit(batch, R)
        fixed = {n: e for n, e in policy_set().items() if n not in NAMES.values()}
        totals = rescore.resampled_totals(rows, batch, weights, R + 1, fold="fold", scores=fixed)
        _RUNS[key] = totals, stored(batch.failures(spark), "failures")
    return _RUNS[key]


@t.stage("refit_draws")
def refit_draws(spark, sf):
    """Eight metrics of every model in the sample and in every resample."""
    models_only = refit_run(spark, sf)[0].where(F.col("series").isin(*SPECS))
    return rescore.metric_draws(models_only, benchmark=PREV).withColumnRenamed("series", "model")


def refit_bootstrap(spark, sf):
    """Estimates and percentile intervals of eight metrics with scaling and every fit repeated per resample, folds fixed."""
    long = refit_draws(spark, sf).unpivot(["resample", "model"], list(rescore.METRICS), "metric", "value")
    return rounded(rescore.intervals(long, ["model", "metric"], "value", R))


def refit_paired(spark, sf):
    d = ranking.paired_differences(refit_draws(spark, sf), PAIRS, rescore.METRICS, ["resample"]).where("matched_cohort")
    return rounded(rescore.intervals(d, ["model", "reference", "metric"], "difference", R), 8)


def refit_audit(spark, sf):
    """Resamples requested, succeeded and failed. A resample fails where a training set has one outcome class only."""
    f = folded(spark, sf)
    w = resample.multiplicities(f, "cluster", R, SEED)
    cell = f.groupBy("cluster", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("e")).join(w, "cluster")
    per = cell.groupBy("resample", "fold").agg(F.sum(F.col("weight") * F.col("n")).alias("n"), F.sum(F.col("weight") * F.col("e")).alias("e"))
    every = per.groupBy("resample").agg(F.sum("n").alias("all_n"), F.sum("e").alias("all_e"), F.collect_list(F.struct("fold", "n", "e")).alias("folds"))  # five folds
    one_class = F.exists("folds", lambda x: ~((F.col("all_e") > x["e"]) & (F.col("all_e") - x["e"] < F.col("all_n") - x["n"])))
    told = every.agg(F.count_if(one_class).cast("int").alias("one_class_resamples"))
    totals, failures = refit_run(spark, sf)
    done = totals.where(F.col("resample") > 0).agg(F.countDistinct("resample").cast("int").alias("resamples_succeeded"))
    lost = failures.agg(F.countDistinct("resample").cast("int").alias("resamples_failed"))
    return done.crossJoin(lost).crossJoin(told).select(F.lit(R).alias("resamples_requested"), "resamples_succeeded", "resamples_failed", F.lit(SEED).alias("seed"), "one_class_resamples")


def refit_failures(spark, sf):
    """One row a fit that failed in a resample, with the reason; none where all succeeded."""
    return refit_run(spark, sf)[1]


ONE_BINARY = {"Prevalence": Model((), 0.0), "One binary": Model(("z_present",), 0.0)}


def refit_closed_form(spark, sf):
    """The resampled refits of one unpenalised indicator, whose fits are event fractions that plain SQL can repeat."""
    rows = t.cohort(spark, sf).withColumn("fold", F.col("cluster") % 5 + 1).withColumn("present", (F.col("seedling_count") > 0).cast("double"))
    terms = {"z_present": ("present", "identity")}
    weights = stored(rescore.draws(rows, "cluster", R, SEED), "draws")
    batch = logistic.fit_batch(rows, "y", terms, ONE_BINARY, "fold", (1, 2, 3, 4, 5), weights, R + 1)
    rescore.audit(batch, R)
    totals = rescore.resampled_totals(rows, batch, weights, R + 1, fold="fold")
    long = rescore.metric_draws(totals, benchmark="Prevalence").unpivot(["resample", "series"], list(rescore.METRICS), "metric", "value")
    return rounded(rescore.intervals(long.withColumnRenamed("series", "model"), ["model", "metric"], "value", R), 5)


AUDIT_SQL = _FOLDS_HEAD + f""", {draws_sql(R, SEED)},
cell AS (SELECT c.cluster, g.fold, count(*) AS n, sum(y) AS e FROM cohort c JOIN seq s ON s.cluster=c.cluster JOIN greedy g ON g.i=s.i GROUP BY ALL),
per AS (SELECT resample, fold, sum(weight*n) AS n, sum(weight*e) AS e FROM cell JOIN mult ON mult.cluster=cell.cluster GROUP BY ALL),
bad AS (SELECT resample, bool_or(total_e-e<=0 OR total_e-e>=total_n-n) AS lost FROM (SELECT *, sum(n) OVER (PARTITION BY resample) AS total_n, sum(e) OVER (PARTITION BY resample) AS total_e FROM per) GROUP BY resample)
SELECT CAST({R} AS INTEGER) AS resamples_requested, CAST(count(*) FILTER (NOT lost) AS INTEGER) AS resamples_succeeded, CAST(count(*) FILTER (lost) AS INTEGER) AS resamples_failed,
  CAST({SEED} AS INTEGER) AS seed, CAST(count(*) FILTER (lost) AS INTEGER) AS one_class_resamples FROM bad"""

CLOSED_SQL = sql("cohort", f"""SELECT model, metric, rnd(max(v) FILTER (resample=-1),5) AS estimate, rnd(quantile_cont(v,25e-3) FILTER (resample>=0),5) AS lower, rnd(quantile_cont(v,975e-3) FILTER (resample>=0),5) AS upper,
  count(v) FILTER (resample>=0) AS estimable_resamples, CAST({R} AS INTEGER) AS resamples FROM long GROUP BY ALL""", draws_sql(R, SEED) + """,
cells AS (SELECT cluster, cluster%5+1 AS fold, seedling_count>0 AS g, count(*) AS n, sum(y) AS e FROM cohort GROUP BY ALL),
wc AS (SELECT resample, fold, g, CAST(sum(weight*n) AS DOUBLE) AS w, CAST(sum(weight*e) AS DOUBLE) AS t FROM cells
  JOIN (SELECT * FROM mult UNION ALL SELECT DISTINCT -1, cluster, 1 FROM cohort) m ON m.cluster=cells.cluster GROUP BY ALL),
pred AS (SELECT model, a.resample, a.fold, a.g, a.w, a.t, sum(b.t)/sum(b.w) AS p FROM wc a, wc b, (VALUES ('One binary'),('Prevalence')) x(model)
  WHERE a.resample=b.resample AND a.fold<>b.fold AND (a.g=b.g OR model='Prevalence') GROUP BY ALL),
bins AS (SELECT model, resample, floor(log2(p))*2048+floor(CAST(p AS FLOAT)/pow(2e0,floor(log2(p)))*2048) AS s, sum(w) AS w, sum(t) AS t FROM pred GROUP BY ALL),
ord AS (SELECT *, sum(w) OVER u-w AS bw, sum(t) OVER u-t AS bt, sum(w) OVER (PARTITION BY model, resample) AS tw, sum(t) OVER (PARTITION BY model, resample) AS tt FROM bins WINDOW u AS (PARTITION BY model, resample ORDER BY s)),
rk AS (SELECT model, resample, sum(t*((bw-bt)+(w-t)/2))/(max(tt)*(max(tw)-max(tt))) AS auc, sum(t*(tt-bt)/(tw-bw))/max(tt) AS ap FROM ord GROUP BY ALL),
top AS (SELECT model, resample, floor(tw*25e-2) AS k, (tt-bt-t)+(floor(tw*25e-2)-(tw-bw-w))*t/w AS hits, tt FROM ord WHERE tw-bw-w<floor(tw*25e-2) AND floor(tw*25e-2)<=tw-bw),
loss AS (SELECT model, resample, sum(t*pow(1-p,2)+(w-t)*pow(p,2))/sum(w) AS brier, -sum(t*ln(p)+(w-t)*ln(1-p))/sum(w) AS ll FROM pred GROUP BY ALL),
long AS (SELECT l.model, l.resample, metric, v FROM loss l JOIN rk ON rk.model=l.model AND rk.resample=l.resample JOIN top ON top.model=l.model AND top.resample=l.resample,
  LATERAL (VALUES ('brier_score',brier),('log_loss',ll),('roc_auc',CASE WHEN l.model<>'Prevalence' THEN auc END),('average_precision',CASE WHEN l.model<>'Prevalence' THEN ap END),
  ('top_fraction',hits/k),('top_no_event_fraction',1-hits/k),('top_capture_fraction',hits/tt),('top_events',hits)) y(metric,v))""")


def policy_bootstrap(spark, sf):
    """Intervals of the fraction of targets a policy selects, and of its difference from a reference policy."""
    totals = refit_run(spark, sf)[0].where(~F.col("series").isin(PREV, DESIGN))
    named = F.col("series")
    for model, policy in NAMES.items():
        named = F.when(F.col("series") == model, policy).otherwise(named)
    e = stored(rescore.policy_draws(totals.withColumn("series", named)), "policy-draws")
    d = ranking.policy_pairs(e, [("Count model", "Raw seedling count"), ("Maple-stage model", "Raw seedling count"), ("Maple-stage model", "Count model")],
                             ["resample", "objective", "requested_fraction"]).where("matched_cohort")
    keys = ["objective", "policy", "reference", "requested_fraction"]
    single = e.select("resample", "objective", "policy", F.lit(None).cast("string").alias("reference"), "requested_fraction", F.col("selected_target_fraction").alias("value"))
    both = single.unionByName(d.select("resample", *keys, F.col("target_fraction_difference").alias("value")))
    return rounded(rescore.intervals(both.where("value IS NOT NULL"), keys, "value", R))


def incremental_audit(spark, sf):
    """Six specifications on saved folds with unpenalised fits, top-quarter capture and loss decomposition."""
    specs = {"Prevalence benchmark": Model((), 0), "Starting density only": Model(("z_seedling_count",), 0), "Starting abundance and observation": Model((*_D, "z_seedling_count"), 0),
             "Structure": Model((*_D, "z_seedling_count", "z_established_ba"), 0), "Structure and stages": Model(tuple(TERMS), 0), "Stages only": Model((*_D, "z_sapling_tpa"), 0)}
    _, p = crossfit(folded(spark, sf), specs=specs)
    return rounded(full_metrics(p, benchmark="Prevalence benchmark").select("model", "observations", "events", "brier_score", "roc_auc", "calibration_slope", "offset_intercept", "top_events"))


def glm_odds_ratios(spark, sf):
    rows = t.cohort(spark, sf)
    batch = logistic.fit_batch(rows, "y", TERMS, models(0.0))
    if batch.unstable():
        raise RuntimeError(f"separated fits: {batch.unstable()}")
    fit = batch.get(STAGE)
    return rounded(inference.odds_ratios(spark, fit, inference.cluster_robust(rows, "y", "cluster", fit, TERMS)))


def nested_models(spark, sf):
    rows = t.cohort(spark, sf)
    batch = logistic.fit_batch(rows, "y", TERMS, models(0.0))
    m = ranking.model_metrics(logistic.predict(rows, batch, ("row_id", "y")), ["model"], benchmark=None).select("model", "brier_score", "roc_auc")
    return rounded(inference.compare_models(spark, batch, list(SPECS)).join(m, "model"))


# registry -> (rows, outcome, models in the order in which they are compared); the incremental audit has its own penalty
REGISTRIES = {
    "recruitment": ("true", "y", SPECS),
    "loss": ("seedling_count > 0", "1 - y", {"Prevalence benchmark": (), "Starting abundance and observation": (*_D, "z_seedling_count"),
                                             "Stage structure": (*_D, "z_seedling_count", "z_sapling_tpa", "z_established_ba")}),
    "appearance": ("seedling_count <= 1", "y", {"Prevalence benchmark": (), "Observation": _D, "Observation and structure": (*_D, "z_sapling_tpa", "z_established_ba")}),
    "cross-sectional": ("true", "CASE WHEN seedling_count = 0 THEN 1 ELSE 0 END", {"Prevalence benchmark": (), "Established trees": ("z_established_ba",),
                                                                                   "Established trees and saplings": ("z_established_ba", "z_sapling_tpa", "z_coverage")}),
}


def registry_rows(spark, sf, name):
    kept, outcome, _ = REGISTRIES[name]
    return t.cohort(spark, sf).where(kept).withColumn("y", F.expr(outcome).cast("int"))


def registry_support(spark, sf):
    """Rows, events and events per slope of every model of every registry."""
    parts = {}
    for name, (_, _, specs) in REGISTRIES.items():
        n = registry_rows(spark, sf, name).agg(F.count(F.lit(1)).alias("observations"), F.sum("y").cast("long").alias("events"))
        each = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(m).alias("model"), F.lit(len(x)).alias("slopes")) for i, (m, x) in enumerate(specs.items())])
        parts[name] = n.select(F.inline(each), "observations", "events").withColumn("events_per_slope", F.try_divide(F.least("events", F.col("observations") - F.col("events")), F.nullif("slopes", F.lit(0))))
    return rounded(cohorts.stacked(parts, "registry"))


REGISTRY_SQL = sql("cohort", "SELECT registry, CAST(position AS INTEGER) AS position, model, CAST(slopes AS INTEGER) AS slopes, observations, events, rnd(least(events,observations-events)/nullif(CAST(slopes AS DOUBLE),0),6) AS events_per_slope FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS registry, position, model, slopes, count(*) AS observations, CAST(sum({outcome.replace(' ', ' ')}) AS BIGINT) AS events FROM cohort, (VALUES "
    + ",".join(f"({i + 1},'{m}',{len(x)})" for i, (m, x) in enumerate(specs.items())) + f") v(position,model,slopes) WHERE {kept} GROUP BY ALL" for name, (kept, outcome, specs) in REGISTRIES.items()) + ")")


def registry_fits(spark, sf):
    """The model sequence of every registry: likelihood-ratio tests, AIC, and Brier score and AUC on the rows it was fitted to."""
    parts = {}
    for name, (_, _, specs) in REGISTRIES.items():
        rows = registry_rows(spark, sf, name)
        batch = logistic.fit_batch(rows, "y", TERMS, {m: Model(x, 0.0) for m, x in specs.items()})
        m = ranking.model_metrics(logistic.predict(rows, batch, ("row_id", "y")), ["model"], benchmark=None).select("model", "brier_score", "roc_auc")
        parts[name] = inference.compare_models(spark, batch, list(specs)).join(m, "model")
    return rounded(cohorts.stacked(parts, "registry"))


def final_fits(spark, sf):
    """Full-data coefficients of the models, one column per population."""
    rows = t.cohort(spark, sf)
    out = None
    for label, d in (("all_pairs", rows), ("baseline_detected", rows.where("seedling_count > 0"))):
        c = logistic.fit_batch(d, "y", TERMS, models()).coefficients(spark).withColumn("population", F.lit(label))
        out = c if out is None else out.unionByName(c)
    return rounded(out.groupBy("model", "position", "term").pivot("population", ["all_pairs", "baseline_detected"]).agg(F.max("estimate")))


def spline_comparison(spark, sf):
    rows, cols = inference.with_natural_spline(t.cohort(spark, sf), "established_ba", "log1p", 3, "s")
    terms = {**TERMS, **{c: (c, "identity") for c in cols}}
    rest = ("z_coverage", "z_interval", "z_seedling_count")
    batch = logistic.fit_batch(rows, "y", terms, {"Linear term": Model((*rest, "z_established_ba"), 0), "Natural spline term": Model((*rest, *cols), 0)})
    return rounded(inference.compare_models(spark, batch, ["Linear term", "Natural spline term"]))


def candidate_forms(spark, sf):
    """None, continuous, binary and presence-plus-amount forms of one predictor."""
    rows = t.cohort(spark, sf).withColumn("present", (F.col("sapling_tpa") > 0).cast("double"))
    pos = rows.where("sapling_tpa > 0").agg(F.avg(F.log1p("sapling_tpa")).alias("m"), F.stddev_samp(F.log1p("sapling_tpa")).alias("s")).first()
    rows = rows.withColumn("amount", F.when(F.col("sapling_tpa") > 0, (F.log1p("sapling_tpa") - pos["m"]) / pos["s"]).otherwise(0.0))
    terms = {**TERMS, "present": ("present", "identity"), "amount": ("amount", "identity")}
    b = (*_D, "z_seedling_count")
    specs = {"No stage term": b, "Continuous amount": (*b, "z_sapling_tpa"), "Binary presence": (*b, "present"), "Presence plus positive amount": (*b, "present", "amount")}
    batch = logistic.fit_batch(rows, "y", terms, {n: Model(x, 0.0) for n, x in specs.items()})
    return rounded(inference.compare_models(spark, batch, list(specs), nested=False))


# indicators that one dense information matrix is meant to hold
MAX_TYPES = 200


def type_sensitivity(spark, sf):
    """Add type indicators, or restrict to one type: both fits in one batch each."""
    rows = t.cohort(spark, sf).join(t.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("kind")), "unit")
    kinds = sorted(r[0] for r in rows.where("kind IS NOT NULL").select("kind").distinct().limit(MAX_TYPES + 1).collect())
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types: group them before the fit")
    rows = rows.withColumns({f"k{i}": (F.col("kind") == k).cast("double") for i, k in enumerate(kinds[1:])})
    terms = {**TERMS, **{f"k{i}": (f"k{i}", "identity") for i in range(len(kinds) - 1)}}
    b = logistic.fit_batch(rows, "y", terms, {"Primary": Model(tuple(TERMS), 0), "Type indicators": Model(tuple(terms), 0)})
    core = logistic.fit_batch(rows.where(F.col("kind") == kinds[0]), "y", TERMS, {"Restricted to one type": Model(tuple(TERMS), 0)})
    a = inference.compare_models(spark, b, ["Primary", "Type indicators"])
    a = a.unionByName(inference.compare_models(spark, core, ["Restricted to one type"]))
    focal = inference.wald_odds(spark, [b.get("Primary"), b.get("Type indicators"), core.get("Restricted to one type")], "z_seedling_count")
    return rounded(a.join(focal, "model"))


def influence_diagnostics(spark, sf):
    rows = t.cohort(spark, sf)
    fit = logistic.fit_batch(rows, "y", TERMS, {STAGE: Model(tuple(TERMS), 0.0)}).get(STAGE)
    infl = inference.influence(rows, "y", fit, TERMS, ["row_id"])
    cal = logistic.calibration(infl, [])
    auc = ranking.rank_metrics(infl, []).drop("average_precision")
    return rounded(inference.diagnostics(infl, fit).crossJoin(cal).crossJoin(auc))


def case_deletion(spark, sf):
    """Rows that cross a conventional cut of a deletion measure, with what they cross."""
    rows = t.cohort(spark, sf)
    fit = logistic.fit_batch(rows, "y", TERMS, {STAGE: Model(tuple(TERMS), 0.0)}).get(STAGE)
    d = inference.deletion(rows, "y", fit, TERMS, ["row_id"])
    return rounded(d.where("influential").select("row_id", "leverage", "dffits", "cook", "covariance_ratio", *inference.DELETION_FLAGS))


def deletion_summary(spark, sf):
    """How many rows cross each cut. The leverages of a fit add up to its number of coefficients."""
    rows = t.cohort(spark, sf)
    fit = logistic.fit_batch(rows, "y", TERMS, {STAGE: Model(tuple(TERMS), 0.0)}).get(STAGE)
    d = inference.deletion(rows, "y", fit, TERMS, ["row_id"])
    return rounded(d.agg(F.count(F.lit(1)).alias("conditions"), F.sum("leverage").alias("sum_leverage"), *[F.count_if(f).alias(f) for f in inference.DELETION_FLAGS],
                         F.count_if("influential").alias("influential")))


SEPARATED = {"Count and design": Model((*_D, "z_seedling_count"), 0.0), "With the outcome's own count": Model(("z_coverage", "z_entrants"), 0.0)}


def separation_flags(spark, sf):
    """Which specifications separate their training sets: one that holds the outcome's own count does."""
    rows = t.cohort(spark, sf).withColumn("fold", F.col("cluster") % 5 + 1).withColumn("some", (F.col("entrants") > 0).cast("double"))
    terms = {**TERMS, "z_entrants": ("some", "identity")}
    return rounded(inference.separation(rows, "y", "fold", (1, 2, 3, 4, 5), SEPARATED, terms))


SEP_SQL = sql("cohort", """SELECT model, CAST(f AS INTEGER) AS fold, CASE WHEN slopes=2 THEN 'complete' ELSE 'none' END AS separation, CAST(sum(y) AS BIGINT) AS training_events, rnd(sum(y)/CAST(slopes AS DOUBLE),6) AS events_per_slope
  FROM cohort, range(1,6) r(f), (VALUES ('Count and design',3),('With the outcome''s own count',2)) x(model,slopes) WHERE cluster%5+1<>f GROUP BY model, slopes, f""")


def vif(spark, sf):
    return rounded(inference.variance_inflation(t.cohort(spark, sf), TERMS))


VIF2_SQL = sql("cohort", """SELECT term, rnd(1/(1-r*r),6) AS vif FROM (SELECT corr(coverage, ln(1e0+seedling_count)) AS r FROM cohort), (VALUES ('z_coverage'),('z_seedling_count')) x(term)""")


def vif_two(spark, sf):
    """Two-term collinearity, where the closed form 1/(1-r^2) applies."""
    return rounded(inference.variance_inflation(t.cohort(spark, sf), {k: TERMS[k] for k in ("z_coverage", "z_seedling_count")}))


def model_support(spark, sf):
    return rounded(inference.support(t.cohort(spark, sf), "y", ["coverage", "interval_years", "seedling_count"], "cluster", "unit", 3))


SUPPORT_SQL = sql("cohort", """SELECT CAST(sum(n) AS BIGINT) AS cohort_n, CAST(sum(n) AS BIGINT) AS observations, CAST(sum(e) AS BIGINT) AS events, count(*) AS "groups", count(*) FILTER (n>=5) AS groups_supported,
  quantile_cont(CAST(n AS DOUBLE),5e-1) AS median_group_n, (SELECT count(DISTINCT unit) FROM cohort) AS units, 1e0 AS complete_case_fraction, rnd(sum(e)/sum(n),6) AS event_fraction,
  rnd(least(sum(e),sum(n)-sum(e))/3e0,6) AS events_per_parameter, count(*) FILTER (n>=5)>=30 AS random_effect_supported FROM (SELECT cluster, count(*) AS n, sum(y) AS e FROM cohort GROUP BY 1)""")


def term_choice(spark, sf):
    return rounded(inference.choose_terms(t.cohort(spark, sf), "y", ["z_coverage", "z_interval", "z_seedling_count"], ["z_sapling_tpa", "z_established_ba"], TERMS,
                                          ("z_sapling_tpa", "z_established_ba")))


def effect_band(spark, sf):
    rows = t.cohort(spark, sf)
    fit = logistic.fit_batch(rows, "y", TERMS, {STAGE: Model(tuple(TERMS), 0.0)}).get(STAGE)
    grid = inference.effect_grid(rows, "z_established_ba", TERMS)
    return rounded(inference.score_with_band(grid, fit, TERMS, ["point", "established_ba"]))


def fit_verification(spark, sf):
    """Second implementation: MLlib logistic regression on the same folds, largest prediction difference."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = folded(spark, sf)
    batch, p = crossfit(rows)
    out = None
    for model, fold in [(m, k) for m in SPECS if SPECS[m] for k in (1, 2, 3, 4, 5)]:
        fit = batch.get(model, fold)
        z = [x.alias(f"z{i}") for i, x in enumerate(inference.design(fit, TERMS)[1:])]
        d = VectorAssembler(inputCols=[f"z{i}" for i in range(len(z))], outputCol="features").transform(rows.select("row_id", "y", "fold", *z))
        m = LogisticRegression(labelCol="y", regParam=1.0 / fit.weight, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=200).fit(d.where(F.col("fold") != fold))
        q = m.transform(d.where(F.col("fold") == fold)).select("row_id", vector_to_array("probability")[1].alias("q"))
        diff = p.where((F.col("fold") == fold) & (F.col("model") == model)).join(q, "row_id").agg(F.count(F.lit(1)).alias("testing_n"), F.max(F.abs(F.col("p") - F.col("q"))).alias("d"))
        row = diff.select(F.lit(model).alias("model"), F.lit(fold).alias("fold"), "testing_n", (F.col("d") <= 1e-5).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def random_intercept(spark, sf):
    return rounded(inference.random_intercept(t.cohort(spark, sf), "y", "cluster", Model(("z_coverage", "z_interval")), TERMS), 5)


def temporal_policies_support(spark, sf):
    return summaries.range_medians(temporal_rows(spark, sf), ["interval_years", "coverage"])


RANGE_MED_SQL = sql("cohort", """SELECT 'interval_years' AS variable, min(interval_years) AS minimum, quantile_cont(interval_years,5e-1) AS median, max(interval_years) AS maximum FROM lastrow
  UNION ALL SELECT 'coverage', min(coverage), quantile_cont(coverage,5e-1), max(coverage) FROM lastrow""",
                    "lastrow AS (SELECT * FROM cohort c WHERE measyear>=2001 OR NOT EXISTS (SELECT 1 FROM cohort l WHERE l.unit=c.unit AND l.measyear>=2001))").replace(
    "min(interval_years)", "rnd(min(interval_years),6)")


# --- closed forms: the same estimator where SQL can state the answer -----------------------------

def logit_intercept_only(spark, sf):
    d = t.documents_cohort(spark, sf)
    f = logistic.fit_batch(d, "y", {"x": ("x", "identity")}, {"Intercept only": Model((), 0.0)}).get("Intercept only")
    return rounded(spark.createDataFrame([(int(f.weight), int(f.events), float(f.beta[0]), float(f.covariance[0, 0]) ** 0.5, f.loglik)],
                                         "n long, events long, estimate double, std_error double, log_likelihood double"))


INT_SQL = sql("docs", """SELECT n, e AS events, rnd(ln(e/CAST(n-e AS DOUBLE)),6) AS estimate, rnd(sqrt(n/CAST(e*(n-e) AS DOUBLE)),6) AS std_error,
  rnd(e*ln(e/CAST(n AS DOUBLE))+(n-e)*ln((n-e)/CAST(n AS DOUBLE)),6) AS log_likelihood FROM (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS e FROM docs)""")


def _binary(spark, sf):
    d = t.documents_cohort(spark, sf).withColumn("b", F.col("quality").cast("double"))
    return d, logistic.fit_batch(d, "y", {"b": ("b", "identity")}, {"One binary": Model(("b",), 0.0)}).get("One binary")


def logit_one_binary(spark, sf):
    """Log odds of a 2x2 table: the slope on the original scale and its Wald error."""
    _, f = _binary(spark, sf)
    s = float(f.scale[0])
    return rounded(spark.createDataFrame([(float(f.beta[1]) / s, float(f.covariance[1, 1]) ** 0.5 / s)], "log_odds_ratio double, std_error double"))


TWO = "tab AS (SELECT CAST(count(*) FILTER (quality=1 AND y=1) AS DOUBLE) AS a, CAST(count(*) FILTER (quality=1 AND y=0) AS DOUBLE) AS b, CAST(count(*) FILTER (quality=0 AND y=1) AS DOUBLE) AS c, CAST(count(*) FILTER (quality=0 AND y=0) AS DOUBLE) AS d FROM docs)"
BIN_SQL = sql("docs", "SELECT rnd(ln(a*d/(b*c)),6) AS log_odds_ratio, rnd(sqrt(1/a+1/b+1/c+1/d),6) AS std_error FROM tab", TWO)


def cluster_robust_one_binary(spark, sf):
    d, f = _binary(spark, sf)
    cov = inference.cluster_robust(d, "y", "cluster", f, {"b": ("b", "identity")})
    return rounded(spark.createDataFrame([(float(cov[1, 1]) ** 0.5 / float(f.scale[0]),)], "robust_std_error double"))


CRB_SQL = sql("docs", """SELECT rnd(sqrt(g/(g-1)*(n-1)/(n-2)*m),6) AS robust_std_error FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS n, sum(pow(u1/v1-u0/v0,2)) AS m FROM (
  SELECT cluster, count(*) AS n, coalesce(sum(y-p1) FILTER (quality=1),0) AS u1, coalesce(sum(y-p0) FILTER (quality=0),0) AS u0, any_value(v1) AS v1, any_value(v0) AS v0 FROM docs,
  (SELECT a/(a+b) AS p1, c/(c+d) AS p0, a*b/(a+b) AS v1, c*d/(c+d) AS v0 FROM tab) GROUP BY cluster))""", TWO)


def logit_transform(spark, sf):
    c = t.cohort(spark, sf).groupBy("cluster").agg(F.avg("y").alias("m"))
    return rounded(c.select("cluster", logit("m").alias("log_odds"), logit(F.lit(0.0) * F.col("m"), 1e-6).alias("clipped")))


LT_SQL = sql("cohort", "SELECT cluster, rnd(ln(avg(y)/(1-avg(y))),6) AS log_odds, rnd(ln(1e-6/(1-1e-6)),6) AS clipped FROM cohort GROUP BY 1")

QUERIES = {
    "train_only_scaling": (train_only_scaling, SCALING_SQL), "greedy_folds": (greedy_folds, _greedy_sql(False)), "event_folds": (event_folds, _greedy_sql(True)),
    "fold_leakage": (fold_leakage, LEAK_SQL), "temporal_support": (temporal_support, TSUP_SQL), "model_support": (model_support, SUPPORT_SQL), "vif_two": (vif_two, VIF2_SQL),
    "logit_intercept_only": (logit_intercept_only, INT_SQL), "logit_one_binary": (logit_one_binary, BIN_SQL), "cluster_robust_one_binary": (cluster_robust_one_binary, CRB_SQL),
    "logit_transform": (logit_transform, LT_SQL),
    "ridge_crossfit": (ridge_crossfit, None), "crossfit_diagnostics": (crossfit_diagnostics, None), "sensitivity_suite": (sensitivity_suite, None), "temporal_check": (temporal_check, None),
    "common_horizon": (common_horizon, None), "refit_bootstrap": (refit_bootstrap, None), "refit_paired": (refit_paired, None), "refit_audit": (refit_audit, AUDIT_SQL), "refit_failures": (refit_failures, None),
    "refit_closed_form": (refit_closed_form, CLOSED_SQL), "policy_bootstrap": (policy_bootstrap, None),
    "incremental_audit": (incremental_audit, None), "glm_odds_ratios": (glm_odds_ratios, None), "nested_models": (nested_models, None), "final_fits": (final_fits, None),
    "spline_comparison": (spline_comparison, None), "candidate_forms": (candidate_forms, None), "type_sensitivity": (type_sensitivity, None), "model_cohort": (model_cohort, COHORT_SQL), "registry_support": (registry_support, REGISTRY_SQL), "registry_fits": (registry_fits, None),
    "influence_diagnostics": (influence_diagnostics, None), "case_deletion": (case_deletion, None), "deletion_summary": (deletion_summary, None), "separation_flags": (separation_flags, SEP_SQL),
    "temporal_split_support": (temporal_split_support, SPLIT_SQL), "vif": (vif, None), "term_choice": (term_choice, None), "effect_band": (effect_band, None),
    "fit_verification": (fit_verification, None), "random_intercept": (random_intercept, None),
}
