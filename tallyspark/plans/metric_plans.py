"""Validation metrics, capacity policies and resampling over a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plan_size
from ..functions.scalar import COUNT_BINS, logistic, right_closed_bin
from ..operators import ranking, resample, rescore, summaries
from . import tables as t
from .tables import rnd, rounded, sql

COUNT, STAGE, PREV = "Count model", "Stage model", "Prevalence"


@t.stage("wide_scores")
def wide_scores(spark, sf):
    """Cohort rows with two fixed score formulas and a constant benchmark."""
    c = t.cohort(spark, sf)
    count = F.lit(-1.5) + F.lit(0.2) * F.log(F.lit(1.0) + F.col("seedling_count"))
    stage = F.lit(-1.5) + F.lit(0.3) * F.col("coverage") - F.lit(0.05) * F.col("interval_years") + F.lit(0.1) * F.log(
        F.lit(1.0) + F.col("sapling_tpa"))
    return c.select("row_id", "unit", "cluster", "measyear", "y", "entrants", "seedling_count", "coverage", "sapling_tpa",
                    F.lit(0.25).alias("p_prev"), rnd(logistic(count), 9).alias("p_count"), rnd(logistic(stage), 9).alias("p_stage"))


def scored(spark, sf):
    w = wide_scores(spark, sf)
    return w.select("row_id", "unit", "cluster", "measyear", "y", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(p).alias("p")) for m, p in ((PREV, "p_prev"), (COUNT, "p_count"), (STAGE, "p_stage"))])))


WIDE = """wide AS (SELECT row_id, unit, cluster, measyear, y, entrants, seedling_count, coverage, sapling_tpa, 25e-2 AS p_prev,
  rnd(1e0/(1e0+exp(-(-15e-1+2e-1*ln(1e0+seedling_count)))),9) AS p_count,
  rnd(1e0/(1e0+exp(-(-15e-1+3e-1*coverage-5e-2*interval_years+1e-1*ln(1e0+sapling_tpa)))),9) AS p_stage FROM cohort),
scored AS (SELECT row_id, unit, cluster, measyear, y, m AS model, p FROM wide, LATERAL (VALUES ('Prevalence',p_prev),('Count model',p_count),('Stage model',p_stage)) x(m,p))"""
TIES = """ties AS (SELECT {g}, p, count(*) AS w, sum(y) AS t FROM scored GROUP BY {g}, p),
cum AS (SELECT *, sum(w) OVER (PARTITION BY {g} ORDER BY p) AS cw, sum(t) OVER (PARTITION BY {g} ORDER BY p) AS ct,
  sum(w) OVER (PARTITION BY {g}) AS tw, sum(t) OVER (PARTITION BY {g}) AS tt FROM ties),
rankm AS (SELECT {g}, CASE WHEN max(tt)>0 AND max(tw)>max(tt) THEN CAST(sum(t*((cw-ct)-(w-t)/2e0)) AS DOUBLE)/(CAST(max(tt) AS DOUBLE)*max(tw-tt)) END AS roc_auc,
  CASE WHEN max(tt)>0 AND max(tw)>max(tt) THEN sum(t*CAST(tt-ct+t AS DOUBLE)/CAST(tw-cw+w AS DOUBLE))/max(tt) END AS average_precision FROM cum GROUP BY {g})"""
PROB = """probm AS (SELECT {g}, count(*) AS observations, CAST(sum(y) AS BIGINT) AS events, avg(y) AS event_fraction, avg(pow(y-p,2)) AS brier_score,
  -avg(y*ln(p)+(1-y)*ln(1-p)) AS log_loss, avg(p) AS mean_predicted, sum(y)/sum(p) AS observed_expected FROM scored GROUP BY {g})"""


def rank_metrics(spark, sf):
    return rounded(ranking.rank_metrics(scored(spark, sf), ["model"]))


RANK_SQL = sql("cohort", "SELECT model, rnd(roc_auc,6) AS roc_auc, rnd(average_precision,6) AS average_precision FROM rankm", WIDE + ", " + TIES.format(g="model"))


def prob_metrics(spark, sf):
    return rounded(ranking.prob_metrics(scored(spark, sf), ["model"]))


_P = "observations, events, rnd(event_fraction,6) AS event_fraction, rnd(brier_score,6) AS brier_score, rnd(log_loss,6) AS log_loss, rnd(mean_predicted,6) AS mean_predicted, rnd(observed_expected,6) AS observed_expected"
PROB_SQL = sql("cohort", f"SELECT model, {_P} FROM probm", WIDE + ", " + PROB.format(g="model"))


def fold_metrics(spark, sf):
    s = scored(spark, sf).withColumn("fold", F.col("cluster") % 5)
    return rounded(ranking.with_skill(ranking.model_metrics(s, ["fold", "model"]), ["fold"]))


FOLD_SQL = sql("cohort", f"""SELECT m.fold, m.model, {_P.replace("brier_score,6", "m.brier_score,6")}, rnd(CASE WHEN m.model<>'Prevalence' THEN roc_auc END,6) AS roc_auc,
  rnd(CASE WHEN m.model<>'Prevalence' THEN average_precision END,6) AS average_precision, rnd(1-m.brier_score/b.ref,6) AS brier_skill
  FROM probm m JOIN rankm r ON r.fold=m.fold AND r.model=m.model JOIN (SELECT fold, brier_score AS ref FROM probm WHERE model='Prevalence') b ON b.fold=m.fold""",
               WIDE.replace("scored AS", "scored0 AS") + ", scored AS (SELECT *, cluster%5 AS fold FROM scored0), " + TIES.format(g="fold, model") + ", " + PROB.format(g="fold, model"))

PAIRS = [(COUNT, PREV), (STAGE, COUNT)]
FIELDS = ["brier_score", "log_loss", "roc_auc", "average_precision"]


def paired_differences(spark, sf):
    m = ranking.model_metrics(scored(spark, sf), ["model"], benchmark=None)
    return rounded(ranking.paired_differences(m, PAIRS, FIELDS))


PAIR_SQL = sql("cohort", """SELECT a.model, a.reference, x.metric, rnd(x.d,6) AS difference, a.same AS matched_cohort FROM (
  SELECT m.model, q.reference, m.observations=n.observations AND m.events=n.events AS same, m.brier_score-n.brier_score AS d1, m.log_loss-n.log_loss AS d2,
   m.roc_auc-n.roc_auc AS d3, m.average_precision-n.average_precision AS d4 FROM mm m JOIN (VALUES ('Count model','Prevalence'),('Stage model','Count model')) q(model,reference)
   ON q.model=m.model JOIN mm n ON n.model=q.reference) a, LATERAL (VALUES ('brier_score',d1),('log_loss',d2),('roc_auc',d3),('average_precision',d4)) x(metric,d)""",
               WIDE + ", " + TIES.format(g="model") + ", " + PROB.format(g="model") + ", mm AS (SELECT p.*, roc_auc, average_precision FROM probm p JOIN rankm r ON r.model=p.model)")


def paired_eight(spark, sf):
    """Eight metrics of each model minus those of its reference on the same rows."""
    m = ranking.eight_metrics(scored(spark, sf), ["model"], "row_id", "unit")
    return rounded(ranking.paired_differences(m, PAIRS, ranking.EIGHT))


def risk_quartiles(spark, sf):
    s = scored(spark, sf).where(F.col("model") != PREV)
    return rounded(ranking.risk_tiles(s, ["model"], "p", "row_id"))


RISK_SQL = sql("cohort", """SELECT model, tile, count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, rnd(avg(y),6) AS observed_fraction, rnd(avg(p),6) AS mean_predicted,
  rnd(min(p),6) AS minimum_predicted, rnd(max(p),6) AS maximum_predicted FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY model ORDER BY p, row_id) AS INTEGER) AS tile
  FROM scored WHERE model<>'Prevalence') GROUP BY model, tile""", WIDE)

# capacity selection in SQL: {g} grouping, rows in `cap` with columns target, score, row_id, unit
CAP = """capr AS (SELECT c.*, f.requested_fraction, row_number() OVER (PARTITION BY {g}, f.requested_fraction ORDER BY score DESC, row_id) AS rn,
  count(*) OVER (PARTITION BY {g}, f.requested_fraction) AS n, sum(target) OVER (PARTITION BY {g}, f.requested_fraction) AS tt
  FROM cap c, (VALUES (1e-1),(25e-2),(5e-1)) f(requested_fraction)),
capc AS (SELECT *, CAST(floor(n*requested_fraction) AS BIGINT) AS capacity FROM capr),
capk AS (SELECT *, max(CASE WHEN rn=capacity THEN score END) OVER (PARTITION BY {g}, requested_fraction) AS cutoff FROM capc),
capa AS (SELECT {g}, requested_fraction, max(n) AS n, max(tt) AS tt, max(capacity) AS capacity, max(cutoff) AS cutoff_score,
  count(*) FILTER (score>cutoff) AS aw, coalesce(sum(target) FILTER (score>cutoff),0) AS abt, count(*) FILTER (score=cutoff) AS w, sum(target) FILTER (score=cutoff) AS t,
  sum(target) FILTER (rn<=capacity) AS det, count(DISTINCT unit) FILTER (rn<=capacity) AS du FROM capk GROUP BY {g}, requested_fraction),
capo AS (SELECT *, abt+(capacity-aw)*t/CAST(w AS DOUBLE) AS expected FROM capa)"""
CAP_OUT = """requested_fraction, n AS observations, CAST(tt AS BIGINT) AS target_total, capacity, rnd(expected,6) AS expected_targets, rnd(capacity-expected,6) AS expected_non_targets,
  rnd(expected/capacity,6) AS selected_target_fraction, rnd(CASE WHEN tt>0 THEN expected/tt END,6) AS target_capture_fraction, rnd(capacity*tt/n,6) AS random_expected_targets,
  rnd(expected-capacity*tt/n,6) AS extra_targets_vs_random, CAST(abt+greatest(0,capacity-aw-(w-t)) AS BIGINT) AS minimum_targets, CAST(abt+least(capacity-aw,t) AS BIGINT) AS maximum_targets,
  {det}, rnd(cutoff_score,6) AS cutoff_score, w AS cutoff_tied_mass, CAST(capacity-aw AS BIGINT) AS cutoff_tied_selected"""
DET = "CAST(det AS BIGINT) AS deterministic_targets, du AS selected_units"


def capacity_selection(spark, sf):
    s = scored(spark, sf).where(F.col("model") != PREV)
    return rounded(ranking.select_capacity(s, ["model"], "y", "p", (0.1, 0.25, 0.5), "row_id", "unit"))


CAP_SQL = sql("cohort", f"SELECT model, {CAP_OUT.format(det=DET)} FROM capo", WIDE + ", cap AS (SELECT model, y AS target, p AS score, row_id, unit FROM scored WHERE model<>'Prevalence'), " + CAP.format(g="model"))


def policies():
    return {"Raw seedling count": F.col("seedling_count"), "Count per sampled coverage": F.round(F.col("seedling_count") / F.col("coverage"), 9),
            "Sapling presence": (F.col("sapling_tpa") > 0).cast("int"), COUNT: F.col("p_count"), STAGE: F.col("p_stage")}


@t.stage("sweep")
def sweep(spark, sf):
    return ranking.policy_sweep(wide_scores(spark, sf), policies(), "y", "row_id", "unit")


POL = """cap AS (SELECT row_id, unit, objective, policy, score*sgn+0e0 AS score, CASE WHEN sgn>0 THEN y ELSE 1-y END AS target FROM wide,
  LATERAL (VALUES ('Random expectation',0e0),('Raw seedling count',CAST(seedling_count AS DOUBLE)),('Count per sampled coverage',round(seedling_count/coverage,9)),
  ('Sapling presence',CASE WHEN sapling_tpa>0 THEN 1e0 ELSE 0e0 END),('Count model',p_count),('Stage model',p_stage)) a(policy,score),
  (VALUES ('No recorded entry',-1),('Recorded entry',1)) b(objective,sgn)), """ + CAP.format(g="objective, policy")


def policy_sweep(spark, sf):
    return rounded(sweep(spark, sf))


SWEEP_SQL = sql("cohort", "SELECT objective, policy, " + CAP_OUT.format(
    det="CASE WHEN policy<>'Random expectation' THEN CAST(det AS BIGINT) END AS deterministic_targets, CASE WHEN policy<>'Random expectation' THEN du END AS selected_units") + " FROM capo", WIDE + ", " + POL)
PPAIRS = [(COUNT, "Raw seedling count"), (STAGE, "Raw seedling count"), (STAGE, COUNT)]


def policy_pairs(spark, sf):
    return rounded(ranking.policy_pairs(sweep(spark, sf), PPAIRS))


PPAIR_SQL = sql("cohort", """SELECT a.objective, a.requested_fraction, a.policy, q.reference, a.capacity, rnd(a.expected/a.capacity-b.expected/b.capacity,6) AS target_fraction_difference,
  rnd(a.expected-b.expected,6) AS expected_target_difference, a.capacity=b.capacity AND a.tt=b.tt AS matched_cohort FROM capo a
  JOIN (VALUES ('Count model','Raw seedling count'),('Stage model','Raw seedling count'),('Stage model','Count model')) q(policy,reference) ON q.policy=a.policy
  JOIN capo b ON b.policy=q.reference AND b.objective=a.objective AND b.requested_fraction=a.requested_fraction""", WIDE + ", " + POL)


def top_quarter(spark, sf):
    s = scored(spark, sf).where(F.col("model") != PREV)
    k = ranking.select_capacity(s, ["model"], "y", "p", (0.25,), "row_id", "unit")
    f = F.col("deterministic_targets") / F.col("capacity")
    return rounded(k.select("model", F.col("capacity").alias("top_capacity"), F.col("deterministic_targets").alias("top_events"), f.alias("top_fraction"),
                            (1 - f).alias("top_no_event_fraction"), (F.col("deterministic_targets") / F.col("target_total")).alias("top_capture_fraction"),
                            F.col("expected_targets").alias("tie_neutral_expected"), "cutoff_tied_mass"))


TOP_SQL = sql("cohort", """SELECT model, capacity AS top_capacity, CAST(det AS BIGINT) AS top_events, rnd(det/capacity,6) AS top_fraction, rnd(1-det/capacity,6) AS top_no_event_fraction,
  rnd(det/tt,6) AS top_capture_fraction, rnd(expected,6) AS tie_neutral_expected, w AS cutoff_tied_mass FROM capo WHERE requested_fraction=25e-2""",
              WIDE + ", cap AS (SELECT model, y AS target, p AS score, row_id, unit FROM scored WHERE model<>'Prevalence'), " + CAP.format(g="model"))


EIGHT_SQL = sql("cohort", """SELECT m.model, q.reference, x.metric, rnd(x.d,6) AS difference, m.observations=r.observations AND m.events=r.events AS matched_cohort
  FROM mm m JOIN (VALUES ('Count model','Prevalence'),('Stage model','Count model')) q(model,reference) ON q.model=m.model JOIN mm r ON r.model=q.reference,
  LATERAL (VALUES ('brier_score',m.brier_score-r.brier_score),('log_loss',m.log_loss-r.log_loss),('roc_auc',m.roc_auc-r.roc_auc),('average_precision',m.average_precision-r.average_precision),
   ('top_fraction',m.det/m.capacity-r.det/r.capacity),('top_no_event_fraction',r.det/r.capacity-m.det/m.capacity),('top_capture_fraction',m.det/m.tt-r.det/r.tt),('top_events',CAST(m.det-r.det AS DOUBLE))) x(metric,d)""",
                WIDE + ", " + TIES.format(g="model") + ", " + PROB.format(g="model") + ", cap AS (SELECT model, y AS target, p AS score, row_id, unit FROM scored), " + CAP.format(g="model") +
                ", mm AS (SELECT p.*, roc_auc, average_precision, det, c.capacity, c.tt FROM probm p JOIN rankm r ON r.model=p.model JOIN capo c ON c.model=p.model WHERE c.requested_fraction=25e-2)")


def brier_decomposition(spark, sf):
    return rounded(ranking.brier_decomposition(ranking.prob_metrics(scored(spark, sf), ["model"]), PREV, COUNT, STAGE))


DECOMP_SQL = sql("cohort", """SELECT metric, rnd(v,6) AS value FROM (SELECT avg(pow(y-p_prev,2)) AS a, avg(pow(y-p_count,2)) AS b, avg(pow(y-p_stage,2)) AS c FROM wide),
  LATERAL (VALUES ('Prevalence Brier',a),('Strong benchmark Brier',b),('Current full model Brier',c),('Full improvement over prevalence',a-c),
  ('Strong benchmark improvement over prevalence',a-b),('Additional full-model improvement over strong benchmark',b-c),
  ('Fraction of full improvement already obtained by strong benchmark',(a-b)/(a-c))) x(metric,v)""", WIDE)

R, SEED = 2000, 20260909


def bootstrap_draws(spark, sf):
    return resample.multiplicities(t.cohort(spark, sf), "cluster", R, SEED)


def draws_sql(resamples, seed):
    return f"""cidx AS (SELECT cluster, row_number() OVER (ORDER BY md5(CAST(cluster AS VARCHAR)), cluster)-1 AS no, count(*) OVER () AS c FROM (SELECT DISTINCT cluster FROM cohort)),
dr AS (SELECT b AS resample, CAST('0x'||substr(md5(concat_ws('|','{seed}',b,d)),1,15) AS BIGINT)%c AS no FROM (SELECT DISTINCT c FROM cidx),
  range({resamples}) bb(b), LATERAL (SELECT unnest(range(c)) AS d)),
mult AS (SELECT resample, cluster, count(*) AS weight FROM dr JOIN cidx ON cidx.no=dr.no GROUP BY ALL)"""


DRAWS = draws_sql(R, SEED)
DRAW_SQL = sql("cohort", "SELECT resample, cluster, weight FROM mult", DRAWS)


def bootstrap_group_ci(spark, sf):
    c = t.cohort(spark, sf).withColumn("count_group", right_closed_bin("seedling_count", *COUNT_BINS))
    return rounded(resample.group_intervals(c, "count_group", "cluster", "y", R, SEED))


BINS = "CASE WHEN seedling_count=0 THEN '0' WHEN seedling_count=1 THEN '1' WHEN seedling_count<=5 THEN '2-5' WHEN seedling_count<=20 THEN '6-20' ELSE '>20' END"
GCI_SQL = sql("cohort", f"""SELECT p.*, rnd(quantile_cont(v,25e-3),6) AS lower, rnd(quantile_cont(v,975e-3),6) AS upper, count(v) AS estimable_resamples, CAST({R} AS INTEGER) AS resamples
  FROM (SELECT count_group, CAST(sum(n) AS BIGINT) AS conditions, count(*) AS clusters, CAST(sum(e) AS BIGINT) AS events, rnd(sum(e)/sum(n),6) AS event_fraction FROM cell GROUP BY 1) p
  JOIN (SELECT count_group, resample, sum(weight*e)/sum(weight*n) AS v FROM cell JOIN mult ON mult.cluster=cell.cluster GROUP BY ALL) r ON r.count_group=p.count_group GROUP BY ALL""",
              DRAWS + f", cell AS (SELECT {BINS} AS count_group, cluster, count(*) AS n, sum(y) AS e FROM cohort GROUP BY ALL)")


def bootstrap_paired_brier(spark, sf):
    w = wide_scores(spark, sf).withColumnsRenamed({"p_count": COUNT, "p_stage": STAGE, "p_prev": PREV})
    return rounded(resample.paired_brier_intervals(w, "cluster", "y", PAIRS, R, SEED), 8)


PB_SQL = sql("cohort", f"""SELECT p.model, p.reference, rnd(p.d,8) AS brier_difference, rnd(quantile_cont(v,25e-3),8) AS lower, rnd(quantile_cont(v,975e-3),8) AS upper,
  count(v) AS estimable_resamples, CAST({R} AS INTEGER) AS resamples FROM (SELECT model, reference, sum(d)/sum(n) AS d FROM pc GROUP BY ALL) p
  JOIN (SELECT model, reference, resample, sum(weight*d)/sum(weight*n) AS v FROM pc JOIN mult ON mult.cluster=pc.cluster GROUP BY ALL) r ON r.model=p.model GROUP BY ALL""",
              WIDE + ", " + DRAWS + """, pc AS (SELECT model, reference, cluster, count(*) AS n, sum(d) AS d FROM wide, LATERAL (VALUES
  ('Count model','Prevalence',pow(y-p_count,2)-pow(y-p_prev,2)),('Stage model','Count model',pow(y-p_stage,2)-pow(y-p_count,2))) x(model,reference,d) GROUP BY ALL)""")


def bootstrap_paired_auc(spark, sf):
    s = scored(spark, sf).where(F.col("model") != PREV)
    return rounded(rescore.paired_auc_intervals(s, "cluster", [(STAGE, COUNT)], R, SEED))


PA_SQL = sql("cohort", f"""SELECT 'Stage model' AS model, 'Count model' AS reference, rnd(max(d) FILTER (resample=-1),6) AS estimate,
  rnd(quantile_cont(d,25e-3) FILTER (resample>=0),6) AS lower, rnd(quantile_cont(d,975e-3) FILTER (resample>=0),6) AS upper, count(d) FILTER (resample>=0) AS estimable_resamples, CAST({R} AS INTEGER) AS resamples FROM (SELECT resample, max(CASE WHEN model='Stage model' THEN auc END)-max(CASE WHEN model='Count model' THEN auc END) AS d FROM (
  SELECT model, resample, CAST(sum(t*((cf-f)+f/2e0)) AS DOUBLE)/(CAST(sum(t) AS DOUBLE)*sum(f)) AS auc FROM (
   SELECT *, sum(f) OVER (PARTITION BY model, resample ORDER BY p) AS cf FROM (SELECT model, resample, p, sum(weight*y) AS t, sum(weight*(1-y)) AS f FROM scored
    JOIN (SELECT * FROM mult UNION ALL SELECT DISTINCT -1, cluster, 1 FROM cohort) m ON m.cluster=scored.cluster WHERE model<>'Prevalence' GROUP BY ALL)) GROUP BY ALL) GROUP BY resample)""", WIDE + ", " + DRAWS)


def plot_balanced_gain(spark, sf):
    return rounded(ranking.balanced_gain(wide_scores(spark, sf), "unit", "cluster", ["cluster"], "y", "p_count", "p_stage"), 8).drop("units_crossing")


GAIN = """gain AS (SELECT cluster, count(*) AS physical_plots, avg(r) AS reference_brier, avg(n) AS new_brier, avg(r-n) AS gain, stddev_samp(r-n) AS loss_difference_sd
  FROM (SELECT cluster, unit, avg(pow(y-p_count,2)) AS r, avg(pow(y-p_stage,2)) AS n FROM wide GROUP BY ALL) GROUP BY cluster)"""
GAIN_SQL = sql("cohort", "SELECT cluster, physical_plots, rnd(reference_brier,8) AS reference_brier, rnd(new_brier,8) AS new_brier, rnd(gain,8) AS gain, rnd(loss_difference_sd,8) AS loss_difference_sd FROM gain", WIDE + ", " + GAIN)


def required_n(spark, sf):
    g = ranking.balanced_gain(wide_scores(spark, sf), "unit", "cluster", ["cluster"], "y", "p_count", "p_stage").where("loss_difference_sd > 0")
    grid = F.array(*[F.struct(F.lit(h).alias("half_width"), F.lit(v).alias("variance_inflation"), F.lit(r).alias("retention"))
                     for h in (0.001, 0.002) for v in (1.0, 1.5) for r in (0.8, 1.0)])
    s = g.select("cluster", "loss_difference_sd", F.inline(grid))
    return rounded(s.select("*", *plan_size.required_units("loss_difference_sd", "half_width", "variance_inflation", "retention")), 8)


_Z = repr(plan_size.normal_quantile())
REQ_SQL = sql("cohort", f"""SELECT cluster, rnd(loss_difference_sd,8) AS loss_difference_sd, rnd(h,8) AS half_width, rnd(v,8) AS variance_inflation, rnd(r,8) AS retention, CAST(greatest(2,ceil(raw)) AS BIGINT) AS independent_units,
  CAST(greatest(2,ceil(v*raw)) AS BIGINT) AS complete_units, CAST(ceil(greatest(2,ceil(v*raw))/r) AS BIGINT) AS candidate_units FROM (SELECT *, pow({_Z}*loss_difference_sd/h,2) AS raw FROM gain,
  (VALUES (1e-3),(2e-3)) a(h), (VALUES (1e0),(15e-1)) b(v), (VALUES (8e-1),(1e0)) c(r)) WHERE loss_difference_sd>0""", WIDE + ", " + GAIN)


def recall_precision(spark, sf):
    g = t.cohort(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p"))
    x = g.select("cluster", "n", "p", F.explode(F.array(F.lit(0.05), F.lit(0.1))).alias("half_width"))
    need = plan_size.wilson_minimal_units("p", "half_width")
    x = x.withColumn("required_units", need)
    return x.select("cluster", "half_width", rnd("p").alias("p"), "required_units",
                    (plan_size.wilson_half_width("p", "required_units") <= F.col("half_width")).alias("met"),
                    ((F.col("required_units") > 1) & (plan_size.wilson_half_width("p", F.col("required_units") - 1) > F.col("half_width"))).alias("minimal"))


# the oracle searches n instead of solving for it
RECALL_SQL = sql("cohort", f"""SELECT cluster, half_width, rnd(p,6) AS p, (SELECT min(n) FROM range(1,500) s(n) WHERE
  {_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4e0*n*n))/(1+{_Z}*{_Z}/n)<=half_width) AS required_units, true AS met, true AS minimal
  FROM (SELECT cluster, avg(y) AS p FROM cohort GROUP BY 1), (VALUES (5e-2),(1e-1)) h(half_width)""")


def exact_bound(spark, sf):
    g = t.cohort(spark, sf).where("y = 1").groupBy("cluster").agg(F.countDistinct("unit").alias("event_plots"))
    return rounded(g.withColumn("lower_if_all_found", plan_size.all_found_lower_bound("event_plots")))


BOUND_SQL = sql("cohort", "SELECT cluster, count(DISTINCT unit) AS event_plots, rnd(pow(25e-3,1e0/count(DISTINCT unit)),6) AS lower_if_all_found FROM cohort WHERE y=1 GROUP BY 1")


def strata_summary(spark, sf):
    c = t.cohort(spark, sf).select(right_closed_bin("seedling_count", *COUNT_BINS).alias("count_group"), (F.col("sapling_tpa") > 0).alias("saplings_present"), "y")
    return rounded(summaries.outcome_strata(c, [["count_group"], ["saplings_present"], ["count_group", "saplings_present"]], "y"))


STRATA_SQL = sql("cohort", f"""SELECT CASE WHEN grouping(count_group)=1 THEN 'saplings_present' WHEN grouping(saplings_present)=1 THEN 'count_group' ELSE 'count_group+saplings_present' END AS stratum,
  count_group, saplings_present, count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, rnd(avg(y),6) AS event_fraction, rnd(1-avg(y),6) AS no_event_fraction
  FROM (SELECT {BINS} AS count_group, sapling_tpa>0 AS saplings_present, y FROM cohort) GROUP BY GROUPING SETS ((count_group),(saplings_present),(count_group,saplings_present))""")


def stratum_profile(spark, sf):
    c = t.cohort(spark, sf).select(right_closed_bin("seedling_count", *COUNT_BINS).alias("count_group"),
                                   F.when(F.col("coverage") < 0.99, "below").otherwise("full").alias("coverage_group"), "y",
                                   F.col("seedling_count").cast("double").alias("raw_count"), "coverage")
    return rounded(summaries.stratum_profile(c, ["count_group", "coverage_group"], "y", ["raw_count", "coverage"]))


PROFILE_SQL = sql("cohort", f"""SELECT count_group, coverage_group, count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, rnd(avg(y),6) AS event_fraction, rnd(min(raw_count),6) AS min_raw_count,
  rnd(max(raw_count),6) AS max_raw_count, rnd(min(coverage),6) AS min_coverage, rnd(max(coverage),6) AS max_coverage, rnd(sum(y)/sum(sum(y)) OVER (),6) AS fraction_of_all_events,
  rnd(quantile_cont(raw_count,5e-1),6) AS median_raw_count, rnd(quantile_cont(coverage,5e-1),6) AS median_coverage
  FROM (SELECT {BINS} AS count_group, CASE WHEN coverage<99e-2 THEN 'below' ELSE 'full' END AS coverage_group, y, CAST(seedling_count AS DOUBLE) AS raw_count, coverage FROM cohort) GROUP BY ALL""")


def extreme_stratum(spark, sf):
    s = strata_summary(spark, sf).where("stratum = 'count_group+saplings_present' and conditions >= 20")
    return s.orderBy(F.desc("event_fraction"), "count_group", "saplings_present").limit(1)


EXTREME_SQL = STRATA_SQL.replace("SELECT CASE WHEN grouping", "SELECT * FROM (SELECT CASE WHEN grouping", 1) + ") WHERE stratum='count_group+saplings_present' AND conditions>=20 ORDER BY event_fraction DESC, count_group, saplings_present LIMIT 1"


def average_ranks(spark, sf):
    """AUC through average ranks, the second formula the metrics are verified with."""
    from ..operators.ordered import with_average_rank
    s = with_average_rank(scored(spark, sf), ["model"], "p", "r")
    g = s.groupBy("model").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("rs"))
    pos = F.col("pos").cast("double")
    return rounded(g.select("model", ((F.col("rs") - pos * (pos + 1) / 2.0) / (pos * (F.col("n") - pos))).alias("roc_auc")))


AVGRANK_SQL = sql("cohort", "SELECT model, rnd(roc_auc,6) AS roc_auc FROM rankm", WIDE + ", " + TIES.format(g="model"))

QUERIES = {
    "rank_metrics": (rank_metrics, RANK_SQL), "prob_metrics": (prob_metrics, PROB_SQL), "fold_metrics": (fold_metrics, FOLD_SQL),
    "paired_differences": (paired_differences, PAIR_SQL), "paired_eight": (paired_eight, EIGHT_SQL), "risk_quartiles": (risk_quartiles, RISK_SQL), "average_ranks": (average_ranks, AVGRANK_SQL),
    "capacity_selection": (capacity_selection, CAP_SQL), "policy_sweep": (policy_sweep, SWEEP_SQL), "policy_pairs": (policy_pairs, PPAIR_SQL),
    "top_quarter": (top_quarter, TOP_SQL), "brier_decomposition": (brier_decomposition, DECOMP_SQL),
    "bootstrap_draws": (bootstrap_draws, DRAW_SQL), "bootstrap_group_ci": (bootstrap_group_ci, GCI_SQL),
    "bootstrap_paired_brier": (bootstrap_paired_brier, PB_SQL), "bootstrap_paired_auc": (bootstrap_paired_auc, PA_SQL),
    "plot_balanced_gain": (plot_balanced_gain, GAIN_SQL), "required_n": (required_n, REQ_SQL), "recall_precision": (recall_precision, RECALL_SQL),
    "exact_bound": (exact_bound, BOUND_SQL), "strata_summary": (strata_summary, STRATA_SQL), "stratum_profile": (stratum_profile, PROFILE_SQL),
    "extreme_stratum": (extreme_stratum, EXTREME_SQL),
}
