"""Tie-exact ranking metrics and fixed-capacity selection over scored outcomes.

Scores collapse to tie groups before anything is ordered; see ``ordered`` for the sliced prefix sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped
from ..session import broadcast_if_small
from ..settings import DEFAULTS
from .ordered import running_totals, slice_bounds, tile, with_position, with_slice

LOSS_METRICS = ("brier_score", "log_loss", "roc_auc", "average_precision")


def _weight(w: str | None) -> Column:
    """Frequency weights; a fraction is an error, never cut off."""
    if not w:
        return F.lit(1).cast("long")
    whole = F.col(w).isNull() | (F.col(w) == F.col(w).cast("long"))
    return F.when(whole, F.col(w).cast("long")).otherwise(F.raise_error(F.lit("frequency weights must be whole numbers")).cast("long"))


def prob_metrics(scored: DataFrame, groups: Sequence[str], y: str = "y", p: str = "p", w: str | None = None,
                 eps: float = 1e-12) -> DataFrame:
    """Brier score, log loss, event and mean predicted fraction, observed/expected."""
    q, o, k = clipped(p, eps), F.col(y), _weight(w)
    loss = o * F.log(q) + (F.lit(1) - o) * F.log1p(-q)
    s = scored.groupBy(*groups).agg(
        F.sum(k).alias("observations"), F.sum(k * o).alias("events"), F.sum(k * F.pow(o - q, F.lit(2.0))).alias("_b"),
        F.sum(k * loss).alias("_l"), F.sum(k * q).alias("_p"))
    n = F.col("observations")
    return s.select(*groups, "observations", "events", F.try_divide("events", n).alias("event_fraction"),
                    F.try_divide(F.col("_b"), n).alias("brier_score"), F.try_divide(-F.col("_l"), n).alias("log_loss"),
                    F.try_divide(F.col("_p"), n).alias("mean_predicted"), F.try_divide(F.col("events"), F.col("_p")).alias("observed_expected"))


def tie_table(scored: DataFrame, groups: Sequence[str], y: str, score: str, w: str | None = None) -> DataFrame:
    k = _weight(w)
    return scored.groupBy(*groups, score).agg(F.sum(k).alias("w"), F.sum(k * F.col(y)).alias("t"))


def rank_metrics(scored: DataFrame, groups: Sequence[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """ROC AUC with half credit for ties and step-wise average precision; NULL when a class is absent."""
    live = scored if w is None else scored.where(F.col(w) > 0)
    return rank_from_ties(tie_table(live, groups, y, p, w), groups, p, slice_bounds(live, p))


def rank_from_ties(table: DataFrame, groups: Sequence[str], p: str, bounds: Sequence | None = None) -> DataFrame:
    """The ranking metrics of a tie table (…, score, w, t)."""
    r = running_totals(table, groups, p, ["w", "t"], bounds)
    pos, neg = F.col("t"), F.col("w") - F.col("t")
    neg_below = F.col("before_w") - F.col("before_t")
    w_from = F.col("total_w") - F.col("before_w")
    t_from = F.col("total_t") - F.col("before_t")
    g = r.groupBy(*groups).agg(
        F.max("total_t").alias("_p"), (F.max("total_w") - F.max("total_t")).alias("_n"),
        F.sum(pos * (neg_below + neg / 2.0)).alias("_auc"), F.sum(pos * (t_from / w_from)).alias("_ap"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return g.select(*groups, F.when(both, F.col("_auc") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
                    F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"))


def model_metrics(scored: DataFrame, groups: Sequence[str], model: str = "model", benchmark: str | None = "Prevalence",
                  w: str | None = None) -> DataFrame:
    """Probability and ranking metrics per group; a constant benchmark gets no ranking metrics."""
    m = prob_metrics(scored, groups, w=w).join(rank_metrics(scored, groups, w=w), list(groups))
    if benchmark is None:
        return m
    const = F.col(model) == benchmark
    return m.withColumns({x: F.when(~const, F.col(x)) for x in ("roc_auc", "average_precision")})


EIGHT = (*LOSS_METRICS, "top_fraction", "top_no_event_fraction", "top_capture_fraction", "top_events")


def eight_metrics(scored: DataFrame, groups: Sequence[str], key: str, unit: str, fraction: float = 0.25, w: str | None = None) -> DataFrame:
    """Losses, ranking, and what the best ``fraction`` of the rows holds (its cutoff tie ordered by ``key``), for each group."""
    top = select_capacity(scored, groups, "y", "p", (fraction,), key, unit, w)
    hits = F.col("deterministic_targets")
    top = top.select(*groups, F.try_divide(hits, "capacity").alias("top_fraction"), (1 - F.try_divide(hits, "capacity")).alias("top_no_event_fraction"),
                     F.try_divide(hits, "target_total").alias("top_capture_fraction"), hits.cast("double").alias("top_events"))
    return model_metrics(scored, groups, benchmark=None, w=w).join(top, list(groups))


def with_skill(metrics: DataFrame, keys: Sequence[str], model: str = "model", benchmark: str = "Prevalence") -> DataFrame:
    """Brier skill against the benchmark row of the same keys."""
    ref = metrics.where(F.col(model) == benchmark).select(*keys, F.col("brier_score").alias("_ref"))
    out = metrics.join(F.broadcast(ref), list(keys)) if keys else metrics.crossJoin(F.broadcast(ref))
    return out.withColumn("brier_skill", F.lit(1.0) - F.col("brier_score") / F.col("_ref")).drop("_ref")


def paired_differences(metrics: DataFrame, pairs: Sequence[tuple[str, str]], fields: Sequence[str],
                       keys: Sequence[str] = (), model: str = "model",
                       matched: Sequence[str] = ("observations", "events")) -> DataFrame:
    """Named model minus reference per metric; unequal cohorts give no row in ``matched`` and fail the audit."""
    long = metrics.unpivot([*keys, model, *matched], list(fields), "metric", "value")
    spark = metrics.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(pairs), f"{model} string, reference string"))
    ref = long.select(*keys, F.col(model).alias("reference"), "metric", F.col("value").alias("_ref"),
                      *[F.col(m).alias(f"_{m}") for m in matched])
    both = long.join(wanted, model).join(ref, [*keys, "reference", "metric"])
    same = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_{m}") for m in matched])
    return both.select(*keys, model, "reference", "metric", (F.col("value") - F.col("_ref")).alias("difference"),
                       same.alias("matched_cohort"))


def cutoffs(scored: DataFrame, groups: Sequence[str], target: str, score: str, fractions: Sequence[float],
            w: str | None = None) -> DataFrame:
    """For each group and capacity: the cutoff score, what lies above it and how large its tie is.

    A capacity that rounds to zero keeps its row, with no cutoff and an empty tie. A missing or NaN score is an error.
    """
    live = scored if w is None else scored.where(F.col(w) > 0)
    s = F.col(score).cast("double")
    live = live.withColumn(score, F.when(s.isNotNull() & ~F.isnan(s), F.col(score)).otherwise(F.raise_error(F.lit("missing scores cannot be ranked")).cast(live.schema[score].dataType)))
    return cutoffs_from_ties(tie_table(live, groups, target, score, w), groups, score, fractions, slice_bounds(live, score))


def expected_targets() -> Column:
    """Targets in a capacity: those above the cutoff, and the expected share of its tie."""
    return F.col("above_t") + F.coalesce(F.try_divide((F.col("capacity") - F.col("above_w")) * F.col("tied_t"), "tied_w"), F.lit(0.0))


def cutoffs_from_ties(table: DataFrame, groups: Sequence[str], score: str, fractions: Sequence[float], bounds: Sequence | None = None) -> DataFrame:
    """The cutoffs of a tie table (…, score, w, t)."""
    r = running_totals(table, groups, score, ["w", "t"], bounds)
    r = r.withColumn("requested_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    r = r.withColumn("capacity", F.floor(F.col("total_w") * F.col("requested_fraction")))
    above_w = F.col("total_w") - F.col("before_w") - F.col("w")
    above_t = F.col("total_t") - F.col("before_t") - F.col("t")
    r = r.withColumn("above_w", above_w).withColumn("above_t", above_t)
    at = (F.col("above_w") < F.col("capacity")) & (F.col("capacity") <= F.col("above_w") + F.col("w"))
    none = (F.col("capacity") == 0) & (F.col("above_w") == 0)
    return r.where(at | none).select(
        *groups, "requested_fraction", "capacity", F.when(~none, F.col(score)).alias("cutoff_score"), F.when(none, 0).otherwise(F.col("w")).alias("tied_w"),
        F.when(none, 0).otherwise(F.col("t")).alias("tied_t"), "above_w", "above_t", "total_w", "total_t")


UNIT_ROWS = 500_000  # rows that a task counts by unit


def _by_unit(taken: DataFrame, cut: DataFrame, groups: Sequence[str]):
    """Selected rows grouped by unit, dealt before anything is counted: units lie apart, so that counts of a task's own rows would fill
    its memory and spare nothing. Tasks grow in number with the rows, not in size."""
    rows = cut.agg(F.sum("capacity")).first()[0] or 0  # no fewer than are selected
    tasks = max(taken.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // UNIT_ROWS))
    keys = [*groups, "_u"]
    return taken.select(*keys, "requested_fraction").repartition(tasks, *keys).groupBy(*keys)


def _taken_of_ties(tied: DataFrame, by: Sequence[str]) -> DataFrame:
    """What the capacity still takes of each cutoff tie, smallest keys first.

    Sums by slice of the key tell which slice the capacity ends in; those before it are taken whole, and only that one is ordered.
    """
    s = with_slice(tied, "_k", slice_bounds(tied, "_k"))
    per = s.groupBy(*by, "_slice").agg(F.sum("_w").alias("_sum"), F.first(F.col("capacity") - F.col("above_w")).alias("_room"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    edge = per.where("_before < _room AND _room <= _before + _sum").select(*by, F.col("_slice").alias("_edge"), (F.col("_room") - F.col("_before")).alias("_left"))
    s = s.join(broadcast_if_small(edge), list(by))
    inside = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    cut = s.where("_slice = _edge").select(*by, "_u", "_t", "_w", (F.col("_left") - F.coalesce(F.sum("_w").over(inside), F.lit(0))).alias("_left"))
    cut = cut.where("_left > 0").select(*by, "_u", F.least("_w", "_left").alias("taken"), "_t")
    return s.where("_slice < _edge").select(*by, "_u", F.col("_w").alias("taken"), "_t").unionByName(cut)


def select_capacity(scored: DataFrame, groups: Sequence[str], target: str, score: str, fractions: Sequence[float],
                    key: str, unit: str, w: str | None = None, analytic: Mapping[str, str] | None = None) -> DataFrame:
    """Top-k selection with exact tie accounting.

    Expectation, minimum and maximum over the cutoff tie come from tie totals. The deterministic pick
    orders only the cutoff tie by ``key``. ``analytic`` names a group value (column -> value) that has
    no deterministic pick, such as a random policy.
    """
    cut = broadcast_if_small(cutoffs(scored, groups, target, score, fractions, w))
    by = [*groups, "requested_fraction"]
    rows = scored.select(*groups, F.col(score).alias("_s"), F.col(target).alias("_t"), F.col(key).alias("_k"),
                         F.col(unit).alias("_u"), _weight(w).alias("_w"))
    if analytic:
        rows = rows.where(reduce(lambda a, b: a & b, [F.col(k) != v for k, v in analytic.items()]))
    near = rows.join(cut.select(*by, "cutoff_score", "capacity", "above_w"), list(groups)).where(
        (F.col("_s") >= F.col("cutoff_score")) & (F.col("_w") > 0)) if groups else rows.crossJoin(
        cut.select(*by, "cutoff_score", "capacity", "above_w")).where((F.col("_s") >= F.col("cutoff_score")) & (F.col("_w") > 0))
    above = near.where(F.col("_s") > F.col("cutoff_score")).select(*by, "_u", F.col("_w").alias("taken"), "_t")
    taken = above.unionByName(_taken_of_ties(near.where(F.col("_s") == F.col("cutoff_score")), by))
    # a larger capacity keeps what a smaller one has, so a unit counts from its first one on
    first = _by_unit(taken, cut, groups).agg(F.min("requested_fraction").alias("_first")).groupBy(*groups, "_first").agg(F.count(F.lit(1)).alias("_units"))
    hits = taken.groupBy(*by).agg(F.sum(F.col("taken") * F.col("_t")).alias("deterministic_targets")).withColumnsRenamed({g: f"_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, [F.col(f"_{g}") == F.col(g) for g in groups], F.col("_first") <= F.col("requested_fraction"))
    det = F.broadcast(hits).join(first, same).groupBy(*by).agg(F.first("deterministic_targets").alias("deterministic_targets"), F.sum("_units").alias("selected_units"))
    c = F.col
    left = c("capacity") - c("above_w")
    expected = c("above_t") + F.coalesce(F.try_divide(left * c("tied_t"), c("tied_w")), F.lit(0.0))
    random = c("capacity") * c("total_t") / c("total_w")
    none = c("capacity") == 0
    out = cut.join(det, by, "left")
    return out.select(
        *by, c("total_w").alias("observations"), c("total_t").alias("target_total"), "capacity",
        expected.alias("expected_targets"), (c("capacity") - expected).alias("expected_non_targets"),
        F.try_divide(expected, c("capacity")).alias("selected_target_fraction"),
        F.when(c("total_t") > 0, expected / c("total_t")).alias("target_capture_fraction"),
        random.alias("random_expected_targets"), (expected - random).alias("extra_targets_vs_random"),
        (c("above_t") + F.greatest(F.lit(0), left - (c("tied_w") - c("tied_t")))).alias("minimum_targets"),
        (c("above_t") + F.least(left, c("tied_t"))).alias("maximum_targets"),
        F.when(none, F.coalesce("deterministic_targets", F.lit(0))).otherwise(c("deterministic_targets")).alias("deterministic_targets"),
        F.when(none, F.coalesce("selected_units", F.lit(0))).otherwise(c("selected_units")).alias("selected_units"), "cutoff_score", c("tied_w").alias("cutoff_tied_mass"),
        left.alias("cutoff_tied_selected"))


def policy_table(rows: DataFrame, policies: Mapping[str, Column], y: str, keep: Sequence[str],
                 objectives: Sequence[tuple[str, bool]] = (("No recorded entry", False), ("Recorded entry", True))) -> DataFrame:
    """Long (objective, policy, score, target); an objective for the absence of the event flips both."""
    scores = F.array(*[F.struct(F.lit(n).alias("policy"), s.cast("double").alias("raw")) for n, s in policies.items()])
    goals = F.array(*[F.struct(F.lit(n).alias("objective"), F.lit(1 if e else -1).alias("sign")) for n, e in objectives])
    x = rows.select(*keep, F.col(y).alias("_y"), F.inline(scores)).select("*", F.explode(goals).alias("g"))
    sign = F.col("g.sign")
    return x.select(*keep, F.col("g.objective").alias("objective"), "policy", (F.col("raw") * sign + F.lit(0.0)).alias("score"),
                    F.when(sign > 0, F.col("_y")).otherwise(1 - F.col("_y")).alias("target"))


RANDOM = "Random expectation"


def policy_sweep(rows: DataFrame, policies: Mapping[str, Column], y: str, key: str, unit: str,
                 fractions: Sequence[float] = DEFAULTS.capacities, w: str | None = None) -> DataFrame:
    """Every policy, objective and capacity in one pass; the random row is an expectation, not a pick."""
    table = policy_table(rows, {RANDOM: F.lit(0.0), **policies}, y, [key, unit, *([w] if w else [])])
    return select_capacity(table, ["objective", "policy"], "target", "score", fractions, key, unit, w, {"policy": RANDOM})


def policy_pairs(sweep: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ("objective", "requested_fraction")) -> DataFrame:
    """Policy minus reference on the same target and capacity."""
    wanted = F.broadcast(sweep.sparkSession.createDataFrame(list(pairs), "policy string, reference string"))
    ref = sweep.select(*keys, F.col("policy").alias("reference"), F.col("selected_target_fraction").alias("_f"),
                       F.col("expected_targets").alias("_e"), F.col("capacity").alias("_c"), F.col("target_total").alias("_t"))
    both = sweep.join(wanted, "policy").join(ref, [*keys, "reference"])
    return both.select(*keys, "policy", "reference", "capacity",
                       (F.col("selected_target_fraction") - F.col("_f")).alias("target_fraction_difference"),
                       (F.col("expected_targets") - F.col("_e")).alias("expected_target_difference"),
                       ((F.col("capacity") == F.col("_c")) & (F.col("target_total") == F.col("_t"))).alias("matched_cohort"))


def risk_tiles(scored: DataFrame, groups: Sequence[str], p: str, key: str, y: str = "y", tiles: int = 4) -> DataFrame:
    """Outcome and prediction summary by equal-count score tiles."""
    placed = with_position(scored.select(*groups, p, key, y), groups, p, key, "_pos", "_n")
    t = placed.withColumn("tile", tile(F.col("_pos"), F.col("_n"), tiles))
    return t.groupBy(*groups, "tile").agg(
        F.count(F.lit(1)).alias("conditions"), F.sum(y).alias("events"), F.avg(y).alias("observed_fraction"),
        F.avg(p).alias("mean_predicted"), F.min(p).alias("minimum_predicted"), F.max(p).alias("maximum_predicted"))


def brier_decomposition(brier: DataFrame, prevalence: str, strong: str, full: str, model: str = "model") -> DataFrame:
    """How much of the full model's improvement over prevalence a simpler benchmark already reaches."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col("brier_score")))
    w = brier.agg(pick(prevalence).alias("a"), pick(strong).alias("b"), pick(full).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = {"Prevalence Brier": a, "Strong benchmark Brier": b, "Current full model Brier": c,
            "Full improvement over prevalence": a - c, "Strong benchmark improvement over prevalence": a - b,
            "Additional full-model improvement over strong benchmark": b - c,
            "Fraction of full improvement already obtained by strong benchmark": F.try_divide(a - b, a - c)}
    return w.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in rows.items()])))


def balanced_gain(scored: DataFrame, unit: str, cluster: str, groups: Sequence[str], y: str, p_ref: str, p_new: str) -> DataFrame:
    """Paired loss difference with equal weight per unit: unit means first, then mean and sd over units.

    ``units_crossing`` counts units seen in several clusters; it must be 0 for the summary to be valid.
    """
    ref = F.pow(F.col(y) - F.col(p_ref), F.lit(2.0))
    new = F.pow(F.col(y) - F.col(p_new), F.lit(2.0))
    u = scored.groupBy(*groups, unit).agg(F.avg(ref).alias("_ref"), F.avg(new).alias("_new"), F.min(cluster).alias("_c0"),
                                          F.max(cluster).alias("_c1"))
    gain = F.col("_ref") - F.col("_new")
    return u.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("physical_plots"), F.avg("_ref").alias("reference_brier"), F.avg("_new").alias("new_brier"),
        F.avg(gain).alias("gain"), F.stddev_samp(gain).alias("loss_difference_sd"),
        F.count_if(F.col("_c0") != F.col("_c1")).alias("units_crossing"))
