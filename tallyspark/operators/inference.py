"""Inference around the batched fits: robust covariance, comparisons, influence, collinearity, bands."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan_size import chi_square_upper, f_quantile, normal_quantile, normal_two_sided_p
from ..functions.scalar import is_finite, logistic, transformed
from ..session import keep, settle, stored
from ..settings import DEFAULTS, Settings
from .logistic import Fit, FitBatch, IncompletePredictions, Model, fit_batch
from .ordered import exact_quantiles


def design(fit: Fit, terms: Mapping[str, tuple[str, str]]) -> list[Column]:
    """Intercept and training-standardised terms of a fit as row expressions."""
    return [F.lit(1.0), *[(transformed(*terms[t]) - F.lit(float(c))) / F.lit(float(s)) for t, c, s in zip(fit.terms, fit.center, fit.scale)]]


def linear(fit: Fit, x: Sequence[Column]) -> Column:
    eta = F.lit(float(fit.beta[0]))
    for b, v in zip(fit.beta[1:], x[1:]):
        eta = eta + F.lit(float(b)) * v
    return eta


def _quadratic(m: np.ndarray, x: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for i in range(len(x)):
        for j in range(i, len(x)):
            out = out + F.lit(float(m[i, j] * (1 if i == j else 2))) * x[i] * x[j]
    return out


def cluster_robust(rows: DataFrame, y: str, cluster: str, fit: Fit, terms: Mapping[str, tuple[str, str]]) -> np.ndarray:
    """CR1 sandwich: scores are summed per cluster in Spark, then their outer products over clusters."""
    x = design(fit, terms)
    k = len(x)
    r = F.col(y) - logistic(linear(fit, x))
    per = rows.select(F.col(cluster).alias("c"), *[(r * v).alias(f"u{i}") for i, v in enumerate(x)]).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
    row = per.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"),
                  *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g, n = row["g"], row["n"]
    if g <= 1 or n <= k:
        raise ValueError("too few clusters or residual degrees of freedom")
    meat = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return g / (g - 1) * (n - 1) / (n - k) * fit.covariance @ meat @ fit.covariance


def odds_ratios(spark: SparkSession, fit: Fit, robust: np.ndarray, level: float = 0.95) -> DataFrame:
    """Odds ratios per standard deviation with robust intervals and Benjamini-Hochberg adjusted p-values."""
    zc = normal_quantile(level)
    se, rse = np.sqrt(np.diag(fit.covariance)), np.sqrt(np.diag(robust))
    p = [normal_two_sided_p(b / s) for b, s in zip(fit.beta[1:], rse[1:])]
    order = sorted(range(len(p)), key=lambda i: p[i], reverse=True)
    adjusted, low = [0.0] * len(p), 1.0
    for rank, i in zip(range(len(p), 0, -1), order):
        low = min(low, p[i] * len(p) / rank)
        adjusted[i] = low
    rows = [(t, float(b), float(s), float(r), math.exp(b), math.exp(b - zc * r), math.exp(b + zc * r), float(b / r), pv, adj)
            for t, b, s, r, pv, adj in zip(fit.terms, fit.beta[1:], se[1:], rse[1:], p, adjusted)]
    return spark.createDataFrame(rows, "term string, log_odds double, model_std_error double, robust_std_error double, odds_ratio double, "
                                       "conf_low double, conf_high double, robust_z double, robust_p double, adjusted_p double")


def wald_odds(spark: SparkSession, fits: Sequence[Fit], term: str, level: float = 0.95) -> DataFrame:
    """(model, focal odds ratio, interval, p) of one term in each fit, per standard deviation of its training rows; NULL where a fit
    lacks the term."""
    z, rows = normal_quantile(level), []
    for f in fits:
        if term not in f.terms:
            rows.append((f.model, None, None, None, None))
            continue
        i = 1 + f.terms.index(term)
        b, se = float(f.beta[i]), float(math.sqrt(f.covariance[i, i]))
        rows.append((f.model, math.exp(b), math.exp(b - z * se), math.exp(b + z * se), normal_two_sided_p(b / se)))
    return spark.createDataFrame(rows, "model string, focal_odds_ratio double, focal_conf_low double, focal_conf_high double, focal_p double")


def compare_models(spark: SparkSession, batch: FitBatch, order: Sequence[str], nested: bool = True) -> DataFrame:
    """Log-likelihood, AIC and, for a nested sequence, likelihood-ratio tests against the previous model."""
    fits = [batch.get(m) for m in order]
    aic = [2 * (len(f.terms) + 1) - 2 * f.loglik for f in fits]
    rows = []
    for i, f in enumerate(fits):
        prev = fits[i - 1] if nested and i else None
        stat = max(0.0, 2 * (f.loglik - prev.loglik)) if prev else None
        df = len(f.terms) - len(prev.terms) if prev else None
        rows.append((i + 1, f.model, prev.model if prev else None, int(f.weight), len(f.terms), f.loglik, aic[i], aic[i] - min(aic), stat, df,
                     chi_square_upper(stat, df) if prev and df else None))
    return spark.createDataFrame(rows, "position int, model string, added_after string, observations long, slopes int, log_likelihood double, "
                                       "aic double, delta_aic double, lr_chisq double, lr_df int, lr_p double")


def influence(rows: DataFrame, y: str, fit: Fit, terms: Mapping[str, tuple[str, str]], keep_columns: Sequence[str]) -> DataFrame:
    """Leverage, Cook's distance and deviance per row; the k x k covariance rides along as literals."""
    x = design(fit, terms)
    k = len(x)
    d = rows.select(*keep_columns, F.col(y).alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    xs = [F.col(f"x{i}") for i in range(k)]
    d = d.withColumn("p", logistic(linear(fit, xs)))
    w = F.col("p") * (1 - F.col("p"))
    d = d.withColumn("leverage", w * _quadratic(fit.covariance, xs))
    pearson2 = F.pow(F.col("y") - F.col("p"), F.lit(2.0)) / w
    cook = pearson2 * F.col("leverage") / (F.lit(float(k)) * F.pow(1 - F.col("leverage"), F.lit(2.0)))
    dev = F.lit(-2.0) * (F.col("y") * F.log("p") + (1 - F.col("y")) * F.log1p(-F.col("p")))
    n = fit.weight
    dffits = F.sqrt(pearson2 / (1 - F.col("leverage")) * F.col("leverage") / (1 - F.col("leverage")))
    d = d.select(*keep_columns, "y", "p", "leverage", cook.alias("cook"), dev.alias("deviance"), dffits.alias("dffits"))
    flag = (F.col("leverage") > 3.0 * k / n) | (F.col("dffits") > 3.0 * math.sqrt(k / (n - k))) | (F.col("cook") > 1.0)
    return d.withColumn("influential", flag)


DELETION_FLAGS = ("leverage_flag", "dffits_flag", "cook_flag", "covratio_flag", "dfbeta_flag")


def deletion(rows: DataFrame, y: str, fit: Fit, terms: Mapping[str, tuple[str, str]], keep_columns: Sequence[str]) -> DataFrame:
    """What one step of deleting each row changes: dfbetas per term, dffits, the covariance ratio and Cook's distance, with the
    conventional cuts (fixed values) as flags.

    The coefficients' change is the row's share of the information times its residual, and the determinant of the information
    without a row is 1 - leverage of the whole, so every measure is an expression over the row and the k x k covariance.
    """
    x = design(fit, terms)
    k, n = len(x), fit.weight
    d = rows.select(*keep_columns, F.col(y).alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    xs = [F.col(f"x{i}") for i in range(k)]
    d = d.withColumn("p", logistic(linear(fit, xs)))
    d = d.withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("leverage", F.col("w") * _quadratic(fit.covariance, xs))
    dev = F.lit(-2.0) * (F.col("y") * F.log("p") + (1 - F.col("y")) * F.log1p(-F.col("p")))
    d = d.withColumn("e", F.when(F.col("y") > F.col("p"), F.sqrt(dev)).otherwise(-F.sqrt(dev)))
    total = -2 * fit.loglik
    left = 1 - F.col("leverage")
    # residual scale of the fit without the row
    d = d.withColumn("si", F.sqrt((F.lit(total) - F.col("e") * F.col("e") / left) / F.lit(n - k - 1)))
    change = [sum((F.lit(float(fit.covariance[i, j])) * xs[j] for j in range(k)), F.lit(0.0)) * F.sqrt("w") * F.col("e") / left for i in range(k)]
    dfbetas = [c / (F.col("si") * F.lit(math.sqrt(fit.covariance[i, i]))) for i, c in enumerate(change)]
    pearson2 = F.pow(F.col("y") - F.col("p"), F.lit(2.0)) / F.col("w")
    d = d.select(*keep_columns, "y", "p", "leverage", (F.col("e") * F.sqrt("leverage") / (F.col("si") * left)).alias("dffits"),
                 (pearson2 * F.col("leverage") / (F.lit(float(k)) * left * left)).alias("cook"),
                 (F.pow(F.col("si") * F.col("si") / F.lit(total / (n - k)), F.lit(float(k))) / left).alias("covariance_ratio"),
                 *[b.alias(f"dfbeta_{t}") for t, b in zip(("intercept", *fit.terms), dfbetas)])
    large = F.lit(False)
    for t in ("intercept", *fit.terms):
        large = large | (F.abs(f"dfbeta_{t}") > 1)
    flags = dict(zip(DELETION_FLAGS, (F.col("leverage") > 3.0 * k / n, F.abs("dffits") > 3.0 * math.sqrt(k / (n - k)), F.col("cook") > f_quantile(0.5, k, n - k),
                                      F.abs(1 - F.col("covariance_ratio")) > 3.0 * k / (n - k), large)))
    d = d.select("*", *[f.alias(name) for name, f in flags.items()])
    any_ = F.lit(False)
    for f in DELETION_FLAGS:
        any_ = any_ | F.col(f)
    return d.withColumn("influential", any_)


SEPARATION = ("complete", "quasi-complete", "none")


def separation(rows: DataFrame, y: str, fold: str, held_out: Sequence[int], models: Mapping[str, Model], terms: Mapping[str, tuple[str, str]],
               penalties: tuple[float, float] = (1e-4, 1e-6), tolerance: float = 1e-4) -> DataFrame:
    """(model, fold, separation, training_events, events_per_slope): whether a training set separates the outcomes.

    A separated fit runs away along a direction of recession. Two fits with vanishing penalties of all folds and models, advanced
    together, differ by that direction; one grouped pass then asks every training row on which side of it the row lies. No row on
    the wrong side: separated, completely where none lies on the boundary. A fit that stays in place has rows on both sides.
    """
    names = list(terms)
    directions: dict = {}
    for sign, penalty in zip((-1, 1), penalties):
        light = {m: Model(s.terms, penalty) for m, s in models.items()}
        batch = fit_batch(rows, y, terms, light, fold, tuple(held_out), max_passes=200, limit=1e6)
        lost = [f for f in batch.fits if f.failure and 0 < f.events < f.weight]
        if lost:  # of both outcomes and yet no direction: an error, not a row less
            raise IncompletePredictions(FitBatch(terms, lost))
        for f in batch.done():
            d = np.zeros(len(names) + 1)
            slope = f.beta[1:] / f.scale
            d[0] = f.beta[0] - np.dot(slope, f.center)
            for t, s in zip(f.terms, slope):
                d[1 + names.index(t)] = s
            directions.setdefault((f.model, f.fold), {})[sign] = (d, f)
    spark = rows.sparkSession
    mid = {n: v for n, v in zip(names, rows.agg(*[F.stddev_pop(transformed(*terms[n])) for n in names]).first())}
    table = []
    for (m, f), both in directions.items():
        if len(both) == 2:
            d = both[1][0] - both[-1][0]
            size = math.sqrt(sum((d[1 + i] * (mid[n] or 0.0)) ** 2 for i, n in enumerate(names)))
            table.append((m, f, [float(v) for v in d], size, both[1][1].events, len(both[1][1].terms)))
    known = F.broadcast(spark.createDataFrame(table, "model string, held_out int, d array<double>, size double, training_events double, slopes int"))
    t = [transformed(*terms[n]).cast("double").alias(f"t{i}") for i, n in enumerate(names)]
    x = rows.select(F.col(y).alias("y"), F.col(fold).cast("int").alias("fold"), *t).join(known, F.col("fold") != F.col("held_out"))
    eta = F.col("d")[0]
    for i in range(len(names)):
        eta = eta + F.col("d")[i + 1] * F.col(f"t{i}")
    # a step of under a thousandth between two penalties is no direction
    margin = F.when(F.col("size") < 1e-3, F.lit(None)).otherwise((2 * F.col("y") - 1) * eta / F.col("size"))
    per = x.withColumn("margin", margin).groupBy("model", "held_out", "training_events", "slopes").agg(
        F.count_if(F.col("margin") < -tolerance).alias("wrong"), F.count_if(F.abs("margin") <= tolerance).alias("boundary"), F.count_if(F.col("margin") > tolerance).alias("right"))
    apart = (F.col("wrong") == 0) & (F.col("right") > 0)
    kind = F.when(apart & (F.col("boundary") == 0), SEPARATION[0]).when(apart, SEPARATION[1]).otherwise(SEPARATION[2])
    return per.select("model", F.col("held_out").alias("fold"), kind.alias("separation"), F.col("training_events").cast("long").alias("training_events"),
                      F.try_divide("training_events", "slopes").alias("events_per_slope"))


def diagnostics(infl: DataFrame, fit: Fit) -> DataFrame:
    k = len(fit.terms) + 1
    return infl.agg((F.sum("deviance") / F.lit(fit.weight - k)).alias("deviance_per_df"), F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2.0))).alias("brier_score"),
                    F.max("cook").alias("max_cook"), F.max("leverage").alias("max_leverage"), F.sum("leverage").alias("sum_leverage"),
                    F.count_if("influential").alias("influential_rows"))


def correlations(rows: DataFrame, terms: Mapping[str, tuple[str, str]]) -> np.ndarray:
    names = list(terms)
    k = len(names)
    t = rows.select(*[transformed(*terms[n]).alias(f"t{i}") for i, n in enumerate(names)])
    row = t.agg(*[F.corr(f"t{i}", f"t{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1, k)]).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = row[f"c{i}_{j}"]
    return m


def variance_inflation(rows: DataFrame, terms: Mapping[str, tuple[str, str]]) -> DataFrame:
    inv = np.linalg.inv(correlations(rows, terms))
    return rows.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(terms, np.diag(inv))], "term string, vif double")


def choose_terms(rows: DataFrame, y: str, required: Sequence[str], optional: Sequence[str], terms: Mapping[str, tuple[str, str]],
                 exclusive: tuple[str, str] | None = None, minimum_complete: float = 0.75, cfg: Settings = DEFAULTS) -> DataFrame:
    """Which terms enter: complete and varying enough, not too correlated, enough events per parameter.

    One aggregate decides; later terms are dropped first when events are scarce.
    """
    both = exclusive or (None, None)
    col = {n: transformed(*terms[n]) for n in (*required, *optional)}
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("e"), *[F.avg(c.isNotNull().cast("double")).alias(f"f_{n}") for n, c in col.items()],
            *[F.stddev_samp(c).alias(f"s_{n}") for n, c in col.items()]]
    if exclusive:
        aggs.append(F.corr(col[both[0]], col[both[1]]).alias("r"))
    row = rows.agg(*aggs).first()
    chosen, reason = list(required), {n: "required" for n in required}
    for n in optional:
        good = (row[f"f_{n}"] or 0) >= minimum_complete and (row[f"s_{n}"] or 0) > 0
        reason[n] = "kept" if good else "incomplete or constant"
        if good:
            chosen.append(n)
    if exclusive and all(b in chosen for b in both) and row["r"] is not None and abs(row["r"]) > cfg.maximum_correlation:
        chosen.remove(both[1])
        reason[both[1]] = "correlated"
    least = min(row["e"], row["n"] - row["e"])
    while least / len(chosen) < cfg.minimum_events_per_parameter and len(chosen) > 3:
        reason[chosen.pop()] = "too few events per parameter"
    out = [(i + 1, n, n in chosen, reason[n], least / len(chosen)) for i, n in enumerate((*required, *optional))]
    return rows.sparkSession.createDataFrame(out, "position int, term string, selected boolean, reason string, events_per_parameter double")


def support(rows: DataFrame, y: str, fields: Sequence[str], cluster: str, unit: str, slopes: int, minimum_group: int = 5,
            cfg: Settings = DEFAULTS) -> DataFrame:
    """Complete cases, events per parameter and group support of a modelling cohort."""
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    d = rows.select(cluster, unit, y, complete.alias("ok"))
    per = d.groupBy(cluster).agg(F.count(F.lit(1)).alias("all"), F.count_if("ok").alias("n"), F.sum(F.when(F.col("ok"), F.col(y))).alias("e"))
    units = d.where("ok").select(unit).distinct().agg(F.count(unit).alias("units"))
    least = F.least(F.col("events"), F.col("observations") - F.col("events"))
    g = per.agg(F.sum("all").alias("cohort_n"), F.sum("n").alias("observations"), F.sum("e").alias("events"),
                F.count_if(F.col("n") > 0).alias("groups"), F.count_if(F.col("n") >= minimum_group).alias("groups_supported"))
    med = exact_quantiles(per.where("n > 0").select(F.col("n").cast("double").alias("v")), [], "v", {"median_group_n": 0.5})
    return g.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(units)).select(
        "*", (F.col("observations") / F.col("cohort_n")).alias("complete_case_fraction"), (F.col("events") / F.col("observations")).alias("event_fraction"),
        (least / F.lit(max(slopes, 1))).alias("events_per_parameter"),
        (F.col("groups_supported") >= cfg.minimum_groups_for_random_effect).alias("random_effect_supported"))


def with_natural_spline(rows: DataFrame, column: str, kind: str, df: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """Natural cubic spline columns with knots at quantiles of the data, as plain column expressions."""
    v = rows.select(transformed(column, kind).alias("v")).where(is_finite("v"))
    probs = {f"q{i}": i / df for i in range(df + 1)}
    row = exact_quantiles(v, [], "v", probs).first()
    knots = [float(row[f"q{i}"]) for i in range(df + 1)]
    x = transformed(column, kind)

    def cube(k):
        return F.pow(F.greatest(x - F.lit(k), F.lit(0.0)), F.lit(3.0))

    def d(j):
        return (cube(knots[j]) - cube(knots[-1])) / F.lit(knots[-1] - knots[j])

    out = {f"{prefix}1": x}
    for j in range(len(knots) - 2):
        out[f"{prefix}{j + 2}"] = d(j) - d(len(knots) - 2)
    return rows.withColumns(out), list(out)


def score_with_band(rows: DataFrame, fit: Fit, terms: Mapping[str, tuple[str, str]], keep_columns: Sequence[str], level: float = 0.95) -> DataFrame:
    """Predicted probability with a pointwise delta-method band for any rows, as row expressions."""
    x = design(fit, terms)
    d = rows.select(*keep_columns, *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    xs = [F.col(f"_x{i}") for i in range(len(x))]
    d = d.select(*keep_columns, linear(fit, xs).alias("eta"), F.sqrt(_quadratic(fit.covariance, xs)).alias("se"))
    z = normal_quantile(level)
    return d.select(*keep_columns, logistic("eta").alias("p"), logistic(F.col("eta") - z * F.col("se")).alias("conf_low"),
                    logistic(F.col("eta") + z * F.col("se")).alias("conf_high"))


def effect_grid(rows: DataFrame, term: str, terms: Mapping[str, tuple[str, str]], points: int = 40) -> DataFrame:
    """Rows that move one term from its minimum to its 99th percentile on the log scale, others at their means."""
    source, _ = terms[term]
    q = exact_quantiles(rows.select(F.col(source).cast("double").alias("v")), [], "v", {"hi": 0.99, "lo": 0.0}, median_unbiased=True).first()
    others = {s: kd for t, (s, kd) in terms.items() if t != term}
    mean = rows.agg(*[F.avg(transformed(s, kd)).alias(s) for s, kd in others.items()]).first()
    lo, hi = math.log1p(max(q["lo"], 0.0)), math.log1p(q["hi"])
    grid = [(i, float(math.expm1(lo + (hi - lo) * i / (points - 1))), *[float(math.expm1(mean[s]) if kd == "log1p" else mean[s]) for s, kd in others.items()])
            for i in range(points)]
    return rows.sparkSession.createDataFrame(grid, "point int, " + ", ".join(f"{s} double" for s in (source, *others)))


def random_intercept(rows: DataFrame, y: str, cluster: str, model: Model, terms: Mapping[str, tuple[str, str]], passes: int = 40,
                     tolerance: float = 1e-4, singular: float = 1e-4) -> DataFrame:
    """Logistic model with one random intercept per cluster, by Laplace-style empirical Bayes steps.

    Every step is one aggregation by cluster with map-side combine: a hot cluster is never gathered.
    Cluster modes are a small table joined back by key; the fixed effects take a Schur-complement step and
    the variance is updated from modes and their curvature until it settles.
    """
    names = list(model.terms)
    used = {n: terms[n] for n in names}
    start = fit_batch(rows, y, used, {"fixed": Model(tuple(names), 0.0)}).get("fixed")
    x = design(start, used)
    k = len(x)
    base = keep(rows.select(F.col(cluster).alias("c"), F.col(y).alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)]))
    spark = rows.sparkSession
    try:
        beta, var = start.beta.copy(), 0.1
        modes, small = settle(base.select("c").distinct().withColumn("u", F.lit(0.0)))
        moved, steps, deviance = math.inf, 0, None
        for steps in range(1, passes + 1):
            eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.col("u"))
            j = base.join(F.broadcast(modes) if small else modes, "c").withColumn("eta", eta).withColumn("p", logistic("eta"))
            v, r = F.col("p") * (1 - F.col("p")), F.col("y") - F.col("p")
            ll = -(F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta"))
            per = j.groupBy("c").agg(F.first("u").alias("u"), F.sum(ll).alias("ll"), F.sum(r).alias("s"), F.sum(v).alias("h"),
                                     *[F.sum(r * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(v * F.col(f"x{i}")).alias(f"b{i}") for i in range(k)],
                                     *[F.sum(v * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)])
            per = per.withColumn("su", F.col("s") - F.col("u") / var).withColumn("hu", F.col("h") + 1 / var)
            per, small = settle(per)
            if not small:
                per = stored(per, "cluster-modes")  # many clusters: cut the lineage of the iteration
            row = per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ll") - F.col("u") * F.col("u") / (2 * var)).alias("ll"), F.sum(F.log(F.col("hu") * var)).alias("ld"),
                          F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(1 / F.col("hu")).alias("ih"),
                          F.sum(F.col("s") * F.col("s") - F.col("h")).alias("slope"),
                          *[F.sum(F.col(f"g{i}") - F.col(f"b{i}") * F.col("su") / F.col("hu")).alias(f"g{i}") for i in range(k)],
                          *[F.sum(F.col(f"m{a}_{b}") - F.col(f"b{a}") * F.col(f"b{b}") / F.col("hu")).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)]).first()
            schur = np.array([[row[f"m{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
            step = np.linalg.solve(schur, np.array([row[f"g{i}"] for i in range(k)]))
            deviance = -2 * row["ll"] + row["ld"]
            delta = F.col("su") - sum((F.col(f"b{i}") * F.lit(float(step[i])) for i in range(k)), F.lit(0.0))
            modes = per.select("c", (F.col("u") + delta / F.col("hu")).alias("u"))
            beta = beta + step
            if steps == 1 and row["slope"] <= 0:
                # the likelihood falls as soon as the variance leaves zero: no cluster spread to estimate
                var, deviance, beta = 0.0, -2 * start.loglik, start.beta
                break
            if steps > 1:
                # fixed point of the variance with the modes' effective degrees of freedom
                new = max(row["uu"] / max(row["n"] - row["ih"] / var, 1e-9), 1e-8)
                moved = max(float(np.max(np.abs(step))), abs(new - var) / var)
                var = new
            if moved < tolerance or var < singular:
                break
        fixed_dev = -2 * start.loglik
        stat = max(0.0, fixed_dev - deviance)
        se = np.sqrt(np.diag(start.covariance if var == 0 else np.linalg.inv(schur)))
        out = [(t, float(b), float(s), var, var / (var + math.pi**2 / 3), deviance, deviance + 2 * (k + 1), stat, 0.5 * chi_square_upper(stat, 1), var < singular, steps, int(row["n"]))
               for t, b, s in zip(("(Intercept)", *names), beta, se)]
        return spark.createDataFrame(out, "term string, estimate double, std_error double, cluster_variance double, icc double, deviance double, aic double, "
                                          "lr_chisq double, boundary_p double, singular boolean, steps int, clusters int")
    finally:
        base.unpersist()


