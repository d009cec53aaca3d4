"""Batched penalised logistic regression: all folds, models and resamples in one set of passes.

Every Newton step is one distributed aggregation. Tasks reduce their rows to the gradient, information
and objective of each fit still running; Spark adds those up and the driver solves k x k systems. Rows are
never copied per fit or per resample: a row carries its fold and, for a bootstrap, the number of its cluster, whose
multiplicities a small broadcast matrix holds (or the multiplicities themselves, where there are too many clusters for one).
Equal rows of a cluster are one row with a count; resamples start from the fit of the whole sample. Columns are standardised once; each fit's own training-only scaling is an affine map of that
and enters through k x k matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import logistic, logit, transformed
from ..session import broadcast_if_small, keep
from . import resample

NO_FOLD = 0


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    penalty: float = 1.0


@dataclass
class Fit:
    resample: int
    fold: int
    model: str
    terms: tuple[str, ...]
    penalty: float
    weight: float
    events: float
    center: np.ndarray
    scale: np.ndarray
    constant: np.ndarray
    beta: np.ndarray | None = None
    covariance: np.ndarray | None = None
    objective: float = float("nan")
    loglik: float = float("nan")
    max_gradient: float = float("nan")
    iterations: int = 0
    failure: str | None = None


@dataclass
class FitBatch:
    """Finished fits (coefficients on the training-standardised scale) and failed ones."""

    terms: Mapping[str, tuple[str, str]]
    fits: list[Fit] = field(default_factory=list)

    def done(self) -> list[Fit]:
        return [f for f in self.fits if f.failure is None]

    def failures(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.resample, f.fold, f.model, f.failure) for f in self.fits if f.failure],
                                     "resample int, fold int, model string, reason string")

    def failed_resamples(self) -> set[int]:
        return {f.resample for f in self.fits if f.failure}

    def gate(self, resamples: int, minimum: float = 0.9) -> int:
        """Resamples in which every fit succeeded; too few are an error."""
        good = resamples - len(self.failed_resamples())
        if good < minimum * resamples:
            raise RuntimeError(f"only {good} of {resamples} resamples succeeded")
        return good

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = []
        for f in self.done():
            se = np.sqrt(np.diag(f.covariance))
            for i, term in enumerate(("(Intercept)", *f.terms)):
                rows.append((f.resample, f.fold, f.model, i, term, float(f.beta[i]), float(se[i]), f.penalty))
        return spark.createDataFrame(rows, "resample int, fold int, model string, position int, term string, estimate double, "
                                           "std_error double, penalty double")

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        rows = [(f.resample, f.fold, f.model, len(f.terms), f.penalty, f.weight, f.events, f.iterations, f.max_gradient,
                 float(np.max(np.abs(f.beta))), f.loglik, 2 * (len(f.terms) + 1) - 2 * f.loglik, -2 * f.loglik) for f in self.done()]
        return spark.createDataFrame(rows, "resample int, fold int, model string, slopes int, penalty double, training_n double, "
                                           "training_events double, iterations int, max_gradient double, max_coefficient double, "
                                           "log_likelihood double, aic double, deviance double")

    def scaling(self, spark: SparkSession) -> DataFrame:
        seen, rows = set(), []
        for f in self.done():
            for i, term in enumerate(f.terms):
                key = (f.resample, f.fold, term)
                if key not in seen:
                    seen.add(key)
                    source, kind = self.terms[term]
                    rows.append((*key, source, kind, float(f.center[i]), float(f.scale[i]), bool(f.constant[i]), f.weight))
        return spark.createDataFrame(rows, "resample int, fold int, term string, source string, transformation string, center double, "
                                           "scale double, constant boolean, training_n double")

    def unstable(self, limit: float = 10.0, se_limit: float = 5.0) -> list[str]:
        """Fits that look separated: huge coefficients or standard errors."""
        return [f.model for f in self.done() if np.max(np.abs(f.beta)) > limit or np.max(np.sqrt(np.diag(f.covariance))) > se_limit
                or not np.all(np.isfinite(f.beta))]

    def get(self, model: str, fold: int = NO_FOLD, resample: int = 0) -> Fit:
        return next(f for f in self.done() if (f.model, f.fold, f.resample) == (model, fold, resample))

    def scoring_table(self, spark: SparkSession) -> DataFrame:
        """(resample, fold, model, a): coefficients on the transformed, unscaled columns, 0 for absent terms."""
        names = list(self.terms)
        rows = []
        for f in self.done():
            a = np.zeros(len(names) + 1)
            slope = f.beta[1:] / f.scale
            a[0] = f.beta[0] - np.dot(slope, f.center)
            for term, s in zip(f.terms, slope):
                a[1 + names.index(term)] = s
            rows.append((f.resample, f.fold, f.model, [float(v) for v in a]))
        return spark.createDataFrame(rows, "resample int, fold int, model string, a array<double>")


class IncompletePredictions(RuntimeError):
    """A fit of the cohort itself failed, so that some of its rows would stay unscored."""

    def __init__(self, batch: FitBatch):
        self.batch = batch
        super().__init__("; ".join(f"{f.model}, fold {f.fold}: {f.failure}" for f in batch.fits if f.failure))


BLOCK = 256  # rows whose fits are evaluated together
PER_TASK = 1 << 27  # rows x resamples that one task takes


def spread(rows: DataFrame, n: int, resamples: int) -> DataFrame:
    """Equal rows as one with their count, dealt so that the tasks share the work and not only the bytes, which are few."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * resamples // PER_TASK))
    return rows.repartition(tasks, *rows.columns).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def blocks(batch: pa.RecordBatch, table: np.ndarray | None, size: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows, fold, y, n, w) of at most ``size`` rows of one fold; w has one row if all are of one cluster, and is None without weights."""
    order = batch.column("fold").to_numpy(zero_copy_only=False)
    if "c" in batch.schema.names:
        order = (order.astype(np.int64) << 32) | batch.column("c").to_numpy(zero_copy_only=False)
    if np.any(order[1:] < order[:-1]):
        batch = batch.take(pa.array(np.argsort(order, kind="stable")))
    folds = batch.column("fold").to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.r_[folds[1:] != folds[:-1], True]) + 1
    cluster = batch.column("c").to_numpy(zero_copy_only=False) if "c" in batch.schema.names else None
    for start, end in zip([0, *ends], ends):
        for s in range(start, end, size):
            b = batch.slice(s, min(size, end - s))
            y, n = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "n"))
            w = None
            if table is not None:
                c = cluster[s:s + len(y)]
                w = table[c[:1] if (c == c[0]).all() else c].astype(float)
            elif "w" in batch.schema.names:
                w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1).astype(float)
            yield b, int(folds[s]), y, n, w


def _statistics(batches: Iterator[pa.RecordBatch], k: int, jobs: list, width: int, table: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Per task: objective, gradient and upper information triangle of every running fit."""
    totals = [np.zeros((width, len(ids))) for ids, *_ in jobs]
    triangles = {len(cols): np.triu_indices(len(cols)) for _, _, cols, *_ in jobs}
    for batch in batches:
        if not batch.num_rows:
            continue
        for b, fold, y, n, w in blocks(batch, table, BLOCK):
            x = np.column_stack([np.ones(len(y))] + [b.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            drawn = None if w is None else w.any(axis=0)
            products: dict = {}
            for total, (_, held, cols, slots, beta) in zip(totals, jobs):
                if held != NO_FOLD and fold == held:
                    continue
                m = len(cols)
                if tuple(cols) not in products:
                    xs = x[:, cols]
                    i, j = triangles[m]
                    products[tuple(cols)] = xs, xs * n[:, None], xs[:, i] * xs[:, j] * n[:, None]
                xs, xn, xx = products[tuple(cols)]
                # fits whose resample drew none of these rows get nothing from them
                at = slice(None) if drawn is None else np.flatnonzero(drawn[slots])
                ws = np.ones((1, 1)) if w is None else w[:, slots[at]]
                bs = beta[:, at]
                one = len(ws) == 1

                def add(a, v, ws=ws, one=one):
                    return (a.T @ v) * ws if one else a.T @ (v * ws)

                if not bs.shape[1]:
                    continue
                if m == 1:  # an intercept alone is the same for all rows
                    target, weight, eta = add(xn, y[:, None]), add(n[:, None], np.ones((len(y), 1))), bs
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    part = [weight * np.logaddexp(0, eta) - target * eta, weight * p - target, weight * p * (1 - p)]
                else:
                    # all from exp(-margin), so that the small losses and residuals of a separated fit are not differences of large sums
                    away = (1 - 2 * y)[:, None]
                    eta = (xs * away) @ bs
                    if np.max(eta) < 700:
                        u = np.exp(eta)
                        v = 1 + u
                        soft = np.log(v, out=eta)
                        soft += (u - (v - 1)) / v  # what 1 + u has lost of u
                        np.divide(u, v, out=u)  # the residual without its sign
                        np.divide(u, v, out=v)  # p (1 - p)
                    else:
                        soft = np.logaddexp(0, eta)
                        u = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                        v = u * (1 - u)
                    part = [add(n[:, None], soft), add(xn * away, u), add(xx, v)]
                total[:1 + m + len(triangles[m][0]), at] += np.concatenate(part)
    for total, (ids, *_) in zip(totals, jobs):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32())] + [pa.array(row) for row in total],
                                         ["fit"] + [f"s{i}" for i in range(width)])


def _moments(base: DataFrame, k: int, weights: DataFrame | None, cluster: str) -> dict:
    """Sums of 1, y, z, z^2 by (resample, fold), clusters reduced before multiplicities are applied."""
    names = ["n", "e", *[f"m{i}" for i in range(k)], *[f"q{i}" for i in range(k)]]
    n = F.col("n")
    aggs = [F.sum(n).alias("n"), F.sum(n * F.col("y")).alias("e"), *[F.sum(n * F.col(f"z{i}")).alias(f"m{i}") for i in range(k)],
            *[F.sum(n * F.col(f"z{i}") * F.col(f"z{i}")).alias(f"q{i}") for i in range(k)]]
    if weights is None:
        rows = base.groupBy("fold").agg(*aggs).select(F.lit(0).alias("resample"), "fold", *names).collect()
    else:
        cell = base.groupBy(cluster, "fold").agg(*aggs)
        rows = cell.join(weights, cluster).groupBy("resample", "fold").agg(
            *[F.sum(F.col(x) * F.col("weight")).alias(x) for x in names]).collect()
    return {(int(r["resample"]), int(r["fold"])): np.array([float(r[x] or 0) for x in names]) for r in rows}


def fit_batch(rows: DataFrame, y: str, terms: Mapping[str, tuple[str, str]], models: Mapping[str, Model], fold: str | None = None,
              held_out: Sequence[int] = (NO_FOLD,), weights: DataFrame | None = None, resamples: int = 1, cluster: str = "cluster",
              max_passes: int = 100, tolerance: float = 1e-7, accept: float = 1e-6, limit: float = 30.0) -> FitBatch:
    """Fit every (resample, held-out fold, model).

    ``terms`` maps a term to (source column, transformation); ``held_out`` lists the folds left out of
    training, NO_FOLD meaning all rows. ``weights`` is (resample, cluster, weight).
    """
    names = list(terms)
    k = len(names)
    cols = [transformed(src, kind).alias(f"t{i}") for i, (src, kind) in enumerate(terms.values())]
    fold_col = F.col(fold).cast("int") if fold else F.lit(NO_FOLD)
    carry = [F.col(cluster)] if weights is not None else []
    t = rows.select(F.col(y).cast("int").alias("y"), fold_col.alias("fold"), *carry, *cols)
    g = t.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"t{i}").alias(f"a{i}") for i in range(k)],
              *[F.stddev_pop(f"t{i}").alias(f"d{i}") for i in range(k)],
              *[F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"u{i}") for i in range(k) for c in (F.col(f"t{i}").cast("double"),)],
              F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("uy")).first()
    unusable = {n: g[f"u{i}"] for i, n in enumerate(names) if g[f"u{i}"]} | ({y: g["uy"]} if g["uy"] else {})
    if unusable:
        raise ValueError(f"missing or non-finite values in the cohort: {unusable}")
    mid = np.array([g[f"a{i}"] for i in range(k)], dtype=float)
    dev = np.array([g[f"d{i}"] for i in range(k)], dtype=float)
    dev[~np.isfinite(dev) | (dev < 1e-12)] = 1.0
    z = t.select("y", "fold", *carry, *[((F.col(f"t{i}") - F.lit(float(mid[i]))) / F.lit(float(dev[i]))).alias(f"z{i}") for i in range(k)])
    table = None
    if weights is None:
        z = z.withColumn("n", F.lit(1))
    else:
        z, table = resample.attach(spread(z, g["n"], resamples), weights, cluster, resamples)
        z = z.sortWithinPartitions("fold", cluster)
    base = keep(z)
    sent = None if table is None else rows.sparkSession.sparkContext.broadcast(table)  # bounded by resample.MATRIX_ENTRIES
    limits = (max_passes, tolerance, accept, limit)
    try:
        starts, drawn = {}, None
        if weights is not None:
            # the fits of the whole sample; those that fail leave their resamples the usual start
            whole = _moments(base, k, None, cluster)
            first = FitBatch(terms, [_prepare(0, f, name, m, names, whole, mid, dev) for f in held_out for name, m in models.items()])
            starts = _newton(base.drop(cluster, "c", "w"), first, names, mid, dev, *limits)
            if table is not None and len(table) <= resamples:
                drawn = table
        moments = _moments(base, k, weights, cluster)
        batch = FitBatch(terms, [_prepare(b, f, name, m, names, moments, mid, dev)
                                 for b in range(resamples) for f in held_out for name, m in models.items()])
        _newton(base.drop(cluster) if weights is not None else base, batch, names, mid, dev, *limits, starts, sent, drawn)
        return batch
    finally:
        base.unpersist()


def _prepare(b: int, held: int, name: str, model: Model, names: list[str], moments: dict, mid, dev) -> Fit:
    k = len(names)
    total = sum((v for (r, f), v in moments.items() if r == b and (held == NO_FOLD or f != held)), np.zeros(2 + 2 * k))
    idx = [names.index(t) for t in model.terms]
    n, e = total[0], total[1]
    mean = total[2:2 + k][idx] / max(n, 1)
    # frequency-weighted variance with n-1, from sums centred near the mean
    var = (total[2 + k:][idx] - n * mean**2) / max(1.0, n - 1)
    sd = np.sqrt(np.maximum(var, 0)) * dev[idx]
    constant = ~np.isfinite(sd) | (sd < 1e-12)
    fit = Fit(b, held, name, model.terms, model.penalty, float(n), float(e), mid[idx] + mean * dev[idx], np.where(constant, 1.0, sd), constant)
    if n <= 0 or e <= 0 or e >= n:
        fit.failure = "Training sample has only one outcome class"
    return fit


def _newton(base: DataFrame, batch: FitBatch, names: list[str], mid, dev, max_passes: int, tolerance: float, accept: float, limit: float,
            starts: Mapping | None = None, sent=None, drawn: np.ndarray | None = None) -> dict:
    """Run every fit to its end. ``starts`` and what is returned: (fold, model) -> coefficients on the shared columns.

    With ``drawn`` (clusters x resamples) the first step of the fits that have such a start comes from one pass over the clusters'
    own sums at it, which the multiplicities combine.
    """
    k = len(names)
    state = {}
    maps = {}
    for i, f in enumerate(batch.fits):
        if f.failure:
            continue
        idx = [names.index(t) for t in f.terms]
        m = len(idx) + 1
        # training-standardised columns as an affine map of the shared columns
        shift = (f.center - mid[idx]) / dev[idx]
        ratio = f.scale / dev[idx]
        a = np.zeros((m, m))
        a[0, 0] = 1
        a[0, 1:] = -shift / ratio
        a[np.arange(1, m), np.arange(1, m)] = 1 / ratio
        start = np.zeros(m)
        start[0] = np.log(f.events / (f.weight - f.events))
        if m > 1 and (f.fold, f.model) in (starts or {}):
            start = np.linalg.solve(a, starts[f.fold, f.model])
        maps[i] = a
        state[i] = {"map": a, "cols": [0, *[j + 1 for j in idx]], "at": start, "rate": 1.0, "from": None, "step": None, "old": np.inf,
                    "pen": np.r_[0.0, np.full(m - 1, f.penalty)]}
    width = 1 + (k + 1) + (k + 1) * (k + 2) // 2
    schema = "fit int, " + ", ".join(f"s{i} double" for i in range(width))

    def summed(jobs, sent):
        parts = base.mapInArrow(lambda it: _statistics(it, k, jobs, width, None if sent is None else sent.value), schema)
        return parts.groupBy("fit").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect()

    if drawn is not None:
        groups = {}
        for i, s in state.items():
            f = batch.fits[i]
            if len(s["cols"]) > 1 and (f.fold, f.model) in starts:
                groups.setdefault((f.fold, f.model), []).append(i)
        of = len(drawn)
        jobs = [(list(range(g * of, (g + 1) * of)), fold, list(state[ids[0]]["cols"]), np.arange(of), np.column_stack([starts[fold, model]] * of))
                for g, ((fold, model), ids) in enumerate(groups.items())]
        each = np.zeros((len(groups) * of, width))
        for row in summed(jobs, base.sparkSession.sparkContext.broadcast(np.eye(of, dtype=np.int16))) if jobs else []:
            each[row["fit"]] = row[1:]
        for g, ids in enumerate(groups.values()):
            for i in ids:
                _advance(batch.fits[i], state, i, drawn[:, batch.fits[i].resample].astype(float) @ each[g * of:(g + 1) * of], tolerance, limit)
    for _ in range(max_passes):
        if not state:
            break
        groups: dict = {}
        for i in state:
            f = batch.fits[i]
            groups.setdefault((f.fold, tuple(state[i]["cols"])), []).append(i)
        jobs = [(ids, fold, list(cols), np.array([batch.fits[i].resample for i in ids]),
                 np.column_stack([state[i]["map"] @ state[i]["at"] for i in ids])) for (fold, cols), ids in groups.items()]
        for row in summed(jobs, sent):
            i = row["fit"]
            _advance(batch.fits[i], state, i, np.array(row[1:], dtype=float), tolerance, limit)
    for i, s in state.items():
        f = batch.fits[i]
        if s["step"] is None or f.max_gradient >= max(accept, 1e-12 * f.weight):
            f.failure = "Fit did not reach a stable finite solution"
        else:
            _finish(f, s, limit)
    return {(f.fold, f.model): maps[i] @ f.beta for i, f in enumerate(batch.fits) if f.failure is None}


def _advance(f: Fit, state: dict, i: int, s: np.ndarray, tolerance: float, limit: float) -> None:
    st = state[i]
    m = len(st["cols"])
    pen, at = st["pen"], st["at"]
    objective = s[0] + np.sum(pen * at**2) / 2
    # sums over n rows carry rounding noise that grows with n, so both tolerances do too
    tolerance = max(tolerance, 1e-13 * f.weight)
    if not objective <= st["old"] + 1e-10 + 1e-12 * abs(st["old"]):
        st["rate"] /= 2
        if st["rate"] < 2**-20:
            f.failure = "Line search failed"
            del state[i]
            return
        st["at"] = st["from"] - st["rate"] * st["step"]
        return
    gradient = st["map"].T @ s[1:1 + m] + pen * at
    info = np.zeros((m, m))
    info[np.triu_indices(m)] = s[1 + m:1 + m + m * (m + 1) // 2]
    info = info + np.triu(info, 1).T
    info = st["map"].T @ info @ st["map"] + np.diag(pen)
    f.max_gradient, f.objective, f.loglik = float(np.max(np.abs(gradient))), float(objective), float(-s[0])
    st["info"], st["good"] = info, at
    if f.max_gradient < tolerance:
        _finish(f, st, limit)
        del state[i]
        return
    try:
        step = np.linalg.solve(info, gradient)
    except np.linalg.LinAlgError:
        step = np.array([np.nan])
    if not np.all(np.isfinite(step)):
        f.failure = "Information matrix is singular"
        del state[i]
        return
    f.iterations += 1
    st.update({"from": at, "step": step, "rate": 1.0, "old": objective, "at": at - step})


def _finish(f: Fit, st: dict, limit: float) -> None:
    beta = st["good"]
    if not np.all(np.isfinite(beta)) or np.max(np.abs(beta)) > limit:
        f.failure = "Fit did not reach a stable finite solution"
        return
    try:
        covariance = np.linalg.inv(st["info"])
    except np.linalg.LinAlgError:
        f.failure = "Information matrix is singular"
        return
    f.beta, f.covariance = beta, covariance


def predict(rows: DataFrame, batch: FitBatch, keep_columns: Sequence[str], fold: str | None = None, weights: DataFrame | None = None,
            cluster: str = "cluster", override: Mapping[str, float] | None = None) -> DataFrame:
    """Long predictions (…, resample, fold, model, p): every row scored by the fits that held its fold out.

    ``override`` sets a source column to a constant at scoring time only; training scaling is untouched.
    """
    spark = rows.sparkSession
    table = F.broadcast(batch.scoring_table(spark))  # fits x terms, built from driver-side results
    for source, value in (override or {}).items():
        rows = rows.withColumn(source, F.lit(float(value)))
    t = [transformed(src, kind).alias(f"_t{i}") for i, (src, kind) in enumerate(batch.terms.values())]
    x = rows.select(*keep_columns, *([F.col(fold).cast("int").alias("fold")] if fold else [F.lit(NO_FOLD).alias("fold")]),
                    *([F.col(cluster).alias("_cluster")] if weights is not None else []), *t)
    on = ["fold"]
    if weights is not None:
        w = weights.select(F.col(cluster).alias("_cluster"), F.col("resample").cast("int").alias("resample"), "weight")
        x, on = x.join(broadcast_if_small(w, 1_000_000), "_cluster"), ["resample", "fold"]
    x = x.join(table, on)
    eta = F.col("a")[0]
    for i in range(len(batch.terms)):
        eta = eta + F.col("a")[i + 1] * F.col(f"_t{i}")
    return x.select(*keep_columns, "resample", "fold", "model", *(["weight"] if weights is not None else []), logistic(eta).alias("p"))


def _newton_step(problem: dict, objective: float, gradient: np.ndarray, information: np.ndarray, tolerance: float) -> None:
    """One damped step of a small problem: a step that made things worse is halved, a small gradient ends it."""
    if not objective <= problem["old"] + 1e-12 * abs(problem["old"]):
        problem["rate"] /= 2
        problem["at"] = problem["from"] - problem["rate"] * problem["step"]
        problem["live"] = problem["rate"] > 2**-20
        return
    if np.max(np.abs(gradient)) <= tolerance:
        # a separated sample has a small gradient too, far out, where the information vanishes
        spread = np.diag(np.linalg.pinv(information)) if np.all(np.isfinite(information)) else np.array([np.inf])
        problem.update(live=False, result=problem["at"] if np.linalg.det(information) > 0 and np.max(spread) < 1e6 else None)
        return
    if not np.all(np.isfinite(information)) or np.linalg.det(information) <= 0:
        problem["live"] = False
        return
    step = np.linalg.solve(information, gradient)
    problem.update({"from": problem["at"], "step": step, "rate": 1.0, "old": objective, "at": problem["at"] - step})


def calibration(scored: DataFrame, groups: Sequence[str], y: str = "y", p: str = "p", w: str | None = None, eps: float = 1e-12,
                passes: int = 200) -> DataFrame:
    """Calibration intercept and slope (joint), and intercept with the slope fixed at one, per group.

    Rows collapse to distinct (group, p); each damped Newton step of all groups is one aggregate over those. What has not settled,
    or has no finite answer, is NULL: a last iterate is no result.
    """
    k = F.col(w) if w else F.lit(1)
    ties = keep(scored.groupBy(*groups, p).agg(F.sum(k).cast("double").alias("w"), F.sum(k * F.col(y)).cast("double").alias("t")).select(
        *groups, logit(p, eps).alias("x"), "w", "t"))
    spark = scored.sparkSession

    def fresh(start, live):
        return {"at": np.array(start), "old": np.inf, "live": live, "result": None, "rate": 1.0}

    try:
        head = ties.groupBy(*groups).agg(F.sum("w").alias("w"), F.sum("t").alias("t"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                       F.avg(F.col("w") * F.col("x")).alias("wx"), F.avg("w").alias("aw")).collect()
        state = {}
        for r in head:
            both = 0 < r["t"] < r["w"]
            # from the base rate, where the likelihood curves: a start at slope one may lie on a plateau
            base = float(np.log(r["t"] / (r["w"] - r["t"]))) if both else 0.0
            state[tuple(r[g] for g in groups)] = {"tolerance": 1e-9 * max(1.0, r["w"]), "joint": fresh([base, 0.0], both and r["lo"] < r["hi"]),
                                                  "offset": fresh([base - r["wx"] / r["aw"]], both)}
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ties.schema if f.name in groups)
        for _ in range(passes):
            live = [(*g, *map(float, s["joint"]["at"]), float(s["offset"]["at"][0])) for g, s in state.items() if s["joint"]["live"] or s["offset"]["live"]]
            if not live:
                break
            beta = F.broadcast(spark.createDataFrame(live, f"{types}{', ' if groups else ''}a double, b double, c double"))
            j = ties.join(beta, list(groups)) if groups else ties.crossJoin(beta)
            x = F.col("x")
            j = j.withColumn("ej", F.col("a") + F.col("b") * x).withColumn("eo", F.col("c") + x)
            j = j.withColumn("q", logistic("ej")).withColumn("r", logistic("eo"))

            def loss(eta):
                e = F.col(eta)
                return F.col("w") * (F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))) - F.col("t") * e

            v, d = F.col("w") * F.col("q") * (1 - F.col("q")), F.col("w") * F.col("q") - F.col("t")
            sums = {"lj": loss("ej"), "g0": d, "g1": d * x, "h00": v, "h01": v * x, "h11": v * x * x, "lo": loss("eo"), "gc": F.col("w") * F.col("r") - F.col("t"),
                    "hc": F.col("w") * F.col("r") * (1 - F.col("r"))}
            for row in j.groupBy(*groups).agg(*[F.sum(e).alias(n) for n, e in sums.items()]).collect():
                s = state[tuple(row[g] for g in groups)]
                if s["joint"]["live"]:
                    _newton_step(s["joint"], row["lj"], np.array([row["g0"], row["g1"]]), np.array([[row["h00"], row["h01"]], [row["h01"], row["h11"]]]), s["tolerance"])
                if s["offset"]["live"]:
                    _newton_step(s["offset"], row["lo"], np.array([row["gc"]]), np.array([[row["hc"]]]), s["tolerance"])
        out = []
        for g, s in state.items():
            joint, offset = (s[x]["result"] for x in ("joint", "offset"))
            out.append((*g, *((None, None) if joint is None else map(float, joint)), None if offset is None else float(offset[0])))
        return spark.createDataFrame(out, f"{types}{', ' if groups else ''}calibration_intercept double, calibration_slope double, offset_intercept double")
    finally:
        ties.unpersist()


def training_scales(rows: DataFrame, fold: str, terms: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Training-only centre and scale of every term for every held-out fold, from one aggregate by fold."""
    names = list(terms)
    t = rows.select(F.col(fold).alias("fold"), *[transformed(s, kd).alias(f"t{i}") for i, (s, kd) in enumerate(terms.values())])
    mid = t.agg(*[F.avg(f"t{i}").alias(f"t{i}") for i in range(len(names))]).first()
    per = t.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"t{i}") - F.lit(float(mid[i]))).alias(f"m{i}") for i in range(len(names))],
                                *[F.sum(F.pow(F.col(f"t{i}") - F.lit(float(mid[i])), F.lit(2.0))).alias(f"q{i}") for i in range(len(names))])
    folds = [r["fold"] for r in per.select("fold").collect()]
    long = per.withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in folds]))).where(F.col("fold") != F.col("held_out"))
    s = long.groupBy("held_out").agg(F.sum("n").alias("n"), *[F.sum(f"{a}{i}").alias(f"{a}{i}") for a in "mq" for i in range(len(names))])
    n = F.col("n")
    parts = []
    for i, name in enumerate(names):
        sd = F.sqrt(F.greatest(F.lit(0.0), (F.col(f"q{i}") - F.col(f"m{i}") * F.col(f"m{i}") / n) / F.greatest(F.lit(1), n - 1)))
        parts.append(F.struct(F.lit(name).alias("term"), (F.lit(float(mid[i])) + F.col(f"m{i}") / n).alias("center"),
                              F.when(sd < 1e-12, 1.0).otherwise(sd).alias("scale"), (sd < 1e-12).alias("constant")))
    return s.select("held_out", F.col("n").alias("training_n"), F.inline(F.array(*parts)))
