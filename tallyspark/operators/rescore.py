"""Many resamples of many fits, scored and summed where the rows are.

A resample changes the coefficients of a fit and the multiplicity of a row's cluster, never the row. Equal rows of a cluster are one
row with a count. One Arrow pass multiplies the design rows of a fold by the coefficient vectors of all resamples at once and adds up
what the metrics need: weighted counts and losses as vectors over the resamples, and the ranking as a histogram of scores. No table
of rows by resamples is made, and what is exchanged grows with resamples and score bins.

A score bin keeps a score's exponent and its first 11 bits: scores that differ by less than a 2048th of themselves are a tie. Fixed
scores (counts up to 4096 for instance) are binned exactly. Resample 0 is the sample itself.

For predictions that no resample changes, ``paired_auc`` orders the rows once, in slices of the score, and runs one weighted prefix
sum over all resamples in each; a slice leaves three vectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import transformed
from ..session import stored
from ..settings import DEFAULTS
from . import ranking, resample
from .logistic import FitBatch, IncompletePredictions, blocks, spread
from .ordered import running_totals, slice_bounds, with_slice
from .resample import vectors

VECTOR_BYTES = 64 << 20  # of multiplicities that may be broadcast
ENTRIES = 1 << 21  # histogram entries a task holds before it adds them up
CELLS = 1 << 23  # counters of one series that a task holds while its scores lie close together
BLOCK = 1024  # rows whose prefix sums are taken together
EPS = 1e-12


def score_bin(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores: sign, exponent and 11 further bits."""
    bits = x.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 12


def draws(rows: DataFrame, cluster: str, resamples: int, seed: int) -> DataFrame:
    """The sample and its resamples: (resample, cluster, weight) for 0 to ``resamples``."""
    own = rows.select(cluster).distinct().select(F.lit(0).alias("resample"), cluster, F.lit(1).cast("long").alias("weight"))
    drawn = resample.multiplicities(rows, cluster, resamples, seed)
    return own.unionByName(drawn.select((F.col("resample") + 1).cast("int").alias("resample"), cluster, "weight"))


def _with_vectors(rows: DataFrame, weights: DataFrame, cluster: str, resamples: int) -> tuple[DataFrame, bool]:
    """Rows with their cluster's vector; broadcast while clusters x resamples fit the bound, a plain join beyond it."""
    table = stored(vectors(weights, cluster, resamples), "vectors")
    small = table.count() * resamples * 2 <= VECTOR_BYTES
    return rows.join(F.broadcast(table) if small else table, cluster), small


class _Histogram:
    """Weighted counts by (resample, bin) of one series: counters while the bins lie close together, sorted entries beyond that."""

    def __init__(self, resamples: int):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.resamples = resamples
        self.low, self.cells = 0, np.zeros((2, resamples, 0), np.int64)  # by outcome

    def add(self, resample: np.ndarray, bins: np.ndarray, w: np.ndarray, t: np.ndarray) -> None:
        live = w > 0
        self.parts.append(((resample[live] << 32) | (bins[live] + (1 << 31)), w[live], t[live]))
        self.size += int(live.sum())
        if self.size > ENTRIES:
            self.merge()

    def count(self, resample: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """``bins`` and ``w``: the given resamples x rows; ``y``: outcome of the rows."""
        if not self.room(int(bins.min()), int(bins.max())):
            self.add(np.repeat(resample, len(y)), bins.ravel().astype(np.int64), w.ravel(), (w * y).ravel())
            return
        width = self.cells.shape[2]
        at = bins + (resample[:, None] * width + (y * (self.resamples * width) - self.low))
        np.add.at(self.cells.reshape(-1), at.ravel(), w.ravel())

    def room(self, low: int, high: int) -> bool:
        """Make the counters reach from ``low`` to ``high``, an octave of scores at a time."""
        width = self.cells.shape[2]
        if width and low >= self.low and high < self.low + width:
            return True
        start, end = low >> 11 << 11, (high >> 11) + 1 << 11
        if width:
            start, end = min(start, self.low), max(end, self.low + width)
        if 2 * self.resamples * (end - start) > CELLS:
            return False
        grown = np.zeros((2, self.resamples, end - start), np.int64)
        if width:
            grown[:, :, self.low - start:self.low - start + width] = self.cells
        self.low, self.cells = start, grown
        return True

    def close(self) -> None:
        """Counters become entries."""
        both = self.cells.sum(axis=0)
        resample, at = np.nonzero(both)
        if len(at):
            self.parts.append(((resample << 32) | (at + self.low + (1 << 31)), both[resample, at], self.cells[1][resample, at]))
            self.size += len(at)
        self.cells = self.cells[:, :, :0]

    def merge(self) -> None:
        if len(self.parts) > 1 or self.parts:
            key, w, t = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            self.parts = [(key[at], np.add.reduceat(w[order], at), np.add.reduceat(t[order], at))] if len(at) else []
            self.size = len(at)


def _reduce(batches, fits: dict, kinds: list[str], fixed: list[str], good: np.ndarray, table: np.ndarray | None = None):
    """Rows (series, resample, sums, histogram) of one task. ``fits``: fold -> model -> coefficients x resamples."""
    sums = {s: np.zeros((4, len(good))) for s in [*kinds, *fixed]}
    hist = {s: _Histogram(len(good)) for s in sums}
    of = np.arange(len(good))
    if table is not None:
        table = table[:, good]

    def emit(only_large: bool):
        for s, h in hist.items():
            if not only_large:
                h.close()
            h.merge()
            if not h.parts or (only_large and h.size < ENTRIES):
                continue
            key, w, t = h.parts[0]
            at = np.searchsorted(key >> 32, np.arange(len(good) + 1))
            bins = (key & 0xFFFFFFFF) - (1 << 31)
            total, sums[s] = sums[s], np.zeros((4, len(good)))
            step = max(1, len(good) * (ENTRIES >> 2) // max(1, len(key)))
            for i in range(0, len(good), step):
                j = min(i + step, len(good))
                offsets = pa.array((at[i:j + 1] - at[i]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[at[i]:at[j]].astype(np.int64))) for v in (bins, w, t)]
                yield pa.RecordBatch.from_arrays([pa.array([s] * (j - i)), pa.array(good[i:j].astype(np.int32)), *[pa.array(v[i:j]) for v in total], *lists],
                                                 ["series", "resample", "n", "events", "brier", "loss", "bins", "w", "t"])
            h.parts, h.size = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        terms = sum(n.startswith("t") and n[1:].isdigit() for n in batch.schema.names)
        for b, fold, y, n, w in blocks(batch, table, BLOCK // 2):
            if table is None:
                w = w[:, good]
            y = y.astype(np.int64)
            live = np.flatnonzero(w.any(axis=0))  # a resample that drew none of these rows gets nothing from them
            if not len(live):
                continue
            # resamples x rows from here on: a resample's counters lie together
            w = w[:, live].T.astype(np.int64) * n.astype(np.int64)
            wn, we = w.sum(1), w @ y
            x = np.vstack([np.ones(len(y)), *[b.column(f"t{i}").to_numpy(zero_copy_only=False) for i in range(terms)]])
            for name, coefficients in (fits.get(fold) or fits.get(0) or {}).items():
                if not coefficients[1:].any():  # one score for all rows
                    p = 1 / (1 + np.exp(-np.clip(coefficients[:1, live], -700, 700)))
                    q = np.clip(p, EPS, 1 - EPS)[0]
                    sums[name][:, live] += [wn, we, we * (1 - q) ** 2 + (wn - we) * q**2, -(we * np.log(q) + (wn - we) * np.log1p(-q))]
                    hist[name].add(live, score_bin(p)[0], wn, we)
                    continue
                p = coefficients[:, live].T @ x
                np.negative(p, out=p)
                if np.max(p) > 700:
                    np.minimum(p, 700, out=p)
                np.exp(p, out=p)
                np.add(p, 1, out=p)
                np.reciprocal(p, out=p)
                hit = np.clip(p, EPS, 1 - EPS)  # the probability of what happened
                hit[:, y == 0] = 1 - hit[:, y == 0]
                loss = np.einsum("ij,ij->i", w, np.log(hit))
                np.subtract(1, hit, out=hit)
                sums[name][:, live] += [wn, we, np.einsum("ij,ij,ij->i", w, hit, hit), -loss]
                hist[name].count(live, p.astype(np.float32).view(np.int32) >> 12, y, w)  # score_bin of what is not negative
            for i, name in enumerate(fixed):
                bins = score_bin(b.column(f"e{i}").to_numpy(zero_copy_only=False).astype(float))
                order = np.argsort(bins, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
                ws, ts = np.add.reduceat(w[:, order], at, axis=1), np.add.reduceat((w * y)[:, order], at, axis=1)
                sums[name][:2, live] += [wn, we]
                hist[name].add(np.repeat(live, len(at)), np.tile(bins[order][at], len(live)), ws.ravel(), ts.ravel())
        yield from emit(True)
    yield from emit(False)


_OUT = "series string, resample int, n double, events double, brier double, loss double, bins array<bigint>, w array<bigint>, t array<bigint>"


def resampled_totals(rows: DataFrame, batch: FitBatch, weights: DataFrame, resamples: int, y: str = "y", fold: str | None = None,
                     cluster: str = "cluster", scores: Mapping[str, Column] | None = None) -> DataFrame:
    """What the metrics of every series (a model, or a fixed score of ``scores``) and resample need.

    Resamples of which a fit failed are left out; a failed fit of the sample itself (resample 0) is an error.
    """
    failed = batch.failed_resamples()
    if 0 in failed:
        raise IncompletePredictions(batch)
    good = np.array([b for b in range(resamples) if b not in failed], np.int64)
    place = {int(b): i for i, b in enumerate(good)}
    names = list(batch.terms)
    fits: dict = {}
    for f in batch.done():
        if f.resample in place:
            table = fits.setdefault(f.fold, {}).setdefault(f.model, np.zeros((1 + len(names), len(good))))
            slope = f.beta[1:] / f.scale
            table[0, place[f.resample]] = f.beta[0] - np.dot(slope, f.center)
            for term, s in zip(f.terms, slope):
                table[1 + names.index(term), place[f.resample]] = s
    kinds = list(dict.fromkeys(m for models in fits.values() for m in models))
    scores = dict(scores or {})
    cols = [transformed(src, kind).cast("double").alias(f"t{i}") for i, (src, kind) in enumerate(batch.terms.values())]
    x = rows.select(F.col(cluster), F.col(y).cast("int").alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), *cols,
                    *[c.cast("double").alias(f"e{i}") for i, c in enumerate(scores.values())])
    x, table = resample.attach(spread(x, x.count(), resamples), weights, cluster, resamples)
    x = x.sortWithinPartitions("fold", cluster).drop(cluster)
    fixed = list(scores)
    sent = rows.sparkSession.sparkContext.broadcast((fits, table))  # folds x models x terms x resamples numbers, and a bounded matrix
    return stored(x.mapInArrow(lambda it: _reduce(it, sent.value[0], kinds, fixed, good, sent.value[1]), _OUT), "resampled")


def ties(totals: DataFrame) -> DataFrame:
    """(series, resample, score, w, t): the score histograms added up."""
    each = totals.select("series", "resample", F.explode(F.arrays_zip("bins", "w", "t")).alias("e"))
    return each.groupBy("series", "resample", F.col("e.bins").alias("score")).agg(F.sum("e.w").alias("w"), F.sum("e.t").alias("t"))


def metric_draws(totals: DataFrame, top: float = 0.25, benchmark: str | None = None) -> DataFrame:
    """(series, resample, observations, events) with eight metrics: losses, ranking, and the best ``top`` share of the rows.

    Events in the top share are expectations over the tie at its edge. A constant benchmark gets no ranking metrics.
    """
    by = ["series", "resample"]
    s = totals.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("n", "events", "brier", "loss")])
    s = s.select(*by, F.col("n").cast("long").alias("observations"), F.col("events").cast("long").alias("events"),
                 F.try_divide("brier", "n").alias("brier_score"), F.try_divide("loss", "n").alias("log_loss"))
    table = stored(ties(totals), "ties")
    rank = ranking.rank_from_ties(table, by, "score")
    cut = ranking.cutoffs_from_ties(table, by, "score", (top,))
    hits = ranking.expected_targets()
    cut = cut.select(*by, hits.alias("top_events"), F.try_divide(hits, "capacity").alias("top_fraction"),
                     (1 - F.try_divide(hits, "capacity")).alias("top_no_event_fraction"), F.try_divide(hits, "total_t").alias("top_capture_fraction"))
    m = s.join(rank, by).join(cut, by)
    if benchmark is None:
        return m
    const = F.col("series") == benchmark
    return m.withColumns({x: F.when(~const, F.col(x)) for x in ("roc_auc", "average_precision")})


METRICS = ("brier_score", "log_loss", "roc_auc", "average_precision", "top_fraction", "top_no_event_fraction", "top_capture_fraction", "top_events")


def intervals(values: DataFrame, keys: Sequence[str], value: str, resamples: int) -> DataFrame:
    """The value in the sample (resample 0) as estimate, and percentile bounds over the resamples."""
    point = values.where("resample = 0").select(*keys, F.col(value).alias("estimate"))
    bounds = resample.percentile_interval(values.where("resample > 0"), keys, value, resamples)
    same = [point[k].eqNullSafe(bounds[k]) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return point.join(bounds, cond, "left").select(*[point[k] for k in keys], "estimate", "lower", "upper", F.coalesce("estimable_resamples", F.lit(0)).cast("long").alias("estimable_resamples"),
                                                   F.lit(resamples).alias("resamples"))


def policy_draws(totals: DataFrame, capacities: Sequence[float] = DEFAULTS.capacities,
                 objectives: Sequence[tuple[str, bool]] = (("No recorded entry", False), ("Recorded entry", True))) -> DataFrame:
    """Tie-neutral selections of every policy, objective and capacity in every resample. An objective for the absence of the event
    turns scores and targets round, which the same histogram gives."""
    goals = F.array(*[F.struct(F.lit(n).alias("objective"), F.lit(e).alias("event")) for n, e in objectives])
    table = ties(totals).select("resample", F.col("series").alias("policy"), F.explode(goals).alias("g"), "score", "w", "t")
    event = F.col("g.event")
    table = stored(table.select("resample", "policy", F.col("g.objective").alias("objective"), F.when(event, F.col("score")).otherwise(-F.col("score")).alias("score"), "w",
                                F.when(event, F.col("t")).otherwise(F.col("w") - F.col("t")).alias("t")), "policy-ties")
    by = ["resample", "objective", "policy"]
    cut = ranking.cutoffs_from_ties(table, by, "score", capacities)
    hits = ranking.expected_targets()
    return cut.select(*by, "requested_fraction", "capacity", F.col("total_t").alias("target_total"), hits.alias("expected_targets"),
                      F.try_divide(hits, "capacity").alias("selected_target_fraction"))


def audit(batch: FitBatch, resamples: int, minimum: float = 0.9) -> None:
    """Too few resamples in which every fit succeeded are an error."""
    good = resamples - len(batch.failed_resamples() - {0})
    if good < minimum * resamples:
        raise RuntimeError(f"only {good} of {resamples} resamples succeeded")


def _scan(batches, resamples: int):
    """Vectors of each (series, slice): events, others, and pairs won inside it. Rows come sorted by series, slice and score."""
    key = None
    sums = tie = None
    score = None

    def closed():
        """Sums once the open tie is settled."""
        e, f, a = sums
        return e + tie[0], f + tie[1], a + tie[0] * (f + tie[1] / 2)

    def row():
        e, f, a = closed()
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in (e, f, a)]],
                                          ["series", "slice", "e", "f", "a"])

    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            b = batch.slice(s, BLOCK)
            names, slices = b.column("series").to_pylist(), b.column("slice").to_pylist()
            p = b.column("p").to_numpy(zero_copy_only=False)
            n, e = (b.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("n", "e"))
            w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1).astype(float)
            cuts = [0, *[i for i in range(1, len(p)) if names[i] != names[i - 1] or slices[i] != slices[i - 1]], len(p)]
            for i, j in zip(cuts, cuts[1:]):
                if key != (names[i], slices[i]):
                    if key is not None:
                        yield row()
                    key, score = (names[i], slices[i]), None
                    sums, tie = [np.zeros(resamples) for _ in range(3)], [np.zeros(resamples) for _ in range(2)]
                at = np.flatnonzero(np.r_[True, p[i + 1:j] != p[i:j - 1]])
                te, tf = (np.add.reduceat((x * w)[i:j], at) for x in (e, n - e))
                if score == p[i]:  # the tie that the last block left open goes on
                    te[0] += tie[0]
                    tf[0] += tie[1]
                else:
                    sums = list(closed())
                below = sums[1] + np.cumsum(tf, 0) - tf
                done = slice(0, len(at) - 1)
                sums = [sums[0] + te[done].sum(0), sums[1] + tf[done].sum(0), sums[2] + (te[done] * (below[done] + tf[done] / 2)).sum(0)]
                tie, score = [te[-1], tf[-1]], p[j - 1]
    if key is not None:
        yield row()


def auc_by_resample(scored: DataFrame, model: str, cluster: str, y: str, p: str, weights: DataFrame, resamples: int) -> DataFrame:
    """(model, resample, auc) of fixed predictions under every resample; NULL where a class is absent."""
    bounds = slice_bounds(scored, p)
    cell = scored.groupBy(F.col(model).alias("series"), cluster, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("e"))
    cell = with_slice(cell, "p", bounds, "slice")
    # dealt before the vectors are attached: a broadcast keeps the rows in place, and nothing as wide as the resamples is exchanged
    x, in_place = _with_vectors(cell.repartition("series", "slice"), weights, cluster, resamples)
    x = x.select("series", "slice", "p", "n", "e", "w")
    x = (x if in_place else x.repartition("series", "slice")).sortWithinPartitions("series", "slice", "p")
    parts = stored(x.mapInArrow(lambda it: _scan(it, resamples), "series string, slice int, e array<double>, f array<double>, a array<double>"), "scanned")
    long = parts.select("series", "slice", F.posexplode(F.arrays_zip("e", "f", "a")).alias("resample", "v")).select("series", "slice", "resample", "v.*")
    r = running_totals(long, ["series", "resample"], "slice", ["e", "f", "a"], [])
    g = r.groupBy("series", "resample").agg(F.max("total_e").alias("_e"), F.max("total_f").alias("_f"), F.sum(F.col("a") + F.col("e") * F.col("before_f")).alias("_a"))
    ok = (F.col("_e") > 0) & (F.col("_f") > 0)
    return g.select(F.col("series").alias(model), "resample", F.when(ok, F.col("_a") / (F.col("_e") * F.col("_f"))).alias("auc"))


def paired_auc_intervals(scored: DataFrame, cluster: str, pairs: Sequence[tuple[str, str]], resamples: int, seed: int,
                         model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """AUC of a model minus that of its reference in the sample, with percentile bounds over the resamples."""
    a = stored(auc_by_resample(scored, model, cluster, y, p, draws(scored, cluster, resamples, seed), resamples + 1), "aucs")
    wanted = F.broadcast(scored.sparkSession.createDataFrame(list(pairs), f"{model} string, reference string"))
    ref = a.select(F.col(model).alias("reference"), "resample", F.col("auc").alias("_ref"))
    d = a.join(wanted, model).join(ref, ["reference", "resample"]).withColumn("d", F.col("auc") - F.col("_ref"))
    return intervals(d, [model, "reference"], "d", resamples)
