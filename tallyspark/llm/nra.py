"""Exact top-k by inner product without random access: sorted lists, score bounds, early stop.

Every task sorts each dimension of a block of candidates and reads the lists from the end that helps the query, a share of
the list at a time. A component that has been read is known; one that has not is bounded by the last value read (above) and
by the far end of its list (below). The k-th best lower bound, carried from block to block, is the bar: candidates whose
upper bound is below it are dropped, and a query stops reading when its outsiders cannot reach the bar any more. Those
left get their final score. Bounds of a block are two matrix products, one for positive and one for negative query
components.

Vectors are integers. Rows with a null key, a null or empty vector, a null or non-finite component, or another length than the
query's take no part. A query's own rows are those with its key; a key that repeats as query is one query (its smallest
vector), as candidate it counts once per row. Ties go to the smaller key. Fewer candidates than k: all are returned. An
empty table gives an empty result. Only the key and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

K = 20
BLOCK = 4096  # candidates whose lists are sorted together
QUERY_BLOCK = 16_384  # queries that meet the candidates in one pass; the only rows that go through the driver
QUERY_TILE = 512
DEPTHS = (0.125, 0.25, 0.5)
FEW = 8  # a query stops once at most FEW * k candidates are open


def whole(vector: str | F.Column, scale: float = 64.0):
    """floor(scale * x) of every component as longs; null if the vector or a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & ok, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _kind(a: np.ndarray, b: np.ndarray):
    """The fastest number type in which all inner products are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, bar: np.ndarray, k: int,
                 depths=DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of all candidates of a block that may be among a query's k best.

    bar: the k-th best score known for each query so far, raised in place.
    """
    n = len(x)
    kind = _kind(x, q)
    down = np.sort(x, 0)[::-1]
    out: list[tuple] = []
    for s in range(0, len(q), QUERY_TILE):
        at = np.arange(s, min(s + QUERY_TILE, len(q)))
        plus, minus = np.maximum(q[at], 0).T.astype(kind), np.minimum(q[at], 0).T.astype(kind)
        live_q, live_x = np.arange(len(at)), np.arange(n)
        # without a bar nothing can be dropped before the lists end
        for share in depths if np.isfinite(bar[at]).any() and kind != np.int64 else ():
            t = max(1, int(n * share))
            above, below = down[t - 1], down[n - t]
            part = x[live_x]
            upper = np.where(part >= above, part, above).astype(kind) @ plus[:, live_q]
            upper += np.where(part <= below, part, below).astype(kind) @ minus[:, live_q]
            open_ = upper >= bar[at][live_q]
            some = open_.any(0)
            few = open_.sum(0) <= FEW * k
            close = np.flatnonzero(few & some)
            if len(close):  # outsiders cannot qualify: resolve the open ones
                c, i = np.nonzero(open_[:, close].T)
                out.append(_resolved(x, q, live_x[i], at[live_q[close[c]]]))
            left = some & ~few
            open_ = open_[:, left]
            live_q = live_q[left]
            live_x = live_x[open_.any(1)] if len(live_q) else live_x[:0]
            if not len(live_x):
                break
        if len(live_q) and len(live_x):
            full = x[live_x].astype(kind) @ q[at][live_q].T.astype(kind)
            own = ids[live_x][:, None] == qids[at][live_q][None, :]
            worst = -np.inf if kind != np.int64 else np.iinfo(np.int64).min
            if len(live_x) > k:
                ranked = np.where(own, worst, full)
                edge = np.partition(ranked, len(live_x) - k, axis=0)[len(live_x) - k]
                edge = np.maximum(edge, bar[at][live_q]) if kind != np.int64 else edge
            else:
                edge = np.full(len(live_q), worst)
            i, c = np.nonzero((full >= edge) & ~own)
            out.append((at[live_q[c]], live_x[i], full[i, c].astype(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    qn, cn, score = (np.concatenate([o[j] for o in out]) for j in range(3))
    keep = ids[cn] != qids[qn]
    return qn[keep], cn[keep], score[keep]


def _resolved(x, q, cn, qn):
    return qn, cn, np.einsum("ij,ij->i", x[cn], q[qn])


def best(qn: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, qn))
    first = np.searchsorted(qn[order], qn[order])
    return order[np.arange(len(order)) - first < k]


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "v", k: int = K, block: int = BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the k best other rows of each query. ``vector`` is an array of longs."""
    rows = stored(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        "id IS NOT NULL AND size(v) > 0"), "vectors")
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    found = None
    parts = max(1, -(-queries.count() // query_block))
    for b in range(parts):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).toArrow().sort_by("id")
        qids = got.column("id").to_numpy()
        lists = got.column("v").to_pylist()
        by_size = {n: (np.array([i for i, v in enumerate(lists) if len(v) == n]), np.array([v for v in lists if len(v) == n], np.int64).reshape(-1, n)) for n in {len(v) for v in lists}}
        sent = rows.sparkSession.sparkContext.broadcast((qids, by_size))

        def run(batches, sent=sent):
            qids, by_size = sent.value
            bar = np.full(len(qids), -np.inf)
            held = [np.zeros(0, np.int64)] * 3
            for n, ids, x in _blocks(batches, block):
                if n not in by_size:
                    continue
                numbers, q = by_size[n]
                own = bar[numbers]
                qn, cn, score = search_block(x, ids, q, qids[numbers], own, k)
                held = [np.concatenate(p) for p in zip(held, (numbers[qn], ids[cn], score))]
                keep = best(*held, k)
                held = [h[keep] for h in held]
                counts = np.bincount(held[0], minlength=len(qids))
                last = np.cumsum(counts) - 1
                full = counts == k
                bar[full] = held[2][last[full]]
            yield pa.RecordBatch.from_arrays([pa.array(qids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "score"])

        part = rows.select("id", "v").mapInArrow(run, "query_id long, id long, score long")
        # each task sends at most k rows for a query
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        part = stored(part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "ranked")
        found = part if found is None else found.unionAll(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _blocks(batches, size: int):
    """Blocks of candidates of one vector length."""
    held: dict[int, list] = {}
    count: dict[int, int] = {}

    def block(n):
        ids, x = zip(*held.pop(n))
        count.pop(n)
        return n, np.concatenate(ids), np.concatenate(x)

    for batch in batches:
        ids = batch.column("id").to_numpy()
        lists = batch.column("v")
        length = np.diff(np.asarray(lists.offsets))
        flat = lists.flatten().to_numpy()
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        for n in np.unique(length).tolist():
            pick = np.flatnonzero(length == n)
            x = flat[start[pick][:, None] + np.arange(n)] if n else np.zeros((len(pick), 0), np.int64)
            for s in range(0, len(pick), size):
                held.setdefault(n, []).append((ids[pick[s:s + size]], x[s:s + size]))
                count[n] = count.get(n, 0) + len(pick[s:s + size])
                if count[n] >= size:
                    yield block(n)
    for n in list(held):
        yield block(n)
