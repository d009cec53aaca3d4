"""Benchmark decontamination by latent semantic retrieval, common subsequences and answer checks.

Words are runs of letters and digits in lower case (any non-ASCII byte counts as a letter). Items become TF-IDF vectors,
with inverse document frequencies counted over all documents, and a distributed randomised SVD of the item passages gives
the latent space; terms outside it have no direction but weigh in a passage's length. Documents are cut into overlapping
passages at the length of the items sought (a quarter more, in steps of sqrt 2). A passage is a candidate for an item if its
cosine in the latent space reaches ``COSINE`` of what the item reaches with itself. A candidate is a leak if the longest common
subsequence of item and passage covers ``VERBATIM`` of the item's words, or ``PARAPHRASE`` of them and the passage also
holds the item's answer, its last ``ANSWER`` words, in a row.

Passages that cannot be candidates or leaks are passed over first, by bounds that lose none. A projection is not longer than
what it projects, so a passage's shared terms, with their repeats, must be long enough for ``COSINE``. And a leak holds an
answer, or one of the rarest words of an item, as many of them as ``VERBATIM`` lets go and one more.

Null or empty texts and texts shorter than an item's passages are one passage; items with fewer than ``LEAST`` words, or a
null id, say nothing and are not sought. Repeated rows and items are reported as often as they come up, once per (key,
item). Rows with a null key are reported with a null key. Empty tables give an empty result. Only the key and text columns
of each table are read. Items are taken in blocks of at most about ``ITEM_BLOCK``, each of which is searched in all
documents; a block's index is all that goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .columnar import chunks, text_bytes, word_bounds, word_hashes

SLOTS = 1 << 18  # hashed terms
RANK = 256
ITEM_BLOCK = 2048
COSINE = 0.3
VERBATIM = 0.8
PARAPHRASE = 0.5
ANSWER = 4
LEAST = 5

_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts, and where each row's words begin."""
    buf, off = text_bytes(texts, lower=True)
    s, e, first = word_bounds(buf, off, _NO_WORD)
    return word_hashes(buf, s, e, 2), first


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents per hashed term, and all documents. Tasks count, at most SLOTS rows reach the driver."""
    def run(batches):
        df, rows = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for c in chunks(batch, "text"):
                h, first = terms(c.column("text"))
                row = np.repeat(np.arange(c.num_rows), np.diff(first))
                pair = np.unique(row * SLOTS + slots(h))
                df[:SLOTS] += np.bincount(pair % SLOTS, minlength=SLOTS)
                df[SLOTS] += c.num_rows
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["slot", "n"])

    got = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS + 1, np.int64)
    df[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return df[:SLOTS], int(df[SLOTS])


def _sum_rows(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum the vectors of (slot, x) by slot, spread over groups of slots."""
    def add(key, table):
        at = table.column("slot").to_numpy()
        x = np.asarray(table.column("x").combine_chunks().values).reshape(-1, width)
        order = np.argsort(at, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        total = np.add.reduceat(x[order], new, axis=0)
        return pa.table({"slot": at[order][new], "x": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))})

    got = parts.groupBy((F.col("slot") % 64).alias("g")).applyInArrow(add, "slot long, x array<double>").toArrow().sort_by("slot")
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, width))
    return got.column("slot").to_numpy(), np.asarray(got.column("x").combine_chunks().values).reshape(-1, width)


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Randomised SVD of the TF-IDF rows of ``passages`` (text): (slots, directions), the leading right singular vectors.

    Each round multiplies an orthonormal basis by the matrix's Gram matrix; tasks add up the rows of the product.
    """
    def times(basis):
        def run(batches):
            for batch in batches:
                h, first = terms(batch.column("text"))
                t = slots(h)
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                if basis is None:  # a random basis, drawn by slot
                    def at(s):
                        return np.stack([np.random.default_rng(int(k)).normal(size=width) for k in s]) if len(s) else np.zeros((0, width))
                else:
                    def at(s):
                        return basis[1][np.searchsorted(basis[0], s)]
                own, number = np.unique(t, return_inverse=True)
                b = at(own)
                if not len(own):
                    continue
                weight = idf[t][:, None]
                proj = np.zeros((batch.num_rows, width))
                np.add.at(proj, row, weight * b[number])
                out = np.zeros((len(own), width))
                np.add.at(out, number, weight * proj[row])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))], ["slot", "x"])

        return _sum_rows(passages.select("text").mapInArrow(run, "slot long, x array<double>"), width)

    width = rank + 8
    basis = None
    for _ in range(rounds):
        at, y = times(basis)
        if not len(at):
            return at, y
        q = np.linalg.qr(y)[0]
        width = q.shape[1]
        basis = (at, q)
    # the small problem: q' (A'A) q
    at, y = times(basis)
    value, vector = np.linalg.eigh(basis[1].T @ y)
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-9 * max(value.max(), 1e-30)]
    return basis[0], basis[1] @ vector[:, keep]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def passage_length(words: int) -> int:
    """The smallest step of sqrt 2 from 16 that is a quarter longer than an item."""
    n = 0
    while round(16 * 2 ** (n / 2)) < 1.25 * words:
        n += 1
    return round(16 * 2 ** (n / 2))


def runs(h: np.ndarray) -> np.ndarray:
    """A hash of every ANSWER words in a row."""
    n = len(h) - ANSWER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ANSWER if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n].astype(np.uint64)
    return out


class Index:
    """The items of a block: their words, their places in the latent space, and the passage lengths they are sought at."""

    def __init__(self, ids: list, words: list[np.ndarray], idf: np.ndarray, at: np.ndarray, space: np.ndarray):
        self.ids, self.words = ids, [w.tolist() for w in words]
        self.idf2 = (idf * idf).astype(np.float32)
        self.inside = np.zeros(SLOTS, bool)
        self.inside[at] = True
        self.at, self.space = at, (idf[at][:, None] * space).astype(np.float32)
        place = np.stack([self.project(slots(w)) for w in words]) if words else np.zeros((0, space.shape[1]), np.float32)
        norm = np.array([np.sqrt(self.idf2[slots(w)].sum()) for w in words])
        self.lengths: dict[int, tuple] = {}
        size = np.array([passage_length(len(w)) for w in words])
        for n in sorted(set(size.tolist())):
            own = np.flatnonzero(size == n)
            # dot product at which a passage reaches COSINE of what the item reaches with itself
            bar = COSINE * (place[own] ** 2).sum(1) / np.maximum(norm[own], 1e-30)
            # no passage reaches it whose shared terms are shorter, against the root of its weight, than this; a little less for rounding
            least = 0.999 * float((bar / np.maximum(np.sqrt((place[own] ** 2).sum(1)), 1e-30)).min())
            rare = np.unique(np.concatenate([self.rarest(words[i]) for i in own]))
            answers = np.unique(np.concatenate([runs(words[i][-ANSWER:]) for i in own]))
            self.lengths[n] = (own, place[own].T, bar, least, rare, answers)

    def rarest(self, w: np.ndarray) -> np.ndarray:
        """Words of an item of which a passage that covers VERBATIM of it has one at least."""
        spare = len(w) - int(np.ceil(VERBATIM * len(w) - 1e-9))
        return w[np.argsort(-self.idf2[slots(w)], kind="stable")[:spare + 1]]

    def project(self, t: np.ndarray) -> np.ndarray:
        t = t[self.inside[t]]
        return self.space[np.searchsorted(self.at, t)].sum(0) if len(t) else np.zeros(self.space.shape[1], np.float32)

    def project_many(self, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the passages t[a:b], each of which has a term inside the space."""
        size = b - a
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        known = self.inside[t[at]]
        own = np.repeat(np.arange(len(a)), size)[known]
        rows = self.space[np.searchsorted(self.at, t[at[known]])]
        return np.add.reduceat(rows, np.searchsorted(own, np.arange(len(a))), axis=0)

    def shared_length(self, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared lengths of the passages t[a:b] in the terms inside the space, repeats counted."""
        size = b - a
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        known = self.inside[t[at]]
        pair, n = np.unique(np.repeat(np.arange(len(a)), size)[known] * SLOTS + t[at[known]], return_counts=True)
        return np.bincount(pair // SLOTS, self.idf2[pair % SLOTS] * n.astype(np.float64) ** 2, len(a))

    def search(self, h: np.ndarray, first: np.ndarray):
        """(row, item, share of the item in common, whether the answer is there) for every leak."""
        t = slots(h)
        w = self.idf2[t]
        total = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
        shared = np.concatenate([[0.0], np.cumsum(np.where(self.inside[t], w, 0), dtype=np.float64)])
        size = np.diff(first)
        four = runs(h)
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for n, (own, place, bar, least, rare, answers) in self.lengths.items():
            step = max(1, n // 4)
            count = np.maximum(1, -(-(size - n) // step) + 1)
            row = np.repeat(np.arange(len(size)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = first[row] + k * step
            b = np.minimum(a + n, first[row + 1])
            weight = total[b] - total[a]
            lo, hi = np.maximum(first[row], a - step), np.minimum(first[row + 1], b + step)
            rares = np.concatenate([[0], np.cumsum(np.isin(h, rare))])
            ends = np.concatenate([[0], np.cumsum(np.isin(four, answers))])
            leaky = (rares[hi] > rares[lo]) | (ends[np.clip(hi - ANSWER + 1, 0, len(four))] > ends[np.minimum(lo, len(four))])
            open_ = np.flatnonzero(leaky & (shared[b] > shared[a]) & (weight > 0))
            for s in range(0, len(open_), 1024):
                part = open_[s:s + 1024]
                part = part[self.shared_length(t, a[part], b[part]) >= least ** 2 * weight[part]]
                if not len(part):
                    continue
                p = self.project_many(t, a[part], b[part])
                near = p @ place >= bar[None, :] * np.sqrt(weight[part])[:, None]
                for i, j in zip(*np.nonzero(near)):
                    x, item = part[i], int(own[j])
                    want = self.words[item]
                    text = h[lo[x]:hi[x]].tolist()
                    if sum(map(set(text).__contains__, want)) < PARAPHRASE * len(want):  # no subsequence can be longer
                        continue
                    share = common_subsequence(want, text) / len(want)
                    if share < PARAPHRASE:
                        continue
                    tail = want[-ANSWER:]
                    answer = any(text[q:q + len(tail)] == tail for q in range(len(text) - len(tail) + 1))
                    if share >= VERBATIM or answer:
                        key = (int(row[x]), item)
                        best[key] = max(best.get(key, (0.0, False)), (share, answer))
        return [(r, i, s, x) for (r, i), (s, x) in sorted(best.items())]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         rank: int = RANK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(key, item, share, answer): every document and item it leaks."""
    spark = docs.sparkSession
    kinds = [docs.schema[key].dataType, benchmark.schema[item].dataType]
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(item, kinds[1]), T.StructField("share", T.DoubleType()), T.StructField("answer", T.BooleanType())])
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    items = stored(items, "items")
    n = items.count()
    if not n:
        return spark.createDataFrame([], schema)
    df, count = document_frequency(rows)
    idf = np.log((count + 1) / (df + 1)) + 0.1
    found = None
    parts = -(-n // item_block)
    for b in range(parts):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == b)
        at, space = latent_space(block, idf, rank)
        got = block.toArrow().sort_by("id")
        h, first = terms(got.column("text").combine_chunks())
        words = [h[x:y] for x, y in zip(first, first[1:])]
        long = [i for i, w in enumerate(words) if len(w) >= LEAST]
        ids = got.column("id").to_pylist()
        index = Index([ids[i] for i in long], [words[i] for i in long], idf, at, space)
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for c in chunks(batch, "text"):
                    h, first = terms(c.column("text"))
                    hits = index.search(h, first) if len(h) else []
                    if hits:
                        r, i, s, x = zip(*hits)
                        yield pa.RecordBatch.from_arrays([c.column("key").take(pa.array(r)), pa.array([index.ids[k] for k in i], c_type), pa.array(s, pa.float64()), pa.array(x)],
                                                         [key, item, "share", "answer"])

        c_type = got.schema.field("id").type
        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    # a document or an item given twice is reported once
    return found.groupBy(key, item).agg(F.max("share").alias("share"), F.max("answer").alias("answer"))
