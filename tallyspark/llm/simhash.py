"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie.

Null and word-free texts have fingerprint 0, texts with fewer words than a shingle use their whole word sequence. Rows
without a doc_id get a fingerprint and take part in links, but have no component of their own id (the smallest known id
reached, else null). Repeated rows are returned as often as they come. An empty table gives an empty result. Only the key
and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .columnar import chunks
from .components import components

SHINGLE = 4
BUDGET = 4
SEED = 42
SUBTREE = 16_384  # fingerprints of one subtree that a task holds, on average
LEAF = 24  # node pairs with so few fingerprints on both sides are compared directly
FRONTIER = 1 << 17  # node pairs that are expanded at once
HALF = 32


def fingerprints_of(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """Majority bits over the XXH64 of the word shingles of each text."""
    from xxhash import xxh64_intdigest as h

    hashes: list[int] = []
    counts = []
    for t in texts:
        words = t.encode().lower().split() if t else []
        n = len(words)
        if n <= shingle:
            if n:
                hashes.append(h(b" ".join(words), SEED))
            counts.append(min(n, 1))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[:n - shingle] + 1).tolist()]
        hashes += [h(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())]
        counts.append(n - shingle + 1)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                fp = fingerprints_of(part.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fp.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("key", kind), T.StructField("fp", T.LongType())]))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest index reached) after linking i and j."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def trie_links(left: np.ndarray, right: np.ndarray | None, top: int, first: int, budget: int = BUDGET,
               leaf: int = LEAF, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between sorted distinct fingerprints at most ``budget`` bits apart.

    left and right are subtrees whose members share their ``top`` leading bits (right None: the self-join of left). A node
    of the binary trie is a range of the sorted array. Node pairs walk down together: each child pair adds a differing bit
    or none, and is dropped once the first half has spent more than ``first`` or the whole more than ``budget``, or when all
    members are already in one component. Returns index pairs into left + right, a forest with the same components.
    """
    whole = left if right is None else np.concatenate([left, right])
    n, cut = len(whole), len(left)
    label = np.arange(n)
    if not n:
        return label, label
    spent = 0 if right is None else int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(64 - top))) if top else 0
    b0 = (0, cut) if right is None else (cut, n)
    # a stack of blocks of node pairs: a range, b range, spent bits; depth is one number per block
    stack = [(top, np.array([[0, cut, *b0, spent]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > frontier:
            stack.append((depth, nodes[frontier:]))
            nodes = nodes[:frontier]
        size_a, size_b = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        done = (size_a * size_b <= leaf * leaf) | (depth >= 64)
        small = nodes[done]
        for s in range(0, len(small), 4096):
            part = small[s:s + 4096]
            w, h = part[:, 1] - part[:, 0], part[:, 3] - part[:, 2]
            total = w * h
            at = np.repeat(np.arange(len(part)), total)
            inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i = part[at, 0] + inner // h[at]
            j = part[at, 2] + inner % h[at]
            near = (i < j) & (np.bitwise_count(whole[i] ^ whole[j]) <= budget)
            if near.any():
                label = unite(label, i[near], j[near])
        nodes = nodes[~done]
        if not len(nodes):
            continue
        # drop node pairs whose members are one component already
        if depth % 4 == 0:
            change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            same = (change[nodes[:, 0]] == change[nodes[:, 1] - 1]) & (change[nodes[:, 2]] == change[nodes[:, 3] - 1]) & (
                label[nodes[:, 0]] == label[nodes[:, 2]])
            nodes = nodes[~same]
            if not len(nodes):
                continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        ones = np.concatenate([[0], np.cumsum((whole & bit) != 0)])

        def middle(lo, hi):
            return hi - (ones[hi] - ones[lo])

        a0, a1, c0, c1, used = nodes.T
        am, cm = middle(a0, a1), middle(c0, c1)
        limit = first if depth + 1 <= HALF else budget
        kids = [np.stack([a0, am, c0, cm, used], 1), np.stack([am, a1, cm, c1, used], 1)]
        far = used + 1 <= limit
        own = (a0 == c0) & (a1 == c1)
        kids.append(np.stack([a0, am, cm, c1, used + 1], 1)[far])
        kids.append(np.stack([am, a1, c0, cm, used + 1], 1)[far & ~own])
        # equal bits are put last, so they are walked first and near members unite early
        nodes = np.concatenate(kids[::-1])
        nodes = nodes[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])]
        if len(nodes):
            stack.append((depth + 1, nodes))
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(fps: DataFrame, fp: str = "fp", budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): links between distinct fingerprints with the components of all pairs at most ``budget`` bits apart.

    Two such fingerprints differ in at most budget // 2 bits of their high half, or in fewer than that share in the low
    half, so two tries are joined (the second on swapped halves), each pruned by the share within its first 32 levels. The
    top levels are walked as a join key: a fingerprint goes to the node pairs its prefix belongs to, and each node pair is
    finished within a task. The depth of the top grows with the number of fingerprints, so subtrees keep their size.
    """
    base = fps.select(F.col(fp).alias("fp")).distinct()
    n = base.count()
    top = min(24, max(4, int(np.ceil(np.log2(max(n, 1) / subtree)))))
    high = budget // 2
    both = None
    for by, first in ((0, high), (HALF, budget - high - 1)):
        masks = [sum(1 << k for k in c) for r in range(first + 1) for c in combinations(range(top), r)]
        f = base.select(_rotated(F.col("fp"), by).alias("f"))
        p = F.shiftrightunsigned("f", 64 - top)
        q = f.select("f", p.alias("p"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
        q = q.select(F.lit(by).alias("by"), F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("p"),
                     F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("q"), "f")
        both = q if both is None else both.unionAll(q)

    def run(key, table):
        by, p, q = (k.as_py() for k in key)
        f = np.sort(table.column("f").to_numpy().astype(np.int64).view(np.uint64))
        first = high if by == 0 else budget - high - 1
        if p == q:
            i, j = trie_links(f, None, top, first, budget)
        else:
            cut = np.searchsorted(f, np.uint64(q) << np.uint64(64 - top))
            i, j = trie_links(f[:cut], f[cut:], top, first, budget) if 0 < cut < len(f) else (f[:0].astype(int),) * 2
        if by:
            f = (f << np.uint64(64 - by)) | (f >> np.uint64(by))
        return pa.table({"a": f[i].view(np.int64), "b": f[j].view(np.int64)})

    return both.groupBy("by", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    budget: int = BUDGET) -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs; component_id is the smallest key reachable by links."""
    fps = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    # copies collapse to their fingerprint before anything is compared
    least = fps.groupBy("fp").agg(F.min("key").alias("least"))
    comp = stored(components(links(least, "fp", budget), "a", "b"), "classes")
    grouped = least.join(comp, least.fp == comp.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("class"), "least")
    smallest = grouped.groupBy("class").agg(F.min("least").alias("component_id"))
    of_fp = grouped.join(smallest, "class").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
