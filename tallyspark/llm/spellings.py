"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other, and the form each follows.

Dense prefix-suffix tiling. Words lie in padded code-point matrices, forwards and backwards; blocks of rows are compared with
blocks of rows, and two words are one edit apart where their common prefix plus their common suffix reaches the longer length
minus one. Which blocks meet is settled by a halving that loses nothing: in the class of words of m code points and words one
longer, a pair that agrees in a prefix of p and a suffix of q code points agrees in p plus half of what is free, or in q plus the
rest of it. So a word goes to the groups of both halves; a group of more than ``GROUP`` words, however common its prefix is, is
halved again, down to one free code point, where the alphabet bounds it. A pair is counted in one group only: a right half takes
the pairs whose common prefix is too short for the left one.

Tasks return one row a word and block, its number of near words and the best of them, no pairs.

A null text has no words, a null key is written as an empty string before the colon, repeated rows count as often as they occur,
an empty table gives an empty result. Texts are read whole; a run of any length is a word. Only the key and text columns are
read. Of several near words with the same count the smallest in code-point order is the form.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
EDITED = 31  # one run in so many loses a code point
FACTOR = 10  # a form occurs so many times as often
GROUP = 1024  # words of a group that is not halved
TILE = 128
ROWS = 16_384  # rows that are laid out together
CELLS = 1 << 22  # code points of a block of rows


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    other = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(word.rlike("[À-Þ]"), other).otherwise(F.lower(word))


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, count: int = MIN_COUNT, edited: int = EDITED) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all documents; a run whose checksum with the key is divisible by ``edited``
    loses the code point that the checksum points at."""
    # a shorter run cannot become a word
    runs = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), runs.alias("run"))
    rows = rows.select("key", lowered(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % edited == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _group_key(p: Column, q: Column) -> Column:
    """The group of a word in class m: what is fixed of it."""
    head = F.substring(F.col("word"), F.lit(1), p)
    tail = F.substring(F.col("word"), F.length("word") - q + 1, q)
    return F.xxhash64("m", p, q, head, tail)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, p, q, bound) in both halves of its group."""
    free = F.col("m") - F.col("p") - F.col("q")
    step = F.floor(free / 2).cast("int")
    none = F.lit(0)
    left = F.struct((F.col("p") + step).alias("p"), F.col("q").alias("q"), F.col("bound").alias("bound"))
    right = F.struct(F.col("p").alias("p"), (F.col("q") + free - step).alias("q"), (F.col("p") + step).alias("bound"))
    # with one free code point the left half is the group itself, and the right one would take nothing
    both = rows.select("word", "n", "m", F.explode(F.when(step > none, F.array(left, right)).otherwise(F.array(left))).alias("g")).select("word", "n", "m", "g.*")
    return both.withColumn("key", _group_key(F.col("p"), F.col("q")))


def _starts(words: DataFrame) -> DataFrame:
    """Every word in its class as shorter and as longer word."""
    n = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("m"))
    return rows.where("m > 0").select("word", "n", "m", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2**31 - 1).alias("bound"))


def _groups(words: DataFrame, group: int) -> DataFrame:
    """(key, m, p, q, bound, word, n): groups of at most ``group`` words, or with one free code point."""
    rows = _halved(_starts(words))
    out = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.length("word") == F.col("m"), 1).otherwise(0)).alias("short"),
                                        F.max(F.col("m") - F.col("p") - F.col("q")).alias("free"))
        # a group of longer words only holds no pair of its class
        crowded = stored(sizes.where((F.col("size") > group) & ((F.col("short") == 0) | (F.col("free") > 1))).select("key", (F.col("short") > 0).alias("open")), "crowded")
        large = stored(rows.join(crowded.where("open"), "key", "left_semi"), "halved")
        small = rows.join(crowded, "key", "left_anti")
        out = small if out is None else out.unionAll(small)
        if large.isEmpty():
            return out
        rows = _halved(large.drop("key"))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, padded behind, forwards and backwards, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if not len(flat) or flat.max() < 256:
        flat = flat.astype(np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    ahead = np.zeros((int(size.max(initial=0)), len(words)), flat.dtype)  # a code point's place first: a tile reads it in one piece
    back = ahead.copy()
    ahead[at, row] = flat
    back[np.repeat(size, size) - 1 - at, row] = flat
    return ahead, back, size


def _agreement(x: np.ndarray, a: slice, b: slice, depth: int) -> np.ndarray:
    """The number of leading places in which rows a and rows b agree."""
    alive = np.ones((a.stop - a.start, b.stop - b.start), bool)
    out = np.zeros(alive.shape, np.int32)
    for c in range(depth):
        alive &= x[c, a][:, None] == x[c, b][None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_in_groups(words: list[str], m: np.ndarray, p: np.ndarray, q: np.ndarray, bound: np.ndarray, group: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near words, each pair once. Rows of a group lie together."""
    ahead, back, size = _matrix(words)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], len(words)]
    blocks: list[tuple[slice, slice]] = []
    start = 0
    for s, e in zip(first.tolist(), last.tolist()):
        if e - s > tile:
            if start < s:
                blocks.append((slice(start, s), slice(start, s)))
            cuts = [slice(x, min(x + tile, e)) for x in range(s, e, tile)]
            blocks += [(a, b) for i, a in enumerate(cuts) for b in cuts[i:]]
            start = e
        elif e - start > tile:
            blocks.append((slice(start, s), slice(start, s)))
            start = s
    if start < len(words):
        blocks.append((slice(start, len(words)), slice(start, len(words))))
    found = []
    for a, b in blocks:
        if not ((size[a] == m[a]).any() or (size[b] == m[b]).any()):
            continue
        depth = int(min(size[a].max(), size[b].max()))
        both = (group[a][:, None] == group[b][None, :]) & ((size[a] == m[a])[:, None] | (size[b] == m[b])[None, :])
        if a == b:
            both &= np.tri(a.stop - a.start, k=-1, dtype=bool).T
        if not both.any():
            continue
        prefix = _agreement(ahead, a, b, depth)
        both &= (prefix >= p[a][:, None]) & (prefix < bound[a][:, None])
        longer = np.maximum(size[a][:, None], size[b][None, :])
        suffix = _agreement(back, a, b, depth)
        both &= (suffix >= q[a][:, None]) & (prefix + suffix >= longer - 1) & (prefix < longer)
        i, j = np.nonzero(both)
        if len(i):
            found.append((i + a.start, j + b.start))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _row_blocks(batches, rows: int, cells: int):
    """Batches cut between groups, of about ``rows`` rows and ``cells`` code points, without rows that are alone in their group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(table: pa.Table, all_: bool):
        key = table.column("key").to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.r_[0, change]
        end = np.r_[change, len(key)]
        done = len(first) if all_ else len(first) - 1
        size = (end - first)[:done]
        pick = np.repeat(size > 1, size)
        keep = table.slice(0, int(end[done - 1]) if done else 0).filter(pa.array(pick))
        return keep, table.slice(int(end[done - 1]) if done else 0)

    def parts(table: pa.Table):
        key = table.column("key").to_numpy()
        width = np.asarray(table.column("width"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        start, widest = 0, 0
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            w = int(width[s:e].max())
            if s > start and max(w, widest) * (e - start) > cells:
                yield table.slice(start, s - start)
                start, widest = s, 0
            widest = max(widest, w)
        if start < len(key):
            yield table.slice(start)

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            done, rest = cut(pa.Table.from_batches(held), False)
            yield from parts(done)
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield from parts(cut(pa.Table.from_batches(held), True)[0])


def neighbours(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best): how many words are near each word that has any, and the most frequent of them."""
    rows = _groups(words, group).select("key", "m", "p", "q", "bound", "word", "n", F.length("word").alias("width"))
    rows = rows.repartition("key").sortWithinPartitions("key", "m", "p", "q", "width")
    names = ["word", "n_near", "best_n", "best"]

    def run(batches):
        for t in _row_blocks(batches, ROWS, CELLS):
            texts = t.column("word").to_pylist()
            m, p, q, bound, key, n = (t.column(c).to_numpy() for c in ("m", "p", "q", "bound", "key", "n"))
            group_of = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            i, j = near_in_groups(texts, m, p, q, bound, group_of)
            if not len(i):
                continue
            own, other = np.r_[i, j], np.r_[j, i]
            place = np.argsort(np.array(texts, object))  # code-point order
            rank = np.empty(len(texts), np.int64)
            rank[place] = np.arange(len(texts))
            order = np.lexsort((rank[other], -n[other], own))
            own, other = own[order], other[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            near = np.diff(np.r_[at, len(own)])
            yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in own[at]], pa.string()), pa.array(near), pa.array(n[other[at]]),
                                              pa.array([texts[k] for k in other[at]], pa.string())], names)

    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def variants(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct (word, n)."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = words.join(neighbours(words, group), "word", "left")
    formed = F.col("best_n") >= F.lit(factor) * F.col("n")
    near = stored(near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(formed, F.col("best_n")).alias("form_n")), "near")
    # every form is ``factor`` times as frequent as what follows it, so chains are as long as a logarithm; each round doubles the step
    roots = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return near.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(counted_words(docs, key, text))
