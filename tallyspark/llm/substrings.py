"""Exact repeated-substring removal with super-k-mers.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it has the same word
sequence as a window of a document with a smaller key; windows are judged on the input. Each window has a minimiser, the
smallest hash of its runs of ``minimiser`` words; consecutive windows that share it travel as one packed string to the
minimiser's bucket, where sorting the windows of all strings finds the smallest key of each sequence.

Minimisers that only one document has are settled before any text moves. Equal packed strings collapse to their smallest
key before they are shuffled. A minimiser with more than ``HOT`` occurrences is split: its windows travel one by one, each
to the bucket of its own hash, so one passage never fills one bucket with the text around its copies.

Word and window identity is a 128-bit hash. Rows with a null key keep all their words and count for no other row. A null,
empty or short text loses nothing. Rows that repeat a key are judged one by one and never against each other. An empty
table gives an empty result. Only the key and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .columnar import chunks, hash_base, mixed, sliding_min, span_hashes, text_bytes, window_hashes, word_bounds, word_hashes

WINDOW = 50
MINIMISER = 8
BLOCK = 2 << 20  # bytes of packed strings that leave a task at once
HOT = 4096  # occurrences of a minimiser beyond which its windows travel one by one


def _runs(words: np.ndarray, first: np.ndarray, window: int, size: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of all rows: row, first window (as a word number), number of windows, minimiser."""
    n = len(words) - window + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    if n <= 0:
        return none
    low = sliding_min(window_hashes(words, size), window - size + 1)
    row = np.searchsorted(first, np.arange(n), "right") - 1
    whole = np.arange(n) + window <= first[row + 1]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    if not len(at):
        return none
    ends = np.append(np.flatnonzero(new)[1:], n)
    ends = ends[np.searchsorted(np.flatnonzero(new), at)]
    # the last run of a row ends with its last whole window
    ends = np.minimum(ends, first[row[at] + 1] - window + 1)
    return row[at], at, ends - at, low[at].view(np.int64)


def _words(texts: pa.Array):
    buf, off = text_bytes(texts)
    starts, ends, first = word_bounds(buf, off)
    return buf, starts, ends, first


def minimisers(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """(m, key): the minimiser of every super-k-mer. docs: (key, text)."""
    def run(batches):
        for batch in batches:
            for c in chunks(batch, "text"):
                buf, s, e, first = _words(c.column("text"))
                row, _, _, low = _runs(word_hashes(buf, s, e), first, window, size)
                yield pa.RecordBatch.from_arrays([pa.array(low), c.column("key").take(pa.array(row))], ["m", "key"])

    return docs.select("key", "text").mapInArrow(run, T.StructType([T.StructField("m", T.LongType()), docs.schema["key"]]))


def packed(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """(bucket, id, words, key, rid, at, n): packed strings of the super-k-mers whose minimiser is in ``shared``.

    docs: (rid, key, text, shared: array of struct(m, hot)). ``id`` names the word sequence; ``at`` is its first word in
    the row and n its number of windows. Words are joined by one space.
    """
    def run(batches):
        for batch in batches:
            for c in chunks(batch, "text"):
                buf, s, e, first = _words(c.column("text"))
                one = word_hashes(buf, s, e)
                row, at, n, low = _runs(one, first, window, size)
                if not len(row):
                    continue
                lists = c.column("shared")
                inner = lists.flatten()
                of = np.repeat(np.arange(c.num_rows), np.asarray(pc.list_value_length(lists)))
                # row and minimiser as one hash; a false hit would only ship a string too many
                want = mixed(of.astype(np.uint64) + np.uint64(1)) ^ inner.field("m").to_numpy(zero_copy_only=False).view(np.uint64)
                have = mixed(row.astype(np.uint64) + np.uint64(1)) ^ low.view(np.uint64)
                order = np.argsort(want)
                pos = np.minimum(np.searchsorted(want[order], have), max(len(want) - 1, 0))
                hit = want[order][pos] == have if len(want) else np.zeros(len(row), bool)
                hot = np.zeros(len(row), bool)
                if len(want):
                    hot = inner.field("hot").to_numpy(zero_copy_only=False)[order][pos] & hit
                # a hot minimiser's windows become strings of one window each
                times = np.where(hot, n, 1)[hit]
                row, at, n, low, hot = (np.repeat(x[hit], times) for x in (row, at, n, low, hot))
                step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                at, n = np.where(hot, at + step, at), np.where(hot, 1, n)
                if not len(at):
                    continue
                last = at + n + window - 1
                two = word_hashes(buf, s, e, 1)
                ids = [_span_ids(w, at, last, k) for k, w in enumerate((one, two))]
                bucket = np.where(hot, ids[0].view(np.int64), low)
                raw = buf.tobytes()
                x, y = s[at], e[last - 1]
                name = np.stack(ids, 1).astype(">u8")
                # windows that travel one by one are some fifty times their text, so they leave in blocks of bounded size
                for i, j in _blocks(y - x):
                    text = [b" ".join(raw[a:b].split()) for a, b in zip(x[i:j].tolist(), y[i:j].tolist())]
                    head = name[i:j].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[i:j]), pa.array([head[k:k + 16] for k in range(0, len(head), 16)], pa.binary()), pa.array(text, pa.binary()),
                         *[c.column(k).take(pa.array(row[i:j])) for k in ("key", "rid")], pa.array(at[i:j] - first[row[i:j]]), pa.array(n[i:j])],
                        ["bucket", "id", "words", "key", "rid", "at", "n"])

    kinds = [T.StructField("bucket", T.LongType()), T.StructField("id", T.BinaryType()), T.StructField("words", T.BinaryType()),
             docs.schema["key"], docs.schema["rid"], T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]
    return docs.mapInArrow(run, T.StructType(kinds))


def _blocks(sizes: np.ndarray, limit: int = BLOCK) -> list[tuple[int, int]]:
    """Cuts of a row of strings into runs of about ``limit`` bytes; a longer string is a run of its own."""
    at = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    cuts = [0, *at.tolist(), len(sizes)]
    return list(zip(cuts[:-1], cuts[1:]))


def _span_ids(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return span_hashes(words, starts, ends, hash_base(seed + 300)[1])


def smallest_keys(strings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, low): for each packed string, the smallest key at every one of its windows.

    strings: (bucket, id, words, low), each id once. A task sorts the windows of its buckets, block by block of buckets.
    """
    def run(batches):
        for bucket in _buckets(batches):
            words = bucket.column("words").combine_chunks()
            buf, s, e, first = _words(words.cast(pa.string()))
            n = len(s) - window + 1
            row = np.searchsorted(first, np.arange(max(n, 0)), "right") - 1
            at = np.flatnonzero(np.arange(max(n, 0)) + window <= first[row + 1])
            row = row[at]
            key = [window_hashes(word_hashes(buf, s, e, k), window, k)[at] for k in (0, 1)]
            low = bucket.column("low").to_numpy()[row]
            order = np.lexsort((key[1], key[0]))
            a, b = key[0][order], key[1][order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(low[order], np.flatnonzero(new)) if len(order) else low
            out = np.empty(len(order), np.int64)
            out[order] = least[group]
            counts = np.bincount(row, minlength=bucket.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([bucket.column("id").combine_chunks(), lists], ["id", "low"])

    return strings.mapInArrow(run, "id binary, low array<long>")


def _buckets(batches, block_bytes: int = 8 << 20):
    """Tables that hold whole buckets, several small ones together; rows come sorted by bucket."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if size >= block_bytes:
            b = t.column("bucket").to_numpy()
            last = held[-1].column("bucket")[-1].as_py()
            cut = int(np.searchsorted(b, last, "right"))
            if cut < len(b):
                yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
                held, size, t = [], 0, t.slice(cut)
        held.append(t)
        size += t.nbytes
    if held:
        yield pa.concat_tables(held).combine_chunks()


def repeated_windows(docs: DataFrame, key: str, text: str, window: int = WINDOW, size: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """(rid, key, starts): for each row, the first words of the windows that a smaller key also has.

    rid tells rows of one key apart (a hash of the text); rows without such windows are left out.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL")
    found = minimisers(rows, window, size).groupBy("m").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    shared = stored(found.select("m", (F.col("n") > hot).alias("hot")), "shared")
    mine = minimisers(rows, window, size).distinct().join(shared, "m")
    lists = mine.groupBy("key").agg(F.collect_list(F.struct("m", "hot")).alias("shared"))
    strings = packed(rows.select(F.xxhash64("text").alias("rid"), "key", "text").join(lists, "key"), window, size)
    strings = stored(strings, "packed")
    once = strings.groupBy("id").agg(F.first("bucket").alias("bucket"), F.first("words").alias("words"), F.min("key").alias("low"))
    lows = smallest_keys(once.repartition("bucket").sortWithinPartitions("bucket"), window)
    lows = lows.where(F.size("low") > 0)
    hits = strings.select("id", "rid", "key", "at").join(lows, "id").where(F.array_min("low") < F.col("key"))
    starts = hits.select("rid", "key", F.expr("filter(transform(low, (x, i) -> IF(x < key, at + i, NULL)), x -> x IS NOT NULL)").alias("s"))
    return starts.groupBy("rid", "key").agg(F.flatten(F.collect_list("s")).alias("starts"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, size: int = MINIMISER,
                hot: int = HOT) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row; kept is its remaining words joined by one space."""
    return _applied(docs, key, text, window, size, hot, digest=False)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, size: int = MINIMISER,
            hot: int = HOT) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row."""
    return _applied(docs, key, text, window, size, hot, digest=True)


def _applied(docs, key, text, window, size, hot, digest) -> DataFrame:
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    found = stored(repeated_windows(docs, key, text, window, size, hot), "repeated")
    rows = base.join(found.withColumnRenamed("key", "found_key"), (F.col("k").cast("long") == F.col("found_key")) & (F.xxhash64("text") == F.col("rid")), "left")
    name = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for t, starts in zip(batch.column("text"), batch.column("starts")):
                t = (t.as_py() or "").encode()
                words = t.split()
                n_words.append(len(words))
                if starts.is_valid:
                    s = starts.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    keep = (np.cumsum(edge)[:-1] == 0).tolist()
                    words = [w for w, k in zip(words, keep) if k]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                                             [key, "n_words", "n_removed", name])

    return rows.select("k", "text", "starts").mapInArrow(run, T.StructType([
        T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(name, T.StringType())]))
