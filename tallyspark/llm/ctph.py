"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes of the UTF-8 text ends a piece wherever its low bits are zero, so that boundaries depend
on their surroundings only and come back after an edit. Each piece gives one code of 12 bits, a hash of all its bytes, written
as two letters. A fingerprint is ``level:codes:codes``: the codes of pieces of 2^level bytes on average, and those of twice
that size. The level is the least, 2 or more, that gives 64 pieces or fewer on average; it falls while a text, one that repeats
itself for instance, gives fewer than 16. From the 128th piece on the rest of a text is one piece.

Fingerprints are compared where their piece sizes are compatible (equal, or one twice the other) by the edit distance of their
codes (1 for a code inserted or deleted, 2 for one replaced) over the number of codes: likeness = 1 - distance / (codes of
both). Of two comparable sizes the likelier counts, without any it is 0. Equal fingerprints have likeness 1.

A null text counts as empty; the empty text has no pieces. Null keys are documents like any other and come last in descending
order; rows that repeat a key follow each other by a hash of their text, equal rows in any order. A text beyond ``BLOCK`` bytes
is read piece by piece, so memory does not grow with its arrays. An empty table gives an empty result. Only the key and text
columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .columnar import chunks, hash_base, mixed, span_hashes

WINDOW = 7
PIECES = 64
FEWEST = 16
MOST = 128
LEAST_LEVEL = 2
BLOCK = 1 << 20  # bytes of text that are hashed together
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TWO = np.array([a + b for a in LETTERS for b in LETTERS], object)
_SEED = 1000
_STEP = np.uint32(0x9E3779B1)
_SQUARE = np.uint32(0x9E3779B1**2 % (1 << 32))


def rolled(buf: np.ndarray) -> np.ndarray:
    """Hash of the 7 bytes that end at each position; the first six are of no use."""
    table, _ = hash_base(_SEED)
    w = (table >> np.uint64(32)).astype(np.uint32)[buf]
    two = w.copy()
    two[1:] += w[:-1] * _STEP
    four = two.copy()
    four[2:] += two[:-2] * _SQUARE
    six = two.copy()
    six[2:] += four[:-2] * _SQUARE
    w[1:] += six[:-1] * _STEP
    w ^= w >> np.uint32(15)
    w *= np.uint32(0x85EBCA6B)
    w ^= w >> np.uint32(13)
    return w


def level_of(size: int) -> int:
    """The least level, from 2 on, that gives 64 pieces or fewer on average."""
    return max(LEAST_LEVEL, (max(size - 1, 0) // PIECES).bit_length())


def _capped(ends: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Piece ends without those between a text's 127th and its last."""
    row = np.searchsorted(off, ends, "left")
    number = np.arange(len(ends)) - np.searchsorted(row, row, "left")
    return ends[(number < MOST - 1) | (ends == off[row])]


def _joined(codes: np.ndarray, ends: np.ndarray, off: np.ndarray) -> list[str]:
    letters = _TWO[codes].tolist()
    at = np.searchsorted(ends, off, "right").tolist()
    return ["".join(letters[a:b]) for a, b in zip(at, at[1:])]


def _block(texts: list[bytes], levels: np.ndarray) -> list[str]:
    """Fingerprints of texts that are hashed together, at given levels."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    low = rolled(buf) & np.repeat((np.uint32(2) << levels.astype(np.uint32)) - np.uint32(1), size)
    half = np.repeat(np.uint32(1) << levels.astype(np.uint32), size)
    fine = np.flatnonzero((low == 0) | (low == half))
    row = np.searchsorted(off, fine, "right") - 1
    fine = fine[fine - off[row] >= WINDOW - 1]
    finish = off[1:][size > 0]
    both = [_capped(np.union1d(cut + 1, finish), off) for cut in (fine, fine[low[fine] == 0])]
    ends = np.concatenate(both)
    starts = np.concatenate([np.concatenate([[0], e[:-1]]) for e in both]).astype(np.int64)[:len(ends)] if len(ends) else ends
    table, base = hash_base(_SEED)
    codes = (span_hashes(table[buf], starts, ends, base) & np.uint64(4095)).astype(np.int64) if len(ends) else ends
    n = len(both[0])
    out = [_joined(codes[:n], both[0], off), _joined(codes[n:], both[1], off)]
    few = np.flatnonzero((np.fromiter(map(len, out[0]), np.int64, len(texts)) < 2 * FEWEST) & (levels > LEAST_LEVEL))
    found = [f"{k}:{a}:{b}" for k, a, b in zip(levels.tolist(), *out)]
    if len(few):
        for i, again in zip(few.tolist(), _block([texts[i] for i in few], levels[few] - 1)):
            found[i] = again
    return found


def _long(data: bytes, level: int, block: int) -> str:
    """The fingerprint of one text that is longer than a block, read a block at a time."""
    table, base = hash_base(_SEED)

    def piece(start: int, end: int) -> str:
        total, factor = 0, 1
        for s in range(start, end, block):
            part = np.frombuffer(data, np.uint8)[s:min(s + block, end)]
            power = np.full(len(part), base, np.uint64)
            power[0] = 1
            total += factor * int((table[part] * np.cumprod(power, dtype=np.uint64)).sum(dtype=np.uint64))
            factor = factor * pow(base, len(part), 1 << 64) % (1 << 64)
        return _TWO[int(mixed(np.array([total % (1 << 64)], np.uint64))[0] & np.uint64(4095))]

    signatures = []
    for k in (level, level + 1):
        cuts: list[int] = []
        for s in range(0, len(data), block):
            a = max(0, s - WINDOW + 1)
            w = rolled(np.frombuffer(data, np.uint8)[a:s + block])
            hit = np.flatnonzero((w & np.uint32((1 << k) - 1)) == 0) + a
            cuts += (hit[hit >= max(s, WINDOW - 1)] + 1).tolist()[:MOST - 1 - len(cuts)]
            if len(cuts) >= MOST - 1:
                break
        ends = cuts + [len(data)] * (not cuts or cuts[-1] < len(data))
        signatures.append([piece(a, b) for a, b in zip([0, *ends], ends)])
    if len(signatures[0]) < FEWEST and level > LEAST_LEVEL:
        return _long(data, level - 1, block)
    return f"{level}:{''.join(signatures[0])}:{''.join(signatures[1])}"


def fingerprint(texts: list[bytes], block: int = BLOCK) -> list[str]:
    """Fingerprints of UTF-8 texts."""
    out: list[str] = [""] * len(texts)
    held: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if held:
            levels = np.array([level_of(len(texts[i])) for i in held], np.int64)
            for i, f in zip(held, _block([texts[i] for i in held], levels)):
                out[i] = f
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        if len(t) > block:
            out[i] = _long(t, level_of(len(t)), block)
            continue
        if size + len(t) > block:
            flush()
        held.append(i)
        size += len(t)
    flush()
    return out


def _common(x: str, y: str) -> float:
    """1 - edit distance / codes, from the longest common subsequence of two code strings, by bits."""
    n, total = len(x) // 2, (len(x) + len(y)) // 2
    if not total:
        return 0.0
    places: dict[str, int] = {}
    for i in range(n):
        c = x[2 * i:2 * i + 2]
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << n) - 1
    open_ = every
    for i in range(0, len(y), 2):
        m = places.get(y[i:i + 2])
        if m:
            u = open_ & m
            open_ = ((open_ + u) | (open_ - u)) & every
    return 2 * (n - open_.bit_count()) / total


def likeness(a: str | None, b: str | None) -> float | None:
    """How alike two fingerprints are, 0 to 1; null if one is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = (x.split(":") for x in (a, b))
    step = int(ka) - int(kb)
    if step == 0:
        return max(_common(a1, b1), _common(a2, b2))
    return _common(a2, b1) if step == -1 else _common(a1, b2) if step == 1 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every document."""
    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", BLOCK):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fingerprint(texts), pa.string())], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, kind).withColumnRenamed("key", key)


def likeness_column(a: str, b: str):
    """A column function over two fingerprint columns, for joins of candidate pairs."""
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return compare(F.col(a), F.col(b))


_FIELDS = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()))
_SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digests(texts: list[str], own: list[str], following: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    other = fingerprint(changed)
    columns = ([len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], own, other,
               [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, next_prints)])
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)]


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every document against its edited
    text, and against the next document in descending order of the key (after the last: the first).

    Documents are sorted over all tasks; a task reads its range once and holds one document beside its chunk. The last document of
    a range has its next one in another task: those seams, two rows a task, are joined afterwards.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("key").desc_nulls_last(), F.col("tie"), F.col("row")]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part"))
    names = [n for n, _ in _FIELDS]

    def run(batches):
        keys = texts = prints = None  # the row that waits for its next one
        part = None
        for batch in batches:
            for piece in chunks(batch, "text", BLOCK):
                new_keys, new_texts = piece.column("key"), piece.column("text").to_pylist()
                new_prints = fingerprint([t.encode() for t in new_texts])
                if keys is None:
                    part = piece.column("part")[0].as_py()
                    yield _seam(new_keys[:1], new_texts[:1], part, "first")
                else:
                    new_keys = pa.concat_arrays([keys, new_keys])
                    new_texts, new_prints = texts + new_texts, prints + new_prints
                n = len(new_texts) - 1
                if n:
                    done = _digests(new_texts[:-1], new_prints[:-1], new_texts[1:], new_prints[1:])
                    yield pa.RecordBatch.from_arrays([new_keys[:n], pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *done],
                                                     ["key", "part", "seam", "text", *names])
                keys, texts, prints = new_keys[n:], new_texts[n:], new_prints[n:]
        if keys is not None:
            yield _seam(keys, texts, part, "last")

    def _seam(key, text, part, which):
        return pa.RecordBatch.from_arrays([key, pa.array([part], pa.int32()), pa.array([which]), pa.array(text, pa.string()), *[pa.nulls(1, k) for _, k in _FIELDS]],
                                          ["key", "part", "seam", "text", *names])

    found = stored(rows.mapInArrow(run, f"key {kind}, part int, seam string, text string, {_SQL}"), "fingerprints")
    seams = found.where("seam IS NOT NULL")
    parts = sorted(r.part for r in seams.where("seam = 'first'").select("part").collect())  # one number a task
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    last = seams.where("seam = 'last'").select("key", "text", "part").join(F.broadcast(after), "part")
    both = last.join(seams.where("seam = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text")), "following")

    def close(batches):
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            own, others = (fingerprint([t.encode() for t in ts]) for ts in (texts, following))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *_digests(texts, own, following, others)], ["key", *names])

    closed = both.select("key", "text", "next_text").mapInArrow(close, f"key {kind}, {_SQL}")
    return found.where("seam IS NULL").select("key", *names).unionAll(closed).withColumnRenamed("key", key)
