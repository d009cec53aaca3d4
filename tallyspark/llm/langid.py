"""Language identification by error-correcting output codes.

Every language gets a codeword; one logistic n-gram classifier per bit predicts it from the whole text. Decoding is
loss-weighted: the distance of a codeword sums the logistic loss of its bits, each weighted by how well that bit
recognises the language in training. The nearest codeword wins; a flag tells when the runner-up is close.

A text that is null or has no letter is ``und`` with score 0. Rows with a null key are predicted and never learned from;
null languages are not learned. Very long texts count whole, as the shares of their n-grams. With one learned language every text with letters gets it, with none every text is ``und``.
Ties between codewords go to the language first in alphabetical order. Repeated rows are returned as they come; an empty
table gives an empty result. Only the named columns are read. Training is fitted on at most about ``per_language`` rows of
each language and ``training_rows`` in all, chosen by a hash of the key; features, weights and predictions use whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import chunks, text_bytes

DIMS = 4096
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 500
TRAINING_ROWS = 16_384  # of all languages, at 16 KB each: what the driver gets
MAX_LANGUAGES = 500
ROWS = 256  # whose features are held at once
PASSES = 150
RIDGE = 1e-5
AMBIGUOUS = 0.6
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (97 <= b < 123 or 65 <= b < 91)]] = 32


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, one unit-length row for each text."""
    raw, off = text_bytes(column)
    buf = _FOLD[raw].astype(np.uint32)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    counts = np.zeros(rows * DIMS)
    gram = np.zeros(len(buf), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(buf) < n:
            break
        gram = gram[:len(buf) - n + 1] | (buf[n - 1:] << np.uint32(8 * (n - 1)))
        if n in GRAMS:
            slot = ((gram * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(20)
            inside = row[:len(gram)] == row[n - 1:]
            counts += np.bincount(row[:len(gram)][inside] * DIMS + slot[inside], minlength=rows * DIMS)
    x = counts.reshape(rows, DIMS)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: all distinct splits for up to seven languages, else random ones without repeats."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    want = int(np.ceil(15 * np.log2(n)))
    out: list[tuple] = []
    while len(out) < want:
        c = rng.integers(0, 2, n) * 2 - 1
        c = tuple((c * c[0]).tolist())
        if c not in out and abs(sum(c)) <= n // 2:
            out.append(c)
    return np.array(out, np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # languages x bits
    slope: np.ndarray  # DIMS x bits
    offset: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and the share of the runner-up."""
        f = x @ self.slope + self.offset
        loss = np.zeros((len(x), len(self.languages)))
        for k in range(len(self.languages)):
            loss[:, k] = (np.logaddexp(0, -f * self.code[k]) * self.weight[k]).sum(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        rest = p.copy()
        rest[np.arange(len(p)), best] = 0
        return best, top, rest.max(1) if p.shape[1] else top


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """One ridge-penalised logistic classifier per bit, all bits advanced together by accelerated gradient steps."""
    names = sorted(set(lang))
    code = codewords(len(names))
    y = np.array([names.index(v) for v in lang])
    n, bits = len(y), code.shape[1]
    slope, offset = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)
    if bits:
        target = code[y].astype(np.float32)
        share = np.bincount(y, minlength=len(names))
        own = (n / (len(names) * share[y])).astype(np.float32)[:, None]  # every language weighs the same
        step = np.float32(4 / own.max())
        s0, o0 = slope, offset
        for t in range(PASSES):
            ahead = np.float32(t / (t + 3))
            s1, o1 = slope + ahead * (slope - s0), offset + ahead * (offset - o0)
            g = -target * own / (1 + np.exp(target * (x @ s1 + o1))) / n
            s0, o0 = slope, offset
            slope = s1 - step * (x.T @ g + RIDGE * s1)
            offset = o1 - step * g.sum(0)
        right = (x @ slope + offset) * target > 0
        weight = np.array([right[y == k].mean(0) for k in range(len(names))]) + 1e-6
        weight *= bits / weight.sum(1, keepdims=True)
    else:
        weight = np.zeros((len(names), 0))
    return Model(names, code, weight, slope, offset)


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, training_rows: int = TRAINING_ROWS) -> Model | None:
    """Fit on rows where ``learn`` holds. The driver gets at most about per_language feature rows for each language, and
    training_rows in all."""
    letters = F.col(text).rlike(r"\p{L}")
    rows = docs.where(learn & F.col(lang).isNotNull()).select(
        F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), letters.alias("ok"))
    sizes = rows.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    part = F.lit(0.0)
    per_language = min(per_language, max(1, training_rows // len(sizes)))
    for r in sizes:
        part = F.when(F.col("l") == r["l"], F.lit(min(1.0, per_language / r["count"]))).otherwise(part)
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches):
        for batch in batches:
            for c in chunks(batch, "t", max_rows=ROWS):
                x = features(c.column("t"))
                yield pa.RecordBatch.from_arrays([c.column("k").cast(pa.string()), c.column("l"), pa.array([v.tobytes() for v in x], pa.binary())], ["k", "l", "x"])

    picked = rows.where(F.col("ok") & (unit < part)).select(F.col("k").cast("string").alias("k"), "l", "t")
    got = picked.mapInArrow(run, "k string, l string, x binary").toArrow().sort_by([("k", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    return fit(x, got.column("l").to_pylist())


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra…, lang_pred, score, ambiguous) of every row."""
    names = [key, *extra]
    kinds = [T.StructField(c, docs.schema[c].dataType) for c in names]

    def run(batches):
        for batch in batches:
            for c in chunks(batch, "__text", max_rows=ROWS):
                texts = c.column("__text")
                lang, score, near = [UNKNOWN] * c.num_rows, np.zeros(c.num_rows), np.zeros(c.num_rows, bool)
                known = np.array([next(filter(str.isalpha, t or ""), None) is not None for t in texts.to_pylist()], bool)
                if model is not None and known.any():
                    best, top, second = model.decode(features(texts.filter(pa.array(known))))
                    score[known], near[known] = top, top < AMBIGUOUS
                    for i, b in zip(np.flatnonzero(known).tolist(), best.tolist()):
                        lang[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], pa.array(lang), pa.array(score), pa.array(near)], [*names, "lang_pred", "score", "ambiguous"])

    return docs.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType([
        *kinds, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
