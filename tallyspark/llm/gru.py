"""Document log-likelihood by a gated recurrent language model trained in numpy.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end token. Counts of all training
tokens are taken over the whole corpus. The model reads the previous token and predicts the next one by a class-factored
softmax: first a class, then the word in it. Classes hold the most frequent words by their endings; all other words fall
into rare classes by a hash, within which a word has the probability (c + 1) / (sum of c + 1 in the class + 1), so unseen
words have one share of each class and the probabilities of all words sum to at most one.

Training is one pass over every training document: a short warm-up on a bounded sample of documents gives a common start,
then each task trains on its partition by truncated backpropagation (state carried from window to window, reset where a
document begins) and the parameters are averaged by tokens, in two levels. Scoring carries the state through a document's
windows from its first to its last token, so texts are scored whole.

A null or empty text is the end token alone. A null key counts as held out. Repeated rows are scored alike and count for
training as often as they come. With no training documents every word is unseen. An empty table gives an empty result. Only
the key and text columns are read. Counts of the ``HEAD`` most frequent words are broadcast; all others are joined.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .columnar import chunks

HEAD = 150_000  # words whose counts every task holds
CLASSES, SIZE = 32, 64  # word classes, and words in each
RARE = 32  # classes of all other words
UNITS = 16
STEPS = 32  # truncation of backpropagation
SLOTS = 256
BLOCK_TOKENS = 1 << 20  # tokens that a task packs into its slots at once
WARM_DOCS = 600  # documents of the warm-up sample, about
RATE = 0.01
END = ""
FLUSH = 300_000  # distinct words a task counts before it hands them on


def words_of(text) -> list[str]:
    """Words with ASCII capitals folded; other letters are left alone."""
    return text.encode().lower().split() if text else []


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of docs, the end token as the empty string. Tasks hand on partial counts."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for c in chunks(batch, "text"):
                for t in c.column("text").to_pylist():
                    seen.update(words_of(t))
                seen[b""] += c.num_rows
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Numbers of the head words: model word, class and log10(c + 1) of each, and the rare classes' totals."""

    def __init__(self, head: list[tuple[str, int]], rare_totals: dict[int, int], classes: int = CLASSES, size: int = SIZE, rare: int = RARE):
        head = sorted(head, key=lambda r: (-r[1], r[0]))
        self.classes, self.size, self.rare = classes, size, rare
        end = next((c for w, c in head if w == END), 0)
        model = [(END, end), *[r for r in head if r[0] != END][:classes * size - 1]]
        by_ending = sorted(model, key=lambda r: r[0][::-1])
        self.width = -(-len(by_ending) // classes)  # words in a class
        self.n_words = len(by_ending)
        place = {w: i for i, (w, _) in enumerate(by_ending)}
        rest = [r for r in head if r[0] not in place]
        self.number = {w.encode(): i for i, (w, _) in enumerate([*by_ending, *rest])}
        self.log_count = np.log10(np.array([c for _, c in [*by_ending, *rest]], float) + 1)
        self.known = np.array([c > 0 for _, c in [*by_ending, *rest]])
        # output symbol: a model word's place, or n_words + rare class
        self.symbol = np.array([*range(self.n_words), *[self.n_words + zlib.crc32(w.encode()) % rare for w, _ in rest]], np.int32)
        self.end = place[END]
        self.counts = np.array([c for _, c in by_ending], float)
        self.rare_totals = np.array([rare_totals.get(b, 0) for b in range(rare)], float)
        self.log_rare = np.log10(self.rare_totals + 1)

    def read(self, text) -> tuple[np.ndarray, float, float, int, Counter]:
        """Symbols of a text; sums of log10(c + 1) over its head words and over those outside the model; known head
        words; counts of the other words."""
        words = words_of(text)
        get = self.number.get
        n = np.full(len(words) + 1, self.end, np.int64)
        n[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        symbols = self.symbol[n]
        away = np.flatnonzero(n < 0)
        others: Counter = Counter()
        if len(away):
            spelt = [words[i] for i in away.tolist()]
            others.update(spelt)
            symbols[away] = self.n_words + np.array([zlib.crc32(w) % self.rare for w in spelt])
        n = n[n >= 0]
        logs = self.log_count[n]
        return symbols, float(logs.sum()), float(logs[n >= self.n_words].sum()), int(self.known[n].sum()), others


def _log_softmax(logit: np.ndarray, bias: np.ndarray, row: np.ndarray, col: np.ndarray, learn: bool):
    """Log-probability of one column per row; with ``learn`` also the gradient by the logits. Overwrites ``logit``."""
    logit += bias
    if float(logit.max(initial=0)) > 60:
        logit -= logit.max(1, keepdims=True)
    chosen = logit[row, col]
    np.exp(logit, out=logit)
    total = logit.sum(1)
    if learn:
        logit *= (1 / total)[:, None]
        logit[row, col] -= 1
    return chosen - np.log(total), logit


class Network:
    """One gated recurrent layer and the class-factored softmax; parameters in one flat vector."""

    def __init__(self, lex: Lexicon, flat: np.ndarray | None = None, units: int = UNITS):
        self.lex, self.units = lex, units
        v, c, w = lex.n_words + lex.rare, lex.classes + lex.rare, lex.width
        self.begin = v  # input that stands before the first token
        shapes = {"into": (v + 1, 3 * units), "back": (units, 3 * units), "shift": (units,), "to_class": (units, c), "class_bias": (c,),
                  "to_word": (lex.classes, units, w), "word_bias": (lex.classes, w)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        self.grad = np.zeros(size, np.float32)
        self.p, self.g, at = {}, {}, 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            self.p[k], self.g[k] = self.flat[at:at + n].reshape(s), self.grad[at:at + n].reshape(s)
            at += n
        self.m, self.s, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0
        if flat is None:
            r = np.random.default_rng(5)
            self.p["into"][:] = r.normal(0, 0.3, shapes["into"])
            self.p["back"][:] = r.normal(0, units ** -0.5, shapes["back"])
            self.p["to_class"][:] = r.normal(0, 0.05, shapes["to_class"])
            self.p["to_word"][:] = r.normal(0, 0.05, shapes["to_word"])
            # the start is the unigram model
            word = np.full(lex.classes * w, -30.0)
            word[:lex.n_words] = np.log(lex.counts + 1)
            word = word.reshape(lex.classes, w)
            top = np.log(np.exp(word - word.max()).sum(1)) + word.max()
            self.p["word_bias"][:] = word - top[:, None]
            self.p["class_bias"][:] = np.concatenate([top, np.log(lex.rare_totals + 1)])
            self.p["class_bias"][:] -= self.p["class_bias"].max()

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, learn: bool):
        """One window of [steps, slots] inputs and targets (-1: none); fresh marks document starts.

        Returns the natural log-probability of each target and the last state; with ``learn``, fills the gradient.
        """
        p, u = self.p, self.units
        steps, slots = x.shape
        into = p["into"][x]
        keep = (~fresh).astype(np.float32)[:, :, None]
        starts = fresh.any(1)
        hs = np.empty((steps, slots, u), np.float32)
        saved = []
        for t in range(steps):
            if starts[t]:
                h = h * keep[t]
            b = h @ p["back"]
            zr = into[t, :, :2 * u] + b[:, :2 * u]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :u], zr[:, u:]
            bn = b[:, 2 * u:]
            bn += p["shift"]
            n = r * bn
            n += into[t, :, 2 * u:]
            np.tanh(n, out=n)
            if learn:
                saved.append((h, zr, bn, n))
            h = h - n
            h *= z
            h += n
            hs[t] = h
        flat, target = hs.reshape(-1, u), y.ravel()
        logp, dh = self._output(flat, target, learn)
        if learn:
            dh = dh.reshape(steps, slots, u)
            d_into = np.empty((steps, slots, 3 * u), np.float32)
            dback, dshift = self.g["back"], self.g["shift"]
            carry = np.zeros((slots, u), np.float32)
            db, ones, turned = np.empty((slots, 3 * u), np.float32), np.ones(slots, np.float32), np.ascontiguousarray(p["back"].T)
            for t in range(steps - 1, -1, -1):
                prev, zr, bn, n = saved[t]
                z, r = zr[:, :u], zr[:, u:]
                d = dh[t]
                d += carry
                own = d_into[t]
                dn = own[:, 2 * u:]
                np.multiply(d, z - 1, out=dn)
                dn *= n * n - 1
                np.multiply(d, prev - n, out=own[:, :u])
                np.multiply(dn, bn, out=own[:, u:2 * u])
                own[:, :2 * u] *= zr * (1 - zr)
                db[:, :2 * u] = own[:, :2 * u]
                np.multiply(dn, r, out=db[:, 2 * u:])
                dback += prev.T @ db
                dshift += ones @ db[:, 2 * u:]
                carry = db @ turned
                d *= z
                carry += d
                if starts[t]:
                    carry *= keep[t]
            order = np.argsort(x.ravel(), kind="stable")
            xs = x.ravel()[order]
            at = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
            self.g["into"][xs[at]] += np.add.reduceat(d_into.reshape(-1, 3 * u)[order], at, axis=0)
        return logp.reshape(steps, slots), h

    def _output(self, h: np.ndarray, target: np.ndarray, learn: bool):
        p, lex = self.p, self.lex
        logp = np.zeros(len(target), np.float32)
        dh = np.zeros_like(h) if learn else None
        at = np.flatnonzero(target >= 0)
        if not len(at):
            return logp, dh
        y = target[at]
        word = y < lex.n_words
        cls = np.where(word, y // lex.width, lex.classes + y - lex.n_words)
        ho = h[at]
        i = np.arange(len(at))
        logp[at], e = _log_softmax(ho @ p["to_class"], p["class_bias"], i, cls, learn)
        if learn:
            self.g["to_class"] += ho.T @ e
            self.g["class_bias"] += e.sum(0)
            dh[at] = e @ p["to_class"].T
        order = np.argsort(np.where(word, cls, lex.classes), kind="stable")[:int(word.sum())]
        edges = np.searchsorted(cls[order], np.arange(lex.classes + 1))
        for c in range(lex.classes):
            rows = order[edges[c]:edges[c + 1]]
            if not len(rows):
                continue
            hc = ho[rows]
            part, e = _log_softmax(hc @ p["to_word"][c], p["word_bias"][c], i[:len(rows)], y[rows] - c * lex.width, learn)
            logp[at[rows]] += part
            if learn:
                self.g["to_word"][c] += hc.T @ e
                self.g["word_bias"][c] += e.sum(0)
                dh[at[rows]] += e @ p["to_word"][c].T
        return logp, dh

    def step(self, tokens: int, rate: float) -> None:
        """Adam on the mean gradient of a window, clipped."""
        g = self.grad / max(tokens, 1)
        norm = float(np.sqrt(np.dot(g, g)))
        if norm > 1:
            g /= norm
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        self.s += np.float32(0.01) * (g * g - self.s)
        lift = math.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        self.flat -= np.float32(rate * lift) * self.m / (np.sqrt(self.s) + np.float32(1e-6))
        self.grad[:] = 0

    def walk(self, texts: list[np.ndarray], learn: bool, rate: float = RATE, slots: int = SLOTS, steps: int = STEPS) -> np.ndarray:
        """Run over documents packed back to back into slots; returns the log-probability (natural) of each document."""
        size = np.array([len(t) for t in texts])
        # scoring packs the longest first; training mixes lengths, so that every window looks like the corpus
        order = np.random.default_rng(len(texts)).permutation(len(texts)) if learn else np.argsort(-size, kind="stable")
        fill = np.zeros(min(slots, len(texts)), np.int64)
        lanes: list[list[int]] = [[] for _ in fill]
        heap = [(0, i) for i in range(len(fill))]
        for d in order.tolist():  # each to the emptiest slot
            n, i = heapq.heappop(heap)
            lanes[i].append(d)
            fill[i] = n + size[d]
            heapq.heappush(heap, (int(fill[i]), i))
        rank = np.argsort(-fill, kind="stable")
        fill, lanes = fill[rank], [lanes[i] for i in rank]
        lane_y = [np.concatenate([texts[d] for d in lane]) for lane in lanes]
        lane_doc = [np.repeat(lane, size[lane]) for lane in lanes]
        out = np.zeros(len(texts))
        h = np.zeros((len(fill), self.units), np.float32)
        before = np.full(len(fill), self.begin, np.int32)  # the last input, and the document it belongs to
        owner = np.full(len(fill), -1, np.int64)
        for t in range(0, int(fill.max()), steps):
            live = int((fill > t).sum())
            y = np.full((live, steps + 1), -1, np.int32)
            doc = np.full((live, steps + 1), -1, np.int32)
            for i in range(live):
                part = lane_y[i][t:t + steps]
                y[i, 1:1 + len(part)] = part
                doc[i, 1:1 + len(part)] = lane_doc[i][t:t + steps]
            y[:, 0], doc[:, 0] = before[:live], owner[:live]
            fresh = doc[:, 1:] != doc[:, :-1]
            x = np.where(fresh, self.begin, np.maximum(y[:, :-1], 0)).T
            before, owner = y[:, -1], doc[:, -1]
            yt, of = np.ascontiguousarray(y[:, 1:].T), doc[:, 1:].T
            logp, h = self.window(x, yt, fresh.T, h[:live], learn)
            good = yt >= 0
            if learn:
                # a window at the end of the longest documents has few live slots, and little say
                seen = int(good.sum())
                self.step(seen, rate * min(1.0, seen / (steps * len(fill))))
            else:
                out += np.bincount(of[good], weights=logp[good], minlength=len(texts))
        return out


def _blocks(batches, limit: int):
    """Row groups of about ``limit`` tokens, judged by bytes."""
    held, size = [], 0
    for batch in batches:
        for c in chunks(batch, "text", 1 << 20):
            held.append(c)
            size += c.nbytes
            if size >= 6 * limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _train(docs: DataFrame, sent, flat: np.ndarray, rate: float, slots: int, pieces: int = 64) -> np.ndarray:
    """Every partition trains from ``flat``; the mean of the parameters, weighted by tokens."""
    def run(batches):
        net, tokens = Network(sent.value, flat), 0
        for table in _blocks(batches, BLOCK_TOKENS):
            texts = [sent.value.read(t)[0] for t in table.column("text").to_pylist()]
            net.walk(texts, True, rate, slots)
            tokens += sum(map(len, texts))
        if tokens:
            parts = np.array_split(net.flat.astype(np.float64) * tokens, pieces)
            lists = pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))
            salt = np.full(pieces, np.random.default_rng(tokens).integers(0, 64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces)), pa.array(salt), pa.array([float(tokens)] * pieces), lists], ["piece", "salt", "n", "x"])

    def add(key, table):
        x = np.stack([np.asarray(v.values) for v in table.column("x")])
        return pa.table({"piece": [key[0].as_py()], "n": [float(pc.sum(table.column("n")).as_py())], "x": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    kind = "piece long, n double, x array<double>"
    sums = docs.select("text").mapInArrow(run, "piece long, salt long, n double, x array<double>").groupBy("piece", "salt").applyInArrow(add, kind)
    got = sums.groupBy("piece").applyInArrow(add, kind).toArrow().sort_by("piece")
    if not got.num_rows:
        return flat
    return np.concatenate([np.asarray(v.values) for v in got.column("x")]) / got.column("n")[0].as_py()


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 throughout.

    Learns from the rows that are not held out.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    learn = rows.where("NOT held")
    counts = stored(token_counts(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the head: all words above the count at which at most ``head`` are left, from a histogram of some hundred rows
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).count().collect()
    room, low = head, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        room -= r["count"]
        if room < 0:
            break
        low = r["b"]
    top = [] if low is None else counts.where((F.floor(F.log2("c") * 8) >= low) | (F.col("word") == END)).toArrow()
    top = list(zip(top.column("word").to_pylist(), top.column("c").to_pylist())) if low is not None else []
    lex = Lexicon(top, {})
    inside = [(w.decode(),) for w, i in lex.number.items() if i < lex.n_words]
    spark = docs.sparkSession
    model_words = F.broadcast(spark.createDataFrame(inside, "word string"))  # at most CLASSES * SIZE words
    rest = counts.join(model_words, "word", "left_anti").groupBy((F.crc32(F.col("word").cast("binary")) % RARE).alias("b")).agg(F.sum(F.col("c") + 1).alias("s"))
    lex = Lexicon(top, {r["b"]: r["s"] for r in rest.collect()})
    sent = spark.sparkContext.broadcast(lex)
    flat = Network(lex).flat.copy()
    n = learn.count()
    if n:
        unit = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, WARM_DOCS / n))
        flat = _train(learn.where(unit).repartition(1), sent, flat, RATE, SLOTS // 4)  # a bounded sample
        flat = _train(learn, sent, flat, RATE / 2, SLOTS)
    trained = spark.sparkContext.broadcast(flat.astype(np.float32))
    names = ["rid", "key", "held", "n_tokens", "known", "head_log", "logp", "others"]
    other = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())]))

    def run(batches):
        lex, net = sent.value, Network(sent.value, trained.value)
        for table in _blocks(batches, BLOCK_TOKENS):
            symbols, head_log, outside, known, others = zip(*[lex.read(t) for t in table.column("text").to_pylist()])
            size = np.array([len(x) for x in symbols])
            flat = np.concatenate(symbols)
            rare = np.flatnonzero(flat >= lex.n_words)
            shares = np.bincount(np.repeat(np.arange(len(size)), size)[rare], weights=lex.log_rare[flat[rare] - lex.n_words], minlength=len(size))
            # in log10: the network's symbols, then the head words within their rare classes; the other words are joined
            logp = net.walk(list(symbols), False, slots=4 * SLOTS) / math.log(10) - shares + np.array(outside)
            ends = np.cumsum([0, *map(len, others)]).astype(np.int32)
            words = pa.array([w for o in others for w in o], pa.binary()).cast(pa.string())
            pairs = pa.StructArray.from_arrays([words, pa.array([n for o in others for n in o.values()], pa.int64())], ["word", "tf"])
            yield pa.RecordBatch.from_arrays(
                [*[table.column(c).combine_chunks() for c in names[:3]], pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(head_log, pa.float64()),
                 pa.array(logp), pa.ListArray.from_arrays(ends, pairs)], names)

    scored = stored(rows.select(F.xxhash64("key", "text").alias("rid"), "key", "held", "text").mapInArrow(run, T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("key", kind), T.StructField("held", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("head_log", T.DoubleType()), T.StructField("logp", T.DoubleType()), T.StructField("others", other)])), "scored")
    c = F.coalesce("c", F.lit(0))
    away = scored.select("rid", F.explode("others").alias("o")).select("rid", "o.word", "o.tf").join(counts, "word", "left").select(
        "rid", (F.col("tf") * F.log10(c + 1)).alias("lg"), F.when(c > 0, F.col("tf")).otherwise(0).alias("kn"), F.lit(0).alias("copies"))
    # rows alike share a rid and bring the same words: their sums are divided by the number of such rows
    one = scored.select("rid", F.lit(0.0).alias("lg"), F.lit(0).cast("long").alias("kn"), F.lit(1).alias("copies"))
    sums = away.unionAll(one).groupBy("rid").agg(F.sum("lg").alias("lg"), F.sum("kn").alias("kn"), F.sum("copies").alias("copies"))
    lg, kn = F.col("lg") / F.col("copies"), (F.col("kn") / F.col("copies")).cast("long")
    return scored.drop("others").join(sums, "rid").select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + kn).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + lg - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), (F.col("logp") + lg).alias("score"))
