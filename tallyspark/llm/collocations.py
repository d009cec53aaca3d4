"""Phrase collocations by stripes: each prefix keys an associative next-word counter, and stripes are merged elementwise.

A stripe belongs to a language and a prefix of 0 to 3 words; it counts the words that follow the prefix inside a piece, and under
the empty word the occurrences that end the piece or go on with a word that no candidate can hold. One merged table of stripes
gives everything: an entry is the count of a phrase, the sum of a stripe is the count of its prefix (of the empty prefix: all
words), and the largest count of a phrase one word longer is the maximum of the phrase's own stripe and of the entries that end
in it. Longer containing phrases are no more frequent than those, so they decide subsumption.

Four passes build the table, one for each prefix size: a pass counts the continuations of the frequent phrases that the one before
found. What is frequent is told to the next pass by a bitmap of fixed size over phrase hashes; a false positive there costs an
entry that the threshold removes, and no frequent phrase is lost. A prefix that has more than a 4096th of all words (so there are 4096 of them at most) has its stripe
dealt to shards by the next word; every prefix is counted in the tasks first. Merging carries one stripe at a time.

A null text counts as empty, a null language as ``und``; a null key plays no part. Repeated rows count as often as they occur.
Texts are read whole, any length. Score ties go to the more frequent phrase, then to the first in byte order. An empty table gives
an empty result. Only the text and language columns are read.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .columnar import chunks, mixed, word_bounds, word_hashes

LEAST = 30  # occurrences of a candidate
TOP = 2000
UNKNOWN = "und"
SHARDS = 4096
BITS = 1 << 27  # of the bitmap of frequent phrases
ENTRIES = 1 << 20  # counted in a task before stripes leave it
ID_BITS = 20
IDS = (1 << ID_BITS) - 1  # words a task can number; it forgets them from a quarter of that on
RUN = 1 << 21  # bytes of text that are numbered together
MERGED = 1 << 20  # entries that are merged together

BLANK, BREAK = 0, 1
# lower case for A-Z, piece ends to line ends, tabs to spaces
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STRIPE = "lang string, prefix string, size int, shard int, nexts array<string>, counts array<long>"


def _spans(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)


def _in_language(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mixed(hashes ^ np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b)


class _Bitmap:
    """Which phrase hashes may be frequent."""

    def __init__(self, data: np.ndarray):
        self.data, self.mask = data, np.uint64(len(data) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Words(dict):
    """Numbers of a language's words in a task, and what was counted of them."""

    def __init__(self, lang: str, hot: dict):
        self.lang, self.hot = lang, hot
        self.update({b"": BLANK, b"\n": BREAK})
        self.hashes = np.zeros(2, np.uint64)
        self.raw: list[tuple[np.ndarray, np.ndarray]] = []  # prefixes and next words, not counted yet
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []  # keys of both, and counts
        self.seen = np.zeros(2, np.int64)  # of each word, where words are counted

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def numbers(self, data: bytes) -> np.ndarray:
        """The words of a run, with a break between pieces and at the end."""
        buf = np.frombuffer(data, np.uint8)
        starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]))
        if not len(starts):
            return np.array([BREAK])
        line = np.cumsum(buf == 10)[starts]
        breaks = np.cumsum(np.r_[False, line[1:] != line[:-1]])
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        letters = buf[(buf != 32) & (buf != 10)]
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        _, at, held = coded.dictionary.buffers()
        held = held.to_pybytes()
        at = np.frombuffer(at, np.int32)[:len(coded.dictionary) + 1].tolist()
        number = np.fromiter(map(self.__getitem__, [held[a:b] for a, b in zip(at, at[1:])]), np.int64, len(at) - 1)
        out = np.full(len(starts) + breaks[-1] + 1, BREAK)
        out[np.arange(len(starts)) + breaks] = number[np.asarray(coded.indices)]
        known = len(self.hashes)
        if len(self) > known:
            new = list(islice(reversed(self), len(self) - known))[::-1]
            self.hashes = np.concatenate([self.hashes, _in_language(_spans(new), self.lang)])
        return out

    def strings(self) -> pa.Array:
        words = list(self)
        words[BREAK] = b""
        return pa.array(words, pa.binary()).cast(pa.string())


def _entries(words: _Words, size: int, ids: np.ndarray, ahead: int, frequent: _Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Prefix and next numbers for one run of words; next is BLANK where the stripe has no use for it. The last ``ahead`` words
    belong to the next run."""
    end = len(ids) - 1 - ahead
    n = len(ids) - size + 1
    h, whole, prefix = words.hashes[ids[:n]], ids[:n] != BREAK, ids[:n]
    for i in range(1, size):
        h, whole, prefix = _paired(h, words.hashes[ids[i:n + i]]), whole & (ids[i:n + i] != BREAK), (prefix << ID_BITS) | ids[i:n + i]
    good = np.zeros(len(ids) + 1, bool)
    where = np.flatnonzero(whole)
    good[where[frequent.holds(h[where])]] = True
    at = np.flatnonzero(good[:end])
    return prefix[at], np.where(good[at + 1], ids[np.minimum(at + size, len(ids) - 1)], BLANK)


def _count(words: _Words, size: int) -> int:
    """Counts what was gathered; returns the number of entries held."""
    if words.raw:
        prefix, following = (np.concatenate(x) for x in zip(*words.raw))
        words.raw = []
        if size < 3:  # prefix and next word are one number
            words.counted.append(np.unique((prefix << ID_BITS) | following, return_counts=True))
        else:
            words.counted.append((np.stack([prefix, following]), np.ones(len(prefix), np.int64)))
    return sum(len(c) for _, c in words.counted)


def _counts(words: _Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes a task has seen, and for each entry the prefix's place, the next word and the count."""
    if size == 0:
        following = np.flatnonzero(words.seen)
        counts, words.seen = words.seen[following], np.zeros(2, np.int64)
        return np.zeros(min(len(following), 1), np.int64), np.zeros(len(following), np.int64), following, counts
    if not _count(words, size):
        words.counted = []
        return (np.zeros(0, np.int64),) * 4
    keys, counts = (np.concatenate(x, axis=-1) for x in zip(*words.counted))
    words.counted = []
    if size == 3:
        kinds, prefix = np.unique(keys[0], return_inverse=True)
        keys = (prefix.astype(np.int64) << ID_BITS) | keys[1]
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, counts = keys[at], np.add.reduceat(counts[order], at)
    first = keys >> ID_BITS
    if size == 3:
        return kinds, first, keys & IDS, counts
    change = np.r_[True, first[1:] != first[:-1]]
    return first[change], np.cumsum(change) - 1, keys & IDS, counts


def _stripes(words: _Words, size: int) -> pa.RecordBatch | None:
    """One row for each prefix (and shard): its next words and how often each came."""
    kinds, prefix, following, counts = _counts(words, size)
    if not len(prefix):
        return None
    strings = words.strings()
    parts = [strings.take(pa.array((kinds >> (ID_BITS * i)) & IDS)) for i in reversed(range(size))]
    named = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0] if size else pa.array([""])
    wide = np.ones(len(kinds), np.int64)
    if size == 0:
        wide[:] = SHARDS
    elif words.hot:
        wide = np.fromiter((words.hot.get((words.lang, x), 1) for x in named.to_pylist()), np.int64, len(kinds))
    shard = (words.hashes[following] % wide[prefix].astype(np.uint64)).astype(np.int64)
    if wide.max() > 1:
        order = np.argsort(prefix * SHARDS + shard, kind="stable")
        prefix, following, counts, shard = prefix[order], following[order], counts[order], shard[order]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])])
    offsets = pa.array(np.r_[first, len(prefix)].astype(np.int32))
    n = len(first)
    return pa.RecordBatch.from_arrays([
        pa.array([words.lang] * n, pa.string()), named.take(pa.array(prefix[first])), pa.array(np.full(n, size, np.int32)), pa.array(shard[first].astype(np.int32)),
        pa.ListArray.from_arrays(offsets, strings.take(pa.array(following))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))],
        ["lang", "prefix", "size", "shard", "nexts", "counts"])


def _counted(docs: DataFrame, size: int, frequent=None, hot=None) -> DataFrame:
    """Stripes of all tasks, not merged, for prefixes of one size: of phrases that the bitmap holds, or of the empty phrase."""
    most, ids_max, run_bytes = ENTRIES, IDS, RUN

    def run(batches):
        bitmap = _Bitmap(frequent.value) if frequent else None
        known = hot.value if hot else {}
        state: dict[str, _Words] = {}
        raw = 0

        def flush():
            for words in state.values():
                batch = _stripes(words, size)
                for s in range(0, batch.num_rows if batch else 0, 4096):
                    yield batch.slice(s, 4096)

        for batch in batches:
            for part in chunks(batch, "text", 4 * run_bytes):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        by_lang.setdefault(lang, []).append(text.encode())
                for lang, texts in by_lang.items():
                    for data, ahead in _runs(texts, run_bytes):
                        room = data.count(b" ") + data.count(b"\n") + 8
                        if sum(map(len, state.values())) > ids_max // 4 or (lang in state and len(state[lang]) + room > ids_max):
                            yield from flush()
                            state, raw = {}, 0
                        if lang not in state:
                            state[lang] = _Words(lang, known)
                        words = state[lang]
                        ids = words.numbers(data)
                        if size == 0:
                            more = np.bincount(ids[:len(ids) - 1 - ahead], minlength=len(words))
                            more[BREAK] = 0
                            more[:len(words.seen)] += words.seen
                            words.seen = more
                        elif len(ids) > size:
                            words.raw.append(_entries(words, size, ids, ahead, bitmap))
                            raw += len(words.raw[-1][0])
                            if raw > most:
                                raw = 0
                                if sum(_count(w, size) for w in state.values()) > 3 * most:
                                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _STRIPE)


def _runs(texts: list[bytes], size: int):
    """(bytes, words ahead): texts joined by line ends, in runs of about ``size`` bytes. A longer text is cut at a piece's end, or
    between two words; then the run ends with up to three words of the next one."""
    held: list[bytes] = []
    total = 0
    for t in texts:
        t = t.translate(_BYTES)
        if len(t) <= size:
            if total + len(t) > size and held:
                yield b"\n".join(held), 0
                held, total = [], 0
            held.append(t)
            total += len(t)
            continue
        start = 0
        while len(t) - start > size:
            cut = t.rfind(b"\n", start, start + size)
            if cut < 0:
                cut = t.rfind(b" ", start, start + size)
            if cut < 0:
                ends = [x for x in (t.find(b"\n", start + size), t.find(b" ", start + size)) if x >= 0]
                if not ends:
                    break
                cut = min(ends)
            ahead = _ahead(t, cut) if t[cut] == 32 else []
            yield b" ".join([t[start:cut], *ahead]), len(ahead)
            start = cut + 1
        yield t[start:], 0
    if held:
        yield b"\n".join(held), 0


def _ahead(t: bytes, at: int) -> list[bytes]:
    """Up to three words of the same piece from a place on."""
    out: list[bytes] = []
    while len(out) < 3 and at < len(t) and t[at] != 10:
        if t[at] == 32:
            at += 1
            continue
        end = min(x for x in (t.find(b" ", at), t.find(b"\n", at), len(t)) if x >= 0)
        out.append(t[at:end])
        at = end
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Stripes of one key added up; rows are sorted by key."""
    table = table.combine_chunks()
    keys = [table.column(c).combine_chunks() for c in ("lang", "prefix", "size", "shard")]
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        change |= np.asarray(pc.not_equal(k[1:], k[:-1]))
    first = np.flatnonzero(np.r_[True, change])
    group = np.cumsum(np.r_[False, change])
    nexts, counts = (table.column(c).combine_chunks() for c in ("nexts", "counts"))
    owner = np.repeat(group, np.diff(np.asarray(nexts.offsets)))
    coded = nexts.flatten().dictionary_encode()
    key = (owner.astype(np.int64) << 32) | np.asarray(coded.indices).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total = np.add.reduceat(np.asarray(counts.flatten())[order], at) if len(at) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[np.searchsorted(key[at] >> 32, np.arange(len(first))), len(at)].astype(np.int32))
    pick = pa.array(first)
    return pa.table([*[k.take(pick) for k in keys], pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(key[at] & 0xFFFFFFFF))),
                     pa.ListArray.from_arrays(offsets, pa.array(total))], ["lang", "prefix", "size", "shard", "nexts", "counts"])


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, size, shard, total, nexts, counts): one row a stripe; entries below the threshold count in the total only."""
    key = ["lang", "prefix", "size", "shard"]
    names = [*key, "total", "nexts", "counts"]
    limit = MERGED

    def finished(t: pa.Table):
        nexts, counts = (t.column(c).combine_chunks() for c in ("nexts", "counts"))
        flat, words = np.asarray(counts.flatten()), nexts.flatten()
        ends = np.asarray(counts.offsets) - counts.offsets[0].as_py()
        total = np.diff(np.r_[0, np.cumsum(flat)][ends])
        keep = (flat >= least) & np.asarray(pc.not_equal(words, ""))
        offsets = pa.array(np.r_[0, np.cumsum(keep)][ends].astype(np.int32))
        mask = pa.array(keep)
        columns = [*[t.column(c).combine_chunks() for c in key], pa.array(total), pa.ListArray.from_arrays(offsets, words.filter(mask)),
                   pa.ListArray.from_arrays(offsets, pa.array(flat[keep]))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                held.append(pa.Table.from_batches([part]))
                count += pc.sum(pc.list_value_length(part.column("counts"))).as_py()
                if count >= limit:
                    both = _merge(pa.concat_tables(held))
                    if both.num_rows > 1:
                        yield finished(both.slice(0, both.num_rows - 1).combine_chunks())
                    held, count = [both.slice(both.num_rows - 1)], 0
        if held:
            yield finished(_merge(pa.concat_tables(held)))

    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "lang string, prefix string, size int, shard int, total long, nexts array<string>, counts array<long>")


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of all (lang, phrase) of one size. The driver gets bits / 8 bytes at most."""
    def run(batches):
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            at = np.zeros(len(phrases), np.uint64)
            for lang in set(langs):
                mine = [i for i, x in enumerate(langs) if x == lang]
                words = [_in_language(_spans([phrases[i][k] for i in mine]), lang) for k in range(len(phrases[mine[0]]))]
                h = words[0]
                for w in words[1:]:
                    h = _paired(h, w)
                at[mine] = h
            yield pa.RecordBatch.from_arrays([pa.array((at & np.uint64(bits - 1)).astype(np.int64))], ["at"])

    set_ = phrases.mapInArrow(run, "at long").groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in set_.collect():
        data = np.frombuffer(r.b, np.uint8)
        start = (r.bucket - 1) * 4096
        part = out[start:start + 4096]
        part |= data[:len(part)]
    return out


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int = BITS) -> DataFrame:
    """The merged stripes of all prefixes whose continuations can be candidates."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    words = stored(_merged(_counted(rows, 0), least), "stripes")
    total = words.agg(F.sum("total")).first()[0] or 0

    def hot_of(phrases: DataFrame):
        # counts of one size add up to all words at most, so there are SHARDS such phrases at most
        found = phrases.where(F.col("a") * F.lit(SHARDS).cast("decimal(10,0)") > F.lit(total)).collect()
        return sc.broadcast({(r.lang, r.phrase): min(SHARDS, -(-r.a * SHARDS // total)) for r in found})

    tables = [words]
    for size in (1, 2, 3):
        found = phrases_of(tables[-1])
        frequent, hot = sc.broadcast(_bitmap(found, bits)), hot_of(found)
        tables.append(stored(_merged(_counted(rows, size, frequent, hot), least), "stripes"))
        frequent.unpersist()
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def phrases_of(table: DataFrame) -> DataFrame:
    """(lang, phrase, a): the entries of stripes."""
    each = table.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    return each.select("lang", F.ltrim(F.concat("prefix", F.lit(" "), F.col("e.nexts"))).alias("phrase"), F.col("e.counts").alias("a"))


def collocations(table: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of a table of stripes: the best phrases of each language."""
    # the count of each phrase, and of its most frequent extension by one word before or behind it
    own = table.where("size > 0").select("lang", F.col("prefix").alias("phrase"), "total", F.when(F.col("size") > 1, F.array_max("counts")).alias("longer"))
    found = phrases_of(table.where("size > 0"))
    behind = found.select("lang", F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase"), F.lit(None).cast("long").alias("total"), F.col("a").alias("longer"))
    known = own.unionAll(behind.where(F.instr("phrase", " ") > 0)).groupBy("lang", "phrase").agg(F.sum("total").alias("total"), F.max("longer").alias("longer"))
    known = stored(known, "phrases")

    def times(factor: int, column: str):
        return F.lit(factor).cast("decimal(10,0)") * F.col(column).cast("decimal(20,0)")

    open_ = found.join(known.select("lang", "phrase", "longer"), ["lang", "phrase"], "left")
    open_ = open_.where(F.col("longer").isNull() | (times(100, "longer") < times(80, "a"))).select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cuts = open_.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    counts = known.where("total IS NOT NULL")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("total").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("total").alias("r")), ["lang", "tail"])
    score = F.call_function("div", times(2_000_000, "a"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = table.where("size = 0").groupBy("lang").agg(F.sum("total").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations(stripes(docs, text, lang, least, bits), top)
