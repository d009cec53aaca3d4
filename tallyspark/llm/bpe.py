"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a row of symbols; the leaf of a symbol holds the rank of its pair with the next one, so the root of a
minimum tree yields the leftmost pair of lowest rank. A merge updates three leaves and their ancestors, in logarithmic
time, until the root holds no pair. Many short pre-tokens run through the same tree steps at once as numpy rows; long ones
use a tree of their own.

A null text counts as empty (no ids, empty decoded text); strings of special tokens in a text become their ids. Rows with
a null key, repeated rows and very long texts are encoded like any other; an empty table gives an empty result. Only the
key and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import chunks

SHORT = 64  # symbols; longer pre-tokens are encoded one by one
CACHE_LETTERS = 4_000_000  # length of all spans that a Python worker remembers
CHUNK = 4 << 20  # bytes of text that are encoded together
NONE = np.int64(1) << 40

# fixed values: the code points with the property White_Space, as the pattern's \s
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else from 256 upwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """A BPE vocabulary file: its merges as sorted pair keys, and the ids of the first symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = made
        self.scalar = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for t, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = t
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split.replace(r"[^\s", f"[^{WHITE}"))
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")")
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The tree for one pre-token: a leaf's value is rank * n + position, so ties go to the left."""
        n = len(symbols)
        m = 1 << max(0, (n - 1).bit_length())
        none = int(NONE) * n
        find, made = self.scalar.get, self.made

        def leaf(i, j):
            r = find((symbols[i] << 20) | symbols[j]) if i >= 0 and j < n else None
            return none if r is None else r * n + i

        tree = [none] * (2 * m)
        tree[m:m + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for v in range(m - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i, value):
            v = m + i
            tree[v] = value
            while v > 1:
                v >>= 1
                low = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == low:
                    break
                tree[v] = low

        gone = bytearray(n)
        while tree[1] < none:
            rank, i = divmod(tree[1], n)
            j = after[i]
            k = after[j]
            symbols[i] = int(made[rank])
            gone[j] = 1
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [s for s, g in zip(symbols, gone) if not g]

    def merge_rows(self, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same tree steps for many pre-tokens at once. symbols: [words, m] with m a power of two, -1 behind the end.

        Returns the symbols with -1 where one was merged into its left neighbour.
        """
        w, m = symbols.shape
        sym = np.concatenate([symbols, np.full((w, 1), -1, np.int64)], 1)  # column m: nothing
        tree = np.full((w, 2 * m), NONE * m, np.int64)
        rank = np.where(sym[:, 1:] >= 0, self.ranks(sym[:, :-1], np.maximum(sym[:, 1:], 0)), NONE)
        tree[:, m:] = rank * m + np.arange(m)
        tree[:, m:][rank == NONE] = NONE * m
        v = m
        while v > 1:
            tree[:, v // 2:v] = np.minimum(tree[:, v:2 * v:2], tree[:, v + 1:2 * v:2])
            v //= 2
        after = np.arange(1, m + 2)[None, :]
        after = np.where(after >= n[:, None], m, after)
        before = np.broadcast_to(np.arange(-1, m), (w, m + 1)).copy()
        rows = np.flatnonzero(tree[:, 1] < NONE * m)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], m)
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i] = self.made[rank]
            sym[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            p = before[rows, i]
            right, mid, left = sym[rows, k], sym[rows, i], sym[rows, np.maximum(p, 0)]
            r = self.ranks(np.concatenate([mid, np.maximum(left, 0)]), np.concatenate([np.maximum(right, 0), mid]))
            c = len(rows)
            own = np.where((k < m) & (r[:c] < NONE), r[:c] * m + i, NONE * m)
            prior = np.where((p >= 0) & (r[c:] < NONE), r[c:] * m + p, NONE * m)
            tree[rows, m + j] = NONE * m
            tree[rows, m + i] = own
            has = p >= 0
            tree[rows[has], m + p[has]] = prior[has]
            for at, who in ((j, rows), (i, rows), (p[has], rows[has])):
                v = m + at
                for _ in range(m.bit_length() - 1):
                    v = v >> 1
                    tree[who, v] = np.minimum(tree[who, 2 * v], tree[who, 2 * v + 1])
            rows = rows[tree[rows, 1] < NONE * m]
        return sym[:, :m]

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian bytes."""
        raw = [x.encode() for x in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        at = np.cumsum(size) - size
        sym = self.first[buf]
        sym[at + size - 1] = self.last[buf[at + size - 1]]
        out = [b""] * len(words)
        low = 0
        for m in (1, 2, 4, 8, 16, 32, SHORT):
            which = np.flatnonzero((size > low) & (size <= m))
            low = m
            for s in range(0, len(which), 16_384):
                part = which[s:s + 16_384]
                col = np.arange(m)
                inside = col[None, :] < size[part][:, None]
                rows = np.where(inside, sym[np.minimum(at[part][:, None] + col, len(sym) - 1)], -1)
                done = self.merge_rows(rows, size[part]) if m > 1 else rows
                kept = done >= 0
                data = done[kept].astype("<u4").tobytes()
                start = 0
                for w, e in zip(part.tolist(), (np.cumsum(kept.sum(1)) * 4).tolist()):
                    out[w] = data[start:e]
                    start = e
        for w in np.flatnonzero(size > SHORT).tolist():
            out[w] = np.array(self.merge_one(sym[at[w]:at[w] + size[w]].tolist()), "<u4").tobytes()
        return out

    def remember(self, words: set[str]) -> None:
        """Encode spans between blanks into the worker's memory. The pattern never crosses a blank."""
        new = list(words - self.cache.keys())
        if self.held + sum(map(len, new)) > CACHE_LETTERS:
            self.cache.clear()
            self.held, new = 0, list(words)
        if new:
            pieces = [self.pattern.findall(w) for w in new]
            distinct = list({x for p in pieces for x in p})
            get = dict(zip(distinct, self.merged(distinct))).__getitem__
            self.cache.update(zip(new, [b"".join(map(get, p)) for p in pieces]))
            self.held += sum(map(len, new))

    def spans(self, text: str) -> list[str]:
        """The text without special tokens, in NFC and letter by letter in lower case, cut at blanks and line ends."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().replace("\n", " ").split(" ")

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        parts = []
        for t in texts:
            if t and "<|" in t:
                parts.append([s if s in self.specials else self.spans(s) for s in self.special.split(t)])
            else:
                parts.append([self.spans(t)] if t else [])
        self.remember({w for p in parts for x in p if isinstance(x, list) for w in x})
        get = self.cache.__getitem__
        return [b"".join([b"".join(map(get, x)) if isinstance(x, list) else self.specials[x].to_bytes(4, "little")
                          for x in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space, specials included: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, text: str, extra: list[str], fields: list[tuple[str, T.DataType]], row, size: int = CHUNK) -> DataFrame:
    kinds = [T.StructField(c, docs.schema[c].dataType) for c in extra]
    source = docs.select(*extra, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text", size):
                cols = row(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*extra, *[n for n, _ in fields]])

    return source.mapInArrow(run, T.StructType([*kinds, *[T.StructField(n, k) for n, k in fields]]))


def encode(docs: DataFrame, path: str, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``extra`` and ids, array<int>."""
    def row(texts):
        return [_id_rows(vocabulary(path).encode(texts))]

    return _mapped(docs, text, list(extra), [("ids", T.ArrayType(T.IntegerType()))], row)


def _id_rows(out: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(out), np.int32)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``extra`` and the decoded text; null ids decode to an empty text."""
    kinds = [T.StructField(c, encoded.schema[c].dataType) for c in extra]

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column("__ids")
            values = np.asarray(lists.values.cast(pa.int32())).astype("<u4", copy=False)
            ends = np.asarray(lists.offsets)
            group = (ends[:-1] - ends[0]) // (CHUNK // 4)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            known = np.asarray(lists.is_valid())
            for s, e in zip(cuts, cuts[1:]):
                texts = [v.decode(values[ends[i]:ends[i + 1]].tobytes()) if known[i] else "" for i in range(s, e)]
                yield pa.RecordBatch.from_arrays([*[c.slice(s, e - s) for c in batch.columns[:-1]], pa.array(texts, pa.string())], [*extra, "text"])

    return encoded.select(*extra, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(
        run, T.StructType([*kinds, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``extra``, ids, n_tokens and the text decoded from the ids, in one pass that holds one chunk of texts."""
    def row(texts):
        v = vocabulary(path)
        out = v.encode(texts)
        return [_id_rows(out), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([v.decode(x) for x in out], pa.string())]

    return _mapped(docs, text, list(extra), [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("decoded", T.StringType())], row, 1 << 20)


def digests(docs: DataFrame, path: str, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``extra``, n_tokens, and SHA-256 of the ids and of the text decoded from them, in one pass."""
    def row(texts):
        v = vocabulary(path)
        out = v.encode(texts)
        sha = hashlib.sha256
        return [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([sha(x).hexdigest() for x in out], pa.string()),
                pa.array([sha(v.decode(x).encode()).hexdigest() for x in out], pa.string())]

    return _mapped(docs, text, list(extra), [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()),
                                             ("decoded_sha256", T.StringType())], row)
