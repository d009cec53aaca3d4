"""Context-triggered fingerprints against a version that goes byte by byte."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ctph
from tallyspark.llm.columnar import hash_base

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def window_hash(seven: bytes) -> int:
    table, _ = hash_base(1000)
    h = 0
    for b in seven:
        h = (h * 0x9E3779B1 + (int(table[b]) >> 32)) & M32
    h ^= h >> 15
    h = h * 0x85EBCA6B & M32
    return h ^ h >> 13


def code(piece: bytes) -> str:
    table, base = hash_base(1000)
    h = sum(int(table[b]) * pow(base, i, 1 << 64) for i, b in enumerate(piece)) & M64
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M64
    h ^= h >> 29
    h = h * 0x9E3779B97F4A7C15 & M64
    h = (h ^ h >> 32) & 4095
    return ctph.LETTERS[h // 64] + ctph.LETTERS[h % 64]


def plain(text: bytes) -> str:
    level = 2
    while (64 << level) < len(text):
        level += 1
    while True:
        out = []
        for k in (level, level + 1):
            pieces, start = [], 0
            for i in range(6, len(text)):
                if window_hash(text[i - 6:i + 1]) % (1 << k) == 0 and len(pieces) < 127:
                    pieces.append(text[start:i + 1])
                    start = i + 1
            if start < len(text):
                pieces.append(text[start:])
            out.append("".join(map(code, pieces)))
        if len(out[0]) >= 32 or level == 2:
            return f"{level}:{out[0]}:{out[1]}"
        level -= 1


def alike(a: str, b: str) -> float:
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            diagonal, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + 2 * (c != d))
        return row[-1]

    if a == b:
        return 1.0
    best = 0.0
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    for i, x in enumerate(sa):
        for j, y in enumerate(sb):
            if int(ka) + i == int(kb) + j:
                x2, y2 = ([s[t:t + 2] for t in range(0, len(s), 2)] for s in (x, y))
                if x2 or y2:
                    best = max(best, 1 - distance(x2, y2) / (len(x2) + len(y2)))
    return best


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 8))) for _ in range(80)]
    out = [" ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 30, 200)))) for _ in range(n)]
    return out + ["", "abc", "a" * 900, "the same line again\n" * 60, "ab" * 500, "日本語" * 40]


def test_against_bytes():
    t = [x.encode() for x in texts(60, 3)]
    expected = [plain(x) for x in t]
    assert ctph.fingerprint(t) == expected
    assert ctph.fingerprint(t, block=97) == expected  # most texts are longer than a block
    pairs = list(zip(expected, expected[1:] + expected[:1]))
    assert np.allclose([ctph.likeness(*p) for p in pairs], [alike(*p) for p in pairs])
    assert ctph.likeness(None, "2::") is None


def expected_rows(rows):
    known = [(k, t or "") for k, t in rows]
    known.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, t) in enumerate(known):
        f = known[(i + 1) % len(known)][1]
        e = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        p, q, n = (plain(x.encode()) for x in (t, e, f))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, round(alike(p, q), 9), round(alike(p, n), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()], key=str)


def test_documents(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(50, 8))] + [(200, None), (None, "no key at all"), (201, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("fingerprint", F.lit(1))
    for parts in (1, 7):
        assert got(ctph.compare_with_edits(df.repartition(parts))) == expected_rows(rows)
    assert {(r[0], r[1]) for r in ctph.fingerprints(df).collect()} == {(k, plain((t or "").encode())) for k, t in rows}


def test_few_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert ctph.compare_with_edits(spark.createDataFrame([], kind)).collect() == []
    assert got(ctph.compare_with_edits(spark.createDataFrame([(5, "one document alone")], kind))) == expected_rows([(5, "one document alone")])
    same = [(7, "a text given twice")] * 40
    assert got(ctph.compare_with_edits(spark.createDataFrame(same, kind).repartition(4))) == expected_rows(same)


def test_edits_are_told_from_neighbours(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(2000)]
    df = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(60, 900)))) for i in range(200)], "doc_id long, text string")
    rows = ctph.compare_with_edits(df).collect()
    assert min(x.near_edited for x in rows) > 0.2 and sorted(x.near_next for x in rows)[-5] < 0.15
    a = df.withColumn("text2", F.concat("text", F.lit(" and a few words more")))
    b = ctph.fingerprints(df).join(ctph.fingerprints(a.drop("text"), text="text2").withColumnRenamed("fingerprint", "other"), "doc_id")
    assert min(x[0] for x in b.select(ctph.likeness_column("fingerprint", "other")).collect()) > 0.9
