"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import spellings


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts: dict) -> set:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def plain_words(rows) -> dict:
    c: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 2}


def vocabulary(n, seed):
    r = random.Random(seed)
    letters = "abé"
    out = {"commonprefix" + "".join(r.choice(letters) for _ in range(r.randint(0, 5))) for _ in range(n)}
    out |= {"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n)}
    out |= {"".join(r.choice(letters) for _ in range(r.randint(0, 5))) + "commonsuffix" for _ in range(n)}
    out |= {"a" * k for k in range(1, 30)} | {"z" * 3000, "z" * 3001, "z" * 2999 + "y", "日本語の言葉", "日本語の言棄", "𝒳𝒴𝒵", "𝒳𝒴"}
    return {w: r.choice((1, 2, 3, 10, 40, 400, 5000)) for w in out}


@pytest.mark.parametrize("group", (2, 9, 1024))
def test_near_words(spark, monkeypatch, group):
    monkeypatch.setattr(spellings, "TILE", 4)
    monkeypatch.setattr(spellings, "ROWS", 64)
    counts = vocabulary(80, group)
    got = spellings.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), group=group)
    assert {tuple(r) for r in got.collect()} == expected(counts)


def test_long_chain_of_forms(spark):
    counts = {"abcdefgh"[:k] + "q" * (8 - k): 10**k for k in range(9)}
    got = spellings.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == expected(counts)


def test_documents(spark):
    r = random.Random(4)
    words = ["Straßen", "FLÄCHEN", "flächen", "Flächén", "étation", "ÉTATION", "xxxxxx", "abcdefgh", "abcdefg", "ÿÿÿÿÿÿÿ", "a×b÷cdef"]
    rows = [(i, " ".join(r.choice(words) + r.choice(("", "s", ", ", "-9")) for _ in range(r.randint(0, 400)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, "nokeyword nokeyword nokeywords"), (70, None), (71, ""), (72, "q" * 50_000 + " " + "q" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = spellings.group_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == expected(plain_words(rows))
    assert spellings.group_variants(df.limit(0)).collect() == []
