"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations


def expected(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(x.lower() if x.isascii() else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    gone = set()
    for p, a in good.items():
        for k in range(3, len(p)):
            gone |= {q for i in range(1, len(p) - k + 2) if 100 * a >= 80 * f[q := (p[0], *p[i:i + k - 1])] and len(q) < len(p)}
    out = []
    for lang in n:
        mine = []
        for p, a in good.items():
            if p[0] == lang and p not in gone:
                cuts = [(2000000 * a // (f[p[:k]] + f[(lang, *p[k:])]), k - 1, f[p[:k]], f[(lang, *p[k:])]) for k in range(2, len(p))]
                s, _, left, right = min(cuts)
                mine.append((-s, -a, " ".join(p[1:]).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def corpus(seed, docs=60):
    r = random.Random(seed)
    common = ["the", "of", "New", "York", "City", "Hall", "état", "日本"]
    rare = [f"w{i}" for i in range(400)]
    fixed = ["machine learning model card", "once upon a time", "the the the the the"]
    rows = []
    for _ in range(docs):
        out = []
        for _ in range(r.randint(0, 150)):
            out.append(r.choice(fixed) if r.random() < 0.15 else r.choice(common) if r.random() < 0.7 else r.choice(rare))
            out.append(r.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",\n", "\x0b", " ", "-"]))
        rows.append(("".join(out), r.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "xx"), ("the end", "yy"), (" . , ", "zz"), ("long piece without end " * 3000, "en")]


@pytest.mark.parametrize("small", (False, True))
def test_against_counting(spark, monkeypatch, small):
    if small:  # every bound is met: runs are cut inside pieces, words forgotten, stripes sharded and merged piece by piece
        for name, value in (("RUN", 100), ("ENTRIES", 500), ("IDS", 255), ("MERGED", 50), ("SHARDS", 16)):
            monkeypatch.setattr(collocations, name, value)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("prefix", F.lit(1)).withColumn("phrase", F.lit("x"))
    got = collocations.mine(df.repartition(3), bits=1 << 15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_saturated_bitmap_ties_and_top(spark):
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.mine(df, least=3, top=25, bits=64 * 512)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 3, 25)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(df).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("a b", None)], "text string, lang string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 10**15
    table = spark.createDataFrame([("en", "", 0, 0, 4 * big, ["a", "b"], [2 * big, 2 * big]), ("en", "a", 1, 0, 2 * big, ["b"], [big]),
                                   ("en", "b", 1, 0, 2 * big + 7, [], [])], "lang string, prefix string, size int, shard int, total long, nexts array<string>, counts array<long>")
    assert [tuple(r) for r in collocations.collocations(table).collect()] == [("en", 1, "a b", big, 2 * big, 2 * big + 7, 4 * big, 2000000 * big // (4 * big + 7))]
