import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline as cp
from tests.llm.test_leaks import lcs
from tests.llm.test_leaks import words as leak_words
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_classes, brute_fingerprint

from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, leaks
from tallyspark.session import stored

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_every_stage_equals_its_plain_version(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = stored(cp.language_id(spark, docs, SF))
    told = {r.doc_id: (r.lang_pred, r.ambiguous) for r in langid.predict(docs, langid.train(docs, F.col("doc_id").isNotNull())).collect()}
    want = [(*r[:2], r[2] if told[r[0]][1] else told[r[0]][0], *r[3:]) for r in rows_of(docs) if any(map(str.isalpha, r[1] or ""))]
    assert sorted(rows_of(first), key=str) == sorted(want, key=str)

    second = stored(cp.line_dedup(spark, first, SF))
    digest = dict(brute_lines([(r[0], r[1]) for r in rows_of(first)]))
    got = {r[0]: r for r in rows_of(second)}
    same = sum(d not in got or hashlib.sha256(got[d][1].encode()).hexdigest() == h for d, h in digest.items())
    assert same >= 0.98 * len(digest) and all(r[4] == len(r[1]) for r in got.values())

    third = stored(cp.near_dedup(spark, second, SF))
    fps = {d: brute_fingerprint(r[1]) for d, r in got.items()}
    classes = brute_classes(list(fps), list(fps.values()))
    assert {r[0] for r in rows_of(third)} == {d for d, c in classes.items() if d == c}

    fourth = stored(cp.decontamination(spark, third, SF))
    items = [(r.item_id, leak_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = set()
    for r in rows_of(third):
        w = leak_words(r[1])
        for _, x in items:
            if len(set(x) & set(w)) >= 0.5 * len(set(x)):
                n = leaks.passage_length(len(x))
                if any(lcs(x, w[max(0, a - n // 4):a + n + n // 4]) >= leaks.VERBATIM * len(x) for a in range(0, max(1, len(w) - n + n // 4), n // 4)):
                    leaking.add(r[0])
    assert {r[0] for r in rows_of(fourth)} == {r[0] for r in rows_of(third)} - leaking

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    texts = {r[0]: r[1] for r in rows_of(fourth)}
    for r in cp.tokens(spark, fourth, SF).collect():
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_languages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    long = docs.where("length(text) > 500")
    wrong = long.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 1, F.lit("es")).otherwise(F.col("lang")))
    truth = {r.doc_id: r.lang for r in long.collect()}
    got = cp.language_id(spark, wrong, SF).collect()
    assert len(got) == len(truth) and sum(r.lang == truth[r.doc_id] for r in got) >= 0.9 * len(truth)
    some = cp.language_id(spark, wrong, SF, ("en", "de")).collect()
    assert {r.lang for r in some} == {"en", "de"} and len(some) == sum(r.lang in ("en", "de") for r in got)


def test_hard_rows_pass_every_stage(spark):
    text = " ".join(f"token{i}" for i in np.arange(60))
    rows = [(1, None), (2, ""), (3, "123"), (None, text), (None, "something else entirely here"), (4, text), (5, "third text with words"), (5, "third text with words"), (6, "long " * 30000)]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS row", "2 AS key")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
    got = [(r.doc_id, r.n_tokens) for r in docs.collect()]
    assert {d for d, _ in got} == {4, 5, 6, None} and sum(d is None for d, _ in got) == 1 and sum(d == 5 for d, _ in got) == 2
    none = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in cp.STAGES:
        none = stored(stage(spark, none, SF))
    assert none.collect() == []


def test_tokens_are_decoded(spark):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en", None, None), (-2, "", "en", None, None)], docs.schema))
    got = cp.tokens(spark, docs, SF).collect()
    assert len(got) == docs.count() and {r.decoded for r in got if r.doc_id in (-1, -2)} == {""}
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in got)


def test_run_applies_the_stages(spark):
    got = cp.run(spark, SF)
    assert 0 < got.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rounds_trips_hold_one_chunk():
    """10,000 texts in one batch: a worker's memory stays far below the batch's ids as Python numbers."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from tallyspark.llm import bpe
v = bpe.vocabulary(sys.argv[1])
r = np.random.default_rng(1)
words = ["w" + "abcdefghij"[i % 10] * (i % 5) + str(i % 97) for i in range(5000)]
texts = [" ".join(words[i] for i in r.integers(0, 5000, 300)) for _ in range(10_000)]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["__text"])
del texts
v.encode(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for part in bpe.chunks(batch, "__text", 1 << 20):
    out = v.encode(part.column("__text").to_pylist())
    n += sum(len(v.decode(x)) for x in out) > 0
    bpe._id_rows(out)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, n)
"""
    out = subprocess.run([sys.executable, "-c", code, public_tokenizers.path("word_bpe_49k.json")], capture_output=True, text=True, timeout=600)
    grown, parts = map(int, out.stdout.split())
    assert parts > 10 and grown < 400
