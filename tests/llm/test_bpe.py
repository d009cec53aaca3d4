import hashlib
import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from tallyspark.llm import bpe  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_equal_the_library(library):
    rng = random.Random(1)
    pool = list("abcxyzABCÉéèß'sS'tlldre 09½²٣\t\n\x0b\x1c\x1f\x85Σσς漢字한글😀<|>_-") + ["\xa0", " ", "​", "　", "İ", "Å"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["a<|endoftext|>B", "<|startoftext|>", "<|endoftext", "It's WE'RE 'D", "", "x" * 5000, "thethere" * 400, "é" * 33, "ab" * 32]
    mine = bpe.Vocabulary(PATH).encode(texts)
    for t, a, b in zip(texts, mine, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(a, "<u4").tolist() == b.ids, t
        assert bpe.Vocabulary.decode(bpe.vocabulary(PATH), a) == library.decode(b.ids, skip_special_tokens=False)


def test_rows_of_trees_equal_the_single_tree():
    v = bpe.vocabulary(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choice("thein graos") for _ in range(rng.randint(1, 64))).replace(" ", "") or "a" for _ in range(500)]
    for w, ids in zip(words, v.merged(words)):
        sym = [int(x) for x in v.first[list(w.encode())]]
        sym[-1] = int(v.last[w.encode()[-1]])
        assert v.merge_one(sym) == np.frombuffer(ids, "<u4").tolist()


def test_memory_is_dropped_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_LETTERS", 50)
    v = bpe.Vocabulary(PATH)
    a = v.encode(["one two three four five six", "seven eight nine ten one two"])
    assert v.encode(["seven eight nine ten one two"]) == a[1:]


def test_query_on_hard_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "The the the"), (4, "The the the"), (None, "x"), (5, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS __text2", "3 AS n_tokens")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect()))
    want = []
    for d, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(e, skip_special_tokens=False)
        want.append((d or 0, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.where("1 = 0"), PATH).collect() == []


def test_round_trip_through_dataframes(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for r in docs.collect():
        assert back[r.doc_id] == library.decode(library.encode(r.text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_decode_of_null_and_sliced_lists(spark, library):
    rows = [(1, None), (2, []), (3, [5, 300, 17])] + [(i, [i % 700, 9]) for i in range(4, 60)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>"), PATH).collect()}
    assert got == {k: library.decode(x or [], skip_special_tokens=False) for k, x in rows}
