import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import gru
from tallyspark.llm.queries import op10_lm_scoring


def lexicon():
    return gru.Lexicon([("", 9), *[(f"w{i}", 50 - i) for i in range(30)]], {3: 10, 5: 4}, 4, 5, 32)


def test_gradients_equal_differences():
    lex = lexicon()
    net = gru.Network(lex, units=5)
    rng = np.random.default_rng(1)
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    y, x = rng.integers(0, lex.n_words + 32, (6, 3)).astype(np.int32), rng.integers(0, lex.n_words + 33, (6, 3))
    y[4, 1] = -1
    fresh, h = rng.random((6, 3)) < 0.2, np.zeros((3, 5), np.float32)
    net.window(x, y, fresh, h, True)
    grad = net.grad.copy()
    for i in rng.integers(0, len(net.flat), 200):
        old, e = net.flat[i], 1e-2
        net.flat[i] = old + e
        a = -net.window(x, y, fresh, h, False)[0].sum()
        net.flat[i] = old - e
        b = -net.window(x, y, fresh, h, False)[0].sum()
        net.flat[i] = old
        assert abs((a - b) / 2 / e - grad[i]) < 2e-2 * max(1, abs(grad[i]))


def test_probabilities_sum_to_one_and_start_as_unigrams():
    lex = lexicon()
    net = gru.Network(lex, units=5)
    n = lex.n_words + lex.rare
    y = np.arange(n, dtype=np.int32)[None, :]
    logp, _ = net.window(np.full((1, n), net.begin), y, np.ones((1, n), bool), np.zeros((n, 5), np.float32), False)
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)
    net.p["to_class"][:], net.p["to_word"][:] = 0, 0
    logp, _ = net.window(np.full((1, n), net.begin), y, np.ones((1, n), bool), np.zeros((n, 5), np.float32), False)
    want = np.concatenate([lex.counts + 1, lex.rare_totals + 1])
    assert np.allclose(np.exp(logp[0]), want / want.sum(), atol=1e-5)


def test_state_is_carried_across_windows_whatever_the_packing():
    lex = lexicon()
    net = gru.Network(lex, units=5)
    rng = np.random.default_rng(3)
    net.flat[:] = rng.normal(0, 0.5, len(net.flat))
    texts = [rng.integers(0, lex.n_words + 32, n).astype(np.int32) for n in (1, 90, 33, 7, 200, 64)]
    whole = [net.window(np.r_[net.begin, t[:-1]][:, None], t[:, None], np.arange(len(t))[:, None] == 0, np.zeros((1, 5), np.float32), False)[0].sum() for t in texts]
    for slots, steps in ((1, 8), (2, 32), (6, 7), (3, 500)):
        assert np.allclose(net.walk(texts, False, slots=slots, steps=steps), whole, rtol=1e-4)


def plain(rows, held):
    words = {i: [*[w.decode() for w in (t or "").encode().lower().split()], ""] for i, (_, t) in enumerate(rows)}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in words.values()]


@pytest.mark.parametrize("head", [5, 100000])
def test_counts_and_base_on_hard_rows(spark, head):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"W{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) % 300)) for i in range(80)]
    rows += [(80, None), (81, ""), (82, " \n\t"), (None, "w1 É é"), (3, rows[3][1]), (3, rows[3][1]), (83, "w1 " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS held", "3 AS rid", "4 AS word")
    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    n, want = plain(rows, held)
    got = gru.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, head=head).collect()
    assert {r.train_tokens for r in got} == {n} and len(got) == len(rows)
    a = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got)
    b = sorted((-1 if d is None else d, x, y, round(z, 6), h) for (d, _), (x, y, z), h in zip(rows, want, held))
    assert a == b
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert gru.score(df.where("1 = 0"), F.lit(False)).collect() == []
    none = gru.score(df, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0} and {r.base_score for r in none} == {0.0}


def test_score_beats_the_base_on_held_out_text(spark):
    """Two kinds of text whose words exclude each other: the state must tell them apart."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 40, 120))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = gru.score(df, F.col("doc_id") >= 600).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] - got[0] > 0.15 * got[2]


def test_query_runs_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    n, want = plain(rows, held)
    got = {r.doc_id: r for r in op10_lm_scoring(spark, sf).collect()}
    for (d, _), (x, y, z), h in zip(rows, want, held):
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens, got[d].held_out) == (x, y, n, h)
        assert got[d].base_score == pytest.approx(z, rel=1e-9)
