import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid
from tallyspark.llm.queries import op5_language_id


def test_codewords_are_distinct_and_apart():
    for n in (2, 3, 4, 7, 8, 20):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and all(abs(x) < n for x in c.sum(0))
        far = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert far >= c.shape[1] // 4
    assert langid.codewords(1).shape == (1, 0)


def test_features_do_not_cross_rows():
    a = langid.features(pa.array(["abc def", None, "", "éa", "x"]))
    for i, t in enumerate(["abc def", None, "", "éa", "x"]):
        assert np.allclose(a[i], langid.features(pa.array([t], pa.string()))[0])
    assert np.isclose((a[0] ** 2).sum(), 1) and not a[1].any()


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(4)
    m = langid.Model(list("abcd"), code, np.ones(code.shape), np.eye(7, dtype=np.float32)[:, :7], np.zeros(7, np.float32))
    for k in range(4):
        f = 3.0 * code[k:k + 1].astype(np.float32)
        f[0, k] *= -1
        best, top, second = m.decode(f)
        assert best[0] == k and top[0] > second[0]
    best, top, second = m.decode(np.zeros((1, 7), np.float32))
    assert best[0] == 0 and top[0] == pytest.approx(0.25)


def test_held_out_accuracy_and_hard_rows(spark):
    got = op5_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert seen.count() > 100
    assert seen.where("lang = lang_pred").count() / seen.count() > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0
    model = langid.train(docs, F.col("doc_id") % 2 == 0)
    rows = [(None, "the and of that with"), (1, None), (2, ""), (3, "123 --- \n"), (3, "123 --- \n"), (4, "der die und nicht " * 4000)]
    hard = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS __text2", "'x' AS lang_pred")
    out = langid.predict(hard, model).collect()
    assert [r.lang_pred for r in out if r.doc_id in (1, 2, 3)] == ["und"] * 4 and len(out) == 6
    assert {r.lang_pred for r in out if r.doc_id == 4} == {"de"} and {r.lang_pred for r in out if r.doc_id is None} == {"en"}
    assert {r.lang_pred for r in langid.predict(hard, None).collect()} == {"und"}
    assert langid.train(docs.where("1 = 0"), F.lit(True)) is None
    one = langid.train(docs.where("lang = 'fr'"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(hard.where("doc_id = 4"), one).collect()} == {("fr", 1.0)}
