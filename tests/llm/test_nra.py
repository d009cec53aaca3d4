import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import nra
from tallyspark.llm.queries import TOP_K_SQL, op6_exact_top_k


def brute(ids, x, k, is_query):
    out = []
    for i in sorted({d for d in ids if is_query(d)}):
        q = min(tuple(v) for d, v in zip(ids, x) if d == i)
        s = sorted((-int(np.dot(q, v)), d) for d, v in zip(ids, x) if d != i and len(v) == len(q))
        out += [(i, r + 1, d, -n) for r, (n, d) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(-40, 40, (6, 8))
    x = (centres[rng.integers(0, 6, 500)] + rng.integers(-3, 4, (500, 8))).tolist()
    x[7] = [0] * 8
    x += x[:40]  # repeated rows and ties
    ids = [*range(500), *range(40)]
    x.append([1, 2, 3])
    ids.append(1000)
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, v array<long>").selectExpr("*", "1 AS id", "2 AS query_id", "3 AS q")
    got = sorted(tuple(r) for r in nra.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=block, query_block=9).collect())
    assert got == brute(ids, x, 7, lambda d: d % 20 == 0)


def test_lists_are_not_read_to_the_end():
    rng = np.random.default_rng(2)
    x = rng.integers(-8, 9, (2000, 16))
    q = rng.integers(-8, 9, (10, 16)) * 3
    full = np.sort(x @ q.T, 0)[-5:]
    bar = full[0].astype(float)
    qn, cn, score = nra.search_block(x, np.arange(2000), q, np.arange(10) + 5000, bar, 5)
    assert (score >= 0).any() and len(qn) < 2000 * 10 // 4
    for i in range(10):
        assert sorted(score[qn == i])[-5:] == full[:, i].tolist()


def test_large_values_and_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (None, [1.0, 1.0]), (80, [None, 1.0]), (1, [1e6, -1e6]), (2, [-0.001, 3.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", nra.whole("e").alias("v"))
    got = sorted(tuple(r) for r in nra.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 64 * -1 + 128 * 192), (0, 2, 1, 64 * 64000000 - 128 * 64000000)]
    assert nra.top_k(df.where("1 = 0"), F.lit(True)).collect() == []


def test_query_equals_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op6_exact_top_k(spark, sf).collect()) == sorted(con.execute(TOP_K_SQL).fetchall())
