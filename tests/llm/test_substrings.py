import hashlib

import numpy as np
import pytest

from tallyspark.llm import substrings
from tallyspark.llm.queries import SUBSTRING_SQL, op1_substring_dedup


def brute(rows, window):
    low = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            s = tuple(w[i:i + window])
            low[s] = min(low.get(s, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if low[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [3, 4096])
def test_equals_brute_force(spark, hot):
    rng = np.random.default_rng(4)
    passages = [" ".join(rng.choice(list("abcdefgh"), rng.integers(3, 40))) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(list("ijklmnopqé"), rng.integers(0, 30))) for _ in range(rng.integers(0, 6))]
        rows.append((int(d * 7 % 60), "\n".join(parts)))
    rows += [(61, None), (62, ""), (63, rows[0][1]), (63, rows[0][1]), (63, rows[1][1]), (None, rows[0][1]), (64, "a " * 500), (65, "x " + "a " * 300),
             (66, rows[2][1].replace(" ", "\t \x0b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS rid", "3 AS k", "4 AS starts")
    got = substrings.digests(df, window=10, size=3, hot=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 10)
    assert substrings.digests(df.where("1 = 0")).collect() == []


def test_kept_words(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x a b c y")], "doc_id int, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.deduplicate(df, window=3, size=1).collect()}
    assert got == {1: (0, "a b c d"), 2: (3, "x y")}


def test_query_equals_brute_force_and_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op1_substring_dedup(spark, sf).collect())
    assert got == brute(rows, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(SUBSTRING_SQL).fetchall()) == got


def test_packed_strings_leave_in_blocks_of_bounded_size(spark, monkeypatch):
    sizes = np.array([10, 10, 10, 500, 10, 10])
    cuts = substrings._blocks(sizes, 25)
    assert [i for c in cuts for i in range(*c)] == list(range(6)) and all(sizes[i:j].sum() <= 35 or j - i == 1 for i, j in cuts if sizes[i:j].max() < 500)
    assert len(substrings._blocks(np.full(1000, 400), 4000)) == 100
    assert len(cuts) > 2
