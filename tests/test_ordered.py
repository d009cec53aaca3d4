import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ordered


def data(seed=1, n=300):
    rnd = random.Random(seed)
    # a third of the rows share one value
    return [(i, "g" if i % 3 else "h", 0.5 if i % 3 == 1 else round(rnd.random(), 2)) for i in range(n)]


@pytest.mark.parametrize("many", [False, True])
def test_quantiles_match_numpy(spark, request, many):
    if many:
        request.getfixturevalue("sliced")
    rows = data()
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    got = {r.g: r for r in ordered.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 2 / 3}).collect()}
    for g in "gh":
        want = np.quantile([v for _, k, v in rows if k == g], [0.1, 0.5, 2 / 3])
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(list(want))


def test_percent_rank_skips_missing(spark, sliced):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, 2.0), (5, 2.0)], "id int, v double")
    got = {r.id: r.p for r in ordered.with_percent_rank(df, "v", "p").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: pytest.approx(1 / 3), 5: pytest.approx(1 / 3)}
    single = spark.createDataFrame([(1, 3.0)], "id int, v double")
    assert ordered.with_percent_rank(single, "v", "p").first().p is None


def test_positions_and_tiles_with_hot_ties(spark, sliced):
    rows = data(2)
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4)
    got = ordered.with_position(df, ["g"], "v", "id", "pos", "n").withColumn("q", ordered.tile(F.col("pos"), F.col("n"), 4)).collect()
    for g in "gh":
        order = sorted((v, i) for i, k, v in rows if k == g)
        want = {i: p for p, (_, i) in enumerate(order, 1)}
        mine = {r.id: r for r in got if r.g == g}
        assert {i: r.pos for i, r in mine.items()} == want
        n = len(order)
        sizes = [n // 4 + (1 if t < n % 4 else 0) for t in range(4)]
        assert [sum(r.q == t for r in mine.values()) for t in (1, 2, 3, 4)] == sizes


def test_text_order_and_average_rank(spark, sliced):
    names = [f"k{i:03d}" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "k string").withColumn("one", F.lit(1))
    got = {r.k: r.before_one for r in ordered.running_totals(df, [], "k", ["one"]).collect()}
    assert got == {n: i for i, n in enumerate(names)}
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "g string, v double")
    assert sorted(r.r for r in ordered.with_average_rank(d, ["g"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_previous_row_crosses_slices(spark, sliced):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 5}", rnd.randrange(20), i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, d int, id int").repartition(3)
    got = {r.id: r.prev_id for r in ordered.with_previous(df, "k", ["d", "id"], ["id"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ids = [i for _, i in sorted((d, i) for kk, d, i in rows if kk == k)]
        want |= dict(zip(ids, [None, *ids[:-1]]))
    assert got == want


def test_ranks_are_carried_by_the_rows(spark, sliced):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["g", "h", None]), None if i % 11 == 0 else 0.0 if i % 3 else rnd.choice([-1.5, 2.0, float("inf"), float("nan"), rnd.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4).withColumn("_n", F.lit(1))
    got = ordered.with_rank_counts(df, ["g"], "v").collect()
    assert len(got) == 400 and got[0].asDict().keys() >= {"id", "g", "v", "_n", "_before", "_ties", "_total"}
    order = lambda v: (1, 0.0) if v != v else (0, v)
    by = {r.id: r for r in got}
    for i, g, v in rows:
        peers = [order(w) for _, k, w in rows if k == g and w is not None]
        want = (None, None, None) if g is None or v is None else (sum(p < order(v) for p in peers), sum(p == order(v) for p in peers), len(peers))
        assert (by[i]._before, by[i]._ties, by[i]._total) == want
    wide = spark.createDataFrame([(i, (1 << 60) + i % 3) for i in range(60)], "id int, v long")  # beyond what a double tells apart
    assert {(r.v, r._before, r._ties) for r in ordered.with_rank_counts(wide, [], "v").collect()} == {((1 << 60) + k, 20 * k, 20) for k in range(3)}


def test_plans_of_ranks(spark, sliced):
    """No value is joined, nothing is gathered in one partition, no product is formed."""
    df = spark.createDataFrame([(i, 0.0 if i % 3 else i / 7) for i in range(300)], "id int, v double").repartition(4)
    for out in (ordered.with_percent_rank(df, "v", "p"), ordered.with_average_rank(df, [], "v", "p"), ordered.with_position(df, [], "v", "id", "p")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
        assert not any("v#" in part.split("],")[0] for part in plan.split("HashJoin [")[1:])
