"""Key gates, digests, nested screens and row numbers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks, constraints, ordered, summaries
from tallyspark.operators.checks import AuditFailure
from tallyspark.operators.constraints import Reference, Unique

SCHEMAS = {"plots": "plt long", "subplots": "plt long, subp int", "core": "plt long, subp int", "conditions": "plt long, cond string",
           "areas": "plt long, cond string, subp int", "stems": "cn long, plt long, cond string, subp int, sp int, src int, cls int"}


def tables():
    return {"plots": [(1,), (2,)], "subplots": [(1, 1), (1, 2), (2, 1)], "core": [(1, 1), (1, 2), (2, 1)], "conditions": [(1, "A"), (2, "A"), (2, "B")],
            "areas": [(1, "A", 1), (1, "A", 2), (2, "B", 1)], "stems": [(10, 1, "A", 1, 318, 1, 1), (11, 1, "A", 2, 318, 1, 1), (12, 2, "B", 1, 318, 1, 2)]}


def registry(spark, data):
    d = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    return [Unique("plots", d["plots"], ("plt",)), Unique("subplots", d["subplots"], ("plt", "subp")), Unique("core", d["core"], ("plt", "subp")),
            Unique("conditions", d["conditions"], ("plt", "cond")), Unique("areas", d["areas"], ("plt", "cond", "subp")), Unique("stems", d["stems"], ("cn",)),
            Unique("tally groups", d["stems"], ("plt", "cond", "subp", "sp", "src", "cls")), Reference("stem area", d["stems"], ("plt", "cond", "subp"), d["areas"], ("plt", "cond", "subp")),
            Reference("subplot plot", d["subplots"], ("plt",), d["plots"], ("plt",), optional=True)]


MUTATIONS = [("plots", (1,), "plots"), ("subplots", (1, 2), "subplots"), ("core", (2, 1), "core"), ("conditions", (2, "B"), "conditions"), ("areas", (1, "A", 1), "areas"),
             ("stems", (10, 1, "A", 2, 999, 1, 1), "stems"), ("stems", (13, 1, "A", 1, 318, 1, 1), "tally groups"), ("stems", (14, 9, "A", 1, 318, 1, 1), "stem area"),
             ("stems", (15, None, "A", 1, 318, 1, 1), "stem area"), ("subplots", (7, 1), "subplot plot")]


def test_each_mutation_trips_its_gate_only(spark):
    good = registry(spark, tables())
    assert all(r.passed for r in constraints.key_audit(good).collect())
    constraints.gate_keys(good)
    for table, row, gate in MUTATIONS:
        data = tables()
        data[table].append(row)
        broken = registry(spark, data)
        assert [r.label for r in constraints.key_audit(broken).collect() if not r.passed] == [gate]
        with pytest.raises(AuditFailure, match=gate):
            constraints.gate_keys(broken)
    data = tables()
    data["subplots"].append((None, 1))
    assert all(r.passed for r in constraints.key_audit(registry(spark, data)).collect())  # an optional reference may be missing
    empty = registry(spark, {n: [] for n in SCHEMAS})
    assert [(r.keys, r.passed) for r in constraints.key_audit(empty).collect()] == [(0, True)] * 9


def test_union_is_counted_once(spark):
    plan = constraints.key_counts(registry(spark, tables()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_digests_tell_tables_apart(spark):
    r = random.Random(3)
    rows = [(i, *[r.random() for _ in range(300)]) for i in range(40)]
    kind = "k long, " + ", ".join(f"p{i} double" for i in range(300))
    a = spark.createDataFrame(rows, kind)
    same = spark.createDataFrame(r.sample(rows, 40), kind).repartition(5)
    assert constraints.differing_ranges(a, same, ["k"], 8).isEmpty() and constraints.differences(a, same, ["k"], 8).isEmpty()
    constraints.gate_reproduction(a, same, ["k"])
    changed = [(*x[:150], x[150] + 2.0**-50, *x[151:]) if x[0] == 7 else x for x in rows]
    for other, kind_, key, n in ((changed, "changed", 7, 1), (rows + [rows[4]], "repeated", 4, 2), (rows[:-1], "missing", 39, 0), (rows + [(99, *rows[0][1:])], "added", 99, 1)):
        b = spark.createDataFrame(other, kind)
        assert [(x.k, x.kind, x.n_right) for x in constraints.differences(a, b, ["k"], 8).collect()] == [(key, kind_, n)]
        assert constraints.differing_ranges(a, b, ["k"], 8).count() == 1
        with pytest.raises(AuditFailure, match=kind_):
            constraints.gate_reproduction(a, b, ["k"])
    x = spark.createDataFrame([(1, None, 5)], "k long, a int, b int")
    assert constraints.differences(x, spark.createDataFrame([(1, 5, None)], "k long, a int, b int"), ["k"]).count() == 1
    with pytest.raises(AuditFailure):
        constraints.differing_ranges(x, x.drop("b"), ["k"])


def test_nested_screens(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(12), r.randrange(5), *[r.choice([True, True, True, False, None]) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, u int, v int, a boolean, b boolean, c boolean, d boolean")
    screens = [(x, F.col(x)) for x in "abcd"]
    got = [tuple(x) for x in checks.nested_flow(df, screens, {"us": ["u"], "uvs": ["u", "v"]}).orderBy("step_no").collect()]
    want, left = [], rows
    for i in range(5):
        nxt = [x for x in left if i < 4 and x[3 + i]]
        want.append((i, "Start" if i == 0 else "abcd"[i - 1], len(left), len({x[1] for x in left}), len({x[1:3] for x in left}), len(left) - len(nxt) if i < 4 else 0))
        left = nxt
    assert got == want
    flow = [(x.n_rows, x.us, x.uvs) for x in checks.flow(df, [("a", F.col("a")), ("ab", F.col("a") & F.col("b"))], {"us": ["u"], "uvs": ["u", "v"]}).orderBy("step_no").collect()]
    assert flow == [w[2:5] for w in want[1:3]]
    assert [x.n_rows for x in checks.nested_flow(df.limit(0), screens, {"us": ["u"]}).orderBy("step_no").collect()] == [0] * 5


def test_numbers_without_gaps(spark, sliced):
    r = random.Random(2)
    rows = [(r.choice([None, 5, 5, 5, 5, r.randrange(50)]), r.choice(["a", "b", None, "c"]), r.randrange(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    want = sorted(rows, key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x))
    for parts in (1, 6):
        got = sorted((x.n, (x.a, x.b, x.c)) for x in ordered.numbered(df.repartition(parts), ["a", "b", "c"], "n").collect())
        assert [n for n, _ in got] == list(range(1, 401))
        assert [x for _, x in sorted(((n, x) for n, x in got), key=lambda p: p[0])] == want


def test_code_changes(spark, sliced):
    r = random.Random(8)
    rows = [(f"2001-{p:02d}", f"c{c}") for p in range(1, 13) for c in range(9) if r.random() < 0.5 and p != 6] * 2
    got = {tuple(x) for x in summaries.code_changes(spark.createDataFrame(rows, "p string, c string"), "p", "c").collect()}
    periods = sorted({p for p, _ in rows})
    want = set()
    for a, b in zip(periods, periods[1:]):
        x, y = ({c for p, c in rows if p == q} for q in (a, b))
        want |= {(a, b, c, "added") for c in y - x} | {(a, b, c, "removed") for c in x - y}
    assert got == want
