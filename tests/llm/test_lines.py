import hashlib

import numpy as np
import pytest

from tallyspark.llm import lines
from tallyspark.llm.queries import op2_line_dedup


def brute(rows, similarity=0.8):
    seen, docs = [], []
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    sets, first = {}, {}
    for none, d, t in order:
        for i, line in enumerate(t.split("\n")):
            norm = line.strip(" ").lower()
            if norm.strip():
                key = (none, d, i, t)
                if norm not in sets:
                    sets[norm] = {norm[k:k + 5] for k in range(len(norm) - 4)} if len(norm) > 5 else {norm}
                first[norm] = min(first.get(norm, key), key)
    names = list(sets)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and len(x & y) >= similarity * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    low = {}
    for n in names:
        low[find(n)] = min(low.get(find(n), first[n]), first[n])
    out = []
    for d, t in rows:
        kept = []
        for i, line in enumerate((t or "").split("\n")):
            norm = line.strip(" ").lower()
            if not norm.strip() or low[find(norm)] == (d is None, d or 0, i, t or ""):
                kept.append(line)
        out.append((-1 if d is None else d, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in lines.deduplicate(df).collect())


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnoprst"), rng.integers(2, 9))) for _ in range(300)]
    base = [list(rng.choice(words, rng.integers(8, 40))) for _ in range(40)]
    rows = []
    for d in range(90):
        out = []
        for _ in range(rng.integers(0, 5)):
            line = list(base[rng.integers(0, 40)])
            if rng.random() < 0.5:
                line[rng.integers(0, len(line))] = rng.choice(words)
            out.append(" ".join(line).capitalize())
        rows.append((int((d * 37) % 90), "\n".join(out)))
    want = brute(rows)
    got = digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)  # banding is of high, not of full recall


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    stem = [f"word{k}" for k in range(30)]
    rows = []
    for d in range(400):
        line = list(stem)
        line[rng.integers(0, 30)] = f"x{d}"
        rows.append((d, " ".join(line)))
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == {0}


def test_hard_rows(spark):
    long = " ".join(f"Item{i}" for i in range(6000))
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "Same line here\n\nother one entirely"), (5, "same LINE here \nfresh words inside"), (5, "same LINE here \nfresh words inside"),
            (None, "same line here"), (6, long), (7, long + "x"), (8, "abc"), (9, "abc\nabd"), (10, "漢字かな交じり文の長い行です" * 4), (11, "漢字かな交じり文の長い行です" * 4 + "。"), (12, "rep eat\nrep eat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS key", "3 AS gone", "4 AS band")
    assert digests(df) == brute(rows)
    got = {r.doc_id: r for r in lines.deduplicate(df, carry=("band",)).collect()}
    assert got[1].text is None and got[1].n_lines == 0 and got[9].text == "abd" and got[12].n_removed == 1 and got[4].band == 4
    assert lines.deduplicate(df.where("1 = 0")).collect() == []


def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch):
    """One band for all lines: similar lines that are neither neighbours nor with the smallest of their bucket."""
    monkeypatch.setattr(lines, "signature", lambda line: lines.F.array(*[lines.F.lit(1).cast("long")] * 4, *[lines.F.xxhash64(line, lines.F.lit(k)) for k in range(12)]))
    monkeypatch.setattr(lines, "GROUPS", [[[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]])
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcdefghijklmnop "), 60)).strip() for _ in range(40)]
    rows = [(d, base[d % 40] + "?!."[d // 40]) for d in range(120)]
    rows = [rows[k] for k in rng.permutation(120)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_parities_bound_the_difference(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in rng.integers(1, 400, 200):
        a = "".join(rng.choice(list("abcde "), n))
        rows.append((a, "".join(c if rng.random() < 0.95 else "x" for c in a)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", lines.parities(df.a).alias("p"), lines.parities(df.b).alias("q")).collect():
        x, y = ({v[i:i + 5] for i in range(len(v) - 4)} if len(v) > 5 else {v} for v in (r.a, r.b))
        assert r.p["size"] == len(x) and sum(((r.p[k] ^ r.q[k]) & (1 << 64) - 1).bit_count() for k in lines.BITS) <= len(x ^ y)


def test_verification_leaves_repeats_to_the_intersection(spark):
    """Lines with repeated shingles are compared as sets, which are not made before the intersection makes them."""
    rows = [(0, "ha ha ha ha ha"), (1, "ha ha ha ha ha ha ha ha"), (2, "ha ha ha hu"), (3, "other words")]
    texts = spark.createDataFrame([(i, len({t[k:k + 5] for k in range(len(t) - 4)}), t) for i, t in rows], "id long, size int, t string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3)], "a long, b long")
    got = lines._verified(pairs, texts, 0.8)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1)]
    assert "array_distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_groups_meet_once():
    seen = [set(g) for groups in lines.GROUPS for g in groups]
    assert all(len(a & b) <= 1 for i, a in enumerate(seen) for b in seen[:i])


def test_short_lines_with_edits_share_a_band(spark):
    """Lines of 1 to 8 words and copies with one other character, similarity 0.8 or more."""
    rng = np.random.default_rng(10)
    letters = list("abcdefghijklmnoprstu")
    pairs = []
    while len(pairs) < 1600:
        n = len(pairs) // 200 + 1
        a = " ".join("".join(rng.choice(letters, rng.integers(3, 25 if n == 1 else 10))) for _ in range(n))
        k = int(rng.choice([rng.integers(0, len(a)), rng.integers(0, 3), len(a) - 1 - rng.integers(0, 3)]))
        b = a[:k] + str(rng.choice(letters)) + a[k + 1:]
        x, y = ({v[i:i + 5] for i in range(max(1, len(v) - 4))} for v in (a, b))
        if a != b and len(x & y) >= 0.8 * len(x | y):
            pairs.append((n, a, b))
    df = spark.createDataFrame(pairs, "n int, a string, b string")
    shared = {n: [] for n in range(1, 9)}
    for r in df.select("n", lines.signature(df.a).alias("x"), lines.signature(df.b).alias("y")).collect():
        shared[r.n].append(any(all(r.x[c] == r.y[c] for c in cells) for groups in lines.GROUPS for cells in groups))
    assert {n: np.mean(v) for n, v in shared.items() if np.mean(v) < 0.95} == {}


def test_long_lines_with_edits_share_a_band(spark):
    """Lines of 52 to 700 characters, both limits of the kinds of bands among them, and copies of similarity 0.8 to 0.84."""
    rng = np.random.default_rng(13)
    letters = list("abcdefghijklmnoprstu    ")
    sets = lambda v: {v[i:i + 5] for i in range(len(v) - 4)}
    rows, sizes = [], [(52, 68), (64, 90), (120, 170), (150, 260), (300, 700)]
    for k in range(5 * 150):
        n = k // 150
        a = "".join(rng.choice(letters, rng.integers(*sizes[n])))
        b = a
        while True:
            at = int(rng.integers(0, len(b)))
            c = b[:at] + "z" + b[at + rng.integers(0, 2):]
            if len(sets(a) & sets(c)) < 0.8 * len(sets(a) | sets(c)):
                break
            b = c
        rows += [(k, n, a), (k, n, b)]
    df = spark.createDataFrame(rows, "k int, n int, norm string")
    shared = {n: [] for n in range(5)}
    for r in lines.signed(df, 0.8).groupBy("k", "n").agg(lines.F.collect_list("bands").alias("b")).collect():
        shared[r.n].append(bool(set(r.b[0]) & set(r.b[1])))
    assert {n: np.mean(v) for n, v in shared.items() if np.mean(v) < 0.95} == {}


def test_lines_of_common_words_are_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(14)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(80)]
    rows = [(d, " ".join(rng.choice(words, 150))) for d in range(80)]
    rows.append((80, rows[7][1] + " z"))
    seen, stored = {}, lines.stored

    def spy(df, name="stage"):
        seen.setdefault(name, out := stored(df, name))
        return out

    monkeypatch.setattr(lines, "stored", spy)
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in got.where("n_removed > 0").collect()] == [80]
    assert seen["members"].select("id").distinct().count() < 50


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.kept_sha256) for r in op2_line_dedup(spark, sf).collect())
    want = brute(rows)
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)
