import numpy as np
import xxhash

from tallyspark.llm import simhash
from tallyspark.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in k]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(ids, fps, budget=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def noisy(rng, n, flips):
    centres = rng.integers(0, 1 << 63, max(2, n // 12), dtype=np.uint64)
    out = set()
    for _ in range(n):
        f = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, flips), replace=False):
            f ^= 1 << int(b)
        out.add(f)
    return np.array(sorted(out), np.uint64)


def test_trie_join_has_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    for leaf, frontier in ((1, 16), (4, 1 << 17)):
        f = noisy(rng, 400, 9)
        found = np.arange(len(f))
        for by, first in ((0, 2), (32, 1)):
            g = (f << np.uint64(by)) | (f >> np.uint64(64 - by)) if by else f
            order = np.argsort(g)
            i, j = simhash.trie_links(g[order], None, 0, first, leaf=leaf, frontier=frontier)
            found = simhash.unite(found, order[i], order[j])
        want = brute_classes(list(range(len(f))), [int(x) for x in f])
        assert found.tolist() == [want[k] for k in range(len(f))]


def test_links_over_many_node_pairs(spark):
    f = noisy(np.random.default_rng(5), 300, 9)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    e = simhash.links(df, subtree=8)
    node = {r.node: r.component for r in components(e, "a", "b").collect()}
    signed = f.view(np.int64).tolist()
    want = brute_classes(signed, [int(x) for x in f])
    assert {x: node.get(x, x) for x in signed} == want


def test_near_duplicates_with_hard_rows(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(5000))
    rows = [(1, "A b c d e f"), (2, "a B c d e f"), (3, None), (4, ""), (5, "\t \n"), (6, "x y"), (6, "x y"), (7, long),
            (8, long + " tail"), (None, "a b c d e f"), (9, "Éa É b"), (10, "x  Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key", "3 AS component_id")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.fingerprint for r in got) == sorted(f"{brute_fingerprint(t):016x}" for _, t in rows)
    of = {r.doc_id: r.component_id for r in got}
    known = [(d, t) for d, t in rows if d is not None]
    assert {k: v for k, v in of.items() if k is not None} == brute_classes([d for d, _ in known], [brute_fingerprint(t) for _, t in known])
    assert of[None] == 1 and of[5] == 3
    assert simhash.near_duplicates(df.where("1 = 0")).collect() == []


def test_query_equals_brute_force(spark):
    from tallyspark.llm.queries import op7_simhash_near_dedup
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_near_dedup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    f = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_classes(list(f), list(f.values()))
    assert got == {d: (f"{f[d]:016x}", want[d]) for d in f}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, 1000 + i) for i in range(200)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), *star[:3]], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{1000 + i: 7 for i in range(200)}}
