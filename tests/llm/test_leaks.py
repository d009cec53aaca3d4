import re

import numpy as np

from tallyspark.llm import leaks
from tallyspark.llm.queries import op9_decontamination


def words(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], prev + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 40)).tolist(), rng.integers(0, 6, rng.integers(0, 70)).tolist()
        assert leaks.common_subsequence(a, b) == lcs(a, b)


def test_latent_space_equals_dense_svd(spark):
    rng = np.random.default_rng(2)
    vocab = [f"t{i}" for i in range(120)]
    texts = [" ".join(rng.choice(vocab, 25)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf = np.random.default_rng(0).random(leaks.SLOTS) + 0.5
    at, v = leaks.latent_space(df, idf, 60, rounds=3)
    import pyarrow as pa
    a = np.zeros((40, len(at)))
    for i, t in enumerate(texts):
        h, _ = leaks.terms(pa.array([t]))
        for s in leaks.slots(h):
            a[i, np.searchsorted(at, s)] += idf[s]
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-6)
    assert np.allclose((a @ v) @ v.T, a, atol=1e-6)  # 40 rows lie in at most 60 directions


def test_planted_passages_and_clean_ones(spark):
    rng = np.random.default_rng(3)
    vocab = np.array([f"word{i}" for i in range(3000)])
    common = np.array(["the", "of", "and", "to", "in"])

    def prose(n):
        return [str(rng.choice(common)) if rng.random() < 0.4 else str(rng.choice(vocab)) for _ in range(n)]

    items = [(i, prose(int(rng.integers(12, 70)))) for i in range(60)]
    rows, want = [], set()
    for d in range(300):
        text = prose(int(rng.integers(0, 400)))
        if d % 3 == 0:
            i, w = items[d % 60]
            w = list(w)
            kind = d % 9
            if kind == 3:  # a paraphrase: a third of the words are others, the answer stays
                for k in rng.choice(len(w) - 4, (len(w) - 4) // 3, replace=False):
                    w[k] = str(rng.choice(vocab))
            if kind == 6:  # words in between and capitals
                w = [x.upper() + "," for k, x in enumerate(w) for x in ([x, "so"] if k % 9 == 8 else [x])]
            cut = int(rng.integers(0, len(text) + 1))
            text = text[:cut] + w + text[cut:]
            want.add((d, i))
        elif d % 3 == 1:  # a shared phrase is no leak
            w = items[d % 60][1][:max(3, len(items[d % 60][1]) // 4)]
            text = text + w + prose(30)
        rows.append((d, " ".join(text)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (900, None), (901, ""), (902, "?!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS share", "3 AS item_id")
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in items], (777, "too short"), (None, "x " * 30), (778, None)], "item_id long, text string").selectExpr("*", "1 AS id")
    for block in (2048, 17):
        got = [(r.doc_id, r.item_id) for r in leaks.find(df, bench, item_block=block).collect()]
        assert len(got) == len(set(got))
        real = {g for g in got if g[0] is not None}
        assert real - want == set() and len(real & want) >= 0.97 * len(want)
        assert any(d is None for d, _ in got)
    assert leaks.find(df, bench.where("1 = 0")).collect() == [] and leaks.find(df.where("1 = 0"), bench).collect() == []


def test_nothing_is_passed_over_that_a_full_search_finds():
    """Paraphrases that keep the common words and the answer; the others become words that no item has and few documents."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(4000)]
    items = [[str(rng.choice(common)) if rng.random() < 0.5 else str(rng.choice(rare)) for _ in range(rng.integers(12, 70))] for _ in range(80)]
    idf = np.full(leaks.SLOTS, 9.0)
    idf[leaks.slots(leaks.terms(pa.array([" ".join(common)]))[0])] = 3.5
    h, first = leaks.terms(pa.array([" ".join(w) for w in items]))
    at, where = np.unique(leaks.slots(h), return_inverse=True)
    a = np.zeros((len(items), len(at)))
    np.add.at(a, (np.repeat(np.arange(len(items)), np.diff(first)), where), idf[leaks.slots(h)])
    index = leaks.Index(list(range(len(items))), [h[x:y] for x, y in zip(first, first[1:])], idf, at, np.linalg.svd(a, full_matrices=False)[2].T)
    texts = []
    for k in range(400):
        w = items[k % 80]
        other = [x if x[0] == "c" or i >= len(w) - 4 or rng.random() < 0.1 * (k // 80) else f"n{rng.integers(1 << 30)}" for i, x in enumerate(w)]
        pad = [f"n{rng.integers(1 << 30)}" for _ in range(120)]
        texts.append(" ".join(pad[:60] + other + pad[60:]))
    texts += ["", "one two three", "c1 " * 200]
    h, first = leaks.terms(pa.array(texts))
    got = index.search(h, first)
    index.lengths = {n: (*v[:3], 0.0, np.unique(h), v[5]) for n, v in index.lengths.items()}  # every passage is open
    assert got == index.search(h, first) and len(got) >= 100


def test_query_equals_brute_force(spark):
    """Every document against every item: the best common subsequence in passages of the item's passage length."""
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, sf).collect()}
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words(r.text)
        for i, x in items:
            if len(set(x) & set(w)) < 0.5 * len(set(x)):
                continue
            n = leaks.passage_length(len(x))
            for a in range(0, max(1, len(w) - n + n // 4), n // 4):
                share = lcs(x, w[max(0, a - n // 4):a + n + n // 4]) / len(x)
                if share >= leaks.VERBATIM:
                    want.add((r.doc_id, i))
    assert want and want <= got and len(got - want) <= 1
