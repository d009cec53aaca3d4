import hashlib
import re

import numpy as np

from tallyspark.llm import secrets
from tallyspark.llm.queries import op3_secret_scan


def sha(v):
    return hashlib.sha256(v.encode()).hexdigest()


def test_candidates_equal_plain_regex(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op3_secret_scan(spark, sf).collect()
    want = set()
    for r in docs.collect():
        t = r.text or ""
        want |= {(r.doc_id, sha(v)) for v in [*re.findall(secrets.RUN, t), *re.findall(secrets.ASSIGNED, t)]}
    assert {(r.doc_id, r.value_sha256) for r in got} == want and len(got) == len(want)
    tokens = {(r.doc_id, sha(v)) for r in docs.collect() for v in re.findall(r'token = "([0-9a-f]{40})"', r.text or "")}
    kept = {(r.doc_id, r.value_sha256) for r in got if r.is_secret}
    assert tokens and tokens <= kept


def test_values_of_compound_names_are_candidates(spark):
    given = [("DB_PASSWORD=", "abcdefgh"), ("client_secret: ", "Xy.12!ab"), ("user_token = ", "qwertyuiop"), ("secret_key='", "a$b@c!d.e"), ("auth_token=", "k9k9k9k9"), ("password_hash=", "zzyyxxww"),
             ('"app.jwt-secret-v2": "', "short.1value"), ("export AWS_SECRET_ACCESS_KEY=", "a/b!c/d!e"), ("https://x.example?access_token=", "u.v.w.x.y"), ("MyApiKeyName: ", "p@ssw0rd"), ("password: ", "letmein!now")]
    df = spark.createDataFrame([(i, f"so {name}{value}' was set", "a") for i, (name, value) in enumerate(given)] + [(50, "auth_header: token=abcd1efgh", "a"), (51, "monkey=abcdefghij", "a")], "doc_id long, text string, source string")
    got = {(r.key, r.value) for r in secrets.candidates(df).collect()}
    assert {(i, value) for i, (_, value) in enumerate(given)} <= got and (50, "abcd1efgh") in got
    assert not [v for k, v in got if k == 51]


def test_forest_removes_false_positives_it_was_not_given(spark):
    """Labels for one half of the values; the verdicts on the other half are held out."""
    rng = np.random.default_rng(5)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(400)]
    words = [str(w) for w in ["river", "stone", "garden", "window", "market", "yellow", "silver", "bridge"]]
    rows, label, truth = [], [], {}
    for i in range(800):
        secret = i % 2 == 0
        value = hexes[i // 2] if secret else "_".join(rng.choice(words, 4)) + str(rng.integers(10, 99))
        context = f"the key {value} was set" if secret else f"see page {value} for more"
        rows.append((i, " ".join(rng.choice(words, 30)) + " " + context, "src/main"))
        truth[sha(value)] = secret
        if i % 4 < 2:
            label.append((value, int(secret)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(df, labels=spark.createDataFrame(label, "value string, label int")).collect()
    given = {sha(v) for v, _ in label}
    out = [r.is_secret == truth[r.value_sha256] for r in got if r.value_sha256 not in given and r.value_sha256 in truth]
    assert len(out) > 300 and np.mean(out) > 0.95


def test_hard_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "password: hunter2hunter2", "a/test.py"), (None, "token=abcdefgh1234567890ABCD", "a"), (4, "x" * 50000 + "1", "b"), (5, "no candidate", "c"),
            (3, "password: hunter2hunter2", "a/test.py"), (6, "v1234567890123456 and v1234567890123456", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS value", "2 AS label", "3 AS row", "4 AS key")
    got = secrets.scan(df).collect()
    by = {(r.doc_id, r.value_sha256): r for r in got}
    assert len(got) == 5 and by[(6, sha("v1234567890123456"))].occurrences == 2 and by[(4, sha("x" * 50000 + "1"))].length == 50001
    assert (3, sha("hunter2hunter2")) in by and (None, sha("abcdefgh1234567890ABCD")) in by
    assert secrets.scan(df.where("1 = 0")).collect() == []
