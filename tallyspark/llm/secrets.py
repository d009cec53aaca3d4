"""Secret scan with a random forest that removes false positives, in DataFrame functions and MLlib only.

A candidate is a run of at least 16 letters, digits and ``_+/-`` that holds a digit, or any value of 8 or more characters
assigned to a name that contains one such as password or token. A finding is a (document, value) with its number of occurrences; the context
is that of the first one. Features: length, shares of character kinds, entropy, character transitions, how much of the value
dictionary words cover (words of the corpus itself), its path, and the words before and after it.

The forest learns from labelled findings, on a bounded sample chosen by a hash of the value; labelled findings are passed in
or come from ``format_labels``, which labels only what its format settles. With labels of one kind only, or none, there is
nothing to learn: findings assigned to a secret's name are kept. A null text has no candidates; a null path or key is kept
as it is. Rows that repeat a key and text are scanned as often as they come. An empty table gives an empty result. Values
never leave in the clear: results carry their SHA-256. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

TRAIN_ROWS = 20_000
DICTIONARY = 5_000
TREES = 24
DEPTH = 6

NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
# the name is an identifier that contains one of NAMES; the value is looked at only, as it may hold the next assignment
ASSIGNED = rf"(?i)(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?:{NAMES}))[A-Za-z0-9_.-]++[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?(?=([^\s\"']{{8,}}))"
# fixed values: published key formats, and what is known not to be a secret
POSITIVE = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})$"
NEGATIVE = r"(?i)^(?:[0-9]+|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|.*(?:example|changeme|placeholder|your[_-]).*|(.)\1+|[0-9]{4}-[0-9]{2}-[0-9]{2}.*)$"

FEATURES = ("length", "digit_share", "upper_share", "symbol_share", "entropy", "switches", "vowel_share", "longest_letters", "coverage", "hex", "assigned", "quoted", "named_before",
            "plain_before", "words_after", "path_depth", "path_test", "path_length", "occurrences")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(row, key, path, value, occurrences, before, after): every candidate value of every row with its first context."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    both = F.concat(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(1)))
    found = rows.withColumn("value", F.explode(F.array_distinct(both)))
    at = F.instr("text", F.col("value"))
    return found.select(
        "row", "key", "path", "value",
        ((F.length("text") - F.length(F.replace("text", F.col("value"), F.lit("")))) / F.length("value")).cast("long").alias("occurrences"),
        F.substring("text", F.greatest(at - 60, F.lit(1)), F.least(at - 1, F.lit(60))).alias("before"), F.substring("text", at + F.length("value"), F.lit(40)).alias("after"))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> DataFrame:
    """The ``size`` most frequent words of four or more ASCII letters, counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), "[^a-z]+")).alias("word")).where(F.length("word") >= 4)
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with their features. words: at most DICTIONARY rows, small enough to go to every task."""
    v, size = F.col("value"), F.length("value")
    letters = F.array_distinct(F.split(v, ""))
    share = F.transform(letters, lambda c: (size - F.length(F.replace(v, c, F.lit("")))) / size)
    kinds = "(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
    last = F.lower(F.regexp_extract("before", r"(?s)((?:\S+\s+){0,2}\S*\s*)$", 1))
    cols = {
        "length": size, "digit_share": _count(v, "[0-9]") / size, "upper_share": _count(v, "[A-Z]") / size, "symbol_share": _count(v, "[^A-Za-z0-9]") / size,
        "entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)), "switches": _count(v, kinds) / size, "vowel_share": _count(v, "[aeiouAEIOU]") / size,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), lambda x: F.length(x))), F.lit(0)), "hex": v.rlike("^[0-9a-fA-F]+$").cast("int"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("int"), "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("int"),
        "named_before": last.rlike(NAMES).cast("int"), "plain_before": last.rlike(r"\b(?:sha|commit|hash|checksum|md5|uuid|isbn|phone|card|order|id)\b").cast("int"),
        "words_after": _count(F.col("after"), r"\S+"), "path_depth": F.coalesce(F.size(F.split("path", "/")), F.lit(0)), "path_length": F.coalesce(F.length("path"), F.lit(0)),
        "path_test": F.coalesce(F.lower("path").rlike("test|example|sample|fixture|lock").cast("int"), F.lit(0))}
    df = found.withColumns({k: c.cast("double") for k, c in cols.items()}).withColumn("occurrences", F.col("occurrences").cast("double"))
    pieces = df.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where(F.length("word") >= 4)
    covered = pieces.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return df.join(covered, "value", "left").withColumn("coverage", F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))).drop("covered")


def format_labels(found: DataFrame) -> Column:
    """1.0 for published key formats and for high-entropy values assigned to a secret's name, 0.0 for formats known to be harmless or prose, else null."""
    named = (F.col("named_before") == 1) & (F.col("assigned") == 1) & (F.col("entropy") > 3.0) & (F.col("digit_share") > 0.1)
    prose = (F.col("coverage") > 0.6) | ((F.col("digit_share") < 0.05) & (F.col("vowel_share") > 0.25))
    return F.when(F.col("value").rlike(POSITIVE), 1.0).when(F.col("value").rlike(NEGATIVE) | prose | (F.col("plain_before") == 1), 0.0).when(named, 1.0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, value_sha256, length, occurrences, score, is_secret) of every candidate; labels: (value, label 0/1)."""
    found = with_features(candidates(docs, key, text, path), stored(dictionary(docs, text), "dictionary"))
    found = found.withColumn("label", format_labels(found))
    if labels is not None:
        given = labels.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("given"))
        found = found.join(given, "value", "left").withColumn("label", F.coalesce("given", "label")).drop("given")
    full = stored(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found).select("key", "value", "length", "occurrences", "assigned", "named_before", "label", "features"), "findings")
    known = full.where("label IS NOT NULL")
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if 0 < positive < n:
        unit = F.pmod(F.xxhash64("value", F.lit(5)), F.lit(1 << 30))
        sample = known.where(unit < int((1 << 30) * min(1.0, train_rows / n))).select("features", "label")
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3).fit(sample)
        scored = model.transform(full).withColumn("p", vector_to_array("probability")).withColumn("score", F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)))
    else:
        scored = full.withColumn("score", ((F.col("assigned") == 1) & (F.col("named_before") == 1)).cast("double"))
    return scored.select(F.col("key").alias(key), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.col("length").cast("long").alias("length"),
                         F.col("occurrences").cast("long").alias("occurrences"), "score", (F.col("score") > 0.5).alias("is_secret"))
