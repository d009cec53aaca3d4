"""URL filter: list rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs, those a rule decides (block = 1), on a bounded sample chosen by a hash of the URL; the
suffix statistics they use count all labelled URLs. A URL that is null or has no ``://`` has an empty host and path, fits no
rule, and is judged by the trees like any other. With labels of one kind only, or none, there is nothing to learn: the rest
gets that kind's verdict, or allow. Repeated rows are judged alike; an empty table gives an empty result. Only the key and
URL columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

TRAIN_ROWS = 20_000
ROUNDS = 20
DEPTH = 4
PRIOR = 20.0  # rows of the average that a suffix's block rate is smoothed with

# (verdict, rule): a host with the first path characters
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_share", "host_digits", "hyphens", "entropy", "parameters", "query_length",
            "fragment", "secure", "last_segment", "suffix_rate", "domain_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Numeric features of (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    share = F.transform(letters, lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    cols = {
        "url_length": size, "host_length": F.length("host"), "path_length": F.length("path"), "depth": F.size(F.split("path", "/")) - 1,
        "host_labels": F.size(F.split("host", r"\.")), "digit_share": F.when(size > 0, digits(url) / size).otherwise(0.0), "host_digits": digits(F.col("host")),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")), "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "fragment": F.when(F.instr(url, "#") > 0, 1).otherwise(0), "secure": F.when(url.startswith("https://"), 1).otherwise(0),
        "last_segment": F.length(F.substring_index("path", "/", -1))}
    return df.withColumns({k: v.cast("double") for k, v in cols.items()}).withColumns(
        {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def with_rates(df: DataFrame, rates: dict[str, DataFrame], overall: float) -> DataFrame:
    """Smoothed block rates of the suffix and the domain; unseen ones get the overall rate."""
    for name, table in rates.items():
        df = df.join(table, name, "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(overall)))
    return df


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) of every row; block_score is the trees' probability of block."""
    base = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = stored(lexical(base.withColumns({"rule": rule, "decided": verdict})), "urls")
    label = F.when(F.col("decided") == "block", 1.0).otherwise(0.0)
    known = rows.where("decided IS NOT NULL").withColumn("label", label)
    n, blocked = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    out = ("key", "host", "path", "rule")
    names = (key, "host", "path", "rule", "verdict", "block_score")
    if not n or blocked in (0.0, float(n)):
        rest = "block" if n and blocked else "allow"
        return rows.select(*out, F.coalesce("decided", F.lit(rest)), F.lit(1.0 if rest == "block" else 0.0)).toDF(*names)
    overall = blocked / n
    rates = {}
    for name in ("suffix", "domain"):
        counts = known.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b"))
        rates[name] = counts.select(name, ((F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)).alias(f"{name}_rate"))
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_rates(rows, rates, overall))
    full = stored(full.select(*out, "url", "decided", "features"), "features")
    unit = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 30))
    sample = full.where(F.col("decided").isNotNull() & (unit < int((1 << 30) * min(1.0, train_rows / n)))).select("features", label.alias("label"))
    model: GBTClassificationModel = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=3, cacheNodeIds=False).fit(sample)
    score = model.transform(full).withColumn("p", vector_to_array("probability")[1])
    return score.select(*out, F.coalesce("decided", F.when(F.col("p") > 0.5, "block").otherwise("allow")), "p").toDF(*names)
