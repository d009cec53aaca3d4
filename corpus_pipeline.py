"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and what it keeps are the next one's documents.

Null doc_ids, null texts, very long texts, repeated rows, ties and empty tables pass through every stage by the rules of its
operator; columns beyond those of documents are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, leaks, lines, simhash
from tallyspark.llm.queries import vocabulary_path
from tallyspark.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# languages whose documents go on; None: every learned one
LANGUAGES: tuple[str, ...] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Documents get the language that is predicted from their text; where the prediction is ambiguous, a label they carry stays.
    Documents whose language cannot be told (those without any letter) go, and with ``languages`` those of another language."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, F.col("doc_id").isNotNull())
    told = langid.predict(docs, model, extra=COLUMNS[1:]).where(F.col("lang_pred") != langid.UNKNOWN)
    lang = F.when(F.col("ambiguous") & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col("lang_pred"))
    told = told.withColumn("lang", lang)
    return (told if languages is None else told.where(F.col("lang").isin(*languages))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document has; a document that loses its last word goes with them."""
    kept = lines.deduplicate(docs, carry=COLUMNS[2:])
    whole = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    return kept.where(whole).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows of one doc_id share its fate, and a group
    without any doc_id stays."""
    found = simhash.near_duplicates(docs).where("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)")
    gone = found.select(F.col("doc_id").alias("__id"), "fingerprint").distinct()
    ids = gone.where("__id IS NOT NULL").select("__id").distinct()
    kept = docs.select(*COLUMNS).join(ids, F.col("doc_id") == F.col("__id"), "left_anti")
    # rows without a doc_id cannot be found by it: their fingerprint is taken again
    unknown = gone.where("__id IS NULL").select("fingerprint").distinct()
    if unknown.isEmpty():
        return kept
    fps = simhash.fingerprints(docs.where("doc_id IS NULL").select(F.xxhash64("text").alias("h"), "text"), key="h")
    hashes = fps.select("key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")).join(unknown, "fingerprint", "left_semi").select(F.col("key").alias("__h")).distinct()
    return kept.join(hashes, F.col("doc_id").isNull() & (F.xxhash64("text") == F.col("__h")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    row = F.xxhash64("doc_id", "text")
    found = leaks.find(docs.select(row.alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return docs.select(*COLUMNS).join(found.select("row").distinct(), row == F.col("row"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, their number and the text decoded from them."""
    return bpe.round_trip(docs, vocabulary_path(), extra=("doc_id", "lang", "source"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

# a language model's and a trie join's rows cannot be stated in SQL; tests/llm/test_pipeline.py states the stages plainly
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
