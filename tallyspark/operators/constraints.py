"""Key constraints of many tables in one pass, and digests that tell where two tables differ."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import AuditFailure


@dataclass(frozen=True)
class Unique:
    """No two rows of a table share a key; a missing part of a key is a value like any other."""

    label: str
    table: DataFrame
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Every key of a table exists in its parent. A missing key has no parent, unless it may be missing."""

    label: str
    table: DataFrame
    keys: tuple[str, ...]
    parent: DataFrame
    parent_keys: tuple[str, ...]
    optional: bool = False


def _key(keys: Sequence[str]) -> Column:
    """The key as one string, with missing parts kept apart from empty ones."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def key_counts(constraints: Sequence[Unique | Reference]) -> DataFrame:
    """(constraint, key, owners, users) of all constraints, from one tagged union that is counted once.

    Keys are counted in the tasks before they are exchanged, so a frequent foreign key is one row a task.
    """
    parts = []
    for i, c in enumerate(constraints):
        if isinstance(c, Unique):
            parts.append(c.table.select(F.lit(i).alias("constraint"), _key(c.keys).alias("key"), F.lit(1).alias("own"), F.lit(0).alias("use")))
            continue
        child = c.table
        if c.optional:
            child = child.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in c.keys]))
        parts.append(child.select(F.lit(i).alias("constraint"), _key(c.keys).alias("key"), F.lit(0).alias("own"), F.lit(1).alias("use")))
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in c.parent_keys])
        parts.append(c.parent.where(known).select(F.lit(i).alias("constraint"), _key(c.parent_keys).alias("key"), F.lit(1).alias("own"), F.lit(0).alias("use")))
    rows = reduce(DataFrame.unionAll, parts)
    return rows.groupBy("constraint", "key").agg(F.sum("own").alias("owners"), F.sum("use").alias("users"))


def _broken(constraints: Sequence[Unique | Reference]) -> Column:
    unique = [i for i, c in enumerate(constraints) if isinstance(c, Unique)]
    return F.when(F.col("constraint").isin(unique), F.col("owners") > 1).otherwise((F.col("users") > 0) & (F.col("owners") == 0))


def key_audit(constraints: Sequence[Unique | Reference]) -> DataFrame:
    """One row a constraint: keys, keys that break it, rows with such keys, and whether it holds. Empty tables hold."""
    counts = key_counts(constraints).withColumn("broken", _broken(constraints))
    bad = F.when(F.col("broken"), F.col("owners") + F.col("users"))
    per = counts.groupBy("constraint").agg(F.count(F.lit(1)).alias("keys"), F.count_if("broken").alias("broken_keys"), F.coalesce(F.sum(bad), F.lit(0)).alias("broken_rows"))
    spark = constraints[0].table.sparkSession
    names = spark.createDataFrame([(i, c.label, type(c).__name__.lower()) for i, c in enumerate(constraints)], "constraint int, label string, kind string")
    out = names.join(per, "constraint", "left")
    return out.select("constraint", "label", "kind", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("keys", "broken_keys", "broken_rows")]).withColumn("passed", F.col("broken_keys") == 0)


def offending_keys(constraints: Sequence[Unique | Reference]) -> DataFrame:
    """(label, key, owners, users) of every key that breaks a constraint."""
    label = F.element_at(F.array(*[F.lit(c.label) for c in constraints]), F.col("constraint") + 1)
    return key_counts(constraints).where(_broken(constraints)).select(label.alias("label"), "key", "owners", "users")


def gate_keys(constraints: Sequence[Unique | Reference]) -> None:
    """Any broken constraint is an error that names it with one of its keys."""
    bad = offending_keys(constraints).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example")).collect()  # a row a constraint
    if bad:
        raise AuditFailure("; ".join(f"{r.label}: {r.n} keys, for example {r.example}" for r in sorted(bad)))


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a whole row; a missing value is told from every present one."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def table_digest(df: DataFrame, keys: Sequence[str], ranges: int = 256) -> DataFrame:
    """(range, n, d1, d2): an order-free digest of the rows of each range of keys. Repeated rows count as often as they occur."""
    columns = sorted(df.columns)
    h1, h2 = _row_hashes(columns)
    at = F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")
    rows = df.select(at.alias("range"), h1.alias("h1"), h2.alias("h2"))
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"h{i}").cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 2)])


def differing_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], ranges: int = 256) -> DataFrame:
    """The ranges of keys whose digests differ; empty for equal tables in any order."""
    if sorted(left.columns) != sorted(right.columns):
        raise AuditFailure("tables have different columns")
    a, b = table_digest(left, keys, ranges), table_digest(right, keys, ranges).toDF("range", "n_right", "e1", "e2")
    both = a.withColumnRenamed("n", "n_left").join(b, "range", "full")
    same = (F.col("n_left") == F.col("n_right")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    return both.where(~F.coalesce(same, F.lit(False))).select("range", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_left", "n_right")])


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], ranges: int = 256) -> DataFrame:
    """(keys, kind, n_left, n_right) of every key whose rows differ: ``missing``, ``added``, ``repeated`` (the same rows, another
    number of times) or ``changed``. Only the ranges whose digests differ are compared."""
    wrong = [r["range"] for r in differing_ranges(left, right, keys, ranges).select("range").collect()]  # at most ``ranges`` numbers
    at = F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")

    def rows(df: DataFrame, side: str) -> DataFrame:
        h1, h2 = _row_hashes(sorted(df.columns))
        own = F.lit(1 if side == "left" else 0)
        return df.where(at.isin(wrong) if wrong else F.lit(False)).select(*keys, h1.alias("h1"), h2.alias("h2"), own.alias("l"), (1 - own).alias("r"))

    per_row = rows(left, "left").unionAll(rows(right, "right")).groupBy(*keys, "h1", "h2").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    per_key = per_row.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.bool_or(F.col("l") != F.col("r")).alias("apart"),
                                         F.bool_and((F.col("l") > 0) & (F.col("r") > 0)).alias("same_rows"))
    kind = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "added").when(F.col("same_rows"), "repeated").otherwise("changed")
    return per_key.where("apart").select(*keys, kind.alias("kind"), "n_left", "n_right")


def gate_reproduction(left: DataFrame, right: DataFrame, keys: Sequence[str], ranges: int = 256) -> None:
    """Two tables must hold the same rows, bit for bit."""
    bad = differences(left, right, keys, ranges).groupBy("kind").count().collect()
    if bad:
        raise AuditFailure("tables differ: " + ", ".join(f"{r['count']} keys {r['kind']}" for r in sorted(bad)))
