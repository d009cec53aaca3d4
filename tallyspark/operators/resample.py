"""Cluster bootstrap by integer multiplicities; rows are never copied, weights are joined to aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

MATRIX_ENTRIES = 1 << 22  # clusters x resamples whose multiplicities are one matrix for all tasks


def cluster_index(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters numbered from 0 in the order of their hashed name.

    The first hex digits of the hash cut the clusters into even slices, so numbering needs no global sort.
    """
    c = df.select(cluster).distinct().withColumn("_h", F.md5(F.col(cluster).cast("string")))
    c = c.withColumn("_part", F.substring("_h", 1, 2))
    sizes = c.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    start = sizes.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_h", cluster))
    return c.withColumn("_r", inside).join(F.broadcast(start), "_part").select(
        cluster, (F.col("_start") + F.col("_r") - 1).alias("cluster_no"))


def draw_number(seed: int, resample: Column, draw: Column, size: int) -> Column:
    """Uniform cluster number from a keyed hash: the same on every engine and every partitioning."""
    key = F.concat_ws("|", F.lit(str(seed)), resample.cast("string"), draw.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(size))


def multiplicities(df: DataFrame, cluster: str, resamples: int, seed: int) -> DataFrame:
    """(resample, cluster, weight): each resample draws as many clusters as there are, with replacement."""
    index = cluster_index(df, cluster)
    size = index.count()
    spark = df.sparkSession
    grid = spark.range(resamples * size).select(F.floor(F.col("id") / size).alias("resample"), (F.col("id") % size).alias("draw"))
    hits = grid.select("resample", draw_number(seed, F.col("resample"), F.col("draw"), size).alias("cluster_no")).groupBy(
        "resample", "cluster_no").agg(F.count(F.lit(1)).alias("weight"))
    return hits.join(index, "cluster_no").select("resample", cluster, "weight")


def vectors(weights: DataFrame, cluster: str, resamples: int) -> DataFrame:
    """(cluster, w): the multiplicities of a cluster in resamples 0 to resamples - 1."""
    entry = F.struct(F.col("resample").cast("int"), F.col("weight"))
    per = weights.groupBy(cluster).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("smallint"))
    return per.select(cluster, each.alias("w"))


def attach(rows: DataFrame, weights: DataFrame, cluster: str, resamples: int) -> tuple[DataFrame, np.ndarray | None]:
    """Rows with the number ``c`` of their cluster, and the matrix (clusters x resamples) whose row that is.

    Beyond MATRIX_ENTRIES rows carry the vector ``w`` of their cluster instead, and there is no matrix.
    """
    table = stored(vectors(weights, cluster, resamples), "vectors")
    if table.count() * resamples > MATRIX_ENTRIES:
        return rows.join(table, cluster), None
    known = table.toArrow().combine_chunks()
    matrix = np.array(known.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int16).reshape(-1, resamples)
    numbers = [(v, i) for i, v in enumerate(known.column(cluster).to_pylist())]
    schema = f"`{cluster}` {table.schema[cluster].dataType.simpleString()}, c int"
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(numbers, schema)), cluster), matrix


def percentile_interval(values: DataFrame, groups: Sequence[str], value: str, resamples: int) -> DataFrame:
    """2.5% and 97.5% points over resamples (at most ``resamples`` values per group); gaps are counted."""
    return values.groupBy(*groups).agg(
        F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper"),
        F.count(value).alias("estimable_resamples")).withColumn("resamples", F.lit(resamples))


def group_intervals(df: DataFrame, group: str, cluster: str, y: str, resamples: int, seed: int) -> DataFrame:
    """Bootstrap interval of a mean per group. Cost is groups x clusters x resamples, not rows x resamples."""
    cell = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("e"))
    point = cell.groupBy(group).agg(F.sum("n").alias("conditions"), F.count(F.lit(1)).alias("clusters"), F.sum("e").alias("events"),
                                    (F.sum("e") / F.sum("n")).alias("event_fraction"))
    w = multiplicities(df, cluster, resamples, seed)
    reps = cell.join(w, cluster).groupBy(group, "resample").agg(
        (F.sum(F.col("weight") * F.col("e")) / F.sum(F.col("weight") * F.col("n"))).alias("p"))
    return point.join(percentile_interval(reps, [group], "p", resamples), group)


def paired_brier_intervals(wide: DataFrame, cluster: str, y: str, pairs: Sequence[tuple[str, str]], resamples: int, seed: int) -> DataFrame:
    """Interval of the Brier difference of fixed predictions (one column per model), from per-cluster sums."""
    d = [F.pow(F.col(y) - F.col(a), F.lit(2.0)) - F.pow(F.col(y) - F.col(b), F.lit(2.0)) for a, b in pairs]
    cell = wide.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"d{i}") for i, x in enumerate(d)])
    long = cell.select(cluster, "n", F.inline(F.array(*[
        F.struct(F.lit(a).alias("model"), F.lit(b).alias("reference"), F.col(f"d{i}").alias("d")) for i, (a, b) in enumerate(pairs)])))
    point = long.groupBy("model", "reference").agg((F.sum("d") / F.sum("n")).alias("brier_difference"))
    w = multiplicities(wide, cluster, resamples, seed)
    reps = long.join(w, cluster).groupBy("model", "reference", "resample").agg(
        (F.sum(F.col("weight") * F.col("d")) / F.sum(F.col("weight") * F.col("n"))).alias("v"))
    return point.join(percentile_interval(reps, ["model", "reference"], "v", resamples), ["model", "reference"])
