"""Balanced assignment of whole groups to folds.

The rule is sequential: groups in descending size (ties by id) go to the fold with the smallest load.
Groups of equal size are interchangeable, so the driver only walks the histogram of sizes and writes,
per size, a few repeating phases; which group takes which turn is decided in Spark by its rank among
groups of its size. The group table itself never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals


def fold_phases(histogram: Sequence[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, int, list[int]]]:
    """(size, events, first rank, length, fold order) for (size, events, groups) in assignment order."""
    load = [[0, 0, 0, f] for f in range(1, k + 1)]
    phases = []
    for size, events, groups in histogram:
        rank = 0
        while groups:
            low = min(x[0] for x in load)
            turn = sorted(x for x in load if x[0] < low + size)
            later = [x[0] for x in load if x[0] >= low + size]
            # whole rounds until the next fold becomes the least loaded one
            rounds = groups // len(turn)
            if later:
                rounds = min(rounds, (min(later) - low) // size)
            picked = turn if rounds else turn[:groups]
            times = rounds or 1
            phases.append((size, events, rank, times * len(picked), [x[3] for x in picked]))
            for x in picked:
                x[0] += size * times
                x[1] += events * times
                x[2] += times
            rank += times * len(picked)
            groups -= times * len(picked)
    return phases


def balanced_folds(df: DataFrame, group: str, k: int = 5, event: str | None = None) -> DataFrame:
    """(group, observations, events, fold). With ``event`` ties in size are ordered by events, then id."""
    e = F.sum(event).cast("long") if event else F.lit(0).cast("long")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("observations"), e.alias("events"))
    hist = sizes.groupBy("observations", "events").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted(((r["observations"], r["events"], r["n"]) for r in hist), key=lambda h: (-h[0], -h[1]))
    k = min(k, sum(h[2] for h in ordered))
    if k < 2:
        raise ValueError("at least two groups are required")
    phases = df.sparkSession.createDataFrame(fold_phases(ordered, k),
                                             "observations long, events long, first long, length long, turn array<int>")
    ranked = running_totals(sizes.withColumn("_one", F.lit(1)), ["observations", "events"], group, ["_one"])
    r = F.col("before__one")
    hit = ranked.join(phases, ["observations", "events"]).where((r >= F.col("first")) & (r < F.col("first") + F.col("length")))
    turn = ((r - F.col("first")) % F.size("turn") + 1).cast("int")
    return hit.select(group, "observations", "events", F.element_at("turn", turn).alias("fold"))


def folds_with_both_classes(df: DataFrame, group: str, y: str, k: int = 5) -> tuple[DataFrame, int]:
    """The largest k for which every fold holds both outcome classes."""
    for n in range(k, 1, -1):
        a = balanced_folds(df, group, n, y)
        per = a.groupBy("fold").agg(F.sum("observations").alias("n"), F.sum("events").alias("e"))
        if per.where((F.col("e") == 0) | (F.col("e") == F.col("n"))).isEmpty():
            return a, n
    raise ValueError("no grouped folds hold both outcome classes")
