"""Exact rank, prefix-sum and quantile work without a one-task window.

A window over a whole table (or over a group that holds a third of it) sorts everything in one task.
Here rows first collapse to distinct values, the value range is cut into slices at approximate
quantiles, and exact prefix sums come from windows inside (group, slice) plus a slice-level offset.
The approximate cut points only steer the partitioning; every result is exact.

Cut points are read by one small aggregate job when an operator is built, so both uses of them in a
plan see the same slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small

MAX_SLICES = 8192
MAX_TEXT_SLICES = 256
ROWS_PER_SLICE = 100_000
_ORDERED = (T.NumericType, T.DateType, T.TimestampType)


def _quantiles(df: DataFrame, column: str) -> list:
    """Approximate quantiles of a column, as many as its row count calls for, with repeats."""
    v = F.col(column).cast("timestamp").cast("double") if column_is_time(df, column) else F.col(column).cast("double")
    n = df.agg(F.count(column).alias("n")).first()["n"]
    slices = min(MAX_SLICES, -(-n // ROWS_PER_SLICE))
    if slices < 2:
        return []
    return sorted(df.agg(F.percentile_approx(v, [i / slices for i in range(1, slices)], max(10_000, 10 * slices)).alias("q")).first()["q"])


def slice_bounds(df: DataFrame, column: str) -> list:
    """Ascending cut points of a column, as many as its row count calls for."""
    if isinstance(df.schema[column].dataType, _ORDERED):
        return sorted(x for x in set(_quantiles(df, column)) if math.isfinite(x))
    # Text keys: the values with the smallest hashes are a uniform sample of the distinct ones.
    keys = df.select(column).where(F.col(column).isNotNull()).distinct()
    sample = keys.orderBy(F.xxhash64(column), column).limit(MAX_TEXT_SLICES * 16).collect()
    values = sorted(r[0] for r in sample)
    full = len(values) == MAX_TEXT_SLICES * 16
    slices = MAX_TEXT_SLICES if full else -(-len(values) // ROWS_PER_SLICE)
    if slices < 2 or not values:
        return []
    return sorted({values[len(values) * i // slices] for i in range(1, slices)})


def column_is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType))


def with_slice(df: DataFrame, column: str, bounds: Sequence, out: str = "_slice") -> DataFrame:
    """Index of the slice that holds each value. Any monotone index serves; numbers use a binary search."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    if isinstance(bounds[0], str):
        def node(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(column) <= F.lit(bounds[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

        return df.withColumn(out, F.coalesce(node(0, len(bounds)), F.lit(0)))
    v = F.col(column).cast("timestamp").cast("double") if column_is_time(df, column) else F.col(column).cast("double")
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_v", outputCol=out, handleInvalid="keep")
    sliced = cut.transform(df.withColumn("_v", v)).drop("_v")
    # a slice is never missing; saying so keeps both uses of the tie table on one exchange
    return sliced.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def running_totals(values: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str],
                   bounds: Sequence | None = None) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``total_<s>`` for rows unique in (groups, order)."""
    bounds = slice_bounds(values, order) if bounds is None else bounds
    groups = list(groups)
    cells = [*groups, "_slice"]
    sliced = with_slice(values, order, bounds)
    inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    per_slice = sliced.groupBy(*cells).agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *cells,
        *[F.coalesce(F.sum(f"_s_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"total_{s}") for s in sums])
    out = local.join(offsets, cells)
    return out.select(*values.columns,
                      *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums],
                      *[f"total_{s}" for s in sums])


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct present values with their counts; hot values shrink to one row map-side."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values with counts below (before_n) and in total (total_n)."""
    present = df.where(F.col(value).isNotNull())
    return running_totals(value_counts(present, groups, value), groups, value, ["n"],
                          slice_bounds(present, value))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float], median_unbiased: bool = False) -> DataFrame:
    """Linearly interpolated (type 7) quantiles per group, one column per named probability; type 8 if median_unbiased."""
    r = ranked_values(df, groups, value)
    aggs = []
    for name, p in probs.items():
        h = (F.col("total_n") - 1) * F.lit(float(p))
        if median_unbiased:
            h = F.least(F.greatest((F.col("total_n") + 1 / 3) * F.lit(float(p)) - 2 / 3, F.lit(0.0)), (F.col("total_n") - 1).cast("double"))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("before_n") <= pos) & (pos < F.col("before_n") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_w_{name}"))
    got = r.groupBy(*groups).agg(*aggs)
    return got.select(*groups, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs])


def _sliced_rows(df: DataFrame, value: str) -> tuple[DataFrame, list[int]]:
    """Rows with the slice of their value, and the slices that hold one value alone.

    A value that fills more than a slice is a repeated quantile, so there are fewer such values than slices; each gets a slice of
    its own, in which no order is needed.
    """
    if not isinstance(df.schema[value].dataType, _ORDERED):
        return with_slice(df, value, slice_bounds(df, value)), []
    q = _quantiles(df, value)
    q = [x for x in q if math.isfinite(x)]
    hot = {x for x, y in zip(q, q[1:]) if x == y and abs(x) < 2**53}
    bounds = sorted(set(q) | {math.nextafter(x, math.inf) for x in hot})
    return with_slice(df, value, bounds), [bounds.index(x) + 1 for x in sorted(hot)]


def _slice_offsets(sliced: DataFrame, groups: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """(groups, cells, __n, __before, __total): rows of each cell, of the cells before it, and of its group.

    Without groups the cells are read once, a bounded number of counts; with groups each group sums its own.
    """
    per = sliced.groupBy(*groups, *cells).agg(F.count(F.lit(1)).alias("__n"))
    if groups:
        whole = Window.partitionBy(*groups)
        earlier = whole.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
        return per.select(*groups, *cells, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__total"))
    rows = sorted(tuple(r) for r in per.collect())
    total, before, out = sum(r[-1] for r in rows), 0, []
    for r in rows:
        out.append((*r, before, total))
        before += r[-1]
    return F.broadcast(sliced.sparkSession.createDataFrame(out, ", ".join(f"{c} int" for c in cells) + ", __n long, __before long, __total long"))


def with_rank_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add ``_before`` (rows of the group with a smaller value), ``_ties`` and ``_total``; NULL for missing values.

    The rank is carried by the row: rows are ordered inside (group, slice) and take the slice's offset, so no join meets the value
    itself. Rows of a value that fills slices are not ordered at all, and missing values are not exchanged.
    """
    groups = list(groups)
    s, alone = _sliced_rows(df.where(F.col(value).isNotNull()), value)
    offsets = _slice_offsets(s, groups, ["_slice"])
    names = [*groups, "_slice"]
    hot = F.col("_slice").isin(alone) if alone else F.lit(False)
    inside = Window.partitionBy(*names)
    # rows missing a group have no rank, as NULL is no group
    cold = s.where(~hot).select("*", (F.rank().over(inside.orderBy(value)) - 1).alias("__r"), F.count(F.lit(1)).over(Window.partitionBy(*names, value)).alias("__t"))
    out = [cold.join(offsets, names, "left").select(*df.columns, (F.col("__before") + F.col("__r")).alias("_before"), F.when(F.col("__before").isNotNull(), F.col("__t")).alias("_ties"), F.col("__total").alias("_total"))]
    if alone:
        out.append(s.where(hot).join(offsets, names, "left").select(*df.columns, F.col("__before").alias("_before"), F.col("__n").alias("_ties"), F.col("__total").alias("_total")))
    none = F.lit(None).cast("long")
    out.append(df.where(F.col(value).isNull()).select(*df.columns, none.alias("_before"), none.alias("_ties"), none.alias("_total")))
    return reduce(DataFrame.unionAll, out)


def with_percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percent rank among present values; NULL for missing values or fewer than two of them."""
    r = with_rank_counts(df, [], value)
    return r.select(*df.columns, F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).alias(out))


def with_average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank with ties sharing their mean position."""
    return with_rank_counts(df, groups, value).select(*df.columns, (F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(out))


def with_position(df: DataFrame, groups: Sequence[str], value: str, key: str, out: str,
                  total: str | None = None) -> DataFrame:
    """1-based position by (value, key) within each group, key unique inside a tie; rows without a value have none and go.

    Rows are numbered inside (group, slice of the value) and take the slice's offset. A value that fills slices is cut by key, so a
    tie that holds a third of the rows spreads out too; no join meets the value itself.
    """
    groups = list(groups)
    s, alone = _sliced_rows(df.where(F.col(value).isNotNull()), value)
    hot = F.col("_slice").isin(alone) if alone else F.lit(False)
    s = with_slice(s, key, slice_bounds(s.where(hot), key) if alone else [], "_part")
    s = s.withColumn("_part", F.when(hot, F.col("_part")).otherwise(0))
    cells = ["_slice", "_part"]
    placed = s.withColumn("__r", F.row_number().over(Window.partitionBy(*groups, *cells).orderBy(value, key)))
    placed = placed.join(_slice_offsets(s, groups, cells), [*groups, *cells])
    return placed.select(*df.columns, (F.col("__before") + F.col("__r")).alias(out), *([F.col("__total").alias(total)] if total else []))


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Rows numbered from 1 without gaps in the order of the given columns, missing values first.

    Two passes: rows are counted by slice of the first column, and numbered inside their slice from its offset. A first value that
    fills slices, or is missing, is cut by the second column. Repeatable on any partitioning; equal rows may swap their numbers.
    """
    s, alone = _sliced_rows(df, order[0])
    s = s.withColumn("_slice", F.when(F.col(order[0]).isNull(), -1).otherwise(F.col("_slice")))
    hot = F.col("_slice").isin([-1, *alone])
    rest = list(order[1:]) or [order[0]]
    s = with_slice(s, rest[0], slice_bounds(s.where(hot), rest[0]), "_part")
    s = s.withColumn("_part", F.when(hot, F.col("_part")).otherwise(0))
    cells = ["_slice", "_part"]
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    placed = s.withColumn("__r", F.row_number().over(Window.partitionBy(*cells).orderBy(*order, tie)))
    return placed.join(_slice_offsets(s, [], cells), cells).select(*df.columns, (F.col("__before") + F.col("__r")).alias(out))


def tile(position: Column, total: Column, tiles: int) -> Column:
    """Equal-count bucket of a 1-based position, the first buckets taking the remainder."""
    base = F.floor(total / tiles)
    extra = total - base * tiles
    big = extra * (base + 1)
    return F.when(position <= big, F.floor((position - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((position - 1 - big) / F.greatest(base, F.lit(1))) + 1).cast("int")


def with_previous(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>``: the preceding row of the same key in the given order.

    Rows are linked inside (key, slice of the first order column); the first row of a slice takes the last
    row of the slice before it, found on a table with one row per (key, slice). A key with a third of all
    rows is spread over the slices.
    """
    seq = [F.col(o) for o in order]
    sliced = with_slice(df, order[0], slice_bounds(df, order[0]))
    inside = Window.partitionBy(key, "_slice").orderBy(*seq)
    packed = F.struct(*carry)
    first = sliced.select("*", F.lag(packed).over(inside).alias("_in"))
    last = sliced.groupBy(key, "_slice").agg(F.max_by(packed, F.struct(*seq)).alias("_last"))
    before = last.select(key, "_slice", F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_prior"))
    joined = first.join(before, [key, "_slice"])
    prev = F.coalesce(F.col("_in"), F.col("_prior"))
    return joined.select(*df.columns, *[prev[x].alias(f"prev_{x}") for x in carry])


def with_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach a one-row table of cut points to every row."""
    return df.crossJoin(broadcast_if_small(thresholds, 1))
