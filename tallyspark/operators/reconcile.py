"""Measurement availability before zero: key and code audit, area coverage, class pivots, unit reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_codes, is_finite, is_whole, near, sampled_unit, sum_or_missing, surely
from ..functions.states import measurement_reason
from ..settings import DEFAULTS, Settings
from .checks import AuditFailure, gate_unique
from .ordered import exact_quantiles

UNIT = ("plt_cn", "condid")
SLICE = ("plt_cn", "condid", "subp")


def gate_records(records: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> None:
    """Declared keys of all record tables; a duplicated tally group would double count."""
    for label, (df, keys) in records.items():
        gate_unique(df, keys, label)


def checked_records(tallies: DataFrame, conditions: DataFrame, subplot_conditions: DataFrame, species: Sequence, target,
                    classes: Sequence = range(1, 7), sources: Sequence = (1, 2, 3), barred_source=3, largest: int = 999) -> DataFrame:
    """Every tally record with a verdict. Invalid records stay, so they cannot turn into a zero."""
    x = tallies.join(conditions.select(*UNIT, "core_cnd_cn", "cond_status_cd"), list(UNIT), "left").join(
        subplot_conditions.select(*SLICE, "core_scd_cn", "micrcond_prop"), list(SLICE), "left")
    c = F.col
    ok = (in_codes("spcd", species) & in_codes("length_class_cd", classes) & in_codes("seedling_source_cd", sources)
          & ~surely((c("spcd") == target) & (c("seedling_source_cd") == barred_source)) & is_finite("seedlingcount")
          & c("seedlingcount").between(1, largest) & is_whole("seedlingcount") & (c("cnd_cn") == c("core_cnd_cn"))
          & (c("scd_cn") == c("core_scd_cn")) & (c("cond_status_cd") == 1) & is_finite("micrcond_prop")
          & (c("micrcond_prop") > 0) & (c("micrcond_prop") <= 1))
    return x.withColumn("valid_record", surely(ok))


def frame_slices(mapping: DataFrame, subplot_conditions: DataFrame, core_subplots: DataFrame, supplement_subplots: DataFrame) -> DataFrame:
    """Contributing slices of the mapped units with the verdict on each slice."""
    area = mapping.select(*UNIT).join(subplot_conditions.select(*SLICE, "micrcond_prop"), list(UNIT)).where(
        is_finite("micrcond_prop") & (F.col("micrcond_prop") > 0))
    f = area.join(core_subplots.select("plt_cn", "subp", F.col("subplot_cn").alias("core_sbp_cn"), "subp_status_cd"), ["plt_cn", "subp"], "left").join(
        supplement_subplots, ["plt_cn", "subp"], "left")
    ok = (sampled_unit("micro_status", "legacy_status", "nonsample_reason") & F.col("ri_subp_cn").isNotNull()
          & (F.col("sbp_cn") == F.col("core_sbp_cn")) & (F.col("subp_status_cd") == 1) & (F.col("micrcond_prop") <= 1))
    return f.withColumn("slice_valid", surely(ok))


def availability(mapping: DataFrame, frame: DataFrame, subplot_conditions: DataFrame, supplement_plots: DataFrame, checked: DataFrame,
                 season: tuple[int, int] = (5, 9), cfg: Settings = DEFAULTS) -> DataFrame:
    """Is the supplement measured on the whole frame of a unit? First failing screen is the reason."""
    p = F.col("micrcond_prop")
    area = mapping.select(*UNIT).join(subplot_conditions.select(*SLICE, "micrcond_prop"), list(UNIT), "left").groupBy(*UNIT).agg(
        F.count_if(~is_finite("micrcond_prop") | surely((p < 0) | (p > 1))).alias("_bad_area"))
    counts = frame.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("contributing_microplots"), F.count_if("slice_valid").alias("sampled_microplots"),
        (F.sum("micrcond_prop") / 4.0).alias("reconstructed_coverage"), F.bool_and("slice_valid").alias("_all_valid"))
    bad = checked.where(~F.col("valid_record")).select("plt_cn").distinct().withColumn("_bad_plot", F.lit(True))
    has = supplement_plots.select("plt_cn").distinct().withColumn("_has", F.lit(True))
    d = mapping.join(area, list(UNIT), "left").join(counts, list(UNIT), "left").join(bad, "plt_cn", "left").join(has, "plt_cn", "left")
    d = d.select(*mapping.columns, "contributing_microplots", "sampled_microplots", "reconstructed_coverage", "_all_valid", "_bad_area",
                 surely(near("reconstructed_coverage", "coverage", cfg.frame_tolerance)).alias("coverage_matches"),
                 F.coalesce("_has", F.lit(False)).alias("has_record"), F.col("_bad_plot").isNull().alias("records_valid"),
                 surely(F.col("measmon").between(*season)).alias("in_season"))
    d = d.withColumn("frame_valid", surely(F.col("has_record") & F.col("_all_valid") & F.col("coverage_matches") & (F.col("_bad_area") == 0)))
    return d.drop("_all_valid", "_bad_area").select(
        "*", (F.col("frame_valid") & F.col("records_valid") & F.col("in_season")).alias("available"),
        measurement_reason(F.col("has_record"), F.col("frame_valid"), F.col("records_valid"), F.col("in_season")).alias("reason"))


def class_counts(units: DataFrame, checked: DataFrame, target, classes: Sequence[int] = range(1, 7)) -> DataFrame:
    """Class columns and totals per available unit; NULL, not zero, where the frame is not available."""
    n, k = F.col("seedlingcount"), F.col("length_class_cd")
    named: dict[str, Column] = {f"class_{i}": k == i for i in classes}
    named |= {"all_count": F.lit(True), "standard_count": k >= 3, "tall_count": k >= 5, "other_source_count": F.col("seedling_source_cd") == 1,
              "stump_source_count": F.col("seedling_source_cd") == 2}
    got = checked.where(F.col("spcd") == target).groupBy(*UNIT).agg(*[F.sum(F.when(p, n)).alias(x) for x, p in named.items()])
    d = units.join(got, list(UNIT), "left")
    return d.withColumns({x: F.when(F.col("available"), F.coalesce(F.col(x), F.lit(0))) for x in named})


def class_profile(pivoted: DataFrame, classes: Sequence[str], y: str) -> DataFrame:
    """Per class: recorded total, units that carry it and events among them (classes overlap)."""
    rows = F.array(*[F.struct(F.lit(c).alias("size_class"), F.col(c).alias("v")) for c in classes])
    long = pivoted.select(y, F.inline(rows))
    return long.groupBy("size_class").agg(F.sum("v").alias("recorded_count"), F.count_if(F.col("v") > 0).alias("units_with_class"),
                                          F.sum(F.when(F.col("v") > 0, F.col(y))).alias("events_with_class"))


def unit_reconciliation(slices: DataFrame, core: DataFrame, checked: DataFrame, target) -> DataFrame:
    """Slice by slice comparison of both tallies: absent in both is 0, a missing count stays missing."""
    a = core.where(F.col("spcd") == target).groupBy(*SLICE).agg(
        sum_or_missing("treecount").alias("core_count"), F.lit(True).alias("_core"))
    b = checked.where(F.col("spcd") == target).groupBy(*SLICE).agg(
        sum_or_missing("seedlingcount").alias("ri_count"), F.sum(F.when(F.col("length_class_cd") >= 3, F.col("seedlingcount")).otherwise(0)).alias("ri_standard_count"),
        F.lit(True).alias("_ri"))
    d = slices.select(*SLICE).join(a, list(SLICE), "left").join(b, list(SLICE), "left")
    filled = lambda x, flag: F.when(F.col(flag).isNull(), F.lit(0)).otherwise(F.col(x)).cast("long").alias(x)
    d = d.select(*SLICE, filled("core_count", "_core"), filled("ri_count", "_ri"), filled("ri_standard_count", "_ri"))
    return d.withColumn("count_difference", F.col("ri_standard_count") - F.col("core_count"))


def reconciliation_summary(units: DataFrame, label: str) -> DataFrame:
    d = F.col("count_difference")
    return units.agg(F.lit(label).alias("unit"), F.count(F.lit(1)).alias("observations"), F.sum("core_count").alias("ordinary_count"), F.sum("ri_standard_count").alias("standard_count"),
                     F.count_if(d == 0).alias("exact_agreements"), F.count_if(d.isNull()).alias("missing_comparisons"), F.max(F.abs(d)).alias("max_abs_difference"))


def development_split(rows: DataFrame, unit: str, later: Column) -> DataFrame:
    """Label rows for a later-period assessment; development rows never share a unit with it."""
    test = rows.where(later).select(unit).distinct().withColumn("_t", F.lit(True))
    return rows.join(test, unit, "left").withColumn("split", F.when(surely(later), "later").when(F.col("_t").isNull(), "development")).drop("_t")


def split_support(rows: DataFrame, later: Column, unit: str, cluster: str, y: str, year: str, manual: str, interval: str, manual_at_least: float = 9.0) -> DataFrame:
    """What each side of a temporal split holds: rows, events, units, clusters, ranges of years, manuals and intervals, and how many
    units both sides share. All rows count; what a split drops shows as shared units."""
    d = rows.select(surely(later).alias("later"), F.col(unit).alias("u"), F.col(cluster).alias("c"), F.col(y).alias("y"), F.col(year).alias("t"),
                    F.col(manual).cast("double").alias("m"), F.col(interval).cast("double").alias("v"))
    per_unit = d.groupBy("u").agg(F.bool_or("later").alias("a"), F.bool_or(~F.col("later")).alias("b"))
    shared = per_unit.agg(F.count_if(F.col("a") & F.col("b")).alias("units_shared"))
    sides = d.groupBy("later").agg(F.count(F.lit(1)).alias("conditions"), F.sum("y").alias("events"), F.countDistinct("u").alias("units"), F.countDistinct("c").alias("clusters"),
                                   F.min("t").alias("year_min"), F.max("t").alias("year_max"), F.min("m").alias("manual_min"), F.max("m").alias("manual_max"),
                                   F.count_if(F.col("m") >= manual_at_least).alias("late_manual_conditions"), F.min("v").alias("interval_min"), F.max("v").alias("interval_max"))
    middle = exact_quantiles(d, ["later"], "v", {"interval_median": 0.5})
    return sides.join(middle, "later").crossJoin(F.broadcast(shared)).select(F.when(F.col("later"), "Testing").otherwise("Training").alias("split"), "*").drop("later")


# fixed values: the least support of a temporal check, conditions and events of its sides
LEAST_SUPPORT = {"Training": (50, 20), "Testing": (50, 15)}


def gate_split(support: DataFrame, least: Mapping[str, tuple[int, int]] = LEAST_SUPPORT) -> DataFrame:
    """A side with too few conditions or events is an error; a side without any row too."""
    seen = {r["split"]: (r["conditions"], r["events"]) for r in support.select("split", "conditions", "events").collect()}
    short = [f"{side}: {seen.get(side, (0, 0))}" for side, (n, e) in least.items() if seen.get(side, (0, 0))[0] < n or seen.get(side, (0, 0))[1] < e]
    if short:
        raise AuditFailure("too little support for a temporal check, " + "; ".join(short))
    return support


def combined_screens(flags: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [surely(F.col(x)) for x in flags])
