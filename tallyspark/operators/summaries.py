"""Descriptive summaries. Each reduces before it counts distinct units, so no group is gathered whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_midpoint, count_when, recoded, surely, wilson
from .ordered import exact_quantiles, numbered


def zero_bins(df: DataFrame, share: str, density: str, flag: str) -> DataFrame:
    """Counts per share bin among zero-density rows; detected rows stay in the NULL bin."""
    shown = df.where(F.col(share).isNotNull() & F.col(density).isNotNull())
    b = F.when(F.col(density) == 0, F.round(bin_midpoint(share), 6)).alias("share_bin")
    return shown.groupBy(b, F.col(flag)).agg(F.count(F.lit(1)).alias("n"))


def headline(a: DataFrame) -> DataFrame:
    """Single-row key figures of the analysis table."""
    flagged = F.avg(F.col("potential_gap").cast("int").cast("double"))
    one = a.agg(F.count(F.lit(1)).alias("plot_conditions"), F.min("measyear").alias("years_min"),
                F.max("measyear").alias("years_max"), count_when(F.col("seedling_sampled")).alias("seedling_sampled"),
                count_when(F.col("maple_seedling_detected") == 0).alias("zero_maple_seedlings"),
                count_when(F.col("maple_seedling_detected") == 1).alias("maple_seedling_detected"),
                count_when(F.col("potential_gap")).alias("potential_gaps"), flagged.alias("potential_gap_fraction"),
                count_when(F.col("potential_gap_sensitivity")).alias("sensitivity_gaps"),
                F.max("established_threshold").alias("primary_threshold"),
                F.max("sensitivity_threshold").alias("sensitivity_threshold"))
    for key, name in (("plt_cn", "plot_visits"), ("unit", "units")):
        one = one.crossJoin(F.broadcast(a.select(key).distinct().agg(F.count(key).alias(name))))
    return one


def masked_proportions(df: DataFrame, groups: Sequence[str], flag: str, minimum: int) -> DataFrame:
    """Flagged proportion per group with a Wilson interval, hidden below a minimum denominator."""
    g = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("sample_n"), count_when(F.col(flag)).alias("gap_n"),
                                F.count(flag).alias("gap_denominator"))
    g = g.withColumn("w", wilson("gap_n", "gap_denominator")).select(*groups, "sample_n", "gap_n", "gap_denominator", "w.*")
    ok = F.col("gap_denominator") >= minimum
    return g.select("*", ok.alias("supported"), F.when(ok, F.col("estimate")).alias("shown_fraction"))


def protocol_completeness(plots: DataFrame, records: DataFrame, key: str, version: str, fields: Sequence[str],
                          maximum: str) -> DataFrame:
    """Record completeness by protocol version; records are reduced per visit before the join."""
    per = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(maximum).alias("mx"),
                                   *[F.count_if(F.col(f).isNull()).alias(f"m_{f}") for f in fields])
    j = plots.join(per, key, "left")
    return j.groupBy(version).agg(
        F.count(F.lit(1)).alias("visits"), F.coalesce(F.sum("n"), F.lit(0)).alias("record_rows"),
        *[F.coalesce(F.sum(f"m_{f}"), F.lit(0)).alias(f"{f}_missing") for f in fields],
        F.max("mx").alias(f"{maximum}_max"))


def seeded_sample(df: DataFrame, keys: Sequence[str], seed: int, n: int) -> DataFrame:
    """Reproducible sample for hand checks: the n rows with the smallest keyed hash."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *keys).limit(n)


def group_counts(df: DataFrame, by: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Counts of value combinations, missing values forming their own groups."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_of_counts(df: DataFrame, unit: str, name: str, units: str) -> DataFrame:
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(units))


def outcome_strata(df: DataFrame, levels: Sequence[Sequence[str]], outcome: str) -> DataFrame:
    """Outcome counts and fractions by several groupings in one pass; ``stratum`` names the grouping."""
    cols = list(dict.fromkeys(c for level in levels for c in level))
    base = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("e"))
    out = None
    for level in levels:
        part = base.groupBy(*level).agg(F.sum("n").alias("conditions"), F.sum("e").alias("events"))
        part = part.select(F.lit("+".join(level) if level else "all").alias("stratum"),
                           *[F.col(x) if x in level else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in cols],
                           "conditions", "events")
        out = part if out is None else out.unionByName(part)
    f = F.col("events") / F.col("conditions")
    return out.select("*", f.alias("event_fraction"), (F.lit(1.0) - f).alias("no_event_fraction"))


def stratum_profile(df: DataFrame, groups: Sequence[str], outcome: str, measures: Sequence[str]) -> DataFrame:
    """Outcome share of all events plus exact medians and ranges of measures by stratum."""
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("conditions"), F.sum(outcome).alias("events"), F.avg(outcome).alias("event_fraction"),
        *[f(m).alias(f"{n}_{m}") for m in measures for f, n in ((F.min, "min"), (F.max, "max"))])
    total = base.agg(F.sum("events").alias("_all"))
    out = base.crossJoin(F.broadcast(total)).withColumn(
        "fraction_of_all_events", F.try_divide(F.col("events"), F.col("_all"))).drop("_all")
    for m in measures:
        out = out.join(exact_quantiles(df, groups, m, {f"median_{m}": 0.5}), list(groups), "left")
    return out


def transition_counts(df: DataFrame, state: str, within: Column) -> DataFrame:
    """State counts with their share of the starting state (a window over a handful of states)."""
    n = df.where(F.col(state).isNotNull()).groupBy(state).agg(F.count(F.lit(1)).alias("conditions"))
    n = n.withColumn("baseline_state", within)
    w = Window.partitionBy("baseline_state")
    return n.withColumn("baseline_state_total", F.sum("conditions").over(w)).withColumn(
        "fraction_within_state", F.col("conditions") / F.col("baseline_state_total"))


def code_slots(df: DataFrame, keys: Sequence[str], slots: Sequence[str], labels: Mapping, default: str) -> DataFrame:
    """Codes recorded in several slots: units that carry each code and slots that record it."""
    long = df.unpivot(list(keys), list(slots), "slot", "code").where(F.col("code") > 0)
    per_unit = long.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    g = per_unit.groupBy("code").agg(F.count(F.lit(1)).alias("condition_count"), F.sum("n").alias("recorded_slots"))
    return g.withColumn("label", recoded("code", labels, default))


def two_level_mean(df: DataFrame, groups: Sequence[str], period: Column, mean_of: Column, sum_of: Column) -> DataFrame:
    """Mean over periods of within-period means and sums (every period weighs the same)."""
    inner = df.groupBy(*groups, period.alias("period")).agg(
        F.avg(mean_of).alias("m"), F.sum(sum_of).alias("s"), F.count(F.lit(1)).alias("days"))
    return inner.groupBy(*groups).agg(
        F.min("period").alias("start_period"), F.max("period").alias("end_period"), F.count(F.lit(1)).alias("periods"),
        F.avg("m").alias("mean_of_means"), F.avg("s").alias("mean_of_sums"), F.sum("days").alias("records"))


def growth_distribution(df: DataFrame, value: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    base = known.agg(F.count(F.lit(1)).alias("survivors"), F.count_if(F.col(value) == 0).alias("zero_increment"),
                     F.count_if(F.col(value) < 0).alias("negative_increment"))
    return base.crossJoin(exact_quantiles(known, [], value, {"median_increment": 0.5, "p10": 0.1, "p90": 0.9}))


def cohort_support(df: DataFrame, screens: Sequence[tuple[str, Column]], units: Mapping[str, Sequence[str]],
                   outcome: str, totals: Mapping[str, Column], event_units: Mapping[str, Sequence[str]]) -> DataFrame:
    """Support of nested or overlapping cohorts: rows, units, events, units with events, totals."""
    from .checks import flow

    event = surely(F.col(outcome) == 1)
    plain = flow(df, screens, units, {"events": event.cast("int"), **totals})
    if not event_units:
        return plain
    hit = flow(df.where(event), screens, event_units)
    return plain.join(hit.drop("step", "n_rows"), "step_no", "left").na.fill(0, list(event_units))


def range_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min / median / max of several columns, long."""
    out = None
    for x in columns:
        mm = df.agg(F.min(x).cast("double").alias("minimum"), F.max(x).cast("double").alias("maximum"))
        q = exact_quantiles(df.select(F.col(x).cast("double").alias("v")), [], "v", {"median": 0.5})
        row = mm.crossJoin(q).select(F.lit(x).alias("variable"), "minimum", "median", "maximum")
        out = row if out is None else out.unionByName(row)
    return out


def code_changes(df: DataFrame, period: str, code: str) -> DataFrame:
    """(previous_period, current_period, code, change): one row for every code that appears or vanishes between two consecutive
    periods.

    Presence of a code is a set of runs over the numbered periods; a run starts where the period before lacks the code and ends
    where the next one does. The work of a code grows with its own periods, and no list of codes is built.
    """
    seen = df.select(F.col(period).alias("period"), F.col(code).alias("code")).where("period IS NOT NULL").distinct()
    periods = numbered(seen.select("period").distinct(), ["period"], "no")
    ends = periods.agg(F.max("no").alias("last"))
    w = Window.partitionBy("code").orderBy("no")
    runs = seen.join(periods, "period").crossJoin(F.broadcast(ends)).select("code", "no", "last", F.lag("no").over(w).alias("before"), F.lead("no").over(w).alias("after"))
    starts = (F.col("no") > 1) & (F.col("before").isNull() | (F.col("before") < F.col("no") - 1))
    stops = (F.col("no") < F.col("last")) & (F.col("after").isNull() | (F.col("after") > F.col("no") + 1))
    change = F.filter(F.array(F.when(starts, F.struct(F.col("no").alias("current"), F.lit("added").alias("change"))),
                              F.when(stops, F.struct((F.col("no") + 1).alias("current"), F.lit("removed").alias("change")))), lambda x: x.isNotNull())
    each = runs.select("code", F.inline(change))
    p, c = (periods.select(F.col("no").alias(f"{x}_no"), F.col("period").alias(f"{x}_period")) for x in ("previous", "current"))
    return each.join(c, each.current == c.current_no).join(p, each.current - 1 == p.previous_no).select("previous_period", "current_period", "code", "change")


def code_set_changes(df: DataFrame, period: str, code: str) -> DataFrame:
    """The changes of each pair of consecutive periods written as two lists, for a report; ``code_changes`` has them as rows."""
    periods = numbered(df.select(F.col(period).alias("period")).where("period IS NOT NULL").distinct(), ["period"], "no")
    step = periods.join(periods.select((F.col("no") + 1).alias("no"), F.col("period").alias("previous_period")), "no").select("previous_period", F.col("period").alias("current_period"))
    g = code_changes(df, period, code).groupBy("previous_period", "current_period").agg(
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("code")))), ";").alias(f"{kind}_codes") for kind in ("added", "removed")])
    out = step.join(g, ["previous_period", "current_period"], "left")
    return out.select("previous_period", "current_period", *[F.coalesce(f"{kind}_codes", F.lit("")).alias(f"{kind}_codes") for kind in ("added", "removed")])


def total_residuals(df: DataFrame, groups: Sequence[str], total: Column, parts: Sequence[Column],
                    cells: Sequence[Column]) -> DataFrame:
    """How far published totals are from the sum of their parts. Audits, never repairs."""
    diff = total
    for p in parts:
        diff = diff - p
    zero = None
    for x in cells:
        zero = (x == 0) if zero is None else zero & (x == 0)
    d = df.select(*groups, diff.alias("d"), surely(zero).alias("z"))
    return d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("d") != 0).alias("nonzero_differences"),
        F.max(F.abs("d")).alias("max_abs_difference"), F.count_if(F.abs("d") > 1).alias("differences_above_one"),
        F.count_if(F.col("z")).alias("all_zero_rows"))


def group_constancy(df: DataFrame, group: str, level: str, levels: Sequence, constants: Sequence[str]) -> DataFrame:
    """Per group: is every level present exactly once and nothing else, and do constants hold?

    A missing value counts as a value of its own, so a constant that is only sometimes missing varies.
    """
    per_level = df.groupBy(group, level).agg(
        F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{t}_{x}") for x in constants for f, t in ((F.min, "lo"), (F.max, "hi"))],
        *[F.count_if(F.col(x).isNull()).alias(f"z_{x}") for x in constants])
    known = F.col(level).isin(list(levels))
    steady = F.lit(True)
    for x in constants:
        missing = F.sum(f"z_{x}")
        one = (missing == 0) & (F.min(f"lo_{x}") == F.max(f"hi_{x}"))
        steady = steady & surely(one | (missing == F.sum("n")))
    return per_level.groupBy(group).agg(
        F.sum("n").alias("n_rows"),
        ((F.count_if(known) == len(levels)) & (F.count_if(surely(~known) | F.col(level).isNull()) == 0)).alias("levels_complete"),
        F.count_if(F.col("n") > 1).alias("duplicated_levels"), steady.alias("constants_hold"))
