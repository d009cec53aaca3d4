"""Linking repeated visits of the same units through weighted many-to-many slice links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import elapsed_years, excess, in_codes, is_finite, joined_key, ratio, surely, with_role
from ..functions.states import outcome_where, transition
from ..settings import DEFAULTS, Settings
from .measures import UNIT, stem_metrics, tally_metrics, target_metrics

SHARE_DIGITS = 12
BASELINE = ("baseline_plt_cn", "baseline_condid")
CURRENT = ("current_plt_cn", "current_condid")
PAIR = (*BASELINE, *CURRENT)
ROLE_KEYS = {"baseline": dict(zip(UNIT, BASELINE)), "followup": dict(zip(UNIT, CURRENT))}


def overlap(matrix: DataFrame, weight: str = "prop_change", slice_key: str = "subp", slices: int = 4) -> DataFrame:
    """Shared footprint of every linked pair: mean positive weight over the fixed number of slices."""
    return matrix.where(F.col(weight) > 0).groupBy(*PAIR).agg(
        (F.sum(weight) / float(slices)).alias("overlap_prop"), F.countDistinct(slice_key).alias("linked_microplots"))


def with_degrees(pairs: DataFrame) -> DataFrame:
    """Number of partners on both sides; degree 1 on both is a strict one-to-one link."""
    b = pairs.groupBy(*BASELINE).agg(F.count(F.lit(1)).alias("baseline_pair_degree"))
    c = pairs.groupBy(*CURRENT).agg(F.count(F.lit(1)).alias("current_pair_degree"))
    return pairs.join(b, list(BASELINE)).join(c, list(CURRENT)).withColumn(
        "strict_one_to_one", (F.col("baseline_pair_degree") == 1) & (F.col("current_pair_degree") == 1))


def pair_candidates(matrix: DataFrame, visits: DataFrame, conditions: DataFrame,
                    scope: Column | None = None, strict: bool = False) -> DataFrame:
    """Linked condition pairs with the attributes of both visits.

    ``scope`` restricts the links (one evaluation, a protocol range); None keeps all history.
    Unmatched references stay as NULL attributes so that the mapping audit can count them. With ``strict`` only one-to-one pairs
    get their attributes; the degrees still count every link.
    """
    pairs = with_degrees(overlap(matrix if scope is None else matrix.where(scope)))
    if strict:
        pairs = pairs.where("strict_one_to_one")
    out = pairs
    for role, plt in (("baseline", "baseline_plt_cn"), ("followup", "current_plt_cn")):
        v = visits if role == "followup" else visits.drop("prev_plt_cn", "unit")
        v = with_role(v, role, {"plt_cn": plt})
        if role == "followup":
            v = v.withColumnsRenamed({"followup_prev_plt_cn": "plot_declared_prev_plt_cn", "followup_unit": "physical_plot_key"})
        out = out.join(v, plt, "left").join(with_role(conditions, role, ROLE_KEYS[role]), list(ROLE_KEYS[role].values()), "left")
    return out.select(
        "*",
        elapsed_years("baseline_measyear", "baseline_measmon", "followup_measyear", "followup_measmon").alias("interval_years"),
        ratio("overlap_prop", "baseline_micrprop_unadj").alias("baseline_overlap_fraction"),
        ratio("overlap_prop", "followup_micrprop_unadj").alias("followup_overlap_fraction"),
        (F.col("baseline_plt_cn") == F.col("plot_declared_prev_plt_cn")).alias("plot_prev_link_matches"),
        joined_key("baseline_plt_cn", "baseline_condid", sep=":").alias("baseline_condition_key"))


def visit_universe(pairs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Every (visit, condition) of either role once, with its attributes."""
    def role(keys, prefix):
        return pairs.select(*[F.col(k).alias(u) for k, u in zip(keys, UNIT)],
                            *[F.col(f"{prefix}_{a}").alias(a) for a in attributes])

    both = role(BASELINE, "baseline").unionByName(role(CURRENT, "followup"))
    return both.groupBy(*UNIT).agg(F.min(F.struct(*attributes)).alias("s")).select(*UNIT, "s.*")


def records_of(records: DataFrame, universe: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Stem or tally records on the units of a universe."""
    return records.join(universe.select(*UNIT, *carry), list(UNIT))


def attach(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """N:1 left joins of unit metrics for both roles."""
    out = pairs
    for role, keys in ROLE_KEYS.items():
        out = out.join(with_role(metrics, role, keys), list(keys.values()), "left")
    return out


def unit_measures(pairs: DataFrame, stems: DataFrame, tallies: DataFrame, target, second_species,
                  coverage: str = "micrprop_unadj", cfg: Settings = DEFAULTS) -> DataFrame:
    """Every measure of every visited unit of either role, one row per (visit, condition)."""
    wanted = list(dict.fromkeys(["micrprop_unadj", "subpprop_unadj", "macrprop_unadj", "macro_breakpoint_dia", coverage]))
    universe = visit_universe(pairs, wanted)
    live = records_of(stems, universe, ["macro_breakpoint_dia"])
    sm = stem_metrics(live, universe, target, cfg=cfg)
    second = target_metrics(live, universe, second_species, "beech", cfg=cfg)
    tm = tally_metrics(records_of(tallies, universe), universe, target, coverage=coverage).drop(coverage)
    return second.join(sm, list(UNIT), "left").join(tm, list(UNIT), "left")


def overlap_adequate(cfg: Settings = DEFAULTS) -> Column:
    """Enough of both frames is shared. Shares are sums of slices, whose order of addition must not decide one that is exactly the limit."""
    shared = [F.round(f"{role}_overlap_fraction", SHARE_DIGITS) >= cfg.minimum_overlap for role in ROLE_KEYS]
    return shared[0] & shared[1]


def longitudinal_analysis(pairs: DataFrame, unit: DataFrame, forest_codes: Sequence,
                          cfg: Settings = DEFAULTS) -> DataFrame:
    """Both visits' measures, the eligibility gates and the before/after outcomes of every linked pair.

    ``unit`` is the output of ``unit_measures``; one row per unit, so each role needs a single join.
    """
    a = attach(pairs, unit)
    sampled = lambda role: ((F.col(f"{role}_plot_status_cd") == 1) & (F.col(f"{role}_cond_status_cd") == 1)
                            & surely(F.col(f"{role}_micrprop_unadj") > 0))
    a = a.select(
        "*", in_codes("baseline_fortypcd", forest_codes).alias("baseline_in_group"),
        in_codes("followup_fortypcd", forest_codes).alias("followup_in_group"),
        (F.coalesce("baseline_established_maple_records", F.lit(0)) > 0).alias("baseline_established_maple"),
        sampled("followup").alias("followup_comparable"),
        overlap_adequate(cfg).alias("overlap_adequate"),
        (is_finite("interval_years") & (F.col("interval_years") > 0)).alias("valid_interval"),
        F.col("baseline_maple_seedling_detected").alias("baseline_seedling_detected"),
        F.col("followup_maple_seedling_detected").alias("followup_seedling_detected"),
        # sums that are not whole leave no difference; a visit without live stems has zeros
        F.when(F.coalesce(F.col("baseline_unusable_tree_records"), F.lit(0)) == 0, excess("baseline_nonmaple_ba_ft2_ac", "baseline_beech_sapling_ba_ft2_ac")).alias("baseline_other_nonmaple_ba_ft2_ac"))
    a = a.withColumn("baseline_comparable", sampled("baseline") & F.col("baseline_in_group"))
    before, after = F.col("baseline_seedling_detected"), F.col("followup_seedling_detected")
    gates = ["baseline_comparable", "baseline_established_maple", "followup_comparable", "strict_one_to_one",
             "overlap_adequate", "valid_interval"]
    eligible = F.lit(True)
    for g in gates:
        eligible = eligible & F.col(g)
    return a.select("*", eligible.alias("primary_pair_eligible"), transition(before, after).alias("seedling_transition"),
                    outcome_where(before == 1, 1 - after).alias("seedling_detection_loss"),
                    outcome_where(before == 0, after).alias("seedling_detection_appearance"))


def longitudinal_steps(cfg: Settings = DEFAULTS) -> list[tuple[str, Column]]:
    """The nested screens of a linked pair, the last one named after the overlap that the configuration asks for."""
    c = F.col
    a = c("baseline_comparable")
    b = a & c("baseline_established_maple")
    d = b & c("strict_one_to_one")
    return [("Links with a positive share", F.lit(True)), ("Comparable condition at the start", a), ("Established target stems at the start", b),
            ("One to one in both directions", d), ("Comparable condition at the follow-up", d & c("followup_comparable")),
            (f"At least {cfg.minimum_overlap:.0%} of the frame shared, positive interval", c("primary_pair_eligible"))]


def mapping_audit(pairs: DataFrame) -> DataFrame:
    """Split, merge, broken-reference and overlap figures of the candidate links, one row per metric."""
    from .checks import long_metrics
    from .ordered import exact_quantiles

    strict = F.col("strict_one_to_one")
    n = F.count_if
    wide = pairs.agg(
        F.count(F.lit(1)).cast("double").alias("m0"), n(strict).cast("double").alias("m1"),
        n(F.col("baseline_pair_degree") > 1).cast("double").alias("m2"),
        n(F.col("current_pair_degree") > 1).cast("double").alias("m3"),
        n(F.col("baseline_cond_status_cd").isNull()).cast("double").alias("m4"),
        n(F.col("followup_cond_status_cd").isNull()).cast("double").alias("m5"),
        n(surely(~F.col("plot_prev_link_matches"))).cast("double").alias("m6"),
        F.min(F.when(strict, F.col("baseline_overlap_fraction"))).alias("m7"),
        F.min(F.when(strict, F.col("followup_overlap_fraction"))).alias("m9"))
    only = pairs.where(strict)
    for name, col in (("m8", "baseline_overlap_fraction"), ("m10", "followup_overlap_fraction")):
        wide = wide.crossJoin(exact_quantiles(only, [], col, {name: 0.5}))
    # fixed values: the published names of these metrics
    return long_metrics(wide, {
        "Candidate pair rows": "m0", "Bidirectional one-to-one pair rows": "m1", "Baseline split pair rows": "m2",
        "Follow-up merge pair rows": "m3", "Broken baseline condition references": "m4",
        "Broken follow-up condition references": "m5", "Plot predecessor-link mismatches": "m6",
        "Minimum baseline overlap fraction among strict pairs": "m7",
        "Median baseline overlap fraction among strict pairs": "m8",
        "Minimum follow-up overlap fraction among strict pairs": "m9",
        "Median follow-up overlap fraction among strict pairs": "m10"})


def latest_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key as an aggregate, not a window over the key's rows."""
    rest = [x for x in df.columns if x != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def role_lookup(pairs: DataFrame, lookup: DataFrame, key: str, value: str, domain: Sequence,
                roles: Mapping[str, str]) -> DataFrame:
    """Look a value up for both visits; keys must be unique and present, codes inside the domain."""
    from .checks import AuditFailure, gate_rules, gate_unique

    if not lookup.where(F.col(key).isNull()).isEmpty():
        raise AuditFailure("lookup keys must be present")
    gate_unique(lookup, [key], "lookup")
    gate_rules(lookup, {f"{value} outside its code domain": ~F.col(value).isin(list(domain))}, "lookup")
    out = pairs
    for plt, name in roles.items():
        out = out.join(lookup.select(F.col(key).alias(plt), F.col(value).alias(name)), plt, "left")
    return out


def with_membership(df: DataFrame, flags: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Boolean membership of rows in key sets; ``flags`` maps a name to (set, {row column: set column})."""
    out = df
    for name, (keys, on) in flags.items():
        distinct = keys.select(*[F.col(s).alias(r) for r, s in on.items()]).distinct().withColumn(name, F.lit(True))
        out = out.join(distinct, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out


def opportunity_census(visits: DataFrame, conditions: DataFrame, required: Sequence[DataFrame],
                       positive: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Baseline condition visits with their successors, without touching any outcome.

    ``required`` are key sets a baseline must be in; ``positive`` marks recorded presence.
    """
    base = visits.where((F.col("plot_status_cd") == 1)).join(conditions.where(
        (F.col("cond_status_cd") == 1) & (F.col("micrprop_unadj") > 0)), "plt_cn")
    for keys in required:
        base = base.join(keys.distinct(), keys.columns, "left_semi")
    base = with_membership(base, {"standard_record_present": (positive, {"plt_cn": "plt_cn", "condid": "condid"})})
    nxt = visits.select(F.col("prev_plt_cn").alias("plt_cn"), F.col("plt_cn").alias("current_plt_cn"),
                        F.col("measyear").alias("followup_measyear"), F.col("measmon").alias("followup_measmon"),
                        F.col("plot_status_cd").alias("followup_plot_status_cd"))
    d = base.join(nxt, "plt_cn", "left")
    degree = d.groupBy("plt_cn", "condid").agg(F.countDistinct("current_plt_cn").alias("successor_count"))
    d = d.join(degree, ["plt_cn", "condid"])
    years = elapsed_years("measyear", "measmon", "followup_measyear", "followup_measmon", default_month=None)
    low, high = cfg.interval_bounds
    d = d.withColumn("interval_years", years)
    return d.select("*", (F.col("successor_count") == 1).alias("single_successor"),
                    ((F.col("successor_count") == 1) & surely(F.col("followup_plot_status_cd") == 1)).alias("followup_plot_compatible"),
                    surely((F.col("interval_years") >= low) & (F.col("interval_years") <= high)).alias("date_window"))
