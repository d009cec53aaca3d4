"""Audited before/after endpoint: entrants, frame continuity, ordered exclusions, tagged-stem fates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_most, count_when, in_codes, near, ratio, sum_or_missing, surely, with_role
from ..functions.states import COMPARABLE_FATES, first_label, linked_fate, outcome_where, record_class, size_window
from ..settings import DEFAULTS, Settings
from .links import BASELINE, CURRENT, PAIR
from .ordered import exact_quantiles

# fixed values: the published reasons in their order, and the fields that are zero where nothing was tallied
REASONS = ("Source pair ineligible", "Design or remeasurement protocol", "Seedling count discrepancy",
           "Shared subplot sampling unresolved", "Subplot predecessor mismatch", "Microplot frame discrepancy",
           "Recruit outside shared microplots", "Ambiguous new live sapling", "Included", "Unresolved eligibility")
ZERO_FIELDS = ("followup_total_ba_ft2_ac", "followup_maple_ba_ft2_ac", "followup_maple_sapling_ba_ft2_ac",
               "followup_established_maple_ba_ft2_ac", "followup_nonmaple_ba_ft2_ac", "followup_maple_sapling_records")


def on_role(keys: DataFrame, records: DataFrame, role: Sequence[str]) -> DataFrame:
    """Records of one visit role, carrying the pair keys."""
    return keys.join(records.withColumnsRenamed(dict(zip(("plt_cn", "condid"), role))), list(role))


def classified_entries(keys: DataFrame, stems: DataFrame, target, cfg: Settings = DEFAULTS) -> DataFrame:
    return on_role(keys, stems, CURRENT).withColumn("recruitment_class", record_class(
        "statuscd", "spcd", "dia", "reconcilecd", "prev_tre_cn", target, cfg.sapling_min_dia, cfg.tree_min_dia))


def entry_counts(entries: DataFrame, target, cfg: Settings = DEFAULTS) -> DataFrame:
    sapling = (F.col("statuscd") == 1) & (F.col("spcd") == target) & size_window("dia", cfg.sapling_min_dia, cfg.tree_min_dia)
    k = F.col("recruitment_class")
    return entries.groupBy(*PAIR).agg(
        count_when(k == "New live sapling tally").alias("new_maple_sapling_count"),
        count_when(k == "Ambiguous new sapling tally").alias("ambiguous_new_maple_sapling_count"),
        count_when(F.col("statuscd") == 1).alias("followup_live_tree_count"),
        count_when(sapling).alias("followup_maple_sapling_count"))


def tally_accounting(rows: DataFrame, prefix: str) -> DataFrame:
    """Tally sum (unknown when one record is), missing and discrepant records, largest record."""
    off = F.col("treecount_calc").isNull() | (F.col("treecount") != F.col("treecount_calc"))
    return rows.groupBy(*PAIR).agg(
        sum_or_missing("treecount").cast("double").alias(f"{prefix}_seedling_count"),
        F.count_if(F.col("treecount").isNull()).alias(f"{prefix}_seedling_missing_count_records"),
        count_when(off).alias(f"{prefix}_seedling_calc_discrepant_records"),
        F.max("treecount").alias(f"{prefix}_seedling_max_record_count"))


def enriched_links(links: DataFrame, subplots: DataFrame, subplot_conditions: DataFrame,
                   cfg: Settings = DEFAULTS) -> DataFrame:
    """Slice links with both visits' subplot status and area share, and the per-slice frame checks."""
    out = links
    for role, (plt, cond) in (("baseline", BASELINE), ("current", CURRENT)):
        s = with_role(subplots, role, {"plt_cn": plt, "subp": "subp"})
        m = subplot_conditions.select(F.col("plt_cn").alias(plt), F.col("condid").alias(cond), "subp",
                                      F.col("micrcond_prop").alias(f"{role}_micrcond_prop"))
        out = out.join(s, [plt, "subp"], "left").join(m, [plt, cond, "subp"], "left")
    tol, w = cfg.frame_tolerance, "prop_change"
    declared = F.col("current_prev_sbp_cn")
    return out.select(
        "*", ((F.col("baseline_subp_status_cd") == 1) & (F.col("current_subp_status_cd") == 1)).alias("linked_subplot_sampled"),
        declared.isNotNull().alias("subplot_predecessor_available"),
        # an absent declaration is allowed, a contradicting one is not
        (F.col("baseline_subplot_cn").isNotNull() & F.col("current_subplot_cn").isNotNull()
         & (declared.isNull() | (declared == F.col("baseline_subplot_cn")))).alias("subplot_predecessor_matches"),
        (at_most(w, "baseline_micrcond_prop", tol) & at_most(w, "current_micrcond_prop", tol)).alias("link_within_both_frames"),
        (near(w, "baseline_micrcond_prop", tol) & near(w, "current_micrcond_prop", tol)).alias("exact_microplot_link"))


def frame_continuity(links: DataFrame) -> DataFrame:
    """Per pair: do all shared slices hold? One unknown slice is enough to fail."""
    every = lambda x: F.bool_and(surely(F.col(x)))
    return links.groupBy(*PAIR).agg(
        F.countDistinct("subp").alias("shared_microplot_count"),
        every("linked_subplot_sampled").alias("shared_microplot_sampled"),
        every("subplot_predecessor_matches").alias("shared_subplot_predecessor_matches"),
        every("subplot_predecessor_available").alias("direct_subplot_predecessors_available"),
        every("link_within_both_frames").alias("frame_proportions_valid"),
        every("exact_microplot_link").alias("exact_microplot_links"))


def entrants_outside(entries: DataFrame, links: DataFrame) -> DataFrame:
    """New entrants whose subplot is not a sampled shared slice."""
    new = entries.where(F.col("recruitment_class") == "New live sapling tally").select(*PAIR, "subp")
    shared = links.select(*PAIR, "subp", "linked_subplot_sampled")
    return new.join(shared, [*PAIR, "subp"], "left").groupBy(*PAIR).agg(
        F.count_if(~surely(F.col("linked_subplot_sampled"))).alias("recruits_outside_shared_subplots"))


def recruitment_dataset(pairs: DataFrame, stems: DataFrame, tallies: DataFrame, subplots: DataFrame,
                        subplot_conditions: DataFrame, links: DataFrame, target,
                        cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per pair with counts, frame checks, eligibility, first failing check and masked outcome."""
    keys = pairs.select(*PAIR)
    entries = classified_entries(keys, stems, target, cfg)
    mine = tallies.where(F.col("spcd") == target)
    base = on_role(keys, stems, BASELINE).where(
        (F.col("statuscd") == 1) & (F.col("spcd") == target) & size_window("dia", cfg.sapling_min_dia, cfg.tree_min_dia))
    base_counts = base.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("baseline_maple_sapling_count"),
                                          F.sum("tpa_unadj").alias("baseline_maple_sapling_tpa_plot_basis"))
    slices = enriched_links(links.join(keys, list(PAIR)), subplots, subplot_conditions, cfg)
    parts = [tally_accounting(on_role(keys, mine, BASELINE), "baseline"),
             tally_accounting(on_role(keys, mine, CURRENT), "followup"), base_counts, entry_counts(entries, target, cfg),
             frame_continuity(slices), entrants_outside(entries, slices)]
    out = pairs
    for part in parts:
        out = out.join(part, list(PAIR), "left")
    absent_is_zero = [x for p in (parts[0], parts[1], parts[2], parts[3], parts[5]) for x in p.columns
                      if x not in PAIR and not x.endswith(("_seedling_count", "_max_record_count"))]
    out = out.fillna(0, absent_is_zero)
    for role in ("baseline", "followup"):
        known = F.col(f"{role}_seedling_missing_count_records") == 0
        out = out.withColumn(f"{role}_seedling_count", F.when(known, F.coalesce(F.col(f"{role}_seedling_count"), F.lit(0.0))))
    return _eligibility(out, cfg)


def _eligibility(d: DataFrame, cfg: Settings) -> DataFrame:
    c = F.col
    zero = lambda *names: [c(n) == 0 for n in names]
    protocol = ((c("baseline_designcd") == 1) & (c("followup_designcd") == 1) & (c("baseline_manual") >= 5.1)
                & (c("followup_manual") >= 5.1) & (c("followup_kindcd") == 2) & in_codes("baseline_kindcd", (1, 2))
                & in_codes("baseline_qa_status", (1, 7)) & in_codes("followup_qa_status", (1, 7))
                & c("baseline_microplot_loc").isNotNull() & (c("baseline_microplot_loc") == c("followup_microplot_loc")))
    counted = None
    for p in zero("baseline_seedling_missing_count_records", "followup_seedling_missing_count_records",
                  "baseline_seedling_calc_discrepant_records", "followup_seedling_calc_discrepant_records"):
        counted = p if counted is None else counted & p
    tol = cfg.frame_tolerance
    d = d.select(
        "*", ratio("baseline_maple_sapling_tpa_plot_basis", "baseline_micrprop_unadj").alias("baseline_maple_sapling_tpa"),
        protocol.alias("protocol_design_comparable"), counted.alias("seedling_count_protocol_valid"),
        ((c("baseline_qa_status") != 1) | (c("followup_qa_status") != 1)).alias("nonstandard_qa_status"),
        (c("exact_microplot_links") & near("baseline_overlap_fraction", F.lit(1.0), tol)
         & near("followup_overlap_fraction", F.lit(1.0), tol)).alias("exact_overlap"))
    frame = c("shared_microplot_sampled") & c("frame_proportions_valid")
    empty = ((c("followup_live_tree_count") == 0) & c("followup_comparable") & c("primary_pair_eligible")
             & c("protocol_design_comparable") & frame & (c("followup_balive") == 0))
    clean = (c("recruits_outside_shared_subplots") == 0) & (c("ambiguous_new_maple_sapling_count") == 0)
    eligible = surely(c("primary_pair_eligible") & c("protocol_design_comparable") & c("seedling_count_protocol_valid")
                      & frame & c("shared_subplot_predecessor_matches") & clean)
    d = d.select("*", surely(empty).alias("followup_zero_tree_corrected"), eligible.alias("recruitment_eligible"))
    unknown = lambda x: ~surely(c(x))
    checks = [~c("primary_pair_eligible"), unknown("protocol_design_comparable"), ~c("seedling_count_protocol_valid"),
              unknown("shared_microplot_sampled"), ~c("shared_subplot_predecessor_matches"),
              ~c("frame_proportions_valid"), c("recruits_outside_shared_subplots") > 0,
              c("ambiguous_new_maple_sapling_count") > 0, c("recruitment_eligible")]
    d = d.select("*", first_label(list(zip(checks, REASONS)), REASONS[-1]).alias("exclusion_reason"),
                 outcome_where(c("recruitment_eligible"), (c("new_maple_sapling_count") > 0).cast("int")).alias("outcome_recruitment"))
    # a verified empty visit has measured zeros, not missing measures
    fixed = {x: F.when(c("followup_zero_tree_corrected"), F.lit(0).cast(d.schema[x].dataType)).otherwise(c(x))
             for x in ZERO_FIELDS if x in d.columns}
    if "followup_maple_sapling_present" in d.columns:
        fixed["followup_maple_sapling_present"] = F.when(c("followup_zero_tree_corrected"), False).otherwise(
            c("followup_maple_sapling_present"))
    return d.withColumns(fixed) if fixed else d


def tagged_fates(pairs: DataFrame, stems: DataFrame, target, cfg: Settings = DEFAULTS) -> DataFrame:
    """Follow tagged baseline saplings to the expected successor visit and mask outcomes to comparable fates."""
    carry = ["interval_years", "primary_pair_eligible", "protocol_design_comparable", "shared_microplot_sampled",
             "shared_subplot_predecessor_matches", "frame_proportions_valid"]
    base = on_role(pairs.select(*PAIR, *carry), stems, BASELINE).where(
        (F.col("statuscd") == 1) & (F.col("spcd") == target) & size_window("dia", cfg.sapling_min_dia, cfg.tree_min_dia))
    base = base.select(*PAIR, *carry, "tree_cn", "dia")
    later = stems.where(F.col("prev_tre_cn").isNotNull()).select(
        F.col("prev_tre_cn").alias("tree_cn"), F.col("plt_cn").alias("current_plt_cn"),
        F.col("tree_cn").alias("followup_tree_cn"),
        *[F.col(x).alias(f"followup_{x}") for x in ("condid", "statuscd", "spcd", "dia", "reconcilecd")])
    c = F.col
    f = base.join(later, ["tree_cn", "current_plt_cn"], "left").withColumn("fate", linked_fate(
        "followup_tree_cn", "followup_statuscd", "followup_spcd", "followup_dia", target, cfg.sapling_min_dia, cfg.tree_min_dia))
    here = surely(c("followup_condid") == c("current_condid"))
    comparable = here & in_codes("fate", COMPARABLE_FATES)
    for x in carry[1:]:
        comparable = comparable & c(x)
    f = f.select("*", surely(c("followup_spcd") != target).alias("species_reidentified"),
                 here.alias("tree_link_condition_matches"), surely(comparable).alias("fate_eligible"))
    alive = c("followup_statuscd") == 1
    return f.select(
        "*", outcome_where(c("fate_eligible") & (c("followup_statuscd") != 3), (c("followup_statuscd") == 2).cast("int")).alias("outcome_death"),
        outcome_where(c("fate_eligible"), alive.cast("int")).alias("outcome_survival"),
        (c("fate") == "Alive; reached 5 inches").alias("reached_tree_size"),
        outcome_where(c("fate_eligible") & alive, (c("followup_dia") - c("dia")) / c("interval_years")).alias("annual_diameter_increment"))


def feasibility_metrics(pairs: DataFrame, stems: DataFrame, target, cfg: Settings = DEFAULTS) -> DataFrame:
    """(metric, value): what a cohort of condition pairs offers for a study of new and of tagged small stems.

    ``pairs`` has the four keys, ``plot``, ``cluster``, ``transition``, ``detected``, ``sapling_present`` and ``interval_years``. Stems
    are reduced to one row a pair before anything is counted; a link that is missing never counts as a death.
    """
    c = F.col
    before, after = ["baseline_plt_cn", "baseline_condid"], ["current_plt_cn", "current_condid"]
    small = (c("dia") >= cfg.sapling_min_dia) & (c("dia") < cfg.tree_min_dia)
    live = surely((c("spcd") == target) & (c("statuscd") == 1))
    now = stems.select(c("plt_cn").alias(after[0]), c("condid").alias(after[1]), "statuscd", "spcd", "dia", "reconcilecd", "prev_tre_cn")
    seen = now.join(pairs.select(*after), after).groupBy(*after).agg(
        F.count(F.lit(1)).alias("trees"), F.count_if(surely(c("statuscd") == 1)).alias("live"), F.count_if(surely(live & small)).alias("saplings"),
        F.count_if(surely(live & small & (c("reconcilecd") == 1) & c("prev_tre_cn").isNull())).alias("new"))
    base = stems.where(live & small).select(c("plt_cn").alias(before[0]), c("condid").alias(before[1]), "tree_cn", c("dia").alias("dia0"))
    base = base.join(pairs.select(*before, *after, "interval_years"), before)
    nxt = stems.select(c("prev_tre_cn").alias("tree_cn"), c("plt_cn").alias(after[0]), c("condid").alias("cond1"), c("statuscd").alias("status1"), c("spcd").alias("sp1"), c("dia").alias("dia1"),
                       F.lit(True).alias("linked"))
    fate = base.join(nxt.where(c("tree_cn").isNotNull()), ["tree_cn", after[0]], "left")
    alive = surely(c("status1") == 1)
    flags = {"tagged": F.lit(True), "unlinked": c("linked").isNull(), "elsewhere": surely(c("cond1") != c(after[1])), "alive": alive, "dead": surely(c("status1") == 2),
             "removed": surely(c("status1") == 3), "gone": surely(c("status1") == 0), "reidentified": alive & surely(c("sp1") != target), "grown": alive & surely(c("dia1") >= cfg.tree_min_dia),
             "shrunk": alive & surely(c("dia1") < c("dia0")), "same": alive & surely(c("dia1") == c("dia0"))}
    stems_of = fate.groupBy(*after).agg(*[F.count_if(p).alias(n) for n, p in flags.items()])
    d = pairs.join(seen, after, "left").join(stems_of, after, "left").fillna(0, ["saplings", "new", *flags])
    lost = c("sapling_present") & (c("saplings") == 0)
    grew = fate.where(alive).select(((c("dia1") - c("dia0")) / c("interval_years")).alias("v"))

    def conditions(p):
        return F.count_if(surely(p)).cast("double")

    def distinct(x, p):
        return F.countDistinct(F.when(surely(p), c(x))).cast("double")

    def total(x, p=None):
        return F.coalesce(F.sum(c(x) if p is None else F.when(surely(p), c(x))), F.lit(0)).cast("double")

    new, some = c("new") > 0, c("tagged") > 0
    metrics = {
        "Condition intervals": F.count(F.lit(1)).cast("double"), "Physical plots": F.countDistinct("plot").cast("double"), "Baseline detections": conditions(c("detected") == 1),
        "New saplings": total("new"), "Conditions with new saplings": conditions(new), "Clusters with new saplings": distinct("cluster", new),
        "Conditions with new saplings and baseline detection": conditions(new & (c("detected") == 1)), "Loss conditions with new saplings": conditions(new & (c("transition") == "Loss")),
        "Tagged saplings": total("tagged"), "Conditions with tagged saplings": conditions(some), "Plots with tagged saplings": distinct("plot", some),
        "Unlinked saplings": total("unlinked"), "Linked on another condition": total("elsewhere"), "Recorded alive": total("alive"), "Recorded dead": total("dead"),
        "Recorded removed": total("removed"), "No longer in the sample": total("gone"), "Survivors of another species": total("reidentified"), "Survivors grown to trees": total("grown"),
        "Sapling losses": conditions(lost), "Sapling losses with a grown survivor": conditions(lost & (c("grown") > 0)), "Grown survivors in sapling losses": total("grown", lost),
        "Sapling losses with another species": conditions(lost & (c("reidentified") > 0)), "Survivors that shrank": total("shrunk"), "Survivors of the same size": total("same"),
        "Visits without live stems": conditions((c("trees") > 0) & (c("live") == 0))}
    wide = d.agg(*[e.alias(f"m{i}") for i, e in enumerate(metrics.values())])
    middle = exact_quantiles(grew, [], "v", {"q": 0.5}).agg(F.max("q").alias(f"m{len(metrics)}"))
    names = [*metrics, "Median yearly growth of survivors"]
    return wide.crossJoin(middle).select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(names)])))
