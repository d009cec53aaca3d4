"""Unit-level measures normalised by the sampled frame, keeping zero apart from not observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (area_contribution, count_when, excess, frame_share, is_finite, ratio,
                                require_prefix, sampling_basis, sum_when)
from ..functions.states import size_window
from ..settings import DEFAULTS, Settings
from .checks import AuditFailure, require_columns
from .ordered import exact_quantiles, with_percent_rank, with_thresholds

UNIT = ("plt_cn", "condid")
FRAMES = ("micrprop_unadj", "subpprop_unadj", "macrprop_unadj")
RANK_DIGITS = 9


def live_stems(stems: DataFrame) -> DataFrame:
    return stems.where((F.col("statuscd") == 1) & (F.col("dia") >= 0) & (F.col("tpa_unadj") >= 0))


def normalised_stems(stems: DataFrame, frames: DataFrame, unit: Sequence[str] = UNIT,
                     cfg: Settings = DEFAULTS) -> DataFrame:
    """Live stems with their frame and per-area contribution; NULL contribution marks a reject."""
    require_columns(stems, [*unit, "spcd", "dia", "tpa_unadj", "statuscd"], "stem records")
    require_columns(frames, [*unit, *FRAMES[:2]], "frame proportions")
    has_break = "macro_breakpoint_dia" in stems.columns
    macro = "macrprop_unadj" if "macrprop_unadj" in frames.columns else F.lit(None).cast("double")
    shares = frames.select(*unit, *[x for x in FRAMES if x in frames.columns])
    basis = sampling_basis("dia", "macro_breakpoint_dia" if has_break else None, cfg.tree_min_dia)
    joined = live_stems(stems).join(shares, list(unit), "left")
    raw = joined.select("*", basis.alias("sampling_basis"),
                        area_contribution("dia", "tpa_unadj", cfg.area_constant).alias("plot_basis"))
    share = frame_share("sampling_basis", "micrprop_unadj", "subpprop_unadj", macro)
    return raw.withColumn("contribution", F.when(is_finite(share), ratio("plot_basis", share)))


def frame_rejects(normalised: DataFrame) -> DataFrame:
    """Live records that cannot be normalised, per frame; must be empty."""
    return (normalised.where(F.col("contribution").isNull()).groupBy("sampling_basis")
            .agg(F.count(F.lit(1)).alias("rejects")))


def stem_metrics(stems: DataFrame, frames: DataFrame, target, unit: Sequence[str] = UNIT,
                 cfg: Settings = DEFAULTS, gate: bool = False) -> DataFrame:
    """All conditional sums, record counts and shares per unit, in one aggregation.

    With ``gate`` a stem without a usable frame proportion is an error, as in the published analysis.
    Without it such stems are counted in ``unusable_tree_records``, and the per-area sums of their unit, which
    would not be whole, are NULL with all that is derived from them.
    """
    rows = normalised_stems(stems, frames, unit, cfg)
    if gate:
        bad = frame_rejects(rows).collect()
        if bad:
            raise AuditFailure("cannot normalise live records: "
                               + ", ".join(f"{r['sampling_basis']} ({r['rejects']})" for r in bad))
    maple = F.col("spcd") == target
    sapling = maple & size_window("dia", cfg.sapling_min_dia, cfg.tree_min_dia)
    tree = F.col("dia") >= cfg.tree_min_dia
    classes = {"": F.lit(True), "maple_": maple, "maple_sapling_": sapling, "overstory_": tree,
               "established_maple_": maple & tree}

    def named(prefix: str, suffix: str) -> str:
        return f"{prefix}total_{suffix}" if prefix in ("", "overstory_") else f"{prefix}{suffix}"

    whole = F.count("contribution") == F.count(F.lit(1))
    sums = [*[sum_when(p, "plot_basis").alias(named(k, "ba_plot_basis")) for k, p in classes.items()],
            *[F.when(whole, sum_when(p, "contribution")).alias(named(k, "ba_ft2_ac")) for k, p in classes.items()]]
    counts = [F.count(F.lit(1)).alias("live_tree_records"), F.count_if(F.col("contribution").isNull()).alias("unusable_tree_records"), count_when(sapling).alias("maple_sapling_records"),
              count_when(tree).alias("overstory_tree_records"),
              count_when(maple & tree).alias("established_maple_records"),
              *[count_when(F.col("sampling_basis") == b).alias(f"{b}_tree_records")
                for b in ("microplot", "subplot", "macroplot")]]
    m = rows.groupBy(*unit).agg(*sums, *counts)
    known = F.col("total_ba_ft2_ac").isNotNull()
    return m.select(
        "*", F.when(known, excess("total_ba_ft2_ac", "maple_ba_ft2_ac")).alias("nonmaple_ba_ft2_ac"),
        F.when(known, excess("total_ba_ft2_ac", "established_maple_ba_ft2_ac")).alias("other_live_ba_ft2_ac"),
        (F.col("maple_sapling_records") > 0).alias("maple_sapling_present"),
        F.when(known, ratio("maple_ba_ft2_ac", "total_ba_ft2_ac", 0)).alias("maple_ba_share"),
        F.when(known, ratio("established_maple_ba_ft2_ac", "overstory_total_ba_ft2_ac", 0)).alias("established_maple_ba_share"))


def target_metrics(stems: DataFrame, frames: DataFrame, target, prefix: str, unit: Sequence[str] = UNIT,
                   cfg: Settings = DEFAULTS) -> DataFrame:
    """Sums and counts of one species on every unit of the frame table; units without it get zeros, and units whose sums are not
    whole for want of a frame proportion get NULL sums."""
    require_prefix(prefix)
    rows = normalised_stems(stems.where(F.col("spcd") == target), frames, unit, cfg)
    small = size_window("dia", cfg.sapling_min_dia, cfg.tree_min_dia)
    big = F.col("dia") >= cfg.tree_min_dia
    whole = F.count("contribution") == F.count(F.lit(1))
    m = rows.groupBy(*unit).agg(
        *[F.when(whole, sum_when(p, "contribution")).alias(f"{prefix}_{n}ba_ft2_ac") for n, p in (("", F.lit(True)), ("sapling_", small), ("established_", big))],
        F.count(F.lit(1)).alias(f"{prefix}_records"), count_when(small).alias(f"{prefix}_sapling_records"),
        count_when(big).alias(f"{prefix}_established_records"))
    grid = frames.select(*unit).distinct()
    none = F.col(f"{prefix}_records").isNull()
    return grid.join(m, list(unit), "left").select(*unit, *[F.when(none, F.lit(0).cast(m.schema[x].dataType)).otherwise(F.col(x)).alias(x) for x in m.columns if x not in unit])


def tally_metrics(tallies: DataFrame, units: DataFrame, target, unit: Sequence[str] = UNIT,
                  coverage: str = "micrprop_unadj") -> DataFrame:
    """Density, detection and share per unit of the universe: zero only where the frame was sampled."""
    require_columns(tallies, [*unit, "spcd", "tpa_unadj"], "tally records")
    require_columns(units, [*unit, coverage], "unit universe")
    maple = F.col("spcd") == target
    seen = tallies.where(F.col("tpa_unadj") >= 0).groupBy(*unit).agg(
        F.sum("tpa_unadj").alias("_all"), sum_when(maple, "tpa_unadj").alias("_maple"),
        count_when(maple).alias("_maple_n"), F.count(F.lit(1)).alias("_n"))
    sampled = F.coalesce(F.col(coverage) > 0, F.lit(False))
    known = units.select(*unit, coverage).join(seen, list(unit), "left").select(
        *unit, coverage, sampled.alias("seedling_sampled"),
        F.when(sampled, F.coalesce("_all", F.lit(0.0))).alias("all_seedling_tpa_plot_basis"),
        F.when(sampled, F.coalesce("_maple", F.lit(0.0))).alias("maple_seedling_tpa_plot_basis"),
        F.coalesce("_maple_n", F.lit(0)).alias("maple_seedling_records"),
        F.coalesce("_n", F.lit(0)).alias("seedling_species_records"))
    dens = known.select(
        "*", ratio("maple_seedling_tpa_plot_basis", coverage).alias("maple_seedling_tpa"),
        ratio("all_seedling_tpa_plot_basis", coverage).alias("all_seedling_tpa"),
        F.when(F.col("seedling_sampled"), (F.col("maple_seedling_tpa_plot_basis") > 0).cast("int"))
        .alias("maple_seedling_detected"))
    return dens.withColumn("maple_seedling_share", ratio("maple_seedling_tpa", "all_seedling_tpa"))


def gap_flags(df: DataFrame, share: str = "established_maple_ba_share", density: str = "maple_seedling_tpa",
              detected: str = "maple_seedling_detected", cfg: Settings = DEFAULTS,
              ranks: bool = True) -> DataFrame:
    """Threshold flags (and percent ranks) defined on outcome-eligible rows only.

    Ranks are those of values rounded to ``RANK_DIGITS``: sums of the same records differ in their last bits by the order of addition,
    which must not part what is tied. The published log1p of the density is monotone, so it leaves the ranks as they are.
    """
    usable = F.col(detected).isNotNull() & F.col(share).isNotNull()
    eligible = df.where(usable).select(share)
    cuts = exact_quantiles(eligible, [], share, {"established_threshold": cfg.gap_quantile,
                                                "sensitivity_threshold": cfg.gap_sensitivity_quantile})
    out = with_thresholds(df, cuts)
    for name, cut in (("potential_gap", "established_threshold"),
                      ("potential_gap_sensitivity", "sensitivity_threshold")):
        flag = F.coalesce((F.col(share) >= F.col(cut)) & (F.col(detected) == 0), F.lit(False))
        out = out.withColumn(name, F.when(F.col(detected).isNotNull(), flag))
    if not ranks:
        return out
    out = out.withColumn("_share", F.when(usable, F.round(share, RANK_DIGITS))).withColumn(
        "_dens", F.when(usable, F.round(density, RANK_DIGITS)))
    out = with_percent_rank(out, "_share", "established_percentile")
    out = with_percent_rank(out, "_dens", "regeneration_percentile")
    return out.withColumn("gap_rank_difference",
                          F.col("established_percentile") - F.col("regeneration_percentile")).drop("_share", "_dens")
