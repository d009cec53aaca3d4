"""Evaluation, eligibility and composition of the cross-sectional cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import c, in_codes, is_finite, plain_name, surely
from ..session import broadcast_if_small
from .checks import AuditFailure, exactly_one, gate_rules, gate_unique, require_columns
from .ordered import numbered


def resolve_evaluation(evaluations: DataFrame, end: str, ident: str, pinned=None):
    """The pinned evaluation or the latest one; exactly one row either way."""
    chosen = evaluations.distinct()
    if pinned is not None:
        chosen = chosen.where(F.col(ident) == pinned)
    else:
        chosen = chosen.orderBy(F.desc(end), F.desc(ident)).limit(1)
    return exactly_one(chosen, "evaluation")


def active_codes(types: DataFrame, code: str, group: str, group_code, allowed: str, retired: str) -> DataFrame:
    """Field-valid codes of a type group that no later manual has retired."""
    return types.where((F.col(group) == group_code) & (F.col(allowed) == "Y") & F.col(retired).isNull()).select(code)


def named_row(reference: DataFrame, names: dict[str, str], label: str = "reference"):
    """The single reference row that matches any of the names, case-insensitively."""
    match = None
    for column, text in names.items():
        hit = F.lower(F.col(column)) == text.lower()
        match = hit if match is None else match | hit
    return exactly_one(reference.where(match), label)


def within(facts: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key set, without multiplying rows."""
    return facts.join(keys.select(*on), list(on), "left_semi")


def eligible_conditions(conditions: DataFrame, visits: DataFrame, members: DataFrame, forest_codes: Sequence,
                        visit: str = "plt_cn") -> DataFrame:
    """Sampled forest conditions of the target types on visits of the evaluation."""
    sampled = within(visits.where(F.col("plot_status_cd") == 1), members, [visit])
    return conditions.where((F.col("cond_status_cd") == 1) & in_codes("fortypcd", forest_codes)).join(sampled, visit)


def with_reference_name(df: DataFrame, reference: DataFrame, key: Sequence[str], name: str,
                        default: str | None = None) -> DataFrame:
    """N:1 lookup of a name; the reference is first made unique per key by its smallest name."""
    unique = reference.groupBy(*key).agg(F.min(name).alias(name))
    out = df.join(broadcast_if_small(unique), list(key), "left")
    return out if default is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def composition(facts: DataFrame, by: Sequence[str], measure) -> DataFrame:
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum(c(measure)).alias("amount"))


def top_shares(totals: DataFrame, amount: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The n largest parts with their share of everything and the share that is shown.

    ``totals`` is already one row per part, so the grand total is a small aggregate of it.
    """
    whole = totals.agg(F.sum(amount).alias("_whole"))
    shown = totals.orderBy(F.desc(amount), *tie).limit(n).crossJoin(F.broadcast(whole)).withColumn(
        "share", F.col(amount) / F.col("_whole")).drop("_whole")
    displayed = shown.agg(F.sum("share").alias("displayed_share"))
    return shown.crossJoin(F.broadcast(displayed))


def join_on_names(left: DataFrame, right: DataFrame, left_text: str, right_text: str, suffix: str = "_right") -> DataFrame:
    """N:1 join on normalised names, the key in ``key``. A repeated name on the right, a missing name, or a row without a match is
    an error; a column that both sides have keeps its name on the left and gets the suffix on the right."""
    a, b = left.withColumn("key", plain_name(left_text)), right.withColumn("key", plain_name(right_text)).drop(right_text)
    b = b.withColumnsRenamed({c: c + suffix for c in b.columns if c in a.columns and c != "key"})
    if not a.where(F.col("key").isNull()).isEmpty() or not b.where(F.col("key").isNull()).isEmpty():
        raise AuditFailure("names must be present on both sides")
    gate_unique(b, ["key"], "names")
    lost = a.join(b, "key", "left_anti")
    if not lost.isEmpty():
        raise AuditFailure(f"name without a match: {lost.first()[left_text]}")
    return a.join(b, "key")


def stacked(parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Tables under each other with their name in ``label``; a column that some lack is missing there. One name with two types is an
    error, and so is no table at all."""
    kinds: dict = {}
    for name, df in parts.items():
        for f in df.schema:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise AuditFailure(f"{f.name} of {name} has another type")
    if not parts:
        raise AuditFailure("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(name).alias(label), "*") for name, df in parts.items()])


def model_ready(rows: DataFrame, eligible: Column, y: str, predictors: Sequence[str], share: str, interval: str, counts: Sequence[str] = (), detected: Mapping[str, str] | None = None,
                order: Sequence[str] = ("row_id",), tolerance: float = 1e-8) -> DataFrame:
    """The eligible rows as a modelling cohort, numbered in ``audit_row``; whatever would drop or bend a row later is an error.

    Required fields are present, the outcome is 0 or 1, predictors are finite and not negative, the sampled share lies in (0, 1.01],
    intervals are positive, counts are whole, and a detection flag (count -> flag) agrees with its count. All rules are counted in
    one pass over the rows.
    """
    required = list(dict.fromkeys([y, *predictors, share, interval, *counts, *order]))
    require_columns(rows, required, "modelling rows")
    d = rows.where(surely(eligible))
    rules = {f"{x} missing": F.col(x).isNull() for x in required}
    rules[f"{y} not binary"] = ~F.col(y).isin(0, 1)
    rules |= {f"{x} not finite or negative": ~is_finite(x) | (F.col(x) < 0) for x in predictors}
    rules |= {f"{share} outside its frame": (F.col(share) <= 0) | (F.col(share) > 1.01), f"{interval} not positive": F.col(interval) <= 0}
    rules |= {f"{x} not whole": F.abs(F.col(x) - F.round(F.col(x).cast("double"))) > tolerance for x in counts}
    rules |= {f"{flag} contradicts {x}": (F.col(x) > 0) != F.col(flag).cast("boolean") for x, flag in (detected or {}).items()}
    gate_rules(d, rules, "modelling cohort")
    return numbered(d, list(order), "audit_row")
