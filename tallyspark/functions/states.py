"""Ordered classifications. Branch order is part of every definition: the first known match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Col, c, surely

# State labels of the published tables, in their reporting order.
TRANSITIONS = ("Persistent non-detection", "Appearance", "Loss", "Persistence")
RECORD_CLASSES = ("Not a live maple sapling", "Previously tagged sapling", "Ambiguous new sapling tally",
                  "New live sapling tally")
FATES = ("Unlinked", "No longer sampled", "Species reidentified", "Unresolved", "Recorded dead",
         "Recorded removed", "Alive; reached 5 inches", "Alive; remains sapling")
COMPARABLE_FATES = ("Recorded dead", "Recorded removed", "Alive; reached 5 inches", "Alive; remains sapling")
MEASUREMENT_REASONS = ("No RI plot record", "Incomplete or contradictory RI microplot frame",
                       "Invalid RI record or foreign key", "Plot date outside May-September or missing",
                       "RI measurement available")


def first_label(branches: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = None
    for predicate, label in branches:
        out = F.when(predicate, F.lit(label)) if out is None else out.when(predicate, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def transition(before: Col, after: Col) -> Column:
    """Before/after detection state; unknown on either side stays unknown."""
    code = c(before) * 2 + c(after)
    return F.when(c(before).isin(0, 1) & c(after).isin(0, 1),
                  F.element_at(F.array(*[F.lit(x) for x in TRANSITIONS]), (code + 1).cast("int")))


def outcome_where(at_risk: Column, outcome: Column) -> Column:
    """Outcome defined only for units at risk."""
    return F.when(surely(at_risk), outcome)


def size_window(dia: Col, low: float, high: float) -> Column:
    return (c(dia) >= low) & (c(dia) < high)


def record_class(status: Col, species: Col, dia: Col, reconcile: Col, previous: Col, target,
                 low: float = 1.0, high: float = 5.0, labels: Sequence[str] = RECORD_CLASSES) -> Column:
    """Is a stem record at the second visit a verified new entrant?

    A single contradicting attribute rules a record out even if others are missing; only then does a
    predecessor tag, then any gap in the attributes, then the reconciliation code decide.
    """
    other, tagged, unclear, new = labels
    s, sp, d = c(status), c(species), c(dia)
    contradicted = (sp != target) | (s != 1) | (d < low) | (d >= high)
    gap = s.isNull() | sp.isNull() | d.isNull()
    return first_label([(contradicted, other), (c(previous).isNotNull(), tagged), (gap, unclear),
                        (c(reconcile) == 1, new)], unclear)


def linked_fate(linked: Col, status: Col, species: Col, dia: Col, target, low: float = 1.0,
                high: float = 5.0, labels: Sequence[str] = FATES) -> Column:
    """What became of a tagged stem. Missing links and non-sampling never count as death."""
    unlinked, unsampled, other_species, unresolved, dead, removed, grown, remains = labels
    s, sp, d = c(status), c(species), c(dia)
    return first_label([
        (c(linked).isNull(), unlinked),
        (s == 0, unsampled),
        (sp != target, other_species),
        (s.isNull() | sp.isNull(), unresolved),
        (s == 2, dead),
        (s == 3, removed),
        ((s == 1) & (d >= high), grown),
        ((s == 1) & (d >= low), remains),
    ], unresolved)


def tracked_fate(linked: Col, status: Col, dia: Col, low: float = 1.0, high: float = 5.0) -> Column:
    """Earlier feasibility variant of the fate: species identity is reported apart from it."""
    s, d = c(status), c(dia)
    # fixed values: the published labels
    return first_label([
        (c(linked).isNull(), "Unlinked; unresolved"),
        (s == 0, "No longer in sample; reconcile separately"),
        (s == 2, "Recorded dead"),
        (s == 3, "Recorded removed"),
        ((s == 1) & (d >= high), "Alive; grew to at least 5 inches"),
        ((s == 1) & (d >= low), "Alive; still 1 to less than 5 inches"),
    ], "Other; unresolved")


def measurement_reason(has_record: Column, frame_ok: Column, records_ok: Column, in_season: Column,
                       labels: Sequence[str] = MEASUREMENT_REASONS) -> Column:
    no_record, frame, record, season, available = labels
    return first_label([(~surely(has_record), no_record), (~surely(frame_ok), frame),
                        (~surely(records_ok), record), (~surely(in_season), season)], available)
