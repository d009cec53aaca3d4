"""Scalar column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS

Col = str | Column


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- missing values -----------------------------------------------------------------

def is_finite(x: Col) -> Column:
    """True only for a present number that is neither NaN nor infinite."""
    v = c(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def surely(p: Column) -> Column:
    """A predicate that counts only when it is known to hold."""
    return F.coalesce(p, F.lit(False))


def in_codes(x: Col, codes: Iterable) -> Column:
    """Set membership that never yields NULL."""
    return surely(c(x).isin(list(codes)))


def count_when(p: Column) -> Column:
    return F.count_if(surely(p))


def sum_when(p: Column, x: Col) -> Column:
    """Conditional sum that is 0 when nothing qualifies."""
    return F.coalesce(F.sum(F.when(p, c(x))), F.lit(0.0))


def sum_or_missing(x: Col) -> Column:
    """A sum that is unknown as soon as one record is."""
    return F.when(F.count_if(c(x).isNull()) == 0, F.sum(c(x)))


# --- measures ------------------------------------------------------------------------

def area_contribution(dia: Col, per_area: Col, constant: float = DEFAULTS.area_constant) -> Column:
    return F.lit(constant) * c(dia) * c(dia) * c(per_area)


def sampling_basis(dia: Col, breakpoint_dia: Col | None = None, small: float = DEFAULTS.tree_min_dia) -> Column:
    """Frame that tallied a stem; an absent breakpoint means there is no macro frame."""
    d = c(dia)
    rest = F.when(d < small, F.lit("microplot")).otherwise(F.lit("subplot"))
    if breakpoint_dia is None:
        return rest
    return F.when(surely(d >= c(breakpoint_dia)), F.lit("macroplot")).otherwise(rest)


def frame_share(basis: Col, micro: Col, sub: Col, macro: Col | None = None) -> Column:
    """Sampled proportion that belongs to a stem's frame."""
    b = c(basis)
    picked = F.when(b == "microplot", c(micro)).when(b == "subplot", c(sub))
    return picked if macro is None else picked.when(b == "macroplot", c(macro))


def ratio(n: Col, d: Col, empty: float | None = None) -> Column:
    """n/d for a positive denominator; ``empty`` (or NULL) otherwise. Never divides by zero."""
    r = F.when(c(d) > 0, c(n) / c(d))
    return r if empty is None else r.otherwise(F.lit(float(empty)))


def excess(a: Col, b: Col) -> Column:
    """a-b floored at zero, missing parts counting as zero."""
    return F.greatest(F.lit(0.0), F.coalesce(c(a), F.lit(0.0)) - F.coalesce(c(b), F.lit(0.0)))


def any_positive(*cols: Col) -> Column:
    """Any of several code slots filled with a positive code."""
    return reduce(lambda p, q: p | q, (F.coalesce(c(x), F.lit(0)) > 0 for x in cols))


# --- keys and calendars --------------------------------------------------------------

def padded(x: Col, width: int) -> Column:
    return F.lpad(c(x).cast("string"), width, "0")


def area_code(major: Col, minor: Col, widths: tuple[int, int] = (2, 3)) -> Column:
    return F.concat(padded(major, widths[0]), padded(minor, widths[1]))


def joined_key(*cols: Col, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[c(x).cast("string") for x in cols])


def elapsed_years(y0: Col, m0: Col, y1: Col, m1: Col, fallback0: Col | None = None,
                  fallback1: Col | None = None, default_month: int | None = 7) -> Column:
    """Decimal years between two (year, month) marks."""
    def year(y, f):
        return c(y) if f is None else F.coalesce(c(y), c(f))

    def month(m):
        return c(m) if default_month is None else F.coalesce(c(m), F.lit(default_month))

    return (year(y1, fallback1) - year(y0, fallback0)).cast("double") + (month(m1) - month(m0)) / F.lit(12.0)


def season_window(year: Col, month: Col, lookback: int = DEFAULTS.season_lookback) -> Column:
    """Seasons that ended before a visit; every January visit skips the running season too."""
    if lookback < 1 or int(lookback) != lookback:
        raise ValueError("lookback must be a positive whole number of seasons")
    january = c(month) == 1
    last = c(year) - 1 - F.when(january, 1).otherwise(0)
    first = last - (lookback - 1)
    return F.struct(first.cast("int").alias("first_season"), last.cast("int").alias("last_season"),
                    january.alias("january_shift"),
                    F.sequence(first, last).cast("array<int>").alias("required_seasons"))


def all_within(required: Col, available: Col) -> Column:
    return F.size(F.array_except(c(required), c(available))) == 0


# --- transforms ----------------------------------------------------------------------

def transformed(x: Col, kind: str) -> Column:
    v = c(x).cast("double")
    if kind == "identity":
        return v
    if kind == "log1p":
        return F.log1p(v)
    raise ValueError(f"unknown transformation {kind}")


def clipped(p: Col, eps: float) -> Column:
    return F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), c(p)))


def logistic(eta: Col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(eta)))


def logit(p: Col, eps: float = 1e-12) -> Column:
    q = clipped(p, eps)
    return F.log(q / (F.lit(1.0) - q))


def near(a: Col, b: Col, tol: float = DEFAULTS.frame_tolerance) -> Column:
    return F.abs(c(a) - c(b)) <= tol


def at_most(a: Col, b: Col, tol: float = DEFAULTS.frame_tolerance) -> Column:
    return c(a) <= c(b) + tol


def is_whole(x: Col, tol: float = 1e-8) -> Column:
    return F.abs(c(x) - F.round(c(x))) <= tol


def right_closed_bin(x: Col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Interval label of x where bin i is (edges[i], edges[i+1]]; outside every bin NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per interval")
    v = c(x)
    out = F.when(v <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(v <= float(upper), F.lit(label))
    return out


COUNT_BINS = ((-1.0, 0.0, 1.0, 5.0, 20.0, float("inf")), ("0", "1", "2-5", "6-20", ">20"))


def bin_midpoint(x: Col, width: float = 0.05, cap: float = 0.975) -> Column:
    return F.least(F.lit(cap), F.floor(c(x) / width) * F.lit(width) + F.lit(width / 2))


def recoded(x: Col, labels: Mapping, default: str) -> Column:
    pairs = [F.lit(v) for kv in labels.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c(x)), F.lit(default))


def plain_name(x: Col) -> Column:
    """Comparable form of a place name: letters and blanks only, lower case."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z ]", ""))


def sampled_unit(status: Col, legacy: Col, reason: Col) -> Column:
    """A unit counts as sampled on an explicit status only; a blank legacy code is allowed, a reason is not."""
    return surely((c(status) == 1) & (c(legacy).isNull() | (c(legacy) == 1)) & c(reason).isNull())


def tall_fraction(ordinary: Col, tall: Col) -> Column:
    """Share of tall among ordinary counts, undefined at zero."""
    return F.when(c(ordinary) > 0, c(tall).cast("double") / c(ordinary))


def tall_fraction_conflict(ordinary: Col, tall: Col, standard: Col) -> Column:
    """Rows whose count definitions disagree; must be empty before ``tall_fraction`` is used."""
    o, t, s = c(ordinary), c(tall), c(standard)
    fine = is_finite(o) & is_finite(t) & is_finite(s) & (o >= 0) & (t >= 0) & is_whole(o) & is_whole(t) \
        & is_whole(s) & (o == s) & (t <= s)
    return ~surely(fine)


# --- names ---------------------------------------------------------------------------

def require_prefix(prefix: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", prefix or ""):
        raise ValueError("a snake-case prefix is required")
    return prefix


def with_role(df: DataFrame, role: str, keys: Mapping[str, str]) -> DataFrame:
    """Rename visit keys to their role columns and prefix every other column with the role."""
    require_prefix(role)
    return df.select(*[F.col(x).alias(keys.get(x, f"{role}_{x}")) for x in df.columns])


def wilson(successes: Col, total: Col, z: float = 1.96) -> Column:
    """Wilson score interval as a struct(estimate, conf_low, conf_high); NULL without trials."""
    n = c(total).cast("double")
    p = c(successes) / n
    z2 = F.lit(z * z)
    scale = F.lit(1.0) + z2 / n
    mid = (p + z2 / (n * 2.0)) / scale
    half = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + z2 / (n * 4.0)) / n) / scale
    known = c(total) > 0
    return F.struct(F.when(known, p).alias("estimate"),
                    F.when(known, F.greatest(F.lit(0.0), mid - half)).alias("conf_low"),
                    F.when(known, F.least(F.lit(1.0), mid + half)).alias("conf_high"))
