"""Audits and gates. Audits return DataFrames; ``gate_*`` raise and are the only actions here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import surely


class AuditFailure(ValueError):
    pass


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    missing = [x for x in columns if x not in df.columns]
    if missing:
        raise AuditFailure(f"{label} is missing columns: {', '.join(missing)}")
    return df


def exactly_one(df: DataFrame, label: str = "lookup"):
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise AuditFailure(f"{label}: expected exactly one row")
    return rows[0]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gate_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    require_columns(df, keys, label)
    if not duplicate_keys(df, keys).isEmpty():
        raise AuditFailure(f"{label} has duplicated key combinations")
    return df


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule (rule = predicate that is true on a violation), in one pass."""
    wide = df.agg(*[F.count_if(surely(p)).alias(f"r{i}") for i, p in enumerate(rules.values())],
                  F.count(F.lit(1)).alias("n_rows"))
    return long_metrics(wide, {name: f"r{i}" for i, name in enumerate(rules)}, "rule", "violations", ["n_rows"])


def gate_rules(df: DataFrame, rules: Mapping[str, Column], label: str = "table") -> DataFrame:
    bad = violation_counts(df, rules).where("violations > 0").collect()
    if bad:
        raise AuditFailure(f"{label}: " + ", ".join(f"{r['rule']} ({r['violations']})" for r in bad))
    return df


def out_of_range(x: str, low: float | None = None, high: float | None = None, allow_missing: bool = True) -> Column:
    v = F.col(x)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    return surely(bad) if allow_missing else surely(bad) | v.isNull()


def long_metrics(wide: DataFrame, names: Mapping[str, str], name_as: str = "metric", value_as: str = "value",
                 keep_columns: Sequence[str] = ()) -> DataFrame:
    """Turn named columns of a small wide result into (name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(label).alias(name_as), F.col(x).alias(value_as))
                      for label, x in names.items()])
    return wide.select(*keep_columns, F.inline(pairs))


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str,
               result: DataFrame | None = None) -> DataFrame:
    """Row counts, distinct keys and unmatched left keys of a join, from keys alone.

    Both key sides are reduced before they meet; the counts come out of one outer join.
    """
    def side(df, tag):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(tag))

    both = side(left, "l").join(side(right, "r"), list(keys), "full")
    out = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count("l").alias("left_unique_keys"), F.count("r").alias("right_unique_keys"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("unmatched_left_keys"))
    if result is None:
        out = out.withColumn("result_rows", F.lit(None).cast("long"))
    else:
        out = out.crossJoin(result.agg(F.count(F.lit(1)).alias("result_rows")))
    return out.select(F.lit(label).alias("join"), "left_rows", "right_rows", "result_rows", "left_unique_keys",
                      "right_unique_keys", "unmatched_left_keys")


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(x).alias(f"c{i}") for i, x in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(x).alias("variable"), (F.col("n_rows") - F.col(f"c{i}")).alias("missing_n"))
                     for i, x in enumerate(cols)])
    return wide.select("n_rows", F.inline(rows)).select(
        "variable", "missing_n", (F.lit(100.0) * F.try_divide("missing_n", "n_rows")).alias("missing_pct"))


def field_support(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present, missing and distinct values per field.

    Each field is first reduced to its distinct values; no row is expanded once per field.
    """
    def one(x):
        per_value = df.groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return per_value.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("nonmissing"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("v").alias("distinct_values")).select(F.lit(x).alias("variable"), "*")

    return reduce(DataFrame.unionByName, [one(x) for x in columns])


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]], units: Mapping[str, Sequence[str]],
         totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows, distinct units and sums at each screen of a cohort.

    Rows are reduced to the keys of all units, with a flag per step, in one shuffle. Screens count a row only when their predicate
    is known to hold.
    """
    flags = [surely(p).alias(f"_f{i}") for i, (_, p) in enumerate(steps)]
    n = len(steps)

    def long(wide: DataFrame, prefix: str, name: Column) -> DataFrame:
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("step_no"), name.alias("what"),
                     F.col(f"{prefix}{i}").cast("double").alias("v")) for i in range(n)])))

    sums = {"n_rows": F.lit(1), **(totals or {})}
    marked = df.select("*", *flags)
    direct = marked.agg(*[F.coalesce(F.sum(F.when(F.col(f"_f{i}"), x)), F.lit(0)).alias(f"t{j}_{i}")
                          for j, x in enumerate(sums.values()) for i in range(n)])
    parts = [long(direct, f"t{j}_", F.lit(name)) for j, name in enumerate(sums)]
    if units:
        per_unit = unit_rows(marked, units, [f"_f{i}" for i in range(n)]).groupBy("what", "key").agg(*[F.max(f"_f{i}").alias(f"_f{i}") for i in range(n)])
        parts.append(long(per_unit.groupBy("what").agg(*[F.count_if(F.col(f"_f{i}")).alias(f"u{i}") for i in range(n)]), "u", F.col("what")))
    names = [*sums, *units]
    table = reduce(DataFrame.unionByName, parts)
    wide = table.groupBy("step_no").agg(*[F.max(F.when(F.col("what") == x, F.col("v"))).alias(x) for x in names])
    label = F.element_at(F.array(*[F.lit(s) for s, _ in steps]), F.col("step_no") + 1)
    return wide.select("step_no", label.alias("step"), *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in names])


def unit_rows(df: DataFrame, units: Mapping[str, Sequence[str]], carry: Sequence[str]) -> DataFrame:
    """(what, key, carry…): each row once for every kind of unit it belongs to, its key as one string."""
    keys = [F.struct(F.lit(name).alias("what"), F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(key)]),
                                                          {"ignoreNullFields": "false"}).alias("key")) for name, key in units.items()]
    return df.select(F.explode(F.array(*keys)).alias("u"), *carry).select("u.what", "u.key", *carry)


def nested_flow(df: DataFrame, screens: Sequence[tuple[str, Column]], units: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows and distinct units that are left after each of a sequence of screens, and the rows each screen takes away.

    A row carries the index of its first failing screen and a unit the largest of its rows', so all screens of all units are
    counted from one shuffle. A screen that is not known to hold fails.
    """
    n = len(screens)
    first = F.coalesce(*[F.when(~surely(p), F.lit(i)) for i, (_, p) in enumerate(screens)], F.lit(n))
    marked = df.select("*", first.alias("_first"))
    rows = marked.groupBy("_first").agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_rows").alias("what"), F.col("_first").alias("last"), "v")
    if units:
        per_unit = unit_rows(marked, units, ["_first"]).groupBy("what", "key").agg(F.max("_first").alias("last"))
        rows = rows.unionAll(per_unit.groupBy("what", "last").agg(F.count(F.lit(1)).alias("v")))
    # at most kinds x screens rows from here on
    steps = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step_no")
    left = rows.select("what", "last", "v", steps)
    wide = left.groupBy("step_no").agg(*[F.sum(F.when(F.col("what") == x, F.col("v"))).alias(x) for x in ("n_rows", *units)],
                                       F.sum(F.when((F.col("what") == "n_rows") & (F.col("last") == F.col("step_no")), F.col("v"))).alias("gone"))
    spark = df.sparkSession
    names = spark.createDataFrame([(i, "Start" if i == 0 else screens[i - 1][0]) for i in range(n + 1)], "step_no int, step string")
    out = names.join(wide, "step_no", "left")
    taken = F.when(F.col("step_no") < n, F.coalesce("gone", F.lit(0))).otherwise(F.lit(0))
    return out.select("step_no", "step", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_rows", *units)], taken.cast("long").alias("fail_next"))


def concordance(df: DataFrame, computed: str, recorded: str) -> DataFrame:
    """Agreement of a computed and a recorded measure over rows where both are known."""
    from .ordered import exact_quantiles

    both = df.where(F.col(computed).isNotNull() & F.col(recorded).isNotNull()).select(
        F.col(computed).alias("x"), F.col(recorded).alias("y"), (F.col(computed) - F.col(recorded)).alias("e"))
    stats = both.agg(
        F.count(F.lit(1)).alias("observations"), F.corr("x", "y").alias("pearson_correlation"),
        F.avg(F.abs("e")).alias("mean_absolute_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms_error"),
        F.max(F.abs("e")).alias("max_absolute_error"))
    return stats.crossJoin(exact_quantiles(both, [], "e", {"median_signed_error": 0.5}))


# fixed values: how far a computed measure may be from the recorded one
CONCORDANT = {"minimum_r": 0.9999, "maximum_mae": 0.01, "maximum_error": 0.05}


def concordance_verdict(audit: DataFrame, minimum_r: float = CONCORDANT["minimum_r"], maximum_mae: float = CONCORDANT["maximum_mae"],
                        maximum_error: float = CONCORDANT["maximum_error"]) -> DataFrame:
    """The audit with a verdict for each limit and for all; an unknown value does not pass."""
    limits = {"correlated": F.col("pearson_correlation") >= minimum_r, "mean_error_small": F.col("mean_absolute_error") <= maximum_mae,
              "largest_error_small": F.col("max_absolute_error") <= maximum_error}
    out = audit.select("*", *[surely(p).alias(n) for n, p in limits.items()])
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(n) for n in limits]))


def gate_concordance(audit: DataFrame, **limits: float) -> DataFrame:
    if not concordance_verdict(audit, **limits).where(~F.col("passed")).isEmpty():
        raise AuditFailure("computed and recorded measures disagree")
    return audit


def same_rows(actual: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str],
              tolerance: float = 1e-10) -> DataFrame:
    """Per-field comparison of two keyed tables: one-sided keys, repeated keys and differing values.

    A field differs when exactly one side is missing or the relative difference exceeds the tolerance.
    """
    def keyed(df, tag):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{tag}"),
                                     *[F.first(x).alias(f"{tag}_{x}") for x in fields])

    a, e = keyed(actual, "a"), keyed(expected, "e")
    on = reduce(lambda p, q: p & q, [a[k].eqNullSafe(e[k]) for k in keys])
    both = a.join(e, on, "full")
    matched = F.col("n_a").isNotNull() & F.col("n_e").isNotNull()
    numeric = {f.name for f in actual.schema if f.dataType.typeName() not in ("string", "boolean")}

    def differs(x):
        p, q = F.col(f"a_{x}"), F.col(f"e_{x}")
        if x in numeric:
            far = F.abs(p - q) > F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(q))
            return matched & (surely(far) | (p.isNull() != q.isNull()))
        return matched & ~p.eqNullSafe(q)

    wide = both.agg(
        F.count_if(matched).alias("matched_keys"),
        F.count_if(F.col("n_e").isNull()).alias("only_actual"),
        F.count_if(F.col("n_a").isNull()).alias("only_expected"),
        F.count_if(surely((F.col("n_a") > 1) | (F.col("n_e") > 1))).alias("repeated_keys"),
        *[F.count_if(differs(x)).alias(f"d{i}") for i, x in enumerate(fields)])
    rows = long_metrics(wide, {x: f"d{i}" for i, x in enumerate(fields)}, "field", "different",
                        ["matched_keys", "only_actual", "only_expected", "repeated_keys"])
    return rows.withColumn("same", (F.col("only_actual") == 0) & (F.col("only_expected") == 0)
                           & (F.col("repeated_keys") == 0) & (F.col("different") == 0))


def ledger(checks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """One row per check; each check is a one-row DataFrame with a boolean column ``passed``."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("check"), surely(F.col("passed")).alias("passed"), F.lit(detail).alias("detail"))
        for name, df, detail in checks])


def groups_crossing(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups seen in more than one part (fold, split); must be empty for honest validation."""
    return df.groupBy(group).agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a <> b").select(group)


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def unseen_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return test.select(key).distinct().join(train.select(key).distinct(), key, "left_anti")


def keys_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, list(keys), "full").agg(
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right")).withColumn(
        "passed", (F.col("only_left") == 0) & (F.col("only_right") == 0))
