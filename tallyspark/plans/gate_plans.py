"""Gates over whole tables: keys and references, nested screens, row numbers, frozen copies, changes of code sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, cohorts, constraints, ordered, summaries
from ..operators.constraints import Reference, Unique
from ..settings import DEFAULTS
from . import audit_plans as a
from . import link_plans as lk
from . import tables as t
from .tables import sql


def record_constraints(spark, sf):
    """The declared keys of the record tables, and the references between them."""
    visits, units, conditions, slices = t.visits(spark, sf), t.units(spark, sf), t.conditions(spark, sf), t.slices(spark, sf)
    tallies, tagged = t.tallies(spark, sf), t.tagged_stems(spark, sf)
    return [
        Unique("visit records", visits, ("plt_cn",)),
        Unique("supplement subplot records", a.sup_subplots(spark, sf), ("plt_cn", "subp")),
        Unique("core subplot records", lk.subplots(spark, sf), ("plt_cn", "subp")),
        Unique("condition records", conditions, ("plt_cn", "condid")),
        Unique("subplot-condition records", slices, ("plt_cn", "condid", "subp")),
        Unique("tagged stem identifiers", tagged, ("tree_cn",)),
        Unique("tally groups", tallies, ("plt_cn", "condid", "subp", "spcd")),
        Reference("tally to subplot-condition", tallies, ("plt_cn", "condid", "subp"), slices, ("plt_cn", "condid", "subp")),
        Reference("condition to visit", conditions, ("plt_cn",), visits, ("plt_cn",)),
        Reference("visit to unit", visits, ("unit",), units, ("unit",)),
        Reference("stem to previous stem", tagged, ("prev_tre_cn",), tagged, ("tree_cn",), optional=True),
    ]


def key_gates(spark, sf):
    return constraints.key_audit(record_constraints(spark, sf))


def _unique_sql(i, label, table, keys):
    return f"""SELECT CAST({i} AS INTEGER) AS constraint, '{label}' AS label, 'unique' AS kind, count(*) AS keys, count(*) FILTER (n>1) AS broken_keys,
  CAST(coalesce(sum(n) FILTER (n>1),0) AS BIGINT) AS broken_rows FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"""


def _reference_sql(i, label, table, keys, parent, parent_keys):
    pick = ", ".join(f"{k} AS k{j}" for j, k in enumerate(keys.split(", ")))
    own = ", ".join(f"{k} AS k{j}" for j, k in enumerate(parent_keys.split(", ")))
    on = " AND ".join(f"p.k{j} IS NOT DISTINCT FROM c.k{j}" for j in range(len(keys.split(", "))))
    return f"""SELECT CAST({i} AS INTEGER), '{label}', 'reference', count(*), count(*) FILTER (users>0 AND NOT own), CAST(coalesce(sum(users) FILTER (users>0 AND NOT own),0) AS BIGINT)
  FROM (SELECT coalesce(c.n,0) AS users, p.k0 IS NOT NULL AS own FROM (SELECT {pick}, count(*) AS n FROM {table} GROUP BY ALL) c FULL JOIN (SELECT DISTINCT {own} FROM {parent}) p ON {on})"""


KEY_SQL = sql("visits units conditions tallies tagged", "SELECT *, broken_keys=0 AS passed FROM (" + " UNION ALL ".join([
    _unique_sql(0, "visit records", "visits", "plt_cn"), _unique_sql(1, "supplement subplot records", "(SELECT DISTINCT plt_cn, subp FROM slices)", "plt_cn, subp"),
    _unique_sql(2, "core subplot records", "(SELECT DISTINCT plt_cn, subp FROM slices)", "plt_cn, subp"), _unique_sql(3, "condition records", "conditions", "plt_cn, condid"),
    _unique_sql(4, "subplot-condition records", "slices", "plt_cn, condid, subp"), _unique_sql(5, "tagged stem identifiers", "tagged", "tree_cn"),
    _unique_sql(6, "tally groups", "tallies", "plt_cn, condid, subp, spcd"),
    _reference_sql(7, "tally to subplot-condition", "tallies", "plt_cn, condid, subp", "slices", "plt_cn, condid, subp"),
    _reference_sql(8, "condition to visit", "conditions", "plt_cn", "visits", "plt_cn"), _reference_sql(9, "visit to unit", "visits", "unit", "units", "unit"),
    _reference_sql(10, "stem to previous stem", "(SELECT * FROM tagged WHERE prev_tre_cn IS NOT NULL)", "prev_tre_cn", "tagged", "tree_cn")]) + ")")


def broken_references(spark, sf):
    """Every key that breaks a constraint, as the row that a repair needs."""
    return constraints.offending_keys(record_constraints(spark, sf)).where("label = 'tally groups'").select(
        F.get_json_object("key", "$.k0").cast("long").alias("plt_cn"), F.get_json_object("key", "$.k1").alias("condid"), F.get_json_object("key", "$.k2").cast("int").alias("subp"),
        F.get_json_object("key", "$.k3").alias("spcd"), F.col("owners").alias("records"))


BROKEN_SQL = sql("tallies", "SELECT plt_cn, condid, subp, spcd, count(*) AS records FROM tallies GROUP BY ALL HAVING count(*)>1")

LOW, HIGH = DEFAULTS.interval_bounds[0] / 10, DEFAULTS.interval_bounds[1] / 10  # bounds of the table's shorter intervals
SCREENS = (
    ("Accessible forest at the start", "baseline_cond_status_cd=1 AND baseline_plot_status_cd=1"),
    ("Northern-hardwood type at the start", "baseline_fortypcd IN (801,805)"),
    ("Count protocol at the start", "baseline_manual>=51e-1"),
    ("Count protocol at the follow-up", "followup_manual>=51e-1"),
    ("Accessible forest at the follow-up", "followup_cond_status_cd=1 AND followup_plot_status_cd=1"),
    ("Bidirectional one-to-one mapping", "strict_one_to_one"),
    ("Shared footprint on both sides", "baseline_overlap_fraction>=9e-1 AND followup_overlap_fraction>=9e-1"),
    ("Predecessor agrees", "plot_prev_link_matches"),
    ("Positive interval", "interval_years>0"),
    (f"Interval of {LOW} to {HIGH} years", f"interval_years>={int(LOW * 100)}e-2 AND interval_years<={int(HIGH * 100)}e-2"),
)


def interval_screens(spark, sf):
    """Condition links, their starting conditions and their plots that are left after each screen of the historical expansion."""
    return checks.nested_flow(lk.candidates(spark, sf, None), [(n, F.expr(p)) for n, p in SCREENS],
                              {"baseline_conditions": ["baseline_plt_cn", "baseline_condid"], "physical_plots": ["physical_plot_key"]})


_FIRST = "CASE " + " ".join(f"WHEN NOT coalesce({p},false) THEN {i}" for i, (_, p) in enumerate(SCREENS)) + f" ELSE {len(SCREENS)} END"
SCREEN_SQL = sql("visits conditions links", f"""SELECT CAST(i AS INTEGER) AS step_no, CASE i WHEN 0 THEN 'Start' {" ".join(f"WHEN {i + 1} THEN '{n}'" for i, (n, _) in enumerate(SCREENS))} END AS step,
  count(*) FILTER (f>=i) AS n_rows, count(DISTINCT (baseline_plt_cn, baseline_condid)) FILTER (f>=i) AS baseline_conditions,
  count(DISTINCT physical_plot_key) FILTER (f>=i) AS physical_plots, count(*) FILTER (f=i AND i<{len(SCREENS)}) AS fail_next
  FROM (SELECT *, {_FIRST} AS f FROM cand), range({len(SCREENS) + 1}) r(i) GROUP BY i""", lk.ALLCAND)


def pair_numbers(spark, sf):
    """Condition intervals numbered without gaps in the order of their keys."""
    p = lk.candidates(spark, sf, None).where("strict_one_to_one").select("baseline_plt_cn", "baseline_condid", "current_plt_cn", "current_condid")
    return ordered.numbered(p, ["baseline_plt_cn", "baseline_condid", "current_plt_cn", "current_condid"], "pair_id")


NUMBER_SQL = sql("visits conditions links", """SELECT baseline_plt_cn, baseline_condid, current_plt_cn, current_condid,
  row_number() OVER (ORDER BY baseline_plt_cn, baseline_condid, current_plt_cn, current_condid) AS pair_id FROM cand WHERE strict_one_to_one""", lk.ALLCAND)


def frozen_visits(spark, sf):
    """A copy of the visits in another order with planted differences: rows gone, values changed, rows given twice."""
    v = t.visits(spark, sf).where("plt_cn % 89 <> 0").withColumn("plot_total", F.when(F.col("plt_cn") % 97 == 0, F.col("plot_total") + 1).otherwise(F.col("plot_total")))
    return v.unionAll(v.where("plt_cn % 83 = 0")).select(*reversed(v.columns)).orderBy(F.xxhash64("plt_cn"))


def frozen_bundle(spark, sf):
    """The keys whose rows differ between the visits and a frozen copy of them."""
    return constraints.differences(t.visits(spark, sf), frozen_visits(spark, sf), ["plt_cn"])


FROZEN_SQL = sql("visits", """SELECT plt_cn, CASE WHEN plt_cn%89=0 THEN 'missing' WHEN plt_cn%97=0 THEN 'changed' ELSE 'repeated' END AS kind, CAST(1 AS BIGINT) AS n_left,
  CAST(CASE WHEN plt_cn%89=0 THEN 0 WHEN plt_cn%83=0 THEN 2 ELSE 1 END AS BIGINT) AS n_right FROM visits WHERE plt_cn%89=0 OR plt_cn%97=0 OR plt_cn%83=0""")


def code_changes(spark, sf):
    return summaries.code_changes(a.monthly_codes(spark, sf), "period", "code")


CHANGE_SQL = sql("visits", """SELECT previous_period, current_period, code, change FROM steps, LATERAL (
  SELECT code, 'added' AS change FROM (SELECT code FROM m WHERE period=current_period EXCEPT SELECT code FROM m WHERE period=previous_period)
  UNION ALL SELECT code, 'removed' FROM (SELECT code FROM m WHERE period=previous_period EXCEPT SELECT code FROM m WHERE period=current_period))""",
                 "m AS (SELECT DISTINCT strftime(visit_date,'%Y-%m') AS period, lpad(CAST(c_nationkey AS VARCHAR),2,'0')||'-'||c_mktsegment AS code FROM visits JOIN customer ON c_custkey=unit),"
                 " steps AS (SELECT * FROM (SELECT lag(period) OVER (ORDER BY period) AS previous_period, period AS current_period FROM (SELECT DISTINCT period FROM m)) WHERE previous_period IS NOT NULL)")

def stacked_records(spark, sf):
    """Stems, tallies and visits under each other: how many values of each column each source has."""
    parts = {"stems": t.stems(spark, sf).select("plt_cn", "condid", "spcd", "dia"), "tallies": t.tallies(spark, sf).select("plt_cn", "condid", "spcd", "treecount"),
             "visits": t.visits(spark, sf).select("plt_cn", "measyear")}
    s = cohorts.stacked(parts, "source")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("records"), *[F.count(c).alias(c) for c in ("condid", "spcd", "dia", "treecount", "measyear")])


STACK_SQL = sql("stems tallies visits", """SELECT 'stems' AS source, count(*) AS records, count(condid) AS condid, count(spcd) AS spcd, count(dia) AS dia, CAST(0 AS BIGINT) AS treecount, CAST(0 AS BIGINT) AS measyear FROM stems
  UNION ALL SELECT 'tallies', count(*), count(condid), count(spcd), 0, count(treecount), 0 FROM tallies UNION ALL SELECT 'visits', count(*), 0, 0, 0, 0, count(measyear) FROM visits""")

QUERIES = {
    "stacked_records": (stacked_records, STACK_SQL),
    "key_gates": (key_gates, KEY_SQL), "broken_references": (broken_references, BROKEN_SQL), "interval_screens": (interval_screens, SCREEN_SQL),
    "pair_numbers": (pair_numbers, NUMBER_SQL), "frozen_bundle": (frozen_bundle, FROZEN_SQL), "code_changes": (code_changes, CHANGE_SQL),
}
