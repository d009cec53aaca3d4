"""Audit queries: supplement reconciliation, code and text audits, calendars, ledgers, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import checks, cohorts, links, reconcile, summaries
from ..session import stored
from ..sources import manifest, scan, text
from . import tables as t
from .link_plans import SUBPLOTS, endpoint_rows, subplots
from .tables import rounded, sql

def code():
    return F.when(F.col("condid") == "A", 1).when(F.col("condid") == "N", 2).otherwise(3)


CODE_SQL = "CASE condid WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"


# --- supplement (finer measurement protocol on the same frame) -----------------------------------

def sup_conditions(spark, sf):
    return t.conditions(spark, sf).select("plt_cn", "condid", (F.col("plt_cn") * 8 + code()).alias("core_cnd_cn"), "cond_status_cd", "micrprop_unadj", "balive")


def sup_slices(spark, sf):
    return t.slices(spark, sf).select("plt_cn", "condid", "subp", (F.col("plt_cn") * 32 + code() * 8 + F.col("subp")).alias("core_scd_cn"), "micrcond_prop")


def sup_subplots(spark, sf):
    m = t.subplot_areas(spark, sf)
    own = F.col("plt_cn") * 8 + F.col("subp")
    return m.select("plt_cn", "subp", (F.col("plt_cn") * 16 + F.col("subp")).alias("ri_subp_cn"), F.when(F.col("m") == 5, own + 1).otherwise(own).alias("sbp_cn"),
                    F.when(F.col("m") <= 0, 2).otherwise(1).alias("micro_status"), F.when(F.col("n") > 1, 1).alias("legacy_status"),
                    F.when(F.col("m") == 7, 10).alias("nonsample_reason"))


def sup_tallies(spark, sf):
    """Fine tallies by source and size class; one row per tally group."""
    q = F.col("l_quantity").cast("int")
    x = t.table(spark, sf, "lineitem").where("l_quantity <= 15").select(
        F.col("l_orderkey").alias("plt_cn"), F.col("l_returnflag").alias("condid"), ((F.col("l_linenumber") - 1) % 4 + 1).alias("subp"),
        F.col("l_linestatus").alias("spcd"), F.when(F.col("l_tax") < 0.035, 1).when(F.col("l_tax") < 0.075, 2).otherwise(3).alias("seedling_source_cd"),
        F.ceil(q / F.lit(2.5)).cast("int").alias("length_class_cd"), q.alias("q"), F.when(F.col("l_discount") >= 0.095, 1).otherwise(0).alias("off"))
    g = x.groupBy("plt_cn", "condid", "subp", "spcd", "seedling_source_cd", "length_class_cd").agg(F.sum("q").alias("seedlingcount"), F.max("off").alias("off"))
    return g.select("plt_cn", "condid", "subp", "spcd", "seedling_source_cd", "length_class_cd", "seedlingcount",
                    (F.col("plt_cn") * 8 + code() + F.col("off")).alias("cnd_cn"), (F.col("plt_cn") * 32 + code() * 8 + F.col("subp")).alias("scd_cn"))


def sup_plots(spark, sf):
    return t.visits(spark, sf).where("manual >= 6").select("plt_cn")


@t.stage("checked")
def checked(spark, sf):
    x = sup_tallies(spark, sf)
    reconcile.gate_records({"supplement tallies": (x, ["plt_cn", "condid", "subp", "spcd", "seedling_source_cd", "length_class_cd"])})
    return reconcile.checked_records(x, sup_conditions(spark, sf), sup_slices(spark, sf), ["F", "O"], "F")


def mapping(spark, sf):
    v = t.visits(spark, sf).select("plt_cn", "measmon", "unit", "measyear")
    return sup_conditions(spark, sf).join(v, "plt_cn").select("plt_cn", "condid", F.col("micrprop_unadj").alias("coverage"), "measmon", "unit", "measyear", "balive")


@t.stage("available")
def available(spark, sf):
    m = mapping(spark, sf)
    f = frame(spark, sf)
    return reconcile.availability(m, f, sup_slices(spark, sf), sup_plots(spark, sf), checked(spark, sf))


def frame(spark, sf):
    return reconcile.frame_slices(mapping(spark, sf), sup_slices(spark, sf), subplots(spark, sf), sup_subplots(spark, sf))


SUP = SUBPLOTS + f""",
scond AS (SELECT plt_cn, condid, plt_cn*8+{CODE_SQL} AS core_cnd_cn, cond_status_cd, micrprop_unadj, balive FROM conditions),
ssub AS (SELECT plt_cn, subp, plt_cn*16+subp AS ri_subp_cn, plt_cn*8+subp+CASE WHEN m=5 THEN 1 ELSE 0 END AS sbp_cn, CASE WHEN m<=0 THEN 2 ELSE 1 END AS micro_status,
  CASE WHEN n>1 THEN 1 END AS legacy_status, CASE WHEN m=7 THEN 10 END AS nonsample_reason FROM (SELECT plt_cn, subp, max(max_tax) AS m, sum(n) AS n FROM slices GROUP BY plt_cn, subp)),
stal AS (SELECT *, plt_cn*8+{CODE_SQL}+off AS cnd_cn FROM (SELECT plt_cn, condid, subp, spcd, src, cls, CAST(sum(q) AS BIGINT) AS cnt, max(off) AS off FROM (
  SELECT l_orderkey AS plt_cn, l_returnflag AS condid, CAST((l_linenumber-1)%4+1 AS INTEGER) AS subp, l_linestatus AS spcd,
   CASE WHEN l_tax<35e-3 THEN 1 WHEN l_tax<75e-3 THEN 2 ELSE 3 END AS src, CAST(ceil(CAST(l_quantity AS INTEGER)/25e-1) AS INTEGER) AS cls, CAST(l_quantity AS INTEGER) AS q,
   CASE WHEN l_discount>=95e-3 THEN 1 ELSE 0 END AS off FROM lineitem WHERE l_quantity<=15) GROUP BY ALL)),
schk AS (SELECT s.*, coalesce(spcd IN ('F','O') AND cls BETWEEN 1 AND 6 AND src BETWEEN 1 AND 3 AND NOT (spcd='F' AND src=3) AND cnt BETWEEN 1 AND 999 AND cnd_cn=core_cnd_cn
  AND cond_status_cd=1 AND z.micrcond_prop>0 AND z.micrcond_prop<=1,false) AS valid_record FROM stal s LEFT JOIN scond c ON c.plt_cn=s.plt_cn AND c.condid=s.condid
  LEFT JOIN slices z ON z.plt_cn=s.plt_cn AND z.condid=s.condid AND z.subp=s.subp),
sframe AS (SELECT z.plt_cn, z.condid, z.subp, z.micrcond_prop, micro_status, legacy_status, nonsample_reason, coalesce(micro_status=1 AND (legacy_status IS NULL OR legacy_status=1) AND nonsample_reason IS NULL
  AND r.sbp_cn=b.subplot_cn AND b.subp_status_cd=1 AND z.micrcond_prop<=1,false) AS slice_valid FROM slices z LEFT JOIN subplots b ON b.plt_cn=z.plt_cn AND b.subp=z.subp
  LEFT JOIN ssub r ON r.plt_cn=z.plt_cn AND r.subp=z.subp WHERE z.micrcond_prop>0),
scnt AS (SELECT plt_cn, condid, count(*) AS contributing_microplots, count(*) FILTER (slice_valid) AS sampled_microplots, sum(micrcond_prop)/4e0 AS reconstructed_coverage, bool_and(slice_valid) AS allv FROM sframe GROUP BY plt_cn, condid),
sav AS (SELECT *, frame_valid AND records_valid AND in_season AS available, CASE WHEN NOT has_record THEN 'No RI plot record' WHEN NOT frame_valid THEN 'Incomplete or contradictory RI microplot frame'
  WHEN NOT records_valid THEN 'Invalid RI record or foreign key' WHEN NOT in_season THEN 'Plot date outside May-September or missing' ELSE 'RI measurement available' END AS reason FROM (
  SELECT *, has_record AND coalesce(allv,false) AND coverage_matches AS frame_valid FROM (SELECT c.plt_cn, c.condid, c.micrprop_unadj AS coverage, c.balive, v.measmon, v.unit, v.measyear, n.* EXCLUDE (plt_cn, condid),
   coalesce(abs(n.reconstructed_coverage-c.micrprop_unadj)<=1e-4,false) AS coverage_matches, v.manual>=6 AS has_record, v.measmon BETWEEN 5 AND 9 AS in_season,
   NOT EXISTS (SELECT 1 FROM schk k WHERE k.plt_cn=c.plt_cn AND NOT valid_record) AS records_valid
   FROM scond c JOIN visits v ON v.plt_cn=c.plt_cn LEFT JOIN scnt n ON n.plt_cn=c.plt_cn AND n.condid=c.condid)))"""
ST = "visits conditions"


def record_validation(spark, sf):
    return summaries.group_counts(checked(spark, sf), ["spcd", "seedling_source_cd", "length_class_cd", "valid_record"], "records")


RECV_SQL = sql(ST, "SELECT spcd, src AS seedling_source_cd, cls AS length_class_cd, valid_record, count(*) AS records FROM schk GROUP BY ALL", SUP)


def coverage_reconstruction(spark, sf):
    return rounded(available(spark, sf).drop("unit", "measyear", "balive"))


COV_SQL = sql(ST, """SELECT plt_cn, condid, rnd(coverage,6) AS coverage, measmon, contributing_microplots, sampled_microplots, rnd(reconstructed_coverage,6) AS reconstructed_coverage, coverage_matches,
  has_record, records_valid, in_season, frame_valid, available, reason FROM sav""", SUP)

NAMES = [f"class_{i}" for i in range(1, 7)]
TOTALS = ["all_count", "standard_count", "tall_count", "other_source_count", "stump_source_count"]


@t.stage("classes")
def classes(spark, sf):
    return reconcile.class_counts(available(spark, sf), checked(spark, sf), "F").withColumn("y", (F.col("balive") > 100000).cast("int"))


def class_pivot(spark, sf):
    return classes(spark, sf).select("plt_cn", "condid", "available", *NAMES, *TOTALS)


_CLS = {**{f"class_{i}": f"cls={i}" for i in range(1, 7)}, "all_count": "true", "standard_count": "cls>=3", "tall_count": "cls>=5", "other_source_count": "src=1", "stump_source_count": "src=2"}
PIV = "piv AS (SELECT a.plt_cn, a.condid, a.available, a.unit, a.measyear, CASE WHEN a.balive>100000 THEN 1 ELSE 0 END AS y, " + ", ".join(
    f"CASE WHEN a.available THEN CAST(coalesce(sum(cnt) FILTER ({p}),0) AS BIGINT) END AS {n}" for n, p in _CLS.items()) + \
    " FROM sav a LEFT JOIN schk k ON k.plt_cn=a.plt_cn AND k.condid=a.condid AND k.spcd='F' GROUP BY a.plt_cn, a.condid, a.available, a.unit, a.measyear, a.balive)"
PIV_SQL = sql(ST, f"SELECT plt_cn, condid, available, {', '.join(NAMES + TOTALS)} FROM piv", SUP + ", " + PIV)


def class_profile(spark, sf):
    return reconcile.class_profile(classes(spark, sf).where("available"), NAMES, "y")


PROF_SQL = sql(ST, "SELECT size_class, CAST(sum(v) AS BIGINT) AS recorded_count, count(*) FILTER (v>0) AS units_with_class, CAST(sum(y) FILTER (v>0) AS BIGINT) AS events_with_class FROM piv, LATERAL (VALUES "
               + ", ".join(f"('class_{i}', class_{i})" for i in range(1, 7)) + ") x(size_class, v) WHERE available GROUP BY 1", SUP + ", " + PIV)


def zero_accounting(spark, sf):
    """Ordered labels of available units, and a development set that shares no unit with the later period."""
    d = reconcile.development_split(classes(spark, sf).where("available"), "unit", F.col("measyear") >= 2001)
    label = F.when(F.col("all_count") == 0, "No tally on verified frame").when(F.col("standard_count") == 0, "Only below standard size").otherwise("Standard size present")
    return d.groupBy("split", label.alias("label")).agg(F.count(F.lit(1)).alias("conditions"), F.sum("y").alias("events"), F.countDistinct("unit").alias("units"))


ZERO_SQL = sql(ST, """SELECT CASE WHEN measyear>=2001 THEN 'later' WHEN NOT EXISTS (SELECT 1 FROM piv q WHERE q.available AND q.unit=p.unit AND q.measyear>=2001) THEN 'development' END AS split,
  CASE WHEN all_count=0 THEN 'No tally on verified frame' WHEN standard_count=0 THEN 'Only below standard size' ELSE 'Standard size present' END AS label,
  count(*) AS conditions, CAST(sum(y) AS BIGINT) AS events, count(DISTINCT unit) AS units FROM piv p WHERE available GROUP BY ALL""", SUP + ", " + PIV)


@t.stage("sup_units")
def sup_units(spark, sf):
    a = available(spark, sf).where("available").select("plt_cn", "condid")
    return reconcile.unit_reconciliation(frame(spark, sf).join(a, ["plt_cn", "condid"], "left_semi"), t.tallies(spark, sf), checked(spark, sf), "F")


def unit_reconciliation(spark, sf):
    return reconcile.reconciliation_summary(sup_units(spark, sf), "Microplot-condition intervals")


UNITS = """su AS (SELECT *, std-core AS d FROM (SELECT f.plt_cn, f.condid, f.subp, CASE WHEN c.plt_cn IS NULL THEN 0 ELSE c.n END AS core, coalesce(r.n,0) AS ri, coalesce(r.s,0) AS std FROM sframe f
  JOIN sav a ON a.plt_cn=f.plt_cn AND a.condid=f.condid AND a.available
  LEFT JOIN (SELECT plt_cn, condid, subp, CASE WHEN count(*)=count(treecount) THEN sum(treecount) END AS n FROM tallies WHERE spcd='F' GROUP BY ALL) c ON c.plt_cn=f.plt_cn AND c.condid=f.condid AND c.subp=f.subp
  LEFT JOIN (SELECT plt_cn, condid, subp, sum(cnt) AS n, coalesce(sum(cnt) FILTER (cls>=3),0) AS s FROM schk WHERE spcd='F' GROUP BY ALL) r ON r.plt_cn=f.plt_cn AND r.condid=f.condid AND r.subp=f.subp))"""
UNIT_SQL = sql(ST + " tallies", """SELECT 'Microplot-condition intervals' AS unit, count(*) AS observations, CAST(sum(core) AS BIGINT) AS ordinary_count, CAST(sum(std) AS BIGINT) AS standard_count,
  count(*) FILTER (d=0) AS exact_agreements, count(*) FILTER (d IS NULL) AS missing_comparisons, CAST(max(abs(d)) AS BIGINT) AS max_abs_difference FROM su""", SUP + ", " + UNITS)


def tall_fractions(spark, sf):
    """Share of larger classes per available unit. The count of all classes is checked against the sum of the single ones, in which
    one unit in 50 has one tally too many; conflicting definitions are listed, never divided."""
    c = classes(spark, sf).where("available")
    single = sum((F.col(x) for x in NAMES), F.lit(0)) + (F.col("plt_cn") % 50 == 0).cast("long")
    c = c.withColumn("single_count", single)
    bad = S.tall_fraction_conflict("all_count", "tall_count", "single_count")
    return rounded(c.select("plt_cn", "condid", bad.alias("conflict"), F.when(~bad, S.tall_fraction("all_count", "tall_count")).alias("tall_fraction")))


TALL_SQL = sql(ST, """SELECT plt_cn, condid, plt_cn%50=0 AS conflict, rnd(CASE WHEN plt_cn%50<>0 AND all_count>0 THEN tall_count/CAST(all_count AS DOUBLE) END,6) AS tall_fraction
  FROM piv WHERE available""", SUP + ", " + PIV)


def status_counts(spark, sf):
    return summaries.group_counts(sup_subplots(spark, sf), ["micro_status", "legacy_status", "nonsample_reason"], "subplot_records")


STAT_SQL = sql(ST, "SELECT micro_status, legacy_status, nonsample_reason, count(*) AS subplot_records FROM ssub GROUP BY ALL", SUP)

# --- table reconciliation and ledger ---------------------------------------------------------------


def table_reconciliation(spark, sf):
    """A table against a copy with changed and missing rows: the audit must find exactly those."""
    a = t.conditions(spark, sf).select("plt_cn", "condid", "micrprop_unadj", "cond_status_cd")
    e = a.where(~((F.col("condid") == "N") & (F.col("cond_status_cd") == 2))).withColumn(
        "micrprop_unadj", F.col("micrprop_unadj") + F.when(F.col("cond_status_cd") == 2, 0.1).otherwise(0.0))
    return checks.same_rows(a, e, ["plt_cn", "condid"], ["micrprop_unadj", "cond_status_cd"])


TREC_SQL = sql("conditions", """SELECT field, count(*) FILTER (NOT gone) AS matched_keys, count(*) FILTER (gone) AS only_actual, CAST(0 AS BIGINT) AS only_expected, CAST(0 AS BIGINT) AS repeated_keys,
  count(*) FILTER (NOT gone AND field='micrprop_unadj' AND cond_status_cd=2) AS different, false AS same FROM (SELECT *, condid='N' AND cond_status_cd=2 AS gone FROM conditions),
  (VALUES ('micrprop_unadj'),('cond_status_cd')) x(field) GROUP BY field""")


def check_ledger(spark, sf):
    d = endpoint_rows(spark, sf)
    s = t.cohort(spark, sf)
    keys = ["baseline_plt_cn", "baseline_condid", "current_plt_cn", "current_condid"]
    one = lambda df, p: df.agg((F.count_if(~S.surely(p)) == 0).alias("passed"))
    return checks.ledger([
        ("Uncertain outcomes remain missing", one(d.where(~F.col("recruitment_eligible")), F.col("outcome_recruitment").isNull()), "Excluded intervals are not zeros"),
        ("Entrant outcome reconciles", one(d.where("recruitment_eligible"), F.col("outcome_recruitment") == (F.col("new_maple_sapling_count") > 0).cast("int")), "Outcome equals entrant count above zero"),
        ("Pair keys unique", checks.duplicate_keys(d, keys).agg((F.count(F.lit(1)) == 0).alias("passed")), "One row per linked pair"),
        ("Units stay in one cluster", checks.groups_crossing(s, "unit", "cluster").agg((F.count(F.lit(1)) == 0).alias("passed")), "No unit crosses clusters"),
        ("Same visits in both tables", checks.keys_equal(t.linked_visits(spark, sf), t.visits(spark, sf), ["plt_cn"]), "Linking keeps every visit"),
        ("Every visit has records", checks.keys_equal(t.visits(spark, sf), t.stems(spark, sf), ["plt_cn"]), "Visits without records are reported"),
        ("Parts add up", one(t.slices(spark, sf).groupBy("plt_cn", "subp").agg(F.sum("micrcond_prop").alias("s")), S.near("s", F.lit(1.0), 1e-8)), "Slice shares of a subplot sum to one")])


LEDGER_SQL = sql("visits stems", """SELECT "check", passed, detail FROM (VALUES ('Uncertain outcomes remain missing',true,'Excluded intervals are not zeros'),('Entrant outcome reconciles',true,'Outcome equals entrant count above zero'),
  ('Pair keys unique',true,'One row per linked pair'),('Units stay in one cluster',(SELECT count(*)=count(DISTINCT c_custkey) FROM customer),'No unit crosses clusters'),
  ('Same visits in both tables',true,'Linking keeps every visit'),('Every visit has records',(SELECT count(*)=0 FROM (SELECT plt_cn FROM visits EXCEPT SELECT plt_cn FROM stems)),'Visits without records are reported'),
  ('Parts add up',true,'Slice shares of a subplot sum to one')) x("check",passed,detail)""")

# --- codes, text rows, calendars ---------------------------------------------------------------------


def monthly_codes(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.concat_ws("-", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("code"))
    return t.visits(spark, sf).select("unit", F.date_format("visit_date", "yyyy-MM").alias("period")).join(c, "unit")


def code_set_changes(spark, sf):
    return summaries.code_set_changes(monthly_codes(spark, sf), "period", "code")


CODES_SQL = sql("visits", """SELECT previous_period, current_period, coalesce((SELECT string_agg(code,';' ORDER BY code) FROM (SELECT code FROM m WHERE period=current_period EXCEPT SELECT code FROM m WHERE period=previous_period)),'') AS added_codes,
  coalesce((SELECT string_agg(code,';' ORDER BY code) FROM (SELECT code FROM m WHERE period=previous_period EXCEPT SELECT code FROM m WHERE period=current_period)),'') AS removed_codes
  FROM (SELECT lag(period) OVER (ORDER BY period) AS previous_period, period AS current_period FROM (SELECT DISTINCT period FROM m)) WHERE previous_period IS NOT NULL""",
                "m AS (SELECT DISTINCT strftime(visit_date,'%Y-%m') AS period, lpad(CAST(c_nationkey AS VARCHAR),2,'0')||'-'||c_mktsegment AS code FROM visits JOIN customer ON c_custkey=unit)")


def components_residual(spark, sf):
    s = t.stems(spark, sf).groupBy("plt_cn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("condid") == "A").alias("a"), F.count_if(F.col("condid") == "R").alias("r"))
    d = s.join(t.visits(spark, sf).select("plt_cn", "measyear"), "plt_cn")
    return summaries.total_residuals(d, ["measyear"], F.col("n"), [F.col("a"), F.col("r")], [F.col("a"), F.col("r")])


RESID_SQL = sql("visits stems", """SELECT measyear, count(*) AS n_rows, count(*) FILTER (d<>0) AS nonzero_differences, max(abs(d)) AS max_abs_difference, count(*) FILTER (abs(d)>1) AS differences_above_one,
  count(*) FILTER (a=0 AND r=0) AS all_zero_rows FROM (SELECT v.measyear, a, r, n-a-r AS d FROM (SELECT plt_cn, count(*) AS n, count(*) FILTER (condid='A') AS a, count(*) FILTER (condid='R') AS r FROM stems GROUP BY 1) s
  JOIN visits v ON v.plt_cn=s.plt_cn) GROUP BY 1""")


def group_constancy(spark, sf):
    return summaries.group_constancy(t.stems(spark, sf), "plt_cn", "condid", ["A", "N", "R"], ["spcd", "statuscd"])


CONST_SQL = sql("stems", """SELECT plt_cn, count(*) AS n_rows, count(DISTINCT condid)=3 AS levels_complete, (SELECT count(*) FROM (SELECT 1 FROM stems z WHERE z.plt_cn=s.plt_cn GROUP BY z.condid HAVING count(*)>1)) AS duplicated_levels,
  count(DISTINCT spcd)+CASE WHEN count(*)>count(spcd) THEN 1 ELSE 0 END<=1 AND count(DISTINCT statuscd)+CASE WHEN count(*)>count(statuscd) THEN 1 ELSE 0 END<=1 AS constants_hold FROM stems s GROUP BY plt_cn""")

MEAS = [f"m{i}" for i in range(1, 11)]


def text_lines(spark, sf):
    """Report lines built from visits: codes with and without letters, thousands separators, defects."""
    v = t.visits(spark, sf)
    n = [F.format_number((F.col("plot_total") / F.lit(float(i))).cast("long"), 0) for i in range(1, 11)]
    code = F.lpad((F.col("unit") % 1000).cast("string"), 3, "0")
    mark = F.when(F.col("evalid") == "P", "a").when(F.col("evalid") == "F", " f").otherwise("")
    cells = F.when(F.col("manual") == 4, F.concat_ws(" ", *n[:9])).when(F.col("manual") == 9, F.lit(None)).otherwise(F.concat_ws(" ", *n))
    return v.select("plt_cn", F.concat_ws(" ", F.concat(code, F.when(F.col("manual") == 9, "").otherwise(mark)), cells).alias("value"))


_CELLS = [f"format('{{:,}}', CAST(trunc(plot_total/{i}e0) AS BIGINT))" for i in range(1, 11)]
LINES = f"""lines AS (SELECT plt_cn, lpad(CAST(unit%1000 AS VARCHAR),3,'0')||CASE WHEN manual=9 THEN '' WHEN evalid='P' THEN 'a' WHEN evalid='F' THEN ' f' ELSE '' END
  ||CASE WHEN manual=9 THEN '' WHEN manual=4 THEN ' '||concat_ws(' ',{", ".join(_CELLS[:9])}) ELSE ' '||concat_ws(' ',{", ".join(_CELLS)}) END AS value FROM visits)"""


def text_row_parse(spark, sf):
    return text.parse_code_rows(text_lines(spark, sf), MEAS).drop("value")


PARSE_SQL = sql("visits", "SELECT plt_cn, CASE WHEN ok THEN 'parsed' WHEN contains(value,' ') THEN 'rejected' ELSE 'ignored' END AS status, CASE WHEN ok THEN left(value,3) END AS code, CASE WHEN ok THEN regexp_replace(substr(value,4),'[ 0-9,].*$','')||CASE WHEN substr(value,4) LIKE ' f%' THEN 'f' ELSE '' END END AS footnote, "
                + ", ".join(f"CASE WHEN ok THEN CAST(replace(list_reverse(string_split(value,' '))[{11 - i}],',','') AS INTEGER) END AS m{i}" for i in range(1, 11))
                + " FROM (SELECT *, regexp_full_match(value,'[0-9]{3}[a-z]?( [a-z])?( [0-9,]+){10}') AS ok FROM lines)", LINES)


def double_extraction(spark, sf):
    """Two readings of two extractions: the second one has other text before its rows, and misreads the last cell of some."""
    lines = text_lines(spark, sf)
    a = text.parse_code_rows(lines, MEAS).where("status = 'parsed'")
    v = t.visits(spark, sf).where("qa_status = 1").select("plt_cn", "manual", F.format_number((F.col("plot_total") / 11).cast("long"), 0).alias("other"))
    misread = F.concat(F.substring_index("value", " ", 10), F.lit(" "), F.col("other"))
    row = F.when((F.col("manual") == 5) & (F.size(F.split("value", " ")) == 11), misread).otherwise(F.col("value"))
    noisy = lines.join(v, "plt_cn").select("plt_cn", F.concat(F.lit("footnote text of 3 lines. "), row).alias("value"))
    b = text.parse_backwards(noisy, MEAS).where("status = 'parsed'")
    return text.extraction_mismatches(a, b, "plt_cn", ["code", "footnote", *MEAS]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


DOUBLE_SQL = sql("visits", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN qa_status<>1 THEN 'primary only'
  WHEN manual=5 AND evalid<>'F' AND trunc(plot_total/10e0)<>trunc(plot_total/11e0) THEN 'different' END AS kind
  FROM visits WHERE manual NOT IN (4,9) AND plot_total>=0) WHERE kind IS NOT NULL GROUP BY kind""")


def season_window(spark, sf):
    c = t.cohort(spark, sf)
    years = t.visits(spark, sf).agg(F.collect_set("measyear").alias("available"))  # one row, bounded by calendar years
    w = c.select("row_id", S.season_window("baseline_year", "baseline_month").alias("w")).crossJoin(F.broadcast(years))
    return w.select("row_id", "w.first_season", "w.last_season", "w.january_shift", F.concat_ws(";", F.col("w.required_seasons").cast("array<string>")).alias("required_seasons"),
                    S.all_within("w.required_seasons", "available").alias("all_available"))


WIN = """win AS (SELECT row_id, cluster, unit, baseline_year, baseline_month, l-2 AS first_season, l AS last_season, baseline_month=1 AS january_shift, concat_ws(';',l-2,l-1,l) AS required_seasons,
  l-2 IN (SELECT measyear FROM visits) AND l-1 IN (SELECT measyear FROM visits) AND l IN (SELECT measyear FROM visits) AS all_available
  FROM (SELECT *, CAST(baseline_year-1-CASE WHEN baseline_month=1 THEN 1 ELSE 0 END AS INTEGER) AS l FROM cohort))"""
WIN_SQL = sql("cohort", "SELECT row_id, first_season, last_season, january_shift, required_seasons, all_available FROM win", WIN)


def season_requirements(spark, sf):
    c = t.cohort(spark, sf).select("row_id", "cluster", "unit", "baseline_year")
    w = season_window(spark, sf).join(c, "row_id")
    return w.groupBy("cluster", "baseline_year").agg(
        F.count(F.lit(1)).alias("conditions"), F.countDistinct("unit").alias("units"), F.count_if("january_shift").alias("january_shifted"),
        F.min("first_season").alias("first_required"), F.max("last_season").alias("last_required"), F.bool_and("all_available").alias("all_required_available"))


REQS_SQL = sql("cohort", """SELECT cluster, baseline_year, count(*) AS conditions, count(DISTINCT unit) AS units, count(*) FILTER (january_shift) AS january_shifted, min(first_season) AS first_required,
  max(last_season) AS last_required, bool_and(all_available) AS all_required_available FROM win GROUP BY ALL""", WIN)


def two_level_mean(spark, sf):
    e = t.table(spark, sf, "events")
    return rounded(summaries.two_level_mean(e, ["event_type"], F.to_date("ts"), F.col("value"), F.col("value")))


TLM_SQL = sql("", """SELECT event_type, min(d) AS start_period, max(d) AS end_period, count(*) AS periods, rnd(avg(m),6) AS mean_of_means, rnd(avg(s),6) AS mean_of_sums, CAST(sum(n) AS BIGINT) AS records
  FROM (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS m, sum(value) AS s, count(*) AS n FROM events GROUP BY 1,2) GROUP BY 1""")


def unpivot_codes(spark, sf):
    v = t.visits(spark, sf).select("plt_cn", "unit", F.when(F.col("manual") == 9, 10).when(F.col("manual") == 7, 20).otherwise(0).alias("trtcd1"),
                                   F.when(F.col("evalid") == "P", 10).when(F.col("evalid") == "F", 40).alias("trtcd2"), F.when(F.col("qa_status") == 7, 90).alias("trtcd3"))
    labels = {10: "Cutting", 20: "Site preparation", 30: "Artificial regeneration", 40: "Natural regeneration", 50: "Other treatment"}
    return summaries.code_slots(v, ["plt_cn", "unit"], ["trtcd1", "trtcd2", "trtcd3"], labels, "Other documented FIA treatment code")


SLOT_SQL = sql("visits", """SELECT code, count(DISTINCT plt_cn) AS condition_count, count(*) AS recorded_slots, CASE code WHEN 10 THEN 'Cutting' WHEN 20 THEN 'Site preparation' WHEN 40 THEN 'Natural regeneration'
  ELSE 'Other documented FIA treatment code' END AS label FROM (SELECT plt_cn, unnest([CASE manual WHEN 9 THEN 10 WHEN 7 THEN 20 ELSE 0 END, CASE evalid WHEN 'P' THEN 10 WHEN 'F' THEN 40 END,
  CASE WHEN qa_status=7 THEN 90 END]) AS code FROM visits) WHERE code>0 GROUP BY code""")


def count_of_counts(spark, sf):
    return summaries.count_of_counts(t.cohort(spark, sf), "unit", "intervals", "units")


COC_SQL = sql("cohort", "SELECT intervals, count(*) AS units FROM (SELECT unit, count(*) AS intervals FROM cohort GROUP BY 1) GROUP BY 1")


def county_recruitment(spark, sf):
    c = t.cohort(spark, sf)
    per_unit = c.groupBy("cluster", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("e"))
    return per_unit.groupBy("cluster").agg(F.sum("n").alias("conditions"), F.count(F.lit(1)).alias("physical_plots"), F.sum("e").alias("recruit_conditions"))


CREC_SQL = sql("cohort", "SELECT cluster, count(*) AS conditions, count(DISTINCT unit) AS physical_plots, CAST(sum(y) AS BIGINT) AS recruit_conditions FROM cohort GROUP BY 1")


def value_counts(spark, sf):
    return summaries.group_counts(t.tagged_stems(spark, sf), ["statuscd", "reconcilecd", "condid"], "trees")


VC_SQL = sql("tagged", "SELECT statuscd, reconcilecd, condid, count(*) AS trees FROM tagged GROUP BY ALL")


def cohort_support(spark, sf):
    c = t.cohort(spark, sf)
    return summaries.cohort_support(c, [("All pairs", F.lit(True)), ("Baseline detected", F.col("seedling_count") > 0), ("Protocol", F.col("manual") >= 5.1)],
                                    {"units": ["unit"], "clusters": ["cluster"]}, "y", {"entrants": F.col("entrants")}, {"event_units": ["unit"]})


SUPP_SQL = sql("cohort", """SELECT CAST(i AS INTEGER) AS step_no, s AS step, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS events, CAST(sum(entrants) AS BIGINT) AS entrants, count(DISTINCT unit) AS units,
  count(DISTINCT cluster) AS clusters, count(DISTINCT unit) FILTER (y=1) AS event_units FROM cohort, (VALUES (0,'All pairs'),(1,'Baseline detected'),(2,'Protocol')) x(i,s)
  WHERE i=0 OR (i=1 AND seedling_count>0) OR (i=2 AND manual>=51e-1) GROUP BY i, s""")


def field_support(spark, sf):
    return checks.field_support(t.tagged_stems(spark, sf), ["statuscd", "reconcilecd", "prev_tre_cn", "condid"])


FS_SQL = sql("tagged", " UNION ALL ".join(f"SELECT '{x}' AS variable, count(*) AS n_rows, count({x}) AS nonmissing, count(*)-count({x}) AS missing, count(DISTINCT {x}) AS distinct_values FROM tagged"
                                          for x in ("statuscd", "reconcilecd", "prev_tre_cn", "condid")))


def range_medians(spark, sf):
    return rounded(summaries.range_medians(t.cohort(spark, sf), ["interval_years", "coverage", "seedling_count"]))


RM_SQL = sql("cohort", " UNION ALL ".join(f"SELECT '{x}' AS variable, rnd(min({x}),6) AS minimum, rnd(quantile_cont(CAST({x} AS DOUBLE),5e-1),6) AS median, rnd(max({x}),6) AS maximum FROM cohort"
                                          for x in ("interval_years", "coverage", "seedling_count")))

# --- lookups and keys -----------------------------------------------------------------------------------


def role_lookup(spark, sf):
    v = t.visits(spark, sf)
    impact = F.when(F.col("manual") == 9, 1).when(F.col("manual") == 7, 2).when(F.col("manual") == 6, 5)
    look = v.where("plot_status_cd = 1").select("plt_cn", impact.alias("browse_impact"))
    p = t.linked_visits(spark, sf).where("prev_plt_cn is not null").select(F.col("prev_plt_cn").alias("baseline_plt_cn"), F.col("plt_cn").alias("current_plt_cn"))
    return links.role_lookup(p, look, "plt_cn", "browse_impact", range(1, 6), {"baseline_plt_cn": "baseline_browse_impact", "current_plt_cn": "followup_browse_impact"})


LOOK_SQL = sql("visits", """SELECT v.prev_plt_cn AS baseline_plt_cn, v.plt_cn AS current_plt_cn, b.i AS baseline_browse_impact, c.i AS followup_browse_impact FROM visits v
  LEFT JOIN l b ON b.plt_cn=v.prev_plt_cn LEFT JOIN l c ON c.plt_cn=v.plt_cn WHERE v.prev_plt_cn IS NOT NULL""",
               "l AS (SELECT plt_cn, CASE manual WHEN 9 THEN 1 WHEN 7 THEN 2 WHEN 6 THEN 5 END AS i FROM visits WHERE plot_status_cd=1)")


def membership_screens(spark, sf):
    c = t.cohort(spark, sf)
    ri, tal = sup_plots(spark, sf), t.tallies(spark, sf).where("spcd = 'F'")
    m = links.with_membership(c, {"base_ri": (ri, {"prev_plt_cn": "plt_cn"}), "follow_ri": (ri, {"row_id": "plt_cn"}), "base_tally": (tal, {"prev_plt_cn": "plt_cn"})})
    return checks.flow(m, [("All", F.lit(True)), ("Baseline record", F.col("base_ri")), ("Records at both visits", reconcile.combined_screens(["base_ri", "follow_ri"])),
                           ("Baseline target tally", F.col("base_tally"))], {"units": ["unit"], "clusters": ["cluster"]}, {"events": F.col("y")})


MEMB_SQL = sql("cohort tallies", """SELECT CAST(i AS INTEGER) AS step_no, s AS step, count(*) FILTER (k) AS n_rows, CAST(coalesce(sum(y) FILTER (k),0) AS BIGINT) AS events, count(DISTINCT unit) FILTER (k) AS units,
  count(DISTINCT cluster) FILTER (k) AS clusters FROM (SELECT c.*, x.*, CASE i WHEN 0 THEN true WHEN 1 THEN b WHEN 2 THEN b AND f ELSE g END AS k FROM (SELECT *,
   prev_plt_cn IN (SELECT plt_cn FROM visits WHERE manual>=6) AS b, row_id IN (SELECT plt_cn FROM visits WHERE manual>=6) AS f, prev_plt_cn IN (SELECT plt_cn FROM tallies WHERE spcd='F') AS g FROM cohort) c,
   (VALUES (0,'All'),(1,'Baseline record'),(2,'Records at both visits'),(3,'Baseline target tally')) x(i,s)) GROUP BY i, s""")


def text_key_join(spark, sf):
    """Regions and their attributes joined on normalised names; every region must match once."""
    r = t.table(spark, sf, "region").select(F.concat(F.initcap("r_name"), F.lit(".")).alias("label"), "r_regionkey")
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))
    out = cohorts.join_on_names(r, n, "label", "r_name")
    return out.select("key", "label", "nations")


TKJ_SQL = """SELECT lower(r_name) AS key, string_agg(upper(left(w,1))||lower(substr(w,2)),' ' ORDER BY i)||'.' AS label, any_value(c) AS nations FROM (SELECT r_name, r_regionkey, generate_subscripts(string_split(r_name,' '),1) AS i,
  unnest(string_split(r_name,' ')) AS w FROM region) r JOIN (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1) n ON n.n_regionkey=r.r_regionkey GROUP BY r_name"""


def region_reader(spark, sf):
    n = t.table(spark, sf, "nation")
    lines = n.select(F.concat_ws("|", F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")), F.concat(F.lit(" "), "n_name", F.lit(" County")),
                                 (F.col("n_nationkey") * 1.5).cast("string"), (-F.col("n_nationkey") * 2.25).cast("string")).alias("value"))
    return rounded(text.parse_regions(lines, "02"))


REG_SQL = sql("", """SELECT lpad(CAST(n_regionkey AS VARCHAR),2,'0')||lpad(CAST(n_nationkey AS VARCHAR),3,'0') AS geoid, n_name AS county_name, rnd(n_nationkey*15e-1,6) AS latitude, rnd(-n_nationkey*225e-2,6) AS longitude
  FROM nation WHERE n_regionkey=2""")


def series_csv(spark, sf):
    """One series file per event type, with preamble lines and prefixed headers, averaged by year day."""
    e = t.table(spark, sf, "events")
    data = e.select(F.concat_ws(",", F.year("ts").cast("string"), F.dayofyear("ts").cast("string"), F.round("value", 2).cast("string")).alias("value"), F.col("event_type").alias("file_key"))
    keys = e.select(F.col("event_type").alias("file_key")).distinct()
    head = keys.select(F.explode(F.array(F.lit("Latitude: 1 Longitude: 2"), F.lit("All years; all variables"), F.lit("year,yday,prcp (mm/day)"))).alias("value"), "file_key")
    s = text.parse_series(head.unionByName(data), {"year": "year", "yday": "yday", "amount": "prcp"})
    return rounded(s.groupBy("file_key").agg(F.count(F.lit(1)).alias("records"), F.avg("amount").alias("mean_amount"), F.max("yday").cast("int").alias("last_day")))


SER_SQL = sql("", "SELECT event_type AS file_key, count(*) AS records, rnd(avg(round(value,2)),6) AS mean_amount, CAST(max(dayofyear(ts)) AS INTEGER) AS last_day FROM events GROUP BY 1")

# --- catalogue ----------------------------------------------------------------------------------------------

SCANNED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations")


def schema_inventory(spark, sf):
    return scan.schema_inventory({n: t.table(spark, sf, n) for n in SCANNED}).select("table_name", "column_position", "column_name", "column_type", "nullable")


INV_SQL = f"""SELECT table_name, CAST(ordinal_position AS INTEGER) AS column_position, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS column_type,
  is_nullable='YES' AS nullable FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{n}'" for n in SCANNED)})"""


def table_row_counts(spark, sf):
    return scan.row_counts({**{n: t.table(spark, sf, n) for n in SCANNED}, "county": None}, spark)


ROWS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, true AS present FROM {n}" for n in SCANNED) + " UNION ALL SELECT 'county', NULL, false"


def reference_matches(spark, sf):
    return scan.reference_matches(t.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["RED ", "brand#2$"])


REF_SQL = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE regexp_matches(concat_ws(' | ',p_name,p_brand,p_type),'red |brand#2$','i')"


def catalogue_scan(spark, sf):
    """Projected and filtered catalogue read; optional columns become typed NULLs."""
    t.table(spark, sf, "part").createOrReplaceTempView("tally_part")
    df = scan.scan(spark, "tally_part", ["p_partkey", "p_size", "p_brand"], F.col("p_size") > 40)
    return df.select("p_partkey", scan.optional_column(df, "p_size", "int"), scan.optional_column(df, "macrprop", "double").alias("macrprop"),
                     F.col(scan.first_existing(["species", "p_brand"], df.columns)).alias("kind"))


SCAN_SQL = "SELECT p_partkey, p_size, CAST(NULL AS DOUBLE) AS macrprop, p_brand AS kind FROM part WHERE p_size>40"


def evaluation_lookup(spark, sf):
    """Latest evaluation, one pinned evaluation and the members of the active type codes."""
    ev = t.visits(spark, sf).groupBy("evalid").agg(F.max("visit_date").alias("end_date"), F.count(F.lit(1)).alias("visits"))
    picked = [("latest", cohorts.resolve_evaluation(ev, "end_date", "evalid")), ("pinned", cohorts.resolve_evaluation(ev, "end_date", "evalid", "F"))]
    rows = spark.createDataFrame([(k, r["evalid"], r["visits"]) for k, r in picked], "choice string, evalid string, visits long")
    types = t.table(spark, sf, "part").groupBy("p_type").agg(F.max("p_size").alias("size"), F.min("p_brand").alias("brand")).select(
        F.col("p_type").alias("code"), F.lit(800).alias("grp"), F.when(F.col("brand") < "Brand#2", "Y").otherwise("N").alias("allowed"), F.when(F.col("size") < 50, F.col("size")).alias("retired"))
    active = cohorts.active_codes(types, "code", "grp", 800, "allowed", "retired").agg(F.count(F.lit(1)).alias("active_codes"))
    one = cohorts.named_row(t.table(spark, sf, "region"), {"r_name": "asia", "r_regionkey": "-1"})
    return rows.crossJoin(active).withColumn("region_key", F.lit(one["r_regionkey"]))


EVAL_SQL = sql("visits", """SELECT choice, evalid, visits, (SELECT count(*) FROM (SELECT p_type FROM part GROUP BY p_type HAVING min(p_brand)<'Brand#2' AND NOT max(p_size)<50)) AS active_codes,
  (SELECT r_regionkey FROM region WHERE lower(r_name)='asia') AS region_key FROM (SELECT 'latest' AS choice, * FROM (SELECT * FROM ev ORDER BY end_date DESC, evalid DESC LIMIT 1)
  UNION ALL SELECT 'pinned', * FROM ev WHERE evalid='F')""", "ev AS (SELECT evalid, max(visit_date) AS end_date, count(*) AS visits FROM visits GROUP BY 1)")


def source_manifest(spark, sf):
    """Digests of the source files against a pin list in which one file is changed and one is not listed."""
    m = stored(manifest.file_manifest(spark, sf, "*.parquet"), "manifest")
    pins = m.where("file <> 'region.parquet'").withColumn("sha256", F.when(F.col("file") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256")))
    return manifest.compare_manifests(m, pins).select("file", "state")


MAN_SQL = "SELECT x||'.parquet' AS file, CASE x WHEN 'region' THEN 'not pinned' WHEN 'nation' THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS x)"

QUERIES = {
    "record_validation": (record_validation, RECV_SQL), "coverage_reconstruction": (coverage_reconstruction, COV_SQL), "class_pivot": (class_pivot, PIV_SQL),
    "class_profile": (class_profile, PROF_SQL), "zero_accounting": (zero_accounting, ZERO_SQL), "unit_reconciliation": (unit_reconciliation, UNIT_SQL), "tall_fractions": (tall_fractions, TALL_SQL),
    "status_counts": (status_counts, STAT_SQL), "table_reconciliation": (table_reconciliation, TREC_SQL), "check_ledger": (check_ledger, LEDGER_SQL),
    "code_set_changes": (code_set_changes, CODES_SQL), "components_residual": (components_residual, RESID_SQL), "group_constancy": (group_constancy, CONST_SQL),
    "text_row_parse": (text_row_parse, PARSE_SQL), "double_extraction": (double_extraction, DOUBLE_SQL), "season_window": (season_window, WIN_SQL), "season_requirements": (season_requirements, REQS_SQL),
    "two_level_mean": (two_level_mean, TLM_SQL), "unpivot_codes": (unpivot_codes, SLOT_SQL), "count_of_counts": (count_of_counts, COC_SQL), "county_recruitment": (county_recruitment, CREC_SQL),
    "value_counts": (value_counts, VC_SQL), "cohort_support": (cohort_support, SUPP_SQL), "field_support": (field_support, FS_SQL), "cohort_range_medians": (range_medians, RM_SQL),
    "role_lookup": (role_lookup, LOOK_SQL), "membership_screens": (membership_screens, MEMB_SQL), "text_key_join": (text_key_join, TKJ_SQL), "region_reader": (region_reader, REG_SQL),
    "series_csv": (series_csv, SER_SQL), "schema_inventory": (schema_inventory, INV_SQL), "table_row_counts": (table_row_counts, ROWS_SQL), "reference_matches": (reference_matches, REF_SQL),
    "catalogue_scan": (catalogue_scan, SCAN_SQL), "evaluation_lookup": (evaluation_lookup, EVAL_SQL), "source_manifest": (source_manifest, MAN_SQL),
}
