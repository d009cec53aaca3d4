"""Cross-sectional queries: eligibility, normalised measures, thresholds, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import checks, cohorts, measures, summaries
from ..settings import DEFAULTS
from . import tables as t
from .tables import rnd, rounded, sql

def members(spark, sf):
    """Visits of the latest evaluation (the oldest order status group stands for one evaluation id)."""
    return t.visits(spark, sf).where(F.col("evalid") == "F").select("plt_cn").distinct()


@t.stage("eligible")
def eligible(spark, sf):
    return cohorts.eligible_conditions(t.conditions(spark, sf), t.visits(spark, sf), members(spark, sf), t.FOREST_CODES)


ELIGIBLE = """eligible AS (SELECT c.*, v.* EXCLUDE (plt_cn) FROM conditions c JOIN visits v ON v.plt_cn=c.plt_cn
  WHERE v.evalid='F' AND v.plot_status_cd=1 AND c.cond_status_cd=1 AND c.fortypcd IN (801,805))"""

BREAK = "CASE WHEN macro_breakpoint_dia IS NOT NULL AND dia>=macro_breakpoint_dia THEN 'macroplot' WHEN dia<5 THEN 'microplot' ELSE 'subplot' END"
NORMAL = f"""normal AS (SELECT s.*, basis, 5454e-6*dia*dia*tpa_unadj AS pb,
  5454e-6*dia*dia*tpa_unadj / CASE basis WHEN 'microplot' THEN micrprop_unadj WHEN 'subplot' THEN subpprop_unadj
   ELSE macrprop_unadj END AS ct
  FROM (SELECT s.*, e.micrprop_unadj, e.subpprop_unadj, e.macrprop_unadj, {BREAK} AS basis
    FROM stems s JOIN UNIV e ON e.plt_cn=s.plt_cn AND e.condid=s.condid
    WHERE statuscd=1 AND dia>=0 AND tpa_unadj>=0) s)"""
STEM_AGG = """stemagg AS (SELECT plt_cn, condid,
  sum(pb) AS total_ba_plot_basis, coalesce(sum(pb) FILTER (spcd='F'),0e0) AS maple_ba_plot_basis,
  coalesce(sum(pb) FILTER (spcd='F' AND dia>=1 AND dia<5),0e0) AS maple_sapling_ba_plot_basis,
  coalesce(sum(pb) FILTER (dia>=5),0e0) AS overstory_total_ba_plot_basis,
  coalesce(sum(pb) FILTER (spcd='F' AND dia>=5),0e0) AS established_maple_ba_plot_basis,
  CASE WHEN count(*)=count(ct) THEN sum(ct) END AS total_ba_ft2_ac, CASE WHEN count(*)=count(ct) THEN coalesce(sum(ct) FILTER (spcd='F'),0e0) END AS maple_ba_ft2_ac,
  CASE WHEN count(*)=count(ct) THEN coalesce(sum(ct) FILTER (spcd='F' AND dia>=1 AND dia<5),0e0) END AS maple_sapling_ba_ft2_ac,
  CASE WHEN count(*)=count(ct) THEN coalesce(sum(ct) FILTER (dia>=5),0e0) END AS overstory_total_ba_ft2_ac,
  CASE WHEN count(*)=count(ct) THEN coalesce(sum(ct) FILTER (spcd='F' AND dia>=5),0e0) END AS established_maple_ba_ft2_ac,
  count(*) AS live_tree_records, count(*)-count(ct) AS unusable_tree_records, count(*) FILTER (spcd='F' AND dia>=1 AND dia<5) AS maple_sapling_records,
  count(*) FILTER (dia>=5) AS overstory_tree_records, count(*) FILTER (spcd='F' AND dia>=5) AS established_maple_records,
  count(*) FILTER (basis='microplot') AS microplot_tree_records, count(*) FILTER (basis='subplot') AS subplot_tree_records,
  count(*) FILTER (basis='macroplot') AS macroplot_tree_records FROM normal GROUP BY plt_cn, condid),
stemmetrics AS (SELECT *, CASE WHEN total_ba_ft2_ac IS NOT NULL THEN greatest(0e0, total_ba_ft2_ac-maple_ba_ft2_ac) END AS nonmaple_ba_ft2_ac,
  CASE WHEN total_ba_ft2_ac IS NOT NULL THEN greatest(0e0, total_ba_ft2_ac-established_maple_ba_ft2_ac) END AS other_live_ba_ft2_ac,
  maple_sapling_records>0 AS maple_sapling_present,
  CASE WHEN total_ba_ft2_ac>0 THEN maple_ba_ft2_ac/total_ba_ft2_ac WHEN total_ba_ft2_ac IS NOT NULL THEN 0e0 END AS maple_ba_share,
  CASE WHEN overstory_total_ba_ft2_ac>0 THEN established_maple_ba_ft2_ac/overstory_total_ba_ft2_ac WHEN overstory_total_ba_ft2_ac IS NOT NULL THEN 0e0 END
    AS established_maple_ba_share FROM stemagg)"""
TALLY = """tallymetrics AS (SELECT u.plt_cn, u.condid, cover, coalesce(cover>0,false) AS seedling_sampled,
  CASE WHEN cover>0 THEN coalesce(a,0e0) END AS all_seedling_tpa_plot_basis,
  CASE WHEN cover>0 THEN coalesce(m,0e0) END AS maple_seedling_tpa_plot_basis,
  coalesce(mn,0) AS maple_seedling_records, coalesce(n,0) AS seedling_species_records,
  CASE WHEN cover>0 THEN coalesce(m,0e0)/cover END AS maple_seedling_tpa,
  CASE WHEN cover>0 THEN coalesce(a,0e0)/cover END AS all_seedling_tpa,
  CASE WHEN cover>0 THEN CASE WHEN coalesce(m,0e0)>0 THEN 1 ELSE 0 END END AS maple_seedling_detected,
  CASE WHEN cover>0 AND a>0 THEN coalesce(m,0e0)/a END AS maple_seedling_share
  FROM universe u LEFT JOIN (SELECT plt_cn, condid, sum(tpa_unadj) AS a, coalesce(sum(tpa_unadj) FILTER (spcd='F'),0e0) AS m,
   count(*) FILTER (spcd='F') AS mn, count(*) AS n FROM tallies WHERE tpa_unadj>=0 GROUP BY plt_cn, condid) o
   ON o.plt_cn=u.plt_cn AND o.condid=u.condid)"""
# the tally frame of a condition is unknown, empty or sampled depending on the visit's manual
COVER = "CASE WHEN manual=6 THEN NULL WHEN manual=51e-1 THEN 0e0 ELSE micrprop_unadj END"
UNIVERSE = f"universe AS (SELECT plt_cn, condid, {COVER} AS cover FROM eligible)"


def seed_cover():
    return F.when(F.col("manual") == 6, F.lit(None)).when(F.col("manual") == 5.1, F.lit(0.0)).otherwise(
        F.col("micrprop_unadj"))


@t.stage("analysis")
def analysis_table(spark, sf):
    e = eligible(spark, sf)
    breaks = e.select("plt_cn", "condid", "macro_breakpoint_dia")
    stems = t.stems(spark, sf).join(breaks, ["plt_cn", "condid"])
    sm = measures.stem_metrics(stems, e, t.TARGET)
    universe = e.select("plt_cn", "condid", seed_cover().alias("cover"))
    tm = measures.tally_metrics(t.tallies(spark, sf), universe, t.TARGET, coverage="cover")
    return e.select("plt_cn", "condid", "unit", "measyear", "balive", "manual").join(
        sm, ["plt_cn", "condid"], "left").join(tm, ["plt_cn", "condid"])


ANALYSIS = ",\n".join([ELIGIBLE, NORMAL.replace("UNIV", "eligible"), STEM_AGG, UNIVERSE, TALLY]) + """,
analysis AS (SELECT e.plt_cn, e.condid, e.unit, e.measyear, e.balive, e.manual, s.* EXCLUDE (plt_cn, condid),
  m.* EXCLUDE (plt_cn, condid) FROM eligible e LEFT JOIN stemmetrics s ON s.plt_cn=e.plt_cn AND s.condid=e.condid
  JOIN tallymetrics m ON m.plt_cn=e.plt_cn AND m.condid=e.condid),
cuts AS (SELECT quantile_cont(established_maple_ba_share, 2/CAST(3 AS DOUBLE)) AS established_threshold,
  quantile_cont(established_maple_ba_share, 75e-2) AS sensitivity_threshold FROM analysis
  WHERE maple_seedling_detected IS NOT NULL AND established_maple_ba_share IS NOT NULL),
flagged AS (SELECT a.*, c.*, CASE WHEN maple_seedling_detected IS NOT NULL THEN
   coalesce(established_maple_ba_share>=established_threshold AND maple_seedling_detected=0, false) END AS potential_gap,
  CASE WHEN maple_seedling_detected IS NOT NULL THEN
   coalesce(established_maple_ba_share>=sensitivity_threshold AND maple_seedling_detected=0, false) END
   AS potential_gap_sensitivity FROM analysis a, cuts c)"""
BASE = "visits stems tallies conditions"

SUMS = [f"{p}{s}" for s in ("ba_plot_basis", "ba_ft2_ac") for p in
        ("total_", "maple_", "maple_sapling_", "overstory_total_", "established_maple_")]
COUNTS = ["live_tree_records", "unusable_tree_records", "maple_sapling_records", "overstory_tree_records", "established_maple_records",
          "microplot_tree_records", "subplot_tree_records", "macroplot_tree_records"]
DERIVED = ["nonmaple_ba_ft2_ac", "other_live_ba_ft2_ac", "maple_ba_share", "established_maple_ba_share",
           "maple_seedling_tpa", "all_seedling_tpa", "maple_seedling_share", "established_threshold",
           "sensitivity_threshold"]
PLAIN = ["maple_sapling_present", "seedling_sampled", "maple_seedling_records", "seedling_species_records",
         "maple_seedling_detected", "potential_gap", "potential_gap_sensitivity"]


def condition_metrics(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False)
    return rounded(a.select("plt_cn", "condid", *SUMS, *COUNTS, *DERIVED, *PLAIN))


CONDITION_METRICS = sql(BASE, "SELECT plt_cn, condid, " + ", ".join(
    [f"rnd({x},6) AS {x}" for x in SUMS + DERIVED] + COUNTS + PLAIN) + " FROM flagged", ANALYSIS)


def percentile_gap_flags(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf))
    return rounded(a.select("plt_cn", "condid", "established_percentile", "regeneration_percentile",
                            "gap_rank_difference", "potential_gap"))


PERCENTILE = sql(BASE, """SELECT plt_cn, condid, rnd(ep,6) AS established_percentile, rnd(rp,6) AS regeneration_percentile,
  rnd(ep-rp,6) AS gap_rank_difference, potential_gap FROM (SELECT *,
  CASE WHEN es IS NOT NULL THEN percent_rank() OVER (PARTITION BY es IS NULL ORDER BY es) END AS ep,
  CASE WHEN rd IS NOT NULL THEN percent_rank() OVER (PARTITION BY rd IS NULL ORDER BY rd) END AS rp FROM (SELECT *,
   CASE WHEN maple_seedling_detected IS NOT NULL AND established_maple_ba_share IS NOT NULL THEN round(established_maple_ba_share,9) END AS es,
   CASE WHEN maple_seedling_detected IS NOT NULL AND established_maple_ba_share IS NOT NULL THEN round(maple_seedling_tpa,9) END AS rd
   FROM flagged))""", ANALYSIS)


def eligible_conditions(spark, sf):
    e = eligible(spark, sf).join(t.units(spark, sf), "unit")
    region = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("cluster"), "n_name")
    e = cohorts.with_reference_name(e, region, ["cluster"], "n_name", "Unknown county")
    site = e.site_class if "site_class" in e.columns else F.lit(None).cast("int")
    return e.select("plt_cn", "condid", "fortypcd", "measyear", S.area_code("cluster", "fortypcd").alias("geoid"),
                    F.col("n_name").alias("county_name"), rnd("micrprop_unadj").alias("micrprop_unadj"),
                    S.any_positive(F.when(F.col("qa_status") == 7, 7), F.when(F.col("manual") == 4, 0),
                                   F.when(F.col("cond_status_cd") == 2, 5)).alias("disturbed"),
                    site.alias("site_class"), S.joined_key("unit", "cluster", "plt_cn").alias("physical_plot_key"))


ELIGIBLE_SQL = sql("visits stems conditions units", """SELECT e.plt_cn, e.condid, e.fortypcd, e.measyear,
  lpad(CAST(u.cluster AS VARCHAR),2,'0')||lpad(CAST(e.fortypcd AS VARCHAR),3,'0') AS geoid,
  coalesce(n.n_name,'Unknown county') AS county_name, rnd(micrprop_unadj,6) AS micrprop_unadj,
  e.qa_status=7 AS disturbed, CAST(NULL AS INTEGER) AS site_class,
  concat_ws('-',e.unit,u.cluster,e.plt_cn) AS physical_plot_key
  FROM eligible e JOIN units u ON u.unit=e.unit LEFT JOIN nation n ON n.n_nationkey=u.cluster""", ELIGIBLE)


def composition_topn(spark, sf):
    e = eligible(spark, sf).select("plt_cn", "condid")
    s = t.stems(spark, sf).where((F.col("statuscd") == 1) & (F.col("dia") >= 0))
    brands = t.table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("species_name"))
    s = s.join(e, ["plt_cn", "condid"])
    per_part = cohorts.composition(s, ["partkey"], S.area_contribution("dia", "tpa_unadj"))
    named = per_part.join(brands, "partkey", "left").withColumn(
        "species_name", F.coalesce("species_name", F.lit("Unknown species")))
    per_brand = named.groupBy("species_name").agg(F.sum("records").alias("records"), F.sum("amount").alias("amount"))
    return rounded(cohorts.top_shares(per_brand, "amount", 12, ["species_name"]))


COMPOSITION = sql("visits stems conditions", """SELECT species_name, records, rnd(amount,6) AS amount, rnd(share,6) AS share,
  rnd(sum(share) OVER (),6) AS displayed_share FROM (SELECT *, amount/sum(amount) OVER () AS share FROM
  (SELECT coalesce(p.p_brand,'Unknown species') AS species_name, count(*) AS records, sum(5454e-6*dia*dia*tpa_unadj) AS amount
   FROM stems s JOIN eligible e ON e.plt_cn=s.plt_cn AND e.condid=s.condid LEFT JOIN part p ON p.p_partkey=s.partkey
   WHERE s.statuscd=1 AND dia>=0 GROUP BY 1) ORDER BY amount DESC, species_name LIMIT 12)""", ELIGIBLE)


def cohort_flow(spark, sf):
    d = t.conditions(spark, sf).join(t.visits(spark, sf), "plt_cn")
    a = F.col("evalid") == "F"
    b = a & (F.col("plot_status_cd") == 1)
    f = b & (F.col("cond_status_cd") == 1)
    g = f & F.col("fortypcd").isin(*t.FOREST_CODES)
    return checks.flow(d, [
        ("Visits assigned to the evaluation", a), ("Sampled visits", b), ("Accessible forest conditions", f),
        ("Target type group", g), ("Demonstrated frame sampling", g & (seed_cover() > 0))],
        {"visits": ["plt_cn"], "plots": ["unit"]}, {"manual_sum": F.col("qa_status")})


FLOW = sql("visits stems conditions", """SELECT CAST(i AS INTEGER) AS step_no, s AS step, count(*) FILTER (k) AS n_rows,
  CAST(coalesce(sum(qa_status) FILTER (k),0) AS BIGINT) AS manual_sum,
  count(DISTINCT plt_cn) FILTER (k) AS visits, count(DISTINCT unit) FILTER (k) AS plots FROM (
  SELECT d.*, x.i, x.s, coalesce(CASE x.i WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN f WHEN 3 THEN g ELSE g AND cov>0 END,false) AS k
  FROM (SELECT *, b AND cond_status_cd=1 AS f, b AND cond_status_cd=1 AND fortypcd IN (801,805) AS g FROM (
   SELECT c.*, v.unit, v.qa_status, v.evalid='F' AS a, v.evalid='F' AND plot_status_cd=1 AS b, """ + COVER + """ AS cov
   FROM conditions c JOIN visits v ON v.plt_cn=c.plt_cn)) d,
  (VALUES (0,'Visits assigned to the evaluation'),(1,'Sampled visits'),(2,'Accessible forest conditions'),
   (3,'Target type group'),(4,'Demonstrated frame sampling')) x(i,s)) GROUP BY i, s""")


def join_audit(spark, sf):
    e = eligible(spark, sf).select("plt_cn", "condid")
    live = measures.live_stems(t.stems(spark, sf)).select("plt_cn", "condid")
    a = checks.join_audit(e, live, ["plt_cn", "condid"], "conditions -> live stems", e.join(live, ["plt_cn", "condid"], "left"))
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    li = t.table(spark, sf, "lineitem").select("l_orderkey")
    return a.unionByName(checks.join_audit(o, li, ["l_orderkey"], "visits -> records"))


JOIN_AUDIT = sql("visits stems conditions", """SELECT 'conditions -> live stems' AS "join", (SELECT count(*) FROM eligible) AS left_rows,
  (SELECT count(*) FROM live) AS right_rows,
  (SELECT count(*) FROM eligible e LEFT JOIN live l ON l.plt_cn=e.plt_cn AND l.condid=e.condid) AS result_rows,
  (SELECT count(*) FROM (SELECT DISTINCT plt_cn, condid FROM eligible)) AS left_unique_keys,
  (SELECT count(*) FROM (SELECT DISTINCT plt_cn, condid FROM live)) AS right_unique_keys,
  (SELECT count(*) FROM (SELECT DISTINCT plt_cn, condid FROM eligible EXCEPT SELECT plt_cn, condid FROM live)) AS unmatched_left_keys
 UNION ALL SELECT 'visits -> records', (SELECT count(*) FROM orders), (SELECT count(*) FROM lineitem), NULL,
  (SELECT count(DISTINCT o_orderkey) FROM orders), (SELECT count(DISTINCT l_orderkey) FROM lineitem),
  (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))""",
                 ELIGIBLE + ", live AS (SELECT plt_cn, condid FROM stems WHERE statuscd=1 AND dia>=0 AND tpa_unadj>=0)")


def missingness(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False)
    return rounded(checks.missingness(a, MISSING_COLS))


MISSING_COLS = ["total_ba_ft2_ac", "established_maple_ba_share", "maple_seedling_tpa", "maple_seedling_detected",
                "maple_seedling_share", "potential_gap", "manual"]
MISSING = sql(BASE, " UNION ALL ".join(
    f"SELECT '{x}' AS variable, count(*)-count({x}) AS missing_n, rnd(100e0*(count(*)-count({x}))/count(*),6) AS missing_pct FROM flagged"
    for x in MISSING_COLS), ANALYSIS)


def duplicate_keys(spark, sf):
    d = checks.duplicate_keys(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return d.withColumn("n", F.col("n"))


DUPLICATES = """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1"""


def range_audit(spark, sf):
    a = analysis_table(spark, sf)
    o = checks.out_of_range
    return checks.violation_counts(a, {
        "share within [0,1]": o("maple_ba_share", 0, 1), "established share within [0,1]": o("established_maple_ba_share", 0, 1),
        "density not negative": o("maple_seedling_tpa", 0), "density known": o("maple_seedling_tpa", 0, allow_missing=False),
        "small area": o("total_ba_ft2_ac", None, 5), "finite total": ~S.is_finite("total_ba_ft2_ac"),
        "whole tally area": ~S.surely(S.is_whole("maple_seedling_tpa"))})


RANGE = sql(BASE, """SELECT rule, count(*) FILTER (v) AS violations, n_rows FROM (SELECT count(*) OVER () AS n_rows, a.* FROM analysis a) a,
  LATERAL (VALUES ('share within [0,1]', coalesce(maple_ba_share<0 OR maple_ba_share>1,false)),
  ('established share within [0,1]', coalesce(established_maple_ba_share<0 OR established_maple_ba_share>1,false)),
  ('density not negative', coalesce(maple_seedling_tpa<0,false)),
  ('density known', maple_seedling_tpa IS NULL OR maple_seedling_tpa<0),
  ('small area', coalesce(total_ba_ft2_ac>5,false)), ('finite total', total_ba_ft2_ac IS NULL),
  ('whole tally area', NOT coalesce(abs(maple_seedling_tpa-round(maple_seedling_tpa))<=1e-8,false))) x(rule,v)
  GROUP BY rule, n_rows""", ANALYSIS)


def concordance(spark, sf):
    per = t.stems(spark, sf).groupBy("plt_cn").agg(F.sum("value").alias("computed"))
    d = t.visits(spark, sf).select("plt_cn", "plot_total").join(per, "plt_cn", "left")
    return rounded(checks.concordance(d, "computed", "plot_total"), 4)


CONCORDANCE = sql("visits stems", """SELECT count(*) AS observations, rnd(corr(x,y),4) AS pearson_correlation,
  rnd(avg(abs(x-y)),4) AS mean_absolute_error, rnd(sqrt(avg((x-y)*(x-y))),4) AS rms_error,
  rnd(max(abs(x-y)),4) AS max_absolute_error, rnd(quantile_cont(x-y,5e-1),4) AS median_signed_error
  FROM (SELECT c.x, v.plot_total AS y FROM visits v JOIN (SELECT plt_cn, sum(value) AS x FROM stems GROUP BY plt_cn) c
  ON c.plt_cn=v.plt_cn) WHERE x IS NOT NULL AND y IS NOT NULL""")


def concordance_verdict(spark, sf):
    """The verdict on two recorded totals: the one that is compared with itself passes, the other does not."""
    per = t.stems(spark, sf).groupBy("plt_cn").agg(F.sum("value").alias("computed"))
    d = t.visits(spark, sf).select("plt_cn", "plot_total").join(per, "plt_cn")
    out = None
    for label, recorded in (("recorded total", F.col("plot_total")), ("own total", F.col("computed") + 0.0)):
        v = checks.concordance_verdict(checks.concordance(d.withColumn("other", recorded), "computed", "other")).select(
            F.lit(label).alias("measure"), "observations", "correlated", "mean_error_small", "largest_error_small", "passed")
        out = v if out is None else out.unionByName(v)
    return out


VERDICT = sql("visits stems", """SELECT measure, count(*) AS observations, corr(x,y)>=9999e-4 AS correlated, avg(abs(x-y))<=1e-2 AS mean_error_small, max(abs(x-y))<=5e-2 AS largest_error_small,
  corr(x,y)>=9999e-4 AND avg(abs(x-y))<=1e-2 AND max(abs(x-y))<=5e-2 AS passed FROM (SELECT c.x, m.measure, CASE m.measure WHEN 'own total' THEN c.x ELSE v.plot_total END AS y
  FROM visits v JOIN (SELECT plt_cn, sum(value) AS x FROM stems GROUP BY plt_cn) c ON c.plt_cn=v.plt_cn, (VALUES ('recorded total'),('own total')) m(measure)) GROUP BY measure""")


def gap_bins(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False)
    return summaries.zero_bins(a, "established_maple_ba_share", "maple_seedling_tpa", "potential_gap")


GAP_BINS = sql(BASE, """SELECT rnd(share_bin,6) AS share_bin, potential_gap, count(*) AS n FROM (SELECT
  CASE WHEN maple_seedling_tpa=0 THEN least(975e-3, floor(established_maple_ba_share/5e-2)*5e-2+25e-3) END AS share_bin,
  potential_gap FROM flagged WHERE established_maple_ba_share IS NOT NULL AND maple_seedling_tpa IS NOT NULL) GROUP BY ALL""", ANALYSIS)


def headline_summary(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False)
    return rounded(summaries.headline(a))


HEADLINE = sql(BASE, """SELECT count(*) AS plot_conditions, count(DISTINCT plt_cn) AS plot_visits, count(DISTINCT unit) AS units,
  min(measyear) AS years_min, max(measyear) AS years_max, count(*) FILTER (seedling_sampled) AS seedling_sampled,
  count(*) FILTER (maple_seedling_detected=0) AS zero_maple_seedlings, count(*) FILTER (maple_seedling_detected=1) AS maple_seedling_detected,
  count(*) FILTER (potential_gap) AS potential_gaps, rnd(avg(CASE WHEN potential_gap THEN 1e0 WHEN NOT potential_gap THEN 0e0 END),6) AS potential_gap_fraction,
  count(*) FILTER (potential_gap_sensitivity) AS sensitivity_gaps, rnd(max(established_threshold),6) AS primary_threshold,
  rnd(max(sensitivity_threshold),6) AS sensitivity_threshold FROM flagged""", ANALYSIS)


def wilson_groups(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False).join(t.units(spark, sf), "unit")
    return rounded(summaries.masked_proportions(a, ["cluster"], "potential_gap", 8), 8)


WILSON = sql(BASE + " units", """SELECT cluster, sample_n, gap_n, gap_denominator, rnd(estimate,8) AS estimate, rnd(conf_low,8) AS conf_low,
  rnd(conf_high,8) AS conf_high, gap_denominator>=8 AS supported, rnd(CASE WHEN gap_denominator>=8 THEN estimate END,8) AS shown_fraction FROM (
  SELECT *, greatest(0e0,mid-half) AS conf_low, least(1e0,mid+half) AS conf_high FROM (SELECT *,
   (estimate+z2/(2*d))/(1+z2/d) AS mid, 196e-2*sqrt((estimate*(1-estimate)+z2/(4*d))/d)/(1+z2/d) AS half FROM (
   SELECT *, CAST(gap_denominator AS DOUBLE) AS d, 196e-2*196e-2 AS z2, CASE WHEN gap_denominator>0 THEN gap_n/CAST(gap_denominator AS DOUBLE) END AS estimate FROM (
   SELECT cluster, count(*) AS sample_n, count(*) FILTER (potential_gap) AS gap_n, count(potential_gap) AS gap_denominator
   FROM flagged f JOIN units u ON u.unit=f.unit GROUP BY cluster))))""", ANALYSIS)


def masked_rank(spark, sf):
    a = measures.gap_flags(analysis_table(spark, sf), ranks=False).join(t.units(spark, sf), "unit")
    m = summaries.masked_proportions(a, ["cluster"], "potential_gap", DEFAULTS.minimum_map_n)
    return rounded(m.where("supported and estimate is not null").orderBy(F.desc("estimate"), "cluster").select("cluster", "gap_denominator", "estimate"), 8)


MASKED_RANK = sql(BASE + " units", """SELECT cluster, count(potential_gap) AS gap_denominator,
  rnd(count(*) FILTER (potential_gap)/CAST(count(potential_gap) AS DOUBLE),8) AS estimate FROM flagged f JOIN units u ON u.unit=f.unit
  GROUP BY cluster HAVING count(potential_gap)>=20""", ANALYSIS)


def protocol_completeness(spark, sf):
    plots = t.visits(spark, sf).select("plt_cn", "manual").distinct()
    return summaries.protocol_completeness(plots, t.tallies(spark, sf), "plt_cn", "manual", ["treecount", "tpa_unadj"], "treecount")


PROTOCOL = sql("visits tallies", """SELECT manual, count(DISTINCT v.plt_cn) AS visits, count(t.plt_cn) AS record_rows,
  count(*) FILTER (t.plt_cn IS NOT NULL AND treecount IS NULL) AS treecount_missing,
  count(*) FILTER (t.plt_cn IS NOT NULL AND tpa_unadj IS NULL) AS tpa_unadj_missing, max(treecount) AS treecount_max
  FROM visits v LEFT JOIN tallies t ON t.plt_cn=v.plt_cn GROUP BY manual""")


def tally_metrics(spark, sf):
    e = eligible(spark, sf)
    m = measures.tally_metrics(t.tallies(spark, sf), e.select("plt_cn", "condid", seed_cover().alias("cover")), t.TARGET,
                               coverage="cover")
    return rounded(m)


TALLY_SQL = sql(BASE, """SELECT plt_cn, condid, rnd(cover,6) AS cover, seedling_sampled,
  rnd(all_seedling_tpa_plot_basis,6) AS all_seedling_tpa_plot_basis, rnd(maple_seedling_tpa_plot_basis,6) AS maple_seedling_tpa_plot_basis,
  maple_seedling_records, seedling_species_records, rnd(maple_seedling_tpa,6) AS maple_seedling_tpa, rnd(all_seedling_tpa,6) AS all_seedling_tpa,
  maple_seedling_detected, rnd(maple_seedling_share,6) AS maple_seedling_share FROM tallymetrics""", ", ".join([ELIGIBLE, UNIVERSE, TALLY]))


def frame_rejects(spark, sf):
    e = eligible(spark, sf)
    frames = e.select("plt_cn", "condid", seed_cover().alias("micrprop_unadj"), "subpprop_unadj", "macrprop_unadj")
    stems = t.stems(spark, sf).join(e.select("plt_cn", "condid", "macro_breakpoint_dia"), ["plt_cn", "condid"])
    return measures.frame_rejects(measures.normalised_stems(stems, frames))


REJECTS = sql("visits stems conditions", f"""SELECT sampling_basis, count(*) AS rejects FROM (SELECT {BREAK} AS sampling_basis, {COVER} AS cov
  FROM stems s JOIN eligible e ON e.plt_cn=s.plt_cn AND e.condid=s.condid WHERE s.statuscd=1)
  WHERE sampling_basis='microplot' AND (cov IS NULL OR cov<=0) GROUP BY 1""", ELIGIBLE)


def hand_check_sample(spark, sf):
    a = analysis_table(spark, sf).where("seedling_sampled")
    return rounded(summaries.seeded_sample(a, ["plt_cn", "condid"], 20260826, 20).select(
        "plt_cn", "condid", "total_ba_ft2_ac", "maple_seedling_tpa", "maple_seedling_detected"))


SAMPLE = sql(BASE, """SELECT plt_cn, condid, rnd(total_ba_ft2_ac,6) AS total_ba_ft2_ac, rnd(maple_seedling_tpa,6) AS maple_seedling_tpa,
  maple_seedling_detected FROM analysis WHERE seedling_sampled ORDER BY md5(concat_ws('|',plt_cn,condid,'20260826')), plt_cn, condid LIMIT 20""", ANALYSIS)

QUERIES = {
    "condition_metrics": (condition_metrics, CONDITION_METRICS),
    "percentile_gap_flags": (percentile_gap_flags, PERCENTILE),
    "eligible_conditions": (eligible_conditions, ELIGIBLE_SQL),
    "tally_metrics": (tally_metrics, TALLY_SQL),
    "frame_rejects": (frame_rejects, REJECTS),
    "composition_topn": (composition_topn, COMPOSITION),
    "cohort_flow": (cohort_flow, FLOW),
    "join_audit": (join_audit, JOIN_AUDIT),
    "missingness": (missingness, MISSING),
    "duplicate_keys": (duplicate_keys, DUPLICATES),
    "range_audit": (range_audit, RANGE),
    "concordance": (concordance, CONCORDANCE), "concordance_verdict": (concordance_verdict, VERDICT),
    "gap_bins": (gap_bins, GAP_BINS),
    "headline_summary": (headline_summary, HEADLINE),
    "wilson_groups": (wilson_groups, WILSON),
    "masked_rank": (masked_rank, MASKED_RANK),
    "protocol_completeness": (protocol_completeness, PROTOCOL),
    "hand_check_sample": (hand_check_sample, SAMPLE),
}
