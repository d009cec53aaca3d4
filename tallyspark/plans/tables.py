"""Binding of the driver's tables to the inventory roles the operators work on.

order = plot visit, customer = physical plot, nation = county, (order, return flag) = condition,
line position = subplot, line item = stem or tally record, previous order of a customer = earlier visit.
Every function has a twin SQL text, used by the oracle, in ``TWINS``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import with_previous
from ..session import stored

NUDGE = 3.3e-11


def rnd(x, digits: int = 6) -> Column:
    """Rounding for comparison. The nudge keeps exact decimal halves off the rounding boundary."""
    return F.round(F.lit(NUDGE) + (F.col(x) if isinstance(x, str) else x), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


TARGET = "F"  # target species: line status F


_OPEN: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A source table; its footer is read once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _OPEN:
        _OPEN[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _OPEN[key]


def stage(name: str):
    """A binding that is built once per application and source folder and kept as a stage table."""
    def wrap(build):
        @functools.wraps(build)
        def read(spark: SparkSession, sf: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, f"stage:{name}")
            if key not in _OPEN:
                _OPEN[key] = stored(build(spark, sf), name)
            return _OPEN[key]
        return read
    return wrap


def forget() -> None:
    """Drop the memo so that the next query rebuilds its stages (used by the bench)."""
    _OPEN.clear()


def visits(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    manual = F.when(p == "1-URGENT", 9.0).when(p == "2-HIGH", 7.0).when(p == "3-MEDIUM", 6.0).when(
        p == "5-LOW", 4.0).otherwise(5.1)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("plt_cn"), F.col("o_custkey").alias("unit"), F.col("o_orderdate").alias("visit_date"),
        F.year("o_orderdate").alias("measyear"), F.month("o_orderdate").alias("measmon"),
        F.when(p == "5-LOW", 2).otherwise(1).alias("plot_status_cd"), manual.alias("manual"),
        F.when(p == "1-URGENT", 8.0).alias("macro_breakpoint_dia"), F.col("o_orderstatus").alias("evalid"),
        F.when(F.col("o_orderstatus") == "O", 7).otherwise(1).alias("qa_status"),
        F.when(manual >= 6, "OUTER").otherwise("CENTER").alias("microplot_loc"),
        F.col("o_totalprice").alias("plot_total"))


@stage("linked_visits")
def linked_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Visits with the previous visit of the same plot."""
    return with_previous(visits(spark, sf), "unit", ["visit_date", "plt_cn"], ["plt_cn", "visit_date"])


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("cluster"))


def stems(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plt_cn"), F.col("l_returnflag").alias("condid"),
        ((F.col("l_linenumber") - 1) % 4 + 1).alias("subp"), F.col("l_linestatus").alias("spcd"),
        (F.col("l_quantity") / 5.0).alias("dia"), (F.lit(1.0) + F.col("l_tax")).alias("tpa_unadj"),
        F.when(d >= 0.095, 2).when(d >= 0.085, 3).when(d >= 0.005, 1).alias("statuscd"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax_code"))


def tallies(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    count = F.when(F.col("l_discount") < 0.095, q)
    return table(spark, sf, "lineitem").where(F.col("l_quantity") <= 15).select(
        F.col("l_orderkey").alias("plt_cn"), F.col("l_returnflag").alias("condid"),
        ((F.col("l_linenumber") - 1) % 4 + 1).alias("subp"), F.col("l_linestatus").alias("spcd"),
        count.alias("treecount"), (count + F.when(F.col("l_tax") >= 0.075, 1).otherwise(0)).alias("treecount_calc"),
        (count * F.lit(1.5)).alias("tpa_unadj"))


@stage("area")
def area(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (visit, condition, subplot) with its share of the subplot and the sums of its condition and its subplot.

    Every sum is taken in one exchange by visit, so that conditions and subplots are rows of this table and need none of their own.
    """
    n = stems(spark, sf).groupBy("plt_cn", "condid", "subp").agg(
        F.count(F.lit(1)).alias("n"), F.max("tax_code").alias("max_tax"),
        F.coalesce(F.sum(F.when(F.col("statuscd") == 1, F.col("value"))), F.lit(0.0)).alias("value"))
    # at most 12 rows per visit are left, so the windows are safe on any visit
    visit, subplot, condition = (Window.partitionBy("plt_cn", *k) for k in ([], ["subp"], ["condid"]))
    d = n.repartition("plt_cn").select(
        "*", (F.col("n") / F.sum("n").over(subplot)).alias("micrcond_prop"), F.max("max_tax").over(subplot).alias("subp_max_tax"),
        F.sum("n").over(subplot).alias("subp_n"), (F.row_number().over(subplot.orderBy("condid")) == 1).alias("first_of_subp"),
        (F.sum("n").over(condition) / F.sum("n").over(visit)).alias("subpprop_unadj"), F.max("max_tax").over(condition).alias("cond_max_tax"),
        (F.row_number().over(condition.orderBy("subp")) == 1).alias("first_of_cond"))
    first = F.col("first_of_cond")
    return d.select("*", F.when(first, F.round(F.sum("micrcond_prop").over(condition) / 4.0, 9)).alias("micrprop_unadj"),
                    F.when(first, F.sum("value").over(condition)).alias("balive"))


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a subplot that each condition covers: one row per (visit, condition, subplot)."""
    return area(spark, sf).select("plt_cn", "condid", "subp", "n", "max_tax", "value", "micrcond_prop")


def subplot_areas(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (visit, subplot): the largest tax code and the number of its records."""
    return area(spark, sf).where("first_of_subp").select("plt_cn", "subp", F.col("subp_max_tax").alias("m"), F.col("subp_n").alias("n"))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    per = area(spark, sf).where("first_of_cond").withColumn("max_tax", F.col("cond_max_tax"))
    return per.select(
        "plt_cn", "condid", "micrprop_unadj", "subpprop_unadj",
        F.lit(1.0).alias("macrprop_unadj"), F.when(F.col("max_tax") <= 1, 2).otherwise(1).alias("cond_status_cd"),
        F.when(F.col("condid") == "R", 801).when(F.col("condid") == "A", 805).otherwise(500).alias("fortypcd"), "balive")


FOREST_CODES = (801, 805)


def _links(spark: SparkSession, sf: str, scope: Column) -> DataFrame:
    s = slices(spark, sf).select("plt_cn", "condid", "subp", "micrcond_prop")
    v = linked_visits(spark, sf).where(F.col("prev_plt_cn").isNotNull() & scope).select(
        F.col("plt_cn").alias("current_plt_cn"), F.col("prev_plt_cn").alias("baseline_plt_cn"), "evalid")
    cur = s.toDF("current_plt_cn", "current_condid", "subp", "current_prop")
    base = s.toDF("baseline_plt_cn", "baseline_condid", "subp", "baseline_prop")
    return v.join(cur, "current_plt_cn").join(base, ["baseline_plt_cn", "subp"]).withColumn(
        "prop_change", F.least("current_prop", "baseline_prop"))


@stage("links")
def links(spark: SparkSession, sf: str) -> DataFrame:
    """Slice links between consecutive visits, weighted by the smaller share of the two slices."""
    return _links(spark, sf, F.lit(True))


@stage("current_links")
def current_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the current evaluation, a third of all."""
    return _links(spark, sf, F.col("evalid") == "F")


@stage("tagged_stems")
def tagged_stems(spark: SparkSession, sf: str) -> DataFrame:
    """One tagged stem per (visit, line); those with a tax code of 2 or more carry a predecessor tag."""
    pick = F.struct("partkey", "suppkey", "condid", "subp", "spcd", "dia", "statuscd", "tpa_unadj", "tax_code")
    one = stems(spark, sf).groupBy("plt_cn", "line").agg(F.min(pick).alias("s")).select("plt_cn", "line", "s.*")
    v = linked_visits(spark, sf).select("plt_cn", F.col("prev_plt_cn").alias("expected_plt_cn"))
    t = F.col("tax_code")
    return one.join(v, "plt_cn").select(
        "plt_cn", "condid", "subp", (F.col("plt_cn") * 8 + F.col("line")).alias("tree_cn"), "spcd", "dia", "statuscd",
        "tpa_unadj", F.when(t >= 2, F.col("expected_plt_cn") * 8 + F.col("line")).alias("prev_tre_cn"),
        F.when(t == 0, 1).when(t == 1, 3).alias("reconcilecd"), "line")


@stage("stem_steps")
def stem_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Live tagged stems that can begin (``sapling``) or end (``tagged``) a step between two visits, from one exchange by visit.

    ``mask`` has a bit for each subplot of the stem's condition, ``masks`` one such mask for every condition of its visit.
    """
    pick = ["partkey", "suppkey", "condid", "subp", "spcd", "dia", "statuscd", "tpa_unadj", "tax_code"]
    s = stems(spark, sf).select("plt_cn", "line", *pick).repartition("plt_cn")
    bit = F.call_function("shiftleft", F.lit(1), F.col("subp") + 3)  # a remainder of four lies between -3 and 3
    s = s.withColumn("mask", F.bit_or(bit).over(Window.partitionBy("plt_cn", "condid")))
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("plt_cn", "line").orderBy(*pick)))
    s = s.withColumn("masks", F.collect_set(F.struct("condid", "mask")).over(Window.partitionBy("plt_cn"))["mask"])
    sapling = (F.col("spcd") == TARGET) & (F.col("dia") >= 1) & (F.col("dia") < 5)
    s = s.where("rn = 1 AND statuscd = 1").select("plt_cn", "line", "dia", "mask", "masks", F.coalesce(sapling, F.lit(False)).alias("sapling"),
                                                  F.coalesce(F.col("tax_code") >= 2, F.lit(False)).alias("tagged"))
    return s.where("sapling OR tagged")


@stage("cohort")
def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Modelling cohort: one row per pair of consecutive visits, baseline predictors, follow-up outcome."""
    st = stems(spark, sf)
    maple = F.col("spcd") == TARGET
    per = st.groupBy("plt_cn").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("condid") != "N").alias("covered"),
        F.count_if(F.col("dia") <= 3).alias("seedling_count"),
        F.coalesce(F.sum(F.when(maple & (F.col("dia") >= 1) & (F.col("dia") < 5), F.col("tpa_unadj"))), F.lit(0.0))
        .alias("sapling_tpa"),
        F.coalesce(F.sum(F.when(maple & (F.col("dia") >= 5), F.col("dia") * F.col("dia") * F.lit(0.005454)
                                * F.col("tpa_unadj"))), F.lit(0.0)).alias("established_ba"),
        F.count_if((F.col("condid") == "R") & (F.col("dia") >= 6)).alias("entrants"))
    v = linked_visits(spark, sf).where(F.col("prev_plt_cn").isNotNull())
    base = per.select(F.col("plt_cn").alias("prev_plt_cn"), (F.col("covered") / F.col("n")).alias("coverage"),
                      "seedling_count", "sapling_tpa", "established_ba")
    cur = per.select("plt_cn", "entrants")
    u = units(spark, sf)
    days = F.datediff("visit_date", "prev_visit_date")
    return v.join(base, "prev_plt_cn").join(cur, "plt_cn", "left").join(u, "unit").where(
        (F.col("coverage") > 0) & (days > 0)).select(
        F.col("plt_cn").alias("row_id"), "prev_plt_cn", "unit", "cluster", "measyear", "manual", "qa_status",
        F.year("prev_visit_date").alias("baseline_year"), F.month("prev_visit_date").alias("baseline_month"),
        (F.coalesce("entrants", F.lit(0)) > 0).cast("int").alias("y"), F.coalesce("entrants", F.lit(0)).alias("entrants"),
        "coverage", (days / F.lit(365.25)).alias("interval_years"), "seedling_count", "sapling_tpa", "established_ba")


def documents_cohort(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("cluster"), "lang", F.col("toxic").alias("y"),
        "quality", F.log1p(F.col("n_chars").cast("double")).alias("x"))


# --- the same bindings as SQL, for the oracle ------------------------------------------------

TWINS = {
    "visits": """visits AS (SELECT o_orderkey AS plt_cn, o_custkey AS unit, o_orderdate AS visit_date,
  CAST(year(o_orderdate) AS INTEGER) AS measyear, CAST(month(o_orderdate) AS INTEGER) AS measmon,
  CASE WHEN o_orderpriority='5-LOW' THEN 2 ELSE 1 END AS plot_status_cd,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 9.0 WHEN '2-HIGH' THEN 7.0 WHEN '3-MEDIUM' THEN 6.0
    WHEN '5-LOW' THEN 4.0 ELSE 5.1 END AS DOUBLE) AS manual,
  CAST(CASE WHEN o_orderpriority='1-URGENT' THEN 8 END AS DOUBLE) AS macro_breakpoint_dia, o_orderstatus AS evalid,
  CASE WHEN o_orderstatus='O' THEN 7 ELSE 1 END AS qa_status,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'OUTER' ELSE 'CENTER' END AS microplot_loc,
  o_totalprice AS plot_total,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_plt_cn,
  lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_visit_date FROM orders)""",
    "units": "units AS (SELECT c_custkey AS unit, c_nationkey AS cluster FROM customer)",
    "stems": """stems AS (SELECT l_orderkey AS plt_cn, l_returnflag AS condid,
  CAST((l_linenumber-1)%4+1 AS INTEGER) AS subp, l_linestatus AS spcd, l_quantity/5e0 AS dia, 1e0+l_tax AS tpa_unadj,
  CASE WHEN l_discount>=95e-3 THEN 2 WHEN l_discount>=85e-3 THEN 3 WHEN l_discount>=5e-3 THEN 1 END AS statuscd,
  l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS line, l_extendedprice AS value,
  CAST(round(l_tax*100) AS INTEGER) AS tax_code FROM lineitem)""",
    "tallies": """tallies AS (SELECT plt_cn, condid, subp, spcd, treecount,
  treecount + CASE WHEN l_tax>=75e-3 THEN 1 ELSE 0 END AS treecount_calc, treecount*15e-1 AS tpa_unadj
  FROM (SELECT l_orderkey AS plt_cn, l_returnflag AS condid, CAST((l_linenumber-1)%4+1 AS INTEGER) AS subp,
   l_linestatus AS spcd, l_tax, CASE WHEN l_discount<95e-3 THEN CAST(l_quantity AS INTEGER) END AS treecount
   FROM lineitem WHERE l_quantity<=15))""",
    "slices": """slices AS (SELECT *, n/CAST(sum(n) OVER (PARTITION BY plt_cn, subp) AS DOUBLE) AS micrcond_prop
  FROM (SELECT plt_cn, condid, subp, count(*) AS n, max(tax_code) AS max_tax,
   coalesce(sum(value) FILTER (statuscd=1),0e0) AS value FROM stems
   GROUP BY plt_cn, condid, subp))""",
    "conditions": """conditions AS (SELECT plt_cn, condid, micrprop_unadj,
  n/CAST(sum(n) OVER (PARTITION BY plt_cn) AS DOUBLE) AS subpprop_unadj, 1e0 AS macrprop_unadj,
  CASE WHEN max_tax<=1 THEN 2 ELSE 1 END AS cond_status_cd,
  CASE condid WHEN 'R' THEN 801 WHEN 'A' THEN 805 ELSE 500 END AS fortypcd, balive
  FROM (SELECT plt_cn, condid, round(sum(micrcond_prop)/4e0,9) AS micrprop_unadj, sum(n) AS n, max(max_tax) AS max_tax,
   sum(value) AS balive FROM slices GROUP BY plt_cn, condid))""",
    "links": """links AS (SELECT b.plt_cn AS baseline_plt_cn, c.subp, c.plt_cn AS current_plt_cn, v.evalid,
  c.condid AS current_condid, c.micrcond_prop AS current_prop, b.condid AS baseline_condid,
  b.micrcond_prop AS baseline_prop, least(c.micrcond_prop, b.micrcond_prop) AS prop_change
  FROM visits v JOIN slices c ON c.plt_cn=v.plt_cn JOIN slices b ON b.plt_cn=v.prev_plt_cn AND b.subp=c.subp)""",
    "tagged": """tagged AS (SELECT s.plt_cn, condid, subp, s.plt_cn*8+line AS tree_cn, spcd, dia, statuscd, tpa_unadj,
  CASE WHEN tax_code>=2 THEN v.prev_plt_cn*8+line END AS prev_tre_cn,
  CASE WHEN tax_code=0 THEN 1 WHEN tax_code=1 THEN 3 END AS reconcilecd, line
  FROM (SELECT *, row_number() OVER (PARTITION BY plt_cn, line ORDER BY partkey, suppkey, condid, subp, spcd, dia,
    statuscd NULLS FIRST, tpa_unadj, tax_code) AS rn FROM stems) s JOIN visits v ON v.plt_cn=s.plt_cn WHERE rn=1)""",
    "cohort": """cohort AS (SELECT v.plt_cn AS row_id, v.prev_plt_cn, v.unit, u.cluster, v.measyear, v.manual, v.qa_status,
  CAST(year(v.prev_visit_date) AS INTEGER) AS baseline_year, CAST(month(v.prev_visit_date) AS INTEGER) AS baseline_month,
  CASE WHEN coalesce(c.entrants,0)>0 THEN 1 ELSE 0 END AS y, coalesce(c.entrants,0) AS entrants, b.coverage,
  date_diff('day', v.prev_visit_date, v.visit_date)/36525e-2 AS interval_years, b.seedling_count, b.sapling_tpa,
  b.established_ba
  FROM visits v
  JOIN per_visit b ON b.plt_cn=v.prev_plt_cn LEFT JOIN per_visit c ON c.plt_cn=v.plt_cn JOIN units u ON u.unit=v.unit
  WHERE b.coverage>0 AND date_diff('day', v.prev_visit_date, v.visit_date)>0)""",
    "per_visit": """per_visit AS (SELECT plt_cn, CAST(count(*) FILTER (WHERE condid<>'N') AS DOUBLE)/count(*) AS coverage,
  count(*) FILTER (WHERE dia<=3) AS seedling_count,
  coalesce(sum(tpa_unadj) FILTER (WHERE spcd='F' AND dia>=1 AND dia<5), 0e0) AS sapling_tpa,
  coalesce(sum(dia*dia*5454e-6*tpa_unadj) FILTER (WHERE spcd='F' AND dia>=5), 0e0) AS established_ba,
  count(*) FILTER (WHERE condid='R' AND dia>=6) AS entrants FROM stems GROUP BY plt_cn)""",
    "docs": """docs AS (SELECT l.doc_id AS row_id, d.source AS cluster, d.lang, l.toxic AS y, l.quality,
  ln(1e0+d.n_chars) AS x FROM labels l JOIN documents d USING (doc_id))""",
}
_NEEDS = {"slices": ["stems"], "conditions": ["slices"], "links": ["visits", "slices"], "tagged": ["visits", "stems"],
          "per_visit": ["stems"], "cohort": ["visits", "per_visit", "units"]}


def sql(names: str, body: str, extra: str = "") -> str:
    """WITH clause of the named twins (and what they need), extra CTEs, then the query body.

    ``rnd(`` stands for the nudged rounding of ``rnd`` above.
    """
    order: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = [TWINS[n] for n in order] + ([extra] if extra else [])
    text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return text.replace("rnd(", "round(33e-12+")
