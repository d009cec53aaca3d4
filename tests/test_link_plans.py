"""What the link queries exchange: narrow stages, conditions and subplots without an exchange, one-to-one pairs apart."""

from tallyspark.operators import endpoint, links, summaries
from tallyspark.plans import link_plans, tables

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_conditions_and_subplots_are_rows_of_the_area_stage(spark):
    for build, keys in ((tables.conditions, ["plt_cn", "condid"]), (tables.subplot_areas, ["plt_cn", "subp"])):
        d = build(spark, SF)
        assert exchanges(d) == 0
        assert d.count() == d.select(*keys).distinct().count() == tables.slices(spark, SF).select(*keys).distinct().count()


def test_one_to_one_pairs_are_analysed_alone(spark):
    every, strict = link_plans.analysed(spark, SF), link_plans.strict_analysed(spark, SF)
    want = every.where("strict_one_to_one")
    assert 0 < strict.count() == want.count() < every.count()
    seen = [tables.rounded(d.select(*link_plans.KEYS, *link_plans.GATES, *link_plans.LONG_OUT, *link_plans.LONG_STATE)) for d in (strict, want)]
    assert seen[0].exceptAll(seen[1]).isEmpty()


def test_stages_hold_what_is_read(spark):
    assert len(link_plans.analysed(spark, SF).columns) <= 50
    assert "baseline_condition_key" not in link_plans.candidates(spark, SF).columns


def test_growth_reads_no_links_and_stores_its_increments(spark, monkeypatch):
    k = link_plans.candidates(spark, SF, None).where("interval_years > 0").select(*link_plans.KEYS, "interval_years")
    base = endpoint.on_role(k, tables.tagged_stems(spark, SF), links.BASELINE).where("statuscd=1 and spcd='F' and dia>=1 and dia<5")
    nxt = tables.tagged_stems(spark, SF).where("statuscd=1").selectExpr("prev_tre_cn AS tree_cn", "plt_cn AS current_plt_cn", "dia AS d2")
    g = base.join(nxt, ["tree_cn", "current_plt_cn"]).selectExpr("(d2 - dia) / interval_years AS inc")
    want = tables.rounded(summaries.growth_distribution(g, "inc")).collect()
    names, stored = [], tables.stored
    for module in (tables, link_plans):
        monkeypatch.setattr(module, "stored", lambda df, name="stage": names.append(name) or stored(df, name), raising=False)
    monkeypatch.setattr(tables, "_OPEN", {})
    assert link_plans.fate_growth(spark, SF).collect() == want and want[0].survivors > 0
    assert names == ["stem_steps", "increments"]
