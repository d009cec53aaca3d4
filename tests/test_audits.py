import gzip
import hashlib
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks, links, reconcile
from tallyspark.operators.checks import AuditFailure
from tallyspark.settings import DEFAULTS
from tallyspark.sources import manifest, scan, text


def supplement(spark, **change):
    """One linked unit a with two fine tallies, b without; ``change`` overrides single cells."""
    g = lambda k, v: change.get(k, v)
    T = {
        "mapping": ([("a", 1, g("coverage", 0.25), g("measmon", 6)), ("b", 1, 0.25, 7)], "plt_cn string, condid int, coverage double, measmon int"),
        "plots": ([(x,) for x in g("plots", ["a", "b"])], "plt_cn string"),
        "sub": ([("a", 1, "rsa", g("sbp_cn", "sa"), g("micro", 1), None, None), ("b", 1, "rsb", "sb", 1, None, None)],
                "plt_cn string, subp int, ri_subp_cn string, sbp_cn string, micro_status int, legacy_status int, nonsample_reason int"),
        "core_sub": ([("a", 1, "sa", 1), ("b", 1, "sb", 1)], "plt_cn string, subp int, subplot_cn string, subp_status_cd int"),
        "cond": ([("a", 1, "ca", 1), ("b", 1, "cb", 1)], "plt_cn string, condid int, core_cnd_cn string, cond_status_cd int"),
        "sc": ([("a", 1, 1, "sca", 1.0), ("b", 1, 1, "scb", 1.0), *g("extra", [])], "plt_cn string, condid int, subp int, core_scd_cn string, micrcond_prop double"),
        "tal": (g("tallies", [("a", 1, 1, g("spcd", 318), g("source", 1), g("cls", 1), g("count", 3.0), g("cnd", "ca"), g("scd", "sca")), ("a", 1, 1, 318, 1, 5, 2.0, "ca", "sca")]),
                "plt_cn string, condid int, subp int, spcd int, seedling_source_cd int, length_class_cd int, seedlingcount double, cnd_cn string, scd_cn string"),
    }
    d = {k: spark.createDataFrame(rows, s) for k, (rows, s) in T.items()}
    chk = reconcile.checked_records(d["tal"], d["cond"], d["sc"], [318, 316], 318)
    frame = reconcile.frame_slices(d["mapping"], d["sc"], d["core_sub"], d["sub"])
    av = reconcile.availability(d["mapping"], frame, d["sc"], d["plots"], chk)
    return av, frame, chk


def unit_a(df):
    return df.where("plt_cn = 'a'").first()


def test_class_totals(spark):
    av, frame, chk = supplement(spark)
    r = unit_a(reconcile.class_counts(av, chk, 318))
    assert r.available and (r.all_count, r.standard_count, r.tall_count, r.class_1, r.stump_source_count) == (5, 2, 2, 3, 0)
    core = spark.createDataFrame([("a", 1, 1, 318, 2)], "plt_cn string, condid int, subp int, spcd int, treecount int")
    assert unit_a(reconcile.unit_reconciliation(frame, core, chk, 318)).count_difference == 0
    missing = core.withColumn("treecount", F.lit(None).cast("int"))
    assert unit_a(reconcile.unit_reconciliation(frame, missing, chk, 318)).count_difference is None


def test_zero_needs_a_verified_frame(spark):
    av, _, chk = supplement(spark, tallies=[])
    assert unit_a(reconcile.class_counts(av, chk, 318)).all_count == 0
    for code in (2, 3, 9, None):
        av, _, chk = supplement(spark, tallies=[], micro=code)
        r = unit_a(reconcile.class_counts(av, chk, 318))
        assert not r.available and r.all_count is None and r.reason.startswith("Incomplete")


@pytest.mark.parametrize("change,reason", [
    ({"plots": ["b"]}, "No RI plot record"), ({"coverage": 0.5}, "Incomplete or contradictory RI microplot frame"), ({"sbp_cn": "wrong"}, "Incomplete or contradictory RI microplot frame"),
    ({"extra": [("a", 1, 2, "x", None)]}, "Incomplete or contradictory RI microplot frame"), ({"measmon": 12}, "Plot date outside May-September or missing"),
    ({"measmon": None}, "Plot date outside May-September or missing"), *[({k: v}, "Invalid RI record or foreign key") for k, v in (
        ("count", None), ("count", 1.5), ("cnd", None), ("scd", "bad"), ("cls", None), ("spcd", None), ("spcd", 999999), ("source", 3))]])
def test_one_broken_field_withdraws_the_unit(spark, change, reason):
    r = unit_a(supplement(spark, **change)[0])
    assert not r.available and r.reason == reason


def test_duplicate_groups_fail(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1)], "k string, j int")
    with pytest.raises(AuditFailure, match="duplicated"):
        reconcile.gate_records({"tallies": (d, ["k", "j"])})


def test_links_split_merge(spark):
    m = spark.createDataFrame([("p", 1, "q", 1, 1, 1.0), ("p", 1, "q", 2, 2, 0.5), ("p", 2, "q", 2, 2, 0.5), ("r", 1, "s", 1, 1, 1.0), ("r", 1, "s", 1, 2, 1.0), ("r", 1, "s", 9, 3, 0.0), ("r", 1, "s", 9, 4, None)],
                              "baseline_plt_cn string, baseline_condid int, current_plt_cn string, current_condid int, subp int, prop_change double")
    got = {(r.baseline_plt_cn, r.baseline_condid, r.current_condid): r for r in links.with_degrees(links.overlap(m)).collect()}
    assert len(got) == 4 and got[("r", 1, 1)].strict_one_to_one and got[("r", 1, 1)].overlap_prop == 0.5 and got[("r", 1, 1)].linked_microplots == 2
    assert got[("p", 1, 1)].baseline_pair_degree == 2 and got[("p", 2, 2)].current_pair_degree == 2 and not got[("p", 2, 2)].strict_one_to_one


def test_the_order_of_slices_does_not_decide_a_share_at_the_limit(spark):
    a, b = (1 / 3 + 1 / 6 + 1 / 2) / 4 / 0.5, (1 / 3 + 1 / 2 + 1 / 6) / 4 / 0.5
    assert a == 0.5 and b < 0.5
    d = spark.createDataFrame([(a, b), (b, a), (a, 0.4999)], "baseline_overlap_fraction double, followup_overlap_fraction double")
    assert [r[0] for r in d.select(links.overlap_adequate(replace(DEFAULTS, minimum_overlap=0.5))).collect()] == [True, True, False]


def test_opportunity_census(spark):
    v = spark.createDataFrame([("a", None, 2017), ("b", None, 2017), ("c", None, 2023), ("a1", "a", 2024), ("a2", "a", 2024), ("b1", "b", 2024)], "plt_cn string, prev_plt_cn string, measyear int").withColumns(
        {"measmon": F.lit(6), "plot_status_cd": F.lit(1)})
    c = spark.createDataFrame([(x, 1) for x in "abc"], "plt_cn string, condid int").withColumns({"cond_status_cd": F.lit(1), "micrprop_unadj": F.lit(1.0)})
    pos = spark.createDataFrame([("b", 1)], "plt_cn string, condid int")
    rows = links.opportunity_census(v, c, [c.select("plt_cn")], pos).collect()
    by = {k: [r for r in rows if r.plt_cn == k] for k in "abc"}
    assert {r.successor_count for r in by["a"]} == {2} and not any(r.single_successor for r in by["a"])
    assert by["b"][0].followup_plot_compatible and by["b"][0].date_window and by["b"][0].standard_record_present
    assert by["c"][0].successor_count == 0 and not by["c"][0].date_window


def test_role_lookup(spark):
    p = spark.createDataFrame([("10", "20"), ("10", "20"), ("11", "21"), ("12", "22")], "b string, c string")
    look = spark.createDataFrame([("10", 2), ("11", None), ("20", 3)], "k string, v int")
    out = links.role_lookup(p, look, "k", "v", range(1, 6), {"b": "vb", "c": "vc"})
    assert sorted((r.vb, r.vc) for r in out.fillna(-1).collect()) == [(-1, -1), (-1, -1), (2, 3), (2, 3)]
    with pytest.raises(AuditFailure):
        links.role_lookup(p, look.union(look.limit(1)), "k", "v", range(1, 6), {"b": "vb"})
    with pytest.raises(AuditFailure):
        links.role_lookup(p, look.withColumn("v", F.lit(0)), "k", "v", range(1, 6), {"b": "vb"})


def test_reconciliation_detects_changes(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    ok = checks.same_rows(a, a, ["k"], ["v", "s"]).collect()
    assert all(r.same for r in ok)
    bad = {r.field: r for r in checks.same_rows(a, a.withColumn("v", F.lit(1.0)), ["k"], ["v", "s"]).collect()}
    assert bad["v"].different == 1 and not bad["v"].same and bad["s"].same
    assert not checks.same_rows(a, a.where("k = 1"), ["k"], ["v"]).first().same


def test_gates_and_flow(spark):
    d = spark.createDataFrame([("a", "p", True), ("a", "q", None), ("b", "q", True), ("b", "r", False)], "u string, v string, f boolean")
    got = [(r.n_rows, r.units, r.vs) for r in checks.flow(d, [("all", F.lit(True)), ("flag", F.col("f"))], {"units": ["u"], "vs": ["v"]}).orderBy("step_no").collect()]
    assert got == [(4, 2, 3), (2, 2, 2)]
    with pytest.raises(AuditFailure):
        checks.gate_unique(d, ["u"])
    with pytest.raises(AuditFailure):
        checks.require_columns(d, ["nope"])
    with pytest.raises(AuditFailure):
        checks.exactly_one(d)
    assert checks.groups_crossing(d, "u", "v").count() == 2


M = [f"m{i}" for i in range(1, 11)]


def parsed(spark, *lines, fn=text.parse_code_rows):
    return fn(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), M).collect()


def test_code_rows(spark):
    a, b, c, d, e, f, g = parsed(spark, "001 1,200 100 2,000 200 30 3 40 4 70 7", "245 " + "0 " * 10, "255f 1 2 3 4 5 6 7 8 12 9", "255 f 1 2 3 4 5 6 7 8 12 9",
                                 "001 1 2 3 4 5 6 7 8 9", "001 1 2 3 NA 5 6 7 8 9 10", "123")
    assert (a.status, a.code, a.m1, a.m8) == ("parsed", "001", 1200, 4) and b.m9 == 0 and c.footnote == d.footnote == "f"
    assert [e.status, f.status, g.status] == ["rejected", "rejected", "ignored"] and e.m1 is None
    with pytest.raises(AuditFailure):
        text.gate_rejects(text.parse_code_rows(spark.createDataFrame([("001 1 2",)], "value string"), M))
    (r,) = parsed(spark, "aHarvest estimates exclude permits. 069 6,442 749 49,458 7,922 63 69 1,045 306 1,108 321", fn=text.parse_backwards)
    assert (r.code, r.m9) == ("069", 1108)


def test_readings_are_independent(spark):
    same = ["001 1,200 100 2,000 200 30 3 40 4 70 7", "255 f 1 2 3 4 5 6 7 8 12 009", "255a f 1 2 3 4 5 6 7 8 12 9", "001 1 2 3 4 5 6 7 8 9", "123", "", "no code at all",
            "001 1 2 3 NA 5 6 7 8 9 10", "001 1,20 2 3 4 5 6 7 8 9 10", "0011 1 2 3 4 5 6 7 8 9 10", "\t245\t1  2 3 4 5 6 7 8 9 10 "]
    for x, y in zip(parsed(spark, *same), parsed(spark, *same, fn=text.parse_backwards)):
        assert (x.status == "parsed") == (y.status == "parsed") and tuple(x)[2:] == tuple(y)[2:]
    # a group of zeros is a number to the one, not to the other; a code before a row is a defect to the one, other text to the other
    apart = [("0,123 1 2 3 4 5 6 7 8 9", "parsed", "ignored"), ("245 1 2 3 4 5 6 7 8 9 10", "rejected", "parsed")]
    for cells, one, other in apart:
        (x,), (y,) = parsed(spark, f"069 {cells}"), parsed(spark, f"069 {cells}", fn=text.parse_backwards)
        assert (x.status, y.status) == (one, other)
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, m int")
    b = spark.createDataFrame([(1, 5), (2, 8), (4, 7)], "k int, m int")
    assert {tuple(r) for r in text.extraction_mismatches(a, b, "k", ["m"]).collect()} == {(2, "different"), (3, "primary only"), (4, "secondary only")}


def test_series_header_rules(spark):
    lines = [("x,y", "k"), ("year,yday,prcp (mm/day),tmax (c)", "k"), ("2001,1,0.5,3", "k"), ("2001,2,1.5,4", "k")]
    d = spark.createDataFrame(lines, "value string, file_key string")
    s = text.parse_series(d, {"year": "year", "rain": "prcp", "tmax": "tmax"}).orderBy("rain").collect()
    assert [(r.year, r.rain, r.tmax) for r in s] == [(2001, 0.5, 3), (2001, 1.5, 4)]
    with pytest.raises(AuditFailure):
        text.parse_series(d, {"year": "year", "tmin": "tmin"})


def test_a_table_of_part_files_is_one_manifest_entry(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    for n in ("p0.parquet", "p1.parquet"):
        (tmp_path / "t.parquet" / n).write_text(n)
    (tmp_path / "u.parquet").write_text("u")
    m = manifest.file_manifest(spark, str(tmp_path), "*.parquet")
    assert {r.file: r.bytes for r in m.collect()} == {"t.parquet": 20, "u.parquet": 1}
    was = {r.file: r.sha256 for r in m.collect()}
    (tmp_path / "t.parquet" / "p1.parquet").write_text("changed")
    now = {r.file: r.sha256 for r in manifest.file_manifest(spark, f"file://{tmp_path}/", "*.parquet").collect()}
    assert was["u.parquet"] == now["u.parquet"] and was["t.parquet"] != now["t.parquet"]


def test_digests_of_files_in_pieces(spark, tmp_path, monkeypatch):
    """Files of many splits and pieces, with and without a last line end, with a mark, long lines, packed by name only."""
    rng = np.random.default_rng(3)
    data = {"a.bin": rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes(), "b.bin": b"\n" * 5000, "c.bin": b"\xef\xbb\xbfone\r\ntwo\n", "d.bin": b"\xef\xbb\xbfone",
            "f.bin": b"\0" * 200_000 + b"\n", "g.gz": b"not packed", "h.gz": gzip.compress(b"packed\n" * 9), "i j%20.bin": b"x", "sub.bin/k.bin": b"\n\xff"}
    for name, b in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b)
    seen = []
    read = type(spark.read).format
    monkeypatch.setattr(manifest, "PIECE", 4096)
    monkeypatch.setattr(type(spark.read), "format", lambda self, kind: seen.append(kind) or read(self, kind))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.file: r.sha256 for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {name: hashlib.sha256(b).hexdigest() for name, b in data.items()}
    want["sub.bin"] = hashlib.sha256(f"sub.bin/k.bin {want.pop('sub.bin/k.bin')}".encode()).hexdigest()
    assert got == want and "text" in seen


def test_a_digest_holds_no_whole_file():
    """The states of 64 MB in pieces take no more memory than a few pieces."""
    piece = pa.array([b"\n" * (1 << 20)], pa.binary())
    one = lambda k: pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (1, 0, 64 << 20, k)] + [piece], ["id", "start", "size", "seq", "piece"])
    tracemalloc.start()
    out = next(manifest._digests(one(k) for k in range(64))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == [{"id": 1, "sha256": hashlib.sha256(b"\n" * (64 << 20)).hexdigest()}] and peak < 8 << 20


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    m = manifest.file_manifest(spark, str(tmp_path), "*.txt")
    pins = m.where("file = 'a.txt'")
    assert {r.file: r.state for r in manifest.compare_manifests(m, pins).collect()} == {"a.txt": "unchanged", "b.txt": "not pinned"}
    rows = manifest.with_replaced(m, m.where("file = 'a.txt'").withColumn("bytes", F.lit(9).cast("long")))
    assert {r.file: r.bytes for r in rows.collect()} == {"a.txt": 9, "b.txt": 3}
    d = spark.createDataFrame([("01", 2)], "geoid string, n int")
    scan.write_table(d, str(tmp_path / "out"), "csv")
    assert scan.read_keyed_csv(spark, str(tmp_path / "out"), "geoid string, n int").first().geoid == "01"
    scan.write_table(d, str(tmp_path / "pq"))
    assert scan.read_required(spark, str(tmp_path / "pq")).count() == 1
    with pytest.raises(AuditFailure):
        scan.read_required(spark, str(tmp_path / "none"))
    with pytest.raises(AuditFailure):
        scan.scan(spark, "no_such_table")
