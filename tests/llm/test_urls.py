import re

from tallyspark.llm import urls
from tallyspark.llm.queries import op4_url_filter


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, k) for k, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_query_and_hard_rows(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    got = op4_url_filter(spark, sf).collect()
    want = {r.page_id: plain(r.url) for r in pages.collect()}
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    hard = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/X?a=b://c"), (5, "x://É.NET/fr/"), (6, "://com"), (7, "a://com/"), (8, "a\n://b.net/es/\nq#f"),
            (9, "x://example.com"), (None, "x://example.com/en/1"), (9, "x://notexample.com/en/"), (10, "x://a.example.org/" + "y" * 100000), (11, "x://m.example.com/EN/")]
    df = spark.createDataFrame(hard, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS key", "4 AS label")
    both = df.unionByName(pages.selectExpr("page_id + 100 AS page_id", "url", "1 AS host", "2 AS rule", "3 AS key", "4 AS label"))
    out = [r for r in urls.judge(both).collect() if (r.page_id or 0) < 100]
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "") for r in out) == sorted((d or 0, *plain(u)[:2], plain(u)[2] or "") for d, u in hard)
    assert urls.judge(df.where("1 = 0")).collect() == []
    assert {r.verdict for r in urls.judge(df.where("page_id in (1, 7, 10)")).collect()} == {"allow"}


def test_trees_recover_withheld_rules(spark):
    """Labels of other URLs of the same kind teach the trees; the withheld ones are judged without their rule."""
    n = 600
    rows = [(i, f"http://{'free-bets9' if i % 2 else 'blog'}.site{i % 50}.example.{'com' if i % 4 < 2 else 'org'}/{'x' * (3 if i % 2 else 12)}/{i}{'?a=1&b=2&c=3' if i % 2 else ''}") for i in range(n)]
    rules = [("block" if i % 2 else "allow", f"{u.split('://')[1].split('/')[0]}/") for i, u in rows[:20] if True]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(df, rules=tuple(dict.fromkeys(rules))).where("rule IS NULL").collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert len(got) > 100 and right / len(got) > 0.95
