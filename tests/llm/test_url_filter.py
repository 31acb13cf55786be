"""URL filter: SQL on the tables, rules and shrinkage by definition."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cellpulse.llm import queries, sql
from cellpulse.llm import url_filter as u
from oracle_compare import _canon, duck, spark_result
from llm_frames import SF_CHECK, SF_SMALL, shipped  # noqa: F401

URLS = ["http://www.Example.COM/en/1?x#y", "https://a.b.example.com/en/2.html", "http://example.com/fr/3/", "http://shop.net/es/4", "http://net/fr/5",
        "http://x.net/de/6", "http://com/7", "http://com", "http://notexample.com/en/8", "no scheme com/9", None, "", "://", "http://host?q=://x.net/es/",
        "ftp://user@WWW.example.com/en/", "http://a.co.uk/10", "http://co.uk/11", "http://x.org", "http://ÄÖ.com/en/1\n2", "http://.net/es/", "a://b://c.com/"]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK, "/root/testdata/sf0.1"])
def test_query_equals_its_sql(spark, sf):
    got = _canon(*spark_result(queries.REGISTRY["op4_url_filter"](spark, sf)), None)
    want = _canon(*duck(sf, sql.ORACLE["op4_url_filter"]), None)
    assert got == want


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, a) for a, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


PAGES = "page_id bigint, url string, html string, host string, n int, bad int, mean int, shown string, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, x, "h", "z", 1, 2, 3, "s", "r") for i, x in urls], PAGES)


def test_parts_and_rules(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]
    got = u.judge(pages(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        host, path = plain_parts(by_id[r.page_id])
        rule, action = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or "allow")


def test_suffix_and_registered_domain(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "x.y.co.uk", "y.co.uk", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = df.select("host", u.suffix_of(F.col("host")).alias("s"), u.registered_of(F.col("host")).alias("d")).collect()
    assert [(r.s, r.d) for r in got] == [("com", "example.com"), ("com", "example.com"), ("com", "com"), ("", ""),
                                        ("co.uk", "y.co.uk"), ("co.uk", "y.co.uk"), ("co.uk", "co.uk")]


def test_shrinkage(spark):
    """A bad host is blocked on many labels, not on one; a host without labels follows its domain."""
    rows, labels, n = [], [], 0
    for host, count, bad in (("bad.site.org", 80, 80), ("good.site.org", 80, 0), ("one.fine.org", 1, 1), ("ok.fine.org", 60, 1),
                             ("a.awful.org", 90, 90), ("b.awful.org", 90, 89), ("c.awful.org", 0, 0), ("x.other.info", 50, 2)):
        for i in range(max(count, 1)):
            rows.append((n, f"http://{host}/p/{n}"))
            if i < count:
                labels.append((n, 0 if i < bad else 1, 0))
            n += 1
    got = {r.host: r for r in u.judge(pages(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    verdicts = {h: r.verdict for h, r in got.items()}
    assert verdicts["bad.site.org"] == verdicts["a.awful.org"] == verdicts["b.awful.org"] == "block"
    assert verdicts["good.site.org"] == verdicts["one.fine.org"] == verdicts["ok.fine.org"] == verdicts["x.other.info"] == "allow"
    assert 0 < got["one.fine.org"].bad_rate < 1
    assert got["c.awful.org"].bad_rate > got["one.fine.org"].bad_rate > got["ok.fine.org"].bad_rate


def test_one_wholly_bad_host_among_thousands_of_pages(spark):
    rows = [(i, f"http://bad.site.org/p/{i}" if i < 50 else f"http://h{i % 400}.d{i % 200}.org/p/{i}") for i in range(4050)]
    labels = [(i, 0 if i < 50 or i * 7919 % 1009 < 100 else 1, 0) for i in range(4050)]
    got = u.judge(pages(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.site.org"}


def test_posterior_by_hand(spark):
    table = spark.createDataFrame([(10, 4.0, 0.25)], "n int, bad double, m double")
    r = u._posterior(table, F.col("m"), 8.0).first()
    a, b = 8 * 0.25 + 4, 8 * 0.75 + 6
    assert r.mean == pytest.approx(a / (a + b)) and r.deviation == pytest.approx(math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))


def test_empty_tables_and_odd_labels(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (2, 0, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert u.judge(pages(spark, []), labels).collect() == []
    got = u.judge(pages(spark, [(1, "http://a.org/1"), (2, "http://a.org/2"), (3, "http://b.org/" + "9" * 40)]), labels).collect()
    assert {r.verdict for r in got} == {"allow"} and len(got) == 3


def test_plan_has_no_python(spark):
    plan = queries.REGISTRY["op4_url_filter"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
