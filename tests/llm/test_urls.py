"""URL rules and the weighted vocabulary, against plain regular expressions and SQL."""

import os
import re

import pytest

from crossbasket.llm import urls

duckdb = pytest.importorskip("duckdb")

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "https://a.b.example.com/en/x?y#z",
    "http://example.com/EN/1", "http://example.com/en", "http://com/", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/",
    "http://x.org/casino", "http://x.org/casinox", "http://xcasino.org/", "http://cheap-pills.org/", "http://cheap.org/cheap/cheap",
    "http://pornhub.org/", "http://x.org/%63asino", "http://x.org/%43ASINO%20", "http://x.org/%2563asino", "http://x.org/%", "http://x.org/%zz",
    "http://x.org/éadult-x", "http://adult.x\nhttp://second.org", "a://b://c.com/d", "http://user@x.com:80/p", "http://x.com?q=/", "http://ads.track.org#ads",
    "http://x.org/" + "ads/" * 50_000, "://", "http://.com/", "http://x.org/free/bonus/win",
]


def plain(url):
    text = url or ""
    at = text.find("://")
    rest = text[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = host.translate(lower)
    fits = [
        r for r in urls.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    one = max(fits, key=lambda r: len(r.name), default=None)
    folded = re.sub("%(2[1-9A-Fa-f]|[3-6][0-9A-Fa-f]|7[0-9A-Ea-e])", lambda m: chr(int(m[1], 16)), text).translate(lower)
    hit = [
        t for t in urls.TERMS
        if re.search(rf"(?<![a-z0-9]){re.escape(t.text)}(?![a-z0-9])" if t.whole else re.escape(t.text), folded)
    ]
    soft = [t.weight for t in hit if t.weight]
    bad = len(soft) < len(hit) or (len(soft) > 1 and sum(soft) >= urls.LIMIT)
    verdict = ("allow" if one.allow else "block") if one else ("block" if bad else "allow")
    return host, path, one and one.name, verdict, len(hit) - len(soft), len(soft), sum(soft)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, 5, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule int, host string")


def test_judged_like_regular_expressions(pages):
    got = {r["page_id"]: tuple(r)[1:5] + tuple(r)[6:] for r in urls.judged(pages).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_sql_twin_on_awkward_urls(pages):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    expected = sorted(connection.execute(urls.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in urls.judged(pages).drop("n_hits").collect()) == expected
    connection.close()


def test_hits_are_counted_each(spark):
    page = spark.createDataFrame([(1, "http://ads.org/ads-ads/adsx")], "page_id long, url string")
    row = urls.judged(page).first()
    assert (row["n_hits"], row["n_soft"], row["soft_weight"]) == (3, 1, 2)


def test_repeated_rows_and_empty_tables(spark, pages):
    assert urls.judged(pages.limit(0)).collect() == []
    twice = urls.judged(pages.unionAll(pages)).collect()
    assert len(twice) == 2 * len(URLS)
    assert urls.judged(pages, rules=(), terms=()).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_wrong_parameters():
    for terms in ([urls.Term("", 0)], [urls.Term("A", 0)], [urls.Term("a", 4)], [urls.Term("a", 0), urls.Term("a", 1)]):
        with pytest.raises(ValueError):
            urls.UrlFilter((), terms, 4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_hosts_of_two_soft_terms_are_blocked(spark):
    rows = urls.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("rule IS NULL")
    assert {r["host"].split(".")[-3] for r in rows.filter("verdict = 'block'").select("host").distinct().collect()} <= {
        "ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"
    }
