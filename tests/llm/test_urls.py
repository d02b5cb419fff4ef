from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from relaykit.llm import urls
from relaykit.llm.queries import OP11_RULES, OP11_SQL, op11_url_filter
from tests.oracle import compare, connect

PAGES = [
    "http://WWW.Example.NET/en/1", "https://example.net/de/2", "https://example.net", "http://a.example.com/de/3?x=1#y", "http://a.example.com/de", "http://example.org/fr/", "http://notorg/fr/",
    "no scheme", "", None, "://", "://host?q", "http://h.com/a/?utm_source=feed&b=2&a=1", "https://www.h.com:443/a?a=1&b=2&ref=x", "x://y://z/w", "http://h.com#a/b", "http://EXAMPLE.com/DE/x",
]
HEADS = [
    ("http://one.com/p", '<link rel="canonical" href="http://b.net/x">'), ("http://two.com/p", "<LINK HREF='//one.com/p' REL='Canonical'>"), ("http://three.com/q/r", '<meta http-equiv="refresh" content="0; URL=http://two.com/p/">'),
    ("http://four.com/q/r", '<link rel=canonical href=s>'), ("http://four.com/q/s", '<link rel="canonical" href="/fr/t?a=1&amp;b=2">'), ("http://four.com/fr/t?b=2&a=1", '<link rel="canonical" href="http://five.org/fr/u"><link rel="canonical" href="http://c.net/">'),
    ("http://six.com", '<link rel="canonical" href="seven">'), ("http://six.com/seven", '<link rel="canonical" href="mailto:a@b.net"><link rel="stylesheet" href="http://b.net/x">'), ("http://eight.com/", "<link rel='canonical' href=''>"), (None, '<link rel="canonical" href="http://b.net/x">'),
]


def plain(pages, links, rules):
    """Verdicts by walking the graph from every page."""
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]

    def rule(url):
        host, path = split(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: (len(str(r)), r.action == "allow"), default=None)

    def form(url):
        host, path = split(url)
        if not host:
            return None
        host = host.removeprefix("www.")
        host = host.removesuffix(":80") if host.endswith(":80") else host.removesuffix(":443")
        query = url.split("#")[0].split("?", 1)[1].split("&") if "?" in url.split("#")[0] else []
        query = sorted(q for q in query if q and q.split("=")[0] not in ("ref", "utm_source"))
        return host + path.rstrip("/") + ("?" + "&".join(query) if query else "")

    near = {}
    for a, b in links:
        if form(a) and form(b):
            near.setdefault(form(a), set()).add(form(b))
            near.setdefault(form(b), set()).add(form(a))
    every = [*pages, *[u for pair in links if form(pair[0]) and form(pair[1]) for u in pair]]
    out = []
    for url in pages:
        own, group, todo = rule(url), set(), [form(url)]
        while todo:
            if (node := todo.pop()) is not None and node not in group:
                group.add(node)
                todo += near.get(node, ())
        said = {r.action for u in every if form(u) in group and (r := rule(u))}
        verdict = own.action if own else "allow" if "allow" in said or not said else "block"
        out.append((*split(url), str(own) if own else None, verdict))
    return out


def judged(spark, rows, links=None, rules=OP11_RULES):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string").withColumn("node", F.lit(1)).withColumn("verdict", F.lit("x")).withColumn("group", F.lit(2))
    links = spark.createDataFrame(links, "source string, target string") if links else None
    found = urls.judge(frame, rules, links)
    assert found.columns == ["page_id", "url", "node", "group", "host", "path", "rule", "verdict", "reason"]
    return [tuple(r)[4:8] for r in sorted(found.collect(), key=lambda r: r["page_id"])]


LINKS = [("http://notorg/fr/", "http://k.net/"), ("http://h.com/a?b=2&a=1", "http://mid.com"), ("http://mid.com/", "http://example.org/fr/x"), ("http://mid.com", "http://k.net/"), (None, "http://k.net/"), ("http://h.com", "http://h.com/"), ("http://l.com/", "http://m.com"), ("http://m.com", "http://k.net/z"), ("http://m.com", "http://k.net/z"), ("x", "http://k.net/")]


@pytest.mark.parametrize("small", [True, False])
def test_verdicts_equal_a_walk_of_the_graph(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urls, "BROADCAST_NODES", 0)
        monkeypatch.setattr(urls, "HOT_ROWS", 3)
    pages = [*PAGES, *["http://l.com"] * 40, "http://a.example.com/de/", *PAGES]
    assert judged(spark, pages, LINKS) == plain(pages, LINKS, OP11_RULES)
    assert judged(spark, pages) == plain(pages, [], OP11_RULES)


def test_no_rules_no_rows(spark):
    assert {r[2:] for r in judged(spark, PAGES, LINKS, [])} == {(None, "allow")}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty, OP11_RULES, urls.declared_links(empty)).count() == 0
    with pytest.raises(ValueError):
        judged(spark, PAGES, rules=[urls.Rule("drop", "a")])


def test_declared_links(spark):
    frame = spark.createDataFrame([*HEADS, ("http://a.com", None), ("http://a.com", "")], "url string, html string")
    got = sorted(tuple(r) for r in urls.declared_links(frame).filter("source is not null").collect())
    assert got == sorted([
        ("http://one.com/p", "http://b.net/x"), ("http://two.com/p", "http://one.com/p"), ("http://three.com/q/r", "http://two.com/p/"), ("http://four.com/q/r", "http://four.com/q/s"),
        ("http://four.com/q/s", "http://four.com/fr/t?a=1&b=2"), ("http://four.com/fr/t?b=2&a=1", "http://five.org/fr/u"), ("http://four.com/fr/t?b=2&a=1", "http://c.net/"), ("http://six.com", "http://six.com/seven"),
    ])


def test_query_and_its_sql(spark, tmp_path):
    assert compare(connect("/root/testdata/sf0.001"), op11_url_filter(spark, "/root/testdata/sf0.001"), OP11_SQL) == ""
    # Pages that declare links: the given ones hold none.
    rows = [(i, u, h) for i, (u, h) in enumerate([*HEADS, *[(u, "<p>") for u in PAGES], ("http://w.com/1", '<link rel="canonical" href="http://four.com/q/r">'), ("http://v.com", None)])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(con, op11_url_filter(spark, str(tmp_path)), OP11_SQL) == ""
    verdicts = {r["page_id"]: (r["verdict"], r["reason"]) for r in op11_url_filter(spark, str(tmp_path)).collect()}
    assert [verdicts[i] for i in range(7)] == [("block", "alias")] * 3 + [("allow", "alias")] * 3 + [("allow", "default")]
    assert json.dumps(verdicts[len(rows) - 2]) == '["allow", "alias"]'
