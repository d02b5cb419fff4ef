"""Allow and block decisions on URLs, carried over redirects and canonical links.

A rule names a host and the beginning of a path. Where no rule fits a URL itself, its aliases decide: URLs that differ
only in form (scheme, ``www.``, default port, fragment, closing slash, order of parameters, tracking parameters) are
one node, and redirects and declared canonical addresses are edges between nodes. Connected components of this graph
are the groups of aliases. A rule that fits a URL always decides on it; else an allowed alias saves the whole group,
else a blocked alias condemns it.

Only DataFrame functions are used. The components are those of declared links alone, not of all pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import cut
from relaykit.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[ce]id|igshid)(=|\z)"
# Address of a link tag, and of a refresh: quoted or bare.
_HREF = r"(?i)\shref\s*=\s*(?:\"([^\">]*)|'([^'>]*)|([^\s\"'>]+))"
_REFRESH = r"(?i)\scontent\s*=\s*(?:\"[^\">]*?url\s*=\s*([^\">]*)|'[^'>]*?url\s*=\s*([^'>]*))"
# Up to so many decided nodes (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 100_000
# A node that more than 1/4096 of the asking pages share, and more than HOT_ROWS, is dealt to several tasks.
HOT_SHARE = 4096
HOT_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Place in ``rules`` of the longest one (host and path together) that fits; of equally long ones an allowing one. Else null.

    The rules are compiled into the plan, so they are configuration, not data.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(str(rules[i])), rules[i].action != ALLOW, i))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*[F.when(fits(rules[i]), F.lit(i)) for i in order], F.lit(None).cast("int"))


def normal_form(url: Column) -> Column:
    """One text for all forms of a URL; null where there is no ``://`` or no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    parameters = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(parameters, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+\z", ""), query))


def node_of(url: Column) -> Column:
    """128 bits of the normal form."""
    return F.md5(normal_form(url))


def absolute(link: Column, page: Column) -> Column:
    """``link`` as found on ``page``; null if it is empty, or neither absolute nor on a page with a host."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    base = F.regexp_extract(page, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:/?#]*:)//", 1), link))
        .when(base == "", None)
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(folder == base, F.concat(base, F.lit("/"), link))
        .otherwise(F.concat(folder, link))
    )


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``source, target``: addresses that pages give for themselves, by ``link rel=canonical`` or by a refresh.

    Null or empty pages declare none. Tags inside comments or scripts count as well. Repeated rows give repeated links.
    """
    likely = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("source"), F.col(html).alias("html"))
    tags = likely.select("source", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), F.lit(1))).alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^<link\s") & F.col("tag").rlike(r"(?i)\srel\s*=\s*[\"']?\s*canonical\b")
    refresh = F.col("tag").rlike(r"(?i)^<meta\s") & F.col("tag").rlike(r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh\b")
    address = lambda pattern, groups: F.concat(*[F.regexp_extract("tag", pattern, g) for g in groups])
    found = F.when(canonical, address(_HREF, (1, 2, 3))).when(refresh, address(_REFRESH, (1, 2)))
    return tags.select("source", absolute(found, F.col("source")).alias("target")).filter("target is not null")


def judge(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Adds ``host, path, rule, verdict, reason`` to every row of ``pages``; columns of these names are replaced.

    ``links`` has ``source`` and ``target`` URLs; those with a null end, or without a host, count for nothing, repeated
    ones once. ``reason`` is ``rule`` (one fits the URL itself), ``alias`` (one fits an alias) or ``default``. Links may
    name URLs that are no pages; the rules that fit them count like those of pages. A URL that is null or has no
    ``://`` has no alias. Repeated rows each get the verdict. Empty tables give an empty result.
    """
    if any(r.action not in (ALLOW, BLOCK) for r in rules):
        raise ValueError(f"a rule either says {ALLOW} or {BLOCK}")
    pages = pages.drop("host", "path", "rule", "verdict", "reason")
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    actions = F.array(*[F.lit(r.action) for r in rules]) if rules else F.array().cast("array<string>")
    names = F.array(*[F.lit(str(r)) for r in rules]) if rules else F.array().cast("array<string>")
    action = F.get(actions, F.col("place"))

    def judged(df: DataFrame) -> DataFrame:
        split = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        return split.withColumn("place", fitting_rule(F.col("host"), F.col("path"), rules))

    rows = judged(pages.select(own.alias("row"), F.col(f"`{url}`").alias("url"))).withColumn("node", node_of(F.col("url")))
    marks = rows.select("node", action.alias("action"), F.col("place").isNull().cast("int").alias("asks"))
    ends = _edges(links) if links is not None else None
    if ends is not None:
        both = ends.select(F.col("source").alias("url")).union(ends.select("target"))
        marks = marks.union(judged(both).select(node_of(F.col("url")), action, F.lit(0)))
    # One row a node: how many pages ask for a verdict, and whether a rule allows or blocks one of its forms.
    nodes = marks.filter("node is not null").groupBy("node").agg(
        F.sum("asks").alias("asks"), F.max(F.col("action") == ALLOW).alias("allowed"), F.max(F.col("action") == BLOCK).alias("blocked")
    )
    if ends is not None:
        parts = connected_components(ends.select("a", "b"))
        named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = cut(named)
        groups = named.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        # Only groups that a rule touches are sent back to their nodes.
        nodes = named.select("node", "component", "asks").join(groups.filter("allowed or blocked"), "component")
    verdict = F.when(F.col("allowed"), ALLOW).otherwise(BLOCK)
    decided = cut(nodes.filter("asks > 0 and (allowed or blocked)").select("node", "asks", verdict.alias("group")))

    settled = rows.filter("place is not null or node is null").withColumn("group", F.lit(None).cast("string"))
    asking = rows.filter("place is null and node is not null")
    found = settled.unionByName(_with_groups(asking, decided))
    return found.select(
        "row.*", "host", "path", F.get(names, F.col("place")).alias("rule"), F.coalesce(action, F.col("group"), F.lit(default)).alias("verdict"),
        F.when(F.col("place").isNotNull(), "rule").when(F.col("group").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def _edges(links: DataFrame) -> DataFrame | None:
    """``a, b, source, target`` of the links between different nodes; None if there are none."""
    found = links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"), "source", "target")
    found = cut(found.filter("a <> b").distinct())
    return None if found.isEmpty() else found


def _with_groups(asking: DataFrame, decided: DataFrame) -> DataFrame:
    """``asking`` with the ``group`` verdict of its ``node``, null where there is none."""
    sums = decided.agg(F.count(F.lit(1)).alias("n"), F.sum("asks").alias("asks")).first()
    if sums["n"] <= BROADCAST_NODES:
        return asking.join(F.broadcast(decided.select("node", "group")), "node", "left").select(*asking.columns, "group")
    # Pages of a hot node are dealt to several tasks; fewer than HOT_SHARE nodes are hot.
    width = max(HOT_ROWS, sums["asks"] // HOT_SHARE)
    hot = decided.filter(F.col("asks") > width).select("node", F.ceil(F.col("asks") / width).cast("int").alias("salts"))
    copies = decided.join(F.broadcast(hot), "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    dealt = asking.join(F.broadcast(hot), "node", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int"))
    return dealt.join(copies.select("node", "salt", "group"), ["node", "salt"], "left").select(*asking.columns, "group")
