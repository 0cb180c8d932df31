"""URL filters: rules by host and path, and redirect equivalence for what no rule decides.

A rule fits its host and every subdomain if the URL's path starts with the rule's path; the longest rule wins. URLs that
redirect to each other, or name each other as canonical, are aliases: their connected components come from the edges of
all pages. A page without a rule of its own is blocked if any alias (a page or a link's target) is blocked by a rule, and
allowed otherwise. An explicit rule always precedes what aliases say, so an allowed alias stays allowed.

Edges are read from the whole page: ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh content="...url=...">``,
resolved against the page's own URL. Two URLs are one node if they are equal without scheme and fragment.

A null URL, or one without ``://``, has an empty host and path, no rule and no aliases; it is allowed. Repeated rows are
judged alike. Everything is a column expression; a hub of many aliases is handled by the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.operators.graph import connected_components
from filamenta.session import staged

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest fitting rule, or null."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
        for v, h, p in by_length
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def node_of(url: Column) -> Column:
    """What makes URLs the same node: host, path and query; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(url.contains("://"), F.concat(host_of(url), path, query))


def resolved(link: Column, url: Column) -> Column:
    """A link's absolute URL, read on the page ``url``."""
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, to): the page's node and the URL that it names."""
    u = F.col(url)
    links = F.array_union(F.regexp_extract_all(F.col(html), F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(F.col(html), F.lit(REFRESH), F.lit(1)))
    marked = pages.where(u.contains("://") & (F.col(html).rlike(CANONICAL) | F.col(html).rlike(REFRESH)))
    return marked.select(u.alias("_from"), F.explode(links).alias("_link")).select(node_of(F.col("_from")).alias("a"), resolved(F.col("_link"), F.col("_from")).alias("to"))


def judged(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict): one row per row of ``pages``."""
    u = F.col(url)
    fits = F.struct(host_of(u).alias("host"), path_of(u).alias("path"))
    own = pages.select(F.col(key).alias("key"), u.alias("url"), fits.alias("at")).select("key", "url", "at.host", "at.path", rule_of(F.col("at.host"), F.col("at.path"), rules).alias("fit"))
    edges = staged(alias_edges(pages, url, html).select("a", node_of(F.col("to")).alias("b"), "to").where("b is not null"), "alias-edges")
    if edges.isEmpty():  # no page names an alias
        verdict = F.coalesce(F.col("fit.verdict"), F.lit("allow"))
        return own.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
    found = staged(connected_components(edges, "a", "b"), "aliases")
    to = F.col("to")
    by_target = edges.where(rule_of(host_of(to), path_of(to), rules)["verdict"] == "block").select(F.col("b").alias("node"))
    by_page = own.where(F.col("fit.verdict") == "block").select(node_of(F.col("url")).alias("node"))
    blocked = by_target.unionByName(by_page).distinct().join(found, "node").select("component").distinct()
    aliases = found.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"))
    undecided = F.when(F.col("fit").isNull(), node_of(F.col("url")))
    out = own.withColumn("node", undecided).join(aliases, F.col("node") == F.col("alias"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("alias").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
