"""URL verdicts by host and path rules, propagated over redirects and canonical links.

Built-in functions only.  A page's own longest rule decides it.  Pages without a
rule take their component's verdict: urls are nodes, and a page's canonical
link, its meta refresh and the given redirects are edges.  A component with an
explicitly allowed url is allowed; else one with a blocked url is blocked; else
it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthbook.llm._graph import components
from hearthbook.llm._store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What aliases of one address share: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), query))


def absolute(base: Column, link: Column) -> Column:
    """A link of the page at base as a whole url; of steps . and .. see ``steps``."""
    root = F.concat(F.regexp_extract(base, r"(?s)^(.*?://)", 1), host(base))
    own = F.concat(F.lit("/"), F.ltrim(path(base), F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("?")), F.concat(root, own, link))
        .when(F.startswith(link, F.lit("#")), base)
        .otherwise(F.concat(root, F.regexp_replace(own, r"[^/]*$", ""), link))
    )


def steps(url: Column) -> Column:
    """The url without steps . and .. in its path, which end where they lead."""
    parts = F.split(path(url), "/")
    up = lambda held: F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == ".", held).when(p == "..", up(held)).otherwise(F.concat(held, F.array(p))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    front, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    return F.when(path(url).rlike(r"(^|/)\.\.?(/|$)"), F.concat(front, F.array_join(walked, "/"), ends, rest)).otherwise(url)


def matched(host_of: Column, path_of: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none does; allow wins between equals.

    rules are (verdict, host, path); a rule fits its host and every subdomain if
    the path starts with the rule's.
    """
    fits = []
    for verdict, rule_host, rule_path in rules:
        own = (host_of == rule_host) | F.endswith(host_of, F.lit("." + rule_host))
        found = F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(verdict == "allow").alias("allowed"), F.lit(rule_host + rule_path).alias("rule"))
        fits.append(F.when(own & F.startswith(path_of, F.lit(rule_path)), found))
    best = F.array_max(F.array_compact(F.array(*fits)))
    return F.when(best.isNotNull(), F.struct(F.when(best["allowed"], F.lit("allow")).otherwise(F.lit("block")).alias("verdict"), best["rule"].alias("rule")))


def links(pages: DataFrame) -> DataFrame:
    """(url, target): the pages' canonical links and meta refreshes as written, those in comments and scripts left out, &amp; read as &."""
    seen = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.regexp_extract_all(F.when(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh")), seen), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    value = r"""\s*=\s*["']?([^"'>\s]+)"""
    each = pages.where("url is not null and html is not null").select("url", F.explode(tags).alias("tag")).where(r"tag rlike '(?is)canonical|refresh'")
    canonical = F.when(F.col("tag").rlike(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b"""), F.regexp_extract("tag", "(?is)\\bhref" + value, 1))
    refresh = F.when(F.col("tag").rlike(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*'?([^"'>\s]+)""", 1))
    return each.select("url", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("target"))


def edges(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, target) -> (a, b), the nodes at both ends.

    Each step is written: the found links are few, and inlining one step's
    expressions into the next makes code that no compiler takes.
    """
    named = scratch.keep("links", found.where("url is not null and target is not null")).where("target <> ''")
    joined = scratch.keep("joined", named.select("url", absolute(F.col("url"), F.col("target")).alias("link")))
    whole = scratch.keep("absolute", joined.select("url", steps(F.col("link")).alias("link")))
    return scratch.keep("edges", whole.select(node(F.col("url")).alias("a"), node(F.col("link")).alias("b"))).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, host, path, rule, verdict, component.

    redirects (from_url, to_url) adds edges.  Every row comes back once.  A null
    url, or one without ://, has empty host and path, fits no rule, has no alias
    and is allowed.  component is the smallest node of the row's component, null
    where the url has no edge.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    found = links(pages)
    if redirects is not None:
        found = found.unionAll(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("target")))
    roots = components(edges(found, scratch), scratch)
    at = F.struct(F.substring_index("node", "/", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/]*(/[^?]*)", 1).alias("path"))
    seeds = roots.withColumn("at", at).withColumn("own", matched(F.col("at.host"), F.col("at.path"), rules))
    rank = F.when(F.col("own.verdict") == "allow", 2).when(F.col("own.verdict") == "block", 1).otherwise(0)
    state = seeds.groupBy("root").agg(F.max(rank).alias("state"))
    spread = roots.join(state, "root").select("node", "root", "state")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("at"))
    rows = rows.withColumn("own", matched(F.col("host"), F.col("path"), rules))
    joined = rows.join(spread, F.col("at") == F.col("node"), "left")
    from_method = F.when(F.col("state") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", from_method).alias("verdict"), F.col("root").alias("component"))
