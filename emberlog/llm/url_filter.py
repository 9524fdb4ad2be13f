"""URL filters over redirect equivalence.

Rules name a host (and all its subdomains) and a path prefix; the longest rule that fits decides.
Pages that no rule fits take the decision of their aliases: URLs are joined by redirects (meta
refresh) and canonical links found in the pages, and by a table of edges if one is given; over
these edges distributed connected components are found. Within a component an explicit allow takes
precedence over any block; without either, the page is allowed.

Rules are parameters (their number is bounded by the caller and they become one expression); edges,
components and decisions stay in tables. Only URLs that have an edge take part in the components.
URLs are one node if they are alike after scheme and host are lower-cased, the scheme's default port goes, dot segments are resolved, escapes
of unreserved characters are undone (others are upper-cased) and the fragment is cut.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no alias;
null html has no links; repeated pages are judged each; edges to oneself say nothing; other columns are ignored; html of any
length is scanned in linear time (a tag with a bare ``<`` or ``>`` in it is no tag).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import connected_components
from emberlog.llm.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


#: The rules of the query, fixed values.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved_path(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments, as RFC 3986 (5.2.4) removes them; an empty path is ``/``."""
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.element_at(parts, -1).isin(".", "..")
    text = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), text).otherwise(path)


def plain_escapes(url: Column) -> Column:
    """Escapes of letters, digits and ``-._~`` written as such, other escapes in upper case (RFC 3986, 6.2.2)."""
    escape = r"%[0-9A-Fa-f]{2}"
    parts = F.regexp_extract_all(url, F.lit(rf"(?s){escape}|%|[^%]+"), F.lit(0))
    sign = lambda x: F.decode(F.unhex(F.substring(x, 2, 2)), "ISO-8859-1")
    plain = lambda x: F.when(~x.rlike(f"^{escape}$"), x).when(sign(x).rlike(r"^[A-Za-z0-9._~-]$"), sign(x)).otherwise(F.upper(x))
    return F.when(url.contains("%"), F.array_join(F.transform(parts, plain), "")).otherwise(url)


def normal_url(url: Column) -> Column:
    """The key under which a URL is an alias: scheme and host lower-cased, no default port, escapes plain, dot segments resolved, no fragment."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    port = F.when(scheme == "http", F.lit(r":(80)?$")).when(scheme == "https", F.lit(r":(443)?$")).otherwise(F.lit(r":$"))
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    search = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, resolved_path(plain_escapes(path_of(url))), plain_escapes(search))).otherwise(url)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Length: host and path together; more host labels win ties."""
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), -r.host.count(".")))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, or null. Attributes are read one after the other, so that what looks like one within another's value or name is none."""
    value = r"(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    named = F.filter(F.regexp_extract_all(tag, F.lit(rf"(?s)[^\s\"'>/=]+\s*=\s*{value}"), F.lit(0)), lambda x: x.rlike(rf"(?i)^{name}\s*="))
    found = F.regexp_extract(F.get(named, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.nullif(F.when(found.rlike("^[\"']"), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found), F.lit(""))


def _absolute(target: Column, base: Column) -> Column:
    """Target of a link as a URL: whole, without a scheme, from the root, or beside the page."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme, root = F.regexp_extract(base, r"(?s)^([^:]*:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, target))
        .when(target == "", base).when(target.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), target)).when(target.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), target))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a`` (page) and ``b`` (what its canonical links and meta refreshes name, by the page's ``base`` if it has one), as URLs. Comments and scripts are passed over."""
    page, body = F.col(url), F.col(html)
    hidden = r"(?is)<!--(?:.*?-->|.*)|<(script|style|textarea|title|noscript|template)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|$)"
    rows = pages.filter(body.isNotNull() & page.contains("://") & body.rlike(r"(?i)canonical|refresh")).select(page.alias("page"), F.regexp_replace(body, hidden, " ").alias("seen"))
    tags = F.regexp_extract_all("seen", F.lit(r"(?is)<(?:link|meta|base)(?=[\s/>])[^<>]*+>"), F.lit(0))
    rows = rows.select("page", tags.alias("tags"))
    bases = F.filter(F.transform("tags", lambda t: F.when(F.lower(t).startswith("<base"), _attribute(t, "href"))), lambda b: b.isNotNull())
    named = rows.select(F.col("page").alias("a"), F.coalesce(_absolute(F.get(bases, F.lit(0)), F.col("page")), F.col("page")).alias("base"), F.explode("tags").alias("tag"))
    named = named.filter(F.col("tag").rlike(r"(?i)canonical|refresh"))
    canonical = F.when(_attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.nullif(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1), F.lit("")))
    target = F.when(F.lower(F.col("tag")).startswith("<link"), canonical).otherwise(refresh)
    return named.select("a", _absolute(target, F.col("base")).alias("b")).filter("b is not null")


def alias_verdicts(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``url`` (normalised)``, alias_verdict`` for every URL with an edge to another: allow if any alias is explicitly allowed, else block if any is blocked."""
    edges = materialise(edges.select(normal_url(F.col("a")).alias("a"), normal_url(F.col("b")).alias("b")).filter("a is not null and b is not null"), "links")
    parts = materialise(connected_components(edges), "parts")
    own = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    said = parts.select("component", own.alias("own")).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    said = said.select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict")).filter("alias_verdict is not null")
    return parts.join(said, "component").select(F.col("node").alias("url"), "alias_verdict")


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, *, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per page. ``redirects``: further edges (a, b) between URLs."""
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    verdicts = materialise(alias_verdicts(edges, rules), "verdicts").withColumnRenamed("url", "alias_url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(verdicts, normal_url(F.col("url")) == F.col("alias_url"), "left")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
