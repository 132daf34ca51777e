"""URL filters whose decisions reach a page's aliases.

Rules name a host, all its subdomains with it, and the beginning of a path.  Two urls are aliases if one names the other
as its canonical link or redirects to it at once; aliases of aliases are aliases too, so they are the connected components of a
graph of urls, found by Spark joins.  A url that no rule fits is blocked if a rule blocks one of its aliases and none
allows one: an explicit permission goes before a block that arrives from elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stash, without
from .neardup import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: Tags that name another address of the page, and their attributes; the same text in Spark's and DuckDB's patterns.
COMMENT = r"(?s)<!--.*?-->"
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
CANONICAL = r"(?is)\srel\s*=\s*[\"']?\s*canonical[\s\"'/>]"
REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh[\s\"'/>]"
#: A redirect counts if it comes at once or within nine seconds.
LINK_TARGET = r"(?is)\shref\s*=\s*[\"']?\s*([^\s\"'>]+)"
REFRESH_TARGET = r"(?is)\scontent\s*=\s*[\"']?\s*[0-9](?:\.[0-9]*)?\s*[;,]\s*url\s*=\s*[\"']?\s*([^\s\"'>]+)"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a url; all empty if it is null or has no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substring(after, F.length(path) + 1, F.length(after)), r"^\?[^#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, query


def address(host: Column, path: Column, query: Column) -> Column:
    """What tells pages apart: scheme, fragment and a slash at the end don't count; null without a host."""
    return F.when(host != "", F.concat(host, F.rtrim(path, F.lit("/")), query))


def targets(html: Column) -> Column:
    """The addresses, as written, that a page's tags outside comments name as canonical or redirect to."""
    clean = F.regexp_replace(html, COMMENT, "")
    tags = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_extract_all(clean, F.lit(TAGS), F.lit(0)))
    named = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, LINK_TARGET, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, REFRESH_TARGET, 1)).otherwise(""))
    return F.coalesce(F.array_distinct(F.filter(named, lambda t: t != "")), F.array().cast("array<string>"))


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The whole url of an address that stands on the page at host and path; null if it names the page itself or isn't of the web."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(F.lit("x:"), t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | t.startswith("#"), F.lit(None))
        .when(t.startswith("/"), F.concat(F.lit("x://"), host, t)).when(t.startswith("?"), F.concat(F.lit("x://"), host, path, t))
        .otherwise(F.concat(F.lit("x://"), host, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)?", 0)), t))
    )


def judged(urls: DataFrame, rules: tuple[Rule, ...] | list[Rule]) -> DataFrame:
    """``urls`` (distinct host, path, address) with rule and rule_verdict of the longest rule that fits, else null.

    Each url meets the rules by an equi-join: on the ends of its host, as many as the rules' hosts have parts, and on the
    beginnings of its path, as long as the rules of that host have them.  Of rules of one length the one with the
    longer host counts, and of those that permission.
    """
    rules = [(r.verdict, r.host, r.path, f"{r.host}{r.path}") for r in dict.fromkeys(rules)]
    table = urls.sparkSession.createDataFrame(rules, "rule_verdict string, r_host string, r_path string, rule string")
    most = max((r[1].count(".") + 1 for r in rules), default=0)
    lengths = table.groupBy(F.col("r_host").alias("end")).agg(F.collect_set(F.length("r_path")).alias("lengths"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda k: F.concat_ws(".", F.slice(parts, -k, k)))
    each = urls.filter(F.lit(most > 0) & (F.col("host") != "")).select("host", "path", F.explode(ends).alias("end"))
    starts = each.join(checked_broadcast(lengths), "end").select("host", "path", "end", F.explode("lengths").alias("length"))
    fits = starts.filter(F.length("path") >= F.col("length")).join(
        checked_broadcast(table), (F.col("end") == F.col("r_host")) & (F.expr("substring(path, 1, length)") == F.col("r_path")),
    )
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("rule_verdict") == "allow", "rule")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", "address", "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and via (the rule whose block arrived from an alias) of every page.

    ``links`` (url, target) adds redirects known from elsewhere, such as a crawler's log.  A page's own rule, the
    longest, decides alone; without one, its aliases do.  Null urls and urls without ``://`` have empty host and path,
    no aliases and the verdict allow; null pages have no links.  Repeated pages and null ids each keep their row; an
    empty table gives none.
    """
    here, path, query = host_and_path(F.col(url_col))
    html = F.col(html_col) if html_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), here.alias("host"), path.alias("path"), query.alias("query"), targets(html).alias("targets"))
    rows = stash(rows.withColumn("address", F.md5(address(F.col("host"), F.col("path"), F.col("query")))).drop("query"), "urls")

    found = rows.filter("address is not null").select("host", "path", "address", F.explode("targets").alias("t"))
    # An exploded array of one names a result: later expressions don't repeat its text.
    found = found.select(F.col("address").alias("a"), F.explode(F.array(resolved(F.col("t"), F.col("host"), F.col("path")))).alias("url"))
    own = rows.filter("address is not null").select("host", "path", "address")
    seen = [own]
    if links is not None:
        h, p, q = host_and_path(F.col("url"))
        start = links.select(h.alias("host"), p.alias("path"), F.md5(address(h, p, q)).alias("address"), F.col("target").cast("string").alias("target")).filter("address is not null")
        seen.append(start.drop("target"))
        found = found.union(start.select("address", F.explode(F.array(resolved(F.col("target"), F.col("host"), F.col("path"))))))
    h, p, q = host_and_path(F.col("url"))
    found = found.filter("url is not null").select("a", h.alias("host"), p.alias("path"), F.md5(address(h, p, q)).alias("b")).filter("b is not null")
    found = stash(found.distinct(), "links")
    urls = found.select("host", "path", F.col("b").alias("address"))
    for more in seen:
        urls = urls.union(more)
    verdicts = stash(judged(urls.distinct(), rules), "judged")

    said = verdicts.groupBy("address").agg(F.max(F.when(F.col("rule_verdict") == "block", F.col("rule"))).alias("blocked"), F.max(F.col("rule_verdict") == "allow").alias("allowed"))
    edges = found.filter("a <> b").select("a", "b").distinct()
    label = components(edges, "aliases").withColumnsRenamed({"doc": "address"})
    named = said.join(label, "address", "left").withColumn("label", F.coalesce("label", "address"))
    groups = named.groupBy("label").agg(F.max("blocked").alias("via"), F.max(F.coalesce("allowed", F.lit(False))).alias("allowed"))
    bad = stash(named.select("address", "label").join(groups.filter("via is not null and not allowed").drop("allowed"), "label").select(F.col("address").alias("bad"), "via"), "blocked")

    spelled = verdicts.filter("rule is not null").select("host", "path", "rule", "rule_verdict").distinct()
    out = rows.select("page_id", "host", "path", "address").join(checked_broadcast(spelled, 100_000), ["host", "path"], "left").join(checked_broadcast(bad, 100_000), F.col("address") == F.col("bad"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("via").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("via")).alias("via"))


def allowed(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, links: DataFrame | None = None) -> DataFrame:
    """The rows of ``pages`` that no rule blocks, directly or through an alias; needs distinct page ids."""
    return without(pages, "page_id", judge(pages, rules, links).filter("verdict = 'block'").select("page_id"))
