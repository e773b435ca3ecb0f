"""URL filters: host and path rules, and block decisions that reach redirect aliases.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides. Urls without a fitting rule are judged by their equivalence class: edges join urls
that name one document, connected components are found on the cluster, and a class with a blocked member
blocks the rest unless another member is explicitly allowed. Edges are given redirects, refreshes and
canonical links that pages declare, and urls without their tracking parameters. Pages of equal html can be
taken as mirrors of one document (``mirrors``); that is off unless asked for, as parked and error pages are alike
on hosts that have nothing to do with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, ascii_lower, connected_components, materialize

#: Rules are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_RULES = 50_000
#: Query parameters that only name where a visit came from; the url without them is its canonical form.
TRACKING = r"utm_\w+|gclid|fbclid"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a url in the edge set: host, path and query, without scheme and fragment; null if it has no ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def canonical_of(url: Column) -> Column:
    """The url's node without tracking parameters."""
    bare = F.regexp_replace(node_of(url), rf"(?<=[?&])(?:{TRACKING})=[^&]*&?", "")
    return F.rtrim(bare, F.lit("?&"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (action, host, path) tuples."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def fit_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for each distinct (host, path) that a rule fits.

    Each host is looked up by its suffixes in one equi-join. Longest: host and path together, then host,
    then the rule's own text.
    """
    given = rules.select(ascii_lower(F.col("host")).alias("suffix"), F.col("path").alias("rule_path"), "action").where("suffix is not null and rule_path is not null").distinct()
    given = F.broadcast(given) if rules.count() <= BROADCAST_RULES else given
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = places.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = tried.join(given, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("suffix", "rule_path")
    # Of one rule both blocked and allowed, allow is taken: it sorts first.
    best = F.max(F.struct(F.char_length(text).alias("n"), F.char_length("suffix").alias("m"), text.alias("rule"), (F.col("action") == "allow").alias("allow")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("action"))


def resolve(base: Column, href: Column) -> Column:
    """The absolute url of a link in a page: ``&amp;`` read as ``&``, dot segments taken out, relative to the page's path."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    query = F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    place, rest = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    at = F.when(href.startswith("/"), place).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), place))
    parts = F.split(at, "/", -1)
    ends = F.element_at(parts, -1).isin(".", "..")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    clean = F.concat(clean, F.when(ends, "/").otherwise(""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(place != "", F.concat(root, clean, rest))
        .when(rest.startswith("?"), F.concat(root, path_of(base), rest))
        .otherwise(F.concat(root, path_of(base), query))
    )


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) that pages declare: canonical links, and refreshes to another url.

    Targets are resolved against the page's url; a ``base`` tag is not read.
    """
    pieces = F.split(F.col(html_col), ">")

    def first(tag: str, marks: str, target: str) -> Column:
        """The target in the first tag that has both: what follows the tag's name up to the next ``>``. Each piece is read once for each pattern."""
        rests = F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?is)<{tag}\b(.*)", 1))
        fits = F.filter(rests, lambda r: r.rlike(marks) & r.rlike(target))
        return F.coalesce(F.regexp_extract(F.get(fits, F.lit(0)), target, 1), F.lit(""))

    link = first("link", r"(?i)\brel\s*+=\s*+[\"']?canonical\b", r"(?i)\bhref\s*+=\s*+[\"']?([^\"'\s>]+)")
    refresh = first("meta", r"(?i)\bhttp-equiv\s*+=\s*+[\"']?refresh\b", r"(?i)\bcontent\s*+=\s*+[\"']?\s*+\d++\s*+;\s*+url\s*+=\s*+[\"']?([^\"'>]+)")
    maybe = F.lower(html_col)
    found = pages.where(F.col(url_col).contains("://") & (maybe.contains("canonical") | maybe.contains("refresh")))
    found = found.select(F.col(url_col).alias("from_url"), F.explode(F.array(link, refresh)).alias("href")).where("href <> ''")
    # Other schemes (mailto, javascript, data) name no page.
    found = found.where(~F.trim("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+:(?!//)"))
    return found.select("from_url", resolve(F.col("from_url"), F.col("href")).alias("to_url"))


def mirror_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) nodes: each url of a html that several urls have, and the first of these urls. Empty and null html has none.

    Digests and nodes alone are shuffled. The first is found with partial minima and written, so that the join back
    is of two plain shuffles, in which the adaptive skew join splits a html that many pages share.
    """
    rows = pages.where(F.octet_length(html_col) > 0).select(node_of(F.col(url_col)).alias("a"), F.sha2(html_col, 256).alias("digest")).where("a is not null")
    rows = materialize(rows, "url-digests")
    first = materialize(rows.groupBy("digest").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b < last").select("digest", "b"), "first-urls")
    return rows.join(first, "digest").where("a <> b").select("a", "b")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", mirrors: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    redirects: further (from_url, to_url) rows; mirrors: whether equal html makes urls aliases. A url's own rule decides; without one, a class that
    holds a blocked url (of a page or only of an edge's end) and no allowed one is blocked; all else is
    allowed. Null urls and urls without ``://`` have empty host and path, no rule and verdict allow.
    Repeated rows repeat; other columns, whatever their names, are not read.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    slim = materialize(slim.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"), canonical_of(F.col("url")).alias("canonical")), "urls")
    edges = slim.select(F.col("node").alias("a"), F.col("canonical").alias("b"))
    declared = [html_edges(pages, url_col, html_col)] if html_col else []
    for e in [*declared, *([redirects] if redirects is not None else [])]:
        edges = edges.unionAll(e.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    if html_col and mirrors:
        edges = edges.unionAll(mirror_edges(pages, url_col, html_col))
    edges = materialize(edges.where("a <> b").distinct(), "url-edges")
    classes = connected_components(edges)

    # Every node of an edge is judged by the rules; its host and path are read back from its name.
    members = classes.withColumns({"host": F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), "path": F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)})
    fits = materialize(fit_rules(slim.select("host", "path").unionAll(members.select("host", "path")), rules), "rule-fits")
    judged = members.join(fits, ["host", "path"], "left")
    judged = materialize(judged.select("node", "component", "action"), "url-classes")
    blocked = judged.groupBy("component").agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("block"), F.max(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allow"))
    blocked = materialize(blocked.where("block and not allow").select("component"), "blocked-classes")
    # Few classes are sent to all tasks; many are joined by class, where the adaptive skew join splits a large one.
    blocked = F.broadcast(blocked) if blocked.count() <= BROADCAST_KEYS else blocked
    taken = judged.join(blocked, "component", "left_semi").select("node").distinct().withColumn("alias_blocked", F.lit(True))
    out = slim.join(fits, ["host", "path"], "left").join(taken, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
