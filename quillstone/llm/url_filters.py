"""URL verdicts with redirect equivalence. DataFrame functions only.

Rules (host, path prefix) block or allow; the longest rule that fits a url wins. Urls that lead to the same
page are aliases: undirected edges join a url with what it redirects to or names as canonical and, where that is asked for, with the form
that it shares with trivially equal urls (no fragment, tracking parameters, trailing slash and the like). In each connected component a
block decision on one member holds for all aliases without a rule of their own, unless a member is
explicitly allowed: allow takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread_join, stored
from quillstone.llm.components import components

#: (action, host, path): the fixed rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def alias_form(url: Column) -> Column:
    """host, path and query under which trivially equal urls meet: no scheme, standard port, tracking parameters, fragment, index page or trailing slash."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _node(url: Column) -> Column:
    return F.concat(F.lit("u"), url)


def url_nodes(urls: DataFrame) -> DataFrame:
    """(node, form): each url as a node, and the node of what trivially equal urls share; the two are an edge.

    The first character tells the two kinds of nodes apart.
    """
    return urls.select(_node(F.col("url")).alias("node"), F.concat(F.lit("="), alias_form(F.col("url"))).alias("form")).distinct()


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in quotes or without, blanks around it cut; empty where there is none."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))
    return F.regexp_replace(value, r"(?i)&(?:amp|#38|#x26);", "&")


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*+>"), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. parts worked off; one that ends in them ends in a slash."""
    parts = F.slice(F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/"), 2, 1_000_000_000)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolved(to: Column, base: Column) -> Column:
    """The url that a link names on the page base; null for other schemes (``mailto:`` and the like)."""
    scheme, root = F.regexp_extract(base, r"^((?s:.*?):)//", 1), F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(path_of(base), r"[^/]*$", ""), "^$", "/")
    path, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*((?s:.*))$", 1)
    return (
        F.when(to == "", base)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(to.startswith("?"), F.concat(page, to))
        .when(to.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), to))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst), urls: canonical links and meta refreshes in the html, absolute or relative to the page or its base tag."""
    canonical = F.transform(F.filter(_tags(F.col("html"), "link"), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)")), lambda t: _attribute(t, "href"))
    meta = F.transform(F.filter(_tags(F.col("html"), "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: _attribute(t, "content"))
    refresh = F.transform(meta, lambda c: F.trim(F.regexp_extract(c, r"""(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']+)""", 1)))
    own = _attribute(F.coalesce(F.get(_tags(F.col("html"), "base"), F.lit(0)), F.lit("")), "href")
    # html without the two words is not searched any further
    worth = F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").contains("://")
    found = pages.where(worth).select("url", own.alias("own"), F.explode(F.concat(canonical, refresh)).alias("to")).where("to != ''")
    return found.select(F.col("url").alias("src"), resolved(F.col("to"), F.coalesce(resolved(F.col("own"), F.col("url")), "url")).alias("dst")).where("dst is not null")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits host or a parent domain and begins the path; null without one.

    Of rules of equal length allow goes before block, then the first in order of names.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in reversed(ordered):
        out = F.when(fits(h.lower(), p), F.struct(F.lit(h.lower() + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, trivial: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for every row of pages (page_id, url, html).

    redirects: further edges (src, dst) of urls. trivial: urls that differ in what alias_form leaves out are aliases too; such urls may be
    different pages, so that this is off unless asked for. A url with a rule gets the rule's verdict (``rule``); else,
    where an alias is allowed by a rule, allow; else, where an alias is blocked, block (both ``alias``);
    else allow (``default``). What links and redirects name counts as an alias whether or not it is a row of pages. Null urls and urls without ``://`` have an empty host and path, and no
    aliases. Repeated rows stay repeated. An empty table gives no rows.
    """
    url = F.col("url")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.where("src is not null and dst is not null").select("src", "dst"))
    links = stored(links, "links")
    edges = links.where("src != dst").select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst"))
    if trivial:
        # every url once: pages, and the ends of links, most of which are no pages
        ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
        urls = stored(url_nodes(pages.select("url").unionAll(ends).where(url.contains("://"))), "urls")
        edges = edges.unionAll(urls.select(F.col("node").alias("src"), F.col("form").alias("dst")))
    named = stored(components(edges), "components")
    member = F.substring("node", 2, 2**31 - 1)
    rule = matching_rule(host_of(member), path_of(member), rules)
    told = named.where(F.col("node").startswith("u")).select("component", rule["action"].alias("action")).where("action is not null")
    decided = told.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    alias = stored(named.join(decided.hint("merge"), "component").select("node", "allowed"), "alias")
    seen = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    seen = stored(seen.select("page_id", _node(F.col("url")).alias("node"), "host", "path", "m.rule", "m.action"), "seen")
    out = spread_join(seen, alias, "node", "left")
    verdict = F.when(F.col("allowed").isNull(), None).when(F.col("allowed"), "allow").otherwise("block")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("action", verdict, F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(verdict.isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
