"""URL block and allow rules, with block decisions carried to redirect and canonical aliases.

DataFrame functions only.  A url is judged by the longest rule that fits it;
a url that no rule fits is blocked if a chain of redirects and canonical
links, in either direction, connects it to a url that a rule blocks.  An
explicit allow takes precedence over whatever its aliases are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.llm.components import components
from nearloom.llm.runtime import cut

#: Rules are literals of the plan; more than this many would not belong there.
MAX_RULES = 10_000
#: Keys that the pages of one url are dealt to.
SALTS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Links and refreshes are read attribute by attribute: tags (quotes count only after an equals sign, and a quoted value may hold any other
# character), what sets an attribute in one, and the url of a refresh.  The parts are bounded for the sake of the matcher's stack.
TAG = r"""(?is)<(?:link|meta)\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+){0,1000}+>"""
ATTRIBUTE = r"""(?is)([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
REFRESH_URL = r"""(?is)^.*?url\s*=\s*(.*)$"""


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The name under which a url is linked: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest rule that fits, null where none does.

    Length is that of host and path together; of equally long ones the longer
    host, then the rule listed first, wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = F.lit(None).cast("string")
    action = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    if ordered:
        first, *rest = ordered
        name, action = F.when(fits(host, path, first), first.host + first.path), F.when(fits(host, path, first), first.action)
        for r in rest:
            name, action = name.when(fits(host, path, r), r.host + r.path), action.when(fits(host, path, r), r.action)
    return name, action


def _target(host: Column, path: Column, href: Column) -> Column:
    """``href`` resolved against a url: absolute, protocol-relative, root-relative or relative to its folder."""
    base = F.concat(F.lit("http://"), host)
    folder = F.concat(F.regexp_extract(path, r"^(.*/)", 1), F.when(path.contains("/"), "").otherwise("/"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:|$)"), None)
        .when(href.startswith("/"), F.concat(base, href))
        .when(href.startswith("?"), F.concat(base, path, href))
        .otherwise(F.concat(base, folder, href))
    )


def _unquoted(value: Column) -> Column:
    """``value`` without the quotes around it: if it starts with one, up to the next of its kind."""
    quoted = lambda q: F.regexp_extract(value, f"(?s)^{q}([^{q}]*)", 1)
    return F.when(value.startswith('"'), quoted('"')).when(value.startswith("'"), quoted("'")).otherwise(value)


def named_urls(html: Column) -> Column:
    """All urls that the canonical links and refreshes of ``html`` name, their attributes quoted or not, in any order."""

    def attribute(tag: Column, name: str) -> Column:
        pairs = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
        own = F.filter(pairs, lambda x: lower_ascii(F.regexp_extract(x, r"^([^\s=]*)", 1)) == name)
        return _unquoted(F.regexp_extract(F.get(own, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1))

    def url(tag: Column) -> Column:
        canonical = lower_ascii(attribute(tag, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)")
        refresh = lower_ascii(F.trim(attribute(tag, "http-equiv"))) == "refresh"
        target = F.trim(F.regexp_extract(attribute(tag, "content"), REFRESH_URL, 1))
        return F.when(lower_ascii(F.substring(tag, 2, 4)) == "link", F.when(canonical, attribute(tag, "href"))).when(refresh, _unquoted(target))

    # Tags without the words are left out before they are taken apart.
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.rlike(r"(?i)canonical|refresh"))
    return F.array_distinct(F.filter(F.transform(tags, url), lambda u: u.isNotNull()))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: the node of each page's url and of each url that its html names as canonical or redirects to."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    linking = pages.where(html.rlike(r"(?i)canonical|refresh")).select(url.alias("url"), F.explode(named_urls(html)).alias("href"))
    # Each step is a column of its own, so that what several later ones use is computed once.
    steps = linking.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("a"), F.trim(F.regexp_replace("href", "&amp;", "&")).alias("href"))
    steps = steps.select("a", _target(F.col("host"), F.col("path"), F.col("href")).alias("target"))
    # Cut here, or the filters below would be pushed under these steps and repeat them all.
    named = cut(steps.select("a", node_of(F.col("target")).alias("b")))
    return named.where((F.length("a") > 0) & (F.length("b") > 0) & (F.col("a") != F.col("b"))).distinct()


def blocked_nodes(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The nodes of ``edges`` whose component holds one that a rule blocks."""
    url = F.concat(F.lit("x://"), F.col("node"))
    groups = cut(components(edges).withColumns({"host": host_of(url), "path": path_of(url)}))
    _, action = ruled(F.col("host"), F.col("path"), rules)
    bad = groups.where(action == "block").select(F.col("component").alias("bad")).distinct()
    return groups.join(bad, F.col("component") == F.col("bad"), "left_semi").select("node")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: ``(page_id, host, path, rule, verdict)``.

    ``edges`` are alias links ``(a, b)`` between nodes (:func:`node_of`);
    by default those that the html of ``pages`` states.  Null urls and urls
    without ``://`` have an empty host and path, fit no rule and are allowed.
    Repeated rows are judged alike; an empty table gives no rows; null html
    links nothing; only the three named columns are read.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node"))
    name, action = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_action": action})
    bad = blocked_nodes(alias_edges(pages, url_col, html_col) if edges is None else edges, rules)
    # Urls without a node would all meet under one key that no alias has: each gets a key of its own.  Those of one node are
    # dealt to SALTS keys, so that a page that a third of all rows name is no single task's.
    row = F.monotonically_increasing_id()
    rows = rows.withColumns({"_salt": F.pmod(row, F.lit(SALTS)).cast("int"), "_key": F.when(F.col("_node") == "", F.concat(F.lit("\0"), row.cast("string"))).otherwise(F.col("_node"))})
    bad = bad.select("node", F.lit("block").alias("_bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    by_alias = rows.join(bad, (F.col("_key") == F.col("node")) & (F.col("_salt") == F.col("_of")), "left")
    return by_alias.select("page_id", "host", "path", "rule", F.coalesce("_action", "_bad", F.lit("allow")).alias("verdict"))
