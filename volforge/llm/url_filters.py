"""URL filters with redirect equivalence.

A rule is (host, path, verdict); it fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's, and the longest fitting rule decides. Urls that no rule fits get
their verdict by the method: pages that redirect to each other or name each other as canonical are
aliases, aliases are the connected components of those links over the whole table, and a block by
rule anywhere in a component holds for every alias that has no rule of its own. An explicit allow
takes precedence: a url that an allow rule fits stays allowed whatever its aliases are. Everything
else is allowed.

Links are read from each page's html: every ``<link rel="canonical" href>`` (among other rel words,
too) and ``<meta http-equiv="refresh" content="...url=">``; further (url, url) edges, such as a
crawler's redirect log, can be passed in. Relative targets are resolved against the page's host and
directory (``<base>`` is not read). A url's node
is its (host, path, query): pages that differ in their query are different pages, though rules see host
and path only; fragments make no new node.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, has no
links, and is allowed; null html has no links, and html of any length is searched whole; repeated pages are each judged; an empty table gives
an empty result; other columns and their names do not matter; the rule list is a policy file held by the driver and compiled into one
expression (a few thousand rules at most)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table
from .graph import components

# (host, path, verdict): the policy of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_CANONICAL = (r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'"""
              r"""|canonical(?=[\s>/]|$)))[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""")
_REFRESH = (r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""")


def host_of(url):
    rest = F.substring_index(F.split(url, "://", 2)[1], "/", 1)
    for stop in "?#":
        rest = F.substring_index(rest, stop, 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(rest)), F.lit(""))


def path_of(url):
    rest = F.split(url, "://", 2)[1]
    for stop in "?#":
        rest = F.substring_index(rest, stop, 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (at > 0), F.substring(rest, at, F.length(rest))), F.lit(""))


def query_of(url):
    """From the ``?`` up to a fragment; empty without one."""
    rest = F.split(url, "://", 2)[1]
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)), F.lit(""))


def rule_text(rule) -> str:
    return rule[0] + rule[1]


def longest_rule(host, path, rules: Sequence[tuple[str, str, str]]):
    """struct(rule, verdict) of the longest rule that fits, or null: one CASE, longest first."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(rule_text(r)), r)):
        h, p, verdict = rule
        fits = ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        hit = F.struct(F.lit(rule_text(rule)).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _without_dots(path):
    """A path with its ``.`` and ``..`` segments applied."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: (
        F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(x == ".", done).otherwise(F.concat(done, F.array(x)))))
    return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _absolute(host, path, target):
    """A link target as an absolute url, resolved against the page's host and directory; null when it
    is a fragment, a scheme without authority, or empty."""
    site = F.when(host != "", F.concat(F.lit("http://"), host))
    base = F.when(path == "", F.lit("/")).otherwise(path)
    own, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"[?#](?s:.*)$", 0)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | F.startswith(target, F.lit("#")) | (target == ""), F.lit(None))
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(site, _without_dots(own), rest))
            .when(F.startswith(target, F.lit("?")), F.concat(site, base, target))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest)))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) edges named by the pages themselves."""
    page = pages.select(F.col(url_col).alias("from_url"), F.col(html_col).alias("html"))
    page = page.where(F.col("html").isNotNull()).where(
        F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh")))
    found = page.select(
        "from_url", F.explode(F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (_CANONICAL, _REFRESH)))).alias("target"))
    target = F.replace(F.col("target"), F.lit("&amp;"), F.lit("&"))
    return (found.where(F.col("target") != "")
            .select("from_url", _absolute(host_of(F.col("from_url")), path_of(F.col("from_url")), target).alias("to_url"))
            .where(F.col("to_url").isNotNull()))


def inherited_blocks(links: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(node_host, node_path, node_query) of every node in a component that a rule blocks somewhere."""
    ends = links.select(*(of(F.col(url)).alias(side + name) for side, url in (("a", "from_url"), ("b", "to_url"))
                          for name, of in (("h", host_of), ("p", path_of), ("q", query_of))))
    same = (F.col("ah") == F.col("bh")) & (F.col("ap") == F.col("bp")) & (F.col("aq") == F.col("bq"))
    nodes = cut(ends.where((F.col("ah") != "") & (F.col("bh") != "") & ~same).distinct())
    parts = ("node_host", "node_path", "node_query")
    a, b = (nodes.select(*(F.col(side + c).alias(n) for c, n in zip("hpq", parts))) for side in "ab")
    # a node as one string; a host holds no / and no ?, a path begins with / and a query with ?
    key = lambda h, p, q: F.concat(F.col(h), F.col(p), F.col(q))
    comp = components(nodes.select(key("ah", "ap", "aq").alias("a"), key("bh", "bp", "bq").alias("b")))
    named = a.union(b).distinct().withColumn("node", key(*parts)).join(comp, "node")
    ruled = named.withColumn("own", longest_rule(F.col("node_host"), F.col("node_path"), rules))
    blocked = ruled.groupBy("root").agg(F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("any_block"))
    return named.join(blocked.where("any_block"), "root", "left_semi").select(*parts)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, inherited) for every page. ``redirects`` adds edges
    (from_url, to_url) to those found in the html. The pages themselves are never shuffled by a
    component key: the list of inherited blocks joins on (host, path, query). ``id_col`` may have any name
    but those of the other results, which is an error."""
    if id_col.lower() in ("host", "path", "rule", "verdict", "inherited"):
        raise ValueError(f"rename the id column {id_col}: the result has a column of that name")
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    inherited = inherited_blocks(links, rules).distinct().withColumn("inherited", F.lit(True))
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                          query_of(F.col(url_col)).alias("query"))
    judged = judged.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    joined = judged.join(inherited, (judged.host == inherited.node_host) & (judged.path == inherited.node_path)
                         & (judged.query == inherited.node_query), "left")
    by_alias = F.coalesce(F.col("inherited"), F.lit(False)) & F.col("own").isNull()
    return joined.select(
        id_col, "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(by_alias, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        by_alias.alias("inherited"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages")).drop("inherited")


_SQL_HOST = ("CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), "
             "'^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END")
_SQL_PATH = ("CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(regexp_replace(substr({u}, strpos({u}, '://') + 3), "
             "'^[^/?#]*', ''), '^[^?#]*') ELSE '' END")
_SQL_QUERY = ("CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^?#]*(\\?[^#]*)', 1) ELSE '' END")


def _sql_node(u: str) -> str:
    return ", ".join(f"coalesce({sql.format(u=u)}, '') AS {name}" for sql, name in ((_SQL_HOST, "host"), (_SQL_PATH, "path"), (_SQL_QUERY, "query")))


def _sql_undotted(p: str) -> str:
    """A path with its ``.`` and ``..`` segments applied."""
    steps = (f"list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), lambda done, x: CASE WHEN x[1] = '..' "
             "THEN done[1:greatest(len(done) - 1, 1)] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END)")
    return f"array_to_string({steps}, '/') || CASE WHEN regexp_matches({p}, '(^|/)[.][.]?$') THEN '/' ELSE '' END"


ORACLE = {
    "op4_url_filters": f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
       ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '<(?:[lL][iI][nN][kK]|[mM][eE][tT][aA])\\b[^>]*')) AS tag FROM pages),
targets AS (
  SELECT url, replace(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), '&amp;', '&') AS t FROM tags
  WHERE regexp_matches(tag, '(?is)^<link\\b') AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*("([^">]*\\s)?canonical(\\s[^">]*)?"|''([^''>]*\\s)?canonical(\\s[^''>]*)?''|canonical([\\s/]|$))')
  UNION ALL
  SELECT url, replace(regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1), '&amp;', '&') FROM tags
  WHERE regexp_matches(tag, '(?is)^<meta\\b') AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
parted AS (
  SELECT url AS from_url, t, 'http://' || host AS site, CASE WHEN path = '' THEN '/' ELSE path END AS base,
    regexp_extract(t, '^[^?#]*') AS own, regexp_extract(t, '(?s)[?#].*$') AS rest
  FROM targets, LATERAL (SELECT {_sql_node('url')}) n WHERE t <> ''),
links AS (
  SELECT from_url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
     WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL WHEN starts_with(t, '//') THEN 'http:' || t
     WHEN site = 'http://' THEN NULL WHEN starts_with(t, '/') THEN site || {_sql_undotted('own')} || rest
     WHEN starts_with(t, '?') THEN site || base || t
     ELSE site || {_sql_undotted("(regexp_replace(base, '[^/]*$', '') || own)")} || rest END AS to_url FROM parted),
nodes AS (
  SELECT DISTINCT {_sql_node('url')} FROM pages UNION SELECT DISTINCT {_sql_node('to_url')} FROM links WHERE to_url IS NOT NULL),
ruled AS (
  SELECT n.*, (SELECT h || p FROM rules WHERE (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p)
     ORDER BY length(h || p) DESC LIMIT 1) AS rule FROM nodes n),
judged AS (SELECT ruled.*, rules.v FROM ruled LEFT JOIN rules ON ruled.rule = rules.h || rules.p),
edges AS (
  SELECT a.host AS ah, a.path AS ap, a.query AS aq, b.host AS bh, b.path AS bp, b.query AS bq FROM
     (SELECT from_url, to_url, row_number() OVER () AS k FROM links WHERE to_url IS NOT NULL) l,
     LATERAL (SELECT {_sql_node('l.from_url')}) a, LATERAL (SELECT {_sql_node('l.to_url')}) b WHERE a.host <> '' AND b.host <> ''),
both_ways AS (SELECT ah, ap, aq, bh, bp, bq FROM edges UNION SELECT bh, bp, bq, ah, ap, aq FROM edges),
reached(host, path, query) AS (
  SELECT host, path, query FROM judged WHERE v = 'block'
  UNION SELECT e.bh, e.bp, e.bq FROM reached r JOIN both_ways e ON e.ah = r.host AND e.ap = r.path AND e.aq = r.query)
SELECT p.page_id, n.host, n.path, j.rule, coalesce(j.v, CASE WHEN EXISTS (SELECT 1 FROM reached r
  WHERE r.host = n.host AND r.path = n.path AND r.query = n.query) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p, LATERAL (SELECT {_sql_node('p.url')}) n JOIN judged j ON j.host = n.host AND j.path = n.path AND j.query = n.query
""",
}
