"""URL filter: rules on host and path, and block decisions that follow redirects.

A rule ``host/path`` fits its host and all subdomains when the url's path starts
with the rule's path; the longest fitting rule decides. Pages without a rule are
judged by redirect equivalence: canonical links and refresh redirects found in
the pages are edges between normalised urls, connected components of these edges
(and urls that normalise alike) are aliases of one resource, and a block of any
member, crawled or only linked to, blocks the members without a rule. Explicit
allow takes precedence: a page with an allow rule stays allowed, and a component
that holds an explicit allow passes no block on.

Normalising drops the scheme, a leading ``www.`` or ``m.``, the fragment, query
parameters that only track (``utm_*``, ``ref``), and a final ``/``, ``.html`` or
``/index.html`` of the path. Links are resolved against the page's url: absolute
ones, ``//host``, ``/path``, ``?query`` and relative paths with their ``.`` and ``..``;
``&amp;`` counts as ``&``. Links of other schemes without ``//`` are none.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and no aliases, and is allowed. A url that a third of all pages share is one
node. Repeated rows, and rows that repeat a page_id, each get the verdict of their
url; null html has no links. Urls and pages of any length are read whole. Ties of
rules cannot be: of two that fit, one is longer or they are equal. Extra columns are
ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRACKING = r"&?\b(utm_[a-z]+|ref)=[^&]*"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]], want: int) -> Column:
    """The longest fitting rule (``want`` 0) or its verdict (1), as one CASE; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[want])).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The normalised url, null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html|\.html|/)$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def links_of(html: Column, url: Column) -> Column:
    """Urls of canonical links and refresh redirects."""
    canonical = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)),
        lambda tag: tag.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""),
    )
    refresh = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)),
        lambda tag: tag.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""),
    )
    href = F.transform(canonical, lambda tag: F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    target = F.transform(refresh, lambda tag: F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.filter(
        F.transform(F.concat(href, target), lambda x: resolved(F.replace(x, F.lit("&amp;"), F.lit("&")), url)), lambda x: x.isNotNull()
    )


def resolved(link: Column, url: Column) -> Column:
    """The absolute url of a link in the page at ``url``; null where it names no page."""
    root = F.concat(F.lit("http://"), host_of(url))
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    steps = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/")
    left = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1)))
        .when(x == ".", done)
        .otherwise(F.concat(done, F.array(x))),
    )
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(root, F.array_join(left, "/"), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)))
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with ``via``: rule, alias or default."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    seen = store.shelve(
        pages.select(
            "page_id",
            host.alias("host"),
            path.alias("path"),
            rule_for(host, path, rules, 0).alias("rule"),
            rule_for(host, path, rules, 1).alias("ruled"),
            node_of(url).alias("node"),
            F.coalesce(links_of(F.col("html"), url), F.array().cast("array<string>")).alias("links"),
        ),
        "pages",
    )
    links = seen.where("node is not null and size(links) > 0").select("node", F.explode("links").alias("to"))
    to = F.col("to")
    ends = links.select("node", node_of(to).alias("other"), rule_for(host_of(to), path_of(to), rules, 1).alias("ruled"))
    ends = store.shelve(ends.where("other is not null").distinct(), "links")
    named = store.components(ends.select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = (
        seen.select("node", "ruled")
        .unionByName(ends.select(F.col("other").alias("node"), "ruled"))
        .where("node is not null and ruled is not null")
        .distinct()
    )
    grouped = facts.join(named.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    bad = store.shelve(
        grouped.agg(F.max(F.col("ruled") == "block").alias("b"), F.max(F.col("ruled") == "allow").alias("a"))
        .where("b and not a")
        .select("component"),
        "blocked",
    )
    blocked = store.shelve(
        bad.select(F.col("component").alias("node"))
        .unionByName(named.join(bad.hint("merge"), "component", "left_semi").select("node"))
        .distinct()
        .withColumn("blocked", F.lit(True)),
        "aliases",
    )
    store.discard(ends, bad, named)
    met = seen.where("node is not null").join(blocked.hint("merge"), "node", "left").unionByName(
        seen.where("node is null").withColumn("blocked", F.lit(None).cast("boolean"))
    )
    return met.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("default").alias("via"),
    )


#: The same decisions in DuckDB SQL, by a recursive walk over the links.
ORACLE = r"""
WITH RECURSIVE urls AS (
  SELECT DISTINCT url FROM pages WHERE url LIKE '%://%'
), raw_links AS (
  SELECT DISTINCT p.url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(p.html, '(?i)<link\b[^>]*>'),
        lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
      lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(p.html, '(?i)<meta\b[^>]*>'),
        lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
      lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS l
  FROM pages p WHERE p.url LIKE '%://%' AND p.html IS NOT NULL
), links AS (
  SELECT url, CASE WHEN contains(l, '://') THEN l
    WHEN l LIKE '//%' THEN 'http:' || l
    WHEN l LIKE '/%' THEN root || l
    WHEN l LIKE '?%' THEN root || path || l
    WHEN l = '' OR l LIKE '#%' OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE root || array_to_string(list_reduce(list_transform(string_split(folder || regexp_extract(l, '^([^?#]*)', 1), '/'), lambda x: [x]),
      lambda a, b: CASE b[1] WHEN '..' THEN a[1:greatest(1, len(a) - 1)] WHEN '.' THEN a ELSE list_concat(a, b) END), '/')
      || regexp_extract(l, '^[^?#]*(.*)$', 1) END AS target
  FROM (SELECT url, replace(l, '&amp;', '&') AS l, 'http://' || regexp_extract(url, '://([^/?#]*)', 1) AS root,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END AS folder
    FROM raw_links)
), all_urls AS (
  SELECT url FROM urls UNION SELECT target FROM links WHERE target IS NOT NULL
), cut AS (
  SELECT url, substr(url, instr(url, '://') + 3) AS r FROM all_urls
), parsed AS (
  SELECT url, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&?\b(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS q
  FROM cut
), rules(rule, rhost, rpath, rv) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), ruled AS (
  SELECT p.url, max_by(rule, length(rule)) AS rule, max_by(rv, length(rule)) AS rv
  FROM parsed p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.url
), nodes AS (
  SELECT p.url, p.host, p.path, r.rule, r.rv, CASE WHEN regexp_replace(p.host, '^(www|m)\.', '') <> '' THEN
    regexp_replace(p.host, '^(www|m)\.', '') || regexp_replace(p.path, '(/index\.html|\.html|/)$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS node
  FROM parsed p LEFT JOIN ruled r USING (url)
), edges AS (
  SELECT DISTINCT a.node AS x, b.node AS y FROM links l JOIN nodes a ON a.url = l.url JOIN nodes b ON b.url = l.target
  WHERE a.node IS NOT NULL AND b.node IS NOT NULL
), both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges
), reach(x, y) AS (
  SELECT DISTINCT node, node FROM nodes WHERE node IS NOT NULL
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
), bad AS (
  SELECT r.x AS node FROM reach r JOIN nodes n ON n.node = r.y
  GROUP BY r.x HAVING bool_or(n.rv = 'block') AND NOT coalesce(bool_or(n.rv = 'allow'), false)
)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.rv, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN n.rv IS NOT NULL THEN 'rule' WHEN b.node IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN bad b ON b.node = n.node
"""
