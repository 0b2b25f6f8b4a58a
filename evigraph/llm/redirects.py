"""URL filters by redirect equivalence, in DataFrame operations only.

Nodes are urls (host, path and query; scheme and fragment do not matter).  Redirects (`<meta http-equiv=refresh>`) and
canonical links are edges.  A url that a rule blocks blocks every alias in its connected component that has no rule of its
own; a url that a rule allows stays allowed and blocks nobody.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([?][^#]*)?"
CANONICAL = r"""(?is)<link[^>]*\brel *= *(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
REFRESH = r"""(?is)<meta[^>]*http-equiv *= *["']?refresh[^>]*>"""
HREF = r"""(?is)href *= *["']?([^"'> ]+)"""
TARGET = r"""(?is)url *= *["']?([^"'> ]+)"""

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def resolved(path: Column) -> Column:
    """A path without its "." and ".." segments."""
    whole = F.regexp_replace(path, r"(/\.\.?)$", "$1/")
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    parts = F.split(whole, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(kept, "/")).otherwise(path)


def node_of(url: Column) -> Column:
    path = resolved(F.regexp_extract(url, URL, 2))
    return F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, URL, 3))


def ruled(df: DataFrame, rules: Sequence[Rule], inline: int = 256) -> DataFrame:
    """Adds rule and action (null without one): of the rules that fit `host` and `path`, the longest, then the first.

    Up to `inline` rules become one expression; more are a table met by an equi-join on the host's suffixes.
    """
    order = sorted(enumerate(rules), key=lambda r: (-len(r[1][1] + r[1][2]), r[0]))
    if len(rules) <= inline:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for _, (act, host, path) in reversed(order):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
        return df.withColumns({"rule": rule, "action": action})
    table = df.sparkSession.createDataFrame([(host, path, act, n) for n, (_, (act, host, path)) in enumerate(order)], "suffix string, start string, action string, n int")
    hosts = df.select("host", "path").distinct()  # judged once, however many rows share them
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = hosts.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").filter(F.startswith("path", F.col("start")))
    best = fit.groupBy("host", "path").agg(F.min(F.struct("n", F.concat("suffix", "start").alias("rule"), "action")).alias("r"))
    return df.join(best.select("host", "path", "r.rule", "r.action"), ["host", "path"], "left")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): every canonical link and refresh target of each page, made absolute; a fragment alone is the page itself."""
    each = lambda tag, part: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, part, 1))
    some = pages.filter(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.concat(each(CANONICAL, HREF), each(REFRESH, TARGET))).alias("t")).filter("t <> '' and not startswith(t, '#')")
    home = F.concat(F.lit("http://"), host_of(F.col("url")))
    folder = F.regexp_replace(path_of(F.col("url")), "[^/]*$", "")
    target = F.when(F.contains("t", F.lit("://")), F.col("t")).when(F.startswith("t", F.lit("//")), F.concat(F.lit("http:"), "t")).when(F.startswith("t", F.lit("/")), F.concat(home, "t")).when(F.startswith("t", F.lit("?")), F.concat(home, path_of(F.col("url")), "t")).otherwise(F.concat(home, F.when(folder == "", F.lit("/")).otherwise(folder), "t"))
    return some.select("url", target.alias("target"))


def judge(pages: DataFrame, links: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url, html).

    `links` (url, target) replaces the links found in the html.  Null urls and urls without "://": empty host and path,
    no node, verdict allow.  Rows that share a url share its verdict; an empty table gives an empty result.
    """
    page = ruled(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    links = page_links(pages) if links is None else links.select("url", "target")
    pairs = cut(links.select(F.array("url", "target").alias("ends"), F.xxhash64(node_of(F.col("url"))).alias("a"), F.xxhash64(node_of(F.col("target"))).alias("b")).filter("a <> b and instr(ends[0], '://') > 0 and instr(ends[1], '://') > 0").distinct())
    group = components(pairs.select("a", "b"))
    ends = pairs.select(F.explode(F.arrays_zip(F.array("a", "b").alias("node"), F.col("ends").alias("url"))).alias("x")).select(F.col("x.node").alias("node"), host_of(F.col("x.url")).alias("host"), resolved(path_of(F.col("x.url"))).alias("path")).distinct()
    blocked = ruled(ends, rules).filter("action = 'block'").select("node").distinct()
    bad = group.join(blocked, "node").select("component").distinct()
    aliases = group.join(bad, "component").select(F.col("node").alias("alias")).distinct()
    # only pages that the component decides meet it; the others would share one empty key
    open_ = (F.col("host") != "") & F.col("rule").isNull()
    decided = page.filter(~open_).select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    asked = page.filter(open_).withColumn("node", F.xxhash64(node_of(F.col("url"))))
    found = asked.join(aliases, asked["node"] == aliases["alias"], "left")
    return decided.unionByName(found.select("page_id", "host", "path", "rule", F.when(F.col("alias").isNotNull(), "block").otherwise("allow").alias("verdict")))


def op3_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of every row of `pages`; null urls, repeats and empty tables as stated there."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql_rules(rules: Sequence[Rule] = RULES) -> str:
    return ", ".join(f"('{a}', '{h}', '{p}', {n})" for n, (a, h, p) in enumerate(rules))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _each(tag: str, part: str) -> str:
    return f"list_transform(regexp_extract_all(html, {_q(tag)}), lambda x: regexp_extract(x, {_q(part)}, 1))"


def _resolved(path: str) -> str:
    """SQL of resolved()."""
    segments = f"list_transform(string_split(regexp_replace({path}, '(/\\.\\.?)$', '\\1/'), '/'), lambda s: [s])"
    step = "CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END"
    return f"CASE WHEN contains({path}, '/.') THEN array_to_string(list_reduce({segments}, lambda a, s: {step}), '/') ELSE {path} END"


OP3_SQL = f"""
WITH RECURSIVE rules(action, rhost, rpath, n) AS (VALUES {_sql_rules()}),
p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, {_q(URL)}, 1), '{UPPER}', '{LOW}'), '') AS host,
      coalesce(regexp_extract(url, {_q(URL)}, 2), '') AS path FROM pages),
found AS (SELECT host, path, url, unnest(list_concat({_each(CANONICAL, HREF)}, {_each(REFRESH, TARGET)})) AS t FROM p WHERE html IS NOT NULL),
links AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t WHEN starts_with(t, '?') THEN 'http://' || host || path || t
      ELSE 'http://' || host || (CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END) || t END AS target FROM found WHERE t <> '' AND NOT starts_with(t, '#')),
urls AS (SELECT url FROM p UNION SELECT target FROM links),
u AS (SELECT url, coalesce(translate(regexp_extract(url, {_q(URL)}, 1), '{UPPER}', '{LOW}'), '') AS host, coalesce(regexp_extract(url, {_q(URL)}, 2), '') AS path, regexp_extract(url, {_q(URL)}, 3) AS query FROM urls WHERE url IS NOT NULL),
v AS (SELECT url, host, query, {_resolved('path')} AS path FROM u),
r AS (SELECT v.*, host || (CASE WHEN path = '' THEN '/' ELSE path END) || query AS node,
      (SELECT rhost || rpath || ' ' || action FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, n LIMIT 1) AS hit FROM v),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM links JOIN r a ON a.url = links.url JOIN r b ON b.url = links.target WHERE a.host <> '' AND b.host <> '' AND a.node <> b.node),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
bad(node) AS (SELECT node FROM r WHERE hit LIKE '% block' AND node IN (SELECT a FROM both_ways) UNION SELECT b FROM bad JOIN both_ways ON a = node),
own AS (SELECT url, (SELECT rhost || rpath || ' ' || action FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, n LIMIT 1) AS hit FROM u)
SELECT p.page_id, p.host, p.path, split_part(own.hit, ' ', 1) AS rule,
       coalesce(split_part(own.hit, ' ', 2), CASE WHEN p.host <> '' AND r.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r ON r.url = p.url LEFT JOIN own ON own.url = p.url
"""
