"""URL filters: rules by host and path, and block decisions carried over redirect aliases.

A rule fits a url if the url's host is the rule's or a subdomain of it and its path starts with
the rule's; the longest fitting rule decides. Urls that no rule fits take the decision of their aliases:
redirect (meta refresh, or a given table) and canonical-link edges join urls to components, and one
blocked member blocks all members but those that a rule explicitly allows. Otherwise a url is allowed.

A node of that graph is a url without its scheme and fragment, host lower-cased, no slash at the end; it is
blocked if a rule blocks any url seen for it, as it was written.
Edges are all ``link`` elements whose rel names canonical and all ``meta`` refreshes of a page outside its comments; character
references of & are decoded and targets resolved against the page's url (a ``base`` element is not looked at).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule with a host and
has no aliases; a null html, and a target of another kind of address (mailto:, javascript:), gives no links; repeated rows each give a row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components, cut

#: (verdict, rule) with a rule written as host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COMMENT, _TAG = r"(?s)<!--.*?(?:-->|$)", r"(?is)<(?:link|meta)\b[^>]*>"
_VALUE = r"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_QUOTES = r"""^["']|["']$"""
_CANONICAL, _REFRESH_URL = r"(?i)(^|\s)canonical(\s|$)", r"""(?i)(?:^|[;,\s])url\s*=\s*["']?([^"'\s>]+)"""
_AMPERSAND = r"(?i)&amp;|&#38;|&#x26;"
_ABSOLUTE, _OTHER = r"^[a-zA-Z][a-zA-Z0-9+.-]*://", r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
_LAST_PART = r"[^/]*$"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The graph's node of a url, null if it has no host."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(tail, r"/$", "")))


def judged(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``df`` with host, path, rule and own: the longest fitting rule and its verdict, or null."""
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, own = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(own)
    return df.withColumn("rule", rule).withColumn("own", own)


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, _VALUE.format(name=name), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(raw, _QUOTES, ""), _AMPERSAND, "&"))


def _plain(path: Column) -> Column:
    """A path without its ``.`` and ``..`` parts."""
    step = lambda done, part: F.when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    return F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.lit(""), step)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The url of a link target on a page of that host and path; null for other kinds of address."""
    at_host = lambda rest: F.concat(F.lit("x://"), host, rest)
    held = F.regexp_extract(target, r"^([^?#]*)", 1)
    tail = F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, _LAST_PART, ""))
    return (
        F.when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), at_host(F.concat(_plain(held), tail)))
        .when(target.rlike(_ABSOLUTE), target)
        .when(target.rlike(_OTHER) | (target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(held == "", at_host(F.concat(path, tail)))
        .otherwise(at_host(F.concat(_plain(F.concat(folder, held)), tail)))
    )


def links(pages: DataFrame) -> DataFrame:
    """(a_url, b_url): pages' urls and what their redirect and canonical links lead to."""
    marked = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (host_of(F.col("url")) != "")).select("url", F.regexp_replace("html", _COMMENT, "").alias("html"))
    tags = marked.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(F.lower(F.left(tag, F.lit(5))) == "<link", F.when(_attribute(tag, "rel").rlike(_CANONICAL), _attribute(tag, "href")))
    refresh = F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(_attribute(tag, "content"), _REFRESH_URL, 1))
    found = tags.select("url", "h", "p", F.coalesce(canonical, refresh).alias("t")).where("t != ''")
    return found.select(F.col("url").alias("a_url"), resolved(F.col("t"), F.col("h"), F.col("p")).alias("b_url")).where("b_url is not null").distinct()


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``redirects`` may add edges (from_url, to_url)."""
    rows = judged(pages.select("page_id", "url"), rules).withColumn("node", node_of(F.col("url")))
    led = links(pages)
    if redirects is not None:
        led = led.unionByName(redirects.select(F.col("from_url").alias("a_url"), F.col("to_url").alias("b_url")))
    led = cut(led)
    labels = connected_components(led.select(node_of(F.col("a_url")).alias("a"), node_of(F.col("b_url")).alias("b"))).withColumnRenamed("id", "node")
    seen = led.select(F.explode(F.array("a_url", "b_url")).alias("url")).unionByName(pages.select("url"))
    bad = judged(seen, rules).where("own = 'block'").select(node_of(F.col("url")).alias("node")).distinct()
    blocked = labels.join(bad, "node", "left_semi").select("label").distinct().withColumn("aliased", F.lit("block"))
    known = labels.join(blocked, "label").select("node", "aliased")
    return rows.join(known, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "aliased", F.lit("allow")).alias("verdict"))


def _oracle() -> str:
    def host(u: str) -> str:
        return f"translate(regexp_extract(rest({u}), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"

    fits = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v} {h}/{p}'" for v, h, p in sorted(((v, *t.split("/", 1)) for v, t in RULES), key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    rest = "CASE WHEN position('://' in coalesce({u}, '')) > 0 THEN substr({u}, position('://' in {u}) + 3) ELSE '' END"
    hosted = lambda u: host(u).replace(f"rest({u})", rest.format(u=u))
    tail = lambda u: f"regexp_extract({rest.format(u=u)}, '^[^/?#]*([^#]*)', 1)"
    node = lambda u: f"CASE WHEN {hosted(u)} <> '' THEN {hosted(u)} || regexp_replace({tail(u)}, '/$', '') END"
    path = lambda u: f"regexp_extract({rest.format(u=u)}, '^[^/?#]*([^?#]*)', 1)"
    value = lambda name: f"trim(regexp_replace(regexp_replace(regexp_extract(tag, {quote(_VALUE.format(name=name))}, 1), {quote(_QUOTES)}, '', 'g'), {quote(_AMPERSAND)}, '&', 'g'))"
    plain = lambda p: f"list_reduce(list_prepend('', string_split(substr({p}, 2), '/')), lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN part = '.' THEN done ELSE done || '/' || part END)"
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {hosted('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages
), tags AS (
  SELECT url, {hosted('url')} AS h, {path('url')} AS p, unnest(regexp_extract_all(regexp_replace(html, {quote(_COMMENT)}, '', 'g'), {quote(_TAG)})) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh') AND {hosted('url')} <> ''
), t AS (
  SELECT url, h, p, CASE WHEN lower(left(tag, 5)) = '<link' AND regexp_matches({value('rel')}, {quote(_CANONICAL)}) THEN {value('href')}
    WHEN lower({value('http-equiv')}) = 'refresh' THEN regexp_extract({value('content')}, {quote(_REFRESH_URL)}, 1) END AS t FROM tags
), u AS (
  SELECT url, h, p, t, regexp_extract(t, '^([^?#]*)', 1) AS held, regexp_extract(t, '^[^?#]*(.*)', 1) AS tail,
    CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '{_LAST_PART}', '') END AS folder FROM t WHERE t <> ''
), w AS (
  SELECT url AS a_url, CASE WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || h || {plain('held')} || tail
    WHEN regexp_matches(t, '{_ABSOLUTE}') THEN t WHEN regexp_matches(t, '{_OTHER}') OR starts_with(t, '#') THEN NULL
    WHEN held = '' THEN 'x://' || h || p || tail ELSE 'x://' || h || {plain('(folder || held)')} || tail END AS b_url FROM u
), e AS (
  SELECT DISTINCT {node('a_url')} AS a, {node('b_url')} AS b FROM w WHERE b_url IS NOT NULL
), both_ways AS (
  SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, s.b FROM reach r JOIN both_ways s ON r.b = s.a
), seen AS (
  SELECT url FROM pages UNION SELECT a_url FROM w UNION SELECT b_url FROM w WHERE b_url IS NOT NULL
), n AS (
  SELECT {hosted('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM seen
), bad AS (SELECT DISTINCT node FROM n WHERE starts_with({fits}, 'block')
), blocked AS (SELECT DISTINCT a AS node FROM reach WHERE b IN (SELECT node FROM bad)
), r AS (SELECT page_id, host, path, node, {fits} AS f FROM p)
SELECT page_id, host, path, split_part(f, ' ', 2) AS rule, CASE WHEN f IS NOT NULL THEN split_part(f, ' ', 1) WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


ORACLE = _oracle()
