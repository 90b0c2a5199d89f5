"""Operator 10: URL filters with redirect equivalence (native).

A rule names a host and a path prefix and fits the host and its subdomains; the longest rule that fits
decides.  Pages that are the same resource -- by URL (scheme and fragment aside), by a
canonical link, an ``og:url`` or a refresh redirect in the page, or by a given redirect table -- form
classes by distributed connected components (rounds of joins, no Python on executors).  A class with a page blocked by rule is blocked: its
pages without a rule of their own get the verdict block.  A page's own rule comes first, so an
explicitly allowed alias stays allowed.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no aliases,
and is allowed; null html has no links, and tags inside comments count as none; of several tags of a kind
all count; attribute values are read with their character references
(numeric ones, ``&amp;``, ``&lt;``, ``&gt;``, ``&quot;``, ``&apos;``); relative links resolve against the
page's ``base`` or else its url, with dot segments removed; links of schemes without ``//`` are none;
rows that share a page_id are judged each by its own url, and repeated rows each; a null page_id is judged
like others; very long urls and pages are read whole; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import components, saved, small

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def own_rule(pages: DataFrame, rules) -> DataFrame:
    """``pages(host, path)`` with ``rule`` and ``own`` (its verdict), null where no rule fits.

    A literal list becomes one expression, longest rule first.  A rule table ``(verdict, host, path)``
    is joined on the host's suffixes.
    """
    if not isinstance(rules, DataFrame):
        rule = own = None
        for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            rule = F.when(fits, F.lit(host + path)).otherwise(rule if rule is not None else F.lit(None))
            own = F.when(fits, F.lit(verdict)).otherwise(own if own is not None else F.lit(None))
        return pages.withColumns({"rule": rule, "own": own})
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    site = pages.select("host", "path").distinct().withColumn("suffix", F.explode(suffix))
    table = rules.toDF("__v", "__h", "__p")
    fits = site.join(table, (F.col("suffix") == F.col("__h")) & F.startswith("path", F.col("__p")))
    length = F.length("__h") + F.length("__p")
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("__h", "__p").alias("rule"), F.col("__v").alias("own")), length).alias("b")
    )
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "b.rule", "b.own")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", 0)
    return F.regexp_replace(value, r"^[^=]*=\s*[\"']?|[\"']$", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: plans do not grow with the number of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescaped(text: Column) -> Column:
    """The text with numeric and the five common named character references replaced, each once."""

    def replaced(piece: Column) -> Column:
        code = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(piece, r"^#[xX]0*([0-9A-Fa-f]{1,6})(?![0-9A-Fa-f])", 1), F.lit("")), 16, 10),
            F.nullif(F.regexp_extract(piece, r"^#0*([0-9]{1,7})(?![0-9])", 1), F.lit("")),
        ).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")).otherwise("\ufffd")
        out = F.when(piece.rlike(r"^#(?:[0-9]|[xX][0-9A-Fa-f])"), F.concat(char, F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", "")))
        for name, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            end = ";" if name == "apos" else "(?:;|(?![0-9A-Za-z=]))"
            out = out.when(piece.rlike(f"^{name}{end}"), F.concat(F.lit(c), F.regexp_replace(piece, f"^{name};?", "")))
        return out.otherwise(F.concat(F.lit("&"), piece))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), replaced)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return _let(F.split(text, "&", -1), joined)


def without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments removed."""
    one, two = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")

    def step(done: Column, x: Column) -> Column:
        return (
            F.when(F.lower(x).isin(*two), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(F.lower(x).isin(*one), done).otherwise(F.concat(done, F.array(x)))
        )

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        end = F.when(F.lower(F.element_at(parts, -1)).isin(*one, *two), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))

    return _let(F.split(F.substring(path, 2, 1 << 30), "/", -1), joined)


def resolved(base: Column, link: Column) -> Column:
    """``link`` as a full url, read on a page whose url is ``base``; null for other schemes, as ``mailto:``."""

    def full(base: Column, link: Column) -> Column:
        site, path = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1), F.regexp_extract(link, r"^([^?#]*)", 1)
        after = F.regexp_extract(link, r"^[^?#]*((?s:.*))$", 1)
        folder = F.regexp_extract(path_of(base), r"^((?s:.*)/)", 1)
        return (
            F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
            .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(base), link))
            .when(path == "", F.regexp_extract(base, "^([^#]*)", 1))
            .otherwise(F.concat(site, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))), after))
        )

    clean = F.regexp_replace(link, r"^\s+|\s+$|[\t\r\n]+", "")
    return _let(base, lambda b: _let(clean, lambda x: full(b, x)))


#: Tags that name a page's address, and the attribute that holds it.
_TAGS = (
    (r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", "href"),
    (r"(?i)<meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b[^>]*>", "content"),
    (r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", "content"),
)


def page_links(pages: DataFrame) -> DataFrame:
    """``(url, link)``: all canonical, og:url and refresh targets of each page outside comments, resolved."""
    html = F.col("html")
    wanted = html.isNotNull() & (F.col("host") != "") & html.rlike(r"(?i)canonical|og:url|refresh")
    read = pages.where(wanted).withColumn("html", F.regexp_replace(html, r"(?s)<!--.*?-->", ""))

    def values(pattern: str, name: str, kind: int) -> Column:
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda tag: F.struct(F.lit(kind).alias("tag"), _attribute(tag, name).alias("link")))

    read = read.select(
        "url",
        _attribute(F.regexp_extract(html, r"(?i)<base\b[^>]*\bhref\s*=[^>]*>", 0), "href").alias("base"),
        F.concat(*[values(pattern, name, i) for i, (pattern, name) in enumerate(_TAGS)]).alias("tags"),
    )
    links = read.select("url", "base", F.explode("tags").alias("t")).select("url", "base", "t.tag", "t.link").where("link <> ''")
    links = links.select("url", "tag", unescaped(F.col("base")).alias("base"), unescaped(F.col("link")).alias("link"))
    target = F.regexp_extract("link", r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)
    links = links.select("url", resolved(F.col("url"), F.col("base")).alias("base"), F.when(F.col("tag") == 2, target).otherwise(F.col("link")).alias("link"))
    base = _let(F.col("base"), lambda b: F.when(host_of(b) != "", b).otherwise(F.col("url")))
    links = links.where("link <> ''").select("url", base.alias("base"), "link")
    return links.select("url", resolved(F.col("base"), F.col("link")).alias("link")).where("link is not null").distinct()


def node_of(url: Column) -> Column:
    """One name for a resource: host, path and query; null without a host."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)``: more edges, as urls.
    """
    url = F.col("url").cast("string")
    pages = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.toDF("url", "link"))
    links = edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("link")).alias("b"))
    alias = saved(components(links, native=True))
    judged = own_rule(pages.drop("html"), rules).withColumn("node", node_of(F.col("url")))
    blocked = judged.where("own = 'block'").select("node").distinct()
    bad = alias.join(blocked, "node").select("component").distinct()
    bad_nodes = alias.join(bad, "component", "left_semi").select("node").union(blocked).distinct()
    bad_nodes = small(saved(bad_nodes)).withColumn("__bad", F.lit(True))
    return judged.join(bad_nodes, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {
    "op10_url_filters": r"""
with recursive p as (
  select page_id, url, html, lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(verdict, h, q) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (select page_id, url, max_by(h || q, length(h || q)) as rule, max_by(verdict, length(h || q)) as own
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id, url),
j as (select p.*, f.rule, f.own, case when host <> '' then host || path || coalesce(regexp_extract(p.url, '^[^?#]*(\?[^#]*)', 1), '') end as node
  from p left join f on f.page_id = p.page_id and f.url = p.url),
t as (select node as a, host, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as html from j where host <> ''),
c as (select a, host, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bproperty\s*=\s*["'']?og:url\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bcontent\s*=\s*["'']?([^"''\s>]*)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)url\s*=\s*["'']?([^"''>]*)', 1))
  )) as link from t),
g as (select a, case when link like '%://%' then link when starts_with(link, '//') then 'http:' || link
    when starts_with(link, '/') then 'http://' || host || link end as link from c where link <> ''),
h as (select a, lower(regexp_extract(link, '^(?s:.*?)://([^/?#]*)', 1)) as host, regexp_extract(link, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path,
    coalesce(regexp_extract(link, '^[^?#]*(\?[^#]*)', 1), '') as query from g where link is not null),
e as (select a, host || path || query as b from h where host <> ''),
u as (select a, b from e union select b, a from e),
bad(node) as (select node from j where own = 'block' and node is not null union select u.b from bad join u on u.a = bad.node)
select page_id, host, path, rule, coalesce(own, case when node in (select node from bad) then 'block' else 'allow' end) as verdict from j
""",
}
