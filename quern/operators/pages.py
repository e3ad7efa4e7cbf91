"""Raw web pages: title, URL parts and links, with relative references resolved against the page's own URL. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load

#: What has no links of its own, the href of an anchor, and a title.
HIDDEN = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title"
#: The parts of a reference, as RFC 3986 gives them: scheme, authority, path, query, fragment.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HAS = {"scheme": "^[A-Za-z][A-Za-z0-9+.-]*:", "authority": "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "query": r"^[^#?]*\?", "fragment": "#"}
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def part(url: Column, name: str) -> Column:
    """A part of a URL; null if it has none (a path may be empty)."""
    got = F.regexp_extract(url, _PARTS, ("scheme", "authority", "path", "query", "fragment").index(name) + 1)
    return F.when(url.rlike(_HAS[name]), got) if name in _HAS else got


def host(url: Column) -> Column:
    """The host in lower case, without user and port; null if there is none."""
    got = F.lower(F.regexp_extract(part(url, "authority"), "^(?:[^@]*@)?([^:]*)", 1))
    return F.when(got != "", got)


def _plain_path(path: Column) -> Column:
    """An absolute path without the segments . and .. ; another path as it is."""
    segments = F.split(path, "/", -1)
    walked = F.aggregate(F.slice(segments, 2, 1 << 30), F.lit(""), lambda s, x: F.when(x == ".", s).when(x == "..", F.regexp_replace(s, "/[^/]*$", "")).otherwise(F.concat(s, F.lit("/"), x)))
    return F.when(F.startswith(path, F.lit("/")), F.concat(walked, F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


_NAMES = ("scheme", "authority", "path", "query", "fragment")


def with_resolved(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """df with out: the absolute URL that the reference in column ref stands for within the page whose URL is in column base (RFC 3986, section 5.2). Parts are taken once, as columns of their own."""
    parts = df.withColumns({f"_{c}_{n}": part(F.col(c), n) for c in (base, ref) for n in _NAMES})
    b, r = ({n: F.col(f"_{c}_{n}") for n in _NAMES} for c in (base, ref))
    own_site = r["scheme"].isNotNull() | r["authority"].isNotNull()
    root = b["authority"].isNotNull() & (b["path"] == "")
    merged = F.when(root, F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], "[^/]*$", ""), r["path"]))
    whole = F.when(own_site | F.startswith(r["path"], F.lit("/")), r["path"]).when(r["path"] == "", F.lit(None)).otherwise(merged)
    to = F.coalesce(_plain_path(F.col("_whole")), b["path"])
    site = F.when(own_site, r["authority"]).otherwise(b["authority"])
    asked = F.when(own_site | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    mark = lambda sign, x: F.coalesce(F.concat(F.lit(sign), x), F.lit(""))
    scheme = F.coalesce(F.concat(F.coalesce(r["scheme"], b["scheme"]), F.lit(":")), F.lit(""))
    made = F.concat(scheme, mark("//", site), to, mark("?", asked), mark("#", r["fragment"]))
    return parts.withColumn("_whole", whole).withColumn(out, made).drop("_whole", *[f"_{c}_{n}" for c in (base, ref) for n in _NAMES])


def _decoded(text: Column) -> Column:
    for entity, sign in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _shown(pages: DataFrame) -> Column:
    return F.regexp_replace(F.coalesce(pages["html"].cast("string"), F.lit("")), HIDDEN, " ")


def title(pages: DataFrame) -> Column:
    """The first title's text, references decoded, runs of white space as one blank; null without one."""
    found = F.trim(F.regexp_replace(_decoded(F.regexp_extract(_shown(pages), TITLE, 1)), r"[ \t-\r]+", " "))
    return F.when(found != "", found)


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, place (from 1), href, target and host: every link of every page (page_id, url, html), in order.

    Anchors in comments, scripts and styles are none. A page of null or empty html has no links; against a null url only absolute references have a target. host is null where the target has none.
    """
    refs = F.transform(F.regexp_extract_all(_shown(pages), F.lit(HREF), F.lit(1)), lambda x: F.trim(_decoded(F.regexp_replace(x, "^[\"']|[\"']$", ""))))
    found = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), F.posexplode(refs).alias("at", "href"))
    found = with_resolved(found.withColumn("base", F.coalesce("url", F.lit(""))), "base", "href", "target")
    target = F.when(F.col("url").isNotNull() | F.col("href").rlike(_HAS["scheme"]), F.col("target"))
    found = found.select("page_id", "url", (F.col("at") + 1).cast("bigint").alias("place"), "href", target.alias("target"))
    return found.withColumn("host", host(F.col("target")))


_DECODE = "{}"
for _entity, _sign in _ENTITIES:
    _DECODE = f"replace({_DECODE}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_Q = lambda s: s.replace("'", "''")
_SHOWN = f"regexp_replace(coalesce(html, ''), '{_Q(HIDDEN)}', ' ', 'g')"


def _sql_part(url: str, name: str) -> str:
    got = f"regexp_extract({url}, '{_PARTS}', {('scheme', 'authority', 'path', 'query', 'fragment').index(name) + 1})"
    return f"CASE WHEN regexp_matches({url}, '{_HAS[name]}') THEN {got} END" if name in _HAS else got


def _sql_host(url: str) -> str:
    return f"nullif(lower(regexp_extract({_sql_part(url, 'authority')}, '^(?:[^@]*@)?([^:]*)', 1)), '')"


_WALK = """CASE WHEN starts_with({p}, '/') THEN list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda s, x: CASE WHEN x = '.' THEN s WHEN x = '..' THEN regexp_replace(s, '/[^/]*$', '') ELSE s || '/' || x END)
    || CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {p} END"""
_LINKS = f"""raw AS (SELECT page_id, url, regexp_extract_all({_SHOWN}, '{_Q(HREF)}', 1) AS l FROM pages),
    refs AS (SELECT page_id, url, i AS place, trim({_DECODE.format("regexp_replace(l[i], '^[\"'']|[\"'']$', '', 'g')")}) AS href FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM raw)),
    parts AS (SELECT *, {", ".join(f"{_sql_part(c, n)} AS {p}_{n}" for c, p in (("href", "r"), ("url", "b")) for n in ("scheme", "authority", "path", "query", "fragment"))} FROM refs),
    merged AS (SELECT *, r_scheme IS NOT NULL OR r_authority IS NOT NULL AS own, CASE WHEN b_authority IS NOT NULL AND b_path = '' THEN '/' || r_path ELSE regexp_replace(b_path, '[^/]*$', '') || r_path END AS m FROM parts),
    links AS (SELECT page_id, url, place, href, coalesce(r_scheme, b_scheme) || ':' || coalesce('//' || CASE WHEN own THEN r_authority ELSE b_authority END, '')
    || CASE WHEN own OR starts_with(r_path, '/') THEN {_WALK.format(p="r_path")} WHEN r_path = '' THEN b_path ELSE {_WALK.format(p="m")} END
    || coalesce('?' || CASE WHEN own OR r_path <> '' OR r_query IS NOT NULL THEN r_query ELSE b_query END, '') || coalesce('#' || r_fragment, '') AS target FROM merged),
    hosted AS (SELECT *, {_sql_host("target")} AS host FROM links)"""


@query("page_links", f"WITH {_LINKS} SELECT page_id, url, place::BIGINT AS place, href, target, host FROM hosted")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(load(spark, sf_dir, "pages"))


@query("page_link_hosts", f"WITH {_LINKS} SELECT host, count(*)::BIGINT AS links, count(*) FILTER (WHERE host = {_sql_host('url')})::BIGINT AS internal FROM hosted GROUP BY host")
def page_link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the host that they lead to, and how many of them stay on it. Tasks send one row a host."""
    return links(load(spark, sf_dir, "pages")).groupBy("host").agg(F.count("*").alias("links"), F.count_if(F.col("host") == host(F.col("url"))).alias("internal"))


@query("page_extract", f"""SELECT page_id, url, nullif(trim(regexp_replace({_DECODE.format(f"regexp_extract({_SHOWN}, '{TITLE}', 1)")}, '[ \\t-\\r]+', ' ', 'g')), '') AS title,
    {_sql_part('url', 'scheme')} AS scheme, {_sql_host('url')} AS host, {_sql_part('url', 'path')} AS path, {_sql_part('url', 'query')} AS query, {_sql_part('url', 'fragment')} AS fragment,
    len(regexp_extract_all({_SHOWN}, '{_Q(HREF)}', 1))::BIGINT AS n_links FROM pages""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, URL parts and number of links of every page."""
    pages = load(spark, sf_dir, "pages")
    url = F.col("url")
    return pages.select(
        "page_id", "url", title(pages).alias("title"), part(url, "scheme").alias("scheme"), host(url).alias("host"), part(url, "path").alias("path"), part(url, "query").alias("query"), part(url, "fragment").alias("fragment"),
        F.size(F.regexp_extract_all(_shown(pages), F.lit(HREF), F.lit(1))).cast("bigint").alias("n_links"),
    )
