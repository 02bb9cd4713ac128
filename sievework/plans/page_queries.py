"""Queries over pages and URLs, and those that combine several operators."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sievework.functions import html as H
from sievework.functions import text as T
from sievework.operators import blocklists, extract
from sievework.plans.registry import query
from sievework.plans.text_queries import PAGE_TOPK_SQL, page_query_topk
from sievework.session import table

STRIP = r"trim(regexp_replace(regexp_replace({x}, '<[^<]+?>', '', 'g'), '\s+', ' ', 'g'))"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


@query("strip_tags", f"SELECT page_id, {STRIP.format(x='html')} AS text FROM pages")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", T.strip_tags(F.col("html")).alias("text"))


def _clean_sql() -> str:
    x = "html"
    for n in ("script", "style", "header", "footer", "nav", "aside"):
        x = f"regexp_replace({x}, '<{n}[^>]*>.*?</{n}>', '', 'gs')"
    for k in range(1, 7):
        x = f"regexp_replace({x}, '<h{k}[^>]*>\\s*(.*?)\\s*</h{k}>', chr(10) || '{'#' * k} \\1' || chr(10), 'gs')"
    return f"array_to_string(list_filter(list_transform(string_split(regexp_replace({x}, '<[^<]+?>', chr(10), 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"


@query("html_clean", f"SELECT page_id, {_clean_sql()} AS text FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", H.clean_html(F.col("html")).alias("text"))


@query("extract_readability", f"SELECT page_id, {STRIP.format(x=chr(39).join(['regexp_extract(html, ', '<h1[^>]*>(.*?)</h1>', ', 1, ', 's', ')']))} AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def extract_readability(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", H.title_of(F.col("html")).alias("title"), H.readable(F.col("html")).alias("text"))


#: The pages' own links are relative: each page gets a host, and links that a searcher must skip.
LINKED_SQL = """replace(html, 'href="/', 'href="https://h' || page_id || '.example/') || '<a href="https://h.example/search?q=1">next results</a><a href="mailto:a@b.example">write to us</a><a href="javascript:x()">open menu</a>'"""
LINK_PATTERN = '<a href="(https://[^"]+)"[^>]*>([^<]{5,})</a>'
LINKS_SQL = f"""
l AS (SELECT page_id, unnest(m) AS a, generate_subscripts(m, 1) AS k FROM (SELECT page_id, regexp_extract_all({LINKED_SQL}, '{LINK_PATTERN}') AS m FROM pages)),
links AS (SELECT page_id, regexp_extract(a, '{LINK_PATTERN}', 1) AS url, arg_min(trim(regexp_extract(a, '{LINK_PATTERN}', 2)), k) AS title, '' AS snippet FROM l WHERE NOT contains(a, 'search?') GROUP BY ALL)
"""


def _linked():
    extra = '<a href="https://h.example/search?q=1">next results</a><a href="mailto:a@b.example">write to us</a><a href="javascript:x()">open menu</a>'
    return F.concat(F.replace("html", F.lit('href="/'), F.concat(F.lit('href="https://h'), F.col("page_id").cast("string"), F.lit(".example/"))), F.lit(extra))


FIELDS = ["url", "title", "snippet"]


@query("generic_links", f"WITH {LINKS_SQL} SELECT page_id, url, title, snippet FROM links")
def generic_links(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute links with a plain title of at least five characters, each address once: results of a page of unknown layout."""
    pages = _pages(spark, sf).select("page_id", _linked().alias("html"))
    return extract.extract_rows(pages, "page_id", "html", extract.link_rows, FIELDS).drop("pos")


PARTS = "list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda p: trim(p)), lambda p: p <> '')"


def _parts():
    return F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"<p>([^<]*)</p>"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")


@query("pages_to_markdown", f"SELECT page_id, '# PDF: ' || url || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(p) + 1), lambda i: '## PDF Page ' || i || chr(10) || chr(10) || p[i]), chr(10) || chr(10)) AS markdown FROM (SELECT page_id, url, {PARTS} AS p FROM pages)")
def pages_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs stand for the pages of a document."""
    numbered = F.transform(_parts(), lambda p, i: F.concat(F.lit("## PDF Page "), (i + 1).cast("string"), F.lit("\n\n"), p))
    return _pages(spark, sf).select("page_id", F.concat(F.lit("# PDF: "), "url", F.lit("\n\n"), F.array_join(numbered, "\n\n")).alias("markdown"))


@query("page_headers", f"SELECT page_id, unnest(range(len(p))) AS chunk, unnest(list_transform(range(len(p)), lambda i: 'CHUNK ' || i || '/' || len(p) || CASE WHEN i = 0 THEN ' first' WHEN i = len(p) - 1 THEN ' last' ELSE ' middle' END)) AS header FROM (SELECT page_id, {PARTS} AS p FROM pages)")
def page_headers(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select("page_id", _parts().alias("p")).select("page_id", F.size("p").alias("n"), F.posexplode("p").alias("i", "x"))
    place = F.when(F.col("i") == 0, " first").when(F.col("i") == F.col("n") - 1, " last").otherwise(" middle")
    return p.select("page_id", F.col("i").cast("bigint").alias("chunk"), F.concat(F.lit("CHUNK "), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), place).alias("header"))


# ---- URLs: each page's url, changed by its id so that every rule has cases

URL_SQL = "u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN url || '?q=1#top' WHEN 3 THEN 'https://en.wikipedia.org/wiki/' || page_id WHEN 4 THEN 'http://malware.example.com/' || page_id ELSE url END AS url FROM pages)"
# Fixed value: what a fetchable address looks like.
URL_PATTERN = r"""^https?://[a-zA-Z0-9]([a-zA-Z0-9\-\.]{1,253}[a-zA-Z0-9])?(\:[0-9]{1,5})?(/[^\s<>"{}|\\^`\[\]]*)?(\?[^\s<>"{}|\\^`\[\]]*)?$"""


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    m, url = F.col("page_id") % 6, F.col("url")
    changed = (
        F.when(m == 0, F.replace(url, F.lit("http"), F.lit("ftp"))).when(m == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@"))).when(m == 2, F.concat(url, F.lit("?q=1#top")))
        .when(m == 3, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("page_id").cast("string"))).when(m == 4, F.concat(F.lit("http://malware.example.com/"), F.col("page_id").cast("string"))).otherwise(url)
    )
    return _pages(spark, sf).select("page_id", changed.alias("url"))


VALID_SQL = "regexp_matches(url, '" + URL_PATTERN + "')"


def valid_url(url):
    return F.coalesce(F.regexp_like(url, F.lit(URL_PATTERN)), F.lit(False))


@query("url_valid", f"WITH {URL_SQL} SELECT page_id, {VALID_SQL} AS valid FROM u")
def url_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", valid_url(F.col("url")).alias("valid"))


@query("url_no_credentials", f"WITH {URL_SQL} SELECT page_id, NOT contains(regexp_extract(url, '://([^/?#]*)', 1), '@') AS clean FROM u")
def url_no_credentials(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", (~F.contains(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("@"))).alias("clean"))


@query("url_referer", f"WITH {URL_SQL} SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS referer FROM u")
def url_referer(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("referer"))


HOST_SQL = "lower(regexp_extract(url, '://([^/]*)', 1))"
WHITELIST, BLACKLIST = ("wikipedia.org", "github.com", "stackoverflow.com"), ("malware.example.com",)


@query("domain_whitelist", f"WITH {URL_SQL} SELECT page_id, {VALID_SQL} AND len(list_filter({list(WHITELIST)!r}, lambda d: {HOST_SQL} = d OR ends_with({HOST_SQL}, '.' || d))) > 0 AS allowed FROM u")
def domain_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    covered = _covered(_urls(spark, sf), spark.createDataFrame([(d,) for d in WHITELIST], "domain string"))
    return covered.select("page_id", (valid_url(F.col("url")) & F.col("match").isNotNull()).alias("allowed"))


@query("domain_blacklist", f"WITH {URL_SQL} SELECT page_id, {VALID_SQL} AND len(list_filter({list(BLACKLIST)!r}, lambda d: {HOST_SQL} = d OR ends_with({HOST_SQL}, '.' || d))) = 0 AS allowed FROM u")
def domain_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    covered = _covered(_urls(spark, sf), spark.createDataFrame([(d,) for d in BLACKLIST], "domain string"))
    return covered.select("page_id", (valid_url(F.col("url")) & F.col("match").isNull()).alias("allowed"))


LISTED_SQL = "SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN h ELSE h[strpos(h, '.') + 1:] END AS domain FROM (SELECT page_id, lower(regexp_extract(url, '://([^/]*)', 1)) AS h FROM pages WHERE page_id % 3 <> 1)"


@query("domain_list_match", f"WITH l AS ({LISTED_SQL}), u AS (SELECT page_id, lower(regexp_extract(url, '://([^/]*)', 1)) AS h FROM pages) SELECT page_id, arg_max(domain, length(domain)) AS match FROM u LEFT JOIN l ON h = domain OR ends_with(h, '.' || domain) GROUP BY page_id")
def domain_list_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's host against a list as long as the table (hosts, or what follows their first dot, of two thirds of the pages): the longest entry."""
    host = F.lower(F.regexp_extract("url", r"://([^/]*)", 1))
    pages = _pages(spark, sf).select("page_id", "url", host.alias("h"))
    listed = pages.where("page_id % 3 <> 1").select(F.when(F.col("page_id") % 2 == 0, F.col("h")).otherwise(F.regexp_replace("h", r"^[^.]*\.", "")).alias("domain"))
    return _covered(pages, listed, 0).select("page_id", "match")


def _covered(urls: DataFrame, listed: DataFrame, in_row: int = blocklists.IN_ROW) -> DataFrame:
    """``urls`` with ``match``, the longest listed ``domain`` that covers their host."""
    return blocklists.longest_match(urls, "page_id", blocklists.suffixes(F.regexp_extract("url", r"://([^/]*)", 1)), listed, "domain", in_row)


# Networks that are never fetched.
NETWORKS = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 8))


def _number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


RANGES = [(_number(ip), _number(ip) + 2 ** (32 - bits)) for ip, bits in NETWORKS]
ADDRESS_SQL = "SELECT event_id, [0, 10, 127, 169, 172, 192, 8, 203][CAST(event_id % 8 AS BIGINT) + 1]::BIGINT * 16777216 + [254, 16, 168, 31, 32, 0][CAST(event_id % 6 AS BIGINT) + 1]::BIGINT * 65536 + event_id % 65536 AS n FROM events"


@query("ip_private_cidr", f"SELECT event_id, {' OR '.join(f'n >= {a} AND n < {b}' for a, b in RANGES)} AS private FROM ({ADDRESS_SQL})")
def ip_private_cidr(spark: SparkSession, sf: str) -> DataFrame:
    """IPv4 addresses in dotted form against the networks; what is no address is private."""
    networks = spark.createDataFrame([(_number(ip), bits) for ip, bits in NETWORKS], "network bigint, bits int")
    return _in_networks(_addresses(spark, sf), networks).select("event_id", F.expr("bad or match is not null").alias("private"))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, n, bad``: an address of each event as a number."""
    i = F.col("event_id")
    first = F.get(F.array(*(F.lit(x) for x in (0, 10, 127, 169, 172, 192, 8, 203))), (i % 8).cast("int"))
    second = F.get(F.array(*(F.lit(x) for x in (254, 16, 168, 31, 32, 0))), (i % 6).cast("int"))
    ip = F.concat_ws(".", first.cast("string"), second.cast("string"), F.floor(i % 65536 / 256).cast("string"), (i % 256).cast("string"))
    parts = F.split("ip", r"\.")
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + F.coalesce(x.try_cast("bigint"), F.lit(0)))
    bad = ~F.regexp_like("ip", F.lit(r"^(\d{1,3}\.){3}\d{1,3}$"))
    return table(spark, sf, "events").select("event_id", ip.alias("ip")).select("event_id", n.alias("n"), bad.alias("bad"))


def _in_networks(addresses: DataFrame, networks: DataFrame, in_row: int = blocklists.IN_ROW) -> DataFrame:
    """``addresses`` with ``match``, the key of the narrowest network that covers them."""
    lengths = sorted((r["bits"] for r in networks.select("bits").distinct().collect()), reverse=True)  # 33 at most
    keys = networks.select(blocklists.network_key(F.col("network"), F.col("bits")).alias("k"))
    return blocklists.longest_match(addresses, "event_id", blocklists.prefixes(F.col("n"), lengths), keys, "k", in_row)


NETWORKS_SQL = f"SELECT DISTINCT bits, n >> (32 - bits) AS lead FROM (SELECT n, CASE event_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 20 ELSE 28 END AS bits FROM ({ADDRESS_SQL}) WHERE event_id % 7 = 0)"


@query("network_match", f"WITH a AS ({ADDRESS_SQL}), l AS ({NETWORKS_SQL}) SELECT event_id, arg_max(bits || '/' || lead, bits) AS match FROM a LEFT JOIN l ON a.n >> (32 - bits) = lead GROUP BY event_id")
def network_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's address against a table of networks (of every seventh event): the narrowest that covers it."""
    addresses = _addresses(spark, sf)
    networks = addresses.where("event_id % 7 = 0").select(F.col("n").alias("network"), F.get(F.array(F.lit(24), F.lit(20), F.lit(28)), (F.col("event_id") % 3).cast("int")).alias("bits"))
    return _in_networks(addresses, networks, 0).select("event_id", "match")


# Of the newer addresses the loopback, and the leading bits of local ones.
NETWORKS_V6 = (("::1", 128), ("fc00::", 7), ("fe80::", 10))


def groups_v6(ip):
    """The eight 16-bit groups of an address as array<int>; null if it is none."""
    part = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    halves = F.split(ip, "::", -1)
    left, right = part(F.get(halves, F.lit(0))), part(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    filled = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(left)
    plain = F.regexp_like(ip, F.lit(r"^(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}$")) & ~F.regexp_like(ip, F.lit(":::|^:[^:]|[^:]:$"))
    good = plain & (F.size(halves) <= 2) & (F.size(filled) == 8) & ((F.size(halves) == 1) | (missing >= 1))
    return F.when(good, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))


def private_v6(groups):
    """Whether an address must not be fetched; what is no address mustn't either."""
    first = F.get(groups, F.lit(0))
    loopback = F.forall(F.slice(groups, 1, 7), lambda g: g == 0) & (F.get(groups, F.lit(7)) == 1)
    return F.coalesce(loopback | (F.shiftright(first, 9) == 0xFC00 >> 9) | (F.shiftright(first, 6) == 0xFE80 >> 6), F.lit(True))


V6_CASES = ("::1", "fc00::{x}", "fd12:3456::{x}", "fe80::{x}:1", "febf:1:2:3:4:5:6:{x}", "2001:db8::{x}", "2606:4700:4700::{x}", "fec0::{x}", "1:2:3:4:5:6:7:8:{x}", "::{x}::1", "12345::{x}", "::ffff")
V6_PRIVATE = (True, True, True, True, True, False, False, False, True, True, True, False)


@query("ip_private_v6", f"SELECT event_id, {list(map(str, V6_PRIVATE))!r}[CAST(event_id % {len(V6_CASES)} AS BIGINT) + 1] = 'True' AS private FROM events")
def ip_private_v6(spark: SparkSession, sf: str) -> DataFrame:
    """Written forms of every kind against the networks; the event's id is one of the groups."""
    forms = F.array(*(F.lit(c) for c in V6_CASES))
    ip = F.replace(F.get(forms, (F.col("event_id") % len(V6_CASES)).cast("int")), F.lit("{x}"), F.lower(F.hex(F.col("event_id") % 4000 + 2)))
    return table(spark, sf, "events").select("event_id", private_v6(groups_v6(ip)).alias("private"))


@query("short_content_fallback", f"SELECT page_id, length(CASE WHEN length({STRIP.format(x='html')}) < 1500 THEN 'R:' || html ELSE html END) AS n, length({STRIP.format(x='html')}) < 1500 AS rendered FROM pages")
def short_content_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with little text are taken from a second, rendered copy (here marked)."""
    short = F.length(T.strip_tags(F.col("html"))) < 1500
    return _pages(spark, sf).select("page_id", F.length(F.when(short, F.concat(F.lit("R:"), "html")).otherwise(F.col("html"))).cast("bigint").alias("n"), short.alias("rendered"))


# ---- result pages, made of each page's url and heading, then parsed

H1_SQL = STRIP.format(x="regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")
SERP = '<article class="result"><a href="{url}" class="url_header">x</a><h3><a href="{url}">{title}</a></h3><p class="result-content">{text}</p></article><article class="result"><h3>no address</h3></article>'
DDG = (
    '<div class="result result--ad"><h2><a class="result__a" href="https://duckduckgo.com/y.js?ad_domain=x">Advert</a></h2></div><div class="result results_links"><div class="links_main result__body">'
    '<h2 class="result__title"><a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg={enc}&amp;rut=1">{title}</a></h2><a class="result__snippet" href="#">{text}</a></div></div>'
)
RESULT_SQL = f"SELECT page_id, url, {H1_SQL} AS title, 'about ' || page_id AS snippet FROM pages"


def _filled(template: str):
    values = {"{url}": F.col("url"), "{enc}": F.url_encode("url"), "{title}": H.element(F.col("html"), "h1"), "{text}": F.concat(F.lit("about <b>"), F.col("page_id").cast("string"), F.lit("</b>"))}
    return F.concat(*(values.get(p, F.lit(p)) for p in re.split(r"(\{\w+\})", template)))


@query("serp_parse", RESULT_SQL)
def serp_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a metasearch page; one without address is left out."""
    page = _pages(spark, sf).select("page_id", _filled(SERP).alias("serp"))
    return extract.extract_rows(page, "page_id", "serp", lambda x: extract.result_rows(x, "searx"), FIELDS).drop("pos")


@query("ddg_parse", RESULT_SQL)
def ddg_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a page whose links are redirects; adverts are left out."""
    page = _pages(spark, sf).select("page_id", _filled(DDG).alias("serp"))
    return extract.extract_rows(page, "page_id", "serp", lambda x: extract.result_rows(x, "duckduckgo"), FIELDS).drop("pos")


@query("provider_pages", f"WITH {LINKS_SQL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'searx' ELSE 'duckduckgo' END AS provider, url, title, snippet FROM ({RESULT_SQL}) WHERE page_id % 3 < 2 UNION ALL SELECT page_id, 'links', url, title, snippet FROM links WHERE page_id % 3 = 2")
def provider_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What three providers saved for a query: the first that has results answers it; a page that says it refused has none."""
    m = F.col("page_id") % 3
    pages = _pages(spark, sf)
    refused = F.lit("<p>429 Too Many Requests</p>" + SERP)
    by = {
        "searx": F.when(m == 0, _filled(SERP)).otherwise(refused),
        "duckduckgo": F.when(m == 1, _filled(DDG)).otherwise(""),
        "links": _linked(),
    }
    saved = pages.select("page_id", *(x.alias(p) for p, x in by.items()))
    return provider_results(saved, "page_id", list(by))


def provider_results(saved: DataFrame, key: str, providers: list[str]) -> DataFrame:
    """``key, provider, url, title, snippet``: of each row's saved pages (a column a provider, in order of preference) the results of the first with any."""

    def rows(pages: list[str | None]) -> list[dict[str, str]]:
        for provider, page in zip(providers, pages, strict=True):
            if extract.refuses(page):
                continue
            found = extract.link_rows(page) if provider == "links" else extract.result_rows(page, provider)
            if found:
                return [{"provider": provider, **row} for row in found]
        return []

    together = saved.select(key, F.to_json(F.array(*(F.coalesce(F.col(p), F.lit("")) for p in providers))).alias("pages"))
    return extract.extract_rows(together, key, "pages", lambda x: rows(json.loads(x)), ["provider", *FIELDS]).drop("pos")


def _decoded(x: str) -> str:
    """The character references that the pages use, the ampersand last."""
    for reference, character in (("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{reference}', '{character}')"
    return x


ARTICLE_SQL = "trim(regexp_replace(regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("extract_custom", f"SELECT page_id, {_decoded(H1_SQL)} AS title, {_decoded(ARTICLE_SQL)} AS text FROM pages")
def extract_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text by selectors, through the extension point for extractors."""
    return extract.extract_with(_pages(spark, sf), "page_id", "html", extract.Selectors("body > article h1, .headline", "div.content, body article").extract, ["title", "text"])


@query("extract_main", f"SELECT page_id, url, {H1_SQL} AS title, regexp_extract(html, '<html[^>]*lang=\"([^\"]+)\"', 1) AS language, {ARTICLE_SQL} AS text FROM pages")
def extract_main(spark: SparkSession, sf: str) -> DataFrame:
    """Main text by the readability rules, with title and language."""
    lang = F.regexp_extract("html", r'<html[^>]*lang="([^"]+)"', 1)
    return _pages(spark, sf).select("page_id", "url", H.title_of(F.col("html")).alias("title"), lang.alias("language"), H.readable(F.col("html")).alias("text"))


@udtf(returnType="pos: int, word: string")
class WordsOf:
    """A user's table function: one row per word of the argument."""

    def eval(self, text: str):
        for k, word in enumerate((text or "").split()):
            yield k, word


@query("udtf_tokens", "SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT item_id, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark)")
def udtf_tokens(spark: SparkSession, sf: str) -> DataFrame:
    spark.udtf.register("words_of", WordsOf)
    table(spark, sf, "benchmark").createOrReplaceTempView("sievework_items")
    return spark.sql("SELECT item_id, cast(pos AS bigint) AS pos, word FROM sievework_items, LATERAL words_of(text)")


RAG_SQL = f"""
WITH t AS ({PAGE_TOPK_SQL}), k AS (SELECT qid, doc_id, rank, pos, score, chunk, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rank) AS ord FROM t WHERE score > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY ord) AS nth FROM k), d AS (SELECT * FROM s WHERE nth <= 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ord) <= 15),
f AS (SELECT *, min(ord) OVER (PARTITION BY qid, doc_id) AS fo FROM d), g AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY fo) AS idx FROM f)
SELECT qid, doc_id, pos, idx, length('[' || idx || '] ' || chunk) + 2 AS part_len FROM g
"""


@query("rag_context", RAG_SQL)
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    """For each query the best passages of its documents, at most three of one and fifteen in all (limits of the feature), numbered by document."""
    k = page_query_topk(spark, sf).where("score > 0 and rank <= 3")
    # of a document's ranked passages the first three can be chosen: what is left is limited before a query's rows meet
    order = [F.desc("score"), F.col("doc_id"), F.col("rank")]
    best = k.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("ord <= 15")
    best = best.withColumn("fo", F.min("ord").over(Window.partitionBy("qid", "doc_id")))
    numbered = best.withColumn("idx", F.dense_rank().over(Window.partitionBy("qid").orderBy("fo")).cast("bigint"))
    return numbered.select("qid", "doc_id", "pos", "idx", (F.length(F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "chunk")) + 2).cast("bigint").alias("part_len"))


# ---- an extension: event-time windows

@query("events_per_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_per_hour(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")
