"""Formatting, crawled content, sources and sinks bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as M
from ..functions import html as H
from ..functions import urls as U
from ..operators import content as C
from ..operators import listing as L
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.directory import Directory
from .core import Plans
from .reads import ROWS, _ALL, _SITEMAP, rows, sitemap

plans = Plans()


def reading(name: str, body: str):
    return plans.query(name, _ALL + " " + body, ROWS)


@plans.query("date_texts", "SELECT id, strftime(CAST(start_date AS DATE), '%b %-d, %Y') AS short, strftime(CAST(start_date AS DATE), '%A, %B %-d, %Y') AS long, strftime(CAST(start_date AS DATE), '%B %Y') AS month, CASE WHEN shotgun_time IS NULL THEN NULL ELSE CASE WHEN CAST(substr(shotgun_time, 1, 2) AS INT) > 12 THEN CAST(CAST(substr(shotgun_time, 1, 2) AS INT) - 12 AS VARCHAR) ELSE CAST(CAST(substr(shotgun_time, 1, 2) AS INT) AS VARCHAR) END || ':30 ' || CASE WHEN CAST(substr(shotgun_time, 1, 2) AS INT) >= 12 THEN 'PM' ELSE 'AM' END END AS clock FROM outings WHERE start_date IS NOT NULL", ("outings",))
def date_texts(d: Directory) -> DataFrame:
    s = F.col("start_date")
    return d.outings.where("start_date is not null").select("id", M.short_date(s).alias("short"), M.long_date(s).alias("long"), M.month_year(s).alias("month"), M.clock(F.col("shotgun_time")).alias("clock"))


_A, _B = "CAST(start_date AS DATE)", "CAST(end_date AS DATE)"


@plans.query(
    "date_ranges",
    f"""SELECT id, CASE WHEN end_date IS NULL THEN strftime({_A}, '%b %-d, %Y') WHEN year({_A}) = year({_B}) AND month({_A}) = month({_B}) THEN strftime({_A}, '%b %-d') || ' to ' || strftime({_B}, '%-d') || strftime({_A}, ', %Y')
      WHEN year({_A}) = year({_B}) THEN strftime({_A}, '%b %-d') || ' to ' || strftime({_B}, '%b %-d') || strftime({_A}, ', %Y') ELSE strftime({_A}, '%b %-d, %Y') || ' to ' || strftime({_B}, '%b %-d, %Y') END AS range FROM outings WHERE start_date IS NOT NULL""",
    ("outings",),
)
def date_ranges(d: Directory) -> DataFrame:
    return d.outings.where("start_date is not null").select("id", M.date_range(F.col("start_date"), F.col("end_date")).alias("range"))


@reading("event_titles", "SELECT id, title || ' at ' || course_name || ', ' || CASE WHEN city IS NULL THEN state ELSE city || ', ' || state END || CASE WHEN status = 'expected' THEN strftime(CAST(expected_month || '-01' AS DATE), ' (expected %B %Y)') ELSE strftime(CAST(start_date AS DATE), ' (%b %-d, %Y)') END AS title, CASE WHEN single_price_cents IS NULL THEN 'See site' ELSE format('${:,}', single_price_cents // 100) || CASE WHEN single_price_cents % 100 = 0 THEN '' ELSE '.' || lpad(CAST(single_price_cents % 100 AS VARCHAR), 2, '0') END || ' per player' END AS price FROM rows")
def event_titles(d: Directory) -> DataFrame:
    title = M.event_title(F.col("title"), F.col("course_name"), F.col("city"), F.col("state"), F.col("status"), F.col("start_date"), F.col("expected_month"))
    return rows(d).select("id", title.alias("title"), M.price(F.col("single_price_cents"), F.lit(None).cast("long"), F.lit(False)).alias("price"))


_RANGE = f"""CASE WHEN year({_A}) = year({_B}) AND month({_A}) = month({_B}) THEN strftime({_A}, '%b %-d') || ' to ' || strftime({_B}, '%-d') || strftime({_A}, ', %Y') WHEN year({_A}) = year({_B}) THEN strftime({_A}, '%b %-d') || ' to ' || strftime({_B}, '%b %-d') || strftime({_A}, ', %Y') ELSE strftime({_A}, '%b %-d, %Y') || ' to ' || strftime({_B}, '%b %-d, %Y') END"""


@plans.query("when_texts", f"SELECT id, CASE WHEN status = 'expected' THEN 'Expected in ' || strftime(CAST(expected_month || '-01' AS DATE), '%B %Y') || ', date not yet announced' WHEN end_date IS NOT NULL THEN {_RANGE} ELSE strftime({_A}, '%A, %B %-d, %Y') END AS text FROM outings", ("outings",))
def when_texts(d: Directory) -> DataFrame:
    text = M.when(F.col("status"), F.col("start_date"), F.col("end_date"), F.col("expected_month"))
    return d.outings.select("id", text.alias("text"))


@plans.query(
    "date_blocks",
    f"""SELECT id, CASE WHEN status = 'expected' THEN 'Expected' ELSE strftime({_A}, '%a') END AS top, CASE WHEN status = 'expected' THEN strftime(CAST(expected_month || '-01' AS DATE), '%b') ELSE strftime({_A}, '%-d') || CASE WHEN end_date IS NULL THEN '' ELSE '–' || strftime({_B}, '%-d') END END AS big,
      CASE WHEN status = 'expected' THEN strftime(CAST(expected_month || '-01' AS DATE), '%Y') ELSE strftime({_A}, '%b') || CASE WHEN month({_A}) <> month({_B}) THEN '–' || strftime({_B}, '%b') ELSE '' END || strftime({_A}, ' %Y') END AS bottom FROM outings""",
    ("outings",),
)
def date_blocks(d: Directory) -> DataFrame:
    leaf = M.date_block(F.col("status"), F.col("start_date"), F.col("end_date"), F.col("expected_month"))
    return d.outings.withColumn("b", leaf).select("id", "b.top", "b.big", "b.bottom")


def _sql_without(html: str, *tags: str) -> str:
    for tag in tags:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"


def _sql_decoded(text: str) -> str:
    for entity, character in H.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return text


def _sql_lines(text: str) -> str:
    return f"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({text}, chr(10)), lambda line: trim(regexp_replace(line, '[ \\t\\x{{00a0}}\\r\\f]+', ' ', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_BODY = "CASE WHEN regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1) <> '' THEN regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1) ELSE html END"


def _sql_blocks(html: str) -> str:
    """``block_text``."""
    broken = f"regexp_replace({_sql_without(html, *H.UNSEEN)}, '({H.BLOCK_END})', '\\1' || chr(10), 'g')"
    return _sql_lines(_sql_decoded(f"regexp_replace({broken}, '(?s)<[^>]*>', '', 'g')"))


@plans.query("block_texts", f"SELECT page_id, {_sql_blocks('html')} AS text FROM pages")
def block_texts(d: Directory) -> DataFrame:
    return d.base("pages").select("page_id", H.block_text(F.col("html")).alias("text"))


_PIECES = f"regexp_replace(regexp_replace({_sql_without('body', *H.UNSEEN, *H.FRAME)}, '(?i)<a\\b[^>]*>', chr(1), 'g'), '(?i)</a\\s*>', chr(2), 'g')"
_PIECES = f"string_split(regexp_replace(regexp_replace({_PIECES}, '{H.BLOCK_TAG}', chr(3), 'g'), '(?s)<[^>]*>', '', 'g'), chr(3))"
_COUNT = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
_BLOCKS = f"""b AS (SELECT page_id, html, {_BODY} AS body FROM pages),
  p AS (SELECT page_id, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS k FROM b),
  w AS (SELECT page_id, k, {_sql_lines(_sql_decoded("regexp_replace(piece, '[' || chr(1) || chr(2) || ']', '', 'g')"))} AS text, {_COUNT.format(_sql_decoded("regexp_replace(piece, '[' || chr(1) || chr(2) || ']', '', 'g')"))} AS words,
    {_COUNT.format(_sql_decoded("array_to_string(regexp_extract_all(piece, chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1), ' ')"))} AS linked FROM p),
  n AS (SELECT *, linked / CAST(words AS DOUBLE) AS density FROM w WHERE words > 0),
  s AS (SELECT *, coalesce(lag(words) OVER q, 0) AS w0, coalesce(lead(words) OVER q, 0) AS w2, coalesce(lag(density) OVER q, 0) AS d0, row_number() OVER q - 1 AS place FROM n WINDOW q AS (PARTITION BY page_id ORDER BY k)),
  c AS (SELECT *, density <= 0.333333 AND CASE WHEN d0 <= 0.555556 THEN words > 16 OR w2 > 15 OR w0 > 4 ELSE words > 40 OR w2 > 17 END AS content FROM s)"""


@plans.query("page_blocks", f"WITH {_BLOCKS} SELECT page_id, place, text, words, linked, content FROM c")
def page_blocks(d: Directory) -> DataFrame:
    blocks = d.base("pages").select("page_id", F.posexplode(H.text_blocks(F.col("html"))).alias("place", "b"))
    return blocks.select("page_id", "place", "b.text", "b.words", "b.linked", "b.content")


@plans.query(
    "dense_texts",
    f"""WITH {_BLOCKS}, t AS (SELECT page_id, string_agg(text, chr(10) ORDER BY k) FILTER (WHERE content) AS text FROM c GROUP BY 1), r AS (SELECT page_id, {_sql_without("body", *H.ASIDE)} AS bare FROM b), f AS (SELECT page_id, {_sql_blocks("bare")} AS rest FROM r)
      SELECT f.page_id, substr(CASE WHEN length(coalesce(text, '')) >= 400 AND length(coalesce(text, '')) >= 0.25 * length(rest) THEN text ELSE rest END, 1, 12000) AS text FROM f LEFT JOIN t ON t.page_id = f.page_id""",
)
def dense_texts(d: Directory) -> DataFrame:
    return d.base("pages").select("page_id", H.dense_text(F.col("html")).alias("text"))


@plans.query("includes_texts", "SELECT id, CASE WHEN id % 3 = 0 THEN 'Includes lunch and cart.' ELSE '' END AS text FROM outings", ("outings",))
def includes_texts(d: Directory) -> DataFrame:
    return d.outings.select("id", M.includes(L.string_list(F.col("includes"))).alias("text"))


@plans.query("sql_inserts")
def sql_inserts(d: Directory) -> DataFrame:
    return S.insert_statements(d.base("nation"), "nation", ["n_nationkey"], per_statement=10, buckets=2)


_PLACE = "'https://directory.example' || path"
for _c, _e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _PLACE = f"replace({_PLACE}, '{_c}', '{_e}')"


@reading(
    "sitemap_xml",
    f"""SELECT kind, CAST((rn - 1) // 45000 AS BIGINT) AS file, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<url><loc>' || {_PLACE} || '</loc><lastmod>' || substr(CAST(lastmod AS VARCHAR), 1, 10) || '</lastmod></url>', '' ORDER BY path) || '</urlset>' AS xml
      FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS rn FROM ({_SITEMAP})) GROUP BY 1, 2""",
)
def sitemap_xml(d: Directory) -> DataFrame:
    return S.sitemap_xml(L.in_files(sitemap(d), ("path",)), "https://directory.example")


@plans.query("event_json", "SELECT id, single_price_cents / 100.0e0 AS price, title FROM outings WHERE start_date IS NOT NULL", ("outings",))
def event_json(d: Directory) -> DataFrame:
    back = "struct<name:string,offers:struct<price:double>>"
    out = C.event_json(rows(d)).withColumn("e", F.from_json("json", back))
    return out.select("id", F.col("e.offers.price").alias("price"), F.col("e.name").alias("title"))


@plans.query("challenge_pages", "SELECT page_id, page_id % 4 = 0 AS challenge FROM pages")
def challenge_pages(d: Directory) -> DataFrame:
    body = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("html", "<title>", "<title>Just a moment... ")).otherwise(F.col("html"))
    return d.base("pages").select("page_id", C.is_challenge(body).alias("challenge"))


_PATH = "regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)"


@plans.query("robots_decisions", f"SELECT page_id, CASE WHEN regexp_matches({_PATH}, '^/.*\\.html$') THEN FALSE WHEN {_PATH} LIKE '/en/1%' THEN TRUE WHEN {_PATH} LIKE '/en/%' THEN FALSE ELSE TRUE END AS allowed FROM pages")
def robots_decisions(d: Directory) -> DataFrame:
    pages = d.base("pages").select("page_id", U.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1).alias("path"))
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: second\nDisallow: /en/ # closed\nAllow: /en/1\nDisallow: /*.html$\nDisallow:\nCrawl-delay: 90\n"
    files = pages.select("host").distinct().withColumn("text", F.lit(text))
    return C.robots_allowed(pages, C.robots_rules(files, "ourbot"))


@plans.query("platform_rules", "SELECT page_id, CASE WHEN regexp_matches(url, 'example\\.org') THEN 'a' ELSE 'b' END AS platform, regexp_matches(url, 'example\\.org') AS allowed, regexp_matches(url, 'example\\.org/es') AS listing FROM pages WHERE regexp_matches(url, 'example\\.(org|net)')")
def platform_rules(d: Directory) -> DataFrame:
    rules = d.spark.createDataFrame([(1, "a", True, "example.org", "^/es", False, None), (2, "b", False, "example.net", None, False, None), (3, "c", False, "other.*", None, True, "/event/")], "ord int, platform string, allowed boolean, domain string, listing_pattern string, directory boolean, event_pattern string")
    return C.platform_verdicts(d.base("pages"), rules).select("page_id", "platform", "allowed", "listing")


@plans.query("first_links", "SELECT href, min(page_id) AS page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages) GROUP BY href")
def first_links(d: Directory) -> DataFrame:
    links = d.base("pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("ord", "link")).select("page_id", "ord", "link.href")
    return C.event_links(links).select("href", "page_id")


_OCTETS = ["event_id * 7 % 256", "event_id * 31 % 256", "event_id * 101 % 256", "event_id % 256"]
_NUMBER = " + ".join(f"({o}) * {256 ** (3 - i)}" for i, o in enumerate(_OCTETS))


def _network(network: str) -> str:
    base, bits = network.split("/")
    low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
    return f"n BETWEEN {low} AND {low + (1 << 32 - int(bits)) - 1}"


@plans.query(
    "address_checks",
    f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN TRUE WHEN 4 THEN event_id % 20 = 4 ELSE {' OR '.join(map(_network, C.PRIVATE_V4))} END AS blocked FROM (SELECT event_id, {_NUMBER} AS n FROM events)""",
)
def address_checks(d: Directory) -> DataFrame:
    """IPv4 addresses of all networks; some IPv6 ones, and texts that are no address."""
    i = F.col("event_id")
    v4 = F.concat_ws(".", *(F.expr(f"cast({o} as string)") for o in _OCTETS))
    address = F.when(i % 10 == 0, F.concat(F.lit("fd00::"), F.hex(i))).when(i % 10 == 1, F.concat(F.lit("2606:4700::"), F.lower(F.hex(i % 65536)))).when(i % 10 == 2, F.concat(F.lit("2001:db8::"), F.lower(F.hex(i % 65536)))).when(i % 10 == 3, F.concat(v4, F.lit(".9")))
    address = address.when(i % 20 == 4, F.concat(F.lit("2600:1:"), F.lower(F.hex(i % 65536)))).when(i % 20 == 14, F.concat(F.lit("2600:1:2:3:4:5:6:"), F.lower(F.hex(i % 65536)))).otherwise(v4)
    return d.base("events").select("event_id", C.is_blocked_address(address).alias("blocked"))


@plans.query("banned_words", "SELECT doc_id, array_to_string(list_filter(['exclusive', 'elite', 'prestigious', 'bucket list'], lambda w: regexp_matches(t, '(?i)\\b' || replace(w, ' ', '\\s+') || '\\b')), ',') AS words FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' An Elite, non-exclusive club.' WHEN 1 THEN chr(10) || 'bucket' || chr(10) || 'list of elites' ELSE '' END AS t FROM documents)")
def banned_words(d: Directory) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", F.when(i % 3 == 0, " An Elite, non-exclusive club.").when(i % 3 == 1, "\nbucket\nlist of elites").otherwise(""))
    return d.base("documents").select("doc_id", F.array_join(C.banned_words(text), ",").alias("words"))


@plans.query("map_features", "SELECT 'node/' || CAST(c_custkey AS VARCHAR) AS ref, 40.5e0 AS lat, CASE WHEN c_custkey % 3 = 0 THEN 'private' WHEN c_custkey % 3 = 1 THEN 'municipal' END AS kind, c_custkey % 10 = 0 AS excluded FROM customer WHERE c_custkey % 4 <> 0")
def map_features(d: Directory) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    tags = F.concat(F.lit('{"name":"'), F.when(F.col("c_custkey") % 10 == 0, "Mini Golf").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, '","access":"private"}').when(F.col("c_custkey") % 3 == 1, '","operator":"City of X"}').otherwise('"}'))
    place = F.when(F.col("c_custkey") % 4 == 0, "").otherwise('"center":{"lat":40.5,"lon":-74.0},')
    text = F.concat(F.lit('{"elements":[{"type":"node","id":'), c, F.lit(","), place, F.lit('"tags":'), tags, F.lit("}]}"))
    found = R.map_features(d.base("customer").select(text.alias("json")))
    return found.select("ref", "lat", C.feature_type(F.col("tags")).alias("kind"), C.is_excluded_feature(F.col("tags")).alias("excluded"))


@plans.query("checked_rows", "SELECT id, CASE WHEN city IS NULL THEN 'city' WHEN outing_count = 0 THEN 'count' END AS problem FROM courses", ("courses",))
def checked_rows(d: Directory) -> DataFrame:
    good, bad = R.split_valid(d.courses, {"city": F.col("city").isNotNull(), "count": F.col("outing_count") > 0})
    return good.select("id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("id", "problem"))


@plans.query("city_names", "SELECT id, city IS NOT NULL AND city = 'St. Elsewhere' AS plausible FROM courses", ("courses",))
def city_names(d: Directory) -> DataFrame:
    return d.courses.select("id", F.coalesce(C.is_city_name(F.col("city")), F.lit(False)).alias("plausible"))
