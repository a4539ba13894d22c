"""Discovery, checks of extracted events, imports and their reports bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extraction as E
from ..functions import html as H
from ..functions import structured as X
from ..functions import text as T
from ..functions import urls as U
from ..operators import content as C
from ..operators import discovery as V
from ..operators import reports as R
from ..operators import selection as S
from ..operators import state as L
from ..sources.directory import NOW, TODAY, Directory
from .core import Plans
from .scalars import _TEXT
from .web import _sql_blocks, _sql_decoded

plans = Plans()
_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


_HOSTS = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_HOST} WHEN 1 THEN {_HOST} || '.' || suffix WHEN 2 THEN suffix WHEN 3 THEN 'w' || page_id || '.' || place || '.ny.us' ELSE '10.0.' || page_id % 7 || '.' || page_id % 250 END AS host
  FROM pages JOIN (VALUES {", ".join(f"({i}, '{x}', '{(*U.US_LOCALITIES, 'glendale', 'co')[i % 9]}')" for i, x in enumerate(U.SUFFIXES))}) v(i, suffix, place) ON i = page_id % {len(U.SUFFIXES)}"""
_listed = lambda texts: ", ".join(f"'{t}'" for t in texts)


@plans.query(
    "registrable_domains",
    f"""WITH h AS ({_HOSTS}), l AS (SELECT *, string_split(host, '.') AS x, len(string_split(host, '.')) AS n FROM h),
      k AS (SELECT *, CASE WHEN x[n] = 'us' AND x[n - 1] IN ({_listed(U.US_STATES)}) THEN CASE WHEN x[n - 2] IN ({_listed(U.US_LOCALITIES)}) THEN 3 ELSE 2 END WHEN n > 3 AND array_to_string(x[-3:], '.') IN ({_listed(U.SUFFIXES)}) THEN 3 WHEN n > 2 AND array_to_string(x[-2:], '.') IN ({_listed(U.SUFFIXES)}) THEN 2 ELSE 1 END AS suffix FROM l)
      SELECT page_id, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR n <= suffix THEN host ELSE array_to_string(x[n - suffix:], '.') END AS domain FROM k""",
)
def registrable_domains(d: Directory) -> DataFrame:
    """The hosts of all pages as they are, or below and at each listed suffix and locality."""
    i, page = F.col("page_id"), F.col("page_id").cast("string")
    known = F.array(*map(F.lit, U.SUFFIXES))
    at = (i % len(U.SUFFIXES)).cast("int")
    suffix = F.get(known, at)
    place = F.get(F.array(*map(F.lit, (*U.US_LOCALITIES, "glendale", "co"))), at % 9)
    own = U.host(F.col("url"))
    host = F.when(i % 5 == 0, own).when(i % 5 == 1, F.concat_ws(".", own, suffix)).when(i % 5 == 2, suffix).when(i % 5 == 3, F.concat(F.lit("w"), page, F.lit("."), place, F.lit(".ny.us")))
    host = host.otherwise(F.concat(F.lit("10.0."), (i % 7).cast("string"), F.lit("."), (i % 250).cast("string")))
    return d.base("pages").select("page_id", U.domain(host).alias("domain"))


@plans.query(
    "slug_titles",
    "SELECT o.id, CASE o.id % 3 WHEN 0 THEN o.title WHEN 1 THEN o.title ELSE 'The ' || c.name || 'Open' END AS given, CASE o.id % 3 WHEN 0 THEN o.title WHEN 1 THEN o.title || ' at Elsewhere Hall' ELSE 'The  Open' END AS slug_title FROM outings o JOIN courses c ON c.id = o.course_id",
    ("outings", "courses"),
)
def slug_titles(d: Directory) -> DataFrame:
    rows = d.outings.select("id", "title", "course_id").join(d.courses.select(F.col("id").alias("course_id"), "name"), "course_id")
    given = F.when(F.col("id") % 3 < 2, F.col("title")).otherwise(F.concat(F.lit("The "), F.col("name"), F.lit("Open")))
    title = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" at "), F.col("name"), F.lit(" Golf Club"))).when(F.col("id") % 3 == 1, F.concat("title", F.lit(" at Elsewhere Hall"))).otherwise(given)
    return rows.select("id", given.alias("given"), T.slug_title(title, F.col("name")).alias("slug_title"))


@plans.query("canonical_urls", "SELECT id, CASE WHEN id % 4 = 1 THEN 'https://pay.example.org/' || id ELSE canonical_source_url END AS url, CASE WHEN id % 4 = 1 THEN 'example.org' ELSE 'site' || id % 50 || '.org' END AS domain FROM outings", ("outings",))
def canonical_urls(d: Directory) -> DataFrame:
    source, i = F.col("canonical_source_url"), F.col("id")
    link = F.when(i % 4 == 0, None).when(i % 4 == 1, F.concat(F.lit("https://pay.example.org/"), i.cast("string"))).otherwise(F.concat(source, F.lit("/register")))
    directory = F.when(i % 4 == 3, None).otherwise(U.host(source))
    return d.outings.select("id", E.canonical_url(source, link, directory).alias("url"), E.organizer_domain(source, link, directory).alias("domain"))


@plans.query(
    "outing_types",
    """, f AS (SELECT o.id, CASE o.id % 11 WHEN 0 THEN 'play.access.example' WHEN 1 THEN 'tour.example' ELSE 'x.org' END AS domain, CASE WHEN o.id % 7 = 3 THEN NULL WHEN o.id % 7 = 4 THEN 'Lincoln High School' ELSE g.name END AS organizer,
        CASE o.id % 5 WHEN 0 THEN 'charity' WHEN 1 THEN 'pro_am' WHEN 2 THEN 'other' WHEN 3 THEN NULL ELSE 'business_association' END AS hint, CASE o.organizer_id % 3 WHEN 0 THEN '03' WHEN 1 THEN '06' END AS subsection FROM outings o LEFT JOIN organizers g ON g.id = o.organizer_id)
      SELECT id, CASE WHEN subsection IS NULL THEN 'unverified' WHEN subsection = '03' THEN '501c3' ELSE 'other_nonprofit' END AS charity, CASE WHEN domain = 'play.access.example' THEN 'access_day' WHEN domain = 'tour.example' THEN 'open_tournament' WHEN hint = 'pro_am' THEN 'pro_am'
        WHEN organizer = 'Lincoln High School' THEN 'school_fundraiser' WHEN coalesce(subsection = '06', FALSE) OR hint = 'business_association' THEN 'business_association' WHEN coalesce(subsection = '03', FALSE) OR hint = 'charity' THEN 'charity' ELSE 'other' END AS kind FROM f""",
    ("outings", "organizers"),
)
def outing_types(d: Directory) -> DataFrame:
    i, g = F.col("id"), F.col("organizer_id")
    rows = d.outings.select("id", "organizer_id").join(d.organizers.select(F.col("id").alias("organizer_id"), "name"), "organizer_id", "left")
    domain = F.when(i % 11 == 0, "play.access.example").when(i % 11 == 1, "tour.example").otherwise("x.org")
    organizer = F.when(i % 7 == 3, None).when(i % 7 == 4, "Lincoln High School").otherwise(F.col("name"))
    hint = F.when(i % 5 == 0, "charity").when(i % 5 == 1, "pro_am").when(i % 5 == 2, "other").when(i % 5 == 3, None).otherwise("business_association")
    subsection = F.when(g % 3 == 0, "03").when(g % 3 == 1, "06")
    charity = E.charity_status(subsection)
    return rows.select("id", charity.alias("charity"), E.outing_type(domain, organizer, hint, subsection, charity, ["access.example"], ["tour.example"]).alias("kind"))


_YEARS = "list_transform(regexp_extract_all({0}, '\\b(19[5-9][0-9]|20[0-9][0-9])\\b', 1), lambda y: CAST(y AS INT))"


@plans.query(
    "year_checks",
    f""", f AS (SELECT id, start_date, title, CASE id % 4 WHEN 0 THEN strftime(CAST(start_date AS DATE), '%A, %b %-d') WHEN 1 THEN strftime(CAST(start_date AS DATE), '%b %-d, %Y') WHEN 3 THEN title END AS quote FROM outings WHERE start_date IS NOT NULL),
      g AS (SELECT *, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'posted ' || substr(updated_at, 1, 4) || '. next ' || coalesce(quote, '') || ' we play' WHEN 2 THEN title || ' in ' || CAST(CAST(substr(start_date, 1, 4) AS INT) + id % 3 - 1 AS VARCHAR) ELSE title || ', ' || coalesce(quote, 'soon') END AS page FROM (SELECT f.*, o.updated_at FROM f JOIN outings o ON o.id = f.id)),
      y AS (SELECT *, {_YEARS.format("coalesce(quote, '')")} AS quoted, CASE WHEN coalesce(quote, '') <> '' THEN strpos(lower(page), lower(substr(quote, 1, 40))) ELSE 0 END AS place FROM g),
      z AS (SELECT *, list_filter(quoted, lambda q: q < 1997)[1] AS early, {_YEARS.format("CASE WHEN place > 400 THEN substr(page, place - 400, 400) ELSE substr(page, 1, greatest(place - 1, 0)::BIGINT) END")} AS dated FROM y)
      SELECT id, CASE WHEN early IS NOT NULL THEN 'past: the page states ' || early WHEN page IS NULL THEN NULL WHEN NOT contains(page || ' https://x.org/a b ' || title || ' ' || coalesce(quote, ''), substr(start_date, 1, 4)) THEN 'year ' || substr(start_date, 1, 4) || ' is not stated on the page'
        WHEN len(quoted) = 0 AND place > 0 AND dated[-1] < 1997 THEN 'past: the page is dated ' || dated[-1] END AS problem FROM z""",
    ("outings",),
)
def year_checks(d: Directory) -> DataFrame:
    """Quotes and pages made of every dated outing's own columns: its day with and without a year, its title, years near its own."""
    i, start = F.col("id"), F.col("start_date")
    rows = d.outings.where("start_date is not null")
    day = start.cast("date")
    quote = F.when(i % 4 == 0, F.date_format(day, "EEEE, MMM d")).when(i % 4 == 1, F.date_format(day, "MMM d, yyyy")).when(i % 4 == 3, F.col("title"))
    near = (F.substring(start, 1, 4).cast("int") + i % 3 - 1).cast("string")
    page = F.when(i % 5 == 0, None).when(i % 5 == 1, F.concat(F.lit("posted "), F.substring("updated_at", 1, 4), F.lit(". next "), F.coalesce(quote, F.lit("")), F.lit(" we play"))).when(i % 5 == 2, F.concat("title", F.lit(" in "), near)).otherwise(F.concat("title", F.lit(", "), F.coalesce(quote, F.lit("soon"))))
    return rows.select("id", E.year_problem(start, quote, page, F.lit("https://x.org/a%20b"), F.col("title"), 1997).alias("problem"))


@plans.query(
    "price_checks",
    "SELECT id, coalesce(single_price_cents = 0, FALSE) OR (single_price_cents IS NULL AND id % 2 = 0) AS free, CASE WHEN single_price_cents IS NULL THEN TRUE WHEN id % 3 = 0 THEN TRUE WHEN id % 3 = 1 THEN FALSE ELSE TRUE END AS stated FROM outings",
    ("outings",),
)
def price_checks(d: Directory) -> DataFrame:
    i, single = F.col("id"), F.col("single_price_cents") / 100
    foursome = F.when(i % 3 == 2, single * 4 + 11).otherwise(single * 4)
    page = F.when(i % 3 == 0, F.concat(F.lit("only $"), F.format_number(F.round(foursome).cast("long"), 0), F.lit(".00 for four"))).otherwise("no price here")
    free = E.is_free_event(single, F.lit(None).cast("double"), F.lit(False), F.when(i % 2 == 0, "It is FREE").otherwise("freedom"))
    return d.outings.select("id", free.alias("free"), E.stated_foursome(single, foursome, page).alias("stated"))


@plans.query("preferred_dates", "SELECT id, CASE WHEN id % 3 = 0 THEN '1999-01-01' ELSE start_date END AS start_date, id % 3 = 0 AND start_date IS NOT NULL AND start_date <> '1999-01-01' AS disagrees, id % 3 = 0 OR (id % 3 = 1 AND start_date IS NOT NULL) AS from_structured FROM outings", ("outings",))
def preferred_dates(d: Directory) -> DataFrame:
    i, start = F.col("id"), F.col("start_date")
    dates = F.when(i % 3 == 0, F.array(F.lit(None).cast("string"), F.lit("1999-01-01"))).when(i % 3 == 1, F.array(F.lit("1990-01-01"), start)).otherwise(F.array(F.lit("1990-01-01")))
    return d.outings.select("id", E.preferred_date(start, dates, i % 3 == 0).alias("p")).select("id", "p.*")


_FIRST = "regexp_replace(split_part(text, '.', 1), '^\\s+|\\s+$', '', 'g')"


@plans.query("summary_links", f"SELECT doc_id, regexp_matches(text, '{E.LINK}') OR regexp_matches(text, '{E.EMAIL}') AS links, CASE WHEN {_FIRST} <> '' AND len(list_filter(string_split_regex({_FIRST}, '\\s+'), lambda w: w <> '')) <= 20 THEN {_FIRST} END AS quote, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS n FROM documents")
def summary_links(d: Directory) -> DataFrame:
    """All documents: whether they hold a link or an address, their first sentence as a quote, their words."""
    text = F.col("text")
    return d.base("documents").select("doc_id", E.contains_url(text).alias("links"), E.clean_evidence(F.substring_index(text, ".", 1)).alias("quote"), E.word_count(text).alias("n"))


_PDF = "array_to_string(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(9)), chr(10)), lambda line: regexp_replace(regexp_replace(line, '[ \\t\\x{00a0}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), chr(10))"


@plans.query("pdf_texts", f"SELECT doc_id, substr(regexp_replace(regexp_replace({_PDF}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 12000) AS text FROM documents")
def pdf_texts(d: Directory) -> DataFrame:
    """All documents, their sentences apart as a PDF's paragraphs are."""
    raw = F.replace("text", F.lit(". "), F.lit(".\n\n\n\t"))
    return d.base("documents").select("doc_id", H.pdf_text(raw).alias("text"))


_NAMES = """regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)"""


@plans.query("event_blocks", f"""SELECT page_id, list_prepend('{{"@type":"GolfEvent","name":' || CAST(to_json(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS VARCHAR) || ',"offers":{{"price":5}}}}', list_transform({_NAMES}, lambda t: '{{"@type":["Thing","Event"],"name":' || CAST(to_json(t) AS VARCHAR) || '}}'))[1:10] AS events FROM pages""")
def event_blocks(d: Directory) -> DataFrame:
    """Blocks made of every page's title and links, in graphs and lists, among blocks that hold no event."""
    html = F.col("html")
    name = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    names = F.regexp_extract_all(html, F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    quoted = lambda text: F.substring(F.to_json(F.struct(text.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)
    one = F.concat(F.lit('{"@graph":[{"@type":"WebSite"},{"@type":"GolfEvent","name":'), quoted(name), F.lit(',"image":"x","offers":{"price":5,"logo":1}}]}'))
    many = F.concat(F.lit("["), F.array_join(F.transform(names, lambda t: F.concat(F.lit('{"@type":["Thing","Event"],"name":'), quoted(t), F.lit(',"sameAs":["x"]}'))), ","), F.lit("]"))
    return d.base("pages").select("page_id", X.event_blocks(F.array(F.lit("no json"), one, F.lit('{"@type":"Person"}'), many)).alias("events"))


_LINKS = """SELECT page_id, k, coalesce(t, '') AS text, CASE (page_id + k) % 7 WHEN 0 THEN 'https://other.org/golf-day/' || k WHEN 1 THEN 'https://www.facebook.com/golf' WHEN 2 THEN 'https://other.org/login?golf' WHEN 3 THEN 'https://index.org/' WHEN 4 THEN 'https://classic.' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' WHEN 5 THEN 'https://www.index.org/list' ELSE 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' || k END AS link
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), 1) AS k FROM pages)"""


@plans.query(
    "link_kinds",
    f"""WITH l AS ({_LINKS}), p AS (SELECT *, regexp_extract(link, '^https?://([^/?#]+)', 1) AS host, CASE WHEN regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) END AS path FROM l),
      q AS (SELECT *, regexp_replace(host, '^www[.]', '') AS bare FROM p)
      SELECT page_id, k, NOT regexp_matches(host, '{V.SOCIAL}') AND NOT regexp_matches(path, '{V.NAVIGATION}') AND regexp_matches(host || ' ' || path || ' ' || text, '{V.ORGANIZER_WORDS}') AS organizer,
        link <> 'https://www.index.org/list' AND NOT regexp_matches(path, '{V.NAVIGATION}') AND NOT (path = '/' AND bare = 'index.org') AND regexp_matches(CASE WHEN path = '/' THEN bare ELSE path END || ' ' || text, '{V.EVENT_WORDS}') AS event FROM q""",
)
def link_kinds(d: Directory) -> DataFrame:
    """The links of all pages with their texts, to other places, social sites, navigation and the index itself."""
    host = F.concat(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("/"))
    texts = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    links = d.base("pages").select("page_id", host.alias("host"), F.posexplode(texts).alias("at", "text")).withColumn("k", F.col("at") + 1)
    n, k = (F.col("page_id") + F.col("k")) % 7, F.col("k").cast("string")
    url = F.when(n == 0, F.concat(F.lit("https://other.org/golf-day/"), k)).when(n == 1, "https://www.facebook.com/golf").when(n == 2, "https://other.org/login?golf").when(n == 3, "https://index.org/")
    url = url.when(n == 4, F.concat(F.lit("https://classic."), "host")).when(n == 5, "https://www.index.org/list").otherwise(F.concat(F.lit("https://"), "host", k))
    return links.select("page_id", "k", V.is_organizer_link(url, F.col("text")).alias("organizer"), V.is_event_link(url, F.col("text"), F.lit("https://www.index.org/list")).alias("event"))


_TARGET = f"regexp_replace('https://golf.example.net/' || {_sql_decoded('href')}, '#.*$', '')"


@plans.query(
    "directory_links",
    f"""WITH RECURSIVE h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 1) AS k FROM pages WHERE NOT regexp_matches({_HOST}, 'example[.]net$')),
      t AS (SELECT page_id, k, {_TARGET} AS target FROM h), l AS (SELECT page_id, target, min(k) AS k FROM t WHERE target <> 'https://golf.example.net/the' AND NOT regexp_matches(regexp_extract(target, '^https://[^/]*([^?]*)', 1), '{V.NAVIGATION}') GROUP BY 1, 2),
      p AS (SELECT page_id, list(target ORDER BY k) AS targets, row_number() OVER (ORDER BY page_id) AS r FROM l GROUP BY page_id),
      w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS page_id, CAST([] AS VARCHAR[]) AS took, CAST([] AS VARCHAR[]) AS seen
        UNION ALL SELECT r, page_id, took, list_concat(seen, took) FROM (SELECT p.r, p.page_id, w.seen, list_filter(p.targets, lambda x: NOT list_contains(w.seen, x))[1:5] AS took FROM w JOIN p ON p.r = w.r + 1))
      SELECT page_id, unnest(took) AS url FROM w WHERE r > 0""",
)
def directory_links(d: Directory) -> DataFrame:
    """All pages as directories of one site's pages: words that many pages link go to the first page that has room for them."""
    pages = d.base("pages").select("page_id", "url", F.regexp_replace("html", 'href="/', 'href="https://golf.example.net/').alias("html"))
    known = d.spark.createDataFrame([("https://golf.example.net/the",)], "url string")
    return V.directory_links(pages, known, known.limit(0).withColumn("reason", F.lit("excluded"))).where("reason is null").select("page_id", "url")


@plans.query("not_removed", "SELECT id FROM outings WHERE id % 9 <> 0 AND id % 50 <> 7", ("outings",))
def not_removed(d: Directory) -> DataFrame:
    outings = d.outings.select("id", F.array("canonical_source_url", F.lit("https://fine.org/")).alias("urls"))
    urls = d.outings.where("id % 50 = 7").select(F.concat("canonical_source_url", F.lit("?utm_source=x#top")).alias("url"))
    return V.not_removed(outings, d.outings.where("id % 9 = 0").select("id"), urls).select("id")


_FOUND = """SELECT id AS ord, url, found_via, CAST(priority AS INT) AS priority, bypass = 1 AS bypass, outing_id, chars % 23 = 0 AS excluded, CASE chars % 7 WHEN 0 THEN 'listing' WHEN 1 THEN 'not_allowed' ELSE 'allowed' END AS verdict, chars % 2 = 0 AS checked FROM {queue}"""


@plans.query(
    "discover",
    f""", c AS ({_FOUND.format(queue="queue")}), r AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN ends_with(url, '/13') THEN 'removed' WHEN NOT checked AND verdict = 'listing' THEN 'platform_listing' WHEN NOT checked AND verdict = 'not_allowed' THEN 'platform_not_allowed' END AS why FROM c),
      k AS (SELECT *, min(CASE WHEN NOT ends_with(url, '/17') AND (bypass OR NOT ends_with(url, '5')) THEN ord END) OVER (PARTITION BY url) AS first FROM r WHERE why IS NULL),
      l AS (SELECT *, CASE WHEN ends_with(url, '/17') THEN 'duplicate' WHEN first IS NULL OR ord < first THEN 'recent' WHEN ord > first THEN 'duplicate' END AS late FROM k),
      q AS (SELECT url, CAST(NULL AS VARCHAR) AS reason, min(ord) AS ord, arg_min(found_via, CAST(priority AS BIGINT) * 1000000000 + ord) AS found_via, min(priority) AS priority, bool_or(bypass) AS bypass FROM l WHERE ord >= first GROUP BY url)
      SELECT url, reason, ord, found_via, priority, bypass FROM q UNION ALL SELECT url, late, ord, found_via, priority, bypass FROM l WHERE late IS NOT NULL UNION ALL SELECT url, why, ord, found_via, priority, bypass FROM r WHERE why IS NOT NULL""",
    ("queue",),
)
def discover(d: Directory) -> DataFrame:
    found = d.spark.sql(_FOUND, queue=d.queue)
    ends = lambda tail: d.queue.where(F.col("url").endswith(tail)).select("url")
    return V.discover(found, ends("/13"), ends("/17"), ends("5")).drop("outing_id")


@plans.query("render_fallback", f"SELECT page_id, CASE WHEN page_id % 2 = 0 AND length({_TEXT.format('html')}) < 2000 THEN {_sql_blocks('html')} ELSE {_TEXT.format('html')} END AS text, page_id % 2 = 0 AND length({_TEXT.format('html')}) < 2000 AS was_rendered FROM pages")
def render_fallback(d: Directory) -> DataFrame:
    """All pages' texts; those of half of them that are short give way to the text with lines."""
    address = F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("url")
    pages = d.base("pages").select("page_id", address, H.visible_text(F.col("html")).alias("text"))
    again = d.base("pages").where("page_id % 2 = 0").select(address, H.block_text(F.col("html")).alias("text"))
    return V.with_rendered(pages, again, least=2000).select("page_id", "text", "was_rendered")


_DIST = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(c.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lng - f.lng) / 2), 2))))"


@plans.query(
    "course_import",
    f""", f AS (SELECT 'way/' || id AS ref, id, name, state, lat, lng, CASE id % 4 WHEN 0 THEN city WHEN 1 THEN 'Springfield' WHEN 2 THEN 'NE Suite 2800' END AS named, CASE id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'municipal' END AS tag FROM courses),
      near AS (SELECT f.ref, c.name, row_number() OVER (PARTITION BY f.ref ORDER BY {_DIST}, c.id) AS rn FROM f JOIN cities c ON c.state = f.state AND {_DIST} <= 30),
      known AS (SELECT lower(replace(name, ' ', '-')) AS key, state, min(name) AS name FROM cities GROUP BY 1, 2)
      SELECT f.ref, CASE WHEN f.id % 6 = 0 THEN f.id END AS id, coalesce(k.name, CASE WHEN f.id % 4 = 1 OR f.named = 'St. Elsewhere' THEN f.named END, n.name) AS city, CASE WHEN f.id % 10 = 3 THEN 'resort' WHEN tag IS NOT NULL THEN tag WHEN f.id % 3 = 0 AND f.id % 2 = 0 THEN 'public' ELSE 'unknown' END AS course_type,
        CASE WHEN f.id % 10 = 3 THEN 'override' WHEN tag IS NOT NULL THEN 'osm' WHEN f.id % 3 = 0 AND f.id % 2 = 0 THEN 'website_llm' END AS type_source, array_to_string(CASE WHEN f.id % 6 = 0 THEN ['Had', 'New'] ELSE ['New'] END, '|') AS aliases
      FROM f LEFT JOIN known k ON k.key = lower(replace(f.named, ' ', '-')) AND k.state = f.state LEFT JOIN near n ON n.ref = f.ref AND n.rn = 1""",
    ("courses", "cities"),
)
def course_import(d: Directory) -> DataFrame:
    i = F.col("id")
    ref = F.concat(F.lit("way/"), i.cast("string")).alias("ref")
    named = F.when(i % 4 == 0, F.col("city")).when(i % 4 == 1, "Springfield").when(i % 4 == 2, "NE Suite 2800")
    features = d.courses.select(ref, "name", "state", "lat", "lng", named.alias("named_city"), F.when(i % 5 == 0, "private").when(i % 5 == 1, "municipal").alias("tag_type"), F.array(F.lit("New"), F.col("name")).alias("aliases"))
    overrides = d.courses.where("id % 10 = 3").select(ref, F.lit("resort").alias("course_type"))
    sites = d.courses.where("id % 3 = 0").select(ref, F.lit("public").alias("course_type"), F.when(i % 2 == 0, 0.7).otherwise(0.69).alias("confidence"))
    existing = d.courses.where("id % 6 = 0").select(ref, "id", F.array(F.lit("Had")).alias("aliases"))
    return V.imported_courses(features, d.cities, overrides, sites, existing).withColumn("aliases", F.array_join("aliases", "|"))


@plans.query("course_answers", "SELECT id, 'public' AS course_type, CASE WHEN id % 4 = 0 THEN 'low_confidence' WHEN id % 5 = 0 THEN 'override' WHEN course_type <> 'unknown' THEN 'already_typed' END AS reason FROM courses", ("courses",))
def course_answers(d: Directory) -> DataFrame:
    answers = d.courses.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).withColumn("course_type", F.when(F.col("ord") == 0, "public").otherwise("private")).withColumn("confidence", F.when(F.col("id") % 4 == 0, 0.6).otherwise(0.7))
    return V.accepted_types(d.courses, answers, d.courses.where("id % 5 = 0").select("id"))


@plans.query("type_candidates", "SELECT id FROM courses WHERE course_type = 'unknown' AND website IS NOT NULL AND id % 7 <> 0 ORDER BY outing_count DESC, notable DESC, updated_at DESC, id LIMIT 40", ("courses",))
def type_candidates(d: Directory) -> DataFrame:
    courses = d.courses.withColumn("last_outing_date", F.col("updated_at"))
    return V.type_candidates(courses, d.courses.where("id % 7 = 0").select("id")).limit(40).select("id")


def _with_errors(d: Directory) -> DataFrame:
    http = '[{"stage":"fetch","kind":"http","message":"503"},{"stage":"fetch","kind":"http","message":"504"}]'
    of = F.col("id") % 6
    stored = F.when(of == 0, http).when(of == 1, '[{"stage":"publish","kind":"internal","message":"boom"}]').when(of == 2, '[{"stage":"x","kind":"not_implemented","message":""}]').when(of == 3, "no json").otherwise("[]")
    return d.runs.withColumn("errors", stored)


@plans.query("errors_by_kind", "SELECT 'http' AS kind, 2 * count(*) AS n, count(*) AS runs FROM runs WHERE id % 6 = 0 UNION ALL SELECT 'internal', count(*), count(*) FROM runs WHERE id % 6 = 1", ("runs",))
def errors_by_kind(d: Directory) -> DataFrame:
    return R.errors_by_kind(_with_errors(d))


@plans.query("run_failures", "SELECT id, 'publish' AS stage, 'internal' AS kind, 'boom' AS message FROM runs WHERE id % 6 = 1", ("runs",))
def run_failures(d: Directory) -> DataFrame:
    return R.failures(_with_errors(d)).select("id", "stage", "kind", "message")


@plans.query(
    "positions_in_groups",
    """, g AS (SELECT course_id AS page, substr(start_date, 1, 7) AS "group", count(*) AS length FROM outings WHERE start_date IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, sum(length) OVER (PARTITION BY page ORDER BY "group") - length AS offset_ FROM g), p AS (SELECT DISTINCT page, p.position FROM g, (SELECT unnest([2, 10, 18]) AS position) p)
      SELECT s.page, s."group", CAST(p.position - s.offset_ AS BIGINT) AS position, (p.position - 2) // 8 AS ordinal FROM s JOIN p ON p.page = s.page AND p.position >= s.offset_ AND p.position < s.offset_ + s.length""",
    ("outings",),
)
def positions_in_groups(d: Directory) -> DataFrame:
    dated = d.outings.where("start_date is not null").select(F.col("course_id").alias("page"), F.substring("start_date", 1, 7).alias("group"))
    groups = dated.groupBy("page", "group").agg(F.count("*").alias("length"))
    positions = groups.select("page").distinct().select("page", F.posexplode(F.array(*(F.lit(p) for p in (2, 10, 18)))).alias("ordinal", "position"))
    return S.positions_in_groups(positions, groups)


@plans.query("list_markup", """SELECT page_id, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"https://a.org/"},{"@type":"ListItem","position":2,"name":"P' || page_id || '","item":"' || url || '"}]}' AS crumbs, '{"@context":"https://schema.org","@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"url":"' || url || '"}]}' AS items FROM pages""")
def list_markup(d: Directory) -> DataFrame:
    names = F.array(F.lit("Home"), F.concat(F.lit("P"), F.col("page_id").cast("string")))
    return d.base("pages").select("page_id", C.breadcrumb_json(names, F.array(F.lit("https://a.org/"), F.col("url"))).alias("crumbs"), C.item_list_json(F.array("url")).alias("items"))


@plans.query("live_holds", f"SELECT url, kind FROM sources WHERE hold_reason IS NOT NULL AND last_fetched + INTERVAL 30 DAY >= CAST('{TODAY}' AS TIMESTAMP)", ("sources",))
def live_holds(d: Directory) -> DataFrame:
    until = F.col("last_fetched") + F.expr("interval 30 days")
    return d.sources.where(F.col("hold_reason").isNotNull() & (until >= F.lit(TODAY).cast("timestamp"))).select("url", "kind")


@plans.query("recent_pages", f"SELECT url FROM sources WHERE CAST('{NOW}' AS TIMESTAMP) - last_fetched < INTERVAL 7 DAY", ("sources",))
def recent_pages(d: Directory) -> DataFrame:
    """The days before are a filter that reaches the scan; the exact span decides."""
    age = F.lit(NOW).cast("timestamp") - F.col("last_fetched")
    early = F.col("last_fetched") >= F.lit(NOW).cast("timestamp") - F.expr("interval 8 days")
    return d.sources.where(early & (age < F.expr("interval 7 days"))).select("url")


@plans.query("searched_courses", "SELECT id, name, state FROM courses WHERE outing_count > 0 OR notable = 1", ("courses",))
def searched_courses(d: Directory) -> DataFrame:
    return d.courses.where("outing_count > 0 or notable = 1").select("id", "name", "state")


_PLACES = "SELECT id, lower(state) || '/' || CASE id % 4 WHEN 0 THEN 'oak-hill' WHEN 1 THEN 'oak-hill-springfield' WHEN 2 THEN 'links' ELSE 'links-' || CAST(id % 9 AS {text}) END AS base, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'springfield' ELSE 'city-' || CAST(id % 3 AS {text}) END AS city, id % 20 = 0 AS stored FROM {courses}"


@plans.query(
    "place_slugs",
    f""", p AS ({_PLACES.format(text="VARCHAR", courses="courses")}), t AS (SELECT split_part(base, '/', 1) AS state, list(DISTINCT base || '-2') AS gone FROM p WHERE stored GROUP BY 1),
      n AS (SELECT *, split_part(base, '/', 1) AS state, row_number() OVER (PARTITION BY split_part(base, '/', 1) ORDER BY id) AS r, CASE WHEN city IS NULL THEN base ELSE base || '-' || city END AS longer FROM p WHERE NOT stored),
      w AS (SELECT n.state, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS slug, coalesce(t.gone, CAST([] AS VARCHAR[])) AS gone FROM n LEFT JOIN t ON t.state = n.state WHERE n.r = 1
        UNION ALL SELECT state, r, id, slug, list_append(gone, slug) FROM (SELECT n.state, n.r, n.id, w.gone, list_filter(list_concat([n.base, n.longer], list_transform(range(2, len(w.gone) + 3), lambda k: n.longer || '-' || CAST(k AS VARCHAR))), lambda s: NOT list_contains(w.gone, s))[1] AS slug FROM w JOIN n ON n.state = w.state AND n.r = w.r + 1))
      SELECT id, slug FROM w WHERE r > 0""",
    ("courses",),
)
def place_slugs(d: Directory) -> DataFrame:
    """New venues of few names: whose base is another's base with its city, or taken, and who share both."""
    rows = d.spark.sql(_PLACES.format(text="STRING", courses="{courses}"), courses=d.courses)
    taken = rows.where("stored").select(F.concat("base", F.lit("-2")).alias("slug"))
    return L.place_slugs(rows.where("not stored").select(F.col("id").alias("ord"), "base", "city"), taken).select(F.col("ord").alias("id"), "slug")
