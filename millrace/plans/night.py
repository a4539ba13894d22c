"""A night's schedule, its accounts and the reference tables, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extractions as X
from ..operators import linkage as K
from ..operators import reports as R
from ..operators import selection as S
from ..sources.directory import Directory
from .core import Plans
from .flows import _FNV

plans = Plans()


# ---- searches


def _metros(d: Directory) -> DataFrame:
    return d.cities.select(F.struct(-F.col("population"), "id").alias("ord"), "name", "state")


_SUBJECTS = """m AS (SELECT *, row_number() OVER (ORDER BY population DESC, id) - 1 AS place FROM cities),
  e AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM courses WHERE outing_count > 0 OR notable = 1)"""
_RANK = "CASE state WHEN 'NJ' THEN 0 WHEN 'IL' THEN 1 ELSE 2 END"


@plans.query(
    "search_plan",
    f""", {_SUBJECTS}, p AS (SELECT {_RANK} AS rank, 0 AS feed, place, 'place' AS kind, name || ', ' || state AS subject, ['golf outing ' || name || ' ' || state || ' 1998', 'charity golf tournament ' || name || ' ' || state || ' 1998', 'golf scramble ' || name || ' ' || state || ' June'] AS q FROM m WHERE {_RANK} < 2 OR place % 7 = 10378 % 7
        UNION ALL SELECT {_RANK}, 1, place, 'course', CAST(id AS VARCHAR), ['"' || name || '" golf outing 1998', '"' || name || '" golf classic register'] FROM e WHERE {_RANK} < 2 OR place % 30 = 0),
      x AS (SELECT *, unnest(range(len(q))) AS n FROM p)
      SELECT place_ AS place, kind, q[n + 1] AS q, subject FROM (SELECT *, row_number() OVER (ORDER BY rank, feed, place, n) - 1 AS place_ FROM x) WHERE place_ < 500""",
    ("cities", "courses"),
)
def search_plan(d: Directory) -> DataFrame:
    courses = d.courses.where("outing_count > 0 or notable = 1").select("id", "name", "state")
    return S.search_plan(_metros(d), courses, "1998-06-01", cap=500, states=["nj", "IL"])


@plans.query(
    "search_backfill",
    f""", {_SUBJECTS}, p AS (SELECT -1 AS rank, 0 AS feed, place, 'place' AS kind, name || ', ' || state AS subject, ['golf outing ' || name || ' ' || state || ' 1998', 'golf outing ' || name || ' ' || state || ' 1999', 'charity golf tournament ' || name || ' ' || state || ' 1998', 'charity golf tournament ' || name || ' ' || state || ' 1999', 'golf scramble ' || name || ' ' || state || ' October'] AS q FROM m WHERE place // 4 = 1
        UNION ALL SELECT 0, 1, place, 'course', CAST(id AS VARCHAR), ['"' || name || '" golf outing 1998', '"' || name || '" golf outing 1999', '"' || name || '" golf classic register'] FROM e WHERE place % 31 = 16),
      x AS (SELECT *, unnest(range(len(q))) AS n FROM p)
      SELECT place_ AS place, kind, q[n + 1] AS q, subject FROM (SELECT *, row_number() OVER (ORDER BY rank, feed, place, n) - 1 AS place_ FROM x) WHERE place_ < 23""",
    ("cities", "courses"),
)
def search_backfill(d: Directory) -> DataFrame:
    courses = d.courses.where("outing_count > 0 or notable = 1").select("id", "name", "state")
    return S.search_plan(_metros(d), courses, "1998-10-17", cap=23, backfill=2)


# ---- listing sources

_SOURCES = "SELECT id AS source, CASE id % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'platform' WHEN 2 THEN 'series' ELSE 'association' END AS feed, id % 50 AS ord, id % 9 <> 0 AS allowed, CASE WHEN id % 3 = 0 THEN 'daily' ELSE 'weekly' END AS cadence, slug FROM {organizers}"
_PAGES = "SELECT id % 97 AS source, CAST(id % 2 AS INT) AS list, CAST(CASE WHEN id % 5 <> 0 THEN id % 8 END AS INT) AS child, id AS ord, 'https://e.org/' || CAST(id % 997 AS STRING) AS url, domain AS title FROM {sources}"
_BUDGET, _MOST, _DAY = 200, 6, 10_378


@plans.query(
    "feed_links",
    f""", s AS ({_SOURCES.format(organizers="organizers")}), l AS ({_PAGES.format(sources="sources").replace("STRING", "VARCHAR")}), r AS (SELECT DISTINCT source, list, child FROM l WHERE child IS NULL OR child < 5),
      due AS (SELECT *, CASE feed WHEN 'series' THEN 0 WHEN 'platform' THEN 1 WHEN 'association' THEN 2 ELSE 3 END AS f FROM s WHERE feed = 'series' OR (allowed AND (cadence = 'daily' OR {_FNV} % 7 = {_DAY} % 7))),
      n AS (SELECT due.*, (SELECT count(*) FROM r WHERE r.source = due.source) AS pages FROM due),
      open_ AS (SELECT * FROM (SELECT *, sum(pages) OVER (ORDER BY f, ord, source) AS upto FROM n) WHERE upto <= {_BUDGET}),
      first AS (SELECT l.source, f, cadence, url, title, list, coalesce(child, -1) AS child, l.ord, row_number() OVER (PARTITION BY l.source, url ORDER BY list, coalesce(child, -1), l.ord) AS rn FROM l JOIN open_ o ON o.source = l.source WHERE child IS NULL OR child < 5),
      placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY list, child, ord, url) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, CASE cadence WHEN 'daily' THEN {_DAY} ELSE {_DAY // 7} END * {_MOST} AS turn FROM first WHERE rn = 1),
      turned AS (SELECT *, CASE WHEN f = 0 OR n <= {_MOST} THEN p ELSE (p - turn % n + n) % n END AS place FROM placed)
      SELECT source, url, title, place FROM turned WHERE place < {_MOST}""",
    ("organizers", "sources"),
)
def feed_links(d: Directory) -> DataFrame:
    sources = d.spark.sql(_SOURCES, organizers=d.organizers)
    links = d.spark.sql(_PAGES, sources=d.sources)
    return S.feed_links(sources, links.select("source", "list", "child").distinct(), links, day=_DAY, budget=_BUDGET, most=_MOST)


# ---- accounts

_UPDATES = "SELECT event_id % 3 AS id, ts AS at, event_type AS stage, event_id % 4 <> 0 AS done, event_id % 700 AS fetches, user_id % 300 AS extractions, event_id % 2 AS outings_new FROM {events}"
_STORED = "SELECT event_id % 3 AS id, ts AS at, event_type AS stage, CAST(event_id AS INT) AS ord, CASE WHEN user_id % 2 = 0 THEN 'http' ELSE 'llm' END AS kind, 'user ' || CAST(user_id AS STRING) AS message FROM {events} WHERE event_id % 5 < 3"


@plans.query(
    "run_accounts",
    f"""WITH u AS ({_UPDATES.format(events="events").replace("AS at", "AS t0")}), e AS ({_STORED.format(events="events").replace("STRING", "VARCHAR").replace("AS at", "AS t0")}),
      f AS (SELECT id, stage, min(t0) AS t0 FROM u WHERE done GROUP BY 1, 2), s AS (SELECT id, list(stage ORDER BY t0, stage) AS stages FROM f GROUP BY 1),
      t AS (SELECT id, max(fetches) AS fetches, max(extractions) AS extractions, sum(outings_new) AS outings_new FROM u GROUP BY 1),
      l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t0 DESC, stage DESC, ord DESC) AS rn FROM e) WHERE rn <= 200),
      g AS (SELECT id, '[' || string_agg('{{"stage":"' || stage || '","kind":"' || kind || '","message":"' || message || '"}}', ',' ORDER BY t0, stage, ord) || ']' AS errors FROM l GROUP BY 1)
      SELECT t.id, array_to_string(list_prepend('start', list_filter(s.stages, lambda x: x <> 'start')), ',') AS stages, greatest(t.fetches, 5) AS fetches, t.extractions, CAST(t.outings_new + 10 AS BIGINT) AS outings_new, g.errors FROM t LEFT JOIN s ON s.id = t.id LEFT JOIN g ON g.id = t.id""",
)
def run_accounts(d: Directory) -> DataFrame:
    """Two halves of the errors are cut down on their own and merged, as stages side by side would."""
    events = d.base("events")
    updates, errors = d.spark.sql(_UPDATES, events=events), d.spark.sql(_STORED, events=events)
    runs = events.select((F.col("event_id") % 3).alias("id")).distinct().select("id", F.array(F.lit("start")).alias("stages_done"), F.lit(5).cast("long").alias("fetches"), F.lit(None).cast("long").alias("extractions"), F.lit(10).cast("long").alias("outings_new"))
    parts = R.last_errors(errors.where("ord % 2 = 0")).unionByName(R.last_errors(errors.where("ord % 2 = 1")))
    return R.run_accounts(runs, updates, parts, ["fetches", "extractions"], ["outings_new"]).select("id", F.array_join("stages_done", ",").alias("stages"), "fetches", "extractions", "outings_new", "errors")


# ---- reference tables

_RAW = "SELECT id, name, state, lat, lng, population, time_zone, CASE WHEN id % 6 = 0 THEN 'PPLX' ELSE 'PPL' END AS feature FROM {0} UNION ALL SELECT id + 1000, upper(name), state, lat + 0.05e0, lng, population + CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END, time_zone, 'PPL' FROM {0} UNION ALL SELECT id + 2000, '---', state, lat, lng, 1, time_zone, 'PPL' FROM {0}"
_CODES = "SELECT lpad(CAST(id % 4000 AS {1}), 5, '0') AS zip, CASE WHEN id % 3 = 0 THEN coalesce(city, 'Nowhere') ELSE 'Hamlet ' || CAST(id AS {1}) END AS place, state, lat + (id % 23) / 50e0 AS lat, lng - (id % 7) / 20e0 AS lng FROM {0}"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lng - p.lng) / 2), 2))))"


@plans.query(
    "reference_places",
    f""", raw AS ({_RAW.format("cities")}), codes AS ({_CODES.format("courses", "VARCHAR")}),
      c AS (SELECT * FROM (SELECT *, {_SLUG.format("name")} AS slug, row_number() OVER (PARTITION BY state, {_SLUG.format("name")} ORDER BY population DESC, id) AS rn FROM raw) WHERE rn = 1 AND slug <> ''),
      p AS (SELECT * FROM (SELECT *, {_SLUG.format("place")} AS slug, row_number() OVER (PARTITION BY zip ORDER BY state, place, lat, lng) AS rn FROM codes) WHERE rn = 1),
      near AS (SELECT p.zip, c.id, row_number() OVER (PARTITION BY p.zip ORDER BY {_KM}, c.id) AS rn FROM p JOIN c ON c.state = p.state AND {_KM} <= 30),
      m AS (SELECT id, name, population FROM raw WHERE feature <> 'PPLX' ORDER BY population DESC, id LIMIT 20)
      SELECT 'city' AS kind, state || '/' || slug AS key, id FROM c UNION ALL SELECT 'zip', p.zip, coalesce(c.id, near.id) FROM p LEFT JOIN c ON c.state = p.state AND c.slug = p.slug LEFT JOIN near ON near.zip = p.zip AND near.rn = 1 UNION ALL SELECT 'metro', name, id FROM m""",
    ("cities", "courses"),
)
def reference_places(d: Directory) -> DataFrame:
    raw = d.spark.sql(_RAW.format("{cities}"), cities=d.cities)
    codes = d.spark.sql(_CODES.format("{courses}", "STRING"), courses=d.courses)
    cities, zips, metros = K.reference_places(raw, codes, metros=20)
    rows = cities.select(F.lit("city").alias("kind"), F.concat_ws("/", "state", "slug").alias("key"), "id")
    return rows.unionByName(zips.select(F.lit("zip").alias("kind"), F.col("zip").alias("key"), F.col("city_id").alias("id"))).unionByName(metros.select(F.lit("metro").alias("kind"), F.col("name").alias("key"), "id"))


# ---- answers

_ANSWERED = """SELECT o.id, o.id // 3 AS page, CASE WHEN o.id % 41 = 0 THEN '' ELSE o.title END AS title, CASE WHEN o.id % 37 = 0 THEN 'see www.example.org' ELSE 'A day of golf' END AS summary, CASE WHEN o.id % 43 = 0 THEN '1998-13-01' ELSE o.start_date END AS start_date, CASE WHEN o.id % 47 = 0 THEN '1990-01-01' ELSE o.end_date END AS end_date, o.shotgun_time,
    c.name AS course_name, CASE WHEN o.id % 4 = 0 THEN NULL ELSE c.state END AS venue_state, CASE WHEN o.id % 53 = 0 THEN 30000e0 WHEN o.id % 7 = 0 THEN 0e0 ELSE o.single_price_cents / 100e0 END AS single_price_usd, o.id % 6 <> 0 AS is_outing, CASE WHEN o.id % 10 = 0 THEN 'unknown' ELSE 'open' END AS status,
    CASE WHEN o.id % 5 <> 0 THEN 'Come ' || o.start_date END AS quote, 'https://www.site' || CAST(o.id % 50 AS {text}) || '.org/register' AS registration_url, o.updated_at FROM {outings} o JOIN {courses} c ON c.id = o.course_id"""


@plans.query(
    "collected_events",
    f""", a AS ({_ANSWERED.format(text="VARCHAR", outings="outings", courses="courses")}), x AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS event_index, count(*) OVER (PARTITION BY page) AS n, first_value(start_date) OVER (PARTITION BY page ORDER BY id) AS d FROM a),
      f AS (SELECT DISTINCT page, CASE WHEN page % 31 = 0 THEN 'no request' WHEN page % 17 = 0 THEN 'batch result errored (overloaded)' WHEN page % 19 = 0 THEN 'stop_reason max_tokens' WHEN page % 23 = 0 THEN 'output is not JSON' WHEN page % 29 = 0 THEN 'output is not a list of events' END AS failure FROM a),
      s AS (SELECT x.*, page % 5 = 0 AND d IS NOT NULL AND (n = 1 OR d IS NOT DISTINCT FROM start_date) AS structured, CASE WHEN page % 2 = 0 THEN string_agg(title || ' ' || coalesce(start_date, ''), ' ') OVER (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS text FROM x JOIN f USING (page) WHERE failure IS NULL),
      t AS (SELECT *, CASE WHEN structured THEN d ELSE start_date END AS day, structured AND start_date IS NOT NULL AND start_date <> d AS disagrees FROM s),
      r AS (SELECT *, CASE WHEN single_price_usd > 25000 THEN 'schema' WHEN title = '' THEN 'empty title' WHEN start_date = '1998-13-01' THEN 'start_date does not parse' WHEN end_date IS NOT NULL AND (start_date IS NULL OR end_date < start_date) THEN 'end_date without or before start_date' WHEN id % 37 = 0 THEN 'summary contains a URL'
        WHEN day IS NOT NULL AND NOT structured AND quote IS NOT NULL AND substr(start_date, 1, 4) < '1997' THEN 'past: the page states ' || substr(start_date, 1, 4) WHEN day IS NOT NULL AND NOT structured AND text IS NOT NULL AND NOT contains(text || ' ' || title || ' ' || coalesce(quote, ''), substr(day, 1, 4)) THEN 'year ' || substr(day, 1, 4) || ' is not stated on the page'
        WHEN coalesce(CASE WHEN end_date >= day THEN end_date END, day) < '1997-03-01' THEN 'past: ' || day || ' before 1997-03-01' END AS reason FROM t),
      g AS (SELECT *, is_outing AND NOT coalesce(single_price_usd = 0, FALSE) AS outing FROM r WHERE reason IS NULL),
      k AS (SELECT *, (100 - CASE WHEN day IS NOT NULL AND (quote IS NOT NULL OR structured) THEN 0 ELSE 30 END - CASE WHEN venue_state IS NULL THEN 20 ELSE 0 END - CASE WHEN single_price_usd IS NULL AND outing THEN 10 ELSE 0 END - CASE WHEN disagrees THEN 20 ELSE 0 END) / 100e0 AS confidence FROM g)
      SELECT 'event' AS kind, page, event_index, day AS start_date, confidence, CASE WHEN outing THEN CASE WHEN day IS NULL THEN 'no_date' WHEN status = 'unknown' THEN 'status_unknown' WHEN confidence < 0.75 THEN 'low_confidence' END END AS reason, CASE WHEN id % 50 IN (page % 50, 7) THEN registration_url END AS link FROM k
      UNION ALL SELECT 'rejected', page, event_index, NULL, NULL, reason, NULL FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'failed', page, NULL, NULL, NULL, failure, NULL FROM f WHERE failure IS NOT NULL""",
    ("outings", "courses"),
)
def collected_events(d: Directory) -> DataFrame:
    """Answers made of every three outings: some did not come through, some events do not hold."""
    rows = d.spark.sql(_ANSWERED.format(text="STRING", outings="{outings}", courses="{courses}").replace("o.id // 3", "o.id div 3"), outings=d.outings, courses=d.courses)
    event = F.struct("id", "title", "summary", "start_date", "end_date", "shotgun_time", "course_name", "venue_state", "single_price_usd", F.lit(False).alias("sponsor_only"), "is_outing", "status", "registration_url", F.struct(F.col("quote").alias("date")).alias("evidence"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(event)).alias("events"), F.min_by("start_date", "id").alias("d"))
    n = lambda k: F.col("page") % k == 0
    text = F.when(n(23), "no json").when(n(29), '{"x":1}').otherwise(F.to_json(F.struct("events")))
    results = pages.select(F.col("page").alias("custom_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.when(n(17), "errored").otherwise("succeeded").alias("kind"), F.when(n(17), "overloaded").alias("error"), F.when(n(19), "max_tokens").otherwise("end_turn").alias("stop_reason"), text.alias("text"))
    results = results.withColumn("text", F.when(F.col("ord") == 1, "a later answer").otherwise(F.col("text")))
    url = F.concat(F.lit("https://www.site"), (F.col("page") % 50).cast("string"), F.lit(".org/"), F.col("page").cast("string"))
    meta = pages.where("page % 31 <> 0").select(F.col("page").alias("custom_id"), url.alias("page_url"), F.when(n(2), F.array_join(F.transform("events", lambda e: F.concat(e["title"], F.lit(" "), F.coalesce(e["start_date"], F.lit("")))), " ")).alias("page_text"), F.when(n(5), F.array("d")).alias("dates"))
    found = X.collected(results, meta, F.lit("1997-03-01 12:00:00").cast("timestamp"), lambda state: F.lit("America/Los_Angeles"), 1997, ["site7.org"])
    page = F.regexp_extract("page_url", "([0-9]+)$", 1).cast("long").alias("page")
    none = F.lit(None).cast("string")
    events = found.events.select(F.lit("event").alias("kind"), page, "event_index", "start_date", "confidence", F.col("hold_reason").alias("reason"), F.col("registration_url").alias("link"))
    rejected = found.rejected.select(F.lit("rejected").alias("kind"), page, "event_index", none.alias("start_date"), F.lit(None).cast("double").alias("confidence"), "reason", none.alias("link"))
    failed = found.failed.select(F.lit("failed").alias("kind"), F.col("custom_id").alias("page"), F.lit(None).cast("int").alias("event_index"), none.alias("start_date"), F.lit(None).cast("double").alias("confidence"), "reason", none.alias("link"))
    return events.unionByName(rejected).unionByName(failed)
