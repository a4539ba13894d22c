"""Linkage, selection, state and reports bound to the directory's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.geo import haversine_km
from ..operators import content as N
from ..operators import linkage as K
from ..operators import listing as L
from ..operators import reports as R
from ..operators import selection as C
from ..operators import similar as M
from ..operators import state as S
from ..operators import write_plan as W
from ..operators.kept import dealt, keep
from ..sources.directory import NOW, TODAY, Directory
from .core import Plans
from .scalars import _TOKENS

plans = Plans()


# ---- linkage


@plans.query("course_match")
def course_match(d: Directory) -> DataFrame:
    courses = d.courses.withColumn("aliases", L.string_list(F.col("aliases")))
    asked = d.courses.select(F.col("id").alias("query_id"), F.concat(F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" Golf Club")).alias("name"), "state", "city", "lat", "lng")
    return K.match_courses(asked, courses)


@plans.query("name_likeness")
def name_likeness(d: Directory) -> DataFrame:
    return d.base("part").select("p_partkey", F.round(K.jaro_winkler(F.col("p_name"), F.col("p_type")), 9).alias("score"))


_NAMES = "SELECT p_partkey AS name_id, p_name || ' ' || p_brand || CASE p_partkey % 4 WHEN 0 THEN ' Ladies Guild' WHEN 1 THEN '' ELSE ' ' || CAST(p_partkey AS STRING) END AS name, CASE p_size % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS state FROM part"
_REGISTER = "SELECT p_partkey AS ein, p_name || ' ' || p_brand || ' ' || CAST(p_partkey - p_partkey % 2 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ' Inc' ELSE '' END AS name, CASE (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS state FROM part"
_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(upper(name), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('INC', 'THE', 'OF', 'AND', 'FOR', 'CO', 'CORP', 'LLC', 'FUND', 'FOUNDATION')))"
_SHARED = f"""WITH names AS ({_NAMES}), register AS ({_REGISTER}),
  a AS (SELECT name_id, state, unnest({_WORDS}) AS token FROM names), b AS (SELECT ein, state, unnest({_WORDS}) AS token FROM register),
  s AS (SELECT name_id, ein, count(*) AS shared FROM a JOIN b USING (token, state) GROUP BY 1, 2),
  ranked AS (SELECT name_id, ein, shared FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY shared DESC, ein) AS rn FROM s) WHERE rn <= 25),
  ns AS (SELECT name_id, ein, count(*) AS shared FROM (SELECT name_id, token FROM a) x JOIN (SELECT ein, token FROM b) y USING (token) GROUP BY 1, 2),
  nranked AS (SELECT name_id, ein FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY shared DESC, ein) AS rn FROM ns) WHERE rn <= 25)"""


def _register(d: Directory) -> tuple[DataFrame, DataFrame]:
    part = d.base("part")
    return d.spark.sql(_NAMES.replace("FROM part", "FROM {part}"), part=part), d.spark.sql(_REGISTER.replace("FROM part", "FROM {part}"), part=part)


@plans.query("register_candidates", f"{_SHARED} SELECT * FROM ranked")
def register_candidates(d: Directory) -> DataFrame:
    names, register = _register(d)
    return K.register_candidates(names, register, by_state=True)


_SCORE = f"""scored AS (SELECT {{0}}.name_id, {{0}}.ein, 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) AS score FROM {{0}}
  JOIN (SELECT name_id, array_to_string({_TOKENS.format('name')}, ' ') AS x FROM names) p ON p.name_id = {{0}}.name_id JOIN (SELECT ein, array_to_string({_TOKENS.format('name')}, ' ') AS y FROM register) q ON q.ein = {{0}}.ein)"""
_BEST = "SELECT name_id, min(ein) AS ein, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY name_id) AS best FROM {0} WHERE score >= {1}) WHERE score = best GROUP BY name_id HAVING count(DISTINCT ein) = 1"


@plans.query(
    "register_match",
    _SHARED + ", " + _SCORE.format("ranked").replace("scored AS", "s1 AS") + ", " + _SCORE.format("nranked").replace("scored AS", "s2 AS")
    + f", b1 AS ({_BEST.format('s1', 0.92)}), b2 AS ({_BEST.format('s2', 0.95)}) SELECT n.name_id, coalesce(b1.ein, b2.ein) AS ein, round(coalesce(b1.score, b2.score), 9) AS score, CASE WHEN b1.ein IS NOT NULL THEN 'state' WHEN b2.ein IS NOT NULL THEN 'nation' END AS via FROM names n LEFT JOIN b1 USING (name_id) LEFT JOIN b2 USING (name_id)",
)
def register_match(d: Directory) -> DataFrame:
    names, register = _register(d)
    return K.register_match(names, register).select("name_id", "ein", F.round("score", 9).alias("score"), "via")


_EVENTS = "SELECT event_id, user_id % 20 AS course_id, CAST(CAST(ts AS DATE) AS STRING) AS start_date, 'd' || CAST(event_id % 7 AS STRING) || '.org' AS domain, CASE WHEN event_id % 3 = 0 THEN 'low_confidence' WHEN event_id % 5 = 0 THEN 'no_date' END AS hold_reason, (40 + event_id % 60) / 100e0 AS confidence FROM {0} WHERE event_type IN ('signup', 'purchase')"
_STORED = "SELECT event_id + 0 AS event_id, user_id % 20 AS course_id, CAST(CAST(ts AS DATE) AS STRING) AS start_date, 'd' || CAST(event_id % 3 AS STRING) || '.org' AS domain FROM {0} WHERE event_type = 'error'"


def _both(d: Directory) -> tuple[DataFrame, DataFrame]:
    return d.spark.sql(_EVENTS.format("{events}"), events=d.base("events")), d.spark.sql(_STORED.format("{events}"), events=d.base("events"))


@plans.query("corroboration", f"WITH e AS ({_EVENTS.format('events')}), s AS ({_STORED.format('events')}) SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM (SELECT course_id, start_date, domain FROM e UNION ALL SELECT course_id, start_date, domain FROM s) o WHERE o.course_id = e.course_id AND o.start_date = e.start_date AND o.domain <> e.domain)")
def corroboration(d: Directory) -> DataFrame:
    events, stored = _both(d)
    return K.corroborated(events, stored).select("event_id")


@plans.query(
    "hold_lifting",
    f"WITH e AS ({_EVENTS.format('events')}), s AS ({_STORED.format('events')}), g AS (SELECT *, hold_reason = 'low_confidence' AND EXISTS (SELECT 1 FROM (SELECT course_id, start_date, domain FROM e UNION ALL SELECT course_id, start_date, domain FROM s) o WHERE o.course_id = e.course_id AND o.start_date = e.start_date AND o.domain <> e.domain) AS lift FROM e) SELECT event_id, CASE WHEN lift THEN greatest(confidence, 0.75) ELSE confidence END AS confidence, CASE WHEN lift THEN NULL ELSE hold_reason END AS hold_reason FROM g",
)
def hold_lifting(d: Directory) -> DataFrame:
    return K.lift_holds(*_both(d)).select("event_id", "confidence", "hold_reason")


def _for_clusters(d: Directory) -> DataFrame:
    names = d.organizers.select(F.col("id").alias("organizer_id"), F.col("name").alias("organizer"))
    rows = d.outings.where("start_date is not null").join(names, "organizer_id", "left")
    kind = F.element_at(F.array(F.lit("organizer"), F.lit("listing"), F.lit("search")), (F.col("id") % 3 + 1).cast("int"))
    return rows.select(F.col("id").alias("event_id"), "course_id", "start_date", "organizer", "title", kind.alias("kind"), "confidence", F.col("id").alias("ord"))


_quoted = lambda texts: ", ".join(f"'{t}'" for t in texts)
_MINE = f"list_filter(string_split_regex(lower(coalesce({{0}}, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_quoted(T.GENERIC_WORDS)}))"
_TITLE = "lower(title)"
for _pattern in (T.ORDINALS, *T.YEARLY):
    _TITLE = f"regexp_replace({_TITLE}, '{_pattern}', ' ', 'g')"
_TITLE = f"list_filter(string_split_regex({_TITLE}, '[^a-z0-9]+'), lambda w: w <> '')"
_TEXT = f"array_to_string({_TOKENS}, ' ')"
_ALIKE = "({0} <> '' AND {1} <> '' AND 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) >= 0.8)"
#: Pairs of one course and day that are about one event, among tables ``ev`` (id, course_id, start_date, organizer, title, r: the order there).
_SAME = f"""prep AS (SELECT *, {_MINE.format("organizer")} AS mine, {_TITLE} AS words, {_TEXT.format("coalesce(organizer, '')")} AS org_text, {_TEXT.format("title")} AS title_text FROM ev),
  met AS (SELECT a.id AS a, b.id AS b, a.r AS ar, a.organizer IS NULL AS na, b.organizer IS NULL AS nb, a.org_text AS oa, b.org_text AS ob, a.title_text AS ta, b.title_text AS tb, a.words AS wa, b.words AS wb, a.mine AS ma, b.mine AS mb,
      a.organizer IS NOT NULL AND b.organizer IS NOT NULL AND (len(list_filter(a.words, lambda w: list_contains(a.mine, w) AND NOT list_contains(b.mine, w))) > 0 OR len(list_filter(b.words, lambda w: list_contains(b.mine, w) AND NOT list_contains(a.mine, w))) > 0) AS guarded
    FROM prep a JOIN prep b ON a.course_id = b.course_id AND a.start_date = b.start_date AND a.r < b.r),
  keyed AS (SELECT *, array_to_string(CASE WHEN guarded THEN wa ELSE list_filter(wa, lambda w: NOT list_contains(ma, w) AND NOT list_contains(mb, w)) END, ' ') AS ka, array_to_string(CASE WHEN guarded THEN wb ELSE list_filter(wb, lambda w: NOT list_contains(ma, w) AND NOT list_contains(mb, w)) END, ' ') AS kb FROM met),
  texts AS (SELECT *, {_TEXT.format("ka")} AS xa, {_TEXT.format("kb")} AS xb FROM keyed),
  same AS (SELECT a, b, ar FROM texts WHERE (na AND nb) OR (NOT na AND NOT nb AND {_ALIKE.format("oa", "ob")}) OR CASE WHEN ka = '' OR kb = '' THEN {_ALIKE.format("ta", "tb")} ELSE ka = kb OR {_ALIKE.format("xa", "xb")} END)"""


@plans.query(
    "event_clusters",
    f""", ev AS (SELECT o.id, o.course_id, o.start_date, s.name AS organizer, title, row_number() OVER (PARTITION BY o.course_id, o.start_date ORDER BY o.id % 3, -o.confidence, o.id) AS r FROM outings o LEFT JOIN organizers s ON o.organizer_id = s.id WHERE o.start_date IS NOT NULL), {_SAME},
      lk AS (SELECT b AS id, list(a ORDER BY ar) AS likes FROM same GROUP BY b),
      w AS (SELECT course_id, start_date, r, id, [id] AS leaders, id AS leader FROM ev WHERE r = 1
        UNION ALL SELECT e.course_id, e.start_date, e.r, e.id, CASE WHEN len(list_filter(w.leaders, lambda l: list_contains(coalesce(lk.likes, []), l))) = 0 THEN list_append(w.leaders, e.id) ELSE w.leaders END, coalesce(list_filter(w.leaders, lambda l: list_contains(coalesce(lk.likes, []), l))[1], e.id)
          FROM w JOIN ev e ON e.course_id = w.course_id AND e.start_date = w.start_date AND e.r = w.r + 1 LEFT JOIN lk ON lk.id = e.id)
      SELECT id AS event_id, leader FROM w""",
    ("outings", "organizers"),
)
def event_clusters(d: Directory) -> DataFrame:
    return K.cluster_events(_for_clusters(d))


_MONTH = "(CAST(substr({0}, 1, 4) AS INT) * 12 + CAST(substr({0}, 6, 2) AS INT))"


@plans.query(
    "claim_existing",
    f""", e AS (SELECT id AS event_id, course_id, organizer_id, coalesce(start_date, expected_month || '-15') AS day FROM outings WHERE id % 2 = 0),
      op AS (SELECT e.event_id, e.course_id, o.id AS outing_id, CASE WHEN o.status <> 'expected' THEN 0 ELSE abs({_MONTH.format("e.day")} - {_MONTH.format("o.expected_month")}) + 1 END AS gap FROM e JOIN outings o ON o.course_id = e.course_id AND o.organizer_id IS NOT DISTINCT FROM e.organizer_id
        AND CASE WHEN o.status <> 'expected' THEN o.start_date = e.day ELSE abs({_MONTH.format("e.day")} - {_MONTH.format("o.expected_month")}) <= 1 END),
      ev AS (SELECT event_id, course_id, options, row_number() OVER (PARTITION BY course_id ORDER BY event_id) AS r FROM (SELECT event_id, course_id, list(outing_id ORDER BY gap, outing_id) AS options FROM op GROUP BY 1, 2)),
      w AS (SELECT course_id, r, event_id, options[1] AS outing_id, [options[1]] AS taken FROM ev WHERE r = 1
        UNION ALL SELECT ev.course_id, ev.r, ev.event_id, list_filter(ev.options, lambda o: NOT list_contains(w.taken, o))[1], list_append(w.taken, list_filter(ev.options, lambda o: NOT list_contains(w.taken, o))[1]) FROM w JOIN ev ON ev.course_id = w.course_id AND ev.r = w.r + 1)
      SELECT event_id, outing_id FROM w WHERE outing_id IS NOT NULL""",
    ("outings",),
)
def claim_existing(d: Directory) -> DataFrame:
    day = F.coalesce("start_date", F.concat("expected_month", F.lit("-15")))
    events = d.outings.where("id % 2 = 0").select(F.col("id").alias("event_id"), "course_id", "organizer_id", day.alias("start_date"), F.col("id").alias("ord"))
    return K.claim_existing(events, d.outings)


_DIST = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lng - p.lng) / 2), 2))))"


@plans.query("nearest_city", f"SELECT point_id, city_id, round(km, 6) AS km FROM (SELECT p.id AS point_id, c.id AS city_id, {_DIST} AS km, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST}, c.id) AS rn FROM courses p JOIN cities c ON {_DIST} <= 30) WHERE rn = 1", ("courses", "cities"))
def nearest_city(d: Directory) -> DataFrame:
    points = d.courses.select(F.col("id").alias("point_id"), "lat", "lng", "state")
    return K.nearest_city(points, d.cities, km=30.0).select("point_id", "city_id", F.round("km", 6).alias("km"))


@plans.query("nearest_city_in_state", f"SELECT point_id, city_id FROM (SELECT p.id AS point_id, c.id AS city_id, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST}, c.id) AS rn FROM courses p JOIN cities c ON {_DIST} <= 50 AND p.state = c.state) WHERE rn = 1", ("courses", "cities"))
def nearest_city_in_state(d: Directory) -> DataFrame:
    points = d.courses.select(F.col("id").alias("point_id"), "lat", "lng", "state")
    return K.nearest_city(points, d.cities, km=50.0, same_state=True).select("point_id", "city_id")


@plans.query("place_centroids", "SELECT c.id AS place_id, round(coalesce(t.lat, z.lat), 6) AS lat FROM courses c LEFT JOIN cities t ON lower(t.name) = lower(c.city) AND t.state = c.state LEFT JOIN (SELECT ci.name, ci.state, avg(z.lat) AS lat FROM zips z JOIN cities ci ON z.city_id = ci.id GROUP BY 1, 2) z ON lower(z.name) = lower(c.city) AND z.state = c.state", ("courses", "cities", "zips"))
def place_centroids(d: Directory) -> DataFrame:
    places = d.courses.select(F.col("id").alias("place_id"), F.col("city").alias("name"), "state")
    return K.centroids(places, d.cities, d.zips).select("place_id", F.round("lat", 6).alias("lat"))


@plans.query("state_zones", "SELECT id, CASE state WHEN 'IL' THEN 'America/Chicago' WHEN 'NY' THEN 'America/New_York' ELSE 'America/Los_Angeles' END AS zone FROM courses", ("courses",))
def state_zones(d: Directory) -> DataFrame:
    known = F.create_map(F.lit("IL"), F.lit("America/Chicago"), F.lit("NY"), F.lit("America/New_York"))
    return d.courses.select("id", F.coalesce(F.try_element_at(known, F.col("state")), F.lit("America/Los_Angeles")).alias("zone"))


@plans.query("facility_pairs", f"SELECT p.id AS a, c.id AS b FROM courses p JOIN courses c ON p.state = c.state AND p.id < c.id AND {_DIST} <= 3 ", ("courses",))
def facility_pairs(d: Directory) -> DataFrame:
    """Courses within 3 km: distances are those of places, of which many courses may share one; only places of one state and neighbouring cells of a grid meet, and only near ones are told their courses."""
    cell = lambda x: F.floor(x / 0.05).cast("int")
    courses = d.courses.select("id", F.xxhash64("state", "lat", "lng").alias("place"), "state", "lat", "lng")
    courses = keep(courses.where("state is not null and lat is not null and lng is not null"))
    places = keep(courses.select("place", "state", "lat", "lng").distinct().withColumn("row", cell(F.col("lat"))).withColumn("col", cell(F.col("lng"))))
    near = places.select(F.col("place").alias("place_a"), "state", F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col")
    near = near.select("place_a", "state", "lat_a", "lng_a", "row", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col"))
    within = haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat"), F.col("lng")) <= F.lit(3.0)
    links = keep(near.join(places.withColumnRenamed("place", "place_b"), ["state", "row", "col"]).where("place_a <= place_b").where(within).select("place_a", "place_b"))
    first = dealt(courses.select(F.col("place").alias("place_a"), F.col("id").alias("a")))
    second = dealt(courses.select(F.col("place").alias("place_b"), F.col("id").alias("b")))
    return links.join(first, "place_a").join(second, "place_b").where("place_a < place_b or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# ---- selection


@plans.query("queue_merge", "SELECT url, min(priority) AS priority, arg_min(found_via, CAST(priority AS BIGINT) * 1000000000 + id) AS found_via, arg_min(outing_id, id) FILTER (WHERE outing_id IS NOT NULL) AS outing_id, max(bypass) AS bypass, min(id) AS ord FROM queue GROUP BY url", ("queue",))
def queue_merge(d: Directory) -> DataFrame:
    return C.merge_queue(d.queue.withColumnRenamed("id", "ord")).select("url", "priority", "found_via", "outing_id", "bypass", "ord")


@plans.query("first_wins", "SELECT url, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, id) AS rn FROM queue) WHERE rn = 1", ("queue",))
def first_wins(d: Directory) -> DataFrame:
    return C.first_wins(d.queue, ["url"], ["priority", "id"]).select("url", "id")


@plans.query("capped_selection")
def capped_selection(d: Directory) -> DataFrame:
    merged = C.merge_queue(d.queue.withColumnRenamed("id", "ord"))
    return C.capped_selection(merged, most=60, per_host=3, most_renders=8)


@plans.query("capped_prefix", "SELECT id, s <= 20000 AND rn <= 150 AS taken FROM (SELECT *, max(t) OVER (ORDER BY priority, id) AS s FROM (SELECT *, sum(chars) OVER (ORDER BY priority, id) AS t, row_number() OVER (ORDER BY priority, id) AS rn FROM queue))", ("queue",))
def capped_prefix(d: Directory) -> DataFrame:
    return C.capped_prefix(d.queue, ["priority", "id"], "id", most_rows=150, weight="chars", budget=20_000).select("id", "taken")


@plans.query("host_quota", "SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY host ORDER BY priority, id) AS rn FROM queue) WHERE rn <= 5", ("queue",))
def host_quota(d: Directory) -> DataFrame:
    return C.top_per_group(d.queue, ["host"], ["priority", "id"], 5).select("url")


@plans.query("not_seen", "SELECT DISTINCT q.url FROM queue q WHERE NOT EXISTS (SELECT 1 FROM queue s WHERE s.priority = 1 AND s.url = q.url)", ("queue",))
def not_seen(d: Directory) -> DataFrame:
    seen = d.queue.where("priority = 1").select("url")
    return d.queue.select("url").distinct().join(seen, "url", "left_anti")


@plans.query("metro_rotation", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY population DESC, id) - 1 AS place FROM cities) WHERE place % 7 = 3", ("cities",))
def metro_rotation(d: Directory) -> DataFrame:
    return C.rotation(d.cities, [F.col("population").desc(), "id"], 7, 3).select("id")


@plans.query("rotating_window", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY slug) - 1 AS place FROM cities) WHERE (place - 20 + 25) % 25 < 10", ("cities",))
def rotating_window(d: Directory) -> DataFrame:
    return C.rotating_window(d.cities, ["slug"], cap=10, run=2).select("id")


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(slug, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT))"


@plans.query("weekly_sources", f"SELECT id, {_FNV} AS hash, id % 4 = 0 OR {_FNV} % 7 = 10378 % 7 AS due FROM organizers", ("organizers",))
def weekly_sources(d: Directory) -> DataFrame:
    cadence = F.when(F.col("id") % 4 == 0, "daily").otherwise("weekly")
    return d.organizers.select("id", C.fnv1a(F.col("slug")).alias("hash"), C.due_tonight(F.col("slug"), cadence, 10_378).alias("due"))


@plans.query("insertion_positions", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type <> 'error') WHERE n >= 3 AND (n - 3) % 8 = 0 AND n < total")
def insertion_positions(d: Directory) -> DataFrame:
    shown = d.base("events").withColumn("shown", F.col("event_type") != "error")
    return C.insertion_positions(shown, ["user_id"], ["event_id"]).select("user_id", "event_id")


@plans.query("between_shown", "SELECT event_id FROM (SELECT *, max(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, max(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS s FROM events)) WHERE event_type = 'signup' AND a = 1 AND b = 1")
def between_shown(d: Directory) -> DataFrame:
    items = d.base("events").withColumn("shown", F.col("event_type").isin("view", "click")).withColumn("inserted", F.col("event_type") == "signup")
    return C.between_shown(items, ["user_id"], ["event_id"]).select("event_id")


@plans.query("top_metros", "SELECT id FROM cities ORDER BY population DESC, id LIMIT 10", ("cities",))
def top_metros(d: Directory) -> DataFrame:
    return d.cities.orderBy(F.col("population").desc(), "id").limit(10).select("id")


@plans.query("most_populous", "SELECT state, arg_max(id, population) AS id FROM cities GROUP BY state", ("cities",))
def most_populous(d: Directory) -> DataFrame:
    return d.cities.groupBy("state").agg(F.max_by("id", "population").alias("id"))


# ---- state


_PAGES = "SELECT page_id, url, html AS text, CASE WHEN page_id % 6 = 0 THEN 304 ELSE 200 END AS http_status FROM {0}"
_BEFORE = "SELECT url, {1} AS hash FROM {0} WHERE page_id % 4 <> 1"


@plans.query("change_detection", f"WITH p AS ({_PAGES.format('pages')}), q AS (SELECT url, min(CASE WHEN page_id % 2 = 0 THEN sha256(html) ELSE 'x' END) AS hash FROM pages WHERE page_id % 4 <> 1 GROUP BY url) SELECT page_id, CASE WHEN http_status = 304 THEN q.hash ELSE sha256(text) END AS hash, coalesce(q.hash = CASE WHEN http_status = 304 THEN q.hash ELSE sha256(text) END, FALSE) AS unchanged FROM p LEFT JOIN q ON p.url = q.url")
def change_detection(d: Directory) -> DataFrame:
    pages = d.base("pages")
    now = pages.select("page_id", "url", F.col("html").alias("text"), F.when(F.col("page_id") % 6 == 0, 304).otherwise(200).alias("http_status"))
    old = pages.where("page_id % 4 <> 1").groupBy("url").agg(F.min(F.when(F.col("page_id") % 2 == 0, F.sha2("html", 256)).otherwise("x")).alias("hash"))
    return S.page_changes(now, old).select("page_id", "hash", "unchanged")


_PAST = f"CAST(timezone(c.time_zone, timezone('UTC', TIMESTAMP '{NOW}')) AS DATE) > CAST(coalesce(o.end_date, o.start_date) AS DATE)"


@plans.query(
    "publish_decision",
    f"""SELECT o.id, CASE WHEN o.id % 31 = 0 THEN 'removed' WHEN o.status = 'expected' AND o.expected_month IS NULL THEN 'no_expected_month' WHEN o.status = 'expected' AND o.organizer_id IS NULL THEN 'no_organizer'
      WHEN o.status = 'expected' THEN 'expected' WHEN o.status = 'past' THEN 'past' WHEN o.start_date IS NULL THEN 'no_date' WHEN {_PAST} THEN 'past_date' WHEN o.confidence < 0.75 THEN 'low_confidence' ELSE 'dated' END AS why,
      CASE WHEN o.id % 31 = 0 THEN 0 WHEN o.status = 'expected' THEN CASE WHEN o.organizer_id IS NULL THEN 0 ELSE 1 END WHEN o.status = 'past' THEN o.published WHEN {_PAST} OR o.confidence < 0.75 THEN 0 ELSE 1 END AS publish,
      CASE WHEN o.id % 31 = 0 THEN 'removed' WHEN o.status = 'expected' THEN NULL WHEN o.status = 'past' THEN o.hold_reason WHEN {_PAST} THEN NULL WHEN o.confidence < 0.75 THEN 'low_confidence' END AS hold
      FROM outings o JOIN courses c ON o.course_id = c.id""",
    ("outings", "courses"),
)
def publish_decision(d: Directory) -> DataFrame:
    zones = d.courses.select(F.col("id").alias("course_id"), "time_zone")
    verdict = S.publish_decision(F.lit(NOW).cast("timestamp"), F.col("time_zone"), F.col("id") % 31 == 0)
    return d.outings.join(zones, "course_id").withColumn("v", verdict).select("id", "v.why", "v.publish", "v.hold")


#: Rules of listed platforms: one is not allowed, one has listing pages, one is a directory.
_RULES = [(0, "site7", False, "site7.org", None, False, None), (1, "site8", True, "site8.org", "^/e/[0-9]*8$", False, None), (2, "site9", True, "site9.org", None, True, "/E/[0-9]*59$"), (3, "late", False, "site8.org", None, False, None)]


def _verdicts(d: Directory, urls: DataFrame) -> DataFrame:
    rules = d.spark.createDataFrame(_RULES, "ord int, platform string, allowed boolean, domain string, listing_pattern string, directory boolean, event_pattern string")
    urls = urls.distinct()
    return N.platform_verdicts(urls.select(F.col("url").alias("page_id"), "url"), rules).withColumnRenamed("page_id", "url")


@plans.query(
    "publish_plan",
    f""", base AS (SELECT o.*, CASE WHEN o.id % 31 = 0 THEN 'removed' WHEN o.status = 'expected' AND o.expected_month IS NULL THEN 'no_expected_month' WHEN o.status = 'expected' AND o.organizer_id IS NULL THEN 'no_organizer'
        WHEN o.status = 'expected' THEN 'expected' WHEN o.status = 'past' THEN 'past' WHEN o.start_date IS NULL THEN 'no_date' WHEN {_PAST} THEN 'past_date' WHEN o.confidence < 0.75 THEN 'low_confidence' ELSE 'dated' END AS why FROM outings o JOIN courses c ON o.course_id = c.id),
      v AS (SELECT DISTINCT url, domain <> 'site7.org' AS allowed, (domain = 'site8.org' AND id % 10 = 8) OR (domain = 'site9.org' AND id % 100 <> 59) AS listing, domain = 'site9.org' AS directory FROM sources WHERE domain IN ('site7.org', 'site8.org', 'site9.org')),
      pages AS (SELECT outing_id AS id, url FROM source_outings l JOIN sources s ON s.id = l.source_id UNION ALL SELECT id, canonical_source_url FROM outings),
      blocked AS (SELECT p.id, min(CASE WHEN NOT coalesce(v.allowed, TRUE) OR coalesce(v.listing, FALSE) THEN 1 ELSE 0 END) AS b FROM pages p LEFT JOIN v ON v.url = p.url GROUP BY 1),
      j AS (SELECT base.*, CASE why WHEN 'expected' THEN 1 WHEN 'dated' THEN 1 WHEN 'past' THEN published ELSE 0 END AS p0, CASE why WHEN 'removed' THEN 'removed' WHEN 'past' THEN hold_reason WHEN 'no_expected_month' THEN 'no_date' WHEN 'no_date' THEN 'no_date' WHEN 'low_confidence' THEN 'low_confidence' END AS hold, coalesce(v.listing, FALSE) AS listing, coalesce(v.directory, FALSE) AS directory, b FROM base LEFT JOIN v ON v.url = canonical_source_url JOIN blocked ON blocked.id = base.id),
      k AS (SELECT *, CASE WHEN p0 = 1 THEN CASE WHEN listing THEN 'platform_listing' WHEN b = 1 THEN 'platform_not_allowed' WHEN directory THEN 'directory_page' END END AS veto FROM j),
      l AS (SELECT *, CASE WHEN veto IS NULL THEN p0 ELSE 0 END AS publish FROM k)
      SELECT id, publish, hold, coalesce(veto, why) AS why, publish <> published OR hold IS DISTINCT FROM hold_reason AS write, publish = 1 AND (published = 0 OR id % 5 = 0) AND status <> 'past' AS ping FROM l""",
    ("outings", "courses", "sources", "source_outings"),
)
def publish_plan(d: Directory) -> DataFrame:
    zones = d.courses.select(F.col("id").alias("course_id"), "time_zone")
    outings = d.outings.join(zones, "course_id")
    pages = d.source_outings.join(d.sources.select(F.col("id").alias("source_id"), "url"), "source_id").select("outing_id", "url")
    verdicts = _verdicts(d, d.sources.select("url").union(d.outings.select("canonical_source_url")))
    return W.publish_plan(outings, pages, verdicts, d.outings.where("id % 31 = 0"), d.outings.where("id % 5 = 0"), F.lit(NOW).cast("timestamp"), F.col("time_zone"))


_SIMILAR = f"SELECT DISTINCT array_to_string({_TOKENS.format('name')}, ' ') AS text FROM (SELECT p_name || ' ' || p_type || ' Inc.' AS name FROM part)"


@plans.query("similar_names", f"WITH t AS MATERIALIZED ({_SIMILAR}) SELECT a.text AS a, b.text AS b FROM t a JOIN t b ON a.text < b.text AND abs(length(a.text) - length(b.text)) <= 0.1 * greatest(length(a.text), length(b.text)) WHERE 1 - levenshtein(a.text, b.text) / CAST(greatest(length(a.text), length(b.text)) AS DOUBLE) >= 0.92")
def similar_names(d: Directory) -> DataFrame:
    text = F.array_join(T.name_tokens(F.concat("p_name", F.lit(" "), "p_type", F.lit(" Inc."))), " ").alias("text")
    names = d.base("part").select(text).distinct()
    return M.similar_texts(names.select(F.col("text").alias("a"), "text"), names.select(F.col("text").alias("b"), "text"), 0.92).where("a < b")


def _run(d: Directory) -> tuple[DataFrame, W.Tables, DataFrame]:
    """A run that read the pages of half of the outings again: their events are stored, have moved a day, have another organizer, or are new."""
    city = F.coalesce(F.regexp_replace("city", "[0-9_]+", ""), F.lit("Elsewhere"))
    places = d.courses.select(F.col("id").alias("course_id"), F.col("name").alias("course_name"), city.alias("city"))
    names = d.organizers.select(F.col("id").alias("organizer_id"), F.col("name").alias("_name"))
    kind = F.element_at(F.array(F.lit("organizer"), F.lit("listing"), F.lit("search")), (F.col("id") % 3 + 1).cast("int"))
    day = F.coalesce("start_date", F.concat("expected_month", F.lit("-15")))
    n = lambda k: F.col("id") % k == 0
    rows = d.outings.where("id % 2 = 0").join(places, "course_id").join(names, "organizer_id", "left")
    events = rows.select(
        F.col("id").alias("event_id"), F.col("id").alias("ord"), F.col("id").alias("source_id"), F.col("canonical_source_url").alias("url"), kind.alias("kind"), F.regexp_extract("canonical_source_url", "www[.]([^/]+)/", 1).alias("domain"), n(26).alias("excluded"),
        F.when(n(18), "low_confidence").alias("hold_reason"), "confidence", F.when(~n(38), F.col("course_id")).alias("course_id"), "course_name", F.when(n(14), F.date_add(day.cast("date"), 1).cast("string")).otherwise(day).alias("start_date"), "end_date",
        F.when(n(22), F.concat(F.lit("Friends of "), "city")).otherwise(F.col("_name")).alias("organizer"), F.lit(None).cast("string").alias("ein"), "title", "outing_type", "shotgun_time", "format", "single_price_cents", F.when(n(10), "unknown").otherwise(F.lit("open")).alias("status"),
    )
    organizers = d.organizers.select("id", "slug", "name", F.lit(None).cast("string").alias("ein"))
    tables = W.Tables(organizers, d.outings.select("id", "slug", "course_id", "published", *W.FIELDS), d.source_outings, d.sources.select("id", "hold_reason"))
    return W.unmatched_holds(events), tables, d.sources.where("id % 2 = 0 or id % 3 = 1").select(F.col("id").alias("source_id"))


@plans.query("write_plan")
def write_plan(d: Directory) -> DataFrame:
    """All changes of the plan, one row each; tests follow its rules event by event."""
    plan = W.write_plan(*_run(d), lambda url: url.rlike("/e/[0-9]*8$"), lambda url: F.regexp_extract(url, "www[.]([^/]+)/", 1))
    none = F.lit(None).cast("string")
    row = lambda df, table, op, key, other, text: df.select(F.lit(table).alias("target"), op.alias("op"), key.cast("long").alias("id"), other.cast("long").alias("other_id"), text.alias("value"))
    parts = [
        row(plan.organizers, "organizers", F.lit("insert"), F.col("id"), F.lit(None), F.col("slug")), row(plan.outings, "outings", F.col("op"), F.col("id"), F.col("organizer_id"), F.col("slug")), row(plan.links, "source_outings", F.lit("insert"), F.col("source_id"), F.col("outing_id"), none),
        row(plan.sources, "sources", F.lit("update"), F.col("id"), F.lit(None), F.col("hold_reason")), row(plan.outcomes, "outcomes", F.col("action"), F.col("event_id"), F.col("outing_id"), F.col("hold_reason")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@plans.query("confidence_scores", "SELECT event_id, (100 - CASE WHEN event_id % 3 = 0 THEN 30 ELSE 0 END - CASE WHEN event_id % 5 = 0 THEN 20 ELSE 0 END - CASE WHEN event_id % 7 = 0 THEN 20 ELSE 0 END - CASE WHEN event_id % 2 = 0 AND event_id % 11 <> 0 THEN 10 ELSE 0 END - CASE WHEN event_id % 13 = 0 THEN 20 ELSE 0 END) / 100.0e0 AS confidence FROM events")
def confidence_scores(d: Directory) -> DataFrame:
    m = lambda n: F.col("event_id") % n == 0
    return d.base("events").select("event_id", S.confidence(~m(3), ~m(5), ~m(7), ~m(2), m(11), m(13)).alias("confidence"))


@plans.query("merge_fields", "SELECT course_id, arg_min(single_price_cents, id) FILTER (WHERE single_price_cents IS NOT NULL) AS single_price_cents, arg_min(shotgun_time, id) FILTER (WHERE shotgun_time IS NOT NULL) AS shotgun_time, arg_min(format, id) FILTER (WHERE format IS NOT NULL) AS format, max(confidence) AS confidence FROM outings GROUP BY course_id", ("outings",))
def merge_fields(d: Directory) -> DataFrame:
    return S.merge_fields(d.outings, ["course_id"], ["id"], ["single_price_cents", "shotgun_time", "format"])


@plans.query(
    "snapshot_merge",
    """WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
      changes AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op, 'X' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 9 = 0)
    SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NOT NULL AND (c.op IS NULL OR c.op = 'insert') THEN b.status ELSE c.status END AS status, CASE WHEN b.id IS NOT NULL THEN b.price ELSE c.price END AS price
    FROM base b FULL OUTER JOIN changes c ON b.id = c.id WHERE c.op IS NULL OR c.op <> 'delete'""",
)
def snapshot_merge(d: Directory) -> DataFrame:
    o = d.base("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    op = F.when(F.col("id") % 4 == 0, "delete").when(F.col("id") % 4 == 1, "insert").otherwise("update")
    last = o.where("id % 2 = 0 or id % 9 = 0").select("id", op.alias("op"), F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), F.lit(2).alias("ord"))
    earlier = o.where("id % 2 = 0").select("id", F.lit("update").alias("op"), F.lit("W").alias("status"), (F.col("price") + 5).alias("price"), F.lit(1).alias("ord"))
    return S.upsert(o.where("id % 3 <> 0"), last.unionByName(earlier), "id", update=["status"])


@plans.query("retraction", "SELECT outing_id FROM source_outings l GROUP BY outing_id HAVING min(CASE WHEN source_id % 2 = 0 THEN 1 ELSE 0 END) = 1 AND outing_id % 8 <> 0", ("source_outings",))
def retraction(d: Directory) -> DataFrame:
    collected = d.sources.where("id % 2 = 0").select(F.col("id").alias("source_id"))
    produced = d.outings.where("id % 8 = 0").select(F.col("id").alias("outing_id"))
    return S.retracted(d.source_outings, collected, produced)


@plans.query(
    "roll_forward",
    f""", o AS (SELECT * FROM outings), over AS (SELECT *, strftime(CAST(substr(start_date, 1, 7) || '-01' AS DATE) + INTERVAL 12 MONTH, '%Y-%m') AS month FROM o WHERE status <> 'expected' AND coalesce(end_date, start_date) < '{TODAY}'),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, organizer_id, month ORDER BY start_date DESC, id) AS rn FROM over) WHERE rn = 1)
    SELECT id AS previous_id, month AS expected_month, replace(title, substr(start_date, 1, 4), CAST(CAST(substr(start_date, 1, 4) AS INT) + 1 AS VARCHAR)) AS title, CAST(CAST(substr(start_date, 1, 4) AS INT) + 1 AS VARCHAR) || substr(slug, 5) AS slug FROM b
    WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.course_id = b.course_id AND x.organizer_id IS NOT DISTINCT FROM b.organizer_id AND abs((CAST(substr(coalesce(x.start_date, x.expected_month), 1, 4) AS INT) * 12 + CAST(substr(coalesce(x.start_date, x.expected_month), 6, 2) AS INT)) - (CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT))) <= 1)""",
    ("outings",),
)
def roll_forward(d: Directory) -> DataFrame:
    return S.roll_forward(d.outings, TODAY).select("previous_id", "expected_month", "title", "slug")


@plans.query("source_misses", "SELECT id, CASE WHEN http_status IN (404, 410) THEN misses + 1 WHEN http_status = 304 OR http_status BETWEEN 200 AND 299 THEN 0 ELSE misses END AS misses, CASE WHEN http_status IN (404, 410) THEN misses + 1 WHEN http_status = 304 OR http_status BETWEEN 200 AND 299 THEN 0 ELSE misses END >= 2 AS gone FROM sources", ("sources",))
def source_misses(d: Directory) -> DataFrame:
    fetched = d.sources.select("id", U.outcome(F.col("http_status")).alias("outcome"))
    return S.source_misses(d.sources, fetched).select("id", "misses", "gone")


#: Slugs by taking turns, family by family (slugs that agree but for numbers at their ends), among tables ``wanted`` (ord, base) and ``taken`` (slug).
_STEM = "regexp_replace({0}, '(-[0-9]+)+$', '')"
_TURNS = f"""f AS (SELECT *, {_STEM.format("base")} AS family, row_number() OVER (PARTITION BY {_STEM.format("base")} ORDER BY ord) AS r FROM wanted),
  h AS (SELECT {_STEM.format("slug")} AS family, list(DISTINCT slug) AS slugs FROM taken GROUP BY 1),
  turns AS (SELECT f.family, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS slug, coalesce(h.slugs, CAST([] AS VARCHAR[])) AS gone FROM f LEFT JOIN h ON h.family = f.family WHERE f.r = 1
    UNION ALL SELECT family, r, ord, slug, list_append(gone, slug) FROM (SELECT f.family, f.r, CAST(f.ord AS BIGINT) AS ord, t.gone, list_filter(list_prepend(f.base, list_transform(range(2, len(t.gone) + 3), lambda n: f.base || '-' || CAST(n AS VARCHAR))), lambda s: NOT list_contains(t.gone, s))[1] AS slug FROM turns t JOIN f ON f.family = t.family AND f.r = t.r + 1))"""


@plans.query(
    "free_slugs",
    f"""WITH RECURSIVE wanted AS (SELECT p_partkey AS ord, replace(lower(p_name), ' ', '-') || CASE p_partkey % 11 WHEN 0 THEN '-2' WHEN 1 THEN '-3-2' ELSE '' END AS base FROM part),
      taken AS (SELECT replace(lower(p_name), ' ', '-') || CASE p_partkey % 10 WHEN 0 THEN '' ELSE '-3' END AS slug FROM part WHERE p_partkey % 5 = 0), {_TURNS}
      SELECT ord, slug FROM turns WHERE r > 0""",
)
def free_slugs(d: Directory) -> DataFrame:
    """Bases that end as another base's numbers do come to its slugs."""
    ending = F.when(F.col("p_partkey") % 11 == 0, "-2").when(F.col("p_partkey") % 11 == 1, "-3-2").otherwise("")
    wanted = d.base("part").select(F.concat(T.kebab(F.col("p_name")), ending).alias("base"), F.col("p_partkey").alias("ord"))
    taken = d.base("part").where("p_partkey % 5 = 0").select(F.concat(T.kebab(F.col("p_name")), F.when(F.col("p_partkey") % 10 == 0, "").otherwise("-3")).alias("slug")).distinct()
    return S.free_slugs(wanted, taken).select("ord", "slug")


_LATER = "strftime(CAST({0} || '-01' AS DATE) + INTERVAL {1} MONTH, '%Y-%m')"
#: Outings whose slugs are shared by many but for their numbers, and that were missed once already or not.
_CHECKED = "SELECT o.*, o.id % 2 AS expected_misses, substr(coalesce(o.start_date, o.expected_month), 1, 4) || '/event-' || CAST(o.id % 40 AS {text}) || CASE WHEN o.id % 7 = 0 THEN '-2' ELSE '' END AS shared_slug, c.time_zone FROM {outings} o JOIN {courses} c ON o.course_id = c.id"


@plans.query(
    "recheck_changes",
    f""", o AS ({_CHECKED.format(text="VARCHAR", outings="outings", courses="courses")}),
      alive AS (SELECT id, url FROM sources WHERE misses = 0 AND http_status < 400),
      alt AS (SELECT l.outing_id, min(a.url) AS next FROM source_outings l JOIN alive a ON a.id = l.source_id JOIN o ON o.id = l.outing_id AND a.url <> o.canonical_source_url GROUP BY 1),
      j AS (SELECT o.*, strftime(timezone(o.time_zone, timezone('UTC', TIMESTAMP '{NOW}')), '%Y-%m-%d') AS today, s.misses >= 2 AS gone, s.misses = 0 AND s.http_status < 400 AS up, alt.next FROM o LEFT JOIN sources s ON s.url = o.canonical_source_url LEFT JOIN alt ON alt.outing_id = o.id),
      k AS (SELECT *, status IN ('open', 'waitlist', 'sold_out', 'cancelled') AS dated, CASE WHEN gone THEN coalesce(next, canonical_source_url) ELSE canonical_source_url END AS url, CASE WHEN gone THEN CASE WHEN next IS NULL THEN 1 ELSE 0 END WHEN up THEN 0 ELSE source_gone END AS mark FROM j),
      l AS (SELECT *, coalesce(dated AND coalesce(end_date, start_date) < today, FALSE) AS over, coalesce(status = 'expected' AND coalesce(hold_reason, '') <> 'expected_stale' AND substr(today, 1, 7) > {_LATER.format("expected_month", 1)}, FALSE) AS missed FROM k),
      ended AS (SELECT *, {_LATER.format("substr(start_date, 1, 7)", 12)} AS month FROM l WHERE (over OR status = 'past') AND next_outing_id IS NULL AND organizer_id IS NOT NULL AND start_date IS NOT NULL),
      held AS (SELECT id, course_id, organizer_id, CASE WHEN status = 'expected' THEN expected_month WHEN dated THEN substr(start_date, 1, 7) END AS month FROM l),
      met AS (SELECT e.id, min(h.id) AS next_id FROM ended e JOIN held h ON h.course_id = e.course_id AND h.organizer_id = e.organizer_id AND h.id <> e.id AND h.month IS NOT NULL AND abs({_MONTH.format("h.month")} - {_MONTH.format("e.month")}) <= 1 GROUP BY 1),
      fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, organizer_id, month ORDER BY id) AS rn FROM ended WHERE id NOT IN (SELECT id FROM met) AND NOT {_LATER.format("month", 1)} < substr(today, 1, 7)) WHERE rn = 1),
      wanted AS (SELECT id AS ord, CAST(CAST(substr(start_date, 1, 4) AS INT) + 1 AS VARCHAR) || substr(shared_slug, 5) AS base FROM fresh), taken AS (SELECT shared_slug AS slug FROM o), {_TURNS}
      SELECT l.id, 'update' AS op, NULL AS previous_id, CASE WHEN over THEN 'past' ELSE status END AS status, url AS canonical_source_url, mark AS source_gone, CASE WHEN missed AND expected_misses = 0 THEN {_LATER.format("expected_month", 12)} ELSE expected_month END AS expected_month,
        CASE WHEN missed THEN expected_misses + 1 ELSE expected_misses END AS expected_misses, CASE WHEN missed AND expected_misses > 0 THEN 0 ELSE published END AS published, CASE WHEN missed AND expected_misses > 0 THEN 'expected_stale' ELSE hold_reason END AS hold_reason, coalesce(met.next_id, next_outing_id) AS next_outing_id, NULL AS slug, NULL AS title
      FROM l LEFT JOIN met ON met.id = l.id WHERE over OR missed OR met.next_id IS NOT NULL OR url <> canonical_source_url OR mark <> source_gone
      UNION ALL SELECT NULL, 'insert', f.id, 'expected', url, 0, month, 0, 0, NULL, NULL, t.slug, replace(title, substr(start_date, 1, 4), CAST(CAST(substr(start_date, 1, 4) AS INT) + 1 AS VARCHAR)) FROM fresh f JOIN turns t ON t.ord = f.id""",
    ("outings", "courses", "sources", "source_outings"),
)
def recheck_changes(d: Directory) -> DataFrame:
    outings = d.spark.sql(_CHECKED.format(text="STRING", outings="{outings}", courses="{courses}"), outings=d.outings, courses=d.courses).drop("slug").withColumnRenamed("shared_slug", "slug")
    return S.recheck(outings, d.sources, d.source_outings, F.lit(NOW).cast("timestamp"), F.col("time_zone"))


@plans.query("queue_bookkeeping", "SELECT id AS url, CASE WHEN http_status % 100 = 1 THEN 'keep' WHEN http_status = 304 OR http_status IN (404, 410, 200) THEN 'done' WHEN misses + 1 >= 3 THEN 'given_up' ELSE 'retry' END AS what FROM sources", ("sources",))
def queue_bookkeeping(d: Directory) -> DataFrame:
    queue = d.sources.select(F.col("id").alias("url"), F.col("misses").alias("tries"))
    results = d.sources.where("http_status <> 301").select(F.col("id").alias("url"), U.outcome(F.col("http_status")).alias("outcome"))
    return S.queue_bookkeeping(queue, results).select("url", "what")


@plans.query("override_merge", "SELECT id, course_type, 'existing' AS origin FROM courses WHERE id % 3 = 0 UNION ALL SELECT id, 'public', 'generated' FROM courses WHERE id % 2 = 0 AND id % 3 <> 0", ("courses",))
def override_merge(d: Directory) -> DataFrame:
    existing = d.courses.where("id % 3 = 0").select("id", "course_type", F.lit("existing").alias("origin"))
    generated = d.courses.where("id % 2 = 0").select("id", F.lit("public").alias("course_type"), F.lit("generated").alias("origin"))
    return existing.unionByName(generated.join(existing, "id", "left_anti"))


@plans.query("recently_fetched", f"SELECT id FROM sources WHERE last_fetched > TIMESTAMP '{NOW}' - INTERVAL 7 DAY", ("sources",))
def recently_fetched(d: Directory) -> DataFrame:
    return d.sources.where(F.col("last_fetched") > F.lit(NOW).cast("timestamp") - F.expr("interval 7 days")).select("id")


@plans.query("previous_hashes", "SELECT id, sha256(url) AS hash FROM sources WHERE extractor_version = 'extract-v2'", ("sources",))
def previous_hashes(d: Directory) -> DataFrame:
    return d.sources.where(F.col("extractor_version").rlike("^extract-v2$")).select("id", F.sha2("url", 256).alias("hash"))


@plans.query("recheck_candidates", "SELECT o.id, c.time_zone, s.id AS source_id FROM outings o JOIN courses c ON o.course_id = c.id LEFT JOIN sources s ON s.url = o.canonical_source_url WHERE o.published = 1", ("outings", "courses", "sources"))
def recheck_candidates(d: Directory) -> DataFrame:
    c = d.courses.select(F.col("id").alias("course_id"), "time_zone")
    s = d.sources.select(F.col("url").alias("canonical_source_url"), F.col("id").alias("source_id"))
    return d.outings.where("published = 1").join(c, "course_id").join(s, "canonical_source_url", "left").select("id", "time_zone", "source_id")


@plans.query("outing_sources", "SELECT l.outing_id, count(*) AS n, string_agg(s.url, ' ' ORDER BY s.url) AS urls FROM source_outings l JOIN sources s ON l.source_id = s.id JOIN outings o ON o.id = l.outing_id GROUP BY 1", ("source_outings", "sources", "outings"))
def outing_sources(d: Directory) -> DataFrame:
    s = d.sources.select(F.col("id").alias("source_id"), "url")
    linked = d.source_outings.join(s, "source_id").join(d.outings.select(F.col("id").alias("outing_id")), "outing_id", "left_semi")
    return linked.groupBy("outing_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("url")), " ").alias("urls"))


@plans.query("linked_outings", "SELECT outing_id FROM source_outings WHERE source_id IN (SELECT id FROM sources WHERE domain = 'site7.org') UNION SELECT id FROM outings WHERE canonical_source_url IN (SELECT url FROM sources WHERE domain = 'site7.org')", ("source_outings", "sources", "outings"))
def linked_outings(d: Directory) -> DataFrame:
    mine = d.sources.where("domain = 'site7.org'")
    a = d.source_outings.join(mine.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("outing_id")
    b = d.outings.join(mine.select(F.col("url").alias("canonical_source_url")), "canonical_source_url", "left_semi").select(F.col("id").alias("outing_id"))
    return a.union(b).distinct()


# ---- reports


@plans.query("hold_counts", "SELECT hold_reason, count(*) AS n, 'source' AS what FROM sources WHERE hold_reason IS NOT NULL GROUP BY 1 UNION ALL SELECT hold_reason, count(*), 'outing' FROM outings WHERE hold_reason IS NOT NULL GROUP BY 1", ("sources", "outings"))
def hold_counts(d: Directory) -> DataFrame:
    return R.holds(d.sources, d.outings)


@plans.query("month_spend", "SELECT CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cents FROM runs WHERE strftime(started_at, '%Y-%m') = '2024-01' AND id <> 5", ("runs",))
def month_spend(d: Directory) -> DataFrame:
    return R.month_spend(d.runs, "2024-01", without=5)


@plans.query("published_counts", f"SELECT CAST(sum(CASE WHEN published = 1 THEN 1 ELSE 0 END) AS BIGINT) AS published, CAST(sum(CASE WHEN published = 1 AND start_date >= '{TODAY}' THEN 1 ELSE 0 END) AS BIGINT) AS later, count(DISTINCT CASE WHEN published = 1 THEN c.state END) AS states FROM outings o JOIN courses c ON o.course_id = c.id", ("outings", "courses"))
def published_counts(d: Directory) -> DataFrame:
    rows = d.outings.join(d.courses.select(F.col("id").alias("course_id"), "state"), "course_id")
    shown = F.col("published") == 1
    return rows.agg(F.count_if(shown).alias("published"), F.count_if(shown & (F.col("start_date") >= TODAY)).alias("later"), F.countDistinct(F.when(shown, F.col("state"))).alias("states"))


@plans.query("weekly_runs", "SELECT kind, count(*) AS runs, count(*) FILTER (WHERE finished_at IS NULL) AS unfinished, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(extractions) AS BIGINT) AS extractions, CAST(sum(fetches) AS BIGINT) AS fetches, CAST(sum(cost_cents) AS BIGINT) AS cents FROM runs WHERE started_at > TIMESTAMP '2024-01-03 00:00:00' AND started_at <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY kind", ("runs",))
def weekly_runs(d: Directory) -> DataFrame:
    return R.weekly(d.runs.where(R.in_window("started_at", "2024-01-03 00:00:00", "2024-01-10 00:00:00")))


@plans.query("cap_hits", "SELECT cap, count(*) AS runs FROM (SELECT id, unnest(CASE id % 4 WHEN 0 THEN ['fetches', 'renders'] WHEN 1 THEN ['queries'] ELSE [] END) AS cap FROM runs) GROUP BY cap", ("runs",))
def cap_hits(d: Directory) -> DataFrame:
    return R.cap_hits(d.runs)


@plans.query("pending_run", "SELECT arg_max(id, started_at) AS id, max(started_at) AS started_at FROM runs WHERE id % 5 = 1", ("runs",))
def pending_run(d: Directory) -> DataFrame:
    return R.latest_with(d.runs, "nightly")


@plans.query("completed_states", "SELECT part FROM (VALUES ('NY'), ('NJ')) t(part)")
def completed_states(d: Directory) -> DataFrame:
    return R.completed_parts(d.runs, "courses")


@plans.query("error_rate", "SELECT count(*) AS fetches, count(*) FILTER (WHERE http_status >= 400 AND http_status NOT IN (404, 410)) AS errors, count(*) FILTER (WHERE http_status >= 400 AND http_status NOT IN (404, 410)) / CAST(count(*) AS DOUBLE) AS rate, count(*) FILTER (WHERE http_status >= 400 AND http_status NOT IN (404, 410)) / CAST(count(*) AS DOUBLE) > 0.2 AS high FROM sources", ("sources",))
def error_rate(d: Directory) -> DataFrame:
    return R.error_rate(d.sources.select(U.outcome(F.col("http_status")).alias("outcome")))


@plans.query("counter_merge", "SELECT event_type AS name, CAST(count(*) + sum(event_id) AS BIGINT) AS n FROM events GROUP BY 1")
def counter_merge(d: Directory) -> DataFrame:
    e = d.base("events")
    a = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return R.counters([a, e.groupBy(F.col("event_type").alias("name")).agg(F.sum("event_id").alias("n"))])
