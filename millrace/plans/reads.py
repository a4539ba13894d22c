"""The read queries of the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_MILE, box_around
from ..functions.text import kebab
from ..operators import listing as L
from ..sources.directory import TODAY, Directory
from .core import Plans

plans = Plans()
ROWS = ("courses", "organizers", "outings")
_ALL = """, rows AS (
  SELECT o.*, c.slug AS course_slug, c.name AS course_name, c.city, c.state, c.lat, c.lng, c.course_type, g.slug AS organizer_slug, g.name AS organizer_name, g.charity_status
  FROM outings o JOIN courses c ON o.course_id = c.id LEFT JOIN organizers g ON o.organizer_id = g.id)"""
_LISTED = "('open', 'waitlist', 'sold_out', 'cancelled')"
_UP = f"published = 1 AND status IN {_LISTED} AND coalesce(end_date, start_date) >= '{TODAY}'"
_INDEX = f"published = 1 AND (status = 'expected' OR coalesce(end_date, start_date) >= '{int(TODAY[:4]) - 1}{TODAY[4:]}')"
_CENTRE = (41.0, -74.0)
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(lat - 41.0) / 2), 2) + cos(radians(41.0)) * cos(radians(lat)) * power(sin(radians(lng + 74.0) / 2), 2))))"
_LABEL = """CASE outing_type WHEN 'charity' THEN CASE WHEN charity_status = '501c3' THEN 'Charity' ELSE 'Fundraiser, charity status unverified' END
  WHEN 'school_fundraiser' THEN 'School fundraiser' WHEN 'business_association' THEN 'Trade group outing' WHEN 'access_day' THEN 'Access day'
  WHEN 'open_tournament' THEN 'Open tournament' WHEN 'pro_am' THEN 'Pro-am' WHEN 'other' THEN 'Golf outing' END"""
CARD = ["id", "slug", "title", "start_date", "shotgun_time", "state", "city", "course_name", "organizer_name", "label"]
_CARD = f"id, slug, title, start_date, shotgun_time, state, city, course_name, organizer_name, {_LABEL} AS label"
_BY_DATE = "start_date NULLS FIRST, shotgun_time NULLS FIRST, title, id"


def rows(d: Directory) -> DataFrame:
    return L.joined(d.outings, d.courses, d.organizers)


def reading(name: str, body: str):
    """A query whose oracle reads the joined ``rows``."""

    return plans.query(name, _ALL + " " + body, ROWS)


@reading("upcoming_list", f"SELECT {_CARD} FROM rows WHERE {_UP}")
def upcoming_list(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY).select(*CARD)


FACETS = L.Facets(state="ny", course_types=("private", "public"), charity_only=True, max_price_cents=40_000, start_from="1998-07-01", start_to="1999-06-30")
_FACETS = "state = 'NY' AND course_type IN ('private', 'public') AND outing_type IN ('charity', 'school_fundraiser') AND single_price_cents <= 40000 AND start_date BETWEEN '1998-07-01' AND '1999-06-30'"


@reading("faceted_list", f"SELECT {_CARD} FROM rows WHERE {_UP} AND {_FACETS}")
def faceted_list(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, FACETS).select(*CARD)


@reading("faceted_list_top", f"SELECT {_CARD} FROM rows WHERE {_UP} AND format = 'scramble' AND single_price_cents IS NOT NULL AND id <> 6 ORDER BY {_BY_DATE} LIMIT 25")
def faceted_list_top(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(format="scramble", singles_welcome=True, exclude_id=6), limit=25).select(*CARD)


@reading("upcoming_by_state", f"SELECT {_CARD} FROM rows WHERE {_UP} AND state = 'NJ'")
def upcoming_by_state(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(state="nj")).select(*CARD)


@reading("upcoming_by_city", f"SELECT {_CARD} FROM rows WHERE {_UP} AND state = 'NJ' AND lower(city) = 'nation 6'")
def upcoming_by_city(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(state="NJ", city="Nation 6")).select(*CARD)


@reading("upcoming_by_course", f"SELECT {_CARD} FROM rows WHERE {_UP} AND course_id = 77")
def upcoming_by_course(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(course_id=77)).select(*CARD)


@reading("upcoming_by_organizer", f"SELECT {_CARD} FROM rows WHERE {_UP} AND organizer_id = 3")
def upcoming_by_organizer(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(organizer_id=3)).select(*CARD)


@reading("expected_list", f"SELECT {_CARD}, expected_month FROM rows WHERE published = 1 AND status = 'expected'")
def expected_list(d: Directory) -> DataFrame:
    return L.list_expected(rows(d)).select(*CARD, "expected_month")


@reading("expected_by_state", f"SELECT {_CARD}, expected_month FROM rows WHERE published = 1 AND status = 'expected' AND state = 'PA' ORDER BY expected_month NULLS FIRST, start_date NULLS FIRST, title, id LIMIT 40")
def expected_by_state(d: Directory) -> DataFrame:
    return L.list_expected(rows(d), L.Facets(state="PA"), limit=40).select(*CARD, "expected_month")


@reading("course_history", f"SELECT {_CARD}, coalesce(start_date, expected_month || '-01') AS day FROM rows WHERE published = 1 AND course_id = 77")
def course_history(d: Directory) -> DataFrame:
    return L.history(rows(d), F.col("course_id") == 77).select(*CARD, "day")


@reading("organizer_history", f"SELECT {_CARD}, coalesce(start_date, expected_month || '-01') AS day FROM rows WHERE published = 1 AND organizer_id = 3")
def organizer_history(d: Directory) -> DataFrame:
    return L.history(rows(d), F.col("organizer_id") == 3).select(*CARD, "day")


@reading("box_top", f"SELECT {_CARD} FROM rows WHERE {_UP} AND lat BETWEEN 40.5 AND 41.5 AND lng BETWEEN -74.5 AND -73.5 ORDER BY {_BY_DATE} LIMIT 200")
def box_top(d: Directory) -> DataFrame:
    return L.list_upcoming(rows(d), TODAY, L.Facets(box=(40.5, 41.5, -74.5, -73.5)), limit=L.MAX_RESULTS).select(*CARD)


@reading("radius_nearest", f"SELECT {_CARD}, round({_KM}, 6) AS km FROM rows WHERE {_UP} AND {_KM} <= 80 ORDER BY {_KM}, {_BY_DATE} LIMIT 50")
def radius_nearest(d: Directory) -> DataFrame:
    return L.nearby(rows(d), *_CENTRE, 80.0, TODAY, limit=50).select(*CARD, F.round("distance_km", 6).alias("km"))


@reading("count_by_state", f"SELECT state, count(*) AS n FROM rows WHERE {_UP} GROUP BY state")
def count_by_state(d: Directory) -> DataFrame:
    return rows(d).where(L.upcoming(TODAY)).groupBy("state").agg(F.count("*").alias("n")).orderBy("state")


@reading("count_by_city", f"SELECT city, count(*) AS n FROM rows WHERE {_UP} AND state = 'NY' AND city IS NOT NULL GROUP BY city")
def count_by_city(d: Directory) -> DataFrame:
    return rows(d).where(L.upcoming(TODAY) & (F.col("state") == "NY") & F.col("city").isNotNull()).groupBy("city").agg(F.count("*").alias("n")).orderBy("city")


@reading("outing_by_slug", f"SELECT {_CARD}, course_id, organizer_id, confidence FROM rows WHERE published = 1 AND slug IN (SELECT slug FROM outings WHERE id = 42)")
def outing_by_slug(d: Directory) -> DataFrame:
    slug = d.outings.where("id = 42").select("slug")
    return rows(d).where("published = 1").join(slug, "slug", "left_semi").limit(1).select(*CARD, "course_id", "organizer_id", "confidence")


@reading("next_outings", "SELECT a.id, b.id AS next_id, b.slug AS next_slug FROM rows a JOIN rows b ON a.next_outing_id = b.id AND b.published = 1")
def next_outings(d: Directory) -> DataFrame:
    following = d.outings.where("published = 1").select(F.col("id").alias("next_outing_id"), F.col("slug").alias("next_slug"))
    return d.outings.join(following, "next_outing_id").select("id", F.col("next_outing_id").alias("next_id"), "next_slug")


@plans.query("course_lookup", "SELECT id, slug, name, outing_count FROM courses WHERE outing_count >= 1 AND slug LIKE 'ny/%'", ("courses",))
def course_lookup(d: Directory) -> DataFrame:
    return d.courses.where((F.col("outing_count") >= 1) & F.col("slug").startswith("ny/")).select("id", "slug", "name", "outing_count")


@plans.query("organizer_exists", "SELECT id, slug, name FROM organizers g WHERE EXISTS (SELECT 1 FROM outings o WHERE o.organizer_id = g.id AND o.published = 1)", ("organizers", "outings"))
def organizer_exists(d: Directory) -> DataFrame:
    published = d.outings.where("published = 1").select(F.col("organizer_id").alias("id"))
    return d.organizers.join(published, "id", "left_semi").select("id", "slug", "name")


@plans.query("resolve_known_city", "SELECT id, slug, name, state, population FROM cities WHERE state = 'NJ' AND slug = 'nation-6'", ("cities",))
def resolve_known_city(d: Directory) -> DataFrame:
    return L.resolve_city(d.cities, d.courses, "nj", "nation-6", kebab).select("id", "slug", "name", "state", "population")


@plans.query("resolve_course_city", "SELECT CAST(NULL AS INTEGER) AS id, 'st-elsewhere' AS slug, city AS name, 'NY' AS state, 0 AS population, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM courses WHERE state = 'NY' AND city = 'St. Elsewhere' GROUP BY city", ("courses",))
def resolve_course_city(d: Directory) -> DataFrame:
    found = L.resolve_city(d.cities, d.courses, "ny", "st-elsewhere", kebab)
    return found.select("id", "slug", "name", "state", "population", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_CENTRES = f"(SELECT state, city, avg(lat) AS lat, avg(lng) AS lng FROM rows WHERE {_INDEX} AND city IS NOT NULL AND lat BETWEEN {{0}} AND {{1}} AND lng BETWEEN {{2}} AND {{3}} GROUP BY state, city)".format(*box_around(*_CENTRE, 60))


@reading("nearby_cities", f"SELECT state, city, round({_KM}, 6) AS km FROM {_CENTRES} WHERE {_KM} <= 60 ORDER BY {_KM}, state, city LIMIT 8")
def nearby_cities(d: Directory) -> DataFrame:
    return L.nearby_cities(rows(d), *_CENTRE, TODAY).select("state", "city", F.round("distance_km", 6).alias("km"))


@plans.query("zip_lookup", "SELECT z.zip, z.lat, z.lng, c.name AS city, c.state FROM zips z LEFT JOIN cities c ON z.city_id = c.id WHERE z.zip = '00005'", ("zips", "cities"))
def zip_lookup(d: Directory) -> DataFrame:
    return L.zip_lookup(d.zips, d.cities, "00005")


@plans.query("all_zips", "SELECT z.zip, c.name AS city, c.state FROM zips z LEFT JOIN cities c ON z.city_id = c.id", ("zips", "cities"))
def all_zips(d: Directory) -> DataFrame:
    c = d.cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"), "state")
    return d.zips.join(c, "city_id", "left").select("zip", "city", "state")


@plans.query("prefix_search", "SELECT slug, name, state FROM cities WHERE lower(name) LIKE 'nation 1%' ORDER BY population DESC, name LIMIT 10", ("cities",))
def prefix_search(d: Directory) -> DataFrame:
    return L.search_cities(d.cities, " Nation 1%").select("slug", "name", "state")


_SITEMAP = f"""SELECT kind, path, max(lastmod) AS lastmod FROM (
  SELECT 'outings' AS kind, '/outings/' || slug AS path, updated_at AS lastmod FROM rows WHERE published = 1 AND source_gone = 0
  UNION ALL SELECT 'courses', '/courses/' || slug, updated_at FROM courses WHERE outing_count >= 1
  UNION ALL SELECT 'organizers', '/organizers/' || organizer_slug, updated_at FROM rows WHERE published = 1 AND organizer_slug IS NOT NULL
  UNION ALL SELECT 'cities', '/golf-outings/' || lower(state) || '/' || trim(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '-'), updated_at FROM rows WHERE {_INDEX} AND city IS NOT NULL
  UNION ALL SELECT 'charity_cities', '/charity-golf-tournaments/' || lower(state) || '/' || trim(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '-'), updated_at FROM rows WHERE {_INDEX} AND city IS NOT NULL AND outing_type IN ('charity', 'school_fundraiser')
  UNION ALL SELECT 'states', '/golf-outings/' || lower(state), updated_at FROM rows WHERE ({_UP}) OR (published = 1 AND status = 'expected')
  UNION ALL SELECT 'all_states', '/states/' || lower(state), updated_at FROM rows WHERE published = 1) GROUP BY kind, path"""


def sitemap(d: Directory) -> DataFrame:
    """Every page of the sitemap: kind, path and last change."""
    r = rows(d)
    city = F.concat(F.lower("state"), F.lit("/"), kebab(F.col("city")))
    parts = [
        r.where("published = 1 and source_gone = 0").select(F.lit("outings").alias("kind"), F.concat(F.lit("/outings/"), "slug").alias("path"), "updated_at"),
        d.courses.where("outing_count >= 1").select(F.lit("courses").alias("kind"), F.concat(F.lit("/courses/"), "slug").alias("path"), "updated_at"),
        r.where("published = 1 and organizer_slug is not null").select(F.lit("organizers").alias("kind"), F.concat(F.lit("/organizers/"), "organizer_slug").alias("path"), "updated_at"),
        r.where(L.indexable(TODAY) & F.col("city").isNotNull()).select(F.lit("cities").alias("kind"), F.concat(F.lit("/golf-outings/"), city).alias("path"), "updated_at"),
        r.where(L.indexable(TODAY) & F.col("city").isNotNull() & F.col("outing_type").isin(*L.CHARITY_TYPES)).select(F.lit("charity_cities").alias("kind"), F.concat(F.lit("/charity-golf-tournaments/"), city).alias("path"), "updated_at"),
        r.where(L.upcoming(TODAY) | L.expected()).select(F.lit("states").alias("kind"), F.concat(F.lit("/golf-outings/"), F.lower("state")).alias("path"), "updated_at"),
        r.where("published = 1").select(F.lit("all_states").alias("kind"), F.concat(F.lit("/states/"), F.lower("state")).alias("path"), "updated_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "path").agg(F.max("updated_at").alias("lastmod"))


@reading("sitemap", _SITEMAP)
def sitemap_query(d: Directory) -> DataFrame:
    return sitemap(d)


@reading("sitemap_files", f"SELECT kind, CAST((rn - 1) // 500 AS BIGINT) AS file, count(*) AS urls, max(lastmod) AS lastmod FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS rn FROM ({_SITEMAP})) GROUP BY 1, 2")
def sitemap_files(d: Directory) -> DataFrame:
    return L.in_files(sitemap(d), ("path",), per_file=500).groupBy("kind", "file").agg(F.count("*").alias("urls"), F.max("lastmod").alias("lastmod"))


@reading("city_indexable", f"SELECT state, lower(city) AS city, count(*) > 0 AS listed, count(*) FILTER (WHERE outing_type IN ('charity', 'school_fundraiser')) > 0 AS charity FROM rows WHERE {_INDEX} AND city IS NOT NULL GROUP BY 1, 2")
def city_indexable(d: Directory) -> DataFrame:
    cities = rows(d).where(L.indexable(TODAY) & F.col("city").isNotNull()).groupBy("state", F.lower("city").alias("city"))
    return cities.agg((F.count("*") > 0).alias("listed"), (F.count_if(F.col("outing_type").isin(*L.CHARITY_TYPES)) > 0).alias("charity"))


@reading("labels", f"SELECT outing_type, charity_status, {_LABEL} AS label, count(*) AS n FROM rows GROUP BY 1, 2, 3")
def labels(d: Directory) -> DataFrame:
    return rows(d).groupBy("outing_type", "charity_status", "label").agg(F.count("*").alias("n"))


@reading("page_filter", f"SELECT id FROM rows WHERE {_UP} AND {_KM} / 1.609344 <= 50 AND single_price_cents <= 30000 AND course_type IN ('private', 'resort')")
def page_filter(d: Directory) -> DataFrame:
    miles = L.haversine_km(F.lit(_CENTRE[0]), F.lit(_CENTRE[1]), F.col("lat"), F.col("lng")) / KM_PER_MILE
    return rows(d).where(L.upcoming(TODAY) & L.matches_filters(50, miles, 30_000, ("private", "resort"))).select("id")


@reading("month_groups", f"SELECT month, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY start_date NULLS FIRST, id) AS ids FROM (SELECT *, CASE WHEN status = 'expected' THEN 'expected' ELSE substr(start_date, 1, 7) END AS month FROM rows WHERE state = 'NY' AND (({_UP}) OR (published = 1 AND status = 'expected'))) GROUP BY month")
def month_groups(d: Directory) -> DataFrame:
    month = F.when(F.col("status") == "expected", "expected").otherwise(F.substring("start_date", 1, 7))
    shown = rows(d).where((F.col("state") == "NY") & (L.upcoming(TODAY) | L.expected())).withColumn("month", month)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_date", "id"))), lambda x: x["id"].cast("string")), ",")
    return shown.groupBy("month").agg(F.count("*").alias("n"), ids.alias("ids"))


@reading("geojson", f"SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat, title, {_LABEL} AS label, round({_KM} / 1.609344, 1) AS miles FROM rows WHERE {_UP} AND {_KM} <= 50 * 1.609344 ORDER BY {_KM}, {_BY_DATE} LIMIT 200")
def geojson(d: Directory) -> DataFrame:
    near = L.nearby(rows(d), *_CENTRE, 50 * KM_PER_MILE, TODAY, limit=L.MAX_RESULTS)
    return near.select("id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "title", "label", F.round(F.col("distance_km") / KM_PER_MILE, 1).alias("miles"))


@reading("page_split", f"SELECT id, CASE WHEN {_UP} THEN 'upcoming' WHEN status = 'expected' THEN 'expected' ELSE 'past' END AS part FROM rows WHERE published = 1")
def page_split(d: Directory) -> DataFrame:
    part = F.when(L.upcoming(TODAY), "upcoming").when(F.col("status") == "expected", "expected").otherwise("past")
    return rows(d).where("published = 1").select("id", part.alias("part"))


@reading("national_hub", f"""SELECT coalesce(u.state, e.state) AS state, coalesce(u.n, 0) AS upcoming, coalesce(e.n, 0) AS expected FROM
  (SELECT state, count(*) AS n FROM rows WHERE {_UP} GROUP BY state) u FULL OUTER JOIN
  (SELECT state, count(*) AS n FROM (SELECT * FROM rows WHERE published = 1 AND status = 'expected' ORDER BY expected_month NULLS FIRST, start_date NULLS FIRST, title, id LIMIT 500) GROUP BY state) e ON u.state = e.state""")
def national_hub(d: Directory) -> DataFrame:
    now = rows(d).where(L.upcoming(TODAY)).groupBy("state").agg(F.count("*").alias("u"))
    later = L.list_expected(rows(d), limit=500).groupBy("state").agg(F.count("*").alias("e"))
    return now.join(later, "state", "full").select("state", F.coalesce("u", F.lit(0)).alias("upcoming"), F.coalesce("e", F.lit(0)).alias("expected"))


@reading("detail_nearby", f"""SELECT id, round(km, 6) AS km FROM (SELECT r.*, 2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(r.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(r.lat)) * power(sin(radians(r.lng - x.lng) / 2), 2)))) AS km
  FROM rows r, (SELECT lat, lng FROM rows WHERE id = 42) x WHERE r.id <> 42) WHERE {_UP} AND km <= 100 * 1.609344 ORDER BY km, {_BY_DATE} LIMIT 5""")
def detail_nearby(d: Directory) -> DataFrame:
    here = rows(d).where("id = 42").select("lat", "lng").first()
    return L.nearby(rows(d), here.lat, here.lng, 100 * KM_PER_MILE, TODAY, L.Facets(exclude_id=42), limit=5).select("id", F.round("distance_km", 6).alias("km"))


@reading("list_description", f"""SELECT count(*) AS n, (SELECT string_agg(course_name, ', ' ORDER BY first) FROM (SELECT course_name, min(rn) AS first FROM ranked GROUP BY course_name ORDER BY first LIMIT 3)) AS courses
  FROM (SELECT *, row_number() OVER (ORDER BY {_BY_DATE}) AS rn FROM rows WHERE {_UP} AND state = 'CT') ranked""".replace("FROM ranked GROUP", f"FROM (SELECT *, row_number() OVER (ORDER BY {_BY_DATE}) AS rn FROM rows WHERE {_UP} AND state = 'CT') GROUP"))
def list_description(d: Directory) -> DataFrame:
    chosen = rows(d).where(L.upcoming(TODAY) & (F.col("state") == "CT"))
    firsts = chosen.groupBy("course_name").agg(F.min(F.struct(*L.LIST_ORDER)).alias("first")).orderBy("first").limit(3)
    names = firsts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "course_name"))), lambda x: x["course_name"]), ", ").alias("courses"))
    return chosen.agg(F.count("*").alias("n")).crossJoin(F.broadcast(names))


@plans.query("guide_links", "SELECT t.ord, p.p_name AS title FROM (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 100000000), (3, 9)) v(ord, k)) t JOIN part p ON p.p_partkey = t.k")
def guide_links(d: Directory) -> DataFrame:
    asked = d.spark.createDataFrame([([5, 3, 100_000_000, 9],)], "ids array<bigint>").select(F.posexplode("ids").alias("ord", "p_partkey"))
    return d.base("part").join(asked, "p_partkey").select("ord", F.col("p_name").alias("title")).orderBy("ord")


@reading("city_page", f"SELECT state, city, count(*) FILTER (WHERE {_UP}) AS upcoming, count(*) FILTER (WHERE published = 1 AND status = 'expected') AS expected, count(*) FILTER (WHERE {_INDEX}) > 0 AS listed FROM rows WHERE city IS NOT NULL GROUP BY state, city")
def city_page(d: Directory) -> DataFrame:
    page = rows(d).where("city is not null").groupBy("state", "city")
    return page.agg(F.count_if(L.upcoming(TODAY)).alias("upcoming"), F.count_if(L.expected()).alias("expected"), (F.count_if(L.indexable(TODAY)) > 0).alias("listed"))


@plans.query("course_aliases", "SELECT id, CASE id % 4 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_aliases, CASE id % 4 WHEN 0 THEN 'Old ' || name WHEN 3 THEN 'A' END AS first_alias FROM courses", ("courses",))
def course_aliases(d: Directory) -> DataFrame:
    aliases = L.string_list(F.col("aliases"))
    return d.courses.select("id", F.size(aliases).alias("n_aliases"), F.get(aliases, F.lit(0)).alias("first_alias"))


@reading("course_rollup", "SELECT course_id, count(*) AS outing_count, max(coalesce(end_date, start_date)) AS last_outing_date FROM rows WHERE published = 1 GROUP BY course_id")
def course_rollup(d: Directory) -> DataFrame:
    return d.outings.where("published = 1").groupBy("course_id").agg(F.count("*").alias("outing_count"), F.max(L.last_day()).alias("last_outing_date"))


@reading("latest_by_organizer", "SELECT organizer_id, id, start_date FROM (SELECT *, row_number() OVER (PARTITION BY organizer_id ORDER BY start_date DESC, id) AS rn FROM rows WHERE published = 1 AND organizer_id IS NOT NULL AND start_date IS NOT NULL) WHERE rn <= 3")
def latest_by_organizer(d: Directory) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("organizer_id").orderBy(F.col("start_date").desc(), "id"))
    return d.outings.where("published = 1 and organizer_id is not null and start_date is not null").withColumn("rn", rank).where("rn <= 3").select("organizer_id", "id", "start_date")
