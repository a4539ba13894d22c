"""Read queries over the directory: faceted lists, counts, lookups, neighbourhoods and sitemaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box_around, haversine_km, in_box
from .selection import numbered

#: Statuses of dated, current events; event types that count as charity; most rows of an API answer.
LISTED_STATUSES = ("open", "waitlist", "sold_out", "cancelled")
CHARITY_TYPES = ("charity", "school_fundraiser")
MAX_RESULTS = 200
LIST_ORDER = ("start_date", "shotgun_time", "title", "id")


@dataclass(frozen=True)
class Facets:
    """Optional conditions of a list; those left out do not filter. A bound on the price leaves out events without one."""

    state: str | None = None
    city: str | None = None
    course_id: int | None = None
    organizer_id: int | None = None
    box: tuple[float, float, float, float] | None = None
    course_types: tuple[str, ...] = ()
    charity_only: bool = False
    max_price_cents: int | None = None
    start_from: str | None = None
    start_to: str | None = None
    format: str | None = None
    singles_welcome: bool = False
    exclude_id: int | None = None

    def condition(self) -> Column:
        c = []
        if self.state:
            c.append(F.col("state") == self.state.upper())
        if self.city:
            c.append(F.lower("city") == self.city.lower())
        if self.course_id is not None:
            c.append(F.col("course_id") == self.course_id)
        if self.organizer_id is not None:
            c.append(F.col("organizer_id") == self.organizer_id)
        if self.box:
            c.append(in_box(F.col("lat"), F.col("lng"), self.box))
        if self.course_types:
            c.append(F.col("course_type").isin(*self.course_types))
        if self.charity_only:
            c.append(F.col("outing_type").isin(*CHARITY_TYPES))
        if self.max_price_cents is not None:
            c.append(F.col("single_price_cents") <= self.max_price_cents)
        if self.start_from:
            c.append(F.col("start_date") >= self.start_from)
        if self.start_to:
            c.append(F.col("start_date") <= self.start_to)
        if self.format:
            c.append(F.col("format") == self.format)
        if self.singles_welcome:
            c.append(F.col("single_price_cents").isNotNull())
        if self.exclude_id is not None:
            c.append(F.col("id") != self.exclude_id)
        return reduce(lambda a, b: a & b, c, F.lit(True))


def label(outing_type: Column, charity_status: Column) -> Column:
    """What a card calls an event."""
    charity = F.when(charity_status == "501c3", "Charity").otherwise("Fundraiser, charity status unverified")
    names = {"school_fundraiser": "School fundraiser", "business_association": "Trade group outing", "access_day": "Access day", "open_tournament": "Open tournament", "pro_am": "Pro-am", "other": "Golf outing"}
    out = F.when(outing_type == "charity", charity)
    for kind, name in names.items():
        out = out.when(outing_type == kind, name)
    return out


def string_list(json_text: Column) -> Column:
    """The strings of a JSON array; empty for anything else. Other values in the array are left out."""
    parsed = F.from_json(json_text, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def joined(outings: DataFrame, courses: DataFrame, organizers: DataFrame) -> DataFrame:
    """Events with their course and, where there is one, their organizer."""
    c = courses.select(F.col("id").alias("course_id"), F.col("slug").alias("course_slug"), F.col("name").alias("course_name"), "city", "state", "zip", "lat", "lng", "time_zone", "course_type")
    o = organizers.select(F.col("id").alias("organizer_id"), F.col("slug").alias("organizer_slug"), F.col("name").alias("organizer_name"), "charity_status")
    return outings.join(c, "course_id").join(o, "organizer_id", "left").withColumn("label", label(F.col("outing_type"), F.col("charity_status")))


def last_day() -> Column:
    return F.coalesce("end_date", "start_date")


def upcoming(today: str) -> Column:
    return (F.col("published") == 1) & F.col("status").isin(*LISTED_STATUSES) & (last_day() >= today)


def expected() -> Column:
    return (F.col("published") == 1) & (F.col("status") == "expected")


def year_before(day: str) -> str:
    """The same month and day a year earlier, as text; it need not be a date (29 February)."""
    return f"{int(day[:4]) - 1}{day[4:]}"


def indexable(today: str) -> Column:
    """Events that keep a city's page in the index: expected, or not over for more than twelve months."""
    return (F.col("published") == 1) & ((F.col("status") == "expected") | (last_day() >= year_before(today)))


def top(df: DataFrame, order: tuple, limit: int | None) -> DataFrame:
    sorted_rows = df.orderBy(*order)
    return sorted_rows if limit is None else sorted_rows.limit(limit)


def list_upcoming(rows: DataFrame, today: str, facets: Facets = Facets(), limit: int | None = None) -> DataFrame:
    return top(rows.where(upcoming(today) & facets.condition()), LIST_ORDER, limit)


def list_expected(rows: DataFrame, facets: Facets = Facets(), limit: int | None = None) -> DataFrame:
    return top(rows.where(expected() & facets.condition()), ("expected_month", "start_date", "title", "id"), limit)


def history(rows: DataFrame, of: Column) -> DataFrame:
    """All published events of a course or an organizer, latest first; an expected one counts as the first of its month."""
    day = F.coalesce("start_date", F.concat("expected_month", F.lit("-01")))
    return rows.where((F.col("published") == 1) & of).withColumn("day", day).orderBy(F.col("day").desc(), "id")


def nearby(rows: DataFrame, lat: float, lng: float, km: float, today: str, facets: Facets = Facets(), limit: int = 5) -> DataFrame:
    """The nearest upcoming events; ties by start, time, title and id."""
    box = box_around(lat, lng, km)
    near = rows.where(upcoming(today) & facets.condition() & in_box(F.col("lat"), F.col("lng"), box))
    near = near.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    return near.where(F.col("distance_km") <= km).orderBy("distance_km", *LIST_ORDER).limit(min(limit, MAX_RESULTS))


def nearby_cities(rows: DataFrame, lat: float, lng: float, today: str, km: float = 60, limit: int = 8, state: str | None = None, exclude: str | None = None) -> DataFrame:
    """Cities with an indexable event, by the distance of the mean place of their courses that have one."""
    chosen = indexable(today) & F.col("city").isNotNull() & in_box(F.col("lat"), F.col("lng"), box_around(lat, lng, km))
    if state:
        chosen &= F.col("state") == state.upper()
    centres = rows.where(chosen).groupBy("state", "city").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    if exclude:
        centres = centres.where(F.lower("city") != exclude.lower())
    far = centres.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    return far.where(F.col("distance_km") <= km).orderBy("distance_km", "state", "city").limit(limit)


def resolve_city(cities: DataFrame, courses: DataFrame, state: str, slug: str, kebab) -> DataFrame:
    """The city of that slug, or else one that only courses name, at the mean of their places."""
    known = cities.where((F.col("state") == state.upper()) & (F.col("slug") == slug)).select("id", "slug", "name", "state", "lat", "lng", "population", "time_zone")
    named = courses.where((F.col("state") == state.upper()) & F.col("city").isNotNull() & (kebab(F.col("city")) == slug))
    first = named.groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).orderBy("city").limit(1)
    other = first.select(F.lit(None).cast("int").alias("id"), F.lit(slug).alias("slug"), F.col("city").alias("name"), F.lit(state.upper()).alias("state"), "lat", "lng", F.lit(0).alias("population"), F.lit(None).cast("string").alias("time_zone"))
    found = known.withColumn("rank", F.lit(0)).unionByName(other.withColumn("rank", F.lit(1)))
    return found.orderBy("rank", "id").limit(1).drop("rank")


def search_cities(cities: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Cities whose name begins so, the most populous first. Wildcards are dropped; under two characters find nothing."""
    typed = prefix.strip().lower().translate({ord(c): None for c in "%_\\"})
    found = cities.where(F.lower("name").startswith(typed)) if len(typed) >= 2 else cities.where(F.lit(False))
    return found.orderBy(F.col("population").desc(), "name").limit(limit)


def zip_lookup(zips: DataFrame, cities: DataFrame, zip_code: str) -> DataFrame:
    valid = len(zip_code) == 5 and zip_code.isascii() and zip_code.isdigit()
    c = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"), "state")
    return zips.where((F.col("zip") == zip_code) & F.lit(valid)).join(c, "city_id", "left").select("zip", "lat", "lng", "city", "state")


def matches_filters(max_distance_miles: float | None, distance_miles: Column, max_price_cents: int | None, types: tuple[str, ...]) -> Column:
    """The condition by which a page shows or hides a card; a card without the asked-for distance or price is hidden."""
    c = F.lit(True)
    if max_distance_miles is not None:
        c &= F.coalesce(distance_miles <= max_distance_miles, F.lit(False))
    if max_price_cents is not None:
        c &= F.coalesce(F.col("single_price_cents") <= max_price_cents, F.lit(False))
    if types:
        c &= F.col("course_type").isin(*types)
    return c


def in_files(urls: DataFrame, order: tuple[str, ...], per_file: int = 45_000) -> DataFrame:
    """Sitemap URLs of each kind numbered into files; nearly all are of one kind, so they are dealt by range."""
    return numbered(urls, list(order), ("kind",)).withColumn("file", F.floor(F.col("place") / per_file).cast("long")).drop("place")
