"""From found addresses to pages to fetch: links of directory pages, removals, the queue with its rules, pages rendered anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from .kept import keep

#: Paths and sites that are no event's, and words that an event's link has.
NAVIGATION = r"(?i)\/(privacy|terms|legal|login|log-in|signin|sign-in|signup|register-account|account|cart|checkout|contact|about|careers|jobs|news|blog|press|search|donate|shop|faq|help|sitemap|wp-admin|wp-login|feed|tag|category|author)(\/|$|\?)"
SOCIAL = r"(?i)(^|\.)(facebook|fb|instagram|twitter|x|linkedin|youtube|youtu|tiktok|pinterest|threads|bsky|reddit|whatsapp)\.(com|be|net|app|me)$"
ORGANIZER_WORDS = r"(?i)event|golf|classic|tournament|outing|invitational|scramble|regist|ticket|sign[\s-]?up|official|organi[sz]er"
EVENT_WORDS = r"(?i)event|golf|classic|tournament|outing|invitational|scramble"
LINKS_PER_PAGE, RECENT_DAYS, LEAST_TEXT = 5, 7, 400


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def is_organizer_link(url: Column, text: Column) -> Column:
    """Whether a directory page's link leads to the organizer or a registration: no navigation, no social site, an event's words."""
    host = U.host(url)
    hay = F.concat_ws(" ", host, _path(url), F.coalesce(text, F.lit("")))
    return F.coalesce(~host.rlike(SOCIAL) & ~_path(url).rlike(NAVIGATION) & hay.rlike(ORGANIZER_WORDS), F.lit(False))


def is_event_link(url: Column, text: Column, index_url: Column) -> Column:
    """Whether a link of an index page looks like an event's. The root of the index's own site is navigation, that of another one may be an event's."""
    bare = lambda u: F.regexp_replace(U.host(u), r"^www\.", "")
    said = F.coalesce(text, F.lit(""))
    root = _path(url) == "/"
    hay = F.when(root, F.concat_ws(" ", bare(url), said)).otherwise(F.concat_ws(" ", _path(url), said))
    return F.coalesce(~url.eqNullSafe(U.normalize(index_url)) & ~_path(url).rlike(NAVIGATION) & ~(root & (bare(url) == bare(index_url))) & hay.rlike(EVENT_WORDS), F.lit(False))


def directory_links(pages: DataFrame, known: DataFrame, blocked: DataFrame, most: int = LINKS_PER_PAGE) -> DataFrame:
    """``page_id``, ``ord``, ``url``, ``reason``: links that directory pages give to fetch (reason null), or that are skipped (``blocked``: url, reason).

    pages: page_id, url, html; known: url. A link counts for the first page that has it, over all pages, and of a page the first ``most``
    that are not blocked count. It must leave the directory's domain and look like an organizer's.

    A page that has its number of links leaves those after them to later pages. So links are claimed in rounds, each by the first page that has not left
    them, until no page has too many; there are about as many rounds as full pages that stand in a row for the same links. Each is kept.
    """
    links = pages.select("page_id", "url", F.posexplode(H.links(F.col("html"))).alias("ord", "link"))
    target = U.normalize(F.when(F.col("link.href").startswith("/"), F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.col("link.href"))).otherwise(F.col("link.href")))
    links = links.select("page_id", "ord", target.alias("target"), F.col("link.text").alias("text"), U.domain(U.host(F.col("url"))).alias("home"))
    links = links.where(F.col("target").isNotNull() & (U.domain(U.host(F.col("target"))) != F.col("home")) & is_organizer_link(F.col("target"), F.col("text")))
    links = links.groupBy("page_id", "target").agg(F.min("ord").alias("ord")).join(known.select(F.col("url").alias("target")).distinct(), "target", "left_anti")
    links = links.join(blocked.groupBy(F.col("url").alias("target")).agg(F.first("reason").alias("reason")), "target", "left")
    links = keep(links)
    first = Window.partitionBy("target").orderBy("page_id")
    before = F.count(F.when(F.col("reason").isNull(), 1)).over(Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    while True:
        owned = links.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank").withColumn("before", before)
        owned = keep(owned)
        full = owned.where(F.col("before") >= most)
        if full.isEmpty():
            return owned.select("page_id", "ord", F.col("target").alias("url"), "reason")
        # a page that is full leaves what comes after; links that it may still get only push these further back
        links = links.join(full.select("page_id", "target"), ["page_id", "target"], "left_anti")
        links = keep(links)


def not_removed(outings: DataFrame, ids: DataFrame, urls: DataFrame) -> DataFrame:
    """Outings (id, urls: array) of which neither the id is removed (``ids``: id) nor any URL (``urls``: url), compared as normalized."""
    same = lambda u: F.coalesce(U.normalize(u), u)
    listed = urls.select(same(F.col("url")).alias("url")).distinct()
    hit = outings.select("id", F.explode("urls").alias("raw")).select("id", same(F.col("raw")).alias("url")).join(listed, "url", "left_semi").select("id")
    return outings.join(hit.unionByName(ids.select("id")).distinct(), "id", "left_anti")


def discover(candidates: DataFrame, removed: DataFrame, waiting: DataFrame, recent: DataFrame) -> DataFrame:
    """What becomes of found addresses: rows of ``url``, ``reason`` (null: queued), ``ord``, ``found_via``, ``priority``, ``bypass``, ``outing_id``.

    candidates: ord (the order of all feeds), url, found_via, priority, bypass, outing_id, excluded (flag), verdict (null, allowed, listing, not_allowed),
    checked (the feed has applied the platform's rules). removed, waiting, recent: url, normalized. Rules in order: no URL, excluded, removed, platform, then of one URL the first
    that may run (not waiting; not recent, unless it bypasses that) is queued and later ones are duplicates. A duplicate with a smaller priority gives its route; any that
    bypasses gives that right.
    """
    url = U.normalize(F.col("url"))
    c = candidates.withColumn("raw", F.substring("url", 1, U.LONGEST)).withColumn("url", url)
    flag = lambda table, name: table.select("url").distinct().withColumn(name, F.lit(True))
    for table, name in ((removed, "is_removed"), (waiting, "is_waiting"), (recent, "is_recent")):
        c = c.join(flag(table, name), "url", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    platform = F.when(~F.col("checked") & (F.col("verdict") == "listing"), "platform_listing").when(~F.col("checked") & (F.col("verdict") == "not_allowed"), "platform_not_allowed")
    reason = F.when(F.col("url").isNull(), "invalid").when(F.col("excluded"), "excluded").when(F.col("is_removed"), "removed").otherwise(platform)
    c = c.withColumn("reason", reason)
    dropped = c.where("reason is not null").select(F.coalesce("url", "raw").alias("url"), "reason", "ord", "found_via", "priority", "bypass", "outing_id")
    c = c.where("reason is null").withColumn("may", ~F.col("is_waiting") & (F.col("bypass") | ~F.col("is_recent")))
    of_url = Window.partitionBy("url").orderBy("ord")
    c = c.withColumn("first", F.min(F.when(F.col("may"), F.col("ord"))).over(Window.partitionBy("url")))
    c = c.withColumn("late", F.when(F.col("is_waiting"), "duplicate").when(F.col("first").isNull() | (F.col("ord") < F.col("first")), "recent").when(F.col("ord") > F.col("first"), "duplicate"))
    active = F.when(F.col("ord") >= F.col("first"), F.col("priority"))
    c = c.withColumn("takes", (F.col("ord") == F.col("first")) | (active < F.min(active).over(of_url.rowsBetween(Window.unboundedPreceding, -1))))
    some = c.where(F.col("first").isNotNull() & (F.col("ord") >= F.col("first")))
    route = F.max_by(F.struct("found_via", "priority"), F.when(F.col("takes"), F.col("ord")))
    outing = F.max_by("outing_id", F.when(F.col("takes") & F.col("outing_id").isNotNull(), F.col("ord")))
    queued = some.groupBy("url").agg(F.min("ord").alias("ord"), route.alias("r"), F.max("bypass").alias("bypass"), outing.alias("outing_id"))
    queued = queued.select("url", F.lit(None).cast("string").alias("reason"), "ord", "r.found_via", "r.priority", "bypass", "outing_id")
    late = c.where("late is not null").select("url", F.col("late").alias("reason"), "ord", "found_via", "priority", "bypass", "outing_id")
    return queued.unionByName(late).unionByName(dropped)


def with_rendered(pages: DataFrame, rendered: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """Pages (url, text) of which those with less than ``least`` characters give way to the page of the same URL in ``rendered`` (url, text), if that came through (text not null). ``was_rendered`` tells which."""
    again = rendered.where("text is not null").select("url", F.col("text").alias("new_text"))
    joined = pages.join(again, "url", "left")
    replaced = F.col("new_text").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) < least)
    return joined.withColumn("was_rendered", replaced).withColumn("text", F.when(replaced, F.col("new_text")).otherwise(F.col("text"))).drop("new_text")


def imported_courses(features: DataFrame, cities: DataFrame, overrides: DataFrame, sites: DataFrame, existing: DataFrame, km: float = 30.0, least: float = 0.7) -> DataFrame:
    """Map features as venues: ``ref``, ``id``, ``city``, ``course_type``, ``type_source``, ``aliases``.

    features: ref, name, state, lat, lng, named_city (as tagged), tag_type (see ``content.feature_type``), aliases (array); of rows that repeat a ref the first by name counts.
    cities: id, name, state, lat, lng; overrides: ref, course_type; sites: ref, course_type, confidence; existing: ref, id, aliases.

    City: the known one of the tagged name in the state, else the tagged name if it is plausible, else the nearest known one of the state within ``km``.
    Type: override, tags, a website's answer from ``least`` on, else unknown. A venue that exists keeps its id and its aliases, new ones are added.
    """
    from ..functions import text as T
    from .content import is_city_name, merged_aliases
    from .linkage import nearest_city

    rows = features.withColumn("rank", F.row_number().over(Window.partitionBy("ref").orderBy("name", "lat", "lng"))).where("rank = 1").drop("rank")
    known = cities.groupBy(T.kebab(F.col("name")).alias("key"), "state").agg(F.min("name").alias("known_city"))
    rows = rows.withColumn("key", T.kebab(F.col("named_city"))).join(known, ["key", "state"], "left")
    lost = rows.where(F.col("known_city").isNull() & ~F.coalesce(is_city_name(F.col("named_city")), F.lit(False)))
    near = nearest_city(lost.select(F.col("ref").alias("point_id"), "lat", "lng", "state"), cities, km, same_state=True).select(F.col("point_id").alias("ref"), F.col("city_id").alias("near_id"))
    near = near.join(cities.select(F.col("id").alias("near_id"), F.col("name").alias("near_city")), "near_id").drop("near_id")
    rows = rows.join(near, "ref", "left").withColumn("city", F.coalesce("known_city", F.when(F.coalesce(is_city_name(F.col("named_city")), F.lit(False)), F.trim("named_city")), "near_city"))
    for table, name, value in ((overrides, "by_override", "course_type"), (sites.where(F.col("confidence") >= least), "by_site", "course_type")):
        rows = rows.join(table.groupBy("ref").agg(F.min(value).alias(name)), "ref", "left")
    source = F.when(F.col("by_override").isNotNull(), "override").when(F.col("tag_type").isNotNull(), "osm").when(F.col("by_site").isNotNull(), "website_llm")
    rows = rows.join(existing.select("ref", "id", F.col("aliases").alias("had")), "ref", "left")
    empty = F.array().cast("array<string>")
    return rows.select("ref", "id", "city", F.coalesce("by_override", "tag_type", "by_site", F.lit("unknown")).alias("course_type"), source.alias("type_source"), merged_aliases(F.col("name"), F.coalesce("had", empty), F.coalesce("aliases", empty)).alias("aliases"))


def type_candidates(courses: DataFrame, overrides: DataFrame) -> DataFrame:
    """Venues of unknown type with a website and no override, in order: most events, notable, latest event, id. overrides: id."""
    asked = courses.where((F.col("course_type") == "unknown") & F.coalesce(F.col("website").rlike(r"(?i)^https?://"), F.lit(False))).join(overrides.select("id").distinct(), "id", "left_anti")
    return asked.orderBy(F.col("outing_count").desc(), F.col("notable").desc(), F.coalesce("last_outing_date", F.lit("")).desc(), "id")


def accepted_types(courses: DataFrame, answers: DataFrame, overrides: DataFrame, least: float = 0.7) -> DataFrame:
    """``id``, ``course_type``, ``reason``: of each venue the first answer (id, ord, course_type, confidence), and why it is not taken (null: it is). Overrides (id) and known types are never overwritten."""
    first = answers.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("rank = 1")
    joined = first.join(courses.select("id", F.col("course_type").alias("now")), "id")
    joined = joined.join(overrides.select("id").distinct().withColumn("by_hand", F.lit(True)), "id", "left")
    reason = F.when(F.col("course_type") == "unknown", "unknown").when(F.col("confidence") < least, "low_confidence").when(F.col("by_hand"), "override").when(F.col("now") != "unknown", "already_typed")
    return joined.select("id", "course_type", reason.alias("reason"))
