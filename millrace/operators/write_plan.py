"""What a run changes in the directory: organizers created, outings confirmed, updated or added, links, holds and retractions, and what is published of it.

A plan is a set of tables of changes, in the order in which they apply. Later ones refer to numbers that earlier ones give out: new rows get the numbers behind the
largest stored one, in the order of their events. Only rows that differ from what is stored are changes, so a second run over the same
events gives an empty plan. ``applied`` gives the next state.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import linkage as K
from . import state as S
from .kept import keep
from .selection import numbered
from .similar import similar_texts

#: Fixed value: least likeness of an organizer's name to one that is known.
SAME_ORGANIZER = 0.92
DATED = ("open", "waitlist", "sold_out", "cancelled")
#: Columns of an outing that a run may change; published follows in its own step.
FIELDS = ["organizer_id", "title", "outing_type", "start_date", "end_date", "shotgun_time", "format", "single_price_cents", "status", "expected_month", "canonical_source_url", "source_gone", "confidence", "hold_reason"]


class Tables(NamedTuple):
    """organizers: id, slug, name, ein. outings: id, slug, course_id, published and FIELDS. links: source_id, outing_id. sources: id, hold_reason."""

    organizers: DataFrame
    outings: DataFrame
    links: DataFrame
    sources: DataFrame


class Plan(NamedTuple):
    """organizers: the new rows. outings: op (insert, update, retract) and the whole new row. links: the new ones. sources: id and the new hold_reason. outcomes: of each event (event_id) its action, outing_id and hold_reason."""

    organizers: DataFrame
    outings: DataFrame
    links: DataFrame
    sources: DataFrame
    outcomes: DataFrame


def unmatched_holds(events: DataFrame) -> DataFrame:
    """``events`` with the hold of those that are not at one known venue (course_id null) and have none yet; excluded ones are never held."""
    held = ~F.col("excluded") & F.col("hold_reason").isNull() & F.col("course_id").isNull()
    return events.withColumn("hold_reason", F.when(held, "course_unmatched").otherwise(F.col("hold_reason")))


def lifted(events: DataFrame, outings: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    """``events`` that are not excluded, with ``lifted``: held for low confidence only, and another domain has the course and day too, in this run (not held for anything else) or stored with a date. Domains are compared by their smallest and largest of a course and day."""
    live = events.where("not excluded")
    backing = live.where("course_id is not null and start_date is not null and (hold_reason is null or hold_reason = 'low_confidence')").select("course_id", "start_date", "domain")
    stored = outings.where("status <> 'expected' and start_date is not null").select("course_id", "start_date", domain(F.col("canonical_source_url")).alias("domain"))
    ends = backing.unionByName(stored).groupBy("course_id", "start_date").agg(F.min("domain").alias("_low"), F.max("domain").alias("_high"))
    other = (F.col("_low") != F.col("domain")) | (F.col("_high") != F.col("domain"))
    return live.join(ends, ["course_id", "start_date"], "left").withColumn("lifted", F.coalesce((F.col("hold_reason") == "low_confidence") & other, F.lit(False))).drop("_low", "_high")


def organizers_of(leads: DataFrame, organizers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who organizes (``event_id``, ``organizer_id``), and the organizers to add (id, slug, name, ein). leads: event_id, at (their order), organizer, ein.

    An organizer is known by its number, else by a name at least SAME_ORGANIZER alike, of stored ones the smallest id; then come those that earlier events of the run add. Names without a match add an organizer.
    """
    names = leads.where("organizer is not null").groupBy("organizer", "ein").agg(F.min("at").alias("at"))
    names = keep(names.select("organizer", "ein", "at", F.xxhash64("organizer", F.coalesce("ein", F.lit(""))).alias("node"), F.array_join(T.name_tokens(F.col("organizer")), " ").alias("text")))
    known = organizers.select("id", "ein", F.array_join(T.name_tokens(F.col("name")), " ").alias("text"))
    by_ein = names.join(known.select("ein", "id"), "ein").groupBy("node").agg(F.min("id").alias("by_ein"))
    by_name = similar_texts(names.select(F.col("node").alias("a"), "text"), known.select(F.col("id").alias("b"), "text"), SAME_ORGANIZER).groupBy("a").agg(F.min("b").alias("by_name")).withColumnRenamed("a", "node")
    seen = keep(names.join(by_ein, "node", "left").join(by_name, "node", "left"))
    new = keep(seen.where("by_ein is null and by_name is null").select("node", "at", "ein", "text", "organizer"))
    pairs = similar_texts(new.select(F.col("node").alias("a"), "text"), new.select(F.col("node").alias("b"), "text"), SAME_ORGANIZER).select("a", "b", F.lit(1).alias("choice"))
    pairs = pairs.unionByName(new.where("ein is not null").select(F.col("node").alias("a"), "ein").join(new.select(F.col("node").alias("b"), "ein"), "ein").select("a", "b", F.lit(0).alias("choice")))
    order = new.select("node", "at")
    earlier = pairs.join(order.withColumnRenamed("node", "a"), "a").join(order.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b").where("at_b < at")
    led = keep(K.leaders(order, earlier.groupBy(F.col("a").alias("node"), F.col("b").alias("before")).agg(F.min("choice").alias("choice"))))

    last = organizers.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = new.join(led.where("node = leader").select("node"), "node")
    created = numbered(created.select("node", "at", "ein", "organizer", T.kebab(F.col("organizer")).alias("base")), ["at"]).withColumn("id", F.col("place") + last + 1)
    created = keep(S.free_slugs(created.drop("at", "place"), organizers.select("slug"), order="id"))
    # a name that is alike to a stored one, but has the number of an organizer that an earlier event adds
    own = seen.where("by_ein is null and by_name is not null and ein is not null").select("node", "at", "ein").alias("s").join(created.join(order, "node").select("ein", "id", F.col("at").alias("at_new")).alias("c"), "ein").where("at_new < at").groupBy("node").agg(F.min("id").alias("by_new"))
    leaders = led.join(created.select(F.col("node").alias("leader"), F.col("id").alias("led_id")), "leader").select("node", "led_id")
    resolved = seen.join(own, "node", "left").join(leaders, "node", "left").select(F.col("organizer"), F.col("ein"), F.coalesce("by_ein", "by_new", "by_name", "led_id").alias("organizer_id"))
    who = leads.alias("l").join(resolved.alias("r"), (F.col("l.organizer") == F.col("r.organizer")) & F.col("l.ein").eqNullSafe(F.col("r.ein")), "left").select("event_id", "organizer_id")
    return who, created.select("id", "slug", F.col("organizer").alias("name"), "ein")


def write_plan(events: DataFrame, tables: Tables, collected: DataFrame, listing: Callable[[Column], Column], domain: Callable[[Column], Column]) -> Plan:
    """The plan of a run.

    events: event_id, ord, source_id, url, kind, domain, excluded, hold_reason, confidence, course_id, course_name, start_date, end_date, organizer, ein, title, outing_type, shotgun_time, format, single_price_cents, status;
    event_id tells them apart. collected: source_id of the pages that this run read. ``listing`` and ``domain`` of a URL.

    Events that are excluded, held or without venue or day write no outing. Those of one course, day and outing are one cluster; each, in the order of its first event, updates a stored outing that no other has: a dated one of
    that course and day with the same organizer or outing, else one expected of the same course and organizer within a month. Clusters without one are added. Stored outings all of whose
    sources were read, and none gave them, lose their confidence.
    """
    events = keep(events)
    rank = F.struct(K.precedence(F.col("kind")).alias("rank"), (-F.col("confidence")).alias("less"), "ord", "event_id")
    live = keep(lifted(events, tables.outings, domain).withColumn("at", rank))
    active = live.where("(hold_reason is null or lifted) and course_id is not null and start_date is not null").withColumn("confidence", F.when(F.col("lifted"), F.greatest("confidence", F.lit(S.PUBLISH_CONFIDENCE))).otherwise(F.col("confidence")))
    active = keep(active.withColumn("at", rank))
    clusters = keep(active.join(K.cluster_events(active), "event_id"))
    lead = clusters.where("event_id = leader")
    who, created = organizers_of(lead.select("event_id", "at", "organizer", "ein"), tables.organizers)
    lead = keep(lead.join(who, "event_id"))

    # the first known value in order, and the page that stands for the cluster: no listing if there is another, then the organizer's own
    first = lambda c, known=None: F.min_by(c, F.when(F.col(c).isNotNull() if known is None else known, F.col("at"))).alias(c)
    page = F.struct(listing(F.col("url")).alias("listing"), (F.col("kind") != "organizer").alias("other"), "at")
    merged = clusters.groupBy("leader").agg(first("end_date"), first("shotgun_time"), first("format"), first("single_price_cents"), F.max("confidence").alias("confidence"), F.min_by("url", page).alias("canonical"), F.min(page).alias("page"))
    end = F.when(F.col("m.end_date") >= F.col("l.start_date"), F.col("m.end_date"))
    merged = keep(lead.alias("l").join(merged.alias("m"), F.col("l.event_id") == F.col("m.leader")).select(
        "l.event_id", "l.at", "l.course_id", "l.course_name", "l.organizer_id", "l.organizer", "l.title", "l.outing_type", "l.start_date", end.alias("end_date"), "m.shotgun_time", "m.format", "m.single_price_cents",
        F.when(F.col("l.status") == "unknown", "open").otherwise(F.col("l.status")).alias("status"), "m.confidence", "m.canonical", (~F.col("m.page.other")).alias("own_page"),
    ))

    stored = tables.outings.join(tables.organizers.select(F.col("id").alias("organizer_id"), F.col("name").alias("_organizer")), "organizer_id", "left")
    # names and titles are taken apart once for each row, and only where a course and day meet
    place = ["course_id", "start_date"]
    met = keep(stored.where("status <> 'expected'").join(merged.select(*place).distinct(), place, "left_semi").select("id", *place, "organizer_id", K.prepared(F.col("_organizer"), F.col("title")).alias("q")))
    asked = keep(merged.join(met.select(*place).distinct(), place, "left_semi").select("event_id", "at", *place, "organizer_id", K.prepared(F.col("organizer"), F.col("title")).alias("p")))
    same = F.coalesce(F.col("m.organizer_id") == F.col("s.organizer_id"), F.lit(False)) | K.same_outing(F.col("q"), F.col("p"))
    dated = asked.alias("m").join(met.alias("s"), (F.col("m.course_id") == F.col("s.course_id")) & (F.col("m.start_date") == F.col("s.start_date"))).where(same)
    month = F.explode(F.array(*(S.D.add_months(F.substring("m.start_date", 1, 7), n) for n in (-1, 0, 1)))).alias("month")
    near = merged.alias("m").select("m.event_id", "m.at", "m.course_id", "m.organizer_id", month).alias("m")
    waiting = stored.where("status = 'expected'").select("id", "course_id", "organizer_id", F.coalesce("expected_month", F.substring("start_date", 1, 7)).alias("month")).alias("s")
    waiting = near.join(waiting, (F.col("m.course_id") == F.col("s.course_id")) & (F.col("m.organizer_id") == F.col("s.organizer_id")) & (F.col("m.month") == F.col("s.month")))
    option = lambda df, kind: df.select(F.col("m.event_id").alias("who"), F.col("m.at").alias("ord"), F.col("s.id").alias("what"), F.struct(F.lit(kind).alias("kind"), F.col("s.id").alias("id")).alias("choice"))
    claims = keep(K.one_to_one(option(dated, 0).unionByName(option(waiting, 1))).select(F.col("who").alias("event_id"), F.col("what").alias("id")))

    known = merged.join(claims, "event_id").alias("m").join(tables.outings.alias("x"), F.col("m.id") == F.col("x.id"))
    confirming = F.col("x.status") == "expected"
    either = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"x.{c}")).alias(c)
    url = F.when(F.col("m.own_page") | confirming | (listing(F.col("x.canonical_source_url")) & ~listing(F.col("m.canonical"))), F.col("m.canonical")).otherwise(F.col("x.canonical_source_url"))
    fields = [
        F.coalesce("x.organizer_id", "m.organizer_id").alias("organizer_id"), "m.title", "m.outing_type", "m.start_date", "m.end_date", F.coalesce("m.shotgun_time", F.when(~confirming, F.col("x.shotgun_time"))).alias("shotgun_time"), either("format"), either("single_price_cents"),
        "m.status", F.lit(None).cast("string").alias("expected_month"), url.alias("canonical_source_url"), F.lit(0).alias("source_gone"), "m.confidence", F.when(F.col("x.hold_reason") == "removed", "removed").alias("hold_reason"),
    ]
    old = F.struct(*[F.col(f"x.{c}").alias(c) for c in FIELDS]).alias("old")
    updates = keep(known.select("m.event_id", "x.id", "x.slug", "x.course_id", "x.published", *fields, old, confirming.alias("confirming")))
    differs = F.lit(False)
    for c in FIELDS:
        differs |= ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
    row = ["id", "slug", "course_id", "published", *FIELDS]

    last = tables.outings.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = merged.join(claims, "event_id", "left_anti")
    year = F.substring("start_date", 1, 4)
    title = F.regexp_replace(T.slug_title(F.col("title"), F.col("course_name")), F.concat(F.lit(r"\b"), year, F.lit(r"\b")), F.lit(" "))
    parts = F.filter(F.array(T.kebab(title), T.short_slug(F.col("course_name"))), lambda p: p != "")
    base = F.concat(year, F.lit("/"), F.array_join(parts, "-"))
    fresh = numbered(fresh.withColumn("base", base), ["at"]).withColumn("id", F.col("place") + last + 1)
    fresh = keep(S.free_slugs(fresh, tables.outings.select("slug"), order="id").withColumn("published", F.lit(0)).withColumn("expected_month", F.lit(None).cast("string")).withColumn("source_gone", F.lit(0)).withColumn("hold_reason", F.lit(None).cast("string")).withColumn("canonical_source_url", F.col("canonical")))

    given = claims.unionByName(fresh.select("event_id", "id"))
    written = clusters.select("event_id", "leader", "source_id").join(given.select(F.col("event_id").alias("leader"), F.col("id").alias("outing_id")), "leader")
    links = written.select("source_id", "outing_id").distinct()
    gone = S.retracted(tables.links, collected, given.select(F.col("id").alias("outing_id")))
    retract = tables.outings.where(F.col("status").isin(*DATED) & (F.col("confidence") != 0)).join(gone.withColumnRenamed("outing_id", "id"), "id", "left_semi").withColumn("confidence", F.lit(0.0))
    changed = updates.where(differs).withColumn("op", F.lit("update")).select("op", *row)
    outings = changed.unionByName(fresh.withColumn("op", F.lit("insert")).select("op", *row)).unionByName(retract.withColumn("op", F.lit("retract")).select("op", *row))

    action = F.when(F.col("event_id") != F.col("leader"), "merge").when(F.col("confirming"), "confirm_expected").when(F.col("confirming").isNotNull(), "update").otherwise("insert")
    done = written.join(updates.select(F.col("id").alias("outing_id"), "confirming"), "outing_id", "left").select("event_id", action.alias("action"), "outing_id", F.lit(None).cast("string").alias("hold_reason"))
    reason = F.coalesce("hold_reason", F.when(F.col("course_id").isNotNull(), "no_date").otherwise("course_unmatched"))
    waiting = live.join(active.select("event_id"), "event_id", "left_anti").select("event_id", F.lit("held").alias("action"), F.lit(None).cast("long").alias("outing_id"), reason.alias("hold_reason"))
    excluded = events.where("excluded").select("event_id", F.lit("excluded").alias("action"), F.lit(None).cast("long").alias("outing_id"), F.lit(None).cast("string").alias("hold_reason"))
    outcomes = keep(done.unionByName(waiting).unionByName(excluded))
    holds = events.select("event_id", "ord", "source_id").join(outcomes.select("event_id", "hold_reason"), "event_id").groupBy("source_id").agg(F.min_by("hold_reason", F.when(F.col("hold_reason").isNotNull(), F.struct("ord", "event_id"))).alias("hold_reason"))
    sources = holds.alias("h").join(tables.sources.alias("s"), F.col("h.source_id") == F.col("s.id")).where(~F.col("h.hold_reason").eqNullSafe(F.col("s.hold_reason"))).select("s.id", "h.hold_reason")
    return Plan(keep(created), keep(outings), keep(links.join(tables.links, ["source_id", "outing_id"], "left_anti")), keep(sources), outcomes)


def applied(tables: Tables, plan: Plan) -> Tables:
    """The tables after a plan, by ``upsert``."""
    ops = lambda df, op: df.withColumn("op", op).withColumn("ord", F.lit(1))
    organizers = S.upsert(tables.organizers, ops(plan.organizers, F.lit("insert")).select("op", "ord", *tables.organizers.columns), "id", [])
    outings = S.upsert(tables.outings, ops(plan.outings.drop("op"), F.lit("update")).select("op", "ord", *tables.outings.columns), "id", FIELDS)
    sources = tables.sources.alias("s").join(plan.sources.select("id", F.struct("hold_reason").alias("new")).alias("p"), "id", "left").select("id", *[F.when(F.col("new").isNotNull(), F.col("new.hold_reason")).otherwise(F.col("s.hold_reason")).alias(c) if c == "hold_reason" else c for c in tables.sources.columns if c != "id"])
    return Tables(keep(organizers), keep(outings), keep(tables.links.unionByName(plan.links.select(*tables.links.columns))), keep(sources))


def publish_plan(outings: DataFrame, pages: DataFrame, verdicts: DataFrame, removed: DataFrame, changed: DataFrame, now: Column, zone: Column) -> DataFrame:
    """What publication makes of each outing: ``id``, ``publish``, ``hold``, ``why``, ``write`` (it differs from what is stored) and ``ping`` (to be announced).

    outings as in ``publish_decision``, with canonical_source_url, published and ``zone``; pages: outing_id, url of all their sources; verdicts: url, allowed, listing, directory of pages on a
    listed platform; removed and changed: id. Platforms veto what would be published: its canonical page is a listing, all its pages are listings or not allowed,
    or the canonical page is a directory's own. Announced is what was not published before or changed, unless it is past.
    """
    judged = outings.join(removed.select("id", F.lit(True).alias("_removed")).distinct(), "id", "left").withColumn("v", S.publish_decision(now, zone, F.coalesce("_removed", F.lit(False))))
    own = verdicts.select(F.col("url").alias("canonical_source_url"), F.col("listing").alias("_listing"), F.col("directory").alias("_directory"))
    every = pages.select(F.col("outing_id").alias("id"), "url").unionByName(outings.select("id", F.col("canonical_source_url").alias("url")))
    blocked = every.join(verdicts, "url", "left").groupBy("id").agg(F.min((~F.coalesce("allowed", F.lit(True)) | F.coalesce("listing", F.lit(False))).cast("int")).alias("_blocked"))
    joined = judged.join(own, "canonical_source_url", "left").join(blocked, "id", "left").join(changed.select("id", F.lit(True).alias("_changed")).distinct(), "id", "left")
    veto = F.when(F.col("v.publish") == 1, F.when(F.coalesce("_listing", F.lit(False)), "platform_listing").when(F.col("_blocked") == 1, "platform_not_allowed").when(F.coalesce("_directory", F.lit(False)), "directory_page"))
    out = joined.withColumn("veto", veto).withColumn("publish", F.when(F.col("veto").isNotNull(), 0).otherwise(F.col("v.publish")))
    write = (F.col("publish") != F.col("published")) | ~F.col("v.hold").eqNullSafe(F.col("hold_reason"))
    ping = (F.col("publish") == 1) & ((F.col("published") == 0) | F.coalesce("_changed", F.lit(False))) & (F.col("status") != "past")
    return out.select("id", "publish", F.col("v.hold").alias("hold"), F.coalesce("veto", "v.why").alias("why"), write.alias("write"), ping.alias("ping"))
