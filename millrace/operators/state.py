"""The directory's state from run to run: changes, publication, merges, retraction and roll-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from .kept import keep

#: A slug with a number that a collision may have given it: 2 or more, without leading zeros.
NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,8})$"

#: Least confidence of a published event; misses after which a source counts as gone; days that pages and holds are left alone; tries of a queued page.
PUBLISH_CONFIDENCE, GONE_MISSES, RECENT_DAYS, HOLD_DAYS, TRIES = 0.75, 2, 7, 30, 3


def page_changes(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """``pages`` with ``hash`` and ``unchanged``: pages url, text, http_status; previous url, hash. A page that was not modified keeps its hash."""
    old = previous.select("url", F.col("hash").alias("old"))
    new = F.when(F.col("http_status") == 304, F.col("old")).otherwise(F.sha2("text", 256))
    joined = pages.join(old, "url", "left").withColumn("hash", new)
    return joined.withColumn("unchanged", F.coalesce(F.col("hash") == F.col("old"), F.lit(False))).drop("old")


def publish_decision(now: Column, zone: Column, removed: Column) -> Column:
    """publish (0/1), hold and why of an event, the first rule that applies."""
    def verdict(publish, hold, why: str) -> Column:
        return F.struct(F.lit(publish).cast("int").alias("publish") if not isinstance(publish, Column) else publish.cast("int").alias("publish"), (hold if isinstance(hold, Column) else F.lit(hold).cast("string")).alias("hold"), F.lit(why).alias("why"))

    c = F.col
    expected, past = c("status") == "expected", c("status") == "past"
    was_removed = F.coalesce(c("hold_reason") == "removed", F.lit(False))
    return (
        F.when(removed, verdict(0, "removed", "removed"))
        .when(expected & F.coalesce(c("hold_reason") == "expected_stale", F.lit(False)), verdict(0, "expected_stale", "expected_stale"))
        .when(expected & c("expected_month").isNull(), verdict(0, "no_date", "no_expected_month"))
        .when(expected & c("organizer_id").isNull(), verdict(0, None, "no_organizer"))
        .when(expected, verdict(1, None, "expected"))
        .when(past, verdict((c("published") == 1) & ~was_removed, F.when(was_removed, None).otherwise(c("hold_reason")), "past"))
        .when(c("start_date").isNull(), verdict(0, "no_date", "no_date"))
        .when(D.is_past(c("start_date"), c("end_date"), now, zone), verdict(0, None, "past_date"))
        .when(c("confidence") < PUBLISH_CONFIDENCE, verdict(0, "low_confidence", "low_confidence"))
        .otherwise(verdict(1, None, "dated"))
    )


def confidence(date: Column, course: Column, state: Column, price: Column, sponsor_only: Column, disagrees: Column) -> Column:
    """1 less what is missing: 0.3 without evidence of the date, 0.2 without course, 0.2 without state, 0.1 without a price where one is due, 0.2 if two sources of the date disagree."""
    cut = lambda missing, points: F.when(missing, points).otherwise(0)
    points = 100 - cut(~date, 30) - cut(~course, 20) - cut(~state, 20) - cut(~price & ~sponsor_only, 10) - cut(disagrees, 20)
    return F.greatest(points, F.lit(0)) / 100


def merge_fields(events: DataFrame, key: list[str], order: list, fields: list[str]) -> DataFrame:
    """For each key the first known value of every field in the stated order, and the highest confidence."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields]
    return events.groupBy(*key).agg(*first, F.max("confidence").alias("confidence"))


def upsert(snapshot: DataFrame, changes: DataFrame, key: str, update: list[str]) -> DataFrame:
    """The next snapshot: rows of ``changes`` replace the ``update`` columns of rows with their key, and are added where there is none. Several changes of a key: the one with the highest ``ord``; one with ``op`` 'delete' removes the row, 'insert' leaves an existing one alone."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *[c for c in snapshot.columns if c != key]), "ord").alias("new"))
    joined = snapshot.withColumn("_old", F.lit(True)).join(last, key, "full")
    known, op = F.col("_old").isNotNull(), F.col("new.op")
    columns = []
    for c in snapshot.columns:
        if c == key:
            columns.append(F.col(c))
        elif c in update:
            columns.append(F.when(known & (op.isNull() | (op == "insert")), F.col(c)).otherwise(F.col(f"new.{c}")).alias(c))
        else:
            columns.append(F.when(known, F.col(c)).otherwise(F.col(f"new.{c}")).alias(c))
    return joined.where(op.isNull() | (op != "delete")).select(*columns)


def retracted(links: DataFrame, collected: DataFrame, produced: DataFrame) -> DataFrame:
    """Events all of whose sources were collected again, and which none of them gave. links: source_id, outing_id."""
    again = links.join(collected.select("source_id").withColumn("again", F.lit(1)), "source_id", "left")
    every = again.groupBy("outing_id").agg(F.min(F.coalesce("again", F.lit(0))).alias("all")).where("all = 1").select("outing_id")
    return every.join(produced.select("outing_id"), "outing_id", "left_anti")


def roll_forward(outings: DataFrame, today: str) -> DataFrame:
    """Rows to add: next year's expected event for each dated one that is over, unless its course and organizer have one within a month of it.

    Only the newest of a course, organizer and month is carried on. Titles and slugs move on a year.
    """
    over = outings.where((F.col("status") != "expected") & (F.coalesce("end_date", "start_date") < today))
    month = D.add_months(F.substring("start_date", 1, 7), 12)
    base = over.withColumn("month", month)
    rank = F.row_number().over(Window.partitionBy("course_id", "organizer_id", "month").orderBy(F.col("start_date").desc(), "id"))
    base = base.withColumn("rank", rank).where("rank = 1")
    there = outings.select(F.col("course_id").alias("c2"), F.col("organizer_id").alias("o2"), F.coalesce(F.substring("start_date", 1, 7), F.col("expected_month")).alias("m2"))
    same = (F.col("course_id") == F.col("c2")) & F.col("organizer_id").eqNullSafe(F.col("o2")) & (D.month_gap(F.col("month"), F.col("m2")) <= 1)
    fresh = base.join(there, same, "left_anti")
    year = F.substring("start_date", 1, 4)
    following = (year.cast("int") + 1).cast("string")
    return fresh.select(F.col("id").alias("previous_id"), "course_id", "organizer_id", F.lit("expected").alias("status"), F.col("month").alias("expected_month"), F.replace("title", year, following).alias("title"), F.concat(following, F.substring("slug", 5, 1000)).alias("slug"))


def alternates(outings: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``canonical_source_url``, ``source_gone`` of outings whose source is gone or came back. sources: id, url, misses, http_status; links: source_id, outing_id.

    A canonical source is gone after GONE_MISSES misses in a row. Then the first other linked source that is alive (no misses, a status below 400), by url, takes its place; without one the
    outing's source is marked as gone. The mark goes when the canonical source is alive again.
    """
    alive = (F.col("misses") == 0) & F.coalesce(F.col("http_status") < 400, F.lit(False))
    state = sources.select("id", "url", "misses", alive.alias("alive"))
    own = state.select(F.col("url").alias("canonical_source_url"), "misses", "alive")
    other = links.join(state.where("alive").select(F.col("id").alias("source_id"), "url"), "source_id").join(outings.select(F.col("id").alias("outing_id"), "canonical_source_url"), "outing_id")
    next_ = other.where("url <> canonical_source_url").groupBy("outing_id").agg(F.min("url").alias("next"))
    joined = outings.select("id", "canonical_source_url", F.col("source_gone").alias("was")).join(own, "canonical_source_url", "left").join(next_, F.col("id") == F.col("outing_id"), "left")
    gone = F.coalesce(F.col("misses") >= GONE_MISSES, F.lit(False))
    url = F.when(gone, F.coalesce("next", "canonical_source_url")).otherwise(F.col("canonical_source_url"))
    mark = F.when(gone, F.when(F.col("next").isNotNull(), 0).otherwise(1)).when(F.col("alive"), 0).otherwise(F.col("was"))
    out = joined.select("id", F.col("canonical_source_url").alias("old"), "was", url.alias("canonical_source_url"), mark.alias("source_gone"))
    return out.where((F.col("old") != F.col("canonical_source_url")) | (F.col("was") != F.col("source_gone"))).select("id", "canonical_source_url", "source_gone")


def expected_misses(outings: DataFrame, now: Column, zone: Column) -> DataFrame:
    """``id``, ``expected_month``, ``expected_misses``, ``published``, ``hold_reason`` of expected outings that nothing confirmed until a month after their month: at first they move on a year, the second time they are taken down as stale. ``zone``: a column of ``outings``."""
    month = F.substring(D.local_today(now, zone), 1, 7)
    due = outings.where((F.col("status") == "expected") & F.col("expected_month").isNotNull() & ~F.coalesce(F.col("hold_reason") == "expected_stale", F.lit(False)) & (month > D.add_months(F.col("expected_month"), 1)))
    again = F.col("expected_misses") > 0
    return due.select(
        "id", F.when(again, F.col("expected_month")).otherwise(D.add_months(F.col("expected_month"), 12)).alias("expected_month"), F.when(again, 2).otherwise(1).alias("expected_misses"),
        F.when(again, 0).otherwise(F.col("published")).alias("published"), F.when(again, "expected_stale").otherwise(F.col("hold_reason")).alias("hold_reason"),
    )


def recheck(outings: DataFrame, sources: DataFrame, links: DataFrame, now: Column, zone: Column) -> DataFrame:
    """The changes of a recheck, one row for each outing that changes or comes new: ``id`` (null: a new one), ``op``, ``previous_id`` and the new ``status``, ``canonical_source_url``, ``source_gone``, ``expected_month``, ``expected_misses``, ``published``, ``hold_reason``, ``next_outing_id``, ``slug``, ``title``.

    outings: id, course_id, organizer_id, slug, title, status, start_date, end_date, expected_month, expected_misses, published, hold_reason, source_gone, next_outing_id, canonical_source_url; ``zone`` of each. Dated
    ones that are over, by the calendar of their zone, become past; past ones with an organizer lead to next year's: to the first outing (by id) of their course and organizer within a month of
    that month, else to a new expected row, one for each course, organizer and month, whose slug is made free; none where that month is over by a month already.
    ``alternates`` and ``expected_misses`` change the rest. The new row's number is its predecessor's ``next_outing_id`` once it is stored.
    """
    rows = keep(outings.withColumn("_zone", zone))
    dated = F.col("status").isin("open", "waitlist", "sold_out", "cancelled")
    over = dated & F.col("start_date").isNotNull() & D.is_past(F.col("start_date"), F.col("end_date"), now, F.col("_zone"))
    over = F.coalesce(over, F.lit(False))
    month = D.add_months(F.substring("start_date", 1, 7), 12)
    ended = keep(rows.where((over | (F.col("status") == "past")) & F.col("next_outing_id").isNull() & F.col("organizer_id").isNotNull() & F.col("start_date").isNotNull()).select("id", "course_id", "organizer_id", "start_date", "slug", "title", "canonical_source_url", "_zone", month.alias("month")))
    of = F.when(F.col("status") == "expected", F.col("expected_month")).when(dated, F.substring("start_date", 1, 7))
    # months next to each other are equal keys of one of three copies
    there = rows.select("course_id", "organizer_id", F.col("id").alias("next_id"), of.alias("held")).where("held is not null").select("course_id", "organizer_id", "next_id", F.explode(F.array(*(D.add_months(F.col("held"), n) for n in (-1, 0, 1)))).alias("month"))
    met = ended.join(there, ["course_id", "organizer_id", "month"]).where("id <> next_id").groupBy("id").agg(F.min("next_id").alias("next_id"))
    fresh = ended.join(met, "id", "left_anti").where(~(D.add_months(F.col("month"), 1) < F.substring(D.local_today(now, F.col("_zone")), 1, 7)))
    rank = F.row_number().over(Window.partitionBy("course_id", "organizer_id", "month").orderBy("id"))
    fresh = fresh.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    year = F.substring("start_date", 1, 4)
    following = (year.cast("int") + 1).cast("string")
    rest = F.when(F.col("slug").contains("/"), F.expr("substring(slug, position('/' in slug) + 1)")).otherwise(F.col("slug"))
    fresh = fresh.select("id", "course_id", "organizer_id", "month", F.concat(following, F.lit("/"), rest).alias("base"), F.regexp_replace("title", F.concat(F.lit(r"\b"), year, F.lit(r"\b")), following).alias("title"), "canonical_source_url")
    new = free_slugs(fresh, rows.select("slug"), order="id")

    changed = rows.select("id", "status", "canonical_source_url", "source_gone", "expected_month", "expected_misses", "published", "hold_reason", "next_outing_id", over.alias("_over"))
    for part, name in ((alternates(rows, sources, links), "a"), (expected_misses(rows, now, F.col("_zone")), "m")):
        changed = changed.join(part.select(F.col("id"), F.struct(*[c for c in part.columns if c != "id"]).alias(name)), "id", "left")
    changed = changed.join(met.select("id", "next_id"), "id", "left")
    pick = lambda part, c: F.when(F.col(part).isNotNull(), F.col(part)[c]).otherwise(F.col(c)).alias(c)
    updates = changed.where("_over or a is not null or m is not null or next_id is not null").select(
        "id", F.lit("update").alias("op"), F.lit(None).cast("long").alias("previous_id"), F.when(F.col("_over"), "past").otherwise(F.col("status")).alias("status"),
        *(pick("a", c) for c in ("canonical_source_url", "source_gone")), *(pick("m", c) for c in ("expected_month", "expected_misses", "published", "hold_reason")),
        F.coalesce("next_id", "next_outing_id").alias("next_outing_id"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("string").alias("title"),
    )
    promoted = new.join(updates.select("id", F.col("canonical_source_url").alias("promoted")), "id", "left")
    inserts = promoted.select(
        F.lit(None).cast("long").alias("id"), F.lit("insert").alias("op"), F.col("id").alias("previous_id"), F.lit("expected").alias("status"), F.coalesce("promoted", "canonical_source_url").alias("canonical_source_url"),
        F.lit(0).alias("source_gone"), F.col("month").alias("expected_month"), F.lit(0).alias("expected_misses"), F.lit(0).alias("published"), F.lit(None).cast("string").alias("hold_reason"), F.lit(None).cast("long").alias("next_outing_id"), "slug", "title",
    )
    return updates.unionByName(inserts)


def source_misses(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Misses of each source after a run and whether it is gone: 404 and 410 count, anything else that came through starts anew."""
    joined = sources.join(fetched.select("id", F.col("outcome")), "id", "left")
    misses = F.when(F.col("outcome").isin("not_found", "gone"), F.col("misses") + 1).when(F.col("outcome").isin("ok", "not_modified"), 0).otherwise(F.col("misses"))
    return joined.withColumn("misses", misses).withColumn("gone", F.col("misses") >= GONE_MISSES)


def _slugs(rows: DataFrame, used: DataFrame) -> DataFrame:
    """``rows`` (ord, head, base, place) with the place that each asks for, and its ``slug``.

    Place 0 is the head, place 1 and on the base with the numbers that are not ``used`` (base, n; distinct), 1 being the base itself. Rows of a base that ask for a number ask in order, none for one that an earlier one
    asks for, and none for a place before its own.
    """
    in_order = Window.partitionBy("base").orderBy("ord")
    heads = rows.where("place = 0").withColumn("slug", F.col("head"))
    asked = rows.where("place > 0").withColumn("_i", F.row_number().over(in_order))
    asked = asked.withColumn("place", F.max(F.col("place") - F.col("_i")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_i")).drop("_i")
    # a used number moves on all places from the number of free ones below it on
    moved = used.withColumn("place", F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n")) + 1).select("base", "place", F.lit(1).alias("moves"), F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("head"))
    passed = F.sum("moves").over(Window.partitionBy("base").orderBy("place", F.col("moves").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = moved.unionByName(asked.withColumn("moves", F.lit(0))).withColumn("n", F.col("place") + passed).where("moves = 0")
    slug = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string")))
    return heads.unionByName(numbered.select("ord", "head", "base", "place", slug.alias("slug")))


def _given(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``ord``, ``slug``: each row (ord, head, base) in turn takes the first of its options that is free: its head, if it has one, then its base and the base's numbers.

    Every slug prefers the earliest row, so taking turns gives the one stable matching, found in rounds: rows ask for an option, the earliest has it, the others go on. Rows of one base move on together, and only bases whose
    rows lost a slug are looked at again; there are as many rounds as slugs that one base spells and another numbers stand in a row. Each is kept.
    """
    held = keep(taken.select("slug").distinct())
    rows = rows.join(held.withColumn("_taken", F.lit(True)).withColumnRenamed("slug", "head"), "head", "left")
    rows = keep(rows.select("ord", "head", "base", F.when(F.col("head").isNull() | F.col("_taken").isNotNull(), 1).otherwise(0).cast("long").alias("place")))
    stem, number = F.regexp_extract("slug", NUMBERED, 1), F.regexp_extract("slug", NUMBERED, 2).try_cast("long")
    used = held.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")).unionByName(held.where(stem != "").select(stem.alias("base"), number.alias("n")).where("n is not null"))
    used = keep(used.join(rows.select("base").distinct(), "base", "left_semi"))
    given = keep(_slugs(rows, used))
    while True:
        winners = given.groupBy("slug").agg(F.min("ord").alias("winner"), F.count("*").alias("rows")).where("rows > 1")
        lost = keep(given.join(winners, "slug").where(F.col("ord") != F.col("winner")).select("ord", "base"))
        if lost.isEmpty():
            return given.select("ord", "slug")
        met = lost.select("base").distinct()
        again = given.join(met, "base", "left_semi").join(lost.select("ord", F.lit(1).alias("_lost")), "ord", "left")
        again = again.select("ord", "head", "base", (F.col("place") + F.coalesce("_lost", F.lit(0))).alias("place"))
        given = keep(given.join(met, "base", "left_anti").unionByName(_slugs(again, used)))


def free_slugs(wanted: DataFrame, taken: DataFrame, base: str = "base", order: str = "ord") -> DataFrame:
    """``wanted`` with ``slug``: the first of base, base-2, base-3, ... that is neither ``taken`` (slug) nor given to an earlier row; ``order`` tells rows apart. Where a base spells another's number ("a-2"), the earlier row has it."""
    rows = wanted.select(F.col(order).alias("ord"), F.lit(None).cast("string").alias("head"), F.col(base).alias("base"))
    return wanted.join(_given(rows, taken).withColumnRenamed("ord", order), order)


def place_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``ord``, ``slug`` of new places: the base, else base-city, else base-city-2, -3, ..., the first that is neither ``taken`` (slug) nor given to an earlier one. wanted: ord (tells rows apart), base, city (as in slugs; null: the base itself is numbered)."""
    head, base = F.when(F.col("city").isNotNull(), F.col("base")), F.concat_ws("-", "base", "city")
    return _given(wanted.select("ord", head.alias("head"), base.alias("base")), taken)


def queue_bookkeeping(queue: DataFrame, results: DataFrame) -> DataFrame:
    """What becomes of each queued page: done and failed for good leave, others are tried again the next day. queue: url, tries; results: url, outcome."""
    tries = F.col("tries") + F.when(F.col("outcome").isNotNull(), 1).otherwise(0)
    done = F.col("outcome").isin("ok", "not_modified", "not_found", "gone")
    what = F.when(F.col("outcome").isNull(), "keep").when(done, "done").when(tries >= TRIES, "given_up").otherwise("retry")
    return queue.join(results, "url", "left").withColumn("what", what).withColumn("tries", tries).drop("outcome")
