"""What a run takes: queue merging, caps, budgets and rotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import keep

#: Fixed value: the share of a run's fetches that may go to events already known.
RECHECK_SHARE = 0.4


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_queue(entries: DataFrame) -> DataFrame:
    """One entry for each URL: the strongest priority and how that was found, the first known event, any bypass; ``ord`` of the first arrival. entries: url, host, priority, found_via, outing_id, bypass, needs_render, ord."""
    return entries.groupBy("url").agg(
        F.min("priority").alias("priority"),
        F.min_by("found_via", F.struct("priority", "ord")).alias("found_via"),
        F.min_by("outing_id", F.when(F.col("outing_id").isNotNull(), F.col("ord"))).alias("outing_id"),
        F.max("bypass").alias("bypass"),
        F.max("needs_render").alias("needs_render"),
        F.min("host").alias("host"),
        F.min("ord").alias("ord"),
    )


def capped_selection(queue: DataFrame, most: int, per_host: int, most_renders: int, share: float = RECHECK_SHARE) -> DataFrame:
    """``url`` and ``decision`` (fetch or deferred) under caps that act on each other: all fetches, rechecks, renders and each host's.

    In order of priority and arrival a row is taken unless a cap that it falls under is full. Of one host and kind no more than
    ``per_host`` rows can be taken, so the rest are left out beforehand; then as many rows as needed are walked in order,
    in one task, and more only while the walk leaves fetches free. That walk is bounded by the caps, not by the queue.
    """
    kind = [F.col("found_via") == "recheck", F.col("needs_render") == 1]
    order = ["priority", "ord"]
    rank = F.row_number().over(Window.partitionBy("host", *kind).orderBy(*order))
    able = queue.withColumn("_rank", rank).where(F.col("_rank") <= per_host).select("url", "host", "priority", "ord", kind[0].alias("recheck"), kind[1].alias("render"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        hosts: dict[str, int] = {}
        taken, rechecks, renders = [], 0, 0
        for r in rows.sort_values(order).itertuples():
            if len(taken) >= most:
                break
            if r.recheck and rechecks >= int(share * most) or hosts.get(r.host, 0) >= per_host or r.render and renders >= most_renders:
                continue
            taken.append(r.url)
            hosts[r.host] = hosts.get(r.host, 0) + 1
            rechecks, renders = rechecks + bool(r.recheck), renders + bool(r.render)
        return pd.DataFrame({"url": taken})

    looked, total = 4 * most, able.count()
    while True:
        taken = able.orderBy(*order).limit(looked).groupBy(F.lit("all").alias("_all")).applyInPandas(walk, "url string")
        if looked >= total or taken.count() >= most:
            break
        looked *= 4
    marked = taken.withColumn("decision", F.lit("fetch"))
    return queue.select("url").join(marked, "url", "left").select("url", F.coalesce("decision", F.lit("deferred")).alias("decision"))


def capped_prefix(rows: DataFrame, order: list, key: str, most_rows: int, weight: str | None = None, budget: int | None = None) -> DataFrame:
    """``rows`` with ``taken``: whether a row comes before the first, in order, that would break the number of rows or the budget of a weight.

    No more than ``most_rows`` can be taken, so only those first rows are summed up in order, whatever the number of rows; ``key`` tells rows apart.
    """
    head = rows.orderBy(*order).limit(most_rows)
    if weight is not None and budget is not None:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        head = head.withColumn("_sum", F.sum(weight).over(upto)).withColumn("_over", F.max((F.col("_sum") > budget).cast("int")).over(upto)).where("_over = 0")
    return rows.join(head.select(key).withColumn("_taken", F.lit(True)), key, "left").withColumn("taken", F.coalesce("_taken", F.lit(False))).drop("_taken")


def numbered(rows: DataFrame, order: list, within: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """``rows`` with their place (from 0) in the order, within each value of the columns ``within`` (no nulls there).

    Rows are dealt by range and numbered inside their partitions; only one row for each partition is summed up in one task. The dealt rows are kept, as both
    branches read them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(n, *within, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*within or [F.lit(1)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*within, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(starts, [*within, "_part"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def rotation(rows: DataFrame, order: list, nights: int, night: int) -> DataFrame:
    """Every nights-th row of an order, another each night."""
    return numbered(rows, order).where(F.col("place") % nights == night % nights)


def rotating_window(rows: DataFrame, order: list, cap: int, run: int) -> DataFrame:
    """The run's ``cap`` rows of an order that goes round and round; all rows if there are no more than that."""
    n = rows.count()
    start = (run * cap) % n if n else 0
    step = F.pmod(F.col("place") - start, F.lit(max(n, 1)))
    return numbered(rows, order).withColumn("step", step).where(F.col("step") < cap)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, as an unsigned number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * 16_777_619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(2_166_136_261), step)


def due_tonight(name: Column, cadence: Column, day: int) -> Column:
    """Daily sources run every night, a weekly one on the night that its name draws."""
    return (cadence == "daily") | (fnv1a(name) % 7 == day % 7)


def insertion_positions(rows: DataFrame, page: list[str], order: list, first: int = 3, every: int = 8) -> DataFrame:
    """Rows after which something is inserted: the first-th shown one and then every so many, if another shown row follows."""
    w = Window.partitionBy(*page)
    counted = rows.where("shown").withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return counted.where((F.col("n") >= first) & ((F.col("n") - first) % every == 0) & (F.col("n") < F.col("total")))


def positions_in_groups(positions: DataFrame, groups: DataFrame) -> DataFrame:
    """Page-wide positions (page, position, ordinal; from 0) as ``group`` and ``position`` in it: consecutive groups (page, group, length) of a page share its positions in the order of ``group``. Positions beyond the last group go."""
    so_far = Window.partitionBy("page").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = groups.withColumn("until", F.sum("length").over(so_far)).withColumn("offset", F.col("until") - F.col("length")).select("page", "group", "offset", "until")
    inside = positions.join(spans, "page").where((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("until")))
    return inside.select("page", "group", (F.col("position") - F.col("offset")).alias("position"), "ordinal")


def between_shown(items: DataFrame, page: list[str], order: list) -> DataFrame:
    """Inserted items (``inserted``) that have a shown row both before and after them."""
    w = Window.partitionBy(*page).orderBy(*order)
    shown = (F.col("shown") & ~F.col("inserted")).cast("int")
    before = F.max(shown).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(shown).over(w.rowsBetween(1, Window.unboundedFollowing))
    return items.withColumn("before", before).withColumn("after", after).where("inserted and before = 1 and after = 1").drop("before", "after")


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def running_sum(rows: DataFrame, order: list, weight: str, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``weight`` up to and with each row, in an order that tells rows apart. Rows are dealt by range and summed inside their partitions; one row for each partition is summed up in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum(weight).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_in", inside).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


#: Child sitemaps of a list that are read; links of a source that a run takes; the order of feeds.
CHILD_SITEMAPS, SOURCE_LINKS = 5, 40
FEEDS = ("series", "platform", "association", "directory")


def feed_links(sources: DataFrame, reads: DataFrame, links: DataFrame, day: int, budget: int, most: int = SOURCE_LINKS) -> DataFrame:
    """The links that a run takes from its sources, under one budget of pages read: ``source``, ``url``, ``title``, ``place`` (its order among the source's).

    sources: source, feed, ord, allowed, cadence, slug; reads: source, list, child (null: the list itself), the pages that a source would have read; links: source, list, child, ord, url, title. Feeds come in
    order, sources in theirs. Those that are not allowed or not due tonight are left out. Of a list's children only the first CHILD_SITEMAPS are read. A source whose pages the budget no longer covers ends
    the run's reading, with all sources after it. Of one URL of a source the first link counts. A series gives its first ``most`` links, others the window that their nights have come to.
    """
    feed = F.lit(len(FEEDS))
    for i, name in enumerate(FEEDS):
        feed = F.when(F.col("feed") == name, i).otherwise(feed)
    due = (F.col("feed") == "series") | (F.col("allowed") & due_tonight(F.col("slug"), F.col("cadence"), day))
    open_ = sources.where(due).select("source", feed.alias("feed"), "ord", "cadence")
    in_reach = F.col("child").isNull() | (F.col("child") < CHILD_SITEMAPS)
    pages = reads.where(in_reach).groupBy("source").agg(F.count("*").alias("pages"))
    costed = running_sum(open_.join(pages, "source", "left").withColumn("pages", F.coalesce("pages", F.lit(0))), ["feed", "ord", "source"], "pages")
    read = keep(costed.where(F.col("upto") <= budget).select("source", "feed", "cadence"))

    at = F.struct("list", F.coalesce("child", F.lit(-1)).alias("child"), "ord")
    first = links.where(in_reach).join(read, "source").groupBy("source", "feed", "cadence", "url").agg(F.min(at).alias("at"), F.min_by("title", at).alias("title"))
    placed = numbered(first.withColumn("_at", F.col("at")), ["_at", "url"], ("source",)).drop("_at")
    counted = keep(placed).join(first.groupBy("source").agg(F.count("*").alias("n")), "source")
    run = F.when(F.col("cadence") == "daily", day).otherwise(day // 7)
    turned = F.pmod(F.col("place") - F.pmod(run * most, F.col("n")), F.col("n"))
    place = F.when((F.col("feed") == 0) | (F.col("n") <= most), F.col("place")).otherwise(turned)
    return counted.withColumn("place", place).where(F.col("place") < most).select("source", "url", "title", "place")


def search_plan(metros: DataFrame, courses: DataFrame, day: str, cap: int, states: list[str] | None = None, backfill: int | None = None) -> DataFrame:
    """The search queries of a night, within a cap: ``place`` (from 0), ``kind``, ``q``, ``subject``.

    metros: ord (their order), name, state; courses: id, name, state (those worth a query). ``states`` come first, in their order and whatever the night; then what tonight's turn brings: metros by weekday
    from April to September, else by day of the month, as courses always. Years are this one, from September the next one too, from December only that.
    ``backfill`` takes one page (from 1) of metros that fit the cap in place of tonight's. No more than ``cap`` subjects can have a query, so only those are written out and counted in order.
    """
    date = pd.Timestamp(day)
    years = [date.year + 1] if date.month == 12 else [date.year, date.year + 1] if date.month >= 9 else [date.year]
    number, days, weekly = (date - pd.Timestamp("1970-01-01")).days, date.days_in_month, 4 <= date.month <= 9
    order = [s.upper() for s in states or []]
    rank = F.lit(len(order))
    for i, state in enumerate(order):
        rank = F.when(F.upper("state") == state, i).otherwise(rank)
    size = max(1, cap // (2 * len(years) + 1))
    tonight = F.col("place") % 7 == number % 7 if weekly else F.col("place") % days == date.day - 1
    city, subject = F.concat_ws(" ", "name", "state"), F.concat_ws(", ", "name", "state")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    queries = [*(say("golf outing ", city, f" {y}") for y in years), *(say("charity golf tournament ", city, f" {y}") for y in years), say("golf scramble ", city, f" {date.month_name()}")]
    placed = numbered(metros, ["ord"])
    if backfill is None:
        placed = placed.withColumn("rank", rank).where((F.col("rank") < len(order)) | tonight)
    else:
        placed = placed.where(F.floor(F.col("place") / size) == backfill - 1).withColumn("rank", F.lit(-1))
    by_place = placed.select("rank", F.lit(0).alias("feed"), "place", F.lit("place").alias("kind"), subject.alias("subject"), F.array(*queries).alias("q"))
    name = F.replace("name", F.lit('"'))
    asked = [*(say('"', name, f'" golf outing {y}') for y in years), say('"', name, '" golf classic register')]
    by_course = numbered(courses, ["id"]).withColumn("rank", rank).where((F.col("rank") < len(order)) | (F.col("place") % days == date.day - 1))
    by_course = by_course.select("rank", F.lit(1).alias("feed"), "place", F.lit("course").alias("kind"), F.col("id").cast("string").alias("subject"), F.array(*asked).alias("q"))
    subjects = by_place.unionByName(by_course).orderBy("rank", "feed", "place").limit(cap)
    first = subjects.select("rank", "feed", F.col("place").alias("subject_place"), "kind", "subject", F.posexplode("q").alias("n", "q")).orderBy("rank", "feed", "subject_place", "n").limit(cap)
    in_order = Window.orderBy("rank", "feed", "subject_place", "n")
    return first.withColumn("place", (F.row_number().over(in_order) - 1).cast("long")).select("place", "kind", "q", "subject")
