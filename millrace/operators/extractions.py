"""What a model's answers about pages come to: events that hold, events that are rejected, answers that failed, in one step."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import extraction as E
from ..functions import text as T
from ..functions import urls as U
from . import state as S
from .kept import keep
from .selection import first_wins

#: Events of a page, characters of a summary and dollars of a price at most; what an event's status may be.
MOST_EVENTS, LONGEST_SUMMARY, HIGHEST_PRICE = 25, 300, 25_000
STATUSES = ("open", "waitlist", "sold_out", "cancelled", "unknown")
TEXTS = ("organizer_name", "organizer_ein", "course_name", "venue_city", "start_date", "end_date", "shotgun_time", "registration_url")
EVENT = (
    "title string, summary string, start_date string, end_date string, shotgun_time string, organizer_name string, organizer_ein string, course_name string, venue_state string, venue_city string, "
    "single_price_usd double, foursome_price_usd double, sponsor_only boolean, is_outing boolean, reject_reason string, lodging_required boolean, status string, registration_url string, evidence struct<date:string,price:string,venue:string>"
)


class Collected(NamedTuple):
    """events: page_url, event_index, the fields of an event, confidence, hold_reason. rejected: page_url, event_index, reason. failed: custom_id, reason."""

    events: DataFrame
    rejected: DataFrame
    failed: DataFrame


def _trimmed(text: Column) -> Column:
    return T.let(F.regexp_replace(text, r"^\s+|\s+$", ""), lambda bare: F.when(bare != "", bare))


def collected(results: DataFrame, meta: DataFrame, now: Column, zone: Callable[[Column], Column], year: int, hosts: list[str]) -> Collected:
    """The events of all answers, checked, scored and held.

    results: custom_id, ord, kind, error, stop_reason, text; of a request's answers the first counts. meta: custom_id, page_url, page_text (nullable), dates (of the page's structured events). ``zone`` of a
    state (the one whose day begins last); ``year``: this one; ``hosts``: where registration links may lead, besides the page's own domain.

    An answer fails if it did not come through, has no request, stopped early, or is no JSON of at most MOST_EVENTS events. An event is rejected for the first of: a schema that doesn't fit, no title, dates that
    don't parse or stand in order, a link in its summary, a year that the page doesn't bear out, a day that is over. Free events are no outings. An outing without a day, of unknown status or with
    too little confidence is held.
    """
    first = first_wins(results, ["custom_id"], ["ord"]).join(meta, "custom_id", "left")
    parsed = F.try_parse_json(F.col("text"))
    raw = F.from_json("text", "events array<string>").getField("events")
    failure = (
        F.when(F.col("page_url").isNull(), "no request")
        .when(F.col("kind") != "succeeded", F.concat(F.lit("batch result "), F.col("kind"), F.coalesce(F.concat(F.lit(" ("), F.col("error"), F.lit(")")), F.lit(""))))
        .when(~F.col("stop_reason").eqNullSafe("end_turn"), F.concat(F.lit("stop_reason "), F.coalesce("stop_reason", F.lit("null"))))
        .when(parsed.isNull(), "output is not JSON")
        .when(F.col("raw").isNull() | (F.size("raw") > MOST_EVENTS), "output is not a list of events")
    )
    answers = keep(first.withColumn("raw", raw).withColumn("failure", failure))
    failed = answers.where("failure is not null").select("custom_id", F.col("failure").alias("reason"))
    rows = answers.where("failure is null").select("page_url", "page_text", "dates", (F.size("raw") == 1).alias("single"), F.posexplode("raw").alias("event_index", "raw"))
    rows = rows.withColumn("e", F.from_json("raw", EVENT)).select("page_url", "page_text", "dates", "single", "event_index", "e.*")
    for c in TEXTS:
        rows = rows.withColumn(c, _trimmed(F.col(c)))
    rows = rows.withColumn("venue_state", F.upper(_trimmed(F.col("venue_state")))).withColumn("title", F.regexp_replace("title", r"^\s+|\s+$", "")).withColumn("summary", F.regexp_replace("summary", r"^\s+|\s+$", ""))
    rows = rows.withColumn("p", E.preferred_date(F.col("start_date"), F.coalesce("dates", F.array().cast("array<string>")), F.col("single")))
    start = F.col("p.start_date")
    end = F.when(F.col("end_date") >= start, F.col("end_date"))
    price_fits = lambda c: F.col(c).isNull() | F.col(c).between(0, HIGHEST_PRICE)
    schema = F.col("title").isNull() | F.col("summary").isNull() | (F.length("summary") > LONGEST_SUMMARY) | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) | ~price_fits("single_price_usd") | ~price_fits("foursome_price_usd")
    today = D.local_today(now, zone(F.col("venue_state")))
    odd_end = F.col("end_date").isNotNull() & (F.col("start_date").isNull() | (F.col("end_date") < F.col("start_date")))
    reason = (
        F.when(schema, "schema").when(F.col("title") == "", "empty title")
        .when(F.col("start_date").isNotNull() & ~D.is_iso_date(F.col("start_date")), "start_date does not parse").when(F.col("end_date").isNotNull() & ~D.is_iso_date(F.col("end_date")), "end_date does not parse")
        .when(odd_end, "end_date without or before start_date").when(E.contains_url(F.col("summary")), "summary contains a URL")
    )
    year_problem = F.when(start.isNotNull() & ~F.col("p.from_structured"), E.year_problem(start, F.col("evidence.date"), F.col("page_text"), F.col("page_url"), F.col("title"), year))
    over = F.when(F.coalesce(end, start) < today, F.concat(F.lit("past: "), start, F.lit(" before "), today))
    judged = keep(rows.withColumn("new_end", end).withColumn("reason", F.coalesce(reason, year_problem, over)))
    rejected = judged.where("reason is not null").select("page_url", "event_index", "reason")

    good = judged.where("reason is null")
    shown = E.stated_foursome(F.col("single_price_usd"), F.col("foursome_price_usd"), F.col("page_text"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    outing = F.col("is_outing") & F.col("reject_reason").isNull() & ~F.coalesce("lodging_required", F.lit(False))
    free = E.is_free_event(F.col("single_price_usd"), F.col("foursome_price_usd"), F.col("sponsor_only"), F.coalesce("evidence.price", F.lit("")))
    good = good.withColumn("_outing", F.coalesce(outing, F.lit(False))).withColumn("_free", F.col("_outing") & free)
    good = good.withColumn("is_outing", F.when(F.col("_free"), False).otherwise(F.col("is_outing"))).withColumn("reject_reason", F.when(F.col("_free"), "other").otherwise(F.col("reject_reason"))).withColumn("_outing", F.col("_outing") & ~F.col("_free"))
    good = good.withColumn("single_price_cents", cents("single_price_usd")).withColumn("foursome_price_cents", F.when(shown, cents("foursome_price_usd")))
    evidence = F.struct(*(E.clean_evidence(F.col(f"evidence.{c}")).alias(c) for c in ("date", "price", "venue")))
    good = good.withColumn("evidence", evidence)
    dated = start.isNotNull() & (F.col("evidence.date").isNotNull() | F.col("p.from_structured"))
    priced = F.col("single_price_cents").isNotNull() | F.col("foursome_price_cents").isNotNull() | ~F.col("_outing")
    good = good.withColumn("confidence", S.confidence(dated, F.col("course_name").isNotNull(), F.col("venue_state").isNotNull(), priced, F.coalesce("sponsor_only", F.lit(False)), F.col("p.disagrees")))
    hold = F.when(F.col("_outing"), F.when(start.isNull(), "no_date").when(F.col("status") == "unknown", "status_unknown").when(F.col("confidence") < S.PUBLISH_CONFIDENCE, "low_confidence"))
    digits = F.regexp_replace("organizer_ein", r"\D", "")
    link = F.col("registration_url")
    # hosts are told once for each event
    good = good.withColumn("_host", U.host(link)).withColumn("_page_host", U.host(F.col("page_url")))
    allowed = F.coalesce(U.domain(F.col("_host")) == U.domain(F.col("_page_host")), F.lit(False)) | F.exists(U.suffixes(F.coalesce("_host", F.lit(""))), lambda s: s.isin(*hosts))
    events = good.select(
        "page_url", "event_index", "title", "summary", start.alias("start_date"), F.col("new_end").alias("end_date"), F.when(D.is_time(F.col("shotgun_time")), F.col("shotgun_time")).alias("shotgun_time"), "organizer_name", F.when(F.length(digits) == 9, digits).alias("organizer_ein"),
        "course_name", "venue_state", "venue_city", "single_price_cents", "foursome_price_cents", "sponsor_only", "is_outing", "reject_reason", "status", F.when(allowed, U.normalize(link)).alias("registration_url"), "evidence", "confidence", hold.alias("hold_reason"),
    )
    return Collected(events, rejected, failed)
