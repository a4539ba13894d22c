"""Checks of extracted events, and which URL an event is about, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import urls as U

#: What looks like a link, an e-mail address or a year; most words of a quote; how far before a quote a page's date counts.
LINK = r"(?i)(https?:\/\/|www\.)\S+|\b[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}\/\S*"
EMAIL = r"(?i)\b[^\s@]+@[^\s@]+\.[a-z]{2,}\b"
YEAR = r"\b(19[5-9]\d|20\d{2})\b"
FREE = r"(?i)\bfree\b"
QUOTE_WORDS, QUOTE_START, DATE_REACH = 20, 40, 400


def contains_url(text: Column) -> Column:
    """Whether a text carries a link or an e-mail address."""
    return text.rlike(LINK) | text.rlike(EMAIL)


def word_count(text: Column) -> Column:
    return F.size(T.words(F.trim(text), r"\s+"))


def clean_evidence(quote: Column) -> Column:
    """The trimmed quote; null if it is empty or has more than QUOTE_WORDS words."""
    q = F.regexp_replace(quote, r"^\s+|\s+$", "")
    return F.when((q != "") & (word_count(q) <= QUOTE_WORDS), q)


def _years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def year_problem(start_date: Column, evidence: Column, page: Column, url: Column, title: Column, year: int) -> Column:
    """Why an event's year cannot be trusted, or null.

    The quote gives an earlier year; or the page gives the event's year nowhere; or the quote gives none, and the last year that the page gives shortly
    before it is an earlier one. Without a page only the first can be told.
    """
    quote = F.coalesce(evidence, F.lit(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    event_year = F.substring(start_date, 1, 4)
    stated = F.concat_ws(" ", page, decoded, title, quote).contains(event_year)
    at = F.when(quote != "", F.position(F.lower(F.substring(quote, 1, QUOTE_START)), F.lower(page))).otherwise(0)
    before = lambda at: F.substring(page, F.greatest(at - DATE_REACH, F.lit(1)), F.when(at > DATE_REACH, F.lit(DATE_REACH)).otherwise(F.greatest(at - 1, F.lit(0))))
    last = lambda years: F.when(F.size(years) > 0, F.element_at(years, -1))
    nearest = T.let(at, lambda found: F.when(found > 0, T.let(_years(before(found)), last)))
    dated = T.let(nearest, lambda y: F.when(y < year, F.concat(F.lit("past: the page is dated "), y.cast("string"))))

    def problem(quoted: Column, early: Column) -> Column:
        return (
            F.when(early.isNotNull(), F.concat(F.lit("past: the page states "), early.cast("string")))
            .when(page.isNull(), None)
            .when(~stated, F.concat(F.lit("year "), event_year, F.lit(" is not stated on the page")))
            .when(F.size(quoted) == 0, dated)
        )

    return T.let(_years(quote), lambda quoted: T.let(F.get(F.filter(quoted, lambda y: y < year), F.lit(0)), lambda early: problem(quoted, early)))


def is_free_event(single: Column, foursome: Column, sponsors_only: Column, quote: Column) -> Column:
    """Nobody pays to enter: a price of 0, or "free" where no price is given. Not if only sponsors enter."""
    zero = (single == 0) & (foursome.isNull() | (foursome == 0))
    said = single.isNull() & foursome.isNull() & F.coalesce(quote.rlike(FREE), F.lit(False))
    return ~F.coalesce(sponsors_only, F.lit(False)) & (F.coalesce(zero, F.lit(False)) | said)


def stated_foursome(single: Column, foursome: Column, page: Column) -> Column:
    """False if a foursome's price is four times a single's and the page does not show the amount."""
    times_four = F.abs(foursome - single * 4) <= 0.005
    amount = F.round(foursome).cast("long")
    shown = F.concat(F.lit(" "), page, F.lit(" "))
    numbers = F.regexp_extract_all(shown, F.lit(r"(?<![\d,])(\d[\d,]*)(?:\.00)?(?![\d,])"), F.lit(1))
    found = F.array_contains(numbers, amount.cast("string")) | F.array_contains(numbers, F.format_number(amount, 0))
    return F.when(single.isNull() | page.isNull() | ~times_four, True).otherwise(found)


def preferred_date(start_date: Column, structured: Column, single_event: Column) -> Column:
    """A struct of ``start_date``, ``disagrees`` and ``from_structured`` from a page's text and its structured dates (array of ISO dates, nulls allowed).

    On a page of one event the first structured date counts, on others only one that agrees.
    """
    chosen = F.when(single_event, F.get(F.filter(structured, lambda d: d.isNotNull()), F.lit(0))).otherwise(F.when(F.array_contains(structured, start_date), start_date))
    return T.let(chosen, lambda day: F.struct(F.coalesce(day, start_date).alias("start_date"), F.coalesce(day != start_date, F.lit(False)).alias("disagrees"), day.isNotNull().alias("from_structured")))


def canonical_url(source_url: Column, registration_url: Column, directory_host: Column) -> Column:
    """The page itself; of a directory's page the registration link, if that leaves the directory."""
    away = F.coalesce(U.domain(U.host(registration_url)) != U.domain(directory_host), F.lit(False))
    return F.when(away, registration_url).otherwise(source_url)


def organizer_domain(source_url: Column, registration_url: Column, directory_host: Column) -> Column:
    return F.coalesce(U.domain(U.host(canonical_url(source_url, registration_url, directory_host))), F.lit(""))


def charity_status(subsection: Column) -> Column:
    return F.when(subsection.isNull(), "unverified").when(subsection == "03", "501c3").otherwise("other_nonprofit")


def outing_type(domain: Column, organizer: Column, hint: Column, subsection: Column, charity: Column, access: list[str], tournaments: list[str]) -> Column:
    """The first rule that holds: operators of access days and tournaments by domain, then the page's hint, schools, business leagues, charities. hint may be null."""
    hinted = lambda kind: F.coalesce(hint == kind, F.lit(False))
    within = lambda hosts: F.exists(U.suffixes(F.coalesce(domain, F.lit(""))), lambda s: s.isin(*hosts)) if hosts else F.lit(False)
    return (
        F.when(within(access), "access_day")
        .when(within(tournaments) | hinted("open_tournament"), "open_tournament")
        .when(hinted("pro_am"), "pro_am")
        .when(hinted("school_fundraiser") | T.is_school(organizer), "school_fundraiser")
        .when(F.coalesce(subsection == "06", F.lit(False)) | hinted("business_association"), "business_association")
        .when(F.coalesce(charity == "501c3", F.lit(False)) | hinted("charity"), "charity")
        .otherwise("other")
    )
