"""How dates, prices and events read on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import format_usd

#: What codes are called.
COURSE_TYPES = {"municipal": "Municipal", "public": "Public", "semi_private": "Semi-private", "private": "Private", "resort": "Resort", "unknown": "Course type unknown"}
FORMATS = {"scramble": "Scramble", "best_ball": "Best ball", "shamble": "Shamble", "stroke": "Stroke play", "other": "Other format"}
INCLUDED = {"lunch": "lunch", "breakfast": "breakfast", "dinner": "dinner", "cart": "cart", "caddie": "caddie", "range": "range balls", "gift": "player gift", "contests": "on-course contests"}


def named(code: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def _date(iso: Column) -> Column:
    return F.when(F.length(iso) == 7, F.concat(iso, F.lit("-01"))).otherwise(iso).cast("date")


def short_date(iso: Column) -> Column:
    return F.date_format(_date(iso), "MMM d, yyyy")


def long_date(iso: Column) -> Column:
    return F.date_format(_date(iso), "EEEE, MMMM d, yyyy")


def month_year(iso: Column) -> Column:
    return F.date_format(_date(iso), "MMMM yyyy")


def clock(time: Column) -> Column:
    return F.date_format(F.to_timestamp(F.concat(F.lit("2000-01-01 "), time), "yyyy-MM-dd HH:mm"), "h:mm a")


def date_range(start: Column, end: Column) -> Column:
    a, b = _date(start), _date(end)
    same_year, same_month = F.year(a) == F.year(b), F.month(a) == F.month(b)
    day = lambda x: F.date_format(x, "MMM d")
    year = F.date_format(a, "yyyy")
    within = F.concat(day(a), F.lit(" to "), F.date_format(b, "d"), F.lit(", "), year)
    across = F.concat(day(a), F.lit(" to "), day(b), F.lit(", "), year)
    return F.when(end.isNull() | (end == start), short_date(start)).when(same_year & same_month, within).when(same_year, across).otherwise(F.concat(short_date(start), F.lit(" to "), short_date(end)))


def includes(items: Column) -> Column:
    """"Includes lunch, cart and dinner." of the known items; empty if there are none."""
    words = F.filter(F.transform(items, lambda i: named(i, INCLUDED)), lambda w: w.isNotNull())
    n = F.size(words)
    several = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1))
    return F.when(n == 0, "").otherwise(F.concat(F.lit("Includes "), F.when(n == 1, F.get(words, F.lit(0))).otherwise(several), F.lit(".")))


def price(single: Column, foursome: Column, sponsor_only: Column) -> Column:
    bits = F.concat_ws(", ", F.when(single.isNotNull(), F.concat(format_usd(single), F.lit(" per player"))), F.when(foursome.isNotNull(), F.concat(format_usd(foursome), F.lit(" per foursome"))))
    return F.when(bits != "", bits).when(sponsor_only, "Foursomes through sponsorship").otherwise("See site")


def place(city: Column, state: Column) -> Column:
    return F.concat_ws(", ", city, F.upper(state))


def when(status: Column, start: Column, end: Column, month: Column) -> Column:
    expected = F.when(start.isNotNull(), F.concat(F.lit("Expected "), long_date(start))).when(month.isNotNull(), F.concat(F.lit("Expected in "), month_year(month), F.lit(", date not yet announced"))).otherwise("Date not yet announced")
    dated = F.when(start.isNull(), "Date not yet announced").when(end.isNotNull() & (end != start), date_range(start, end)).otherwise(long_date(start))
    return F.when(status == "expected", expected).otherwise(dated)


def event_title(title: Column, course: Column, city: Column, state: Column, status: Column, start: Column, month: Column) -> Column:
    named_in = F.contains(F.lower(title), F.lower(course))
    where = F.concat(title, F.when(named_in, "").otherwise(F.concat(F.lit(" at "), course)), F.lit(", "), place(city, state))
    at = F.coalesce(month, start)
    later = F.when(at.isNotNull(), F.concat(where, F.lit(" (expected "), month_year(at), F.lit(")"))).otherwise(where)
    return F.when(status == "expected", later).when(start.isNotNull(), F.concat(where, F.lit(" ("), short_date(start), F.lit(")"))).otherwise(where)


def date_block(status: Column, start: Column, end: Column, month: Column) -> Column:
    """Three lines of a calendar leaf: top, big, bottom."""
    a, b = _date(start), _date(end)
    two = end.isNotNull() & (end != start)
    top = F.when(status == "expected", "Expected")
    big = F.when(two, F.concat(F.dayofmonth(a).cast("string"), F.lit("–"), F.dayofmonth(b).cast("string"))).otherwise(F.dayofmonth(a).cast("string"))
    months = F.when(two & (F.month(a) != F.month(b)), F.concat(F.date_format(a, "MMM"), F.lit("–"), F.date_format(b, "MMM"))).otherwise(F.date_format(a, "MMM"))
    leaf = lambda t, m, u: F.struct(t.alias("top"), m.alias("big"), u.alias("bottom"))
    whole = leaf(F.coalesce(top, F.date_format(a, "EEE")), big, F.concat(months, F.lit(" "), F.year(a).cast("string")))
    only_month = leaf(F.coalesce(top, F.lit("")), F.date_format(_date(month), "MMM"), F.year(_date(month)).cast("string"))
    return F.when(start.isNotNull(), whole).when(month.isNotNull(), only_month).otherwise(leaf(F.lit("Date"), F.lit("–"), F.lit("to come")))
