"""Money as whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CENTS = 2_500_000


def dollars_to_cents(dollars: Column) -> Column:
    """Rounded at the sixth place first, so that 150.005 is not a hair below the half cent."""
    return F.floor(F.round(dollars * 100, 6) + 0.5).cast("long")


def format_usd(cents: Column) -> Column:
    whole = F.format_number(F.floor(F.abs(cents) / 100), 0)
    fraction = F.when(F.abs(cents) % 100 == 0, "").otherwise(F.concat(F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")))
    return F.when(cents.isNull(), "").otherwise(F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), whole, fraction))


def parse_usd(text: Column) -> Column:
    """Cents of an amount such as "USD 1,250.5"; null for anything else."""
    pattern = r"(?i)^\s*(?:usd\s*)?\$?\s*(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?\s*$"
    whole = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("long")
    return F.when(text.rlike(pattern), whole * 100 + F.rpad(F.regexp_extract(text, pattern, 2), 2, "0").try_cast("long"))


def is_plausible(cents: Column) -> Column:
    return F.coalesce((cents >= 0) & (cents <= MOST_CENTS), F.lit(False))


def cost_cents(units: dict[str, tuple[Column, int]]) -> Column:
    """Whole cents, rounded up, of amounts with rates in millionths of a cent."""
    total = F.lit(0).cast("long")
    for amount, rate in units.values():
        total = total + amount.cast("long") * F.lit(rate).cast("long")
    return F.ceil(total / 1_000_000).cast("long")
