"""Ids that the same key always gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the letters and digits of ULIDs; and those of plain base 32, which Spark writes.
_ULID = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _base32(number: Column, base: int, length: int) -> Column:
    return F.translate(F.lpad(F.conv(number, base, 32), length, "0"), _PLAIN, _ULID)


def ulid(milliseconds: Column, random_hex: Column) -> Column:
    """26 characters: 48 bits of time and 80 bits given as 20 hexadecimal digits."""
    halves = [_base32(F.substring(random_hex, start, 10), 16, 8) for start in (1, 11)]
    return F.concat(_base32(milliseconds.cast("string"), 10, 10), *halves)


def stable_id(prefix: str, milliseconds: Column, key: Column) -> Column:
    """``prefix``_ULID whose random part is a hash of prefix and key."""
    return F.concat(F.lit(f"{prefix}_"), ulid(milliseconds, F.sha2(F.concat(F.lit(f"{prefix}:"), key), 256)))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat(F.lit("source:"), url), 256), 1, 40))


def is_ulid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9A-HJKMNP-TV-Z]{26}$"), F.lit(False))
