"""Joins of texts that are alike by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "array<struct<length:int,piece:int,text:string>>"


def _edits(length: Column, least: float) -> Column:
    """The most edits between a text of this length and one that is alike."""
    return F.floor((1 - least) * F.floor(length / least + 1e-9) + 1e-9).cast("int")


def _span(length: Column, piece: Column, pieces: Column) -> tuple[Column, Column]:
    """Where a piece begins (from 1) and how long it is."""
    at = F.floor(length * piece / pieces).cast("int")
    return at + 1, (F.floor(length * (piece + 1) / pieces) - at).cast("int")


def similar_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` of all pairs whose texts have 1 - edits / longer length of ``least`` or more; both empty is not alike. left: a, text; right: b, text (equal texts may repeat).

    A text that may be e edits away is cut into e + 1 pieces, one of which stands whole in the other, at most e places off. So the right texts' pieces are keys, by length and place, and the left
    ones look up all places where a piece of a text of a fitting length could be. Pairs that meet are compared once each.
    """
    size = lambda t: F.length(t)
    right = right.where(F.length("text") > 0).select("b", "text")
    left = left.where(F.length("text") > 0).select("a", "text")
    n = _edits(size("text"), least) + 1
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(size("text").alias("length"), i.alias("piece"), F.substring(F.col("text"), *_span(size("text"), i, n)).alias("text")))
    keys = right.select("b", F.col("text").alias("text_b"), F.explode(pieces).alias("key"))

    def places(length: Column) -> Column:
        e = _edits(length, least)

        def of_piece(i: Column) -> Column:
            at, long = _span(length, i, e + 1)
            low, high = F.greatest(F.lit(1), at - e), F.least(at + e, size("text") - long + 1)
            found = F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.struct(length.alias("length"), i.alias("piece"), F.substring(F.col("text"), p, long).alias("text")))
            return F.when((low <= high) & (long > 0), found).otherwise(F.array().cast(_EMPTY))

        return F.flatten(F.transform(F.sequence(F.lit(0), e), of_piece))

    shortest, longest = F.ceil(size("text") * least - 1e-9).cast("int"), F.floor(size("text") / least + 1e-9).cast("int")
    looked = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), shortest), longest), places)))
    met = left.select("a", F.col("text").alias("text_a"), F.explode(looked).alias("key")).join(keys, "key").select("a", "b", "text_a", "text_b").distinct()
    alike = 1 - F.levenshtein("text_a", "text_b") / F.greatest(F.length("text_a"), F.length("text_b"))
    return met.where(alike >= least).select("a", "b")
