"""Operator 7: mix sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, with_rank

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source that share a slice of the seeded order, about.
SLICE_ROWS = 2_000


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null. Every word but the first follows white space, so the starts are counted."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Callable[[Column], Column], max_epochs: float = 3.0) -> DataFrame:
    """Capped water-filling over ``source``, ``source_size``: adds ``place`` (from 0, by code point, null last), ``weight`` and ``target``.

    The targets share the whole of all sizes by weight; those above ``max_epochs`` times their source's size
    stop there, and the excess goes to the others by weight, until none is above. Each round is one
    aggregation to two sums, for any number of sources. Sources of no words get 0.
    """
    placed = with_rank(sizes, [F.col("source").asc_nulls_last()], "place")
    table = cut_lineage(placed.withColumn("weight", weight(F.col("place")).cast("double")).withColumn("cap", max_epochs * F.col("source_size")).drop("place_rows"))
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * level >= F.col("cap")
        row = table.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weights"), F.count_if(above).alias("clamped")
        ).first()
        if row.clamped == clamped or not row.weights:
            break
        clamped, level = row.clamped, (whole - row.fixed) / row.weights
    return table.withColumn("target", F.least("cap", F.col("weight") * level))


def mix(df: DataFrame, weight: Callable[[Column], Column], max_epochs: float = 3.0, seed: int = 7, size: Column | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """How much of each document the mix takes.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``whole`` (times
    that all of it is taken) and ``part`` (words of it that are taken once more). A source is repeated whole
    as often as fits into its target. The rest is filled in an order drawn from the seed and the ids; the
    document at the edge gives only as many of its words as are missing, so ``taken`` sums to the rounded target.

    The order is cut into slices by hash: slices are summed first, so that a source with any share of the rows
    is spread over all tasks. Null sources are one source, the last; null texts have size 0; null or
    repeated ids keep a row each (rows that agree in id and size are interchangeable); an empty table gives an empty result.
    """
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), (n_words(F.col(text_column)) if size is None else size).alias("size"))
    rows = cut_lineage(rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    aims = targets(sums, weight, max_epochs)
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    positive = F.col("source_size") > 0
    aims = aims.withColumn("whole", F.when(positive, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = aims.withColumn("rest", F.when(positive, F.round(rest)).otherwise(0).cast("long"))
    aims = cut_lineage(aims.withColumn("slices", (F.col("source_rows") / SLICE_ROWS + 1).cast("long")))

    joined = rows.join(aims.select("place", F.col("source").alias("_source"), "source_size", "target", "whole", "rest", "slices"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("slice", F.pmod(F.col("draw"), F.col("slices")))
    slices = joined.groupBy("place", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("place").orderBy("slice")
    starts = slices.select(F.col("place").alias("_place"), F.col("slice").alias("_slice"), (F.sum("slice_size").over(ahead) - F.col("slice_size")).alias("start"))
    inside = Window.partitionBy("place", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = joined.withColumn("upto", F.sum("size").over(inside))
    dealt = dealt.join(starts, (F.col("place") == F.col("_place")) & (F.col("slice") == F.col("_slice")))
    before = F.col("start") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return dealt.withColumn("part", part).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part")


def mixed_rows(df: DataFrame, weight: Callable[[Column], Column], max_epochs: float = 3.0, seed: int = 7, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of the mix, with the columns of ``df``: each document as often as it is taken whole, and the first words of those at the edge of a source's target.

    Rows that agree in id, source and size are taken alike, by the largest share of any of them. Documents without words
    are repeated with their source, as often as that is taken whole. The texts are shuffled once, to meet what ``mix`` says.
    """
    plan = mix(df, weight, max_epochs, seed, None, id_column, source_column, text_column)
    plan = plan.groupBy(F.struct("doc_id", "source", "size").alias("key")).agg(F.max("whole").alias("whole"), F.max("part").alias("part"))
    own = F.struct(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n_words(F.col(text_column)).alias("size"))
    joined = df.select(own.alias("key"), F.struct(*df.columns).alias("row")).join(plan, "key")
    part, size, text = F.col("part"), F.col("key.size"), F.col(f"row.{text_column}")
    whole = F.array_repeat(text, (F.col("whole") + F.when((part > 0) & (part == size), 1).otherwise(0)).cast("int"))
    spaced = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.when((part > 0) & (part < size), F.array(F.array_join(F.slice(spaced, F.lit(1), part.cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    taken = joined.select("row", F.explode(F.concat(whole, first)).alias("text"))
    return taken.select(*(F.col("text").alias(c) if c == text_column else F.col(f"row.{c}") for c in df.columns))
