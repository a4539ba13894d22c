"""Exact search for the sets that share most words with a set.

Words are taken from the rarest on. Those that few sets hold give their whole postings, so every set that shares one of them is seen, with its full
overlap. Sets that share frequent words only need no postings: for each group of frequent words, its first sets by id are enough, as
any other set that holds the group comes behind them. Groups of the search sets' frequent words are few, since sets share them. Nothing is
joined on a frequent word alone, and rows stay in proportion to the search sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import dealt, keep

#: Sets that may hold a word whose postings are read whole; frequent words of a search set that are taken in groups, and of a held set (those with more are met word by word).
RARE, GROUPED, LISTED = 64, 5, 8


def _groups(words: Column) -> Column:
    """All groups of the words (sorted), none empty, as text and size."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(words)) - 1).cast("int"))
    return F.transform(masks, lambda m: F.filter(words, lambda w, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))


def _first(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def most_shared(searched: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """``asked``, ``id``, ``shared``: for each search set the ``most`` held sets that share most words with it (one at least), ties to the smaller id.

    searched: asked, place, words; held: id, place, words (distinct words, no nulls; sets of one place only meet). Equal held sets stand behind their first ``most`` ids.
    """
    by_set = held.where(F.size("words") > 0).select("id", "place", F.array_sort("words").alias("words"))
    ids = _first(by_set, ["place", "words"], ["id"], most).groupBy("place", "words").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sets = keep(ids.withColumn("set", F.monotonically_increasing_id()))
    postings = sets.select("place", "set", F.explode("words").alias("word"))
    counted = keep(postings.groupBy("place", "word").agg(F.count("*").alias("df")))

    # the words that the register holds, the rarest first; the last ones that are frequent go in groups
    asked = searched.select("asked", "place", F.explode("words").alias("word")).join(dealt(counted), ["place", "word"])
    asked = asked.groupBy("asked", "place").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    frequent = F.least(F.lit(GROUPED), F.size(F.filter("w", lambda x: x["df"] > RARE)))
    asked = asked.select("asked", "place", F.transform("w", lambda x: x["word"]).alias("words"), frequent.alias("n"))
    own, often = F.slice("words", F.lit(1), F.size("words") - F.col("n")), F.array_sort(F.slice("words", F.size("words") - F.col("n") + 1, F.col("n")))
    asked = keep(asked.select("asked", "place", "words", own.alias("own"), often.alias("often"), F.xxhash64("place", often).alias("group_id")))

    # held sets' frequent words among those that are searched for in groups; few, so this join alone may broadcast
    groups = asked.where(F.size("often") > 0).select("place", "often", "group_id").distinct()
    sought = groups.select("place", F.explode("often").alias("word")).distinct()
    listed = postings.join(sought, ["place", "word"], "left_semi").groupBy("place", "set").agg(F.array_sort(F.collect_list("word")).alias("often"))
    listed = keep(listed)
    many = listed.where(F.size("often") > LISTED).select("set")

    # one row for each pair, at the rarest word that both have
    shared = F.array_intersect(F.col("a.words"), F.col("h.words"))
    rare = asked.select("asked", "place", "words", F.explode("own").alias("word")).alias("a")
    holders = postings.join(dealt(asked.select("place", F.explode("own").alias("word")).distinct()), ["place", "word"], "left_semi").join(dealt(sets.select("set", "words", "ids")), "set").alias("h")
    pairs = rare.join(dealt(holders), ["place", "word"]).where(F.get(shared, F.lit(0)) == F.col("word")).select("asked", F.size(shared).alias("shared"), "ids")
    wide = sets.join(dealt(many), "set", "left_semi").select("place", "words", "ids", F.explode("words").alias("word")).alias("h")
    every = asked.select("asked", "place", "words", F.explode("words").alias("word")).alias("a")
    pairs = pairs.unionByName(every.join(dealt(wide), ["place", "word"]).where(F.get(shared, F.lit(0)) == F.col("word")).select("asked", F.size(shared).alias("shared"), "ids"))
    seen = pairs.select("asked", "shared", F.explode("ids").alias("id"))

    key = F.array_join("g", " ")
    wanted = groups.select("place", "group_id", F.explode(_groups(F.col("often"))).alias("g")).select("place", "group_id", key.alias("key"), F.size("g").alias("shared"))
    offered = listed.join(dealt(many), "set", "left_anti").select("place", "set", F.explode(_groups(F.col("often"))).alias("g")).select("place", "set", key.alias("key"))
    offered = offered.join(dealt(wanted.select("place", "key").distinct()), ["place", "key"], "left_semi").join(dealt(sets.select("set", F.explode("ids").alias("id"))), "set")
    lists = wanted.join(dealt(_first(offered, ["place", "key"], ["id"], most)), ["place", "key"]).groupBy("group_id", "id").agg(F.max("shared").alias("shared"))
    by_group = _first(lists, ["group_id"], [F.col("shared").desc(), "id"], most)
    grouped = asked.where(F.size("often") > 0).select("asked", "group_id").join(dealt(by_group), "group_id").select("asked", "shared", "id")
    best = seen.unionByName(grouped).groupBy("asked", "id").agg(F.max("shared").alias("shared"))
    return _first(best, ["asked"], [F.col("shared").desc(), "id"], most)
