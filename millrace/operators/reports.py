"""Accounting of runs: spending, counters, errors and holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_spend(runs: DataFrame, month: str, without: int | None = None) -> DataFrame:
    """Cents spent by the runs that began in a month (YYYY-MM), one run left out if so asked."""
    mine = runs.where(F.date_format("started_at", "yyyy-MM") == month)
    if without is not None:
        mine = mine.where(F.col("id") != without)
    return mine.agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cents"))


def in_window(at: str, after: str, until: str) -> Column:
    """After the one instant, up to and with the other."""
    return (F.col(at) > F.lit(after).cast("timestamp")) & (F.col(at) <= F.lit(until).cast("timestamp"))


def list_of(column: str) -> Column:
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def cap_hits(runs: DataFrame) -> DataFrame:
    """In how many runs each cap was reached."""
    return runs.select("id", F.explode(F.array_distinct(list_of("budget_hits"))).alias("cap")).groupBy("cap").agg(F.count("*").alias("runs"))


def weekly(runs: DataFrame) -> DataFrame:
    """Totals of each kind of run."""
    return runs.groupBy("kind").agg(
        F.count("*").alias("runs"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.count_if(F.col("failed") == 1).alias("failed"),
        F.sum("queries").alias("queries"), F.sum("extractions").alias("extractions"), F.sum("fetches").alias("fetches"), F.sum("cost_cents").alias("cents"),
    )


ERRORS = "array<struct<stage:string,kind:string,message:string>>"
#: Kinds of stored errors that make a run fail, and the one that is none.
FAILURE_KINDS, STUB = ["internal", "forced"], "not_implemented"


def stored_errors(runs: DataFrame) -> DataFrame:
    """One row for each stored error: ``id``, ``started_at``, ``place`` in the run, ``stage``, ``kind``, ``message``. Stubs and texts that are no list are left out."""
    errors = runs.select("id", "started_at", F.posexplode(F.from_json("errors", ERRORS)).alias("place", "e"))
    return errors.where(F.col("e.kind").isNotNull() & (F.col("e.kind") != STUB)).select("id", "started_at", "place", "e.*")


def errors_by_kind(runs: DataFrame) -> DataFrame:
    return stored_errors(runs).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("runs"))


def failures(runs: DataFrame) -> DataFrame:
    """Errors of stages that threw or were made to; a run with one has failed."""
    return stored_errors(runs).where(F.col("kind").isin(*FAILURE_KINDS))


def latest_with(runs: DataFrame, stage: str) -> DataFrame:
    """The latest run whose finished stages hold this one."""
    done = runs.where(F.array_contains(list_of("stages_done"), stage))
    return done.agg(F.max_by("id", F.struct("started_at", "id")).alias("id"), F.max("started_at").alias("started_at"))


def completed_parts(runs: DataFrame, prefix: str) -> DataFrame:
    """What earlier runs have done of a stage that is done in parts (``prefix``:part)."""
    parts = runs.select(F.explode(list_of("stages_done")).alias("stage")).where(F.col("stage").startswith(prefix + ":"))
    return parts.select(F.substring("stage", len(prefix) + 2, 1000).alias("part")).distinct()


def holds(sources: DataFrame, outings: DataFrame) -> DataFrame:
    """Held sources and events by reason."""
    count = lambda df, what: df.where("hold_reason is not null").groupBy("hold_reason").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return count(sources, "source").unionByName(count(outings, "outing"))


def error_rate(outcomes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The share of fetches that failed, and whether it is above the threshold."""
    bad = F.count_if(F.col("outcome").isin("server_error", "client_error"))
    return outcomes.agg(F.count("*").alias("fetches"), bad.alias("errors")).withColumn("rate", F.when(F.col("fetches") > 0, F.col("errors") / F.col("fetches")).otherwise(0.0)).withColumn("high", F.col("rate") > threshold)


def counters(parts: list[DataFrame]) -> DataFrame:
    """Counters of several stages added up by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.sum("n").alias("n"))


#: Fixed value: errors that a run's row keeps.
STORED_ERRORS = 200


def last_errors(errors: DataFrame, most: int = STORED_ERRORS) -> DataFrame:
    """The last ``most`` errors of each run: id, at, stage, ord (tells a stage's errors apart), kind, message. By time, then stage and place.

    A bounded state that merges: the last of several parts' last ones are those of all rows, in any order of merging, and each task passes on no more than ``most`` of a run.
    """
    late = F.row_number().over(Window.partitionBy("id").orderBy(F.col("at").desc(), F.col("stage").desc(), F.col("ord").desc()))
    return errors.withColumn("_late", late).where(F.col("_late") <= most).drop("_late")


def run_accounts(runs: DataFrame, updates: DataFrame, errors: DataFrame, metered: list[str], added: list[str]) -> DataFrame:
    """Rows of runs after the updates of their stages, which may run side by side: ``id``, ``stages_done`` (in order of their first end), metered and added columns, ``errors`` (JSON, the oldest of the last first).

    runs: id and all these columns, stages_done as an array, errors as rows of ``errors`` (before any update). updates: id, at, stage, done, and the columns: metered ones are what has been spent so far, so the highest counts; added ones
    add up. A run without updates stays as it is.
    """
    ends = updates.where("done").groupBy("id", "stage").agg(F.min("at").alias("at"))
    stages = ends.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stage"))), lambda x: x["stage"]).alias("_new"))
    spent = updates.groupBy("id").agg(*(F.max(c).alias(f"_{c}") for c in metered), *(F.sum(c).alias(f"_{c}") for c in added))
    kept = last_errors(errors).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "stage", "ord", "kind", "message"))).alias("_e"))
    text = F.to_json(F.transform(F.coalesce("_e", F.array().cast("array<struct<at:timestamp,stage:string,ord:int,kind:string,message:string>>")), lambda e: F.struct(e["stage"].alias("stage"), e["kind"].alias("kind"), e["message"].alias("message"))))
    joined = runs.join(stages, "id", "left").join(spent, "id", "left").join(kept, "id", "left")
    before = F.coalesce("stages_done", F.array().cast("array<string>"))
    done = F.concat(before, F.array_except(F.coalesce("_new", F.array().cast("array<string>")), before))
    return joined.select("id", done.alias("stages_done"), *(F.coalesce(F.greatest(c, f"_{c}"), F.lit(0)).alias(c) for c in metered), *((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in added), text.alias("errors"))
