"""The corpus pipeline: its stages in order, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import byte_bpe
from millrace.llm.common import shared_dir
from millrace.llm.jaccard import jaccard_components
from millrace.llm.lines import dedup_lines
from millrace.llm.mixing import mixed_rows
from millrace.llm.ordinal import fit_on, score
from millrace.llm.registry import GRADES, KEEP, grade

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express the fitted classifier of the first stage, and so none of the rest.
ORACLE_SQL = None


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the present text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Drops documents whose probability of the highest grade is below KEEP. The model is fitted on a bounded sample of the labelled documents."""
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade(), GRADES)
    return _documents(score(docs, model, GRADES, docs.columns).where(F.col("top_probability") >= KEEP))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Texts lose the lines that an earlier line repeats; a document that had lines and keeps none is a copy, and goes."""
    return _documents(dedup_lines(docs).where("n_kept > 0 or n_lines = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Of each group of linked documents the first stays, by id (null last) and then by a hash of the text; documents without words stay. Rows that agree in id and text are one document and stay or go together."""
    others = jaccard_components(docs).where("not first").select(F.col("doc_id").alias("other_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return _documents(docs.join(others, same, "left_anti"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Each document is repeated as often as the mix takes it whole; the one at the edge of a source's target adds its first words, as many as are missing."""
    return _documents(mixed_rows(docs, weight=lambda place: place % 3 + 1, max_epochs=3.0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. The token ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    coded = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{STAGES[-1][0]}"
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
