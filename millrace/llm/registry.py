"""The queries of this subpackage, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(_documents(spark, sf_dir))


def op3_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .planes import read_token_files, write_token_files

    files = write_token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    ids = read_token_files(files)
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, factor=2.0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import byte_bpe

    coded = byte_bpe(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_documents(spark, sf_dir), weight=lambda place: place % 3 + 1, max_epochs=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    deduped = dedup_lines(_documents(spark, sf_dir))
    return deduped.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


#: A labelled document's grade: 0 junk, 1 toxic, 2 clean; and the least probability of grade 2 that passes.
GRADES, KEEP = 3, 0.5


def grade() -> Column:
    return F.col("quality") * (2 - F.col("toxic"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal import fit_on, score

    documents = _documents(spark, sf_dir)
    model = fit_on(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade(), GRADES)
    return score(documents, model, GRADES, ["doc_id"]).withColumn("keep", F.col("top_probability") >= KEEP)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spellings import spelling_variants

    return spelling_variants(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair_reports

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_reports(conversations, damage(conversations))


#: The shards that the documents are in before, by source, and afterwards.
OLD_SHARDS, SHARDS = 6, 8


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resharding import reshard_by_bytes

    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    rows = reshard_by_bytes(_documents(spark, sf_dir).select("doc_id", "text", "source"), old, SHARDS).read()
    return rows.select("row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_order_minhash": op1_order_minhash,
        "op2_licence_scan": op2_licence_scan,
        "op3_plane_files": op3_plane_files,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_vantage_trees": op5_vantage_trees,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_source_mix": op7_source_mix,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality": op9_quality,
        "op10_token_counts": op10_token_counts,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_resharding": op13_resharding,
    }


def oracle_sql() -> dict[str, str]:
    """SQL has neither the hashes of operators 1, 7 and 13, nor tokenizers, nor a fitted model; operator 5 is approximate, and the edits of operator 12 are the least of very many. Those are tested against brute force."""
    from . import oracles

    return {"op2_licence_scan": oracles.licences(), "op4_jaccard_join": oracles.JACCARD, "op8_line_dedup": oracles.LINES, "op11_spelling_variants": oracles.SPELLINGS}
