"""Operator 10: token counts, where huge documents are counted in overlapping chunks by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut_lineage, partitions, small_batches

#: Characters from which a document is cut into chunks, and of a chunk. Results do not depend on either.
HUGE_CHARS = 64_000
CHUNK_CHARS = 32_000
#: Characters that neighbouring chunks share at first, and by how much that grows when they cannot be aligned.
OVERLAP_CHARS = 256
WIDEN = 16

_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        if path.endswith(".model"):
            import sentencepiece

            _tokenizers[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _tokenizers[path] = tokenizer
    return _tokenizers[path]


def _lengths(path: str, texts: list[str]) -> list[int]:
    tokenizer = _tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def can_align(path: str) -> bool:
    """Whether boundaries of this vocabulary can be proven: byte-level, so no token crosses a pre-token, and the split looks at most one character ahead and never back."""
    if path.endswith(".model"):
        return False
    tokenizer = _tokenizer(path)
    plain = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not tokenizer.pre_tokenizer.add_prefix_space
    return plain and not any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())


def _margin(path: str) -> int:
    """Characters at a chunk's ends where its tokens may differ from the document's: an added token cut in two, and the character that the split looks ahead."""
    return 2 + max([0, *(len(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values())])


def count_chunk(path: str, text: str, start: int, zones: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """The tokens of a chunk that begins at ``start``, and the pre-token starts in the zones of the document with the tokens before each."""
    encoding = _tokenizer(path).encode(text, add_special_tokens=False)
    found, before = [], None
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != before and any(a <= start + at < b for a, b in zones):
            found.append((start + at, i))
        before = word
    return len(encoding.ids), found


def _count_huge(huge: DataFrame, path: str, overlap: int | None) -> tuple[DataFrame, DataFrame]:
    """Counts of the distinct texts of ``huge`` that align at this overlap (None: one chunk for each), and the digests of those that don't."""
    margin = _margin(path) if overlap else 0
    step = CHUNK_CHARS

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                digest, text = batch.column("digest")[row].as_py(), batch.column("text")[row].as_py()
                starts = range(0, max(1, len(text) - (overlap or 0)), step) if overlap else [0]
                for k, at in enumerate(starts):
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "chunk": k, "chunks": len(starts), "piece": text[at : at + step + overlap] if overlap else text}])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("p", pa.int64()), ("before", pa.int64())]))
        schema = pa.schema([("digest", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("n", pa.int64()), ("ends", pairs)])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k, zones = row["chunk"], []
                if overlap:
                    joints = [j for j in (k, k + 1) if 0 < j < row["chunks"]]
                    zones = [(j * step + margin, j * step + overlap - margin) for j in joints]
                n, ends = count_chunk(path, row["piece"], k * step, zones)
                out.append({"digest": row["digest"], "chunk": k, "chunks": row["chunks"], "n": n, "ends": [{"p": p, "before": b} for p, b in ends]})
            yield pa.RecordBatch.from_pylist(out, schema)

    pieces = huge.mapInArrow(chunks, "digest string, chunk bigint, chunks bigint, piece string").repartition(partitions(huge.sparkSession), "digest", "chunk")
    counted = cut_lineage(pieces.mapInArrow(count, "digest string, chunk bigint, chunks bigint, n bigint, ends array<struct<p:bigint,before:bigint>>").dropDuplicates(["digest", "chunk"]))
    at = counted.select("digest", "chunk", "n", F.explode("ends").alias("e")).select("digest", "chunk", "n", F.col("e.p").alias("p"), F.col("e.before").alias("before"))
    left = at.select("digest", (F.col("chunk") + 1).alias("joint"), "p", (F.col("n") - F.col("before")).alias("after"))
    right = at.select("digest", F.col("chunk").alias("joint"), "p", "before")
    joints = left.join(right, ["digest", "joint", "p"]).groupBy("digest", "joint").agg(F.min_by(F.col("after") + F.col("before"), "p").alias("twice"))
    spliced = joints.groupBy("digest").agg(F.sum("twice").alias("twice"), F.count("*").alias("joints"))
    totals = counted.groupBy("digest").agg(F.sum("n").alias("n"), F.max("chunks").alias("chunks")).join(spliced, "digest", "left")
    whole = F.coalesce("joints", F.lit(0)) == F.col("chunks") - 1
    good = totals.where(whole).select("digest", (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))
    return good, totals.where(~whole).select("digest")


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of each text without begin, end or added special tokens: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``vocabulary`` is a .json file of the tokenizers library or a .model file of sentencepiece. Texts of over
    HUGE_CHARS characters are cut into chunks that overlap, dealt over all tasks and encoded with offsets. Two
    neighbours are spliced at a character where both begin a pre-token, at least a margin away from the ends of
    both: byte-level tokens do not cross pre-tokens, and the split from there on depends on nothing before it.
    Where no such character exists the overlap widens, at last to the whole text. Other kinds of vocabulary give
    no such proof; their texts are encoded whole. Null texts count as empty (no tokens); null and repeated ids keep a row each;
    other columns are not read.
    """
    rows = small_batches(df).select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                n = _lengths(vocabulary, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    cut = can_align(vocabulary)
    usual = sized.where(F.length("text") <= HUGE_CHARS) if cut else sized
    counts = usual.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    if cut:
        huge = sized.where(F.length("text") > HUGE_CHARS).withColumn("digest", F.sha2("text", 256))
        texts, parts, overlap = huge.select("digest", "text"), [], OVERLAP_CHARS
        while True:
            good, failed = _count_huge(texts, vocabulary, overlap)
            parts.append(good)
            if overlap is None or failed.isEmpty():
                break
            texts = huge.select("digest", "text").join(failed, "digest", "left_semi")
            overlap = overlap * WIDEN if overlap * WIDEN < CHUNK_CHARS else None
        known = parts[0]
        for more in parts[1:]:
            known = known.unionByName(more)
        counts = counts.unionByName(huge.select("doc_id", "n_bytes", "digest").join(known, "digest").select("doc_id", "n_bytes", "n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
