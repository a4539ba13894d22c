"""What the operators of this subpackage share: word hashing inside tasks, and small Spark helpers.

Texts reach Python as Arrow batches. ``WordHasher`` finds the words of a whole batch with numpy, so
that no Python statement runs once per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are hashed at once; memory in a task is about 40 times this.
PIECE_BYTES = 1 << 19
ARROW_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: The white space of the contracts: the space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that all their bits depend on all others."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more for the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordHasher:
    """64-bit hashes of the white-space-separated words of many texts at once."""

    def __init__(self, lower: bool = True) -> None:
        self.lower = lower
        self._grow(PIECE_BYTES + 1)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            up, down = np.full(n, U64(_BASE)), np.full(n, U64(_BASE_INVERSE))
            up[0] = down[0] = U64(1)
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _pieces(self, data: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about PIECE_BYTES that end at white space or at the end of a text."""
        at, n = 0, len(data)
        while at < n:
            end = min(at + PIECE_BYTES, n)
            while end < n:
                row_end = breaks[np.searchsorted(breaks, end)]
                near = np.flatnonzero(_SPACE[data[end : min(row_end, end + 65536)]])
                if len(near):
                    end += int(near[0])
                    break
                if row_end <= end + 65536:
                    end = int(row_end)
                    break
                end += 65536
            yield at, end
            at = end

    def words(self, data: np.ndarray, offsets: np.ndarray, first_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: first byte, end byte, row and hash (of its first bytes only, if so asked)."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in self._pieces(data, offsets[1:]):
            part = data[a:b]
            if self.lower:
                part = _LOWER[part]
            inside = ~_SPACE[part]
            cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
            before = np.empty(len(part), bool)
            before[0], before[1:] = False, inside[:-1]
            before[cut] = False
            after = np.empty(len(part), bool)
            after[-1], after[:-1] = False, inside[1:]
            after[cut[cut > 0] - 1] = False
            start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            if first_bytes:
                end = np.minimum(end, start + first_bytes)
            if len(part) + 1 > len(self.up):
                self._grow(len(part) + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, U64)
                np.cumsum((part.astype(U64) + U64(1)) * self.up[: len(part)], out=total[1:])
                hashed = mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
            found.append((start + a, end + a, hashed))
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, np.zeros(0, U64)
        start, end, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, end, np.searchsorted(offsets, start, "right") - 1, hashed


def shingles(row: np.ndarray, hashed: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``width`` words; a row with fewer words gives one run of all its words."""
    n = len(row)
    if not n:
        return row, hashed
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    with np.errstate(over="ignore"):
        factor = [U64(_BASE) ** U64(i + 1) for i in range(width)]
        full = max(0, n - width + 1)
        total = np.zeros(full, U64)
        for i, f in enumerate(factor):
            total += hashed[i : i + full] * f
        same = row[:full] == row[width - 1 :] if full else np.zeros(0, bool)
        short = np.flatnonzero(count < width)
        few = np.zeros(len(short), U64)
        for i in range(width - 1):
            has = count[short] > i
            few[has] += hashed[first[short][has] + i] * factor[i]
        few += count[short].astype(U64) * U64(0xA0761D6478BD642F)
    rows = np.concatenate([row[:full][same], row[first[short]]])
    values = mix(np.concatenate([total[same], few]))
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's. A temporary one only on a local master, which has no other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="millrace-")
            sc.setCheckpointDir(f"file://{named}")
            named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the given order, and ``<name>_rows``, how many there are.

    Rows are dealt by range and numbered inside their partition; only one row per partition, with its
    count, meets in one task. The dealt rows are checkpointed, since both branches must see one dealing.
    """
    dealt = cut_lineage(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    all_parts = Window.partitionBy(F.lit(1))
    starts = counts.select(
        F.col("_part").alias("_p"),
        (F.sum("_n").over(all_parts.orderBy("_part")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(all_parts).alias(f"{name}_rows"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = dealt.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return ranked.withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_part", "_p", "_in", "_start")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches hold ARROW_BYTES at most, unless the session has a size of its own.

    Executors hold a batch several times over (in the JVM, on its way, in Python); the usual 64 MB of texts are too much beside a small heap.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def by_bytes(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, whole rows each; at its end Arrow's free memory goes back."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


#: Rows of a file that ``keep`` writes, at least about, where the number of rows is known to be small.
FILE_ROWS = 10_000


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage of tables that several steps read. ``rows``: how many there are at most, so that few rows don't make as many files as there are shuffle partitions."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    written = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    written.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
