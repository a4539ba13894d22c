"""Operator 3: token ids in files of compressed bit or byte planes.

A file holds the documents of one range of ids::

    magic | planes of chunk 0 | planes of chunk 1 | ... | index | length of the index (8 bytes) | magic

A chunk is a block of CHUNK_IDS ids (the last may be shorter). Its fixed-size ids are transposed: plane i
holds bit i (or byte i) of every id, and each plane is compressed by itself with zstandard. The index is
zstandard-compressed JSON with the width of an id, the kind of planes, each chunk's position, ids and plane
lengths, and the position of each block of the list of documents (their ids and numbers of tokens), which stand between the
chunks; so any range of ids can be read by itself, and no file's list of documents is in memory as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import JsonEncoder, encoder
from .common import by_bytes, cut_lineage, partitions, shared_dir, small_batches

MAGIC = b"MRPLANE1"
CHUNK_IDS = 1 << 17
#: Documents in a block of the index, and bytes of text that go into one file, about.
BLOCK_DOCUMENTS, FILE_BYTES = 1 << 14, 1 << 28
LEVEL = 1


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned integers, lowest first, each compressed."""
    width = ids.dtype.itemsize
    octets = np.ascontiguousarray(ids.astype(ids.dtype.newbyteorder("<"))).view(np.uint8).reshape(-1, width)
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    if kind == "byte":
        return [compress(np.ascontiguousarray(octets[:, i]).tobytes()) for i in range(width)]
    planes = []
    for i in range(width):
        byte = np.ascontiguousarray(octets[:, i])
        planes += [compress(np.packbits(byte & (1 << bit)).tobytes()) for bit in range(8)]
    return planes


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, kind: str) -> np.ndarray:
    """The inverse of ``to_planes``."""
    expand = zstandard.ZstdDecompressor().decompress
    octets = np.zeros((n, dtype.itemsize), np.uint8)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(expand(plane), np.uint8)
        if kind == "byte":
            octets[:, i] = raw
        else:
            octets[:, i // 8] |= np.unpackbits(raw, count=n) << np.uint8(i % 8)
    return octets.reshape(-1).view(dtype.newbyteorder("<"))


class PlaneWriter:
    def __init__(self, out, width: int, kind: str) -> None:
        self.out, self.kind, self.dtype = out, kind, np.dtype(f"<u{width}")
        self.at, self.waiting, self.waiting_ids = len(MAGIC), [], 0
        self.chunks: list[list[int]] = []
        self.blocks: list[list[int]] = []
        self.documents: list[int | None] = []
        self.counts: list[int] = []
        self.n_documents = self.n_tokens = 0
        out.write(MAGIC)

    def add(self, document: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.dtype.itemsize:
            raise ValueError(f"an id does not fit into {self.dtype.itemsize} bytes")
        self.documents.append(document)
        self.counts.append(len(ids))
        self.n_documents, self.n_tokens = self.n_documents + 1, self.n_tokens + len(ids)
        if len(self.documents) >= BLOCK_DOCUMENTS:
            self._block()
        self.waiting.append(ids.astype(self.dtype))
        self.waiting_ids += len(ids)
        if self.waiting_ids >= CHUNK_IDS:
            whole = np.concatenate(self.waiting)
            full = len(whole) // CHUNK_IDS * CHUNK_IDS
            for start in range(0, full, CHUNK_IDS):
                self._chunk(whole[start : start + CHUNK_IDS])
            self.waiting, self.waiting_ids = [whole[full:].copy()], len(whole) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.kind)
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        for plane in planes:
            self.out.write(plane)
            self.at += len(plane)

    def _block(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps([self.documents, self.counts]).encode())
        self.blocks.append([self.at, len(packed)])
        self.out.write(packed)
        self.at += len(packed)
        self.documents, self.counts = [], []

    def close(self) -> None:
        if self.waiting_ids:
            self._chunk(np.concatenate(self.waiting))
        if self.documents:
            self._block()
        index = json.dumps({"width": self.dtype.itemsize, "planes": self.kind, "chunks": self.chunks, "blocks": self.blocks})
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(index.encode())
        self.out.write(packed + len(packed).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads by the index: no more than one chunk, one block of the list of documents and one document are in memory."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a finished plane file")
        length = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - length)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))
        self.dtype = np.dtype(f"<u{self.index['width']}")

    def chunk(self, i: int) -> np.ndarray:
        at, n, *lengths = self.index["chunks"][i]
        self.file.seek(at)
        raw, planes = self.file.read(sum(lengths)), []
        for length in lengths:
            planes.append(raw[:length])
            raw = raw[length:]
        return from_planes(planes, n, self.dtype, self.index["planes"])

    def _listed(self) -> Iterator[tuple[int | None, int]]:
        for at, length in self.index["blocks"]:
            self.file.seek(at)
            yield from zip(*json.loads(zstandard.ZstdDecompressor().decompress(self.file.read(length))), strict=True)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, chunks = np.zeros(0, self.dtype), iter(range(len(self.index["chunks"])))
        for document, n in self._listed():
            parts, missing = [held[:n]], n - min(n, len(held))
            held = held[n:]
            while missing:
                held = self.chunk(next(chunks))
                parts.append(held[:missing])
                held, missing = held[missing:], missing - len(parts[-1])
            yield document, np.concatenate(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, to: str | None = None, planes: str = "byte", width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and write the ids, with ``end_id`` after each document, in ascending ``doc_id`` order.

    Each range of ids becomes one file in ``to`` (a folder that all executors reach; by default a new one in
    the shared folder); files hold about FILE_BYTES of text each, or less, as there is one for each task at least. Returns the list of files: ``shard``, ``path``, ``documents``, ``tokens``. Null texts count as
    empty; null ids come first; rows with the same id are ordered by a hash of the text, then by the text, and may be spread over several files. Other columns are not
    read. An empty table writes no file. A task that runs again writes the same bytes under a name of its own and
    moves them into place, so a lost executor leaves no broken file.
    """
    spark = small_batches(df).sparkSession
    folder = to or f"{shared_dir(spark)}/planes-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        shard = task.partitionId()
        name, draft = f"{root}/shard-{shard:06d}.planes", f"{root}/.draft-{shard:06d}-{uuid.uuid4().hex}"
        bpe, end, writer, out = encoder(JsonEncoder, vocabulary), np.array([end_id], np.uint32), None, None
        for batch in batches:
            for part in by_bytes(batch, "text"):
                for document, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if writer is None:
                        out = store.open_output_stream(draft)
                        writer = PlaneWriter(out, width, planes)
                    writer.add(document, np.concatenate([np.frombuffer(bpe.encode(text), np.uint32), end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, name)
            path = folder.rstrip("/") + f"/shard-{shard:06d}.planes"
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "documents": writer.n_documents, "tokens": writer.n_tokens}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    files = max(partitions(spark), int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / FILE_BYTES) + 1)
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    return cut_lineage(dealt.mapInArrow(run, "shard bigint, path string, documents bigint, tokens bigint"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Read what ``write_token_files`` lists: ``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (binary, little-endian unsigned 32-bit)."""
    everything = Window.partitionBy(F.lit(1)).orderBy("shard")  # one row per file
    placed = files.select("path", (F.sum("tokens").over(everything) - F.col("tokens")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _filesystem(row["path"])
                with store.open_input_file(path) as file:
                    start, held, n_bytes = row["start"], [], 0
                    for document, ids in PlaneReader(file).documents():
                        held.append((document, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        n_bytes += len(held[-1][2])
                        if n_bytes > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, n_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    spread = placed.repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, ids binary")
