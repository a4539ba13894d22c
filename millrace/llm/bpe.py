"""Byte-level BPE inside Spark tasks (operator 6), and the pre-token cache that operator 3 shares.

A byte-level vocabulary merges inside one pre-token only, so the ids of a text are those of its
pre-tokens end to end. Each worker keeps the ids of the pre-tokens that it has met; the library is
asked once for each of them.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches

#: Pre-tokens whose ids one worker keeps in each of two generations, of at most so many characters each (about 20 MB of usual text, under 100 MB of the longest). Results do not depend on it.
CACHED, CACHED_CHARS = 100_000, 64


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_TO_CHARACTER = byte_characters()


def as_characters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_TO_CHARACTER)


class _Known(dict):
    """Ids of strings met before. When full, it becomes the older generation, from which strings that are met again come back."""

    def __init__(self, ids_of: Callable[[str], bytes], most: int) -> None:
        self.ids_of, self.most = ids_of, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > CACHED_CHARS:
            return self.ids_of(key)
        found = self.older.get(key)
        if found is None:
            found = self.ids_of(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PieceCache:
    """Ids of whole texts from the ids of their pre-tokens, as little-endian unsigned 32-bit integers."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], list[int]], most: int | None = None) -> None:
        import regex

        def ids_of(piece: str) -> bytes:
            ids = encode_piece(piece)
            return struct.pack(f"<{len(ids)}I", *ids)

        self.split = regex.compile(pattern).findall
        self.known = _Known(ids_of, most or CACHED)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))


class JsonEncoder:
    """A byte-level vocabulary file of the tokenizers library; strings of added tokens inside a text become their ids, as the library does."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space or not tokenizer.pre_tokenizer.use_regex:  # PATTERN is the one that ByteLevel has
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        model = tokenizer.model
        self.cache = PieceCache(public_tokenizers.PATTERN, lambda piece: [t.id for t in model.tokenize(as_characters(piece))], 4 * CACHED)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: added tokens that take neighbouring characters are not handled")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.special is None or not self.special.search(text):
            return self.cache.encode(text)
        return b"".join(self.added.get(x) or self.cache.encode(x) for x in self.special.split(text) if x)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the vocabulary of a rank file.

    Piece 0 is <unk>, piece ``rank + 1`` the token of that rank, written with one character per byte and
    scored by its negative rank, so that sentencepiece merges in the order of the ranks. The text is not
    normalised. Ranks have to be 0, 1, 2, ... without gaps.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not consecutive from 0")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for rank, token in enumerate(tokens):
        characters = "".join(map(_TO_CHARACTER.__getitem__, token)).encode()
        pieces.append(_field(1, characters) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    as_is = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, as_is)


class RankEncoder:
    """Encodes by a sentencepiece model built from a rank file; decodes by the inverse mapping."""

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        ranks = read_ranks(path)
        encode = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks)).encode

        def encode_piece(piece: str) -> list[int]:
            whole = ranks.get(piece.encode())
            return [whole] if whole is not None else [i - 1 for i in encode(as_characters(piece))]

        self.cache = PieceCache(pattern, encode_piece)
        self.token = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str | None) -> bytes:
        return self.cache.encode(text or "")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[tuple, object] = {}


def encoder(kind: type, *arguments: str) -> object:
    """One encoder for each worker process, kept from batch to batch, and from task to task unless a task lets it go."""
    key = (kind.__name__, *arguments)
    if key not in _encoders:
        _encoders[key] = kind(*arguments)
    return _encoders[key]


def byte_bpe(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Operator 6. Encode each text by a rank file's vocabulary and decode the ids again.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit integers) and
    ``decoded`` (binary: the bytes that the ids stand for, made from the ids alone). One row for each row of
    ``df``, repeated rows and null ids too; a null text counts as empty and gives no ids; other columns of
    ``df`` are not read. No shuffle; a task holds about 4 MB of text at once, or its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(RankEncoder, path, pattern)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                decoded = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        _encoders.clear()  # a worker that goes on to other work keeps no vocabulary

    kind = df.schema[id_column].dataType.simpleString()
    return small_batches(df).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
