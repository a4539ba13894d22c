"""Operators 3, 6 and 10: against the libraries themselves, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, planes, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "a  b\n\n c\t", "It's the end<|endoftext|>of it <|endoftext|>", "<|endoftext|>", "ünïcödé 漢字かな 🎈🎈", "x" * 5000, ("word " * 3000) + "  \n", "0123456789 " * 40, "a b c\x1cd"]


def table(spark, extra=False):
    rows = [(i, t, "n", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "n", 7), (3, "a", "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long")
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def by_text(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id if r.doc_id is not None else 0))


def test_bpe_like_the_library(spark, encoding):
    want = {t: np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes() for t in [*TEXTS, "no id"]}
    rows = by_text(bpe.byte_bpe(table(spark, extra=True), RANKS, P.PATTERN).collect())
    assert len(rows) == len(TEXTS) + 2
    given_texts = {**dict(enumerate(TEXTS)), None: "no id"}
    for r in rows:
        text = given_texts[r.doc_id]
        assert bytes(r.ids) == want[text] and r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == (text or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    import tiktoken

    ours = bpe.encoder(bpe.RankEncoder, RANKS, P.PATTERN)
    theirs = _tiktoken(tiktoken)
    ids = ours.encode(text)
    assert list(np.frombuffer(ids, "<u4")) == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


_made = []


def _tiktoken(tiktoken):
    if not _made:
        _made.append(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}))
    return _made[0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3))
def test_json_encoder_of_any_text(text, specials):
    from tokenizers import Tokenizer

    text = "<|endoftext|>" * specials + text
    want = Tokenizer.from_file(JSON) if not _json else _json[0]
    if not _json:
        _json.append(want)
    assert list(np.frombuffer(bpe.encoder(bpe.JsonEncoder, JSON).encode(text), "<u4")) == want.encode(text, add_special_tokens=False).ids


_json = []


def test_the_cache_forgets_and_stays_right(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "CACHED", 3)
    ours = bpe.RankEncoder(RANKS, P.PATTERN)
    for text in ["one two three four", "two five six one", "seven one two"] * 3:
        assert list(np.frombuffer(ours.encode(text), "<u4")) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, dtype, n):
    ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(dtype)
    assert (planes.from_planes(planes.to_planes(ids, kind), n, np.dtype(dtype), kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_hold_every_document(spark, tokenizer, kind, monkeypatch):
    monkeypatch.setattr(planes, "CHUNK_IDS", 100)
    df = table(spark, extra=True)
    rows = planes.read_token_files(planes.write_token_files(df, JSON, end_id=2, planes=kind)).collect()
    start = 0
    order = sorted(((d, t) for d, t, *_ in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc, text), r in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, bytes(r.ids)) == (doc, start, ids.tobytes())
        assert zlib.crc32(r.ids) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_files_of_an_empty_table(spark):
    files = planes.write_token_files(table(spark).limit(0), JSON, end_id=2)
    assert files.count() == 0 and planes.read_token_files(files).count() == 0


def test_ids_that_do_not_fit_are_refused():
    import io

    with pytest.raises(ValueError):
        planes.PlaneWriter(io.BytesIO(), 2, "byte").add(1, np.array([70_000]))


@pytest.mark.parametrize("huge, chunk, overlap", [(64_000, 32_000, 256), (300, 200, 40), (300, 150, 33)])
def test_counts_like_the_library(spark, tokenizer, monkeypatch, huge, chunk, overlap):
    monkeypatch.setattr(token_counts, "HUGE_CHARS", huge)
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(token_counts, "OVERLAP_CHARS", overlap)
    df = table(spark, extra=True)
    want = sorted((d is None, d or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in df.collect())
    rows = token_counts.token_counts(df, JSON, limit=50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in rows)


def test_counts_of_other_vocabularies(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df = table(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = token_counts.token_counts(df, path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    empty = table(spark).limit(0)
    assert token_counts.token_counts(empty, JSON).count() == 0
    assert bpe.byte_bpe(empty, RANKS, P.PATTERN).count() == 0


def test_model_file_is_readable():
    import sentencepiece

    model = bpe.sentencepiece_model(bpe.read_ranks(RANKS))
    assert sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size() == 50_257
    assert hashlib.sha256(model).hexdigest() == hashlib.sha256(bpe.sentencepiece_model(bpe.read_ranks(RANKS))).hexdigest()
    assert isinstance(pa.array([model], pa.binary())[0].as_py(), bytes)
