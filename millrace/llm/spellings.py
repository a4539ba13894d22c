"""Operator 11: group spelling variants of the words of a corpus by automata over the words' halves.

If two words differ by one inserted, deleted or replaced code point, one half of the longer holds as it stands in the other: its first half at the
other's beginning or its second half at the other's end. Every word's two segments go to shards by hash, with the word; every word goes to the shards
that could hold a segment of a word of its length or of one more code point. A shard builds one Aho-Corasick automaton over its segments,
scans the words dealt to it, keeps matches whose offset and length fit, and verifies the distance of what is left.

A segment that more than HOT words share, or that very many are scanned for, is not dealt as it is: the rest of those words, beyond what they share, is halved again, and again, until
few enough share a segment; so no group of words meets pair by pair. A pair is found by its first halves if these agree, else by the second, so once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keep, small_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Code points of a text that are looked at together, and distinct words that are counted together in a task.
PIECE_CHARS, COUNTED = 1 << 18, 1 << 17
#: Words that may share a segment before it is halved again; words with segments of one shard, about; bytes of the pairs that are compared at once.
HOT, SHARD_WORDS, BLOCK_BYTES = 256, 20_000, 1 << 22


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that don't cut a run."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and (more := RUN.match(text, end)):
            end = more.end()
        yield text[at:end]
        at = end


def faulty(run: str, start: int, every: int) -> str:
    """The run with the code point gone that its checksum, carried on from its document's (``start``), draws, if it draws one."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, every: int = 97, least_chars: int = 5, least_n: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n``: the runs of letters of all texts, A to Z lower-cased, each ``every``-th of a document's distinct runs with a fault.

    Runs are counted in tasks first, some at a time, then by word. Null texts have none; a null id counts as empty text; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for piece in _pieces(text or ""):
                        for word, n in Counter(RUN.findall(piece.translate(_LOWER))).items():
                            if len(word) >= least_chars:  # a fault only shortens
                                word = faulty(word, start, every)
                                if len(word) >= least_chars:
                                    counts[word] += n
                        if len(counts) >= COUNTED:
                            yield given()
        if counts:
            yield given()

    rows = small_batches(df).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _keys(word: Column, length: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """The keys under which a word meets words of ``length`` that share its ``first`` and ``last`` code points and, besides, the first or second half of the ``length - first - last`` between."""
    half = ((length - first - last) / 2).cast("int")
    key = lambda side, a, b: F.struct(F.lit(side).alias("side"), length.alias("length"), a.alias("first"), b.alias("last"), F.substring(word, F.lit(1), a).alias("head"), F.substring(word, F.length(word) - b + 1, b).alias("tail"))
    return key("P", first + half, last), key("S", first, length - first - half)


def _meetings(words: DataFrame) -> DataFrame:
    """Rows ``key``, ``pattern``, ``word``, ``n``: where words meet as holders of a segment (pattern) and as scanned words.

    A level's keys come from the words' halves; keys that nobody holds go, and those with more than HOT holders or SHARD_WORDS scanned words go on as the next level's, which follow from the word and the key's numbers.
    """
    zero = F.lit(0)
    length = F.length("word")
    mine = F.array(*_keys(F.col("word"), length, zero, zero))
    others = F.array(*_keys(F.col("word"), length, zero, zero), *_keys(F.col("word"), length + 1, zero, zero))
    level = words.select("word", "n", F.explode(F.concat(F.transform(mine, lambda k: F.struct(F.lit(True).alias("pattern"), k.alias("key"))), F.transform(others, lambda k: F.struct(F.lit(False).alias("pattern"), k.alias("key"))))).alias("m"))
    level = keep(level.select("m.key", "m.pattern", "word", "n"))
    done = None
    while True:
        sizes = level.groupBy("key").agg(F.count_if("pattern").alias("held"), F.count_if(~F.col("pattern")).alias("met")).where("held > 0")
        k = F.col("key")
        again = ((F.col("held") > HOT) | (F.col("met") > SHARD_WORDS)) & (k["length"] - k["first"] - k["last"] > 1)
        level = keep(level.join(sizes.select("key", again.alias("again")), "key"))
        rest = level.where("not again").drop("again")
        done = rest if done is None else done.unionByName(rest)
        if level.where("again").isEmpty():
            return done
        nested = F.array(*_keys(F.col("word"), k["length"], k["first"], k["last"]))
        level = level.where("again").select(F.explode(nested).alias("key"), "pattern", "word", "n")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _one_apart(longer: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Pairs (rows of both) that differ by exactly one code point; the words of ``others`` have as many as those of ``longer`` or one less."""
    width, least = longer.shape[1], others.shape[1]
    found, step = [], max(1, BLOCK_BYTES // max(1, 4 * width * len(longer)))
    for at in range(0, len(others), step):
        part = others[at : at + step]
        if width == least:
            hits = np.argwhere((longer[:, None, :] != part[None, :, :]).sum(2) == 1)
        else:
            same = longer[:, None, :-1] == part[None, :, :]
            heads = np.logical_and.accumulate(same, 2).sum(2)
            tails = np.logical_and.accumulate((longer[:, None, 1:] == part[None, :, :])[:, :, ::-1], 2).sum(2)
            hits = np.argwhere(heads + tails >= least)
        found.append(hits + [0, at])
    return np.concatenate(found) if found else np.zeros((0, 2), int)


def _found_before(key: tuple, word: str, other: str) -> bool:
    """Whether a pair under a key that went by second halves, on any level, agrees in the first halves too, under which it is found already. The numbers of a key tell how it came about."""
    _, length, upto, behind, _, _ = key
    first = last = 0
    while first != upto or last != behind:
        half = (length - first - last) // 2
        if upto >= first + half:
            first += half
        elif other[: first + half] == word[: first + half]:
            return True
        else:
            last = length - first - half
    return False


def _shard(table: pa.Table) -> pa.Table:
    """The near pairs of a shard: ``word``, ``near``, ``near_n``, both ways."""
    keys, patterns, words, counts = (table[c].to_pylist() for c in ("key", "pattern", "word", "n"))
    held: dict[tuple, tuple[list[str], list[int]]] = {}
    texts: dict[str, set[tuple]] = {}
    scanned: dict[str, int] = {}
    name = lambda k: (k["side"], k["length"], k["first"], k["last"], k["head"], k["tail"])
    for key, pattern, word, n in zip(keys, patterns, words, counts, strict=True):
        if pattern:
            group = held.setdefault(name(key), ([], []))
            group[0].append(word)
            group[1].append(n)
            # the segment that the automaton holds: the shared beginning or, of second halves, the shared end
            texts.setdefault(key["head"] if key["side"] == "P" else key["tail"], set()).add(name(key))
        else:
            scanned[word] = n
    automaton = ahocorasick.Automaton()
    for text, names in texts.items():
        automaton.add_word(text, (len(text), sorted(names)))
    automaton.make_automaton()
    met: dict[tuple, list[str]] = {}
    for word in scanned if texts else ():
        for end, (size, names) in automaton.iter(word):
            for k in names:
                side, length, _, _, head, tail = k
                at_place = end + 1 == size if side == "P" else end + 1 == len(word)
                if at_place and length - 1 <= len(word) <= length and word.startswith(head) and word.endswith(tail):
                    met.setdefault(k, []).append(word)
    out: tuple[list, list, list] = ([], [], [])
    for k, group in met.items():
        longer, ns = held[k]
        length = k[1]
        a = _codes(longer, length)
        for width in (length, length - 1):
            others = [w for w in group if len(w) == width]
            if not others:
                continue
            for i, j in _one_apart(a, _codes(others, width)):
                word, other = longer[i], others[j]
                if width == length and word > other or _found_before(k, word, other):
                    continue
                for x, y, n in ((word, other, scanned[other]), (other, word, ns[i])):
                    out[0].append(x)
                    out[1].append(y)
                    out[2].append(n)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n`` of all words (distinct ``word``, ``n``) that differ by exactly one code point, both ways, each pair once."""
    shards = max(1, -(-6 * words.count() // SHARD_WORDS))
    dealt = _meetings(words).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_shard, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of words with a ``form``: pointers are doubled until none moves. Forms at least double in number, so paths are short."""
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of distinct words and their counts. A form is the near word of largest count, the first in code-point order, if that is at least twice the word's. No words give no rows."""
    words = keep(words)
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    leads = -F.col("best.less") >= 2 * F.col("n")
    formed = keep(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, every: int = 97, least_chars: int = 5, least_n: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spelling groups of a corpus' words (see ``word_counts``, ``spelling_groups``). Columns besides id and text are not looked at."""
    return spelling_groups(word_counts(df, every, least_chars, least_n, id_column, text_column))
