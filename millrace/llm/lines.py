"""Operator 8: drop lines that are within one edit of an earlier line, by a deletion-neighbourhood join.

Lines are compared as their lower-cased words. Two lines are one insertion, deletion or replacement of a
word apart exactly if one is a one-word deletion of the other, or both give the same line when the word at the same
place is deleted. So each line emits itself and its deletions as hashed keys, and equal keys
meet; a group of any size needs only its earliest line, never its pairs.

An edit may be an eighth of a line at most: a word of lines of eight words or more, a character of shorter ones of eight characters or more. Digits are never edited, as
"Chapter 2" is no copy of "Chapter 3".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHasher, by_bytes, keep, mix, partitions, small_batches, utf8

#: Words or, of lines of no more words, characters of a line that may have an edit.
LEAST_WORDS = LEAST_CHARS = 8
_SECOND = U64(0xE7037ED1A0B428DB)
#: Stands for a null id: the smallest there is.
_NO_ID = -(1 << 63)
POSITION = ["doc", "text_hash", "line"]
_POSITION_TYPE = "doc bigint, text_hash bigint, line int"
_POSITION = np.dtype([("doc", "<i8"), ("text_hash", "<i8"), ("line", "<i4")])
#: Numbers in the list of lines that are looked at again (8 bytes each), up to which the list is broadcast; a longer one is joined by shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Characters for each key that a line emits, at least about; and keys that one reducer task takes, about.
CHARS_PER_KEY, REDUCER_KEYS = 4, 4_000_000


class Sequences:
    """128-bit hashes of runs of words, of lines and of lines without one word, from running sums over a batch."""

    def __init__(self, hasher: WordHasher, words: np.ndarray) -> None:
        if len(words) + 2 > len(hasher.up):
            hasher._grow(len(words) + 2)
        self.up, self.down, self.sums = hasher.up, hasher.down, []
        with np.errstate(over="ignore"):
            for w in (words, mix(words + _SECOND)):
                total = np.zeros(len(words) + 1, U64)
                np.cumsum(w * self.up[: len(words)], out=total[1:])
                self.sums.append(total)

    def runs(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [mix((q[end] - q[start]) * self.down[start] + (end - start).astype(U64) * _SECOND) for q in self.sums]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """As ``runs``, of the words from start to end except the one at ``at``."""
        with np.errstate(over="ignore"):
            head = [(q[at] - q[start]) * self.down[start] for q in self.sums]
            tail = [(q[end] - q[at + 1]) * self.down[at + 1] * self.up[at - start] for q in self.sums]
            return [mix(h + t + (end - start - 1).astype(U64) * _SECOND) for h, t in zip(head, tail, strict=True)]


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts (one more for the end), their rows and their numbers in the text."""
    feeds = np.flatnonzero(data == 10) + 1
    rows = np.searchsorted(offsets, feeds - 1, "right") - 1
    starts = np.concatenate([offsets[:-1], feeds])
    rows = np.concatenate([np.arange(len(offsets) - 1), rows])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    return np.append(starts, offsets[-1]), rows, np.arange(len(rows)) - first[rows]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Tells keys of characters from keys of words.
_CHARS = U64(0xC2B2AE3D27D4EB4F)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each text starts (one more for the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return codes, np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]


def _halves(sequences: Sequences, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the first and the last c parts of each line, for c half of the line and half of one with one part less.

    One edit leaves the first or the last c parts alone, with c half the length of the shorter line; so lines that share none of these with another line have no neighbour.
    """
    n, keys = end - first, []
    for c in (n // 2, (n - 1) // 2):
        for side, (s, e) in enumerate(((first, first + c), (end - c, end))):
            keys.append(mix(sequences.runs(s, e)[0] + U64(side)))
    return np.stack(keys, 1)


def _lines_with_keys(least_words: int):
    """Each line that has words: position, hash, words, and the hashes of its halves, by words or characters as it may be edited."""
    return lambda batches: _keyed(batches, least_words)


def _keyed(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for part in by_bytes(batch, "text"):
            data, offsets = utf8(part.column("text"))
            starts, rows, numbers = _line_starts(data, offsets)
            _, _, line, words = hasher.words(data, starts)
            if not len(line):
                continue
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            end, line = np.r_[first[1:], len(words)], line[first]
            sequences = Sequences(hasher, words)
            a, b = sequences.runs(first, end)
            n = end - first
            by_words = np.flatnonzero(n >= least_words)
            owners, keys = [by_words], [_halves(sequences, first[by_words], end[by_words])]
            few = np.flatnonzero(n <= least_words)
            texts = [_plain(data[starts[i] : starts[i + 1]].tobytes().decode()) for i in line[few]]
            long = [i for i, t in enumerate(texts) if len(t) >= LEAST_CHARS]
            if long:
                codes, at = _characters([texts[i] for i in long])
                owners.append(few[long])
                keys.append(_halves(Sequences(hasher, mix(codes.astype(U64) + _CHARS)), at[:-1], at[1:]))
            owner, flat = np.repeat(np.concatenate(owners), 4), np.concatenate(keys).reshape(-1)
            order = np.argsort(owner, kind="stable")
            halves = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(len(line) + 1)), pa.int32()), _signed(flat[order]))
            row = pa.array(rows[line])
            yield pa.RecordBatch.from_arrays([part.column("doc").take(row), part.column("text_hash").take(row), pa.array(numbers[line], pa.int32()), _signed(a), _signed(b), halves], [*POSITION, "a", "b", "halves"])


def _deletions(sequences: Sequences, first: np.ndarray, end: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines (place -1) and of lines (``of``) without their part at ``at``: key, place and line of each."""
    key = np.concatenate([sequences.runs(first, end)[0], sequences.without(first[of], end[of], at)[0]])
    place = np.concatenate([np.full(len(first), -1, np.int32), (at - first[of]).astype(np.int32)])
    return key, place, np.concatenate([np.arange(len(first)), of])


def _neighbourhoods(n_reducers: int, least_words: int):
    """Each line's own key (place -1), and its key without each of its words, or characters, packed for reducers.

    Of members that agree in key and place, all but the earliest of a batch already have their earlier line (reducer -1: its position);
    only the earliest goes on, so that a key with any number of lines sends one entry a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                _, _, line, words = hasher.words(*utf8(part.column("text")))
                if not len(line):
                    continue
                position = np.rec.fromarrays([part.column(c).to_numpy(zero_copy_only=False) for c in POSITION], dtype=_POSITION)
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                end, line = np.r_[first[1:], len(words)], line[first]
                n = end - first
                many = np.flatnonzero(n >= least_words)
                of = np.repeat(np.arange(len(many)), n[many])
                at = np.concatenate([np.arange(a, b) for a, b in zip(first[many], end[many], strict=True)]) if len(many) else np.zeros(0, np.int64)
                key, word, of = _deletions(Sequences(hasher, words), first[many], end[many], at, of)
                row = line[many][of]
                few = line[n <= least_words]
                texts = [_plain(t) for t in part.column("text").take(pa.array(few)).to_pylist()]
                long = [i for i, t in enumerate(texts) if len(t) >= LEAST_CHARS]
                if long:
                    codes, starts = _characters([texts[i] for i in long])
                    letters = np.flatnonzero((codes < 48) | (codes > 57))
                    more = _deletions(Sequences(hasher, mix(codes.astype(U64) + _CHARS)), starts[:-1], starts[1:], letters, np.searchsorted(starts, letters, "right") - 1)
                    key, word, row = np.concatenate([key, mix(more[0] + _CHARS)]), np.concatenate([word, more[1]]), np.concatenate([row, few[long][more[2]]])
                rank = np.empty(part.num_rows, np.int64)
                rank[np.argsort(position, order=POSITION, kind="stable")] = np.arange(part.num_rows)
                order = np.lexsort((rank[row], word, key))
                key, word, row = key[order], word[order], row[order]
                head = np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1])][: len(key)]
                of_head = np.flatnonzero(head)[np.cumsum(head) - 1]
                late = ~head & (row != row[of_head])
                out = [(-1, position[row[late]].tobytes(), position[row[of_head][late]].tobytes(), b"")] if late.any() else []
                key, word, row = key[head], word[head], row[head]
                to = (key >> U64(32)) % U64(n_reducers)
                order = np.argsort(to, kind="stable")
                key, word, row, to = key[order], word[order], row[order], to[order]
                ends = np.searchsorted(to, np.arange(n_reducers + 1))
                for r in np.flatnonzero(np.diff(ends)):
                    here = slice(ends[r], ends[r + 1])
                    out.append((int(r), position[row[here]].tobytes(), key[here].tobytes(), word[here].tobytes()))
                if not out:
                    continue
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["reducer", "positions", "keys", "words"])

    return run


def _pairs(at: np.ndarray, earliest: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**{c: at[c] for c in POSITION}, **{f"earlier_{c}": earliest[c] for c in POSITION}})


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Lines of one reducer that have an earlier neighbour, each with it: the earliest of the same key and word (a replaced word), or of a line and the lines that it is a deletion of."""
    at = np.frombuffer(b"".join(group["positions"]), _POSITION)
    if group["reducer"].iat[0] < 0:
        return _pairs(at, np.frombuffer(b"".join(group["keys"]), _POSITION))
    key, word = np.frombuffer(b"".join(group["keys"]), U64), np.frombuffer(b"".join(group["words"]), np.int32)
    order = np.lexsort((at["line"], at["text_hash"], at["doc"], word, key))
    at, key, word = at[order], key[order], word[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = np.flatnonzero(first != np.arange(len(key)))
    found = [_pairs(at[late], at[first[late]])]
    # a key's whole line stands first in its run (word -1), then the earliest of each word
    heads = np.flatnonzero(new)
    run = np.flatnonzero(np.r_[True, key[heads][1:] != key[heads][:-1]])
    whole = np.repeat(heads[run], np.diff(np.r_[run, len(heads)]))
    cut = np.flatnonzero((word[whole] < 0) & (word[heads] >= 0))
    mine, its = at[heads[cut]], at[whole[cut]]
    its_first = its["line"] < mine["line"]
    for c in reversed(POSITION[:-1]):
        its_first = np.where(its[c] == mine[c], its_first, its[c] < mine[c])
    found.append(_pairs(mine[its_first], its[its_first]))
    found.append(_pairs(its[~its_first], mine[~its_first]))
    return pd.concat(found)


def within_one_edit(a: list[str] | str, b: list[str] | str) -> bool:
    """Whether one insertion, deletion or replacement of a word (or of a character of a text), or none, turns one list into the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


_LOWERED = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)}


def _words(line: str) -> list[str]:
    return [w for w in line.translate(_LOWERED).split(" ") if w]


def _plain(line: str) -> str:
    return " ".join(_words(line))


def near(a: str, b: str, least_words: int = LEAST_WORDS) -> bool:
    """Whether two lines are within one edit: of a word if both have ``least_words`` or more, of a character that is no digit if both have no more than that and LEAST_CHARS characters."""
    x, y = _words(a), _words(b)
    if min(len(x), len(y)) >= least_words and within_one_edit(x, y):
        return True
    if max(len(x), len(y)) > least_words:
        return False
    x, y = " ".join(x), " ".join(y)
    return min(len(x), len(y)) >= LEAST_CHARS and within_one_edit(x, y) and [c for c in x if "0" <= c <= "9"] == [c for c in y if "0" <= c <= "9"]


def _verified(least_words: int):
    return F.pandas_udf(lambda a, b: pd.Series([near(x, y, least_words) for x, y in zip(a, b, strict=True)]), "boolean")


def _rebuilt(text: pd.Series, kept: pd.Series) -> pd.DataFrame:
    out = []
    for t, k in zip(text, kept, strict=True):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines, keep = t.split("\n"), set() if k is None else set(k)
        blank = [not x.strip(" \t\r\x0b\x0c") for x in lines]
        stays = [x for i, x in enumerate(lines) if blank[i] or i in keep]
        out.append(("\n".join(stays) if keep or all(blank) else "", len(lines) - sum(blank), len(keep)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_kept"])


def _near_earlier(firsts: DataFrame, documents: DataFrame, least_words: int) -> DataFrame:
    """Positions of the distinct lines that are within one edit of an earlier one."""
    spark = firsts.sparkSession
    halves = firsts.where(F.size("halves") > 0).select("id", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    suspects = halves.join(shared, "half").select("id").distinct()
    by_document = keep(firsts.join(suspects, "id").groupBy("doc", "text_hash").agg(F.collect_set("line").alias("numbers")))
    small = by_document.agg(F.sum(F.size("numbers") + 6)).first()[0] or 0
    asked = F.broadcast(by_document) if small <= BROADCAST_NUMBERS else by_document
    d, q = documents.select("doc", "text_hash", "text").alias("d"), asked.alias("q")
    lines = d.join(q, (F.col("d.doc") == F.col("q.doc")) & (F.col("d.text_hash") == F.col("q.text_hash"))).select("d.doc", "d.text_hash", "numbers", F.split("text", "\n").alias("lines"))
    lines = lines.select("doc", "text_hash", F.explode("numbers").alias("line"), "lines").select(*POSITION, F.get("lines", F.col("line")).alias("text"))
    lines = keep(lines)

    n_keys = (lines.agg(F.sum(F.length("text"))).first()[0] or 0) / CHARS_PER_KEY
    n_reducers = max(partitions(spark), int(n_keys / REDUCER_KEYS) + 1)
    blobs = lines.mapInArrow(_neighbourhoods(n_reducers, least_words), "reducer int, positions binary, keys binary, words binary")
    blobs = blobs.withColumn("salt", F.when(F.col("reducer") < 0, F.xxhash64("positions")).otherwise(0))
    found = blobs.groupBy("reducer", "salt").applyInPandas(_meet, f"{_POSITION_TYPE}, earlier_doc bigint, earlier_text_hash bigint, earlier_line int")
    pairs = found.distinct()
    texts = lines.dropDuplicates(POSITION)
    its = texts.select(*(F.col(c).alias(f"earlier_{c}") for c in POSITION), F.col("text").alias("earlier_text"))
    checked = pairs.join(texts, POSITION).join(its, [f"earlier_{c}" for c in POSITION])
    return checked.where(_verified(least_words)("text", "earlier_text")).select(*POSITION).distinct()


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` with each text reduced to the lines that have no earlier near copy, and ``n_lines``, ``n_kept``: its lines with words before and after.

    A line goes if an earlier line of any document has the same words; or, both having ``least_words`` or more (2 at least), words within one edit; or, both having no more than that, words that are one character apart (words
    joined by single spaces, LEAST_CHARS at least; an inserted, deleted or replaced digit is no edit). Whether that earlier line itself stays does not matter. Earlier: by id, then by a hash of the
    text, then by place. A null id counts as the smallest. Blank lines are never dropped or counted, except that a text none of whose lines is kept
    becomes empty. Rows that agree in id and text are one document and keep the same lines. A null text stays null.
    Columns of ``df`` named n_lines or n_kept are replaced, all others kept.

    Lines are shuffled as hashes. Only lines that share one of four half-line hashes with another distinct line come back
    as text to emit their deletions: no other line can have a neighbour.
    """
    kept_columns = [c for c in df.columns if c not in ("n_lines", "n_kept")]
    documents = small_batches(df).select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.col(text_column)).alias("text_hash"), F.col(text_column).alias("text"), F.struct(*(c for c in kept_columns if c != text_column)).alias("row"))
    keyed = documents.select("doc", "text_hash", "text").mapInArrow(_lines_with_keys(max(least_words, 2)), f"{_POSITION_TYPE}, a bigint, b bigint, halves array<bigint>")
    firsts = keyed.groupBy("a", "b").agg(F.min(F.struct(*POSITION, "halves")).alias("first")).select("first.*")
    firsts = keep(firsts.withColumn("id", F.monotonically_increasing_id()))
    near = _near_earlier(firsts, documents, max(least_words, 2))
    staying = firsts.select(*POSITION).join(near, POSITION, "left_anti")
    kept = staying.groupBy("doc", "text_hash").agg(F.collect_list("line").alias("kept"))
    joined = documents.alias("d").join(kept.alias("k"), (F.col("d.doc") == F.col("k.doc")) & (F.col("d.text_hash") == F.col("k.text_hash")), "left")
    # nondeterministic only by name: else a filter on the counts asks for it a second time, which keeps a second worker busy in each task
    rebuilt = F.pandas_udf(_rebuilt, "text string, n_lines int, n_kept int").asNondeterministic()
    built = joined.select("row", "kept", rebuilt("text", "kept").alias("new"))
    columns = [F.col("new.text").alias(c) if c == text_column else F.col(f"row.{c}").alias(c) for c in kept_columns]
    return built.select(*columns, "new.n_lines", "new.n_kept")
