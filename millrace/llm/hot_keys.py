"""Pairs of entries that share a key, in proportion to the entries even where thousands share one.

An entry is a set of 64-bit keys with a component; a pair matters only across components. Keys travel packed: one row for a batch and
a reducer, not one for a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep, mix, partitions

_COLUMNS = ["entries", "components", "keys", "tags"]
#: Of keys that more than two entries have, one in so many pairs its members with the smallest of them.
STAR_SHARE = 8
#: Keys that one reducer takes, about.
REDUCER_KEYS = 1_000_000
#: Pairs that a reducer looks at in one step, about; and words of bits that it compares at once.
STEP = 2_000_000
_MET = "kind int, a bigint, b bigint, n bigint, dest int, entries binary, keys binary, tags binary"


def _cut(to: np.ndarray, n: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The receivers that get anything, and each column's bytes for each of them."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(n + 1))
    receivers = np.flatnonzero(np.diff(ends))
    return receivers, [[(c := column[order])[ends[p] : ends[p + 1]].tobytes() for p in receivers] for column in columns]


def _flat(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]]


def _deal(n: int):
    """(entry, component, keys, tags) to one row for each reducer with its keys and whose they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = _flat(batch.column("keys")), _flat(batch.column("tags"))
            owner = [np.repeat(batch.column(c).to_numpy(), np.diff(batch.column("keys").offsets.to_numpy())) for c in ("entry", "component")]
            to = (mix(keys.view(U64)) >> U64(20)) % U64(n)
            receivers, columns = _cut(to.astype(np.int64), n, [*owner, keys, tags if len(tags) else np.zeros(len(keys), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(receivers, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["reducer", *_COLUMNS])

    return run


class Group:
    """What a reducer got, in the order of keys and entries."""

    def __init__(self, group: pd.DataFrame) -> None:
        columns = [np.frombuffer(b"".join(group[c]), np.int64) for c in _COLUMNS]
        order = np.lexsort((columns[0], columns[2]))
        self.entry, self.component, self.key, self.tag = (c[order] for c in columns)
        self.first = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        self.size = np.diff(np.r_[self.first, len(self.key)])
        #: Keys of more than one component.
        self.mixed = np.minimum.reduceat(self.component, self.first) != np.maximum.reduceat(self.component, self.first)

    def returned(self, chosen: np.ndarray, tag: np.ndarray, n: int) -> pd.DataFrame:
        """The chosen keys, packed for the tasks that gather what belongs to an entry."""
        to = (mix(self.entry[chosen].view(U64)) >> U64(20)) % U64(n)
        receivers, (entries, keys, tags) = _cut(to.astype(np.int64), n, [self.entry[chosen], self.key[chosen], tag[chosen]])
        return pd.DataFrame({"kind": 2, "a": 0, "b": 0, "n": 0, "dest": receivers, "entries": entries, "keys": keys, "tags": tags})


def _pairs(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Distinct pairs and how often each was found."""
    rows, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_counts=True)
    return pd.DataFrame({"kind": kind, "a": rows[:, 0], "b": rows[:, 1], "n": n, "dest": 0, "entries": b"", "keys": b"", "tags": b""})


def _opposite(limit: int, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """kind 0: entries a and b of different components whose tags differ in the lowest bit share n keys of at most ``limit`` entries. kind 2: keys of more entries, with the entries' tags."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        g = Group(group)
        few, hot = g.mixed & (g.size <= limit), np.repeat(g.mixed & (g.size > limit), g.size)
        of = np.repeat(np.where(few, np.arange(len(g.first)), -1), g.size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, int(g.size[few].max(initial=1))):
            i = np.flatnonzero((of[:-d] >= 0) & (of[:-d] == of[d:]))
            i = i[(g.component[i] != g.component[i + d]) & ((g.tag[i] ^ g.tag[i + d]) & 1 == 1)]
            left.append(g.entry[i])
            right.append(g.entry[i + d])
        return pd.concat([_pairs(0, np.concatenate(left), np.concatenate(right)), g.returned(hot, g.tag, n)])

    return meet


def _counted(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """kind 1: entry b shares n keys with a, the smallest that has them, of a share of the keys. kind 2: keys of several components, with the number of their entries as tag."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        g = Group(group)
        mixed, centre = np.repeat(g.mixed, g.size), np.repeat(g.first, g.size)
        star = mixed & np.repeat(g.size > 2, g.size) & (mix(g.key.view(U64)) % U64(STAR_SHARE) == 0) & (g.component != g.component[centre])
        return pd.concat([_pairs(1, g.entry[centre][star], g.entry[star]), g.returned(mixed, np.repeat(g.size, g.size), n)])

    return meet


def _within(low: np.ndarray, high: np.ndarray, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with low[i] <= j < high[i], j counted from ``offset``, a bounded number at once."""
    n = np.maximum(high - low, 0)
    cuts = np.searchsorted(np.cumsum(n), np.arange(STEP, int(n.sum()) + STEP, STEP), "left") + 1 if n.sum() else []
    start = 0
    for end in cuts:
        part = n[start:end]
        i = np.repeat(np.arange(start, start + len(part)), part)
        yield i, offset + low[i] + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        start = end


def _candidates(g: Group, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries of different components that may have enough in common from a shared key on, a bounded number at once. A tag holds an entry's size (upper half) and its keys from this one on, ``left``.

    Entries of sizes r and s need t(r+s)/(100+t) in common, so an entry has room for partners of up to left(100+t)/t - r. The smaller of a pair
    must have room for one of its own size; such entries are *strong*. An entry that is not meets smaller strong ones only. Of the strong ones, those of the component that most of them have meet
    only entries of others.
    """
    size, left = g.tag >> 32, g.tag & 0xFFFFFFFF
    room = left * (100 + t) // t - size
    for k in np.flatnonzero(g.mixed & (g.size > 1)):
        rows = np.arange(g.first[k], g.first[k] + g.size[k])
        strong = rows[room[rows] >= size[rows]]
        if not len(strong):
            continue
        strong = strong[np.argsort(size[strong], kind="stable")]
        named, count = np.unique(g.component[strong], return_counts=True)
        in_main = g.component[strong] == named[np.argmax(count)]
        for small, large in ((strong[~in_main], rows), (strong[in_main], rows[g.component[rows] != named[np.argmax(count)]])):
            low = np.searchsorted(size[small], -(-size[large] * t // 100), "left")
            high = np.searchsorted(size[small], np.minimum(size[large], room[large]), "right")
            for i, j in _within(low, high, 0):
                a, b = large[i], small[j]
                fits = (g.component[a] != g.component[b]) & (size[a] <= room[b])
                yield g.entry[a[fits]], g.entry[b[fits]]


class Bits:
    """Sets as rows of bits, one for each member that two of them have."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        values, number, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        place = np.cumsum(count > 1)[number[shared]] - 1
        self.rows = np.zeros((len(sets), int((count > 1).sum()) // 64 + 1), U64)
        np.bitwise_or.at(self.rows, (owner[shared], place // 64), U64(1) << (place % 64).astype(U64))

    def linked(self, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether sets a and b, pair by pair, have t percent of their union in common."""
        out, step = np.zeros(len(a), bool), max(1, STEP // self.rows.shape[1])
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            common = np.bitwise_count(self.rows[x] & self.rows[y]).sum(1, dtype=np.int64)
            out[at : at + step] = 100 * common >= t * (self.size[x] + self.size[y] - common)
        return out


def _links(t: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def meet(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Links a, b between entries of a reducer that unite them as all of its links would: those that join two of what is not yet joined here."""
        found: list[tuple[int, int]] = []
        if len(group) and len(held):
            g = Group(group)
            entry = held["entry"].to_numpy()
            order = np.argsort(entry)
            entry, bits = entry[order], Bits([np.frombuffer(held["members"].iat[i], np.int64) for i in order])
            # components of this reducer: those that the entries come with, and what links here join
            root = {c: c for c in np.unique(g.component).tolist()}
            component = np.empty(len(entry), np.int64)
            component[np.searchsorted(entry, g.entry)] = g.component

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for a, b in _candidates(g, t):
                pair = np.unique(np.stack([np.searchsorted(entry, np.minimum(a, b)), np.searchsorted(entry, np.maximum(a, b))], 1), axis=0)
                now = {c: top(c) for c in root}
                joined = np.array([now[c] for c in component.tolist()])
                pair = pair[joined[pair[:, 0]] != joined[pair[:, 1]]]
                for i, j in pair[bits.linked(pair[:, 0], pair[:, 1], t)].tolist():
                    x, y = top(int(component[i])), top(int(component[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((int(entry[i]), int(entry[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return meet


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    entry, key, tag = (np.frombuffer(b"".join(group[c]), np.int64) for c in ("entries", "keys", "tags"))
    order = np.lexsort((key, entry))
    entry, key, tag = entry[order], key[order], tag[order]
    first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    return pd.DataFrame({"entry": entry[first], "keys": np.split(key, first[1:]), "tags": np.split(tag, first[1:])})


def _blobs(entries: DataFrame, n: int) -> DataFrame:
    return entries.select("entry", "component", "keys", "tags").mapInArrow(_deal(n), "reducer int, entries binary, components binary, keys binary, tags binary")


def _met(entries: DataFrame, meet: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return keep(_blobs(entries, partitions(entries.sparkSession)).groupBy("reducer").applyInPandas(meet, _MET))


def _members(n: int):
    """(entry, keys, members) to one row for each reducer that has a key of the entry: reducer, entry, members as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = batch.column("keys").offsets.to_numpy(), _flat(batch.column("keys"))
            to = ((mix(keys.view(U64)) >> U64(20)) % U64(n)).astype(np.int32)
            ends, members = batch.column("members").offsets.to_numpy(), batch.column("members").values.to_numpy()
            entries = batch.column("entry").to_numpy()
            for i in range(batch.num_rows):
                reducers = np.unique(to[at[i] - at[0] : at[i + 1] - at[0]])
                blob = members[ends[i] : ends[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(reducers), pa.array(np.full(len(reducers), entries[i])), pa.array([blob] * len(reducers), pa.binary())], ["reducer", "entry", "members"])

    return run


def _found(met: DataFrame, kind: int) -> DataFrame:
    return met.where(F.col("kind") == kind).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _of_entries(met: DataFrame) -> DataFrame:
    return keep(met.where("kind = 2").select("dest", "entries", "keys", "tags").groupBy("dest").applyInPandas(_gather, "entry bigint, keys array<bigint>, tags array<bigint>"))


def opposite_pairs(entries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of ``entries`` (entry, component: bigint; keys, tags: array<bigint> of the same length): pairs a < b of different components whose tags differ in the lowest bit at a key that at most ``limit`` entries have, and n, at how many; and each entry's keys of several components that more entries have (entry, keys, tags)."""
    met = _met(entries, _opposite(limit, partitions(entries.sparkSession)))
    return _found(met, 0), _of_entries(met)


def shared_parts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``entries`` (tags may be empty): each entry's keys that an entry of another component has too (entry, keys, tags: how many entries have each); and stars a, b, n: entries of different components that share n keys of a share of all, of which a is the smallest that has them."""
    met = _met(entries, _counted(partitions(entries.sparkSession)))
    return _of_entries(met), _found(met, 1)


def fitting_links(entries: DataFrame, t: int) -> DataFrame:
    """Links (a, b) of entries of different components that have t percent of their union in common, as many as unite them as all such links would. ``members``: all that is in an entry's set; keys: as many of these as must hold one
    of those that two have in common, in one order of all keys; tags: the set's size times 2^32 plus how many of its shared members stand from that key on (see ``_candidates``).

    A set goes once to each reducer that has a key of it, and pairs are compared there, as bits, so that only links leave the reducer, and of these no more than join something: their number is bounded by that of the
    entries, whatever the number of pairs.
    """
    n_keys = entries.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    n = max(partitions(entries.sparkSession), int(n_keys / REDUCER_KEYS) + 1)
    held = entries.select("entry", "keys", "members").mapInArrow(_members(n), "reducer int, entry bigint, members binary")
    met = _blobs(entries, n).groupBy("reducer").cogroup(held.groupBy("reducer")).applyInPandas(_links(t), "a bigint, b bigint")
    return keep(met).distinct()
