"""Operator 4: exact Jaccard self-join of word-shingle sets by universe partitions and the pigeonhole principle.

Sets of similar size share a *band*, and each band has its own number m of *segments*: every shingle belongs to
one segment, by its hash. Two sets of r and s shingles with Jaccard >= t/100 differ in at most
D = (r+s)(100-t)/(100+t) shingles, so at most D segments differ, and the rest are equal. The key of a segment is a hash
of the subset of a set that falls into it; sets that link meet in some key. A set emits its keys in its own band, and
in the bands below that hold smaller sets it may link with.

*Allocation by cost.* m exceeds D+1, so some keys can do without: a key that more than HOT sets share is hot, and costs
too much to pair off. A set that keeps more than D keys that are not hot finds all its links by those. Other sets
are *saturated*: links between two of them are sought by giving segments of three shingles or more a second unit, the
one-deletion neighbourhood (a segment that differs by one shingle), where its keys are not hot. Sets that even this does not
cover, such as tiny ones that leave segments empty, are compared among themselves by the rarest of the shingles that they share with others (``_compared``).

Only connected components are wanted. So first some keys pair their members with their smallest one, each set tries the few partners with
which it shares most keys, and the links found unite sets; later pairs are made only between different components.
All pairs are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHasher, by_bytes, keep, mix, partitions, shingles, small_batches, utf8
from .components import components
from .hot_keys import fitting_links, opposite_pairs, shared_parts

WIDTH, THRESHOLD = 5, 75
#: Upper end of a band over its lower end.
BAND_RATIO = 1.5
#: Segments beyond D+1, as a share of it, for bands that begin at these sizes. Small sets leave more segments empty, and a passage that many
#: documents share makes up more of them.
SPARE = {0: 3.0, 32: 1.5, 256: 0.6, 1024: 0.25}
#: Sets that share a key, beyond which it is hot.
HOT = 24
#: Bytes of a key that are compared within a reducer: of 2 million keys about two agree by chance, which a later check finds out.
KEY_BYTES = 5
#: Bytes of text that a task turns into sets at once.
SLICE_BYTES = 1 << 20
#: Keys of a set, about, by which its likeliest partners are sought, and how many of these are tried first.
STARS, PARTNERS = 16, 6
#: Keys that one reducer task takes at once, about.
REDUCER_KEYS = 2_000_000
#: Rows of a table of sets (16 to 32 bytes each) up to which a join broadcasts it; beyond it, it is shuffled.
BROADCAST_NODES = 100_000
#: As that, for the ids of the documents whose texts are read again (16 bytes each): the shuffle that it spares is one of all texts.
BROADCAST_IDS = 500_000
#: Tags of keys: below the band, segment and side.
_BAND_BITS = 40
_SEGMENT_SEED, _SUBSET_SEED, _A, _B = (U64(x) for x in (0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def band_ends() -> np.ndarray:
    """The smallest size of each band."""
    ends = [1]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
    return np.array(ends)


_BANDS = band_ends()


def most_different(r, s, t: int = THRESHOLD):
    """Shingles in which linked sets of these sizes differ at most."""
    return (r + s) * (100 - t) // (100 + t)


class Scopes:
    """In which bands a set emits keys, and how many segments each band has."""

    def __init__(self, t: int = THRESHOLD) -> None:
        self.t = t
        highest = _BANDS[1:] - 1
        self.different = most_different(highest, highest * 100 // t, t)
        share = np.array([SPARE[max(k for k in SPARE if k <= low)] for low in _BANDS[:-1].tolist()])
        self.segments = self.different + 1 + np.ceil(share * (self.different + 1)).astype(np.int64)

    def of(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Bands that some of these sets emit in, with the sets' places. A band in which linked sets are equal has no keys."""
        own = np.searchsorted(_BANDS, sizes, "right") - 1
        least = -(-sizes * self.t // 100)
        for band in range(int(own.max(initial=-1)) + 1):
            if self.different[band]:
                into = np.flatnonzero((own == band) | ((own > band) & (least < _BANDS[band + 1]) & (sizes > 0)))
                if len(into):
                    yield band, into

    def most(self, band: int, sizes: np.ndarray) -> np.ndarray:
        """D of each set and any set that it may meet in this band: in its own band also larger sets, which emit from the bands above."""
        partner = sizes * 100 // self.t
        own = sizes < _BANDS[band + 1]
        return most_different(sizes, np.where(own, partner, np.minimum(_BANDS[band + 1] - 1, partner)), self.t)


def sets_of(texts: pa.Array, hasher: WordHasher, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows end to end, sorted in each row, and where each row starts (one more for the end)."""
    data, offsets = utf8(texts)
    _, _, row, word = hasher.words(data, offsets)
    rows, values = shingles(row, word, width)
    bits = max(1, int(len(offsets)).bit_length())
    short = (rows.astype(U64) << U64(64 - bits)) | (values >> U64(bits))
    order = np.argsort(short)
    rows, values, short = rows[order], values[order], short[order]
    if len(rows):
        new = np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]
        if (new[1:] & (short[1:] == short[:-1])).any():  # two shingles that differ in the last bits only
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            new = np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]
        rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(offsets)))


def nodes_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets have equal ids."""
    with np.errstate(over="ignore"):
        total = np.r_[U64(0), np.cumsum(mix(values + _A))]
        return mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(U64) * _B).view(np.int64)


def segment_sums(values: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each non-empty segment's slot (row * m + segment), subset hash before mixing and size; and each shingle's place in that list."""
    slot = rows * m + (mix(values + _SEGMENT_SEED) % U64(m)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    sorted_slot = slot[order]
    first = np.flatnonzero(np.r_[True, sorted_slot[1:] != sorted_slot[:-1]])
    with np.errstate(over="ignore"):
        total = np.r_[U64(0), np.cumsum(mix(values[order] + _SUBSET_SEED))]
    end = np.r_[first[1:], len(slot)]
    sums = total[end] - total[first]
    member = np.empty(len(slot), np.int64)
    member[order] = np.repeat(np.arange(len(first)), end - first)
    return sorted_slot[first], sums, end - first, member


def key_of(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + segment.astype(U64) * _A + U64(band + 1) * _B)


def _pick(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the given rows end to end, and each value's place in ``which``."""
    sizes = starts[which + 1] - starts[which]
    before = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(starts[which] - before[:-1], sizes) + np.arange(before[-1])
    return values[at], np.repeat(np.arange(len(which)), sizes)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                values, starts = sets_of(part.column("text"), hasher, width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(starts)), pa.array(nodes_of(values, starts))], ["doc_id", "text_hash", "n_shingles", "node"])

    return run


def _emit(width: int, t: int, n_reducers: int):
    """Of each batch, one row for each reducer: the ids of its sets, how many keys each sends there, and the band and the lowest 5 bytes of each key. An id goes to a reducer once, whatever the bands.

    Rows for negative reducers hold how many keys each set has in each band beyond its D.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, scopes = WordHasher(), Scopes(t)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                values, starts = sets_of(part.column("text"), hasher, width)
                node, found_keys, found_nodes, found_bands, spare = nodes_of(values, starts), [], [], [], []
                for band, which in scopes.of(np.diff(starts)):
                    own, rows = _pick(values, starts, which)
                    m = int(scopes.segments[band])
                    slot, sums, _, _ = segment_sums(own, rows, len(which), m)
                    found_keys.append(key_of(sums, slot % m, band))
                    found_nodes.append(node[which][slot // m])
                    found_bands.append(np.full(len(slot), band, np.uint8))
                    spare.append((node[which], np.full(len(which), band), np.bincount(slot // m, minlength=len(which)) - scopes.most(band, np.diff(starts)[which])))
                if not found_keys:
                    continue
                keys, nodes, bands = np.concatenate(found_keys), np.concatenate(found_nodes), np.concatenate(found_bands)
                to = ((keys >> U64(48)) % U64(n_reducers)).astype(np.int64)
                order = np.lexsort((bands, nodes, to))
                keys, nodes, bands, to = keys[order], nodes[order], bands[order], to[order]
                ends = np.searchsorted(to, np.arange(n_reducers + 1))
                out = []
                for p in np.flatnonzero(np.diff(ends)):
                    n, b, k = nodes[ends[p] : ends[p + 1]], bands[ends[p] : ends[p + 1]], keys[ends[p] : ends[p + 1]]
                    new = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
                    octets = np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                    out.append((int(p), n[new].tobytes(), b.tobytes(), np.diff(np.r_[new, len(n)]).astype(np.uint32).tobytes(), octets.tobytes()))
                spared, own, left = (np.concatenate(x) for x in zip(*spare, strict=True))
                to = spared % n_reducers
                for p in np.unique(to):
                    here = to == p
                    out.append((-1 - int(p), spared[here].tobytes(), own[here].astype(np.uint8).tobytes(), left[here].astype(np.int32).tobytes(), b""))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["reducer", "nodes", "bands", "counts", "key_bytes"])

    return run


def _meet(t: int):
    stride = np.maximum(1, Scopes(t).segments // STARS).astype(np.uint64)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """What one reducer finds.

        kind 0: sets x and y alone share n keys. kind 1: members y of a key x of 3 to HOT sets. kind 2: how often (n) set x has a hot key in band y.
        kind 3: set x has n keys beyond D in band y. kind 4: sets x and y share n keys of three or more sets of which x is the smallest; of each set about STARS keys are
        looked at for that.
        """
        nodes = [np.frombuffer(x, np.int64) for x in group["nodes"]]
        bands = [np.frombuffer(x, np.uint8) for x in group["bands"]]
        if group["reducer"].iat[0] < 0:
            left = np.concatenate([np.frombuffer(x, np.int32) for x in group["counts"]])
            rows = np.unique(np.stack([np.concatenate(nodes), np.concatenate(bands).astype(np.int64), left.astype(np.int64)], 1), axis=0)
            return pd.DataFrame({"kind": np.full(len(rows), 3), "x": rows[:, 0], "y": rows[:, 1], "n": rows[:, 2]})
        counts = [np.frombuffer(x, np.uint32) for x in group["counts"]]
        node = np.concatenate([np.repeat(a, c) for a, c in zip(nodes, counts, strict=True)])
        band = np.concatenate(bands)
        octets = np.frombuffer(b"".join(group["key_bytes"]), np.uint8).reshape(-1, KEY_BYTES)
        eight = np.zeros((len(octets), 8), np.uint8)
        eight[:, :KEY_BYTES] = octets
        key = eight.reshape(-1).view("<u8")
        order = np.lexsort((node, key))
        node, key, band = node[order], key[order], band[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        node, key, band = node[new], key[new], band[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        of = np.repeat(np.arange(len(first)), size)
        smallest = node[first][of]

        def pairs_of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.unique(np.stack([smallest[chosen], node[chosen]], 1), axis=0, return_counts=True)

        two, n_two = pairs_of((size[of] == 2) & (node != smallest))
        star, n_star = pairs_of((size[of] > 2) & (node != smallest) & (key % stride[band] == 0))
        some, hot = (size[of] > 2) & (size[of] <= HOT), size[of] > HOT
        hots, n_hots = np.unique(np.stack([node[hot], band[hot].astype(np.int64)], 1), axis=0, return_counts=True)
        with np.errstate(over="ignore"):
            group_key = mix(key[some] + U64(int(group["reducer"].iat[0]) + 1) * _B).view(np.int64)
        kinds = np.repeat([0, 1, 2, 4], [len(two), int(some.sum()), len(hots), len(star)])
        return pd.DataFrame({"kind": kinds, "x": np.r_[two[:, 0], group_key, hots[:, 0], star[:, 0]], "y": np.r_[two[:, 1], node[some], hots[:, 1], star[:, 1]], "n": np.r_[n_two, np.zeros(int(some.sum()), np.int64), n_hots, n_star]})

    return meet


def _sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, n: int) -> DataFrame:
    """``node`` and its sorted distinct shingles of the wanted nodes (column node), read again from the text of one document of each. n: nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                values, starts = sets_of(part.column("text"), hasher, width)
                yield pa.RecordBatch.from_arrays([part.column("wanted"), pa.array(nodes_of(values, starts)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))], ["wanted", "node", "shingles"])

    asked = keep(nodes.join(_small(keep(wanted.select("node").distinct(), n)), "node").select(F.col("node").alias("wanted"), "first.doc_id", "first.text_hash"), n)
    nameless = asked.where("doc_id is null").select("wanted", "text_hash")
    texts = documents.join(_small(asked.where("doc_id is not null").select("wanted", "doc_id"), BROADCAST_IDS), "doc_id").select("wanted", "text")
    read = lambda texts: texts.mapInArrow(run, "wanted bigint, node bigint, shingles array<bigint>").where("wanted = node").drop("wanted")
    found = read(texts)
    if not nameless.isEmpty():
        found = found.unionByName(read(documents.where("doc_id is null").join(nameless, "text_hash").select("wanted", "text")).dropDuplicates(["node"]))
    return keep(found)


def _linked(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose sets link; the set of a, of which there are fewer, goes to b."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= t * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _neighbourhoods(t: int):
    """Keys of saturated sets in the bands where they are so: whole segments (side 0), and segments of three shingles or more without one of them (side 1).

    One row for a set. A tag is the band, the segment plus one (zero for smaller segments) and the side; ``wide`` counts the segments of three or more of each band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes = Scopes(t)
        for batch in batches:
            lists, bands, out = batch.column("shingles"), batch.column("bands").to_pylist(), []
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            for i in range(batch.num_rows):
                values, keys, tags, wides = flat[ends[i] : ends[i + 1]], [], [], []
                for band in bands[i]:
                    slot, sums, size, member = segment_sums(values, np.zeros(len(values), np.int64), 1, int(scopes.segments[band]))
                    wide = size[member] > 2
                    with np.errstate(over="ignore"):
                        keys += [key_of(sums, slot, band), key_of(sums[member][wide] - mix(values[wide] + _SUBSET_SEED), slot[member][wide], band)]
                    tags += [(band << _BAND_BITS) + 2 * np.where(size > 2, slot + 1, 0), (band << _BAND_BITS) + 2 * (slot[member][wide] + 1) + 1]
                    wides.append(int((size > 2).sum()))
                out.append((np.concatenate(keys).view(np.int64), np.concatenate(tags), wides))
                if len(out) >= 500 or i == batch.num_rows - 1:
                    at, places = np.cumsum([0, *(len(x[0]) for x in out)]), np.arange(i + 1 - len(out), i + 1)
                    lists_of = lambda j: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([x[j] for x in out])))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(places)) for c in ("node", "component")), lists_of(0), lists_of(1), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["entry", "component", "keys", "tags", "wide"])
                    out = []

    return run


def _spare(met: DataFrame) -> DataFrame:
    """How many keys beyond D that are not hot each set has in each band: ``node``, ``band``, ``hot``, ``spare``. It shares at least so many with any set that links with it in the band."""
    hot = met.where("kind = 2").groupBy(F.col("x").alias("node"), F.col("y").alias("band")).agg(F.sum("n").alias("hot"))
    spare = met.where("kind = 3").select(F.col("x").alias("node"), F.col("y").alias("band"), F.col("n").alias("spare"))
    joined = spare.join(hot, ["node", "band"], "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    return joined.select("node", "band", "hot", (F.col("spare") - F.col("hot")).alias("spare"))


def _saturated_links(spare: DataFrame, documents: DataFrame, nodes: DataFrame, links: DataFrame, united: DataFrame, width: int, t: int, n: int) -> DataFrame:
    """Links, with the given ones, that unite saturated sets as all links between these would.

    A wide segment none of whose keys is hot here is worth two units, as it is found unless two shingles of it differ. A set whose units exceed D in
    the band finds its links by keys that are not hot. The rest are compared by their shingles (``_compared``).
    """
    saturated = spare.where("spare <= 0").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "hot", "spare"))).alias("bands"))
    saturated = keep(saturated.join(united, "node", "left").withColumn("component", F.coalesce("component", "node")), n)
    if saturated.isEmpty():
        return links
    sets = _sets(documents, nodes, saturated, width, n)
    bands = _small(saturated)
    described = sets.join(bands, "node").select("node", "component", F.transform("bands", lambda b: b["band"]).alias("bands"), "shingles")
    entries = keep(described.mapInArrow(_neighbourhoods(t), "entry bigint, component bigint, keys array<bigint>, tags array<bigint>, wide array<int>"))
    pairs, hot = opposite_pairs(entries, HOT)

    def spoiled(band: Column) -> Column:
        of_band = F.filter("tags", lambda x: (F.shiftright(x, _BAND_BITS) == band) & (F.shiftright(x, 1) % (1 << _BAND_BITS - 1) > 0))
        return F.coalesce(F.size(F.array_distinct(F.transform(of_band, lambda x: F.shiftright(x, 1)))), F.lit(0))

    units = entries.select(F.col("entry").alias("node"), "wide").join(bands, "node").join(hot.select(F.col("entry").alias("node"), "tags"), "node", "left")
    short = lambda b, wide: b["spare"] + F.greatest(wide - spoiled(b["band"]) - b["hot"], F.lit(0)) <= 0
    rest = keep(units.where(F.exists(F.zip_with("bands", "wide", short), lambda x: x)).select("node", "component"), n)
    rest = sets.join(_small(rest), "node").select(F.col("node").alias("entry"), F.size("shingles").cast("long").alias("size"), "component", F.col("shingles").alias("keys"), F.array().cast("array<bigint>").alias("tags"))
    return _compared(keep(rest), pairs.select("a", "b"), sets, links, united, t)


def _overlap_can(common: Column, r: Column, s: Column, t: int) -> Column:
    """Sets of r and s shingles with so many in common link."""
    return common * (100 + t) >= t * (r + s)


def _compared(rest: DataFrame, also: DataFrame, sets: DataFrame, links: DataFrame, united: DataFrame, t: int) -> DataFrame:
    """Links, with the given ones and those of the pairs ``also``, that unite the sets of ``rest`` (entry, size, component, keys: its shingles) as all their links would.

    Only shingles that sets of another component have too can be in common with those: the *shared part* of a set; a set with too small a one is done. Of sets with the same
    part (a passage that thousands have), each that links by it with any links with the smallest one too, and then links nothing that the smallest does not link; so these are
    tried with the smallest only, and left out. Groups of near copies are tried by stars. When these have united what they can, the sets of different
    components that are left meet by the rarest shingles of their parts, as many as must hold one of those in common, where sizes and places leave enough.
    """
    parts, stars = shared_parts(rest)
    sizes = rest.select("entry", "size", "component")
    held = parts.withColumn("shared", F.size("keys").cast("long")).join(sizes, "entry").where(100 * F.col("shared") >= t * F.col("size")).withColumn("part", F.xxhash64("keys"))
    held = keep(held, 10 * sizes.count())
    first = held.groupBy("part").agg(F.min(F.struct("size", "entry")).alias("first"), F.count("*").alias("n")).where("n > 1")
    by_part = _overlap_can(F.col("shared"), F.col("size"), F.col("first.size"), t) & (F.col("entry") != F.col("first.entry"))
    covered = keep(held.select("part", "entry", "size", "shared").join(first, "part").where(by_part).select(F.col("first.entry").alias("a"), F.col("entry").alias("b")), sizes.count())
    sized = _small(keep(sizes.select("entry", "size")))
    for side in ("a", "b"):
        stars = stars.join(sized.select(F.col("entry").alias(side), F.col("size").alias(f"size_{side}")), side)
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.col("n").desc(), "a"))
    tried = stars.where(_same_size(F.col("size_a"), F.col("size_b"), t)).withColumn("rank", rank).where(F.col("rank") <= PARTNERS)
    links = links.unionByName(keep(_linked(also.unionByName(covered).unionByName(tried.select("a", "b")).distinct(), sets, t)))
    left = held.join(_small(covered.select(F.col("b").alias("entry"))), "entry", "left_anti").drop("component")
    now = _small(keep(components(links)))
    left = left.join(now.withColumnRenamed("node", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    ranked = F.array_sort(F.arrays_zip(F.col("tags").alias("n"), F.col("keys").alias("key")))
    length = (F.col("shared") - F.ceil(F.col("size") * t / 100) + 1).cast("int")
    place = lambda x, i: F.shiftleft(F.col("size"), 32) + F.col("shared") - i
    left = left.withColumn("rare", F.slice(ranked, F.lit(1), length)).select("entry", "component", F.transform("rare", lambda x: x["key"]).alias("keys"), F.transform("rare", place).alias("tags"))
    left = left.join(sets.select(F.col("node").alias("entry"), F.col("shingles").alias("members")), "entry")
    return links.unionByName(fitting_links(keep(left), t))


def _cross_pairs(members: DataFrame, united: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a key (columns key, node) that are in different components.

    A key whose members are all in one component makes no pair. In the others, only the members outside the
    largest component are paired with the rest: a pair across components has at least one of them.
    """
    placed = members.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    of_several = placed.join(_small(keep(several)), "key")
    parts = of_several.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    of_mixed = keep(of_several.join(largest, "key"))
    p, q = of_mixed.where("component <> largest").alias("p"), of_mixed.alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component"))
    # a pair of which neither is in the largest component comes up from both sides
    on &= (F.col("q.component") == F.col("q.largest")) | (F.col("p.node") < F.col("q.node"))
    return p.join(q, on).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))


def _small(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table`` (a kept one, whose count costs no scan) for a join: broadcast if it has no more than ``most`` rows, BROADCAST_NODES if not given; else as it is."""
    return F.broadcast(table) if table.count() <= (BROADCAST_NODES if most is None else most) else table


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())


def _apart(pairs: DataFrame, united: DataFrame) -> DataFrame:
    """Pairs of different components."""
    for side in ("a", "b"):
        pairs = pairs.join(united.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))


def _same_size(a: Column, b: Column, t: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * t


def jaccard_components(df: DataFrame, width: int = WIDTH, t: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links, itself included) of every row; further ``text_hash`` (xxhash64 of the text) and ``first``: whether the row is its component's first document, by id (null last), then by text_hash. Rows without a set are the first of their own.

    A document's set holds the distinct runs of ``width`` words (lower-case A-Z; separated by ASCII white space), as 64-bit hashes; with
    fewer words, all of them as one run. Sets link when 100 * intersection >= ``t`` * union. Null and empty texts have no set and
    link with nothing. Rows with equal sets are one node whatever their number. Null ids keep a row, do not count as smallest, and get
    the component's id if another row has one. Rows that repeat an id count as one document for the component's
    id. Other columns are not read. An empty table gives no rows.
    """
    spark = small_batches(df).sparkSession
    documents = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("text_hash"))
    described = keep(documents.mapInArrow(_describe(width), "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    nodes = described.where("n_shingles > 0").groupBy("node").agg(first.alias("first"), F.first("n_shingles").alias("size"))
    n, keys = described.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0)) * 0.8).first()
    nodes = keep(nodes, n)
    n_reducers = max(partitions(spark), int(keys / REDUCER_KEYS) + 1)
    blobs = documents.select("text").mapInArrow(_emit(width, t, n_reducers), "reducer int, nodes binary, bands binary, counts binary, key_bytes binary")
    met = keep(blobs.groupBy("reducer").applyInPandas(_meet(t), "kind int, x bigint, y bigint, n bigint"))

    spare = keep(_spare(met), 3 * n)
    least = spare.groupBy("node").agg(F.min("spare").alias("least"))
    sized = _small(keep(nodes.select("node", "size").join(least, "node"), n))

    def with_sizes(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes can link, with what the two sets have to share."""
        for side in ("a", "b"):
            pairs = pairs.join(sized.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("least").alias(f"least_{side}")), side)
        return pairs.where(_same_size(F.col("size_a"), F.col("size_b"), t)).withColumn("least", F.greatest("least_a", "least_b"))

    # first the likeliest partners of each set
    near = met.where("kind in (0, 4)").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("n").alias("n"))
    likely = with_sizes(near).where("8 * n >= least or n >= 4")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.col("n").desc(), F.xxhash64("a", "b"), "a"))
    best = keep(likely.withColumn("rank", rank).where(F.col("rank") <= PARTNERS).select("a", "b"), PARTNERS * n)
    links = keep(_linked(best, _sets(documents, nodes, _ends(best), width, n), t), PARTNERS * n)
    united = _small(keep(components(links), n))

    # then every pair of sets in different components: of saturated sets, and of those that share as many keys as they have to
    links = _saturated_links(spare, documents, nodes, links, united, width, t, n)
    two = met.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "n")
    several = _cross_pairs(met.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("node")), united).withColumn("n", F.lit(1))
    enough = with_sizes(_apart(two.unionByName(several).groupBy("a", "b").agg(F.sum("n").alias("n")), united)).where("n >= least")
    more = keep(enough.select("a", "b"))
    more = _linked(more, _sets(documents, nodes, _ends(more), width, n), t)
    final = _small(keep(components(links.unionByName(more)), n))

    of_node = nodes.join(final, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = _small(keep(of_node.groupBy("component").agg(F.min("first").alias("first")), n))
    named = _small(keep(of_node.drop("first").join(smallest, "component").select("node", F.col("first").alias("named")), n))
    own = F.col("doc_id").eqNullSafe(F.col("named.doc_id")) & (F.col("text_hash") == F.col("named.text_hash"))
    some = described.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", F.col("named.doc_id").alias("component_id"), "text_hash", own.alias("first"))
    return some.unionByName(described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("first")))
