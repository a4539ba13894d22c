"""Operator 1: order MinHash fingerprints, in DataFrame functions only.

A text is read as short tokens: up to four lower-case letters, with the character that ends them. Every run of K tokens is
a k-mer, and repeated k-mers are told apart by an occurrence number. The numbered k-mers are hashed onto a ring.
Component b of the M components takes the L k-mers that follow the point b/M of the ring, puts them back into the
order in which the text has them, and hashes that tuple. Equal components need the same k-mers in the same order, so the
share of equal components follows edit distance, not only the common k-mers. One pass gives all components, and texts
of any length give M of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, with_rank

#: Tokens in a k-mer, components of a fingerprint, and k-mers in a component.
K, M, L = 4, 64, 2
#: A sort key holds a hash in its upper bits and a position in these lower ones.
_POSITION_BITS = 30
_POSITION = (1 << _POSITION_BITS) - 1
_TOKEN = "[a-z]{4}|[a-z]{0,3}[^a-z]|[a-z]{1,3}"


def _packed(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(position.cast("long"))


def _descend(steps: Column, moves) -> Column:
    """The largest sum of steps (powers of two, falling) for which ``moves(sum)`` holds; it must hold for all smaller ones."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(moves(at + step), at + step).otherwise(at))


def _with_kmers(df: DataFrame, text: str, name: str) -> DataFrame:
    kmers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?=((?:{_TOKEN}){{1,{K}}}))(?:{_TOKEN})"), F.lit(1))
    return df.withColumn(f"{name}_kmers", kmers)


def _with_sorted(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(f"{name}_sorted", F.sort_array(F.transform(f"{name}_kmers", lambda x, i: _packed(F.xxhash64(x), i))))


def _with_ring(df: DataFrame, name: str) -> DataFrame:
    """The numbered k-mers' hashes with their positions, in order. Equal k-mers stand side by side, so a number is the distance to the first of them."""
    at = F.col(f"{name}_sorted")
    powers = F.filter(F.array(*(F.lit(1 << b) for b in reversed(range(_POSITION_BITS)))), lambda s: s < F.size(at))

    def numbered(x: Column, i: Column) -> Column:
        same = lambda back: F.shiftright(F.get(at, i - back), _POSITION_BITS) == F.shiftright(x, _POSITION_BITS)
        number = F.when(same(F.lit(1)), _descend(F.col(f"{name}_steps"), same)).otherwise(0)
        return _packed(F.xxhash64(F.shiftright(x, _POSITION_BITS), number), x.bitwiseAND(F.lit(_POSITION)))

    return df.withColumn(f"{name}_steps", powers).withColumn(f"{name}_ring", F.sort_array(F.transform(at, numbered)))


def _components(name: str) -> Column:
    ring, kmers, steps = F.col(f"{name}_ring"), F.col(f"{name}_kmers"), F.col(f"{name}_steps")
    n = F.size(ring)
    points = F.array(*(F.lit(-(1 << 63) + b * ((1 << 64) // M)) for b in range(M)))

    def component(point: Column) -> Column:
        first = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ring, at + step - 1) < point, at + step).otherwise(at))
        # the sum of all steps may fall one short of the end
        first = F.transform(F.array(first), lambda at: F.when(F.get(ring, at) < point, at + 1).otherwise(at))
        places = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.get(ring, (F.get(first, F.lit(0)) + j) % n).bitwiseAND(F.lit(_POSITION)).cast("int"))
        return F.shiftright(F.xxhash64(F.transform(F.array_sort(places), lambda p: F.get(kmers, p))), 32).cast("int")

    return F.when(n > 0, F.transform(points, component)).otherwise(F.array_repeat(F.lit(0), M))


def fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint (array of M ints) for each text column: ``texts`` maps names of new columns to text columns.

    Null counts as empty, whose components are all 0. No shuffle.
    """
    names = {name: f"_{i}" for i, name in enumerate(texts)}
    for name, text in texts.items():
        df = _with_kmers(df, text, names[name])
    df = df.drop(*texts.values())
    for step in (_with_sorted, _with_ring):
        for short in names.values():
            df = step(df, short)
    used = [c for short in names.values() for c in (f"{short}_kmers", f"{short}_sorted", f"{short}_steps", f"{short}_ring")]
    return df.withColumns({name: _components(short) for name, short in names.items()}).drop(*used)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(M))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def successors(df: DataFrame) -> DataFrame:
    """``key`` and ``next_key`` of each distinct id, in descending order, null last; after the last comes the first. ``need``: a third of its text's characters."""
    ids = df.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).alias("need"), F.count("*").alias("n"))
    placed = with_rank(ids, [F.col("key.id").desc_nulls_last()], "place")
    after = placed.select(F.col("place").alias("_place"), F.col("key").alias("next_key"))
    return keep(placed.join(after, (F.col("place") + 1) % F.col("place_rows") == F.col("_place")).select("key", "next_key", "need", "n"))


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last third (floor of the characters / 3) replaced by as many first characters of the next document in
    descending order of ids, or all that it has; the last document takes from the first. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts count as empty. Null ids come last and count as one
    document. Rows keep their number; where rows repeat an id, the next document is that of the next different id, and of rows with
    that id the smallest beginning and the smallest fingerprint count. A single document is its own next. Other columns are not read.

    Texts are shuffled once, by id; only the characters that are needed travel to the document before.
    """
    documents = df.select(F.struct(F.col(id_column).alias("id")).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    after = successors(documents)
    repeated = (after.agg(F.max("n")).first()[0] or 0) > 1
    lent = documents.join(after.select(F.col("key").alias("to"), F.col("next_key").alias("key"), "need"), "key").select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("need").cast("int")).alias("head"))
    if repeated:
        lent = lent.groupBy("key").agg(F.min("head").alias("head"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = documents.join(lent, "key").select("key", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - third), F.substring("head", F.lit(1), third)).alias("edited"))
    edited = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    done = keep(fingerprints(edited, {"own": "text", "other": "edited"}))
    of_next = done.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"))
    if repeated:
        of_next = of_next.groupBy("next_key").agg(F.min("next_own").alias("next_own"))
    joined = done.join(after.select("key", "next_key"), "key").join(of_next, "next_key")
    return joined.select(
        F.col("key.id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
