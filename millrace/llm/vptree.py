"""Operator 5: nearest neighbours by inner product, with a vantage-point tree for each shard.

Inner products are turned into distances: with M the largest norm of a shard, x becomes (x, sqrt(M^2 - |x|^2)) and a query
(q, 0), so that the nearest x has the largest product. A tree node splits its vectors at the median distance to a
vantage point. A query that is d away from it visits the far side of radius r only if |d - r| * factor is
at most the distance of its k-th nearest so far. By the triangle inequality factor 1 loses nothing; larger factors
skip more.

Shards are balls around pivots, in the same space with one M for all. A query searches the ball of its nearest pivot first; the distance of its k-th nearest there then rules out, by the same inequality and factor,
every ball that it does not reach. A ball of more than SHARD_ROWS vectors is several shards.
"""

from __future__ import annotations

import math

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, small_batches

#: Vectors of a shard and queries of a block, at most about; they bound a task's memory.
SHARD_ROWS, BLOCK_ROWS = 20_000, 8_192
#: Pivots at most, of all vectors of a length; a bounded sample of these. Vectors for each pivot, at least about.
PIVOTS, PIVOT_ROWS = 1_024, 1_000
#: Vectors that are compared one by one at the end of a branch.
LEAF = 128
#: Places kept beyond k while searching, as products are rounded there; the end result is computed anew.
_MORE = 8
#: Room for rounding in squared distances, as a share of the squared reach of a query.
_ROUNDING = 1e-12


class Tree:
    """A vantage-point tree over distinct vectors; many queries descend together."""

    def __init__(self, vectors: np.ndarray) -> None:
        norms = np.sqrt((vectors * vectors).sum(1))
        self.most = norms.max(initial=0.0)
        self.vectors = np.c_[vectors, np.sqrt(np.maximum(self.most**2 - norms**2, 0))]
        self.order = np.arange(len(vectors))
        self.root = self._build(0, len(vectors), np.random.default_rng(len(vectors)))

    def _build(self, a: int, b: int, draw: np.random.Generator) -> tuple:
        if b - a > LEAF:
            rows = self.order[a:b]
            point = self.vectors[rows[draw.integers(b - a)]]
            d = np.sqrt(np.maximum(((self.vectors[rows] - point) ** 2).sum(1), 0))
            radius = float(np.median(d))
            inside = d <= radius
            n = int(inside.sum())
            if n < b - a:
                self.order[a:b] = np.r_[rows[inside], rows[~inside]]
                return point, radius, self._build(a, a + n, draw), self._build(a + n, b, draw)
        return (a, b)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Products and vectors of the k best found for each query, of equal products the first vectors; -inf and -1 where there are fewer."""
        self.queries = np.c_[queries, np.zeros(len(queries))]
        self.reach = (queries * queries).sum(1) + self.most**2
        self.score, self.found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        self.factor = factor
        self._visit(self.root, np.arange(len(queries)))
        return self.score, self.found

    def _visit(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 2:
            rows = self.order[node[0] : node[1]]
            products = self.queries[active] @ self.vectors[rows].T
            score = np.c_[self.score[active], products]
            found = np.c_[self.found[active], np.broadcast_to(rows, products.shape)]
            best = np.lexsort((found, -score), axis=1)[:, : self.score.shape[1]]  # of equal products the first vectors stay
            self.score[active], self.found[active] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
            return
        point, radius, inner, outer = node
        d = np.sqrt(np.maximum(((self.queries[active] - point) ** 2).sum(1), 0))
        inside = d <= radius
        for here, near, far in ((inside, inner, outer), (~inside, outer, inner)):
            self._visit(near, active[here])
            worst = self.score[active].min(1)
            # a vector as near as the worst may lie on the far side of an equal bound; square roots of rounded differences need the more room
            tau = np.sqrt(np.maximum(self.reach[active] - 2 * worst, 0) + _ROUNDING * self.reach[active])
            self._visit(far, active[here & (np.abs(d - radius) * self.factor <= tau)])


def _search(k: int, factor: float):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids)
        vectors, first, of = np.unique(np.stack(candidates["embedding"].to_numpy())[order].astype(np.float64), axis=0, return_index=True, return_inverse=True)
        # vectors in the order of their smallest ids, by which the tree breaks ties
        by_id = np.argsort(first)
        vectors, of = vectors[by_id], np.argsort(by_id)[of.reshape(-1)]
        # of equal vectors only the k+1 smallest ids can be among k nearest
        by_vector = np.argsort(of, kind="stable")
        ids, starts = ids[order][by_vector], np.searchsorted(of[by_vector], np.arange(len(vectors) + 1))
        q_ids, q = queries["vec_id"].to_numpy(), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        _, found = Tree(vectors).search(q, k + 1 + _MORE, factor)
        out = []
        for i, query in enumerate(q_ids):
            rows = found[i][found[i] >= 0]
            score = (vectors[rows] * q[i]).sum(1)
            equal = [ids[starts[r] : min(starts[r + 1], starts[r] + k + 1)] for r in rows]
            vec, score = np.concatenate(equal), np.repeat(score, [len(x) for x in equal])
            vec, score = vec[vec != query], score[vec != query]
            best = np.lexsort((vec, -score))[:k]
            out.append((np.full(len(best), query), vec[best], score[best]))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Pivots(NamedTuple):
    """The pivots of the vectors of one length, in the space of their largest norm (squared: most)."""

    points: np.ndarray
    most: float

    def distances(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        own = (vectors * vectors).sum(1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.most - own, 0))
        products = vectors @ self.points[:, :-1].T + last[:, None] * self.points[:, -1]
        return np.sqrt(np.maximum((own if query else np.full(len(vectors), self.most))[:, None] + self.most - 2 * products, 0))


def _pivots(rows: DataFrame, spark) -> dict[int, Pivots]:
    """Pivots for lengths of more than PIVOT_ROWS vectors: those with the smallest hashed ids, as many as PIVOTS allows. Other lengths are one ball each."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("length").agg(F.count("*").alias("n"), F.max(norm).alias("most")).where(F.col("n") > PIVOT_ROWS).orderBy(F.col("n").desc(), "length").limit(PIVOTS).collect()
    whole = sum(r.n for r in sizes)
    out = {}
    for r in sizes:
        wanted = max(math.ceil(r.n / SHARD_ROWS), min(partitions(spark), math.ceil(r.n / PIVOT_ROWS)))
        some = rows.where(F.col("length") == r.length).orderBy(F.xxhash64(F.lit(2), "vec_id")).limit(max(1, min(wanted, PIVOTS * r.n // whole))).select("embedding").collect()
        points = np.unique(np.array([x.embedding for x in some], np.float64), axis=0)
        out[r.length] = Pivots(np.c_[points, np.sqrt(np.maximum(r.most - (points * points).sum(1), 0))], r.most)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            yield int(length), batch.filter(pa.array(lengths == length))


def _dealt(pivots: dict[int, Pivots], query: bool):
    """Rows with their nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in _by_length(batches):
            pivot, distance = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
            if length in pivots:
                d = pivots[length].distances(_vectors(part.column("embedding")), query)
                pivot = d.argmin(1).astype(np.int32)
                distance = d[np.arange(len(d)), pivot]
            yield part.append_column("pivot", pa.array(pivot)).append_column("distance", pa.array(distance))

    return run


def _reached(pivots: dict[int, Pivots], radii: dict[int, np.ndarray], factor: float):
    """Queries with each ball, besides their own, that may hold a vector nearer than the worst they have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in _by_length(batches):
            if length not in pivots:
                continue
            q, home = _vectors(part.column("embedding")), part.column("pivot").to_numpy()
            d = pivots[length].distances(q, True)
            reach = (q * q).sum(1) + pivots[length].most
            worst = part.column("worst").to_numpy(zero_copy_only=False)
            tau = np.sqrt(np.maximum(reach - 2 * worst, 0) + _ROUNDING * reach)
            near = ((d - radii[length]) * factor <= tau[:, None]) & (np.arange(d.shape[1]) != home[:, None])
            row, pivot = np.nonzero(near)
            chosen = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([chosen.column("vec_id"), chosen.column("embedding"), chosen.column("length"), pa.array(pivot, pa.int32())], ["vec_id", "embedding", "length", "pivot"])

    return run


def _visited(candidates: DataFrame, visits: DataFrame, balls: DataFrame, k: int, factor: float) -> DataFrame:
    """The best of each ball for each query that visits it. A ball's shards meet its queries in blocks, so a task holds one shard and one block."""
    ball = ["length", "pivot"]
    met = keep(visits.groupBy(*ball).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(balls.select(*ball, F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards")), ball))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = candidates.join(met, ball).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).withColumn("block", every("blocks"))
    asked = visits.join(met, ball).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int")).withColumn("shard", every("shards"))
    keys = [*ball, "shard", "block"]
    columns = [*keys, "vec_id", "embedding"]
    return mine.select(*columns).groupBy(*keys).cogroup(asked.select(*columns).groupBy(*keys)).applyInPandas(_search(k, factor), "query_id bigint, vec_id bigint, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each query row its ``k`` best found rows by inner product in double precision.

    ``is_query`` is a condition on ``vec_id``. A query does not find its own id; ties go to the smaller id; with fewer candidates all
    are returned. Rows with a null id, and vectors that are null, zero, or hold null or non-finite components, take no part; vectors are compared with
    those of the same length only. Of rows that repeat an id the one with the smallest vector counts. Other columns are not read.

    Rows are dealt to the nearest of at most PIVOTS pivots, and a query visits the balls that it can't rule out after its own (see above). Each visit sends k rows for each shard to the final ranking.
    The driver sees the pivots and their radii only.
    """
    spark = df.sparkSession
    rows = small_batches(df).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = keep(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("length", F.size("embedding")))
    pivots = _pivots(rows, spark)
    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = f"vec_id bigint, embedding {kind}, length int, pivot int, distance double"
    candidates = keep(rows.mapInArrow(_dealt(pivots, False), dealt))
    balls = keep(candidates.groupBy("length", "pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")))
    radii = {length: np.full(len(p.points), -np.inf) for length, p in pivots.items()}
    for r in balls.where(F.col("length").isin(list(pivots))).collect() if pivots else []:
        # distances are rounded sums; the room is that of the squared distances in the trees
        radii[r.length][r.pivot] = math.sqrt(r.radius**2 + 4 * _ROUNDING * pivots[r.length].most)
    queries = keep(rows.where(is_query).mapInArrow(_dealt(pivots, True), dealt))
    own = keep(_visited(candidates, queries, balls, k, factor))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    worst = own.withColumn("_n", best).where(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    asked = queries.join(worst, "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    visits = keep(asked.mapInArrow(_reached(pivots, radii, factor), f"vec_id bigint, embedding {kind}, length int, pivot int"))
    found = own.unionByName(_visited(candidates, visits, balls, k, factor))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
