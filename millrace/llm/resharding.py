"""Operator 13: reshard a corpus, moving as few bytes as the new capacities allow.

A layout is a table of files: each belongs to a shard, and its rows are that shard's from ``start`` on. Resharding takes the old shards' sizes and the
new capacities as a transport problem: what a shard holds may stay for nothing, each byte that goes to another shard costs one (or what the caller says). The
minimum-cost flow says how many bytes every old shard gives to every new one. A shard's rows stand by size, the largest first; the flow cuts that order into runs, of
which the first stays, so that cuts fall between small rows. Files that only hold rows that stay are left alone; the others are read, and their rows written to
files of their new shards. Only those rows are shuffled.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructType

from .common import keep, partitions, shared_dir, small_batches

#: Bytes of a file, about.
BLOCK_BYTES = 128 << 20
#: The end of a shard's last run: whatever rows of no bytes stand behind its bytes.
_END = 1 << 62


def least_moves(sizes: list[int], capacities: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Bytes that each old shard gives to each new one, at least cost; both sides have the same sum. Without ``cost`` a byte that changes its number costs one.

    Successive shortest paths, each found by Bellman and Ford's rule over a queue. The graph has a node for each shard, whatever the number of rows.
    """
    n, m = len(sizes), len(capacities)
    cost = cost or [[int(i != j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, free = list(sizes), list(capacities)
    while any(left):
        distance: list[float] = [0 if v < n and left[v] else float("inf") for v in range(n + m)]
        before: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            v = queue.popleft()
            forth = [(n + j, cost[v][j]) for j in range(m)] if v < n else [(i, -cost[i][v - n]) for i in range(n) if flow[i][v - n]]
            for w, paid in forth:
                if distance[v] + paid < distance[w]:
                    distance[w], before[w] = distance[v] + paid, v
                    queue.append(w)
        path = [n + min((j for j in range(m) if free[j]), key=lambda j: distance[n + j])]
        while (v := before[path[-1]]) is not None:
            path.append(v)
        first, last = path[-1], path[0] - n
        steps = list(zip(path[1:], path))
        amount = min(left[first], free[last], *(flow[w][v - n] for v, w in steps if v >= n))
        for v, w in steps:
            if v < n:
                flow[v][w - n] += amount
            else:
                flow[w][v - n] -= amount
        left[first] -= amount
        free[last] -= amount
    return flow


def runs_of(sizes: list[int], largest: list[list[int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (old shard, from, to, new shard) of the old shards' bytes by size of rows, the largest first. ``largest``: sizes of the first rows of each, ``shards`` of them at most.

    A row larger than an even share of what is left gets a shard to itself, its own if that is free; the rest is spread evenly over the others.
    """
    rest, open_ = sum(sizes), list(range(shards))
    alone: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for size, i in sorted(((size, i) for i, some in enumerate(largest) for size in some), key=lambda x: (-x[0], x[1])):
        if len(open_) < 2 or size * len(open_) <= rest:
            break
        target = i if i in open_ else open_[-1]
        open_.remove(target)
        alone[i].append((size, target))
        rest -= size
    even = {s: rest // len(open_) + (place < rest % len(open_)) for place, s in enumerate(open_)}
    given = least_moves([size - sum(x for x, _ in alone[i]) for i, size in enumerate(sizes)], [even.get(s, 0) for s in range(shards)])
    out = []
    for i, row in enumerate(given):
        at = 0
        for size, j in [*alone[i], *((row[j], j) for j in sorted(range(shards), key=lambda j: (j != i, j)) if row[j])] or [(0, i % shards)]:
            out.append((i, at, at + size, j))
            at += size
        out[-1] = (*out[-1][:2], _END, out[-1][3])
    return out


class Layout:
    """A sharded table. ``files``: path, shard, start (slot of its first row), rows, bytes; ``row``: the type of its rows."""

    def __init__(self, files: DataFrame, row: DataType) -> None:
        self.files, self.row = files, row

    def read(self, files: DataFrame | None = None) -> DataFrame:
        """``row`` and ``size`` of all rows, with ``slot`` and the columns of ``files`` (all of the layout's, or these). As with every reader of files, the driver lists them by name."""
        files = self.files if files is None else files
        spark, schema = files.sparkSession, StructType().add("row", self.row).add("size", LongType())
        names = [r.path for r in files.select("path").toLocalIterator()]
        if not names:
            return files.crossJoin(spark.createDataFrame([], schema)).withColumn("slot", F.col("start"))
        rows = spark.read.schema(schema).parquet(*names).select("row", "size", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("_place"))
        return rows.join(files, "path").withColumn("slot", F.col("start") + F.col("_place")).drop("_place")


def _written(rows: DataFrame, whole: int) -> DataFrame:
    """The files (path, shard, seq, rows, bytes) that rows (row, size, shard) are written to, by shard and by size, the largest first; about BLOCK_BYTES of the ``whole`` to a file."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    # rows of one shard and size are dealt by a hash, so that no value of the order is a group of its own
    order = [F.col("shard"), F.col("size").desc(), F.xxhash64("row")]
    n = max(partitions(spark), -(-whole // BLOCK_BYTES))
    rows.select("row", "size", F.col("shard").cast("int").alias("shard")).repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(folder)
    read = spark.read.schema(StructType().add("row", rows.schema["row"].dataType).add("size", LongType()).add("shard", IntegerType())).parquet(folder)
    files = read.groupBy(F.col("_metadata.file_path").alias("path"), "shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return files.withColumn("seq", F.regexp_extract("path", r".*part-(\d+)-", 1).cast("long"))


def _numbered(files: DataFrame, *order: str) -> DataFrame:
    """``files`` with ``start``: the rows of its shard's files before it. One row for each file takes part."""
    ahead = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return keep(files.withColumn("start", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).select("path", "shard", "start", "rows", "bytes"))


def write_shards(df: DataFrame, shard: Column, size: Column) -> Layout:
    """The layout of ``df`` in the given shards (int, from 0), each cut into files. All columns are kept, in ``row``, whatever their names, nulls and repeated rows too; an empty table has no files."""
    rows = small_batches(df).select(F.struct(*df.columns).alias("row"), size.cast("long").alias("size"), shard.cast("int").alias("shard"))
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return Layout(_numbered(_written(rows, whole), "seq"), rows.schema["row"].dataType)


def reshard(layout: Layout, shards: int) -> Layout:
    """The layout in ``shards`` of nearly equal bytes that moves the fewest bytes.

    Each cut of a shard's order may be off by half a row, and cuts fall between small rows where there are any; a row larger than an even share has
    a shard to itself. Files that nothing leaves stay, with new slots. The driver sees each shard's sum and its ``shards`` largest rows.
    """
    spark = layout.files.sparkSession
    sums = {r.shard: r.bytes for r in layout.files.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    olds = max(sums, default=-1) + 1
    largest: list[list[int]] = [[] for _ in range(olds)]
    for r in layout.read(layout.files.where(F.col("start") < shards)).where(F.col("slot") < shards).select("shard", "size").collect():
        largest[r.shard].append(r["size"])
    runs = spark.createDataFrame(runs_of([sums.get(s, 0) for s in range(olds)], largest, shards), "old int, low bigint, high bigint, new int")

    # a table of pairs of shards, which says for each where its bytes go
    into = lambda rows, low, high: rows.join(F.broadcast(runs), (F.col("shard") == F.col("old")) & (F.col("low") <= low) & (high <= F.col("high")), "left").drop("old", "low", "high")
    ahead = Window.partitionBy("shard").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    files = layout.files.withColumn("offset", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
    files = keep(into(files, F.col("offset"), F.col("offset") + F.col("bytes")))
    whole = files.where("new is not null").select("path", "new", F.col("start").alias("from"), (F.col("start") + F.col("rows") - 1).alias("to"))
    before = F.sum("size").over(Window.partitionBy("path").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    crossed = layout.read(files.where("new is null").drop("new", "rows", "bytes")).select("path", "shard", "slot", "size", "offset")
    crossed = crossed.withColumn("middle", F.col("offset") + F.coalesce(before, F.lit(0)) + F.expr("size div 2"))
    parts = into(crossed, F.col("middle"), F.col("middle") + 1).groupBy("path", "new").agg(F.min("slot").alias("from"), F.max("slot").alias("to"))
    spans = keep(whole.unionByName(parts))

    leaving = keep(files.select("path", "shard").join(spans, "path").where("new <> shard").select("path").distinct())
    moved = layout.read(files.join(leaving, "path", "left_semi").select("path", "start")).join(spans, "path").where("slot between from and to")
    amount = files.join(leaving, "path", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    new = _written(moved.select("row", "size", F.col("new").alias("shard")), amount).withColumn("turn", F.lit(1))
    kept = files.join(leaving, "path", "left_anti").select("path", "shard", "rows", "bytes", F.col("start").alias("seq"), F.lit(0).alias("turn"))
    return Layout(_numbered(kept.unionByName(new.select(*kept.columns)), "turn", "seq"), layout.row)


def reshard_by_bytes(df: DataFrame, old: Column, shards: int, text_column: str = "text") -> Layout:
    """``df`` laid out in its old shards, then resharded to ``shards`` of nearly equal bytes of text (and one for each row). A null text has no bytes."""
    size = F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)).cast("long") + 1
    return reshard(write_shards(df, old, size), shards)
