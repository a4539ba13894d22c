"""Operator 12: repair the structure of conversations by the cheapest edits, the first of them by audit.

A conversation's role initials have to read ``(s?(ua)+)?``. Its rows are kept (K, no cost), given another role (R, 2), deleted (D, 3; blank and
repeated rows have to be) and joined by inserted empty turns (I, 2); a truncated row that stays costs 1. Of the cheapest edits those count whose
letters are ASCII-least.

The search is a dynamic program over rows, with the automaton's four states as a layer. A macro edit is a run of insertions and the edit of the row
behind it; its letters end in D, K or R, so the codes are prefix-free, and audits of one layer compare by their beginnings alone. A layer therefore
holds for each state its cost and the rank of its audit among the layer's, not the audit, and a pointer to its parent; audits are read off backwards
at the end. Costs count from the layer's least and states that can't win any more leave, so that few different layers exist; each step between two is worked out once for a worker.

A conversation may hold any share of the rows. Rows are numbered in order by ranges and cut into chunks; a chunk that begins or ends inside a
conversation is summed up by the costs and ranks from each state to each; the summaries of a conversation (one for each CHUNK rows) are
composed in order, and tell each chunk the states that it begins and ends with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, small_batches

#: Rows of a chunk, at most.
CHUNK_BITS = 12
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after s, after u, after a.
E, S, U, A = range(4)
_AFTER = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_WANTED = ("u", "u", "a", "u")
#: Insertions that finish a conversation in each state.
_CLOSE = (0, 2, 1, 0)
#: A row as the program sees it: 0 has to go; others by initial and whether truncated.
_INITIALS = "sua?"


def _macros(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Code, cost and end of each macro edit of a row from a state. More than two insertions never pay."""
    found = []
    for run in range(3):
        paid = run * INSERT
        found.append(("I" * run + "D", paid + DELETE, state))
        if symbol:
            initial, cut = _INITIALS[(symbol - 1) // 2], (symbol - 1) % 2 * TRUNCATED
            if (state, initial) in _AFTER:
                found.append(("I" * run + "K", paid + cut, _AFTER[state, initial]))
            found.append(("I" * run + "R", paid + REROLE + cut, _AFTER[state, _WANTED[state]]))
        state = _AFTER[state, _WANTED[state]]
    return found


_MACROS = [[_macros(state, symbol) for symbol in range(9)] for state in range(4)]
#: Whether a path is dead: (state, other, slack) when it costs more than the other state's by more than the slack. After a all goes that goes after s; only one s that
#: is deleted instead (3) tells the beginning from after a; and an insertion leads from u to a.
_DEAD = ((E, A, DELETE), (E, U, DELETE + INSERT), (S, A, 0), (S, U, INSERT))
Layer = tuple[tuple[int, int] | None, ...]
_steps: dict[tuple[Layer, int], tuple[Layer, int, tuple]] = {}


def _ranked(best: list[tuple | None]) -> tuple[Layer, int, tuple]:
    """The layer of the best (cost, rank, code, parent) of each state, with costs from the least on, that least cost, and the parents (state, code)."""
    for state, other, slack in _DEAD:
        if best[state] and best[other] and best[state][0] > best[other][0] + slack:
            best[state] = None
    least = min(b[0] for b in best if b)
    place = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
    return tuple(b and (b[0] - least, place[b[1:3]]) for b in best), least, tuple(b and (b[3], b[2]) for b in best)


def _step(layer: Layer, symbol: int) -> tuple[Layer, int, tuple]:
    found = _steps.get((layer, symbol))
    if found is None:
        best: list[tuple | None] = [None] * 4
        for state, held in enumerate(layer):
            for code, paid, end in _MACROS[state][symbol] if held else ():
                new = (held[0] + paid, held[1], code, state)
                if best[end] is None or new < best[end]:
                    best[end] = new
        found = _steps[layer, symbol] = _ranked(best)
    return found


def _start(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def _forward(symbols: list[int], state: int) -> tuple[Layer, int, list[tuple]]:
    """The last layer of a run of rows, what to add to its costs, and the parents of all layers."""
    layer, total, parents = _start(state), 0, []
    for symbol in symbols:
        layer, least, back = _step(layer, symbol)
        total += least
        parents.append(back)
    return layer, total, parents


def _codes(parents: list[tuple], end: int) -> list[tuple[str, int]]:
    """Code of each row and the state before it, read from the end."""
    out = []
    for back in reversed(parents):
        end, code = back[end]
        out.append((code, end))
    return out[::-1]


def _closed(layer: Layer) -> tuple[int, int]:
    """The best last state, and what it costs with the insertions that finish it."""
    cost, _, state = min((held[0] + _CLOSE[s] * INSERT, held[1], s) for s, held in enumerate(layer) if held)
    return state, cost


class _Summary(NamedTuple):
    costs: list[int]
    ranks: list[int]


def _summary(symbols: list[int]) -> _Summary:
    """Cost and rank of a run of rows from each state (4) to each (4); -1 where no path is worth its cost."""
    costs, ranks = [], []
    for state in range(4):
        layer, total, _ = _forward(symbols, state)
        costs += [-1 if held is None else held[0] + total for held in layer]
        ranks += [-1 if held is None else held[1] for held in layer]
    return _Summary(costs, ranks)


def _compose(summaries: list[_Summary]) -> tuple[list[tuple[int, int]], int]:
    """Begin and end state of each run of a conversation, and the cost of it all."""
    layer, total, backs = _start(E), 0, []
    for costs, ranks in summaries:
        best: list[tuple | None] = [None] * 4
        for state, held in enumerate(layer):
            for end in range(4) if held else ():
                paid = costs[4 * state + end]
                # one run from one state to one end has one audit; its rank stands for the code
                new = (held[0] + paid, held[1], ranks[4 * state + end], state)
                if paid >= 0 and (best[end] is None or new < best[end]):
                    best[end] = new
        layer, least, back = _ranked(best)
        total += least
        backs.append(back)
    state, cost = _closed(layer)
    out = []
    end = state
    for back in reversed(backs):
        begin = back[end][0]
        out.append((begin, end))
        end = begin
    return out[::-1], total + cost


# ---- tables


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Rows with faults drawn from crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes its role user. Null roles, texts and parts of the drawn name are one space; other columns go."""
    v = F.pmod(F.crc32(F.concat(_text(F.col(conv_column)), F.lit(":"), _text(F.col(turn_column))).cast("binary")), F.lit(20))
    rows = df.select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"), _text(F.col(role_column)).alias("role"), _text(F.col(text_column)).alias("text"), v.alias("_v")).where("_v <> 0")
    text = F.when(F.col("_v") == 1, "").when(F.col("_v") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_v") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_v") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("at")


def _runs(names: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield at, i
            at = i


_OPEN = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])


def _summed(table: pa.Table) -> pa.Table:
    """The summaries of a chunk's first and last conversation, which may go on in other chunks."""
    table = _sorted(table)
    convs, symbols, chunk = table["conv"].to_pylist(), table["symbol"].to_pylist(), table["chunk"][0].as_py()
    runs = list(_runs(convs))
    rows = [(convs[a], chunk, *_summary(symbols[a:b])) for a, b in dict.fromkeys((runs[0], runs[-1]))]
    return pa.Table.from_pylist([dict(zip(_OPEN.names, r, strict=True)) for r in rows], _OPEN)


_SOLVED = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])


def _solved(table: pa.Table) -> pa.Table:
    """Begin and end states of the chunks of one conversation; its cost with the last."""
    table = table.sort_by("chunk")
    states, cost = _compose([_Summary(*s) for s in zip(table["costs"].to_pylist(), table["ranks"].to_pylist(), strict=True)])
    n = table.num_rows
    columns = [table["conv"], table["chunk"], [b for b, _ in states], [e for _, e in states], [i == n - 1 for i in range(n)], [cost if i == n - 1 else 0 for i in range(n)]]
    return pa.table(columns, schema=_SOLVED)


def _edited(rows: pa.Table, solved: pa.Table) -> pa.Table:
    """Each row of a chunk with its code, the roles inserted before and after it, its new role (null: deleted), and its conversation's cost (at its last row)."""
    rows = _sorted(rows)
    known = {r["conv"]: r for r in solved.to_pylist()}
    convs, symbols = rows["conv"].to_pylist(), rows["symbol"].to_pylist()
    codes, before, after, role, costs = [], [], [], [], []
    for a, b in _runs(convs):
        states = known.get(convs[a])
        if states is None:  # a conversation within the chunk
            layer, total, parents = _forward(symbols[a:b], E)
            end, cost = _closed(layer)
            last, cost = True, cost + total
        else:
            _, _, parents = _forward(symbols[a:b], states["begin"])
            end, last, cost = states["end"], states["last"], states["cost"]
        for code, state in _codes(parents, end):
            inserted = []
            for _ in range(len(code) - 1):
                inserted.append(ROLES[_WANTED[state]])
                state = _AFTER[state, _WANTED[state]]
            codes.append(code)
            before.append(inserted)
            after.append([])
            role.append(None if code[-1] == "D" else "" if code[-1] == "K" else ROLES[_WANTED[state]])
            costs.append(0)
        costs[-1] = cost
        for _ in range(_CLOSE[end] if last else 0):
            codes[-1] += "I"
            after[-1].append(ROLES[_WANTED[end]])
            end = _AFTER[end, _WANTED[end]]
    new = {"code": pa.array(codes, pa.string()), "before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string())), "edit": pa.array(role, pa.string()), "cost": pa.array(costs, pa.int64())}
    for name, column in new.items():
        rows = rows.append_column(name, column)
    return rows.drop_columns(["symbol"])


class Repaired(NamedTuple):
    turns: DataFrame
    reports: DataFrame


def repair(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> Repaired:
    """``turns``: the rows of the repaired conversations (``conv_id``, ``at``, ``part``: their order; ``role``, ``text``); ``reports``: for each conversation ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Rows stand by turn, nulls first; rows of one turn by role and then a digest of the text, copies next to each other. Null roles and texts are one
    space, rows without conversation are one conversation, an empty table gives empty tables; clashing columns are not looked at. Of a row's faults the first
    counts: blank, equal to an earlier row in role and text (compared by MD5, 128 bits), truncated. The texts themselves are dealt only once, to meet their edits.
    """
    spark = df.sparkSession
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_column).cast("string")), F.lit(""))
    rows = df.select(F.col(conv_column).alias("conv_id"), conv.alias("conv"), F.col(turn_column).alias("turn"), _text(F.col(role_column)).alias("role"), _text(F.col(text_column)).alias("text")).withColumn("digest", F.md5("text"))
    trailing = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    slim = rows.select("conv_id", "conv", "turn", "role", "digest", (trailing == "").alias("blank"), (~trailing.isin(".", "!", "?")).alias("cut"))
    dealt = slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    slim = keep(dealt.withColumn("at", F.monotonically_increasing_id()))

    firsts = slim.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), 0).otherwise(1 + 2 * kind + (F.col("fault").eqNullSafe("truncated")).cast("int"))
    seen = slim.join(firsts, "at", "left").withColumn("fault", fault).withColumn("initial", initial).withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    faults = keep(seen.select("conv_id", "conv", "turn", "role", "digest", "at", "chunk", "fault", "initial", symbol.alias("symbol")))

    program = faults.select("chunk", "conv", "at", "symbol")
    summaries = program.groupBy("chunk").applyInArrow(_summed, "conv string, chunk bigint, costs array<bigint>, ranks array<bigint>")
    solved = summaries.groupBy("conv").applyInArrow(_solved, "conv string, chunk bigint, begin int, end int, last boolean, cost bigint")
    fields = "chunk bigint, conv string, at bigint, code string, before array<string>, after array<string>, edit string, cost bigint"
    edits = keep(program.groupBy("chunk").cogroup(solved.groupBy("chunk")).applyInArrow(_edited, fields))

    # a row that stays is the first of its role and text, so these tell it from all others
    staying = faults.select("at", "conv_id", "conv", "turn", "role", "digest").join(edits.where("edit is not null").select("at", "edit"), "at")
    same = F.col("t.turn").eqNullSafe(F.col("e.turn"))
    for name in ("conv", "role", "digest"):
        same &= F.col(f"t.{name}") == F.col(f"e.{name}")
    kept = rows.alias("t").join(staying.alias("e"), same).select("e.conv_id", "e.conv", "e.at", F.lit(2).alias("part"), F.when(F.col("edit") == "", F.col("e.role")).otherwise(F.col("edit")).alias("role"), "t.text")
    kept = kept.dropDuplicates(["at"])
    lists = F.concat(F.transform("before", lambda r, i: F.struct(i.alias("part"), r.alias("role"))), F.transform("after", lambda r, i: F.struct((i + 3).alias("part"), r.alias("role"))))
    named = edits.where("size(before) + size(after) > 0").join(faults.select("at", "conv_id"), "at")
    inserted = named.select("conv_id", "conv", "at", F.explode(lists).alias("i")).select("conv_id", "conv", "at", "i.part", "i.role", F.lit("").alias("text"))

    # neighbours in a chunk by a window; those of two chunks by the ends of the conversation's runs
    run = Window.partitionBy("chunk", "conv").orderBy("at")
    bad = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    pairs = faults.select("chunk", "conv", "at", "initial", F.coalesce(bad(F.lag("initial").over(run), F.col("initial")), F.lit(0)).alias("bad"))
    joined = pairs.join(edits.select("at", "code", "cost"), "at")
    pieces = joined.groupBy("conv", "chunk").agg(
        F.sum("bad").alias("bad"), F.min_by("initial", "at").alias("first"), F.max_by("initial", "at").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("audit"), F.sum("cost").alias("cost"),
    )
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "audit", "first", "last"))).alias("p"), F.sum("bad").alias("bad"), F.sum("cost").alias("cost"))
    seams = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda x, y: bad(x["last"], y["first"]))
    audits = whole.select("conv", (F.col("bad") + F.aggregate(seams, F.lit(0).cast("long"), lambda s, x: s + x)).alias("illegal"), "cost", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    counted = faults.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
    )
    reports = counted.join(audits, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repaired(kept.unionByName(inserted).drop("conv"), reports)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of the repaired rows as ``role:text``, joined by newlines. A digest is worked out in order, so a conversation is one task's; its rows pass by in sorted batches and are never held together."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, None, False
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
            ids, hashes = [], []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not started or conv != current:
                    if started:
                        ids.append(current)
                        hashes.append(state.hexdigest())
                    current, state, started = conv, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(f"{role}:".encode())
                state.update(text.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(hashes, pa.string())], schema=schema)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([current], schema.field(0).type), pa.array([state.hexdigest()], pa.string())], schema=schema)

    dealt = small_batches(turns).select("conv_id", "at", "part", "role", "text").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", "part")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_reports(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The report and the digest of the repaired rows for every conversation of ``original``, of which ``rows`` (conv_id, turn, role, text) are left; one without rows has zeros, an empty audit and the digest of nothing."""
    repaired = repair(rows)
    nothing = hashlib.sha256().hexdigest()
    out = original.select("conv_id").distinct().alias("o").join(repaired.reports.alias("r"), F.expr("o.conv_id <=> r.conv_id"), "left").join(digests(repaired.turns).alias("d"), F.expr("o.conv_id <=> d.conv_id"), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
