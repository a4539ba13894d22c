"""Operators 11, 12 and 13: brute force over all pairs, all edits and all flows, hot groups, and edges."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from millrace.llm import conversations, registry, resharding, spellings

DATA = "/root/testdata/sf0.001"


# ---- 11


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows, every=97):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_groups(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = defaultdict(list)
    for n, group in by_length.items():
        holes = defaultdict(list)
        for w in group:
            for i in range(n):
                holes[i, w[:i] + w[i + 1 :]].append(w)
        for w in group:
            near[w] += {v for i in range(n) for v in holes[i, w[:i] + w[i + 1 :]] if v != w}
        shorter = set(by_length.get(n - 1, ()))
        for w in group:
            for v in {w[:i] + w[i + 1 :] for i in range(n)} & shorter:
                near[w].append(v)
                near[v].append(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def grouped(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spellings_of_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    expected = plain_groups(plain_words(rows))
    assert any(v[0] for v in expected.values())
    assert grouped(registry.op11_spelling_variants(spark, DATA)) == expected


def test_hot_segments_are_halved_again(spark, monkeypatch):
    monkeypatch.setattr(spellings, "HOT", 5)
    monkeypatch.setattr(spellings, "SHARD_WORDS", 40)
    draw = random.Random(3)
    words = {}
    for i in range(400):
        middle = "".join(draw.choice("abç") for _ in range(draw.randrange(1, 6)))
        words[draw.choice(["inter", "unterr", "x"]) + middle + draw.choice(["ingly", "ation", "ç" * 4])] = i % 17 + 3
    words |= {"a" * n: n for n in range(5, 40)} | {"b" * 3000: 7, "b" * 2999: 20}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert grouped(spellings.spelling_groups(df)) == plain_groups(words)
    pairs = [tuple(r) for r in spellings.near_pairs(df).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs)) and all(one_apart(a, b) for a, b in pairs)


def test_spellings_edges(spark):
    rows = [(1, "Colour colour COLOUR color"), (1, "colour"), (None, "colour color color"), (2, None), (3, ""), (4, "Ünder ünder Ünder ÷×÷×÷ ab1cd " + "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, word string")
    got = grouped(spellings.spelling_variants(df, every=10**12))
    assert got == {"colour": (None, "colour", 5, 1, None), "color": (None, "color", 3, 1, None)}
    assert spellings.spelling_variants(df.limit(0)).collect() == []


def test_pieces_keep_runs(monkeypatch):
    monkeypatch.setattr(spellings, "PIECE_CHARS", 4)
    text = "abcdefgh ij, klmnop"
    assert "".join(spellings._pieces(text)) == text
    assert [w for p in spellings._pieces(text) for w in spellings.RUN.findall(p)] == ["abcdefgh", "ij", "klmnop"]


# ---- 12


def damaged(rows):
    out = []
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        v = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if v == 0:
            continue
        text = "" if v == 1 else re.sub("[.!?]", "", text) if v == 2 else text
        out += [(conv, turn, "user" if v == 4 else role, text)] * (2 if v == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_report(rows):
    """Cheapest edits by all prefixes' audits, written out: for each number of rows and repaired initials' end the least (cost, macro audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
    found = faults(rows)
    paths = {"": (0, (), ())}
    end = lambda out: "".join(r[0] for r in out)

    def shape(initials):
        if re.fullmatch("s?(ua)*u?", initials) is None:
            return None
        return initials if len(initials) < 2 else initials[-1]

    for (_, _, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for cost, audit, out in paths.values():
            options = []
            for inserted in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
                at = out + tuple((r, "") for r in inserted)
                paid, code = cost + 2 * len(inserted), "I" * len(inserted)
                options.append((paid + 3, (*audit, code + "D"), at))
                if fault not in ("blank", "duplicate"):
                    cut = int(fault == "truncated")
                    options += [(paid + cut, (*audit, code + "K"), (*at, (role, text))), *((paid + cut + 2, (*audit, code + "R"), (*at, (r, text))) for r in ("user", "assistant"))]
            for paid, code, at in options:
                initials = "".join(r[:1] or "?" for r, _ in at)
                state = shape(initials) if re.fullmatch("s?(ua)*u?", initials) else None
                if state is not None:
                    state = "" if not initials else "s" if initials == "s" else initials[-1]
                    if state not in new or (paid, code) < new[state][:2]:
                        new[state] = (paid, code, at)
        paths = new
    best = None
    for cost, audit, out in paths.values():
        for inserted in ((), ("user",), ("assistant",), ("user", "assistant")):
            at = out + tuple((r, "") for r in inserted)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in at)):
                whole = (cost + 2 * len(inserted), "".join(audit) + "I" * len(inserted), at)
                best = whole if best is None or whole[:2] < best[:2] else best
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{name: found.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": best[0], "audit": best[1],
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    }


def plain_reports(original, rows):
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    return {conv: plain_report(of[conv]) for conv in {r[0] for r in original}}


def reported(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r.pop("conv_id"): r for r in rows}
    assert len(out) == len(rows)
    return out


def exhaustive(symbols):
    """All edits of a few rows (role, fault), as (cost, audit) of the best."""
    best = None
    inserts = [()] + [c for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    edits = [[("D", 3, "")] + ([] if fault in ("blank", "duplicate") else [(c, p + (fault == "truncated"), i) for c, p, i in (("K", 0, role[:1]), ("R", 2, "u"), ("R", 2, "a"))]) for role, fault in symbols]
    for chosen in itertools.product(*edits):
        for runs in itertools.product(inserts, repeat=len(symbols) + 1):
            initials = "".join("".join(r) + (e[2] if e else "") for r, e in itertools.zip_longest(runs, chosen))
            if re.fullmatch("(s?(ua)+)?", initials):
                new = (sum(2 * len(r) for r in runs) + sum(e[1] for e in chosen), "".join("I" * len(r) + (e[0] if e else "") for r, e in itertools.zip_longest(runs, chosen)))
                best = new if best is None or new < best else best
    return best


def test_program_against_all_edits():
    choices = [("system", None), ("user", None), ("assistant", None), ("tool", None), ("user", "truncated"), ("system", "truncated"), ("user", "blank")]
    number = lambda role, fault: 0 if fault == "blank" else 1 + 2 * "suat".index(role[0]) + (fault == "truncated")
    for rows in itertools.chain(*(itertools.product(choices, repeat=n) for n in range(3))):
        symbols = [number(*r) for r in rows]
        layer, total, parents = conversations._forward(symbols, 0)
        end, cost = conversations._closed(layer)
        audit = "".join(c for c, _ in conversations._codes(parents, end)) + "I" * conversations._CLOSE[end]
        assert (cost + total, audit) == exhaustive(rows)


def test_summaries_compose_to_the_whole():
    draw = random.Random(5)
    for _ in range(300):
        symbols = [draw.randrange(9) for _ in range(draw.randrange(1, 40))]
        layer, total, parents = conversations._forward(symbols, 0)
        end, cost = conversations._closed(layer)
        at = sorted(draw.sample(range(len(symbols) + 1), min(len(symbols), draw.randrange(1, 6))))
        parts = [symbols[a:b] for a, b in itertools.pairwise([0, *at, len(symbols)])]
        states, composed = conversations._compose([conversations._summary(p) for p in parts])
        codes = [c for p, (begin, stop) in zip(parts, states, strict=True) for c in conversations._codes(conversations._forward(p, begin)[2], stop)]
        assert composed == cost + total and codes == conversations._codes(parents, end)
        assert len(conversations._steps) < 5000


def test_repair_of_all_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    assert reported(registry.op12_conversation_repair(spark, DATA)) == plain_reports(rows, damaged(rows))


def test_repair_edges_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 2)
    draw = random.Random(9)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No", "", " \n", None, "So? ", "¿Qué?", "x" * 50_000 + "!"]
    rows = [(draw.choice([1, 2, 2, 2, 3, None]), draw.choice([None, *range(30)]), draw.choice(roles), draw.choice(texts) if i % 3 else f"Turn {i}.") for i in range(300)]
    rows += [(7, 1, None, None), (8, None, "user", "Alone."), (2**60, 1, "system", "Only this.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string")
    assert reported(conversations.repair_reports(df, conversations.damage(df))) == plain_reports(rows, damaged(rows))
    assert {tuple(map(str, r)) for r in conversations.damage(df).collect()} == {tuple(map(str, r)) for r in damaged(rows)}
    assert conversations.repair_reports(df.limit(0), conversations.damage(df.limit(0))).collect() == []


def test_one_conversation_of_many_rows(spark):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"Line {i % 4000}{'.' if i % 7 else ''}") for i in range(9000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = reported(conversations.repair_reports(df, df))[1]
    layer, total, parents = conversations._forward([0 if f == "duplicate" else 1 + 2 * "sua".index(r[2][0]) + (f == "truncated") for r, f in zip(rows, faults(rows), strict=True)], 0)
    end, cost = conversations._closed(layer)
    assert got["cost"] == cost + total and got["audit"] == "".join(c for c, _ in conversations._codes(parents, end)) + "I" * conversations._CLOSE[end]


# ---- 13


def test_flows_are_cheapest():
    draw = random.Random(2)
    for _ in range(60):
        n, m = draw.randrange(1, 4), draw.randrange(1, 4)
        sizes = [draw.randrange(4) for _ in range(n)]
        capacities = [0] * m
        for _ in range(sum(sizes)):
            capacities[draw.randrange(m)] += 1
        cost = [[draw.randrange(5) for _ in range(m)] for _ in range(n)]
        flow = resharding.least_moves(sizes, capacities, cost)
        assert [sum(r) for r in flow] == sizes and [sum(c) for c in zip(*flow, strict=True)] == capacities
        units = [i for i, s in enumerate(sizes) for _ in range(s)]
        slots = [j for j, c in enumerate(capacities) for _ in range(c)]
        best = min(sum(cost[i][j] for i, j in zip(units, order, strict=True)) for order in set(itertools.permutations(slots))) if len(slots) < 8 else None
        if best is not None:
            assert sum(cost[i][j] * flow[i][j] for i in range(n) for j in range(m)) == best
        moved = resharding.least_moves(sizes, capacities)
        stay = sum(min(s, c) for s, c in zip(sizes, capacities, strict=False))
        assert sum(sizes) - sum(moved[i][i] for i in range(min(n, m))) == sum(sizes) - stay


def check_layout(rows, shards):
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    for group in held.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert set(held) <= set(range(shards))
    return [sum(r["size"] for r in held[s]) for s in range(shards)]


def test_resharding_of_all_documents(spark):
    got = registry.op13_resharding(spark, DATA).collect()
    documents = {r[0]: (r[1] or "").encode() for r in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in documents.items())
    sizes = check_layout(got, registry.SHARDS)
    assert max(sizes) - min(sizes) < max(len(t) for t in documents.values())
    again = registry.op13_resharding(spark, DATA).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in again}


def test_untouched_files_stay_and_few_bytes_move(spark, monkeypatch):
    from pyspark.sql import functions as F

    draw = random.Random(4)
    df = spark.createDataFrame([(i, "x" * draw.randrange(200), i % 3 if i % 5 else 0) for i in range(3000)], "doc_id bigint, text string, shard int")
    old = resharding.write_shards(df, F.col("shard"), F.length("text") + 1)
    new = resharding.reshard(old, 4)
    before, after = ({r.row.doc_id: r for r in x.read().collect()} for x in (old, new))
    sizes = check_layout(after.values(), 4)
    assert set(before) == set(after) == set(range(3000)) and max(sizes) - min(sizes) <= 200
    was = [sum(r["size"] for r in before.values() if r.shard == s) for s in range(4)]
    moved = sum(r["size"] for i, r in after.items() if r.shard != before[i].shard)
    assert abs(moved - sum(max(0, w - sum(was) // 4) for w in was)) <= 400
    stayed = {r.path for r in old.files.collect()} & {r.path for r in new.files.collect()}
    assert stayed and all(r.rows for r in new.files.collect())
    assert {r.path for r in resharding.reshard(new, 4).files.collect()} == {r.path for r in new.files.collect()} or max(sizes) > min(sizes)


def test_resharding_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a" * 500_000, 0), (2, None, 0), (None, "", 1), (3, "ü" * 400_000, 0), (3, "b", 5), (3, "b", 5)] + [(i, "same text", None) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `_shard` int").withColumn("slot", F.lit("clash"))
    got = resharding.reshard_by_bytes(df, F.coalesce("_shard", F.lit(2)), 4).read().collect()
    check_layout(got, 4)
    assert sorted(map(str, ((r.row.doc_id, r.row.text, r.row.slot) for r in got))) == sorted(map(str, ((i, t, "clash") for i, t, _ in rows)))
    big = [r.shard for r in got if r["size"] > 100_000]
    assert len(set(big)) == 2 and all(sum(x.shard == s for x in got) == 1 for s in big)
    assert resharding.reshard_by_bytes(df.limit(0), F.lit(0), 4).read().collect() == []
    assert {r.shard for r in resharding.reshard_by_bytes(df.limit(1), F.lit(0), 4).read().collect()} == {0}


@pytest.mark.parametrize("shards", [1, 3])
def test_rows_of_no_bytes(spark, shards):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    layout = resharding.reshard(resharding.write_shards(df, F.lit(1), F.lit(0)), shards)
    assert sorted(r.row.i for r in layout.read().collect()) == list(range(10))
