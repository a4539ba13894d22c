"""Operators 1, 2, 5, 7 and 9 and the pipeline: plain recomputation, brute force, recall and held-out accuracy."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import licences, mixing, order_minhash, ordinal, registry, vptree

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 1


def fingerprint(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.f for r in order_minhash.fingerprints(df, {"f": "text"}).orderBy("i").collect()]


def like(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / order_minhash.M


def test_fingerprints_follow_order(spark):
    draw = random.Random(1)
    text = [f"word{draw.randrange(10**6)}" for _ in range(400)]
    one_edit, turned = list(text), text[200:] + text[:200]
    one_edit[50] = "changed"
    shuffled = list(text)
    draw.shuffle(shuffled)
    whole, edit, turn, mess, again = fingerprint(spark, *(" ".join(t) for t in (text, one_edit, turned, shuffled, text)))
    assert whole == again and len(whole) == order_minhash.M
    # both of these keep nearly all k-mers, which a fingerprint without order would call the same text
    assert like(whole, edit) > 0.9 and like(whole, turn) < 0.75 and like(whole, mess) < 0.75


def test_occurrence_numbers_tell_repeats_apart(spark):
    text = " ".join(f"word{i * 7919 % 10007}" for i in range(100)) + " "
    few, many, more = fingerprint(spark, text + "ab " * 10, text + "ab " * 2000, text + "ab " * 2000 + "tail")
    assert like(few, many) < 0.5 and like(many, more) > 0.9


def test_fingerprint_edges(spark):
    none, empty, one, long, wide, lines = fingerprint(spark, None, "", "a", "xyz " * 30_000, "漢字かな" * 50, "\n\n")
    assert none == empty == [0] * order_minhash.M and none != one
    assert len({tuple(one), tuple(long), tuple(wide), tuple(lines)}) == 4


def test_edited_texts(spark):
    rows = [(5, "abcdefghi"), (3, "XYZ"), (9, None), (7, "ü" * 10), (None, "no id at all"), (3, "AAA")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fingerprint int")
    got = order_minhash.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    edited = {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (5, 9, sha("abcdef" + "AAA")) in edited
    assert (3, 3, sha("XYn")) in edited and (3, 3, sha("AAn")) in edited
    assert (7, 10, sha("ü" * 7 + "abc")) in edited
    assert (9, 0, sha("")) in edited and (None, 12, sha("no id at")) in edited
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert order_minhash.edited_fingerprints(df.limit(0)).count() == 0
    single = order_minhash.edited_fingerprints(df.where("doc_id = 5")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == sha("abcdefabc")


def xx(*values):
    """Spark's xxhash64 of texts, (value, bytes) integers, or a list of texts."""
    h = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            data = x.encode() if isinstance(x, str) else x[0].to_bytes(x[1], "little", signed=True)
            h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    """One k-mer at a time: number the repeats, hash onto the ring, and of each point take what follows, in the text's order."""
    token, low = order_minhash._TOKEN, (1 << 30) - 1
    kmers = [m.group(1) for m in re.finditer(f"(?=((?:{token}){{1,{order_minhash.K}}}))(?:{token})", text or "", re.S)]
    if not kmers:
        return [0] * order_minhash.M
    seen, ring = Counter(), []
    for i, kmer in enumerate(kmers):
        upper = xx(kmer) >> 30
        ring.append((xx((upper, 8), (seen[upper], 4)) & ~low | i))
        seen[upper] += 1
    ring.sort()
    out = []
    for b in range(order_minhash.M):
        point = -(1 << 63) + b * ((1 << 64) // order_minhash.M)
        first = next((i for i, x in enumerate(ring) if x >= point), len(ring))
        places = sorted(ring[(first + j) % len(ring)] & low for j in range(order_minhash.L))
        out.append(xx([kmers[p] for p in places]) >> 32)
    return out


def test_fingerprints_against_plain_python(spark):
    draw = random.Random(11)
    texts = ["", "a", "ab ab ab ab", "Ünïcode, and\nlines\n", "x" * 50]
    texts += [" ".join(draw.choice(["the", "of", "lorem", "ipsum,", "X", "7", "longerword"]) for _ in range(draw.randrange(1, 120))) for _ in range(25)]
    assert fingerprint(spark, *texts) == [plain_fingerprint(t) for t in texts]
    got = sorted(order_minhash.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    shown = lambda f: "".join(f"{x & 0xFFFFFFFF:08X}" for x in f)
    for i, r in enumerate(got):
        text, following = texts[i], texts[i - 1]  # descending order of ids; after the smallest comes the largest
        third = len(text) // 3
        own, other, after = (plain_fingerprint(t) for t in (text, text[: len(text) - third] + following[:third], following))
        assert (r.fingerprint.upper(), r.edited_fingerprint.upper()) == (shown(own), shown(other))
        assert (r.near_edited, r.near_next) == (like(own, other), like(own, after))


def test_likeness_falls_with_edits(spark):
    """What the README says of texts of several lengths: likeness after replacing a share of the words."""
    draw, texts, shares = random.Random(5), [], (0.02, 0.1, 0.3)
    for n in (30, 100, 1000):
        base = [f"word{draw.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(base))
        for share in shares:
            copy = list(base)
            for at in draw.sample(range(n), max(1, int(n * share))):
                copy[at] = f"other{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    prints = fingerprint(spark, *texts)
    for i in range(0, len(texts), 4):
        near = [like(prints[i], prints[i + 1 + k]) for k in range(3)]
        assert near[0] > near[1] > near[2] and near[0] >= 0.6, near


# ---- 2


def plain_scan(text):
    def words(t):
        return [w for w in re.split(r"[\W_]+", t.lower()) if w]

    best, n = None, 0
    for part in dict.fromkeys([text, *re.split(r"\n|(?<=[.!?])\s+", text)]):
        w = words(part)
        grams = set(zip(w, w[1:], strict=False))
        hits = []
        for row in licences._template_rows(licences.THRESHOLD):
            template = {tuple(b.split(" ")) for b in row["bigrams"]}
            dice = 2 * len(grams & template) / (len(grams) + len(template))
            if dice >= licences.THRESHOLD:
                hits.append((-dice, row["licence"]))
        if hits:
            n += 1
            best = min([best, min(hits)] if best else [min(hits)])
    return (best[1], -best[0], n) if best else (None, 0.0, 0)


def test_licences(spark):
    texts = [
        None, "", "nothing", "Released under the MIT License.", "some prose. RELEASED UNDER THE -- mit  license! More prose.", "Released under the new MIT License\nLicensed under CC BY-NC 4.0.",
        licences.TEMPLATES["ISC"][0], "x\n" + licences.TEMPLATES["MIT"][2] + "\n" + "prose " * 5000, "Released under a licence of its own making.",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[3], "z"), (3, texts[3], "z")], "doc_id long, text string, licence string")
    rows = licences.scan_licences(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[3 if r.doc_id is None else r.doc_id]
        want = plain_scan(text) if text else (None, 0.0, 0)
        assert (r.licence, pytest.approx(r.dice), r.n_matches) == want
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_shared_paragraphs_do_not_decide(spark):
    t = licences.TEMPLATES
    clauses = "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce it."
    texts = {
        "BSD-2-Clause": f"Copyright 2020 Someone.\n{t['BSD-2-Clause'][1]}\n{clauses}",
        "BSD-3-Clause": f"Copyright 2020 Someone.\n{t['BSD-2-Clause'][1]}\n{clauses}\n3. {t['BSD-3-Clause'][1]}",
        "BSD-4-Clause": f"{t['BSD-2-Clause'][1]}\n{clauses}\n{t['BSD-4-Clause'][0]}\n{t['BSD-3-Clause'][1]}",
        "MIT": f"{t['MIT'][2]}\n{t['MIT'][3]}",
        "JSON": f"{t['MIT'][2]}\n{t['MIT'][3]}\n{t['JSON'][0]}",
        "ECL-2.0": f"{t['ECL-2.0'][0]}\n{t['Apache-2.0'][2]}",
        "Apache-2.0": f"{t['Apache-2.0'][1]}\n{t['Apache-2.0'][2]}",
        "NCSA": f"{t['NCSA'][0]}\n{clauses}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id: r.licence for r in licences.scan_licences(df).collect()} == {name: name for name in texts}


@pytest.mark.parametrize("width, mark", [(30, ""), (72, " * "), (80, "# ")])
def test_wrapped_licences(spark, width, mark):
    """Notices wrapped at some columns, plain or as comments, once or twice within other text."""
    prose = "\n".join(f"some other line number {i} about nothing" for i in range(40))
    rest = "The above copyright notice shall be included in all copies or substantial portions of the Software."
    wanted = [(name, text) for name, texts in licences.TEMPLATES.items() for text in texts if len(text) > width]
    wrap = lambda t: "\n".join(mark + line for line in textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False))
    rows = [(i, f"{prose}\n\n{wrap(text)}\n\n{wrap(rest)}\n{prose}") for i, (_, text) in enumerate(wanted)]
    rows += [(100 + i, f"{prose}\n{wrap(text)}\n{prose}\n{wrap('Indeed: ' + text)}\n{prose}") for i, (_, text) in enumerate(wanted)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert len(got) == len(rows)
    for i, (name, _) in enumerate(wanted):
        assert got[i].licence == got[100 + i].licence == name
        assert got[i].dice >= 0.95 and got[100 + i].dice >= 0.95
        assert got[i].n_matches >= 1 and got[100 + i].n_matches >= 2


# ---- 5


def test_vantage_trees_find_the_nearest(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(3000, 16)) * draw.uniform(0.5, 2, size=(3000, 1))
    vectors[100:400] = vectors[50]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = np.array([v for _, v in rows])
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        got = defaultdict(list)
        for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=10, factor=factor).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        right = 0
        for q in range(0, 3000, 20):
            s = exact @ exact[q]
            order = [i for i in np.lexsort((np.arange(3000), -np.round(s, 9))) if i != q][:10]
            found = sorted(got[q])
            assert [x[0] for x in found] == list(range(1, 11))
            assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in found)
            right += sum(x[2] >= s[order[-1]] - 1e-9 for x in found)
            if factor == 1.0:
                assert [x[1] for x in found] == order
        assert right / 1500 >= least


@pytest.mark.parametrize("factor", [1.0, 2.0])
def test_many_balls_of_many_shards(spark, monkeypatch, factor):
    """Clusters of vectors and one that very many share, over small balls, shards and blocks: factor 1 is exact, and both leave out balls."""
    monkeypatch.setattr(vptree, "PIVOT_ROWS", 40)
    monkeypatch.setattr(vptree, "SHARD_ROWS", 60)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 9)
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 8)) * 4
    vectors = np.round(centres[draw.integers(12, size=1500)] + draw.normal(size=(1500, 8)) * 0.2, 3)
    vectors[:500] = vectors[0]
    other = draw.normal(size=(30, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000 + i, v.tolist()) for i, v in enumerate(other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(vptree, "_visited", lambda c, v, *a, f=vptree._visited: (seen.append(v.count()), f(c, v, *a))[1])
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=10, factor=factor).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for first, block in ((0, vectors), (2000, other)):
        for q in range(0, len(block), 20):
            scores = (block * block[q]).sum(1)
            order = [i for i in np.lexsort((np.arange(len(block)), -scores)) if i != q][:10]
            mine = sorted(got[first + q])
            assert len(mine) == 10
            hits += sum(s >= scores[order[-1]] - 1e-9 for _, _, s in mine)
            if factor == 1:
                assert [v for _, v, _ in mine] == [first + i for i in order]
    assert hits >= 0.9 * 10 * 77 and seen[0] == 77 and seen[1] < 0.8 * 75 * 38


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 0.0, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (6, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 20, 1.0), (20, 1, 6, 2.0), (20, 2, 0, 1.0)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("factor", [1.0, 2.0])
def test_ties_go_to_the_smallest_ids(spark, factor):
    """Far more distinct vectors than places have the same product with a query, exact in integers."""
    draw = random.Random(8)
    rows = [(0, [1.0] + [0.0] * 7)]
    rows += [(i, [1.0] + [float(draw.randrange(-3, 4)) for _ in range(7)]) for i in range(1, 620)]
    rows += [(i, [2.0 if i % 90 == 0 else 0.0] + [float(draw.randrange(-3, 4)) for _ in range(7)]) for i in range(620, 1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") == 0, factor=factor).orderBy("rank").collect()]
    assert got == [(i, 2.0) for i in range(630, 1000, 90)] + [(i, 1.0) for i in range(1, 16)] + []


# ---- 7


def plain_targets(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, fixed, total = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, sum(sizes.values())
    while True:
        rest, free = total - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        target = {s: fixed[s] if s in fixed else rest * weight[s] / free for s in names}
        over = {s: cap * sizes[s] for s in names if s not in fixed and target[s] > cap * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mixing(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "b", "c", "é", None, "tiny"] if i else ["none"]), " ".join(["w"] * (0 if i % 17 == 0 else draw.randrange(1, 40)))) for i in range(600)]
    rows += [(9, "a", "w w w"), (9, "a", "w w w"), (None, "b", "w w"), (601, "b", None), (602, "nothing", "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, source string, text string, size int")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), Counter()
    got = mixing.mix(df, lambda place: place % 3 + 1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.whole * r["size"] + r.part
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(df.repartition(7), lambda place: place % 3 + 1).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(df.limit(0), lambda place: place % 3 + 1).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, lambda place: place % 3 + 1).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and got["c"] == 3 and got["d"] == 0 and sum(got.values()) == pytest.approx(1011)


def test_mixed_rows_have_the_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mixed_rows(docs, lambda place: place % 3 + 1)
    assert out.columns == docs.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert sum(words(out).values()) == pytest.approx(sum(words(docs).values()), abs=12)


def test_mixed_rows_carry_any_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 2), (2, None, None, 3, 4), (3, "d e", "s", 5, 6), (3, "d e", "s", 5, 6)], "doc_id long, text string, source string, _part int, key int")
    out = mixing.mixed_rows(docs, lambda place: place % 3 + 1)
    assert out.columns == docs.columns and {(r["_part"], r.key) for r in out.collect()} <= {(1, 2), (3, 4), (5, 6)}


# ---- 9


def graded(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        g = draw.choice([0, 1, 2, 2, 2])
        w = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(20, 120))]
        if g == 0:
            w = [draw.choice(["JUNK!!", "###", "BUY$$$"]) if draw.random() < 0.5 else x.upper() for x in w]
        if g == 1:
            for _ in range(2):
                w[draw.randrange(len(w))] = draw.choice(["nasty", "nastier", "vile"])
        rows.append((i, " ".join(w), g))
    return rows


def test_held_out_accuracy(spark):
    train, held = graded(1500, 1), graded(600, 2)
    model = ordinal.fit([t for _, t, _ in train], [g for *_, g in train], 3)
    assert (np.diff(model.thresholds) > 0).all()
    df = spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string")
    got = {r.doc_id: r for r in ordinal.score(df, model, 3, ["doc_id"]).collect()}
    right = sum((got[i].top_probability >= 0.5) == (g == 2) for i, _, g in held)
    assert right / len(held) > 0.95
    mean = [np.mean([got[i].expected_grade for i, _, h in held if h == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    again = ordinal.fit([t for _, t, _ in train], [g for *_, g in train], 3)
    assert (again.weights == model.weights).all()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "x " * 50_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.fit_on(docs, none, registry.grade(), 3)
    assert model is None
    assert {r.top_probability for r in ordinal.score(docs, None, 3, ["doc_id", "score"]).collect()} == {1.0}
    model = ordinal.fit([t for _, t, _ in graded(200, 3)] + [None], [g for *_, g in graded(200, 3)] + [2], 3)
    out = ordinal.score(docs, model, 3, ["doc_id", "score", "text"])
    assert out.columns == ["doc_id", "score", "text", "expected_grade", "top_probability"] and out.count() == 4
    assert ordinal.score(docs.limit(0), model, 3, ["doc_id"]).count() == 0


def test_gradient_and_probabilities_against_plain_python():
    """The gradient against differences of the likelihood; probabilities against sums over one text's features at a time."""
    draw = np.random.default_rng(3)
    n, n_used, n_grades = 40, 7, 3
    rows, column = np.repeat(np.arange(n), 3).astype(np.int32), draw.integers(0, n_used, 3 * n).astype(np.int32)
    scale, grade, weight = draw.uniform(0.5, 2, n_used), draw.integers(0, n_grades, n), draw.uniform(0.5, 2, n)
    parameters = draw.normal(size=n_used + n_grades - 1) / 3

    def loss(p):
        thresholds = [p[n_used], p[n_used] + math.exp(p[n_used + 1])]
        total = 0.0
        for i in range(n):
            z = sum(p[c] * scale[c] for c in column[rows == i])
            above = [1.0, *(1 / (1 + math.exp(t - z)) for t in thresholds), 0.0]
            total -= weight[i] * math.log(above[grade[i]] - above[grade[i] + 1])
        return total / n + 5e-3 / 2 * sum(x * x for x in p[:n_used])

    got = ordinal.gradient(parameters, rows, column, scale, grade, weight, 5e-3)
    for j in range(len(parameters)):
        step = np.zeros(len(parameters))
        step[j] = 1e-4
        assert got[j] == pytest.approx((loss(parameters + step) - loss(parameters - step)) / 2e-4, abs=2e-5)

    texts = [t for _, t, _ in graded(50, 4)] + ["", None]
    model = ordinal.fit([t for _, t, _ in graded(300, 1)], [g for *_, g in graded(300, 1)], 3)
    import pyarrow as pa

    row, columns = ordinal.Features()(*ordinal.utf8(pa.array(texts)))
    tails = model.tails(row, columns, len(texts))
    for i in range(len(texts)):
        z = float(sum(model.weights[c] for c in columns[row == i]))
        assert tails[i] == pytest.approx([1 / (1 + math.exp(t - z)) for t in model.thresholds], abs=1e-6)


def test_fit_on_a_table_is_the_fit_of_its_texts(spark):
    rows = graded(200, 7)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5, "zzz", "x"), (None, "y", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows] + [(9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = ordinal.fit_on(docs, labels, registry.grade(), 3)
    want = ordinal.fit([t for _, t, _ in rows], [g for *_, g in rows], 3)
    assert got.thresholds == pytest.approx(want.thresholds, abs=1e-4) and np.abs(got.weights - want.weights).max() < 1e-3
    clash = ordinal.score(docs.withColumn("top_probability", F.lit("mine")), got, 3, ["doc_id", "top_probability", "grade"])
    assert clash.columns == ["doc_id", "grade", "expected_grade", "top_probability"] and clash.count() == docs.count()


# ---- the pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.where("n_chars <> length(text)").count() == 0
    decoded = {hashlib.sha256(r.text.encode()).hexdigest() for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r.decoded_sha256 for r in docs.collect()} == decoded
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = {k for k, v in labels.items() if v.quality == 1 and v.toxic == 0}
    assert len(clean & ids[1]) >= 0.9 * len(clean)
    junk = {k for k, v in labels.items() if v.quality == 0}
    assert len(junk & ids[1]) <= 0.4 * len(junk)


def test_pipeline_edges(spark, tmp_path):
    """Null ids, texts and sources, empty and repeated rows, an unknown column whose name the stages use; then no rows at all."""
    spark.createDataFrame([(99, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (1, words), (2, words + " more"), (3, None), (4, ""), (None, words), (None, "some other words that stand alone here"), (5, "\n\n")]
    docs = spark.createDataFrame([(a, b, "en", None if i % 2 else "s", 9, "x", 0.5) for i, (a, b) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _part string, top_probability double")
    for name, table in (("few", docs), ("none", docs.limit(0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{i}"))
            table = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            assert i == 4 or table.columns == corpus_pipeline.COLUMNS
        assert (table.count() > 0) == (name == "few") and table.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_the_registry_has_all_ten():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"]


def test_oracle_sql(spark):
    import oracle

    con = oracle.connect(DATA)
    queries = registry.queries()
    for name, sql in registry.oracle_sql().items():
        assert oracle.difference(spark, con, DATA, queries[name], sql) == "", name
