"""Operators 4 and 8 against brute force over small tables full of near copies, and their edge cases."""

import random
import re

import pytest

from millrace.llm import jaccard, lines
from millrace.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(texts, width=5):
    sets, root = {k: shingles(t, width) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed, n, passages):
    """Families of near copies of all sizes, texts that share passages, and tiny texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    shared = [[word() for _ in range(40)] for _ in range(passages)]
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(draw.choice([1, 3, 5, 6, 8, 11, 20, 60, 150, 400]))]
        if passages and draw.random() < 0.5:
            base = draw.choice(shared) + base
        texts.append(base)
        for _ in range(draw.choice([0, 0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(draw.randrange(1 + len(copy) // 12)):
                at = draw.randrange(len(copy))
                copy[at : at + draw.choice([0, 1])] = [word()] if draw.random() < 0.7 else []
                copy = copy or [word()]
            texts.append(copy)
    return dict(enumerate(" ".join(t) for t in texts[:n]))


@pytest.mark.parametrize("seed, hot, passages", [(1, 24, 0), (2, 24, 2), (3, 3, 2), (4, 2, 1)])
def test_components_against_brute_force(spark, monkeypatch, seed, hot, passages):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = corpus(seed, 220, passages)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == groups(texts)


def test_one_large_group_of_near_copies(spark):
    draw = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    texts = {}
    for i in range(150):
        copy = list(base)
        copy[draw.randrange(80)] = f"x{i}"
        texts[i] = " ".join(copy)
    texts |= {500 + i: " ".join(base[:20] + [f"y{i}_{j}" for j in range(40)]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == groups(texts)


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É b c d e f"), (8, "é b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (11, "word " * 30_000)]
    df = spark.createDataFrame([(a, b, 5, "x") for a, b in rows], "doc_id long, text string, node int, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (8, 2, 8), (9, 2, 9), (9, 2, 9), (11, 1, 11), (None, 1, None), (None, 2, 9)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_rows_without_ids_link_and_one_is_first(spark):
    """A set that only rows without an id have joins two documents; of each component one document is the first, whatever its ids."""
    words = [f"n{i}" for i in range(44)]
    rows = [(3, " ".join(words[:36])), (None, " ".join(words[:40])), (None, " ".join(words[:40])), (1, " ".join(words[4:44])), (1, "quite another text of six words"), (None, "some text that nobody else has got"), (None, "some text that nobody else has  got")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.first) for r in got) == sorted([(3, 1, False), (0, 1, False), (0, 1, False), (1, 1, True), (1, 1, True), (0, 0, True), (0, 0, False)])


def test_sizes_where_sets_may_link():
    scopes = jaccard.Scopes()
    for r in range(1, 400):
        for s in range(-(-r * 75 // 100), r + 1):
            if 100 * s >= 75 * r and jaccard.most_different(r, s):
                import numpy as np

                mine = {b for b, _ in scopes.of(np.array([r]))}
                band = int(np.searchsorted(jaccard._BANDS, s, "right") - 1)
                assert band in mine and jaccard.most_different(r, s) <= scopes.most(band, np.array([r]))[0] < scopes.segments[band]


def test_own_band_covers_larger_partners():
    """A set and a larger one of the next band meet in the smaller one's band."""
    import numpy as np

    scopes = jaccard.Scopes()
    for s in range(1, 400):
        band = int(np.searchsorted(jaccard._BANDS, s, "right") - 1)
        for r in range(s, s * 100 // 75 + 1):
            if jaccard.most_different(r, s):
                assert r - s <= scopes.most(band, np.array([s]))[0] < scopes.segments[band]
                assert r - s <= scopes.most(band, np.array([r]))[0]


def test_subset_pairs_of_neighbouring_bands(spark):
    """Groups of three: a set of shingles and two larger ones that hold all of it."""
    texts, draw = {}, random.Random(12)
    for family in range(120):
        small, large = [(12, 16), (18, 24), (27, 36)][family % 3]
        base = [f"f{family}_{i}" for i in range(small + 4)]
        texts[len(texts)] = " ".join(base)
        for k in range(2):
            before = draw.randrange(large - small + 1)
            extra = [f"f{family}_{k}_{i}" for i in range(large - small)]
            texts[len(texts)] = " ".join(extra[:before] + base + extra[before:])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == groups(texts)


def test_connected_components(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {k: find(k) for k in root if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(w, v):
    """One word of eight or more, or one character of eight or more of lines of eight words at most, digits apart."""
    if len(w) >= 8 and len(v) >= 8 and edits(w, v) <= 1:
        return True
    a, b = " ".join(w), " ".join(v)
    return max(len(w), len(v)) <= 8 and min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1 and re.findall("[0-9]", a) == re.findall("[0-9]", b)


def brute_lines(rows):
    """(id, text) in order to what stays of each."""
    seen, out = [], {}
    for key, text in rows:
        if text is None:
            out[key] = (None, 0, 0)
            continue
        kept, n, k = [], 0, 0
        for line in text.split("\n"):
            w = WORD.findall(line.translate(LOWER))
            if not w:
                kept.append(line)
                continue
            n += 1
            near = any(w == v or alike(w, v) for v in seen)
            seen.append(w)
            if not near:
                kept.append(line)
                k += 1
        out[key] = ("\n".join(kept) if k or not n else "", n, k)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_brute_force(spark, seed):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(30)}" for _ in range(draw.choice([1, 4, 7, 8, 9, 15, 40]))] for _ in range(25)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(draw.randrange(6)):
            line = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                at = draw.randrange(len(line))
                line[at : at + draw.randrange(2)] = [] if draw.random() < 0.3 and len(line) > 1 else [f"w{draw.randrange(40)}"]
            text.append(draw.choice([" ", "  "]).join(line))
            text += [""] * draw.randrange(2)
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()} == brute_lines(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_lines_against_brute_force(spark, seed):
    """Typing errors in lines of one to nine words, with digits, accents and joined words."""
    draw = random.Random(seed)
    base = [" ".join("".join(draw.choice("abcdé1") for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(1, 10))) for _ in range(30)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(draw.randrange(4)):
            line = list(draw.choice(base))
            for _ in range(draw.choice([0, 1, 1, 2])):
                at = draw.randrange(len(line) + 1)
                line[at : at + draw.randrange(2)] = draw.choice([[], ["b"], [" "], ["2"], ["É"], ["A"]])
            text.append("".join(line))
        rows.append((i, "\n".join(text)))
    rows += [(200, "alpha beta gamma delta epsilon zeta eta\nalpha beta gamma delta epsilon zeta eth"), (201, "Read more about golf\nChapter number 2"), (202, "read  more about golff\nchapter number 3\n" + "x" * 90_000), (203, "x" * 89_999 + "y\n" + "x" * 89_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_lines([r for r in rows if r[0] < 203])
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()}
    assert got.pop(203) == ("", 2, 0) and got == expected


def test_lines_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_NUMBERS", -1)
    rows = [(1, "a b c d e f g h\nx"), (2, "a b c d e f g i\ny"), (3, "x\na b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()} == brute_lines(rows)


def test_lines_edges(spark):
    rows = [(1, None, "k", 1), (2, "", "k", 2), (3, "\n \n", "k", 3), (4, "same\nsame", "k", 4), (5, "same", "k", 5), (None, "only here", "k", 6), (7, "x " * 20_000, "k", 7), (4, "same\nsame", "k", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_kept string, line int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_kept"]
    got = {r.line: (r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect()}
    assert got == {1: (1, None, 0, 0), 2: (2, "", 0, 0), 3: (3, "\n \n", 0, 0), 4: (4, "same", 2, 1), 5: (5, "", 1, 0), 6: (None, "only here", 1, 1), 7: (7, "x " * 20_000, 1, 1), 8: (4, "same", 2, 1)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("a, b, near", [("a b c", "a b c", True), ("a b c", "a c", True), ("a c", "a b c", True), ("a b c", "a x c", True), ("a b c", "x b y", False), ("a b", "b a", False), ("", "a", True)])
def test_within_one_edit(a, b, near):
    assert lines.within_one_edit(a.split(), b.split()) is near


def test_a_passage_that_thousands_of_short_documents_share(spark):
    """They share most of their words but hardly any of them link; a few do."""
    draw = random.Random(21)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join([f"a{i}_{j}" for j in range(3 + i % 9)] + passage + [f"b{i}_{j}" for j in range(draw.randrange(6))]) for i in range(600)}
    other = passage[:30] + [f"q{i}" for i in range(6)]
    texts |= {2000 + i: " ".join(other + [f"c{i}_{j}" for j in range(1 + i % 12)]) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == groups(texts)


@pytest.mark.parametrize("seed, hot", [(1, 1), (2, 2), (3, 6)])
def test_sets_of_few_hot_parts(spark, monkeypatch, seed, hot):
    """Texts put together from a few shared passages: hot parts of all kinds, at several levels."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    draw = random.Random(seed)
    parts = [[f"s{k}_{i}" for i in range(draw.choice([6, 9, 15]))] for k in range(7)]
    texts = {}
    for i in range(160):
        chosen = [w for k in sorted(draw.sample(range(7), draw.choice([1, 2, 3]))) for w in parts[k]]
        texts[i] = " ".join(chosen + [f"u{i}_{j}" for j in range(draw.choice([0, 0, 1, 3, 6]))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == groups(texts)


def test_links_leave_a_task_only_as_they_join(spark):
    """Entries that all share keys: pairs are compared where they meet, and as many links come out as unite what all links would."""
    import numpy as np
    from millrace.llm import hot_keys

    draw = random.Random(12)
    sets = {i: sorted({*range(100, 100 + 30), *(draw.randrange(1000, 1020) for _ in range(draw.randrange(12)))}) for i in range(80)}
    rows = [(i, i % 60, x, [(len(x) << 32) + len(x) - j for j in range(len(x))], x) for i, x in sets.items()]
    df = spark.createDataFrame(rows, "entry long, component long, keys array<long>, tags array<long>, members array<long>")
    got = [tuple(r) for r in hot_keys.fitting_links(df, 75).collect()]
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    assert set(got) <= linked and len(got) < len(linked) / 4

    def united(pairs):
        root = {i: i % 60 for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            by = {}
            for i, r in root.items():
                by[i % 60] = min(by.get(i % 60, r), r)
            root = {i: by[i % 60] for i in sets}
        return root

    assert united(got) == united(linked)
    bits = hot_keys.Bits([np.array(x) for x in sets.values()])
    a, b = np.array([p[0] for p in linked]), np.array([p[1] for p in linked])
    assert bits.linked(a, b, 75).all()
