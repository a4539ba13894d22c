"""Work in rounds of joins against the walk that it stands for: leaders, one-to-one choice, search by shared words."""

import random
from collections import Counter

from millrace.operators import linkage as K
from millrace.operators import overlap
from millrace.operators import state as S


def walked(nodes, pairs):
    leaders, out = [], {}
    for node in nodes:
        out[node] = next((x for x in leaders if (x, node) in pairs), node)
        if out[node] == node:
            leaders.append(node)
    return out


def test_leaders_are_the_walk(spark):
    draw = random.Random(1)
    for n, chance in ((1, 0.0), (40, 0.1), (60, 0.5)):
        order = list(range(n))
        draw.shuffle(order)
        pairs = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if draw.random() < chance}
        nodes = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "node long, at int")
        edges = spark.createDataFrame([(b, a) for a, b in pairs], "node long, before long")
        assert {r.node: r.leader for r in K.leaders(nodes, edges).collect()} == walked(order, pairs)


def test_one_to_one_is_taking_turns(spark):
    draw = random.Random(2)
    options = [(who, what, choice) for who in range(50) for choice, what in enumerate(draw.sample(range(30), draw.randrange(6)))]
    taken, expected = set(), {}
    for who in sorted(range(50), key=lambda w: -w):
        for _, what, _ in sorted((o for o in options if o[0] == who), key=lambda o: o[2]):
            if what not in taken:
                taken.add(what)
                expected[who] = what
                break
    df = spark.createDataFrame([(w, -w, x, c) for w, x, c in options], "who long, ord long, what long, choice long")
    assert {r.who: r.what for r in K.one_to_one(df).collect()} == expected
    assert K.one_to_one(df.limit(0)).collect() == []


def test_most_shared_is_the_search_of_all(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    some = lambda: sorted({draw.choices(words, [1 / (i + 1) ** 1.5 for i in range(30)])[0] for _ in range(draw.randrange(1, 9))})
    searched = [(i, draw.choice(["NY", "NJ"]), some()) for i in range(60)] + [(60, "NY", words), (61, "NY", ["unknown"]), (62, "CT", ["w0"])]
    held = [(i, draw.choice(["NY", "NJ"]), some()) for i in range(400)] + [(400, "NY", words), (401, "NJ", [])]
    expected = set()
    for asked, place, mine in searched:
        ranked = sorted((-len(set(mine) & set(theirs)), i) for i, where, theirs in held if where == place and set(mine) & set(theirs))
        expected |= {(asked, i, -shared) for shared, i in ranked[:5]}
    s, h = spark.createDataFrame(searched, "asked long, place string, words array<string>"), spark.createDataFrame(held, "id long, place string, words array<string>")
    for rare, grouped, listed in ((64, 5, 8), (3, 2, 2), (0, 4, 4), (10**6, 0, 0)):
        monkeypatch.setattr(overlap, "RARE", rare)
        monkeypatch.setattr(overlap, "GROUPED", grouped)
        monkeypatch.setattr(overlap, "LISTED", listed)
        got = [tuple(r) for r in overlap.most_shared(s, h, 5).collect()]
        assert Counter(got) == Counter(expected)


def test_clusters_and_claims_of_whole_tables_follow_the_walk(spark):
    draw = random.Random(4)
    names, titles = ["Kidney Fund", "Kidney Fund Inc", "Heart Circle", "Rotary Club of Phoenix", "Lions Club of Phoenix", None], ["Golf Outing", "2026 Golf Outing", "Kidney Fund Golf Outing", "Rotary Golf Day", "Lions Golf Day", "Golf Day", "2026", ""]
    rows = [(i, draw.randrange(2), draw.choice(["2026-05-01", "2026-05-02"]), draw.choice(names), draw.choice(titles), draw.choice(["organizer", "listing", "search", "other"]), draw.randrange(4) / 4, i) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, course_id long, start_date string, organizer string, title string, kind string, confidence double, ord long")
    distinct = list({(r[3], r[4]) for r in rows})
    pairs = spark.createDataFrame([(i, j, *a, *b) for i, a in enumerate(distinct) for j, b in enumerate(distinct)], "i int, j int, oa string, ta string, ob string, tb string")
    from pyspark.sql import functions as F

    same = {(distinct[r.i], distinct[r.j]) for r in pairs.where(K.same_outing(K.prepared(F.col("oa"), F.col("ta")), K.prepared(F.col("ob"), F.col("tb")))).collect()}
    assert all((b, a) in same for a, b in same)
    rank = {"organizer": 0, "listing": 1, "search": 2}
    leaders, expected = [], {}
    for r in sorted(rows, key=lambda r: (rank.get(r[5], 3), -r[6], r[7])):
        expected[r[0]] = next((x[0] for x in leaders if x[1:3] == r[1:3] and (x[3:5] == r[3:5] or (x[3:5], r[3:5]) in same)), r[0])
        if expected[r[0]] == r[0]:
            leaders.append(r)
    assert {r.event_id: r.leader for r in K.cluster_events(events).collect()} == expected


def test_free_slugs_by_taking_turns(spark):
    draw = random.Random(5)
    for seed in range(6):
        bases = [draw.choice(["a", "b", "a-2", "a-2-2", "a-3", "a-02", "a-1", "b-2", "-2"]) for _ in range(60)]
        taken = {draw.choice(["a", "a-2", "a-4", "a-02", "a-1", "b-2-2", "a-2-3", "a-9", "c"]) for _ in range(seed * 4)}
        given, expected = set(taken), {}
        for i, base in enumerate(bases):
            expected[i] = next(s for s in [base, *(f"{base}-{n}" for n in range(2, 100))] if s not in given)
            given.add(expected[i])
        df = spark.createDataFrame([(b, i, "kept") for i, b in enumerate(bases)], "base string, ord long, other string")
        held = spark.createDataFrame([(t,) for t in taken], "slug string")
        assert {r.ord: r.slug for r in S.free_slugs(df, held).collect()} == expected


def test_place_slugs_by_taking_turns(spark):
    draw = random.Random(7)
    for seed in range(4):
        rows = [(i, draw.choice(["a", "b", "a-x", "a-2", "a-x-2"]), draw.choice(["x", "y", "x-2", None])) for i in draw.sample(range(100), 50)]
        given = {"b", "a-x-3", "b-y-2"} if seed % 2 else set()
        taken, expected = spark.createDataFrame([(t,) for t in given], "slug string"), {}
        for i, base, city in sorted(rows):
            longer = base if city is None else f"{base}-{city}"
            expected[i] = next(s for s in [base, longer, *(f"{longer}-{n}" for n in range(2, 99))] if s not in given)
            given.add(expected[i])
        assert {r.ord: r.slug for r in S.place_slugs(spark.createDataFrame(rows, "ord long, base string, city string"), taken).collect()} == expected
