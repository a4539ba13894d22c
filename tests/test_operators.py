"""Operators whose order of work matters, against small tables with known answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import linkage as K
from millrace.operators import selection as C
from millrace.operators import state as S


def test_jaro_winkler():
    got = K.jaro_winkler_of(["martha", "", "a", "abc", "", "dwayne", "a" * 40], ["marhta", "a", "a", "xyz", "", "duane", "b"])
    assert got.tolist() == pytest.approx([0.9611111, 0, 1, 0, 0, 0.84, 0], abs=1e-6)


def test_match_courses(spark):
    courses = spark.createDataFrame(
        [(1, "Bethpage Black", "NY", "Farmingdale", 40.74, -73.45, ["Bethpage State Park"]), (2, "Bethpage Red", "NY", "Farmingdale", 40.745, -73.455, ["Bethpage State Park"]), (3, "Oak Hill", "NY", "Rochester", 43.1, -77.5, []), (4, "Oak Hill", "NJ", "Milford", 40.6, -75.0, []), (5, "Oak Hills", "NY", "Yonkers", 40.9, -73.8, [])],
        "id long, name string, state string, city string, lat double, lng double, aliases array<string>",
    )
    asked = spark.createDataFrame([(1, "Bethpage State Park Golf Course", "ny", None, None, None), (2, "Oak Hill Country Club", "NY", None, None, None), (3, "Oak Hill CC", "NY", "Rochester", None, None), (4, "Nowhere", "NY", None, None, None)], "query_id long, name string, state string, city string, lat double, lng double")
    got = {r.query_id: (r.kind, r.course_id, r.facility) for r in K.match_courses(asked, courses).collect()}
    assert got[1][0] == "matched" and got[1][2] is True
    assert got[2] == ("ambiguous", None, False)
    assert got[3] == ("matched", 3, False)
    assert got[4] == ("unmatched", None, False)


def test_clusters_follow_the_first_leader(spark):
    rows = [(1, "search", 0.9, "Kidney Fund", "Kidney Fund Golf Outing"), (2, "organizer", 0.5, "Kidney Fund Inc", "Golf Outing"), (3, "organizer", 0.9, "Heart Circle", "Spring Scramble"), (4, "search", 0.9, None, "2026 Golf Outing"), (5, "search", 0.1, "Kidney Fund", "Kidney Fund Golf Outing")]
    assert clusters(spark, rows) == {3: 3, 2: 2, 1: 2, 4: 2, 5: 2}


def test_titles_that_name_their_organizer_stay_apart(spark):
    rows = [(1, "organizer", 0.9, "Rotary Club of Phoenix", "Rotary Golf Day"), (2, "organizer", 0.8, "Lions Club of Phoenix", "Lions Golf Day"), (3, "search", 0.8, "Phoenix Lions", "Golf Day"), (4, "search", 0.7, None, "2026"), (5, "search", 0.6, "Someone", "2026")]
    assert clusters(spark, rows) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def clusters(spark, rows):
    events = spark.createDataFrame([(i, 7, "2026-05-01", o, t, k, c, i) for i, k, c, o, t in rows], "event_id long, course_id long, start_date string, organizer string, title string, kind string, confidence double, ord long")
    return {r.event_id: r.leader for r in K.cluster_events(events).collect()}


def plain_jaro_winkler(a, b):
    """One pair at a time, by the definition."""
    if not a or not b:
        return 0.0
    reach, taken, mine = max(max(len(a), len(b)) // 2 - 1, 0), {}, []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken[j] = c
            mine.append(c)
    if not mine:
        return 0.0
    m, moved = len(mine), sum(x != taken[j] for x, j in zip(mine, sorted(taken), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler_against_plain_pairs():
    import random

    draw = random.Random(1)
    words = ["".join(draw.choice("abcé ") for _ in range(draw.randrange(12))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = K.jaro_winkler_of([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([plain_jaro_winkler(a, b) for a, b in pairs])


def test_courses_against_all_pairs(spark):
    """Random places in two states, against a walk over every pair."""
    import math
    import random

    draw = random.Random(6)
    name = lambda: " ".join(draw.choice(["oak", "oaks", "hill", "hills", "river", "north"]) for _ in range(2))
    courses = [(i, name(), draw.choice(["NY", "NJ"]), draw.choice([None, "Aton", "Bville"]), 40 + draw.random() / 3, -74 + draw.random() / 3, [name()] if i % 3 == 0 else []) for i in range(60)]
    asked = [(i, name(), draw.choice(["ny", "NJ"]), draw.choice([None, "aton", "Bville", "Cford"]), *draw.choice([(None, None), (40.1, -73.9), (40.2, -73.8)])) for i in range(50)]
    km = lambda a, b, c, d: 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    want = {}
    for q, wanted, state, city, lat, lng in asked:
        found = []
        for i, n, s, c, y, x, aliases in courses:
            own, other = plain_jaro_winkler(wanted, n), max([plain_jaro_winkler(wanted, a) for a in aliases], default=0)
            if s != state.upper() or max(own, other) < 0.88:
                continue
            if city and not (c and c.lower() == city.lower()) and not (lat is not None and km(lat, lng, y, x) <= 25):
                continue
            found.append((-max(own, other), other > own, len(n), i, y, x))
        found.sort()
        apart = any(km(a[4], a[5], b[4], b[5]) > 3 for a in found for b in found)
        want[q] = ("unmatched", None, 0) if not found else ("ambiguous", None, len(found)) if apart else ("matched", found[0][3], len(found))
    assert {k for k, *_ in want.values()} == {"unmatched", "ambiguous", "matched"}
    got = K.match_courses(spark.createDataFrame(asked, "query_id long, name string, state string, city string, lat double, lng double"), spark.createDataFrame(courses, "id long, name string, state string, city string, lat double, lng double, aliases array<string>"))
    assert {r.query_id: (r.kind, r.course_id, r.candidates) for r in got.collect()} == want


def test_capped_selection_against_a_plain_walk(spark):
    import random

    draw = random.Random(3)
    rows = [(f"u{i}", f"h{draw.randrange(6)}", draw.randrange(3), i, draw.choice(["recheck", "search"]), draw.randrange(2)) for i in range(300)]
    queue = spark.createDataFrame(rows, "url string, host string, priority int, ord int, found_via string, needs_render int")
    most, per_host, renders = 40, 9, 7
    hosts, want, re, rn = {}, set(), 0, 0
    for url, host, _, _, via, render in sorted(rows, key=lambda r: (r[2], r[3])):
        if len(want) >= most or via == "recheck" and re >= int(0.4 * most) or hosts.get(host, 0) >= per_host or render and rn >= renders:
            continue
        want.add(url)
        hosts[host] = hosts.get(host, 0) + 1
        re, rn = re + (via == "recheck"), rn + render
    got = C.capped_selection(queue, most, per_host, renders).where("decision = 'fetch'").collect()
    assert {r.url for r in got} == want


def test_fnv1a(spark):
    got = spark.range(1).select(C.fnv1a(F.lit("")).alias("a"), C.fnv1a(F.lit("a")).alias("b"), C.fnv1a(F.lit("foobar")).alias("c")).first()
    assert (got.a, got.b, got.c) == (2166136261, 0xE40C292C, 0xBF9CF968)


def test_free_slugs(spark):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "base string, ord int")
    taken = spark.createDataFrame([("a",), ("a-3",)], "slug string")
    assert sorted((r.ord, r.slug) for r in S.free_slugs(wanted, taken).collect()) == [(1, "a-2"), (2, "a-4"), (3, "a-5"), (4, "b")]


def test_upsert_is_stable_without_changes(spark):
    snapshot = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, name string, v double")
    none = spark.createDataFrame([], "id int, op string, name string, v double, ord int")
    assert sorted(map(tuple, S.upsert(snapshot, none, "id", ["name"]).collect())) == [(1, "x", 1.0), (2, "y", 2.0)]


def test_rotation_covers_everything(spark):
    rows = spark.range(23)
    seen = pd.concat([C.rotation(rows, ["id"], 7, n).toPandas() for n in range(7)])
    assert sorted(seen["id"]) == list(range(23))
    window = [r.id for n in range(6) for r in C.rotating_window(rows, ["id"], 5, n).collect()]
    assert set(window) == set(range(23))
