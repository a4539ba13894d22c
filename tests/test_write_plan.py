"""The plan of a run against a walk over its events, one after the other; the next state; a second run that changes nothing; publication."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import linkage as K
from millrace.operators import similar
from millrace.operators import write_plan as W

NAMES = ["Kidney Fund of Troy", "Kidney Fund of Troys", "Heart Circle", "Rotary Club of Phoenix", "Lions Club of Phoenix", "Elks Lodge 12", None]
TITLES = ["Golf Outing", "2026 Golf Outing", "Heart Circle Scramble", "Rotary Golf Day", "Lions Golf Day at Oak Hill Golf Club", "Golf Day"]
EVENT = "event_id long, ord long, source_id long, url string, kind string, domain string, excluded boolean, hold_reason string, confidence double, course_id long, course_name string, start_date string, end_date string, organizer string, ein string, title string, outing_type string, shotgun_time string, format string, single_price_cents long, status string"
OUTING = "id long, slug string, course_id long, published int, organizer_id long, title string, outing_type string, start_date string, end_date string, shotgun_time string, format string, single_price_cents long, status string, expected_month string, canonical_source_url string, source_gone int, confidence double, hold_reason string"
listing = lambda u: u.contains("/list")
domain = lambda u: F.regexp_extract(u, r"//([^/]+)/", 1)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similar_texts_are_all_pairs(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab ") for _ in range(draw.randrange(1, 30))) for _ in range(150)]
    texts += [t[:-1] for t in texts[:40]] + ["x" + t for t in texts[:40]] + ["", "a", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    for least in (0.8, 0.92):
        expected = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and 1 - lev(a, b) / max(len(a), len(b)) >= least}
        assert {tuple(r) for r in similar.similar_texts(df, df.withColumnRenamed("a", "b"), least).collect()} == expected


def world(seed):
    draw = random.Random(seed)
    organizers = [(1, "heart-circle", "Heart Circle", None), (2, "kidney-fund-of-troy", "Kidney Fund of Troy", "111"), (3, "elks", "Elks", "999")]
    days = ["2026-05-01", "2026-05-02", "2026-06-10"]
    outings = []
    for i in range(1, 25):
        expected = draw.random() < 0.3
        day = draw.choice(days)
        outings.append((i, f"2026/event-{i}", draw.randrange(2), 1, draw.choice([1, 2, 3, None]), draw.choice(TITLES), "charity", None if expected else day, None, draw.choice([None, "08:00"]), None, 100, "expected" if expected else "open", day[:7] if expected else None, f"https://d{i % 3}.org/{draw.choice(['e', 'list'])}/{i}", 0, 0.8, draw.choice([None, "removed"])))
    outings.append((25, "2026/golf-outing-oak-hill", 9, 1, None, "x", "charity", "2020-01-01", None, None, None, None, "past", None, "https://d1.org/e/0", 0, 0.8, None))
    events = []
    for i in range(60):
        events.append((i, draw.randrange(10), draw.randrange(20), f"https://d{i % 4}.org/{draw.choice(['e', 'list'])}/{i}", draw.choice(["organizer", "listing", "search"]), f"d{i % 4}.org", i % 13 == 0, draw.choice([None, None, None, "low_confidence", "no_date"]), draw.randrange(4, 9) / 8, draw.choice([0, 1, 1, 0, 2, None]), "Oak Hill Golf Club", draw.choice([*days, None]), draw.choice([None, "2026-05-02"]), draw.choice(NAMES), draw.choice([None, None, "111", "222", "333"]), draw.choice(TITLES), "charity", draw.choice([None, "09:00"]), draw.choice([None, "scramble"]), draw.choice([None, 5000]), draw.choice(["open", "unknown", "sold_out"])))
    links = [(draw.randrange(20), o[0]) for o in outings for _ in range(2)]
    return organizers, outings, events, sorted(set(links))


def tables_of(spark, seed):
    organizers, outings, events, links = world(seed)
    sources = spark.createDataFrame([(i, "no_date" if i % 2 else None, "kept") for i in range(20)], "id long, hold_reason string, error string")
    tables = W.Tables(spark.createDataFrame(organizers, "id long, slug string, name string, ein string"), spark.createDataFrame(outings, OUTING), spark.createDataFrame(links, "source_id long, outing_id long"), sources)
    return tables, W.unmatched_holds(spark.createDataFrame(events, EVENT)), spark.createDataFrame([(i,) for i in range(18)], "source_id long")


def walk(spark, seed, tables):
    """The run as a program would do it, event by event."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    events = [dict(zip(names, e, strict=True)) for e in world(seed)[2]]
    stored, known = ([r.asDict() for r in df.orderBy("id").collect()] for df in (tables.outings, tables.organizers))
    every = sorted({x for x in [*NAMES, *(k["name"] for k in known)] if x})
    df = spark.createDataFrame([(a, b) for a in every for b in every], "a string, b string")
    alike = {(r.a, r.b) for r in df.where(T.token_set_similarity(F.col("a"), F.col("b")) >= 0.92).collect()}
    both = {(n, t) for n in [*NAMES, *(k["name"] for k in known)] for t in [*TITLES, "x"]}
    pairs = spark.createDataFrame([(*a, *b) for a in both for b in both], "oa string, ta string, ob string, tb string")
    same = {((r.oa, r.ta), (r.ob, r.tb)) for r in pairs.where(K.same_outing(K.prepared(F.col("oa"), F.col("ta")), K.prepared(F.col("ob"), F.col("tb")))).collect()}
    slug_of = {t: r.s for t in TITLES for r in spark.createDataFrame([(t, "Oak Hill Golf Club")], "t string, c string").select(T.kebab(F.regexp_replace(T.slug_title(F.col("t"), F.col("c")), r"\b2026\b", " ")).alias("s")).collect()}

    outcomes, live = {}, []
    for e in events:
        if e["hold_reason"] is None and e["course_id"] is None and not e["excluded"]:
            e["hold_reason"] = "course_unmatched"
        if e["excluded"]:
            outcomes[e["event_id"]] = ("excluded", None, None)
        else:
            live.append(e)
    active = []
    of = lambda u: u.split("/")[2]
    for e in live:
        at = (e["course_id"], e["start_date"])
        backed = None not in at and e["hold_reason"] == "low_confidence" and (
            any((o["course_id"], o["start_date"]) == at and o["domain"] != e["domain"] and o["hold_reason"] in (None, "low_confidence") for o in live) or any((x["course_id"], x["start_date"]) == at and x["status"] != "expected" and of(x["canonical_source_url"]) != e["domain"] for x in stored))
        if (e["hold_reason"] is None or backed) and None not in at:
            active.append(e | {"confidence": max(e["confidence"], 0.75) if backed else e["confidence"]})
        else:
            outcomes[e["event_id"]] = ("held", None, e["hold_reason"] or ("no_date" if e["course_id"] is not None else "course_unmatched"))
    rank = {"organizer": 0, "listing": 1, "search": 2}
    clusters = []
    for e in sorted(active, key=lambda e: (rank[e["kind"]], -e["confidence"], e["ord"], e["event_id"])):
        home = next((c for c in clusters if (c[0]["course_id"], c[0]["start_date"]) == (e["course_id"], e["start_date"]) and ((c[0]["organizer"], c[0]["title"]), (e["organizer"], e["title"])) in same), None)
        clusters.append([e]) if home is None else home.append(e)
    added, rows, links, claimed, new = [], {}, set(), set(), []
    name_of = {k["id"]: k["name"] for k in known}
    slugs, taken = {k["slug"] for k in known}, {x["slug"] for x in stored}

    def free(base, held):
        slug = next(s for s in [base, *(f"{base}-{n}" for n in range(2, 99))] if s not in held)
        held.add(slug)
        return slug

    for c in clusters:
        top, organizer = c[0], None
        if top["organizer"] is not None:
            everyone = known + added
            found = next((o for o in everyone if top["ein"] and o["ein"] == top["ein"]), None) or next((o for o in everyone if (o["name"], top["organizer"]) in alike), None)
            if found is None:
                found = {"id": max(k["id"] for k in known) + len(added) + 1, "slug": free(top["organizer"].lower().replace(" ", "-"), slugs), "name": top["organizer"], "ein": top["ein"]}
                added.append(found)
            organizer = found["id"]
        first = lambda f, c=c: next((e[f] for e in c if e[f] is not None), None)
        pool = [e for e in c if "/list" not in e["url"]] or c
        own = next((e for e in pool if e["kind"] == "organizer"), None)
        url = (own or pool[0])["url"]
        end = first("end_date")
        merged = {"title": top["title"], "outing_type": top["outing_type"], "start_date": top["start_date"], "end_date": end if end and end >= top["start_date"] else None, "status": "open" if top["status"] == "unknown" else top["status"], "confidence": max(e["confidence"] for e in c)} | {f: first(f) for f in ("shotgun_time", "format", "single_price_cents")}
        months = lambda m: int(m[:4]) * 12 + int(m[5:7])
        free_rows = [x for x in stored if x["id"] not in claimed and x["course_id"] == top["course_id"]]
        x = next((x for x in free_rows if x["status"] != "expected" and x["start_date"] == top["start_date"] and (((name_of.get(x["organizer_id"]), x["title"]), (top["organizer"], top["title"])) in same or organizer is not None and x["organizer_id"] == organizer)), None)
        x = x or next((x for x in free_rows if x["status"] == "expected" and organizer is not None and x["organizer_id"] == organizer and abs(months(x["expected_month"]) - months(top["start_date"])) <= 1), None)
        if x:
            claimed.add(x["id"])
            confirming = x["status"] == "expected"
            action = "confirm_expected" if confirming else "update"
            move = own or confirming or "/list" in x["canonical_source_url"] and "/list" not in url
            row = x | merged | {"organizer_id": x["organizer_id"] or organizer, "expected_month": None, "source_gone": 0, "canonical_source_url": url if move else x["canonical_source_url"], "hold_reason": "removed" if x["hold_reason"] == "removed" else None}
            row["shotgun_time"] = merged["shotgun_time"] or (None if confirming else x["shotgun_time"])
            for f in ("format", "single_price_cents"):
                row[f] = merged[f] if merged[f] is not None else x[f]
            if row != x:
                rows[x["id"]] = ("update", row)
            number = x["id"]
        else:
            action, number = "insert", max((x["id"] for x in stored), default=0) + len(new) + 1
            row = {"id": number, "slug": free(f"2026/{slug_of[top['title']]}-oak-hill", taken), "course_id": top["course_id"], "published": 0, "organizer_id": organizer, **merged, "expected_month": None, "canonical_source_url": url, "source_gone": 0, "hold_reason": None}
            new.append(row)
            rows[number] = ("insert", row)
        for i, e in enumerate(c):
            outcomes[e["event_id"]] = ("merge" if i else action, number, None)
            links.add((e["source_id"], number))
    return added, rows, links, outcomes


def check(spark, seed, tables, events, collected):
    plan = W.write_plan(events, tables, collected, listing, domain)
    added, rows, links, outcomes = walk(spark, seed, tables)
    assert sorted(map(tuple, plan.organizers.collect())) == sorted((o["id"], o["slug"], o["name"], o["ein"]) for o in added)
    assert {r.event_id: (r.action, r.outing_id, r.hold_reason) for r in plan.outcomes.collect()} == outcomes
    changed = plan.outings.collect()
    assert {r.id: (r.op, {k: v for k, v in r.asDict().items() if k != "op"}) for r in changed if r.op != "retract"} == rows
    by_outing, stored = {}, {r.id: r for r in tables.outings.collect()}
    for r in tables.links.collect():
        by_outing.setdefault(r.outing_id, set()).add(r.source_id)
    produced = {o for _, o, _ in outcomes.values() if o}
    assert {r.id for r in changed if r.op == "retract"} == {i for i, s in by_outing.items() if max(s) < 18 and i not in produced and stored[i].status in W.DATED and stored[i].confidence}
    assert {tuple(r) for r in plan.links.collect()} == links - {tuple(r) for r in tables.links.collect()}
    after = W.applied(tables, plan)
    assert {r.id: r.title for r in after.outings.collect()} == {i: r.title for i, r in stored.items()} | {i: r["title"] for i, (_, r) in rows.items()}
    return after, {a for a, _, _ in outcomes.values()}, plan


def test_plan_follows_the_walk(spark):
    tables, events, collected = tables_of(spark, 1)
    _, actions, _ = check(spark, 1, tables, events, collected)
    assert {"excluded", "held", "insert", "update", "merge"} <= actions


def test_a_second_run_changes_nothing(spark):
    tables, events, collected = tables_of(spark, 2)
    after, _, plan = check(spark, 2, tables._replace(outings=tables.outings.limit(0), links=tables.links.limit(0)), events, collected)
    assert not any(getattr(plan, name).isEmpty() for name in ("organizers", "outings", "links", "sources"))
    again = W.write_plan(events, after, collected, listing, domain)
    assert all(getattr(again, name).isEmpty() for name in ("organizers", "outings", "links", "sources"))


def test_an_empty_run(spark):
    tables, events, collected = tables_of(spark, 1)
    plan = W.write_plan(events.limit(0), tables, collected.limit(0), listing, domain)
    assert all(x.isEmpty() for x in plan)
