"""Streams with lifetimes against the same rules walked over all events at once, over several batches and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from millrace.streaming import crawl_state as C
from millrace.streaming import ingest as G
from pyspark.sql.types import StructType

BEGIN = datetime(2026, 1, 1)


def walked(events, end):
    """Decisions on pages with everything at hand; ``end``: up to when lifetimes are seen to run out."""
    out = []
    for url in {e[0] for e in events}:
        ends, tries = {}, 0

        def run_out(at, url=url, ends=ends):
            for until, name in sorted((t, n) for n, t in ends.items() if t <= at):
                del ends[name]
                if name != "recent":
                    out.append((url, until, {"held": "hold_over", "retry": "try_again"}[name], None))

        for _, at, _, what, outcome, bypass in sorted((e for e in events if e[0] == url), key=lambda e: (e[1], e[2])):
            run_out(at)
            if what == "held":
                ends["held"] = at + timedelta(days=30)
                out.append((url, at, "held", ends["held"]))
            elif what == "queued":
                waits = [ends[n] for n in ("held", "retry", "recent") if n in ends and not (n == "recent" and bypass)]
                out.append((url, at, "wait", waits[0]) if waits else (url, at, "fetch", None))
            elif outcome in ("ok", "not_found"):
                tries = 0
                ends.pop("retry", None)
                ends["recent"] = at + timedelta(days=7)
                out.append((url, at, "done", ends["recent"]))
            else:
                tries += 1
                ends.pop("retry", None)
                if tries == 3:
                    tries = 0
                    out.append((url, at, "given_up", None))
                else:
                    ends["retry"] = at + timedelta(days=1)
                    out.append((url, at, "retry", ends["retry"]))
        run_out(end)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield C.with_state_store(spark)
    spark.conf.set(key, before)


def test_pages_over_batches_and_restarts(stateful, tmp_path):
    spark, draw = stateful, random.Random(1)
    days = sorted(draw.random() * 90 for _ in range(160))
    events = [(f"u{draw.randrange(6)}", BEGIN + timedelta(seconds=int(d * 86400)), i, draw.choice(["queued", "queued", "fetched", "fetched", "held"] if i % 4 else ["queued", "fetched"]), draw.choice(["ok", "not_found", "error", "error"]), draw.random() < 0.2) for i, d in enumerate(days)]
    events.append(("last", BEGIN + timedelta(days=200), 999, "queued", None, False))
    schema = "url string, at timestamp, ord int, what string, outcome string, bypass boolean"
    frame = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    parts = [events[:50], events[50:60], events[60:130], events[130:160], events[160:], [("after", BEGIN + timedelta(days=201), 1000, "queued", None, False)]]
    for i, part in enumerate(parts):  # the stream stops and starts again for each
        frame(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = G.stream_of(spark, str(tmp_path / "in"), StructType.fromDDL(schema))
        G.run_once(C.page_states(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        if i == 3:
            size = state_rows(spark, tmp_path)
            assert size > 0
    got = sorted(((r.url, r.at, r.action, r.until) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    everything = events + parts[-1]
    assert got == walked(everything, BEGIN + timedelta(days=199))
    assert {a for _, _, a, _ in got} == {"fetch", "wait", "held", "done", "retry", "given_up", "hold_over", "try_again"}
    # all that ran out has left; a page that failed keeps its number of tries
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "page").load()
    assert all(r.value.tries > 0 for r in left.collect())


def state_rows(spark, tmp_path):
    return spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "page").load().count()


def test_robots_are_read_once_a_day(stateful, tmp_path):
    spark, draw = stateful, random.Random(2)
    times = sorted(BEGIN + timedelta(minutes=draw.randrange(6 * 24 * 60)) for _ in range(80))
    requests = [(f"https://h{draw.randrange(3)}.org", f"/p/{i}", at) for i, at in enumerate(times)]
    expected, until = [], {}
    for origin, url, at in requests:
        known = origin in until and at < until[origin]
        if not known:
            until[origin] = at + timedelta(hours=24)
        expected.append((origin, url, at, "known" if known else "read"))
    for part in (requests[:30], requests[30:31], requests[31:]):
        spark.createDataFrame(part, "origin string, url string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = G.stream_of(spark, str(tmp_path / "in"), StructType.fromDDL("origin string, url string, at timestamp"))
        G.run_once(C.robots_reads(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("origin", "url", "at", "action").collect()]
    assert sorted(got) == sorted(expected) and {a for *_, a in got} == {"read", "known"}
