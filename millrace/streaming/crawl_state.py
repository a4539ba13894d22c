"""State of a crawl with lifetimes of its own, kept by a stream: pages left alone for a week, held for thirty days, tried again the next day; robots files good for a day.

What happens depends on the events' own times only. A lifetime that has run out counts as over for any later event, whether or not its timer has fired yet; timers give
out what ran out and drop the state, so how events fall into batches changes nothing. Both operators need the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import HOLD_DAYS, RECENT_DAYS, TRIES

#: Hours that a robots file is good for; days until a page is tried again.
ROBOTS_HOURS, RETRY_DAYS = 24, 1
DONE = ("ok", "not_modified", "not_found", "gone")
#: Times in state and tasks are microseconds, which no session's zone touches.
_HOUR = 3600 * 10**6
_STATE = "recent bigint, held bigint, retry bigint, tries int"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _timer(handle: StatefulProcessorHandle, until: int | None) -> None:
    """One timer for a key, at the first whole millisecond by which ``until`` is over."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if until is not None:
        handle.registerTimer(-(-until // 1000))


def _run(processor: StatefulProcessor, events: DataFrame, key: str, late: str, schema: str) -> DataFrame:
    timed = events.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    return timed.groupBy(key).transformWithState(processor, schema, "append", "eventTime")


class _Pages(StatefulProcessor):
    """One URL's lifetimes: ``recent`` (left alone until), ``held`` (until), ``retry`` (tried again at) and tries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", _STATE)

    def _ran_out(self, url: str, s: dict, at: int) -> Iterator[Row]:
        """What ran out up to a time, in order."""
        over = sorted((s[name], name) for name in ("held", "recent", "retry") if s[name] is not None and s[name] <= at)
        for until, name in over:
            s[name] = None
            if name != "recent":
                yield Row(url=url, at=until, action={"held": "hold_over", "retry": "try_again"}[name], until=None)

    def _event(self, url: str, s: dict, e: Row) -> Row:
        row = lambda action, until=None: Row(url=url, at=e.micros, action=action, until=until)
        if e.what == "held":
            s["held"] = e.micros + HOLD_DAYS * 24 * _HOUR
            return row("held", s["held"])
        if e.what == "queued":
            for name in ("held", "retry", "recent"):
                if s[name] is not None and not (e.bypass and name == "recent"):
                    return row("wait", s[name])
            return row("fetch")
        if e.outcome in DONE:
            s["tries"], s["retry"], s["recent"] = 0, None, e.micros + RECENT_DAYS * 24 * _HOUR
            return row("done", s["recent"])
        s["tries"] += 1
        if s["tries"] >= TRIES:
            s["tries"], s["retry"] = 0, None
            return row("given_up")
        s["retry"] = e.micros + RETRY_DAYS * 24 * _HOUR
        return row("retry", s["retry"])

    def _load(self) -> dict:
        held = self.state.get() if self.state.exists() else (None, None, None, 0)
        return dict(zip(("recent", "held", "retry", "tries"), held, strict=True))

    def _store(self, s: dict) -> None:
        ends = [s[name] for name in ("recent", "held", "retry") if s[name] is not None]
        if ends or s["tries"]:
            self.state.update((s["recent"], s["held"], s["retry"], s["tries"]))
        else:
            self.state.clear()
        _timer(self.handle, min(ends, default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, out = self._load(), []
        for e in sorted(rows, key=lambda e: (e.micros, e.ord)):
            out += self._ran_out(key[0], s, e.micros)
            out.append(self._event(key[0], s, e))
        self._store(s)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load()
        out = list(self._ran_out(key[0], s, expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self._store(s)
        return iter(out)

    def close(self) -> None:
        pass


def page_states(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Decisions on pages (``url``, ``at``, ``action``, ``until``) as events come in.

    events: url, at, ord (the order of events of one time), what (queued, fetched or held), outcome of a fetch, bypass (of a queued page, the week's rest). A queued page is to be
    fetched unless it is held, waits for another try or was fetched within RECENT_DAYS. A fetch that failed is tried again a day later (``try_again``), TRIES times in all. Events that
    come later than ``late`` behind the newest are left out; null URLs too.
    """
    out = _run(_Pages(), events, "url", late, "url string, at bigint, action string, until bigint")
    return out.select("url", F.timestamp_micros("at").alias("at"), "action", F.timestamp_micros("until").alias("until"))


class _Robots(StatefulProcessor):
    """When an origin's robots file was last asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("robots", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until, out = (self.state.get()[0] if self.state.exists() else None), []
        for e in sorted(rows, key=lambda e: (e.micros, e.url)):
            known = until is not None and e.micros < until
            if not known:
                until = e.micros + ROBOTS_HOURS * _HOUR
            out.append(Row(origin=key[0], url=e.url, at=e.micros, action="known" if known else "read"))
        self.state.update((until,))
        _timer(self.handle, until)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def robots_reads(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Whether the robots file of each request's origin has to be read (``action`` read) or was read within ROBOTS_HOURS (known). requests: origin, url, at."""
    out = _run(_Robots(), requests, "origin", late, "origin string, url string, at bigint, action string")
    return out.select("origin", "url", F.timestamp_micros("at").alias("at"), "action")
