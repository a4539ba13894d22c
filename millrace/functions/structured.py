"""Events in a page's JSON-LD blocks. The blocks nest freely, so they are walked in Python, one Arrow batch at a time."""

from __future__ import annotations

import contextlib
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of lists, graphs and series that are opened.
DEEPEST = 6
_TYPE = "array<struct<name:string,start_date:string,start_time:string,location_name:string,location_address:string>>"


def _kinds(node: dict) -> set[str]:
    given = node.get("@type")
    return {re.split("[/#:]", k)[-1] for k in (given if isinstance(given, list) else [given]) if isinstance(k, str)}


def _text(value) -> str | None:
    while isinstance(value, list):
        value = value[0] if value else None
    return re.sub(r"\s+", " ", value).strip() or None if isinstance(value, str) else None


def events_in(value, level: int = 0) -> Iterator[dict]:
    """Event objects in document order, also those inside graphs, series and lists."""
    if level > DEEPEST:
        return
    if isinstance(value, list):
        for item in value:
            yield from events_in(item, level + 1)
    elif isinstance(value, dict):
        if any(k.endswith("Event") for k in _kinds(value)):
            yield value
        inner = [value["@graph"]] if isinstance(value.get("@graph"), list) else []
        inner += [value["subEvent"]] if "subEvent" in value else []
        listed = value.get("itemListElement")
        inner += [(e.get("item") or e) if isinstance(e, dict) else e for e in listed] if isinstance(listed, list) else []
        for item in inner:
            yield from events_in(item, level + 1)


def _place(value) -> tuple[str | None, str | None]:
    if isinstance(value, list):
        real = [v for v in value if isinstance(v, str) or isinstance(v, dict) and "VirtualLocation" not in _kinds(v)]
        value = (real or value or [None])[0]
    if isinstance(value, dict) and "VirtualLocation" not in _kinds(value):
        return _text(value.get("name")), _address(value.get("address"))
    return (_text(value), None) if isinstance(value, str) else (None, None)


def _address(value) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else None
    if not isinstance(value, dict):
        return _text(value)
    region = " ".join(filter(None, (_text(value.get("addressRegion")), _text(value.get("postalCode")))))
    return ", ".join(filter(None, (_text(value.get("streetAddress")), _text(value.get("addressLocality")), region))) or _text(value.get("name"))


def _start(value) -> tuple[str | None, str | None]:
    """Date and clock time as written; midnight in UTC is a date that was written as an instant."""
    text = _text(value) or ""
    found = re.match(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}))?", text)
    if not found:
        return None, None
    date, time = found.groups()
    return date, None if time == "00:00" and re.search(r"Z$|[+-]00:?00$", text) else time


def summaries(blocks: list[str] | None) -> list[tuple]:
    """Distinct summaries of all events in the blocks; blocks that are no JSON hold none."""
    found: dict[tuple, None] = {}
    for block in blocks if blocks is not None else []:
        try:
            parsed = json.loads(block)
        except ValueError:
            continue
        for event in events_in(parsed):
            found.setdefault((_text(event.get("name")), *_start(event.get("startDate")), *_place(event.get("location"))))
    return list(found)


def structured_events(blocks: Column) -> Column:
    """The events of a page's JSON-LD blocks (array of JSON texts)."""

    def run(given: pd.Series) -> pd.Series:
        names = ("name", "start_date", "start_time", "location_name", "location_address")
        return pd.Series([[dict(zip(names, e, strict=True)) for e in summaries(b)] for b in given])

    return F.pandas_udf(run, _TYPE)(blocks)


#: Keys that an extraction does not need, levels and list items that it keeps, levels that are searched, and events of a page.
DROPPED = ["image", "logo", "sameAs", "potentialAction", "@context"]
KEPT_LEVELS, KEPT_ITEMS, SEARCHED_LEVELS, MOST_EVENTS = 6, 20, 8, 10


def _slim(value, level: int = 0):
    if level > KEPT_LEVELS:
        return None
    if isinstance(value, dict):
        return {k: _slim(v, level + 1) for k, v in value.items() if k not in DROPPED}
    return [_slim(v, level + 1) for v in value[:KEPT_ITEMS]] if isinstance(value, list) else value


def _outermost(value, level: int = 0) -> Iterator[dict]:
    """Objects whose type ends in Event, at any depth that is searched; what is inside them is theirs."""
    if level <= SEARCHED_LEVELS and isinstance(value, (dict, list)):
        kinds = value.get("@type") if isinstance(value, dict) else None
        if any(isinstance(k, str) and k.endswith("Event") for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield value
        else:
            for inner in value.values() if isinstance(value, dict) else value:
                yield from _outermost(inner, level + 1)


def event_blocks(blocks: Column) -> Column:
    """The first events of a page's JSON-LD blocks (array of JSON texts), each as JSON without what an extraction does not need. Blocks that are no JSON hold none."""

    def of_page(texts) -> list[str]:
        parsed = []
        for text in texts if texts is not None else []:
            with contextlib.suppress(ValueError):
                parsed.append(json.loads(text))
        return [json.dumps(_slim(e), ensure_ascii=False, separators=(",", ":")) for e in itertools.islice(_outermost(parsed), MOST_EVENTS)]

    return F.pandas_udf(lambda given: pd.Series([of_page(b) for b in given]), "array<string>")(blocks)
