"""Expectations of the scalar functions, at the edges that the tables do not reach."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import html as H
from millrace.functions import money as M
from millrace.functions import text as T
from millrace.functions import urls as U


def ask(spark, expression, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize("given, slug", [("Winged Foot Golf Club", "winged-foot-golf-club"), ("Château Élan & Spa", "chateau-elan-and-spa"), ("  St. John's  ", "st-johns"), ("", ""), ("---", ""), (None, None)])
def test_kebab(spark, given, slug):
    assert ask(spark, T.kebab(F.col("t")), t=given) == slug


def test_short_slug_keeps_all_words_when_all_are_common(spark):
    assert ask(spark, T.short_slug(F.col("t")), t="The Links") == "the-links"
    long = ask(spark, T.short_slug(F.col("t")), t="Very Long Winding Name of a Place with Many Trees and Hills")
    assert len(long) <= 40 and not long.endswith("-") and "very-long" in long


@pytest.mark.parametrize("a, b, score", [("National Kidney Foundation Inc.", "The Kidney Foundation, National", 1.0), ("A & B", "A and B LLC", 1.0), ("", "x", 0.0), ("The Of", "Of The", 1.0)])
def test_token_set_similarity(spark, a, b, score):
    assert ask(spark, T.token_set_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


def test_course_names(spark):
    assert ask(spark, T.course_name_variants(F.col("t")), t="Medinah Country Club (No. 3)") == ["medinah no 3", "medinah"]
    assert ask(spark, T.course_name(F.col("t")), t="Old C.C. of the G.C. Links") == "old of"
    assert ask(spark, T.city_name(F.col("t")), t="St. Paul") == "saint paul"


def test_title_key_keeps_repeated_words(spark):
    key = T.title_key(F.col("t"), F.col("o"))
    assert ask(spark, key, t="2026 Twenty-First Annual Golf golf Outing by William Paterson", o="William Paterson University") == "golf golf outing by"


@pytest.mark.parametrize("title, watched", [("U.S. Open", True), ("U.S. Open Watch Party Scramble", False), ("Thursday League", True), ("Spring Gala", True), ("Gala Golf Outing", False)])
def test_not_playable(spark, title, watched):
    assert ask(spark, T.is_not_playable(F.col("t")), t=title) is watched


@pytest.mark.parametrize("text, yes", [("charity-golf-outing", True), ("mini golf tournament", False), ("golf lesson outing", False), ("golf", False)])
def test_outing_text(spark, text, yes):
    assert ask(spark, T.is_outing_text(F.col("t")), t=text) is yes


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.COM:443/a?utm_source=x&b=1#top", "https://example.com/a?b=1"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com/?UTM_medium=y&fbclid=1", "http://example.com/"),
        ("ftp://example.com/", None),
        ("http://user:pw@example.com/", None),
        ("http://localhost/", None),
        ("http://example.com./x", "http://example.com/x"),
        ("http://example.com:8080/x", "http://example.com:8080/x"),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert ask(spark, U.normalize(F.col("t")), t=url) == want


@pytest.mark.parametrize("host, want", [("support.kidney.org", "kidney.org"), ("www.lausd.k12.ca.us", "lausd.k12.ca.us"), ("a.b.co.uk", "b.co.uk"), ("x.city.ca.us", "city.ca.us"), ("org", "org")])
def test_domain(spark, host, want):
    assert ask(spark, U.domain(F.col("t")), t=host) == want


def test_money(spark):
    assert ask(spark, M.dollars_to_cents(F.col("v")), v=150.005) == 15001
    assert ask(spark, M.format_usd(F.col("v")), v=123456789) == "$1,234,567.89"
    assert ask(spark, M.format_usd(F.col("v")), v=-12500) == "-$125"
    for text, cents in (("$1,250.5", 125050), ("USD 12", 1200), ("12.345", None), ("1,25", None), ("", None)):
        assert ask(spark, M.parse_usd(F.col("t")), t=text) == cents


def test_wall_times_in_the_gap_and_the_overlap(spark):
    at = lambda day, time: str(ask(spark, D.wall_time_to_utc(F.col("d"), F.col("t"), F.lit("America/New_York")).cast("string"), d=day, t=time))
    assert at("2026-03-08", "02:30") == "2026-03-08 06:30:00"
    assert at("2026-11-01", "01:30") == "2026-11-01 05:30:00"


def test_html(spark):
    page = '<title>A &amp; B</title><nav>no</nav><script>var x="</p>";</script><p>yes&nbsp;<a href="/x?a=1&amp;b=2">go <b>on</b></a></p><script type="application/ld+json"><![CDATA[{"a":1}]]></script>'
    assert ask(spark, H.title(F.col("t")), t=page) == "A & B"
    assert ask(spark, H.main_text(F.col("t")), t=page) == "A & B yes go on"
    assert [tuple(x) for x in ask(spark, H.links(F.col("t")), t=page)] == [("/x?a=1&b=2", "go on")]
    assert ask(spark, H.json_ld(F.col("t")), t=page) == ['{"a":1}']
    xml = "<sitemapindex><sitemap><loc> https://a.example/s.xml </loc></sitemap></sitemapindex>"
    assert ask(spark, H.sitemap_addresses(F.col("t")), t=xml) == ["https://a.example/s.xml"]
    assert ask(spark, H.is_sitemap_index(F.col("t")), t=xml) is True


def test_ulids(spark):
    import hashlib

    from millrace.functions import ids

    letters = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

    def plain(number, length):
        return "".join(letters[number >> 5 * i & 31] for i in reversed(range(length)))

    key = int.from_bytes(hashlib.sha256(b"crs:x/y").digest()[:10], "big")
    want = "crs_" + plain(1_790_000_000_123, 10) + plain(key, 16)
    got = spark.createDataFrame([("x/y", 1_790_000_000_123)], "k string, t long").select(ids.stable_id("crs", F.col("t"), F.col("k")).alias("a"), ids.source_id(F.col("k")).alias("b"), ids.is_ulid(F.lit(want[4:])).alias("c"), ids.is_ulid(F.lit("I" * 26)).alias("d")).first()
    assert got.a == want and got.b == "src_" + hashlib.sha256(b"source:x/y").hexdigest()[:40] and got.c and not got.d


def test_structured_events(spark):
    import json

    from millrace.functions.structured import structured_events

    place = {"@type": "Place", "name": "Oak  Hill", "address": {"streetAddress": "1 A St", "addressLocality": "Rye", "addressRegion": "NY", "postalCode": "10580"}}
    one = {"@type": "SportsEvent", "name": "Cup", "startDate": "2026-05-01T08:30:00-04:00", "location": [{"@type": "VirtualLocation"}, place]}
    two = {"@type": ["Event"], "name": "Day", "startDate": "2026-06-01T00:00:00Z", "location": "Town hall"}
    blocks = [json.dumps({"@graph": [one, {"@type": "EventSeries", "subEvent": two}]}), "not json", json.dumps({"@type": "ItemList", "itemListElement": [{"item": two}]})]
    rows = spark.createDataFrame([(blocks,), (None,), ([],)], "b array<string>").select(structured_events(F.col("b")).alias("e")).collect()
    assert [tuple(e) for e in rows[0].e] == [("Cup", "2026-05-01", "08:30", "Oak Hill", "1 A St, Rye, NY 10580"), ("Day", "2026-06-01", None, "Town hall", None)]
    assert rows[1].e == rows[2].e == []


def test_zones_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([("2026-03-08", "02:30"), ("2026-07-01", "00:15")], "d string, t string")
    asked = lambda: [tuple(r) for r in rows.select(F.unix_seconds(D.wall_time_to_utc(F.col("d"), F.col("t"), F.lit("America/New_York"))), D.local_today(F.timestamp_seconds(F.lit(1_772_000_000)), F.lit("America/New_York")), D.zoned_iso(F.col("d"), F.col("t"), F.lit("America/Chicago"))).collect()]
    want = asked()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert asked() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_slug_titles(spark):
    rows = [("NKF Golf Classic at Winged Foot Golf Club", "Winged Foot Golf Club"), ("Day at Oak Hill", "Pine Valley"), ("The Pine Valley Open", "Pine Valley"), ("Pine Valley", "Pine Valley")]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(T.slug_title(F.col("t"), F.col("c"))).collect()] == ["NKF Golf Classic", "Day at Oak Hill", "The   Open", "Pine Valley"]


def test_blocks_and_dense_text(spark):
    lines = "<ul><li>One<ul><li>Two <b>bo</b>ld</li></ul></li></ul><p hidden>Panel&nbsp;text<br>next</p><!-- gone --><script>x()</script>"
    assert ask(spark, H.block_text(F.col("t")), t=lines) == "OneTwo bold\n\nPanel text\nnext"
    said = " ".join(f"word{i}" for i in range(60))
    side = "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(30))
    page = f"<html><body><nav>{side}</nav><div><div><ul>{side}</ul></div><div>{said}.</div><div aria-hidden='true'><p>{said} more</p></div><table><tr><td>{said} table</td></tr></table></div><footer>All rights</footer></body></html>"
    assert ask(spark, H.dense_text(F.col("t")), t=page) == f"{said}.\n{said} more\n{said} table"
    assert ask(spark, H.dense_text(F.col("t")), t="<p>Short</p><nav>x</nav>") == "Short"
    for empty in (None, "", "<body></body>"):
        assert not ask(spark, H.dense_text(F.col("t")), t=empty)


@pytest.mark.parametrize("address, blocked", [("2600:1:2", True), ("2600::1:2", False), ("2600:1:2:3:4:5:6:7", False), ("2600:1:2:3:4:5:6:7:8", True), ("2600::1::2", True), ("2600:::2", True), ("2600:1:2:3:4:5:6:", True), ("fe80::1", True), ("[2606:4700::1111]", False)])
def test_ipv6_addresses(spark, address, blocked):
    from millrace.operators import content as C

    assert ask(spark, C.is_blocked_address(F.col("t")), t=address) is blocked
