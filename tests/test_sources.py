"""Readers, sinks, streams and content rules over small files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import content as C
from millrace.sources import readers as R
from millrace.sources import sinks as S
from millrace.streaming import ingest as G


def test_register(spark, tmp_path):
    one = tmp_path / "a.csv"
    one.write_text('NAME,EIN,CITY,STATE,SUBSECTION,SORT_NAME\n"Fund, ""Big""\nof X",123,Rye,ny,3,\nNAME,EIN,CITY,STATE,SUBSECTION,SORT_NAME\n,77,Rye,NY,3,\n')
    two = tmp_path / "b.csv"
    two.write_text("EIN,NAME,CITY,STATE,SUBSECTION,SORT_NAME,OTHER\n000000123,Later,Rye,NY,3,,z\n45,Other,Troy,NY,06,SORT,z\n")
    good, bad = R.read_register(spark, [str(one), str(two)])
    assert sorted(tuple(r) for r in good.select("ein", "name", "state", "subsection", "sort_name").collect()) == [("000000045", "Other", "NY", "06", "SORT"), ("000000123", 'Fund, "Big"\nof X', "NY", "03", None)]
    assert bad.count() == 2


def test_places(spark, tmp_path):
    def city(name, state, lat, population):
        cells = ["1", name, name, "", lat, "-74.0", "P", "PPL", "US", "", state, "", "", "", population, "", "", "America/New_York", ""]
        return "\t".join(cells)

    path = tmp_path / "cities.txt"
    path.write_text("\n".join([city("Rye", "NY", "41.0", "100"), city("Rye", "NY", "41.5", "900"), city('Le"x', "NJ", "40.0", "x"), city("Bad", "NY", "north", "5")]))
    rows = {(r.name, r.lat, r.population) for r in R.read_cities(spark, str(path)).collect()}
    assert rows == {("Rye", 41.5, 900), ('Le"x', 40.0, 0)}
    assert R.read_cities(spark, str(path), ["NJ"]).count() == 1
    postal = tmp_path / "zips.txt"
    postal.write_text("US\t10580\tRye\tNew York\tNY\t\t\t\t\t41.0\t-73.7\t4\nUS\t1058\tRye\tNew York\tNY\t\t\t\t\t41.0\t-73.7\t4\n")
    assert [r.zip for r in R.read_postal_codes(spark, str(postal)).collect()] == ["10580"]


def test_archives_and_bodies(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("x/US.txt", "hello")
        archive.writestr("readme", "no")
    (tmp_path / "p.zip").write_bytes(data.getvalue())
    row = R.zip_entries(spark, str(tmp_path / "p.zip"), ".txt").first()
    assert (row.entry, bytes(row.content)) == ("x/US.txt", b"hello")
    bodies = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (bytearray("é".encode()), None), (bytearray(b'<meta charset="latin1">' + "é".encode("latin-1")), "text/html")], "b binary, t string")
    assert [r.x[-1] for r in bodies.select(R.decoded_body(F.col("b"), F.col("t")).alias("x")).collect()] == ["é"] * 3


def test_search_answers(spark):
    text = '{"tasks":[{"result":[{"items":[{"type":"organic","rank_group":1,"url":"https://a.example","title":"A"},{"type":"paid","url":"https://b.example"}]}]}]}'
    df = spark.createDataFrame([("q", text), ("bad", "no json")], "query string, json string")
    assert [tuple(r) for r in R.search_results(df).collect()] == [("q", 1, "https://a.example", "A", None)]


def test_newest_month():
    assert R.newest_month(["2026-01", "2026-03", "2026-09"], "2026-05") == "2026-03"
    assert R.newest_month([], "2026-05") is None


def test_inserts(spark):
    df = spark.createDataFrame([(i, "it's" if i else None) for i in range(7)], "id int, name string")
    found = [r.statement for r in S.insert_statements(df, "t", ["id"], per_statement=3, buckets=1).collect()]
    assert len(found) == 3 and sum(x.count("(") - 1 for x in found) == 7
    assert any("(0, NULL)" in x for x in found) and any("'it''s'" in x for x in found)


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert S.markdown_table(df, ["n"]) == "| n | t |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |"


def test_snapshot_round_trip(spark, tmp_path):
    S.write_snapshot(spark.range(5).withColumn("k", F.col("id") % 2), str(tmp_path / "s"), ["k"])
    assert spark.read.parquet(str(tmp_path / "s")).where("k = 1").count() == 2


def test_streams(spark, tmp_path):
    rows = [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-02 00:00:00"), ("u2", "2024-01-02 01:00:00")]
    df = spark.createDataFrame(rows, "url string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = G.stream_of(spark, str(tmp_path / "in"), df.schema)
        G.run_once(G.first_seen(stream, ["url"], "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]
    late = df.unionByName(spark.createDataFrame([("u3", "2024-03-01 00:00:00")], "url string, at string").withColumn("at", F.col("at").cast("timestamp")))
    late.write.parquet(str(tmp_path / "in2"))
    counts = G.hourly_counts(G.stream_of(spark, str(tmp_path / "in2"), late.schema, files_per_batch=100), "at", "url")
    G.run_once(counts, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() >= 3


def test_robots(spark):
    text = "User-agent: OurBot/2.0\nUser-agent: x\nDisallow: /private\nAllow: /private/open$\nCrawl-delay: 90\n\nUser-agent: *\nDisallow: /\n"
    rules = C.robots_rules(spark.createDataFrame([("h", text), ("i", "User-agent: *\nDisallow:\n")], "host string, text string"), "ourbot")
    assert {r.crawl_delay for r in rules.collect()} == {30.0}
    pages = spark.createDataFrame([(1, "h", "/private/a"), (2, "h", "/private/open"), (3, "h", "/private/open/x"), (4, "h", "/"), (5, "i", "/any"), (6, "none", "/")], "page_id int, host string, path string")
    assert {r.page_id: r.allowed for r in C.robots_allowed(pages, rules).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_guides(spark):
    body = "# Top\n\n## Fine\n```\n# in a fence\n<b>\n```\nTitle\n=====\ntext <br/> ![x](y)\n#### deep"
    got = {(r.line, r.problem) for r in C.guide_problems(spark.createDataFrame([(1, body)], "guide_id int, body string")).collect()}
    assert got == {(1, "heading level 1; use ## or ###"), (9, "setext H1 heading; use ##"), (10, "raw HTML"), (10, "image"), (11, "heading level 4; use ## or ###")}
    df = spark.createDataFrame([('---\ntitle: "A b"\ndraft: true\n---\nBody [link](x) here',), ("none",)], "t string")
    rows = df.select(C.front_matter(F.col("t")).alias("f"), C.guide_words(F.col("t")).alias("n")).collect()
    assert rows[0].f.data == {"title": "A b", "draft": "true"} and rows[0].f.body == "Body [link](x) here" and rows[1].f is None and rows[1].n == 1


def test_aliases_and_about_links(spark):
    df = spark.createDataFrame([("Oak", ["Old Oak"], ["old oak", "OAK", "New Oak"])], "n string, k array<string>, m array<string>")
    assert df.select(C.merged_aliases(F.col("n"), F.col("k"), F.col("m")).alias("x")).first().x == ["Old Oak", "New Oak"]
    html = '<a href="/rates">Rates</a><a href="https://other.example/join">Join</a><a href="/about.pdf">About</a><a href="/our-club">The story</a>'
    pages = spark.createDataFrame([(1, "https://www.oak.example/", html)], "page_id int, url string, html string")
    assert C.about_links(pages).first().href == "/our-club"


@pytest.mark.parametrize("body, yes", [("<html><title>Just a moment...</title>", True), ("just a moment", False), ("<html>fine</html>", False)])
def test_challenges(spark, body, yes):
    assert spark.createDataFrame([(body,)], "b string").select(C.is_challenge(F.col("b")).alias("x")).first().x is yes


def test_overrides(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "exclusions.yaml").write_text("# none yet\ndomains: []\nurl_patterns:\n  - https://x.org/*\n")
    (tmp_path / "platforms.yaml").write_text("platforms:\n  - domain: a.org\n    allowed: true\n    terms_checked: 2026-01-02\n  - domain: b.org\n    allowed: false\n")
    got = {(r.file, r.list, r.ord): r.entry for r in R.read_overrides(spark, str(tmp_path)).collect()}
    assert got == {("exclusions", "url_patterns", 0): {"value": "https://x.org/*"}, ("platforms", "platforms", 0): {"domain": "a.org", "allowed": "true", "terms_checked": "2026-01-02"}, ("platforms", "platforms", 1): {"domain": "b.org", "allowed": "false"}}
    for name, text, said in (("platforms", "platforms:\n  - domain: a.org\n    allowed: true\n", "terms"), ("removals", "pages: []\n", "none of its lists"), ("surprise", "x: []\n", "no such")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / f"{name}.yaml").write_text(text)
        with pytest.raises(ValueError, match=said):
            R.read_overrides(spark, str(folder))
