"""Cases that a review found: each failed on the code before it."""

import corpus_pipeline
import duckdb
import numpy as np
import oracle
import pyarrow as pa
from conftest import DATA
from millrace.functions import extraction as E
from millrace.functions import urls as U
from millrace.llm import jaccard as J
from millrace.operators import linkage as K
from millrace.plans import registry
from pyspark.sql import functions as F

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_titles_are_those_of_the_sql(spark, tmp_path):
    pages = ["<title> a &quot;b&quot; &amp; c</title>", "<title>a\nb</title>", "<TITLE>x</TITLE>", "<title lang='x'>y</title>", None, "<title>\tq </title>", "<title>a&amp;amp;</title><title>b</title>", "<title>a\rb\u2028</title>", "no title"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert oracle.difference(spark, con, str(tmp_path), QUERIES["html_titles"], SQL["html_titles"]) == ""


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_register_look_ups_deal_by_key(spark):
    assert broadcasts(QUERIES["register_candidates"](spark, DATA)) == 0


def test_register_matches_deal_by_key(spark):
    assert broadcasts(QUERIES["register_match"](spark, DATA)) == 0


def test_distances_of_facilities_are_those_of_places(spark):
    """Courses are joined to pairs of near places; no distance is worked out for each pair of courses."""
    plan = QUERIES["facility_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ASIN" not in plan and "SIN(" not in plan


def test_venues_of_one_name_and_city_answer_once(spark, monkeypatch):
    rows, keep = [], K.keep
    monkeypatch.setattr(K, "keep", lambda df: rows.append(keep(df)) or rows[-1])
    venue = "id long, name string, state string, city string, lat double, lng double, aliases array<string>"
    courses = spark.createDataFrame([(i, "Pine Hollow", "NY", "Rye", 41.0, -73.7 + (i % 2) * 0.01, ["Old Pine Hollow"]) for i in range(30)], venue)
    asked = courses.drop("aliases").withColumnRenamed("id", "query_id")
    got = {tuple(r)[1:] for r in K.match_courses(asked, courses).collect()}
    assert got == {("matched", 0, 1.0, 30, True)}
    assert max(df.count() for df in rows) <= 60


VENUE, ASKED = "id long, name string, state string, city string, lat double, lng double, aliases array<string>", "query_id long, name string, state string, city string, lat double, lng double"


def test_course_answers_are_rows_of_asks_not_of_pairs(spark, monkeypatch):
    rows, keep = [], K.keep
    monkeypatch.setattr(K, "keep", lambda df: rows.append(keep(df)) or rows[-1])
    courses = spark.createDataFrame([(i, f"Pine Hollow {100 + i}", "NY", "Rye" if i % 2 else None, 41.0, -73.7, []) for i in range(40)], VENUE)
    got = {tuple(r) for r in K.match_courses(courses.drop("aliases").withColumnRenamed("id", "query_id"), courses).collect()}
    assert got == {(i, "matched", i, 1.0, 40, True) for i in range(40)}
    assert max(df.count() for df in rows) <= 80


def test_shares_of_course_names_and_places_change_nothing(spark, monkeypatch):
    courses = spark.createDataFrame([(i, "Pine Hollow" if i % 3 else f"Pine Hollow {i}", "NY", ["Rye", None, "Troy"][i % 5 % 3], 41 + i / 500, -73.7, ["Old Pine", None, ""]) for i in range(40)], VENUE)
    asked = courses.drop("aliases").withColumnRenamed("id", "query_id")
    want = {tuple(r) for r in K.match_courses(asked, courses).collect()}
    for limit in ("ASKED_NAMES", "VENUE_NAMES", "ROWS_OF_A_NAME"):
        monkeypatch.setattr(K, limit, 2)
    monkeypatch.setattr(K.A, "REACHED", 30)
    monkeypatch.setattr(K.A, "AT_ONCE", 3)
    assert {tuple(r) for r in K.match_courses(asked, courses).collect()} == want


def test_candidates_in_a_small_box_are_measured(spark):
    """Boxes of at most 3 km a side, but over 3 km from corner to corner: of places in the middles of its sides, and in three corners."""
    east = lambda km: km / 111.195 / np.cos(np.radians(41)).item()
    spots = {"Elm": [(0, 1.35), (1.35, 0), (2.7, 1.35), (1.35, 2.7)], "Ash": [(0, 0), (2.7, 0), (0, 2.7)]}
    courses = [(i, name, "NY", None, 41 + y / 111.195, -74 + east(x), []) for i, (name, y, x) in enumerate((name, *spot) for name, all_ in spots.items() for spot in all_)]
    asked = [(1, "Elm", "NY", None, None, None), (2, "Ash", "NY", None, None, None), (3, "Ash", "NY", "Rye", 41.0, -74.0)]
    got = {tuple(r) for r in K.match_courses(spark.createDataFrame(asked, ASKED), spark.createDataFrame(courses, VENUE)).collect()}
    assert got == {(1, "matched", 0, 1.0, 4, True), (2, "ambiguous", None, None, 3, False), (3, "ambiguous", None, None, 3, False)}


def test_courses_without_a_name_match_nothing(spark):
    courses = spark.createDataFrame([(1, "", "NY", "Rye", 41.0, -74.0, None), (2, "", "NY", "Rye", None, None, [""]), (3, None, "NY", "Rye", 41.0, -74.0, ["Elm"])], VENUE)
    asked = spark.createDataFrame([(1, "", "NY", "Rye", None, None), (2, None, "NY", "Rye", None, None), (3, "Elm", "NY", "Rye", 41.0, None), (4, "Elm", None, "Rye", None, None)], ASKED)
    got = {tuple(r) for r in K.match_courses(asked, courses).collect()}
    assert got == {(i, "unmatched", None, None, 0, False) for i in (1, 2, 4)} | {(3, "matched", 3, 1.0, 1, False)}


def test_names_against_many_are_those_of_pairs():
    import random

    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abé ") for _ in range(draw.choice([0, 1, 3, 9, 10, 11, 63, 64, 65, 80])))
    names = [word() for _ in range(50)] + ["a" * 64, "ab" * 32, "ab" * 33]
    held = K.A.Names(names, 0.7)
    for text in names + sorted(names):
        which, scores = held.alike(text)
        every = K.jaro_winkler_of([text] * len(names), names)
        assert dict(zip(which.tolist(), scores.tolist(), strict=True)) == {i: x for i, x in enumerate(every.tolist()) if x >= 0.7}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_titles_are_taken_apart_once(spark):
    rows = spark.createDataFrame([("Friends of Golf Inc", "Friends 1st Annual Scramble")], "organizer string, title string")
    plan = optimized(rows.select(K.prepared(F.col("organizer"), F.col("title")).alias("p")))
    # the organizer's telling words, the title's words, and the token text of each
    assert plan.count("split(") == 4


def test_hosts_and_pages_are_taken_apart_once(spark):
    rows = spark.createDataFrame([("a.b.org", "x", "q", "t", "1998-01-01")], "host string, page string, quote string, title string, day string")
    assert optimized(rows.select(U.suffixes(F.col("host")).alias("s"))).count("split(") == 1
    plan = optimized(rows.select(E.year_problem(F.col("day"), F.col("quote"), F.col("page"), F.col("host"), F.col("title"), 1998).alias("y")))
    assert plan.count("lower(page") == 1 and plan.count("regexp_extract_all(") == 2


def test_one_structured_date_is_chosen_once(spark):
    rows = spark.createDataFrame([("1998-01-01", ["1998-01-02"])], "day string, dates array<string>")
    chosen = rows.withColumn("p", E.preferred_date(F.col("day"), F.col("dates"), F.lit(True) & F.col("day").isNotNull()))
    assert optimized(chosen.select("p.start_date", "p.disagrees", F.concat("p.start_date", F.lit("x")))).count("filter(dates") == 1


def test_a_set_is_named_once_to_each_reducer():
    """Sets that emit keys in two bands; each key has its band."""
    texts = pa.array([" ".join(f"w{i}" for i in range(n, n + 40 + n)) for n in range(9)])
    rows = pa.Table.from_batches(J._emit(5, 75, 4)([pa.RecordBatch.from_arrays([texts], ["text"])])).to_pylist()
    rows = [r for r in rows if r["reducer"] >= 0]
    assert any(len(set(r["bands"])) > 1 for r in rows)
    for r in rows:
        nodes, counts = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["counts"], np.uint32)
        assert len(set(nodes.tolist())) == len(nodes) == len(counts) and counts.sum() == len(r["bands"]) == len(r["key_bytes"]) // J.KEY_BYTES


def test_texts_without_their_copied_lines_are_made_once(spark):
    """The filter of the pipeline's stage uses the counts that come with the texts; each task has one worker for them, not two."""
    rows = spark.createDataFrame([(1, "a b c\nd e f", "en", "s", 11), (2, "a b c", "en", "s", 5), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.lines(spark, rows, "")
    assert optimized(kept).count("_rebuilt(") == 1
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
