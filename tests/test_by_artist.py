"""Work by artist: the tracks of an artist are in one task, and their shuffle is made once."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import curation as c
from quillon.plans.views import captions, tracks, tracks_by_artist
from quillon.queries import QUERIES
from quillon.sources import readers

FOLDER = "/root/testdata/sf0.001"


def scans(spark, df, name="lineitem.parquet"):
    """How often the final plan reads a table."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([x for x in plan.splitlines() if "FileScan" in x and name in x])


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_tracks(spark):
    a, b = tracks(spark, FOLDER), tracks_by_artist(spark, FOLDER)
    own = captions(spark, FOLDER).groupBy("track_id").agg(F.count("*").alias("clips"))
    wanted = a.join(own, "track_id").select(*b.columns)
    assert wanted.exceptAll(b).isEmpty() and b.exceptAll(wanted).isEmpty() and a.count() == b.count()


def test_signature_scores_read_line_items_once(spark, unbroadcast):
    """They were read four times, and the tracks' tags were shuffled one by one."""
    assert scans(spark, QUERIES["e7_signature_scores"](spark, FOLDER)) == 1


def test_representative_tracks_read_line_items_once(spark, unbroadcast):
    """They were read five times; albums were joined by track."""
    assert scans(spark, QUERIES["f2_representative_tracks"](spark, FOLDER)) == 1


def test_odd_tracks_have_the_joins_scores(spark):
    rows = [("t1", "a", ["x", "y", None, "x"]), ("t2", "a", ["x"]), ("t3", "a", None), ("t4", "a", []), (None, "a", ["y"]), ("t5", None, ["x"]), ("t6", "b", ["genre:z"]), ("t7", "c", [None])]
    t = spark.createDataFrame(rows, "track_id string, artist_key string, style_tags array<string>")
    profiles = c.artist_profiles(t, min_global=1)
    found = {(r["artist_key"], r["tag"]): (round(r["support"], 6), r["rank"]) for r in profiles.collect()}
    assert found == {("a", "x"): (0.4, 2), ("a", "y"): (0.4, 1), ("b", "genre:z"): (1.0, 1)}
    scores = {r["track_id"]: (r["signature_score"], r["tag_overlap"]) for r in c.signature_scores(t, profiles).collect()}
    assert scores.pop("t2")[1] == 1
    assert scores == {"t1": (1.0, 2), "t3": (0.0, 0), "t4": (0.0, 0), None: (0.0, 0), "t5": (0.0, 0), "t6": (1.0, 1), "t7": (0.0, 0)}


def test_selection_counts_read_line_items_once(spark, unbroadcast):
    assert scans(spark, QUERIES["e9_selection_counts"](spark, FOLDER)) == 1


def test_combinations_of_genres_give_the_tracks_votes(spark):
    rows = [("t1", ["pop", "x"]), ("t2", ["pop", "x"]), ("t3", ["jazz", "pop", "x", "y"]), (None, ["jazz", "x"]), ("t4", ["z"]), ("t5", None), ("t6", [])]
    t = spark.createDataFrame(rows, "track_id string, genres array<string>")
    exact = {"pop": "pop", "jazz": "jazz"}
    votes = {(r["tag"], r["family"]): r["units"] / c.UNITS for r in c.genre_cooccurrence(t, exact, ()).collect()}
    assert votes == {("x", "pop"): 2.5, ("x", "jazz"): 0.5, ("y", "pop"): 0.5, ("y", "jazz"): 0.5}
    taxonomy = c.infer_taxonomy(t, exact, (), 1, 0.5)
    assert {r["tag"]: (r["family"], r["n_tracks"]) for r in taxonomy.collect()} == {"pop": ("pop", 3), "jazz": ("jazz", 2), "x": ("pop", 4), "y": ("pop", 1), "z": (None, 1)}
    coarse = {r["track_id"]: r["coarse_genres"] for r in c.apply_taxonomy(t, taxonomy).collect()}
    assert coarse == {"t1": ["pop"], "t2": ["pop"], "t3": ["jazz", "pop"]}


def test_selection_stores_only_what_is_eligible(spark, monkeypatch):
    """The catalogue was stored as it is and with its families."""
    kept = []
    monkeypatch.setattr(c, "stored", lambda df: kept.append(df.columns) or df)
    c.build_selection(tracks_by_artist(spark, FOLDER), captions(spark, FOLDER), 6, 3)
    assert kept and not [k for k in kept if "style_tags" in k]


def test_a_selections_songs_are_computed_once(spark, tmp_path):
    """They were computed for each of the three tables."""
    seen = spark.sparkContext.accumulator(0)
    odd = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    songs = spark.createDataFrame([(f"t{i}", f"a{i % 2}") for i in range(10)], "id string, artist_key string").select(odd("id").alias("track_id"), "artist_key")
    clips = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "track_id string, n int")
    readers.write_selection(songs, clips, lambda rows: rows.groupBy("artist_key").count(), str(tmp_path / "out"))
    assert seen.value == 10
    read = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    assert (read("songs").count(), read("captions").count()) == (10, 5)
    assert sorted(map(tuple, read("artists").collect())) == [("a0", 5), ("a1", 5)]
