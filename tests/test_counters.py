"""Scalar-or-array labels, counters that come with a result, and their one scan."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import curation as c
from quillon.operators.counters import Counters
from quillon.sources import readers
from quillon.streaming.streams import run_available, stream_catalog

LINES = [
    {"id": "1", "artist_id": 7, "audiodownload": "u", "musicinfo": {"tags": {"genres": "Rock", "instruments": ["a", 1, None, True], "vartags": None}}},
    {"id": 2, "artist_name": "STRASSE straße ΟΔΟΣ", "audiodownload": "u", "audiodownload_allowed": "no", "music_info": {"tags": {"genres": [" Pop ", "pop", ""]}}},
    {"id": "3", "artist_id": "8", "audiodownload": "u", "audiodownload_allowed": False, "musicinfo": {"tags": {"genres": ["x"]}}},
    {"id": "4", "artist_id": "8", "audiodownload": "u", "musicinfo": "none"},
    {"id": "5", "artist_id": "8", "audiodownload": "u", "musicinfo": None, "music_info": {"tags": {"genres": {"a": 1}}}},
    {"id": "1", "artist_id": 7, "audiodownload": "u", "musicinfo": {"tags": {"genres": ["again"]}}},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2024-01-01.jsonl").write_text("\n".join(map(json.dumps, LINES[:5])) + "\n\n{bad\n5\n")
    (tmp_path / "2024-01-02.jsonl").write_text(json.dumps(LINES[5]) + "\n")
    return str(tmp_path)


def test_labels(spark):
    values = ['"Rock"', '["a", 1, null, 2.5, true, {"x": 1}, ["y"]]', "5", "null", "{}", "[]", '""', None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.parse_json("v").alias("v"))
    assert [r[0] for r in df.select(t.labels("v")).collect()] == [["Rock"], ["a", "1", None, "2.5", "true", '{"x":1}', '["y"]'], [], [], [], [], [""], []]
    assert [r[0] for r in df.select(t.normalize_genres(t.labels("v"))).collect()][:2] == [["rock"], ["1", "2.5", '["y"]', "a", "true", '{"x":1}']]
    assert df.select(t.record_genres(t.labels("v"), F.lit(" z ")).alias("g")).collect()[2]["g"] == ["z"]


def test_casefold(spark):
    df = spark.createDataFrame([("Straße ẞ ΟΔΟΣ Émile",)], "s string")
    assert df.select(t.casefold("s")).first()[0] == "Straße ẞ ΟΔΟΣ Émile".casefold()


def test_catalogue_with_single_labels(spark, folder):
    rows = {r["track_id"]: r for r in readers.catalog_tracks(readers.read_catalog(spark, folder, "2024-01-01.jsonl")).where("_corrupt is null").collect()}
    assert rows["1"]["genres"] == ["rock"] and rows["1"]["style_tags"] == ["genre:rock", "instrument:1", "instrument:a", "instrument:true"]
    assert rows["2"]["genres"] == ["pop"] and rows["2"]["artist_key"] == "name:strasse strasse οδοσ"
    assert [rows[k]["audiodownload_allowed"] for k in "1234"] == [True, True, False, True]
    assert rows["4"]["genres"] == rows["5"]["genres"] == []


def test_counts_come_with_one_scan(spark, folder, tmp_path):
    counters = Counters()
    rows = readers.catalog_tracks(readers.read_catalog(spark, folder, counters=counters))
    funnelled = c.funnel(rows.where("_corrupt is null"), "track_id", "artist_key", F.col("audiodownload_allowed"), "genres", ["file_name"], counters)
    assert funnelled._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    funnelled.write.parquet(f"{tmp_path}/out")
    assert counters.values() == {
        "metadata": {"metadata_rows": 8, "metadata_parse_errors": 2},
        "funnel": {"accepted": 2, "missing_id": 0, "duplicate_id": 1, "missing_artist": 0, "not_downloadable": 1, "missing_genres": 2},
    }
    with pytest.raises(ValueError, match="watched already"):
        readers.read_catalog(spark, folder, counters=counters)


def test_funnel_deals_out_rows_without_an_id(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("id"), F.lit("a").alias("artist"), F.array(F.lit("g")).alias("genres"), F.col("id").alias("at"))
    out = c.funnel(df.repartition(3), "id", "artist", F.lit(True), "genres", ["at"])
    assert out.groupBy("reason").count().collect()[0].asDict() == {"reason": "missing_id", "count": 500}
    assert "xxhash64" in out._jdf.queryExecution().analyzed().toString()


def test_caption_counters(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","caption":"c","start_time":0,"end_time":9}\n' * 2 + '{"id":"2","caption":"d","start_time":0,"end_time":9}\n{bad\n')
    counters = Counters()
    wanted = spark.createDataFrame([("1",)], "track_id string")
    rows = c.dedup_captions(readers.read_captions(spark, f"{tmp_path}/c.jsonl", wanted, counters).drop("_corrupt"), counters)
    assert rows.count() == 1
    assert counters.values() == {"captions": {"caption_rows": 4, "caption_parse_errors": 1}, "captions_read": {"rows": 2}, "captions_kept": {"rows": 1}}
    assert {(r["section"], r["name"]): r["n"] for r in counters.table(spark).collect()}["captions", "caption_rows"] == 4


def test_stream_takes_single_labels(spark, folder, tmp_path):
    rows = run_available(stream_catalog(spark, folder, glob="2024-01-01.jsonl"), "single_labels", f"{tmp_path}/checkpoint").collect()
    assert {(r["track_id"], tuple(r["genres"])) for r in rows} == {("1", ("rock",)), ("2", ("pop",))}


def test_manifest_takes_single_labels(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"audio":"a","text":"t","token_shard":"s","token_offset":0,"token_length":5,"artist_key":"k","genres":"Rock","signature_tags":["x"]}\n')
    row = readers.read_token_manifest(spark, f"{tmp_path}/m.jsonl").first()
    assert (row["genres"], row["signature_tags"], row["coarse_genres"]) == (["Rock"], ["x"], None)
