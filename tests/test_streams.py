"""Writes that replace a table as a whole, batches that come again, reasons by file order."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators.curation import funnel
from quillon.sources import files, readers
from quillon.streaming.streams import BatchTable, drained, stream_funnel, stream_metric_means


def rows(spark, n, tag="a"):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def test_a_killed_write_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/out"
    readers.write_jsonl(rows(spark, 5).repartition(3), path, "id")
    broken = rows(spark, 9, "b").withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("killed"))))
    for write in (readers.write_jsonl, readers.write_csv):
        with pytest.raises(Exception, match="killed"):
            write(broken, path, "tag")
        with pytest.raises(ValueError, match="empty"):
            write(rows(spark, 0), path, "id")
        assert sorted(r["id"] for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]
    assert os.listdir(tmp_path) == ["out"]
    readers.write_jsonl(rows(spark, 2, "c"), path, "id")
    assert [tuple(r) for r in spark.read.json(path).orderBy("id").collect()] == [(0, "c"), (1, "c")]


def test_written_in_order(spark, tmp_path):
    readers.write_jsonl(rows(spark, 100).orderBy(F.desc("id")), f"{tmp_path}/out", "id")
    lines = [json.loads(x)["id"] for f in sorted(tmp_path.glob("out/part-*.json")) for x in f.read_text().splitlines()]
    assert lines == list(range(100))


def test_a_replacement_cut_between_its_moves_is_undone(spark, tmp_path):
    path = f"{tmp_path}/out"
    readers.write_csv(rows(spark, 3), path, "id")
    os.rename(path, f"{tmp_path}/_out.old-1")
    os.makedirs(f"{tmp_path}/_out.new-1")
    files.recover(spark, path)
    assert spark.read.csv(path, header=True).count() == 3 and os.listdir(tmp_path) == ["out"]
    os.makedirs(f"{tmp_path}/_out.old-2")
    files.recover(spark, path)
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        files.rename(spark, path, str(tmp_path))


def test_selection_is_replaced_together(spark, tmp_path):
    songs = spark.createDataFrame([("t", "a")], "track_id string, artist_key string")
    captions = spark.createDataFrame([("t", "x")], "track_id string, text string")
    write = lambda c, seed: readers.write_selection(songs, c, songs.select("artist_key"), f"{tmp_path}/out", {"seed": seed})
    write(captions, 1)
    with pytest.raises(ValueError, match="empty"):
        write(captions.where("false"), 2)
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/out/config").first()["seed"] == 1
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["artists", "captions", "config", "songs"]


@pytest.mark.parametrize("complete", [False, True])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, complete):
    table = BatchTable(spark, f"{tmp_path}/table", complete)
    assert table.read(rows(spark, 1).schema).count() == 0
    table.put(rows(spark, 2, "a"), 0)
    table.put(rows(spark, 3, "b"), 1)
    wanted = (["a"] * 2 if not complete else []) + ["b"] * 3
    for number in (0, 1, 1):
        table.put(rows(spark, 7, "again"), number)
        assert sorted(r["tag"] for r in table.read(rows(spark, 1).schema).collect()) == wanted
    with pytest.raises(Exception, match="killed"):
        table.put(rows(spark, 1).withColumn("tag", F.raise_error(F.lit("killed")).cast("string")), 2)
    assert table.read(rows(spark, 1).schema).count() == len(wanted)
    table.put(rows(spark, 1, "c"), 2)
    assert table.read(rows(spark, 1).schema).count() == (1 if complete else 6)


def test_a_stream_that_lost_its_last_commit_appends_once(spark, tmp_path):
    source, work = f"{tmp_path}/in", f"{tmp_path}/work"
    schema = "scenario string, artist_key long, value double"
    spark.createDataFrame([("s", 1, 2.0)], schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert drained(stream(), work).count() == 1
    spark.createDataFrame([("s", 1, 4.0)], schema).coalesce(1).write.mode("append").parquet(source)
    assert drained(stream(), work).count() == 2
    commits = sorted((tmp_path / "work/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    commits[-1].unlink()  # as if the driver was lost after the batch was written
    assert drained(stream(), work).count() == 2
    means = drained(stream_metric_means(spark, source, schema), f"{tmp_path}/means", "complete").collect()
    assert [(r["n"], r["mean"]) for r in means] == [(2, 3.0)]


def line(track, url="u", genres="Rock", artist="7"):
    return json.dumps({"id": track, "artist_id": artist, "audiodownload": url, "musicinfo": {"tags": {"genres": genres}}})


def test_stream_and_batch_give_the_same_reasons(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    days = {  # in order of arrival
        "2024-01-03": [line("1"), line("2"), line("4", genres=None), line(" "), line("6")],
        "2024-01-01": [line("1"), line("2", url=None), line("3"), line("3"), line("5", artist=None)],
        "2024-01-02": [line("2"), line("4"), "{bad", line("3", url=" ")],
        "2024-02-01": [line("7")],
        "2024-02-02": [line("1"), line("6")],
        "2024-04-01": [line("9")],
    }
    for i, (day, lines) in enumerate(days.items()):
        (folder / f"{day}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{day}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    found = drained(stream_funnel(spark, str(folder), "10 days"), str(tmp_path / "work"))
    got = {(r["track_id"], r["position"].split("/")[-1].split("|")[0], r["reason"]) for r in found.collect()}
    batch = readers.catalog_tracks(readers.read_catalog(spark, str(folder))).where("_corrupt is null and track_id is distinct from '9'")
    wanted = funnel(batch, "track_id", "artist_key", F.col("audiodownload_allowed") & F.col("audiodownload").isNotNull() & (F.trim("audiodownload") != ""), "genres", ["position"])
    assert found.count() == wanted.count() == 16
    assert got == {(r["track_id"], r["file_name"], r["reason"]) for r in wanted.collect()}
    assert ("2", "2024-01-02.jsonl", "accepted") in got and ("1", "2024-02-02.jsonl", "duplicate_id") in got


def test_a_forgotten_id_may_return(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (day, track) in enumerate([("2024-01-01", "1"), ("2024-02-01", "2"), ("2024-03-01", "3"), ("2024-04-01", "1"), ("2024-06-01", "4"), ("2024-07-01", "5")]):
        (folder / f"{day}.jsonl").write_text(line(track) + "\n")
        os.utime(folder / f"{day}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    for keep, reason in ((20, "accepted"), (None, "duplicate_id")):
        found = drained(stream_funnel(spark, str(folder), "1 day", keep), str(tmp_path / f"work{keep}")).collect()
        assert [r["reason"] for r in sorted(found, key=lambda r: r["position"]) if r["track_id"] == "1"] == ["accepted", reason]


def test_many_ids_share_a_call_and_keep_the_batch_reasons(spark, tmp_path):
    """Each id had a call of its own, more than once; now a bucket of ids has one."""
    folder = tmp_path / "in"
    folder.mkdir()
    days = {
        "2024-01-02": [line(str(i), genres=None if i % 13 == 0 else "Rock") for i in range(0, 3000, 5)],
        "2024-01-01": [line(str(i), url=None if i % 7 == 0 else "u") for i in range(3000)],
        "2024-02-20": [line(str(i)) for i in range(0, 3000, 3)],
        "2024-06-01": [line("last")],
    }
    for i, (day, lines) in enumerate(days.items()):
        (folder / f"{day}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{day}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    found = drained(stream_funnel(spark, str(folder), "10 days"), str(tmp_path / "work"))
    batch = readers.catalog_tracks(readers.read_catalog(spark, str(folder))).where("_corrupt is null and track_id <> 'last'")
    wanted = funnel(batch, "track_id", "artist_key", F.col("audiodownload_allowed") & F.col("audiodownload").isNotNull() & (F.trim("audiodownload") != ""), "genres", ["position"])
    got = sorted((r["track_id"], r["position"].split("/")[-1].split("|")[0], r["reason"]) for r in found.collect())
    assert got == sorted((r["track_id"], r["file_name"], r["reason"]) for r in wanted.collect())
    state = spark.read.format("statestore").load(f"file://{tmp_path}/work/checkpoint")
    assert 0 < state.count() <= 1024  # of 3,001 ids
