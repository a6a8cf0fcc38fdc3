"""Checks inside plans, exact quantiles, digest trees, split sizes, autocorrelation, metric folders."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays as a
from quillon.functions import text as t
from quillon.operators import checks, curation, dataset, digests, metrics, quantiles, series, stats
from quillon.plans import experiments as x
from quillon.sources import readers


def fails(df, match):
    """Building df runs nothing; its result is an error."""
    with pytest.raises(Exception, match=match):
        df.collect()


def test_column_checks(spark):
    df = spark.createDataFrame([("7", "A", "low_key", None, [2, 0, 2]), (None, " ", "x", "y", [0, 9])], "id string, name string, title string, note string, ids array<int>")
    good, bad = df.where("id = '7'"), df.where("id is null")
    assert good.select(t.artist_key("id", "name", strict=True)).first()[0] == "id:7"
    fails(bad.select(t.artist_key("id", "name", strict=True)), "without an artist")
    assert good.select(t.resolve_group("title", "note", {"low key": "low"}, strict=True)).first()[0] == "low"
    fails(bad.select(t.resolve_group("title", "note", {"low key": "low"}, strict=True)), "unknown group: x y")
    assert [r["id"] for r in good.select(a.equal_weights("ids", 3).alias("w")).first()["w"]] == [0, 2]
    fails(bad.select(a.equal_weights("ids", 9)), "ids outside 0 to 8")
    fails(df.select(checks.required(F.col("id"), "no id")), "no id")


def test_table_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert checks.checked(df, F.col("v") > "", "x").count() == 5
    fails(checks.checked(df, F.col("k") > 0, F.concat(F.lit("bad row "), F.col("v"))), "bad row d")
    assert checks.unique(df.where("k is null or k = 1"), "k", "same").count() == 3
    fails(checks.unique(df, "k", "same k"), "same k: 2")
    assert checks.filled(df, "none").count() == 5
    fails(checks.filled(df.where("k = 9"), "none left"), "none left")
    assert [r["index"] for r in dataset.label_vocabulary(df, "v").orderBy("label").collect()] == [0, 1, 2, 3, 4]
    fails(dataset.label_vocabulary(df.where("false"), "v"), "no v to number")
    fails(x.remap_labels(df.selectExpr("v as artist_key", "k as artist_index"), spark.createDataFrame([("a", 0)], "artist_key string, index int")), "outside the vocabulary: [bcde]")
    assets = spark.createDataFrame([("a", 3)], "path string, size int")
    assert readers.present(assets, df.where("v = 'a'").selectExpr("v as path"), "path").first()["size"] == 3
    fails(readers.present(assets, df.where("v = 'b'").selectExpr("v as path"), "path"), "missing file: b")


def test_counts_of_values_and_tracks(spark):
    values = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 3.0), ("s", "b", 5.0)], "scenario string, artist_key string, value double")
    assert {r["artist_key"]: r["value"] for r in metrics.aggregate_by_artist(values, clips=2).collect()} == {"a": 2.0, "b": 5.0}
    fails(metrics.aggregate_by_artist(values, clips=3), "neither 1 nor 3 values for s a")
    m = values.withColumn("metric", F.lit("m"))
    fails(stats.metric_matrix(m, ["s", "t", "u"]), "no values of m for t, u")
    assert stats.metric_matrix(m, ["s"]).count() == 2
    scored = spark.createDataFrame([(f"t{i}", "a" if i < 3 else "b", None, 0.5, 1) for i in range(4)], "track_id string, artist_key string, album_id string, signature_score double, tag_overlap int")
    fails(curation.select_representative(scored, 2), "fewer than 2 tracks: b")
    assert curation.select_representative(scored, 2, strict=False).count() == 2


@pytest.mark.parametrize("sizes", [(0.05, 0.05), (0.5, 0.5), (0.9, 0.3), (0.2, 0.95), (0.0, 0.6)])
def test_split_sizes_equal_the_loop(spark, sizes):
    rows = spark.createDataFrame([(f"a{n}", f"t{i}") for n in range(1, 30) for i in range(n)], "artist_key string, track_id string")
    out = dataset.split_by_track(rows, *sizes, 3)
    got = {(r["artist_key"], r["split"]): r["n"] for r in out.groupBy("artist_key", "split").agg(F.count("*").alias("n")).collect()}
    for n in range(1, 30):
        v, u = (0 if n <= 1 else max(round(n * f), 1 if n >= 3 and f > 0 else 0) for f in sizes)
        while v + u >= n and v + u:
            v, u = (v, u - 1) if u >= v and u else (v - 1, u)
        assert [got.get((f"a{n}", s), 0) for s in ("val", "test", "train")] == [v, u, n - v - u]
    fails(dataset.split_by_track(rows.where("false"), 0.1, 0.1, 3), "training split is empty")


@pytest.mark.parametrize("values", [[], [4.0], [1.0, 2.0], [3.0] * 50, [float("nan"), 1.0, None, 2.0], list(range(1001))])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(5)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = [r["value"] for r in quantiles.exact_quantiles(df, "v", fractions).orderBy("fraction").collect()]
    wanted = df.agg(F.percentile("v", F.array(*map(F.lit, fractions)))).first()[0] or [None] * 5
    assert [str(v) for v in got] == [str(v) for v in wanted]


def test_quantiles_of_many_ranges(spark):
    x = np.random.default_rng(2).normal(size=20_000).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(16)
    got = [r["value"] for r in quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.77]).orderBy("fraction").collect()]
    assert got == pytest.approx(np.quantile(x, [0.1, 0.5, 0.77]).tolist(), abs=1e-12)
    assert curation.selection_stats(df, "v").first()["median"] == pytest.approx(np.median(x))
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.exact_quantiles(df, "v", [2.0])


def test_digest_trees_shuffle_their_rows_once(spark):
    """Rows went through four shuffles and a stored table; the last but one had one key."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 20_000).alias("i"))
    found = digests.tree_digest(df, "g", ["i"], digests.row_text("i"))
    rows = found.collect()
    for r in rows:
        level = [hashlib.sha256(f"i={i}".encode()).hexdigest() for i in sorted(k * 7919 % 20_000 for k in range(r["g"], 20_000, 2))]
        for _ in range(digests.LEVELS):
            level = [hashlib.sha256("\n".join(level[k : k + 1024]).encode()).hexdigest() for k in range(0, len(level), 1024)]
        assert (r["n"], r["digest"]) == (10_000, level[0])
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in plan.splitlines() if "- Exchange rangepartitioning" in x]) == 1


def test_digest_trees_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(digests, "FAN", 4)
    rows = [(i % 3 if i % 5 else None, i, f"r{i}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v string")
    found = [{r["g"]: (r["n"], r["digest"]) for r in digests.tree_digest(df.repartition(n), "g", ["i"], digests.row_text("i", "v")).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    for g in (0, 1, 2, None):
        own = [f"i={i}\nv={'null' if v is None else v}" for k, i, v in rows if k == g]
        level = [hashlib.sha256(x.encode()).hexdigest() for x in own]
        for _ in range(digests.LEVELS):
            level = [hashlib.sha256("\n".join(level[k : k + 4]).encode()).hexdigest() for k in range(0, len(level), 4)]
        assert found[0][g] == (len(own), level[0])
    assert digests.tree_digest(df.where("false"), "g", ["i"], F.lit("")).collect() == []
    changed = df.withColumn("v", F.when(F.col("i") == 250, "other").otherwise(F.col("v")))
    assert x.cohort_digest(changed, ["i"], ["i", "v"]).first()["digest"] != x.cohort_digest(df, ["i"], ["i", "v"]).first()["digest"]


@pytest.mark.parametrize("size", [16, 4096])
def test_autocorrelation(spark, monkeypatch, size):
    monkeypatch.setattr(series, "CHUNK", size)
    rng = np.random.default_rng(size)
    gaps = {"a": set(), "b": {3, 40, 41}, "c": set(range(2, 200))}
    n = {"a": 150, "b": 97, "c": 3}
    rows = [(k, i, float(rng.normal()) if i != 5 else None) for k in n for i in range(n[k]) if i not in gaps[k]]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(6)
    value = {(k, i): v for k, i, v in rows if v is not None}
    got = {(r["k"], r["lag"]): (r["total"], r["pairs"]) for r in series.autocorrelation(df, "k", "i", "x", 0, 20).collect()}
    for k in n:
        for lag in range(21):
            pairs = [value[k, i] * value[k, i + lag] for i in range(n[k]) if (k, i) in value and (k, i + lag) in value]
            total, count = got.get((k, lag), (0.0, 0))
            assert count == len(pairs) and total == pytest.approx(sum(pairs), abs=1e-9)


def test_metric_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text("scenario,sample_id,kl,note\na,1,0.5,x\nb,1,,y\n")
    (tmp_path / "two.csv").write_text("scenario,artist_key,fad,kl\na,k,1.5,z\na,l,2.5,3\n")
    (tmp_path / "three.csv").write_text("﻿scenario,artist_key,fad,kl\na,k,x,7\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "more.txt").write_text("scenario,sample_id,kl\na,1,1\n")
    rows = readers.read_metric_tables(spark, str(tmp_path)).collect()
    assert {(r["metric"], r["entity_level"], r["entity"], r["scenario"], r["value"]) for r in rows} == {
        ("one:kl", "sample_id", "1", "a", 0.5), ("two:fad", "artist_key", "k", "a", 1.5), ("two:fad", "artist_key", "l", "a", 2.5), ("three:kl", "artist_key", "k", "a", 7.0),
    }
    with pytest.raises(ValueError, match="no metric table"):
        readers.read_metric_tables(spark, str(tmp_path), "other.csv")


def test_stored_tables_go_with_the_driver(spark):
    from quillon.sources.stored import stored, unstore

    table = stored(spark.range(3))
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rsplit("/", 1)[0])
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert table.count() == 3 and fs.cancelDeleteOnExit(folder)
    unstore(table)
    assert not fs.exists(folder)
