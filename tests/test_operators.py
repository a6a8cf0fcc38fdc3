"""Operators on small tables with results worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays as a
from quillon.functions import text as t
from quillon.operators import curation as c
from quillon.operators import dataset as ds
from quillon.operators import metrics as m
from quillon.operators import ranking as r
from quillon.operators import stats as h
from quillon.plans import experiments as x
from quillon.sources import readers


def test_funnel_counts_duplicates_of_accepted_rows_only(spark):
    rows = [(1, "a", None, True, ["g"]), (2, "a", "x", True, ["g"]), (3, "a", "x", True, ["g"]), (4, None, "x", True, ["g"]), (5, "b", "x", False, ["g"]), (6, "b", "x", True, []), (7, "b", "x", True, ["g"]), (8, "b", None, True, None)]
    df = spark.createDataFrame(rows, "pos int, id string, artist string, ok boolean, genres array<string>")
    got = {row["pos"]: row["reason"] for row in c.funnel(df, "id", "artist", F.col("ok"), "genres", ["pos"]).collect()}
    assert got == {1: "missing_artist", 2: "accepted", 3: "duplicate_id", 4: "missing_id", 5: "not_downloadable", 6: "missing_genres", 7: "accepted", 8: "duplicate_id"}


def test_balanced_choice_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    for case in range(6):
        rows = [(f"a{i}", rng.choice(t.FAMILIES[:5]), rng.randint(1, 4)) for i in range(rng.randint(5, 25))]
        df = spark.createDataFrame(rows, "artist_key string, dominant_genre string, n_tracks int")
        hashed = {k: v for k, v in df.select("artist_key", t.stable_hash(case, "artists", "artist_key")).collect()}
        queues: dict = {}
        for row in sorted(rows, key=lambda z: (-z[2], hashed[z[0]], z[0])):
            queues.setdefault(row[1], []).append(row[0])
        picked, taken, count = [], dict.fromkeys(queues, 0), len(rows) - 2
        while len(picked) < count:
            g = min((g for g in queues if queues[g]), key=lambda g: (taken[g], -len(queues[g]), t.FAMILIES.index(g)))
            picked.append(queues[g].pop(0))
            taken[g] += 1
        assert {z[0] for z in c.choose_artists_balanced(df, count, case).select("artist_key").collect()} == set(picked)


def test_split_sizes_and_no_leak(spark):
    sizes = {"n1": 1, "n2": 2, "n3": 3, "n10": 10, "n11": 11, "n64": 64}
    rows = [(k, f"{k}-{i}", j) for k, n in sizes.items() for i in range(n) for j in range(2)]
    got = ds.split_by_track(spark.createDataFrame(rows, "artist_key string, track_id string, clip int"), 0.05, 0.05, 1).collect()
    count = {k: [sum(z["artist_key"] == k and z["split"] == s for z in got) for s in ("train", "val", "test")] for k in sizes}
    assert count == {"n1": [1, 0, 0], "n2": [2, 0, 0], "n3": [1, 1, 1], "n10": [8, 1, 1], "n11": [9, 1, 1], "n64": [58, 3, 3]}
    assert len({z["track_id"] for z in got}) == len(got)


def test_dense_index_is_gapless(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "label string").repartition(7)
    assert [z["index"] for z in ds.dense_index(df, "label").orderBy("label").collect()] == list(range(500))


def test_holm(spark):
    df = spark.createDataFrame([("m", 0, 0.01), ("m", 1, float("nan")), ("m", 2, 0.04), ("m", 3, 0.03)], "metric string, i int, p double")
    got = [z["p_holm"] for z in r.holm_adjust(df, ["metric"]).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.03) and math.isnan(got[1]) and got[2:] == pytest.approx([0.06, 0.06])


def test_tails_against_known_quantiles():
    assert h.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert h.f_tail(2.8661, 4, 20) == pytest.approx(0.05, abs=1e-5)
    assert h.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert h.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert h.f_tail(float("inf"), 2, 3) == 0.0 and h.chi2_tail(0.0, 3) == 1.0


def test_statistics_of_a_constant_matrix_and_of_ties(spark):
    rows = [("flat", s, k, 2.0) for s in "abc" for k in range(4)] + [("tied", s, k, float(v)) for k, z in enumerate([(1, 2, 3), (1, 1, 2), (2, 3, 1), (1, 3, 4)]) for s, v in zip("abc", z, strict=True)]
    matrix = h.metric_matrix(spark.createDataFrame(rows, "metric string, scenario string, artist_key int, value double"), ["a", "b", "c"])
    got = {z["metric"]: z for z in h.omnibus(matrix).collect()}
    assert got["flat"]["f_statistic"] == 0 and got["flat"]["chi2"] == 0 and got["flat"]["friedman_p"] == 1.0
    assert got["tied"]["chi2"] == pytest.approx(2.8, abs=1e-9)


def test_exact_and_sampled_permutation_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("m", s, k, float(v)) for k in range(8) for s, v in (("a", rng.normal()), ("b", rng.normal() + 0.7))]
    d = h.paired_differences(h.metric_matrix(spark.createDataFrame(rows, "metric string, scenario string, artist_key int, value double"), ["a", "b"]))
    exact = h.permutation_p(d).first()["p_value"]
    diffs = np.array([z["d"] for z in d.collect()])
    signs = 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1) - 1
    assert exact == pytest.approx((np.abs((signs * diffs).mean(axis=1)) >= abs(diffs.mean()) - 1e-12).mean())
    assert h.permutation_p(d, 4000, exact_max=0).first()["p_value"] == pytest.approx(exact, abs=0.03)


def test_frechet_distance_of_equal_and_shifted_sets(spark):
    x = np.random.default_rng(0).normal(size=(40, 3))
    df = spark.createDataFrame([("g", [float(v) for v in z]) for z in x], "g string, v array<double>")
    moved = df.withColumn("v", F.transform("v", lambda z: z + 2.0))
    assert m.frechet_distance(df, df, "g", "v").first()["distance"] == pytest.approx(0, abs=1e-7)
    assert m.frechet_distance(df, moved, "g", "v").first()["distance"] == pytest.approx(12.0, abs=1e-6)


def test_delay_layout(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "q int, codes array<int>").withColumn("row", a.delay_row("codes", "q", 3, 2, 9))
    assert [z["row"] for z in df.orderBy("q").collect()] == [[9, 1, 2, 3], [9, 9, 4, 5]]


def test_scenarios_are_matched(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "row_id long, target int")
    for z in x.control_scenarios(rows, 7, 3).collect():
        ids, name = z["ids"], z["scenario"]
        assert len(set(ids)) == len(ids)
        assert (z["target"] in ids) == (name not in ("no_control", "suppress_single_others", "suppress_multiple_others"))
        assert len(ids) == {"no_control": 0}.get(name, 1) or ("multiple" in name and 2 <= len(ids) <= 5)
        assert not ids or z["weight"] * len(ids) == pytest.approx(1)


def test_readers(spark, tmp_path):
    (tmp_path / "2024-01-01.jsonl").write_text('{"id":"1","artist_id":"7","musicinfo":{"tags":{"genres":["Rock"]}}}\n\nnot json\n')
    (tmp_path / "2024-01-02.jsonl").write_text('{"id":"2","music_info":{"tags":{"genres":["Pop"],"vartags":["x"]}}}\n')
    (tmp_path / "captions.jsonl").write_text('{"id":"1","caption":"c","start_time":0,"end_time":9}\n{"id":"9","caption":"d","start_time":0,"end_time":9}\n')
    catalog = readers.read_catalog(spark, str(tmp_path)).cache()
    assert catalog.where("_corrupt is not null").count() == 1
    assert {z["id"]: z["genres"] for z in catalog.where("id is not null").collect()} == {"1": ["Rock"], "2": ["Pop"]}
    assert [z["text"] for z in readers.read_captions(spark, str(tmp_path / "captions.jsonl"), catalog.select(F.col("id").alias("track_id"))).collect()] == ["c"]
    (tmp_path / "m.csv").write_text("scenario,sample_id,kl,note\na,1,0.5,x\nb,1,,y\n")
    assert [(z["metric"], z["entity"], z["value"]) for z in readers.read_metric_table(spark, str(tmp_path / "m.csv"), "m").collect()] == [("m:kl", "1", 0.5)]
    (tmp_path / "r.json").write_text('{"sections":[{"id":"s","rows":[{"id":"r","label":"R","values":{"kl":0.5,"fad":null}}]}]}')
    assert {z["metric"]: z["shown"] for z in readers.read_results(spark, str(tmp_path / "r.json")).collect()} == {"kl": "0.500", "fad": "—"}
    with pytest.raises(ValueError):
        readers.write_csv(catalog.where("false").select("id"), str(tmp_path / "out"), "id")


def test_manifest_and_assets(spark, tmp_path):
    good = '{"audio":"a","text":"t","token_shard":"s","token_offset":0,"token_length":5,"artist_key":"k"}\n'
    (tmp_path / "good.jsonl").write_text(good)
    (tmp_path / "bad.jsonl").write_text(good.replace('"token_length":5', '"token_length":0'))
    assert readers.read_token_manifest(spark, str(tmp_path / "good.jsonl")).count() == 1
    with pytest.raises(ValueError):
        readers.read_token_manifest(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.mp3").write_bytes(b"ID3" + b"\0" * 5000)
    (tmp_path / "bin/b.mp3").write_bytes(b"\xff\xfb" + b"\0" * 5000)
    (tmp_path / "bin/c.mp3").write_bytes(b"RIFF" + b"\0" * 5000)
    assert {z["path"][-5]: z["is_mp3"] for z in readers.read_assets(spark, str(tmp_path / "bin")).collect()} == {"a": True, "b": True, "c": False}


def test_streams_equal_batch(spark, tmp_path):
    from quillon.streaming import streams

    src = tmp_path / "cat"
    src.mkdir()
    row = '{{"id":"{}","artist_id":"7","audiodownload":"u","musicinfo":{{"tags":{{"genres":["Rock"]}}}}}}\n'
    (src / "2024-01-01.jsonl").write_text(row.format(1) + row.format(" 2 ") + row.format(1))
    (src / "2024-01-02.jsonl").write_text(row.format(2) + row.format(3))
    (src / "captions.jsonl").write_text(row.format(4))
    got = streams.run_available(streams.stream_catalog(spark, str(src)), "catalog_rows", str(tmp_path / "c1"))
    assert sorted(z["track_id"] for z in got.collect()) == ["1", "2", "3"]
    values = spark.createDataFrame([("a", i % 3, float(i)) for i in range(30)], "scenario string, artist_key int, value double")
    values.repartition(3).write.parquet(str(tmp_path / "m"))
    df = streams.stream_metric_means(spark, str(tmp_path / "m"), "scenario string, artist_key int, value double")
    got = streams.run_available(df, "means", str(tmp_path / "c2"), "complete")
    want = m.aggregate_by_artist(values).collect()
    assert {z["artist_key"]: z["mean"] for z in got.collect()} == {z["artist_key"]: z["value"] for z in want}


def test_scoring_tries_entry_points(spark):
    from quillon.functions.udf import group_eval, score_with

    class Model:
        def encode_audio(self, batch):
            return (batch * 2, None)

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "k string, v array<double>")
    assert [z["scores"] for z in score_with(Model, df, "v", 1).orderBy("k").collect()] == [[2.0, 4.0], [6.0, 8.0]]
    assert {z["k"]: z["value"] for z in group_eval(df, "k", lambda g: {"n": len(g)}).collect()} == {"a": 1.0, "b": 1.0}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_hot_entity_without_arrays(spark):
    rng = random.Random(8)
    keys = [rng.choice(["hot", "hot", "b", "c", "d"]) for _ in range(120)]
    candidates = spark.createDataFrame([(i, k, 1000 + i) for i, k in enumerate(keys)], "cpos long, artist_key string, clip_id long")
    asked = [(7 * i, rng.choice(["hot", "b", "c", "none", None])) for i in range(90)] + [(7, "hot"), (7, "hot")]
    got = x.different_entity_pair(spark.createDataFrame(asked, "pos long, artist_key string"), candidates)
    want = []
    for pos, key in asked:
        others = [1000 + i for i, k in enumerate(keys) if k != key]
        want.append((pos, key or "", others[pos % len(others)]))
    assert sorted((r["pos"], r["artist_key"] or "", r["match"]) for r in got.collect()) == sorted(want)
    assert "collect_list" not in _plan(got)


def test_anova_centres_without_a_window(spark):
    rows = [("m", f"a{i}", p, float((i * 7 + p * p * 3) % 11)) for i in range(9) for p in range(3)]
    found = h.rm_anova(spark.createDataFrame(rows, "metric string, artist_key string, pos int, value double"))
    y = np.array([r[3] for r in rows]).reshape(9, 3)
    y = y - y.mean()
    ss, artists = 9 * (y.mean(axis=0) ** 2).sum(), 3 * (y.mean(axis=1) ** 2).sum()
    assert np.isclose(found.first()["f_statistic"], (ss / 2) / (((y**2).sum() - ss - artists) / 16))
    assert "Window" not in _plan(found)


def test_names_of_records(spark):
    from quillon.functions import text as t

    df = spark.createDataFrame([(3, "Été & Co.", "a b", ""), (12345, "___", " ", "x/track_77/clip_000001500_000002500.flac")], "i int, name string, id string, audio string")
    got = df.select(t.numbered_directory("i", "name"), t.artist_directory(F.trim("id"), "name"), t.slug("name", "none"), t.track_identifier("id", "audio", "i"), t.clip_identifier("id", "audio", "i"), t.milliseconds(F.lit(None).cast("double"), "audio", 1)).collect()
    assert tuple(got[0]) == ("0003_Ete_Co", "artist_a b", "t_Co", "a b", "a b", None)
    assert tuple(got[1]) == ("12345_artist", got[1][1], "none", "77", "clip_000001500_000002500", 1500)
    assert got[1][1].startswith("artist_name_") and len(got[1][1]) == 24


def test_what_is_missing_or_ambiguous_is_an_error(spark, tmp_path):
    from quillon.functions.udf import group_eval
    from quillon.operators import dataset, ranking

    people = spark.createDataFrame([(1, "Ann"), (2, "ann"), (3, "Bo")], "entity int, name string")
    asked = spark.createDataFrame([("BO",), ("Ann",), ("Cy",)], "value string").withColumn("request", F.col("value"))
    assert {r["request"]: (r["how"], r["matches"]) for r in ranking.resolve_entity(asked, people).collect()} == {"BO": ("name", 1), "Ann": ("name", 2), "Cy": (None, 0)}
    scored = spark.createDataFrame([("t", "k", None, 1.0, 1)], "track_id string, artist_key string, album_id string, signature_score double, tag_overlap int")
    profiles = spark.createDataFrame([("k", "pop", 3)], "artist_key string, dominant_genre string, clips int")
    clips = spark.createDataFrame([(1, "a.wav")], "sample_id int, path string")
    cached = spark.createDataFrame([(1, "old")], "id int, sha string")
    checked = x.cache_valid(cached, spark.createDataFrame([(1, "new"), (2, "new")], "id int, sha string"), "id", ["sha"])
    metrics = '{"metric_groups":[{"id":"g","metrics":[{"id":"kl"},{"id":"kl"}]}],"sections":[]}'
    (tmp_path / "twice.json").write_text(metrics)
    for fails in (
        lambda: dataset.filter_records(scored, ["nobody"], None, "genres"),
        lambda: ranking.choose_evaluation_artists(profiles, 1, 1, 0),
        lambda: ranking.choose_evaluation_artists(profiles, 1, 0, 0, targets=["nobody"]),
        lambda: ranking.choose_evaluation_artists(profiles, 1, 0, 0, targets=["k"], controls=["k"]),
        lambda: x.require_valid(checked, cached, "id"),
        lambda: readers.read_results(spark, str(tmp_path / "twice.json")),
    ):
        with pytest.raises(ValueError):
            fails()
    with pytest.raises(Exception, match="unknown or ambiguous: (Ann|Cy)"):
        ranking.resolve_entity(asked, people, strict=True).collect()
    with pytest.raises(Exception, match="selection without a clip: 9"):
        ranking.demo_bundle(spark.createDataFrame([(9, "g")], "sample_id int, group string"), clips, ["path"]).collect()
    assert [r["id"] for r in x.require_valid(checked, cached, "id", overwrite=True).orderBy("id").collect()] == [1, 2]
    assert ranking.choose_evaluation_artists(profiles, 1, 0, 0, targets=["k"]).collect() == [("k", "target", 0)]
    with pytest.raises(Exception, match="evaluation gave"):
        group_eval(people, "name", lambda g: {"n": 1}, ["m"]).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_catalog(spark, str(tmp_path))


def test_bootstrap_draws_are_those_of_the_digests(spark):
    import hashlib

    rng = np.random.default_rng(5)
    rows = [("m", s, k, float(v)) for k in range(40) for s, v in (("a", rng.normal()), ("b", rng.normal() + 0.3))]
    d = h.paired_differences(h.metric_matrix(spark.createDataFrame(rows, "metric string, scenario string, artist_key int, value double"), ["a", "b"]))
    y = np.array([r["d"] for r in d.orderBy("artist_key").collect()])
    picks = [[int(hashlib.md5(f"0:{r}:{i // 4}".encode()).hexdigest()[i % 4 * 8 : i % 4 * 8 + 8], 16) % 40 for i in range(40)] for r in range(150)]
    means = [y[p].mean() for p in picks]
    got = h.bootstrap_ci(d, 150).first()
    assert (got["low"], got["high"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    assert h.bootstrap_ci(d, 150).rdd.getNumPartitions() >= 1 and h.permutation_p(d, 130).count() == 1


def test_agreement_of_templates(spark):
    from quillon.operators.series import agreement

    left = spark.createDataFrame([(1, 5), (2, 6)], "k int, template int")
    right = spark.createDataFrame([(1, 5), (2, 7)], "k int, template int")
    assert tuple(agreement(left, right, ["k"]).first()) == (0.5, 2)
