"""Metric queries (E10 to E32, D4, D8, F4 to F13, I, U) over events and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import accumulators as acc
from quillon.functions import arrays as a
from quillon.functions import udf as u
from quillon.operators import dataset as ds
from quillon.operators import metrics as m
from quillon.operators import ranking as r
from quillon.plans.views import V_METRIC, V_TRACK, metrics, table, tracks

from .registry import query

KINDS = ["click", "error", "purchase", "signup", "view"]
E = "e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS l, list_transform(embedding[11:20], lambda x: x::DOUBLE) AS g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda z: exp(z - list_max({0}))))))"
P = f"exp(l[label + 1] - {LSE.format('l')})"


def vectors(spark, d):
    x = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", "label", F.slice(x, 1, 10).alias("l"), F.slice(x, 11, 10).alias("g"), x.alias("v"))


def r6(*cs):
    return [F.round(c, 6).alias(c) for c in cs]


@query("e10_artist_genre_matrix", f"WITH {V_TRACK} SELECT artist_key, genre, round(n / sum(n) OVER (PARTITION BY artist_key), 6) AS weight FROM (SELECT artist_key, genre, count(*) AS n FROM (SELECT DISTINCT artist_key, track_id, unnest(genres) AS genre FROM v_track) GROUP BY 1, 2)")
def e10(spark, d):
    return ds.artist_genre_matrix(tracks(spark, d)).select("artist_key", "genre", *r6("weight"))


@query("e11_label_vocabulary", f"WITH {V_TRACK} SELECT artist_key AS label, row_number() OVER (ORDER BY artist_key) - 1 AS index FROM (SELECT DISTINCT artist_key FROM v_track)")
def e11(spark, d):
    return ds.label_vocabulary(tracks(spark, d), "artist_key")


@query("e12_entity_profiles", f"""WITH {V_TRACK}, g AS (SELECT artist_key, genre, count(*) AS n FROM (SELECT artist_key, unnest(genres) AS genre FROM v_track) GROUP BY 1, 2), a AS (SELECT artist_key, album_id, count(*) AS n FROM v_track GROUP BY 1, 2)
SELECT artist_key, arg_min(genre, (-n, genre)) AS dominant_genre, array_to_string(list_sort(list(genre)), '|') AS genres, (SELECT arg_min(coalesce(album_id, ''), (-a.n, coalesce(album_id, ''))) FROM a WHERE a.artist_key = g.artist_key) AS artist_name, (SELECT sum(a.n)::BIGINT FROM a WHERE a.artist_key = g.artist_key) AS clips FROM g GROUP BY 1""")
def e12(spark, d):
    t = tracks(spark, d).withColumn("artist_name", F.coalesce("album_id", F.lit("")))
    return ds.entity_profiles(t).select("artist_key", "dominant_genre", F.array_join("genres", "|").alias("genres"), "artist_name", "clips")


@query("e14_aggregate_by_artist", f"WITH {V_METRIC} SELECT scenario, artist_key, round(avg(value), 6) AS value, count(value) AS n FROM v_metric GROUP BY 1, 2")
def e14(spark, d):
    return m.aggregate_by_artist(metrics(spark, d)).withColumn("value", F.round("value", 6))


@query("e15_summarize_values", f"WITH {V_METRIC} SELECT scenario, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM (SELECT * FROM v_metric WHERE sample_id % 5 <> 0) GROUP BY 1")
def e15(spark, d):
    holed = metrics(spark, d).withColumn("value", F.when(F.col("sample_id") % 5 == 0, float("nan")).otherwise(F.col("value")))
    return m.summarize(holed, "scenario").select("scenario", *r6("mean", "std"), "n")


@query("e16_scenario_metric_table", f"WITH {V_METRIC} SELECT position, scenario, round(avg(value) FILTER (WHERE artist_key % 2 = 0), 6) AS even, round(avg(value) FILTER (WHERE artist_key % 2 = 1), 6) AS odd FROM (SELECT unnest(range(5))::INT AS position, unnest(['view','click','error','signup','purchase']) AS scenario) LEFT JOIN v_metric USING (scenario) GROUP BY 1, 2")
def e16(spark, d):
    v = metrics(spark, d).withColumn("metric", F.when(F.col("artist_key") % 2 == 0, "even").otherwise("odd"))
    return m.scenario_metric_table(v, ["view", "click", "error", "signup", "purchase"], ["even", "odd"]).select("position", "scenario", *r6("even", "odd"))


@query("e17_attribution_per_artist", f"WITH {E} SELECT label, round(avg((list_position(l, list_max(l)) - 1 = label)::INT), 6) AS rate, round(avg({P}), 6) AS mean_confidence, round(avg(1 + len(list_filter(l, lambda z: z > l[label + 1]))), 6) AS mean_rank, count(*) AS clips FROM e GROUP BY 1")
def e17(spark, d):
    return m.attribution(m.target_statistics(vectors(spark, d), "l", "label"), "label").select("label", *r6("rate", "mean_confidence", "mean_rank"), "clips")


@query("e18_target_attribution_rate", f"WITH {E} SELECT round(avg((list_position(l, list_max(l)) - 1 = label)::INT), 9) AS rate FROM e")
def e18(spark, d):
    return m.target_attribution_rate(m.target_statistics(vectors(spark, d), "l", "label")).withColumn("rate", F.round("rate", 9))


@query("e19_other_artist_accuracy", f"WITH {E} SELECT round(avg((list_position(l, list_max(l)) - 1 = label)::INT), 9) AS accuracy, count(*) AS n FROM e WHERE label NOT IN (1, 4)")
def e19(spark, d):
    return m.other_accuracy(m.target_statistics(vectors(spark, d), "l", "label"), "label", [1, 4]).withColumn("accuracy", F.round("accuracy", 9))


@query("e20_forgetting_gap", f"WITH {E} SELECT round(avg({P} - exp(g[label + 1] - {LSE.format('g')})), 6) AS gap, count(*) AS n FROM e")
def e20(spark, d):
    v = vectors(spark, d)
    return m.forgetting_gap(v, v.select("vec_id", F.col("g").alias("l")), "vec_id", "l", "label").withColumn("gap", F.round("gap", 6))


@query("e21_topk_accuracy", f"WITH {E}, k AS (SELECT 1 + len(list_filter(l, lambda z: z > l[label + 1])) AS rk, -ln({P}) AS ce FROM e) SELECT round(avg((rk <= 1)::INT), 9) AS top1, round(avg((rk <= 5)::INT), 9) AS topk, round(avg(ce), 6) AS cross_entropy FROM k")
def e21(spark, d):
    return m.topk_accuracy(vectors(spark, d), "l", "label").select(F.round("top1", 9).alias("top1"), F.round("topk", 9).alias("topk"), *r6("cross_entropy"))


def _kl(p, q):
    return f"greatest(0.0, list_sum(list_transform(range(1, 11), lambda i: exp({p}[i] - {LSE.format(p)}) * (({p}[i] - {LSE.format(p)}) - ({q}[i] - {LSE.format(q)})))))"


@query("e22_paired_kl", f"WITH {E}, k AS (SELECT {_kl('l', 'g')} AS rg, {_kl('g', 'l')} AS gr FROM e) SELECT round(avg(rg), 6) AS rg_mean, round(stddev_pop(rg), 6) AS rg_std, round(avg(gr), 6) AS gr_mean, round(stddev_pop(gr), 6) AS gr_std, round(avg(rg + gr), 6) AS both_mean, round(stddev_pop(rg + gr), 6) AS both_std FROM k")
def e22(spark, d):
    k = m.paired_kl(vectors(spark, d), "l", "g")
    return k.select(*r6(*k.columns))


@query("e23_probability_kl", f"""WITH {E}, c AS (SELECT vec_id, list_transform(l, lambda z: greatest(z, 1e-8)) AS p, list_transform(g, lambda z: greatest(z, 1e-8)) AS q FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: p[i] / list_sum(p) * (ln(p[i] / list_sum(p)) - ln(q[i] / list_sum(q))))), 5) AS kl FROM c""")
def e23(spark, d):
    return vectors(spark, d).select("vec_id", F.round(a.probability_kl("l", "g"), 5).alias("kl"))


@query("e24_clap_score", f"WITH {E} SELECT round(avg(greatest(0.0, list_cosine_similarity(l, g) * 100)), 6) AS score FROM e")
def e24(spark, d):
    return m.clap_score(vectors(spark, d), "l", "g").withColumn("score", F.round("score", 6))


@query("e25_token_confidence", f"WITH {V_METRIC}, c AS (SELECT artist_key AS clip, avg(exp(-value / 100)) FILTER (WHERE sample_id % 7 <> 0) AS confidence, sum(exp(-value / 100)) FILTER (WHERE sample_id % 7 <> 0) AS total, count(*) FILTER (WHERE sample_id % 7 <> 0) AS n FROM v_metric GROUP BY 1) SELECT clip, round(confidence, 6) AS confidence, n FROM c UNION ALL SELECT -1, round(sum(total) / sum(n), 6), sum(n)::BIGINT FROM c")
def e25(spark, d):
    v = metrics(spark, d).select(F.col("artist_key").alias("clip"), (F.col("value") / 100).alias("loss"), (F.col("sample_id") % 7 != 0).alias("valid"))
    c = m.token_confidence(v, "clip", "loss", F.col("valid"))
    return c.select("clip", *r6("confidence"), "n").union(m.micro_confidence(c).select(F.lit(-1).cast("long"), F.round("confidence", 6), "n"))


@query("e26_rollout_confidence", f"""WITH {E}, pos AS (SELECT unnest([1, 3, 6]) AS position), s AS (SELECT vec_id // 40 AS clip, (vec_id % 4)::INT AS codebook, (vec_id % 40) // 4 AS step, l FROM e),
f AS (SELECT DISTINCT clip, codebook, position, position - 1 + codebook AS step, (clip + codebook + position) % 10 AS label FROM s, pos)
SELECT clip, position, round(avg(exp(l[label + 1] - {LSE.format('l')})), 6) AS confidence, count(*) AS codebooks FROM f JOIN s USING (clip, codebook, step) GROUP BY 1, 2""")
def e26(spark, d):
    v = vectors(spark, d)
    clip = F.floor(F.col("vec_id") / 40)
    scores = v.select(clip.alias("clip"), (F.col("vec_id") % 4).cast("int").alias("codebook"), F.floor((F.col("vec_id") % 40) / 4).alias("step"), F.col("l").alias("logits"))
    cells = scores.select("clip", "codebook").distinct().withColumn("column", F.explode(F.sequence(F.lit(5), F.lit(12))))
    labels = cells.withColumn("label", ((F.col("clip") + F.col("codebook") + F.col("column") - 5 + 1) % 10).cast("int")).withColumn("valid", F.lit(True))
    return m.rollout_confidence(scores, labels, 5, m.curve_positions(3, 6)).select("clip", "position", *r6("confidence"), "codebooks")


@query("e27_confidence_curve", f"WITH {V_METRIC} SELECT (sample_id % 10)::INT AS position, " + ", ".join(f"round(avg(value) FILTER (WHERE scenario = '{k}'), 6) AS {k}" for k in KINDS) + " FROM v_metric GROUP BY 1")
def e27(spark, d):
    v = metrics(spark, d).select((F.col("sample_id") % 10).cast("int").alias("position"), "scenario", F.col("value").alias("confidence"))
    return m.confidence_curve(v, KINDS).select("position", *r6(*KINDS))


@query("e28_max_abs_delta", f"WITH {V_METRIC}, x AS (SELECT artist_key, scenario, avg(value) AS v FROM v_metric GROUP BY 1, 2) SELECT a.scenario, round(max(abs(a.v - b.v)), 6) AS max_abs_delta, max(abs(a.v - b.v)) = 0 AS identical FROM x a JOIN x b ON a.artist_key = b.artist_key AND b.scenario = 'view' WHERE a.scenario <> 'view' GROUP BY 1")
def e28(spark, d):
    return m.max_abs_delta(metrics(spark, d), "view", "artist_key").withColumn("max_abs_delta", F.round("max_abs_delta", 6))


@query("e29_token_losses", f"WITH {V_METRIC} SELECT artist_key, round(avg(b), 6) AS loss, round(least(exp(avg(b)), 1e12), 4) AS perplexity FROM (SELECT artist_key, scenario, avg(value / 100) AS b FROM v_metric WHERE sample_id % 3 <> 0 GROUP BY 1, 2) GROUP BY 1")
def e29(spark, d):
    v = metrics(spark, d).withColumn("loss", F.col("value") / 100)
    return m.token_losses(v, "artist_key", "scenario", "loss", F.col("sample_id") % 3 != 0).select("artist_key", *r6("loss"), F.round("perplexity", 4).alias("perplexity"))


@query("e30_margin_hinges", f"WITH {E}, h AS (SELECT greatest(l[1] - l[2] + 0.1, 0) AS a, greatest(l[4] - l[5] + 0.1, 0) AS b, greatest(l[2] - l[3] + 0.1, 0) AS c, greatest(l[6] - l[7] - 0.1, 0) AS d, greatest(sqrt(greatest(l[8], 1e-8)) - 0.05, 0) AS e FROM e) SELECT round(avg(a), 6) AS enhance, round(avg(b), 6) AS contrast, round(avg(c), 6) AS suppress, round(avg(d), 6) AS preserve, round(avg(e * e), 6) AS budget FROM h")
def e30(spark, d):
    names = ["pos", "def", "neg", "correct", "wrong", "ctrl", "ref", "energy"]
    log = vectors(spark, d).select(*(F.get("l", F.lit(i)).alias(n) for i, n in enumerate(names)))
    h = m.margin_hinges(log, 0.1, 0.05)
    return h.select(*r6(*h.columns))


@query("e31_best_k_models", "SELECT o_orderkey AS run_id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def e31(spark, d):
    return r.best_k_models(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("score")), "score", 12)


@query("e32_run_totals", "SELECT (count(*) + sum(l_linenumber))::BIGINT AS manifest_rows, count(*) AS \"unique\", sum(l_linenumber)::BIGINT AS duplicates, count(*) FILTER (WHERE l_returnflag <> 'R') AS processed, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS ok, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS failed, sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS token_steps, 4 * sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS token_ids, CASE WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'complete' END AS status FROM lineitem")
def e32(spark, d):
    status = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_linestatus") == "F", "ok").otherwise("error")
    return m.run_totals(table(spark, d, "lineitem").select(status.alias("status"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_linenumber") + 1).cast("long").alias("rows")), 4)


@query("e32_split_counts", f"""WITH {V_TRACK}, n AS (SELECT artist_key, track_id, count(*) OVER (PARTITION BY artist_key) AS n, row_number() OVER (PARTITION BY artist_key ORDER BY sha256('3:split:' || artist_key || ':' || track_id), track_id) AS r FROM v_track), z AS (SELECT *, greatest(round_even(n * 0.05, 0), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS v FROM n)
SELECT CASE WHEN r <= v THEN 'val' WHEN r <= 2 * v THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT artist_key) AS labels FROM z GROUP BY 1""")
def e32s(spark, d):
    return ds.split_counts(ds.split_by_track(tracks(spark, d), 0.05, 0.05, 3))


TOKENS = f"tk AS (SELECT vec_id % 20 AS clip, vec_id % 4 AS codebook, vec_id, CASE WHEN vec_id % 11 = 0 THEN -100 ELSE label END AS y, label, vec_id % 13 <> 0 AS t, l FROM e), tv AS (SELECT *, y <> -100 AND y <> 3 AND t AS ok, ln({P}) AS lp, list_position(l, list_max(l)) - 1 = label AS hit FROM tk)"


def tokens(spark, d):
    v, k = vectors(spark, d), F.col("vec_id")
    return v.select((k % 20).alias("clip"), (k % 4).alias("codebook"), F.when(k % 11 == 0, -100).otherwise(F.col("label")).alias("y"), (k % 13 != 0).alias("t"), "l")


@query("e25_logit_confidence", f"WITH {E}, {TOKENS} SELECT clip, round(avg(exp(lp)) FILTER (WHERE ok), 6) AS confidence, count(*) FILTER (WHERE ok) AS n FROM tv GROUP BY 1")
def e25l(spark, d):
    return m.logit_confidence(tokens(spark, d), "clip", "l", "y", m.valid_tokens("y", 3, in_time="t")).select("clip", *r6("confidence"), "n")


@query("e29_batch_metrics", f"WITH {E}, {TOKENS} SELECT clip, round(avg(b), 6) AS loss, round(sum(h) / sum(n), 6) AS token_accuracy, round(least(exp(avg(b)), 1e12), 5) AS perplexity FROM (SELECT clip, codebook, avg(-lp) AS b, sum(hit::INT) AS h, count(*) AS n FROM tv WHERE ok GROUP BY 1, 2) GROUP BY 1")
def e29b(spark, d):
    b = m.batch_metrics(tokens(spark, d), "clip", "codebook", "l", "y", m.valid_tokens("y", 3, in_time="t"))
    return b.select("clip", *r6("loss", "token_accuracy"), F.round("perplexity", 5).alias("perplexity"))


@query("e20_probability_gap", f"WITH {E} SELECT round(avg(abs(l[label + 1]) - abs(g[label + 1])), 6) AS gap, count(*) AS n FROM e")
def e20p(spark, d):
    v = vectors(spark, d)
    size = lambda c: F.transform(c, lambda x: F.abs(x))
    return m.forgetting_gap(v.withColumn("l", size("l")), v.select("vec_id", size("g").alias("l")), "vec_id", "l", "label", probabilities=True).withColumn("gap", F.round("gap", 6))


@query("e27_axis_range", f"WITH {V_METRIC}, x AS (SELECT min(value / 1000) AS lo, max(value / 1000) AS hi FROM v_metric) SELECT round(greatest(0, (lo + hi) / 2 - greatest(hi - lo, 0.02) * 0.62), 6) AS low, round(least(1, (lo + hi) / 2 + greatest(hi - lo, 0.02) * 0.62), 6) AS high FROM x")
def e27a(spark, d):
    return m.axis_range(metrics(spark, d).withColumn("x", F.col("value") / 1000), "x").select(*r6("low", "high"))


DELTA = "x AS (SELECT artist_key, avg(value) FILTER (WHERE scenario = 'purchase') AS v, avg(value) FILTER (WHERE scenario = 'view') AS b FROM v_metric GROUP BY 1)"


@query("d4_delta_vs_baseline", f"WITH {V_METRIC}, {DELTA} SELECT artist_key, round(v, 6) AS value, round(b, 6) AS baseline, round(v - b, 6) AS delta FROM x WHERE v IS NOT NULL")
def d4(spark, d):
    return r.delta_vs_baseline(metrics(spark, d), "purchase", "view").select("artist_key", *r6("value", "baseline", "delta"))


@query("f4_best_worst", f"""WITH {V_METRIC}, g AS (SELECT artist_key, round(avg(value), 9) AS mean FROM v_metric GROUP BY 1)
SELECT * FROM (SELECT 'best' AS side, row_number() OVER (ORDER BY mean, artist_key) AS place, artist_key, round(mean, 6) AS mean FROM g) WHERE place <= 10 UNION ALL SELECT * FROM (SELECT 'worst' AS side, row_number() OVER (ORDER BY mean DESC, artist_key DESC) AS place, artist_key, round(mean, 6) AS mean FROM g) WHERE place <= 10""")
def f4(spark, d):
    return r.best_worst(metrics(spark, d), 10).select("side", F.col("place").cast("long").alias("place"), "artist_key", *r6("mean"))


@query("f5_rank_candidates", f"WITH {V_METRIC}, {DELTA} SELECT artist_key, round(v - b, 6) AS score, row_number() OVER (ORDER BY round(v - b, 9) DESC, artist_key) AS rank FROM x WHERE v - b IS NOT NULL QUALIFY rank <= 20")
def f5(spark, d):
    ranked = r.rank_candidates(r.delta_vs_baseline(metrics(spark, d), "purchase", "view"), "improvement", 20, "maximize")
    return ranked.select("artist_key", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query("f5_filtered_candidates", f"WITH {V_METRIC}, {DELTA} SELECT artist_key, round(v - b, 6) AS score, row_number() OVER (ORDER BY round(v - b, 9), artist_key) AS rank FROM x WHERE v - b IS NOT NULL AND artist_key IN (SELECT artist_key FROM v_metric WHERE contains(scenario || '-' || (sample_id % 97), 'ase-13')) QUALIFY rank <= 20")
def f5c(spark, d):
    v = metrics(spark, d)
    clips = v.select("artist_key", F.concat_ws("-", F.upper("scenario"), (F.col("sample_id") % 97).cast("string")).alias("text"))
    ranked = r.rank_candidates(r.delta_vs_baseline(v, "purchase", "view"), "delta", 20, largest_first=False, clips=clips, caption=" ase-13 ")
    return ranked.select("artist_key", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query("f6_candidate_clips", f"WITH {V_METRIC}, s AS (SELECT sample_id, row_number() OVER (PARTITION BY artist_key ORDER BY value DESC, sample_id) AS rank FROM v_metric WHERE scenario <> 'view') SELECT sample_id, rank AS secondary_rank FROM v_metric LEFT JOIN s USING (sample_id)")
def f6(spark, d):
    from pyspark.sql import Window

    clips = metrics(spark, d)
    second = clips.where("scenario <> 'view'").select("sample_id", F.row_number().over(Window.partitionBy("artist_key").orderBy(F.desc("value"), "sample_id")).cast("long").alias("rank"), F.lit("x").alias("evidence"))
    return r.candidate_clips(clips, second).select("sample_id", "secondary_rank")


@query("f7_choose_evaluation_artists", f"""WITH {V_TRACK}, p AS (SELECT artist_key, count(*) AS clips, (split_part(artist_key, ':', 2)::INT % 4)::VARCHAR AS dominant_genre FROM v_track GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY dominant_genre ORDER BY clips DESC, artist_key) > 1 AS rep FROM p),
tt AS (SELECT artist_key, row_number() OVER (ORDER BY rep, clips DESC, artist_key) - 1 AS position FROM t QUALIFY position < 2)
SELECT artist_key, 'target' AS role, position FROM tt UNION ALL SELECT artist_key, 'control', row_number() OVER (ORDER BY sha256('9:controls:' || artist_key), artist_key) - 1 AS position FROM p WHERE artist_key NOT IN (SELECT artist_key FROM tt) QUALIFY position < 4""")
def f7(spark, d):
    p = tracks(spark, d).groupBy("artist_key").agg(F.count("*").alias("clips")).withColumn("dominant_genre", (F.split_part("artist_key", F.lit(":"), F.lit(2)).cast("int") % 4).cast("string"))
    return r.choose_evaluation_artists(p, 2, 4, 9).withColumn("position", F.col("position").cast("long"))


@query("f10_holm_adjust", f"""WITH {V_METRIC}, p AS (SELECT scenario, artist_key, CASE WHEN artist_key % 9 = 0 THEN 'NaN'::DOUBLE ELSE (artist_key * 7 + length(scenario)) % 101 / 9973 END AS p FROM v_metric GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY scenario) AS m FROM p WHERE NOT isnan(p))
SELECT scenario, artist_key, round(least(1.0, max((m - k) * p) OVER (PARTITION BY scenario ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h UNION ALL SELECT scenario, artist_key, NULL FROM p WHERE isnan(p)""")
def f10(spark, d):
    p = metrics(spark, d).groupBy("scenario", "artist_key").agg(F.first(F.when(F.col("artist_key") % 9 == 0, float("nan")).otherwise((F.col("artist_key") * 7 + F.length("scenario")) % 101 / 9973)).alias("p"))
    h = r.holm_adjust(p, ["scenario"])
    return h.select("scenario", "artist_key", F.when(~F.isnan("p_holm"), F.round("p_holm", 6)).alias("p_holm"))


@query("f11_display_order", """WITH items AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'single' ELSE 'multiple' END AS grp, p_partkey::VARCHAR AS id, p_partkey AS index, p_partkey AS pos FROM part),
c AS (SELECT CASE WHEN o_orderkey % 4 < 2 THEN 'single' ELSE 'multiple' END AS grp, o_orderkey AS entry, CASE WHEN o_orderkey % 3 = 0 THEN 'gone' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_custkey::VARCHAR END AS id, o_custkey * 2 % 1000 AS index, o_orderkey % 5 <> 0 AS shown FROM orders),
a AS (SELECT c.*, i.pos FROM c LEFT JOIN items i ON i.grp = c.grp AND i.id = c.id),
b AS (SELECT grp, entry, shown, pos FROM a WHERE pos IS NOT NULL UNION ALL SELECT a.grp, a.entry, a.shown, i.pos FROM a JOIN items i ON i.grp = a.grp AND i.index = a.index WHERE a.pos IS NULL),
m AS (SELECT grp, pos, arg_min(shown, entry) AS shown, min(entry) AS entry FROM b GROUP BY 1, 2)
SELECT grp AS "group", pos, entry, coalesce(shown, true) AS visible FROM items LEFT JOIN m USING (grp, pos)""")
def f11(spark, d):
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    items = table(spark, d, "part").select(F.when(p % 2 == 0, "single").otherwise("multiple").alias("group"), p.cast("string").alias("id"), p.alias("index"), p.alias("pos"))
    known = F.when(k % 3 == 0, F.concat(F.lit("gone"), k.cast("string"))).when(k % 3 == 1, F.col("o_custkey").cast("string"))
    config = table(spark, d, "orders").select(F.when(k % 4 < 2, "single").otherwise("multiple").alias("group"), k.alias("entry"), known.alias("id"), (F.col("o_custkey") * 2 % 1000).alias("index"), (k % 5 != 0).alias("show"))
    return r.display_order(items, config).select("group", "pos", "entry", "visible")


@query("f12_demo_bundle", "SELECT p_partkey AS sample_id, p_type AS \"group\", unnest(['a_path', 'b_path']) AS asset, unnest([p_name, p_brand]) AS path FROM part WHERE p_size < 10")
def f12(spark, d):
    p = table(spark, d, "part")
    sel = p.where("p_size < 10").select(F.col("p_partkey").alias("sample_id"), F.col("p_type").alias("group"))
    return r.demo_bundle(sel, p.select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("a_path"), F.col("p_brand").alias("b_path")), ["a_path", "b_path"])


@query("f12_bundle_manifest", "SELECT p_type AS \"group\", p_partkey AS sample_id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS ordinal, 'a_path=' || p_name || ',b_path=' || p_brand AS assets, count(*) OVER (PARTITION BY p_type) AS items FROM part WHERE p_size < 10")
def f12m(spark, d):
    items, counts = r.bundle_manifest(f12(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("assets")), lambda x: F.concat_ws("=", x.key, x.value)), ",")
    return items.join(counts.drop("assets"), "group").select("group", "sample_id", F.col("ordinal").cast("long").alias("ordinal"), text.alias("assets"), "items")


@query("f13_matched_table", f"WITH {V_METRIC}, c AS (SELECT sample_id % 500 AS clip, scenario, min(sample_id) AS s FROM v_metric GROUP BY 1, 2) SELECT clip, 'caption ' || clip AS caption, " + ", ".join(f"max(s) FILTER (WHERE scenario = '{k}') AS {k}, max('artist' || s % 3 || ', artist' || s % 5) FILTER (WHERE scenario = '{k}') AS {k}_artists" for k in KINDS) + " FROM c GROUP BY 1")
def f13t(spark, d):
    cells = metrics(spark, d).groupBy((F.col("sample_id") % 500).alias("clip"), "scenario").agg(F.min("sample_id").alias("value"))
    cells = cells.withColumn("ids", F.array(F.col("value") % 3, F.col("value") % 5))
    clips = cells.select("clip", F.concat(F.lit("caption "), F.col("clip").cast("string")).alias("caption")).distinct()
    artists = spark.range(5).select("id", F.concat(F.lit("artist"), F.col("id").cast("string")).alias("name"))
    return r.matched_table(cells, clips, artists, KINDS, "clip")


@query("f13_matched_row", f"WITH {V_METRIC} SELECT artist_key, " + ", ".join(f"arg_min(value, sample_id) FILTER (WHERE scenario = '{k}') AS {k}" for k in KINDS) + " FROM v_metric GROUP BY 1")
def f13(spark, d):
    return r.matched_row(metrics(spark, d), "artist_key", KINDS)


@query("d10_attach_similarity", f"WITH {V_METRIC} SELECT a.sample_id, a.scenario AS variant, CASE WHEN a.sample_id % 4 = 0 THEN NULL WHEN a.sample_id % 4 = 1 THEN a.value END AS similarity FROM v_metric a WHERE a.value > 1 AND a.sample_id % 11 <> 0")
def d10(spark, d):
    v = metrics(spark, d)
    variants = v.select("sample_id", F.col("scenario").alias("variant"), (F.col("value") > 1).alias("visible"))
    side = v.where("sample_id % 4 < 2").select("sample_id", F.col("scenario").alias("variant"), F.when(F.col("sample_id") % 4 == 0, float("inf")).otherwise(F.col("value")).alias("similarity"))
    return r.attach_similarity(variants, side, v.where("sample_id % 11 = 0").select("sample_id")).select("sample_id", "variant", "similarity")


CENT = "c0 AS (SELECT label, i, avg(v[i] / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS w FROM c0 GROUP BY 1)"


@query("d8_pairwise_similarity", f"WITH {E}, {CENT} SELECT a.label AS left, b.label AS right, round(list_cosine_similarity(a.w, b.w), 6) AS similarity FROM c a, c b")
def d8(spark, d):
    c = m.centroids(vectors(spark, d), "label", "v")
    return m.pairwise_similarity(c, "label", "centroid").select("left", "right", *r6("similarity"))


@query("d8_blocked_similarity", f"WITH {E}, {CENT} SELECT a.label::VARCHAR AS left, b.label::VARCHAR AS right, round(list_cosine_similarity(a.w, b.w), 6) AS similarity FROM c a, c b")
def d8b(spark, d):
    return m.blocked_similarity(m.centroids(vectors(spark, d), "label", "v"), "label", "centroid", 4).select("left", "right", *r6("similarity"))


@query("i1_cosine_rows", f"WITH {E} SELECT vec_id, round(list_cosine_similarity(l, g), 6) AS cosine, round(list_sum(list_transform(l, lambda z: z / sqrt(list_sum(list_transform(l, lambda y: y * y))))), 6) AS unit_sum FROM e")
def i1(spark, d):
    return vectors(spark, d).select("vec_id", F.round(a.cosine("l", "g"), 6).alias("cosine"), F.round(a.total(a.l2_normalize("l")), 6).alias("unit_sum"))


@query("i2_similarity_rows", f"""WITH {E}, n AS (SELECT *, list_transform(v[21:30], lambda z: z) AS t, list_transform(v[31:40], lambda z: z) AS f FROM e),
c0 AS (SELECT label, i, avg(f[i] / sqrt(list_sum(list_transform(f, lambda z: z * z)))) AS x FROM (SELECT label, f, unnest(range(1, 11)) AS i FROM n) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS w FROM c0 GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(l, g), 6) AS paired, round(list_cosine_similarity(g, t) - list_cosine_similarity(l, t), 6) AS text_delta, round(list_cosine_similarity(g, f) - list_cosine_similarity(l, f), 6) AS reference_delta, round(list_cosine_similarity(g, w) - list_cosine_similarity(l, w), 6) AS centroid_delta FROM n JOIN c USING (label)""")
def i2(spark, d):
    v = vectors(spark, d).select("vec_id", "label", "l", "g", F.slice("v", 21, 10).alias("t"), F.slice("v", 31, 10).alias("f"))
    return m.similarity_rows(v, "label", "t", "l", "g", "f").select("vec_id", *r6("paired", "text_delta", "reference_delta", "centroid_delta"))


@query("i3_target_statistics", f"WITH {E} SELECT vec_id, list_position(l, list_max(l)) - 1 AS predicted, (list_position(l, list_max(l)) - 1 = label)::INT AS hit, round({P}, 6) AS confidence, 1 + len(list_filter(l, lambda z: z > l[label + 1])) AS rank FROM e")
def i3(spark, d):
    return m.target_statistics(vectors(spark, d), "l", "label").select("vec_id", "predicted", "hit", *r6("confidence"), "rank")


@query("i4_covariance", f"""WITH {E}, k AS (SELECT unnest(range(1, 11)) AS i), p AS (SELECT a.i AS i, b.i AS j FROM k a, k b)
SELECT label::VARCHAR AS g, i - 1 AS i, j - 1 AS j, round(covar_samp(l[i], l[j]), 9) AS cov FROM e, p GROUP BY 1, 2, 3""")
def i4(spark, d):
    s = m.group_statistics(vectors(spark, d), "label", "l")
    long = s.select("g", F.posexplode("cov").alias("p", "cov"))
    return long.select("g", F.floor(F.col("p") / 10).alias("i"), (F.col("p") % 10).cast("long").alias("j"), F.round("cov", 9).alias("cov"))


@query("i5_frechet_distance")
def i5(spark, d):
    v = vectors(spark, d)
    return m.frechet_distance(v, v, "label", "l").join(m.frechet_distance(v, v.withColumn("l", F.col("g")), "label", "l").select("g", F.col("distance").alias("other")), "g")


@query("i6_peer_similarity", f"""WITH {E}, {CENT}, n AS (SELECT label, list_transform(w, lambda z: z / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS w FROM c), mu AS (SELECT i, avg(w[i]) AS x FROM (SELECT w, unnest(range(1, 65)) AS i FROM n) GROUP BY 1), muv AS (SELECT list(x ORDER BY i) AS m FROM mu),
z AS (SELECT label, list_transform(range(1, 65), lambda i: w[i] - m[i]) AS w FROM n, muv)
SELECT a.label AS left, b.label AS right, round(0.9 * list_cosine_similarity(a.w, b.w) + 0.1 * (a.label * b.label) / 100, 6) AS similarity FROM z a, z b""")
def i6(spark, d):
    now = m.pairwise_similarity(m.centroids(vectors(spark, d), "label", "v"), "label", "centroid", centred=True)
    new = now.select("left", "right", (F.col("left") * F.col("right") / 100).alias("similarity"))
    return m.moving_average(now, new, 0.9).select("left", "right", *r6("similarity"))


@query("i7_peer_weights", f"""WITH {E}, {CENT}, s AS (SELECT a.label AS "left", b.label AS "right", CASE WHEN b.label IN (2, 5) THEN 0 ELSE exp(list_cosine_similarity(a.w, b.w) / 0.2) END AS x FROM c a, c b WHERE a.label <> b.label)
SELECT "left", "right", round(x / sum(x) OVER (PARTITION BY "left"), 6) AS weight FROM s""")
def i7(spark, d):
    s = m.pairwise_similarity(m.centroids(vectors(spark, d), "label", "v"), "label", "centroid")
    hidden = spark.createDataFrame([(2,), (5,)], "entity int")
    return m.peer_weights(s, 0.2, masked=hidden).select("left", "right", *r6("weight"))


@query("i7_genre_affinity", f"WITH {V_METRIC}, w AS (SELECT artist_key AS e, scenario AS g, count(*) AS w FROM v_metric GROUP BY 1, 2), s AS (SELECT a.e AS l, b.e AS r, sum(a.w * b.w) AS x FROM w a JOIN w b USING (g) WHERE a.e <> b.e GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", round(x / sum(x) OVER (PARTITION BY l), 6) AS weight FROM s")
def i7g(spark, d):
    w = metrics(spark, d).groupBy(F.col("artist_key").alias("entity"), F.col("scenario").alias("genre")).agg(F.count("*").alias("weight"))
    return m.affinity_weights(w).select("left", "right", *r6("weight"))


@query("i8_mean_pool", f"WITH {E} SELECT label AS clip, i - 1 AS i, round(avg(l[i]), 6) AS x FROM (SELECT label, l, unnest(range(1, 11)) AS i FROM e WHERE vec_id % 3 <> 0) GROUP BY 1, 2")
def i8(spark, d):
    v = vectors(spark, d).withColumnRenamed("label", "clip")
    return m.mean_pool(v, "clip", "l", F.col("vec_id") % 3 != 0).select("clip", F.col("i").cast("long").alias("i"), *r6("x"))


@query("i9_pad_trim", "SELECT doc_id, array_to_string(list_transform(range(6), lambda i: coalesce(string_split(text, ' ')[i + 1], '<pad>')), '|') AS padded, least(6, len(string_split(text, ' '))) AS valid, array_to_string(string_split(text, ' ')[greatest(0, (len(string_split(text, ' ')) - 4) // 2) + 1 : greatest(0, (len(string_split(text, ' ')) - 4) // 2) + 4], '|') AS middle FROM documents")
def i9(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(a.pad_trim(w, 6, "<pad>"), "|").alias("padded"), F.size(F.filter(a.valid_mask(w, 6), lambda x: x)).cast("long").alias("valid"), F.array_join(a.center_crop(w, 4), "|").alias("middle"))


@query("i9_crops", "SELECT doc_id, array_to_string(CASE WHEN n <= 4 THEN w ELSE w[r + 1 : r + 4] END, '|') AS random, CASE WHEN n >= 6 THEN array_to_string(w[4:6], '|') END AS segment FROM (SELECT *, ('0x' || left(sha256('5:crop:' || doc_id), 8))::BIGINT % greatest(n - 3, 1) AS r FROM (SELECT doc_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM documents))")
def i9c(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(a.random_crop(w, 4, 5, "doc_id"), "|").alias("random"), F.array_join(a.exact_segment(w, F.lit(3), 3), "|").alias("segment"))


@query("i10_token_slice", f"WITH {E} SELECT vec_id, round(list_sum(v[(vec_id % 50)::INT + 1 : (vec_id % 50)::INT + 9]), 6) AS total FROM e")
def i10(spark, d):
    return vectors(spark, d).select("vec_id", F.round(a.total(a.token_slice("v", (F.col("vec_id") % 50).cast("int"), F.lit(9))), 6).alias("total"))


@query("i11_delay_layout", "SELECT vec_id, array_to_string(list_transform(range(8), lambda c: CASE WHEN c - (vec_id % 4) - 1 BETWEEN 0 AND 4 THEN ((vec_id + c - (vec_id % 4) - 1) % 7)::VARCHAR ELSE '9' END), '|') AS row, array_to_string(list_transform(range(5), lambda t: CASE WHEN t + (vec_id % 4) + 1 < 8 THEN ((vec_id + t) % 7)::VARCHAR ELSE 'null' END), '|') AS back FROM embeddings")
def i11(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("q"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: ((F.col("vec_id") + t) % 7).cast("int")).alias("codes"))
    laid = v.select("vec_id", "q", a.delay_row("codes", "q", 5, 4, 9).alias("laid"))
    return laid.select("vec_id", F.array_join(F.col("laid").cast("array<string>"), "|").alias("row"), F.array_join(a.undelay_row("laid", "q", 5).cast("array<string>"), "|", "null").alias("back"))


@query("i11_plain_shift", "SELECT vec_id, '9|' || array_to_string(list_transform(range(4), lambda t: (vec_id + t) % 7), '|') AS row FROM embeddings")
def i11s(spark, d):
    codes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: ((F.col("vec_id") + t) % 7).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(a.shift_right(codes, 9).cast("array<string>"), "|").alias("row"))


@query("i12_multihot", "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i IN (label, (vec_id % 10)) THEN CASE WHEN label = vec_id % 10 THEN '1' ELSE '0.5' END ELSE '0' END), '|') AS weights FROM embeddings")
def i12(spark, d):
    w = a.multihot(F.array("label", (F.col("vec_id") % 10).cast("int")), 10)
    text = F.transform(w, lambda x: F.when(x == 1, "1").when(x == 0.5, "0.5").otherwise("0"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(text, "|").alias("weights"))


@query("g6_suppression_weights", "SELECT vec_id, CASE WHEN label = vec_id % 10 THEN label || ':1' ELSE least(label, vec_id % 10) || ':0.5|' || greatest(label, vec_id % 10) || ':0.5' END AS weights FROM embeddings")
def g6(spark, d):
    w = a.equal_weights(F.array("label", (F.col("vec_id") % 10).cast("int"), "label"))
    text = F.transform(w, lambda s: F.concat(s.getField("id").cast("string"), F.lit(":"), F.when(s.getField("weight") == 1, "1").otherwise("0.5")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(text, "|").alias("weights"))


@query("i13_rms_cap", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(l, lambda z: z * least(1.0, sqrt(list_sum(list_transform(g, lambda y: y * y))) / sqrt(list_sum(list_transform(l, lambda y: y * y)))))), 6) AS total FROM e")
def i13(spark, d):
    return vectors(spark, d).select("vec_id", F.round(a.total(a.rms_cap("l", "g")), 6).alias("total"))


@query("i14_combine_prompt", f"WITH {E} SELECT vec_id, len(list_concat(l, g)) AS n, round(list_concat(l, g)[15], 6) AS x FROM e")
def i14(spark, d):
    return vectors(spark, d).select("vec_id", F.size(F.concat("l", "g")).cast("long").alias("n"), F.round(F.get(F.concat("l", "g"), F.lit(14)), 6).alias("x"))


@query("i15_peak_normalize", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(v, lambda z: z / greatest(0.1, list_max(v)))), 6) AS total FROM e")
def i15(spark, d):
    return vectors(spark, d).select("vec_id", F.round(a.total(a.peak_normalize("v")), 6).alias("total"))


@query("c8_assert_ranges", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_length, count(*) FILTER (WHERE list_max(embedding) >= 0.4) AS too_high FROM embeddings")
def c8(spark, d):
    from quillon.sources.readers import violation_counts

    return violation_counts(table(spark, d, "embeddings"), {"bad_length": F.size("embedding") != 64, "too_high": F.array_max("embedding") >= F.lit(0.4).cast("float")})


@query("c9_finite_rows", f"WITH {V_METRIC} SELECT artist_key, count(*) AS cells FROM (SELECT artist_key, scenario FROM v_metric GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 5")
def c9(spark, d):
    wide = m.aggregate_by_artist(metrics(spark, d)).groupBy("artist_key").pivot("scenario", KINDS).agg(F.first("value"))
    return wide.where(a.all_finite(F.array(*KINDS))).select("artist_key", F.lit(5).cast("long").alias("cells"))


@query("c10_missing_types", "SELECT s AS sample_type FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'refund', 'share']) AS s) WHERE s NOT IN (SELECT event_type FROM events)")
def c10(spark, d):
    from quillon.plans.experiments import missing_types

    return missing_types(metrics(spark, d).select(F.col("scenario").alias("sample_type")), [*KINDS, "refund", "share"])


@query("u1_score_with", f"WITH {E} SELECT vec_id, round(list_sum(v), 5) AS total FROM e")
def u1(spark, d):
    return u.score_with(lambda: (lambda x: {"scores": x.sum(axis=1, keepdims=True)}), vectors(spark, d), "v").select("vec_id", F.round(F.get("scores", F.lit(0)), 5).alias("total"))


@query("u2_group_eval", f"WITH {V_METRIC} SELECT scenario, 'median' AS metric, round(median(value), 6) AS value FROM v_metric GROUP BY 1")
def u2(spark, d):
    return u.group_eval(metrics(spark, d), "scenario", lambda g: {"median": float(np.median(g["value"]))}, ["median"]).withColumn("value", F.round("value", 6))


@query("u3_accumulated_metrics", f"""WITH {E}, h AS (SELECT label, list_position(l, list_max(l)) - 1 = label AS hit, {P} - exp(g[label + 1] - {LSE.format('g')}) AS lost FROM e)
SELECT round(avg(hit::INT), 9) AS rate, round(avg(hit::INT) FILTER (WHERE label NOT IN (1, 4)), 9) AS accuracy, count(*) FILTER (WHERE label NOT IN (1, 4))::DOUBLE AS others, round(avg(lost), 6) AS gap, count(*)::DOUBLE AS n FROM h""")
def u3(spark, d):
    """E18 to E20 as user metrics."""
    v = vectors(spark, d)
    rate = acc.accumulate(v.select("l", "label"), acc.TargetRate("l", "label")).select(F.round("rate", 9).alias("rate"))
    other = acc.accumulate(v.select("l", "label"), acc.OtherAccuracy("l", "label", [1, 4])).select(F.round("accuracy", 9).alias("accuracy"), F.col("n").alias("others"))
    gap = acc.accumulate(v.select("l", "g", "label"), acc.ForgettingGap("l", "g", "label")).select(F.round("gap", 6).alias("gap"), "n")
    return rate.join(F.broadcast(other)).join(F.broadcast(gap))


@query("u3_cat_state", f"WITH {V_METRIC} SELECT artist_key, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM v_metric GROUP BY 1")
def u3c(spark, d):
    spread = acc.accumulate(metrics(spark, d).select("artist_key", "value"), acc.Spread("value"), "artist_key")
    return spread.select("artist_key", *r6("median", "low", "high"))
