"""Plans, splits and draws (G, D5 to D7, D9, D11, F8, F9, C6, C7, K), statistics (H), series (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import dataset as ds
from quillon.operators import series as s
from quillon.operators import stats as h
from quillon.operators.digests import tree_sql
from quillon.plans import experiments as x
from quillon.plans.views import V_METRIC, V_TRACK, metrics, table, tracks

from .metrics import KINDS
from .registry import query

HN = "('0x' || left(sha256({}), 8))::BIGINT"


def records(spark, d):
    return tracks(spark, d).withColumn("clip_id", F.col("track_id")).withColumn("track_id", F.col("album_id"))


@query("c7_eligible_for_cohort", f"WITH {V_TRACK}, k AS (SELECT * FROM v_track WHERE duration >= 20 AND split_part(artist_key, ':', 2)::INT % 2 = 0) SELECT artist_key, track_id FROM k WHERE artist_key IN (SELECT artist_key FROM k GROUP BY 1 HAVING count(*) >= 3)")
def c7(spark, d):
    t = tracks(spark, d).withColumn("token_length", F.col("duration"))
    keys = t.select("artist_key").distinct()
    even = keys.where(F.split_part("artist_key", F.lit(":"), F.lit(2)).cast("int") % 2 == 0)
    return ds.eligible_for_cohort(t, keys, even, 20, 3).select("artist_key", "track_id")


@query("g1_select_records", f"""WITH {V_TRACK}, a AS (SELECT artist_key FROM (SELECT DISTINCT artist_key FROM v_track) ORDER BY sha256('5:artists:' || artist_key), artist_key LIMIT 6),
so AS (SELECT artist_key, album_id, row_number() OVER (PARTITION BY artist_key ORDER BY sha256(concat_ws(':', '5', 'songs', artist_key, album_id)), album_id NULLS FIRST) AS r FROM (SELECT DISTINCT artist_key, album_id FROM v_track WHERE artist_key IN (SELECT * FROM a) AND album_id IS NOT NULL)),
c AS (SELECT v.artist_key, v.track_id, row_number() OVER (PARTITION BY v.artist_key, v.album_id ORDER BY sha256('5:clips:' || v.track_id), v.track_id) AS r FROM v_track v JOIN so ON v.artist_key = so.artist_key AND v.album_id = so.album_id AND so.r <= 4)
SELECT artist_key, track_id AS clip_id FROM c WHERE r <= 2 ORDER BY sha256('5:samples:' || track_id), track_id LIMIT 40""")
def g1(spark, d):
    return ds.select_records(records(spark, d).where("track_id is not null"), 5, 6, 4, 2, 40).select("artist_key", "clip_id")


@query("g2_split_by_track", f"""WITH {V_TRACK}, n AS (SELECT artist_key, track_id, count(*) OVER (PARTITION BY artist_key) AS n, row_number() OVER (PARTITION BY artist_key ORDER BY sha256('3:split:' || artist_key || ':' || track_id), track_id) AS r FROM v_track),
z AS (SELECT *, greatest(round_even(n * 0.05, 0), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS v FROM n)
SELECT artist_key, track_id, CASE WHEN r <= v THEN 'val' WHEN r <= 2 * v THEN 'test' ELSE 'train' END AS split FROM z""")
def g2(spark, d):
    return ds.split_by_track(tracks(spark, d), 0.05, 0.05, 3)


@query("g3_balanced_cohort", f"""WITH {V_TRACK}, a AS (SELECT artist_key FROM v_track GROUP BY 1 HAVING count(*) >= 5 ORDER BY sha256('8:artists:' || artist_key), artist_key LIMIT 4)
SELECT artist_key, track_id AS clip_id, row_number() OVER (PARTITION BY artist_key ORDER BY sha256('8:clips:' || artist_key || ':' || track_id), track_id) - 1 AS artist_clip_index FROM v_track WHERE artist_key IN (SELECT * FROM a) QUALIFY artist_clip_index < 5""")
def g3(spark, d):
    t = tracks(spark, d).select("artist_key", F.col("track_id").alias("clip_id"))
    return x.balanced_cohort(t, 4, 5, 8).withColumn("artist_clip_index", F.col("artist_clip_index").cast("long"))


@query("g4_balanced_draws", f"""WITH {V_TRACK}, z AS (SELECT artist_key, count(*) AS n, row_number() OVER (ORDER BY artist_key) - 1 AS a FROM v_track GROUP BY 1), c AS (SELECT artist_key, track_id, row_number() OVER (PARTITION BY artist_key ORDER BY track_id) - 1 AS c FROM v_track),
dr AS (SELECT i AS draw, {HN.format("'6:artist:' || i")} % (SELECT count(*) FROM z) AS a, {HN.format("'6:clip:' || i")} AS h FROM range(500) t(i))
SELECT draw, c.artist_key, track_id AS clip_id FROM dr JOIN z USING (a) JOIN c ON c.artist_key = z.artist_key AND c.c = h % n""")
def g4(spark, d):
    return ds.balanced_draws(tracks(spark, d).select("artist_key", F.col("track_id").alias("clip_id")), 500, 6)


def plan_rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("target"))


def _draws(ns, row="vec_id", seed=4):
    """Hashed offsets from a target's successor on, 8 of each digest."""
    return f"list_concat(list_transform(range(64), lambda j: ('0x' || substr(sha256('{seed}:{ns}:' || {row} || ':' || (j // 8)), (1 + 8 * (j % 8))::BIGINT, 8))::BIGINT % 9), [0, 1, 2, 3, 4])"


def _oth(draws, count):
    return f"list_transform(list_filter({draws}, lambda o, n: list_position({draws}, o) = n)[1:{count}], lambda o: (label + 1 + o) % 10)"


SETS = f"""q0 AS (SELECT vec_id, label, {_draws('multi_target')} AS mt, {_draws('single_other')} AS so, {_draws('multi_other')} AS mo FROM embeddings),
q AS (SELECT vec_id, label, {_oth('mt', "(1 + " + HN.format("'4:multi_target:' || vec_id") + " % 4)")} AS mt, {_oth('so', '1')} AS so, {_oth('mo', "(2 + " + HN.format("'4:multi_other:' || vec_id") + " % 4)")} AS mo FROM q0)"""


@query("g5_control_scenarios", f"""WITH {SETS},
u AS (SELECT vec_id, unnest([{{'p': 0, 's': 'no_control', 'i': []::BIGINT[]}}, {{'p': 1, 's': 'enhance_target', 'i': [label::BIGINT]}}, {{'p': 2, 's': 'suppress_single_target', 'i': [label::BIGINT]}}, {{'p': 3, 's': 'suppress_multiple_target', 'i': list_sort(list_append(mt, label))}}, {{'p': 4, 's': 'suppress_single_others', 'i': so}}, {{'p': 5, 's': 'suppress_multiple_others', 'i': list_sort(mo)}}]) AS z FROM q)
SELECT vec_id AS row_id, z.p AS position, z.s AS scenario, array_to_string(z.i, ',') AS ids, CASE WHEN len(z.i) > 0 THEN round(1.0 / len(z.i), 6) END::DOUBLE AS weight FROM u""")
def g5(spark, d):
    p = x.control_scenarios(plan_rows(spark, d), 10, 4)
    return p.select("row_id", "position", "scenario", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.round("weight", 6).alias("weight"))


@query("d5_scenario_manifest", f"""WITH {SETS},
u AS (SELECT vec_id, unnest([{{'s': 'no_control', 'l': 'No Control', 'i': []::BIGINT[]}}, {{'s': 'enhance_target', 'l': 'Enhance Target', 'i': [label::BIGINT]}}, {{'s': 'suppress_single_target', 'l': 'Suppress Single Target', 'i': [label::BIGINT]}}, {{'s': 'suppress_multiple_target', 'l': 'Suppress Multiple Target', 'i': list_sort(list_append(mt, label))}}, {{'s': 'suppress_single_others', 'l': 'Suppress Single Others', 'i': so}}, {{'s': 'suppress_multiple_others', 'l': 'Suppress Multiple Others', 'i': list_sort(mo)}}]) AS z FROM q)
SELECT vec_id AS row_id, 's' || vec_id AS sample_id, z.s AS scenario, z.l AS scenario_label, z.s || '_artist_indices' AS index_array, array_to_string(list_transform(z.i, lambda i: 'artist' || i), ',') AS keys, 'audio/' || z.s || '/s' || vec_id || '.wav' AS audio_path, 'audio/reference/s' || vec_id || '.wav' AS reference_path FROM u""")
def d5(spark, d):
    rows = plan_rows(spark, d)
    plan = x.control_scenarios(rows, 10, 4)
    artists = spark.range(10).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("artist"), F.col("id").cast("string")).alias("artist_key"))
    clips = rows.select("row_id", F.concat(F.lit("s"), F.col("row_id").cast("string")).alias("sample_id"))
    return x.scenario_manifest(clips, plan, artists).select("row_id", "sample_id", "scenario", "scenario_label", "index_array", F.array_join("keys", ",").alias("keys"), "audio_path", "reference_path")


@query("d6_remap_labels", "SELECT s_suppkey, (s_suppkey % 10)::INT AS control_artist_index, (9 - s_suppkey % 10)::INT AS artist_index FROM supplier")
def d6(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).cast("int").alias("artist_index"), F.concat(F.lit("k"), (F.col("s_suppkey") % 10).cast("string")).alias("artist_key"))
    vocab = spark.range(10).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("artist_key"), (9 - F.col("id")).cast("int").alias("index"))
    return x.remap_labels(rows, vocab).select("s_suppkey", "control_artist_index", "artist_index")


@query("d7_pending_jobs", f"WITH {V_METRIC}, d AS (SELECT artist_key, bool_and(value > 0.5) AS ok, count(DISTINCT scenario) AS n FROM v_metric WHERE sample_id % 3 = 0 GROUP BY 1) SELECT DISTINCT v.artist_key AS group_id FROM v_metric v LEFT JOIN d USING (artist_key) WHERE NOT coalesce(ok AND n = 5, false)")
def d7(spark, d):
    v = metrics(spark, d)
    done = v.where("sample_id % 3 = 0").select(F.col("artist_key").alias("group_id"), F.col("scenario").alias("sample_type"), (F.col("value") > 0.5).alias("exists"))
    return x.pending(v.select(F.col("artist_key").alias("group_id")).distinct(), done, KINDS)


@query("d7_completed_manifest", f"WITH {V_METRIC} SELECT sample_id FROM v_metric WHERE artist_key IN (SELECT artist_key FROM v_metric GROUP BY 1 HAVING bool_and(value > 0.5) AND count(DISTINCT scenario) = 5)")
def d7c(spark, d):
    v = metrics(spark, d).select("sample_id", F.col("artist_key").alias("group_id"), F.col("scenario").alias("sample_type"), (F.col("value") > 0.5).alias("exists"))
    return x.completed(v, v, KINDS).select("sample_id")


@query("d9_different_entity_pair", """WITH c AS (SELECT vec_id AS cpos, label FROM embeddings), s AS (SELECT vec_id AS pos, label FROM embeddings),
r AS (SELECT s.pos, c.cpos, row_number() OVER (PARTITION BY s.pos ORDER BY c.cpos) - 1 AS k, count(*) OVER (PARTITION BY s.pos) AS m FROM s JOIN c ON s.label <> c.label) SELECT pos, cpos AS match FROM r WHERE k = pos % m""")
def d9(spark, d):
    e = table(spark, d, "embeddings")
    cand = e.select(F.col("vec_id").alias("cpos"), F.col("label").alias("artist_key"), F.col("vec_id").alias("clip_id"))
    return x.different_entity_pair(e.select(F.col("vec_id").alias("pos"), F.col("label").alias("artist_key")), cand).select("pos", "match")


@query("d11_clip_cohort_rows", f"WITH {V_METRIC} SELECT sample_id AS clip_id, artist_key, row_number() OVER (PARTITION BY artist_key ORDER BY sample_id) - 1 AS artist_clip_index FROM v_metric WHERE sample_id % 2 = 0")
def d11(spark, d):
    v = metrics(spark, d).select(F.col("sample_id").alias("clip_id"), "artist_key")
    cohort = v.where("clip_id % 2 = 0").select("clip_id", F.col("clip_id").alias("position"))
    return x.clip_cohort_rows(cohort, v).select("clip_id", "artist_key", F.col("artist_clip_index").cast("long").alias("artist_clip_index"))


@query("g7_generation_jobs", f"""WITH v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('2:jobs:' || label || ':' || vec_id), vec_id) AS r FROM embeddings), j AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS gi, ((label + 1 + {HN.format("'2:other:' || label || ':' || vec_id")} % 9) % 10)::INT AS o FROM v WHERE r <= 3)
SELECT printf('%04d:%03d', label, gi) AS group_id, vec_id AS dataset_index, o AS other_index, t AS sample_type, CASE t WHEN 'suppress_self' THEN label WHEN 'suppress_other' THEN o END AS condition_index FROM j, (SELECT unnest(['default', 'suppress_self', 'suppress_other']) AS t)""")
def g7(spark, d):
    r = table(spark, d, "embeddings").select(F.col("label").alias("artist_key"), F.col("label").alias("artist_index"), F.col("vec_id").alias("dataset_index"))
    return x.generation_jobs(r, 3, 2).select("group_id", "dataset_index", "other_index", "sample_type", "condition_index")


ROW = "('1:2:' || vec_id)"


SCHEDULED = f"""WITH q AS (SELECT vec_id, label, {HN.format(f"'11:joint:' || {ROW}")} < 2147483648 AS joint, {HN.format(f"'11:size:' || {ROW}")} % 4 + 2 AS k, {_draws('suppress', ROW, 11)} AS ds, {_draws('preserve', ROW, 11)} AS dp FROM embeddings),
w AS (SELECT vec_id, joint, CASE WHEN joint THEN list_sort(list_append({_oth('ds', '(k - 1)')}, label)) ELSE [label::BIGINT] END AS s, list_sort({_oth('dp', '(CASE WHEN joint THEN k ELSE 1 END)')}) AS p FROM q)
"""


@query("g8_joint_totals", SCHEDULED + "SELECT count(*) AS rows, round(avg(joint::INT), 6) AS joint_rate, round(avg(len(s)), 6) AS mean_suppress, round(avg(len(p)), 6) AS mean_preserve FROM w")
def g8t(spark, d):
    t = x.joint_totals(x.scheduled_sets(plan_rows(spark, d), 10, 1, 2, 11))
    return t.select("rows", *(F.round(c, 6).alias(c) for c in ("joint_rate", "mean_suppress", "mean_preserve")))


@query("g8_scheduled_sets", SCHEDULED + "SELECT vec_id AS row_id, joint, array_to_string(s, ',') AS suppress, array_to_string(p, ',') AS preserve FROM w")
def g8(spark, d):
    p = x.scheduled_sets(plan_rows(spark, d), 10, 1, 2, 11)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return p.select("row_id", "joint", text("suppress"), text("preserve"))


@query("g9_wrong_target", "SELECT vec_id, (label + 1 + 23 % 9) % 10 AS wrong FROM embeddings")
def g9(spark, d):
    return table(spark, d, "embeddings").select("vec_id", x.wrong_target("label", 23, 10).alias("wrong"))


@query("g10_batches", f"SELECT vec_id // 32 AS batch_id, count(*) AS n, {HN.format(chr(39) + '13:' + chr(39) + ' || string_agg(vec_id::VARCHAR, ' + chr(39) + ',' + chr(39) + ' ORDER BY vec_id)')} AS seed FROM embeddings GROUP BY 1 HAVING count(*) = 32")
def g10(spark, d):
    return x.batches(table(spark, d, "embeddings"), "vec_id", 32, 13, True)


@query("f8_shard_layout", """WITH a AS (SELECT o_orderkey AS asset_index, o_orderstatus <> 'P' AS ok, (o_custkey % 50 + 1) AS length FROM orders),
w AS (SELECT *, asset_index // 256 AS shard, sum(CASE WHEN ok THEN length ELSE 0 END) OVER (PARTITION BY asset_index // 256 ORDER BY asset_index ROWS UNBOUNDED PRECEDING) AS e, sum(ok::INT) OVER (PARTITION BY asset_index // 256 ORDER BY asset_index ROWS UNBOUNDED PRECEDING) AS i FROM a)
SELECT asset_index, shard, CASE WHEN ok THEN (i - 1)::BIGINT END AS token_index, CASE WHEN ok THEN (e - length)::BIGINT END AS token_offset, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status FROM w""")
def f8(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_index"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_custkey") % 50 + 1).alias("length"))
    return x.shard_layout(o, 256)


@query("f9_resume_prefix", "SELECT count(*) AS done, max(o_orderkey) + 1 = count(*) AS contiguous, bool_and(o_orderkey <> 7) AS same FROM orders WHERE o_orderkey < 100")
def f9(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_index"), F.col("o_custkey").alias("asset"))
    old = o.where("asset_index < 100").withColumn("asset", F.when(F.col("asset_index") == 7, -1).otherwise(F.col("asset")))
    return x.resume_prefix(old, o)


@query("k1_cache_valid", "SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS valid FROM customer")
def k1(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("generation"), F.col("c_mktsegment").alias("assets"))
    old = c.where("c_custkey % 2 = 0").withColumn("generation", F.when(F.col("c_custkey") % 5 == 0, "stale").otherwise(F.col("generation")))
    return x.cache_valid(old, c, "c_custkey", ["generation", "assets"])


@query("k2_reuse_or_recompute", "SELECT source, doc_id, CASE WHEN doc_id % 6 IN (0, 3) THEN 'recomputed' ELSE 'reused' END AS action FROM documents")
def k2(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.struct(F.lit("a").alias("variant"), F.sha2("text", 256).alias("sha")), F.struct(F.lit("b").alias("variant"), F.sha2(F.reverse("text"), 256).alias("sha")))).alias("x")).select("sample_id", "x.*")
    cache = items.withColumn("sha", F.when(F.col("sample_id") % 6 == 3, "old").otherwise(F.col("sha"))).withColumn("value", F.when(F.col("sample_id") % 6 != 0, 1.0))
    return x.reuse_or_recompute(items, cache).join(docs.select(F.col("doc_id").alias("sample_id"), "source"), "sample_id").select("source", F.col("sample_id").alias("doc_id"), "action")


@query("k2_action_counts", "SELECT CASE WHEN doc_id % 6 IN (0, 3) THEN 'recomputed' ELSE 'reused' END AS action, count(*) AS n FROM documents GROUP BY 1")
def k2c(spark, d):
    return x.action_counts(k2(spark, d))


@query("k1_to_compute", "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 5 <> 0)")
def k1c(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("generation"))
    old = c.where("c_custkey % 2 = 0").withColumn("generation", F.when(F.col("c_custkey") % 5 == 0, "stale").otherwise(F.col("generation")))
    return x.require_valid(x.cache_valid(old, c, "c_custkey", ["generation"]), old, "c_custkey", overwrite=True)


@query("k3_generation_identity", "SELECT p_partkey, sha256('brand=' || p_brand || chr(10) || 'name=' || p_name || chr(10) || 'type=' || p_type) AS identity FROM part")
def k3(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return x.generation_identity(p.unpivot("p_partkey", ["type", "name", "brand"], "key", "value"), "p_partkey")


@query("k3_cohort_digest", tree_sql("(SELECT 0 AS one, l_orderkey, l_linenumber, 'l_linenumber=' || l_linenumber || chr(10) || 'l_orderkey=' || l_orderkey || chr(10) || 'l_partkey=' || l_partkey || chr(10) || 'l_returnflag=' || l_returnflag AS row FROM lineitem)", "one", "l_orderkey, l_linenumber", "row").replace("g AS one, ", ""))
def k3c(spark, d):
    return x.cohort_digest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query("k3_plan_digest", tree_sql("(SELECT z.s AS scenario, vec_id, 'ids=' || array_to_string(z.i, ',') || chr(10) || 'row_id=' || vec_id AS row FROM (SELECT vec_id, unnest([{'s': 'no_control', 'i': []::BIGINT[]}, {'s': 'enhance_target', 'i': [label::BIGINT]}, {'s': 'suppress_single_target', 'i': [label::BIGINT]}, {'s': 'suppress_multiple_target', 'i': list_sort(list_append(mt, label))}, {'s': 'suppress_single_others', 'i': so}, {'s': 'suppress_multiple_others', 'i': list_sort(mo)}]) AS z FROM q))", "scenario", "vec_id", "row").join([f"WITH {SETS} ", ""]))
def k3p(spark, d):
    p = x.control_scenarios(plan_rows(spark, d), 10, 4)
    named = p.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    return x.plan_digest(named, order=("row_id",), columns=("row_id", "ids"))


@query("k4_config_mismatches", "SELECT c_name AS key, CASE WHEN c_custkey % 10 <> 1 THEN c_mktsegment END AS old_value, CASE WHEN c_custkey % 10 = 2 THEN 'new' WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS new_value FROM customer WHERE c_custkey % 10 IN (1, 2, 3)")
def k4(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 10
    old = c.where(k != 1).select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    new = c.where(k != 3).select(F.col("c_name").alias("key"), F.when(k == 2, "new").otherwise(F.col("c_mktsegment")).alias("value"))
    return x.config_mismatches(old, new)


# Paired statistics

M = "mm AS (SELECT artist_key AS a, list_position(['click','error','purchase','signup','view'], scenario) - 1 AS p, avg(value) AS x FROM v_metric GROUP BY 1, 2), ok AS (SELECT a FROM mm GROUP BY 1 HAVING count(*) = 5), m AS (SELECT * FROM mm WHERE a IN (SELECT a FROM ok))"


def matrix(spark, d):
    return h.metric_matrix(metrics(spark, d).withColumn("metric", F.lit("value")), KINDS)


@query("h1_metric_matrix", f"WITH {V_METRIC}, {M} SELECT 'value' AS metric, a AS artist_key, p AS pos, round(x, 6) AS value FROM m")
def h1(spark, d):
    return matrix(spark, d).select("metric", "artist_key", "pos", F.round("value", 6).alias("value"))


@query("h2_rm_anova", f"""WITH {V_METRIC}, {M}, c AS (SELECT a, p, x - avg(x) OVER () AS x FROM m), t AS (SELECT sum(x * x) AS tot, count(DISTINCT a) AS n, count(DISTINCT p) AS k FROM c), sc AS (SELECT sum(n * mu * mu) AS v FROM (SELECT avg(x) AS mu, count(*) AS n FROM c GROUP BY p)), ss AS (SELECT sum(n * mu * mu) AS v FROM (SELECT avg(x) AS mu, count(*) AS n FROM c GROUP BY a))
SELECT 'value' AS metric, n AS artists, k AS scenarios, round((sc.v / (k - 1)) / ((tot - sc.v - ss.v) / ((n - 1) * (k - 1))), 6) AS f_statistic, (k - 1)::DOUBLE AS df1, ((n - 1) * (k - 1))::DOUBLE AS df2 FROM t, sc, ss""")
def h2(spark, d):
    return h.rm_anova(matrix(spark, d)).withColumn("f_statistic", F.round("f_statistic", 6))


@query("h3_greenhouse_geisser", f"""WITH {V_METRIC}, {M}, cv AS (SELECT a.p AS p, b.p AS q, covar_samp(a.x, b.x) AS c FROM m a JOIN m b USING (a) GROUP BY 1, 2), z AS (SELECT p, q, c - avg(c) OVER (PARTITION BY p) - avg(c) OVER (PARTITION BY q) + avg(c) OVER () AS c FROM cv)
SELECT 'value' AS metric, round(least(1.0, greatest(0.25, pow(sum(c) FILTER (WHERE p = q), 2) / (4 * sum(c * c)))), 6) AS epsilon FROM z""")
def h3(spark, d):
    return h.greenhouse_geisser(matrix(spark, d)).withColumn("epsilon", F.round("epsilon", 6))


@query("h4_friedman", f"""WITH {V_METRIC}, {M}, r0 AS (SELECT a, p, rank() OVER (PARTITION BY a ORDER BY x) AS r, count(*) OVER (PARTITION BY a, x) AS t FROM m), s AS (SELECT p, sum(r + (t - 1) / 2) AS s FROM r0 GROUP BY 1), g AS (SELECT count(DISTINCT a) AS n, sum(t * t - 1) AS tie FROM r0)
SELECT 'value' AS metric, round((12.0 / (n * 5 * 6) * (SELECT sum(s * s) FROM s) - 3.0 * n * 6) / (1 - tie / (n * 5 * 24)), 6) AS chi2, 4.0::DOUBLE AS df FROM g""")
def h4(spark, d):
    return h.friedman(matrix(spark, d)).withColumn("chi2", F.round("chi2", 6))


DIFF = "dd AS (SELECT a.a, a.p AS p, b.p AS q, b.x - a.x AS d FROM m a JOIN m b ON a.a = b.a AND a.p < b.p)"


@query("h5_mean_differences", f"WITH {V_METRIC}, {M}, {DIFF} SELECT 'value' AS metric, p, q, round(avg(d), 6) AS mean_difference, count(*) AS n FROM dd GROUP BY 2, 3")
def h5(spark, d):
    return h.mean_differences(h.paired_differences(matrix(spark, d))).withColumn("mean_difference", F.round("mean_difference", 6))


@query("i5_frechet_parts", """WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS l, list_transform(embedding[11:20], lambda x: x::DOUBLE) AS g FROM embeddings), k AS (SELECT unnest(range(1, 11)) AS i), c AS (SELECT label, i, avg(l[i]) - avg(g[i]) AS dm, var_samp(l[i]) + var_samp(g[i]) AS tr FROM e, k GROUP BY 1, 2)
SELECT label::VARCHAR AS g, round(sum(dm * dm), 6) AS mean_gap, round(sum(tr), 6) AS traces FROM c GROUP BY 1""")
def i5p(spark, d):
    from quillon.operators import metrics as m

    from .metrics import vectors

    v = vectors(spark, d)
    a, b = m.group_statistics(v, "label", "l").toDF("g", "n", "m1", "c1"), m.group_statistics(v, "label", "g").toDF("g", "n2", "m2", "c2")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, y: t + y)
    trace = lambda c: add(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get(c, i * 11)))
    return a.join(b, "g").select("g", F.round(add(F.zip_with("m1", "m2", lambda y, z: (y - z) * (y - z))), 6).alias("mean_gap"), F.round(trace("c1") + trace("c2"), 6).alias("traces"))


#: With five scenarios both tails are closed forms: F of 4 and an even number of degrees of
#: freedom, chi-square of 4.
TAILS = f"""WITH {V_METRIC}, {M}, c AS (SELECT a, p, x - avg(x) OVER () AS x FROM m), t AS (SELECT sum(x * x) AS tot, count(DISTINCT a) AS n FROM c), sc AS (SELECT sum(n * mu * mu) AS v FROM (SELECT avg(x) AS mu, count(*) AS n FROM c GROUP BY p)), ss AS (SELECT sum(n * mu * mu) AS v FROM (SELECT avg(x) AS mu, count(*) AS n FROM c GROUP BY a)),
f AS (SELECT (sc.v / 4) / ((tot - sc.v - ss.v) / ((n - 1) * 4)) AS f, ((n - 1) * 4)::DOUBLE AS df2 FROM t, sc, ss), fx AS (SELECT df2 / 2 AS b, df2 / (df2 + 4 * f) AS x FROM f),
r0 AS (SELECT a, p, rank() OVER (PARTITION BY a ORDER BY x) AS r, count(*) OVER (PARTITION BY a, x) AS t FROM m), s AS (SELECT p, sum(r + (t - 1) / 2) AS s FROM r0 GROUP BY 1), g AS (SELECT count(DISTINCT a) AS n, sum(t * t - 1) AS tie FROM r0),
h AS (SELECT (12.0 / (n * 5 * 6) * (SELECT sum(s * s) FROM s) - 3.0 * n * 6) / (1 - tie / (n * 5 * 24)) AS chi2 FROM g)
SELECT 'value' AS metric, round(pow(x, b) * (1 + b * (1 - x)), 8) AS p_value, round(exp(-chi2 / 2) * (1 + chi2 / 2), 8) AS friedman_p FROM fx, h"""


@query("h6_closed_form_tails", TAILS)
def h6t(spark, d):
    return h.omnibus(matrix(spark, d)).select("metric", F.round("p_value", 8).alias("p_value"), F.round("friedman_p", 8).alias("friedman_p"))


@query("h6_omnibus_p_values")
def h6(spark, d):
    return h.omnibus(matrix(spark, d))


#: Signs and draws come from the digits of md5 digests, 32 signs or 4 draws of each.
EDGE = "2.220446049250313e-16 * greatest(1, o) * 16"


def flips_sql(where: str, most: int) -> str:
    return f"""WITH {V_METRIC}, {M.replace('FROM v_metric', f'FROM v_metric WHERE {where}')}, {DIFF}, n0 AS (SELECT p, q, count(*) AS n, abs(avg(d)) AS o FROM dd GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY a) - 1 AS i FROM dd), r AS (SELECT i AS r FROM range({1 << most}) t(i)),
g AS (SELECT r, b, md5('0:' || r || ':' || b) AS h FROM r, (SELECT DISTINCT i // 32 AS b FROM k) WHERE r < 10000),
s AS (SELECT p, q, k.r, abs(avg(CASE WHEN (CASE WHEN n <= {most} THEN (k.r >> i) & 1 = 1 ELSE substr(h, i % 32 + 1, 1) >= '8' END) THEN d ELSE -d END)) AS v, any_value(o) AS o, any_value(n) AS n FROM (SELECT * FROM k JOIN n0 USING (p, q), r WHERE r < CASE WHEN n <= {most} THEN 1::BIGINT << n ELSE 10000 END) k LEFT JOIN g ON g.r = k.r AND g.b = k.i // 32 GROUP BY 1, 2, 3)
SELECT 'value' AS metric, p, q, round(CASE WHEN any_value(n) <= {most} THEN avg((v >= o - {EDGE})::INT) ELSE (sum((v >= o - {EDGE})::INT) + 1) / (count(*) + 1) END, 6) AS p_value FROM s GROUP BY 2, 3"""


@query("h7_permutation_p", flips_sql("true", 16))
def h7(spark, d):
    return h.permutation_p(h.paired_differences(matrix(spark, d))).withColumn("p_value", F.round("p_value", 6))


def interval_sql(where: str) -> str:
    return f"""WITH {V_METRIC}, {M.replace('FROM v_metric', f'FROM v_metric WHERE {where}')}, {DIFF}, k AS (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY p, q) AS n FROM dd), g AS (SELECT r, b, md5('0:' || r || ':' || b) AS h FROM range(2000) t(r), (SELECT DISTINCT i // 4 AS b FROM k)),
j AS (SELECT p, q, g.r, ('0x' || substr(h, (k.i % 4 * 8 + 1)::BIGINT, 8))::BIGINT % n AS i FROM k JOIN g ON g.b = k.i // 4),
e AS (SELECT p, q, r, avg(d) AS v FROM j JOIN k USING (p, q, i) GROUP BY 1, 2, 3) SELECT 'value' AS metric, p, q, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.975), 5) AS high FROM e GROUP BY 2, 3"""


@query("h8_bootstrap_ci", interval_sql("true"))
def h8(spark, d):
    ci = h.bootstrap_ci(h.paired_differences(matrix(spark, d)))
    return ci.select("metric", "p", "q", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


def pairwise_sql(k: int) -> str:
    """H5, H7 and H8 of the samples of one parity, not rounded but for the interval."""
    own = f"sample_id % 2 = {k}"
    mean = f"WITH {V_METRIC}, {M.replace('FROM v_metric', f'FROM v_metric WHERE {own}')}, {DIFF} SELECT p, q, avg(d) AS mean_difference FROM dd GROUP BY 1, 2"
    flips = flips_sql(own, 16).replace("round(CASE", "(CASE").replace("END, 6) AS p_value", "END) AS p_value")
    return f"SELECT 'm{k}' AS metric, p, q, mean_difference, p_value, low, high FROM ({mean}) JOIN ({flips}) USING (p, q) JOIN ({interval_sql(own)}) USING (p, q)"


@query("h9_pairwise_table", f"""WITH a AS ({pairwise_sql(0)} UNION ALL {pairwise_sql(1)}), o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p_value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM a)
SELECT metric, p, q, round(mean_difference, 6) AS mean_difference, round(p_value, 6) AS p_value, round(least(1.0, max((n - i) * p_value) OVER (PARTITION BY metric ORDER BY i)), 6) AS p_holm, low, high FROM o""")
def h9p(spark, d):
    """The pairwise report without the column that hangs on the corrected omnibus test."""
    pair = h9(spark, d)
    return pair.select("metric", "p", "q", *(F.round(c, 6).alias(c) for c in ("mean_difference", "p_value", "p_holm")), *(F.round(c, 5).alias(c) for c in ("low", "high")))


@query("h9_scenario_statistics")
def h9(spark, d):
    """The pairwise table; the omnibus one is h6_omnibus_p_values."""
    return h.scenario_statistics(metrics(spark, d).withColumn("metric", F.concat(F.lit("m"), (F.col("sample_id") % 2).cast("string"))), KINDS)[1]


# Series


@query("j1_envelope", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT user_id, least(i // greatest(1, n // 20), 19) AS bucket, round_even(least(1.0, max(abs(value)) / 250), 4) AS peak FROM r GROUP BY 1, 2)
SELECT user_id, bucket, coalesce(peak, 0) AS peak FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT i AS bucket FROM range(20) t(i)) LEFT JOIN b USING (user_id, bucket)""")
def j1(spark, d):
    return s.envelope(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 20, 250.0)


HOURS = "hh AS (SELECT event_type, (epoch_us(ts) // 3600000000 % 168) AS slot, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, slot, coalesce(v, 0) AS value FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT i AS slot FROM range(168) t(i)) LEFT JOIN hh USING (event_type, slot))"


def hourly(spark, d):
    e = table(spark, d, "events").withColumn("slot", F.floor(F.unix_timestamp("ts") / 3600) % 168)
    return s.resample_grid(e, "event_type", "slot", "value", 168)


@query("j5_resample_grid", f"WITH {HOURS} SELECT event_type, slot, round(value, 4) AS value FROM g")
def j5(spark, d):
    return hourly(spark, d).withColumn("value", F.round("value", 4))


@query("j2_dominant_period", f"""WITH {HOURS}, d AS (SELECT event_type, slot, greatest(0, value - lag(value) OVER (PARTITION BY event_type ORDER BY slot)) AS d FROM g), u AS (SELECT event_type, slot, (d - avg(d) OVER (PARTITION BY event_type)) / greatest(stddev_samp(d) OVER (PARTITION BY event_type), 1e-8) AS x FROM d WHERE slot > 0),
sc AS (SELECT a.event_type, b.slot - a.slot AS lag, round(avg(a.x * b.x), 9) AS sc FROM u a JOIN u b ON a.event_type = b.event_type AND b.slot - a.slot BETWEEN 2 AND 48 GROUP BY 1, 2) SELECT event_type, arg_max(lag, (sc, -lag))::INT AS period FROM sc GROUP BY 1""")
def j2(spark, d):
    return s.dominant_period(hourly(spark, d), "event_type", "slot", 2, 48)


@query("j2_period_rate", f"""WITH {HOURS}, d AS (SELECT event_type, slot, greatest(0, value - lag(value) OVER (PARTITION BY event_type ORDER BY slot)) AS d FROM g), u AS (SELECT event_type, slot, (d - avg(d) OVER (PARTITION BY event_type)) / greatest(stddev_samp(d) OVER (PARTITION BY event_type), 1e-8) AS x FROM d WHERE slot > 0),
sc AS (SELECT a.event_type, b.slot - a.slot AS lag, round(avg(a.x * b.x), 9) AS sc FROM u a JOIN u b ON a.event_type = b.event_type AND b.slot - a.slot BETWEEN 2 AND 48 GROUP BY 1, 2), p AS (SELECT event_type, arg_max(lag, (sc, -lag)) AS period FROM sc GROUP BY 1) SELECT round(avg(abs(60.0 / period - 60.0 / length(event_type))), 6) AS error, count(*) AS n FROM p""")
def j2r(spark, d):
    p = s.dominant_period(hourly(spark, d), "event_type", "slot", 2, 48)
    return s.rate_error(s.period_rate(p, "event_type", 60.0), s.period_rate(p.withColumn("period", F.length("event_type")), "event_type", 60.0), "event_type").withColumn("error", F.round("error", 6))


PROF = "p0 AS (SELECT event_type, (user_id % 7) AS frame, (event_id % 12) AS bin, sum(value) AS v FROM events GROUP BY 1, 2, 3), p1 AS (SELECT event_type, frame, bin, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY event_type, frame)), 1e-8) AS u FROM p0), pr AS (SELECT event_type, bin, sum(u) / (SELECT count(DISTINCT frame) FROM p0 f WHERE f.event_type = p1.event_type) AS weight FROM p1 GROUP BY 1, 2)"


def profiles(spark, d):
    e = table(spark, d, "events").withColumn("frame", F.col("user_id") % 7)
    return s.profile(e, "event_type", "frame", "event_id", "value")


@query("j3_profile_similarity", f"WITH {PROF}, w AS (SELECT event_type, list(weight ORDER BY bin) AS w FROM pr GROUP BY 1), z AS (SELECT event_type, list(weight ORDER BY (bin + 1) % 12) AS w FROM pr GROUP BY 1) SELECT event_type, round(list_cosine_similarity(w.w, z.w), 6) AS similarity FROM w JOIN z USING (event_type)")
def j3(spark, d):
    p = profiles(spark, d)
    return s.profile_similarity(p, p.withColumn("bin", (F.col("bin") + 1) % 12), "event_type").withColumn("similarity", F.round("similarity", 6))


@query("j4_template_match", f"""WITH {PROF}, t AS (SELECT 12 * m + r AS template, b AS bin, CASE WHEN (b - r + 12) % 12 = 0 OR (b - r + 12) % 12 = 4 - m OR (b - r + 12) % 12 = 7 THEN 0.5 ELSE -0.25 / 1.5 END AS t FROM range(2) x(m), range(12) y(r), range(12) z(b)),
sc AS (SELECT event_type, template, round(sum(weight * t), 9) AS sc FROM pr JOIN t USING (bin) GROUP BY 1, 2) SELECT event_type, arg_max(template, (sc, -template))::INT AS template FROM sc GROUP BY 1""")
def j4(spark, d):
    return s.template_match(profiles(spark, d), "event_type")
