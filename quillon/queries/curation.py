"""Catalogue curation (C, D1 to D3, E1 to E9, F1 to F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import curation as c
from quillon.operators.counters import Counters
from quillon.operators.quantiles import exact_quantiles
from quillon.plans.views import STAND_IN_EXACT, STAND_IN_KEYWORDS, V_CAPTION, V_FAMILY, V_TRACK, captions, table, tracks, tracks_by_artist
from quillon.sources.stored import stored

from .registry import query

TAG = f"tagged AS (SELECT track_id, artist_key, tag, {V_FAMILY.format(t='tag')} AS family FROM (SELECT track_id, artist_key, unnest(genres) AS tag FROM v_track))"
TAXONOMY = """anchors AS (SELECT track_id, list_sort(list_distinct(list(family))) AS families FROM tagged WHERE family IS NOT NULL GROUP BY 1),
votes AS (SELECT tag, family, sum(units)::BIGINT AS units FROM (SELECT t.tag, unnest(a.families) AS family, 360360 // len(a.families) AS units FROM tagged t JOIN anchors a USING (track_id) WHERE t.family IS NULL) GROUP BY 1, 2),
guess AS (SELECT tag, sum(units) AS total, arg_max(family, (units, family)) AS family, max(units) AS top FROM votes GROUP BY 1),
taxonomy AS (SELECT f.tag, coalesce(f.family, g.family) AS family, CASE WHEN f.family IS NOT NULL THEN 'direct' WHEN g.family IS NOT NULL THEN 'inferred' ELSE 'unresolved' END AS how,
  CASE WHEN f.family IS NULL THEN g.top / g.total END AS confidence, f.n_tracks
  FROM (SELECT tag, any_value(family) AS family, count(*) AS n_tracks FROM tagged GROUP BY 1) f LEFT JOIN (SELECT * FROM guess WHERE total >= 5 * 360360 AND top / total >= 0.35) g USING (tag))"""
BASE = f"WITH {V_TRACK}, {TAG}, {TAXONOMY}"
MAPPED = "mapped AS (SELECT v.*, c.coarse FROM v_track v JOIN (SELECT track_id, list_sort(list_distinct(list(x.family))) AS coarse FROM tagged t JOIN taxonomy x USING (tag) WHERE x.family IS NOT NULL GROUP BY 1) c USING (track_id))"
ORDER = "list_position(['ambient_newage','blues_funk_soul','cinematic','classical_orchestral','electronic_dance','experimental','folk_country','hiphop_rnb','jazz','latin','metal','pop','reggae_caribbean','rock_alternative_punk','world_traditional'], {})"
DOMINANT = f"dominant AS (SELECT artist_key, arg_max(family, (units, -{ORDER.format('family')})) AS dominant_genre FROM (SELECT artist_key, family, sum(units)::BIGINT AS units FROM (SELECT artist_key, unnest(coarse) AS family, 360360 // len(coarse) AS units FROM mapped) GROUP BY 1, 2) GROUP BY 1)"
PROFILE = """st AS (SELECT artist_key, unnest(list_distinct(style_tags)) AS tag FROM {src}),
cnt AS (SELECT artist_key, tag, count(*) AS n FROM st GROUP BY 1, 2),
world AS (SELECT tag, sum(n) AS nt, count(*) AS na FROM cnt GROUP BY 1),
siz AS (SELECT artist_key, count(*) AS size FROM {src} GROUP BY 1),
b0 AS (SELECT c.artist_key, c.tag, c.n, c.n / s.size AS support, c.n / s.size * least(1 + ln(((SELECT count(*) FROM siz) + 1) / (w.na + 1)), 3.0) AS weight, w.nt, s.size, starts_with(c.tag, 'genre:') AS g,
  row_number() OVER (PARTITION BY c.artist_key ORDER BY c.n DESC, c.tag) AS common FROM cnt c JOIN world w USING (tag) JOIN siz s USING (artist_key)),
b1 AS (SELECT *, CASE WHEN n >= 3 AND support >= 0.3 AND nt >= {glob} THEN 0 WHEN n >= least(3, greatest(2, size)) AND support >= 0.3 THEN 1 WHEN common <= 5 THEN 2 END AS tier FROM b0),
b2 AS (SELECT *, min(tier) OVER (PARTITION BY artist_key) AS best FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY weight DESC, support DESC, tag) AS rk FROM b2 WHERE tier = best OR (best = 2 AND common <= 5)),
top AS (SELECT artist_key, tag, weight, support, g FROM b3 WHERE rk <= 5),
nog AS (SELECT artist_key, max(rk) AS last FROM b3 WHERE rk <= 5 GROUP BY 1 HAVING NOT bool_or(g)),
bg AS (SELECT artist_key, arg_max(tag, (weight, support, tag)) AS tag, arg_max(weight, (weight, support, tag)) AS weight, arg_max(support, (weight, support, tag)) AS support FROM b2 WHERE g AND artist_key IN (SELECT artist_key FROM nog) GROUP BY 1),
profile AS (SELECT artist_key, tag, weight, support, row_number() OVER (PARTITION BY artist_key ORDER BY weight DESC, support DESC, tag) AS rank FROM (
  SELECT b.artist_key, b.tag, b.weight, b.support FROM b3 b LEFT JOIN (SELECT nog.* FROM nog JOIN bg USING (artist_key)) x USING (artist_key) WHERE b.rk <= 5 AND (x.last IS NULL OR b.rk <> x.last)
  UNION ALL SELECT artist_key, tag, weight, support FROM bg))"""
SCORE = """score AS (SELECT v.track_id, v.artist_key, v.album_id, v.duration, v.genres, round(coalesce(h.hit, 0.0) / t.total, 9) AS signature_score, coalesce(h.k, 0) AS tag_overlap
  FROM {src} v LEFT JOIN (SELECT artist_key, sum(weight) AS total FROM profile GROUP BY 1) t USING (artist_key)
  LEFT JOIN (SELECT s.track_id, sum(p.weight) AS hit, count(*) AS k FROM (SELECT track_id, artist_key, unnest(list_distinct(style_tags)) AS tag FROM {src}) s JOIN profile p ON s.artist_key = p.artist_key AND s.tag = p.tag GROUP BY 1) h USING (track_id))"""


def stand_in(spark, d):
    return tracks(spark, d), STAND_IN_EXACT, STAND_IN_KEYWORDS


def mapped(spark, d, read=tracks):
    t, exact, words = stand_in(spark, d)
    return c.apply_taxonomy(read(spark, d), c.infer_taxonomy(t, exact, words))


@query("c1_rejection_funnel", """
WITH r AS (SELECT CASE WHEN l_quantity = 7 THEN NULL ELSE l_orderkey::VARCHAR || '/' || l_linenumber END AS id, CASE WHEN l_quantity = 8 THEN 'missing_artist' WHEN l_returnflag = 'N' AND l_quantity > 45 THEN 'not_downloadable' WHEN l_quantity = 9 THEN 'missing_genres' END AS fault, (l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
m AS (SELECT *, min(pos) FILTER (WHERE fault IS NULL AND id IS NOT NULL) OVER (PARTITION BY id) AS first FROM r)
SELECT CASE WHEN id IS NULL THEN 'missing_id' WHEN pos > first THEN 'duplicate_id' ELSE coalesce(fault, 'accepted') END AS reason, count(*) AS n FROM m GROUP BY 1""")
def c1(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    cat = li.select(
        F.when(q != 7, F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("id"),
        F.when(q != 8, F.col("l_suppkey")).alias("artist"),
        F.when((F.col("l_returnflag") == "N") & (q > 45), False).when(q > 10, True).alias("ok"),
        F.when(q == 9, F.array().cast("array<string>")).otherwise(F.array("l_returnflag")).alias("genres"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    return c.funnel(cat, "id", "artist", F.col("ok"), "genres", ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("c2_dedup_captions", "WITH " + V_CAPTION + " SELECT count(*) AS kept, (SELECT count(*) FROM v_caption) - count(*) AS dropped FROM (SELECT DISTINCT * FROM v_caption)")
def c2(spark, d):
    cap = captions(spark, d)
    n = cap.agg(F.count("*").alias("n"))
    return c.dedup_captions(cap).agg(F.count("*").alias("kept")).join(F.broadcast(n)).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("c3_valid_captions", "WITH " + V_CAPTION + " SELECT track_id, start_time, end_time, text FROM v_caption WHERE end_time - start_time >= 5 AND start_time >= 0 AND trim(text) <> ''")
def c3(spark, d):
    return c.valid_captions(captions(spark, d))


@query("c4_usable_captions", f"""WITH {V_TRACK}, {V_CAPTION},
u AS (SELECT track_id, start_time, CASE WHEN duration > 0 THEN least(end_time, duration) ELSE end_time END AS end_time, text FROM (SELECT DISTINCT * FROM v_caption) JOIN v_track USING (track_id))
SELECT track_id, start_time, end_time, text FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_time, end_time, text) AS r FROM u WHERE end_time - start_time >= 5) WHERE r <= 2""")
def c4(spark, d):
    return c.usable_captions(c.dedup_captions(captions(spark, d)), tracks(spark, d), 5.0, 2)


@query("c5_unique_assets", "SELECT sha256(text) AS asset, min(doc_id) AS first, count(*) AS n, row_number() OVER (ORDER BY min(doc_id), sha256(text)) - 1 AS index FROM documents GROUP BY 1")
def c5(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("asset"), "doc_id")
    return c.unique_assets(docs, "asset", ["doc_id"]).select("asset", F.col("first.doc_id").alias("first"), F.col("rows").alias("n"), "index")


@query("c5_asset_totals", "SELECT count(*) AS rows, count(DISTINCT text) AS unique, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def c5t(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("asset"), "doc_id")
    return c.asset_totals(c.unique_assets(docs, "asset", ["doc_id"]))


@query("c6_filter_records", f"WITH {V_TRACK} SELECT track_id, artist_key FROM v_track WHERE artist_key IN ('id:1', 'id:3', 'id:5') AND list_has_any(genres, ['red', 'gear'])")
def c6(spark, d):
    from quillon.operators.dataset import filter_records

    return filter_records(tracks(spark, d), ["id:1", "id:3", "id:5"], ["red", "gear"], "genres").select("track_id", "artist_key")


@query("d1_captions_for_candidates", "WITH " + V_CAPTION + " SELECT track_id, count(*) AS n FROM v_caption WHERE track_id IN (SELECT l_suppkey || '-' || p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 20) GROUP BY 1")
def d1(spark, d):
    wanted = tracks(spark, d).where("duration >= 20")
    return captions(spark, d).join(wanted.select("track_id"), "track_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("n"))


@query("d2_clip_tasks", "SELECT o_orderkey AS track_id, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def d2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), "l_linenumber", "l_quantity")
    return c.clip_tasks(o.select("track_id"), li, o).select("track_id", "l_linenumber", "l_quantity")


@query("d3_attach_tokens", "SELECT CASE WHEN l.doc_id IS NULL THEN 'unprocessed' WHEN l.quality = 0 THEN 'failed' ELSE 'enriched' END AS route, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END)::BIGINT AS token_steps FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def d3(spark, d):
    assets = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))
    routed = c.attach_tokens(table(spark, d, "documents").select("doc_id", "n_chars"), assets, "doc_id")
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.when(F.col("route") == "enriched", F.col("n_chars")).otherwise(0)).alias("token_steps"))


@query("e1_tag_frequencies", f"WITH {V_TRACK} SELECT tag, count(*) AS n_tracks, count(DISTINCT artist_key) AS n_artists FROM (SELECT artist_key, unnest(style_tags) AS tag FROM v_track) GROUP BY 1")
def e1(spark, d):
    return c.tag_frequencies(tracks(spark, d))


@query("e2_genre_cooccurrence", BASE + " SELECT tag, family, units FROM votes")
def e2(spark, d):
    return c.genre_cooccurrence(*stand_in(spark, d))


@query("e3_infer_taxonomy", BASE + " SELECT tag, family, how, round(confidence, 6) AS confidence, n_tracks FROM taxonomy")
def e3(spark, d):
    return c.infer_taxonomy(*stand_in(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("e4_apply_taxonomy", f"{BASE}, {MAPPED} SELECT track_id, array_to_string(coarse, '|') AS coarse FROM mapped")
def e4(spark, d):
    return mapped(spark, d).select("track_id", F.array_join("coarse_genres", "|").alias("coarse"))


@query("e5_dominant_genre", f"{BASE}, {MAPPED}, {DOMINANT} SELECT * FROM dominant")
def e5(spark, d):
    return c.dominant_genre(mapped(spark, d))


@query("e6_artist_profiles", f"WITH {V_TRACK}, {PROFILE.format(src='v_track', glob=50)} SELECT artist_key, tag, round(weight, 6) AS weight, round(support, 6) AS support, rank FROM profile")
def e6(spark, d):
    p = c.artist_profiles(tracks(spark, d))
    return p.select("artist_key", "tag", F.round("weight", 6).alias("weight"), F.round("support", 6).alias("support"), F.col("rank").cast("long").alias("rank"))


@query("e7_signature_scores", f"WITH {V_TRACK}, {PROFILE.format(src='v_track', glob=50)}, {SCORE.format(src='v_track')} SELECT track_id, round(signature_score, 6) AS signature_score, tag_overlap FROM score")
def e7(spark, d):
    t = tracks_by_artist(spark, d)
    return c.signature_scores(t, c.artist_profiles(t)).select("track_id", F.round("signature_score", 6).alias("signature_score"), "tag_overlap")


@query("e8_artist_summary", f"WITH {V_TRACK} SELECT artist_key, count(*) AS songs, sum(length(track_id))::BIGINT AS clips, array_to_string(list_sort(list(track_id)), '|') AS track_ids, array_to_string(list_sort(list_distinct(flatten(list(genres)))), '|') AS genres, round(avg(duration), 6) AS score FROM v_track GROUP BY 1")
def e8(spark, d):
    s = c.artist_summary(tracks(spark, d).withColumn("clips", F.length("track_id")).withColumn("signature_score", F.col("duration")))
    return s.select("artist_key", "songs", "clips", F.array_join("track_ids", "|").alias("track_ids"), F.array_join("genres", "|").alias("genres"), F.round("signature_score_mean", 6).alias("score"))


@query("e9_selection_stats", "SELECT count(o_totalprice) AS n, min(o_totalprice) AS min, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 6) AS median, max(o_totalprice) AS max FROM orders")
def e9(spark, d):
    return c.selection_stats(table(spark, d, "orders"), "o_totalprice").withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 6))


@query("e9_exact_quantiles", "SELECT unnest([0.0, 0.1, 0.5, 0.975, 1.0])::DOUBLE AS fraction, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.975, 1.0])), 6) AS value FROM lineitem")
def e9q(spark, d):
    return exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.0, 0.1, 0.5, 0.975, 1.0]).withColumn("value", F.round("value", 6))


@query("e9_selection_counts", f"""{BASE}, {MAPPED}, {DOMINANT}, {PROFILE.format(src='v_track', glob=50)}, sel AS (SELECT artist_key, track_id, dominant_genre FROM mapped JOIN dominant USING (artist_key) WHERE duration >= 25)
SELECT 'total' AS section, 'artists' AS name, count(DISTINCT artist_key) AS n FROM sel UNION ALL SELECT 'total', 'songs', count(*) FROM sel UNION ALL SELECT 'total', 'clips', 2 * count(*) FROM sel
UNION ALL SELECT 'songs_by_genre', dominant_genre, count(*) FROM sel GROUP BY 2 UNION ALL SELECT 'artists_by_genre', dominant_genre, count(*) FROM dominant WHERE artist_key IN (SELECT artist_key FROM sel) GROUP BY 2
UNION ALL SELECT 'signature_tags', split_part(tag, ':', 1), count(*) FROM profile WHERE artist_key IN (SELECT artist_key FROM sel) GROUP BY 2""")
def e9c(spark, d):
    m = mapped(spark, d, tracks_by_artist)
    dom = c.dominant_genre(m)
    sel = m.where("duration >= 25").join(dom, "artist_key").withColumn("captioned_clips", F.lit(2))
    return c.selection_counts(sel, c.artist_profiles(tracks_by_artist(spark, d)), dom)


@query("e9_profile_map", f"WITH {V_TRACK}, {PROFILE.format(src='v_track', glob=50)} SELECT artist_key, string_agg(tag, '|' ORDER BY rank) AS tags, string_agg(round(weight * 1000)::INT::VARCHAR, '|' ORDER BY rank) AS weights, string_agg(round(support * 1000)::INT::VARCHAR, '|' ORDER BY rank) AS supports FROM profile GROUP BY 1")
def e9p(spark, d):
    m = c.profile_map(c.artist_profiles(tracks(spark, d)))
    text = lambda n: F.array_join(F.transform("tags", lambda x: F.round(F.element_at(n, x) * 1000).cast("int").cast("string")), "|").alias(n)
    return m.select("artist_key", F.array_join("tags", "|").alias("tags"), text("weights"), text("supports"))


@query("e9_curation_counters", f"""{BASE}, {MAPPED}, {V_CAPTION}, routed AS (SELECT l.doc_id IS NULL AS none, coalesce(l.quality = 1, false) AS ok, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'taxonomy' AS section, unnest(['tags', 'direct', 'inferred', 'unresolved']) AS name, unnest([count(*), count(*) FILTER (WHERE how = 'direct'), count(*) FILTER (WHERE how = 'inferred'), count(*) FILTER (WHERE how = 'unresolved')]) AS n FROM taxonomy
UNION ALL SELECT 'coarse_genres', unnest(['tracks', 'tracks_dropped_without_coarse_genre']), unnest([(SELECT count(*) FROM v_track), (SELECT count(*) FROM v_track) - (SELECT count(*) FROM mapped)])
UNION ALL SELECT 'captions_read', 'rows', count(*) FROM v_caption UNION ALL SELECT 'captions_kept', 'rows', count(*) FROM (SELECT DISTINCT * FROM v_caption)
UNION ALL SELECT 'tokens', unnest(['unprocessed', 'failed', 'enriched', 'token_steps']), unnest([count(*) FILTER (WHERE none), count(*) FILTER (WHERE NOT none AND NOT ok), count(*) FILTER (WHERE ok), sum(n_chars) FILTER (WHERE ok)::BIGINT]) FROM routed""")
def e9k(spark, d):
    """What the steps of a curation count while their results are written."""
    counters = Counters()
    t, exact, words = stand_in(spark, d)
    taxonomy = stored(c.infer_taxonomy(t, exact, words, counters=counters))
    stored(c.apply_taxonomy(t, taxonomy, counters))
    stored(c.dedup_captions(captions(spark, d), counters))
    assets = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))
    stored(c.attach_tokens(table(spark, d, "documents").select("doc_id", "n_chars"), assets, "doc_id", counters, "n_chars"))
    return counters.table(spark)


@query("e13_failures", "SELECT l_orderkey AS track_id, l_linenumber, CASE WHEN l_quantity > 10 THEN 'q' || l_quantity::BIGINT ELSE 'unknown' END AS error FROM lineitem WHERE l_linestatus <> 'F'")
def e13f(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), "l_linenumber", F.when(F.col("l_linestatus") == "F", "ok").otherwise("bad").alias("status"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string"))).alias("error"))
    return c.failures(li, "track_id", "l_linenumber")


@query("e13_run_totals", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS selected_artists, (SELECT count(*) FROM orders) AS selected_songs, (SELECT sum(o_orderkey % 4)::BIGINT FROM orders) AS expected_clips, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS successful_downloads, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS failed_downloads, count(*) FILTER (WHERE l_linestatus = 'F') AS successful_clips, count(*) FILTER (WHERE l_linestatus <> 'F') AS failed_clips FROM lineitem")
def e13t(spark, d):
    o = table(spark, d, "orders")
    selected = o.select(F.col("o_custkey").alias("artist_key"), F.col("o_orderkey").alias("track_id"), (F.col("o_orderkey") % 4).alias("expected"))
    status = lambda df, col: df.select(F.when(F.col(col) == "F", "ok").otherwise("bad").alias("status"))
    return c.completeness_totals(selected, status(o, "o_orderstatus"), status(table(spark, d, "lineitem"), "l_linestatus"))


@query("e13_completeness", """
SELECT o_orderkey AS track_id, expected, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) FILTER (WHERE l_linestatus <> 'F') AS failed, count(*) FILTER (WHERE l_linestatus = 'F') = expected AND count(*) FILTER (WHERE l_linestatus <> 'F') = 0 AS removable
FROM (SELECT o_orderkey, o_orderkey % 4 AS expected FROM orders) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def e13(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), (F.col("o_orderkey") % 4).alias("expected"))
    clips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("bad").alias("status"))
    return c.completeness(o, clips)


PICK = "SELECT artist_key, dominant_genre, n_tracks FROM (SELECT *, row_number() OVER (PARTITION BY dominant_genre ORDER BY n_tracks DESC, sha256('{seed}:artists:' || artist_key), artist_key) - 1 AS turn, count(*) OVER (PARTITION BY dominant_genre) AS k FROM {src}) ORDER BY turn, k - turn DESC, " + ORDER.format("dominant_genre") + " LIMIT {n}"


@query("f1_choose_artists_balanced", f"{BASE}, {MAPPED}, {DOMINANT}, cat AS (SELECT artist_key, dominant_genre, count(*) AS n_tracks FROM mapped JOIN dominant USING (artist_key) GROUP BY 1, 2) {PICK.format(seed=42, src='cat', n=7)}")
def f1(spark, d):
    m = mapped(spark, d)
    cat = m.join(c.dominant_genre(m), "artist_key").groupBy("artist_key", "dominant_genre").agg(F.count("*").alias("n_tracks"))
    return c.choose_artists_balanced(cat, 7, 42).drop("turn")


REPRESENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY over_cap, signature_score DESC, tag_overlap DESC, track_id) AS rank, count(*) OVER (PARTITION BY artist_key) AS n FROM (SELECT *, album_id IS NOT NULL AND row_number() OVER (PARTITION BY artist_key, album_id ORDER BY signature_score DESC, tag_overlap DESC, track_id) > 2 AS over_cap FROM {src})) WHERE rank <= {k} AND n >= {k}"


@query("f2_representative_tracks", f"WITH {V_TRACK}, {PROFILE.format(src='v_track', glob=50)}, {SCORE.format(src='v_track')} SELECT artist_key, track_id, rank FROM ({REPRESENT.format(src='score', k=12)})")
def f2(spark, d):
    t = tracks_by_artist(spark, d)
    scored = c.signature_scores(t, c.artist_profiles(t), "album_id")
    return c.select_representative(scored, 12, strict=False).select("artist_key", "track_id", F.col("rank").cast("long").alias("rank"))


@query("f3_build_selection", f"""{BASE}, {MAPPED}, {DOMINANT}, {PROFILE.format(src='mapped', glob=50)}, {SCORE.format(src='mapped')}, {V_CAPTION},
fit AS (SELECT s.*, dominant_genre FROM score s JOIN dominant USING (artist_key) JOIN (SELECT track_id, coarse FROM mapped) USING (track_id) WHERE signature_score > 0 AND list_contains(coarse, dominant_genre)),
cat1 AS (SELECT artist_key, dominant_genre, count(*) AS n_tracks FROM fit GROUP BY 1, 2 HAVING count(*) >= 3),
pick1 AS ({PICK.format(seed=42, src='cat1', n=26)}),
clip AS (SELECT track_id, count(*) AS captioned_clips FROM (SELECT DISTINCT track_id, start_time, end_time, text FROM v_caption) JOIN (SELECT track_id, duration FROM fit) USING (track_id)
  WHERE end_time - start_time >= 5 AND (CASE WHEN duration > 0 THEN least(end_time, duration) ELSE end_time END) - start_time >= 5 GROUP BY 1),
near AS (SELECT * FROM fit JOIN clip USING (track_id) WHERE artist_key IN (SELECT artist_key FROM pick1)),
cat2 AS (SELECT artist_key, dominant_genre, count(*) AS n_tracks FROM near GROUP BY 1, 2 HAVING count(*) >= 3),
pick2 AS ({PICK.format(seed=43, src='cat2', n=6)})
SELECT artist_key, track_id, dominant_genre, captioned_clips, rank FROM ({REPRESENT.format(src="(SELECT * FROM near WHERE artist_key IN (SELECT artist_key FROM pick2))", k=3)})""")
def f3(spark, d):
    _, exact, words = stand_in(spark, d)
    chosen = c.build_selection(tracks_by_artist(spark, d), captions(spark, d), 6, 3, exact=exact, keywords=words)
    return chosen.select("artist_key", "track_id", "dominant_genre", "captioned_clips", F.col("rank").cast("long").alias("rank"))
