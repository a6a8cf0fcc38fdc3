"""Scalar functions (B), validation (C) and file-level digests (A) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators.checks import unique
from quillon.operators.digests import row_text, tree_digest, tree_sql
from quillon.plans.views import table
from quillon.sources.readers import collection_digest, content_digest, metric_columns, unpivot_metrics, violation_counts

from .registry import query

JOINED = "array_to_string({}, '|')"


def joined(c):
    return F.array_join(c, "|")


@query("a3_manifest_violations", "SELECT count(*) AS n_rows, sum(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN l_quantity <= 5 THEN 1 ELSE 0 END)::BIGINT AS bad_length, sum(CASE WHEN l_linenumber - 2 < 0 THEN 1 ELSE 0 END)::BIGINT AS bad_offset FROM lineitem")
def a3(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("token_length"), (F.col("l_linenumber") - 2).alias("token_offset"))
    return violation_counts(li, {"missing": F.col("token_length").isNull(), "bad_length": F.col("token_length") <= 5, "bad_offset": F.col("token_offset") < 0})


@query("a4_metric_discovery", """
SELECT 'lineitem:' || column_name AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM (
  SELECT l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR column_name IN (l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)) GROUP BY 1""")
def a4(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    strings = li.select(*[F.col(c).cast("string").alias(c) for c in li.columns])
    return unpivot_metrics(strings, metric_columns(strings, []), "lineitem").groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("a8_content_digests", """
WITH f AS (SELECT source, doc_id, length(text) AS n, sha256(text) AS sha FROM documents)
SELECT source, count(*) AS n_files, sha256(string_agg(doc_id || ':' || n || ':' || sha, chr(10) ORDER BY doc_id)) AS digest FROM f GROUP BY source""")
def a8(spark, d):
    files = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"), content_digest("text").alias("sha"))
    return collection_digest(files, "source", "doc_id")


@query("a8_tree_digests", tree_sql("(SELECT source, doc_id, 'doc_id=' || doc_id || chr(10) || 'sha=' || sha256(text) || chr(10) || 'size=' || length(text) AS row FROM documents)", "source", "doc_id", "row"))
def a8t(spark, d):
    files = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"), content_digest("text").alias("sha"))
    return tree_digest(files, "source", ["doc_id"], row_text("doc_id", "size", "sha"))


@query("b1_clean_values", """
SELECT doc_id, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') IS NULL AS blank, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, TRY_CAST(regexp_extract(text, '[0-9]+') AS DOUBLE) AS number FROM documents""")
def b1(spark, d):
    c = t.clean_text("text")
    return table(spark, d, "documents").select("doc_id", c.isNull().alias("blank"), F.length(F.coalesce(c, F.lit(""))).cast("long").alias("n"), t.clean_float(F.regexp_extract("text", "[0-9]+", 0)).alias("number"))


@query("b2_normalize_genres", "SELECT p_partkey, " + JOINED.format("list_sort(list_distinct(list_transform(string_split(p_name || ' ' || p_name, ' '), lambda x: lower(trim(x)))))") + " AS genres FROM part")
def b2(spark, d):
    return table(spark, d, "part").select("p_partkey", joined(t.normalize_genres(F.split(F.concat_ws(" ", "p_name", F.upper("p_name")), " "))).alias("genres"))


@query("b2_scalar_or_array", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) WHEN p_partkey % 4 = 1 THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') END AS genres,
CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN p_brand ELSE array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') END AS record FROM part""")
def b2s(spark, d):
    """A label field that holds a text, a number or an array."""
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.to_json(F.struct(F.col("p_type").alias("v")))).when(k == 1, '{"v": 5}').otherwise(F.to_json(F.struct(F.split("p_name", " ").alias("v"))))
    found = t.labels(F.try_variant_get(F.parse_json(value), "$.v", "variant"))
    return table(spark, d, "part").select("p_partkey", joined(t.normalize_genres(found)).alias("genres"), joined(t.record_genres(found, "p_brand")).alias("record"))


@query("b3_style_tags", "SELECT p_partkey, " + JOINED.format("list_sort(list_concat(list_transform(list_distinct(string_split(p_name, ' ')), lambda x: 'genre:' || x), ['instrument:' || lower(p_type)], ['vartag:' || lower(p_brand)]))") + " AS tags FROM part")
def b3(spark, d):
    tags = t.style_tags(F.split("p_name", " "), F.array("p_type"), F.array("p_brand"))
    return table(spark, d, "part").select("p_partkey", joined(tags).alias("tags"))


@query("b4_artist_key", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name:' || lower(c_name) ELSE 'id:' || c_custkey END AS artist_key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS record_key FROM customer")
def b4(spark, d):
    own = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", t.artist_key(own, F.concat(F.lit(" "), "c_name")).alias("artist_key"), t.record_artist_key(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" "), "c_name").alias("record_key"))


@query("b5_track_key", "SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) || '::' || CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR ELSE regexp_replace(url, '/[^/]*$', '') END AS track_key FROM pages")
def b5(spark, d):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").select("page_id", t.track_key(host, F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), "url").alias("track_key"))


@query("b6_record_genres", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE " + JOINED.format("list_sort(list_distinct(string_split(p_name, ' ')))") + " END AS genres FROM part")
def b6(spark, d):
    words = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(" "))).otherwise(F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", joined(t.record_genres(words, "p_type")).alias("genres"))


@query("b7_safe_names", r"""
WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(url || repeat('x', (page_id % 3)::INT * 30), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS s, url || repeat('x', (page_id % 3)::INT * 30) AS v FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'item_' || left(sha1(v), 12) WHEN length(s) > 96 THEN left(s, 80) || '_' || left(sha1(v), 10) ELSE s END AS name, CASE WHEN page_id % 5 = 0 THEN 'page_' || page_id ELSE left(regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80) END AS slug FROM c""")
def b7(spark, d):
    long = F.concat("url", F.expr("repeat('x', cast(page_id % 3 as int) * 30)"))
    return table(spark, d, "pages").select("page_id", t.safe_path_component(long).alias("name"), t.slug(F.when(F.col("page_id") % 5 == 0, "..-_").otherwise(F.col("url")), F.concat(F.lit("page_"), F.col("page_id").cast("string"))).alias("slug"))


@query("b8_record_identifiers", r"""
SELECT doc_id, left(sha256(trim(regexp_replace(nfc_normalize(text), '[' || '\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}' || ']+', ' ', 'g'))), 16) AS caption_hash, round_even(n_chars / 16.0 * 1000, 0)::BIGINT AS start_ms,
CASE doc_id % 3 WHEN 0 THEN 't' || doc_id WHEN 1 THEN source ELSE 'row_' || doc_id END AS track_id, CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'clip.' || doc_id ELSE 'row_' || doc_id END AS clip_id FROM documents""")
def b8(spark, d):
    k, own = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    audio = F.when(k == 1, F.concat(F.lit("a/track_"), F.col("source"), F.lit("/clip."), own, F.lit(".flac"))).otherwise("")
    named = lambda x: F.when(k == 0, F.concat(F.lit(x), own)).otherwise(" ")
    return table(spark, d, "documents").select("doc_id", t.caption_hash(t.canonical_caption("text")).alias("caption_hash"), t.milliseconds(F.col("n_chars") / 16.0, F.lit("x"), 1).alias("start_ms"), t.track_identifier(named("t"), audio, "doc_id").alias("track_id"), t.clip_identifier(named("c"), audio, "doc_id").alias("clip_id"))


@query("b9_sample_id", r"""
SELECT sample_id, count(*) AS n FROM (SELECT 'jmdmc__a_artist_' || l_suppkey || '__t_' || left('p_' || l_partkey || repeat('x', 40), 32) || '__s_' || lpad(((l_linenumber - 1) * 30000)::VARCHAR, 9, '0') || '__e_' || lpad(((l_linenumber - 1) * 30000 + l_quantity * 1000)::BIGINT::VARCHAR, 9, '0') || '__c_' || left(sha256(l_returnflag), 16) AS sample_id FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def b9(spark, d):
    li = table(spark, d, "lineitem")
    start = (F.col("l_linenumber") - 1) * 30000
    end = (start + F.col("l_quantity") * 1000).cast("long")
    track = F.concat(F.lit("p!"), F.col("l_partkey").cast("string"), F.lit("x" * 40))
    key = t.sample_id(F.lit("--"), track, start, end, F.col("l_returnflag"), "l_suppkey")
    return li.select(key.alias("sample_id")).groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


@query("b9_unique_sample_ids", r"""
SELECT l_orderkey, l_linenumber, 'jmdmc__a_artist_' || l_suppkey || '__t_' || left('p_' || l_partkey || repeat('x', 40), 32) || '__s_' || lpad(((l_linenumber - 1) * 30000)::VARCHAR, 9, '0') || '__e_' || lpad(((l_linenumber - 1) * 30000 + l_quantity * 1000)::BIGINT::VARCHAR, 9, '0') || '__c_' || left(sha256(l_orderkey || '/' || l_linenumber), 16) AS sample_id FROM lineitem""")
def b9u(spark, d):
    """The ids themselves, under the guard against collisions."""
    li = table(spark, d, "lineitem")
    start = (F.col("l_linenumber") - 1) * 30000
    end = (start + F.col("l_quantity") * 1000).cast("long")
    track = F.concat(F.lit("p!"), F.col("l_partkey").cast("string"), F.lit("x" * 40))
    caption = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return unique(li.select("l_orderkey", "l_linenumber", t.sample_id(F.lit("--"), track, start, end, caption, "l_suppkey").alias("sample_id")), "sample_id", "sample ids collide")


@query("b10_direct_family", """
SELECT tag, CASE WHEN tag IN ('red', 'small') THEN 'pop' WHEN contains(tag, 'ol') THEN 'metal' WHEN contains(tag, 'r') THEN 'jazz' END AS family FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part)""")
def b10(spark, d):
    tags = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    return tags.select("tag", t.direct_family("tag", {"red": "pop", "small": "pop"}, (("metal", ("ol",)), ("jazz", ("r", "ol")))).alias("family"))


@query("b11_resolve_group", "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'low' WHEN 'promo' THEN 'low' WHEN 'large' THEN 'high' ELSE CASE WHEN p_brand = 'Brand#1' THEN 'first' END END AS grp FROM part")
def b11(spark, d):
    return table(spark, d, "part").select("p_partkey", t.resolve_group(F.concat(F.lit(" _"), "p_type"), F.regexp_replace("p_brand", "#", "-"), {"economy": "low", "promo": "low", "large": "high", "brand 1": "first"}).alias("grp"))


@query("b12_resolve_entity", """
WITH e AS (SELECT s_suppkey, 'k' || s_suppkey AS key, s_suppkey * 2 AS index, CASE WHEN s_suppkey % 7 = 0 THEN 'same' ELSE s_name END AS name FROM supplier),
r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey::VARCHAR WHEN 1 THEN 'k' || s_suppkey WHEN 2 THEN ' ' || upper(CASE WHEN s_suppkey % 7 = 0 THEN 'same' ELSE s_name END) ELSE 'nobody' END AS value FROM supplier),
m AS (SELECT r.s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'key' ELSE 'name' END AS how, (SELECT count(*) FROM e WHERE CASE r.s_suppkey % 4 WHEN 0 THEN e.index = r.s_suppkey WHEN 1 THEN e.key = r.value ELSE lower(e.name) = lower(trim(r.value)) END) AS matches,
  (SELECT min(e.s_suppkey) FROM e WHERE CASE r.s_suppkey % 4 WHEN 0 THEN e.index = r.s_suppkey WHEN 1 THEN e.key = r.value ELSE lower(e.name) = lower(trim(r.value)) END) AS entity FROM r)
SELECT s_suppkey, CASE WHEN matches > 0 THEN how END AS how, matches, entity FROM m""")
def b12(spark, d):
    from quillon.operators.ranking import resolve_entity

    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    name = F.when(k % 7 == 0, "same").otherwise(F.col("s_name"))
    own = k.cast("string")
    value = F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("k"), own)).when(k % 4 == 2, F.concat(F.lit(" "), F.upper(name))).otherwise("nobody")
    entities = s.select(k.alias("entity"), F.concat(F.lit("k"), own).alias("key"), (k * 2).alias("index"), name.alias("name"))
    return resolve_entity(s.select(k.alias("request"), value.alias("value")), entities).withColumnRenamed("request", "s_suppkey")


@query("b13_fixed_numbers", "SELECT o_orderstatus, printf('%.4f', avg(o_orderkey % 1024)) AS mean_text, printf('%.4f ± %.4f', avg(o_orderkey % 1024), stddev_pop(o_orderkey % 1024)) AS both_text, count(*) AS n FROM orders GROUP BY 1")
def b13(spark, d):
    k = F.col("o_orderkey") % 1024
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.avg(k).alias("m"), F.stddev_pop(k).alias("s"), F.count("*").alias("n"))
    return g.select("o_orderstatus", t.fixed("m", 4, "n").alias("mean_text"), t.mean_std("m", "s", "n").alias("both_text"), "n")


@query("b14_stable_hash_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7:part:' || p_brand || ':' || p_partkey), p_partkey) AS rank FROM part")
def b14(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(t.stable_hash(7, "part", "p_brand", "p_partkey"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("b15_display_table", "SELECT vec_id, label, CASE WHEN len(embedding) > 0 THEN 'words/' || vec_id END AS words, 'words' AS column, json_array(label::VARCHAR, vec_id::VARCHAR)::VARCHAR AS json FROM embeddings")
def b15(spark, d):
    from quillon.operators.ranking import display_payloads

    e = table(spark, d, "embeddings").select("vec_id", "label", F.array(F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("words"))
    shown, side = display_payloads(e, "vec_id")
    return shown.join(side, F.split_part("words", F.lit("/"), F.lit(2)) == F.col("payload_key")).select("vec_id", "label", "words", "column", "json")


@query("b16_path_inside_root", "SELECT page_id, CASE WHEN starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') THEN false ELSE p <> '' AND NOT list_contains(string_split(p, '/'), '..') END AS inside FROM (SELECT page_id, (CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN 'a/' ELSE 'a/../' END) || regexp_replace(url, '^[a-z]+://[^/]*/', '') AS p FROM pages)")
def b16(spark, d):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, "a/").otherwise("a/../"), F.regexp_replace("url", "^[a-z]+://[^/]*/", ""))
    return table(spark, d, "pages").select("page_id", t.path_inside_root(path).alias("inside"))
