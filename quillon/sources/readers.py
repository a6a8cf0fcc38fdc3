"""Sources: JSON lines catalogues and captions, manifests, metric tables, results, binary files."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import artist_key, clean_text, is_mp3, labels, normalize_genres, style_tags
from quillon.operators.checks import checked
from quillon.operators.counters import Counters, watched
from quillon.sources import files

_STR = T.StringType()
TAGS = ("genres", "instruments", "vartags")
CATALOG = T.StructType(
    [T.StructField(n, _STR) for n in ("id", "name", "artist_id", "artist_name", "album_id", "album_name", "duration", "releasedate", "audiodownload")]
    + [T.StructField(n, T.VariantType()) for n in ("audiodownload_allowed", "musicinfo", "music_info")]
    + [T.StructField("_corrupt", _STR)]
)
CAPTIONS = T.StructType([T.StructField("id", _STR), T.StructField("caption", _STR), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType()), T.StructField("_corrupt", _STR)])
DATED = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].jsonl"


def _json_lines(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def file_position(line: Column) -> Column:
    """Where a row stands in the files read, as a text in their order: path, part of the file,
    then line, a number that grows from row to row of a part."""
    meta = F.col("_metadata")
    return F.concat_ws("|", meta.getField("file_path"), *(F.lpad(n.cast("string"), 20, "0") for n in (meta.getField("file_block_start"), line)))


def catalog_values(raw: DataFrame) -> DataFrame:
    """Rows of CATALOG with genres, instruments and vartags as arrays (a single text is one
    label) from musicinfo or music_info, and audiodownload_allowed as a boolean: false only where
    it is the value false."""
    tags = F.coalesce(*(F.try_variant_get(c, "$.tags", "variant") for c in ("musicinfo", "music_info")))
    allowed = ~((F.schema_of_variant("audiodownload_allowed") == "BOOLEAN") & ~F.try_variant_get("audiodownload_allowed", "$", "boolean"))
    found = raw.withColumns({n: labels(F.try_variant_get(tags, f"$.{n}", "variant")) for n in TAGS})
    return found.withColumn("audiodownload_allowed", F.coalesce(allowed, F.lit(True))).drop("musicinfo", "music_info")


def read_catalog(spark: SparkSession, folder: str, glob: str = DATED, counters: Counters | None = None) -> DataFrame:
    """Rows of the files named YYYY-MM-DD.jsonl (or as glob says) with catalog_values
    and their position in file order; a malformed line has its text in _corrupt, blank lines are
    skipped. counters: section metadata, with
    metadata_rows and metadata_parse_errors."""
    raw = _json_lines(spark, folder, CATALOG, glob)
    if not raw.inputFiles():
        raise FileNotFoundError(f"no catalogue file {glob} in {folder}")
    found = catalog_values(raw.withColumns({"file_name": F.col("_metadata.file_name"), "position": file_position(F.monotonically_increasing_id())}))
    return watched(counters, found, "metadata", metadata_rows=F.count("*"), metadata_parse_errors=F.count_if(F.col("_corrupt").isNotNull()))


def catalog_tracks(catalog: DataFrame) -> DataFrame:
    """Rows of read_catalog as tracks: cleaned texts, artist_key, genres and style_tags."""
    tidy = catalog.withColumns({c: clean_text(c) for c in ("id", "name", "artist_id", "artist_name", "album_id", "album_name")})
    out = tidy.withColumns({"genres": normalize_genres("genres"), "style_tags": style_tags("genres", "instruments", "vartags")})
    return out.withColumn("artist_key", artist_key("artist_id", "artist_name")).withColumnRenamed("id", "track_id").withColumnRenamed("name", "title")


def read_captions(spark: SparkSession, path: str, candidates: DataFrame | None = None, counters: Counters | None = None) -> DataFrame:
    """Caption lines (malformed ones in _corrupt), of the candidate track_ids only if given.
    counters: section captions, with caption_rows and caption_parse_errors of all lines."""
    raw = _json_lines(spark, path, CAPTIONS).select(F.col("id").alias("track_id"), "start_time", "end_time", F.col("caption").alias("text"), "_corrupt")
    raw = watched(counters, raw, "captions", caption_rows=F.count("*"), caption_parse_errors=F.count_if(F.col("_corrupt").isNotNull()))
    return raw if candidates is None else raw.join(candidates.select("track_id"), "track_id", "left_semi")


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: n_rows and the number of rows that break each rule."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(rule).alias(name) for name, rule in rules.items()))


def require_none(df: DataFrame, rules: dict[str, Column], empty_ok: bool = False) -> DataFrame:
    """df itself, once no row breaks a rule (and there is a row): one aggregate, else an error."""
    row = violation_counts(df, rules).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_rows" and v}
    if broken or (not row["n_rows"] and not empty_ok):
        raise ValueError(f"invalid input: {broken or 'no rows'}")
    return df


MANIFEST = (
    "audio string, text string, track_id string, artist_key string, artist_id string, artist_name string, title string, genres variant, coarse_genres variant, signature_tags variant, coarse_genre string, signature_score double, "
    "start_time double, end_time double, duration double, token_shard string, token_offset long, token_length long, token_codebooks int, token_codebook_size int, token_dtype string"
)


def read_token_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines manifest, its labels (a text or an array) as arrays; required fields, positive
    lengths, offsets from 0 and an entity key in every row, else an error."""
    df = spark.read.schema(MANIFEST).json(path)
    df = df.withColumns({c: F.when(F.col(c).isNotNull(), labels(c)) for c in ("genres", "coarse_genres", "signature_tags")})
    needed = ["audio", "text", "token_shard", "token_offset", "token_length"]
    entity = ["artist_key", "artist_id", "artist_name"]
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed])
    return require_none(df, {"missing": null, "length": F.col("token_length") <= 0, "offset": F.col("token_offset") < 0, "entity": F.coalesce(*entity).isNull()})


ENTITY_KEYS = ("sample_id", "sample_index", "artist_key")
#: Known metrics with their labels, entity levels and directions.
KNOWN_METRICS = {
    "passt_kl_to_reference": ("PaSST KL(reference || generated)", "clip", "kl_reference_to_generated", "minimize"),
    "fad_to_reference": ("FAD to reference", "artist", "fad", "minimize"),
    "target_attribution_hit": ("Target artist top-1 hit", "clip", "target_attribution_hit", "maximize"),
    "target_artist_confidence": ("Target artist confidence", "clip", "target_artist_confidence", "maximize"),
    "target_artist_rank": ("Target artist rank", "clip", "target_artist_rank", "minimize"),
    "target_attribution_rate": ("Target artist attribution rate", "artist", "target_attribution_rate", "maximize"),
    "mean_target_artist_confidence": ("Mean target artist confidence", "artist", "mean_target_artist_confidence", "maximize"),
    "mean_target_artist_rank": ("Mean target artist rank", "artist", "mean_target_artist_rank", "minimize"),
}
#: Numeric columns that are no metrics.
NOT_METRICS = ("scenario", "scenario_label", "sample_index", "sample_id", "checkpoint_id", "artist_key", "artist_index", "artist_clip_index", "track_id", "clip_id", "start_ms", "end_ms", "caption_sha256_16", "predicted_artist_index", "predicted_artist_key", "num_clips", "num_reference_windows", "num_generated_windows")


def describe_metrics(long: DataFrame) -> DataFrame:
    """long (metric as stem:column, ...) with metric_id, label and direction: those of a known
    metric of that column, else metric itself, the column's name and null."""
    column = F.substring_index("metric", ":", -1)
    known = F.create_map(*(F.lit(x) for k, (label, _, c, way) in KNOWN_METRICS.items() for x in (c, f"{k}\t{label}\t{way}")))
    parts = F.split(F.element_at(known, column), "\t")
    return long.withColumns({"metric_id": F.coalesce(F.get(parts, F.lit(0)), "metric"), "label": F.coalesce(F.get(parts, F.lit(1)), F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))), "direction": F.get(parts, F.lit(2))})


def _number_checks(names: list[str]) -> list[Column]:
    filled = lambda c: F.trim(F.col(c)) != ""
    return [F.struct(F.count_if(filled(c)).alias("n"), F.count_if(filled(c) & F.col(c).try_cast("double").isNull()).alias("bad")).alias(c) for c in names]


def metric_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Columns whose values all read as numbers, at least one not empty: one aggregate."""
    names = [c for c in df.columns if c not in keys and c not in NOT_METRICS]
    row = df.agg(*_number_checks(names)).first()
    return [c for c in names if row[c]["n"] > 0 and row[c]["bad"] == 0]


def unpivot_metrics(df: DataFrame, columns: list[str], stem: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long form: keys, metric (<stem>:<column>), value; empty values go."""
    typed = df.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), columns, "column", "value").where("value is not null").select(*keys, F.concat(F.lit(f"{stem}:"), "column").alias("metric"), "value")


def read_metric_table(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """A long-form CSV with a scenario column: entity_level, entity, scenario, metric, value, and
    what is known of the metric (describe_metrics)."""
    df = spark.read.csv(path, header=True)
    entity = next((k for k in ENTITY_KEYS if k in df.columns), None)
    if "scenario" not in df.columns or entity is None:
        raise ValueError("a metric table needs a scenario and an entity column")
    found = metric_columns(df, list(ENTITY_KEYS))
    return describe_metrics(unpivot_metrics(df, found, stem, ("scenario", entity)).withColumnRenamed(entity, "entity").withColumn("entity_level", F.lit(entity)))


def read_metric_tables(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """read_metric_table of all files of a folder that have a scenario and an entity column, each
    under its name as stem; other files are left out, and a folder without such a file is an error.

    Files of one header are read together, whatever other headers there are. Two passes over the
    files before the result's: their first lines, and which columns are numbers in which file.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(folder).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in first.collect():
        groups.setdefault(tuple(next(csv.reader([row["header"].removeprefix("\ufeff")]), [])), []).append(row["file_path"])
    found = []
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("_stem")
    for header, paths in sorted(groups.items()):
        entity = next((k for k in ENTITY_KEYS if k in header), None)
        if "scenario" not in header or entity is None:
            continue
        df = spark.read.schema(T.StructType([T.StructField(c, _STR) for c in header])).option("header", True).option("enforceSchema", True).csv(sorted(paths)).select("*", stem)
        names = [c for c in header if c not in (*ENTITY_KEYS, *NOT_METRICS)]
        if not names:
            continue
        rows = df.groupBy("_stem").agg(*_number_checks(names)).collect()
        metrics = [f"{r['_stem']}:{c}" for r in rows for c in names if r[c]["n"] and not r[c]["bad"]]
        typed = df.select("_stem", "scenario", F.col(entity).alias("entity"), *[F.col(c).try_cast("double").alias(c) for c in names])
        long = typed.unpivot(["_stem", "scenario", "entity"], names, "column", "value").where("value is not null")
        kept = long.select("scenario", "entity", F.concat_ws(":", "_stem", "column").alias("metric"), "value").where(F.col("metric").isin(metrics))
        found.append(kept.withColumn("entity_level", F.lit(entity)))
    if not found:
        raise ValueError(f"no metric table {glob} in {folder}")
    return describe_metrics(reduce(DataFrame.unionByName, found))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A published-results document as rows: section, row, label, metric, value, shown (fixed
    decimals, an em dash for null). Repeated or blank ids of rows, and of metrics where the
    document's groups name them (metric_groups: id, metrics of id and label), are an error."""
    schema = "metric_groups array<struct<id:string,label:string,metrics:array<struct<id:string,label:string>>>>, sections array<struct<id:string,rows:array<struct<id:string,label:string,values:map<string,double>>>>>"
    metrics = metric_groups(spark, path)
    if not metrics.groupBy("metric").agg(F.count("*").alias("n")).where("n > 1 or metric is null or trim(metric) = ''").isEmpty():
        raise ValueError("metrics need distinct ids")
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("sections").alias("s")).select(F.col("s.id").alias("section"), F.explode("s.rows").alias("r"))
    bad = rows.groupBy("section", F.col("r.id").alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null or trim(id) = ''")
    if not bad.isEmpty():
        raise ValueError("result rows need distinct ids")
    long = rows.select("section", F.col("r.id").alias("row"), F.col("r.label").alias("label"), F.explode(F.map_entries("r.values")).alias("e"))
    return long.select("section", "row", "label", F.col("e.key").alias("metric"), F.col("e.value").alias("value"), F.coalesce(F.format_string("%.3f", "e.value"), F.lit("—")).alias("shown")).withColumn("shown", F.when(F.col("value").isNull(), "—").otherwise(F.col("shown")))


def metric_groups(spark: SparkSession, path: str) -> DataFrame:
    """The metric groups of a results document: group, group_label, metric, label."""
    schema = "metric_groups array<struct<id:string,label:string,metrics:array<struct<id:string,label:string>>>>"
    groups = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("metric_groups").alias("g"))
    return groups.select(F.col("g.id").alias("group"), F.col("g.label").alias("group_label"), F.explode("g.metrics").alias("m")).select("group", "group_label", F.col("m.id").alias("metric"), F.col("m.label").alias("label"))


def content_digest(c) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def collection_digest(assets: DataFrame, group: str, name: str) -> DataFrame:
    """Digest of each group's ordered (name, size, sha) rows. A group's files meet in one value;
    digests.tree_digest has no such limit."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(name), F.col("size"), F.col("sha"))))
    text = F.transform(rows, lambda x: F.concat_ws(":", x.getField(name).cast("string"), x.getField("size").cast("string"), x.getField("sha")))
    return assets.groupBy(group).agg(F.count("*").alias("n_files"), F.sha2(F.array_join(text, "\n"), 256).alias("digest"))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with size, digest and whether they begin like an MP3."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), content_digest("content").alias("sha"), is_mp3("content").alias("is_mp3"))


def present(assets: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """The assets that expected names (a name each); one that is not there is an error."""
    joined = expected.select(name).join(assets.withColumn("_there", F.lit(True)), name, "left")
    return checked(joined, F.col("_there"), F.concat(F.lit("missing file: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))).drop("_there")


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """df in order of the columns named, in place of what path holds, once all is written; an empty
    df is an error and changes nothing."""
    _replace_sorted(df, path, order, lambda rows, to: rows.write.json(to, ignoreNullFields=False))


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """As write_jsonl, with a header."""
    _replace_sorted(df, path, order, lambda rows, to: rows.write.csv(to, header=True))


def _replace_sorted(df: DataFrame, path: str, order: tuple[str, ...], put: Callable[[DataFrame, str], None]) -> None:
    files.replace(df.sparkSession, path, lambda to: files.write_filled(df.orderBy(*order), lambda rows: put(rows, to)))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small document (a configuration, statistics), pretty-printed by key."""
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    document = spark.createDataFrame([(text,)], "value string").coalesce(1)
    files.replace(spark, path, document.write.text)


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of several tables under the union of their columns (what one lacks is null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_selection(selected: DataFrame, captions: DataFrame, artists: DataFrame | Callable[[DataFrame], DataFrame], folder: str, config: dict | None = None, stats: dict | None = None) -> None:
    """The selection's outputs: songs, captions (song x caption), artists (a table, or made of the
    songs); config and stats. They replace the folder together; an empty table is an error and
    changes nothing. Songs are computed once: the other tables read them as written."""
    spark = selected.sparkSession

    def write(to: str) -> None:
        for name, value in (("config", config), ("selection_stats", stats)):
            if value is not None:
                write_json(spark, value, f"{to}/{name}")
        put = lambda name, df: files.write_filled(df, lambda rows: rows.write.parquet(f"{to}/{name}"))
        put("songs", selected)
        songs = spark.read.schema(selected.schema).parquet(f"{to}/songs")
        put("captions", songs.join(captions, "track_id"))
        put("artists", artists(songs) if callable(artists) else artists)

    files.replace(spark, folder, write)
