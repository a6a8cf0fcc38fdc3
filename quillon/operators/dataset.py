"""Training-set construction: allow lists, vocabularies, matrices, caps, splits and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.operators.checks import filled, without
from quillon.sources.stored import stored


def filter_records(records: DataFrame, artists: list[str] | None, genres: list[str] | None, field: str) -> DataFrame:
    """Records of the allowed artists and genres (None: all). Nothing left is an error."""
    if artists is not None:
        records = records.where(F.col("artist_key").isin(artists))
    if genres is not None:
        records = records.where(F.arrays_overlap(F.col(field), F.array(*map(F.lit, genres))))
    if records.isEmpty():
        raise ValueError("no record passes the allow lists")
    return records


def eligible_for_cohort(records: DataFrame, vocabulary: DataFrame, allowed: DataFrame, min_length: int, min_clips: int) -> DataFrame:
    """Records of known and allowed artists, long enough, of artists with enough such clips."""
    kept = records.where(F.col("token_length") >= min_length).join(vocabulary, "artist_key", "left_semi").join(allowed, "artist_key", "left_semi")
    enough = kept.groupBy("artist_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_clips)
    return kept.join(enough.select("artist_key"), "artist_key", "left_semi")


def artist_genre_matrix(records: DataFrame) -> DataFrame:
    """artist_key, genre, weight: each (artist, track, genre) once, rows normalised."""
    counts = records.select("artist_key", "track_id", F.explode("genres").alias("genre")).distinct().groupBy("artist_key", "genre").agg(F.count("*").alias("n"))
    return counts.select("artist_key", "genre", (F.col("n") / F.sum("n").over(Window.partitionBy("artist_key"))).alias("weight"))


def label_vocabulary(records: DataFrame, column: str) -> DataFrame:
    """label, index: sorted distinct labels from 0; none is an error. Range-partitioned ranks: no
    task sees all."""
    labels = records.select(F.col(column).alias("label")).where("label is not null").distinct()
    return filled(dense_index(labels, "label"), f"no {column} to number")


def dense_index(rows: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Rows numbered from 0 in the order of unique columns: range partitions are ranked alone and
    shifted by the sizes of those before (one small count per partition). The ranges are stored:
    cut a second time, they could part elsewhere."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    marked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    return marked.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b") - 1).drop("_p", "_r", "_b")


def entity_profiles(records: DataFrame) -> DataFrame:
    """Per artist: dominant genre (count, then name; unknown if none), most common name, sorted
    genres, clips."""
    genre = records.select("artist_key", F.explode("genres").alias("genre")).groupBy("artist_key", "genre").agg(F.count("*").alias("n"))
    top = genre.groupBy("artist_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "genre")).alias("g"), F.array_sort(F.collect_set("genre")).alias("genres"))
    names = records.groupBy("artist_key", "artist_name").agg(F.count("*").alias("n"))
    name = names.groupBy("artist_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "artist_name")).alias("a"), F.sum("n").alias("clips"))
    return name.join(top, "artist_key", "left").select("artist_key", F.coalesce("g.genre", F.lit("unknown")).alias("dominant_genre"), F.col("a.artist_name").alias("artist_name"), "genres", "clips")


def select_records(records: DataFrame, seed: int, max_artists: int | None = None, max_songs: int | None = None, max_clips: int | None = None, max_samples: int | None = None) -> DataFrame:
    """Independent caps, in this order: artists, songs per artist, clips per song, rows. Draws
    follow seeded hashes, so they do not hang on the input's order."""
    if max_artists is not None:
        artists = records.select("artist_key").distinct().orderBy(stable_hash(seed, "artists", "artist_key"), "artist_key").limit(max_artists)
        records = records.join(artists, "artist_key", "left_semi")
    if max_songs is not None:
        rank = F.row_number().over(Window.partitionBy("artist_key").orderBy(stable_hash(seed, "songs", "artist_key", "track_id"), "track_id"))
        songs = records.select("artist_key", "track_id").distinct().withColumn("_r", rank).where(F.col("_r") <= max_songs)
        records = records.join(songs.select("artist_key", "track_id"), ["artist_key", "track_id"], "left_semi")
    if max_clips is not None:
        rank = F.row_number().over(Window.partitionBy("artist_key", "track_id").orderBy(stable_hash(seed, "clips", "clip_id"), "clip_id"))
        records = records.withColumn("_r", rank).where(F.col("_r") <= max_clips).drop("_r")
    if max_samples is not None:
        records = records.orderBy(stable_hash(seed, "samples", "clip_id"), "clip_id").limit(max_samples)
    return records


def split_by_track(records: DataFrame, val: float, test: float, seed: int) -> DataFrame:
    """artist_key, track_id, split: whole tracks, by artist. Sizes are rounded half to even, at
    least one from three tracks on, and lowered until train keeps one."""
    tracks = records.select("artist_key", "track_id").distinct()
    artist = Window.partitionBy("artist_key")
    n = F.count("*").over(artist)
    size = lambda f: F.when(n <= 1, 0).otherwise(F.greatest(F.rint(n * F.lit(f)).cast("int"), F.when(n >= 3, 1 if f > 0 else 0).otherwise(0)))
    ranked = tracks.select("*", n.alias("n"), size(val).alias("v"), size(test).alias("t"), F.row_number().over(artist.orderBy(stable_hash(seed, "split", "artist_key", "track_id"), "track_id")).alias("r"))
    # While train has none the larger size gives, test where they are equal: what is left of both,
    # and of val, is known at once. Every artist keeps a train track, so only no track has none.
    both = F.least(F.col("v") + F.col("t"), F.greatest(F.col("n") - 1, F.lit(0)))
    lowered = ranked.select("artist_key", "track_id", "r", "v", "t", both.cast("int").alias("both"))
    val = F.least(F.col("v"), F.greatest(F.ceil(F.col("both") / 2), F.col("both") - F.col("t"))).cast("int")
    sized = lowered.select("artist_key", "track_id", "r", "both", val.alias("val"))
    split = F.when(F.col("r") <= F.col("val"), "val").when(F.col("r") <= F.col("both"), "test").otherwise("train")
    none = records.agg(F.count("*").alias("n")).where("n = 0")
    return without(sized.select("artist_key", "track_id", split.alias("split")), none, F.lit("the training split is empty"))


def split_counts(split: DataFrame, label: str = "artist_key") -> DataFrame:
    """split, n rows, labels: distinct labels of each split."""
    return split.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))


def balanced_draws(records: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement, every artist equally likely, then every clip of the artist:
    draw, artist_key, clip_id. Dense indexes turn the draws into equi-joins."""
    spark = records.sparkSession
    sizes = dense_index(records.groupBy("artist_key").agg(F.count("*").alias("n")), "artist_key", name="a")
    artists = sizes.count()
    clips = records.select("artist_key", "clip_id", (F.row_number().over(Window.partitionBy("artist_key").orderBy("clip_id")) - 1).alias("c"))
    number = lambda ns, *k: F.conv(F.substring(stable_hash(seed, ns, *k), 1, 8), 16, 10).cast("long")
    drawn = spark.range(n).select(F.col("id").alias("draw"), (number("artist", "id") % artists).alias("a")).join(sizes, "a").withColumn("c", number("clip", "draw") % F.col("n"))
    return drawn.join(clips, ["artist_key", "c"]).select("draw", "artist_key", "clip_id")
