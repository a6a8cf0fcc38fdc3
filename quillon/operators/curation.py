"""Catalogue curation: rejection funnel, families, creator profiles and balanced selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import FAMILIES, direct_family, stable_hash
from quillon.operators.checks import checked
from quillon.operators.counters import Counters, watched
from quillon.operators.dataset import dense_index
from quillon.operators.quantiles import exact_quantiles
from quillon.sources.stored import nearby, stored

#: 1/n of a vote in whole units, exact for up to 15 families per track.
UNITS = 360360


REASONS = ("accepted", "missing_id", "duplicate_id", "missing_artist", "not_downloadable", "missing_genres")


def funnel(catalog: DataFrame, track_id: str, artist: str, allowed: Column, genres: str, position: list, counters: Counters | None = None) -> DataFrame:
    """catalog with `reason`: accepted, or the first of missing_id, duplicate_id, missing_artist,
    not_downloadable, missing_genres that holds (an unknown `allowed` counts as allowed). A row is
    a duplicate only of an earlier accepted row (by the position columns). Rows without an id are
    dealt out by their position. counters: section funnel, rows of each reason."""
    blank = F.col(track_id).isNull()
    fault = F.when(F.col(artist).isNull(), "missing_artist").when(~F.coalesce(allowed, F.lit(True)), "not_downloadable").when(F.coalesce(F.size(genres), F.lit(0)) < 1, "missing_genres")
    marked = catalog.withColumn("_fault", fault).withColumn("_at", F.struct(*position))
    first = F.min(F.when(F.col("_fault").isNull(), F.col("_at"))).over(Window.partitionBy(track_id, F.when(blank, F.xxhash64("_at"))))
    reason = F.when(blank, "missing_id").when(F.col("_at") > first, "duplicate_id").otherwise(F.coalesce("_fault", F.lit("accepted")))
    return watched(counters, marked.withColumn("reason", reason).drop("_fault", "_at"), "funnel", **{r: F.count_if(F.col("reason") == r) for r in REASONS})


def dedup_captions(captions: DataFrame, counters: Counters | None = None) -> DataFrame:
    """counters: sections captions_read and captions_kept, rows before and after."""
    kept = watched(counters, captions, "captions_read", rows=F.count("*")).dropDuplicates(["track_id", "start_time", "end_time", "text"])
    return watched(counters, kept, "captions_kept", rows=F.count("*"))


def valid_captions(captions: DataFrame, min_seconds: float = 5.0) -> DataFrame:
    return captions.where(F.col("text").isNotNull() & (F.trim("text") != "") & (F.col("start_time") >= 0) & (F.col("end_time") - F.col("start_time") >= min_seconds))


def usable_captions(captions: DataFrame, tracks: DataFrame, min_seconds: float = 5.0, max_clips: int | None = None) -> DataFrame:
    """Ends clamped to positive durations, short spans dropped, the first max_clips per track."""
    joined = captions.join(tracks.select("track_id", "duration"), "track_id")
    end = F.when(F.col("duration") > 0, F.least("end_time", "duration")).otherwise(F.col("end_time"))
    kept = joined.withColumn("end_time", end).where(F.col("end_time") - F.col("start_time") >= min_seconds).drop("duration")
    if max_clips is None:
        return kept
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("start_time", "end_time", "text"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= max_clips).drop("_r")


def tag_frequencies(tracks: DataFrame) -> DataFrame:
    """Tracks and artists per style tag; a tag counts once per track."""
    tags = tracks.select("artist_key", F.explode(F.array_distinct("style_tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n_tracks"), F.count_distinct("artist_key").alias("n_artists"))


def _combinations(tracks: DataFrame) -> DataFrame:
    """genres, n_tracks, n_known: each combination of genres, its tracks and those with an id."""
    return tracks.groupBy("genres").agg(F.count("*").alias("n_tracks"), F.count("track_id").alias("n_known"))


def _tag_families(tracks: DataFrame, exact, keywords) -> DataFrame:
    """tag, family: computed once per distinct tag."""
    return tracks.select(F.explode("genres").alias("tag")).distinct().select("tag", direct_family("tag", exact, keywords).alias("family"))


def genre_cooccurrence(tracks: DataFrame, exact=None, keywords=None) -> DataFrame:
    """Votes (in UNITS) of the known families on a track for each of its unknown tags. tracks:
    track_id, genres, one row a track; each combination of genres is counted once."""
    return _votes(stored(_combinations(tracks)), exact, keywords)


def _votes(combinations: DataFrame, exact, keywords) -> DataFrame:
    tagged = combinations.where("n_known > 0").select("genres", "n_known", F.explode("genres").alias("tag")).join(_tag_families(combinations, exact, keywords), "tag")
    anchors = tagged.where("family is not null").groupBy("genres").agg(F.collect_set("family").alias("families"))
    open_tags = tagged.where("family is null").select("genres", "n_known", "tag").join(anchors, "genres")
    votes = open_tags.select("tag", F.explode("families").alias("family"), ((F.lit(UNITS) / F.size("families")).cast("long") * F.col("n_known")).alias("units"))
    return votes.groupBy("tag", "family").agg(F.sum("units").alias("units"))


def infer_taxonomy(tracks: DataFrame, exact=None, keywords=None, min_cooccurrence: int = 5, min_confidence: float = 0.35, counters: Counters | None = None) -> DataFrame:
    """Every tag: family (null if unresolved), how (direct, inferred, unresolved), confidence, and
    n_tracks. The inferred family has most votes, ties to the greatest name. The tracks (one row
    each) are read once, and their combinations of genres stored. counters: section taxonomy, tags
    of each route and tags with tracks in all."""
    found = stored(_combinations(tracks))
    families = _tag_families(found, exact, keywords)
    frequency = found.select("n_tracks", F.explode("genres").alias("tag")).groupBy("tag").agg(F.sum("n_tracks").alias("n_tracks"))
    best = _votes(found, exact, keywords).groupBy("tag").agg(F.sum("units").alias("total"), F.max(F.struct("units", "family")).alias("top"))
    good = best.where((F.col("total") >= min_cooccurrence * UNITS) & (F.col("top.units") / F.col("total") >= min_confidence))
    guess = good.select("tag", F.col("top.family").alias("guess"), (F.col("top.units") / F.col("total")).alias("confidence"))
    joined = frequency.join(families, "tag").join(guess, "tag", "left")
    how = F.when(F.col("family").isNotNull(), "direct").when(F.col("guess").isNotNull(), "inferred").otherwise("unresolved")
    found = joined.select("tag", F.coalesce("family", "guess").alias("family"), how.alias("how"), F.when(F.col("family").isNull(), F.col("confidence")).alias("confidence"), "n_tracks")
    return watched(counters, found, "taxonomy", tags=F.count("*"), **{r: F.count_if(F.col("how") == r) for r in ("direct", "inferred", "unresolved")})


def apply_taxonomy(tracks: DataFrame, taxonomy: DataFrame, counters: Counters | None = None) -> DataFrame:
    """tracks with coarse_genres (sorted distinct families); tracks without any, or without an id,
    are dropped. Families are found once for each combination of genres: few combinations come to
    the tracks, which then stay where they are. counters: section coarse_genres, with tracks and
    tracks_dropped_without_coarse_genre."""
    known = taxonomy.where("family is not null").select("tag", "family")
    combinations = tracks.where("track_id is not null").select("genres").distinct()
    coarse = combinations.select("genres", F.explode("genres").alias("tag")).join(known, "tag").groupBy("genres").agg(F.array_sort(F.collect_set("family")).alias("coarse_genres"))
    coarse = nearby(coarse)
    if counters is None:
        return tracks.where("track_id is not null").join(coarse, "genres").select(*tracks.columns, "coarse_genres")
    found = tracks.join(coarse, "genres", "left").select(*tracks.columns, F.when(F.col("track_id").isNotNull(), F.col("coarse_genres")).alias("coarse_genres"))
    lost = F.col("coarse_genres").isNull()
    return counters.watch(found, "coarse_genres", tracks=F.count("*"), tracks_dropped_without_coarse_genre=F.count_if(lost)).where(~lost)


def dominant_genre(tracks: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """artist_key, dominant_genre: most fractional votes, ties to the earlier family."""
    votes = tracks.select("artist_key", F.explode("coarse_genres").alias("family"), (F.lit(UNITS) / F.size("coarse_genres")).cast("long").alias("units")).groupBy("artist_key", "family").agg(F.sum("units").alias("units"))
    order = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    return votes.groupBy("artist_key").agg(F.max(F.struct("units", (-order).alias("late"), "family")).alias("top")).select("artist_key", F.col("top.family").alias("dominant_genre"))


def artist_profiles(tracks: DataFrame, min_support: float = 0.30, min_songs: int = 3, max_tags: int = 5, min_global: int = 50, idf_cap: float = 3.0) -> DataFrame:
    """artist_key, tag, weight, support, rank of each artist's signature (at most max_tags).

    Stable tags: frequent enough with the artist and in the catalogue; failing any, repeated
    local tags; failing any, the most frequent ones (ties by name). Weight is support times a
    capped inverse artist frequency. A signature without a genre tag gets the best one for its
    last place. The tracks are read twice and not shuffled if those of an artist are in one task;
    an artist's number of tracks is counted with its tags, under none.
    """
    tags = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_compact(F.array_distinct("style_tags")), F.array().cast("array<string>")))
    counts = tracks.select("artist_key", F.explode(tags).alias("tag")).groupBy("artist_key", "tag").agg(F.count("*").alias("n"))
    world = counts.groupBy("tag").agg(F.sum("n").alias("n_tracks"), F.count("*").alias("n_artists"))
    # One row a tag of the vocabulary, and the one of none.
    world = world.withColumn("artists", F.max(F.when(F.col("tag").isNull(), F.col("n_artists"))).over(Window.partitionBy()))
    artist = Window.partitionBy("artist_key")
    sized = counts.withColumn("size", F.max(F.when(F.col("tag").isNull() & F.col("artist_key").isNotNull(), F.col("n"))).over(artist))
    base = sized.where("size is not null and tag is not null").join(world, "tag")
    support = F.col("n") / F.col("size")
    idf = 1.0 + F.ln((F.col("artists") + 1) / (F.col("n_artists") + 1))
    common = F.row_number().over(artist.orderBy(F.desc("n"), "tag"))
    tier = (
        F.when((F.col("n") >= min_songs) & (support >= min_support) & (F.col("n_tracks") >= min_global), 0)
        .when((F.col("n") >= F.least(F.lit(min_songs), F.greatest(F.lit(2), F.col("size")))) & (support >= min_support), 1)
        .when(common <= max_tags, 2)
    )
    scored = base.select("artist_key", "tag", support.alias("support"), (support * F.least(idf, F.lit(idf_cap))).alias("weight"), tier.alias("tier"), common.alias("common"), F.col("tag").startswith("genre:").alias("is_genre"))
    scored = scored.withColumn("best", F.min("tier").over(artist))
    chosen = (F.col("tier") == F.col("best")) | ((F.col("best") == 2) & (F.col("common") <= max_tags))
    order = [F.desc("weight"), F.desc("support"), F.col("tag")]
    ranked = scored.withColumn("chosen", chosen & chosen.isNotNull()).withColumn("rank", F.row_number().over(artist.orderBy(F.desc("chosen"), *order)))
    ranked = ranked.withColumn("taken", F.col("chosen") & (F.col("rank") <= max_tags))
    ranked = ranked.withColumn("last", F.max(F.when(F.col("taken"), F.col("rank"))).over(artist)).withColumn("genres", F.max((F.col("taken") & F.col("is_genre")).cast("int")).over(artist))
    ranked = ranked.withColumn("top_genre", F.max(F.when(F.col("is_genre"), F.struct("weight", "support", "tag"))).over(artist))
    swap = (F.col("genres") == 0) & F.col("top_genre").isNotNull()
    kept = ranked.where((F.col("taken") & ~(swap & (F.col("rank") == F.col("last")))) | (swap & (F.col("tag") == F.col("top_genre.tag"))))
    return kept.select("artist_key", "tag", "weight", "support", F.row_number().over(artist.orderBy(*order)).alias("rank"))


def signature_scores(tracks: DataFrame, profiles: DataFrame, *keep: str) -> DataFrame:
    """track_id, artist_key, signature_score (weight of the profile's tags on the track over all
    its weight, rounded to 9 places so that ties do not hang on summation order), tag_overlap, and
    the columns of tracks to keep. An artist's profile meets its tracks as one value."""
    own = profiles.groupBy("artist_key").agg(F.sum("weight").alias("total"), F.array_sort(F.collect_list(F.struct("tag", "weight"))).alias("signature"))
    hits = F.when(F.col("track_id").isNotNull(), F.filter("signature", lambda x: F.array_contains("style_tags", x["tag"])))
    joined = tracks.select("track_id", "artist_key", "style_tags", *keep).join(own, "artist_key", "left").withColumn("hits", hits)
    hit = F.coalesce(F.aggregate("hits", F.lit(0.0), lambda total, x: total + x["weight"]), F.lit(0.0))
    score = F.when(F.col("total") > 0, hit / F.col("total")).otherwise(0.0)
    overlap = F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long")
    return joined.select("track_id", "artist_key", F.round(score, 9).alias("signature_score"), overlap.alias("tag_overlap"), *keep)


def choose_artists_balanced(artists: DataFrame, count: int, seed: int, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """`count` artists round robin over dominant genres; artists: artist_key, dominant_genre,
    n_tracks. Each turn takes from the genre with fewest picks, then most artists left, then
    family order; within a genre largest catalogues first, ties in seeded hash order."""
    order = F.array_position(F.array(*map(F.lit, families)), F.col("dominant_genre"))
    genre = Window.partitionBy("dominant_genre")
    sizes = artists.groupBy("dominant_genre").agg(F.count("*").alias("size"))
    # No genre gives more than `count`: Spark keeps that many of each in every task before they meet.
    place = F.row_number().over(genre.orderBy(F.desc("n_tracks"), stable_hash(seed, "artists", "artist_key"), "artist_key"))
    turns = artists.withColumn("place", place).where(F.col("place") <= count).join(F.broadcast(sizes), "dominant_genre")
    turns = turns.withColumn("turn", F.col("place") - 1).withColumn("left", F.col("size") - F.col("turn"))
    return turns.orderBy("turn", F.desc("left"), order).limit(count).select("artist_key", "dominant_genre", "n_tracks", "turn")


def select_representative(scored: DataFrame, songs: int, max_per_album: int = 2, strict: bool = True) -> DataFrame:
    """The `songs` best tracks of each artist, albums capped unless too few are left; scored:
    track_id, artist_key, album_id, signature_score, tag_overlap. An artist with fewer is an
    error, or left out unless strict."""
    best = [F.desc("signature_score"), F.desc("tag_overlap"), F.col("track_id")]
    nth = F.row_number().over(Window.partitionBy("artist_key", "album_id").orderBy(*best))
    over = F.col("album_id").isNotNull() & (nth > max_per_album)
    artist = Window.partitionBy("artist_key")
    ranked = scored.withColumn("over", over).withColumn("n", F.count("*").over(artist))
    ranked = ranked.withColumn("rank", F.row_number().over(artist.orderBy("over", *best)))
    enough = F.col("n") >= songs
    if strict:
        ranked = checked(ranked, enough, F.concat(F.lit(f"fewer than {songs} tracks: "), F.col("artist_key")))
    return ranked.where((F.col("rank") <= songs) & enough).drop("over", "n")


def build_selection(tracks: DataFrame, captions: DataFrame, num_artists: int, songs_per_artist: int, seed: int = 42, candidate_multiplier: float = 3.0, min_seconds: float = 5.0, exact=None, keywords=None, **profile) -> DataFrame:
    """The whole curation: families, profiles, eligible artists, a balanced first choice, their
    usable captions, a balanced final choice, and each artist's representative tracks. The
    catalogue is read several times (a long plan is better stored first), with those of an artist
    in one task at best: then it is not shuffled by artist again. Its eligible part and its
    captioned part are written once."""
    mapped = apply_taxonomy(tracks, infer_taxonomy(tracks, exact, keywords))
    profiles, dominant = artist_profiles(mapped, **profile), dominant_genre(mapped)
    scored = signature_scores(mapped, profiles, "album_id", "duration", "coarse_genres").join(dominant, "artist_key")
    fit = stored(scored.where((F.col("signature_score") > 0) & F.array_contains("coarse_genres", F.col("dominant_genre"))))
    candidates = max(num_artists, -int(-num_artists * candidate_multiplier // 1), num_artists + 20)
    first = choose_artists_balanced(_catalogue(fit, songs_per_artist), candidates, seed)
    near = fit.join(F.broadcast(first.select("artist_key")), "artist_key", "left_semi")
    own = dedup_captions(captions.join(nearby(near.select("track_id")), "track_id", "left_semi"))
    clips = usable_captions(valid_captions(own, min_seconds), near, min_seconds)
    counted = stored(near.join(clips.groupBy("track_id").agg(F.count("*").alias("captioned_clips")), "track_id"))
    final = choose_artists_balanced(_catalogue(counted, songs_per_artist), num_artists, seed + 1)
    chosen = counted.join(F.broadcast(final.select("artist_key")), "artist_key", "left_semi")
    return select_representative(chosen, songs_per_artist).drop("coarse_genres", "duration")


def _catalogue(scored: DataFrame, least: int) -> DataFrame:
    return scored.groupBy("artist_key", "dominant_genre").agg(F.count("*").alias("n_tracks")).where(F.col("n_tracks") >= least)


def artist_summary(selected: DataFrame) -> DataFrame:
    """Per artist of selected (artist_key, track_id, genres, signature_score, clips): songs, clips,
    track_ids, genres, mean score."""
    return selected.groupBy("artist_key").agg(
        F.count("*").alias("songs"),
        F.sum("clips").alias("clips"),
        F.array_sort(F.collect_list("track_id")).alias("track_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("genres")))).alias("genres"),
        F.avg("signature_score").alias("signature_score_mean"),
    )


def selection_stats(values: DataFrame, column: str) -> DataFrame:
    """One row: n, min, mean, median and max of a column; the median by rank, so no task holds it."""
    c = F.col(column)
    middle = exact_quantiles(values, column, [0.5]).select(F.col("value").alias("median"))
    return values.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max")).join(F.broadcast(middle)).select("n", "min", "mean", "median", "max")


def selection_counts(selected: DataFrame, profiles: DataFrame, dominant: DataFrame) -> DataFrame:
    """section, name, n of a selection (artist_key, track_id, dominant_genre, captioned_clips):
    totals, songs and artists by genre, and the artists' signature tags by namespace."""
    keys = selected.select("artist_key").distinct()
    totals = selected.agg(F.count_distinct("artist_key").alias("artists"), F.count("*").alias("songs"), F.coalesce(F.sum("captioned_clips"), F.lit(0)).alias("clips"))
    parts = [totals.unpivot([], ["artists", "songs", "clips"], "name", "n").select(F.lit("total").alias("section"), "name", "n")]
    for section, rows, name in (
        ("songs_by_genre", selected, F.col("dominant_genre")),
        ("artists_by_genre", dominant.join(keys, "artist_key", "left_semi"), F.col("dominant_genre")),
        ("signature_tags", profiles.join(keys, "artist_key", "left_semi"), F.split_part("tag", F.lit(":"), F.lit(1))),
    ):
        parts.append(rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n"))
    return reduce(DataFrame.union, parts)


def profile_map(profiles: DataFrame) -> DataFrame:
    """artist_key, tags in rank order, weights and supports by tag."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "tag", "weight", "support")))
    named = lambda c: F.map_from_entries(F.transform("rows", lambda x: F.struct(x.getField("tag"), x.getField(c))))
    return profiles.groupBy("artist_key").agg(rows.alias("rows")).select("artist_key", F.col("rows.tag").alias("tags"), named("weight").alias("weights"), named("support").alias("supports"))


def unique_assets(manifest: DataFrame, path: str, position: list) -> DataFrame:
    """Distinct paths with the rows that name them, the position of the first, and a dense index
    from 0 in the order of first positions (ties by path)."""
    found = manifest.groupBy(path).agg(F.min(F.struct(*position)).alias("first"), F.count("*").alias("rows"))
    return dense_index(found, "first", path)


def asset_totals(assets: DataFrame) -> DataFrame:
    """One row of unique_assets: rows, unique, duplicates."""
    return assets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("unique"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"))


def clip_tasks(songs: DataFrame, captions: DataFrame, downloads: DataFrame) -> DataFrame:
    """Song x its captions x successful downloads."""
    return songs.join(captions, "track_id").join(downloads.where("status = 'ok'").select("track_id"), "track_id", "left_semi")


def attach_tokens(manifest: DataFrame, assets: DataFrame, key: str, counters: Counters | None = None, length: str = "token_length") -> DataFrame:
    """manifest left-joined with assets (key, status, token columns): route is unprocessed, failed
    or enriched. counters: section tokens, rows of each route and token_steps, the length of the
    enriched ones."""
    joined = manifest.join(assets, key, "left")
    routed = joined.withColumn("route", F.when(F.col("status").isNull(), "unprocessed").when(F.col("status") != "ok", "failed").otherwise("enriched"))
    if counters is None:
        return routed
    counts = {r: F.count_if(F.col("route") == r) for r in ("unprocessed", "failed", "enriched")}
    return counters.watch(routed, "tokens", **counts, token_steps=F.sum(F.when(F.col("route") == "enriched", F.col(length))))


def completeness(expected: DataFrame, clips: DataFrame) -> DataFrame:
    """Per track: expected clips, done, failed, and whether its source may be removed."""
    done = clips.groupBy("track_id").agg(F.count_if(F.col("status") == "ok").alias("done"), F.count_if(F.col("status") != "ok").alias("failed"))
    joined = expected.join(done, "track_id", "left").fillna(0, ["done", "failed"])
    return joined.withColumn("removable", (F.col("done") == F.col("expected")) & (F.col("failed") == 0))


def failures(results: DataFrame, *columns: str) -> DataFrame:
    """The failed rows of downloads or clips (status other than ok), with the named columns and
    the error."""
    return results.where("status is null or status <> 'ok'").select(*columns, F.coalesce("error", F.lit("unknown")).alias("error"))


def completeness_totals(selected: DataFrame, downloads: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: artists, songs, expected clips of the selection (artist_key, track_id, expected);
    downloads and clips (status) that succeeded and failed."""
    ok = F.col("status") == "ok"
    both = [df.agg(F.count_if(ok).alias(f"successful_{n}"), F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"failed_{n}")) for n, df in (("downloads", downloads), ("clips", clips))]
    own = selected.agg(F.count_distinct("artist_key").alias("selected_artists"), F.count_distinct("track_id").alias("selected_songs"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected_clips"))
    return own.join(F.broadcast(both[0])).join(F.broadcast(both[1]))
