"""Deterministic experiment plans: cohorts, matched scenarios, jobs, shards, resume checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.operators.checks import checked
from quillon.operators.dataset import dense_index
from quillon.operators.digests import row_text, tree_digest

#: The scenarios in order, with their direction.
SCENARIOS = (
    ("no_control", 0.0),
    ("enhance_target", 1.0),
    ("suppress_single_target", -1.0),
    ("suppress_multiple_target", -1.0),
    ("suppress_single_others", -1.0),
    ("suppress_multiple_others", -1.0),
)
#: The sample types of a generation job.
SAMPLE_TYPES = ("default", "suppress_self", "suppress_other")


def hash_number(seed: int, namespace: str, *keys) -> Column:
    """A number below 2^32 from the stable hash of the keys."""
    return F.conv(F.substring(stable_hash(seed, namespace, *keys), 1, 8), 16, 10).cast("long")


def balanced_cohort(records: DataFrame, num_artists: int, clips: int, seed: int) -> DataFrame:
    """`clips` clips of `num_artists` artists that have so many, drawn without replacement by
    hash; artist_clip_index from 0. records: artist_key, clip_id."""
    artists = records.groupBy("artist_key").agg(F.count("*").alias("n")).where(F.col("n") >= clips).orderBy(stable_hash(seed, "artists", "artist_key"), "artist_key").limit(num_artists)
    kept = records.join(artists.select("artist_key"), "artist_key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("artist_key").orderBy(stable_hash(seed, "clips", "artist_key", "clip_id"), "clip_id")) - 1
    return kept.withColumn("artist_clip_index", rank).where(F.col("artist_clip_index") < clips)


#: Draws for each id that is wanted. Should they hold too few different ones, the ids that follow
#: the target fill up.
TRIES = 12


def _others(target: Column, count: Column, concepts: int, seed: int, namespace: str, row: Column, most: int = 5) -> Column:
    """`count` (at most `most`) distinct ids other than target: hashed numbers below concepts - 1,
    from the target's successor on, the first of each kept. The work does not grow with the
    vocabulary."""
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), row.cast("string"), F.lit(str(k))), 256)
    eight = lambda d: F.array(*(F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("long") % (concepts - 1) for i in range(8)))
    # Lambdas bind a digest and the first draws, so that each is made once; mostly the first digest
    # has different numbers enough, and the others are not made.
    drawn = lambda k: F.flatten(F.transform(F.array(digest(k)), eight))
    rest = F.array(*(F.lit(i).cast("long") for i in range(min(most, concepts - 1))))
    more = lambda first: F.array_distinct(F.concat(first, *(drawn(k) for k in range(1, -(-most * TRIES // 8))), rest))
    offsets = F.element_at(F.transform(F.array(F.array_distinct(drawn(0))), lambda first: F.when(F.size(first) >= count, first).otherwise(more(first))), 1)
    return F.transform(F.slice(offsets, F.lit(1), count), lambda o: ((target + 1 + o) % concepts).cast("int"))


def control_scenarios(rows: DataFrame, concepts: int, seed: int, least: int = 2, most: int = 5) -> DataFrame:
    """Six conditions per row of rows (row_id, target): row_id, scenario, position, direction, ids
    (sorted), weight (1 / number of ids; null without). Needs three concepts."""
    if concepts < 3:
        raise ValueError("six scenarios need at least three artists")
    t, row = F.col("target"), F.col("row_id")
    size = lambda ns, top: (F.lit(min(least, top)) + hash_number(seed, ns, "row_id") % (min(most, top) - min(least, top) + 1)).cast("int")
    one = F.array(t)
    sets = [
        F.array().cast("array<int>"),
        one,
        one,
        F.concat(one, _others(t, size("multi_target", concepts) - 1, concepts, seed, "multi_target", row, most)),
        _others(t, F.lit(1), concepts, seed, "single_other", row),
        _others(t, size("multi_other", concepts - 1), concepts, seed, "multi_other", row, most),
    ]
    plan = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(name).alias("scenario"), F.lit(sign).alias("direction"), F.array_sort(ids.cast("array<int>")).alias("ids")) for i, ((name, sign), ids) in enumerate(zip(SCENARIOS, sets, strict=True))))
    out = rows.select("row_id", "target", F.explode(plan).alias("s")).select("row_id", "target", "s.*")
    return out.withColumn("weight", F.when(F.size("ids") > 0, 1.0 / F.size("ids")))


def scenario_manifest(clips: DataFrame, plan: DataFrame, artists: DataFrame) -> DataFrame:
    """Clip x scenario with the conditioned artists' keys in the order of their ids and the output
    path. clips: row_id, sample_id; artists: id, artist_key."""
    keyed = plan.select("row_id", "scenario", F.posexplode_outer("ids").alias("k", "id")).join(artists, "id", "left")
    keys = keyed.groupBy("row_id", "scenario").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "artist_key"))), lambda s: s.getField("artist_key")).alias("keys"))
    joined = clips.join(plan, "row_id").join(keys, ["row_id", "scenario"])
    path = lambda part: F.concat_ws("/", F.lit("audio"), part, F.concat("sample_id", F.lit(".wav")))
    label = F.initcap(F.replace("scenario", F.lit("_"), F.lit(" ")))
    return joined.withColumns({"scenario_label": label, "index_array": F.concat("scenario", F.lit("_artist_indices")), "audio_path": path("scenario"), "reference_path": path(F.lit("reference"))})


def generation_jobs(records: DataFrame, groups: int, seed: int) -> DataFrame:
    """Per artist `groups` records and one other artist each, three rows per job. records:
    artist_key, artist_index (dense from 0), dataset_index."""
    artist = Window.partitionBy("artist_key")
    drawn = records.withColumn("r", F.row_number().over(artist.orderBy(stable_hash(seed, "jobs", "artist_key", "dataset_index"), "dataset_index"))).where(F.col("r") <= groups)
    jobs = drawn.withColumn("group_index", F.row_number().over(artist.orderBy("dataset_index")) - 1).drop("r")
    n = records.agg((F.max("artist_index") + 1).alias("n"))
    shift = 1 + hash_number(seed, "other", "artist_key", "dataset_index") % (F.col("n") - 1)
    jobs = jobs.join(F.broadcast(n)).withColumn("other_index", ((F.col("artist_index") + shift) % F.col("n")).cast("int"))
    jobs = jobs.withColumn("group_id", F.format_string("%04d:%03d", "artist_index", "group_index"))
    rows = jobs.select("group_id", "artist_key", "artist_index", "dataset_index", "other_index", F.explode(F.array(*map(F.lit, SAMPLE_TYPES))).alias("sample_type"))
    condition = F.when(F.col("sample_type") == "suppress_self", F.col("artist_index")).when(F.col("sample_type") == "suppress_other", F.col("other_index"))
    return rows.withColumn("condition_index", condition)


def pending(jobs: DataFrame, done: DataFrame, required: list[str], group: str = "group_id") -> DataFrame:
    """Jobs whose group is not complete: a complete one has exactly the required sample types, and
    all its files exist. done: group, sample_type, exists."""
    want = F.array(*map(F.lit, sorted(required)))
    complete = done.groupBy(group).agg(F.array_sort(F.collect_set("sample_type")).alias("types"), F.bool_and("exists").alias("all")).where((F.col("types") == want) & F.col("all"))
    return jobs.join(complete.select(group), group, "left_anti")


def completed(manifest: DataFrame, done: DataFrame, required: list[str], group: str = "group_id") -> DataFrame:
    """The manifest rewritten: its rows of complete groups only (see pending)."""
    return manifest.join(pending(manifest.select(group).distinct(), done, required, group), group, "left_anti")


def joint_totals(sets: DataFrame) -> DataFrame:
    """One row of scheduled_sets: rows, joint_rate, mean sizes of both sets."""
    return sets.agg(F.count("*").alias("rows"), F.avg(F.col("joint").cast("int")).alias("joint_rate"), F.avg(F.size("suppress")).alias("mean_suppress"), F.avg(F.size("preserve")).alias("mean_preserve"))


def scheduled_sets(rows: DataFrame, concepts: int, epoch: int, batch: int, seed: int, p: float = 0.5) -> DataFrame:
    """row_id, target, joint, suppress (holds the target), preserve (does not): a row is joint with
    probability p, then of 2 to 5 ids."""
    row = F.concat_ws(":", F.lit(str(epoch)), F.lit(str(batch)), F.col("row_id").cast("string"))
    marked = rows.withColumn("_row", row)
    joint = hash_number(seed, "joint", "_row") < int(p * 2**32)
    size = (2 + hash_number(seed, "size", "_row") % 4).cast("int")
    t = F.col("target")
    more = _others(t, F.least(size - 1, F.lit(concepts - 1)), concepts, seed, "suppress", F.col("_row"))
    keep = _others(t, F.least(F.when(joint, size).otherwise(1), F.lit(concepts - 1)), concepts, seed, "preserve", F.col("_row"))
    return marked.select("row_id", "target", joint.alias("joint"), F.array_sort(F.when(joint, F.concat(F.array(t), more)).otherwise(F.array(t))).alias("suppress"), F.array_sort(keep).alias("preserve"))


def wrong_target(target, batch: int, concepts: int) -> Column:
    """A target other than the row's own, by arithmetic."""
    return F.pmod(F.col(target) + 1 + batch % (concepts - 1), F.lit(concepts))


def batch_seed(seed: int, ids) -> Column:
    """The first four bytes of sha256("seed:ids")."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ids), 256), 1, 8), 16, 10).cast("long")


def batches(rows: DataFrame, index: str, size: int, seed: int, drop_last: bool = False) -> DataFrame:
    """batch_id, n, seed of fixed-size batches in index order."""
    b = rows.withColumn("batch_id", F.floor(F.col(index) / size)).groupBy("batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(index)), lambda x: x.cast("string")), ",").alias("ids"))
    out = b.select("batch_id", "n", batch_seed(seed, F.col("ids")).alias("seed"))
    return out.where(F.col("n") == size) if drop_last else out


def shard_layout(assets: DataFrame, size: int = 1024) -> DataFrame:
    """shard (index div size), token_index and token_offset of successful assets within it, and
    status. assets: asset_index (dense), ok, length."""
    shard = F.floor(F.col("asset_index") / size)
    w = Window.partitionBy("shard").orderBy("asset_index").rowsBetween(Window.unboundedPreceding, 0)
    length = F.when(F.col("ok"), F.col("length")).otherwise(0)
    laid = assets.withColumn("shard", shard).withColumn("_e", F.sum(length).over(w)).withColumn("_i", F.sum(F.col("ok").cast("int")).over(w))
    return laid.select("asset_index", "shard", F.when(F.col("ok"), F.col("_i") - 1).alias("token_index"), F.when(F.col("ok"), F.col("_e") - F.col("length")).alias("token_offset"), F.when(F.col("ok"), "ok").otherwise("error").alias("status"))


def resume_prefix(existing: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: done, contiguous (indexes 0 to done - 1), same (assets as the manifest's)."""
    j = existing.select("asset_index", F.col("asset").alias("old")).join(manifest.select("asset_index", "asset"), "asset_index", "left")
    n, top = F.count("*"), F.coalesce(F.max("asset_index"), F.lit(-1))
    return j.agg(n.alias("done"), ((top + 1 == n) & (F.count_distinct("asset_index") == n)).alias("contiguous"), F.coalesce(F.bool_and(F.col("old").eqNullSafe(F.col("asset"))), F.lit(True)).alias("same"))


def different_entity_pair(source: DataFrame, candidates: DataFrame) -> DataFrame:
    """source (pos, artist_key) with match: candidate number pos mod m among the m candidates of
    other artists, in candidate order (candidates: cpos dense from 0, artist_key, clip_id); no
    such candidate, no row. Positions among "all but mine" are found by arithmetic: the j-th is
    shifted by as many of the artist's own as stand before it. Those are counted from dense numbers
    of range partitions, so that no row and no task holds an artist's positions."""
    total = candidates.agg(F.count("*").alias("total"))
    known = candidates.where("artist_key is not null").select("artist_key", "cpos")
    j = source.join(F.broadcast(total)).join(known.groupBy("artist_key").agg(F.count("*").alias("own")), "artist_key", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    m = F.col("total") - F.col("own")
    j = j.where(m > 0).withColumn("j", F.col("pos") % m)
    # The i-th own candidate (from 0) has cpos - i others before it: it is passed if that is at most j.
    owned = dense_index(known, "artist_key", "cpos", name="i")
    firsts = owned.groupBy("artist_key").agg(F.min("i").alias("first"))
    points = j.where("own > 0").select("artist_key", F.col("j").alias("at")).distinct()
    events = owned.join(firsts, "artist_key").select("artist_key", (F.col("cpos") - F.col("i") + F.col("first")).alias("at"), F.lit(0).alias("kind"), "cpos")
    events = events.union(points.select("artist_key", "at", F.lit(1), F.lit(0)))
    among = dense_index(events, "artist_key", "at", "kind", "cpos", name="p").where("kind = 1").select("artist_key", "at", "p")
    # Of the p events before a point q are points; the others are candidates, `first` of them of earlier artists.
    shifts = among.join(dense_index(points, "artist_key", "at", name="q"), ["artist_key", "at"]).join(firsts, "artist_key")
    shifts = shifts.select("artist_key", F.col("at").alias("j"), (F.col("p") - F.col("q") - F.col("first")).alias("passed"))
    placed = j.join(shifts, ["artist_key", "j"], "left").withColumn("cpos", F.col("j") + F.coalesce("passed", F.lit(0)))
    return placed.join(candidates.select("cpos", "clip_id"), "cpos").select("pos", "artist_key", F.col("clip_id").alias("match"))


def clip_cohort_rows(cohort: DataFrame, records: DataFrame) -> DataFrame:
    """Cohort (position, clip_id) joined to records with a running index per artist."""
    w = Window.partitionBy("artist_key").orderBy("position")
    return cohort.join(records, "clip_id").withColumn("artist_clip_index", F.row_number().over(w) - 1)


def remap_labels(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """artist_index becomes another vocabulary's index of the same key; the old one is kept as
    control_artist_index. Unknown keys are an error."""
    joined = rows.withColumnRenamed("artist_index", "control_artist_index").join(vocabulary.select("artist_key", F.col("index").alias("artist_index")), "artist_key", "left")
    return checked(joined, F.col("artist_index").isNotNull(), F.concat(F.lit("key outside the vocabulary: "), F.coalesce("artist_key", F.lit("null"))))


def missing_types(rows: DataFrame, requested: list[str], column: str = "sample_type") -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([(x,) for x in requested], f"{column} string")
    return wanted.join(rows.select(column).distinct(), column, "left_anti")


# Incremental recomputation and provenance


def cache_valid(cached: DataFrame, current: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key, valid: provenance columns equal; a cached row without provenance is not valid."""
    names = [F.col(f"cur.{p}").eqNullSafe(F.col(f"old.{p}")) & F.col(f"old.{p}").isNotNull() for p in parts]
    ok = names[0]
    for n in names[1:]:
        ok = ok & n
    return current.alias("cur").join(cached.alias("old"), key, "left").select(key, ok.alias("valid"))


def require_valid(checked: DataFrame, cached: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Keys (of cache_valid) that are to be computed: those without a cached row, and with
    overwrite those with an invalid one, which is an error otherwise."""
    stale = checked.where("not coalesce(valid, false)")
    if overwrite:
        return stale.select(key)
    bad = stale.join(cached, key, "left_semi").limit(5).collect()
    if bad:
        raise ValueError(f"cached rows of other or no provenance: {[r[key] for r in bad]}")
    return stale.select(key)


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def reuse_or_recompute(items: DataFrame, cache: DataFrame) -> DataFrame:
    """sample_id, action: reused if the (variant, sha) rows of an item equal those cached and every
    variant has a value. items: sample_id, variant, sha; cache: the same and value."""
    prints = lambda df: df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("variant", "sha"))).alias("prints"), F.bool_and(F.col("value").isNotNull()).alias("full"))
    # Values of variants that the item no longer has, or lacks, make other key sets.
    old = prints(cache).select("sample_id", F.col("prints").alias("old"), F.col("full").alias("old_full"))
    new = prints(items.withColumn("value", F.lit(0)))
    same = (F.col("prints") == F.col("old")) & F.col("old_full")
    return new.join(old, "sample_id", "left").select("sample_id", F.when(same, "reused").otherwise("recomputed").alias("action"))


def generation_identity(config: DataFrame, group: str) -> DataFrame:
    """group, identity: digest of the sorted key=value lines. config: group, key, value."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda s: F.concat(s.getField("key"), F.lit("="), F.coalesce(s.getField("value"), F.lit("null"))))
    return config.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("identity"))


def cohort_digest(cohort: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row, n and digest: of a cohort's rows (their named columns) in order."""
    return tree_digest(cohort.withColumn("_all", F.lit(0)), "_all", order, row_text(*columns)).drop("_all")


def plan_digest(plan: DataFrame, by: str = "scenario", order: tuple[str, ...] = ("row_id", "position"), columns: tuple[str, ...] = ("row_id", "position", "scenario", "ids", "weight")) -> DataFrame:
    """by, n, digest: of each scenario's rows of a control plan in order."""
    return tree_digest(plan, by, list(order), row_text(*columns))


def config_mismatches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose values differ, or that one side lacks. Both: key, value."""
    j = old.select("key", F.col("value").alias("old_value")).join(new.select("key", F.col("value").alias("new_value")), "key", "full")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
