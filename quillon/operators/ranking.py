"""Ranking and reporting: baselines, best and worst, candidates, display order and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import checked


def resolve_entity(requests: DataFrame, entities: DataFrame, strict: bool = False) -> DataFrame:
    """Requests (request, value) resolved against entities (entity, name and, where there are
    any, key and index): a whole number by index, else by exact key, else by name, whatever the
    case. Returns request, how (index, key, name or null), matches, and entity, the least of them.
    With strict, a request without exactly one match is an error."""
    value, out = F.trim(F.col("value").cast("string")), requests
    number = F.when(value.rlike(r"^-?\d+$"), value.try_cast("long")) if "index" in entities.columns else F.lit(None).cast("long")
    forms = {"index": (number, F.col("index").cast("long")), "key": (F.when(number.isNull(), value), F.col("key")), "name": (F.when(number.isNull(), F.lower(value)), F.lower("name"))}
    used = {k: v for k, v in forms.items() if k in entities.columns}
    for how, (asked, own) in used.items():
        found = entities.groupBy(own.alias("_k")).agg(F.count("*").alias(f"_n_{how}"), F.min("entity").alias(f"_e_{how}")).where("_k is not null")
        out = out.withColumn("_a", asked).join(found, F.col("_a") == F.col("_k"), "left").drop("_a", "_k")
    first = lambda prefix: F.coalesce(*(F.col(f"{prefix}_{how}") for how in used))
    how = F.coalesce(*(F.when(F.col(f"_n_{h}").isNotNull(), F.lit(h)) for h in used))
    out = out.select("request", how.alias("how"), F.coalesce(first("_n"), F.lit(0)).alias("matches"), first("_e").alias("entity"))
    return checked(out, F.col("matches") == 1, F.concat(F.lit("unknown or ambiguous: "), F.coalesce(F.col("request").cast("string"), F.lit("null")))) if strict else out


def display_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of scalar columns, and of those that go into a payload of their own."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "binary")]
    return [c for c in df.columns if c not in nested], nested


def display_payloads(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df with payload columns replaced by a reference <column>/<slug of the key>, and the payloads
    themselves: column, payload_key, json."""
    from quillon.functions.text import slug

    scalar, nested = display_columns(df)
    name = slug(F.col(key).cast("string"), F.substring(F.sha1(F.col(key).cast("string")), 1, 12))
    shown = df.select(*scalar, *(F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(c), name)).alias(c) for c in nested))
    text = lambda c: F.base64(c) if dict(df.dtypes)[c] == "binary" else F.to_json(c)
    side = df.select(name.alias("payload_key"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("json")) for c in nested))).alias("p")) if nested else None
    return shown, side.select("p.column", "payload_key", "p.json").where("json is not null") if nested else df.select(F.lit("").alias("column"), name.alias("payload_key"), F.lit("").alias("json")).where("false")


def delta_vs_baseline(values: DataFrame, scenario: str, baseline: str, entity: str = "artist_key") -> DataFrame:
    """entity, value (mean in the scenario), baseline, delta (null without a baseline): one pass."""
    mean = lambda s: F.avg(F.when(F.col("scenario") == s, F.col("value")))
    g = values.where(F.col("scenario").isin(scenario, baseline)).groupBy(entity).agg(mean(scenario).alias("value"), mean(baseline).alias("baseline"))
    return g.where("value is not null").withColumn("delta", F.col("value") - F.col("baseline"))


MODES = ("scenario_value", "delta", "absolute_delta", "degradation", "improvement")


def rank_candidates(deltas: DataFrame, mode: str, k: int, direction: str | None = None, entity: str = "artist_key", largest_first: bool = True, clips: DataFrame | None = None, artist: str | None = None, caption: str | None = None) -> DataFrame:
    """The k first entities by a mode, rank from 1. Degradation and improvement need a metric
    direction (maximize or minimize); rows without a baseline count in scenario_value only. With
    clips (entity, artist_key, text) only entities that have one count; artist keeps one artist's,
    caption those with a clip whose text has it, whatever the case."""
    if mode not in MODES or (mode in MODES[3:] and direction not in ("maximize", "minimize")):
        raise ValueError(f"unknown mode {mode} or direction {direction}")
    sign = 1 if (mode == "improvement") == (direction == "maximize") else -1
    score: dict[str, Column] = {"scenario_value": F.col("value"), "delta": F.col("delta"), "absolute_delta": F.abs("delta")}
    if clips is not None:
        wanted = clips if artist is None else clips.where(F.col("artist_key") == artist)
        wanted = wanted if not (caption or "").strip() else wanted.where(F.contains(F.lower("text"), F.lit(caption.lower().strip())))
        deltas = deltas.join(wanted.select(entity).distinct(), entity, "left_semi")
    order = [F.desc("score") if largest_first else F.asc("score"), F.col(entity)]
    ordered = deltas.withColumn("score", F.round(score.get(mode, sign * F.col("delta")), 9)).where("score is not null").orderBy(*order).limit(k)
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_worst(values: DataFrame, k: int, entity: str = "artist_key", scenario: str | None = None) -> DataFrame:
    """The k least (best) and k greatest (worst) mean values: side, place from 1, entity, mean."""
    rows = values if scenario is None else values.where(F.col("scenario") == scenario)
    means = rows.groupBy(entity).agg(F.round(F.avg("value"), 9).alias("mean"))
    out = []
    for side, order in (("best", [F.col("mean"), F.col(entity)]), ("worst", [F.desc("mean"), F.desc(entity)])):
        top = means.orderBy(*order).limit(k)
        out.append(top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(*order)).alias("place"), entity, "mean"))
    return out[0].union(out[1])


def candidate_clips(clips: DataFrame, secondary: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """Clips of a candidate in index order, or by a secondary metric's rank, unranked last."""
    if secondary is None:
        return clips.orderBy(key)
    return clips.join(secondary.select(key, F.col("rank").alias("secondary_rank"), "evidence"), key, "left").orderBy(F.col("secondary_rank").asc_nulls_last(), key)


def choose_evaluation_artists(profiles: DataFrame, num_targets: int, num_controls: int, seed: int, min_clips: int = 1, targets: list[str] | None = None, controls: list[str] | None = None) -> DataFrame:
    """Targets by clips, genres not yet used first; controls in hash order of the rest. profiles:
    artist_key, dominant_genre, clips. role and position (from 0). Artists with fewer than
    min_clips don't count. Lists given explicitly are taken in their order: an artist in both or
    twice, or one that doesn't count, is an error, as are too few artists."""
    from quillon.functions.text import stable_hash

    profiles = profiles.where(F.col("clips") >= min_clips)
    named = [*(targets or []), *(controls or [])]
    if len(set(named)) < len(named):
        raise ValueError("an artist is named twice")
    if named:
        known = {r[0] for r in profiles.where(F.col("artist_key").isin(named)).select("artist_key").collect()}
        if set(named) - known:
            raise ValueError(f"unknown artists or too few clips: {sorted(set(named) - known)}")
        given = profiles.sparkSession.createDataFrame([(role, i, x) for role, xs in (("target", targets), ("control", controls)) for i, x in enumerate(xs or [])], "role string, position int, artist_key string")
        given = given.select("artist_key", "role", "position")
        if targets and controls:
            return given
        free = profiles.where(~F.col("artist_key").isin(named))
        more = choose_evaluation_artists(free, 0 if targets else num_targets, 0 if controls else num_controls, seed)
        return given.union(more)
    if profiles.limit(num_targets + num_controls).count() < num_targets + num_controls:
        raise ValueError("too few artists with enough clips")
    in_genre = F.row_number().over(Window.partitionBy("dominant_genre").orderBy(F.desc("clips"), "artist_key"))
    ranked = profiles.withColumn("repeat", in_genre > 1)
    first = ranked.orderBy("repeat", F.desc("clips"), "artist_key").limit(num_targets)
    chosen = first.select("artist_key", F.lit("target").alias("role"), (F.row_number().over(Window.orderBy("repeat", F.desc("clips"), "artist_key")) - 1).alias("position"))
    order = [stable_hash(seed, "controls", "artist_key"), F.col("artist_key")]
    rest = profiles.join(chosen.select("artist_key"), "artist_key", "left_anti").orderBy(*order).limit(num_controls)
    return chosen.union(rest.select("artist_key", F.lit("control").alias("role"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("position")))


def holm_adjust(p: DataFrame, family: list[str], value: str = "p") -> DataFrame:
    """p with p_holm: the running maximum of (m - rank) p over the family's finite p values in
    ascending order, at most 1; NaN stays NaN."""
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    w = Window.partitionBy(*family, finite)
    rank = F.row_number().over(w.orderBy(value)) - 1
    scaled = p.withColumn("_s", (F.count("*").over(w) - rank) * F.col(value))
    adjusted = F.least(F.lit(1.0), F.max("_s").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.withColumn("p_holm", F.when(finite, adjusted).otherwise(F.lit(float("nan")))).drop("_s")


def display_order(items: DataFrame, config: DataFrame, include_unlisted: bool = True) -> DataFrame:
    """Items (id, index, pos, and group where there are several lists) in configured order: an
    entry (entry, id, index, show, and group) names an item of its group by id, and if no item has
    that id, by index; the first entry of an item counts; hidden ones are kept and marked."""
    group = ["group"] if "group" in items.columns else []
    own = items.select(*group, "id", "index", F.col("pos").alias("item"))
    by_id = config.join(own.drop("index"), [*group, "id"], "left").select(*group, "entry", "index", "show", "item")
    by_index = by_id.where("item is null").drop("item").join(own.drop("id"), [*group, "index"]).select(*group, "entry", "show", "item")
    first = by_id.where("item is not null").select(*group, "entry", "show", "item").union(by_index).groupBy(*group, F.col("item").alias("pos")).agg(F.min(F.struct("entry", "show")).alias("e"))
    joined = items.join(first, [*group, "pos"], "left" if include_unlisted else "inner")
    out = joined.select(*group, "id", "index", "pos", F.col("e.entry").alias("entry"), F.coalesce("e.show", F.lit(True)).alias("visible"))
    return out.orderBy(*group, F.col("entry").asc_nulls_last(), "pos")


def demo_bundle(selections: DataFrame, clips: DataFrame, paths: list[str]) -> DataFrame:
    """Selected clips, one row per asset: sample_id, group, asset, path. A selection that no clip
    has is an error."""
    joined = selections.join(clips.withColumn("_there", F.lit(True)), "sample_id", "left")
    found = checked(joined, F.col("_there"), F.concat(F.lit("selection without a clip: "), F.coalesce(F.col("sample_id").cast("string"), F.lit("null")))).drop("_there")
    return found.unpivot(["sample_id", "group"], paths, "asset", "path").where("path is not null and path <> ''")


def bundle_manifest(bundle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of demo_bundle's rows: one row per item with its assets as a map, in order of sample_id
    within the group (ordinal from 1); and the number of items and assets of each group."""
    items = bundle.groupBy("group", "sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "path")))).alias("assets"))
    numbered = items.withColumn("ordinal", F.row_number().over(Window.partitionBy("group").orderBy("sample_id")))
    return numbered, bundle.groupBy("group").agg(F.count_distinct("sample_id").alias("items"), F.count("*").alias("assets"))


def matched_row(values: DataFrame, entity: str, scenarios: list[str]) -> DataFrame:
    """One wide row per entity with a cell for each scenario (the first value by sample)."""
    return values.groupBy(entity).pivot("scenario", scenarios).agg(F.min_by("value", "sample_id"))


def matched_table(cells: DataFrame, clips: DataFrame, artists: DataFrame, scenarios: list[str], key: str = "sample_id") -> DataFrame:
    """One wide row per clip: clips (key, target, caption, prefix, ...) and for each scenario its
    cell, and `<scenario>_artists`, the names of the artists controlled in it, in the order of
    their ids. cells: key, scenario, value, ids; artists: id, name."""
    named = cells.select(key, "scenario", F.posexplode_outer("ids").alias("k", "id")).join(artists, "id", "left")
    names = named.groupBy(key, "scenario").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s.getField("name")), ", ").alias("names"))
    own = cells.select(key, "scenario", "value").join(names, [key, "scenario"], "left")
    wide = own.groupBy(key).pivot("scenario", scenarios).agg(F.first("value").alias("value"), F.first("names").alias("artists"))
    return clips.join(wide, key).select(*clips.columns, *(c for s in scenarios for c in (F.col(f"{s}_value").alias(s), F.col(f"{s}_artists"))))


def attach_similarity(variants: DataFrame, sidecar: DataFrame, excluded: DataFrame) -> DataFrame:
    """variants left-joined with the sidecar by sample and variant; values that are not finite
    become null; hidden and excluded samples go."""
    finite = F.when(~F.isnan("similarity") & (F.abs("similarity") < F.lit(float("inf"))), F.col("similarity"))
    kept = variants.where("visible").join(excluded, "sample_id", "left_anti")
    return kept.join(sidecar, ["sample_id", "variant"], "left").withColumn("similarity", finite)


def best_k_models(runs: DataFrame, metric: str, k: int, mode: str = "max") -> DataFrame:
    """The true k best runs by a metric."""
    order = F.desc(metric) if mode == "max" else F.asc(metric)
    return runs.where(F.col(metric).isNotNull()).orderBy(order, "run_id").limit(k)
