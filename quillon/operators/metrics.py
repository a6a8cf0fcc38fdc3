"""Metric aggregations: attribution, confidence, divergence, similarity and token losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import arrays as a
from quillon.operators.checks import checked
from quillon.sources.stored import stored


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def aggregate_by_artist(values: DataFrame, keys: tuple[str, ...] = ("scenario", "artist_key"), clips: int | None = None) -> DataFrame:
    """Mean per scenario and artist; NaN is not skipped. With the number of clips of an artist,
    any other number of rows than that or one (a value of the artist itself) is an error."""
    means = values.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"), F.count("*").alias("_rows"))
    if clips is not None:
        means = checked(means, F.col("_rows").isin(1, clips), F.concat_ws(" ", F.lit(f"neither 1 nor {clips} values for"), *(F.col(k).cast("string") for k in keys)))
    return means.drop("_rows")


def summarize(values: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of the finite values, and their number (NaN, NaN, 0 if none)."""
    x = F.when(finite("value"), F.col("value"))
    nan = F.lit(float("nan"))
    return values.groupBy(*keys).agg(F.coalesce(F.avg(x), nan).alias("mean"), F.coalesce(F.stddev_pop(x), nan).alias("std"), F.count(x).alias("n"))


def scenario_metric_table(values: DataFrame, scenarios: list[str], metrics: list[str]) -> DataFrame:
    """One row per scenario in the given order, one column per metric; empty cells are NaN."""
    spark = values.sparkSession
    order = spark.createDataFrame(list(enumerate(scenarios)), "position int, scenario string")
    wide = values.groupBy("scenario").pivot("metric", metrics).agg(F.avg(F.when(finite("value"), F.col("value"))))
    cells = [F.coalesce(F.col(m), F.lit(float("nan"))).alias(m) for m in metrics]
    return order.join(wide, "scenario", "left").select("position", "scenario", *cells)


def target_statistics(df: DataFrame, logits: str, target: str) -> DataFrame:
    """hit, confidence, rank and predicted of a 0-based target among logits."""
    predicted = a.argmax(logits)
    return df.withColumns({"predicted": predicted, "hit": (predicted == F.col(target)).cast("int"), "confidence": a.softmax_at(logits, F.col(target)), "rank": a.rank_of(logits, F.col(target))})


def attribution(clips: DataFrame, *keys: str) -> DataFrame:
    return clips.groupBy(*keys).agg(F.avg("hit").alias("rate"), F.avg("confidence").alias("mean_confidence"), F.avg("rank").alias("mean_rank"), F.count("*").alias("clips"))


def target_attribution_rate(clips: DataFrame) -> DataFrame:
    return clips.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def other_accuracy(clips: DataFrame, label: str, ignored: list[int]) -> DataFrame:
    return clips.where(~F.col(label).isin(ignored)).agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def forgetting_gap(reference: DataFrame, forgotten: DataFrame, key: str, scores: str, target: str, probabilities: bool = False) -> DataFrame:
    """Mean loss of the target's probability over paired rows; scores are logits, or
    probabilities."""
    at = (lambda c, t: F.get(c, t)) if probabilities else a.softmax_at
    pairs = reference.select(key, F.col(target).alias("t"), at(scores, F.col(target)).alias("p")).join(forgotten.select(key, F.col(scores).alias("l")), key)
    return pairs.agg(F.avg(F.col("p") - at("l", F.col("t"))).alias("gap"), F.count("*").alias("n"))


def topk_accuracy(df: DataFrame, logits: str, label: str, k: int = 5) -> DataFrame:
    top = lambda n: F.avg(a.in_top(logits, F.col(label), n).cast("int"))
    return df.agg(top(1).alias("top1"), top(k).alias("topk"), F.avg(-F.ln(a.softmax_at(logits, F.col(label)))).alias("cross_entropy"))


def paired_kl(df: DataFrame, reference: str, generated: str) -> DataFrame:
    """Mean and population deviation of KL both ways and their sum over paired logit rows."""
    k = df.select(a.kl_from_logits(reference, generated).alias("rg"), a.kl_from_logits(generated, reference).alias("gr")).withColumn("both", F.col("rg") + F.col("gr"))
    return k.agg(*(f(c).alias(f"{c}_{n}") for c in ("rg", "gr", "both") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def clap_score(df: DataFrame, left: str, right: str, scale: float = 100.0, floor: float = 0.0) -> DataFrame:
    return df.agg(F.avg(F.greatest(F.lit(floor), a.cosine(left, right) * scale)).alias("score"))


def token_confidence(tokens: DataFrame, clip: str, loss: str, valid: Column) -> DataFrame:
    """Per clip: mean exp(-loss) over valid tokens (NaN if none), their sum and number."""
    c = F.when(valid, F.exp(-F.col(loss)))
    return tokens.groupBy(clip).agg(F.coalesce(F.avg(c), F.lit(float("nan"))).alias("confidence"), F.coalesce(F.sum(c), F.lit(0.0)).alias("total"), F.count(c).alias("n"))


def valid_tokens(label: str, pad: int | None = None, ignore: int = -100, in_time: str | None = None) -> Column:
    """Whether a token counts: its label is neither ignored nor padding, and its time is masked in."""
    ok = F.col(label) != ignore
    ok = ok if pad is None else ok & (F.col(label) != pad)
    return F.coalesce(ok if in_time is None else ok & F.col(in_time).cast("boolean"), F.lit(False))


def logit_confidence(tokens: DataFrame, clip: str, logits: str, label: str, valid: Column) -> DataFrame:
    """token_confidence from logits: per clip the mean probability of the labels of valid tokens."""
    loss = F.when(valid, -F.ln(a.softmax_at(logits, F.col(label))))
    return token_confidence(tokens.withColumn("_loss", loss), clip, "_loss", valid)


def micro_confidence(per_clip: DataFrame) -> DataFrame:
    return per_clip.agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("confidence"), F.sum("n").alias("n"))


def rollout_confidence(scores: DataFrame, labels: DataFrame, prompt: int, positions: list[int]) -> DataFrame:
    """clip, position, confidence: frame r, codebook q is scored at step r - 1 + q against label
    column prompt + r - 1; mean over valid codebooks at the requested 1-based frames."""
    frames = labels.withColumn("position", F.col("column") - prompt + 1).where(F.col("position").isin(positions)).withColumn("step", F.col("position") - 1 + F.col("codebook"))
    joined = frames.join(scores, ["clip", "codebook", "step"])
    c = F.when(F.col("valid"), a.softmax_at("logits", F.col("label")))
    return joined.groupBy("clip", "position").agg(F.avg(c).alias("confidence"), F.count(c).alias("codebooks"))


def curve_positions(every: int, last: int) -> list[int]:
    """1, k, 2k, ... up to the last frame."""
    return sorted({1, *range(every, last + 1, every)})


def confidence_curve(rollouts: DataFrame, scenarios: list[str]) -> DataFrame:
    """Mean per position (rows) and scenario (columns) over finite clips."""
    return rollouts.where(finite("confidence")).groupBy("position").pivot("scenario", scenarios).agg(F.avg("confidence"))


def axis_range(df: DataFrame, column: str, padding: float = 0.12, least: float = 0.02) -> DataFrame:
    """Plot limits inside 0 and 1: 12 per cent padding around at least a minimal span."""
    low, high = F.min(column), F.max(column)
    r = df.where(finite(column)).agg(low.alias("lo"), high.alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(least))
    mid = (F.col("hi") + F.col("lo")) / 2
    half = span * (0.5 + padding)
    return r.select(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))


def max_abs_delta(values: DataFrame, baseline: str, key: str) -> DataFrame:
    """Per scenario: the largest absolute paired difference from the baseline, over finite pairs,
    and whether all are 0."""
    x = F.when(finite("value"), F.col("value"))
    base = values.where(F.col("scenario") == baseline).groupBy(key).agg(F.avg(x).alias("b"))
    own = values.where(F.col("scenario") != baseline).groupBy(key, "scenario").agg(F.avg(x).alias("v"))
    delta = F.abs(F.col("v") - F.col("b"))
    return own.join(base, key).groupBy("scenario").agg(F.max(delta).alias("max_abs_delta"), (F.max(delta) == 0).alias("identical"))


def token_losses(tokens: DataFrame, sample: str, codebook: str, loss: str, valid: Column) -> DataFrame:
    """Per sample: mean over codebooks of their mean valid loss, and perplexity (at most 1e12)."""
    books = tokens.where(valid).groupBy(sample, codebook).agg(F.avg(loss).alias("book_loss"))
    out = books.groupBy(sample).agg(F.avg("book_loss").alias("loss"))
    return out.withColumn("perplexity", F.least(F.exp("loss"), F.lit(1e12)))


def batch_metrics(tokens: DataFrame, batch: str, codebook: str, logits: str, label: str, valid: Column) -> DataFrame:
    """Per batch: loss (mean over codebooks of the mean valid cross entropy; 0 without a valid
    token), perplexity (at most 1e12) and the accuracy of the largest logit over valid tokens."""
    at = F.when(valid, F.col(label))
    rows = tokens.select(batch, codebook, F.when(valid, -F.ln(a.softmax_at(logits, at))).alias("loss"), F.when(valid, (a.argmax(logits) == at).cast("int")).alias("hit"))
    books = rows.groupBy(batch, codebook).agg(F.avg("loss").alias("book_loss"), F.sum("hit").alias("hits"), F.count("hit").alias("n"))
    out = books.groupBy(batch).agg(F.coalesce(F.avg("book_loss"), F.lit(0.0)).alias("loss"), (F.coalesce(F.sum("hits"), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("token_accuracy"))
    return out.withColumn("perplexity", F.least(F.exp("loss"), F.lit(1e12)))


def margin_hinges(log: DataFrame, margin: float, budget: float, eps: float = 1e-8) -> DataFrame:
    """Means of the margin losses over a paired log: pos, neg, def, correct, wrong, ctrl, ref, energy."""
    relu = lambda x: F.avg(F.greatest(x, F.lit(0.0)))
    c = F.col
    excess = F.greatest(F.sqrt(F.greatest(c("energy"), F.lit(eps))) - budget, F.lit(0.0))
    return log.agg(
        relu(c("pos") - c("def") + margin).alias("enhance"),
        relu(c("correct") - c("wrong") + margin).alias("contrast"),
        relu(c("def") - c("neg") + margin).alias("suppress"),
        relu(c("ctrl") - c("ref") - margin).alias("preserve"),
        F.avg(excess * excess).alias("budget"),
    )


def run_totals(assets: DataFrame, codebooks: int) -> DataFrame:
    """One row over unique assets: status (ok, failed, or null where not processed), length, and
    rows, the manifest rows that name the asset (1 if there is no such column). A run is complete
    when every asset was processed."""
    ok, done = F.coalesce(F.col("status") == "ok", F.lit(False)), F.col("status").isNotNull()
    rows = F.coalesce(F.sum("rows" if "rows" in assets.columns else F.lit(1)), F.lit(0))
    steps = F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0))
    return assets.agg(
        rows.alias("manifest_rows"),
        F.count("*").alias("unique"),
        (rows - F.count("*")).alias("duplicates"),
        F.count_if(done).alias("processed"),
        F.count_if(ok).alias("ok"),
        F.count_if(done & ~ok).alias("failed"),
        steps.alias("token_steps"),
        (steps * codebooks).alias("token_ids"),
        F.when(F.count_if(~done) == 0, "complete").otherwise("partial").alias("status"),
    )


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: normalised mean of the normalised vectors."""
    long = vectors.select(key, F.posexplode(a.l2_normalize(vector)).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    mean = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(key, F.col("v.x").alias("v"))
    return mean.select(key, a.l2_normalize("v").alias("centroid"))


def similarity_rows(df: DataFrame, key: str, text: str, before: str, after: str, reference: str) -> DataFrame:
    """Text, paired, reference and centroid cosines before and after, with their differences."""
    joined = df.join(centroids(df, key, reference), key)
    pairs = {"text": text, "reference": reference, "centroid": "centroid"}
    cols = {"paired": a.cosine(before, after)}
    for name, other in pairs.items():
        cols |= {f"{name}_before": a.cosine(before, other), f"{name}_after": a.cosine(after, other)}
    out = joined.withColumns(cols)
    return out.withColumns({f"{n}_delta": F.col(f"{n}_after") - F.col(f"{n}_before") for n in pairs})


def mean_pool(frames: DataFrame, clip: str, vector: str, valid: Column) -> DataFrame:
    """clip, i, x: masked mean of frame vectors by dimension."""
    return frames.where(valid).select(clip, F.posexplode(vector).alias("i", "x")).groupBy(clip, "i").agg(F.avg("x").alias("x"))


#: Entities whose vectors may be broadcast.
FEW = 2048


def pairwise_similarity(entities: DataFrame, key: str, vector: str, centred: bool = False, eps: float = 1e-8) -> DataFrame:
    """left, right, similarity of all pairs of at most FEW entities, one copy of which is broadcast;
    more are compared by blocked_similarity, whose keys are texts. With centred, the mean over
    entities is taken off first."""
    if centred:
        mean = entities.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(F.col("v.m").alias("mean"))
        entities = entities.join(F.broadcast(mean)).select(key, F.zip_with(vector, "mean", lambda x, m: x - m).alias(vector))
    if entities.limit(FEW + 1).count() > FEW:
        kind = dict(entities.dtypes)[key]
        far = blocked_similarity(entities, key, vector, FEW)
        return far.select(F.col("left").cast(kind).alias("left"), F.col("right").cast(kind).alias("right"), "similarity")
    unit = entities.select(key, F.transform(vector, lambda x: x / F.greatest(a.norm(vector), F.lit(eps))).alias("u"))
    right = unit.select(F.col(key).alias("right"), F.col("u").alias("w"))
    return unit.select(F.col(key).alias("left"), "u").join(F.broadcast(right)).select("left", "right", a.dot("u", "w").alias("similarity"))


def blocked_similarity(entities: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """All pairs by blocks of rows: each pair of blocks is one matrix product in a task."""
    nb = max(1, -(-entities.count() // block))
    marked = entities.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).alias("b"))
    left = marked.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    right = marked.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("b").alias("c2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("b2"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"left": [], "right": [], "similarity": []})
        m, n = np.stack(x["v"].to_numpy()).astype(float), np.stack(y["v2"].to_numpy()).astype(float)
        m, n = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8) for z in (m, n))
        return pd.DataFrame({"left": np.repeat(x["k"].to_numpy(), len(y)), "right": np.tile(y["k2"].to_numpy(), len(x)), "similarity": (m @ n.T).ravel()})

    return left.groupBy("b", "c").cogroup(right.groupBy("b2", "c2")).applyInPandas(product, "left string, right string, similarity double")


def moving_average(stored: DataFrame, new: DataFrame, momentum: float) -> DataFrame:
    """momentum * old + (1 - momentum) * new by (left, right); a pair of one side is copied."""
    n = new.select("left", "right", F.col("similarity").alias("s"))
    both = stored.join(n, ["left", "right"], "full")
    return both.select("left", "right", F.coalesce(F.col("similarity") * momentum + F.col("s") * (1 - momentum), "s", "similarity").alias("similarity"))


def genre_affinity(weights: DataFrame) -> DataFrame:
    """left, right, similarity: product of the entities' genre weights (entity, genre, weight),
    joined by genre; entities without a common genre have no row. Where most pairs have one, each
    pair of blocks of entities is one matrix product in a task, and no pair is shuffled."""
    weights = stored(weights.select("entity", "genre", "weight"))
    blocks = _affinity_blocks(weights)
    if not blocks:
        right = weights.select("genre", F.col("entity").alias("right"), F.col("weight").alias("w"))
        return weights.join(right, "genre").groupBy(F.col("entity").alias("left"), "right").agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))

    def pairs(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        left, right, dots, common = _affinities(x, y)
        i, j = np.nonzero(common)
        return pd.DataFrame({"left": left[i], "right": right[j], "similarity": dots[i, j]})

    key, number = (dict(_affinity_columns(weights).dtypes)[c] for c in ("entity", "weight"))
    return _by_blocks(weights, blocks).applyInPandas(pairs, f"left {key}, right {key}, similarity {number}")


def affinity_weights(weights: DataFrame) -> DataFrame:
    """peer_weights of genre_affinity(weights) in proportion to it. In blocks, an entity's total
    comes from a first pass over the products, which gives one row an entity and block; the second
    pass gives the pairs."""
    weights = stored(weights.select("entity", "genre", "weight"))
    blocks = _affinity_blocks(weights)
    if not blocks:
        return peer_weights(genre_affinity(weights), 1.0, "affinity")

    def peers(x: pd.DataFrame, y: pd.DataFrame) -> tuple:
        left, right, dots, common = _affinities(x, y)
        return left, right, dots, common & (left[:, None] != right[None, :])

    def totals(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        left, _, dots, common = peers(x, y)
        return pd.DataFrame({"entity": left, "total": np.where(common, dots, 0).sum(axis=1), "n": common.sum(axis=1)})

    def shares(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        left, right, dots, common = peers(x, y)
        i, j = np.nonzero(common)
        known = x.drop_duplicates("entity").set_index("entity").loc[left]
        total, n = known["total"].to_numpy(float)[i], known["n"].to_numpy()[i]
        return pd.DataFrame({"left": left[i], "right": right[j], "weight": np.where(total > 0, dots[i, j] / np.where(total > 0, total, 1.0), 1.0 / n)})

    key, number = (dict(_affinity_columns(weights).dtypes)[c] for c in ("entity", "weight"))
    sums = _by_blocks(weights, blocks).applyInPandas(totals, f"entity {key}, total {number}, n long").groupBy("entity").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _by_blocks(weights, blocks, sums).applyInPandas(shares, f"left {key}, right {key}, weight double")


#: Entities of a block of products, and genres that a product takes at once.
AFFINITY_BLOCK, AFFINITY_GENRES = 1024, 4096


def _affinity_columns(weights: DataFrame) -> DataFrame:
    """entity, genre, weight: a whole number as long, another one as double."""
    kind = dict(weights.dtypes)["weight"]
    return weights.select("entity", "genre", F.col("weight").cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "double").alias("weight"))


def _affinity_blocks(weights: DataFrame) -> int:
    """Blocks for the products of the entities; 0 where a join by genre is better: few pairs have
    a common genre, or an entity or weight is null or not finite, or weights are decimals. Asked by
    two small jobs, so weights are stored first."""
    kinds = dict(weights.dtypes)
    if kinds["weight"].startswith("decimal"):
        return 0
    w = F.col("weight").cast("double")
    odd = F.count_if(F.col("entity").isNull() | w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    genres = weights.where("genre is not null").groupBy("genre").agg(F.count("*").cast("double").alias("rows"), odd.alias("odd"))
    seen = genres.agg(F.sum(F.col("rows") * F.col("rows")).alias("joined"), F.sum("odd").alias("odd")).first()
    n = weights.select("entity").distinct().count()
    if not n or seen["joined"] is None or seen["odd"] or seen["joined"] * 16 < float(n) * n:
        return 0
    return -(-n // AFFINITY_BLOCK)


def _by_blocks(weights: DataFrame, blocks: int, totals: DataFrame | None = None):
    """Rows of each pair of blocks of entities, cogrouped; left ones with their totals, if given.
    The pairs are dealt out by number: small tables would else meet in one task."""
    marked = _affinity_columns(weights).where("genre is not null").withColumn("own", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(c)
    left = (marked if totals is None else marked.join(totals, "entity")).select("*", each("other"))
    right = marked.select(*(F.col(c).alias(c + "2") for c in ("entity", "genre", "weight")), F.col("own").alias("other2"), each("own2"))
    tasks = min(blocks * blocks, 4096)
    return left.repartition(tasks, "own", "other").groupBy("own", "other").cogroup(right.repartition(tasks, "own2", "other2").groupBy("own2", "other2"))


def _affinities(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entities of two blocks, their sums of products of weights by genre, and which pairs have
    a common genre."""
    y = y.rename(columns=lambda c: c.removesuffix("2"))
    (i, left), (j, right) = pd.factorize(x["entity"]), pd.factorize(y["entity"])
    shared = pd.Index(x["genre"].unique()).intersection(pd.Index(y["genre"].unique()))
    whole = np.issubdtype(x["weight"].dtype, np.integer)
    dots = np.zeros((len(left), len(right)), np.int64 if whole else np.float64)
    common = np.zeros(dots.shape, bool)

    def spread(rows: pd.DataFrame, at: np.ndarray, n: int, genres: pd.Index) -> tuple[np.ndarray, np.ndarray]:
        g = genres.get_indexer(rows["genre"])
        values, there = np.zeros((n, len(genres)), dots.dtype), np.zeros((n, len(genres)), np.float32)
        np.add.at(values, (at[g >= 0], g[g >= 0]), rows["weight"].to_numpy()[g >= 0])
        there[at[g >= 0], g[g >= 0]] = 1
        return values, there

    for k in range(0, len(shared), AFFINITY_GENRES):
        genres = shared[k : k + AFFINITY_GENRES]
        (m, a_), (n, b_) = spread(x, i, len(left), genres), spread(y, j, len(right), genres)
        if whole and float(np.abs(m).max()) * float(np.abs(n).max()) * len(shared) >= 2.0**63:
            raise OverflowError("sums of products of weights exceed a long")
        dots += m @ n.T
        common |= (a_ @ b_.T) > 0
    return np.asarray(left), np.asarray(right), dots, common


def peer_weights(similarity: DataFrame, temperature: float, mode: str = "similarity", masked: DataFrame | None = None) -> DataFrame:
    """left, right, weight: softmax of similarity / temperature over peers without the entity
    itself, in proportion to it (affinity: similarity is genre_affinity of all pairs), or uniform;
    masked peers go and the rest is renormalised, uniform if nothing is left."""
    peers = similarity.where("left <> right")
    raw = {"similarity": F.exp(F.col("similarity") / temperature), "affinity": F.col("similarity"), "uniform": F.lit(1.0)}[mode]
    row = Window.partitionBy("left")
    w = peers.withColumn("w", raw)
    if masked is not None:
        hidden = masked.select(F.col("entity").alias("right"), F.lit(True).alias("hidden"))
        w = w.join(hidden, "right", "left").withColumn("w", F.when(F.col("hidden"), 0.0).otherwise(F.col("w")))
    total = F.sum("w").over(row)
    return w.select("left", "right", F.when(total > 0, F.col("w") / total).otherwise(1.0 / F.count("*").over(row)).alias("weight"))


def covariance_sums(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, sums, products: sufficient statistics, one row per task and group, then added.
    Products are the upper triangle; D (D + 3) / 2 numbers per group, whatever the rows."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for g, rows in frame.groupby("g"):
                x = np.stack(rows["v"].to_numpy()).astype(np.float64)
                n, s, p = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(x), s + x.sum(axis=0), p + x.T @ x)
        yield pd.DataFrame([(g, n, np.concatenate([s, p[np.triu_indices(len(s))]])) for g, (n, s, p) in sums.items()], columns=["g", "n", "stats"])

    source = vectors.select(F.col(group).cast("string").alias("g"), F.col(vector).alias("v"))
    parts = source.mapInPandas(partial, "g string, n long, stats array<double>")
    long = parts.select("g", "n", F.posexplode("stats").alias("i", "x"))
    return long.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def group_statistics(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """g, n, mean array, covariance (row-major, n - 1; zeros for one row) from covariance_sums."""

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, n = rows.sort_values("i")["x"].to_numpy(), int(rows["n"].iat[0])
        d = int((np.sqrt(8 * len(x) + 9) - 3) / 2)
        mean, full = x[:d] / n, np.zeros((d, d))
        full[np.triu_indices(d)] = x[d:]
        full = full + np.triu(full, 1).T
        cov = (full - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.zeros((d, d))
        return pd.DataFrame({"g": [key[0]], "n": [n], "mean": [mean], "cov": [cov.ravel()]})

    return covariance_sums(vectors, group, vector).groupBy("g").applyInPandas(finish, "g string, n long, mean array<double>, cov array<double>")


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0.0))) @ v.T


def frechet(mean1, cov1, mean2, cov2) -> float:
    """|m1 - m2|^2 + tr(C1 + C2 - 2 sqrt(sqrt(C1) C2 sqrt(C1))), at least 0."""
    d = len(mean1)
    c1, c2 = np.reshape(cov1, (d, d)), np.reshape(cov2, (d, d))
    r = _root(c1)
    w = np.linalg.eigvalsh((r @ c2 @ r + (r @ c2 @ r).T) / 2)
    gap = np.asarray(mean1) - np.asarray(mean2)
    return float(max(0.0, gap @ gap + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(w, 0.0)).sum()))


def frechet_distance(reference: DataFrame, generated: DataFrame, group: str, vector: str, least: int = 2) -> DataFrame:
    """g, n_reference, n_generated, distance of groups with `least` rows on both sides."""
    a1 = group_statistics(reference, group, vector).toDF("g", "n1", "m1", "c1")
    a2 = group_statistics(generated, group, vector).toDF("g", "n2", "m2", "c2")
    both = a1.join(a2, "g").where((F.col("n1") >= least) & (F.col("n2") >= least))

    def distance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"g": f["g"], "n_reference": f["n1"], "n_generated": f["n2"], "distance": [frechet(*x) for x in zip(f["m1"], f["c1"], f["m2"], f["c2"], strict=True)]})

    return both.mapInPandas(distance, "g string, n_reference long, n_generated long, distance double")
