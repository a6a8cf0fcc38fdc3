"""Keyed series: envelopes, dominant periods, profiles and templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def envelope(series: DataFrame, key: str, order: list, value: str, points: int = 180, scale: float = 1.0) -> DataFrame:
    """key, bucket, peak: consecutive samples in `points` buckets (the last takes the rest), the
    largest absolute value over scale, at most 1, to 4 places; empty buckets are 0."""
    w = Window.partitionBy(key)
    ranked = series.select(key, F.col(value).alias("v"), (F.row_number().over(w.orderBy(*order)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    width = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    peaks = ranked.groupBy(key, F.least(F.floor(F.col("i") / width), F.lit(points - 1)).alias("bucket")).agg(F.bround(F.least(F.lit(1.0), F.max(F.abs("v")) / scale), 4).alias("peak"))
    grid = series.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    return grid.join(peaks, [key, "bucket"], "left").fillna(0.0, ["peak"])


def resample_grid(series: DataFrame, key: str, slot: str, value: str, slots: int) -> DataFrame:
    """key, slot, value on a dense grid of slots from 0; gaps are 0."""
    grid = series.select(key).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    sums = series.groupBy(key, slot).agg(F.sum(value).alias("value"))
    return grid.join(sums, [key, slot], "left").fillna(0.0, ["value"])


#: Slots of a chunk, at least, in which autocorrelations are summed.
CHUNK = 4096


def autocorrelation(samples: DataFrame, key: str, slot: str, value: str, low: int, high: int) -> DataFrame:
    """key, lag, total, pairs: sums of products of a key's values `lag` slots apart, from low to
    high (0 or more), and how many such pairs there are. Slots are distinct whole numbers; gaps
    count as absent.

    Fast Fourier transforms over chunks of CHUNK (or high, if more) slots, each with the `high`
    slots after it: a value goes to two chunks at most, and a chunk gives one row per lag.
    """
    size = max(CHUNK, high)
    block = F.floor(F.col(slot) / size)
    both = F.array_compact(F.array(block, F.when(F.pmod(F.col(slot), F.lit(size)) < high, block - 1)))
    rows = samples.where(F.col(value).isNotNull()).select(key, F.col(slot).cast("long").alias("slot"), F.col(value).cast("double").alias("x"), F.explode(both).alias("block"))

    def chunk(of: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["slot"].to_numpy() - of[1] * size
        n = int(at.max()) + 1
        signal = np.zeros((2, n))  # values, and where there are any
        signal[:, at] = np.stack([rows["x"].to_numpy(), np.ones(len(rows))])
        width = 1 << (n + size).bit_length()
        head, whole = np.fft.rfft(signal[:, :size], width), np.fft.rfft(signal, width)
        sums = np.fft.irfft(head.conj() * whole, width)[:, low : high + 1]
        return pd.DataFrame({key: [of[0]] * (high - low + 1), "lag": np.arange(low, high + 1), "total": sums[0], "pairs": np.rint(sums[1]).astype(np.int64)})

    sums = rows.groupBy(key, "block").applyInPandas(chunk, T.StructType([samples.schema[key], *T.StructType.fromDDL("lag int, total double, pairs long").fields]))
    return sums.groupBy(key, "lag").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def dominant_period(dense: DataFrame, key: str, slot: str, low: int, high: int) -> DataFrame:
    """key, period: the lag from low to high of largest autocorrelation of the positive
    differences, mean taken off and divided by the sample deviation (first lag on ties to 9
    places); 0 for fewer than 3 differences. dense: key, slot (from 0), value."""
    before = dense.select(key, (F.col(slot) + 1).alias(slot), F.col("value").alias("before"))
    rise = dense.join(before, [key, slot]).where(F.col(slot) > 0).select(key, slot, F.greatest(F.lit(0.0), F.col("value") - F.col("before")).alias("d"))
    sizes = rise.groupBy(key).agg(F.avg("d").alias("mean"), F.greatest(F.stddev_samp("d"), F.lit(1e-8)).alias("deviation"), F.count("d").alias("n"))
    unit = rise.join(sizes, key).select(key, slot, ((F.col("d") - F.col("mean")) / F.col("deviation")).alias("x"))
    scores = autocorrelation(unit, key, slot, "x", low, high).where("pairs > 0").select(key, "lag", F.round(F.col("total") / F.col("pairs"), 9).alias("score")).join(sizes.select(key, "n"), key)
    best = scores.where("lag < n").groupBy(key).agg(F.max(F.struct("score", (-F.col("lag")).alias("l"))).alias("b"), F.max("n").alias("n"))
    return dense.select(key).distinct().join(best.select(key, F.when(F.col("n") >= 3, -F.col("b.l")).alias("period")), key, "left").fillna(0, ["period"])


def period_rate(periods: DataFrame, key: str, slots_per_minute: float) -> DataFrame:
    """key, rate: repetitions a minute of each period; 0 without one."""
    return periods.select(key, F.when(F.col("period") > 0, slots_per_minute / F.col("period")).otherwise(0.0).alias("rate"))


def rate_error(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: the mean absolute difference of paired rates, and the number of pairs."""
    j = left.join(right.select(key, F.col("rate").alias("other")), key)
    return j.agg(F.avg(F.abs(F.col("rate") - F.col("other"))).alias("error"), F.count("*").alias("n"))


def profile(series: DataFrame, key: str, frame: str, bin_: str, value: str, bins: int = 12) -> DataFrame:
    """key, bin, weight: per-frame L2-normalised bins averaged over frames."""
    sums = series.groupBy(key, frame, F.pmod(F.col(bin_), F.lit(bins)).alias("bin")).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(key, frame)
    unit = sums.withColumn("u", F.col("v") / F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v")).over(w)), F.lit(1e-8)))
    frames = series.groupBy(key).agg(F.count_distinct(frame).alias("frames"))
    return unit.groupBy(key, "bin").agg(F.sum("u").alias("s")).join(frames, key).select(key, "bin", (F.col("s") / F.col("frames")).alias("weight"))


def profile_similarity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Cosine of paired profiles; a bin that one side lacks is 0."""
    j = left.select(key, "bin", F.col("weight").alias("x")).join(right.select(key, "bin", F.col("weight").alias("y")), [key, "bin"], "full").fillna(0.0, ["x", "y"])
    return j.groupBy(key).agg((F.sum(F.col("x") * F.col("y")) / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))), F.lit(1e-12))).alias("similarity"))


def triads(spark) -> DataFrame:
    """template, bin, t: the 24 centred, normalised triads (0 to 11 major, 12 to 23 minor): a rule,
    not a table. A triad has 3 of 12 ones: centred entries 3/4 and -1/4, norm 3/2."""
    rows = [(12 * minor + root, b, (0.75 if (b - root) % 12 in ((0, 3, 7) if minor else (0, 4, 7)) else -0.25) / 1.5) for minor in (0, 1) for root in range(12) for b in range(12)]
    return spark.createDataFrame(rows, "template int, bin long, t double")


def template_match(profiles: DataFrame, *key: str) -> DataFrame:
    """key, template: of largest correlation (to 9 places, first on ties). Centring and scaling a
    profile changes no order among centred templates, so products suffice."""
    scores = profiles.join(F.broadcast(triads(profiles.sparkSession)), "bin").groupBy(*key, "template").agg(F.round(F.sum(F.col("weight") * F.col("t")), 9).alias("score"))
    return scores.groupBy(*key).agg(F.max(F.struct("score", (-F.col("template")).alias("l"))).alias("b")).select(*key, (-F.col("b.l")).alias("template"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Share of keys on which two template columns agree."""
    j = left.join(right.withColumnRenamed("template", "other"), keys)
    return j.agg(F.avg((F.col("template") == F.col("other")).cast("int")).alias("rate"), F.count("*").alias("n"))
