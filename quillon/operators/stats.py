"""Artist-level paired statistics: ANOVA, sphericity, Friedman, permutation, bootstrap."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import without
from .dataset import dense_index
from .metrics import finite
from .ranking import holm_adjust


def metric_matrix(values: DataFrame, scenarios: list[str]) -> DataFrame:
    """metric, artist_key, pos, value: artist means, artists with a cell missing or not finite
    dropped. values: metric, scenario, artist_key, value. Long form; pos numbers the scenarios. A
    scenario that a metric lacks altogether is an error."""
    order = F.array_position(F.array(*map(F.lit, scenarios)), F.col("scenario")).cast("int") - 1
    means = values.where(F.col("scenario").isin(scenarios)).groupBy("metric", "artist_key", order.alias("pos")).agg(F.avg("value").alias("value"))
    known = values.groupBy("metric").agg(F.collect_set(F.when(F.col("scenario").isin(scenarios), F.col("scenario"))).alias("found"))
    lacking = known.select("metric", F.array_except(F.array(*map(F.lit, scenarios)), "found").alias("missing")).where(F.size("missing") > 0)
    whole = means.where(finite("value")).groupBy("metric", "artist_key").agg(F.count("*").alias("cells")).where(F.col("cells") == len(scenarios))
    matrix = means.join(whole.select("metric", "artist_key"), ["metric", "artist_key"])
    fault = F.concat(F.lit("no values of "), F.coalesce("metric", F.lit("null")), F.lit(" for "), F.array_join("missing", ", "))
    return without(matrix, lacking, fault)


def rm_anova(matrix: DataFrame) -> DataFrame:
    """Per metric: sums of squares of values centred on the grand mean, F and degrees of freedom."""
    grand = matrix.groupBy("metric").agg(F.avg("value").alias("grand"))
    centred = matrix.join(F.broadcast(grand), "metric").withColumn("x", F.col("value") - F.col("grand"))
    by = lambda key: centred.groupBy("metric", key).agg(F.avg("x").alias("mean"), F.count("*").alias("n")).groupBy("metric").agg(F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias(f"ss_{key}"), F.count("*").alias(f"n_{key}"))
    total = centred.groupBy("metric").agg(F.sum(F.col("x") * F.col("x")).alias("ss_total"))
    j = total.join(by("pos"), "metric").join(by("artist_key"), "metric")
    error = F.greatest(F.lit(0.0), F.col("ss_total") - F.col("ss_pos") - F.col("ss_artist_key"))
    df1, df2 = (F.col("n_pos") - 1).cast("double"), ((F.col("n_artist_key") - 1) * (F.col("n_pos") - 1)).cast("double")
    ms1, ms2 = F.col("ss_pos") / df1, error / df2
    f = F.when(ms2 == 0, F.when(ms1 == 0, 0.0).otherwise(float("inf"))).otherwise(ms1 / ms2)
    return j.where("n_pos >= 2 and n_artist_key >= 2").select("metric", F.col("n_artist_key").alias("artists"), F.col("n_pos").alias("scenarios"), f.alias("f_statistic"), df1.alias("df1"), df2.alias("df2"))


def _pairs(matrix: DataFrame, strict: bool) -> DataFrame:
    b = matrix.select("metric", "artist_key", F.col("pos").alias("q"), F.col("value").alias("y"))
    a = matrix.select("metric", "artist_key", F.col("pos").alias("p"), F.col("value").alias("x"))
    joined = a.join(b, ["metric", "artist_key"])
    return joined.where("p < q") if strict else joined


def greenhouse_geisser(matrix: DataFrame) -> DataFrame:
    """metric, epsilon: from the double-centred covariance of the scenarios, in [1/(k-1), 1]."""
    cov = _pairs(matrix, False).groupBy("metric", "p", "q").agg(F.covar_samp("x", "y").alias("c"))
    m = Window.partitionBy("metric")
    row, column = Window.partitionBy("metric", "p"), Window.partitionBy("metric", "q")
    centred = cov.select("metric", "p", "q", (F.col("c") - F.avg("c").over(row) - F.avg("c").over(column) + F.avg("c").over(m)).alias("c"))
    sums = centred.groupBy("metric").agg(F.sum(F.when(F.col("p") == F.col("q"), F.col("c"))).alias("trace"), F.sum(F.col("c") * F.col("c")).alias("square"), F.count_distinct("p").alias("k"))
    raw = F.col("trace") * F.col("trace") / ((F.col("k") - 1) * F.col("square"))
    eps = F.when(F.col("square") > 0, F.least(F.lit(1.0), F.greatest(1.0 / (F.col("k") - 1), raw))).otherwise(1.0)
    return sums.select("metric", eps.alias("epsilon"))


def friedman(matrix: DataFrame) -> DataFrame:
    """metric, chi2, df: average ranks within artist, corrected for ties; equal columns give 0."""
    artist = Window.partitionBy("metric", "artist_key")
    ties = Window.partitionBy("metric", "artist_key", "value")
    ranked = matrix.withColumn("t", F.count("*").over(ties)).withColumn("r", F.rank().over(artist.orderBy("value")) + (F.col("t") - 1) / 2)
    ranked = ranked.withColumn("k", F.count("*").over(artist))
    sums = ranked.groupBy("metric", "pos").agg(F.sum("r").alias("s"), F.max("k").alias("k")).groupBy("metric").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("k").alias("k"))
    tie = ranked.groupBy("metric").agg(F.sum(F.col("t") * F.col("t") - 1).alias("tie"), F.count_distinct("artist_key").alias("n"))
    j = sums.join(tie, "metric")
    k, n = F.col("k"), F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    c = 1.0 - F.col("tie") / (n * k * (k * k - 1))
    return j.select("metric", F.when(c > 0, raw / c).otherwise(0.0).alias("chi2"), (k - 1).cast("double").alias("df"))


def paired_differences(matrix: DataFrame) -> DataFrame:
    """metric, p, q, artist_key, d = value of q - value of p for every scenario pair p < q."""
    return _pairs(matrix, True).select("metric", "p", "q", "artist_key", (F.col("y") - F.col("x")).alias("d"))


def mean_differences(differences: DataFrame) -> DataFrame:
    return differences.groupBy("metric", "p", "q").agg(F.avg("d").alias("mean_difference"), F.count("*").alias("n"))


#: Artists of one array of differences, and resamples of one task's block.
CHUNK, BLOCK = 1024, 64
KEYS = ["metric", "p", "q"]


def _chunked(differences: DataFrame) -> DataFrame:
    """metric, p, q, n, chunk, d: the differences in the order of the artists, in arrays of at most
    CHUNK. Artists are numbered by range partitions."""
    artists = dense_index(differences.select("metric", "artist_key").distinct(), "metric", "artist_key", name="at")
    first = artists.groupBy("metric").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    at = artists.join(first, "metric").select("metric", "artist_key", "n", (F.col("at") - F.col("first")).alias("at"))
    placed = differences.join(at, ["metric", "artist_key"]).withColumn("chunk", F.floor(F.col("at") / CHUNK).cast("int"))
    rows = placed.groupBy(*KEYS, "n", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("a"))
    return rows.select(*KEYS, F.col("n").cast("int").alias("n"), "chunk", F.col("a.d").alias("d"))


def _digits(seed: int, r: int, first: int, count: int, width: int) -> np.ndarray:
    """Numbers first, first + 1, ... of resample r: hexadecimal digits, width at a time, of the
    md5 of seed:r:k, where the k-th digest gives 32 / width of them."""
    per = 32 // width
    blocks = range(first // per, (first + count - 1) // per + 1)
    raw = b"".join(hashlib.md5(f"{seed}:{r}:{k}".encode()).digest() for k in blocks)
    out = np.frombuffer(raw, dtype=">u4") if width == 8 else np.stack([(x := np.frombuffer(raw, dtype=np.uint8)) >> 4, x & 15], axis=1).ravel()
    return out[first % per :][:count].astype(np.int64)


def _signs(seed: int, exact: bool):
    """Sums of signed differences of one block of resamples and one chunk of artists, for all
    metrics and pairs at once: their signs are the same."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, chunk, n, runs = (int(rows[c].iat[0]) for c in ("block", "chunk", "n", "runs"))
        d = np.stack(rows["d"].to_numpy()).astype(np.float64)
        r = np.arange(block * BLOCK, min((block + 1) * BLOCK, runs))
        up = (r[:, None] >> np.arange(d.shape[1])) & 1 > 0 if exact else np.stack([_digits(seed, int(x), chunk * CHUNK, d.shape[1], 1) >= 8 for x in r])
        sums = d @ np.where(up, 1.0, -1.0).T
        out = rows[[*KEYS, "n"]].loc[rows.index.repeat(len(r))]
        return out.assign(r=np.tile(r, len(rows)), s=sums.ravel())

    return run


def permutation_p(differences: DataFrame, resamples: int = 10_000, exact_max: int = 16, seed: int = 0) -> DataFrame:
    """metric, p, q, p_value: two-sided sign flips of the mean. Up to exact_max artists all sign
    vectors, else `resamples` vectors from the digits of md5 digests and the add-one rule. Blocks
    of resamples are dealt out, each with chunks of the differences."""
    chunks = _chunked(differences)
    size = f"{', '.join(f'{k} {dict(differences.dtypes)[k]}' for k in KEYS)}, n int, r long, s double"
    found = []
    for exact, mine in ((True, F.col("n") <= exact_max), (False, F.col("n") > exact_max)):
        runs = F.pow(F.lit(2), F.col("n")).cast("int") if exact else F.lit(resamples)
        dealt = chunks.where(mine).withColumn("runs", runs).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("runs") - 1) / BLOCK).cast("int"))))
        found.append(dealt.groupBy("n", "block", "chunk").applyInPandas(_signs(seed, exact), size))
    sums = found[0].union(found[1]).groupBy(*KEYS, "n", "r").agg(F.sum("s").alias("s"))
    seen = mean_differences(differences).select(*KEYS, F.abs("mean_difference").alias("seen"))
    null = F.abs(F.col("s") / F.col("n"))
    hit = (null >= F.col("seen") - 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.col("seen")) * 16).cast("long")
    counted = sums.join(seen, KEYS).groupBy(*KEYS, "n").agg(F.sum(hit).alias("k"), F.count("*").alias("m"))
    return counted.select(*KEYS, F.when(F.col("n") <= exact_max, F.col("k") / F.col("m")).otherwise((F.col("k") + 1) / (F.col("m") + 1)).alias("p_value"))


def _drawn(seed: int):
    """How often each resample of a block draws each artist, chunk by chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, block, runs in (x for f in frames for x in zip(f["n"], f["block"], f["runs"], strict=True)):
            r = range(block * BLOCK, min((block + 1) * BLOCK, runs))
            counts = np.stack([np.bincount(_digits(seed, x, 0, n, 8) % n, minlength=n) for x in r]).astype(np.int32)
            at = range(0, n, CHUNK)
            yield pd.DataFrame({"n": n, "block": block, "chunk": [a // CHUNK for a in at], "times": [counts[:, a : a + CHUNK].tobytes() for a in at]})

    return run


def _resampled(key: tuple, rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
    """Sums of the drawn differences of one chunk for one block of resamples."""
    if not len(rows) or not len(drawn):
        return pd.DataFrame({"metric": [], "p": [], "q": [], "n": [], "r": [], "s": []})
    d = np.stack(rows["d"].to_numpy()).astype(np.float64)
    times = np.frombuffer(drawn["times"].iat[0], dtype=np.int32).reshape(-1, d.shape[1])
    r = int(key[1]) * BLOCK + np.arange(len(times))
    return rows[[*KEYS, "n"]].loc[rows.index.repeat(len(r))].assign(r=np.tile(r, len(rows)), s=(d @ times.T).ravel())


def bootstrap_ci(differences: DataFrame, resamples: int = 2_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """metric, p, q, low, high: percentile interval of the mean over resamples drawn by md5
    digests; the draws of a resample are the same for all metrics and pairs of as many artists."""
    chunks = _chunked(differences)
    block = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // BLOCK)))
    plan = chunks.select("n").distinct().withColumn("block", block).withColumn("runs", F.lit(resamples)).repartition("n", "block")
    drawn = plan.mapInPandas(_drawn(seed), "n int, block int, chunk int, times binary")
    keys = ["n", "block", "chunk"]
    size = f"{', '.join(f'{k} {dict(differences.dtypes)[k]}' for k in KEYS)}, n int, r long, s double"
    sums = chunks.withColumn("block", block).groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInPandas(_resampled, size)
    means = sums.groupBy(*KEYS, "n", "r").agg((F.sum("s") / F.col("n")).alias("m"))
    tail = (1 - confidence) / 2
    return means.groupBy(*KEYS).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if math.isinf(f):
        return 0.0
    return _beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """P(chi2 > x): one minus the series of the regularised lower gamma, or its fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b = z + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        b += 2
        num = -i * (i - a)
        d = 1 / (num * d + b)
        c = b + num / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*x) for x in zip(f, df1, df2, strict=True)])


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(*v) for v in zip(x, df, strict=True)])


def omnibus(matrix: DataFrame) -> DataFrame:
    """ANOVA with and without Greenhouse-Geisser correction, and Friedman, per metric."""
    j = rm_anova(matrix).join(greenhouse_geisser(matrix), "metric").join(friedman(matrix).withColumnRenamed("df", "chi2_df"), "metric")
    j = j.withColumn("p_value", f_p_value("f_statistic", "df1", "df2")).withColumn("gg_p_value", f_p_value("f_statistic", F.col("epsilon") * F.col("df1"), F.col("epsilon") * F.col("df2")))
    return j.withColumn("friedman_p", chi2_p_value("chi2", "chi2_df"))


def scenario_statistics(values: DataFrame, scenarios: list[str], alpha: float = 0.05, resamples: int = 10_000, bootstraps: int = 2_000, exact_max: int = 16, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The two report tables: omnibus tests per metric; pairwise tests with Holm correction within
    the metric, intervals, and significance (omnibus and Holm p both under alpha)."""
    matrix = metric_matrix(values, scenarios)
    tests, d = omnibus(matrix), paired_differences(matrix)
    keys = ["metric", "p", "q"]
    pair = mean_differences(d).join(permutation_p(d, resamples, exact_max, seed), keys).join(bootstrap_ci(d, bootstraps, seed=seed), keys)
    pair = holm_adjust(pair, ["metric"], "p_value").join(tests.select("metric", "gg_p_value"), "metric")
    return tests, pair.withColumn("significant", (F.col("gg_p_value") < alpha) & (F.col("p_holm") < alpha))
