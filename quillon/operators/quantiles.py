"""Exact quantiles by rank: equal values meet as counts, ranges of values are ranked side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.stored import stored


def exact_quantiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """fraction, value: the quantiles of a numeric column's values (double; null left out, NaN
    greatest), between two values by straight line, as percentile gives them. No values: null.

    Counts of distinct values are cut into ranges and stored; the values before each range are one
    sum per range. A task holds one range, and a value that many rows share is one row.
    """
    if not fractions or any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    spark = df.sparkSession
    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.sum("n").alias("size"))
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    wanted = spark.createDataFrame([(float(f),) for f in sorted(set(fractions))], "fraction double")
    # Ranks from 0, the one at or below and the next; each is in one range.
    at = F.col("fraction") * (F.col("total") - 1)
    total = sizes.agg(F.sum("size").alias("total"))
    ranks = wanted.join(F.broadcast(total)).select("fraction", (at - F.floor(at)).alias("part"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank")).distinct()
    last = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    spans = ranged.withColumn("last", last).join(F.broadcast(before), "range").select("v", (F.col("before") + F.col("last") - F.col("n")).alias("from"), (F.col("before") + F.col("last")).alias("to"))
    found = spans.join(F.broadcast(ranks), (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    value = F.when(low == high, low).otherwise(low + F.max("part") * (high - low))
    return wanted.join(found.groupBy("fraction").agg(value.alias("value")), "fraction", "left")
