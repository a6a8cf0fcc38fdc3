"""What the two vector searches share: clean vectors and pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_vectors(vectors: DataFrame, drop_zero: bool) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part: id and vector not null,
    every component finite, of the dimension that most rows have (ties: the smaller), and, with
    drop_zero, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    if drop_zero:
        good = good.where(F.exists("embedding", lambda x: x != 0.0))
    common = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("embedding") == F.lit(common["d"])) if common else good


def query_rows_of(good: DataFrame, is_query) -> DataFrame:
    """query_id and query of the rows that is_query selects; of rows that repeat a vec_id the one
    of the least vector."""
    return good.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))


def paired_blocks(candidates: DataFrame, queries: DataFrame, key: str, candidate_rows: int, query_rows: int):
    """Group candidates (key, vec_id, ...) and queries (key, query_id, ...) for cogrouping: within
    each key, hashed blocks of about candidate_rows meet hashed blocks of about query_rows, so
    that no group grows with the key. There must be few keys (their sizes are broadcast)."""
    counts = candidates.groupBy(key).agg(F.count("*").alias("c")).join(queries.groupBy(key).agg(F.count("*").alias("q")), key)
    sizes = F.broadcast(counts.select(key, F.ceil(F.col("c") / candidate_rows).cast("long").alias("nb"), F.ceil(F.col("q") / query_rows).cast("long").alias("nq")))
    left = candidates.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("nb"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    right = queries.join(sizes, key).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    right = right.drop("nb", "nq").toDF(*(f"{c}_q" if c in (key, "b", "qb") else c for c in right.columns if c not in ("nb", "nq")))
    return left.drop("nb", "nq").groupBy(key, "b", "qb"), right.groupBy(f"{key}_q", "b_q", "qb_q")


def nearest(found: DataFrame, k: int, score_type: str, *beyond: str) -> DataFrame:
    """The k best rows per query, ties to the smaller vec_id (after further columns, if named)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *map(F.desc, beyond), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(score_type).alias("score"))
