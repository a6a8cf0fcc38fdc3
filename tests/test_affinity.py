"""Genre affinity in blocks of entities: the same rows as the join by genre, spread over tasks."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics as m


def joined(weights):
    right = weights.select("genre", F.col("entity").alias("right"), F.col("weight").alias("w"))
    return weights.join(right, "genre").groupBy(F.col("entity").alias("left"), "right").agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))


def rows(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "double"])
def test_blocks_give_the_joins_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(m, "AFFINITY_BLOCK", 7)
    monkeypatch.setattr(m, "AFFINITY_GENRES", 2)
    data = [(f"e{e}", f"g{g}", float((e * 7 + g * 3) % 5)) for e in range(40) for g in range(6) if (e + g) % 4 != 0 or e == 3]
    data += [("e1", "g1", 2.0), ("alone", "only", 1.0), ("zero", "g2", 0.0), ("zero", "only", 0.0), (f"e{2}", None, 3.0)]
    weights = spark.createDataFrame(data, "entity string, genre string, weight double").withColumn("weight", F.col("weight").cast(kind))
    found = m.genre_affinity(weights)
    assert dict(found.dtypes) == dict(joined(weights).dtypes)
    assert rows(found) == rows(joined(weights))
    assert rows(m.affinity_weights(weights)) == rows(m.peer_weights(joined(weights), 1.0, "affinity"))


def test_pairs_are_dealt_out_and_not_shuffled(spark, monkeypatch):
    """2,250,000 joined rows of 300 entities met in one task, which then shuffled them all."""
    monkeypatch.setattr(m, "AFFINITY_BLOCK", 50)
    weights = spark.range(300 * 5).select((F.col("id") % 300).alias("entity"), (F.col("id") / 300).cast("int").alias("genre"), (F.col("id") % 11 + 1).alias("weight"))
    found = m.affinity_weights(weights)
    assert found.rdd.getNumPartitions() >= 36
    assert found.count() == 300 * 299


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_odd_weights_and_rare_genres_are_joined(spark, odd):
    few = spark.createDataFrame([(e, f"g{e // 2}", 1.0) for e in range(100)], "entity long, genre string, weight double")
    assert m._affinity_blocks(few) == 0 and rows(m.genre_affinity(few)) == rows(joined(few))
    most = spark.createDataFrame([(e, "g", odd if e == 5 else 1.0) for e in range(9)], "entity long, genre string, weight double")
    assert m._affinity_blocks(most) == 0
