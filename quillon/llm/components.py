"""Distributed union-find: connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unstore


def connected_components(edges: DataFrame) -> DataFrame:
    """Map every vertex of edges (src, dst) to the smallest vertex reachable from it.

    Returns (id, root), one row per vertex that an edge names, isolated self-loops included.
    src and dst may be of any ordered type; rows with a null end are ignored. Alternates the
    large-star and small-star rewrites until the edge set is a set of stars. Each round is
    written to the shared folder, so the lineage stays short; a hub's rows are pre-aggregated
    to one minimum per task and its join is an inner join that AQE can split. The result is a
    table in that folder; what led to it is deleted.
    """
    both = stored(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    now = stored(both.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    while True:
        starred = stored(_small_star(_large_star(now)))
        state = _state(starred)
        unstore(now)
        now = starred
        if state == before:
            break
        before = state
    vertices = both.select(F.col("src").alias("id")).union(both.select(F.col("dst").alias("id"))).distinct()
    named = vertices.join(now.select(F.col("src").alias("id"), F.col("dst").alias("root")), "id", "left")
    out = stored(named.select("id", F.coalesce("root", "id").alias("root")))
    for df in (both, now):
        unstore(df)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is joined to the least of u's neighbourhood."""
    near = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return near.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src != dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour smaller than u, and u, is joined to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row: list[Column] = [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(src, dst))").alias("h")]
    return tuple(edges.agg(*row).first())
