"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Each block of candidates has one list per dimension, sorted by component. A query reads all its
lists in parallel (from the top where its own component is positive, from the bottom where it is
negative), scores every new candidate in full, and stops once the sum of its components times
the last values read, which bounds every candidate not seen yet, is below its kth score.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import clean_vectors, nearest, paired_blocks, query_rows_of

STEP = 16
#: The largest number that 64 bits hold.
MOST = 2**63 - 1


def top_k(x: np.ndarray, ids: np.ndarray, order: np.ndarray, q: np.ndarray, own: int, k: int, floor=None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows of x (whole numbers) for q, without id own.
    order[:, d]: rows by descending component d. The lists are read in steps that double. With a
    floor, rows that score less are not wanted."""
    used = np.flatnonzero(q)
    if not len(used):
        rows = np.flatnonzero(ids != own)
        rows = rows[np.argsort(ids[rows], kind="stable")[:k]]
        return rows, np.zeros(len(rows), dtype=x.dtype)
    lists = np.where(q[used] > 0, order[:, used], order[::-1, used])
    seen, reached = ids == own, np.zeros(len(x), dtype=bool)
    rows, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=x.dtype)
    depth, step = 0, STEP
    while depth < len(x):
        reached[lists[depth : depth + step]] = True
        new = np.flatnonzero(reached & ~seen)
        seen[new] = True
        depth, step = depth + step, 2 * step
        found = x[new] @ q
        least = scores[-1] if len(rows) == k else floor
        if least is not None:
            good = found >= (least if floor is None else max(least, floor))
            new, found = new[good], found[good]
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
        best = np.lexsort((ids[rows], _ranks(-scores)))[:k]
        rows, scores = rows[best], scores[best]
        bound = (x[lists[min(depth, len(x)) - 1], used] * q[used]).sum()
        if (len(rows) == k and scores[-1] > bound) or (floor is not None and floor > bound):
            break
    return rows, scores


def _ranks(x: np.ndarray) -> np.ndarray:
    """What lexsort can sort: Python integers are replaced by their ranks."""
    return np.unique(x, return_inverse=True)[1] if x.dtype == object and len(x) else x.astype(np.float64) if x.dtype == object else x


def whole_numbers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles while all are finite (and so exact), else Python integers."""
    z = np.floor(x * scale)
    if np.isfinite(z).all():
        return z
    return np.array([[math.floor(Fraction(float(v)) * Fraction(scale)) for v in row] for row in x], dtype=object)


def _exact_type(x: np.ndarray, q: np.ndarray) -> type:
    """Doubles where every sum of products is below 2^53 and so exact, 64-bit integers below
    2^63, else Python integers."""
    if x.dtype == object or q.dtype == object:
        return object
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def _typed(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.array([[int(v) for v in row] for row in x], dtype=object)
    return x.astype(kind)


def _beyond(score: int) -> bytes | None:
    """For scores at or outside the ends of 64 bits: bytes in the order of the numbers."""
    if -MOST < score < MOST:
        return None
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + key if score > 0 else b"\x00" + bytes(255 - b for b in key)


COLUMNS = {"query_id": np.int64, "vec_id": np.int64, "score": np.int64, "beyond": object}


def _search(k: int, scale: float):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.empty(0, t) for c, t in COLUMNS.items()})]
        if len(rows) and len(queries):
            x, asked = (whole_numbers(np.stack(v.to_numpy()), scale) for v in (rows["embedding"], queries["query"]))
            ids, kind = rows["vec_id"].to_numpy(), _exact_type(x, asked)
            x, asked = _typed(x, kind), _typed(asked, kind)
            order = np.argsort(-x, axis=0, kind="stable")
            # A floor beyond 64 bits is not known exactly: such queries search without one.
            floors = [None if abs(int(f)) >= MOST else int(f) for f in queries["least"]]
            for own, q, floor in zip(queries["query_id"], asked, floors, strict=True):
                best, scores = top_k(x, ids, order, q, own, k, floor)
                exact = [int(s) for s in scores]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": np.array([min(max(s, -MOST), MOST) for s in exact], dtype=np.int64), "beyond": pd.Series([_beyond(s) for s in exact], dtype=object)}))
        return pd.concat(out)

    return run


def threshold_search(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, candidate_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """Exact k best rows by integer inner product, components turned into floor(scale * x).

    vectors: vec_id, embedding (further columns ignored); is_query: a column that selects the
    query rows. Returns query_id, rank (from 1), vec_id, score long. Candidates are all rows but
    those of the query's own vec_id. Vectors that are null, of another dimension than most, or
    hold null or non-finite components take no part; zero vectors do. Ties go to the smaller
    vec_id; rows that repeat a vec_id count each as candidates, and the least of their vectors asks.
    All candidates are returned where there are
    fewer than k. Scores are exact at any size of the components; one that 64 bits cannot hold is
    ranked exactly and shown as the nearest number they can hold (+-(2^63 - 1)).

    Each query first searches one block of candidates; its kth score there is the floor with
    which it searches the others.
    """
    good = stored(clean_vectors(vectors, drop_zero=False))
    queries = query_rows_of(good, is_query)
    blocks = max(1, -(-good.count() // candidate_rows))
    rows = good.withColumn("lists", F.least(F.pmod(F.xxhash64(F.lit(11), F.col("vec_id")), F.lit(blocks)), F.lit(1)))

    def searched(of: int, asked: DataFrame) -> DataFrame:
        pair = paired_blocks(rows.where(F.col("lists") == of), asked.withColumn("lists", F.lit(of).cast("long")), "lists", candidate_rows, query_rows)
        return pair[0].cogroup(pair[1]).applyInPandas(_search(k, scale), "query_id long, vec_id long, score long, beyond binary")

    first = stored(searched(0, queries.withColumn("least", F.lit(-MOST))))
    kth = nearest(first, k, "long", "beyond").where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = searched(1, queries.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-MOST))))
    return nearest(first.unionByName(rest), k, "long", "beyond")
