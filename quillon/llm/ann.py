"""Maximum inner product search with score-aware quantisation.

Vectors are assigned to coarse cells; the residual is product-quantised with 16 codewords per
pair of dimensions (four bits). Codewords and codes minimise an anisotropic loss, in which the
error parallel to the vector weighs more than the rest, since that is what changes large inner
products. A query scans the codes of its best cells by table look-up; the best of these, and all
that the tables' errors leave in doubt, are scored again with the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_fraction, matching, stored, unstore
from .vectors import clean_vectors, nearest, paired_blocks, query_rows_of

WIDTH = 2
CODES = 16


@dataclass(frozen=True)
class Quantizer:
    """centroids (cells, d); codebooks (subspaces, 16, WIDTH); probes: cells to scan per query."""

    centroids: np.ndarray
    codebooks: np.ndarray
    parallel: float
    probes: int


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))


def _cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = _cells(x, centroids)
        n = np.bincount(cell, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, x)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def _encode(x: np.ndarray, residual: np.ndarray, codebooks: np.ndarray, parallel: float, rounds: int) -> np.ndarray:
    """Codes by coordinate descent on |e|^2 + (parallel - 1) (e.x/|x|)^2, e the error."""
    m = len(codebooks)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), m, WIDTH)
    part = residual.reshape(len(x), m, WIDTH)
    codes = np.stack([np.argmin(((part[:, j, None] - codebooks[j]) ** 2).sum(axis=2), axis=1) for j in range(m)], axis=1)
    along = ((part - codebooks[np.arange(m), codes]) * unit).sum(axis=2)
    for _ in range(rounds):
        for j in range(m):
            error = part[:, j, None] - codebooks[j]
            mine = (error * unit[:, j, None]).sum(axis=2)
            rest = along.sum(axis=1) - along[:, j]
            codes[:, j] = np.argmin((error * error).sum(axis=2) + (parallel - 1.0) * (rest[:, None] + mine) ** 2, axis=1)
            along[:, j] = mine[np.arange(len(x)), codes[:, j]]
    return codes


def _update(x: np.ndarray, residual: np.ndarray, codes: np.ndarray, codebooks: np.ndarray, parallel: float) -> np.ndarray:
    """Codewords that minimise the loss for given codes, one subspace after the other."""
    m, new = len(codebooks), codebooks.copy()
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), m, WIDTH)
    part = residual.reshape(len(x), m, WIDTH)
    for j in range(m):
        along = ((part - new[np.arange(m), codes]) * unit).sum(axis=2)
        rest = along.sum(axis=1) - along[:, j]
        u = unit[:, j]
        for c in range(CODES):
            own = codes[:, j] == c
            if own.any():
                a = own.sum() * np.eye(WIDTH) + (parallel - 1.0) * u[own].T @ u[own]
                target = part[own, j] + (parallel - 1.0) * u[own] * (rest[own] + (part[own, j] * u[own]).sum(axis=1))[:, None]
                new[j, c] = np.linalg.solve(a, target.sum(axis=0))
    return new


def train_quantizer(sample: np.ndarray, cells: int, threshold: float = 0.2, coverage: float = 0.98, k: int = 20, rounds: int = 6, seed: int = 3) -> Quantizer:
    """Fit on sample rows. `threshold` is the cosine from which inner products matter: it sets
    the weight of the parallel error. The number of cells to probe is the least that covers
    `coverage` of the sample's true neighbours of 300 of its rows."""
    rng = np.random.default_rng(seed)
    x = _padded(sample)
    d = x.shape[1]
    parallel = max(1.0, (d - 1) * threshold**2 / (1.0 - threshold**2))
    centroids = _k_means(x, min(cells, len(x)), rounds, rng)
    cell = _cells(x, centroids)
    residual = x - centroids[cell]
    part = residual.reshape(len(x), -1, WIDTH)
    picked = rng.choice(len(x), CODES, replace=len(x) < CODES)
    codebooks = np.stack([part[picked, j] for j in range(part.shape[1])])
    for _ in range(rounds):
        codebooks = _update(x, residual, _encode(x, residual, codebooks, parallel, 1), codebooks, parallel)
    q = rng.choice(len(x), min(300, len(x)), replace=False)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[q] @ centroids.T), axis=1), axis=1)
    if not near.size:
        return Quantizer(centroids, codebooks, parallel, len(centroids))
    needed = np.sort(place[np.arange(len(q))[:, None], cell[near]].ravel())
    return Quantizer(centroids, codebooks, parallel, int(needed[min(len(needed) - 1, int(coverage * len(needed)))]) + 1)


def _index(quantizer: Quantizer):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _padded(np.stack(frame["embedding"].to_numpy()))
            cell = _cells(x, quantizer.centroids)
            codes = _encode(x, x - quantizer.centroids[cell], quantizer.codebooks, quantizer.parallel, 2).astype(np.uint8)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, ::2] | (codes[:, 1::2] << 4)
            yield frame.assign(cell=cell.astype(np.int32), codes=[c.tobytes() for c in packed])

    return run


def _probe(quantizer: Quantizer, held: np.ndarray, least: int):
    """Cells of each query: its best ones, `probes` of them and on until they hold `least` ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _padded(np.stack(frame["query"].to_numpy()))
            best = np.argsort(-(x @ quantizer.centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(held[best], axis=1) < least).sum(axis=1) + 1
            n = np.minimum(np.maximum(quantizer.probes, enough), best.shape[1])
            cells = np.concatenate([own[:m] for own, m in zip(best, n, strict=True)]).astype(np.int32)
            yield pd.DataFrame({"query_id": np.repeat(frame["query_id"].to_numpy(), n), "query": frame["query"].repeat(n).to_numpy(), "cell": cells})

    return run


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the columns i of x with the columns j of y, added up in order of the
    components: equal vectors get equal scores in every block."""
    total = np.zeros(len(i))
    for a, b in zip(x, y, strict=True):
        total += a[i] * b[j]
    return total


def _scan(quantizer: Quantizer, again: int, k: int):
    """The k best of one block of a cell for each query of a block. Its codes are scanned; the
    best `again` by table score are scored with the original vectors, and so is every other row
    whose table score comes so near to the k-th of these that its error may hide a better one.
    The error of a query's table scores has a mean square over the block that is a quadratic form
    of the query; three times its root (by a row's own error more), at most the product of the
    norms, is allowed for."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if not len(rows) or not len(queries):
            return out[0]
        ids, cell = rows["vec_id"].to_numpy(), rows["cell"].iat[0]
        packed = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(rows), -1)[:, : len(quantizer.codebooks)]
        x = _padded(np.stack(rows["embedding"].to_numpy()))
        error = x - quantizer.centroids[cell] - quantizer.codebooks[np.arange(codes.shape[1]), codes].reshape(len(rows), -1)
        spread, length = error.T @ error / len(rows), np.linalg.norm(error, axis=1)
        # Table scores are single precision.
        more = np.maximum(1.0, length / max(np.sqrt((length * length).mean()), 1e-300))
        rounding = 1e-5 * np.linalg.norm(x, axis=1).max()
        best = min(again, len(rows))
        for lot in np.array_split(np.arange(len(queries)), max(1, len(queries) * len(rows) // 500_000)):
            wide = _padded(np.stack(queries["query"].to_numpy()[lot]))
            tables = np.einsum("qmw,mcw->mqc", wide.reshape(len(lot), -1, WIDTH), quantizer.codebooks).astype(np.float32)
            near = np.repeat((wide @ quantizer.centroids[cell]).astype(np.float32)[:, None], len(rows), axis=1)
            for j, table in enumerate(tables):
                near += table[:, codes[:, j]]
            asked = queries["query_id"].to_numpy()[lot]
            near[asked[:, None] == ids] = -np.inf
            first = np.argpartition(near, len(ids) - best, axis=1)[:, len(ids) - best :]
            q = np.repeat(np.arange(len(lot)), best)
            scores = np.where(np.isneginf(near[q, first.ravel()]), -np.inf, _products(wide.T, x.T, q, first.ravel())).reshape(len(lot), best)
            last = np.partition(scores, best - k, axis=1)[:, best - k] if best >= k else np.full(len(lot), -np.inf)
            norm = np.linalg.norm(wide, axis=1)
            doubt = 3.0 * np.sqrt(np.maximum(((wide @ spread) * wide).sum(axis=1), 0.0))
            allowed = np.minimum(doubt[:, None] * more, norm[:, None] * length) + (rounding * norm)[:, None]
            open_ = (near + allowed >= last[:, None]) & ~np.isneginf(near)
            open_[np.arange(len(lot))[:, None], first] = False
            q2, r2 = np.nonzero(open_)
            q1, r1, s1 = q, first.ravel(), scores.ravel()
            taken = s1 > -np.inf
            qs, rs = np.concatenate([q1[taken], q2]), np.concatenate([r1[taken], r2])
            found = np.concatenate([s1[taken], _products(wide.T, x.T, q2, r2)])
            order = np.lexsort((ids[rs], -found, qs))
            qs, rs, found = qs[order], rs[order], found[order]
            keep = np.arange(len(qs)) - np.searchsorted(qs, qs) < k
            out.append(pd.DataFrame({"query_id": asked[qs[keep]], "vec_id": ids[rs[keep]], "score": found[keep]}))
        return pd.concat(out)

    return run


def _covering(quantizer: Quantizer, index: DataFrame, queries: DataFrame, k: int, coverage: float, tried: int) -> Quantizer:
    """The quantiser with as many cells to probe as hold `coverage` of the true neighbours, among
    all rows of the index, of `tried` queries: a hash sample of those that are asked."""
    some = queries.orderBy(F.xxhash64(F.lit("ann"), "query_id"), "query_id").limit(tried).collect()
    ids, wide = np.array([r["query_id"] for r in some]), np.array([r["query"] for r in some])

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, cell = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int32)
        for frame in frames:
            for part in np.array_split(np.arange(len(frame)), max(1, len(frame) // 2000)):
                if len(part):
                    rows = frame.iloc[part]
                    own = wide @ np.stack(rows["embedding"].to_numpy()).T
                    own[ids[:, None] == rows["vec_id"].to_numpy()] = -np.inf
                    score, cell = np.hstack([score, own]), np.hstack([cell, np.broadcast_to(rows["cell"].to_numpy(), own.shape)])
                    if score.shape[1] > k:
                        top = np.argpartition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k :]
                        score, cell = np.take_along_axis(score, top, axis=1), np.take_along_axis(cell, top, axis=1)
        flat = score.ravel()
        yield pd.DataFrame({"query_id": np.repeat(ids, score.shape[1]), "cell": cell.ravel(), "score": flat})[flat > -np.inf]

    found = index.select("vec_id", "embedding", "cell").mapInPandas(best, "query_id long, cell int, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "cell").toPandas()
    if not len(true):
        return quantizer
    place = np.argsort(np.argsort(-(_padded(wide) @ quantizer.centroids.T), axis=1, kind="stable"), axis=1)
    at = {q: i for i, q in enumerate(ids)}
    needed = np.sort(place[true["query_id"].map(at).to_numpy(), true["cell"].to_numpy()])
    return replace(quantizer, probes=int(needed[min(len(needed) - 1, int(coverage * len(needed)))]) + 1)


def _fitted(good: DataFrame, total: int, max_sample: int, cells: int) -> Quantizer:
    """The quantiser, fitted in one task on a bounded sample of whole rows."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for frame in frames for x in frame["embedding"]]
        q = train_quantizer(np.array(rows, dtype=np.float64), cells)
        yield pd.DataFrame({"centroids": [q.centroids.tobytes()], "codebooks": [q.codebooks.tobytes()], "parallel": [q.parallel], "probes": [q.probes]})

    # Rows that repeat an id come in or stay out together, so the sample is also limited.
    sample = hash_fraction(good, "vec_id", max_sample / total, "ann").select("embedding").limit(2 * max_sample)
    sample = sample if sample.head(1) else good.select("embedding").limit(1)
    row = sample.repartition(1).mapInPandas(fit, "centroids binary, codebooks binary, parallel double, probes int").first()
    width = -(-len(good.first()["embedding"]) // WIDTH) * WIDTH
    return Quantizer(np.frombuffer(row["centroids"]).reshape(-1, width), np.frombuffer(row["codebooks"]).reshape(width // WIDTH, CODES, WIDTH), row["parallel"], row["probes"])


def _without_copies(good: DataFrame, k: int) -> DataFrame:
    """The rows of good (vec_id, embedding) but those of vectors that k smaller ids have, too.
    Hashes and ids are shuffled; vectors only where more than a broadcast's bytes of hashes stand
    for more than k rows each."""
    alike = ["h1", "h2"]
    hashed = good.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), F.col("embedding"))})
    narrow = hashed.select("vec_id", *alike)
    many = stored(narrow.groupBy(*alike).agg(F.count("*").alias("n")).where(F.col("n") > k).drop("n"))
    place = F.dense_rank().over(Window.partitionBy(*alike).orderBy("vec_id"))
    least = stored(matching(narrow, many, alike).withColumn("place", place).where(F.col("place") <= k).select("vec_id", *alike).distinct())
    few = matching(hashed, many, alike, "left_anti")
    return few.unionByName(matching(hashed, least, ["vec_id", *alike], "left_semi")).select("vec_id", "embedding")


def inner_product_search(vectors: DataFrame, is_query, k: int = 20, again: int = 200, max_sample: int = 20_000, cells: int | None = None) -> DataFrame:
    """The k rows of largest inner product for every row that is_query (a column) selects.

    vectors: vec_id, embedding (further columns ignored). Returns query_id, rank (from 1),
    vec_id, score (double precision, original vectors). Candidates are all rows but those of the
    query's own vec_id; vectors that are null, zero, of another dimension than most, or hold null
    or non-finite components take no part. Ties go to the smaller vec_id; rows that repeat a
    vec_id count each as candidates, and the least of their vectors asks. All candidates are
    returned where there are fewer than k. The quantiser is fitted on a hash sample of about
    max_sample rows (never over twice as many); every row is indexed. There are 64 cells up to
    four million rows, then sqrt(rows)/32, at most 4096.

    So many cells are probed as hold 99 % of the true neighbours of 256 of the queries, which are
    compared with all rows for that. Of equal vectors those of the k + 1 least ids are scanned,
    which no other copy can beat. In each block of a cell the best `again` by table score are
    scored with the original vectors, and all rows that the tables' errors leave in doubt.
    """
    again = max(again, 2 * k)
    good = stored(clean_vectors(vectors, drop_zero=True))
    total = good.count()
    if not total:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    quantizer = _fitted(good, total, max_sample, cells or int(min(4096, max(1, min(64, total // 100), total**0.5 / 32))))
    index = stored(_without_copies(good, k + 1).mapInPandas(_index(quantizer), "vec_id long, embedding array<double>, cell int, codes binary"))
    held = np.zeros(len(quantizer.centroids), dtype=np.int64)
    for row in index.groupBy("cell").agg(F.countDistinct("vec_id").alias("n")).collect():
        held[row["cell"]] = row["n"]
    queries = stored(query_rows_of(good, is_query))
    unstore(good)
    quantizer = _covering(quantizer, index, queries, k, 0.99, 256)
    probes = queries.mapInPandas(_probe(quantizer, held, again + 1), "query_id long, query array<double>, cell int")
    rows, asked = paired_blocks(index, probes, "cell", 4096, 4096)
    scanned = rows.cogroup(asked).applyInPandas(_scan(quantizer, again, k), "query_id long, vec_id long, score double")
    return nearest(scanned, k, "double")
