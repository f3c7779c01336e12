"""Exact k-means on integer vectors with the Shallot search.

Every vector remembers its nearest and second-nearest centroid of the last search, an upper bound of
its distance to the first and a lower bound of that to all others.  When the centroids move, the
bounds give way by what they moved; a vector whose bounds still tell its centroid apart is not
looked at.  The others compute the distance to both remembered centroids and search from the closer
one: its fellow centroids, sorted by their distance to it, are tried in that order, and the search ends
where they lie beyond the vector's distance to the start plus its second-best distance so far, a
ball that shrinks with every better centroid found.  Survivors are compared by exact squared
distances in 64-bit integers, ties by the smaller number; bounds are integers rounded to the safe
side, so the result is that of comparing all.

The vectors with their bounds are a table in the shared folder, one version a round; a version is
deleted when the next one is written.  Only the centroids (k rows) pass through the driver.  Sums
of a cluster are added map-side, so a cluster that holds most vectors costs no more than others.

Cases: a vector is kept if it has ``WIDTH`` components, none null, NaN or infinite; others give no row.
A component x becomes floor(``SCALE`` x); one whose integer is not below ``LIMIT`` in size raises an error,
since squared distances would leave 64 bits.  Ties go to the smaller centroid number.  Repeated
ids and rows are vectors of their own (first centroids of equal hash: by components); a null
id has the empty string in its hash.  Fewer vectors than centroids: as many centroids as vectors.  An
empty cluster keeps its centroid.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import discard, store

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT = 1 << 28
SLICE = 8192  # vectors searched at once
FAR = 1 << 40  # above any bound
STATE = "vec_id long, v array<int>, near int, second int, upper long, lower long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v``: the kept vectors as integers."""
    e = F.col("embedding")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where((F.size(e) == WIDTH) & usable).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    large = F.raise_error(F.concat(F.lit("a component is too large in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    fits = F.forall(e, lambda x: F.abs(x.cast("double")) * SCALE < LIMIT)
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return kept.select("vec_id", F.when(fits, whole).otherwise(large.cast("array<int>")).alias("v"))


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", key.alias("hash")).orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), WIDTH)


def _ceil_root(d: np.ndarray) -> np.ndarray:
    """Integers not below the square roots of ``d``, at most one above."""
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d  # the float root is off by one at most
    return r + (r * r < d)


@dataclass
class Centres:
    """Centroids with what a search needs of them: for each, the others by distance, those
    distances rounded down, and how far the centroids moved last, rounded up."""

    at: np.ndarray
    order: np.ndarray
    gap: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centres:
        k = len(at)
        square = ((at[:, None, :] - at[None, :, :]) ** 2).sum(2)
        order = np.array([[j for j in np.lexsort((np.arange(k), square[i])) if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
        gap = np.array([[isqrt(int(square[i, j])) for j in order[i]] for i in range(k)], np.int64).reshape(k, k - 1)
        moved = np.zeros(k, np.int64) if before is None else _ceil_root(((at - before) ** 2).sum(1))
        return cls(at, order, gap, moved)


def _square(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    diff = v - at
    return np.einsum("ij,ij->i", diff, diff)


def search(v: np.ndarray, near: np.ndarray, second: np.ndarray, c: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of every row and their squared distances, from the
    remembered two.  With one centroid there is no second (-1)."""
    best, best_d = near.copy(), _square(v, c.at[near])
    if len(c.at) == 1:
        return best, np.full(len(v), -1), best_d, np.full(len(v), FAR * FAR // 4)
    other, other_d = second.copy(), _square(v, c.at[second])

    def settle(rows):
        swap = (other_d[rows] < best_d[rows]) | ((other_d[rows] == best_d[rows]) & (other[rows] < best[rows]))
        at = rows[swap]
        best[at], other[at] = other[at], best[at].copy()
        best_d[at], other_d[at] = other_d[at], best_d[at].copy()

    settle(np.arange(len(v)))
    start, left_out, radius = best.copy(), other.copy(), _ceil_root(best_d)
    for s in np.unique(start):
        rows = np.flatnonzero(start == s)
        for j, gap in zip(c.order[s], c.gap[s], strict=True):
            rows = rows[gap <= radius[rows] + _ceil_root(other_d[rows])]  # the ball has shrunk since the last one
            if not len(rows):
                break
            tried = rows[left_out[rows] != j]
            d = _square(v[tried], c.at[j])
            better = (d < other_d[tried]) | ((d == other_d[tried]) & (j < other[tried]))
            at = tried[better]
            other[at], other_d[at] = j, d[better]
            settle(at)
    return best, other, best_d, other_d


def step(v: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centres) -> tuple:
    """The next state of vectors whose bounds held for the centroids before they moved."""
    if len(c.at) > 1:
        most = int(c.moved.argmax())
        others = np.where(near == most, np.delete(c.moved, most).max(), c.moved[most])
        alone = c.gap[:, 0][near]
    else:
        others, alone = np.zeros(len(v), np.int64), np.full(len(v), 2 * FAR)
    near, second, upper, lower = near.copy(), second.copy(), np.minimum(upper + c.moved[near], FAR), lower - others
    open_ = np.flatnonzero((upper >= lower) & (2 * upper >= alone))
    upper[open_] = _ceil_root(_square(v[open_], c.at[near[open_]]))
    open_ = open_[(upper[open_] >= lower[open_]) & (2 * upper[open_] >= alone[open_])]
    if len(open_):
        near[open_], second[open_], d, d2 = search(v[open_], near[open_], second[open_], c)
        upper[open_] = _ceil_root(d)
        root = _ceil_root(d2)
        lower[open_] = root - (root * root > d2)
    return near, second, upper, lower


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assign(state: DataFrame, c: Centres) -> DataFrame:
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                old = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("near", "second", "upper", "lower")]
                near, second, upper, lower = step(_matrix(batch.column("v")), *old, c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(second, pa.int32()),
                     pa.array(upper, pa.int64()), pa.array(lower, pa.int64())], ["vec_id", "v", "near", "second", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids' exact componentwise floored means; empty ones stay."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(at.shape[1])]
    out = at.copy()
    for row in state.groupBy("near").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows
        out[row.near] = [row[f"s{i}"] // row.n for i in range(at.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``rounds`` rounds of k-means on the ``(vec_id, embedding)`` rows, then one more assignment:
    ``vec_id, v, near, second, upper, lower`` (the bounds of the last search), and the centroids."""
    spark = vectors.sparkSession
    kept = quantised(vectors)
    at = first_centroids(kept, k)
    # as if every vector had been between the first two centroids, with bounds that tell nothing
    state = kept.select("vec_id", "v", F.lit(0).alias("near"), F.lit(min(1, len(at) - 1)).alias("second"),
                        F.lit(FAR).cast("long").alias("upper"), F.lit(0).cast("long").alias("lower"))
    if not len(at):
        return spark.createDataFrame([], STATE), at
    path = None
    before = None
    for r in range(rounds + 1):
        written = store(spark, _assign(state, Centres.of(at, before)), "bounded-vectors")
        if path:
            discard(spark, path)
        path = written
        state = spark.read.schema(STATE).parquet(path)
        if r < rounds:
            before, at = at, _moved(state, at)
    return state, at


def clusters(spark: SparkSession, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance`` (squared, to its centroid), ``cluster_inertia, inertia``
    (distances summed over the cluster and over all) and ``centroid_sha256``."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    state, at = cluster(vectors, k, rounds)
    if not len(at):
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            near = batch.column("near")
            d = _square(_matrix(batch.column("v")), at[near.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), near, pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    found = state.select("vec_id", "v", "near").mapInArrow(run, "vec_id long, cluster int, distance long")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in at.tolist()]
    # at most k rows, so the broadcast is bounded
    side = spark.createDataFrame([(c, d, sum(sums.values()), shas[c]) for c, d in sums.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
