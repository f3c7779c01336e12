"""Approximate nearest neighbours by few stable projections and a kd-tree.

Vectors are scaled to length 1 (so the largest cosine is the smallest distance) and projected on
``PROJECTIONS`` Gaussian directions, which are 2-stable: a point at distance r lies at a squared
projected distance of r**2 times a chi-squared variable with that many degrees.  The projected points are
one kd-tree over the whole table: its upper part, the cells, is cut from a sample of at most about
``SAMPLE`` points (by a hash of the id) and every vector is routed to its cell; a cell's own points
are a tree again where they are searched.  A query takes the cells in the order of their projected
distance, a wave of some more cells at a time, and within a cell the leaves in that order; their
points are verified by exact cosine.  It stops as soon as the chance that a point nearer than its
k-th best of all cells so far lies beyond the next one falls below ``MISS``.

A search task is one block of vectors (a cell, or part of one that holds more than ``BLOCK_ROWS``) with
at most about ``QUERY_ROWS`` of the queries that come to it, so vectors are read once a wave unless
very many queries need them, and not at all where no query comes.  The cells' boxes (at most
``SAMPLE`` / ``CELL_SAMPLE``) go to the workers.  Every vector is indexed.  Of equal vectors only the k + 1 smallest ids
can be among anybody's k nearest, since ties go to the smaller id: the others are left out, so a vector
that a third of all rows hold is no hot cell.

Cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, as
candidates or queries.  Vectors are compared with those of their own length only.  Repeated ids
count once (the smallest vector stays); a null id takes no part.  Ties go to the smaller id.
Fewer than k candidates give fewer rows.  Empty tables give none.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import broadcast_if_small, forget, stored

PROJECTIONS = 8
MISS = 0.01
LEAF = 64
CELL_ROWS = 4_096  # vectors of a cell, while the sample allows as many cells
SAMPLE, CELL_SAMPLE = 1 << 16, 16
BLOCK_ROWS, QUERY_ROWS = 16_384, 2_048
FIRST_WAVE, WAVE_GROWTH = 2, 4  # cells of the first wave, and by how much the waves grow
MARGIN = 1e-9  # above the rounding of a product of unit vectors
SEED = 97


def chi2_quantile(p: float, dof: int) -> float:
    """The value a chi-squared variable stays below with probability ``p``, by bisection over the
    series of the lower incomplete gamma function."""
    import math

    def below(x: float) -> float:
        a, x = dof / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-15:
            n += 1
            term *= x / (a + n)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * dof + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def projection(dim: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, m))


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree by median splits of the widest axis: the order of the points leaf by leaf, the leaves'
    first places (and the end), and their boxes' lower and upper corners."""
    order, cuts = np.arange(len(points)), []
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            cuts.append(a)
            continue
        mine = order[a:b]
        part = points[mine]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        mid = (b - a) // 2
        order[a:b] = mine[np.argpartition(part[:, axis], mid)]
        todo += [(a + mid, b), (a, a + mid)]
    cuts = np.array(sorted(cuts))
    low = np.minimum.reduceat(points[order], cuts)
    high = np.maximum.reduceat(points[order], cuts)
    return order, np.append(cuts, len(points)), low, high


@dataclass
class Cells:
    """The upper part of the tree: for node i, ``axis[i]`` (-1: a cell), ``cut[i]`` and its children, or its cell."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, cells: int) -> Cells:
        leaf = max(1, -(-len(points) // max(1, cells)))
        axis, cut, child, todo, number = [], [], [], [(np.arange(len(points)), None)], 0
        while todo:
            mine, parent = todo.pop()
            at = len(axis)
            if parent is not None:
                child[parent[0]][parent[1]] = at
            part = points[mine]
            spread = part.max(axis=0) - part.min(axis=0) if len(mine) else np.zeros(1)
            if len(mine) <= leaf or spread.max() == 0:
                axis.append(-1), cut.append(0.0), child.append([number, number])
                number += 1
                continue
            a = int(np.argmax(spread))
            middle = float(np.median(part[:, a]))
            low = part[:, a] < middle
            if not low.any():  # the median is the least value
                middle = float(part[:, a][part[:, a] > middle].min())
                low = part[:, a] < middle
            axis.append(a), cut.append(middle), child.append([0, 0])
            todo += [(mine[~low], (at, 1)), (mine[low], (at, 0))]
        return cls(np.array(axis), np.array(cut), np.array(child))

    def route(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.child[node, 0]
            at = node[inner]
            node[inner] = self.child[at, (points[inner, self.axis[at]] >= self.cut[at]).astype(int)]


def scores_of(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines, the same for equal vectors wherever they stand."""
    return (vectors * q).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((q * q).sum()))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, m: int = PROJECTIONS, miss: float = MISS, bests=None):
    """``(query row, id, cosine)`` of up to ``k`` neighbours of every query in this block of vectors; ``bests``: each
    query's k-th best cosine so far (minus infinity: none)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    q_unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    proj = projection(vectors.shape[1], m)
    points, q_points = unit @ proj, q_unit @ proj
    order, first, low, high = build_tree(points)
    ids, unit, vectors = ids[order], unit[order], vectors[order]
    limit = chi2_quantile(1 - miss, m)
    bests = np.full(len(queries), -np.inf) if bests is None else bests
    for i, (qid, q, qu, qp, known) in enumerate(zip(query_ids, queries, q_unit, q_points, bests, strict=True)):
        gap = np.maximum(np.maximum(low - qp, qp - high), 0.0)
        near = (gap * gap).sum(axis=1)
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(near, kind="stable"):
            # the k-th best distance so far; beyond limit times it a nearer point is improbable
            kth = max(known, best[-1] if len(best) == k else -np.inf)
            if near[leaf] > limit * max(2 - 2 * kth, 0.0) + MARGIN:
                break
            a, b = first[leaf], first[leaf + 1]
            good = np.flatnonzero((unit[a:b] @ qu >= kth - MARGIN) & (ids[a:b] != qid)) + a
            if len(good):
                c_id, c = np.concatenate([best_id, ids[good]]), np.concatenate([best, scores_of(vectors[good], q)])
                top = np.lexsort((c_id, -c))[:k]
                best_id, best = c_id[top], c[top]
        yield i, best_id, best


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vec, dim)`` of the rows that take part, ids once."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v_")).where("id is not null and v_ is not null")
    odd = F.exists("v_", lambda x: x.isNull() | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = rows.where(~odd & F.exists("v_", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v_").alias("vec")).withColumn("dim", F.size("vec"))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def projected(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ projection(vectors.shape[1])


def _routed(cells: Cells):
    """Adds each vector's cell and its projected point."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = projected(_matrix(batch.column("vec")))
            at = pa.array(np.arange(len(points) + 1) * points.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(cells.route(points).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(points.reshape(-1)))],
                ["id", "vec", "cell", "point"])

    return run


def _next_cells(number: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, limit: float, k: int, wave: int):
    """The blocks that each query visits in the next wave."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = projected(_matrix(batch.column("vec")))
            out = ([], [], [])
            best = batch.column("best").to_pylist()
            for i, (p, seen) in enumerate(zip(points, batch.column("visited").to_pylist(), strict=True)):
                gap = np.maximum(np.maximum(low - p, p - high), 0.0)
                near = (gap * gap).sum(axis=1)
                order = np.argsort(near, kind="stable")[seen : seen + wave]
                kth = best[i][-1]["score"] if best[i] is not None and len(best[i]) == k else -np.inf
                for c in order[near[order] <= limit * max(2 - 2 * kth, 0.0) + MARGIN]:
                    for part in range(-(-int(size[c]) // BLOCK_ROWS)):
                        out[0].append(i)
                        out[1].append((int(number[c]) << 32) + part)
                        out[2].append(kth)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("vec").take(at), pa.array(out[2], pa.float64()), pa.array(out[1], pa.int64())], ["id", "vec", "kth", "block"])

    return run


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(queries) and len(vectors):
            q_ids = queries.column("id").to_numpy()
            for i, ids, scores in search_block(
                    vectors.column("id").to_numpy(), _matrix(vectors.column("vec")), q_ids, _matrix(queries.column("vec")), k, bests=queries.column("kth").to_numpy()):
                out[0].extend([int(q_ids[i])] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(scores.tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _same_length(index: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """``query_id, best`` (up to k structs of ``score`` and ``vec_id``) for vectors of one length."""
    spark = index.sparkSession
    every = max(1, n // SAMPLE)
    rows = index.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(every)) == 0).select("vec").mapInArrow(_points, "point array<double>")
    sample = np.array([r.point for r in rows.collect()]).reshape(-1, PROJECTIONS)  # about SAMPLE points
    cells = Cells.of(sample, min(-(-n // CELL_ROWS), SAMPLE // CELL_SAMPLE))
    routed = stored(spark, index.mapInArrow(_routed(cells), "id long, vec array<double>, cell int, point array<double>"), "routed")
    sides = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTIONS)]
    boxes = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).orderBy("cell").collect()  # a row a cell
    number, size = (np.array([r[c] for r in boxes]) for c in ("cell", "n"))
    low, high = (np.array([[r[f"{name}{i}"] for i in range(PROJECTIONS)] for r in boxes]) for name in ("low", "high"))
    parts = F.create_map(*[x for c, z in zip(number.tolist(), size.tolist(), strict=True) if z > BLOCK_ROWS for x in (F.lit(c), F.lit(-(-z // BLOCK_ROWS)))]) if (size > BLOCK_ROWS).any() else None
    part = F.pmod(F.xxhash64("id"), F.coalesce(parts[F.col("cell")], F.lit(1))) if parts is not None else F.lit(0)
    blocks = routed.select("id", "vec", (F.col("cell").cast("long") * (1 << 32) + part).alias("block"))
    limit = chi2_quantile(1 - MISS, PROJECTIONS)
    kind = "array<struct<score:double,vec_id:bigint>>"
    state = stored(spark, asked.select("id", "vec", F.lit(0).alias("visited"), F.lit(None).cast(kind).alias("best")), "search")
    wave = FIRST_WAVE
    while True:
        planned = stored(spark, state.mapInArrow(_next_cells(number, low, high, size, limit, k, wave), "id long, vec array<double>, kth double, block long"), "visits")
        if planned.isEmpty():
            forget(planned, routed)
            return state.select(F.col("id").alias("query_id"), "best")
        counts = planned.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
        counts = stored(spark, counts, "visits")
        few = broadcast_if_small(counts, counts.agg(F.count(F.lit(1)) * 64))
        q = planned.join(few, "block").select("id", "vec", "kth", "block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"))
        x = blocks.join(few, "block").select("id", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        new = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
        old = state.select(F.col("id").alias("query_id"), F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = old.unionByName(new).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("b"))  # k rows
        merged = state.drop("best").join(best.select(F.col("query_id").alias("id"), F.transform("b", lambda r: F.struct(r["score"].alias("score"), r["vec_id"].alias("vec_id"))).alias("best")), "id", "left")
        after = stored(spark, merged.select("id", "vec", (F.col("visited") + wave).alias("visited"), "best"), "search")
        forget(state, planned, counts)
        state, wave = after, wave * WAVE_GROWTH


def _points(batches):
    for batch in batches:
        if batch.num_rows:
            points = projected(_matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * points.shape[1], pa.int32()), pa.array(points.reshape(-1)))], ["point"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` found for each of ``queries`` (same columns), their own id aside:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    equal = Window.partitionBy("vec").orderBy("id")
    few = usable(vectors, key, vector).withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).drop("nth")
    index = stored(spark, few, "vectors")
    asked = stored(spark, usable(queries, key, vector), "queries")
    sizes = {r.dim: r.n for r in index.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each vector length
    asks = {r.dim for r in asked.select("dim").distinct().collect()}
    found = None
    for dim in sorted(set(sizes) & asks):
        one = _same_length(index.where(F.col("dim") == dim).select("id", "vec"), asked.where(F.col("dim") == dim).select("id", "vec"), sizes[dim], k)
        found = one if found is None else found.unionAll(one)
    forget(index, asked)
    if found is None:
        found = spark.createDataFrame([], "query_id long, best array<struct<score:double,vec_id:bigint>>")
    ranked = found.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")
