"""Batches of inputs under a token budget: as many rows as fit when all are padded to the longest.

Rows are put in one order by length (range shuffle, ties by key) and packed greedily from the shortest:
a batch is closed when one more row would bring rows x longest row above the budget.  Where each
batch begins follows from the histogram of the lengths alone (one row a length, at most ``MAX_LENGTHS``),
so the packing itself is arithmetic: a row's number among those of its length gives its batch.  That number
is its place in its range plus the rows of its length in the ranges before (one row for each
range and length).  No window spans all rows, and a length that a third of all rows have is dealt over many ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .jobs import _cached_model, _new_key, _score_lists

MAX_LENGTHS = 1 << 20


def packing_plan(histogram: Sequence[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, fill, first, next, cap)`` for lengths in ascending order: the first ``fill`` rows of a length go to
    the open batch ``first``, the others, ``cap`` at a time, to the batches from ``next`` on.  A row longer than the
    budget is a batch of its own; an empty row counts as one token."""
    plan, held, batch = [], 0, 0
    for length, n in histogram:
        cap = max(1, budget // max(length, 1))
        fill = min(n, max(0, cap - held)) if held else 0
        rest, following = n - fill, batch + (1 if held else 0)
        plan.append((length, fill, batch, following, cap))
        if rest:
            batch, held = following + (rest - 1) // cap, (rest - 1) % cap + 1
        else:
            held += fill
    return plan


def token_batches(df: DataFrame, budget: int, length_col: str = "n_tokens", key_col: str = "example_id") -> DataFrame:
    """``df``, stored in order of length and key, with ``batch`` (from 0).  Null lengths raise."""
    if budget < 1:
        raise ValueError("the budget must be positive")
    spark = df.sparkSession
    path = scratch_path(spark, "by-length")
    length = F.col(length_col).cast("int")
    checked = df.withColumn("__length", F.when(length.isNull() | (length < 0), F.raise_error("a row has no length").cast("int")).otherwise(length))
    order = [F.col("__length"), F.col(key_col)]
    dealt = checked.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__place"))
    dealt.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    per = rows.groupBy("__range", "__length").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("begin")).orderBy("__length", "__range").collect()
    sums: dict[int, int] = {}
    parts = []
    for part, length, n, begin in per:
        parts.append((part, length, sums.get(length, 0) - begin))
        sums[length] = sums.get(length, 0) + n
    if len(sums) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} different lengths")
    plan = {p[0]: p[1:] for p in packing_plan(sorted(sums.items()), budget)}
    # one row for each range and length it holds
    side = spark.createDataFrame([(r, length, shift, *plan[length]) for r, length, shift in parts],
                                 "__range int, __length int, __shift long, __fill long, __first long, __next long, __cap long")
    placed = rows.join(F.broadcast(side), ["__range", "__length"])
    nth = F.col("__place") + F.col("__shift")
    batch = F.when(nth < F.col("__fill"), F.col("__first")).otherwise(F.col("__next") + F.floor((nth - F.col("__fill")) / F.col("__cap")))
    return placed.select(*[F.col(c) for c in df.columns], batch.cast("long").alias("batch"))


def padding_report(batches: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row: ``n_rows, n_batches, n_tokens, n_padded`` (tokens with padding to each batch's longest row) and
    ``padding_share``."""
    per = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(length_col).alias("tokens"), F.max(length_col).alias("longest"))
    padded = F.sum(F.col("n") * F.col("longest"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"), F.sum("tokens").alias("n_tokens"), padded.alias("n_padded"),
                   F.try_divide(padded - F.sum("tokens"), padded).alias("padding_share"))


def score_token_batches(
    batches: DataFrame,
    score_fn: Callable[[Any, pd.DataFrame], Sequence[Sequence[float]] | np.ndarray],
    feature_cols: Sequence[str],
    load_fn: Callable[[], Any] | None = None,
    model_id: str = "model",
    key_cols: Sequence[str] = ("example_id", "batch"),
) -> DataFrame:
    """:func:`relspark.operators.jobs.score_batches` with the batches of :func:`token_batches`: the model sees the rows
    of one batch at a time (of those that a task cuts, its parts).  Rows stand in batch order in the stored table, so nothing is shuffled."""
    keys, feats, cache_key = list(key_cols), list(feature_cols), _new_key()
    schema = T.StructType([batches.schema[k] for k in keys] + [T.StructField("model_id", T.StringType(), False), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(incoming):
        import pyarrow as pa

        model = _cached_model(cache_key, load_fn)

        def scored(table):
            out = score_fn(model, table.select(feats).to_pandas())
            if len(out) != table.num_rows:
                raise ValueError(f"score_fn returned {len(out)} rows for {table.num_rows}")
            cols = [table.column(k).combine_chunks() for k in keys]
            cols += [pa.array(np.full(len(out), model_id, dtype=object), type=pa.string()), _score_lists([out])]
            return pa.RecordBatch.from_arrays(cols, schema.names)

        held = None
        for rb in incoming:
            if not rb.num_rows:
                continue
            table = pa.Table.from_batches([rb]) if held is None else pa.concat_tables([held, pa.Table.from_batches([rb])])
            number = table.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield scored(table.slice(a, b - a))
            held = table.slice(cuts[-1])
        if held is not None:
            yield scored(held)

    return batches.select(*dict.fromkeys([*keys, "batch", *feats])).mapInArrow(run, schema)
