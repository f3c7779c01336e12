"""Accuracy of the thresholded decoder at every threshold that matters.

The decoder (``decode.threshold_decode``) keeps the best class where its probability reaches the threshold
and says "no relation" (0) elsewhere.  Between two scores that occur nothing changes, so the
accuracy is wanted at every distinct best score.  Examples are reduced to one row per distinct score
(ties together, map-side), those rows are put in one global order by a range shuffle and stored with
the number of their range; each range is added up by itself, and what the ranges before it hold is one
number each (a row a range), so no window spans all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import argmax, as_double_array, sigmoid
from ..plans.joins import require
from ..schemas import BLIND_LABEL
from ..session import scratch_path
from .metrics import align_models

_COUNTS = ("n", "hits", "none")


def _range_totals(ranged: DataFrame) -> tuple[list[tuple], dict[str, tuple]]:
    """Per range and model what the ranges before it hold, and each model's totals, from one row per (range, model)."""
    totals = ranged.groupBy("range", "model_id").agg(*[F.sum(c) for c in _COUNTS]).orderBy("range").collect()
    before, so_far = [], {}
    for part, model, *counts in totals:
        held = so_far.get(model, (0, 0, 0))
        before.append((part, model, *held))
        so_far[model] = tuple(a + b for a, b in zip(held, counts, strict=True))
    return before, so_far


def threshold_sweep(scores: DataFrame, answers: DataFrame, models: Sequence[str], scores_col: str = "scores") -> DataFrame:
    """``(model_id, threshold, n, accuracy)``: for every model and every distinct best score, as the
    probability that it stands for, how many examples have it and the accuracy with it as threshold.

    Scores are of the relations 1 to K (as for ``threshold_decode``); answers are 0 to K.  Every
    model and answer must be there exactly once per example; the hidden label raises.
    """
    spark = scores.sparkSession
    x = as_double_array(scores_col)
    best = F.struct(F.array_max(x).alias("top"), (argmax(x) + 1).alias("pred"))
    aligned = align_models(scores, answers, models, best, F.col("answer"))
    aligned = require(aligned, F.col("answer") == F.lit(BLIND_LABEL), "hidden label 100 among answers")
    hit = F.coalesce((F.col("value.pred") == F.col("answer")).cast("long"), F.lit(0))
    none = F.coalesce((F.col("answer") == 0).cast("long"), F.lit(0))
    per = aligned.groupBy("model_id", F.col("value.top").alias("top")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum(none).alias("none"))
    path = scratch_path(spark, "score-ranges")
    dealt = per.repartitionByRange(F.col("top").asc_nulls_first(), "model_id")
    dealt.select("*", F.spark_partition_id().alias("range")).write.option("compression", "zstd").parquet(path)
    schema = "model_id string, top double, n long, hits long, none long, range int"
    ranged = spark.read.schema(schema).parquet(path)
    before, totals = _range_totals(ranged)
    # a row per (range, model): bounded by the number of shuffle partitions
    offsets = spark.createDataFrame(
        [(r, m, hits, none, *totals[m][:2]) for r, m, _, hits, none in before],
        "range int, model_id string, hits_before long, none_before long, n_all long, hits_all long")
    within = Window.partitionBy("range", "model_id").orderBy(F.col("top").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), ["range", "model_id"]).select(
        "*", F.coalesce(F.sum("hits").over(within), F.lit(0)).alias("hits_in"), F.coalesce(F.sum("none").over(within), F.lit(0)).alias("none_in"))
    # below the threshold the answer 0 is right, from it on the best class
    right = F.col("none_before") + F.col("none_in") + F.col("hits_all") - F.col("hits_before") - F.col("hits_in")
    return placed.select("model_id", sigmoid("top").alias("threshold"), "n", (right / F.col("n_all")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """``(model_id, threshold, accuracy)``: each model's threshold of highest accuracy (the lowest of equals)."""
    best = F.max(F.struct("accuracy", (-F.col("threshold")).alias("low"))).alias("b")
    return sweep.groupBy("model_id").agg(best).select("model_id", (-F.col("b.low")).alias("threshold"), F.col("b.accuracy").alias("accuracy"))
