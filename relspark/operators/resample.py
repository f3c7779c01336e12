"""Confidence interval of the accuracy by a Poisson bootstrap, in one pass over the examples.

A replicate draws every example with replacement; at scale the times one example is drawn are
independent Poisson(1) numbers.  Here they come from a hash of the example and the replicate, so a run
gives the same interval whatever the partitioning, and a lost task draws the same again.  One MD5 holds
``PER_HASH`` replicates of 16 bits.  Every replicate needs two sums, which are added map-side; what
is shuffled is one row a task, model and hash, and what is ranked is one number a replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax
from ..plans.joins import require
from ..schemas import BLIND_LABEL
from .metrics import align_models

PER_HASH = 8
# fixed values: 65536 times the chance that a Poisson(1) number is at most 0, 1, ... 7
POISSON_BOUNDS = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def poisson_weight(digits: Column) -> Column:
    """A Poisson(1) number from four hexadecimal digits."""
    u = F.conv(digits, 16, 10).cast("int")
    weight = F.lit(0)
    for bound in POISSON_BOUNDS:
        weight = weight + (u >= bound).cast("int")
    return weight


def accuracy_interval(scores: DataFrame, answers: DataFrame, models: Sequence[str], replicates: int = 96, level: float = 0.95, scores_col: str = "scores") -> DataFrame:
    """``(model_id, accuracy, low, high, n)``: each model's accuracy and the bounds between which the middle
    ``level`` of the replicates' accuracies lie (nearest ranks; ``replicates`` a multiple of
    ``PER_HASH``).  Every model and answer must be there exactly once per example; the hidden label raises."""
    if replicates < PER_HASH or replicates % PER_HASH:
        raise ValueError(f"replicates must be a multiple of {PER_HASH}")
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    aligned = align_models(scores, answers, models, argmax(F.col(scores_col)), F.col("answer"))
    aligned = require(aligned, F.col("answer") == F.lit(BLIND_LABEL), "hidden label 100 among answers")
    hit = F.coalesce((F.col("value") == F.col("answer")).cast("long"), F.lit(0))
    rows = aligned.select("model_id", hit.alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(replicates // PER_HASH - 1))).alias("h"), "example_id")
    # all models of an example are drawn together, so their replicates can be compared
    key = F.md5(F.concat_ws(":", F.col("example_id").cast("string"), F.col("h").cast("string")).cast("binary"))
    rows = rows.select("model_id", "h", "hit", key.alias("key"))
    sums = [F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")]
    for i in range(PER_HASH):
        w = poisson_weight(F.substring("key", 4 * i + 1, 4))
        sums += [F.sum(w * F.col("hit")).alias(f"hit{i}"), F.sum(w).alias(f"all{i}")]
    per = rows.groupBy("model_id", "h").agg(*sums)
    # a replicate that drew nobody has no accuracy; it can only be one of a table of few examples
    drawn = F.filter(F.array(*[F.try_divide(F.col(f"hit{i}"), F.col(f"all{i}")) for i in range(PER_HASH)]), lambda x: x.isNotNull())
    got = per.groupBy("model_id").agg(F.max(F.col("hits") / F.col("n")).alias("accuracy"), F.max("n").alias("n"),
                                      F.array_sort(F.flatten(F.collect_list(drawn))).alias("all"))  # a number a replicate
    tail = (1 - level) / 2

    def rank(q: float) -> Column:
        at = F.greatest(F.ceil(F.size("all") * q - 1e-9), F.lit(1)).cast("int")
        return F.try_element_at("all", at)

    return got.select("model_id", "accuracy", rank(tail).alias("low"), rank(1 - tail).alias("high"), "n")
