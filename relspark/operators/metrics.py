"""Evaluation: prediction/answer alignment, accuracy, confusion counts, BCE loss.

Alignment is an equi-join on ``example_id`` (a file position is turned into an id once, at
ingest).  It is a full outer join with a check, so tables of unequal length fail instead of
being silently truncated; the checks are filters, so no column selection or count drops them.
Accuracy and loss are global aggregates with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax, as_double_array, bce_with_logits_sum
from ..plans.joins import require
from ..schemas import BLIND_LABEL


def _one_per_key(df: DataFrame, value: str, marker: str) -> DataFrame:
    """One row per ``example_id`` with the row count in ``marker``.

    The aggregation combines map-side and hash-partitions by ``example_id``, which the
    following join reuses (no extra shuffle); a duplicated key is therefore detected from its
    count instead of being joined into all pairs.
    """
    return df.groupBy("example_id").agg(
        F.count(F.lit(1)).alias(marker), F.max(F.col(value)).alias(value)
    )


def _paired(joined: DataFrame, left: str, right: str, left_name: str, right_name: str) -> DataFrame:
    """Rows of a full outer join of key counts; raises unless each key is once on both sides."""
    key = F.col("example_id").cast("string")
    joined = require(
        joined, F.col(left).isNull() | F.col(right).isNull(),
        F.concat(F.lit(f"{left_name} and {right_name} differ in length / keys at example_id "), key),
    )
    for col, name in ((left, left_name), (right, right_name)):
        joined = require(joined, F.col(col) > 1, F.concat(F.lit(f"duplicate example_id in {name}: "), key))
    return joined


def align_predictions(
    predictions: DataFrame,
    answers: DataFrame,
    pred_col: str = "pred",
    answer_col: str = "answer",
) -> DataFrame:
    """``(example_id, pred, answer)``; raises if an id is on one side only or repeated."""
    p = _one_per_key(predictions.select("example_id", F.col(pred_col).alias("pred")), "pred", "__p")
    a = _one_per_key(answers.select("example_id", F.col(answer_col).alias("answer")), "answer", "__a")
    # a missing side shows as a null count, which tells it apart from a null value from a file
    joined = _paired(p.join(a, "example_id", "full_outer"), "__p", "__a", "predictions", "answers")
    return joined.select("example_id", "pred", "answer")


def accuracy(
    predictions: DataFrame,
    answers: DataFrame,
    exclude_hidden: bool = False,
    pred_col: str = "pred",
    answer_col: str = "answer",
) -> DataFrame:
    """One row: share of examples whose prediction equals the answer, and the count.

    Answers carrying the hidden label 100 raise unless ``exclude_hidden`` drops them.
    """
    aligned = align_predictions(predictions, answers, pred_col, answer_col)
    hidden = F.col("answer") == F.lit(BLIND_LABEL)
    if exclude_hidden:
        aligned = aligned.filter(~hidden | F.col("answer").isNull())
    else:
        aligned = require(aligned, hidden, "hidden label 100 among answers")
    hit = F.coalesce((F.col("pred") == F.col("answer")).cast("double"), F.lit(0.0))
    return aligned.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def accuracy_from_scores(
    scores: DataFrame, answers: DataFrame, scores_col: str = "scores", **kw
) -> DataFrame:
    """Argmax of each score vector, then :func:`accuracy`."""
    preds = scores.select(F.col("example_id"), argmax(F.col(scores_col)).alias("pred"))
    return accuracy(preds, answers, **kw)


def align_models(scores: DataFrame, answers: DataFrame, models: Sequence[str], value: Column, answer: Column) -> DataFrame:
    """``(example_id, model_id, value, answer)``: every model's ``value`` of an example beside its answer.

    One scan of each side: the scores are reduced to one row per example (a count and a value for
    each of the expected models), joined with the answers' one row per example, and laid out by model
    again.  Raises unless every model and every answer is there exactly once.
    """
    counts, values = [], []
    for i, m in enumerate(models):
        mine = F.col("model_id") == F.lit(m)
        counts.append(F.count(F.when(mine, 1)).alias(f"__n{i}"))
        values.append(F.max(F.when(mine, F.col("__v"))).alias(f"__v{i}"))
    per = scores.select("example_id", "model_id", value.alias("__v")).groupBy("example_id").agg(F.count(F.lit(1)).alias("__rows"), *counts, *values)
    side = answers.select("example_id", answer.alias("answer"))
    joined = per.join(_one_per_key(side, "answer", "__a"), "example_id", "full_outer")
    key = F.col("example_id").cast("string")
    joined = require(joined, F.col("__rows").isNull() | F.col("__a").isNull(), F.concat(F.lit("scores and answers differ in length / keys at example_id "), key))
    joined = require(joined, F.col("__a") > 1, F.concat(F.lit("duplicate example_id in answers: "), key))
    wrong = F.col("__rows") != len(models)
    for i in range(len(models)):
        wrong = wrong | (F.col(f"__n{i}") != 1)
    joined = require(joined, wrong, F.concat(F.lit(f"expected {len(models)} models per example, each once, at example_id "), key))
    laid = F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"__v{i}").alias("value")) for i, m in enumerate(models)]))
    return joined.select("example_id", "answer", laid.alias("__m")).select("example_id", "__m.model_id", "__m.value", "answer")


def accuracy_by_model(scores: DataFrame, answers: DataFrame, models: Sequence[str], scores_col: str = "scores") -> DataFrame:
    """``(model_id, accuracy, n)``: :func:`accuracy_from_scores` of every model in one plan."""
    aligned = align_models(scores, answers, models, argmax(F.col(scores_col)), F.col("answer"))
    aligned = require(aligned, F.col("answer") == F.lit(BLIND_LABEL), "hidden label 100 among answers")
    hit = F.coalesce((F.col("value") == F.col("answer")).cast("double"), F.lit(0.0))
    return aligned.groupBy("model_id").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def bce_by_model(scores: DataFrame, targets: DataFrame, models: Sequence[str], scores_col: str = "scores", target_col: str = "target") -> DataFrame:
    """``(model_id, loss, n)``: :func:`bce_with_logits` of every model in one plan."""
    aligned = align_models(scores, targets, models, as_double_array(scores_col), as_double_array(target_col))
    aligned = require(
        aligned, F.col("value").isNull() | F.col("answer").isNull() | (F.size("value") != F.size("answer")), "logit and target vectors differ in width"
    )
    return aligned.groupBy("model_id").agg(
        (F.sum(bce_with_logits_sum("value", "answer")) / F.sum(F.size("value"))).alias("loss"), F.count(F.lit(1)).alias("n")
    )


def confusion_counts(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """``(answer, pred, n)`` over aligned rows."""
    aligned = align_predictions(predictions, answers)
    return aligned.groupBy("answer", "pred").agg(F.count(F.lit(1)).alias("n"))


def bce_with_logits(
    scores: DataFrame,
    targets: DataFrame,
    scores_col: str = "scores",
    target_col: str = "target",
) -> DataFrame:
    """One row: mean over all elements of binary cross-entropy with logits.

    Every ``example_id`` must be once on both sides, with vectors of equal width.  The key check
    runs on counts without the vectors (hash aggregation), and the vectors are joined once.
    """
    s = scores.select("example_id", as_double_array(scores_col).alias("x"))
    t = targets.select("example_id", as_double_array(target_col).alias("z"))
    sides = s.select("example_id", F.lit(1).alias("__in_s"), F.lit(0).alias("__in_t")).unionAll(
        t.select("example_id", F.lit(0), F.lit(1))
    )
    keys = sides.groupBy("example_id").agg(
        F.nullif(F.sum("__in_s"), F.lit(0)).alias("__s"), F.nullif(F.sum("__in_t"), F.lit(0)).alias("__t")
    )
    keys = _paired(keys, "__s", "__t", "scores", "targets").select("example_id")
    joined = require(
        keys.join(s, "example_id").join(t, "example_id"),
        F.col("x").isNull() | F.col("z").isNull() | (F.size("x") != F.size("z")),
        "logit and target vectors differ in width",
    )
    return joined.agg(
        (F.sum(bce_with_logits_sum("x", "z")) / F.sum(F.size("x"))).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )
