"""Decoders: score vectors -> label ids.

Per-row decoders (argmax, threshold, per-hypothesis) are pure projections.  The voting
decoders group rows of one example with fixed-width streaming aggregates (one sum per class
and a row count): partial sums are combined map-side, buffers never grow with a group, and
that every expected key (variant, model or hypothesis) is there exactly once is checked on
fixed-width counts, so no group is ever collected; the checks are filters, which no column
selection can prune.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax, as_double_array, let, sigmoid, softmax
from ..plans.joins import require

# fixed values: default decision threshold of the no-relation-free decoder
EXCEPT0_THRESHOLD = 0.6

KEY_COLUMNS = ("example_id", "variant", "model_id")


def _keys(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in KEY_COLUMNS if c in df.columns]


def argmax_decode(scores: DataFrame, scores_col: str = "scores") -> DataFrame:
    """Per row: index of the first maximum score."""
    return scores.select(*_keys(scores), argmax(F.col(scores_col)).alias("pred"))


def hypothesis_decode(scores: DataFrame, scores_col: str = "scores") -> DataFrame:
    """Per hypothesis row (2-wide scores): 0 = no, 1 = yes.  No roll-up to a relation."""
    return argmax_decode(scores, scores_col)


def threshold_decode(
    scores: DataFrame, threshold: float = EXCEPT0_THRESHOLD, scores_col: str = "scores"
) -> DataFrame:
    """Scores over relations 1..K-1: best index + 1, or 0 when sigmoid(best score) < threshold.

    Exactly at the threshold the class is kept.
    """
    x = F.col(scores_col)
    best = sigmoid(F.array_max(x))
    pred = F.when(best < F.lit(threshold), F.lit(0)).otherwise(argmax(x) + 1).cast("int")
    return scores.select(*_keys(scores), pred.alias("pred"))


class _KeyCheck:
    """Proof that a group has every expected key exactly once.

    With the keys themselves: one fixed-width count for each, and the row count.  With only their
    number: the row count and the count of distinct keys.
    """

    def __init__(self, key: str, expected: int | Sequence, what: str):
        self.n = expected if isinstance(expected, int) else len(expected)
        self.what = what
        self.aggregates = [F.count(F.lit(1)).alias("__n")]
        bad = F.col("__n") != self.n
        if isinstance(expected, int):
            self.aggregates.append(F.count_distinct(key).alias("__nd"))
            bad = bad | (F.col("__nd") != self.n)
        else:
            for i, k in enumerate(expected):
                self.aggregates.append(F.count(F.when(F.col(key) == F.lit(k), 1)).alias(f"__k{i}"))
                bad = bad | (F.col(f"__k{i}") != 1)
        self.bad = bad

    def apply(self, grouped: DataFrame) -> DataFrame:
        message = F.concat(
            F.lit(f"expected {self.n} {self.what} per example, each once, got "),
            F.col("__n").cast("string"), F.lit(" rows at example_id "), F.col("example_id").cast("string"),
        )
        return require(grouped, self.bad, message)


def _models(scores: DataFrame, expected: int | Sequence[str] | None) -> int | list[str]:
    """The expected models; read from the table (one small aggregate) when not given."""
    if expected is None:
        return sorted(r[0] for r in scores.select("model_id").distinct().collect())
    return expected if isinstance(expected, int) else list(expected)


def vector_width(scores: DataFrame, scores_col: str = "scores") -> int:
    """Width of the score vectors, read from one row (every row is checked against it later).

    Callers that know the class count (it follows from the label set) should pass it as
    ``width`` instead: reading a row runs the plan up to that row.
    """
    row = scores.select(F.size(scores_col)).first()
    if row is None:
        raise ValueError("no score rows")
    return int(row[0])


def _soft_vote(
    scores: DataFrame,
    group_cols: list[str],
    key: str,
    expected: int | Sequence,
    what: str,
    from_logits: bool,
    scores_col: str,
    width: int | None,
) -> DataFrame:
    """Mean probability vector per group and its argmax, as a fixed-width aggregate.

    One ``sum(p[i])`` per class plus a row count: hash aggregation with map-side partial
    sums and constant-size buffers, so even a key holding a large share of the rows is
    reduced before the shuffle and never collected in one task.
    """
    width = width if width is not None else vector_width(scores, scores_col)
    # the width is a filter too: it holds whichever columns are selected later
    checked = require(scores, F.coalesce(F.size(scores_col), F.lit(-1)) != width, f"score vector width differs from {width}")
    raw = as_double_array(scores_col)
    probs = softmax(raw) if from_logits else raw
    rows = checked.select(*[F.col(c) for c in group_cols], F.col(key), probs.alias("__p"))
    check = _KeyCheck(key, expected, what)
    sums = [F.sum(F.col("__p")[i]).alias(f"__s{i}") for i in range(width)]
    grouped = check.apply(rows.groupBy(*group_cols).agg(*check.aggregates, *sums))
    mean = F.array(*[F.col(f"__s{i}") / check.n for i in range(width)])
    voted = grouped.select(*[F.col(c) for c in group_cols], mean.alias("probs"))
    return voted.select(*[F.col(c) for c in group_cols], argmax("probs").alias("pred"), "probs")


def pair_soft_vote(
    scores: DataFrame,
    from_logits: bool = True,
    scores_col: str = "scores",
    width: int | None = None,
) -> DataFrame:
    """Two-sentence decoding: softmax each of the two variant rows, average, argmax.

    Groups by ``example_id`` (and ``model_id`` when present); each group must hold variants 0 and
    1, each once.  ``width`` (number of classes) is read from one row when not given.
    """
    group_cols = ["example_id"] + (["model_id"] if "model_id" in scores.columns else [])
    return _soft_vote(scores, group_cols, "variant", (0, 1), "variants", from_logits, scores_col, width)


def ensemble_soft_vote(
    scores: DataFrame,
    expected_models: int | Sequence[str] | None = None,
    from_logits: bool = True,
    scores_col: str = "scores",
    width: int | None = None,
) -> DataFrame:
    """Model ensemble: softmax per model, mean over models, argmax (first index on ties).

    ``expected_models`` are the model ids (default: those of the table, one small aggregate), each
    of which must have scored every example exactly once; given only their number, that many
    different models must have.  With the ids the vote groups by ``example_id`` alone and its
    output stays hash-partitioned by ``example_id`` for a following keyed join.
    """
    return _soft_vote(
        scores, ["example_id"], "model_id", _models(scores, expected_models), "models", from_logits, scores_col, width
    )


def hard_vote(
    predictions: DataFrame,
    expected_models: int | Sequence[str] | None = None,
    pred_col: str = "pred",
    n_labels: int | None = None,
) -> DataFrame:
    """Majority label per example over model predictions; ties -> the smallest label id.

    With ``n_labels`` known, one fixed-width aggregate counts the votes of every label per
    example (map-side partial counts, one shuffle); a prediction outside ``0..n_labels-1``
    raises.  Without it, votes are counted per (example, label) and the winner is a streaming
    ``max_by`` over at most one row per distinct label.  ``expected_models`` as in
    :func:`ensemble_soft_vote`.
    """
    check = _KeyCheck("model_id", _models(predictions, expected_models), "model predictions")
    if n_labels is not None:
        p = F.col(pred_col)
        rows = require(
            predictions.select("example_id", "model_id", p.alias("__pred")),
            F.col("__pred").isNull() | (F.col("__pred") < 0) | (F.col("__pred") >= n_labels),
            F.concat(F.lit("prediction outside label range: "), F.coalesce(F.col("__pred").cast("string"), F.lit("null"))),
        )
        counts = [F.count(F.when(F.col("__pred") == j, 1)).alias(f"__c{j}") for j in range(n_labels)]
        agg = check.apply(rows.groupBy("example_id").agg(*check.aggregates, *counts))
        votes = F.array(*[F.col(f"__c{j}") for j in range(n_labels)])
        return agg.select("example_id", argmax(votes).alias("pred"), F.array_max(votes).cast("int").alias("votes"))
    # models are counted first, so that no model's second row can stand for a missing one
    models = predictions.groupBy("example_id", "model_id").agg(
        F.count(F.lit(1)).alias("__rows"), F.max(pred_col).alias("__pred")
    )
    models = require(models, F.col("__rows") > 1, f"expected {check.n} model predictions per example, each once")
    votes = models.groupBy("example_id", "__pred").agg(F.count(F.lit(1)).alias("__n"))
    best = votes.groupBy("example_id").agg(
        F.max_by(F.col("__pred"), F.struct(F.col("__n"), -F.col("__pred"))).alias("__best"),
        F.max("__n").alias("__votes"),
        F.sum("__n").alias("__total"),
    )
    best = require(
        best, F.col("__total") != check.n,
        F.concat(F.lit(f"expected {check.n} model predictions per example, each once, got "), F.col("__total").cast("string")),
    )
    return best.select(
        "example_id", F.col("__best").cast("int").alias("pred"), F.col("__votes").cast("int").alias("votes")
    )


def hypothesis_rollup(
    scores: DataFrame,
    n_labels: int,
    threshold: float = 0.5,
    from_logits: bool = True,
    scores_col: str = "scores",
) -> DataFrame:
    """Per example: the relation whose two hypotheses have the highest mean "yes" probability.

    Hypothesis ``variant v`` belongs to relation ``v div 2 + 1``.  Below ``threshold`` the
    example gets 0 (no relation); ties go to the smallest relation id.  Each example must carry
    exactly the hypotheses 0..2*(K-1)-1, each once.  Rows are reduced map-side to one per relation
    (both directions counted and summed), then to one streaming maximum per example, so the work is
    linear in the hypotheses and an example with a large share of the rows is never gathered.
    """
    n_rel = n_labels - 1
    n_hyp = 2 * n_rel
    group_cols = ["example_id"] + (["model_id"] if "model_id" in scores.columns else [])
    v = F.col("variant")
    checked = require(scores, F.coalesce(F.size(scores_col), F.lit(-1)) != 2, "score vector width differs from 2")
    checked = require(
        checked, v.isNull() | (v < 0) | (v >= n_hyp),
        F.concat(F.lit("hypothesis variant out of range: "), F.coalesce(v.cast("string"), F.lit("null"))),
    )
    raw = as_double_array(scores_col)
    probs = softmax(raw) if from_logits else raw
    rows = checked.select(
        *group_cols, F.floor(v / 2).cast("int").alias("__rel"), (v % 2).alias("__dir"), F.element_at(probs, 2).alias("__p")
    )
    each = rows.groupBy(*group_cols, "__rel").agg(
        F.count(F.when(F.col("__dir") == 0, 1)).alias("__forward"),
        F.count(F.when(F.col("__dir") == 1, 1)).alias("__reverse"),
        (F.sum("__p") / 2).alias("m"),
    )
    once = "hypothesis variants must be 0..2*(K-1)-1 once each"
    each = require(each, (F.col("__forward") != 1) | (F.col("__reverse") != 1), once)
    best = each.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.col("m")).alias("score"),
        F.max_by(F.col("__rel"), F.struct("m", (-F.col("__rel")).alias("neg"))).alias("__best"),
    )
    best = require(best, F.col("__n") != n_rel, f"expected {n_hyp} hypotheses per example: " + once)
    pred = F.when(F.col("score") < F.lit(threshold), F.lit(0)).otherwise(F.col("__best") + 1)
    return best.select(*group_cols, pred.cast("int").alias("pred"), "score")


def hypothesis_rollup_compact(
    scores: DataFrame,
    n_labels: int,
    threshold: float = 0.5,
    from_logits: bool = True,
    scores_col: str = "scores",
) -> DataFrame:
    """:func:`hypothesis_rollup` for one row per example whose ``scores`` holds the 2-wide
    score vectors of all ``2*(n_labels-1)`` hypotheses in variant order.

    Everything is per row (higher-order functions over the score array): no explode, no
    aggregation and no shuffle.  Same arithmetic as the grouped form: the mean of the two
    "yes" probabilities of each relation, the best relation, ties to the smallest id.
    """
    n_rel = n_labels - 1
    n_hyp = 2 * n_rel
    arr = F.col(scores_col).cast("array<array<double>>")
    shape_ok = (F.size(arr) == F.lit(n_hyp)) & F.aggregate(
        arr, F.lit(True), lambda acc, s: acc & (F.size(s) == F.lit(2))
    )
    scores = require(scores, ~F.coalesce(shape_ok, F.lit(False)), f"expected {n_hyp} two-wide hypothesis score vectors per example")

    def yes(s):
        return F.element_at(softmax(s) if from_logits else s, 2)

    best = let(
        F.transform(arr, yes),
        lambda p: F.array_max(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_rel - 1)),
                lambda j: F.struct(((p[j * 2] + p[j * 2 + 1]) / 2).alias("m"), (-j).alias("neg")),
            )
        ),
    )
    keys = [F.col(c) for c in ("example_id", "model_id") if c in scores.columns]
    voted = scores.select(*keys, best.alias("__best"))
    b = F.col("__best")
    pred = F.when(b["m"] < F.lit(threshold), F.lit(0)).otherwise(-b["neg"] + 1)
    return voted.select(*keys, pred.cast("int").alias("pred"), b["m"].alias("score"))


def pair_soft_vote_compact(
    scores: DataFrame, from_logits: bool = True, scores_col: str = "scores"
) -> DataFrame:
    """:func:`pair_soft_vote` for one row per example whose ``scores`` holds the score vectors
    of its two question variants (in variant order): softmax each, average, argmax — per row,
    no shuffle."""
    arr = F.col(scores_col).cast("array<array<double>>")
    shape_ok = (F.size(arr) == F.lit(2)) & (F.size(arr[0]) == F.size(arr[1]))
    scores = require(scores, ~F.coalesce(shape_ok, F.lit(False)), "expected two equally wide score vectors per example")
    probs = F.transform(arr, lambda s: softmax(s) if from_logits else s)
    mean = let(probs, lambda p: F.zip_with(p[0], p[1], lambda a, b: (a + b) / 2))
    keys = [F.col(c) for c in ("example_id", "model_id") if c in scores.columns]
    voted = scores.select(*keys, mean.alias("probs"))
    return voted.select(*keys, argmax("probs").alias("pred"), "probs")
