"""End-to-end compositions: read -> project -> build inputs by style; scores -> decoder by
name; predictions -> accuracy.  No own logic; each step is an operator of this library and
the whole chain stays one lazy plan up to the caller's action.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import decode, examples, inputs, metrics
from ..sources import files


def build_inputs(
    ex: DataFrame,
    style: str,
    dim: DataFrame | None = None,
    tagger: Callable | None = None,
    pandas_tagger: Callable | None = None,
    load_fn: Callable | None = None,
    **kw,
) -> DataFrame:
    """``EXAMPLE`` rows -> model inputs of one style (``pair``, ``typed_pair``, ``single``,
    ``two_sentence``, ``hypothesis``)."""
    if style == inputs.STYLE_PAIR:
        return inputs.pair_input(ex, **kw)
    if style == inputs.STYLE_SINGLE:
        return inputs.single_input(ex, **kw)
    if style == inputs.STYLE_TWO_SENTENCE:
        return inputs.two_sentence_input(ex, **kw)
    if style == inputs.STYLE_TYPED_PAIR:
        from ..operators.jobs import tag_entities

        if tagger is None and pandas_tagger is None:
            raise ValueError("typed_pair needs a tagger")
        return inputs.typed_pair_input(tag_entities(ex, tagger=tagger, pandas_tagger=pandas_tagger, load_fn=load_fn), **kw)
    if style == inputs.STYLE_HYPOTHESIS:
        if dim is None:
            raise ValueError("hypothesis inputs need the label dimension")
        return inputs.hypothesis_input(ex, dim, **kw)
    raise ValueError(f"unknown input style {style!r}")


def decode_scores(scores: DataFrame, decoder: str, **kw) -> DataFrame:
    """Apply a decoder by name (as chosen by :func:`relspark.operators.experiments.decoder_choice`)."""
    table = {
        "argmax_decode": decode.argmax_decode,
        "threshold_decode": decode.threshold_decode,
        "hypothesis_decode": decode.hypothesis_decode,
        "pair_soft_vote": decode.pair_soft_vote,
        "ensemble_soft_vote": decode.ensemble_soft_vote,
        "hypothesis_rollup": decode.hypothesis_rollup,
    }
    if decoder not in table:
        raise ValueError(f"unknown decoder {decoder!r}")
    return table[decoder](scores, **kw)


def load_test_dataset(
    spark: SparkSession, path: str, dim: DataFrame, style: str = "pair", scope: str = "file", **kw
) -> DataFrame:
    """Raw example file -> model inputs of ``style`` (the plain, two-sentence and hypothesis
    test loaders are this with different styles)."""
    raw = files.read_raw_examples(spark, path, scope=scope)
    return build_inputs(examples.project_examples(raw, dim), style, dim=dim, **kw)


def load_marked_examples(spark: SparkSession, path: str, dim: DataFrame) -> DataFrame:
    """Raw example file -> ``MARKED_EXAMPLE`` (entity markers inserted at the offsets)."""
    return examples.mark_entities(files.read_raw_examples(spark, path), dim)


def tagged_test_dataset(
    spark: SparkSession,
    path: str,
    tagger: Callable | None = None,
    pandas_tagger: Callable | None = None,
    load_fn: Callable | None = None,
    scope: str = "file",
    **kw,
) -> DataFrame:
    """Tagged example file -> typed-pair model inputs, tags by a Column tagger or a model."""
    tagged = files.read_tagged_examples(spark, path, scope=scope)
    return build_inputs(
        examples.project_tagged(tagged), inputs.STYLE_TYPED_PAIR, tagger=tagger, pandas_tagger=pandas_tagger, load_fn=load_fn, **kw
    )


def ensemble_files(
    spark: SparkSession,
    raw_path: str,
    tagged_path: str,
    dim: DataFrame,
    pair_models: dict[str, Callable],
    typed_models: dict[str, Callable],
    score_fn: Callable,
    pandas_tagger: Callable,
    out_path: str,
    tagger_load_fn: Callable | None = None,
    width: int | None = None,
    scope: str = "file",
) -> DataFrame:
    """The ensemble as one flow: a raw and a tagged file of the same examples in the same order,
    models by name and loader on entity pairs and on typed pairs, soft vote, positional
    predictions written to ``out_path``.  Returns the vote (``example_id``, ``pred``, ``probs``).

    The two files are aligned by position; a row that only one of them has lacks some of the
    models' scores, and the vote raises."""
    from ..operators.jobs import score_batches

    raw = files.read_raw_examples(spark, raw_path, scope=scope)
    pairs = inputs.pair_input(examples.project_examples(raw, dim))
    typed = tagged_test_dataset(spark, tagged_path, pandas_tagger=pandas_tagger, load_fn=tagger_load_fn, scope=scope)
    scores = None
    for frame, models in ((pairs, pair_models), (typed, typed_models)):
        for name, load_fn in models.items():
            part = score_batches(frame, score_fn, ["text", "text_pair"], load_fn=load_fn, model_id=name)
            scores = part if scores is None else scores.unionByName(part)
    vote = decode.ensemble_soft_vote(scores, expected_models=[*pair_models, *typed_models], width=width)
    files.write_positional_predictions(vote, out_path)
    return vote


def score_hypotheses(
    ex: DataFrame,
    dim: DataFrame,
    score_fn: Callable,
    load_fn: Callable | None = None,
    threshold: float = 0.5,
    model_id: str = "rtq",
    batch_size: int = 82,
    **kw,
) -> DataFrame:
    """Hypothesis statements, scoring and roll-up to one relation per example as one plan.

    The compact form sends each sentence to the scorer once with its 2*(K-1) statements,
    and the scores of one example come back in one row, so the roll-up is a per-row
    expression: the whole pipeline runs without a shuffle.
    """
    from ..operators.jobs import score_statement_batches
    from ..operators.labels import label_stats

    compact = inputs.hypothesis_statements(ex, dim, **kw)
    scores = score_statement_batches(
        compact, score_fn, load_fn=load_fn, model_id=model_id, batch_size=batch_size, explode=False
    )
    return decode.hypothesis_rollup_compact(
        scores, n_labels=label_stats(dim).n_labels, threshold=threshold
    )


def score_two_sentence(
    ex: DataFrame,
    score_fn: Callable,
    load_fn: Callable | None = None,
    model_id: str = "two_sentence",
    batch_size: int = 32,
    **kw,
) -> DataFrame:
    """Both questions of each example scored together (sentence sent once) and soft-voted per
    row: the two-sentence inference as one plan without a shuffle."""
    from ..operators.jobs import score_statement_batches

    compact = inputs.two_sentence_statements(ex, **kw)
    scores = score_statement_batches(
        compact, score_fn, load_fn=load_fn, model_id=model_id, batch_size=batch_size, explode=False
    )
    return decode.pair_soft_vote_compact(scores)


def evaluate_files(spark: SparkSession, pred_path: str, answer_path: str, scope: str = "file", **kw) -> DataFrame:
    """Accuracy of a positional prediction file (column ``pred``) against a positional answer
    file (column ``answer``): rows are aligned by their position, and files of different
    length fail.  ``scope='dir'`` reads multi-part folders."""
    preds = files.read_predictions(spark, pred_path, column="pred", scope=scope).select("example_id", "pred")
    answers = files.read_predictions(spark, answer_path, column="answer", scope=scope).select("example_id", "answer")
    return metrics.accuracy(preds, answers, **kw)


def evaluate(predictions: DataFrame, answers: DataFrame, **kw) -> DataFrame:
    """Accuracy of keyed predictions against keyed answers."""
    return metrics.accuracy(predictions, answers, **kw)
