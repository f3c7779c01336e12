import math
import random

import pytest
from pyspark.sql import functions as F

from relspark.operators import decode, metrics, sweep, targets

MODELS = ["a", "b"]


def tables(spark, n=400, levels=40, seed=2):
    r = random.Random(seed)
    answers = [(i, r.randrange(0, 4)) for i in range(n)]
    scores = [(i, 0, m, [3 * r.randrange(-levels, levels) / levels for _ in range(3)]) for i in range(n) for m in MODELS]
    s = spark.createDataFrame(scores, "example_id long, variant int, model_id string, scores array<double>").repartition(5)
    return s, spark.createDataFrame(answers, "example_id long, answer int").repartition(3), scores, dict(answers)


def brute(scores, answers, model):
    """Accuracy at each distinct score by decoding anew."""
    mine = [(max(x), x.index(max(x)) + 1, answers[i]) for i, _, m, x in scores if m == model]
    return {t: (sum(b == t for b, _, _ in mine), sum((p if b >= t else 0) == a for b, p, a in mine) / len(mine)) for t in {b for b, _, _ in mine}}


@pytest.mark.parametrize("levels", [1, 5, 10**6])
def test_sweep_equals_decoding_at_every_score(spark, levels):
    s, a, scores, answers = tables(spark, levels=levels)
    got = sweep.threshold_sweep(s, a, MODELS).collect()
    for m in MODELS:
        want = {round(1 / (1 + math.exp(-t)), 9): v for t, v in brute(scores, answers, m).items()}
        assert {round(r.threshold, 9): (r.n, pytest.approx(r.accuracy)) for r in got if r.model_id == m} == want
    best = {r.model_id: r for r in sweep.best_threshold(sweep.threshold_sweep(s, a, MODELS)).collect()}
    for m in MODELS:
        top = max(v[1] for v in brute(scores, answers, m).values())
        assert best[m].accuracy == pytest.approx(top)
        low = min(t for t, v in brute(scores, answers, m).items() if v[1] == top)
        assert best[m].threshold == pytest.approx(1 / (1 + math.exp(-low)))


def test_the_chosen_threshold_is_what_the_decoder_reaches(spark):
    s, a, *_ = tables(spark)
    for r in sweep.best_threshold(sweep.threshold_sweep(s, a, MODELS)).collect():
        pred = decode.threshold_decode(s.where(F.col("model_id") == r.model_id), threshold=r.threshold - 1e-12)
        assert metrics.accuracy(pred, a).first().accuracy == pytest.approx(r.accuracy)


def test_no_window_spans_all_rows(spark, capsys):
    s, a, *_ = tables(spark)
    sweep.threshold_sweep(s, a, MODELS).explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" in plan and "SinglePartition" not in plan


def test_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s, a, scores, answers = tables(spark, n=300, levels=10**6)
        got = sweep.threshold_sweep(s, a, MODELS).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(round(r.accuracy, 9) for r in got if r.model_id == "a") == sorted(round(v[1], 9) for v in brute(scores, answers, "a").values())


def test_one_plan_for_all_models_equals_each_by_itself(spark):
    s, a, *_ = tables(spark)
    t = targets.soft_target(a, n_classes=3, label_col="answer")
    for together, alone, side in ((metrics.accuracy_by_model, metrics.accuracy_from_scores, a), (metrics.bce_by_model, metrics.bce_with_logits, t)):
        got = {r.model_id: tuple(r)[1:] for r in together(s, side, MODELS).collect()}
        for m in MODELS:
            assert got[m] == pytest.approx(tuple(alone(s.where(F.col("model_id") == m), side).first()))


def test_missing_repeated_and_hidden_rows_raise(spark):
    s, a, *_ = tables(spark, n=20)
    for scores, answers, text in [
        (s.where("not (example_id = 3 and model_id = 'b')"), a, "each once"), (s.union(s.where("example_id = 3")), a, "each once"),
        (s, a.where("example_id <> 3"), "differ in length"), (s, a.union(a.where("example_id = 3")), "duplicate"),
        (s, a.withColumn("answer", F.when(F.col("example_id") == 3, 100).otherwise(F.col("answer"))), "hidden"),
    ]:
        with pytest.raises(Exception, match=text):
            metrics.accuracy_by_model(scores, answers, MODELS).collect()
        with pytest.raises(Exception, match=text):
            sweep.threshold_sweep(scores, answers, MODELS).collect()


def test_empty_tables(spark):
    s, a, *_ = tables(spark, n=4)
    assert sweep.threshold_sweep(s.where("example_id < 0"), a.where("example_id < 0"), MODELS).count() == 0
