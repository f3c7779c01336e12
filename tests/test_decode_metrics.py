"""Score math, decoders and evaluation on hand-made rows."""

import math

import numpy as np
import pytest

from relspark.plans.inspect import physical_plan
from pyspark.sql import functions as F

from relspark.functions.scores import argmax, softmax
from relspark.operators import decode, metrics, targets
from relspark.plans import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def scores_df(spark, rows):
    return spark.createDataFrame(rows, "example_id long, variant int, model_id string, scores array<double>")


def test_argmax_edge_cases(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 3.0, 3.0]), (1, [float("nan"), 5.0]), (2, []), (3, [-1000.0, 1000.0]), (4, [2.0, float("nan")])],
        "example_id long, scores array<double>",
    )
    got = {r.example_id: r.i for r in df.select("example_id", argmax("scores").alias("i")).collect()}
    assert got == {0: 1, 1: 0, 2: None, 3: 1, 4: 1}


def test_softmax_sums_to_one_and_is_stable(spark):
    df = spark.createDataFrame([([1000.0, -1000.0, 0.0],), ([0.1, 0.2],)], "scores array<double>")
    for r in df.select(softmax("scores").alias("p")).collect():
        assert abs(sum(r.p) - 1) < 1e-12
        assert all(not math.isnan(x) for x in r.p)


def test_threshold_decode(spark):
    # logit ln(1.5) is the 0.6 boundary; stay clearly off it.
    df = scores_df(spark, [(0, 0, "m", [0.1, 0.3]), (1, 0, "m", [0.2, 0.5]), (2, 0, "m", [2.0, 0.0])])
    got = {r.example_id: r.pred for r in decode.threshold_decode(df).collect()}
    assert got == {0: 0, 1: 2, 2: 1}


def test_pair_soft_vote(spark):
    df = scores_df(spark, [(0, 0, "m", [2.0, 0.0, 0.0]), (0, 1, "m", [0.0, 0.0, 3.0])])
    p = np.exp([2.0, 0, 0]) / np.exp([2.0, 0, 0]).sum() + np.exp([0, 0, 3.0]) / np.exp([0, 0, 3.0]).sum()
    assert decode.pair_soft_vote(df).first().pred == int(np.argmax(p))
    one = scores_df(spark, [(1, 0, "m", [1.0, 2.0])])
    with pytest.raises(Exception, match="expected 2 variants"):
        decode.pair_soft_vote(one).collect()


def test_ensemble_of_one_model_equals_argmax(spark):
    s = fx.rel_scores(spark, SF_SMALL).filter(F.col("model_id") == "2")
    a = {r.example_id: r.pred for r in decode.argmax_decode(s).collect()}
    e = {r.example_id: r.pred for r in decode.ensemble_soft_vote(s, expected_models=1).collect()}
    assert a == e


def test_ensemble_invariant_under_order_and_partitioning(spark):
    """Predictions are invariant; mean probabilities agree up to summation order."""
    s = fx.rel_scores(spark, SF_SMALL)
    base = {r.example_id: (r.pred, r.probs) for r in decode.ensemble_soft_vote(s, 4).collect()}
    shuffled = s.repartition(7, F.rand(3)).orderBy(F.rand(5))
    other = {r.example_id: (r.pred, r.probs) for r in decode.ensemble_soft_vote(shuffled, 4).collect()}
    assert base.keys() == other.keys()
    for k, (pred, probs) in base.items():
        assert other[k][0] == pred
        assert np.allclose(other[k][1], probs, rtol=0, atol=1e-12)


def test_ensemble_long_form_twin(spark):
    """Array-form soft vote equals the long form (explode, avg per class, best class)."""
    s = fx.rel_scores(spark, SF_SMALL)
    arr = {r.example_id: r.pred for r in decode.ensemble_soft_vote(s, 4).collect()}
    long = (
        s.select("example_id", "model_id", F.posexplode(softmax("scores")).alias("c", "p"))
        .groupBy("example_id", "c")
        .agg(F.avg("p").alias("p"))
        .groupBy("example_id")
        .agg(F.max_by("c", F.struct(F.round("p", 12), -F.col("c"))).alias("pred"))
    )
    assert arr == {r.example_id: r.pred for r in long.collect()}


def test_ensemble_count_guard(spark):
    s = fx.rel_scores(spark, SF_SMALL).filter(~((F.col("model_id") == "3") & (F.col("example_id") == 5)))
    with pytest.raises(Exception, match="expected 4 models"):
        decode.ensemble_soft_vote(s, 4).collect()


def test_hard_vote_majority_and_ties(spark):
    df = spark.createDataFrame(
        [(0, "a", 3), (0, "b", 3), (0, "c", 1), (1, "a", 5), (1, "b", 2), (1, "c", 7)],
        "example_id long, model_id string, pred int",
    )
    got = {r.example_id: (r.pred, r.votes) for r in decode.hard_vote(df, 3).collect()}
    assert got == {0: (3, 2), 1: (2, 1)}
    wide = {r.example_id: (r.pred, r.votes) for r in decode.hard_vote(df, 3, n_labels=8).collect()}
    assert wide == got
    with pytest.raises(Exception, match="outside label range"):
        decode.hard_vote(df, 3, n_labels=4).collect()


def test_hard_vote_count_guard(spark):
    df = spark.createDataFrame([(0, "a", 1), (0, "b", 1)], "example_id long, model_id string, pred int")
    with pytest.raises(Exception, match="expected 3 model predictions"):
        decode.hard_vote(df, 3).collect()


def test_vote_rejects_mixed_widths(spark):
    df = scores_df(spark, [(0, 0, "a", [1.0, 2.0]), (0, 0, "b", [1.0, 2.0, 3.0])])
    with pytest.raises(Exception, match="width differs"):
        decode.ensemble_soft_vote(df, 2, width=2).collect()


def test_hot_example_is_aggregated_not_collected(spark):
    """A key holding most rows goes through map-side partial sums (HashAggregate, no
    collect_list) and is rejected by the count guard."""
    hot = spark.range(0, 20000).select(
        F.lit(1).cast("long").alias("example_id"), F.lit(0).alias("variant"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("model_id"),
        F.array(F.lit(0.1), F.lit(0.2)).alias("scores"),
    )
    voted = decode.ensemble_soft_vote(hot, expected_models=4, width=2)
    plan = physical_plan(voted)
    assert "collect_list" not in plan
    with pytest.raises(Exception, match="expected 4 models"):
        voted.collect()


def test_hypothesis_rollup(spark):
    # 3 labels -> 2 relations -> 4 hypotheses per example
    rows = [
        (0, 0, "m", [0.0, 2.0]), (0, 1, "m", [0.0, 2.0]), (0, 2, "m", [0.0, 3.0]), (0, 3, "m", [0.0, 3.0]),
        (1, 0, "m", [3.0, 0.0]), (1, 1, "m", [3.0, 0.0]), (1, 2, "m", [3.0, 0.0]), (1, 3, "m", [3.0, 0.0]),
    ]
    got = {r.example_id: r.pred for r in decode.hypothesis_rollup(scores_df(spark, rows), n_labels=3).collect()}
    assert got == {0: 2, 1: 0}


def test_accuracy_alignment(spark):
    p = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "example_id long, pred int")
    a = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "example_id long, answer int")
    r = metrics.accuracy(p, a).first()
    assert abs(r.accuracy - 2 / 3) < 1e-12 and r.n == 3
    self_acc = metrics.accuracy(p, p.withColumnRenamed("pred", "answer")).first()
    assert self_acc.accuracy == 1.0
    short = a.filter("example_id < 2")
    with pytest.raises(Exception, match="differ in length"):
        metrics.accuracy(p, short).collect()
    hidden = spark.createDataFrame([(0, 1), (1, 100), (2, 3)], "example_id long, answer int")
    with pytest.raises(Exception, match="hidden label"):
        metrics.accuracy(p, hidden).collect()
    ex = metrics.accuracy(p, hidden, exclude_hidden=True).first()
    assert ex.n == 2 and ex.accuracy == 1.0


def test_alignment_rejects_repeated_keys(spark):
    p = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "example_id long, pred int")
    a = spark.createDataFrame([(0, 1), (1, 1)], "example_id long, answer int")
    with pytest.raises(Exception, match="duplicate example_id in predictions"):
        metrics.accuracy(p, a).collect()


def test_bce_matches_numpy_and_is_stable(spark):
    x = [[1000.0, -1000.0, 0.5], [-2.0, 3.0, 0.0]]
    z = [[1.0, 0.0, 0.5], [0.0, 1.0, 1 / 3]]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "example_id long, scores array<double>")
    t = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "example_id long, target array<double>")
    got = metrics.bce_with_logits(s, t).first().loss
    xa, za = np.array(x), np.array(z)
    ref = np.mean(np.maximum(xa, 0) - xa * za + np.log1p(np.exp(-np.abs(xa))))
    assert abs(got - ref) < 1e-9


def test_targets(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 41)], "example_id long, label int")
    got = {r.example_id: r.target for r in targets.soft_target(df, 41).collect()}
    assert got[0] == [1 / 41] * 41
    assert got[1][0] == 1.0 and sum(got[1]) == 1.0
    assert got[2][40] == 1.0 and sum(got[2]) == 1.0
    with pytest.raises(Exception, match="outside target width"):
        targets.soft_target(spark.createDataFrame([(3, 100)], "example_id long, label int"), 41).collect()
    sm = {r.example_id: r.target for r in targets.smoothed_target(df, 42, 0.5).collect()}
    assert abs(sm[1][1] - (0.5 + 0.5 / 42)) < 1e-12 and abs(sum(sm[1]) - 1) < 1e-12
    vt = targets.variant_target(df).collect()
    assert len(vt) == 6 and {r.variant for r in vt} == {0, 1}


def test_bucketed_scores_and_answers_need_no_shuffle(spark, tmp_dir):
    from relspark.sources import files

    spark.sql("DROP TABLE IF EXISTS scores_b")
    spark.sql("DROP TABLE IF EXISTS answers_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files.save_bucketed(fx.rel_scores(spark, SF_SMALL), "scores_b", 4)
        files.save_bucketed(fx.rel_answers(spark, SF_SMALL), "answers_b", 4)
        vote = decode.ensemble_soft_vote(spark.table("scores_b"), expected_models=[str(m) for m in range(4)], width=fx.MODEL_WIDTH)
        acc = metrics.accuracy(vote, spark.table("answers_b"))
        plan = physical_plan(acc)
        assert "Exchange hashpartitioning" not in plan
        direct = metrics.accuracy(
            decode.ensemble_soft_vote(fx.rel_scores(spark, SF_SMALL), 4, width=fx.MODEL_WIDTH), fx.rel_answers(spark, SF_SMALL)
        )
        assert acc.first() == direct.first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS scores_b")
        spark.sql("DROP TABLE IF EXISTS answers_b")


def test_compact_rollup_equals_grouped_rollup(spark):
    s = fx.rel_hypothesis_scores(spark, SF_SMALL)
    grouped = {r.example_id: (r.pred, r.score) for r in decode.hypothesis_rollup(s, n_labels=17).collect()}
    compact_in = s.groupBy("example_id", "model_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("variant", "scores"))), lambda x: x["scores"]).alias("scores")
    )
    compact = {r.example_id: (r.pred, r.score) for r in decode.hypothesis_rollup_compact(compact_in, n_labels=17).collect()}
    assert compact == grouped
    bad = compact_in.select("example_id", F.slice("scores", 1, 5).alias("scores"))
    with pytest.raises(Exception, match="two-wide hypothesis score vectors"):
        decode.hypothesis_rollup_compact(bad, n_labels=17).collect()


def test_votes_need_each_key_once(spark):
    twice = scores_df(spark, [(0, 0, "m0", [1.0, 0.0]), (0, 0, "m0", [1.0, 0.0]), (0, 0, "m1", [0.0, 1.0])])
    for expected in (3, ["m0", "m1", "m2"]):
        with pytest.raises(Exception, match="expected 3 models"):
            decode.ensemble_soft_vote(twice, expected, width=2).collect()
    preds = twice.select("example_id", "model_id", F.lit(1).alias("pred"))
    for kw in ({}, {"n_labels": 2}):
        with pytest.raises(Exception, match="expected 3 model predictions"):
            decode.hard_vote(preds, 3, **kw).collect()
        with pytest.raises(Exception, match="expected 3 model predictions"):
            decode.hard_vote(preds, ["m0", "m1", "m2"], **kw).collect()
    pair = scores_df(spark, [(0, 0, "m", [1.0, 0.0]), (0, 0, "m", [1.0, 0.0])])
    with pytest.raises(Exception, match="expected 2 variants"):
        decode.pair_soft_vote(pair, width=2).collect()


def test_rollup_needs_each_hypothesis_once(spark):
    # sums and sums of squares of these variants equal those of 0..7
    rows = [(0, v, "m", [0.0, float(v)]) for v in (1, 1, 2, 2, 3, 6, 6, 7)]
    with pytest.raises(Exception, match="once each"):
        decode.hypothesis_rollup(scores_df(spark, rows), n_labels=5).collect()
    short = scores_df(spark, [(0, v, "m", [0.0, 1.0]) for v in (0, 1, 2, 3, 4, 5)])
    with pytest.raises(Exception, match="expected 8 hypotheses"):
        decode.hypothesis_rollup(short, n_labels=5).count()


def test_checks_survive_column_selection(spark):
    s = fx.rel_scores(spark, SF_SMALL).filter("model_id <> '3'")
    with pytest.raises(Exception, match="expected 4 models"):
        decode.ensemble_soft_vote(s, 4, width=fx.MODEL_WIDTH).select("example_id", "probs").collect()
    with pytest.raises(Exception, match="expected 4 models"):
        decode.ensemble_soft_vote(s, ["0", "1", "2", "3"], width=fx.MODEL_WIDTH).count()
    p = spark.createDataFrame([(0, 1), (1, 1)], "example_id long, pred int")
    a = spark.createDataFrame([(0, 1)], "example_id long, answer int")
    with pytest.raises(Exception, match="differ in length"):
        metrics.align_predictions(p, a).count()
    wide = spark.createDataFrame([(0, [[1.0, 2.0]])], "example_id long, scores array<array<double>>")
    with pytest.raises(Exception, match="two-wide"):
        decode.hypothesis_rollup_compact(wide, n_labels=3).count()


def test_bce_needs_each_row_on_both_sides(spark):
    s = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(3)], "example_id long, scores array<double>")
    t = spark.createDataFrame([(0, [0.0, 1.0])], "example_id long, target array<double>")
    with pytest.raises(Exception, match="differ in length"):
        metrics.bce_with_logits(s, t).collect()
    twice = t.unionAll(t).unionAll(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "example_id long, target array<double>"))
    with pytest.raises(Exception, match="duplicate example_id in targets"):
        metrics.bce_with_logits(s, twice).collect()
    whole = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(3)], "example_id long, target array<double>")
    assert "SortAggregate" not in physical_plan(metrics.bce_with_logits(s, whole))
