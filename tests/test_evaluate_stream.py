import os
import random

import pytest

from relspark.operators import metrics
from relspark.streaming import evaluate_stream as es


class Folders:
    def __init__(self, spark, base):
        self.spark, self.base, self.n = spark, base, 0
        for name in ("pred", "answer"):
            os.makedirs(f"{base}/{name}")

    def put(self, side, rows):
        self.n += 1
        with open(f"{self.base}/{side}/f{self.n}.csv", "w") as f:
            f.write(f"example_id,{side}\n" + "".join(f"{i},{'' if v is None else v}\n" for i, v in rows))

    def run(self, files=1):
        q = es.run_evaluation(self.spark, f"{self.base}/pred", f"{self.base}/answer", f"{self.base}/out", f"{self.base}/ckpt", files)
        q.awaitTermination()
        return {(r.answer, r.pred): r.n for r in es.running_confusion(self.spark, f"{self.base}/out").collect()}


def tables(n=60, seed=1):
    r = random.Random(seed)
    return [(i, r.randrange(3)) for i in range(n)], [(i, r.randrange(3)) for i in range(n)]


def batch(spark, pred, answer):
    p = spark.createDataFrame(pred, "example_id long, pred int")
    a = spark.createDataFrame(answer, "example_id long, answer int")
    return {(r.answer, r.pred): r.n for r in metrics.confusion_counts(p, a).collect()}, metrics.accuracy(p, a).first()


@pytest.mark.parametrize("order", ["answers late", "answers first", "mixed"])
def test_any_order_of_files_ends_with_the_batch_counts(spark, tmp_dir, order):
    pred, answer = tables()
    f = Folders(spark, tmp_dir)
    r = random.Random(2)
    r.shuffle(pred), r.shuffle(answer)
    parts = [("pred", pred[i::3]) for i in range(3)] + [("answer", answer[i::4]) for i in range(4)]
    if order == "answers first":
        parts.reverse()
    elif order == "mixed":
        r.shuffle(parts)
    for side, rows in parts:
        f.put(side, rows)
    want, acc = batch(spark, pred, answer)
    assert f.run() == want
    got = es.running_accuracy(spark, f"{tmp_dir}/out").first()
    assert (got.accuracy, got.n) == pytest.approx((acc.accuracy, acc.n))


def test_a_later_run_goes_on_and_nothing_counts_twice(spark, tmp_dir):
    pred, answer = tables()
    f = Folders(spark, tmp_dir)
    f.put("pred", pred)
    assert f.run() == {}
    assert es.running_accuracy(spark, f"{tmp_dir}/out").first().n == 0
    f.put("answer", answer[:25])
    first = f.run()
    assert sum(first.values()) == 25 and f.run() == first
    f.put("answer", answer[25:])
    assert f.run() == batch(spark, pred, answer)[0]


def test_a_batch_that_is_run_again_replaces_its_counts(spark, tmp_dir):
    changed = spark.createDataFrame([(1, 1, 1, 2, 2), (2, 1, 0, 0, None)], "example_id long, predictions long, answers long, pred int, answer int")
    add = es._add(f"{tmp_dir}/out")
    for _ in range(2):
        add(changed, 7)
    assert [tuple(r) for r in es.running_confusion(spark, f"{tmp_dir}/out").collect()] == [(2, 2, 1)]


def test_a_second_arrival_raises(spark, tmp_dir):
    f = Folders(spark, tmp_dir)
    f.put("pred", [(1, 0), (2, 1)])
    f.put("answer", [(1, 0)])
    f.run()
    f.put("answer", [(1, 0)])
    with pytest.raises(Exception, match="arrived twice"):
        f.run()


def test_null_values_are_wrong_but_there(spark, tmp_dir):
    f = Folders(spark, tmp_dir)
    f.put("pred", [(1, None), (2, 1)])
    f.put("answer", [(1, 0), (2, 1)])
    assert f.run() == {(0, None): 1, (1, 1): 1}
    assert es.running_accuracy(spark, f"{tmp_dir}/out").first().accuracy == 0.5


def test_rows_are_dealt_out_before_they_are_grouped(spark, tmp_dir):
    f = Folders(spark, tmp_dir)
    f.put("pred", [(i, 1) for i in range(50)])
    f.put("answer", [(i, i % 2) for i in range(50)])
    q = es.run_evaluation(spark, f"{tmp_dir}/pred", f"{tmp_dir}/answer", f"{tmp_dir}/out", f"{tmp_dir}/ckpt", 1)
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    # one exchange, of the rows as they are read: no table of all examples of a file before it
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning"):]
