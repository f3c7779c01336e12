import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from relspark.operators import resample


def tables(spark, n=300, right=0.7):
    r = random.Random(3)
    answers = {i: r.randrange(4) for i in range(n)}
    scores = [(i, m, [1.0 if c == (a if r.random() < right else (a + 1) % 4) else 0.0 for c in range(4)]) for i, a in answers.items() for m in "ab"]
    s = spark.createDataFrame(scores, "example_id long, model_id string, scores array<double>").repartition(4)
    return s, spark.createDataFrame(list(answers.items()), "example_id long, answer int"), scores, answers


def brute(scores, answers, model, replicates, level):
    bounds = [math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
    hits = {i: x.index(max(x)) == answers[i] for i, m, x in scores if m == model}
    got = []
    for b in range(replicates):
        total = good = 0
        for i, hit in hits.items():
            u = int(hashlib.md5(f"{i}:{b // 8}".encode()).hexdigest()[4 * (b % 8) : 4 * (b % 8) + 4], 16)
            w = sum(u >= t for t in bounds)
            total, good = total + w, good + w * hit
        if total:
            got.append(good / total)
    got.sort()
    tail = (1 - level) / 2
    return sum(hits.values()) / len(hits), *(got[max(math.ceil(len(got) * q - 1e-9), 1) - 1] for q in (tail, 1 - tail)), len(hits)


@pytest.mark.parametrize("replicates,level", [(96, 0.95), (8, 0.5), (40, 0.9)])
def test_interval_equals_drawing_row_by_row(spark, replicates, level):
    s, a, scores, answers = tables(spark)
    got = {r.model_id: tuple(r)[1:] for r in resample.accuracy_interval(s, a, ["a", "b"], replicates, level).collect()}
    assert got == {m: pytest.approx(brute(scores, answers, m, replicates, level)) for m in "ab"}


def test_interval_is_about_that_of_the_normal_approximation(spark):
    s, a, *_ = tables(spark, n=2000)
    for r in resample.accuracy_interval(s, a, ["a", "b"], 400).collect():
        half = 1.96 * math.sqrt(r.accuracy * (1 - r.accuracy) / r.n)
        assert r.low < r.accuracy < r.high and 0.8 < (r.high - r.low) / (2 * half) < 1.2


def test_partitioning_does_not_matter(spark):
    s, a, *_ = tables(spark)
    one, two = (sorted(map(tuple, resample.accuracy_interval(s.repartition(n), a.repartition(n), ["a", "b"]).collect())) for n in (1, 9))
    assert one == two


def test_bad_input(spark):
    s, a, *_ = tables(spark, n=10)
    with pytest.raises(ValueError, match="multiple"):
        resample.accuracy_interval(s, a, ["a", "b"], 10)
    with pytest.raises(Exception, match="each once"):
        resample.accuracy_interval(s.where("not (example_id = 1 and model_id = 'b')"), a, ["a", "b"]).collect()
    assert resample.accuracy_interval(s.where("example_id < 0"), a.where("example_id < 0"), ["a", "b"]).count() == 0
    one = resample.accuracy_interval(s.where("example_id = 3"), a.where("example_id = 3"), ["a", "b"]).first()
    assert one.low == one.high == one.accuracy
