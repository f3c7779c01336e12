import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.operators import batching, jobs

SCHEMA = "example_id long, n_tokens int, text string"


def rows(n=500, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([7, 7, 7, r.randrange(0, 60), r.randrange(1, 8)]), f"t{i}") for i in range(n)]


def greedy(rows, budget):
    """Packed one row after the other."""
    out, held, batch = {}, 0, 0
    for i, n, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if held and (held + 1) * max(n, 1) > budget:
            batch, held = batch + 1, 0
        out[i] = batch
        held += 1
    return out


@pytest.mark.parametrize("budget", [1, 20, 64, 1000, 10**6])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_batches_equal_packing_row_by_row(spark, budget, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
        got = batching.token_batches(df, budget)
        assert got.columns == ["example_id", "n_tokens", "text", "batch"]
        assert {r.example_id: r.batch for r in got.collect()} == greedy(rows(), budget)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plan_against_packing_over_many_histograms():
    r = random.Random(2)
    for _ in range(300):
        lengths = sorted(r.sample(range(0, 40), r.randrange(1, 8)))
        many = [(i, n, "") for n in lengths for i in range(r.randrange(1, 30))]
        many = [(i, n, "") for i, (_, n, _) in enumerate(many)]
        hist = [(n, sum(m == n for _, m, _ in many)) for n in lengths]
        budget = r.randrange(1, 120)
        want, got = list(greedy(many, budget).values()), []
        for (_, fill, first, following, cap), (_, n) in zip(batching.packing_plan(hist, budget), hist, strict=True):
            got += [first if i < fill else following + (i - fill) // cap for i in range(n)]
        assert got == want


def test_same_scores_and_every_row_once(spark):
    def score(_model, batch):
        assert (len(batch) * batch["n_tokens"].max() <= 64) or len(batch) == 1
        return np.stack([batch["text"].str.len(), batch["n_tokens"]], axis=1).astype(float)

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = batching.score_token_batches(batching.token_batches(df, 64), score, ["text", "n_tokens"])
    want = jobs.score_batches(df, lambda _m, b: np.stack([b["text"].str.len(), b["n_tokens"]], axis=1).astype(float), ["text", "n_tokens"])
    assert sorted((r.example_id, r.scores) for r in got.collect()) == sorted((r.example_id, r.scores) for r in want.collect())


def test_padding_share(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    r = batching.padding_report(batching.token_batches(df, 64)).first()
    batches = {}
    for i, n, _ in rows():
        batches.setdefault(greedy(rows(), 64)[i], []).append(n)
    padded = sum(len(b) * max(b) for b in batches.values())
    assert (r.n_rows, r.n_batches, r.n_tokens, r.n_padded) == (500, len(batches), sum(n for _, n, _ in rows()), padded)
    in_table_order = sum(max(n for _, n, _ in rows()[i : i + 8]) * 8 for i in range(0, 496, 8))
    assert r.padding_share == pytest.approx(1 - r.n_tokens / padded) and padded < in_table_order


def test_repeated_keys_empty_table_and_bad_input(spark):
    same = spark.createDataFrame([(1, 5, "x")] * 40 + [(None, 3, "y")], SCHEMA).repartition(4)
    got = batching.token_batches(same, 20).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == [1, *[4] * 10]
    assert batching.token_batches(same.where("example_id = 9"), 20).count() == 0
    with pytest.raises(ValueError, match="positive"):
        batching.token_batches(same, 0)
    with pytest.raises(Exception, match="no length"):
        batching.token_batches(same.withColumn("n_tokens", F.lit(None).cast("int")), 20)
