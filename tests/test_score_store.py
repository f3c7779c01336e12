import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relspark.operators import jobs, score_store
from relspark.session import scratch_path

SCHEMA = "example_id long, text string, text_pair string"


def make_scorer(more=0):
    def scorer(_model, batch: pd.DataFrame) -> np.ndarray:
        a, b = ([len("?" if x is None else x) + more for x in batch[c]] for c in ("text", "text_pair"))
        return np.array([a, b], dtype=float).T

    return scorer


scorer = make_scorer()


def rows(n=50):
    return [(i, f"text {i % 20}" if i % 11 else None, "p" * (i % 3)) for i in range(n)]


def run(store, df, fn=scorer, **kw):
    got = store.score(df, fn, ["text", "text_pair"], **kw)
    return sorted((r.example_id, r.variant, r.model_id, r.scores) for r in got.collect()), store.runs()[-1].n_scored


@pytest.fixture()
def place(spark):
    return scratch_path(spark, "score-store")


def expected(df):
    return sorted((r.example_id, r.variant, r.model_id, r.scores) for r in jobs.score_batches(df, scorer, ["text", "text_pair"]).collect())


def test_a_second_run_scores_nothing_and_a_changed_text_one(spark, place):
    store = score_store.ScoreStore(spark, place, buckets=4)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got, n = run(store, df)
    assert got == expected(df) and n == len({r[1:] for r in rows()})
    assert run(store, df) == (got, 0)
    changed = df.withColumn("text", F.when(F.col("example_id") == 7, "new").otherwise(F.col("text")))
    got, n = run(store, changed)
    assert got == expected(changed) and n == 1
    assert run(store, df.withColumn("extra", F.lit(1)))[1] == 0
    assert run(store, df, model_id="other")[1] == len({r[1:] for r in rows()})


def test_another_session_opens_the_store(spark, place):
    df = spark.createDataFrame(rows(), SCHEMA)
    first = score_store.ScoreStore(spark, place, buckets=4)
    got, _ = run(first, df)
    spark.sql(f"DROP TABLE {first.name}")  # what a new session's catalog knows; the files stay
    again = score_store.ScoreStore(spark, place, buckets=99)
    assert again.buckets == 4 and run(again, df) == (got, 0)


def test_a_run_that_is_not_committed_is_not_read(spark, place, monkeypatch):
    store = score_store.ScoreStore(spark, place, buckets=4)
    df = spark.createDataFrame(rows(), SCHEMA)

    def lost(self, name):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(score_store.ScoreStore, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            store.score(df, make_scorer(1), ["text", "text_pair"])
    assert spark.table(store.name).count() > 0 and store.rows().count() == 0
    assert run(store, df)[0] == expected(df)


def test_lookup_reads_the_store_without_a_shuffle(spark, place, capsys):
    store = score_store.ScoreStore(spark, place, buckets=4)
    run(store, spark.createDataFrame(rows(), SCHEMA))
    store.rows().explain()
    assert "Exchange" not in capsys.readouterr().out


def test_repeated_rows_share_one_score_and_nulls_differ_from_text(spark, place):
    store = score_store.ScoreStore(spark, place, buckets=2)
    many = [(1, "same", "x")] * 300 + [(2, None, "x"), (3, "-", "x"), (4, "", "x"), (5, "ab", "c"), (6, "a", "bc")]
    got, n = run(store, spark.createDataFrame(many, SCHEMA).repartition(4))
    assert n == 6 and len(got) == 305 and got[:300] == [(1, 0, "model", [4.0, 1.0])] * 300


def test_empty_table(spark, place):
    store = score_store.ScoreStore(spark, place, buckets=2)
    assert run(store, spark.createDataFrame([], SCHEMA)) == ([], 0)


def test_a_scoring_task_gets_a_bounded_share_of_the_features(spark, place, monkeypatch):
    monkeypatch.setattr(score_store, "TASK_BYTES", 1000)
    dealt, plain = [], score_store.score_batches

    def seen(df, *args, **kw):
        size = F.coalesce(F.length("text"), F.lit(0)) + F.length("text_pair")
        dealt.extend(r.b for r in df.groupBy(F.spark_partition_id()).agg(F.sum(size).alias("b")).collect())
        return plain(df, *args, **kw)

    monkeypatch.setattr(score_store, "score_batches", seen)
    many = [(i, None if i % 9 == 0 else f"{i:050d}", "é" * (i % 40)) for i in range(400)]
    df = spark.createDataFrame(many + many[:50], SCHEMA).coalesce(1)
    got, n = run(score_store.ScoreStore(spark, place, buckets=2), df)
    assert got == expected(df) and n == len({r[1:] for r in many})
    assert len(dealt) > 20 and max(dealt) < 4000
