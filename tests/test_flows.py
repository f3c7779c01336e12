"""Compositions: input style and decoder dispatch, experiment-driven choice."""

import pytest
from pyspark.sql import functions as F

from relspark.operators import decode, labels
from relspark.plans import flows


def dim(spark):
    return labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "p:spouse"), (2, "p:job")], "label_id int, label_name string")
    )


def examples(spark):
    return spark.createDataFrame(
        [(0, "A met B", "A", "B", 1), (1, "C saw D", "C", "D", 0)],
        "example_id long, sentence string, entity_01 string, entity_02 string, label int",
    )


@pytest.mark.parametrize(
    "style,rows_per_example",
    [("pair", 1), ("single", 1), ("two_sentence", 2), ("hypothesis", 4), ("typed_pair", 1)],
)
def test_build_inputs_dispatch(spark, style, rows_per_example):
    tagger = (lambda c: F.lit("T")) if style == "typed_pair" else None
    out = flows.build_inputs(examples(spark), style, dim=dim(spark), tagger=tagger)
    assert out.count() == 2 * rows_per_example


def test_build_inputs_rejects_unknown_style(spark):
    with pytest.raises(ValueError):
        flows.build_inputs(examples(spark), "nope")


def test_decode_scores_dispatch(spark):
    s = spark.createDataFrame(
        [(0, 0, "m", [0.1, 2.0, 0.3]), (0, 1, "m", [0.2, 1.5, 0.1])],
        "example_id long, variant int, model_id string, scores array<double>",
    )
    by_name = {r.variant: r.pred for r in flows.decode_scores(s, "argmax_decode").collect()}
    assert by_name == {r.variant: r.pred for r in decode.argmax_decode(s).collect()} == {0: 1, 1: 1}
    assert flows.decode_scores(s, "pair_soft_vote").first().pred == 1
    assert {r.pred for r in flows.decode_scores(s, "threshold_decode", threshold=0.5).collect()} == {2}
    with pytest.raises(ValueError):
        flows.decode_scores(s, "nope")


def test_evaluate_positional_files(spark, tmp_path):
    (tmp_path / "pred.csv").write_text("pred\n1\n2\n3\n4\n")
    (tmp_path / "answer.csv").write_text("answer\n1\n2\n0\n4\n")
    (tmp_path / "short.csv").write_text("answer\n1\n2\n")
    r = flows.evaluate_files(spark, str(tmp_path / "pred.csv"), str(tmp_path / "answer.csv")).first()
    assert r.accuracy == 0.75 and r.n == 4
    with pytest.raises(Exception, match="differ in length"):
        flows.evaluate_files(spark, str(tmp_path / "pred.csv"), str(tmp_path / "short.csv")).collect()


def test_score_batches_rectangular_and_ragged(spark):
    import numpy as np

    from relspark.operators import jobs

    df = spark.range(0, 250).select(F.col("id").alias("example_id"), (F.col("id") % 7).cast("double").alias("x"))
    rect = jobs.score_batches(df, lambda _, b: np.stack([b["x"].to_numpy(), -b["x"].to_numpy()], axis=1), ["x"])
    got = {r.example_id: r.scores for r in rect.collect()}
    assert len(got) == 250 and got[10] == [3.0, -3.0]
    ragged = jobs.score_batches(df, lambda _, b: [[v] * (int(v) + 1) for v in b["x"]], ["x"], batch_size=7)
    got = {r.example_id: r.scores for r in ragged.collect()}
    assert got[3] == [3.0] * 4 and got[7] == [0.0]


def test_two_sentence_compact_equals_row_form(spark):
    import numpy as np

    from relspark.operators import inputs, jobs
    from relspark.plans import fixtures as fx
    from relspark.plans.registry import fixture_question_scores

    d = "/root/testdata/sf0.001"
    ex = flows.examples.project_examples(fx.rel_examples(spark, d), fx.rel_labels(spark, d))
    row_scores = jobs.score_batches(inputs.two_sentence_input(ex), fixture_question_scores, ["text_pair", "variant"])
    row = {r.example_id: r.pred for r in decode.pair_soft_vote(row_scores, width=3).collect()}
    cmp = {r.example_id: r.pred for r in flows.score_two_sentence(ex, fixture_question_scores).collect()}
    assert row == cmp and len(cmp) == ex.count()
    plan = flows.score_two_sentence(ex, fixture_question_scores)
    from relspark.plans.inspect import physical_plan

    text = physical_plan(plan, "simple")
    assert "HashAggregate" not in text and "Generate" not in text
    bad = spark.createDataFrame([(0, [[1.0, 2.0]])], "example_id long, scores array<array<double>>")
    with pytest.raises(Exception, match="two equally wide"):
        decode.pair_soft_vote_compact(bad).collect()


def test_tag_entities_with_a_hot_entity(spark):
    """One entity on a third of the rows: the tagger sees each distinct entity once, and every
    row still gets its tags."""
    import pandas as pd

    from relspark.operators import jobs

    n = 30000
    ex = spark.range(0, n, 1, 12).select(
        F.col("id").alias("example_id"),
        F.lit("s").alias("sentence"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("entity_01"),
        F.lit("tail").alias("entity_02"),
    )
    seen = spark.sparkContext.accumulator(0)

    def tagger(s: pd.Series) -> pd.Series:
        seen.add(len(s))
        return s.str.slice(0, 1)

    out = jobs.tag_entities(ex, pandas_tagger=tagger)
    # the entity join carries no text: the sentence is only joined by example_id
    from relspark.plans.inspect import physical_plan

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical_plan(jobs.tag_entities(ex, pandas_tagger=tagger))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(coalesce(entity" in plan.replace("(coalesce(", "(coalesce(") and "hashpartitioning(entity_01" not in plan
    seen.value = 0
    out = jobs.tag_entities(ex, pandas_tagger=tagger)
    rows = out.groupBy("tag_01", "tag_02").count().collect()
    assert {(r.tag_01, r.tag_02): r["count"] for r in rows} == {("H", "t"): n // 3, ("e", "t"): n - n // 3}
    # distinct entities: HOT, tail and the 20000 others
    assert seen.value == 2 + (n - n // 3)


def test_file_loaders(spark, tmp_path):
    dim = labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "p:spouse")], "label_id int, label_name string")
    )
    raw = tmp_path / "raw.tsv"
    raw.write_text("t\tAB met CD\tAB\t0\t1\tCD\t7\t8\tp:spouse\n")
    marked = flows.load_marked_examples(spark, str(raw), dim).first()
    assert marked.sentence == "[E1]AB[/E1] met [E2]CD[/E2]" and marked.label == 1
    tagged = tmp_path / "tagged.csv"
    tagged.write_text("tag,sentence,e1,e2,label\n0,AB met cd,AB,cd,1\n")
    typed = flows.tagged_test_dataset(
        spark, str(tagged), lambda c: F.when(c.rlike("^[A-Z]"), F.lit("ORG")).otherwise(F.lit("O"))
    ).first()
    assert typed.text == "[E1][E1-NER]ORG[E1-NER]AB[E1][E2][E2-NER]O[E2-NER]cd[E2]"
    assert typed.text_pair == "AB met cd" and typed.max_length == 200


def test_two_loaders_of_one_factory_are_two_models(spark):
    import numpy as np

    from relspark.operators import jobs

    def loader(c):
        return lambda: c

    df = spark.range(0, 20).select(F.col("id").alias("example_id"), F.col("id").cast("double").alias("x"))
    score = lambda c, b: np.stack([b["x"].to_numpy() * c], axis=1)
    one = jobs.score_batches(df, score, ["x"], load_fn=loader(2.0)).collect()
    two = jobs.score_batches(df, score, ["x"], load_fn=loader(3.0)).collect()
    assert {r.example_id: r.scores[0] for r in one} == {i: 2.0 * i for i in range(20)}
    assert {r.example_id: r.scores[0] for r in two} == {i: 3.0 * i for i in range(20)}


def test_typed_loader_with_a_model_tagger(spark, tmp_path):
    tagged = tmp_path / "tagged.csv"
    tagged.write_text("tag,sentence,e1,e2,label\n0,AB met cd,AB,cd,1\n")
    got = flows.tagged_test_dataset(
        spark, str(tagged), pandas_tagger=lambda m, s: s.str.isupper().map(m), load_fn=lambda: {True: "ORG", False: "O"}
    ).first()
    assert got.text == "[E1][E1-NER]ORG[E1-NER]AB[E1][E2][E2-NER]O[E2-NER]cd[E2]"


def test_ensemble_of_files_fails_on_unequal_lengths(spark, tmp_path):
    import numpy as np

    raw, tagged = tmp_path / "raw.tsv", tmp_path / "tagged.csv"
    raw.write_text("t\tA met B\tA\t0\t0\tB\t6\t6\tp:job\nt\tC saw D\tC\t0\t0\tD\t6\t6\tblind\n")
    tagged.write_text("tag,sentence,e1,e2,label\n0,A met B,A,B,2\n0,C saw D,C,D,100\n")
    score = lambda c, b: np.stack([np.full(len(b), c), b["text"].str.len().to_numpy() * 0.1], axis=1)
    run = lambda path, out: flows.ensemble_files(
        spark, str(raw), str(path), dim(spark), {"a": lambda: 0.5, "b": lambda: 1.0}, {"c": lambda: 2.0}, score,
        lambda s: s.str.slice(0, 1), str(tmp_path / out), width=2)
    assert run(tagged, "out").count() == 2
    short = tmp_path / "short.csv"
    short.write_text("tag,sentence,e1,e2,label\n0,A met B,A,B,2\n")
    with pytest.raises(Exception, match="expected 3 models"):
        run(short, "out2").count()
