"""Label lookups, input builders, hypothesis expansion and pair encoding."""

import pytest

from relspark.plans.inspect import physical_plan
from pyspark.sql import functions as F

from relspark.operators import examples, inputs, labels, targets
from relspark.plans import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def small_dim(spark, n=5):
    rows = [(0, "no_relation")] + [(i, f"subj{i % 2}:attr{i}") for i in range(1, n)]
    return labels.label_dimension(spark.createDataFrame(rows, "label_id int, label_name string"))


def raw_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "example_id long, sentence string, entity_01 string, e1_s int, e1_e int, "
        "entity_02 string, e2_s int, e2_e int, relation string",
    )


def test_label_dimension_splits_and_checks(spark):
    dim = small_dim(spark).orderBy("label_id").collect()
    assert dim[0].subject_part is None and dim[0].attribute_part is None
    assert (dim[1].subject_part, dim[1].attribute_part) == ("subj1", "attr1")
    bad = spark.createDataFrame([(0, "none"), (1, "nocolon")], "label_id int, label_name string")
    with pytest.raises(Exception, match="without"):
        labels.label_dimension(bad).collect()
    dup = spark.createDataFrame([(0, "a"), (0, "b:c")], "label_id int, label_name string")
    with pytest.raises(ValueError, match="duplicate"):
        labels.label_stats(labels.label_dimension(dup))


def test_encode_label_blind_known_unknown(spark):
    dim = small_dim(spark)
    raw = raw_rows(
        spark,
        [(0, "a b", "a", 0, 0, "b", 2, 2, "subj1:attr1"), (1, "a b", "a", 0, 0, "b", 2, 2, "blind")],
    )
    got = {r.example_id: r.label for r in labels.encode_label(raw, dim).collect()}
    assert got == {0: 1, 1: 100}
    unk = raw_rows(spark, [(2, "a b", "a", 0, 0, "b", 2, 2, "no:such")])
    with pytest.raises(Exception, match="unknown relation"):
        labels.encode_label(unk, dim).collect()


def test_decode_label(spark):
    dim = small_dim(spark)
    df = spark.createDataFrame([(0, 1), (1, 100), (2, 77)], "example_id long, label int")
    got = {r.example_id: r.label_name for r in labels.decode_label(df, dim).collect()}
    assert got == {0: "subj1:attr1", 1: "blind", 2: None}


def test_project_rejects_null_entity(spark):
    dim = small_dim(spark)
    raw = raw_rows(spark, [(0, "a b", None, 0, 0, "b", 2, 2, "blind")])
    with pytest.raises(Exception, match="null entity_01"):
        examples.project_examples(raw, dim).collect()


def test_text_builders(spark):
    ex = spark.createDataFrame(
        [(7, "s t", "A", "B", 2)], "example_id long, sentence string, entity_01 string, entity_02 string, label int"
    )
    p = inputs.pair_input(ex).first()
    assert (p.text, p.text_pair, p.max_length, p.style) == ("A[SEP]B", "s t", 100, "pair")
    s = inputs.single_input(ex).first()
    assert (s.text, s.text_pair, s.max_length) == ("s t", None, 150)
    ts = inputs.two_sentence_input(ex).orderBy("variant").collect()
    assert [r.text_pair for r in ts] == ["A와 B은 무슨 관계인가?", "B와 A은 무슨 관계인가?"]
    assert all(r.text == "s t" for r in ts)
    tagged = ex.withColumn("tag_01", F.lit("PER")).withColumn("tag_02", F.lit("ORG"))
    t = inputs.typed_pair_input(tagged).first()
    assert t.text == "[E1][E1-NER]PER[E1-NER]A[E1][E2][E2-NER]ORG[E2-NER]B[E2]"
    assert t.max_length == 200


def test_hypothesis_expansion_counts_and_targets(spark):
    dim = small_dim(spark, 5)  # 4 relations -> 8 hypotheses per example
    ex = spark.createDataFrame(
        [(i, "s", "A", "B", lab) for i, lab in enumerate([0, 1, 4, 100])],
        "example_id long, sentence string, entity_01 string, entity_02 string, label int",
    )
    hyp = inputs.hypothesis_input(ex, dim)
    rows = hyp.collect()
    assert len(rows) == 4 * 2 * 4
    sums = {}
    for r in rows:
        sums[r.example_id] = sums.get(r.example_id, 0) + r.target
        assert r.variant == (r.label_id - 1) * 2 + r.direction
    assert sums == {0: 0, 1: 2, 2: 2, 3: 0}
    r = [x for x in rows if x.example_id == 1 and x.variant == 0][0]
    assert r.text_pair == "A의 attr1은 B인가?"
    r = [x for x in rows if x.example_id == 1 and x.variant == 1][0]
    assert r.text_pair == "B은 subj1 A의 attr1인가?"
    ht = targets.hypothesis_target(inputs.expand_hypotheses(ex, dim)).collect()
    assert sorted((x.example_id, x.variant) for x in ht if x.target == 1) == [(1, 0), (1, 1), (2, 6), (2, 7)]


def test_hypothesis_plan_streams_examples(spark):
    """The label side is broadcast and equi-joined; no nested-loop or cartesian join."""
    ex = examples.project_examples(fx.rel_examples(spark, SF_SMALL), fx.rel_labels(spark, SF_SMALL))
    hyp = inputs.hypothesis_input(ex, fx.rel_labels(spark, SF_SMALL))
    plan = physical_plan(hyp)
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_truncate(la, lb, budget):
    a, b = la, lb
    while a + b > budget:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_encode_pair_matches_one_at_a_time_truncation(spark):
    rows = []
    for la in range(0, 9):
        for lb in range(0, 9):
            rows.append((len(rows), " ".join(f"a{i}" for i in range(la)), " ".join(f"b{i}" for i in range(lb)), la, lb))
    df = spark.createDataFrame(rows, "example_id long, text string, text_pair string, la int, lb int")
    out = inputs.encode_pair(df, max_length=9, padding="max_length").collect()
    for r in out:
        if r.lb == 0:
            assert r.n_a == min(r.la, 7) and r.n_b == 0
            continue
        assert (r.n_a, r.n_b) == brute_truncate(r.la, r.lb, 6), (r.la, r.lb)
        assert len(r.tokens) == 9 and len(r.segment_ids) == 9 and len(r.attention_mask) == 9
        assert r.tokens[0] == "[CLS]" and r.tokens[r.n_a + 1] == "[SEP]"
        assert sum(r.attention_mask) == r.n_a + r.n_b + 3
        assert r.segment_ids[: r.n_a + 2] == [0] * (r.n_a + 2)


def test_encode_pair_longest_padding(spark):
    df = spark.createDataFrame([(0, "a b c", None), (1, "a", None)], "example_id long, text string, text_pair string")
    out = {r.example_id: r for r in inputs.encode_pair(df, max_length=50, padding="longest").collect()}
    assert len(out[0].tokens) == len(out[1].tokens) == 5
    assert out[1].attention_mask == [1, 1, 1, 0, 0]


def test_compact_statements_equal_row_form(spark):
    ex = examples.project_examples(fx.rel_examples(spark, SF_SMALL), fx.rel_labels(spark, SF_SMALL))
    dim = fx.rel_labels(spark, SF_SMALL)
    rows = inputs.hypothesis_input(ex, dim)
    compact = inputs.statements_to_rows(inputs.hypothesis_statements(ex, dim))
    assert compact.columns == rows.columns
    assert compact.exceptAll(rows).count() == 0 and rows.exceptAll(compact).count() == 0
    plan = physical_plan(inputs.hypothesis_statements(ex, dim))
    assert "Generate" not in plan and "explode" not in plan


def test_compact_scoring_equals_row_scoring(spark):
    import numpy as np

    from relspark.operators import jobs

    ex = examples.project_examples(fx.rel_examples(spark, SF_SMALL), fx.rel_labels(spark, SF_SMALL))
    dim = fx.rel_labels(spark, SF_SMALL)

    def model(_, batch):
        n = batch["text"].str.len().to_numpy() % 7 + batch["text_pair"].str.len().to_numpy() % 5
        return np.stack([n * 0.1, batch["label_id"].to_numpy() * 0.01 + batch["direction"].to_numpy()], axis=1)

    row = jobs.score_batches(
        inputs.hypothesis_input(ex, dim), model, ["text", "text_pair", "label_id", "direction"], batch_size=82
    ).select("example_id", "variant", "scores")
    cmp = jobs.score_statement_batches(inputs.hypothesis_statements(ex, dim), model).select(
        "example_id", "variant", "scores"
    )
    a = sorted((r.example_id, r.variant, tuple(r.scores)) for r in row.collect())
    b = sorted((r.example_id, r.variant, tuple(r.scores)) for r in cmp.collect())
    assert a == b and len(a) == ex.count() * 48


def test_null_inputs_raise(spark):
    raw = raw_rows(spark, [(0, "a b", "a", None, 0, "b", 2, 2, "blind")])
    with pytest.raises(Exception, match="missing or negative e1_s"):
        examples.mark_entities(raw, small_dim(spark)).collect()
    tagged = spark.createDataFrame(
        [(0, "s", "x", "y", None)], "example_id long, sentence string, entity_01 string, entity_02 string, label int"
    )
    with pytest.raises(Exception, match="null label"):
        examples.project_tagged(tagged).collect()
    with pytest.raises(Exception, match="outside target width"):
        targets.soft_target(tagged, 41).collect()
    with pytest.raises(Exception, match="outside target width"):
        targets.smoothed_target(tagged, 42).collect()


def test_whitespace_tokens_match_regex_split(spark):
    import re

    texts = ["", "   ", "a", " a  b\tc\n\nd \x0be\ff\r\ng  ", "x\u00a0y z", "\ttab lead", "trail \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.tok for r in df.select(inputs.whitespace_tokens(F.col("t")).alias("tok")).collect()]
    want = [[w for w in re.split("[ \t\n\x0b\f\r]+", t) if w] for t in texts]
    assert got == want
    assert got[3] == ["a", "b", "c", "d", "e", "f", "g"]


def test_duplicate_names_are_rejected_not_multiplied(spark):
    dim = labels.label_dimension(spark.createDataFrame([(0, "n"), (1, "a:b"), (2, "a:b")], "label_id int, label_name string"))
    raw = raw_rows(spark, [(0, "a b", "a", 0, 0, "b", 2, 2, "a:b")])
    with pytest.raises(ValueError, match="duplicate label_name"):
        labels.encode_label(raw, dim)


def test_unknown_relation_raises_whatever_is_selected(spark):
    raw = raw_rows(spark, [(0, "a b", "a", 0, 0, "b", 2, 2, "no:such")])
    ex = examples.project_examples(raw, small_dim(spark))
    with pytest.raises(Exception, match="unknown relation"):
        inputs.pair_input(ex).collect()
    with pytest.raises(Exception, match="unknown relation"):
        ex.count()


def test_encode_pair_rejects_a_length_without_room(spark):
    df = spark.createDataFrame([(0, "a", "b", 2)], "example_id long, text string, text_pair string, max_length int")
    with pytest.raises(ValueError):
        inputs.encode_pair(df, max_length=2)
    with pytest.raises(Exception, match="leave room"):
        inputs.encode_pair(df).collect()


def test_bounded_split_gives_the_same_cut(spark):
    rows = []
    for la in (0, 1, 5, 6, 7, 8, 20, 40):
        for lb in (0, 1, 5, 6, 7, 8, 20, 40):
            a, b = " ".join(f"a{i}" for i in range(la)), " ".join(f"b{i}" for i in range(lb))
            rows += [(len(rows) + k, lead + a, lead + b) for k, lead in enumerate(("", "  "))]
    df = spark.createDataFrame(rows, "example_id long, text string, text_pair string")
    own = inputs.encode_pair(df, max_length=10)
    full = inputs.encode_pair(df, max_length=10, tokens_a=inputs.whitespace_tokens(F.col("text")), tokens_b=inputs.whitespace_tokens(F.col("text_pair")))
    assert own.exceptAll(full).count() == 0 and full.exceptAll(own).count() == 0


TEXT_ONLY = [
    "pair_input", "single_input", "two_sentence_input", "typed_pair_input", "tag_entities", "encode_pair",
    "first_example", "score_hypotheses", "score_two_sentence", "expand_hypotheses",
]


@pytest.mark.parametrize("name", TEXT_ONLY)
def test_text_queries_read_no_labels(spark, name):
    from relspark.plans.registry import QUERIES

    plan = physical_plan(QUERIES[name](spark, SF_SMALL))
    assert "labels.parquet" not in plan
