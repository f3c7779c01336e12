"""Readers and writers: quoting, NA words, short rows, file positions, templates, configs,
prediction files, experiment checks and the streaming decoder."""

import json
import os

import pytest

from relspark.plans.inspect import physical_plan
from pyspark.sql import functions as F

from relspark.operators import experiments, labels
from relspark.plans import flows
from relspark.sources import files
from relspark.streaming import decode_stream as ds


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_raw_tsv_quoting_and_words(spark, tmp_dir):
    lines = [
        'r0\t"he said ""hi"""\tNA\t0\t1\tNone\t3\t4\tblind',
        "r1\tback\\slash text\tA\t0\t0\t\t2\t2\tblind",
        "r2\tplain\tx\t0\t0\ty\t2\t2\tblind",
    ]
    p = write(f"{tmp_dir}/raw/a.tsv", "\n".join(lines) + "\n")
    rows = {r.example_id: r for r in files.read_raw_examples(spark, p).collect()}
    assert rows[0].sentence == 'he said "hi"'
    assert rows[0].entity_01 == "NA" and rows[0].entity_02 == "None"
    assert rows[1].sentence == "back\\slash text"
    assert rows[1].entity_02 is None
    assert rows[2].row_tag == "r2"


def test_raw_tsv_short_row_failfast(spark, tmp_dir):
    p = write(f"{tmp_dir}/raw/short.tsv", "r0\tonly three\tcols\n")
    with pytest.raises(Exception):
        files.read_raw_examples(spark, p).collect()
    ok = files.read_raw_examples(spark, p, mode="PERMISSIVE").collect()
    assert ok[0].e1_s is None


def test_row_position_across_many_splits(spark, tmp_dir):
    n = 20000
    lines = [f"r{i}\tsentence number {i}\ta\t0\t0\tb\t2\t2\tblind" for i in range(n)]
    p = write(f"{tmp_dir}/big/a.tsv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = files.read_raw_examples(spark, p)
        assert df.rdd.getNumPartitions() > 5
        rows = df.select("example_id", "row_tag").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    assert all(r.row_tag == f"r{r.example_id}" for r in rows)


def test_tagged_csv_drops_header_and_casts_label(spark, tmp_dir):
    text = 'tag,sentence,e1,e2,label\n0,"a, b",x,y,3\n1,c d,u,v,0\n'
    p = write(f"{tmp_dir}/tagged/a.csv", text)
    rows = {r.example_id: r for r in files.read_tagged_examples(spark, p).collect()}
    assert rows[0].sentence == "a, b" and rows[0].label == 3 and rows[1].label == 0
    bad = write(f"{tmp_dir}/tagged/bad.csv", "h1,h2,h3,h4,h5\n0,s,x,y,notanint\n")
    with pytest.raises(Exception):
        files.read_tagged_examples(spark, bad).collect()


def test_round_trip_of_written_examples(spark, tmp_dir):
    df = spark.createDataFrame(
        [("r0", 'q "x" \\ y', "q", 0, 0, "y", 9, 9, "blind")],
        "row_tag string, sentence string, entity_01 string, e1_s int, e1_e int, "
        "entity_02 string, e2_s int, e2_e int, relation string",
    )
    files.write_raw_examples(df, f"{tmp_dir}/rt")
    back = files.read_raw_examples(spark, f"{tmp_dir}/rt").first()
    assert back.sentence == 'q "x" \\ y'


def test_templates(spark, tmp_dir):
    text = "\n".join(
        [
            "{",
            "  'none': 0,",
            "  'p:spouse': 1, \"'s spouse?\", \"'s spouse?\" \"{1} spouse {2}?\" \"{2} spouse {1}?\"",
            "  'p:job': 2, \"'s job?\" \" job holder?\"",
            "  'o:age': 3 \"'s age?\", \"of age?\"}",
        ]
    )
    p = write(f"{tmp_dir}/tpl/template.txt", text)
    rows = {r.label_id: r for r in files.read_templates(spark, p).collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert rows[0].forward is None and rows[0].extra == []
    assert rows[1].extra == ["{1} spouse {2}?", "{2} spouse {1}?"]
    assert (rows[2].forward, rows[2].reverse) == ("'s job?", " job holder?")
    assert rows[3].label_name == "o:age" and rows[3].reverse == "of age?"
    for lost in ('  "double": 4, "a"', "  'o:name': x, \"a\""):
        bad = write(f"{tmp_dir}/tpl_bad/{len(lost)}.txt", "{\n" + lost + "\n}\n")
        with pytest.raises(Exception, match="not a template line"):
            files.read_templates(spark, bad).collect()


def test_experiments(spark, tmp_dir):
    full = {
        "seed": 7, "MODEL_NAME": "m", "output_dir": "./o/a", "logging_dir": "./l/a", "EPOCH": 2,
        "optimizer": "SGD", "learning_rate": 0.25, "batch_size": 4, "rtq": "off",
        "two_sentence": "off", "except_0": "off", "entity_token": "on",
    }
    confs = {
        "c1.json": {"MODEL_NAME": "m"},
        "c2.json": full,
        "c3.json": {**full, "output_dir": "./o/a", "logging_dir": "./l/b", "entity_token": "off"},
        "c4.json": {**full, "output_dir": "./o/c", "logging_dir": "./l/c", "rtq": "on", "except_0": "on"},
        "c5.json": {**full, "output_dir": "./o/d", "logging_dir": "./l/d", "two_sentence": "on", "except_0": "on"},
        "c6.json": {**full, "output_dir": "./o/e", "logging_dir": "./other/d", "two_sentence": "on"},
    }
    for name, c in confs.items():
        write(f"{tmp_dir}/conf/{name}", json.dumps(c, indent=2))
    plan = {r.file: r for r in experiments.experiment_plan(files.read_experiments(spark, f"{tmp_dir}/conf")).collect()}
    assert len(plan["c1.json"].missing_keys) == 11 and not plan["c1.json"].ok
    assert plan["c2.json"].duplicate_output_dir and plan["c3.json"].duplicate_output_dir
    assert plan["c4.json"].conflict and plan["c4.json"].num_labels == 2
    assert plan["c2.json"].style == "typed_pair" and plan["c3.json"].style == "pair"
    assert plan["c4.json"].style == "hypothesis" and plan["c4.json"].decoder == "hypothesis_decode"
    assert plan["c5.json"].decoder == "pair_soft_vote" and plan["c5.json"].num_labels == 41
    assert plan["c2.json"].decoder == "argmax_decode" and plan["c2.json"].run_name == "a_2"
    # both would write predictions under the name d_2
    assert plan["c5.json"].duplicate_run_name and plan["c6.json"].duplicate_run_name and not plan["c5.json"].ok
    # a missing flag is not "off"
    assert plan["c1.json"].num_labels is None and plan["c1.json"].style is None and plan["c1.json"].decoder is None
    write(f"{tmp_dir}/broken/x.json", '{"MODEL_NAME": ')
    with pytest.raises(Exception):
        files.read_experiments(spark, f"{tmp_dir}/broken").collect()


def test_predictions_positional_and_keyed(spark, tmp_dir):
    write(f"{tmp_dir}/preds/m1.csv", "pred\n1\n2\n3\n")
    write(f"{tmp_dir}/preds/m2.csv", "pred\n1\n0\n3\n")
    df = files.read_predictions(spark, [f"{tmp_dir}/preds/m1.csv", f"{tmp_dir}/preds/m2.csv"])
    got = sorted((r.model_id, r.example_id, r.pred) for r in df.collect())
    assert got == [("m1", 0, 1), ("m1", 1, 2), ("m1", 2, 3), ("m2", 0, 1), ("m2", 1, 0), ("m2", 2, 3)]
    keyed = df.filter("model_id = 'm1'").select("example_id", "pred")
    files.write_predictions(keyed, f"{tmp_dir}/out")
    with pytest.raises(Exception):
        files.write_predictions(keyed, f"{tmp_dir}/out")
    back = files.read_keyed_predictions(spark, f"{tmp_dir}/out")
    answers = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "example_id long, answer int")
    assert abs(flows.evaluate(back, answers).first().accuracy - 2 / 3) < 1e-12
    # files of unequal length cannot be aligned
    write(f"{tmp_dir}/preds/short.csv", "pred\n1\n")
    short = files.read_predictions(spark, f"{tmp_dir}/preds/short.csv").select("example_id", "pred")
    with pytest.raises(Exception, match="differ in length"):
        flows.evaluate(short, answers).collect()


def test_load_test_dataset_flow(spark, tmp_dir):
    dim = labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "p:spouse"), (2, "p:job")], "label_id int, label_name string")
    )
    p = write(f"{tmp_dir}/flow/test.tsv", "t\tA met B\tA\t0\t0\tB\t6\t6\tp:job\nt\tC saw D\tC\t0\t0\tD\t6\t6\tblind\n")
    pair = flows.load_test_dataset(spark, p, dim).orderBy("example_id").collect()
    assert [r.text for r in pair] == ["A[SEP]B", "C[SEP]D"]
    hyp = flows.load_test_dataset(spark, p, dim, style="hypothesis")
    assert hyp.count() == 2 * 2 * 2
    assert hyp.agg(F.sum("target")).first()[0] == 2


def test_streaming_per_row_decoder(spark, tmp_dir):
    src = f"{tmp_dir}/scores_in"
    df = spark.createDataFrame(
        [(0, 0, "m", [0.1, 0.9]), (1, 0, "m", [0.8, 0.2])],
        "example_id long, variant int, model_id string, scores array<double>",
    )
    df.write.parquet(src)
    stream = ds.decode_stream(ds.read_score_stream(spark, src), "argmax_decode")
    q = ds.write_prediction_stream(stream, f"{tmp_dir}/scores_out", f"{tmp_dir}/ckpt", available_now=True)
    q.awaitTermination(120)
    got = {r.example_id: r.pred for r in spark.read.parquet(f"{tmp_dir}/scores_out").collect()}
    assert got == {0: 1, 1: 0}
    with pytest.raises(ValueError):
        ds.decode_stream(stream, "ensemble_soft_vote")


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"accuracy", "n"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert not {k for k in set(q) - set(o) if not k.startswith("op") and k != "pipeline"}


def test_label_dimension_file(spark, tmp_dir):
    p = write(f"{tmp_dir}/labels/labels.csv", "label_id,label_name\n0,none\n1,p:spouse\n2,o:members\n")
    dim = {r.label_id: r for r in files.read_label_dimension(spark, p).collect()}
    assert dim[2].subject_part == "o" and dim[2].attribute_part == "members"


def test_row_position_dir_scope_over_multipart_output(spark, tmp_dir):
    df = spark.range(0, 5000).select(F.col("id").cast("int").alias("pred"))
    df.repartitionByRange(6, "pred").sortWithinPartitions("pred").write.csv(f"{tmp_dir}/mp/m7", header=True)
    out = files.read_predictions(spark, f"{tmp_dir}/mp/m7", scope="dir").collect()
    assert len(out) == 5000
    assert all(r.example_id == r.pred and r.model_id == "m7" for r in out)


def test_score_hypotheses_flow(spark):
    import numpy as np

    dim = labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "p:spouse"), (2, "p:job")], "label_id int, label_name string")
    )
    ex = spark.createDataFrame(
        [(0, "s", "A", "B", 2), (1, "s", "C", "D", 1)],
        "example_id long, sentence string, entity_01 string, entity_02 string, label int",
    )

    def oracle_model(_, batch):
        # "yes" exactly on relation 2 for entity A, relation 1 otherwise
        yes = np.where(
            (batch["text_pair"].str.contains("A")) == (batch["label_id"] == 2), 4.0, -4.0
        )
        return np.stack([-yes, yes], axis=1)

    out = {r.example_id: r.pred for r in flows.score_hypotheses(ex, dim, oracle_model).collect()}
    assert out == {0: 2, 1: 1}


def test_broadcast_fallback_gives_same_result(spark):
    from relspark.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    ex, dim = fx.rel_examples(spark, d), fx.rel_labels(spark, d)
    a = labels.encode_label(ex, dim).select("example_id", "label")
    assert "BroadcastHashJoin" in physical_plan(a)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        # a dimension over the size bound is not hinted: the join becomes a shuffle join
        b = labels.encode_label(ex, dim, max_broadcast_bytes=0).select("example_id", "label")
        plan = physical_plan(b)
        got_b = sorted(map(tuple, b.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert sorted(map(tuple, a.collect())) == got_b


def test_blank_lines_and_reject_table(spark, tmp_dir):
    text = "r0\ta b\ta\t0\t0\tb\t2\t2\tblind\n\nr1\tc d\tc\t0\t0\td\t2\t2\tblind\nr2\tshort\n"
    p = write(f"{tmp_dir}/rej/a.tsv", text)
    df = files.read_raw_examples(spark, p, mode="PERMISSIVE")
    good, bad = files.split_rejects(df)
    assert sorted((r.example_id, r.row_tag) for r in good.select("example_id", "row_tag").collect()) == [
        (0, "r0"),
        (1, "r1"),
    ]
    assert [(r.example_id, r.row_tag) for r in bad.select("example_id", "row_tag").collect()] == [(2, "r2")]


def test_tagger_contract(spark):
    from relspark.operators import jobs

    ex = spark.createDataFrame([(0, "x", "A", "b")], "example_id long, sentence string, entity_01 string, entity_02 string")
    none_for_lower = lambda c: F.when(c.rlike("^[A-Z]"), F.lit("CAP"))
    with pytest.raises(Exception, match="no tag for entity: b"):
        jobs.tag_entities(ex, tagger=none_for_lower).collect()
    r = jobs.tag_entities(ex, tagger=none_for_lower, default_tag="O").first()
    assert (r.tag_01, r.tag_02) == ("CAP", "O")


def test_predictions_partitioned_by_run_name(spark, tmp_dir):
    df = spark.createDataFrame(
        [(0, 1, "./logs/conf3_x"), (1, 2, "./logs/conf3_x"), (0, 5, "./logs/conf9_y")],
        "example_id long, pred int, logging_dir string",
    ).withColumn("run", files.run_name("logging_dir"))
    files.write_predictions(df, f"{tmp_dir}/runs", partition_col="run")
    assert sorted(d for d in os.listdir(f"{tmp_dir}/runs") if d.startswith("run=")) == [
        "run=conf3_x_2",
        "run=conf9_y_2",
    ]
    back = files.read_keyed_predictions(spark, f"{tmp_dir}/runs/run=conf9_y_2").collect()
    assert [(r.example_id, r.pred) for r in back] == [(0, 5)]


def test_decode_label_rejects_duplicate_ids(spark):
    dim = labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "a:b"), (1, "c:d")], "label_id int, label_name string")
    )
    df = spark.createDataFrame([(0, 1)], "example_id long, label int")
    with pytest.raises(ValueError, match="duplicate"):
        labels.decode_label(df, dim)


def test_streaming_input_builder(spark, tmp_dir):
    dim = labels.label_dimension(
        spark.createDataFrame([(0, "none"), (1, "p:spouse")], "label_id int, label_name string")
    )
    src = f"{tmp_dir}/ex_in"
    spark.createDataFrame(
        [("t", "A met B", "A", 0, 0, "B", 6, 6, "p:spouse", 10), ("t", "C saw D", "C", 0, 0, "D", 6, 6, "blind", 11)],
        "row_tag string, sentence string, entity_01 string, e1_s int, e1_e int, entity_02 string, "
        "e2_s int, e2_e int, relation string, example_id long",
    ).write.parquet(src)
    stream = ds.pair_input_stream(ds.read_raw_example_stream(spark, src), dim)
    q = ds.write_prediction_stream(stream, f"{tmp_dir}/ex_out", f"{tmp_dir}/ex_ckpt", available_now=True)
    q.awaitTermination(120)
    got = {r.example_id: (r.text, r.text_pair) for r in spark.read.parquet(f"{tmp_dir}/ex_out").collect()}
    assert got == {10: ("A[SEP]B", "A met B"), 11: ("C[SEP]D", "C saw D")}


def test_row_position_per_file_with_many_splits_each(spark, tmp_dir):
    paths = []
    for k, n in enumerate([7000, 3000, 5000]):
        lines = [f"f{k}r{i}\ts {i}\ta\t0\t0\tb\t2\t2\tblind" for i in range(n)]
        paths.append(write(f"{tmp_dir}/multi/part{k}.tsv", "\n".join(lines) + "\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = files.read_raw_examples(spark, f"{tmp_dir}/multi")
        assert df.rdd.getNumPartitions() > 6
        rows = df.select("example_id", "row_tag").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 15000
    assert all(r.row_tag.split("r")[1] == str(r.example_id) for r in rows)


def test_parts_are_ordered_by_their_number(spark, tmp_dir):
    """Part 100000 comes after part 99999, and no job runs beyond the one that counts the splits."""
    for k, rows in {99998: [0, 1], 99999: [2], 100000: [3, 4], 100001: [5]}.items():
        write(f"{tmp_dir}/parts/m/part-{k:05d}-x.csv", "pred\n" + "".join(f"{r}\n" for r in rows))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reader", "reader")
    df = files.read_predictions(spark, f"{tmp_dir}/parts/m", scope="dir")
    jobs = len(tracker.getJobIdsForGroup("reader"))
    spark.sparkContext.setJobGroup("other", "other")
    assert all(r.example_id == r.pred for r in df.collect())
    assert jobs <= 3  # one action; AQE submits its shuffle stages as jobs of their own


def test_quoted_line_breaks(spark, tmp_dir):
    p = write(f"{tmp_dir}/breaks/a.tsv", 'r0\t"a\nb ""q"""\ta\t0\t0\tb\t2\t2\tblind\nr1\tc d\tc\t0\t0\td\t2\t2\tblind\n')
    rows = {r.example_id: r.sentence for r in files.read_raw_examples(spark, p, quoted_breaks=True).collect()}
    assert rows == {0: 'a\nb "q"', 1: "c d"}


def test_positional_predictions_round_trip(spark, tmp_dir):
    df = spark.range(0, 3000, 1, 7).select(F.col("id").alias("example_id"), (F.col("id") * 7 % 13).cast("int").alias("pred"))
    files.write_positional_predictions(df.orderBy(F.rand(1)), f"{tmp_dir}/pos/run_2")
    back = files.read_predictions(spark, f"{tmp_dir}/pos/run_2", scope="dir").collect()
    assert len(back) == 3000 and all(r.pred == r.example_id * 7 % 13 and r.model_id == "run_2" for r in back)
    with pytest.raises(Exception):
        files.write_positional_predictions(df, f"{tmp_dir}/pos/run_2")


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from relspark import session

    conf = SimpleNamespace(get=lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, applicationId="x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
