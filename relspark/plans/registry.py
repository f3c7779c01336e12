"""Registered queries: each operator run over the fixture tables derived from the driver
data, named as in the operator inventory.  Every callable takes ``(spark, sf_dir)`` and
returns a lazy DataFrame whose columns match :data:`relspark.plans.oracle.ORACLE`.

Array outputs are exploded to ``(key, pos, value)`` rows and doubles rounded to 6 places so
that the result can be compared value by value with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import argmax, sigmoid_array, softmax
from ..operators import batching, decode, examples, experiments, inputs, jobs, labels, metrics, resample, score_store, subwords, sweep, tagger, targets, training
from ..session import scratch_path
from ..sources import files
from ..streaming import evaluate_stream
from . import fixtures as fx
from . import flows
from .oracle import ASCII_HYPOTHESES, ASCII_TWO_SENTENCE

Query = Callable[[SparkSession, str], DataFrame]


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return labels.encode_label(fx.rel_examples(spark, d), fx.rel_labels(spark, d))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return examples.project_examples(fx.rel_examples(spark, d), fx.rel_labels(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Sentence and entities for builders whose output has no label: one scan, no join."""
    return examples.project_texts(fx.rel_texts(spark, d))


MODEL_IDS = [str(m) for m in range(fx.N_MODELS)]


def _explode_vector(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("pos", "value")).select(
        *keys, F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value")
    )


def fixture_tagger(c):
    """Tagger of the fixture: an initial capital letter -> CAP, otherwise LOW."""
    return F.when(c.rlike("^[A-Z]"), F.lit("CAP")).otherwise(F.lit("LOW"))


def fixture_pandas_tagger(s: pd.Series) -> pd.Series:
    return pd.Series(np.where(s.str.match(r"^[A-Z]"), "CAP", "LOW"), index=s.index)


def load_fixture_tagger() -> dict[bool, str]:
    return {True: "CAP", False: "LOW"}


def fixture_model_tagger(model: dict[bool, str], s: pd.Series) -> pd.Series:
    """The same tags by a loaded model."""
    return s.str.match(r"^[A-Z]").map(model)


# --- projections and label lookups ---------------------------------------------------------


def q_project_examples(spark, d):
    return _examples(spark, d)


def q_encode_label(spark, d):
    return _encoded(spark, d).select("example_id", "relation", "label")


def q_decode_label(spark, d):
    enc = _encoded(spark, d).select("example_id", "label")
    return labels.decode_label(enc, fx.rel_labels(spark, d)).select("example_id", "label", "label_name")


def q_is_blind(spark, d):
    ex = fx.rel_examples(spark, d)
    return ex.select("example_id", "relation", labels.is_blind("relation").alias("is_blind"))


def q_example_filter_none(spark, d):
    enc = _encoded(spark, d).select("example_id", "label")
    return labels.example_filter_none(enc, label_col="label")


def q_mark_entities(spark, d):
    return examples.mark_entities(fx.rel_examples(spark, d), fx.rel_labels(spark, d))


# --- model inputs ---------------------------------------------------------------------------


def q_pair_input(spark, d):
    return inputs.pair_input(_texts(spark, d))


def q_single_input(spark, d):
    return inputs.single_input(_texts(spark, d))


def q_two_sentence_input(spark, d):
    return inputs.two_sentence_input(_texts(spark, d), template=ASCII_TWO_SENTENCE)


def q_tag_entities(spark, d):
    tagged = jobs.tag_entities(_texts(spark, d), pandas_tagger=fixture_pandas_tagger)
    return tagged.select("example_id", "entity_01", "tag_01", "entity_02", "tag_02")


def q_typed_pair_input(spark, d):
    """Tags by a loaded model: each distinct entity once, joined back without the text."""
    return flows.build_inputs(
        _texts(spark, d), inputs.STYLE_TYPED_PAIR, pandas_tagger=fixture_model_tagger, load_fn=load_fixture_tagger
    )


def q_tag_paths(spark, d):
    """A tagger learned from tagged names; the path and the tag of every distinct entity."""
    found = tagger.tag_paths(fx.rel_entity_names(spark, d), tagger.fit_tagger(fx.rel_tagged_tokens(spark, d)))
    return found.select("entity", F.array_join("tags", " ").alias("tags"), "tag")


def q_expand_hypotheses(spark, d):
    ex = _texts(spark, d).select("example_id")
    return inputs.expand_hypotheses(ex, fx.rel_labels(spark, d)).select(
        "example_id", "variant", "label_id", "direction", "subject_part", "attribute_part"
    )


def q_hypothesis_input(spark, d):
    return inputs.hypothesis_input(
        _examples(spark, d), fx.rel_labels(spark, d), templates=ASCII_HYPOTHESES
    )


def q_hypothesis_statements(spark, d):
    """Compact hypothesis form (sentence once per example), laid back out as rows."""
    compact = inputs.hypothesis_statements(
        _examples(spark, d), fx.rel_labels(spark, d), templates=ASCII_HYPOTHESES
    )
    return inputs.statements_to_rows(compact)


def q_encode_pair(spark, d):
    enc = inputs.encode_pair(inputs.pair_input(_texts(spark, d)), padding="max_length")
    return enc.select(
        "example_id",
        "n_a",
        "n_b",
        F.size("tokens").cast("int").alias("n_tokens"),
        F.array_join("tokens", " ").alias("input_text"),
        F.array_join(F.transform("segment_ids", lambda s: s.cast("string")), "").alias("segments"),
        F.array_join(F.transform("attention_mask", lambda s: s.cast("string")), "").alias("mask"),
    )


def q_encode_subwords(spark, d):
    """The pair layout in piece ids; whole texts are segmented, the layout cuts them."""
    enc = subwords.encode_subwords(inputs.pair_input(_texts(spark, d)), fx.rel_pieces(spark, d), padding="max_length")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return enc.select(
        "example_id", F.size("ids_0").alias("pieces_a"), F.size("ids_1").alias("pieces_b"),
        F.md5(F.concat(text("ids_0"), F.lit("|"), text("ids_1"))).alias("whole_md5"),
        "n_a", "n_b", text("input_ids").alias("input_ids"), text("segment_ids").alias("segments"), text("attention_mask").alias("mask"),
    )


def q_first_example(spark, d):
    return (
        inputs.pair_input(_texts(spark, d))
        .orderBy("example_id")
        .limit(5)
        .select("example_id", "text", "text_pair")
    )


# --- targets ----------------------------------------------------------------------------------


def q_class_target(spark, d):
    return targets.class_target(_examples(spark, d))


def q_variant_target(spark, d):
    return targets.variant_target(_examples(spark, d))


def q_hypothesis_target(spark, d):
    ex = _examples(spark, d).select("example_id", "label")
    hyp = inputs.expand_hypotheses(ex, fx.rel_labels(spark, d))
    return targets.hypothesis_target(hyp)


def q_soft_target(spark, d):
    t = targets.soft_target(fx.rel_answers(spark, d), n_classes=fx.MODEL_WIDTH, label_col="answer")
    return _explode_vector(t, ["example_id"], "target")


def q_smoothed_target(spark, d):
    t = targets.smoothed_target(fx.rel_answers(spark, d), n_classes=fx.MODEL_WIDTH, epsilon=0.5, label_col="answer")
    return _explode_vector(t, ["example_id"], "target")


# --- score math and decoders ------------------------------------------------------------------


def q_softmax(spark, d):
    s = fx.rel_scores(spark, d).select("example_id", "model_id", softmax("scores").alias("p"))
    return _explode_vector(s, ["example_id", "model_id"], "p")


def q_sigmoid(spark, d):
    s = fx.rel_scores(spark, d).select("example_id", "model_id", sigmoid_array("scores").alias("p"))
    return _explode_vector(s, ["example_id", "model_id"], "p")


def q_argmax(spark, d):
    return fx.rel_scores(spark, d).select("example_id", "model_id", argmax("scores").alias("idx"))


def q_argmax_decode(spark, d):
    return decode.argmax_decode(fx.rel_scores(spark, d))


def q_threshold_decode(spark, d):
    return decode.threshold_decode(fx.rel_scores(spark, d), threshold=0.55)


def _pair_scores(spark, d):
    """The 64 numbers as two 32-class question variants."""
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    emb = fx.table(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("example_id"), F.posexplode(halves).alias("variant", "s")).select(
        "example_id", F.col("variant").cast("int").alias("variant"), F.lit("pair").alias("model_id"), F.col("s").cast("array<double>").alias("scores")
    )


def q_pair_soft_vote(spark, d):
    return decode.pair_soft_vote(_pair_scores(spark, d), width=32).select(
        "example_id", "model_id", "pred"
    )


def _ensemble(spark, d):
    return decode.ensemble_soft_vote(
        fx.rel_scores(spark, d), expected_models=MODEL_IDS, width=fx.MODEL_WIDTH
    )


def q_ensemble_soft_vote(spark, d):
    return _ensemble(spark, d).select("example_id", "pred")


def q_hard_vote(spark, d):
    preds = decode.argmax_decode(fx.rel_scores(spark, d))
    return decode.hard_vote(preds, expected_models=MODEL_IDS, n_labels=fx.MODEL_WIDTH)


def q_stack_predictions(spark, d):
    """Write each model's argmax predictions as a header CSV folder with one ``pred`` column
    in example order (the positional format), then read all folders back in one scan."""
    base = scratch_path(spark, "stack_predictions")
    preds = decode.argmax_decode(fx.rel_scores(spark, d))
    (
        preds.withColumn("__dir", F.concat(F.lit("pred_"), F.col("model_id")))
        .repartitionByRange("__dir", "example_id")
        .sortWithinPartitions("__dir", "example_id")
        .select("__dir", "pred")
        .write.partitionBy("__dir")
        .csv(base, header=True)
    )
    folders = [f"{base}/__dir=pred_{m}" for m in range(fx.N_MODELS)]
    out = files.read_predictions(spark, folders, scope="dir")
    return out.select(
        "example_id", F.regexp_replace("model_id", "^__dir=", "").alias("model_id"), "pred"
    )


def q_hypothesis_decode(spark, d):
    return decode.hypothesis_decode(fx.rel_hypothesis_scores(spark, d))


def q_hypothesis_rollup(spark, d):
    r = decode.hypothesis_rollup(
        fx.rel_hypothesis_scores(spark, d), n_labels=fx.N_HYPOTHESIS_ROWS // 2 + 1, threshold=0.5
    )
    return r.select("example_id", "model_id", "pred", F.round("score", 6).alias("score"))


# --- evaluation --------------------------------------------------------------------------------


def q_align_predictions(spark, d):
    return metrics.align_predictions(_ensemble(spark, d), fx.rel_answers(spark, d))


def q_accuracy(spark, d):
    acc = metrics.accuracy(_ensemble(spark, d), fx.rel_answers(spark, d))
    return acc.select(F.round("accuracy", 6).alias("accuracy"), "n")


def q_accuracy_from_scores(spark, d):
    """Every model's own accuracy."""
    acc = metrics.accuracy_by_model(fx.rel_scores(spark, d), fx.rel_answers(spark, d), MODEL_IDS)
    return acc.select("model_id", F.round("accuracy", 6).alias("accuracy"), "n")


def q_confusion_counts(spark, d):
    return metrics.confusion_counts(_ensemble(spark, d), fx.rel_answers(spark, d))


def q_bce_with_logits(spark, d):
    """Every model's own loss."""
    t = targets.soft_target(fx.rel_answers(spark, d), n_classes=fx.MODEL_WIDTH, label_col="answer")
    loss = metrics.bce_by_model(fx.rel_scores(spark, d), t, MODEL_IDS)
    return loss.select("model_id", F.round("loss", 6).alias("loss"), "n")


def q_accuracy_interval(spark, d):
    r = resample.accuracy_interval(fx.rel_scores(spark, d), fx.rel_answers(spark, d), MODEL_IDS)
    return r.select("model_id", *[F.round(c, 6).alias(c) for c in ("accuracy", "low", "high")], "n")


def q_threshold_sweep(spark, d):
    r = sweep.threshold_sweep(fx.rel_scores(spark, d), fx.rel_answers(spark, d), MODEL_IDS)
    return r.select("model_id", F.round("threshold", 6).alias("threshold"), "n", F.round("accuracy", 6).alias("accuracy"))


def q_best_threshold(spark, d):
    """What the sweep chooses for each model, in place of a threshold that is typed in."""
    r = sweep.best_threshold(sweep.threshold_sweep(fx.rel_scores(spark, d), fx.rel_answers(spark, d), MODEL_IDS))
    return r.select("model_id", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 6).alias("accuracy"))


# --- scoring -------------------------------------------------------------------------------------


def fixture_linear_model() -> np.ndarray:
    """A fixed dense 64x10 linear layer."""
    return linear_layer(7, 3)


def linear_layer(a: int, b: int) -> np.ndarray:
    i, j = np.arange(64)[:, None], np.arange(10)[None, :]
    return ((i * a + j * b) % 11 - 5) / 8.0


def linear_loader(a: int, b: int):
    """A loader from a factory: two of them differ only in what they captured."""
    return lambda: linear_layer(a, b)


def fixture_linear_scores(w: np.ndarray, batch: pd.DataFrame) -> np.ndarray:
    x = np.stack(batch["embedding"].to_numpy())
    return x @ w


def q_score_batches(spark, d):
    emb = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("example_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    scores = jobs.score_batches(
        emb,
        fixture_linear_scores,
        ["embedding"],
        load_fn=fixture_linear_model,
        model_id="linear",
        batch_size=40,
    )
    return scores.select(
        "example_id",
        "model_id",
        argmax("scores").alias("pred"),
        F.round(F.array_max("scores"), 6).alias("top_score"),
    )


def q_score_two_models(spark, d):
    """Two models from one loader factory scored in one plan."""
    emb = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("example_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    out = None
    for name, (a, b) in {"first": (7, 3), "second": (5, 4)}.items():
        s = jobs.score_batches(emb, fixture_linear_scores, ["embedding"], load_fn=linear_loader(a, b), model_id=name)
        out = s if out is None else out.unionAll(s)
    return out.select(
        "example_id", "model_id", argmax("scores").alias("pred"), F.round(F.array_max("scores"), 6).alias("top_score")
    )


def fixture_hypothesis_scores(_model, batch: pd.DataFrame) -> np.ndarray:
    """Deterministic two-way "model" of the fixture: yes-logit from statement length, relation
    and direction; no-logit 0."""
    s = (
        (batch["text_pair"].str.len().to_numpy() + batch["label_id"].to_numpy() * 3 + batch["direction"].to_numpy())
        % 11
        - 5
    ) * 0.5
    return np.stack([np.zeros(len(batch)), s], axis=1)


def q_score_hypotheses(spark, d):
    """Hypothesis statements -> batched scoring -> roll-up to one relation per example."""
    from .flows import score_hypotheses

    r = score_hypotheses(
        _texts(spark, d),
        fx.rel_labels(spark, d),
        fixture_hypothesis_scores,
        templates=ASCII_HYPOTHESES,
    )
    return r.select("example_id", "pred", F.round("score", 6).alias("score"))


def fixture_question_scores(_model, batch: pd.DataFrame) -> np.ndarray:
    """Deterministic three-way "model" of the fixture for the two-question style."""
    n = batch["text_pair"].str.len().to_numpy()
    v = batch["variant"].to_numpy().astype(np.float64)
    return np.stack([(n % 5) * 0.3, (n % 3) * 0.5, v * 0.2], axis=1)


def q_score_two_sentence(spark, d):
    """Both questions of each example scored together and soft-voted per row."""
    from .flows import score_two_sentence

    r = score_two_sentence(_texts(spark, d), fixture_question_scores, template=ASCII_TWO_SENTENCE)
    return r.select("example_id", "pred", F.round(F.array_max("probs"), 6).alias("score"))


def fixture_pair_scores(_model, batch: pd.DataFrame) -> np.ndarray:
    """Deterministic two-way "model" of the fixture for pair inputs."""
    a, b = (batch[c].str.len().to_numpy() for c in ("text", "text_pair"))
    return np.stack([(a % 7) * 0.3, ((a + b) % 5) * 0.5], axis=1)


BATCH_TOKENS = 2000


def _token_batches(spark, d):
    enc = inputs.encode_pair(inputs.pair_input(_texts(spark, d)))
    return batching.token_batches(enc.select("example_id", "text", "text_pair", F.size("tokens").cast("int").alias("n_tokens")), BATCH_TOKENS)


def q_token_batches(spark, d):
    """Pairs scored in batches of at most ``BATCH_TOKENS`` tokens with padding: each row's batch and score."""
    batches = _token_batches(spark, d)
    scored = batching.score_token_batches(batches, fixture_pair_scores, ["text", "text_pair"])
    return scored.select("example_id", "batch", argmax("scores").alias("pred"), F.round(F.array_max("scores"), 6).alias("top_score"))


def q_padding_report(spark, d):
    r = batching.padding_report(_token_batches(spark, d))
    return r.select("n_rows", "n_batches", "n_tokens", "n_padded", F.round("padding_share", 6).alias("padding_share"))


def q_score_store(spark, d):
    """All pairs scored into a store; then the table again with the entities swapped in every seventh
    example: its scores, and whether the second run had to make them."""
    ex = _texts(spark, d)
    turned = F.col("example_id") % 7 == 0
    second = ex.withColumns({
        "entity_01": F.when(turned, F.col("entity_02")).otherwise(F.col("entity_01")),
        "entity_02": F.when(turned, F.col("entity_01")).otherwise(F.col("entity_02"))})
    store = score_store.ScoreStore(spark, scratch_path(spark, "scores-kept"), buckets=16)
    for df in (ex, second):
        out = store.score(inputs.pair_input(df), fixture_pair_scores, ["text", "text_pair"], model_id="pairs")
    runs = [r.run for r in store.runs()]
    return out.select("example_id", argmax("scores").alias("pred"), F.round(F.array_max("scores"), 6).alias("top_score"), (F.col("run") == runs[1]).alias("fresh"))


def q_train_linear_classifier(spark, d):
    """Fit and score with the default settings on classes that the text decides: the pair's first
    text repeats a class word (``example_id`` modulo 5) as often as the second, the whole
    sentence, has words."""
    label = F.pmod("example_id", F.lit(5)).cast("int")
    train = _texts(spark, d).select(
        "example_id", F.lit(0).alias("variant"), F.repeat(F.concat(F.lit("class"), label.cast("string"), F.lit(" ")), F.size(F.split("sentence", " "))).alias("text"),
        F.col("sentence").alias("text_pair"), label.alias("label"),
    )
    model = jobs.train_linear_classifier(train)
    return decode.argmax_decode(jobs.score_linear_classifier(model, train))


SOFT_SETTINGS = training.Settings(n_classes=len(fx.LANGUAGE_CLASSES), n_features=1 << 10, learning_rate=0.5, optimizer="adamw", weight_decay=0.01, epsilon=1e-6)


def _soft_rows(spark, d):
    df = targets.soft_target(fx.rel_classes(spark, d), n_classes=SOFT_SETTINGS.n_classes)
    return training.training_rows(df, SOFT_SETTINGS)


def _rounded_history(spark, told):
    h = training.history(spark, told)
    return h.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "held_loss", "held_accuracy")])


def q_train_soft_targets(spark, d):
    """Four epochs on the documents' words with the language as soft target; figures of each."""
    return _rounded_history(spark, training.fit(_soft_rows(spark, d), SOFT_SETTINGS, 4)[1])


def q_resume_training(spark, d):
    """A run of eight epochs that is taken up again after three, from the store; which epochs stay."""
    rows, store = _soft_rows(spark, d), scratch_path(spark, "training-epochs")
    told = training.fit(rows, SOFT_SETTINGS, 3, store=store)[1]
    told += training.fit(rows, SOFT_SETTINGS, 8, store=store)[1]
    kept = sorted(training.EpochStore(spark, store, SOFT_SETTINGS).figures())
    return _rounded_history(spark, told).withColumn("kept", F.col("epoch").isin(*kept))


# --- sources: files written by Spark from the driver tables, read back --------------------------


def q_read_raw_examples(spark, d):
    path = scratch_path(spark, "raw_examples")
    raw = fx.rel_examples(spark, d).withColumn("row_tag", F.col("example_id").cast("string"))
    files.write_raw_examples(raw, path)
    back = files.read_raw_examples(spark, path)
    return examples.project_examples(
        back.withColumn("example_id", F.col("row_tag").cast("long")), fx.rel_labels(spark, d)
    )


def q_read_tagged_examples(spark, d):
    path = scratch_path(spark, "tagged_examples")
    ex = _examples(spark, d).withColumn("row_tag", F.col("example_id").cast("string"))
    files.write_tagged_examples(ex, path)
    back = files.read_tagged_examples(spark, path)
    return examples.project_tagged(back.withColumn("example_id", F.col("row_tag").cast("long")))


def q_read_marked_examples(spark, d):
    """Raw file -> entity-marked examples (the marker-style loader)."""
    path = scratch_path(spark, "marked_examples")
    raw = fx.rel_examples(spark, d).withColumn("row_tag", F.col("example_id").cast("string"))
    files.write_raw_examples(raw, path)
    back = files.read_raw_examples(spark, path).withColumn("example_id", F.col("row_tag").cast("long"))
    return examples.mark_entities(back, fx.rel_labels(spark, d))


STREAM_ROWS = 500_000  # of a file; a micro-batch reads two files of a side


def q_stream_confusion(spark, d):
    """Predictions and answers as streams of files; the running counts when all have been read."""
    pred, answer = scratch_path(spark, "pred-files"), scratch_path(spark, "answer-files")
    files.write_predictions(_ensemble(spark, d).repartition(3), pred, max_rows=STREAM_ROWS)
    fx.rel_answers(spark, d).repartition(4).write.option("maxRecordsPerFile", STREAM_ROWS).csv(answer, header=True)
    out = scratch_path(spark, "running-counts")
    evaluate_stream.run_evaluation(spark, pred, answer, out, scratch_path(spark, "evaluation-state"), 2).awaitTermination()
    return evaluate_stream.running_confusion(spark, out)


def q_write_predictions(spark, d):
    """Ensemble predictions written with their key, read back and aligned with the answers."""
    path = scratch_path(spark, "predictions")
    files.write_predictions(_ensemble(spark, d), path)
    back = files.read_keyed_predictions(spark, path)
    return metrics.align_predictions(back, fx.rel_answers(spark, d))


def _write_in_order(df: DataFrame, path: str, write) -> str:
    """Rows written in ``example_id`` order over several files, so that position is identity."""
    write(df.repartitionByRange("example_id").sortWithinPartitions("example_id"), path)
    return path


def _raw_file(spark, d, name: str) -> str:
    raw = fx.rel_examples(spark, d).withColumn("row_tag", F.col("example_id").cast("string"))
    return _write_in_order(raw, scratch_path(spark, name), files.write_raw_examples)


def q_row_position(spark, d):
    """Both scopes over a folder of several raw files: the folder position of each row, its
    position in its own file counted from that file's first row, and the tag it was written with."""
    path = _raw_file(spark, d, "positions")
    whole = files.read_raw_examples(spark, path, scope="dir").select("row_tag", F.col("example_id").alias("position"))
    own = files.read_raw_examples(spark, path, scope="file").select("row_tag", F.col("example_id").alias("in_file"))
    both = whole.join(own, "row_tag")
    # the file a row is in is known by the difference of its two positions
    first = both.groupBy((F.col("position") - F.col("in_file")).alias("begins")).agg(F.min("in_file").alias("least"), F.count(F.lit(1)).alias("n"), F.max("in_file").alias("most"))
    ok = F.broadcast(first.agg(F.max((F.col("least") != 0) | (F.col("most") + 1 != F.col("n"))).alias("broken")))  # one row
    out = both.select(F.col("row_tag").cast("long").alias("example_id"), "position", F.lit(1).alias("one"))
    return out.join(ok.withColumn("one", F.lit(1)), "one").select("example_id", "position", (~F.col("broken")).alias("file_positions_ok"))


def q_read_predictions(spark, d):
    """Each model's predictions written as one positional column, read back with positions."""
    base = scratch_path(spark, "read_predictions")
    preds = decode.argmax_decode(fx.rel_scores(spark, d))
    for m in MODEL_IDS:
        files.write_positional_predictions(preds.filter(F.col("model_id") == m), f"{base}/m{m}")
    return files.read_predictions(spark, [f"{base}/m{m}" for m in MODEL_IDS], scope="dir")


def q_hard_vote_files(spark, d):
    """Majority vote over prediction files aligned by position."""
    return decode.hard_vote(q_read_predictions(spark, d), [f"m{m}" for m in MODEL_IDS], n_labels=fx.MODEL_WIDTH)


def q_read_quoted_breaks(spark, d):
    """Raw examples whose sentences keep their line breaks, written and read back."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("example_id"), F.trim("text").alias("raw"))
    ex = fx.rel_examples(spark, d).join(docs, "example_id").withColumn("sentence", F.col("raw"))
    ex = ex.withColumn("row_tag", F.col("example_id").cast("string"))
    path = _write_in_order(ex, scratch_path(spark, "quoted_breaks"), files.write_raw_examples)
    back = files.read_raw_examples(spark, path, quoted_breaks=True, scope="dir")
    return back.select(F.col("row_tag").cast("long").alias("doc_id"), F.col("example_id").alias("position"), "sentence", "relation")


def q_label_dimension(spark, d):
    return fx.rel_labels(spark, d)


def q_read_templates(spark, d):
    """Template lines written from the label dimension (every fifth with two more statements),
    between brace lines, read back."""
    dim = fx.rel_labels(spark, d)
    ask = lambda pattern: F.concat(F.lit('"'), *[F.col(x) if x.endswith("_part") else F.lit(x) for x in pattern], F.lit('"'))
    line = F.concat(
        F.lit("  '"), F.col("label_name"), F.lit("': "), F.col("label_id").cast("string"), F.lit(", "),
        ask(["attribute_part", " of?"]), F.lit(", "), ask(["subject_part", " to?"]),
        F.when(F.col("label_id") % 5 == 0, F.concat(F.lit(" "), ask(["{1} ", "attribute_part"]), F.lit(" "), ask(["{2} ", "subject_part"]))).otherwise(F.lit("")),
    )
    path = scratch_path(spark, "templates")
    lines = F.when(F.col("label_id") == 0, F.concat(F.lit("{\n\n"), line, F.lit(","))).when(F.col("label_id") == 24, F.concat(line, F.lit("\n}"))).otherwise(F.concat(line, F.lit(",")))
    dim.select(lines.alias("value")).write.text(path)
    t = files.read_templates(spark, path)
    return t.select("label_id", "label_name", "forward", "reverse", F.array_join("extra", "|").alias("extra"))


def _experiments(spark, d) -> DataFrame:
    """One JSON config file for each nation, read back; flags by the nation's key."""
    k = F.col("n_nationkey")
    flag = lambda n, r: F.when(k % n == r, "on").otherwise("off")
    conf = fx.table(spark, d, "nation").select(
        k.alias("key"), k.cast("int").alias("seed"), F.col("n_name").alias("MODEL_NAME"),
        F.concat(F.lit("./out/"), F.when(k % 12 == 3, F.lit("shared")).otherwise(F.col("n_name"))).alias("output_dir"),
        F.concat(F.lit("./log/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.when(k % 9 == 4, F.lit("same")).otherwise(F.col("n_name"))).alias("logging_dir"),
        F.lit(2).alias("EPOCH"), F.lit("SGD").alias("optimizer"), F.lit(0.25).alias("learning_rate"),
        F.when(k % 8 != 7, F.lit(4)).cast("int").alias("batch_size"),
        flag(5, 1).alias("rtq"), flag(3, 0).alias("two_sentence"), flag(4, 2).alias("except_0"),
        F.when(k % 10 != 9, flag(2, 0)).alias("entity_token"),
    )
    path = scratch_path(spark, "configs")
    conf.write.partitionBy("key").json(path)
    return files.read_experiments(spark, f"{path}/*/*.json")


def q_read_experiments(spark, d):
    return _experiments(spark, d).drop("file")


def q_num_labels(spark, d):
    return _experiments(spark, d).select(F.col("MODEL_NAME").alias("model"), experiments.num_labels(42).alias("num_labels"))


def q_input_style(spark, d):
    return _experiments(spark, d).select(F.col("MODEL_NAME").alias("model"), experiments.input_style().alias("style"), experiments.decoder_choice().alias("decoder"))


def q_experiment_check(spark, d):
    c = experiments.experiment_check(_experiments(spark, d))
    return c.select(F.col("MODEL_NAME").alias("model"), F.array_join(F.array_sort("missing_keys"), ",").alias("missing_keys"),
                    "duplicate_output_dir", "duplicate_run_name", "conflict", "ok")


def q_run_name(spark, d):
    return _experiments(spark, d).select(F.col("MODEL_NAME").alias("model"), files.run_name("logging_dir").alias("run_name"))


def q_load_test_dataset(spark, d):
    """Raw file -> question inputs; labels of the file are checked."""
    path = _raw_file(spark, d, "test_dataset")
    return flows.load_test_dataset(spark, path, fx.rel_labels(spark, d), style=inputs.STYLE_TWO_SENTENCE, scope="dir", template=ASCII_TWO_SENTENCE)


def q_tagged_test_dataset(spark, d):
    """Tagged file -> typed-pair inputs, tags by a loaded model."""
    path = _write_in_order(_examples(spark, d).withColumn("row_tag", F.lit("t")), scratch_path(spark, "tagged_dataset"), files.write_tagged_examples)
    return flows.tagged_test_dataset(spark, path, pandas_tagger=fixture_model_tagger, load_fn=load_fixture_tagger, scope="dir")


def length_loader(a: int, b: int):
    return lambda: (a, b)


def fixture_length_scores(model: tuple[int, int], batch: pd.DataFrame) -> np.ndarray:
    """Three classes from the lengths of both texts, by the model's two numbers."""
    a, b = model
    n, m = batch["text"].str.len().to_numpy(), batch["text_pair"].str.len().to_numpy()
    return np.stack([(n % a) * 0.23, (m % b) * 0.51, ((n + m) % (a + b)) * 0.117], axis=1)


def q_ensemble_files(spark, d):
    """Raw and tagged file -> four models -> soft vote -> positional file -> accuracy."""
    raw_path = _raw_file(spark, d, "ensemble_raw")
    tagged = _examples(spark, d).withColumn("row_tag", F.lit("t"))
    tagged_path = _write_in_order(tagged, scratch_path(spark, "ensemble_tagged"), files.write_tagged_examples)
    answers = fx.rel_texts(spark, d).select("example_id", F.pmod("example_id", F.lit(3)).cast("int").alias("answer"))
    answer_path = scratch_path(spark, "ensemble_answers")
    files.write_positional_predictions(answers, answer_path, column="answer")
    out_path = scratch_path(spark, "ensemble_predictions")
    flows.ensemble_files(
        spark, raw_path, tagged_path, fx.rel_labels(spark, d),
        {"p1": length_loader(5, 3), "p2": length_loader(7, 4)}, {"t1": length_loader(6, 5), "t2": length_loader(9, 2)},
        fixture_length_scores, fixture_model_tagger, out_path, tagger_load_fn=load_fixture_tagger, width=3, scope="dir",
    )
    acc = flows.evaluate_files(spark, out_path, answer_path, scope="dir")
    return acc.select(F.round("accuracy", 6).alias("accuracy"), "n")


QUERIES: dict[str, Query] = {
    "project_examples": q_project_examples,
    "encode_label": q_encode_label,
    "decode_label": q_decode_label,
    "is_blind": q_is_blind,
    "example_filter_none": q_example_filter_none,
    "mark_entities": q_mark_entities,
    "pair_input": q_pair_input,
    "single_input": q_single_input,
    "two_sentence_input": q_two_sentence_input,
    "tag_entities": q_tag_entities,
    "typed_pair_input": q_typed_pair_input,
    "tag_paths": q_tag_paths,
    "expand_hypotheses": q_expand_hypotheses,
    "hypothesis_input": q_hypothesis_input,
    "hypothesis_statements": q_hypothesis_statements,
    "encode_pair": q_encode_pair,
    "encode_subwords": q_encode_subwords,
    "first_example": q_first_example,
    "class_target": q_class_target,
    "variant_target": q_variant_target,
    "hypothesis_target": q_hypothesis_target,
    "soft_target": q_soft_target,
    "smoothed_target": q_smoothed_target,
    "softmax": q_softmax,
    "sigmoid": q_sigmoid,
    "argmax": q_argmax,
    "argmax_decode": q_argmax_decode,
    "threshold_decode": q_threshold_decode,
    "pair_soft_vote": q_pair_soft_vote,
    "ensemble_soft_vote": q_ensemble_soft_vote,
    "hard_vote": q_hard_vote,
    "stack_predictions": q_stack_predictions,
    "hypothesis_decode": q_hypothesis_decode,
    "hypothesis_rollup": q_hypothesis_rollup,
    "align_predictions": q_align_predictions,
    "accuracy": q_accuracy,
    "accuracy_from_scores": q_accuracy_from_scores,
    "confusion_counts": q_confusion_counts,
    "stream_confusion": q_stream_confusion,
    "bce_with_logits": q_bce_with_logits,
    "accuracy_interval": q_accuracy_interval,
    "threshold_sweep": q_threshold_sweep,
    "best_threshold": q_best_threshold,
    "score_batches": q_score_batches,
    "score_hypotheses": q_score_hypotheses,
    "score_two_sentence": q_score_two_sentence,
    "score_store": q_score_store,
    "token_batches": q_token_batches,
    "padding_report": q_padding_report,
    "train_linear_classifier": q_train_linear_classifier,
    "train_soft_targets": q_train_soft_targets,
    "resume_training": q_resume_training,
    "read_raw_examples": q_read_raw_examples,
    "read_tagged_examples": q_read_tagged_examples,
    "read_marked_examples": q_read_marked_examples,
    "write_predictions": q_write_predictions,
    "score_two_models": q_score_two_models,
    "row_position": q_row_position,
    "read_predictions": q_read_predictions,
    "hard_vote_files": q_hard_vote_files,
    "read_quoted_breaks": q_read_quoted_breaks,
    "label_dimension": q_label_dimension,
    "read_templates": q_read_templates,
    "read_experiments": q_read_experiments,
    "num_labels": q_num_labels,
    "input_style": q_input_style,
    "experiment_check": q_experiment_check,
    "run_name": q_run_name,
    "load_test_dataset": q_load_test_dataset,
    "tagged_test_dataset": q_tagged_test_dataset,
    "ensemble_files": q_ensemble_files,
}
