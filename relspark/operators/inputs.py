"""Model-input builders: one example -> one, two or 2*(K-1) (text, text_pair) rows.

All builders are narrow (no shuffle).  The hypothesis expansion is an ``explode`` of variant
numbers followed by an equi-join on ``label_id`` against the checked-broadcast label
dimension, so it runs as one pipelined stage that streams the example side.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import let
from ..functions.text import fill_template
from ..plans.joins import BROADCAST_BYTES, broadcast_within, require
from .labels import NO_RELATION_ID, label_stats

# --- fixed values: model-input layout -------------------------------------------------
SEP = "[SEP]"
E1 = "[E1]"
E2 = "[E2]"
E1_NER = "[E1-NER]"
E2_NER = "[E2-NER]"
# max_length per input style
MAX_LENGTH_PAIR = 100
MAX_LENGTH_TYPED_PAIR = 200
MAX_LENGTH_SINGLE = 150
MAX_LENGTH_TWO_SENTENCE = 150
MAX_LENGTH_HYPOTHESIS = 200
# question template (entity 1, entity 2), asked in both entity orders
TWO_SENTENCE_TEMPLATE = "{}와 {}은 무슨 관계인가?"
# hypothesis templates: forward (entity 1, attribute, entity 2),
# reverse (entity 2, subject, entity 1, attribute)
HYPOTHESIS_TEMPLATES = ("{}의 {}은 {}인가?", "{}은 {} {}의 {}인가?")
# ---------------------------------------------------------------------------------------

STYLE_PAIR = "pair"
STYLE_TYPED_PAIR = "typed_pair"
STYLE_SINGLE = "single"
STYLE_TWO_SENTENCE = "two_sentence"
STYLE_HYPOTHESIS = "hypothesis"


def _model_input(
    df: DataFrame, variant: Column, style: str, text: Column, text_pair: Column, max_length: int
) -> DataFrame:
    return df.select(
        F.col("example_id"),
        variant.cast("int").alias("variant"),
        F.lit(style).alias("style"),
        text.alias("text"),
        text_pair.cast("string").alias("text_pair"),
        F.lit(max_length).cast("int").alias("max_length"),
    )


def pair_input(examples: DataFrame, max_length: int = MAX_LENGTH_PAIR) -> DataFrame:
    """(``e1[SEP]e2``, sentence): entity text first, the sentence as the pair."""
    text = F.concat(F.col("entity_01"), F.lit(SEP), F.col("entity_02"))
    return _model_input(examples, F.lit(0), STYLE_PAIR, text, F.col("sentence"), max_length)


def typed_pair_input(
    tagged: DataFrame,
    max_length: int = MAX_LENGTH_TYPED_PAIR,
    tag_cols: tuple[str, str] = ("tag_01", "tag_02"),
) -> DataFrame:
    """(``[E1][E1-NER]t1[E1-NER]e1[E1][E2][E2-NER]t2[E2-NER]e2[E2]``, sentence).

    ``tagged`` carries one tag column per entity (see :func:`relspark.operators.jobs.tag_entities`).
    The same marker opens and closes each part.
    """
    t1, t2 = (F.col(c) for c in tag_cols)
    text = F.concat(
        F.lit(E1 + E1_NER), t1, F.lit(E1_NER), F.col("entity_01"), F.lit(E1),
        F.lit(E2 + E2_NER), t2, F.lit(E2_NER), F.col("entity_02"), F.lit(E2),
    )
    return _model_input(tagged, F.lit(0), STYLE_TYPED_PAIR, text, F.col("sentence"), max_length)


def single_input(examples: DataFrame, max_length: int = MAX_LENGTH_SINGLE) -> DataFrame:
    """(sentence, none)."""
    return _model_input(
        examples, F.lit(0), STYLE_SINGLE, F.col("sentence"), F.lit(None), max_length
    )


def two_sentence_input(
    examples: DataFrame,
    template: str = TWO_SENTENCE_TEMPLATE,
    max_length: int = MAX_LENGTH_TWO_SENTENCE,
) -> DataFrame:
    """(sentence, question) twice: variant 0 asks about (e1, e2), variant 1 about (e2, e1)."""
    e1, e2 = F.col("entity_01"), F.col("entity_02")
    questions = F.array(fill_template(template, e1, e2), fill_template(template, e2, e1))
    exploded = examples.select(
        F.col("example_id"), F.col("sentence"), F.posexplode(questions).alias("variant", "q")
    )
    return _model_input(
        exploded, F.col("variant"), STYLE_TWO_SENTENCE, F.col("sentence"), F.col("q"), max_length
    )


def two_sentence_statements(
    examples: DataFrame,
    template: str = TWO_SENTENCE_TEMPLATE,
    max_length: int = MAX_LENGTH_TWO_SENTENCE,
) -> DataFrame:
    """Compact form of :func:`two_sentence_input`: one row per example with the sentence once
    and ``statements`` = both questions (``struct<variant, text_pair>``), for scoring without
    sending the sentence twice and voting without a shuffle."""
    e1, e2 = F.col("entity_01"), F.col("entity_02")
    return examples.select(
        F.col("example_id"),
        F.col("sentence").alias("text"),
        F.lit(max_length).cast("int").alias("max_length"),
        F.array(
            F.struct(F.lit(0).alias("variant"), fill_template(template, e1, e2).alias("text_pair")),
            F.struct(F.lit(1).alias("variant"), fill_template(template, e2, e1).alias("text_pair")),
        ).alias("statements"),
    )


def _hypothesis_dim(dim: DataFrame, max_broadcast_bytes: int) -> tuple[DataFrame, int]:
    stats = label_stats(dim)
    if not stats.contiguous:
        raise ValueError(
            f"label ids must be 0..{stats.n_labels - 1}; got {stats.min_id}..{stats.max_id}"
        )
    small = dim.filter(F.col("label_id") != NO_RELATION_ID).select(
        F.col("label_id").alias("__lid"),
        F.col("subject_part").alias("__subj"),
        F.col("attribute_part").alias("__attr"),
    )
    return broadcast_within(small, stats.size_bytes, max_broadcast_bytes), stats.n_labels


def expand_hypotheses(
    examples: DataFrame, dim: DataFrame, max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Each example x each relation label except 0, times two directions.

    ``variant = (label_id - 1) * 2 + direction``.  The label set comes from ``dim`` (ids must be
    0..K-1), never from a hard-coded width.  Output keeps every input column plus
    ``variant, label_id, direction, subject_part, attribute_part``.
    """
    small, n_labels = _hypothesis_dim(dim, max_broadcast_bytes)
    n_variants = 2 * (n_labels - 1)
    if n_variants <= 0:
        raise ValueError("label dimension has no relation besides id 0")
    exploded = examples.withColumn(
        "variant", F.explode(F.sequence(F.lit(0), F.lit(n_variants - 1)))
    ).withColumn("__lid_key", (F.col("variant") / 2).cast("int") + 1)
    joined = exploded.join(small, exploded["__lid_key"] == small["__lid"], "inner")
    return joined.select(
        *[F.col(c) for c in examples.columns],
        F.col("variant").cast("int").alias("variant"),
        F.col("__lid").cast("int").alias("label_id"),
        (F.col("variant") % 2).cast("int").alias("direction"),
        F.col("__subj").alias("subject_part"),
        F.col("__attr").alias("attribute_part"),
    )


def hypothesis_input(
    examples: DataFrame,
    dim: DataFrame,
    templates: tuple[str, str] = HYPOTHESIS_TEMPLATES,
    max_length: int = MAX_LENGTH_HYPOTHESIS,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``HYPOTHESIS`` rows: (sentence, one yes/no statement per relation and direction).

    Forward statement from (e1, attribute, e2), reverse from (e2, subject, e1, attribute).
    ``target`` is 1 exactly on the two rows of the example's own label (never for 0 or 100).
    """
    ex = expand_hypotheses(examples, dim, max_broadcast_bytes)
    e1, e2 = F.col("entity_01"), F.col("entity_02")
    subj, attr = F.col("subject_part"), F.col("attribute_part")
    fwd, rev = templates
    statement = F.when(F.col("direction") == 0, fill_template(fwd, e1, attr, e2)).otherwise(
        fill_template(rev, e2, subj, e1, attr)
    )
    return ex.select(
        F.col("example_id"),
        F.col("variant"),
        F.col("label_id"),
        F.col("direction"),
        F.col("sentence").alias("text"),
        statement.alias("text_pair"),
        F.lit(max_length).cast("int").alias("max_length"),
        (F.col("label") == F.col("label_id")).cast("int").alias("target"),
    )


_RELATION_NAMES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _relation_names(dim: DataFrame) -> list[tuple[str, str]]:
    """(subject, attribute) of relations 1..K-1 in id order; read once per dimension frame."""
    if dim not in _RELATION_NAMES:
        rows = (
            dim.filter(F.col("label_id") != NO_RELATION_ID)
            .orderBy("label_id")
            .select("subject_part", "attribute_part")
            .collect()
        )
        _RELATION_NAMES[dim] = [(r["subject_part"], r["attribute_part"]) for r in rows]
    return _RELATION_NAMES[dim]


def hypothesis_statements(
    examples: DataFrame,
    dim: DataFrame,
    templates: tuple[str, str] = HYPOTHESIS_TEMPLATES,
    max_length: int = MAX_LENGTH_HYPOTHESIS,
) -> DataFrame:
    """Compact form of :func:`hypothesis_input`: one row per example carrying the sentence
    once and an array of its ``2*(K-1)`` statements
    (``struct<variant, label_id, direction, text_pair, target>``).

    Built with one ``transform`` over the variant numbers, no explode and no join, so a
    scorer can receive each sentence once instead of once per hypothesis.  The relation names
    are inlined as literal arrays: the label set is a constant of the model (ids proven
    contiguous), read once as a broadcast side would be.  ``posexplode(statements)`` gives back the row form.
    """
    stats = label_stats(dim)
    if not stats.contiguous:
        raise ValueError(
            f"label ids must be 0..{stats.n_labels - 1}; got {stats.min_id}..{stats.max_id}"
        )
    if "label" not in examples.columns:  # inputs for scoring carry no label
        examples = examples.withColumn("label", F.lit(None).cast("int"))
    rel = _relation_names(dim)
    subj = F.array(*[F.lit(sp) for sp, _ in rel])
    attr = F.array(*[F.lit(ap) for _, ap in rel])
    e1, e2, label = F.col("entity_01"), F.col("entity_02"), F.col("label")
    fwd, rev = templates

    def statement(v):
        return let(
            (v / 2).cast("int") + 1,
            lambda lid: F.struct(
                v.cast("int").alias("variant"),
                lid.alias("label_id"),
                (v % 2).cast("int").alias("direction"),
                F.when(v % 2 == 0, fill_template(fwd, e1, F.element_at(attr, lid), e2))
                .otherwise(
                    fill_template(rev, e2, F.element_at(subj, lid), e1, F.element_at(attr, lid))
                )
                .alias("text_pair"),
                (label == lid).cast("int").alias("target"),
            ),
        )

    n_hyp = 2 * (stats.n_labels - 1)
    return examples.select(
        F.col("example_id"),
        F.col("sentence").alias("text"),
        F.lit(max_length).cast("int").alias("max_length"),
        F.transform(F.sequence(F.lit(0), F.lit(n_hyp - 1)), statement).alias("statements"),
    )


def statements_to_rows(compact: DataFrame) -> DataFrame:
    """Row form (``HYPOTHESIS`` columns) of :func:`hypothesis_statements`."""
    return compact.select(
        "example_id", "text", "max_length", F.explode("statements").alias("s")
    ).select(
        "example_id",
        F.col("s.variant").alias("variant"),
        F.col("s.label_id").alias("label_id"),
        F.col("s.direction").alias("direction"),
        "text",
        F.col("s.text_pair").alias("text_pair"),
        "max_length",
        F.col("s.target").alias("target"),
    )


# --- pair encoding ---------------------------------------------------------------------

# fixed values: special tokens of the encoded layout
CLS_TOKEN = "[CLS]"
PAD_TOKEN = "[PAD]"
PAIR_LAYOUT = ("begin", "between", "pad")


def whitespace_tokens(text: Column, limit: Column | int = -1) -> Column:
    """Tokens of ``text`` split on runs of whitespace (empty text -> empty array); with
    ``limit`` the last of that many pieces is the unsplit rest of the text.

    A split on whitespace runs leaves an empty token only at either end (leading or trailing
    whitespace, or empty text); ``array_remove`` drops it without a per-token lambda.
    (Measured against a character map plus a single-space split: no faster.)
    """
    return F.array_remove(F.split(text, r"\s+", limit), "")


def truncated_lengths(la: Column, lb: Column, budget: Column) -> tuple[Column, Column]:
    """Token counts kept from each side under ``budget``: shorten the longer side until both
    are equal, then alternate, taking the first token from side b."""
    over = F.greatest(la + lb - budget, F.lit(0))
    d = F.abs(la - lb)
    m = F.least(la, lb)
    r = over - d
    keep_a = F.when(over <= d, F.when(la > lb, la - over).otherwise(la)).otherwise(
        m - F.floor(r / 2).cast("int")
    )
    keep_b = F.when(over <= d, F.when(la > lb, lb).otherwise(lb - over)).otherwise(
        m - F.ceil(r / 2).cast("int")
    )
    return keep_a.cast("int"), keep_b.cast("int")


def encode_pair(
    df: DataFrame,
    text_col: str = "text",
    pair_col: str | None = "text_pair",
    max_length: int | str = "max_length",
    padding: str = "none",
    tokens_a: Column | None = None,
    tokens_b: Column | None = None,
    layout: dict[str, Column] | None = None,
) -> DataFrame:
    """Truncate and lay out one or two token sequences as ``[CLS] a [SEP] (b [SEP])``.

    Adds ``tokens`` (array<string>), ``attention_mask`` and ``segment_ids`` (array<int>),
    ``n_a`` and ``n_b`` (tokens kept per side).  Tokens default to whitespace splitting; a
    caller may pass token-array columns instead, and with them the ``layout``: the special
    tokens ``begin``, ``between`` and ``pad`` as values of the arrays' type.  ``padding``: ``none``, ``max_length`` (pad
    every row to its ``max_length``) or ``longest`` (pad to the longest row of the whole
    frame, found with one aggregate).
    """
    if not isinstance(max_length, str) and max_length < 3:
        raise ValueError("max_length must leave room for the special tokens (3 or more)")
    if isinstance(max_length, str):
        df = require(df, F.col(max_length) < 3, "max_length must leave room for the special tokens (3 or more)")
    layout = layout or dict(zip(PAIR_LAYOUT, (F.lit(CLS_TOKEN), F.lit(SEP), F.lit(PAD_TOKEN)), strict=True))
    begin, between = F.array(layout["begin"]), F.array(layout["between"])
    # A side never keeps more than max_length - 2 tokens, so the rest need not be split: one more
    # token than that decides the same cut (and one piece may be a leading empty one).
    limit = F.col(max_length) + 1 if isinstance(max_length, str) else max_length + 1
    ta = tokens_a if tokens_a is not None else whitespace_tokens(F.col(text_col), limit)
    has_pair = tokens_b is not None or pair_col is not None
    tb = (
        tokens_b
        if tokens_b is not None
        else (whitespace_tokens(F.coalesce(F.col(pair_col), F.lit("")), limit) if pair_col else F.slice(ta, 1, 0))
    )
    ml = F.col(max_length) if isinstance(max_length, str) else F.lit(int(max_length))
    out = df.withColumn("__ta", ta).withColumn("__tb", tb).withColumn("__ml", ml.cast("int"))
    la, lb = F.size("__ta"), F.size("__tb")
    if has_pair:
        # A pair with an empty or null second text is laid out as a single sequence.
        pair_present = lb > 0
        budget = F.when(pair_present, F.col("__ml") - 3).otherwise(F.col("__ml") - 2)
    else:
        pair_present = F.lit(False)
        budget = F.col("__ml") - 2
    keep_a, keep_b = truncated_lengths(la, lb, budget)
    out = out.withColumn("n_a", keep_a).withColumn("n_b", F.when(pair_present, keep_b).otherwise(0))
    a_part = F.slice(F.col("__ta"), 1, F.col("n_a"))
    b_part = F.slice(F.col("__tb"), 1, F.col("n_b"))
    seg_a = F.array_repeat(F.lit(0), F.col("n_a") + 2)
    seg_b = F.array_repeat(F.lit(1), F.col("n_b") + 1)
    tokens = F.when(
        pair_present,
        F.concat(begin, a_part, between, b_part, between),
    ).otherwise(F.concat(begin, a_part, between))
    segments = F.when(pair_present, F.concat(seg_a, seg_b)).otherwise(seg_a)
    out = out.withColumn("tokens", tokens).withColumn("segment_ids", segments)
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))
    if padding != "none":
        if padding == "max_length":
            target = F.col("__ml")
        elif padding == "longest":
            longest = out.agg(F.max(F.size("tokens"))).first()[0] or 0
            target = F.lit(int(longest))
        else:
            raise ValueError(f"unknown padding {padding!r}")
        out = out.withColumn("__pad", F.greatest(target - F.size("tokens"), F.lit(0)))
        pad = F.col("__pad")
        out = (
            out.withColumn("tokens", F.concat("tokens", F.array_repeat(layout["pad"], pad)))
            .withColumn("segment_ids", F.concat("segment_ids", F.array_repeat(F.lit(0), pad)))
            .withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), pad)))
            .drop("__pad")
        )
    return out.drop("__ta", "__tb", "__ml")
