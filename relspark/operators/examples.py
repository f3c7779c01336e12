"""Projections of raw and tagged example tables, and entity-span marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mark_spans, spans_overlap
from .labels import encode_label

TEXT_COLUMNS = ("sentence", "entity_01", "entity_02")


def _not_null(name: str) -> Column:
    c = F.col(name)
    return F.when(c.isNull(), F.raise_error(F.lit(f"null {name} in example")).cast("string")).otherwise(c)


def project_texts(raw: DataFrame) -> DataFrame:
    """Raw rows -> ``example_id`` and the three text columns, for builders whose output has no
    label: no lookup, no join.  A null sentence or entity raises."""
    return raw.select(F.col("example_id"), *[_not_null(name).alias(name) for name in TEXT_COLUMNS])


def project_examples(raw: DataFrame, dim: DataFrame, strict: bool = True) -> DataFrame:
    """Raw rows -> ``EXAMPLE``: keep sentence and both entity texts, encode the relation.

    ``raw`` carries ``example_id`` and the ``RAW_EXAMPLE`` columns.  With ``strict`` a null
    sentence or entity raises (the text builders would otherwise produce null inputs).
    """
    enc = encode_label(raw, dim, relation_col="relation", out_col="label")
    cols = [F.col("example_id")]
    for name in TEXT_COLUMNS:
        cols.append((_not_null(name) if strict else F.col(name)).alias(name))
    cols.append(F.col("label"))
    return enc.select(*cols)


def project_tagged(tagged: DataFrame, strict: bool = True) -> DataFrame:
    """Tagged rows (label already an int) -> ``EXAMPLE``."""
    cols = [F.col("example_id")]
    for name in TEXT_COLUMNS:
        cols.append((_not_null(name) if strict else F.col(name)).alias(name))
    label = F.col("label").cast("int")
    if strict:
        label = F.when(label.isNull(), F.raise_error(F.lit("null label in tagged example")).cast("int")).otherwise(label)
    cols.append(label.alias("label"))
    return tagged.select(*cols)


def mark_entities(raw: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Raw rows -> ``MARKED_EXAMPLE``: entity markers inserted at the four offsets.

    Offsets are 0-based code-point positions, ends inclusive.  Entity texts are dropped; the
    offsets are kept; ``spans_overlap`` flags rows whose markers cross.  When ``dim`` is given
    the relation is encoded, otherwise an existing ``label`` column is kept.
    """
    df = encode_label(raw, dim, relation_col="relation", out_col="label") if dim is not None else raw

    def offset(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | (c < 0), F.raise_error(F.lit(f"missing or negative {name}")).cast("int")).otherwise(c)

    s = F.col("sentence")
    e1s, e1e, e2s, e2e = (offset(c) for c in ("e1_s", "e1_e", "e2_s", "e2_e"))
    return df.select(
        F.col("example_id"),
        mark_spans(s, e1s, e1e, e2s, e2e).alias("sentence"),
        e1s.alias("e1_s"),
        e1e.alias("e1_e"),
        e2s.alias("e2_s"),
        e2e.alias("e2_e"),
        F.col("label").cast("int").alias("label"),
        spans_overlap(e1s, e1e, e2s, e2e).alias("spans_overlap"),
    )
