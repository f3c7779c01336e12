"""Training targets: class id, per-variant copy, per-hypothesis binary, soft and smoothed
vectors.  All per-row expressions; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLIND_LABEL

# fixed values: label smoothing factor of the default trainer setup
LABEL_SMOOTHING = 0.5


def class_target(examples: DataFrame, label_col: str = "label") -> DataFrame:
    """The row's label as its target."""
    return examples.select(F.col("example_id"), F.col(label_col).cast("int").alias("target"))


def variant_target(examples: DataFrame, n_variants: int = 2, label_col: str = "label") -> DataFrame:
    """The parent label on each of the ``n_variants`` rows of an example (two-sentence style)."""
    return examples.select(
        F.col("example_id"),
        F.explode(F.sequence(F.lit(0), F.lit(n_variants - 1))).alias("variant"),
        F.col(label_col).cast("int").alias("target"),
    ).select("example_id", F.col("variant").cast("int").alias("variant"), "target")


def hypothesis_target(hypotheses: DataFrame, label_col: str = "label") -> DataFrame:
    """1 iff the hypothesis' relation is the example's label, else 0 (label 0 and 100 -> 0)."""
    return hypotheses.select(
        F.col("example_id"),
        F.col("variant"),
        F.col("label_id"),
        (F.col(label_col) == F.col("label_id")).cast("int").alias("target"),
    )


def _checked_label(label: Column, n_classes: int) -> Column:
    """The label, raising when it cannot index a vector of ``n_classes`` relation classes."""
    bad = label.isNull() | (label < 0) | (label > n_classes) | (label == BLIND_LABEL)
    return F.when(
        bad, F.raise_error(
            F.concat(F.lit("label outside target width: "), F.coalesce(label.cast("string"), F.lit("NULL")))
        ).cast("int")
    ).otherwise(label)


def soft_target_vector(label: Column, n_classes: int) -> Column:
    """``n_classes`` wide: label 0 -> every entry ``1/n_classes``; label l -> one-hot at l-1."""
    lab = _checked_label(label, n_classes)
    uniform = F.lit(1.0 / n_classes)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.when(lab == 0, uniform).otherwise(F.when(i == lab - 1, 1.0).otherwise(0.0)),
    )


def soft_target(df: DataFrame, n_classes: int = 41, label_col: str = "label") -> DataFrame:
    """Adds ``target`` (array<double>) for the multi-label loss of the no-relation-free head."""
    return df.withColumn("target", soft_target_vector(F.col(label_col), n_classes))


def smoothed_target_vector(label: Column, n_classes: int, epsilon: float) -> Column:
    """``(1 - eps) * one_hot(label) + eps / n_classes`` over ``n_classes`` entries."""
    bad = label.isNull() | (label < 0) | (label >= n_classes)
    lab = F.when(
        bad, F.raise_error(
            F.concat(F.lit("label outside target width: "), F.coalesce(label.cast("string"), F.lit("NULL")))
        ).cast("int")
    ).otherwise(label)
    base = F.lit(epsilon / n_classes)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: base + F.when(i == lab, F.lit(1.0 - epsilon)).otherwise(F.lit(0.0)),
    )


def smoothed_target(
    df: DataFrame, n_classes: int = 42, epsilon: float = LABEL_SMOOTHING, label_col: str = "label"
) -> DataFrame:
    """Adds ``target`` (array<double>): the label-smoothed class distribution."""
    return df.withColumn("target", smoothed_target_vector(F.col(label_col), n_classes, epsilon))
