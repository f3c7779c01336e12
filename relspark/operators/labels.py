"""Label dimension and the label lookups (encode by name, decode by id).

The dimension is tiny (one row per class) but joined against every example, so every lookup
reads its size first (:func:`label_stats`): a broadcast hash join when the dimension is within
a fixed number of bytes, Catalyst's shuffle join otherwise.  Example rows are never
shuffled on the label key in the common case, so a label that holds a third of all rows
costs nothing extra.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import BROADCAST_BYTES, broadcast_within, require
from ..schemas import BLIND_LABEL, BLIND_RELATION

NO_RELATION_ID = 0


def label_dimension(df: DataFrame) -> DataFrame:
    """Validate a ``(label_id, label_name)`` table and split names into subject and attribute.

    Every name except the one of id 0 must read ``subject:attribute``; parts 0 and 1 of the
    ``:`` split are kept, a further ``:`` is ignored.  A name without ``:`` raises at run time.
    """
    parts = F.split(F.col("label_name"), ":")
    has_colon = F.size(parts) >= 2
    subject = (
        F.when(has_colon, parts[0])
        .when(F.col("label_id") == NO_RELATION_ID, F.lit(None).cast("string"))
        .otherwise(
            F.raise_error(
                F.concat(F.lit("label name without ':': "), F.col("label_name"))
            ).cast("string")
        )
    )
    return df.select(
        F.col("label_id").cast("int").alias("label_id"),
        F.col("label_name").cast("string").alias("label_name"),
        subject.alias("subject_part"),
        F.when(has_colon, parts[1]).alias("attribute_part"),
    )


@dataclass(frozen=True)
class LabelStats:
    """Size facts of a label dimension, read in one small aggregate."""

    n_labels: int
    min_id: int
    max_id: int
    size_bytes: int

    @property
    def contiguous(self) -> bool:
        return self.min_id == 0 and self.max_id == self.n_labels - 1


_STATS_MEMO: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def label_stats(dim: DataFrame) -> LabelStats:
    """Count, min and max of ``label_id``; raises on duplicate ids (an inverted map would
    silently keep the last name).  One small aggregate, remembered per DataFrame."""
    if dim in _STATS_MEMO:
        return _STATS_MEMO[dim]
    row = dim.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("label_id").alias("nd"),
        F.countDistinct("label_name").alias("nn"),
        F.min("label_id").alias("lo"),
        F.max("label_id").alias("hi"),
        F.sum(F.octet_length("label_name") * 2 + 64).alias("bytes"),
    ).first()
    if row["n"] != row["nd"]:
        raise ValueError("label dimension has duplicate label_id values")
    if row["n"] != row["nn"]:
        raise ValueError("label dimension has duplicate label_name values")
    stats = LabelStats(int(row["n"]), int(row["lo"] or 0), int(row["hi"] or 0), int(row["bytes"] or 0))
    _STATS_MEMO[dim] = stats
    return stats


def is_blind(relation: Column | str = "relation") -> Column:
    """Predicate: the example's relation is hidden."""
    rel = F.col(relation) if isinstance(relation, str) else relation
    return rel == F.lit(BLIND_RELATION)


def encode_label(
    examples: DataFrame,
    dim: DataFrame,
    relation_col: str = "relation",
    out_col: str = "label",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Relation name -> label id; ``blind`` -> 100; an unknown name raises.

    Left join to the dimension, whose names are proven unique, so no example is multiplied;
    an unknown name raises whichever columns are selected later.
    """
    lookup = broadcast_within(
        dim.select(F.col("label_name").alias("__lname"), F.col("label_id").alias("__lid")),
        label_stats(dim).size_bytes,
        max_broadcast_bytes,
    )
    joined = examples.join(lookup, examples[relation_col] == lookup["__lname"], "left")
    blind = F.coalesce(is_blind(F.col(relation_col)), F.lit(False))
    joined = require(
        joined,
        ~blind & F.col("__lid").isNull(),
        F.concat(F.lit("unknown relation: "), F.coalesce(F.col(relation_col), F.lit("NULL"))),
    )
    label = F.when(blind, F.lit(BLIND_LABEL)).otherwise(F.col("__lid")).cast("int")
    return joined.withColumn(out_col, label).drop("__lname", "__lid")


def decode_label(
    df: DataFrame,
    dim: DataFrame,
    id_col: str = "label",
    out_col: str = "label_name",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Label id -> name; 100 -> ``blind``; an id outside the dimension gives null.

    Duplicate ids in the dimension are rejected (an inverted name map would silently keep one
    of them), so the join is many-to-one.
    """
    lookup = broadcast_within(
        dim.select(F.col("label_id").alias("__lid"), F.col("label_name").alias("__lname")),
        label_stats(dim).size_bytes,
        max_broadcast_bytes,
    )
    joined = df.join(lookup, df[id_col] == lookup["__lid"], "left")
    name = F.when(F.col(id_col) == F.lit(BLIND_LABEL), F.lit(BLIND_RELATION)).otherwise(
        F.col("__lname")
    )
    return joined.withColumn(out_col, name).drop("__lid", "__lname")


def example_filter_none(df: DataFrame, label_col: str = "label_id") -> DataFrame:
    """Drop the no-relation class (id 0), as the hypothesis expansion does."""
    return df.filter(F.col(label_col) != F.lit(NO_RELATION_ID))
