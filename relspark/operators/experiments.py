"""Experiment table operators: class count, input style, decoder choice and config checks.

One row per config file (see :func:`relspark.sources.files.read_experiments`).  Flags are the
strings ``on`` / ``off``; a missing flag stays null and is reported, never read as ``off``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EXPERIMENT_KEYS


def _on(flag: str) -> Column:
    return F.col(flag) == F.lit("on")


def _first_on(choices: list[tuple[str, Column]], otherwise: Column) -> Column:
    """The value of the first flag that is on; null as soon as a consulted flag is missing."""
    out = otherwise
    for flag, value in reversed(choices):
        out = F.when(F.col(flag).isNull(), F.lit(None)).when(_on(flag), value).otherwise(out)
    return out


def num_labels(n_labels: int = 42) -> Column:
    """Classifier width: 2 with rtq, else ``n_labels - 1`` with except_0, else ``n_labels``; null if a
    consulted flag is missing."""
    return _first_on([("rtq", F.lit(2)), ("except_0", F.lit(n_labels - 1))], F.lit(n_labels)).cast("int")


def input_style() -> Column:
    """Input style by precedence rtq > two_sentence > entity_token > pair; null if a consulted flag
    is missing."""
    return _first_on(
        [("rtq", F.lit("hypothesis")), ("two_sentence", F.lit("two_sentence")), ("entity_token", F.lit("typed_pair"))],
        F.lit("pair"),
    )


def decoder_choice() -> Column:
    """Decoder by exclusive precedence rtq > two_sentence > except_0 > argmax; null if a consulted
    flag is missing."""
    return _first_on(
        [("rtq", F.lit("hypothesis_decode")), ("two_sentence", F.lit("pair_soft_vote")), ("except_0", F.lit("threshold_decode"))],
        F.lit("argmax_decode"),
    )


def experiment_check(experiments: DataFrame) -> DataFrame:
    """Adds ``missing_keys`` (array of absent required keys), ``duplicate_output_dir`` (another
    config writes to the same folder), ``duplicate_run_name`` (another config's predictions get the
    same name), ``conflict`` (rtq together with except_0: a 2-wide head
    against a 41-wide target) and ``ok``."""
    from ..sources.files import run_name

    missing = F.filter(
        F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in EXPERIMENT_KEYS]),
        lambda x: x.isNotNull(),
    )
    dup = F.count(F.lit(1)).over(Window.partitionBy("output_dir")) > 1
    name = run_name("logging_dir")
    same_name = name.isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy(name)) > 1)
    conflict = F.coalesce(_on("rtq") & _on("except_0"), F.lit(False))
    out = experiments.withColumn("missing_keys", missing).withColumn(
        "duplicate_output_dir", F.col("output_dir").isNotNull() & dup
    ).withColumn("duplicate_run_name", same_name).withColumn("conflict", conflict)
    return out.withColumn(
        "ok",
        (F.size("missing_keys") == 0) & ~F.col("duplicate_output_dir") & ~F.col("duplicate_run_name") & ~F.col("conflict"),
    )


def experiment_plan(experiments: DataFrame, n_labels: int = 42) -> DataFrame:
    """The checked table with the derived settings of each run."""
    from ..sources.files import run_name

    return experiment_check(experiments).select(
        "*",
        num_labels(n_labels).alias("num_labels"),
        input_style().alias("style"),
        decoder_choice().alias("decoder"),
        run_name("logging_dir").alias("run_name"),
    )
