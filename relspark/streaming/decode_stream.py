"""Stateless operators on Structured Streaming sources.

The per-row operators (label encoding, input builders, targets, argmax / threshold /
per-hypothesis decoding) have no state, so they apply unchanged to a streaming DataFrame;
the label dimension joins as a static broadcast side.  This module wires score files that
arrive in a folder through a per-row decoder into a parquet sink whose checkpoint folder the
caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode, examples, inputs
from ..schemas import SCORES

PER_ROW_DECODERS = {
    "argmax_decode": decode.argmax_decode,
    "threshold_decode": decode.threshold_decode,
    "hypothesis_decode": decode.hypothesis_decode,
}


def read_score_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet ``SCORES`` files appearing in ``folder`` as a stream."""
    reader = spark.readStream.schema(SCORES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def decode_stream(scores: DataFrame, decoder: str = "argmax_decode", **kw) -> DataFrame:
    """Per-row decoding of a (streaming or static) ``SCORES`` frame."""
    if decoder not in PER_ROW_DECODERS:
        raise ValueError(
            f"{decoder!r} groups rows of an example; only per-row decoders run on a stream: "
            f"{sorted(PER_ROW_DECODERS)}"
        )
    return PER_ROW_DECODERS[decoder](scores, **kw)


def read_raw_example_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of keyed raw examples (``example_id`` + ``RAW_EXAMPLE`` columns) as a
    stream.  A stream has no global row order, so files must carry their key."""
    from pyspark.sql import types as T

    from ..schemas import RAW_EXAMPLE

    schema = T.StructType(RAW_EXAMPLE.fields + [T.StructField("example_id", T.LongType(), False)])
    return spark.readStream.schema(schema).parquet(folder)


def pair_input_stream(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """Label encoding against the static label dimension, then pair inputs, on a stream."""
    return inputs.pair_input(examples.project_examples(raw, dim))


def write_prediction_stream(
    predictions: DataFrame,
    out_folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append rows (decoded predictions or model inputs) to parquet; exactly-once through the
    file sink's commit log, as long as a restart names the same ``checkpoint`` folder."""
    writer = (
        predictions.writeStream.format("parquet")
        .option("path", out_folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
