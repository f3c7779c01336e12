"""Running evaluation of predictions and answers that arrive as files, in any order.

Both sides are one stream of rows keyed by ``example_id``.  The state holds, for each example, how often each
side has arrived and its value, so an answer may be late by any time; an example counts once both are
there.  A micro-batch adds its newly complete examples to the confusion counts as a folder of its
own, named by the batch's number: a batch that is run again after a failure replaces what it wrote.  The
running counts and the accuracy are sums over those folders.

A prediction or answer that arrives again raises, as in the batch form, also when its values agree.  The
state grows with the examples seen, one small row each (Spark's state store keeps it by key in the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_COUNTS = "answer int, pred int, n long"


def evaluation_stream(spark: SparkSession, predictions: str, answers: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The states of the examples that changed: ``example_id, predictions, answers`` (arrivals of each), ``pred``,
    ``answer``.  Files are CSV with a header: ``example_id,pred`` and ``example_id,answer``."""
    def side(folder: str, value: str) -> DataFrame:
        reader = spark.readStream.schema(f"example_id long, {value} int").option("header", True).option("mode", "FAILFAST")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.csv(folder)

    null, zero, one = F.lit(None).cast("int"), F.lit(0), F.lit(1)
    rows = side(predictions, "pred").select("example_id", "pred", one.alias("p"), null.alias("answer"), zero.alias("a")).unionByName(
        side(answers, "answer").select("example_id", null.alias("pred"), zero.alias("p"), "answer", one.alias("a")))
    # dealt out before they are grouped: an example has few rows, and a table of all those of a file would fill a task
    return rows.repartition("example_id").groupBy("example_id").agg(
        F.sum("p").alias("predictions"), F.sum("a").alias("answers"), F.max("pred").alias("pred"), F.max("answer").alias("answer"))


def _add(out: str):
    def run(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()
        try:
            twice = changed.where("predictions > 1 or answers > 1").select("example_id").first()
            if twice is not None:
                raise ValueError(f"example_id arrived twice on one side: {twice[0]}")
            # an example is complete in one batch only: a further arrival would be the second of its side
            done = changed.where("predictions = 1 and answers = 1").groupBy("answer", "pred").agg(F.count(F.lit(1)).alias("n"))
            done.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        finally:
            changed.unpersist()

    return run


def run_evaluation(spark: SparkSession, predictions: str, answers: str, out: str, checkpoint: str,
                   max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the evaluation; with ``available_now`` it ends when the files that are there have been read.  A later run
    with the same ``checkpoint`` and ``out`` goes on from there."""
    writer = evaluation_stream(spark, predictions, answers, max_files_per_trigger).writeStream.outputMode("update")
    writer = writer.option("checkpointLocation", checkpoint).foreachBatch(_add(out.rstrip("/")))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_confusion(spark: SparkSession, out: str) -> DataFrame:
    """``(answer, pred, n)`` of the examples that are complete so far, as ``metrics.confusion_counts``."""
    counts = spark.read.schema(_COUNTS).option("recursiveFileLookup", True).parquet(out)
    return counts.groupBy("answer", "pred").agg(F.sum("n").alias("n"))


def running_accuracy(spark: SparkSession, out: str) -> DataFrame:
    """``(accuracy, n)`` of the examples that are complete so far, as ``metrics.accuracy``."""
    counts = running_confusion(spark, out)
    right = F.sum(F.when(F.col("answer") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.agg(F.try_divide(right, F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
