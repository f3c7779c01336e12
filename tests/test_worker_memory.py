import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from relspark.operators import jobs
from relspark.sources import files


def test_layouts_are_whole_batches_within_both_bounds(monkeypatch):
    monkeypatch.setattr(jobs, "LAYOUT_BYTES", 1000)
    r = np.random.default_rng(4)
    for _ in range(50):
        size, counts, batch = r.integers(0, 400, 60), r.integers(0, 5, 60), int(r.integers(1, 9))
        row_of = np.repeat(np.arange(60), counts)
        got = list(jobs._layouts(row_of, size, 4 * batch, batch))
        assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == len(row_of)
        for a, b in got:
            assert a % batch == 0 and b - a <= 4 * batch
            assert b - a <= batch or size[row_of[a] : row_of[b - 1] + 1].sum() <= 1000
    assert list(jobs._layouts(np.zeros(0, np.int64), np.zeros(3), 8, 4)) == []


def test_only_one_batch_of_rows_is_python_objects(spark, monkeypatch):
    made = []

    def scorer(_model, batch: pd.DataFrame):
        assert batch["text"].values.base is None or len(batch["text"].values.base) <= 10  # no view of a larger frame
        return np.array([[len(t), i] for i, t in zip(batch.index, batch["text"], strict=True)], dtype=float)

    class Rows:
        def __init__(self, schema):
            self.columns, self.schema = schema.names, schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _schema):
            return run

    df = spark.range(95).select(F.col("id").alias("example_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    batch = pa.RecordBatch.from_pandas(df.toPandas(), preserve_index=False)
    run = jobs.score_batches(Rows(df.schema), scorer, ["text"], batch_size=10)

    monkeypatch.setattr(jobs, "release", lambda: made.append("released"))
    out = [list(map(tuple, b.column("scores").to_pylist())) for b in run(iter([batch]))]
    assert out == [[(float(i), float(i)) for i in range(95)]] and made == ["released"]


def test_predictions_are_written_in_files_of_bounded_size(spark, tmp_dir):
    rows = spark.range(50, numPartitions=1).select(F.col("id").alias("example_id"), (F.col("id") % 3).cast("int").alias("pred"))
    files.write_predictions(rows, f"{tmp_dir}/p", max_rows=20)
    read = spark.read.option("header", True).csv(f"{tmp_dir}/p")
    sizes = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
    assert sorted(sizes) == [10, 20, 20]
