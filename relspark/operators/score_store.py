"""Scores kept by content, so that a later run scores only what no run has scored before.

The store is one Parquet table below ``path``, bucketed and sorted by ``key``, the SHA-256 of the model's
name and the features' values.  A run looks up its keys (the stored side is not shuffled), scores each
unseen key once, appends the rows under a run name of its own, and then writes that name to
``_runs``: rows of a run that is not listed there (a driver that was lost) are not read.  Any
session opens the store again by its path; the bucket numbers are in the file names.

Rows are dealt to tasks by key, so many that each task gets about ``TASK_BYTES`` of features: a worker then
holds no more at once, whatever the corpus' size or the session's batch size.

Nulls are values of their own.  Equal inputs share a key and are scored once.  Repeated input rows all
get their scores.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import score_batches

_STORED = "key string, model_id string, scores array<double>, run string"
_RUN = "run string, buckets int, n_scored long"
TASK_BYTES = 4 << 20  # bytes of features to a task that scores


def content_key(model_id: str, features: Sequence[str]) -> Column:
    """SHA-256 of the model's name and the features: each value with its length before it (null: none)."""
    parts = [F.lit(f"{len(model_id)}:{model_id}")]
    for f in features:
        text = F.col(f).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _bytes(df: DataFrame, features: Sequence[str]) -> int:
    """Bytes of the features as text, all rows together."""
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)).cast("long") for f in features), F.lit(0).cast("long")))).first()[0] or 0


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "score_store_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        runs = self.runs()
        self.buckets = runs[0].buckets if runs else buckets

    # --- the table ---------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def runs(self) -> list:
        """The runs that were committed: ``run, buckets, n_scored``, in order."""
        if not self._exists(f"{self.path}/_runs"):
            return []
        return self.spark.read.schema(_RUN).json(f"{self.path}/_runs").orderBy("run").collect()

    def _open(self) -> None:
        """The table's entry in this session's catalog, for files that are there already."""
        if not self.spark.catalog.tableExists(self.name):
            where = self.path.replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {self.name} ({_STORED}) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                f"INTO {self.buckets} BUCKETS LOCATION '{where}'"
            )
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """``key, model_id, scores, run`` of the committed runs, one row a key (of two runs at once: the later name)."""
        self._open()
        listed = [r.run for r in self.runs()]
        found = self.spark.table(self.name).where(F.col("run").isin(*listed) if listed else F.lit(False))
        one = found.groupBy("key").agg(F.max(F.struct("run", "model_id", "scores")).alias("r"))
        return one.select("key", "r.model_id", "r.scores", "r.run")

    # --- a run -----------------------------------------------------------------------------------

    def score(
        self,
        df: DataFrame,
        score_fn: Callable[[Any, Any], Any],
        feature_cols: Sequence[str],
        load_fn: Callable[[], Any] | None = None,
        model_id: str = "model",
        batch_size: int = 40,
        key_cols: Sequence[str] = ("example_id", "variant"),
    ) -> DataFrame:
        """``SCORES`` of all rows as :func:`relspark.operators.jobs.score_batches` gives them, and the ``run`` that
        each was scored in.  ``feature_cols`` are all that the model sees; ``model_id`` must name its version."""
        ids = [c for c in key_cols if c in df.columns]
        features = list(feature_cols)
        keyed = df.select(*dict.fromkeys([*ids, *features]), content_key(model_id, features).alias("__key"))
        known = self.rows().select(F.col("key").alias("__key"))
        unseen = keyed.select("__key").distinct().join(known, "__key", "left_anti")
        n = _bytes(keyed, features) // TASK_BYTES + 1
        wanted = keyed.join(unseen, "__key", "left_semi").dropDuplicates(["__key"]).repartition(n, "__key")
        run = f"{len(self.runs()) + 1:06d}-{uuid.uuid4().hex}"
        new = score_batches(wanted, score_fn, features, load_fn, model_id, batch_size, key_cols=("__key",))
        new = new.select(F.col("__key").alias("key"), "model_id", "scores", F.lit(run).alias("run"))
        self._append(new)
        self._commit(run)
        side = self.rows().select(F.col("key").alias("__key"), "model_id", "scores", "run")
        out = keyed.drop(*[f for f in features if f not in ids]).join(side, "__key").drop("__key")
        return out if "variant" in ids else out.withColumn("variant", F.lit(0))

    def _append(self, new: DataFrame) -> None:
        dealt = new.repartition(self.buckets, "key")  # one file a bucket and run
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _commit(self, run: str) -> None:
        n = self.spark.table(self.name).where(F.col("run") == run).count()
        self.spark.createDataFrame([(run, self.buckets, n)], _RUN).coalesce(1).write.mode("append").json(f"{self.path}/_runs")
