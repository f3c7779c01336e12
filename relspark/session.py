"""Session construction and the shared scratch location.

The library never picks a machine-local folder on its own: written intermediate tables and
checkpoints go below ``spark.checkpoint.dir`` as the cluster names it.  Only when that setting
is unset (local runs, tests) do we choose a folder ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_FALLBACK: dict[str, str] = {}
_SCRATCH: set[str] = set()


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "relspark",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every operator in this library is planned for.

    AQE stays on (coalescing small shuffle partitions and splitting skewed join partitions);
    the UI is off; Arrow carries the Python batches (``mapInArrow``).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing one only when the cluster names none."""
    conf = spark.sparkContext.getConf()
    path = (
        spark.conf.get(CHECKPOINT_CONF, None)
        or conf.get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getCheckpointDir()
    )
    if not path:
        # Local runs and tests only: a cluster must name shared storage.
        if conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="relspark-ckpt-")
        path = _LOCAL_FALLBACK[app]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder for a written table.  All such
    folders of an application stand in one, which is removed when the application ends."""
    app = spark.sparkContext.applicationId
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/relspark-{app}"
    if base not in _SCRATCH:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _SCRATCH.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
