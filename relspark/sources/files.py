"""Readers and writers: delimited example files, template files, experiment configs,
prediction files, plus the file-position index that turns "row order is identity" into an
explicit key once, at ingest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import require
from ..schemas import EXPERIMENT_JSON, RAW_EXAMPLE, TAGGED_EXAMPLE
from ..session import ensure_checkpoint_dir

# --- S7: file position ----------------------------------------------------------------------


def _with_scan_meta(df: DataFrame) -> DataFrame:
    """Columns needed by :func:`with_row_position`; call directly on a file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__mid"),
    )


def with_row_position(scanned: DataFrame, scope: str = "file", out_col: str = "position", keep_file: bool = False) -> DataFrame:
    """0-based line position of each row, per file (``scope='file'``) or over all files of
    one folder (``scope='dir'``, for multi-part outputs: parts by their number, then by name).

    ``scanned`` comes from :func:`_with_scan_meta`.  Rows of one split are contiguous in
    ``monotonically_increasing_id``.  One job counts the rows of each split (file metadata
    columns only) and stores the running offsets, one row per split, below the checkpoint
    folder; they are joined back on the file path and the split start.  Offsets of one file or
    folder are summed in one window group, which grows with its splits, not its rows.
    """
    if scope == "file":
        group = F.col("__file")
    elif scope == "dir":
        group = F.regexp_replace(F.col("__file"), "/[^/]*$", "")
    else:
        raise ValueError(f"unknown scope {scope!r}")
    ensure_checkpoint_dir(scanned.sparkSession)
    blocks = scanned.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    name = F.regexp_extract("__file", "([^/]*)$", 1)
    part = F.expr("try_cast(regexp_extract(regexp_extract(__file, '([^/]*)$', 1), '^part-([0-9]+)', 1) as bigint)")
    blocks = blocks.select("*", group.alias("__group"), part.alias("__part"), name.alias("__name"))
    w = (
        Window.partitionBy("__group")
        .orderBy(F.col("__part").asc_nulls_first(), "__name", "__file", "__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.withColumn("__offset", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(
        "__file", "__block", (F.col("__offset") - F.col("__first")).alias("__shift")
    ).checkpoint(eager=True)
    joined = scanned.join(offsets, ["__file", "__block"])
    pos = (F.col("__shift") + F.col("__mid")).cast("long")
    out = joined.withColumn(out_col, pos).drop("__block", "__mid", "__shift")
    return out if keep_file else out.drop("__file")


# --- S1 / S2: example files -----------------------------------------------------------------


def read_raw_examples(
    spark: SparkSession,
    path: str | Sequence[str],
    mode: str = "FAILFAST",
    quoted_breaks: bool = False,
    scope: str = "file",
) -> DataFrame:
    """Tab-separated, header-less example file(s) -> ``RAW_EXAMPLE`` + ``example_id``.

    Quotes are doubled inside quoted fields (``escape='"'``).  The words ``NA``/``None`` stay
    text; an empty field is null; blank lines are skipped.  ``mode='FAILFAST'`` raises on
    short or malformed rows; ``PERMISSIVE`` fills nulls, and :func:`split_rejects` then
    separates incomplete rows.  ``example_id`` is the 0-based row position within the file
    (``scope='dir'``: within the folder).  ``quoted_breaks`` accepts line breaks inside quoted
    fields; a file is then read by one task, so large inputs should come as several files.
    """
    df = spark.read.csv(
        path, schema=RAW_EXAMPLE, sep="\t", header=False, quote='"', escape='"', mode=mode, multiLine=quoted_breaks
    )
    return with_row_position(_with_scan_meta(df), scope=scope, out_col="example_id")


REQUIRED_RAW = ("sentence", "entity_01", "e1_s", "e1_e", "entity_02", "e2_s", "e2_e", "relation")


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete rows, reject rows) of a ``PERMISSIVE`` read: a row is rejected when any
    required field is missing or did not parse (null).  Decided on content, so it holds under
    any later column selection."""
    bad = F.lit(False)
    for c in REQUIRED_RAW:
        bad = bad | F.col(c).isNull()
    return raw.filter(~bad), raw.filter(bad)


def read_tagged_examples(
    spark: SparkSession,
    path: str | Sequence[str],
    mode: str = "FAILFAST",
    quoted_breaks: bool = False,
    scope: str = "file",
) -> DataFrame:
    """Comma-separated tagged example file(s) with one header line -> ``TAGGED_EXAMPLE`` +
    ``example_id`` (0-based position after the header).  A non-integer label raises;
    ``quoted_breaks`` and ``scope`` as in :func:`read_raw_examples`."""
    df = spark.read.csv(
        path, schema=TAGGED_EXAMPLE, sep=",", header=True, quote='"', escape='"', mode=mode, multiLine=quoted_breaks
    )
    return with_row_position(_with_scan_meta(df), scope=scope, out_col="example_id")


def write_raw_examples(df: DataFrame, path: str) -> None:
    """Write ``RAW_EXAMPLE`` columns as tab-separated text in the reader's quoting dialect."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in RAW_EXAMPLE.fields]).write.mode(
        "errorifexists"
    ).csv(path, sep="\t", header=False, quote='"', escape='"', emptyValue="")


def write_tagged_examples(df: DataFrame, path: str) -> None:
    """Write ``TAGGED_EXAMPLE`` columns as comma-separated text with a header line."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in TAGGED_EXAMPLE.fields]).write.mode(
        "errorifexists"
    ).csv(path, sep=",", header=True, quote='"', escape='"', emptyValue="")


# --- S4: label/question templates -------------------------------------------------------------


def read_templates(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Template lines ``'name': id, "q1", "q2" ["s1" "s2"]`` -> ``TEMPLATE_DIM``.

    The files look like JSON but are not (single-quoted keys, missing commas), so each line is
    matched by regular expressions.  Lines of braces and blank lines are skipped; any other line
    that does not begin with ``'name': id`` raises.
    """
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^[\s{},]*$"))
    head = r"^\s*'([^']+)'\s*:\s*(\d+)"
    quoted = F.regexp_extract_all(F.col("value"), F.lit(r'"([^"]*)"'), F.lit(1))
    lines = require(lines, ~F.col("value").rlike(head), F.concat(F.lit("not a template line: "), F.col("value")))
    parsed = lines.select(
        F.regexp_extract("value", head, 2).cast("int").alias("label_id"),
        F.regexp_extract("value", head, 1).alias("label_name"),
        quoted.alias("__q"),
    )
    return parsed.select(
        "label_id",
        "label_name",
        F.try_element_at("__q", F.lit(1)).alias("forward"),
        F.try_element_at("__q", F.lit(2)).alias("reverse"),
        F.when(F.size("__q") > 2, F.slice("__q", F.lit(3), F.size("__q") - 2)).otherwise(F.array().cast("array<string>")).alias("extra"),
    )


# --- S5: experiment configs -------------------------------------------------------------------


def read_label_dimension(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """``(label_id, label_name)`` from a header CSV or parquet file -> validated ``LABEL_DIM``."""
    from ..operators.labels import label_dimension

    if fmt == "csv":
        df = spark.read.csv(path, header=True, schema="label_id int, label_name string", mode="FAILFAST")
    elif fmt == "parquet":
        df = spark.read.parquet(path).select("label_id", "label_name")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return label_dimension(df)


def read_experiments(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per JSON config file; a missing key is null (not "off"), broken JSON raises."""
    df = spark.read.schema(EXPERIMENT_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.col("_metadata.file_name").alias("file"), *EXPERIMENT_JSON.fieldNames())


# --- S6 / U1 / S8 / S9: predictions --------------------------------------------------------------


def read_predictions(
    spark: SparkSession,
    paths: str | Sequence[str],
    column: str = "pred",
    scope: str = "file",
) -> DataFrame:
    """Header CSV files with one integer column ``column`` (``pred`` or ``answer``) ->
    ``(example_id, model_id, <column>)``.

    Several files (or folders) are read in one scan; ``model_id`` is the file name without
    extension (``scope='file'``) or the folder name (``scope='dir'``, multi-part outputs), and
    ``example_id`` the row position within it.
    """
    df = spark.read.csv(paths, header=True, schema=f"{column} int", mode="FAILFAST")
    pos = with_row_position(_with_scan_meta(df), scope=scope, out_col="example_id", keep_file=True)
    name = (
        F.regexp_extract(F.col("__file"), r"([^/]+)/[^/]*$", 1)
        if scope == "dir"
        else F.regexp_replace(F.regexp_extract(F.col("__file"), r"([^/]+)$", 1), r"\.[^.]*$", "")
    )
    return pos.select("example_id", name.alias("model_id"), F.col(column))


def write_positional_predictions(predictions: DataFrame, path: str, column: str = "pred") -> None:
    """Write one column in ``example_id`` order without the key: position is identity, as
    ``read_predictions(..., scope='dir')`` reads it back.  Refuses an existing folder."""
    ordered = predictions.select("example_id", F.col(column).cast("int").alias(column)).repartitionByRange("example_id")
    ordered.sortWithinPartitions("example_id").select(column).write.mode("errorifexists").csv(path, header=True)


def read_keyed_predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Prediction files written by :func:`write_predictions` (they carry ``example_id``)."""
    return spark.read.csv(paths, header=True, schema="example_id long, pred int", mode="FAILFAST")


def stack_predictions(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of several prediction frames, tagged with their ``model_id``."""
    out = None
    for model_id, df in frames.items():
        part = df.select("example_id", F.lit(model_id).alias("model_id"), "pred")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no prediction frames")
    return out


def run_name(logging_dir: str = "logging_dir", suffix: str = "_2"):
    """Output name of a run: last segment of its logging folder plus ``suffix``."""
    return F.concat(F.element_at(F.split(F.col(logging_dir), "/"), -1), F.lit(suffix))


def save_bucketed(
    df: DataFrame, table: str, n_buckets: int, key: str = "example_id", mode: str = "errorifexists"
) -> None:
    """Persist a keyed table (``SCORES``, ``ANSWER``, predictions) bucketed and sorted by
    ``key``.

    Tables bucketed on the same key with the same bucket count are read co-partitioned: the
    votes (grouped by ``example_id``) and the alignment join between scores and answers then
    run without any shuffle, and several decoders can reuse one stored copy of the scores.
    """
    (
        df.write.mode(mode)
        .format("parquet")
        .bucketBy(n_buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def write_predictions(
    predictions: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    partition_col: str | None = None,
    max_rows: int = 0,
) -> None:
    """Write ``(example_id, pred)`` (with the key, unlike a bare positional column), in files of at most
    ``max_rows`` rows (0: any number).

    The default mode refuses an existing folder, so two runs sharing a name cannot overwrite
    each other silently.  ``partition_col`` (e.g. a :func:`run_name` column) writes one
    sub-folder per value.
    """
    cols = [F.col("example_id").cast("long"), F.col("pred").cast("int")]
    if partition_col:
        cols.append(F.col(partition_col))
    writer = predictions.select(*cols).write.mode(mode).option("maxRecordsPerFile", max_rows)
    if partition_col:
        writer = writer.partitionBy(partition_col)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
