"""Merkle fixity audit of WARC archives.

A record's leaf hash covers its place and its bytes.  Records are filed by offset: the node of
level 0 covers ``RANGE_BYTES`` of an archive, a node of level j ``FANOUT`` nodes of level j - 1,
and the single top node is the root.  A node's hash is over its children's numbers and hashes
in offset order, so place, order and content all count.  Because a node is an offset range,
each level is one aggregation, groups are bounded by the range (never by the archive), and no
archive is ordered in one task.  The audit compares roots, then joins only the children of
nodes that differ, level by level, down to the records.

Offsets are those of the archive's index (one manifest for all replicas), so a record that is
lost or cut short in a replica leaves the offsets after it as they are.

Cases: an empty archive set has no roots; records with a null payload have empty content;
repeated equal records of one place hash together (the multiset counts); a null archive name
or offset is kept as its own value.  Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relspark.llm.common import fresh_names, stored

RANGE_BYTES = 1 << 16
FANOUT = 16
RECORDS_PER_ARCHIVE = 1024
DATE = "2000-01-01T00:00:00Z"  # one date for all records: replicas must agree byte for byte


def warc_bytes(kind: str, uri: Column, record_id: Column, payload: Column) -> Column:
    """One WARC/1.0 record as text: header lines, blank line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def page_records(pages: DataFrame, html: Column | None = None, per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """``pages`` as WARC records: ``archive`` (``per_archive`` consecutive page ids), ``record_id``,
    ``content``.  A null page id goes to archive -1."""
    archive = F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("long")
    body = F.col("html") if html is None else html
    return pages.select(archive.alias("archive"), F.col("page_id").alias("record_id"),
                        warc_bytes("resource", F.col("url"), F.col("page_id"), body).alias("content"))


def with_offsets(records: DataFrame) -> DataFrame:
    """``records`` (``archive``, ``record_id``, ``length``, ``digest``) with ``offset``: in id order, one after the
    other.  Only the columns of ``records`` are shuffled (no contents).  They are dealt by ranges of archive, id and digest,
    and last by row, so an archive or an id that a third of all records have is cut into many ranges; a range is
    added up by itself, and an archive's ranges by one row each."""
    number, row, before = fresh_names(records, "range_no", "row_no", "before")
    order = [F.col("archive").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("digest"), F.col(row)]
    numbered = records.withColumn(row, F.monotonically_increasing_id())
    dealt = stored(records.sparkSession, numbered.repartitionByRange(*order).withColumn(number, F.spark_partition_id()), "record-ranges")
    sums = dealt.groupBy(number, "archive").agg(F.sum("length").alias("held"))
    so_far = F.sum("held").over(Window.partitionBy("archive").orderBy(number)) - F.col("held")
    sums = stored(records.sparkSession, sums.select(F.col(number).alias("s_range"), F.col("archive").alias("s_archive"), so_far.alias(before)), "range-sums")
    placed = dealt.join(sums, (dealt[number] == sums["s_range"]) & dealt["archive"].eqNullSafe(sums["s_archive"]))
    inside = F.sum("length").over(Window.partitionBy(number, "archive").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(*records.columns, (F.col(before) + inside - F.col("length")).alias("offset"))


def manifest(records: DataFrame) -> DataFrame:
    """``(archive, record_id, length, digest, offset)`` of records with ``content``."""
    return with_offsets(records.select("archive", "record_id", *sealed(F.col("content"))))


def sealed(content: Column, suffix: str = "") -> list[Column]:
    """``length`` in bytes and ``digest`` (SHA-256) of a record."""
    return [F.octet_length(content).cast("long").alias("length" + suffix), F.unhex(F.sha2(content, 256)).alias("digest" + suffix)]


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file for each archive below ``path`` (``archive=.../``), records in id order."""
    rows = records.select("archive", "record_id", F.expr("left(content, length(content) - 4)").alias("value"))
    rows = rows.repartition("archive").sortWithinPartitions("archive", "record_id", F.sha2("value", 256)).drop("record_id")
    rows.write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def _parse(batches):
    import hashlib

    import pyarrow as pa

    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, at = [], 0
            while at < len(data):
                m = head.match(data, at)
                if not m:
                    raise ValueError(f"{name}: no WARC record at byte {at}")
                fields = dict(x.split(b": ", 1) for x in m[1].split(b"\r\n"))
                end = min(m.end() + int(fields[b"Content-Length"]) + 4, len(data))
                rid = re.search(rb"<urn:page:(-?\d*)>", fields[b"WARC-Record-ID"])
                out.append((rid and rid[1] and int(rid[1]), at, end - at, hashlib.sha256(data[at:end]).digest()))
                at = end
            archive = int(re.search(r"archive=(-?\d+)", name)[1])
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([archive] * len(out), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["archive", "record_id", "offset", "length", "digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, record_id, offset, length, digest)`` of the files that ``write_warc`` wrote.  One
    archive is in a task's memory at a time; archives have a bounded number of records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_parse, "archive long, record_id long, offset long, length long, digest binary")


def _ordered_hash(index: str, digest: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(index), F.lit(-1)).alias("i"), F.col(digest).alias("d"))))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["i"].cast("string"), F.lit(":"), F.hex(x["d"]))), "|")
    return F.unhex(F.sha2(joined, 256))


def merkle_tree(leaves: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored node tables ``(archive, node, hash)``, from the offset ranges up to the roots."""
    spark = leaves.sparkSession
    sealed = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.hex("digest"))
    at = leaves.select("archive", "offset", F.unhex(F.sha2(sealed, 256)).alias("hash"))
    nodes = at.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("node")).agg(_ordered_hash("offset", "hash").alias("hash"))
    out = [stored(spark, nodes, "merkle")]
    for _ in range(levels):
        nodes = out[-1].groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(_ordered_hash("node", "hash").alias("hash"))
        out.append(stored(spark, nodes, "merkle"))
    return out


def _levels_for(extent: int, range_bytes: int, fanout: int) -> int:
    ranges, levels = max(1, -(-extent // range_bytes)), 0
    while fanout**levels < ranges:
        levels += 1
    return levels


def _same(names: list[str], left: DataFrame, right: DataFrame) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def _below(rows: DataFrame, bad: DataFrame, node: Column) -> DataFrame:
    """The rows whose ``node`` is among the ``bad`` nodes of their archive."""
    up = bad.select(F.col("archive").alias("up_archive"), F.col("node").alias("up_node"))
    return rows.join(up, rows["archive"].eqNullSafe(up["up_archive"]) & node.eqNullSafe(up["up_node"]), "left_semi")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records of two replicas (``archive, record_id, offset, length, digest`` each) that differ:
    ``archive``, ``record_id``, ``offset``, ``state`` (``changed``, ``lost``: not in ``right``,
    ``added``: not in ``left``), ``digest_left`` and ``digest_right`` in lower-case hex."""
    spark = left.sparkSession
    columns = ["archive", "record_id", "offset", "length", "digest"]
    a, b = (stored(spark, x.select(*columns), "replica") for x in (left, right))
    extent = a.unionByName(b).agg(F.max("offset")).first()[0] or 0
    levels = _levels_for(extent + 1, range_bytes, fanout)
    tree_a, tree_b = merkle_tree(a, levels, range_bytes, fanout), merkle_tree(b, levels, range_bytes, fanout)
    bad = None
    for level in range(levels, -1, -1):
        x, y = tree_a[level], tree_b[level]
        if bad is not None:
            x, y = (_below(t, bad, F.floor(t["node"] / fanout)) for t in (x, y))
        both = x.join(y, _same(["archive", "node"], x, y), "full").where(~x["hash"].eqNullSafe(y["hash"]))
        there = x["hash"].isNotNull()
        bad = stored(spark, both.select(F.when(there, x["archive"]).otherwise(y["archive"]).alias("archive"),
                                        F.when(there, x["node"]).otherwise(y["node"]).alias("node")), "merkle-differ")
    key = ["archive", "record_id", "offset"]

    def one(t: DataFrame) -> DataFrame:
        t = _below(t, bad, F.floor(t["offset"] / range_bytes))
        return t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"), F.max("digest").alias("last"), F.sum("length").alias("length"))

    x, y = one(a), one(b)
    both = x.join(y, _same(key, x, y), "full")
    gone, new = y["n"].isNull(), x["n"].isNull()
    differ = both.where(gone | new | ~(x["n"].eqNullSafe(y["n"]) & x["digest"].eqNullSafe(y["digest"]) & x["last"].eqNullSafe(y["last"]) & x["length"].eqNullSafe(y["length"])))
    return differ.select(
        *[F.when(new, y[c]).otherwise(x[c]).alias(c) for c in key],
        F.when(gone, "lost").when(new, "added").otherwise("changed").alias("state"),
        F.lower(F.hex(x["digest"])).alias("digest_left"), F.lower(F.hex(y["digest"])).alias("digest_right"),
    )
