"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its runs of five words, each weighted by how often it occurs.  The
region of an element is split into unit-weight cells; darts strike a cell at the arrival times
of a Poisson process that is seeded by the cell's hash, each at a hashed coordinate.  A document
keeps the earliest dart of each coordinate, so two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.  Darts are thrown only up to the time by which
all coordinates are expected to be struck (about ``COORDINATES`` x ``DARTS`` darts, whatever the
document's length) and further for the few documents that are not filled by then.

Equal texts are one class before anything else.  Classes that agree in a whole band meet in a
bucket.  A bucket does not emit its pairs: its members are first compared with one centre, the class that is
in the most and largest buckets, and the verified links give components.  Where many members stay outside their bucket's
largest component, they meet further centres of it, one a turn, as long as that helps; each turn
is linear in the members.  Then every pair of a bucket that could still join two
components is verified, so no link of a bucket is lost.  Left out before are texts and pairs that
cannot reach ``SIMILARITY``: what texts of two components share is at most what either has in common
cells, those of other components and more than ``RARE`` texts, unless they share a rare cell too; pairs with a
shared rare cell are few (at most ``RARE`` for each cell and text) and are verified by themselves.  So a
text with many cells of its own (an edited copy whose edits nobody else has) meets nobody.  A pair of
exactly ``SIMILARITY`` shares no bucket with probability 4.9e-5 (closer pairs with less): such a link
is found only if other texts connect the two.  A link needs an exact
weighted Jaccard similarity of ``SIMILARITY``.

Cases: null counts as empty; texts without words are linked only to equal texts; a text of fewer
than five words is one run.  Repeated rows and ids give one row each.  An empty table gives no
rows.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import _MULT, batch_rows, broadcast_if_small, forget, fresh_names, mix64, release, shingle_hashes, stored, text_bytes, word_bounds, word_hashes
from relspark.llm.components import connected_components, merged_components

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at SIMILARITY meets in no band with probability (1 - 0.8**5)**25 = 4.9e-5
COORDINATES = BANDS * ROWS
RARE = 8  # texts that a rare cell is in at most
DARTS = 10.0  # darts expected at each coordinate
# further centres are tried while the pairs left exceed LINEAR for each member and the last
# centre has brought them below GAIN of what they were
LINEAR, GAIN = 4, 0.8
BATCH_BYTES = 4 << 20


def unit_cells(col: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's unit-weight cells (a run of words and its number among the equal
    runs of that text) and the index of each text's first cell."""
    flat, offsets = text_bytes(col)
    starts, ends, first = word_bounds(flat, offsets)
    runs, first = shingle_hashes(word_hashes(flat, starts, ends), first, run)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((runs, row))
    new = np.ones(len(runs), bool)
    new[1:] = (runs[order][1:] != runs[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0)) if len(runs) else np.zeros(0, np.int64)
    number = np.empty(len(runs), np.uint64)
    number[order] = (np.arange(len(runs)) - begin).astype(np.uint64)
    return mix64(runs + number * _MULT), first


def signatures(cells: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart (its time) of each coordinate for every non-empty row of cells; rows without
    cells hold infinity."""
    rows = len(first) - 1
    best = np.full(rows * k, np.inf)
    size = np.diff(first)
    row_of = np.repeat(np.arange(rows), size)
    limit = np.where(size > 0, DARTS * k / np.maximum(size, 1), 0.0)
    todo = np.flatnonzero(size > 0)
    time, state, cell = np.zeros(len(cells)), cells.copy(), np.arange(len(cells))
    while len(todo):
        # throw on from where each cell stands up to its row's limit
        live = cell
        pending_cell, pending_time, pending_state = [], [], []
        t, s = time, state
        while len(live):
            nxt = mix64(s + _MULT)
            gap = -np.log1p(-((nxt >> np.uint64(11)).astype(np.float64) * 2.0**-53))
            arrive = t + gap
            hit = arrive < limit[row_of[live]]
            pending_cell.append(live[~hit])
            pending_time.append(t[~hit])
            pending_state.append(s[~hit])
            live, t, s = live[hit], arrive[hit], nxt[hit]
            slot = row_of[live] * k + (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, t)
        todo = np.flatnonzero(np.isinf(best.reshape(rows, k)).any(axis=1) & (size > 0))
        limit[todo] *= 2
        keep = np.zeros(rows, bool)
        keep[todo] = True
        cell, time, state = (np.concatenate(x) for x in (pending_cell, pending_time, pending_state))
        again = keep[row_of[cell]]
        cell, time, state = cell[again], time[again], state[again]
    return best.reshape(rows, k)


def _bands(batches):
    for batch in batches:
        for part in batch_rows(batch, BATCH_BYTES):
            cells, first = unit_cells(part.column("text"))
            sig = signatures(cells, first).view(np.uint64).reshape(len(part), BANDS, ROWS)
            key = np.full((len(part), BANDS), np.uint64(0))
            for j in range(ROWS):
                key = mix64((key ^ sig[:, :, j]) + _MULT)
            key = mix64(key + np.arange(BANDS, dtype=np.uint64) * _MULT).view(np.int64)
            some = np.diff(first) > 0
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32), pa.array(key[some].ravel()))
            n_cells = pa.array(np.diff(first).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], n_cells, lists], ["key", "row_id", "cid", "n_cells", "bands"])
            del cells, first, sig, key, lists
            release()


def _cells(batches):
    for batch in batches:
        for part in batch_rows(batch, BATCH_BYTES):
            cells, first = unit_cells(part.column("text"))
            short = (cells >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(short))], ["cid", "cells"])
            release()


def near_size(a: str, b: str, similarity: float) -> Column:
    """Whether texts of ``a`` and ``b`` cells can be so similar: they share the fewer of them at most."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def verified(pairs: DataFrame, cells: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose weighted Jaccard similarity is ``similarity`` or more.  Cells are
    compared by 32 bits of their hashes, distinct within a text up to a share of n / 2**33."""
    left = cells.select(F.col("cid").alias("a"), F.col("cells").alias("ca"))
    right = cells.select(F.col("cid").alias("b"), F.col("cells").alias("cb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ca", "cb"))
    union = F.size("ca") + F.size("cb") - common
    return both.where(common >= similarity * union).select("a", "b")


def shared_cells(members: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cid``, ``most`` and ``core``: how many cells of a text are in a text of another component (``comp``) of
    ``members`` too, and how many of these in more than ``RARE`` texts; and the pairs ``a``, ``b`` of
    two components that share a rarer one.  Equal cells within a text, or by their 32 bits, only raise the bounds."""
    spark = members.sparkSession
    # texts and components by number: sums over long numbers are hashed, over binary ids they would be sorted
    texts = stored(spark, members.select("cid", "n_cells", "comp").distinct().withColumn("t", F.monotonically_increasing_id()), "texts")
    numbers = stored(spark, texts.groupBy("comp").agg(F.min("t").alias("c")), "texts")
    each = cells.join(texts.join(numbers, "comp").select("cid", "t", "c"), "cid").select("t", "c", F.explode("cells").alias("cell"))
    met = each.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("cell", "n")
    met = stored(spark, met, "shared-cells")
    cross = stored(spark, each.join(met, "cell"), "shared-cells")
    rare = cross.where(F.col("n") <= RARE)
    pairs = rare.select("cell", F.col("t").alias("x"), F.col("c").alias("cx")).join(rare.select("cell", F.col("t").alias("y"), F.col("c").alias("cy")), "cell")
    pairs = pairs.where("x < y and cx <> cy").select("x", "y").distinct()
    of = lambda t, name: texts.select(F.col("t").alias(t), F.col("cid").alias(name))
    pairs = pairs.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
    counts = cross.groupBy("t").agg(F.count(F.lit(1)).cast("int").alias("most"), F.count(F.when(F.col("n") > RARE, 1)).cast("int").alias("core"))
    known = texts.join(counts, "t", "left").select("cid", "n_cells", F.coalesce("most", F.lit(0)).alias("most"), F.coalesce("core", F.lit(0)).alias("core"))
    bounds = stored(spark, known, "cell-bounds")
    found = stored(spark, pairs, "rare-pairs")
    forget(met, cross, texts, numbers)
    return bounds, found


def can_reach(most: Column, n: Column, other: Column, similarity: float) -> Column:
    """Whether a text of ``n`` cells that shares ``most`` at most can be so similar to one of ``other`` cells."""
    return most >= similarity * (n + F.greatest(other, most) - most)


def bounded(x: str, n: str, y: str, m: str, similarity: float) -> Column:
    """Whether texts of ``n`` and ``m`` cells that can share ``x`` and ``y`` of them can be so similar."""
    both = F.least(x, y)
    return both >= similarity * (F.col(n) + F.col(m) - both)


def _apart(pairs: DataFrame, bounds: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` of different components that can be so similar."""
    named = bounds.join(comp, bounds["cid"] == comp["node"], "left").select("cid", "n_cells", "most", F.coalesce("component", "cid").alias("comp"))
    left = named.toDF("a", "na", "ma", "ca")
    right = named.toDF("b", "nb", "mb", "cb")
    both = pairs.join(left, "a").join(right, "b").where("ca <> cb").where(near_size("na", "nb", similarity))
    return both.where(bounded("ma", "na", "mb", "nb", similarity)).select("a", "b")


def _split_buckets(members: DataFrame, comp: DataFrame, similarity: float) -> tuple[DataFrame, int, int]:
    """Members (``band, cid, n_cells, core, centre``) of the buckets that hold several components (``main``: the
    bucket's largest) and can have a link there, the pairs that remain between an outsider and
    another member, and the members' number."""
    placed = members.join(comp, members["cid"] == comp["node"], "left").select("band", "cid", "n_cells", "core", "centre", F.coalesce("component", "cid").alias("comp"))
    groups = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("n_cells").alias("least"))
    largest = groups.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least")).where("parts > 1")
    spark = members.sparkSession
    mains = stored(spark, largest.select("band", "main", "least"), "mains")
    live = placed.join(mains, "band").where(can_reach(F.col("core"), F.col("n_cells"), F.col("least"), similarity)).drop("least")
    split = stored(spark, live, "split-buckets")
    forget(mains)
    size = split.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("comp") != F.col("main"), 1).otherwise(0)).alias("o"))
    cross, rows = size.agg(F.coalesce(F.sum(F.col("n") * F.col("o")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return split, cross, rows


def has_repeats(ids: DataFrame) -> bool:
    """Whether a row (``key``, ``cid``) comes more than once."""
    return not ids.groupBy("key", "cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _classes(docs: DataFrame, similarity: float, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """``near_duplicates``, and the stored tables that it reads."""
    spark = docs.sparkSession
    cid = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("cid")
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row_id"), cid, "text")
    key_type = docs.schema[key].dataType.simpleString()
    signed = stored(spark, rows.mapInArrow(_bands, f"key {key_type}, row_id long, cid binary, n_cells int, bands array<long>"), "signatures")
    ids = stored(spark, signed.select("key", "row_id", "cid"), "ids")
    first = ids.groupBy("cid").agg(F.min(F.struct("key", "row_id")).alias("rep"))
    bands = signed.join(first.select("rep.row_id"), "row_id").select("cid", "n_cells", "bands")
    bucket = bands.select("cid", "n_cells", F.explode("bands").alias("band"))
    # aggregates are stored before they are joined back: the join is then between two exchanges,
    # and a hot bucket can be split
    sizes = stored(spark, bucket.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    met = stored(spark, bucket.join(sizes, "band"), "buckets")
    forget(signed, sizes)
    # the text that edited copies come from is in more and larger buckets than they are
    reach = stored(spark, met.groupBy("cid").agg(F.sum("n").alias("reach")), "reach")
    shared = stored(spark, met.select("band", "cid", "n_cells").join(reach, "cid"), "buckets")
    forget(met, reach)
    centres = shared.groupBy("band").agg(F.max_by(F.struct("cid", "n_cells"), F.struct("reach", "cid")).alias("c"))
    centres = stored(spark, centres.select("band", F.col("c.cid").alias("centre"), F.col("c.n_cells").alias("c_cells")), "centres")
    members = stored(spark, shared.select("band", "cid", "n_cells").join(centres, "band"), "buckets")
    forget(shared, centres)
    star = members.where("cid <> centre").where(near_size("n_cells", "c_cells", similarity)).select(F.least("centre", "cid").alias("a"), F.greatest("centre", "cid").alias("b")).distinct()
    # one text of each group of equal texts is read again
    meets = members.select("cid").distinct().join(first, "cid").select("cid", F.col("rep.key").alias("key"))
    meets = broadcast_if_small(meets, meets.agg(F.count(F.lit(1)) * 64))
    read = rows.drop("row_id").join(meets.withColumnRenamed("key", "rep_key"), "cid").where(F.col("key").eqNullSafe(F.col("rep_key")))
    cells = read.select("cid", "text").mapInArrow(_cells, "cid binary, cells array<int>")
    if has_repeats(ids):
        cells = cells.groupBy("cid").agg(F.first("cells").alias("cells"))
    cells = stored(spark, cells, "cells")
    links = stored(spark, verified(star, cells, similarity), "links")
    comp = stored(spark, connected_components(links), "components")
    forget(links)
    # at first every cell may be shared; what is shared in fact is counted for the buckets that are left
    split, cross, _ = _split_buckets(members.withColumn("core", F.col("n_cells")), comp, similarity)
    forget(members)
    bounds, rare = shared_cells(split, cells)
    left = stored(spark, split.select("band", "cid", "centre").join(bounds.select("cid", "n_cells", "core"), "cid"), "buckets")
    forget(split)
    split, cross, rows = _split_buckets(left, comp, similarity)
    turn, before = 0, None
    while cross > LINEAR * rows and (before is None or cross < GAIN * before):
        # another centre for each bucket: members elsewhere meet one more of its largest component
        turn, before = turn + 1, cross
        others = split.where("comp = main").groupBy("band").agg(F.min_by(F.struct("cid", "n_cells"), F.xxhash64("cid", F.lit(turn))).alias("c"))
        others = others.select("band", F.col("c.cid").alias("c"), F.col("c.n_cells").alias("c_cells"))
        pairs = split.where("comp <> main").join(others, "band").where(near_size("n_cells", "c_cells", similarity))
        pairs = pairs.select(F.least("c", "cid").alias("a"), F.greatest("c", "cid").alias("b")).distinct()
        comp = merged_components(comp, verified(pairs, cells, similarity))
        forget(split)
        split, cross, rows = _split_buckets(left, comp, similarity)
    forget(left)
    out = split.where("comp <> main").select("band", F.col("cid").alias("o"), F.col("comp").alias("o_comp"), F.col("n_cells").alias("o_cells"), F.col("core").alias("o_core"))
    rest = split.join(out, "band").where("comp <> o_comp and cid <> centre and o <> centre and (comp = main or cid < o)").where(near_size("n_cells", "o_cells", similarity))
    rest = rest.where(bounded("core", "n_cells", "o_core", "o_cells", similarity)).select(F.least("o", "cid").alias("a"), F.greatest("o", "cid").alias("b"))
    rest = rest.unionByName(_apart(rare, bounds, comp, similarity))
    comp = merged_components(comp, verified(rest.distinct(), cells, similarity))
    forget(split, cells, bounds, rare)
    named = first.join(comp, first["cid"] == comp["node"], "left").select("cid", "rep", F.coalesce("component", "cid").alias("comp"))
    classes = stored(spark, named, "classes")
    forget(comp)
    best = stored(spark, classes.groupBy("comp").agg(F.min("rep").alias("best")), "classes")
    named = stored(spark, classes.join(best, "comp").select("cid", "best"), "classes")
    forget(classes, best)
    return ids.join(named, "cid").select(
        F.col("key").alias(key), F.col("best.key").alias("class_id"), F.lower(F.hex("cid")).alias("text_id"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept")), [ids, named]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the smallest ``key`` of its near-duplicate class),
    ``text_id`` (same for equal texts) and ``kept`` (the one row of its class to keep)."""
    return _classes(docs, similarity, key)[0]


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest ``key`` (of the
    smallest text hash among equal keys)."""
    k_key, k_text, text_hash = fresh_names(docs, "k_key", "k_text", "text_id")
    found, tables = _classes(docs, similarity, key)
    kept = stored(docs.sparkSession, found.where("kept").select(F.col(key).alias(k_key), F.col("text_id").alias(k_text)), "kept")
    forget(*tables)
    kept = broadcast_if_small(kept, kept.agg(F.count(F.lit(1)) * 64))
    text_id = F.md5(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(kept, docs[key].eqNullSafe(F.col(k_key)) & (text_id == F.col(k_text)), "left_semi")
    repeats = has_repeats(docs.select(F.col(key).alias("key"), text_id.alias("cid")))
    return out.withColumn(text_hash, text_id).dropDuplicates([key, text_hash]).drop(text_hash) if repeats else out
