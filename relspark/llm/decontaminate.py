"""Benchmark decontamination: a hash set of normalised test n-grams scans training windows.

Words are maximal runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.  A
test window is 13 consecutive words of an item (a shorter item is one window).  Every window
is filed under its *anchor*: the two adjacent words with the most letters (the single word for
a one-word window), which is rare in running text.  Hashes of the anchors, reduced to fixed
ranges, are the broadcast hash set: at most ``2**SET_BITS`` numbers whatever the benchmark's
size.  The scan keeps, inside each row, the word positions whose hash is in the set, joins
them with the windows on the anchor itself and verifies all words of the window, so a false
hit of the set never reaches the result.  DataFrame functions only.

Cases: null or empty text has no words (0, 0, 0, not contaminated).  Equal documents and
repeated ``doc_id`` give one row each.  Items without words or with a null text give no
window; windows of items with a null ``item_id`` hit but count no item.  An empty benchmark
gives no hits.  Further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import ascii_lower, broadcast_if_small, fresh_names, raw_words, stored

WINDOW = 13
WORD_BITS = 18
SET_BITS = 20
MIN_SHARE = 20  # contaminated when MIN_SHARE * n_hit >= n_words


def _word_slot(word):
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(1 << WORD_BITS))


def _anchor_slot(anchor):
    return F.pmod(F.xxhash64(F.lower(anchor)), F.lit(1 << SET_BITS))


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words, n, anchor, at)``: each item's windows; ``at`` is the anchor's
    position in the window, from 0."""
    words = benchmark.select("item_id", raw_words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("run"))
    each = each.withColumn("n", F.size("run"))
    pair = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - 2, F.lit(0))),
        lambda i: F.struct(
            (F.length(F.get("run", i)) + F.coalesce(F.length(F.get("run", i + 1)), F.lit(0))).alias("letters"),
            F.concat_ws(" ", F.get("run", i), F.get("run", i + 1)).alias("anchor"),
            i.alias("at"),
        ),
    )
    best = F.array_max(pair)
    return each.select("item_id", F.array_join("run", " ").alias("words"), "n", best["anchor"].alias("anchor"), best["at"].alias("at"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(found, items)``.  ``found`` has ``key``, ``text_hash``, ``row_id``, ``n_words`` and one
    row per candidate: a verified occurrence has ``start`` (from 1), ``n`` and ``window_id``,
    any other row nulls there; every document has a row.  ``items`` maps ``window_id`` to
    ``item_id``."""
    spark = docs.sparkSession
    every = stored(spark, test_windows(benchmark, window), "test-windows")
    anchors = every.select("anchor", F.substring_index("anchor", " ", 1).alias("head"), (F.instr("anchor", " ") == 0).alias("lone")).distinct()
    # bounded by the two ranges, not by the benchmark: the hash set
    heads = [r[0] for r in anchors.where("not lone").select(_word_slot(F.col("head"))).distinct().collect()]
    slots = [r[0] for r in anchors.where("not lone").select(_anchor_slot(F.col("anchor"))).distinct().collect()]
    alone = [r[0] for r in anchors.where("lone").select(_anchor_slot(F.col("anchor"))).distinct().collect()]

    def is_candidate(i):
        word, nxt = F.get("w", i), F.get("w", i + 1)
        hit = F.lit(False)
        if slots:
            hit = _word_slot(word).isin(heads) & nxt.isNotNull() & _anchor_slot(F.concat_ws(" ", word, nxt)).isin(slots)
        if alone:
            hit = hit | _anchor_slot(word).isin(alone)
        return hit

    words = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row_id"), F.xxhash64("text").alias("text_hash"), raw_words(F.col("text")).alias("w"))
    words = words.withColumn("n_words", F.size("w"))
    at = F.filter(F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1)), is_candidate)

    def context(i):
        begin = F.greatest(i - (window - 1), F.lit(0))
        near = F.split(ascii_lower(F.array_join(F.slice("w", begin + 1, 2 * window), " ")), " ")
        return F.struct(i.alias("i"), begin.alias("begin"), near.alias("near"))

    scan = words.select("key", "row_id", "text_hash", "n_words", F.explode_outer(F.transform(at, context)).alias("c"))
    here = F.col("c.i") - F.col("c.begin")
    pair = F.concat_ws(" ", F.get("c.near", here), F.get("c.near", here + 1))
    keys = [pair] * bool(slots) + [F.get("c.near", here)] * bool(alone) or [F.lit(None).cast("string")]
    scan = scan.withColumn("look", F.explode_outer(F.array(*keys)) if len(keys) > 1 else keys[0])
    texts = every.groupBy("words", "n", "anchor", "at").agg(F.sha2("words", 256).alias("window_id"))
    texts = broadcast_if_small(texts, every.agg(F.sum(F.octet_length("words") + F.octet_length("anchor") + 128)))
    offset = F.col("c.i") - F.col("at") - F.col("c.begin")
    same = (F.col("look") == F.col("anchor")) & (offset >= 0) & (F.array_join(F.slice("c.near", offset + 1, F.col("n")), " ") == F.col("words"))
    found = scan.join(texts, same, "left").select(
        F.col("key").alias(key), "text_hash", "row_id", "n_words",
        F.when(F.col("window_id").isNotNull(), F.col("c.i") - F.col("at") + 1).alias("start"), "n", "window_id",
    )
    items = every.where("item_id is not null").select(F.sha2("words", 256).alias("window_id"), "item_id").distinct()
    return found, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """One row per document: ``n_words``, ``n_hit`` (words inside an occurrence), ``n_items``,
    ``items_sha256``, ``contaminated``, ``text_hash`` and ``spans`` (``start``, ``end`` in words
    from 0, end exclusive).

    The hits of one document meet in one group, bounded by its words times the window lengths."""
    found, items = find_windows(docs, benchmark, window, key)
    per_doc = found.groupBy("row_id").agg(
        F.first(key).alias(key),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "n"))).alias("hits"),
        F.collect_set("window_id").alias("windows"),
    )
    per_doc = stored(docs.sparkSession, per_doc, "hits")  # one scan, and row ids that stay
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    spans = F.array_sort(F.transform("hits", lambda h: F.struct((h["start"] - 1).alias("start"), (h["start"] + h["n"] - 1).alias("end"))))
    named = (
        per_doc.where(F.size("windows") > 0)
        .select("row_id", F.explode("windows").alias("window_id"))
        .join(items, "window_id")
        .groupBy("row_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    n_hit = F.size(covered).cast("long")
    return per_doc.join(named, "row_id", "left").select(
        key, "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(MIN_SHARE) * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash", spans.alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they came."""
    bad_key, bad_hash = fresh_names(docs, "bad_key", "bad_hash")
    bad = contamination(docs, benchmark, window, key).where("contaminated").select(F.col(key).alias(bad_key), F.col("text_hash").alias(bad_hash)).distinct()
    bad = stored(docs.sparkSession, bad, "contaminated")
    bad = broadcast_if_small(bad, bad.agg(F.count(F.lit(1)) * 64))
    return docs.join(bad, docs[key].eqNullSafe(F.col(bad_key)) & (F.xxhash64(docs["text"]) == F.col(bad_hash)), "left_anti")
