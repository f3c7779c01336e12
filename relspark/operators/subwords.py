"""Subword encoding of model inputs: longest-match-first pieces through a distinct-word table.

Texts are split into words in their scan: each block of rows (``BLOCK_BYTES`` of text, or one longer
row) becomes a dictionary of its distinct words and, per text, numbers into it.  The dictionaries meet
in a table of distinct words, where every word is segmented once; its ids go back to the blocks by
a join, and each block's texts are laid out from its dictionary.  So dictionaries are shuffled,
never a row for each word, and a word that stands in every text is one row a block.

Pieces are a table ``(piece, piece_id)``; a piece that continues a word begins with ``##``.  Up to
``PIECE_BYTES`` they are shipped to the workers as a trie; a larger table is joined to the words' substrings.

Nulls count as empty texts.  A word without a segmentation, or longer than ``MAX_WORD_CHARS``, is the
unknown piece.  The special tokens of a text (``[SEP]``, entity marks) are words of their own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .inputs import PAIR_LAYOUT, encode_pair

BLOCK_BYTES = 4 << 20
PIECE_BYTES = 64 << 20
MAX_WORD_CHARS = 100
CONTINUES = "##"
# fixed values: special tokens of the encoded layout and of marked entities
PAD, UNKNOWN, BEGIN, BETWEEN = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
MARKS = ("[E1]", "[/E1]", "[E2]", "[/E2]", "[E1-NER]", "[E2-NER]")
# fixed values: a word is a run of characters other than ASCII white space, controls and punctuation, or one punctuation character
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def word_pattern(special: Sequence[str]) -> str:
    return "|".join([*(re.escape(s) for s in sorted(special, key=len, reverse=True)), _WORD])


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: both of its readers see one version."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- words of blocks ---------------------------------------------------------------------------


def word_blocks(df: DataFrame, text_cols: Sequence[str], keep: Sequence[str], special: Sequence[str]) -> DataFrame:
    """One row a block: ``block``, ``words`` (distinct, in order of appearance), for each text column ``codes_<i>``
    (numbers of its words, all rows after one another) and ``counts_<i>`` (words of each row), and the kept
    columns as arrays."""
    fields = [T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]
    for i in range(len(text_cols)):
        fields += [T.StructField(f"{n}_{i}", T.ArrayType(T.IntegerType())) for n in ("codes", "counts")]
    fields += [T.StructField(f"keep_{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(keep)]
    pattern = word_pattern(special)
    n_text = len(text_cols)

    def cuts(batch):
        import pyarrow.compute as pc

        size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_text))
        begin, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > BLOCK_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        find = re.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in cuts(whole) if whole.num_rows else ():
                number: dict[str, int] = {}
                cols: list = []
                for i in range(n_text):
                    codes, counts = [], []
                    for text in batch.column(i).to_pylist():
                        found = find(text) if text else ()
                        codes += [number.setdefault(w, len(number)) for w in found]
                        counts.append(len(found))
                    cols += [pa.array([codes], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int32()))]
                for c in batch.columns[n_text:]:
                    cols.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
                head = [pa.array([block], pa.int64()), pa.array([list(number)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(head + cols, [f.name for f in fields])
                block += 1

    return df.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text_cols)],
                     *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).mapInArrow(run, T.StructType(fields))


# --- segmentation of distinct words ------------------------------------------------------------


class PieceTrie:
    """Pieces by character; a node's id stands under the empty string."""

    def __init__(self, pieces: Sequence[tuple[str, int]], special: Sequence[str] = ()):
        self.begin: dict = {}
        self.follow: dict = {}
        self.whole = {p: i for p, i in pieces if p in set(special)}
        self.unknown = dict(pieces)[UNKNOWN]
        for piece, i in pieces:
            follows = piece.startswith(CONTINUES) and len(piece) > len(CONTINUES)
            node = self.follow if follows else self.begin
            for c in piece[len(CONTINUES) :] if follows else piece:
                node = node.setdefault(c, {})
            node[""] = i

    def segment(self, word: str) -> list[int]:
        """The longest piece that begins the rest of the word, until nothing is left."""
        if word in self.whole:
            return [self.whole[word]]
        if len(word) > MAX_WORD_CHARS:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            node, end, found = self.follow if at else self.begin, at, None
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    end, found = i + 1, node[""]
            if found is None:
                return [self.unknown]
            out.append(found)
            at = end
        return out


_TRIES: dict[str, PieceTrie] = {}


def segment_by_trie(words: DataFrame, pieces: DataFrame, special: Sequence[str]) -> DataFrame:
    """``word, ids`` of distinct ``word`` rows; the pieces go to the workers."""
    spark = words.sparkSession
    rows = [(r[0], r[1]) for r in pieces.select("piece", "piece_id").collect()]  # within PIECE_BYTES
    shipped, key, special = spark.sparkContext.broadcast(rows), uuid.uuid4().hex, tuple(special)

    def run(batches):
        import pyarrow as pa

        if key not in _TRIES:
            _TRIES.clear()  # one vocabulary a worker
            _TRIES[key] = PieceTrie(shipped.value, special)
        trie = _TRIES[key]
        for batch in batches:
            ids = [trie.segment(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def segment_by_join(words: DataFrame, pieces: DataFrame, special: Sequence[str]) -> DataFrame:
    """As :func:`segment_by_trie` for pieces of any number: the words' substrings, at most
    ``MAX_WORD_CHARS`` squared a word, are joined with them and the longest ones followed from the left."""
    p = pieces.select("piece", F.col("piece_id").alias("id"), F.length("piece").alias("chars"))
    longest = p.agg(F.max("chars")).first()[0] or 0
    unknown = pieces.where(F.col("piece") == UNKNOWN).select("piece_id").first()[0]
    plain = (F.length("word") <= MAX_WORD_CHARS) & ~F.col("word").isin(*special)
    at = words.select("word", F.explode(F.when(plain, F.sequence(F.lit(1), F.length("word")))).alias("at"))
    span = at.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("n"))
    named = F.concat(F.when(F.col("at") > 1, F.lit(CONTINUES)).otherwise(""), F.substring(F.col("word"), F.col("at"), F.col("n")))
    # at the beginning a piece that looks like a continuation is one only from the second character on
    found = span.withColumn("piece", named).join(p, "piece").where(
        ~((F.col("at") == 1) & F.col("piece").startswith(CONTINUES) & (F.col("chars") > len(CONTINUES))))
    best = found.groupBy("word", "at").agg(F.max(F.struct("n", "id")).alias("b"))
    steps = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "b.n", "b.id"))).alias("steps"))  # a word's characters
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"))
    walked = F.aggregate("steps", start, lambda acc, s: F.when(
        s["at"] == acc["next"], F.struct((acc["next"] + s["n"]).alias("next"), F.concat(acc["ids"], F.array(s["id"])).alias("ids"))).otherwise(acc))
    reached = steps.select("word", walked.alias("w"))
    alone = p.where(F.col("piece").isin(*special)).select(F.col("piece").alias("word"), F.col("id").alias("own"))
    ids = F.when(F.col("own").isNotNull(), F.array("own")).when(F.col("w.next") == F.length("word") + 1, F.col("w.ids")).otherwise(F.array(F.lit(unknown)))
    return words.select("word").join(reached, "word", "left").join(alone, "word", "left").select("word", ids.alias("ids"))


def segment_words(words: DataFrame, pieces: DataFrame, special: Sequence[str] = (BETWEEN, *MARKS), limit: int = PIECE_BYTES) -> DataFrame:
    """``word, ids`` of distinct ``word`` rows, by trie or, for more than ``limit`` bytes of pieces, by join."""
    facts = pieces.agg(F.sum(F.octet_length("piece") + 32).alias("bytes"), F.count(F.lit(1)).alias("n"),
                       F.count_distinct("piece").alias("names"), F.max(F.col("piece") == UNKNOWN).alias("unknown")).first()
    if not facts.unknown or facts.names != facts.n:
        raise ValueError(f"pieces must be distinct and hold {UNKNOWN}")
    return (segment_by_trie if facts.bytes <= limit else segment_by_join)(words, pieces, special)


# --- texts of ids ------------------------------------------------------------------------------


def subword_ids(df: DataFrame, pieces: DataFrame, text_cols: Sequence[str], keep: Sequence[str] = ("example_id",),
                special: Sequence[str] = (BETWEEN, *MARKS)) -> DataFrame:
    """The kept columns and, for each text column, ``ids_<i>``: the piece ids of the whole text."""
    keep = list(keep)
    blocks = _written(word_blocks(df, text_cols, keep, special), "word-blocks")
    entries = blocks.select("block", F.posexplode("words").alias("at", "word"))
    segmented = _written(segment_words(entries.select("word").distinct(), pieces, special), "segmented-words")
    found = entries.join(segmented, "word").select(F.col("block").alias("owner"), "at", "ids")
    n_text = len(text_cols)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(f"ids_{i}", T.ArrayType(T.IntegerType())) for i in range(n_text)])

    def lay_out(block, entries):
        """One block (bounded by its text): ids of its words, in order, put where their numbers stand."""
        import pyarrow as pa

        block, entries = block.combine_chunks(), entries.sort_by("at").combine_chunks()
        cells = entries.column("ids").combine_chunks() if entries.num_rows else pa.array([], pa.list_(pa.int32()))
        ids = cells.flatten().to_numpy(zero_copy_only=False)
        size = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size

        def cell(name):
            return block.column(name).combine_chunks().flatten()

        cols = [cell(f"keep_{i}") for i in range(len(keep))]
        for i in range(n_text):
            codes, counts = (cell(f"{n}_{i}").to_numpy(zero_copy_only=False) for n in ("codes", "counts"))
            each = size[codes]
            end = np.cumsum(each)
            at = np.repeat(first[codes] - (end - each), each) + np.arange(end[-1] if len(end) else 0)
            bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[at], pa.int32())))
        return pa.table(cols, names=schema.names)

    return blocks.drop("words").groupBy("block").cogroup(found.groupBy("owner")).applyInArrow(lay_out, schema)


def special_ids(pieces: DataFrame) -> dict[str, int]:
    """Ids of the layout's special tokens; each must be a piece."""
    names = (PAD, UNKNOWN, BEGIN, BETWEEN)
    found = {r.piece: r.piece_id for r in pieces.where(F.col("piece").isin(*names)).collect()}
    if missing := sorted(set(names) - set(found)):
        raise ValueError(f"no pieces {missing}")
    return found


def encode_subwords(df: DataFrame, pieces: DataFrame, text_col: str = "text", pair_col: str | None = "text_pair",
                    max_length: int | str = "max_length", padding: str = "none", special: Sequence[str] = (BETWEEN, *MARKS)) -> DataFrame:
    """``MODEL_INPUT`` rows as model features: ``input_ids``, ``attention_mask``, ``segment_ids``, the kept counts
    ``n_a`` and ``n_b``, and the whole texts' ids ``ids_0`` and ``ids_1`` (the second if there is a pair).

    The layout and the truncation are those of :func:`relspark.operators.inputs.encode_pair`."""
    known = special_ids(pieces)
    texts = [text_col] + ([pair_col] if pair_col else [])
    keep = [c for c in ("example_id", "variant") if c in df.columns] + ([max_length] if isinstance(max_length, str) else [])
    ids = subword_ids(df, pieces, texts, keep, special)
    layout: dict[str, Column] = {k: F.lit(known[v]) for k, v in zip(PAIR_LAYOUT, (BEGIN, BETWEEN, PAD), strict=True)}
    out = encode_pair(
        ids, text_col="ids_0", pair_col=None, max_length=max_length, padding=padding, tokens_a=F.col("ids_0"),
        tokens_b=F.col("ids_1") if pair_col else None, layout=layout,
    )
    return out.withColumnRenamed("tokens", "input_ids")
