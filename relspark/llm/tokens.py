"""BPE encoding and decoding through a distinct-word table.

A text's words (the tokenizer's own pre-tokens, which partition the text) are split by a SQL
regular expression.  Blocks of documents of bounded size become a dictionary of distinct words
and, per document, word positions as numbers into it.  The dictionaries meet in a table that is
dealt by word: every distinct word of the corpus is encoded once, by the vocabulary's merges.
Its ids go back to their blocks, are decoded there by the id-to-piece table, once for each
distinct word of a block, and are put in place by position.  So what is shuffled is dictionaries and
word numbers, never one row for each word or token, and the costly merge loop runs once for
each distinct word.  Only ids go back: the piece table meets the blocks in a join, one row a block.

The split is exact where the expression's and the tokenizer's character classes agree; a text
with a character outside those ranges, or with a special token's string, is split by the
tokenizer's own pre-tokenizer in the worker instead.

Cases: null counts as empty (no tokens, empty decoded text).  Repeated documents and ids give
one row each.  Special-token strings in a text become their ids, as the library does by
default.  An empty table gives no rows.  A very long text is one block.  Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from relspark.llm.common import batch_bytes, batch_rows, bucketed, release, text_bytes, word_hashes

BLOCK_BYTES = 4 << 20  # text bytes of an Arrow batch; a block holds about twice that
# fixed values: the byte-level pre-tokenizer's word pattern, with Unicode white space
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters on which both regular-expression engines agree (tested one by one)
PLAIN = r"\x{0}-\x{557}\x{2010}-\x{2060}\x{20A0}-\x{20BF}\x{2190}-\x{23FF}\x{2500}-\x{2B73}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FEF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1F64F}"


class Vocabulary:
    """A byte-level BPE tokenizer file: the merges, the pieces and the special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.encoder = Tokenizer.from_file(path)
        self.encoder.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.encoder.encode_special_tokens = True
        self.encoder.no_truncation()
        self.encoder.no_padding()

    def split(self, text: str) -> list[str]:
        """Words and special tokens of ``text``, in order; together they are the text."""
        import re

        if not text:
            return []
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(part)]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a special token's string, which no word can equal, gives its id."""
        got = self.encoder.encode_batch(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, got, strict=True)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once for each worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
        release()  # the parsed file
    return _LOADED[path]


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``vocab`` 0, ``pieces``, the piece of every id as byte letters (a special token's
    string too), and ``hex_pieces``, its bytes in hex.  Its size is that of the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    piece = {i: p for p, i in spec["model"]["vocab"].items()}
    piece |= {t["id"]: "".join(letters[b] for b in t["content"].encode()) for t in spec["added_tokens"]}
    rows = [piece.get(i) for i in range(max(piece) + 1)]
    byte_of = {c: b for b, c in enumerate(letters)}
    as_hex = [None if p is None else bytes(byte_of[c] for c in p).hex() for p in rows]
    return spark.createDataFrame([(0, rows, as_hex)], "vocab int, pieces array<string>, hex_pieces array<string>")


def split_words(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``size`` (text bytes) and ``words`` by the SQL expression, or null with ``text``
    where the tokenizer's own splitter must decide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike(f"[^{PLAIN}]")
    for s in vocabulary(path).special:
        plain = plain & ~F.contains(text, F.lit(s))
    return docs.select(
        F.col(key).alias("key"), F.octet_length(text).alias("size"),
        F.when(plain, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"), F.when(~plain, text).alias("text"),
    )


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, byte plane by byte plane, compressed."""
    return _press(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _blocks(path: str, buckets: int, key_type: pa.DataType):
    """mapInArrow function: documents to blocks, each a dictionary of distinct words dealt to
    ``buckets`` and the documents as numbers into it."""
    chunk_words = 1 << 18
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()),
                        ("keys", pa.list_(key_type)), ("counts", pa.list_(pa.int32()))])

    def row(**values):
        arrays = [pa.array([values.get(f.name)], f.type) if not isinstance(values.get(f.name), pa.Array) else
                  pa.ListArray.from_arrays(pa.array([0, len(values[f.name])], pa.int32()), values[f.name]) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def flush(block: int, keys, counts, flats):
        flat = pa.concat_arrays(flats) if flats else pa.array([], pa.string())
        flats.clear()
        coded = flat.dictionary_encode()
        del flat
        number = coded.indices.to_numpy(zero_copy_only=False)
        data, at = text_bytes(coded.dictionary.cast(pa.string()))
        size = np.diff(at)
        bucket = (word_hashes(data, at[:-1], at[1:], lower=False) % np.uint64(buckets)).astype(np.int64)
        # frequent words get small numbers, which compress well
        by_count = np.argsort(-np.bincount(number, minlength=len(size)), kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_count] = np.arange(len(size))
        order = by_count[np.argsort(bucket[by_count], kind="stable")]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = order[cut[b] : cut[b + 1]]
            if len(mine):
                take = np.repeat(at[:-1][mine] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(size[mine].sum())
                yield row(kind="words", block=block, bucket=b, numbers=_pack(np.diff(rank[mine], prepend=0)), sizes=_pack(size[mine]), words=_press(data[take].tobytes()))
        count = np.concatenate(counts)
        ends = np.cumsum(count)
        all_keys = pa.concat_arrays(keys)
        i = 0
        while i < len(count):  # about chunk_words words to a row
            begin = ends[i] - count[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + chunk_words)))
            yield row(kind="docs", block=block, bucket=None if i else 0, keys=all_keys[i:j], counts=pa.array(count[i:j], pa.int32()), numbers=_pack(rank[number[begin : ends[j - 1]]]))
            i = j

    def run(batches):
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0
        keys, counts, flats, held = [], [], [], 0
        for batch in batches:
            for part in batch_rows(batch, BLOCK_BYTES, "size"):
                lists = part.column("words")
                if lists.null_count:
                    texts = part.column("text").to_pylist()
                    vocab = vocabulary(path)
                    lists = pa.array([vocab.split(t) if t is not None else w for t, w in zip(texts, lists.to_pylist(), strict=True)], pa.list_(pa.string()))
                keys.append(part.column("key"))
                counts.append(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                flats.append(lists.flatten())
                held += pa.compute.sum(part.column("size")).as_py() or 0
                if held >= 7 * BLOCK_BYTES // 4:  # a block is two such parts or several small batches
                    yield from flush(base + seq, keys, counts, flats)
                    keys, counts, flats, held, seq = [], [], [], 0, seq + 1
                    release()
        if keys:
            yield from flush(base + seq, keys, counts, flats)

    return run


def _encode_bucket(path: str):
    """applyInArrow function over one bucket of words: each distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        release()
        vocab = vocabulary(path)
        sizes = [_unpack(x) for x in table.column("sizes").to_pylist()]
        data = b"".join(_expand(x) for x in table.column("words").to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        words, ids = coded.dictionary.to_pylist(), []
        for i in range(0, len(words), 4096):
            ids += [",".join(map(str, x)) for x in vocab.encode_words(words[i : i + 4096])]
        listed, indices = pa.array(ids, pa.string()), coded.indices
        del words, ids, coded, data
        at = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).tolist()
        # one block's words as strings at a time
        packed = [_press(" ".join(listed.take(indices[a:b]).to_pylist()).encode()) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"block": table.column("block"), "numbers": table.column("numbers"), "ids": pa.array(packed, pa.binary())})

    return run


def _assemble(key_type: pa.DataType, digests: bool):
    """Cogrouped function over one block: ids and their pieces put back by position."""
    letter_byte = np.zeros(512, np.uint8)
    for b, c in enumerate(byte_letters()):
        letter_byte[ord(c)] = b

    def piece_bytes(letters: list) -> dict[str, bytes]:
        """The bytes of every id's piece, by the id in decimal; an id without a piece has none."""
        letters = [x or "" for x in letters]
        data = letter_byte[np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32)].tobytes()
        ends = np.cumsum([len(x) for x in letters]).tolist()
        return {str(i): data[a:b] for i, (a, b) in enumerate(zip([0] + ends[:-1], ends, strict=True))}

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        _LOADED.clear()  # an earlier stage's, of no use here
        release()
        rank = np.concatenate([np.cumsum(_unpack(x)) for x in found.column("numbers").to_pylist()] or [np.zeros(0, np.int64)])
        ids, pieces = np.empty(len(rank), object), np.empty(len(rank), object)
        ids[rank] = [w for x in found.column("ids").to_pylist() for w in _expand(x).decode().split(" ")]
        piece = piece_bytes(next(x.as_py() for x in docs.column("pieces") if x.is_valid))
        pieces[rank] = [piece[w] if "," not in w else b"".join([piece[i] for i in w.split(",")]) for w in ids[rank]]
        del piece
        n_ids = np.fromiter((x.count(",") + 1 for x in ids), np.int64, len(ids))
        flat_ids = np.array(",".join(ids).split(","), dtype=np.int32) if not digests and len(ids) else np.zeros(0, np.int32)
        id_at = np.concatenate([[0], np.cumsum(n_ids)])[:-1]
        keys, cols = [], ([], [], [])
        for k, counts, numbers in zip(docs.column("keys").combine_chunks(), docs.column("counts"), docs.column("numbers").to_pylist(), strict=True):
            number, count = _unpack(numbers), counts.values.to_numpy()
            keys.append(k.values)
            ends = np.cumsum(count)
            data = [b"".join(pieces[number[e - n : e]].tolist()) for n, e in zip(count, ends, strict=True)]
            if digests:
                texts = (",".join(ids[number[e - n : e]].tolist()) for n, e in zip(count, ends, strict=True))
                cols[0].append(np.diff(np.concatenate([[0], np.cumsum(n_ids[number])])[np.concatenate([[0], ends])]))
                cols[1].extend(hashlib.sha256(t.encode()).hexdigest() for t in texts)
                cols[2].extend(hashlib.sha256(d).hexdigest() for d in data)
            else:
                size = n_ids[number]
                total = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(id_at[number] - total[:-1], size) + np.arange(total[-1])
                cols[0].append(pa.ListArray.from_arrays(total[np.concatenate([[0], ends])].astype(np.int32), pa.array(flat_ids[take])))
                cols[1].extend(d.decode("utf-8", "replace") for d in data)
        keys = pa.concat_arrays(keys) if keys else pa.array([], key_type)
        if digests:
            return pa.table([keys, pa.array(np.concatenate(cols[0]) if cols[0] else [], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                            names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        lists = pa.concat_arrays(cols[0]) if cols[0] else pa.array([], pa.list_(pa.int32()))
        return pa.table([keys, lists, pa.array(cols[1], pa.string())], names=["key", "ids", "decoded"])

    return run


def with_pieces(rows: DataFrame, path: str, at: str) -> DataFrame:
    """``rows`` with ``pieces``, the piece of every id as byte letters, where the column ``at`` is 0,
    else null."""
    table = piece_table(rows.sparkSession, path).select(F.col("vocab").alias(at), "pieces")
    return rows.join(F.broadcast(table), at, "left")  # a vocabulary file: fixed size


def encode(docs: DataFrame, path: str, key: str = "doc_id", digests: bool = False) -> DataFrame:
    """Every row's text encoded by the vocabulary file ``path`` and decoded again: ``key``, ``ids``
    and ``decoded``; with ``digests``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead."""
    spark = docs.sparkSession
    key_field = docs.schema[key].dataType
    key_sql, key_type = key_field.simpleString(), to_arrow_type(key_field)
    # the dictionaries of two blocks fill a bucket, whatever the corpus' size
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, total // (2 * BLOCK_BYTES) + 1)
    schema = f"kind string, block long, bucket int, numbers binary, sizes binary, words binary, keys array<{key_sql}>, counts array<int>"
    blocks = split_words(docs, path, key).mapInArrow(_blocks(path, buckets, key_type), schema)
    # bucketed by block: the documents are not shuffled again when their ids come back
    with batch_bytes(spark, BLOCK_BYTES):
        kept = bucketed(spark, blocks, "word_blocks", "block", max(8, total // (2 * BLOCK_BYTES)))
    words = kept.where("kind = 'words'").select("block", "bucket", "numbers", "sizes", "words")
    coded = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "block long, numbers binary, ids binary")
    # the first row of each block (its bucket is 0) brings the pieces
    numbered = with_pieces(kept.where("kind = 'docs'").select("block", "bucket", "keys", "counts", "numbers"), path, "bucket")
    numbered = numbered.select("block", "keys", "counts", "numbers", "pieces")
    names = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = numbered.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(key_type, digests), f"key {key_sql}, {names}")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of each row's ids through the id-to-piece table.  Bytes
    that are not UTF-8 become U+FFFD; null ids give an empty text; an unknown id gives nothing."""
    table = piece_table(encoded.sparkSession, path).select("vocab", "hex_pieces")
    rows = encoded.withColumn("vocab", F.when(F.col(ids).isNull(), F.lit(0)).otherwise(F.size(ids) * 0))
    joined = rows.join(F.broadcast(table), "vocab")
    letters = F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get("hex_pieces", i)), "")
    return joined.withColumn("decoded", F.make_valid_utf8(F.unhex(letters).cast("string"))).drop("vocab", "hex_pieces")
