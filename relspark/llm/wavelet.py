"""Token ids of a corpus in wavelet-matrix files: one compressed, self-indexed file a shard.

``write_shards`` deals the documents by ascending ``doc_id`` over range partitions (Spark's range
shuffle; one shuffle of the texts), encodes each text in its sorted partition and appends the ids to
shards of about ``SHARD_TOKENS`` ids; a document is never cut.  A shard's ids become a wavelet
matrix: bit-plane 0 holds the top bits in text order, each further plane the next bits after
stably putting the zeros of the plane before first.  The planes are cut into chunks of
``CHUNK_BITS`` bits, each compressed by itself, with a directory of the ones before each chunk and
of each chunk's place, so that rank, select, ``access`` (the id at a position), ``count`` (how often
an id stands in a range) and ``locate`` (where it stands) read a few chunks of the file.
``read_shards`` decodes whole shards plane by plane, from the lowest up.

What a task holds is one shard: its ids and planes.  A shard is written under a name of its attempt
and then moved to its own; the manifest, a table written by Spark, lists the files of the tasks that
ended, with their counts, and is what readers follow.  A document's start is its place in the shard,
plus the shard's place in its partition, plus the ids of the partitions before (one number a partition).

Encoding: words of a batch are found on its code points at once (letters, single numbers, other
characters, with the English endings apart; white space goes), each distinct word is encoded once a
batch at most by the tokenizers library and its ids are put back by position.  Texts with characters
outside the checked ranges or with the mark of a special token go to the library whole.

Cases: a null text counts as empty (its ids are the end id alone).  Null ids come first; rows of equal
id are ordered by a hash of their texts, and repeated rows give one row each, in any partition.  A
very long text makes one long shard.  An empty table gives no files and no rows.  Further columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import batch_rows, release, stored
from relspark.session import scratch_path

SHARD_TOKENS = 1 << 20
CHUNK_BITS = 1 << 16
BATCH_BYTES = 8 << 20
KNOWN_WORDS = 3 << 18  # words whose ids a worker remembers from batch to batch
LINE_WORDS = 256
END_ID = 1
MAGIC = b"RSWM0001"
_HEAD = struct.Struct("<8sQQIIQ")  # magic, ids, documents, planes, bytes of the directory, first id's place in the partition

# fixed values: code-point ranges on which the splitting below and the tokenizer's agree (a test
# holds every one of them against the library), white space, and the endings split from a word
RANGES = [(0x0, 0x52F), (0x2010, 0x2060), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x2500, 0x2B73), (0x3041, 0x3096),
          (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F)]
SPACES = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
SPECIAL_MARK = "<|"
WORD_END = "</w>"
_ODD, _LETTER, _NUMBER, _OTHER, _SPACE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case code point of every code point; those outside the ranges are odd."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for begin, end in RANGES:
        for c in range(begin, end + 1):
            x, group = chr(c), unicodedata.category(chr(c))
            if unicodedata.normalize("NFC", x) != x or unicodedata.combining(x) or len(x.lower()) != 1 or group[0] == "M" or group == "Cn":
                continue
            kind[c] = {"L": _LETTER, "N": _NUMBER}.get(group[0], _OTHER)
            lower[c] = ord(x.lower())
    kind[SPACES] = _SPACE
    return kind, lower


class Words:
    """Words of texts, and their ids, by a tokenizer file of the lower-casing word vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.encoder, self.liner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.encoder, self.liner):
            t.no_truncation()
            t.no_padding()
        # lines of words that are normalised and split already
        self.liner.normalizer = normalizers.Sequence([])
        self.liner.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind, self.lower = _tables()
        pieces = self.encoder.get_vocab()
        self.is_end = np.zeros(max(pieces.values()) + 1, bool)
        self.is_end[[i for x, i in pieces.items() if x.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Lower-cased words of all texts in order, how many each text has, and which texts must go
        to the library whole (they have no words here)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[code]
        row_end = np.cumsum(size)
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(row_end, np.flatnonzero(kind == _ODD), "right")] = True
        for i, text in enumerate(texts):
            if SPECIAL_MARK in text:
                whole[i] = True
        if whole.any():
            kind = np.where(np.repeat(whole, size), _SPACE, kind)
        code = self.lower[code]
        begin = kind == _NUMBER
        begin[1:] |= kind[1:] != kind[:-1]
        begin[:1] = True
        begin[(row_end - size)[size > 0]] = True
        # an apostrophe that begins a run and one of the endings are one word, what follows another
        at = np.flatnonzero((code == ord("'")) & begin)
        if len(at):
            padded = np.concatenate([code, np.zeros(3, np.uint32)])
            solid = np.concatenate([begin, np.ones(3, bool)])
            taken = np.zeros(len(at), bool)
            for ending in ENDINGS:
                hit = ~taken & np.all([padded[at + 1 + j] == ord(c) for j, c in enumerate(ending)], axis=0)
                hit &= kind[np.minimum(at + 1, len(kind) - 1)] == _LETTER
                hit &= ~solid[at + 2] if len(ending) == 2 else True  # both letters are of the same text
                # the next row's first letter is not this row's ending
                hit &= np.searchsorted(row_end, at, "right") == np.searchsorted(row_end, np.minimum(at + len(ending), len(code) - 1), "right")
                begin[at[hit] + 1] = False
                after = at[hit] + 1 + len(ending)
                after = after[after < len(code)]
                begin[after] = True
                taken |= hit
        starts = np.flatnonzero(begin)
        width = (np.uint8(1) + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)) * (kind != _SPACE)
        seen = kind[starts] != _SPACE
        row = np.searchsorted(row_end, starts[seen], "right")
        data = code[kind != _SPACE].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(width, starts, dtype=np.int64)[seen] if len(starts) else [])]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
        return words, np.bincount(row, minlength=len(texts)).astype(np.int64), whole

    def _ids(self, encoder, texts: list[str]) -> np.ndarray:
        return np.array([i for e in encoder.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, encoded in lines of words: the last piece of a word ends with the
        vocabulary's mark, which no other piece does."""
        if not words:
            return
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known.clear()
        ids = self._ids(self.liner, [" ".join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)])
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.known.update(zip(words, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
        else:
            for word in words:
                self.known[word] = self._ids(self.liner, [word]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words, count, whole = self.split(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self.known])
        found = list(map(self.known.get, distinct))
        if None in found:  # the batch made room: all its words anew
            self._learn(distinct)
            found = list(map(self.known.get, distinct))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.uint32)
        word = coded.indices.to_numpy(zero_copy_only=False)
        size, first = n[word], (np.cumsum(n) - n)[word]
        end = np.cumsum(size)
        out = ids[np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        rows = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(whole):
            rows[i] = self._ids(self.encoder, [texts[i]])
        return rows


# ---- the file ---------------------------------------------------------------------------------


def pack(ids: np.ndarray, doc_ids: list, counts: np.ndarray, place: int) -> bytes:
    """A shard file of ``ids``: of documents ``doc_ids`` with ``counts`` ids each, the first at ``place``."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    chunks = -(-n // CHUNK_BITS)
    press = zstandard.ZstdCompressor(level=1).compress
    zeros = np.zeros(planes, np.uint64)
    ones = np.zeros((planes, chunks), np.uint32)  # ones before each chunk
    blobs = []
    x = ids.astype(np.uint32 if planes > 16 else np.uint16)
    for p in range(planes):
        bit = (x >> (planes - 1 - p) & 1).astype(bool)
        raw = np.packbits(bit, bitorder="little")
        per = np.add.reduceat(bit, np.arange(0, n, CHUNK_BITS), dtype=np.uint32) if n else np.zeros(0, np.uint32)
        ones[p] = np.cumsum(per) - per
        blobs += [press(raw[c * CHUNK_BITS // 8 : (c + 1) * CHUNK_BITS // 8].tobytes()) for c in range(chunks)]
        zeros[p] = n - int(per.sum())
        x = np.concatenate([np.compress(~bit, x), np.compress(bit, x)])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    sizes = np.array([len(b) for b in blobs], np.uint32)
    directory = press(b"".join(a.tobytes() for a in (zeros, ones, sizes, known, docs, counts.astype(np.uint64))))
    return _HEAD.pack(MAGIC, n, len(doc_ids), planes, len(directory), place) + directory + b"".join(blobs)


class Shard:
    """A shard file's content.  Chunks are decompressed when first needed."""

    def __init__(self, content: bytes):
        self.content = content
        magic, self.n, n_docs, self.planes, size, self.place = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard file")
        raw = zstandard.ZstdDecompressor().decompress(content[_HEAD.size : _HEAD.size + size])
        chunks, at = -(-self.n // CHUNK_BITS), 0

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.zeros = take(np.uint64, self.planes).astype(np.int64)
        self.ones = take(np.uint32, self.planes * chunks).reshape(self.planes, chunks).astype(np.int64)
        sizes = take(np.uint32, self.planes * chunks).astype(np.int64)
        self.where = (_HEAD.size + size + np.concatenate([[0], np.cumsum(sizes)])).tolist()
        self.chunks = chunks
        known, docs = take(np.uint8, n_docs), take(np.int64, n_docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, docs, strict=True)]
        self.counts = take(np.uint64, n_docs).astype(np.int64)
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def starts(self) -> np.ndarray:
        """Place of each document's first id in the shard, and the number of ids."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def _raw(self, p: int, c: int) -> bytes:
        i = p * self.chunks + c
        return zstandard.ZstdDecompressor().decompress(self.content[self.where[i] : self.where[i + 1]])

    def _chunk(self, p: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's bits and the ones before each, within the plane."""
        if (p, c) not in self._open:
            bits = np.unpackbits(np.frombuffer(self._raw(p, c), np.uint8), bitorder="little")[: self.n - c * CHUNK_BITS]
            self._open[p, c] = bits, self.ones[p, c] + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self._open[p, c]

    def rank(self, p: int, bit: int, i: int) -> int:
        """How many of the first ``i`` bits of plane ``p`` are ``bit``."""
        c = min(i // CHUNK_BITS, self.chunks - 1)
        one = int(self._chunk(p, c)[1][i - c * CHUNK_BITS]) if self.n else 0
        return one if bit else i - one

    def select(self, p: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the ``k``-th (from 0, ascending) bits of plane ``p`` that are ``bit``."""
        before = self.ones[p] if bit else np.arange(self.chunks) * CHUNK_BITS - self.ones[p]
        out = np.zeros(len(k), np.int64)
        chunk = np.searchsorted(before, k, "right") - 1
        for c in np.unique(chunk):
            mine = chunk == c
            out[mine] = c * CHUNK_BITS + np.flatnonzero(self._chunk(p, c)[0] == bit)[k[mine] - before[c]]
        return out

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            c = i // CHUNK_BITS
            bit = int(self._chunk(p, c)[0][i - c * CHUNK_BITS])
            value = value << 1 | bit
            i = self.rank(p, bit, i) + (self.zeros[p] if bit else 0)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among places ``lo`` to ``hi`` end up below the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            bit = token >> (self.planes - 1 - p) & 1
            lo, hi = (int(self.rank(p, bit, x) + (self.zeros[p] if bit else 0)) for x in (lo, hi))
            if lo == hi:
                return 0, 0
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands at places ``lo`` to ``hi`` (end exclusive)."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def locate(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of ``token`` from ``lo`` to ``hi`` (end exclusive), ascending."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(lo, hi)
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            at = self.select(p, bit, at - (self.zeros[p] if bit else 0))
        return at

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        x = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for p in reversed(range(self.planes)):
            raw = np.frombuffer(b"".join(self._raw(p, c) for c in range(self.chunks)), np.uint8)
            bit = np.unpackbits(raw, bitorder="little")[: self.n].view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[: self.zeros[p]]
            y[np.flatnonzero(bit)] = x[self.zeros[p] :] | x.dtype.type(1 << (self.planes - 1 - p))
            x = y
        return x


# ---- Spark jobs -------------------------------------------------------------------------------

_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def _put(folder: str, name: str, content: bytes, attempt: int) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/_attempt-{attempt}-{name}") as f:
        f.write(content)
    store.move(f"{base}/_attempt-{attempt}-{name}", f"{base}/{name}")


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all texts (each followed by ``end_id``) below ``folder``, a place that driver
    and executors share; returns the manifest: ``part, shard, file, n_docs, n_tokens``, one row a file."""

    def run(batches):
        from pyspark import TaskContext

        words, context = _words(vocabulary), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        doc_ids, rows, held, place, shard = [], [], 0, 0, 0

        def close():
            nonlocal doc_ids, rows, held, place, shard
            name = f"part-{part:06d}-{shard:06d}.wm"
            counts = np.array([len(r) for r in rows], np.int64)
            _put(folder, name, pack(np.concatenate(rows), doc_ids, counts, place), attempt)
            found = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [name],
                "n_docs": pa.array([len(rows)], pa.int64()), "n_tokens": pa.array([held], pa.int64())})
            doc_ids, rows, place, shard, held = [], [], place + held, shard + 1, 0
            return found

        for batch in batches:
            for piece in batch_rows(batch, BATCH_BYTES):
                texts = piece.column("text").to_pylist()
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    rows.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= shard_tokens:
                        yield close()
            release()
        if rows:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # what splits a repeated id, and last a repeated row, over partitions
    keyed = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = dealt.mapInArrow(run, "part int, shard int, file string, n_docs long, n_tokens long")
    return stored(docs.sparkSession, found, "wavelet-manifest")


def _shard_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``part``, ``base`` (ids of the partitions before) and ``content`` of every file of the manifest."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    if not totals:
        return spark.createDataFrame([], "part int, base long, content binary")
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = manifest.select("file", "part").join(F.broadcast(bases), "part")
    return files.join(F.broadcast(listed), "file").select("part", "base", "content")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens`` and its ids, or with ``digests``
    ``ids_crc32`` (unsigned, of the ids as little-endian unsigned 32-bit integers) in their place."""

    def run(batches):
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                ids, bounds = shard.ids().astype("<u4"), shard.starts
                flat = memoryview(ids).cast("B")
                cols = {"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(base + shard.place + bounds[:-1], pa.int64()),
                        "n_tokens": pa.array(shard.counts, pa.int64())}
                if digests:
                    crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    cols["ids_crc32"] = pa.array(crc, pa.int64())
                else:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
            release()

    last = "ids_crc32 long" if digests else "ids array<int>"
    return _shard_files(spark, folder, manifest).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def token_counts(spark: SparkSession, folder: str, manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``token``, ``n``: how often each of ``tokens`` stands in the files, by rank alone."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int32()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    counted = _shard_files(spark, folder, manifest).mapInArrow(run, "token int, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, manifest: DataFrame, token: int) -> DataFrame:
    """``doc_id``, ``start`` (of the document) and ``at``: every place of ``token``, counted over all
    documents; by select alone."""

    def run(batches):
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                at = shard.locate(token)
                doc = np.searchsorted(shard.starts, at, "right") - 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([shard.doc_ids[i] for i in doc], pa.int64()),
                    "start": pa.array(base + shard.place + shard.starts[doc], pa.int64()), "at": pa.array(base + shard.place + at, pa.int64())})

    return _shard_files(spark, folder, manifest).mapInArrow(run, "doc_id long, start long, at long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back: ``doc_id``, ``start``,
    ``n_tokens``, ``ids_crc32`` of every document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "wavelet-shards")
    return read_shards(spark, folder, write_shards(docs, folder, vocabulary), digests=True)
