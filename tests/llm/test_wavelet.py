import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relspark.llm import wavelet
from relspark.session import scratch_path
from tests.llm.data import documents, empty, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll '' \"'s 'so don't 'Till ''s 's's x'", "'", "s", "a'", "re", "12½ ²3 aé É <|endoftext|> b", "", "  ", "İstanbul ΣΑΣ", "éa",
       "I'VE 'r e'd", "a\x1cb\x85c d", "don'", "tell'l", "l ok", "中文abc1'm'", "' s'd", " x y", "a</w>b </w>"]


@pytest.fixture(scope="module")
def words():
    return wavelet.Words(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(words, library):
    r = random.Random(3)
    mixed = ["".join(r.choice("ab's tTrRlL12 .,!'éß中\n\t") for _ in range(r.randrange(60))) for _ in range(400)]
    for texts in (ODD, mixed, ODD):
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_checked_character_is_split_as_the_library_does(words, library):
    chars = [chr(c) for c in np.flatnonzero(words.kind) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 500):
        text = " ".join(f"x{c}y{c}{c}1" for c in chars[i : i + 500])
        got, _, whole = words.split([text])
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert not whole[0] and len(got) == len(found)


def test_forgetting_words_changes_nothing(words, library, monkeypatch):
    monkeypatch.setattr(wavelet, "KNOWN_WORDS", 3)
    texts = ["one two three four", "four five six one", "six seven eight nine two"]
    assert [x.tolist() for x in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("top", [1, 2, 50_000, 200_000])
def test_rank_select_access_against_the_plain_array(top, monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK_BITS", 256)
    r = np.random.default_rng(top)
    ids = np.minimum(r.zipf(1.3, 3000), top - 1).astype(np.uint32)
    shard = wavelet.Shard(wavelet.pack(ids, [7, None, 9], np.array([1000, 0, 2000]), 5))
    assert (shard.ids() == ids).all() and shard.doc_ids == [7, None, 9] and shard.place == 5
    assert [shard.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    for token in {0, 1, int(ids.max()), int(ids[5]), top, top + 70_000}:
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at) and (shard.locate(token) == at).all()
        assert shard.count(token, 100, 2900) == ((at >= 100) & (at < 2900)).sum()
        assert (shard.locate(token, 300, 301) == at[(at >= 300) & (at < 301)]).all()
    with pytest.raises(IndexError):
        shard.access(3000)
    none = wavelet.Shard(wavelet.pack(ids[:0], [], np.zeros(0, np.int64), 0))
    assert len(none.ids()) == 0 and none.count(3) == 0 and len(none.locate(3)) == 0


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(-4, "first of all"), (10**12, "last"), (50, "long one " * 20_000), (None, "no id"), (60, None)]
    folder = scratch_path(spark, "wavelet")
    manifest = wavelet.write_shards(documents(spark, rows), folder, PATH, shard_tokens=40)
    assert manifest.count() > 2
    found = wavelet.read_shards(spark, folder, manifest, digests=True)
    got = sorted(map(tuple, found.collect()), key=lambda r: r[1])
    assert got == expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), library)
    whole = {r.start: r.ids for r in wavelet.read_shards(spark, folder, manifest).collect()}
    everything = [i for s in sorted(whole) for i in whole[s]]
    counts = {r.token: r.n for r in wavelet.token_counts(spark, folder, manifest, [1, everything[0], 49_000]).collect()}
    assert counts == {t: everything.count(t) for t in (1, everything[0], 49_000)}
    places = sorted(r["at"] for r in wavelet.occurrences(spark, folder, manifest, everything[0]).collect())
    assert places == [i for i, t in enumerate(everything) if t == everything[0]]


def test_odd_and_repeated_rows(spark, library):
    rows = odd_rows() + [(77, "the same row")] * 500
    got = sorted((tuple(r) for r in wavelet.token_files(documents(spark, rows), PATH).collect()), key=lambda r: r[1])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in expected(rows, library))
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]]
    assert [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)


def test_empty_table(spark):
    assert wavelet.token_files(empty(spark), PATH).count() == 0


def test_a_file_left_by_a_lost_task_is_not_read(spark):
    folder = scratch_path(spark, "wavelet")
    manifest = wavelet.write_shards(documents(spark, [(1, "a b c")]), folder, PATH)
    wavelet._put(folder, "part-009999-000000.wm", wavelet.pack(np.array([5], np.uint32), [2], np.array([1]), 0), 3)
    assert [r.doc_id for r in wavelet.read_shards(spark, folder, manifest).collect()] == [1]
