import hashlib

import pytest
from tokenizers import Tokenizer

from relspark.llm import registry, tokens

from .data import documents, empty, odd_rows

TEXTS = [
    "a b  c\n\n d", "it's we'll 'street' ''s I'M", "x<|endoftext|>y <|endoftext|>", "日本語 テスト 😀 ՘֋ \x85\xa0 ​　z", "\t\n  \r\n", " ", " lead", "trail  ",
    "1234 ½ ²³ ٣", "!!!???", "a" * 3000, "\u0000\u0007﻿", "é İ ß", "<|endoftext", "don't’t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.vocabulary_path())


def test_ids_and_text_equal_the_library(spark, library):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = tokens.encode(documents(spark, rows), registry.vocabulary_path()).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)


def test_digests_and_decode(spark, library):
    path = registry.vocabulary_path()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = documents(spark, rows)
    told = {r.doc_id: r for r in tokens.encode(docs, path, digests=True).collect()}
    back = {r.doc_id: r for r in tokens.decode(tokens.encode(docs, path).drop("decoded"), path).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert told[i].n_tokens == len(ids)
        assert told[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert told[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert back[i].decoded == t
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, [220, 50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in tokens.decode(odd, path).collect()} == {1: "", 2: "", 3: "", 4: " <|endoftext|>"}


def test_plain_characters_split_as_the_tokenizer_does(spark):
    """Every character of the ranges that the SQL expression is trusted with."""
    vocab = tokens.vocabulary(registry.vocabulary_path())
    ranges = [(0, 0x557), (0x2010, 0x2060), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x2500, 0x2B73), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F)]
    texts = []
    for a, b in ranges:
        points = [chr(c) for c in range(a, b + 1)]
        for i in range(0, len(points), 512):
            texts.append("".join(f"a{c}1{c}!{c} " for c in points[i : i + 512]))
    docs = documents(spark, list(enumerate(texts)), clash=False)
    rows = tokens.split_words(docs, registry.vocabulary_path()).collect()
    assert all(r.words is not None for r in rows)
    assert {r.key: list(r.words) for r in rows} == {i: vocab.split(t) for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert tokens.encode(empty(spark), registry.vocabulary_path()).count() == 0


def test_only_ids_go_back_to_their_blocks(spark, monkeypatch):
    """One Python step a task, the pieces joined to one row of each block, documents not shuffled again."""
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 200)
    rows = [(i, f"word{i} word{i % 7} été {'x' * (i % 50)}") for i in range(60)]
    out = tokens.encode(documents(spark, rows, clash=False), registry.vocabulary_path())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("BroadcastHashJoin") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "pieces" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(block" in x)
    assert sorted((r.doc_id, r.decoded) for r in out.collect()) == rows


def test_python_gets_a_bounded_batch_of_texts(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 20_000)
    plain = tokens.batch_rows

    def seen(batch, *args):
        with open(f"{tmp_dir}/sizes", "a") as f:
            f.write(f"{batch.nbytes}\n")
        return plain(batch, *args)

    monkeypatch.setattr(tokens, "batch_rows", seen)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = [(i, f"{i} word " * 50) for i in range(400)]
    out = tokens.encode(documents(spark, rows, clash=False).coalesce(1), registry.vocabulary_path())
    assert spark.conf.get(name) == before
    with open(f"{tmp_dir}/sizes") as f:
        sizes = [int(x) for x in f]
    assert len(sizes) > 4 and max(sizes) < 60_000
    assert sorted((r.doc_id, r.decoded) for r in out.collect()) == rows
