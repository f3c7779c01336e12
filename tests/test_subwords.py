import random
import re

import pytest
from pyspark.sql import functions as F

from relspark.operators import inputs, subwords

SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[E1]", "[/E1]"]
BODY = ["a", "b", "ab", "abc", "#", "##", "##a", "##b", "##c", "##bc", "##é", "é", ".", "[", "]", "/", "##ab", "x" * 40, "##x"]
PIECES = {p: i for i, p in enumerate(SPECIAL + BODY)}


def pieces(spark):
    return spark.createDataFrame(list(PIECES.items()), "piece string, piece_id int")


def brute_words(text):
    return re.findall(r"\[SEP\]|\[E1\]|\[/E1\]|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]", text or "")


def brute_word(word):
    if word in SPECIAL[3:]:
        return [PIECES[word]]
    if len(word) > subwords.MAX_WORD_CHARS:
        return [PIECES["[UNK]"]]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in PIECES and (at or not (piece.startswith("##") and len(piece) > 2)):
                out.append(PIECES[piece])
                at = end
                break
        else:
            return [PIECES["[UNK]"]]
    return out


def brute(text):
    return [i for w in brute_words(text) for i in brute_word(w)]


TEXTS = ["abc ab cab", None, "", "  \n\t ", "é.éa [SEP] [E1]ab[/E1]", "x" * 99, "x" * 100, "x" * 101, "#a ##b [UNK] [SEP", "abcabcab" * 5, "中 a", "ab " * 5000]


def examples(spark, texts=TEXTS):
    rows = [(i, t, texts[-1 - i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "example_id long, text string, text_pair string").repartition(3)


def test_whole_texts_against_brute_force(spark, monkeypatch):
    for size in (1, 64, 1 << 22):
        monkeypatch.setattr(subwords, "BLOCK_BYTES", size)
        got = subwords.subword_ids(examples(spark), pieces(spark), ["text", "text_pair"], special=SPECIAL[3:]).collect()
        assert {r.example_id: (r.ids_0, r.ids_1) for r in got} == {i: (brute(t), brute(TEXTS[-1 - i])) for i, t in enumerate(TEXTS)}


def test_trie_and_join_agree(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abcé#x") for _ in range(r.randrange(1, 12))) for _ in range(400)} | {"x" * 100, "x" * 101, "[SEP]", "abc", "中"}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    by_trie = {r.word: r.ids for r in subwords.segment_words(table, pieces(spark), SPECIAL[3:]).collect()}
    by_join = {r.word: r.ids for r in subwords.segment_words(table, pieces(spark), SPECIAL[3:], limit=0).collect()}
    assert by_trie == by_join == {w: brute_word(w) for w in words}


def test_a_word_is_segmented_once_and_repeated_rows_stay(spark, monkeypatch):
    seen = []
    plain = subwords.segment_words
    monkeypatch.setattr(subwords, "segment_words", lambda w, *rest: seen.append(w) or plain(w, *rest))
    rows = [(1, "ab ab abc")] * 200 + [(2, "abc ab")] * 100
    df = spark.createDataFrame(rows, "example_id long, text string").repartition(7)
    got = subwords.subword_ids(df, pieces(spark), ["text"]).groupBy("example_id", "ids_0").count().collect()
    assert {(r.example_id, tuple(r.ids_0), r["count"]) for r in got} == {(1, tuple(brute("ab ab abc")), 200), (2, tuple(brute("abc ab")), 100)}
    assert sorted(r.word for r in seen[0].collect()) == ["ab", "abc"]


def test_layout_is_that_of_encode_pair(spark):
    enc = subwords.encode_subwords(examples(spark), pieces(spark), max_length=12, padding="max_length", special=SPECIAL[3:])
    for r in enc.collect():
        a, b = brute(TEXTS[r.example_id]), brute(TEXTS[-1 - r.example_id])
        assert (r.ids_0, r.ids_1) == (a, b)
        while len(a) + len(b) > (9 if b else 10):
            (a if len(a) > len(b) else b).pop()
        ids = [2, *a, 3, *([*b, 3] if r.ids_1 else [])]
        assert r.input_ids == ids + [0] * (12 - len(ids)) and r.attention_mask == [1] * len(ids) + [0] * (12 - len(ids))
        assert r.segment_ids == [0] * (len(a) + 2) + [1] * (len(ids) - len(a) - 2) + [0] * (12 - len(ids))


def test_single_text_and_kept_columns(spark):
    df = inputs.single_input(spark.createDataFrame([(5, "ab abc", "ab", "abc")], "example_id long, sentence string, entity_01 string, entity_02 string"))
    r = subwords.encode_subwords(df.withColumn("words", F.lit(1)), pieces(spark), pair_col=None).first()
    assert (r.example_id, r.variant, r.input_ids) == (5, 0, [2, *brute("ab abc"), 3])


def test_empty_table_and_bad_pieces(spark):
    none = examples(spark).where("example_id < 0")
    assert subwords.encode_subwords(none, pieces(spark), max_length=10).count() == 0
    with pytest.raises(ValueError, match="distinct"):
        subwords.segment_words(spark.createDataFrame([("a",)], "word string"), pieces(spark).union(pieces(spark)))
    with pytest.raises(ValueError, match="no pieces"):
        subwords.encode_subwords(examples(spark), pieces(spark).where("piece <> '[PAD]'"), max_length=10)
