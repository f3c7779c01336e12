"""Entity-span marking: hand-worked strings, and a reader that walks the characters."""

import random

from pyspark.sql import functions as F

from relspark.functions.text import mark_spans, spans_overlap


def brute_mark(s, e1s, e1e, e2s, e2e):
    """Reads the sentence one character at a time with a queue of points still to come.  Openings
    stand before their character and closings after it; a point that lies behind the reading
    place (touching or crossing spans) reads again from there."""
    queue = sorted([(e1s, 0), (e1e, 1), (e2s, 2), (e2e, 3)])
    out, at = [], 0
    for turn, (pos, which) in enumerate(queue):
        opening = turn % 2 == 0
        stop = pos if opening else pos + 1
        while at < stop and at < len(s):
            out.append(s[at])
            at += 1
        at = stop
        out.append(("[E" if opening else "[/E") + ("1]" if which < 2 else "2]"))
    out.extend(s[at:])
    return "".join(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "s string, a int, b int, c int, d int")
    out = df.select(
        mark_spans(F.col("s"), F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"),
        spans_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ov"),
    ).collect()
    return [(r.m, r.ov) for r in out]


def test_hand_cases(spark):
    s = "ABCDEFGHIJKLMN"
    rows = [
        (s, 0, 2, 5, 7),  # disjoint, e1 first
        (s, 5, 7, 0, 2),  # disjoint, e2 first
        (s, 0, 10, 3, 5),  # nested
        (s, 1, 1, 1, 2),  # touching
        (s, 4, 4, 9, 9),  # one character each
        ("\U0001F600ab cd", 1, 2, 4, 5),  # astral character before a span
    ]
    got = run(spark, rows)
    assert got[0][0] == "[E1]ABC[/E1]DE[E2]FGH[/E2]IJKLMN"
    assert got[1][0] == "[E2]ABC[/E2]DE[E1]FGH[/E1]IJKLMN"
    assert got[2][0] == "[E1]ABCD[/E2]E[E2]FGHIJK[/E1]LMN"
    assert got[3][0] == brute_mark(*rows[3])
    assert got[3][0] == "A[E1]B[/E1][E2]BC[/E2]DEFGHIJKLMN"
    assert [g[1] for g in got] == [False, False, True, True, False, False]
    for r, (m, _) in zip(rows, got):
        assert m == brute_mark(*r)
    assert got[5][0] == "\U0001F600[E1]ab[/E1] [E2]cd[/E2]"


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "abéç\U0001F600 xyz"
    rows = []
    for _ in range(300):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30)))
        n = len(s)
        offs = [rnd.randint(0, n - 1) for _ in range(4)]
        a, b = sorted(offs[:2])
        c, d = sorted(offs[2:])
        rows.append((s, a, b, c, d))
    got = run(spark, rows)
    for r, (m, _) in zip(rows, got):
        assert m == brute_mark(*r), r


def test_removing_markers_restores_disjoint_sentence(spark):
    rows = [("hello big world", 0, 4, 10, 14), ("hello big world", 10, 14, 0, 4)]
    for (m, _), r in zip(run(spark, rows), rows):
        stripped = m
        for tag in ("[E1]", "[/E1]", "[E2]", "[/E2]"):
            stripped = stripped.replace(tag, "")
        assert stripped == r[0]
