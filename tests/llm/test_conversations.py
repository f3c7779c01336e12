import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from relspark.llm import conversations as C

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ["idx", "fault", "part", "gone", "kind", "jump", "x", "times", "cost"]
TARGET = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # states: nothing, after s, u, a


def twin(codes):
    """Least (cost, audit, initials made) over all edits, a state of the grammar at a time."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = []
        if i == len(codes) and state in (0, 3):
            out.append((0, "", ""))
        if i < len(codes):
            c = codes[i]
            cost, a, m = best(i + 1, state, 0)
            out.append((cost + 4, "D" + a, m))
            for letter, then in TARGET[state].items() if c != "x" else ():
                if letter == "s" and c.lower() != "s":
                    continue
                cost, a, m = best(i + 1, then, 0)
                kept = letter == c.lower()
                out.append((cost + 3 * c.isupper() + 3 * (not kept), ("K" if kept else "R") + a, ("" if kept else letter) + m))
        if inserts < 3:
            for letter, then in TARGET[state].items():
                if letter != "s":
                    cost, a, m = best(i, then, inserts + 1)
                    out.append((cost + 3, "I" + a, letter + m))
        return min(out, default=(1 << 30, "", ""))

    return best(0, 0, 0)


def test_all_short_codes_against_the_twin():
    for n in range(6):
        for codes in itertools.product("suaoxU", repeat=n):
            assert C.align("".join(codes)) == twin("".join(codes)), codes


def test_longer_codes_against_the_twin(monkeypatch):
    r = random.Random(4)
    for first in (1, 8, 200):
        monkeypatch.setattr(C, "FIRST_SLACK", first)
        for _ in range(150):
            n = r.randrange(6, 40)
            clean = "".join("ua"[i % 2] for i in range(n))
            codes = "".join(r.choice("sSuUaAox") if r.random() < r.choice((0.1, 0.5, 1)) else c for c in clean)
            assert C.align(codes) == twin(codes), codes


def test_a_long_conversation_stays_in_its_band():
    r = random.Random(6)
    codes = "".join(c for i in range(20_000) for c in ["ua"[i % 2]] if r.random() > 0.002)
    t = time.time()
    cost, audit, made = C.align(codes)
    assert time.time() - t < 60 and audit.count("K") + audit.count("R") + audit.count("D") == len(codes)
    assert cost == 4 * audit.count("D") + 3 * (audit.count("R") + audit.count("I")) and len(made) == audit.count("R") + audit.count("I")
    for odd in ("u" * 300, "a" * 301, "AU" * 100 + "x" * 100, "o" * 99):
        assert C.align(odd) == twin(odd)


def brute(rows):
    """The contract, row by row."""
    out = {}
    convs = {r[0] for r in rows}
    for conv in convs:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes += C.code(role[:1], fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t[0] for t in turns if t[0] is not None]
        cost, audit, made = twin(codes)
        lines, at, made = [], 0, iter(made)
        name = {"u": "user", "a": "assistant"}
        for e in audit:
            if e == "I":
                lines.append(name[next(made)] + ":")
                continue
            if e in "KR":
                lines.append((turns[at][1] if e == "K" else name[next(made)]) + ":" + turns[at][2])
            at += 1
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *[F.lit("y").alias(c) for c in CLASH])
    got = C.repair(C.damaged(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r[0]: tuple(r[1:]) for r in got}


def test_tables_against_the_twin(spark):
    r = random.Random(8)
    rows = []
    for conv in range(300):
        for turn in range(r.randrange(9)):
            role = "system" if turn == 0 and r.random() < 0.2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, r.choice(["Hi there.", "Yes!", "no end", "Is it? ", "é中\U0001f600.", f"n{r.random()}."])))
    rows += [(None, i, "user", f"t{i}.") for i in range(30)] + [(None, None, None, None)] * 3
    rows += [(1000, None, "tool", "x."), (1000, 5, "", "y."), (1000, 5, "user", None), (1000, 5, "assistant", "a."), (1000, 5, "assistant", "a.")]
    rows += [(1001, -(1 << 40), "system", "\t\n\x0b"), (1001, 1 << 40, "user", "\xa0"), (1002, 3, "user", "long " * 50_000 + "."), (-5, 1, "assistant", "z?")]
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    got, want = repaired(spark, rows), brute(rows)
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_with_a_third_of_all_rows(spark):
    r = random.Random(9)
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(1000)]
    rows += [(c, t, r.choice(["user", "assistant", "system"]), f"{r.random()}.") for c in range(100, 600) for t in range(4)]
    assert repaired(spark, rows) == brute(rows)


def test_same_text_in_a_third_of_all_rows(spark):
    rows = [(c, t, "user", "ok.") for c in range(50) for t in range(20)]
    assert repaired(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("codes, cost, audit", [("", 0, ""), ("s", 4, "D"), ("su", 3, "KKI"), ("sua", 0, "KKK"), ("us", 3, "KR"), ("o", 4, "D"), ("aua", 3, "IKKK")])
def test_hand_cases(codes, cost, audit):
    assert C.align(codes)[:2] == (cost, audit)
