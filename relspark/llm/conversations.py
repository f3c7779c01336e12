"""Repair of conversations to the grammar ``(s?(ua)+)?`` by alignment with its strings.

The turns of a conversation, in order, are aligned with target strings of the grammar by the
Wagner-Fischer recurrence.  Edits: Keep (0), Rerole to user or assistant (3), Delete (4; required for
blank and duplicate turns) and Insert an empty user or assistant turn (3); a truncated turn that stays
adds 3.  The strings of all lengths are ends of one alternating string (a system turn can only be
kept, never made), so the table is filled from the end of both, a row a turn, and its first row
holds the cost of every feasible length.  Only a band of the table is filled (Ukkonen): a cell that is
k columns off its row's turns costs at least k inserts or deletes beyond what the required deletes and
the truncated turns cost anyway, so cells that cannot beat the incumbent's cost are left out.  The
incumbent comes from a narrow band first; its cost then gives the band that holds every alignment
as cheap.  All lengths of least cost are traced back, the least initial first at every step, and the
least audit of them, in ASCII order, is the result.

In Spark, a conversation's turns meet in one shuffle by ``conv_id``; order, faults and neighbours come from
windows over it.  A sorted stream then brings, for each conversation, one code a turn first and the
texts after; the worker aligns the codes when they end and hashes the repaired texts as they pass.  It
holds a conversation's codes and audit (some bytes a turn), rows of the band at marks and between two of
them, and one batch of texts, never a conversation's texts.

Cases: null ids form one conversation; a null role or text is one space, and so is a null in the
damage key.  Null turns come first; turns of equal number are ordered by role, then text.  Repeated
rows are duplicates.  A conversation without rows after damage gives zeros, an empty audit and the
hash of nothing.  Any other role than one that begins with s, u or a can only be reroled or deleted.  A
gap count beyond 64 bits is null.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import release

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
KEEP_CODES = 64  # conversations of up to so many turns share the alignment of equal codes
FIRST_SLACK = 8
NEVER = 1 << 40


# ---- alignment of one conversation's codes ----------------------------------------------------


def code(letter: str, fault: str) -> str:
    """One character a turn: its role's initial (``o`` if none of the grammar's), in upper case if
    truncated; ``x`` if it must be deleted."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = letter if letter in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


class _Band:
    """Rows of the table for one slack.  Cell r of row i: least cost to turn the codes from i on into
    the last r letters of ...uaua.  Rows are kept at marks and filled again between two of them."""

    def __init__(self, codes: str, slack: int):
        self.codes, n = codes, len(codes)
        # turns from i on that are not required to go
        self.left = np.concatenate([np.cumsum(np.frombuffer(codes.encode(), np.uint8)[::-1] != ord("x"))[::-1], [0]]).astype(np.int64)
        # surplus turns go at DELETE beyond nothing, or beyond CUT_SHORT if truncated
        spare = slack // (DELETE - CUT_SHORT) if any(c.isupper() for c in codes) else slack // DELETE
        self.low = np.maximum(self.left - spare, 0)
        self.high = self.left + slack // INSERT
        self.every = max(1, int(n**0.5))
        self.marks: dict[int, np.ndarray] = {}
        self.block: tuple[int, dict[int, np.ndarray]] = (-1, {})
        row = self._last()
        for i in range(n, -1, -1):
            if i < n:
                row = self._above(i, row)
            if i % self.every == 0 or i == n:
                self.marks[i] = row

    def _last(self) -> np.ndarray:
        n = len(self.codes)
        return INSERT * np.arange(self.low[n], self.high[n] + 1, dtype=np.int64)

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        c, lo, hi, lo1 = self.codes[i], self.low[i], self.high[i], self.low[i + 1]
        padded = np.concatenate([[NEVER], below, [NEVER]])  # columns lo1 - 1 to high[i + 1] + 1
        r = np.arange(lo, hi + 1)
        last = len(padded) - 1
        best = padded[np.clip(r - lo1 + 1, 0, last)] + DELETE
        if c != "x":
            stay = padded[np.clip(r - lo1, 0, last)] + (CUT_SHORT if c.isupper() else 0)
            other = np.where(r % 2 == 1, c.lower() != "a", c.lower() != "u")
            best = np.minimum(best, np.where(r > 0, stay + REROLE * other, NEVER))
        return np.minimum.accumulate(best - INSERT * r) + INSERT * r

    def row(self, i: int) -> np.ndarray:
        if i in self.marks:
            return self.marks[i]
        first = i - i % self.every
        if self.block[0] != first:
            top = min(first + self.every, len(self.codes))
            rows, row = {}, self.marks[top]
            for j in range(top - 1, first, -1):
                row = rows[j] = self._above(j, row)
            self.block = first, rows
        return self.block[1][i]

    def cell(self, i: int, r: int) -> int:
        at = r - self.low[i]
        return int(self.row(i)[at]) if r >= 0 and 0 <= at <= self.high[i] - self.low[i] else NEVER


def _in_band(codes: str, slack: int) -> tuple[int, _Band, list[tuple[int, int]]]:
    """The least cost in the band of ``slack``, the band, and the targets that have it: the turn kept
    as their s (-1: they have none) and how many letters follow."""
    band = _Band(codes, slack)
    found = {(-1, int(band.low[0] + j)): int(c) for j, c in enumerate(band.row(0)) if (band.low[0] + j) % 2 == 0}
    for i, c in enumerate(codes):
        if c.lower() == "s":  # the turns before it go
            cost = DELETE * i + (CUT_SHORT if c.isupper() else 0)
            for j, rest in enumerate(band.row(i + 1)):
                m = int(band.low[i + 1] + j)
                if m % 2 == 0 and m:
                    found[i, m] = cost + int(rest)
    best = min(found.values(), default=NEVER)
    return best, band, [k for k, c in found.items() if c == best]


def _trace(codes: str, band: _Band, r: int, system_at: int) -> tuple[str, str]:
    """The least audit of the target with ``r`` letters (after an s kept at ``system_at``, if not
    negative) and the letters that were inserted or reroled to."""
    edits, letters, i = ["D" * system_at + "K" if system_at >= 0 else ""], [], system_at + 1
    n = len(codes)
    while i < n or r:
        cost = band.cell(i, r)
        letter = "a" if r % 2 else "u"
        if i < n and DELETE + band.cell(i + 1, r) == cost:
            edits.append("D")
            i += 1
        elif r and INSERT + band.cell(i, r - 1) == cost:
            edits.append("I")
            letters.append(letter)
            r -= 1
        elif codes[i].lower() == letter:
            edits.append("K")
            i, r = i + 1, r - 1
        else:
            edits.append("R")
            letters.append(letter)
            i, r = i + 1, r - 1
    return "".join(edits), "".join(letters)


def align(codes: str) -> tuple[int, str, str]:
    """Least cost, least audit of that cost, and the role initials of its inserts and reroles, in order."""
    base = sum(DELETE if c == "x" else CUT_SHORT if c.isupper() else 0 for c in codes)
    slack = FIRST_SLACK
    while True:
        cost, band, targets = _in_band(codes, slack)
        if cost - base <= slack:  # the band holds every alignment as cheap as the incumbent
            break
        slack = min(cost - base, 4 * slack)
    return cost, *min(_trace(codes, band, m, s) for s, m in targets)


_short = lru_cache(maxsize=1 << 16)(align)


# ---- Spark jobs ---------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows after damage, repeats included; dropped rows are
    marked ``gone``, so that no conversation is lost."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


_FAULT = {"blank": 1, "duplicate": 2, "truncated": 3}


def with_faults(rows: DataFrame) -> DataFrame:
    """The ``damaged`` rows dealt by conversation, with ``idx`` (order, from 1), ``fault`` (0: none) and ``jump``
    (its role may not follow the one before)."""
    conv = ["conv_id", "gone"]
    dealt = rows.repartition("conv_id")
    in_order = Window.partitionBy(*conv).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    alike = Window.partitionBy(*conv, "role", "text").orderBy("idx")
    solid = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(Window.partitionBy(*conv).orderBy("idx")), initial)
    fault = F.when(solid == "", _FAULT["blank"]).when(F.row_number().over(alike) > 1, _FAULT["duplicate"])
    fault = fault.when(~solid.isin(".", "!", "?"), _FAULT["truncated"]).otherwise(0)
    numbered = dealt.withColumn("idx", F.row_number().over(in_order)).withColumn("fault", fault)
    return numbered.withColumn("jump", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))


class _Conversation:
    """What is known of the conversation that passes."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes: list[str] = []
        self.turns: list = [None, None, 0, None]  # least, most, distinct, last seen
        self.faults = [0, 0, 0, 0]
        self.jumps = 0
        self.plan = None
        self.hash = hashlib.sha256()
        self.lines = 0

    def add_code(self, letter, fault, turn, jump):
        self.codes.append(code(letter, {v: k for k, v in _FAULT.items()}.get(fault, "")))
        self.faults[fault] += 1
        self.jumps += jump
        if turn is not None:
            if self.turns[2] == 0:
                self.turns[0] = turn
            self.turns[1] = turn
            self.turns[2] += self.turns[2] == 0 or self.turns[3] != turn
            self.turns[3] = turn

    def solve(self):
        """Aligns the codes, which have all passed."""
        if self.plan is None:
            codes = "".join(self.codes)
            self.codes = []
            self.plan = _short(codes) if len(codes) <= KEEP_CODES else align(codes)
            self.edit, self.letter = iter(self.plan[1]), iter(self.plan[2])
            self.put_inserts()

    def line(self, role, text):
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def put_inserts(self):
        """The next edit that takes a turn; the inserts before it are written."""
        self.next = next(self.edit, None)
        while self.next == "I":
            self.line(ROLES[next(self.letter)], "")
            self.next = next(self.edit, None)

    def add_text(self, role, text):
        self.solve()
        if self.next == "K":
            self.line(role, text)
        elif self.next == "R":
            self.line(ROLES[next(self.letter)], text)
        self.put_inserts()

    def result(self):
        self.solve()
        least, most, distinct, _ = self.turns
        gaps = most - least + 1 - distinct if distinct else 0
        cost, audit, _ = self.plan
        return (self.conv_id, gaps if gaps < 1 << 63 else None, *self.faults[1:], self.jumps, cost, audit, self.hash.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _repair(batches):
    """Streams the sorted rows of whole conversations: marks of dropped rows, codes, then texts."""
    now, out = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "fault", "jump", "role", "text")]
        for conv_id, part, turn, fault, jump, role, text in zip(*cols, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv_id)
            if part == 1:
                now.add_code(role, fault, turn, jump)
            elif part == 2:
                now.add_text(role, text)
        if out:
            yield _batch(out)
            out = []
        release()
    if now is not None:
        yield _batch([now.result()])


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``damaged`` rows (or any with its columns): ``gaps``, the fault counts, ``illegal``
    (neighbours that may not follow each other), ``cost``, ``audit`` and ``repaired_sha256``."""
    found = with_faults(rows)
    alone = F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    coded = F.struct(F.lit(1).alias("part"), F.substring("role", 1, 1).alias("role"), F.lit(None).cast("string").alias("text"))
    told = F.struct(F.lit(2).alias("part"), F.col("role"), F.col("text"))
    parts = found.select("conv_id", "idx", "turn", "fault", "jump", F.explode(F.when(F.col("gone"), F.array(alone)).otherwise(F.array(coded, told))).alias("x"))
    stream = parts.select("conv_id", "x.part", "idx", "turn", "fault", "jump", "x.role", "x.text").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "idx")
    return stream.mapInArrow(_repair, RESULT)
