"""Secret scan: fixed credential patterns plus a randomness test battery.

Base kinds (``assign``, ``access``, ``hex``) are leftmost non-overlapping matches of fixed
patterns.  The battery looks at every other run of 16 or more characters of the usual key
alphabets, letter-only ones too.  Its encoding is inferred from the classes of characters that it has
(digits, lower case, upper case, signs), and two tests ask whether the classes could be drawn at random from that
encoding: chi-squared for their shares, and the number of runs of one class (names and paths keep
to a class for a word's length).  A run that fails one of them at ``CLASS_LEVEL`` is no candidate.

The letters of the others are then held against ordinary text.  Three tests ask whether they could be uniform
random: chi-squared over four groups of letters from common to rare, runs of vowels and consonants, and
the lag-1 serial correlation of the two commoner groups.  Fisher's method combines them.  How
random ordinary text looks depends on its length, so the evidence against a token is compared with
ordinary text of its length class: all letters of every text outside long runs, cut
into pieces of the shortest lengths of the classes in turn (the first by a hash of the text), each
letter in one piece.  A token's p-value is the share of its class' pieces that look as random.  The
Benjamini-Hochberg rule over all distinct candidates then bounds the expected share of false
discoveries by ``FDR``.  The statistics are histograms over fixed cells (length class x evidence),
so nothing grows with the corpus but the scan.  Every count is a difference of string lengths; no test
walks over characters one at a time.  DataFrame functions only.

What it misses: a token with fewer than ``LENGTH_STEP`` letters is never added, nor one in hexadecimal digits (24
and more are a base kind); short random tokens look like ordinary ones by chance, the more so the rarer secrets are among the candidates
(README: measured by length).

Positions are code points, end exclusive; they come from the pieces between matches by a
running sum.  Cases: null or empty text has no spans; repeated documents and ids give one row
each; a corpus too small or too short to calibrate adds no spans; tokens of digits alone or letters
alone are never added; an added span that overlaps a base span is left out.  Further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import broadcast_if_small, fresh_names, stored

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of 24 or more
MIN_VALUE, MIN_ACCESS = 6, 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"

FDR = 0.05
CLASS_LEVEL, CLASS_Z = 0.001, 3.0902  # share of random tokens that each class test may lose, and its normal deviate
LENGTH_STEP, LENGTH_CLASSES = 8, 9  # 8, 16, ... 64 letters and over
LENGTHS = [LENGTH_STEP * i for i in range(1, LENGTH_CLASSES)]
# places and lengths of the pieces of a stretch of letters, each length first in one of them
CUTS = [[(sum((LENGTHS[i:] + LENGTHS[:i])[:j]), n) for j, n in enumerate(LENGTHS[i:] + LENGTHS[:i])] for i in range(len(LENGTHS))]
EVIDENCE_STEP, EVIDENCE_CLASSES = 0.05, 400  # of -log10 p

DIGITS, LOWERS, UPPERS, SIGNS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_-"
# fixed values: letters from common to rare in Latin-script languages, and the vowels
GROUPS = ("etaoins", "rhldcum", "fpgwyb", "vkjxqz")
VOWELS = "aeiouy"


def _surprise(z: Column) -> Column:
    """-ln P(Z >= z) of the standard normal by its logistic approximation.  All evidence is compared with that of
    ordinary text, so only its order matters."""
    near = F.greatest(F.least(z, F.lit(15.0)), F.lit(-8.0))
    return F.log1p(F.exp(near * (1.5976 + 0.070566 * near * near)))


def _chi_z(chi: Column, dof: Column) -> Column:
    """The normal variable that stands for a chi-squared one with ``dof`` degrees (Wilson and Hilferty)."""
    return (F.cbrt(F.greatest(chi, F.lit(0.0)) / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))


def _times(c: str, part: str) -> Column:
    """How often ``part`` stands in column ``c``, without overlaps."""
    return (F.length(c) - F.length(F.replace(F.col(c), F.lit(part), F.lit("")))).cast("double") / len(part)


def evidence(df: DataFrame, letters: str) -> DataFrame:
    """``df`` with ``cell`` for its column of lower-case ``letters``: length class x -log10 of the
    probability that uniform random letters look as odd.  Null below ``LENGTH_STEP`` letters."""
    # one symbol for a letter's group and whether it is a vowel; its other views by whole-string replacement
    symbol = {c: "01234567"[2 * i + (c not in VOWELS)] for i, g in enumerate(GROUPS) for c in g}
    df = df.withColumn("_g", F.translate(letters, LOWERS, "".join(symbol[c] for c in LOWERS))).withColumn("_n", F.length(letters).cast("double"))

    def seen(names: dict[str, str]) -> Column:
        out = F.col("_g")
        for i in sorted(set(symbol.values())):
            out = F.replace(out, F.lit(i), F.lit(names[i]))
        return out

    df = df.withColumn("_v", seen({i: "c" if int(i) % 2 else "v" for i in "01234567"})).withColumn("_h", seen({i: "h" if int(i) < 4 else "l" for i in "01234567"}))
    n = F.col("_n")
    for i in range(len(GROUPS)):
        df = df.withColumn(f"_c{i}", sum((_times("_g", x) for x in (str(2 * i), str(2 * i + 1)) if x in symbol.values()), F.lit(0.0)))
    chi = sum((F.pow(F.col(f"_c{i}") - n * (len(g) / 26), F.lit(2.0)) / (n * (len(g) / 26)) for i, g in enumerate(GROUPS)), F.lit(0.0))
    df = df.withColumn("_p1", _chi_z(chi, F.lit(len(GROUPS) - 1.0)))
    # runs of vowels and consonants
    df = df.withColumn("_u", _times("_v", "v")).withColumn("_r", 1 + _times("_v", "vc") + _times("_v", "cv"))
    df = df.withColumn("_b", 2 * F.col("_u") * (n - F.col("_u")))
    both = F.col("_b")
    df = df.withColumn("_s", both * (both - n) / (n * n * (n - 1)))
    df = df.withColumn("_p2", F.when(F.col("_s") > 0, F.abs(F.col("_r") - both / n - 1) / F.sqrt("_s")).otherwise(F.sqrt(n)))
    # lag-1 correlation of common letters: of k ones, those followed by a one are k less the runs of ones
    df = df.withColumn("_k", F.col("_c0") + F.col("_c1")).withColumn("_o", _times("_h", "lh") + F.startswith("_h", F.lit("h")).cast("double"))
    k = F.col("_k")
    df = df.withColumn("_q", k * (k - 1) * (n - k) * (n - k + 1) / (n * n * (n - 1)))
    df = df.withColumn("_p3", F.when(F.col("_q") > 0, F.abs(F.col("_o") - k * (n - k + 1) / n) / F.sqrt("_q")).otherwise(F.sqrt(n)))
    two_sided = lambda c: _surprise(F.col(c)) - math.log(2)  # noqa: E731  (z is not below 0)
    df = df.withColumn("_f", _surprise(F.col("_p1")) + two_sided("_p2") + two_sided("_p3"))
    log_p = (-F.col("_f") + F.log(1 + F.col("_f") + F.col("_f") * F.col("_f") / 2)) / math.log(10)  # chi-squared, 6 degrees
    step = F.least(F.floor(F.greatest(-log_p, F.lit(0.0)) / EVIDENCE_STEP), F.lit(EVIDENCE_CLASSES - 1))
    length = F.least(F.floor(n / LENGTH_STEP), F.lit(LENGTH_CLASSES - 1))
    df = df.withColumn("cell", F.when(n >= LENGTH_STEP, (length * EVIDENCE_CLASSES + step).cast("int")))
    return df.drop("_g", "_v", "_h", "_n", *[f"_c{i}" for i in range(len(GROUPS))], "_p1", "_u", "_r", "_b", "_s", "_p2", "_k", "_o", "_q", "_p3", "_f")


def candidates(df: DataFrame, token: str) -> DataFrame:
    """``df`` with ``letters``: those of its ``token`` in lower case, null where the token's classes of
    characters could not be drawn from its encoding."""
    classes = "".join(c * len(x) for c, x in zip("dlus", (DIGITS, LOWERS, UPPERS, SIGNS), strict=True))
    df = df.withColumn("_t", F.translate(token, DIGITS + LOWERS + UPPERS + SIGNS, classes)).withColumn("_n", F.length(token).cast("double"))
    n = F.col("_n")
    for c in "dlus":
        df = df.withColumn(f"_{c}", _times("_t", c))
    # the encoding's characters of each class: base32 has six digits; at most two signs are in use at once
    base32 = F.col(token).rlike("^[A-Z2-7]+$")
    of = {"d": F.when(base32, 6.0).otherwise(10.0), "l": F.lit(26.0), "u": F.lit(26.0), "s": F.lit(2.0)}
    size = sum((F.when(F.col(f"_{c}") > 0, of[c]).otherwise(0.0) for c in "dlus"), F.lit(0.0))
    kinds = sum(((F.col(f"_{c}") > 0).cast("double") for c in "dlus"), F.lit(0.0))
    df = df.withColumn("_k", kinds).withColumn("_a", size)
    for c in "dlus":
        df = df.withColumn(f"_e{c}", n * of[c] / F.col("_a"))
    chi = sum((F.when(F.col(f"_{c}") > 0, F.pow(F.col(f"_{c}") - F.col(f"_e{c}"), F.lit(2.0)) / F.col(f"_e{c}")).otherwise(0.0) for c in "dlus"), F.lit(0.0))
    df = df.withColumn("_p1", F.when(F.col("_k") > 1, _chi_z(chi, F.greatest(F.col("_k") - 1, F.lit(1.0)))).otherwise(0.0))
    for power in (2, 3):
        df = df.withColumn(f"_s{power}", sum((F.pow(F.col(f"_{c}"), F.lit(float(power))) for c in "dlus"), F.lit(0.0)))
    s2, s3 = F.col("_s2"), F.col("_s3")
    df = df.withColumn("_w", (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n * n * n) / (n * n * (n - 1)))
    runs = F.length(F.regexp_replace("_t", r"(.)\1+", "$1")).cast("double")
    df = df.withColumn("_p2", F.when(F.col("_w") > 0, (1 + (n * n - s2) / n - runs) / F.sqrt(F.greatest("_w", F.lit(1e-9)))).otherwise(0.0))
    passed = (F.col("_p1") <= CLASS_Z) & (F.col("_p2") <= CLASS_Z) & (F.col("_l") + F.col("_u") >= LENGTH_STEP)
    letters = F.when(passed, F.lower(F.regexp_replace(token, "[^A-Za-z]+", "")))
    return df.withColumn("letters", letters).drop("_t", "_n", "_k", "_a", "_p1", "_s2", "_s3", "_w", "_p2", *[f"_{c}" for c in "dlus"], *[f"_e{c}" for c in "dlus"])


def random_cells(docs: DataFrame, fdr: float = FDR) -> list[int]:
    """The cells whose tokens count as secrets; at most LENGTH_CLASSES x EVIDENCE_CLASSES numbers."""
    text = F.col("text")
    runs = docs.where(text.rlike(RUN)).select(F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("token")).distinct()
    runs = candidates(runs, "token").where("letters is not null").select("letters", F.lit(True).alias("test"))
    # long runs are no part of the ordinary text they are compared with
    plain = F.lower(F.regexp_replace(F.when(text.rlike(RUN), F.regexp_replace(text, RUN, " ")).otherwise(text), "[^A-Za-z]+", ""))
    plain = docs.select(plain.alias("letters"), F.pmod(F.xxhash64(text), F.lit(len(CUTS))).cast("int").alias("turn"))
    plain = plain.select("turn", F.explode(F.regexp_extract_all("letters", F.lit(f"[a-z]{{1,{sum(n for _, n in CUTS[0])}}}"), F.lit(0))).alias("letters"))
    cuts = F.get(F.array(*[F.array(*[F.struct(F.lit(a).alias("at"), F.lit(n).alias("size")) for a, n in turn]) for turn in CUTS]), F.col("turn"))
    cuts = F.filter(cuts, lambda c: c["at"] + c["size"] <= F.length("letters"))
    plain = plain.select(F.explode(F.transform(cuts, lambda c: F.substring("letters", c["at"] + 1, c["size"]))).alias("letters"), F.lit(False).alias("test"))
    told = evidence(runs.unionByName(plain), "letters")
    counts = stored(docs.sparkSession, told.groupBy("cell").agg(
        F.sum(F.when(F.col("test"), 1).otherwise(0)).alias("tested"), F.sum(F.when(F.col("test"), 0).otherwise(1)).alias("plain")), "secret-cells")
    # from here on: at most one row for each cell
    counts = counts.select(F.floor(F.col("cell") / EVIDENCE_CLASSES).alias("length"), F.pmod("cell", F.lit(EVIDENCE_CLASSES)).alias("step"), "cell", "tested", "plain")
    null = counts.select(F.col("length").alias("l0"), F.col("step").alias("s0"), F.col("plain").alias("p0")).where("p0 > 0")
    per = counts.where("tested > 0").join(F.broadcast(null), F.col("l0") == F.col("length"), "left").groupBy("cell", "tested").agg(
        F.coalesce(F.sum("p0"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("s0") <= F.col("step"), F.col("p0"))), F.lit(0)).alias("as_random"))
    per = per.withColumn("p", (1 + F.col("as_random")) / (1 + F.col("all")))
    ordered = per.withColumn("rank", F.sum("tested").over(Window.orderBy("p"))).withColumn("m", F.sum("tested").over(Window.partitionBy()))
    limit = ordered.where(F.col("p") * F.col("m") <= fdr * F.col("rank")).agg(F.max("p").alias("limit"))
    row = limit.first()[0]
    return [] if row is None else [r[0] for r in per.where(F.col("p") <= row).select("cell").collect()]


def find_spans(docs: DataFrame, fdr: float = FDR, key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``row_id``, ``text_hash`` and ``found``, its spans as
    ``(start, kind number, end)`` in order."""
    cells = random_cells(docs, fdr)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row_id"), text.alias("text"))
    docs = docs.withColumn("runs", F.col("text").rlike(RUN)).withColumn("assigns", F.col("text").rlike(ASSIGN))

    def matches(kind: int, pattern: str, gate: Column, value: int = 0) -> Column:
        # lengths of the text before each match since the last one, the matches, their values
        between = F.transform(F.split("text", pattern), lambda p: F.length(p))
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("before"), whole.alias("match"),
                             (F.regexp_extract_all("text", F.lit(pattern), F.lit(value)) if value else whole).alias("value"))
        rows = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), p["before"].alias("before"), p["match"].alias("match"), p["value"].alias("value")))
        return F.when(gate, rows).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,match:string,value:string>>"))

    runs = F.col("runs")
    every = F.concat(
        matches(0, ASSIGN, F.col("assigns"), 2), matches(1, ACCESS, runs & F.contains("text", F.lit("AKIA"))),
        matches(2, HEX, runs & F.col("text").rlike("[0-9a-f]{24}")), matches(3, RUN, runs),
    )
    rows = docs.select("key", "row_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(every).alias("m")).select("key", "row_id", "text_hash", "m.*")
    rows = rows.repartition("row_id")  # the running sum and the grouping below share this one shuffle
    w = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.length("match")).over(w))
    rows = rows.withColumn("start", F.col("end") - F.length("match"))
    token = F.when(F.col("kind") == 3, F.col("match"))
    rows = evidence(candidates(rows.withColumn("token", token), "token"), "letters")
    good = (
        ((F.col("kind") == 0) & (F.length("value") >= MIN_VALUE)) | ((F.col("kind") == 1) & (F.length("match") >= MIN_ACCESS))
        | (F.col("kind") == 2) | (F.col("letters").isNotNull() & (F.col("cell").isin(cells) if cells else F.lit(False)))
    )
    span = F.when(good, F.struct("start", "kind", "end"))
    per = rows.groupBy("row_id").agg(F.first("key").alias("key"), F.first("text_hash").alias("text_hash"), F.array_sort(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    kept = F.filter("all", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return per.withColumn("base", base).withColumn("found", kept).select(F.col("key").alias(key), "row_id", "text_hash", "base", "found")


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = FDR, key: str = "doc_id") -> DataFrame:
    """Per document: ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` and ``spans``."""
    found = find_spans(docs, fdr, key)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR, key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``MARK``; other columns, and texts without
    a span, as they were.  Overlapping spans are replaced once."""
    f_key, f_hash, f_spans = fresh_names(docs, "f_key", "f_hash", "f_spans")
    found = find_spans(docs, fdr, key).where(F.size("found") > 0).groupBy(F.col(key).alias(f_key), F.col("text_hash").alias(f_hash)).agg(F.first("found").alias(f_spans))
    found = stored(docs.sparkSession, found, "secret-spans")
    found = broadcast_if_small(found, found.agg(F.sum(F.size(f_spans) * 32 + 64)))
    same = docs[key].eqNullSafe(F.col(f_key)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f_hash))
    joined = docs.join(found, same, "left")
    # the text between spans: each piece begins at the furthest end so far
    n = F.size(f_spans)
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(f_spans, F.lit(1), i), lambda s: s["end"])), F.lit(0).cast("long"))
    piece = lambda i: F.when(i == n, F.substring("text", (reach(i) + 1).cast("int"), F.length("text"))).when(
        (i > 0) & (F.get(f_spans, i)["start"] < reach(i)), F.lit(None).cast("string")).otherwise(
        F.substring("text", (reach(i) + 1).cast("int"), (F.get(f_spans, i)["start"] - reach(i)).cast("int")))
    pieces = F.filter(F.transform(F.sequence(F.lit(0), n), piece), lambda p: p.isNotNull())
    clean = F.when(F.col(f_spans).isNull(), F.col("text")).otherwise(F.array_join(pieces, MARK))
    return joined.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])
