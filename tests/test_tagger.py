import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from relspark.operators import tagger

SCHEMA = "sequence long, position int, token string, tag string"


def training(n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["PER", "ORG", "LOC"])
        words = {"PER": ["kim", "lee", "ann", "of"], "ORG": ["bank", "of", "group", "lee"], "LOC": ["north", "of", "sea"]}
        tags = [kind] + [r.choice([kind, "O"]) for _ in range(r.randrange(4))]
        rows += [(i, p, r.choice(words.get(t, ["the", "of"])), t) for p, t in enumerate(tags)]
    return rows


def brute(rows, entity, smoothing=0.5):
    """The best of all tag paths."""
    tags = sorted({r[3] for r in rows})
    seqs = {}
    for s, p, w, t in rows:
        seqs.setdefault(s, []).append((p, w, t))
    step, emit = {}, {}
    for seq in seqs.values():
        before = None
        for _, w, t in sorted(seq):
            step[before, t] = step.get((before, t), 0) + 1
            emit[w, t] = emit.get((w, t), 0) + 1
            before = t
    size = len({r[2] for r in rows}) + 1

    def p_step(a, b):
        return math.log((step.get((a, b), 0) + smoothing) / (sum(step.get((a, t), 0) for t in tags) + smoothing * len(tags)))

    def p_emit(w, t):
        return math.log((emit.get((w, t), 0) + smoothing) / (sum(v for (_, x), v in emit.items() if x == t) + smoothing * size))

    words = entity.split()
    best = None
    for path in itertools.product(tags, repeat=len(words)):
        v = sum(p_step(a, b) + p_emit(w, b) for a, b, w in zip([None, *path], path, words))
        if best is None or v > best[0] + 1e-9:
            best = v, path
    return best


def score(rows, entity, path):
    fixed = [(s, p, w, t) for s, p, w, t in rows]
    tags = sorted({r[3] for r in fixed})
    return next(v for v, p in [brute_path(fixed, entity, path, tags)])


def brute_path(rows, entity, path, tags):
    only = {tuple(path)}
    plain = itertools.product
    try:
        itertools.product = lambda *a, **k: only
        return brute(rows, entity)
    finally:
        itertools.product = plain


def test_paths_are_the_best_of_all(spark):
    rows = training()
    model = tagger.fit_tagger(spark.createDataFrame(rows, SCHEMA).repartition(4))
    r = random.Random(2)
    entities = [" ".join(r.choice(["kim", "lee", "bank", "of", "sea", "north", "group", "the", "new"]) for _ in range(r.randrange(1, 6))) for _ in range(80)]
    df = spark.createDataFrame([(e,) for e in entities * 3], "entity string").repartition(3)
    got = {x.entity: x for x in tagger.tag_paths(df, model).collect()}
    assert set(got) == set(entities)
    for e, x in got.items():
        assert x.tag == x.tags[0] and len(x.tags) == len(e.split())
        assert score(rows, e, x.tags) == pytest.approx(brute(rows, e)[0], abs=1e-9)


def test_every_distinct_entity_is_decoded_once_and_odd_ones_have_no_path(spark):
    model = tagger.fit_tagger(spark.createDataFrame(training(), SCHEMA))
    df = spark.createDataFrame([("lee",)] * 500 + [(None,), ("",), (" \t",), ("  kim   lee ",)], "name string").repartition(4)
    got = {x.entity: (x.tags, x.tag) for x in tagger.tag_paths(df, model, "name").collect()}
    assert len(got) == 5 and got[None] == got[""] == got[" \t"] == (None, None) and len(got["  kim   lee "][0]) == 2
    assert tagger.tag_paths(df.where("name = 'zzz'"), model, "name").count() == 0


def test_a_long_entity(spark):
    model = tagger.fit_tagger(spark.createDataFrame(training(), SCHEMA))
    got = tagger.tag_paths(spark.createDataFrame([("kim of " * 300,)], "entity string"), model).first()
    assert len(got.tags) == 600


def test_one_tag_ties_and_bad_input(spark):
    one = tagger.fit_tagger(spark.createDataFrame([(1, 0, "a", "X")], SCHEMA))
    assert tagger.tag_paths(spark.createDataFrame([("a b",)], "entity string"), one).first().tags == ["X", "X"]
    even = tagger.fit_tagger(spark.createDataFrame([(1, 0, "a", "X"), (2, 0, "b", "W")], SCHEMA))
    assert tagger.tag_paths(spark.createDataFrame([("c",)], "entity string"), even).first().tag == "W"
    with pytest.raises(ValueError, match="tags are needed"):
        tagger.fit_tagger(spark.createDataFrame([], SCHEMA))
    with pytest.raises(ValueError, match="positive"):
        tagger.fit_tagger(spark.createDataFrame(training(), SCHEMA), smoothing=0)
    many = spark.range(100).select(F.col("id").alias("sequence"), F.lit(0).alias("position"), F.lit("w").alias("token"), F.col("id").cast("string").alias("tag"))
    with pytest.raises(ValueError, match="tags are needed"):
        tagger.fit_tagger(many)
