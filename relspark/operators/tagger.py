"""A trained entity tagger: tag transitions and token emissions counted in Spark, and the most probable tag
path (Viterbi) of each distinct entity.

The model is a hidden Markov chain over the tokens of an entity.  Starts and transitions are a small
square table (at most ``MAX_TAGS`` tags) and go into the plan as literals; emissions stay a table with one row a
token, so the vocabulary may be of any size, and are joined to the tokens of the distinct entities.  All
counts are smoothed by ``smoothing``.  Every entity is decoded once, by an aggregate over its own
tokens, however often it occurs.

Ties go to the tag that comes first in order.  A token that was never seen has the smoothed probability of any
unseen one.  An entity without tokens (null, empty, white space) has no path and a null tag.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import let

MAX_TAGS = 64


@dataclass
class TagModel:
    """``emissions``: ``token, logs`` (one log-probability for each tag); ``unseen``: those of any other token."""

    tags: list[str]
    starts: list[float]
    transitions: list[list[float]]
    emissions: DataFrame
    unseen: list[float]


def fit_tagger(tagged: DataFrame, smoothing: float = 0.5) -> TagModel:
    """Learn from rows ``sequence, position, token, tag``: the tokens of tagged entities (positions unique and
    ascending within a sequence)."""
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    rows = tagged.select("sequence", "position", "token", "tag").where("token is not null and tag is not null")
    before = F.lag("tag").over(Window.partitionBy("sequence").orderBy("position"))
    steps = rows.select(before.alias("before"), "tag").groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n")).limit(MAX_TAGS * (MAX_TAGS + 1) + 1).collect()
    tags = sorted({r.tag for r in steps})
    if not tags or len(tags) > MAX_TAGS:
        raise ValueError(f"between 1 and {MAX_TAGS} tags are needed, got {len(tags)}")
    n = {(r.before, r.tag): r.n for r in steps}

    def logs(before) -> list[float]:
        total = sum(n.get((before, t), 0) for t in tags)
        return [math.log((n.get((before, t), 0) + smoothing) / (total + smoothing * len(tags))) for t in tags]

    of_tag = {t: sum(v for (_, x), v in n.items() if x == t) for t in tags}
    counts = rows.groupBy("token").agg(*[F.count(F.when(F.col("tag") == t, 1)).alias(f"n{i}") for i, t in enumerate(tags)])
    size = rows.agg(F.count_distinct("token")).first()[0] + 1  # and one for all unseen ones
    whole = [of_tag[t] + smoothing * size for t in tags]
    logged = F.array(*[F.log((F.col(f"n{i}") + smoothing) / whole[i]) for i in range(len(tags))])
    return TagModel(tags, logs(None), [logs(t) for t in tags], counts.select("token", logged.alias("logs")), [math.log(smoothing / w) for w in whole])


def _matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def viterbi(logs: Column, model: TagModel) -> Column:
    """Tag numbers of the most probable path for an array of the tokens' emission arrays (not empty)."""
    k = len(model.tags)
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    # from[t][s]: the step to t from s
    into = _matrix([[model.transitions[s][t] for s in range(k)] for t in range(k)])
    starts = F.array(*map(F.lit, model.starts))

    def step(acc, emitted):
        best = F.transform(numbers, lambda t: F.array_max(F.transform(
            numbers, lambda s: F.struct((F.get(acc["score"], s) + F.get(F.get(into, t), s)).alias("v"), (-s).alias("neg")))))
        return let(best, lambda b: F.struct(
            F.zip_with(b, emitted, lambda x, e: x["v"] + e).alias("score"),
            F.concat(acc["back"], F.array(F.transform(b, lambda x: -x["neg"]))).alias("back")))

    first = F.struct(F.zip_with(starts, F.get(logs, F.lit(0)), lambda x, e: x + e).alias("score"), F.array().cast("array<array<int>>").alias("back"))
    done = F.aggregate(F.slice(logs, F.lit(2), F.size(logs)), first, step)

    def walk(d):
        last = F.array_position(d["score"], F.array_max(d["score"])).cast("int") - 1
        return F.aggregate(F.reverse(d["back"]), F.array(last), lambda path, b: F.concat(F.array(F.get(b, F.get(path, F.lit(0)))), path))

    return let(done, walk)


def tag_paths(entities: DataFrame, model: TagModel, entity_col: str = "entity") -> DataFrame:
    """``entity, tags, tag`` of the distinct entities: the path and the tag of its first token."""
    distinct = entities.select(F.col(entity_col).alias("entity")).distinct()
    words = F.array_remove(F.split(F.coalesce("entity", F.lit("")), r"\s+"), "")
    tokens = distinct.select("entity", F.posexplode(words).alias("at", "token"))
    known = tokens.join(model.emissions, "token", "left")
    emitted = F.coalesce("logs", F.array(*map(F.lit, model.unseen)))
    per = known.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", emitted.alias("e")))).alias("all"))  # an entity's tokens
    path = viterbi(F.col("all.e"), model)
    names = F.array(*map(F.lit, model.tags))
    found = per.select("entity", F.transform(path, lambda i: F.get(names, i)).alias("tags"))
    out = distinct.join(found.withColumnRenamed("entity", "__entity"), F.col("entity").eqNullSafe(F.col("__entity")), "left").drop("__entity")
    return out.select("entity", "tags", F.get("tags", F.lit(0)).alias("tag"))
