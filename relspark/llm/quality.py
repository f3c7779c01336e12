"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (runs of ``PASSAGE`` words, the last one shorter).  Every passage of
the whole text is encoded as a fixed vector of what its characters and words look like; the
vector is projected, a gated attention network (``tanh(V h) * sigmoid(U h)``) weighs the passages,
and a logistic unit scores the weighted sum.  All weights are learned from document labels by
full-batch gradient steps.

Training reads at most ``MAX_TRAIN`` labelled documents (the smallest hashes of their ids) and of these, in that
order, those that fit into ``MAX_PASSAGES`` passages in all, one text an id (the smallest hash): a documented
bound.  Their passages are encoded on the executors and fitted in one task, whose size that bound fixes; it takes
them in that order, so the weights do not depend on partitions.  Scoring reads every passage of every document.

Nothing but the text enters a score.  Cases: null and empty texts are a bag of one passage
without words.  Labels that are null, not 0 or 1, or whose document is missing are not learned
from; a document with several labels counts once for each.  Without labels of both kinds every
score is the share of label 1 (0.5 if there is none).  Repeated rows give one row each.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import IS_WORD, batch_bytes, batch_rows, forget, release, stored, text_bytes, word_hashes

PASSAGE = 64  # words
MAX_TRAIN = 4_000  # labelled documents
MAX_PASSAGES = 100_000  # of them together
THRESHOLD = 0.3
HASHED = 16  # slots for hashed word shapes
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 150, 0.05, 1e-4
ARROW_BYTES = 4 << 20  # of an Arrow batch of training texts
BATCH_BYTES = 1 << 20  # of text that is laid out in numpy arrays at once; these take about 40 times as much

_B = np.arange(256)
# byte classes whose shares in a passage are features
CLASSES = np.stack([
    (_B >= 0x61) & (_B <= 0x7A), (_B >= 0x41) & (_B <= 0x5A), (_B >= 0x30) & (_B <= 0x39), _B >= 0x80,
    (_B == 0x20), (_B == 0x0A), (_B == 0x2E) | (_B == 0x2C), np.isin(_B, [0x21, 0x3F]),
    np.isin(_B, list(b"#$%&*@^~")), np.isin(_B, list(b"|/\\_<>{}[]=+")), np.isin(_B, list(b"\"'();:-")),
]).astype(np.float64)
FEATURES = len(CLASSES) + 10 + HASHED


def held_out(key: Column) -> Column:
    """Rows that training must not see: the id's CRC-32 is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of the passages of every text and the index of each text's first passage.
    Words here are runs without white space or control characters."""
    flat, offsets = text_bytes(col)
    rows = len(offsets) - 1
    solid = np.concatenate([flat > 0x20, [False]])
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge))
    after = np.concatenate([solid[1:], [False]])
    next_edge = np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(solid & (~after | next_edge)) + 1
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    pass_first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(pass_first[-1])
    word_row = np.repeat(np.arange(rows), n_words)
    passage = pass_first[:-1][word_row] + (np.arange(len(starts)) - first[:-1][word_row]) // PASSAGE
    size = np.bincount(passage, minlength=total).astype(np.float64)
    # a passage's bytes run from its first word to the next passage's
    x = np.zeros((total, FEATURES))
    if len(starts):
        new = np.ones(len(starts), bool)
        new[1:] = passage[1:] != passage[:-1]
        has = np.zeros(total, bool)
        has[passage] = True
        begin = starts[new]
        stop = np.minimum(np.concatenate([begin[1:], [len(flat)]]), offsets[1:][word_row[new]])
        length = np.maximum(stop - begin, 1).astype(np.float64)
        for j, c in enumerate(CLASSES):
            run = np.concatenate([[0.0], np.cumsum(c[flat])])
            x[has, j] = (run[stop] - run[begin]) / length
        j = len(CLASSES)
        words = np.maximum(size, 1)
        chars = (ends - starts).astype(np.float64)
        mean = lambda v: np.bincount(passage, v, minlength=total) / words
        x[:, j] = mean(chars) / 8
        x[:, j + 1] = np.sqrt(np.maximum(mean(chars**2) - mean(chars) ** 2, 0)) / 4
        x[:, j + 2] = mean(chars <= 3)
        h = word_hashes(flat, starts, ends)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        x[:, j + 3] = mean(same)
        order = np.lexsort((h, passage))
        uniq = np.ones(len(h))
        uniq[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        x[:, j + 4] = np.bincount(passage[order], uniq, minlength=total) / words
        upper = CLASSES[1].astype(bool)
        up = np.concatenate([[0], np.cumsum(upper[flat])])
        x[:, j + 5] = mean((up[ends] - up[starts]) * 2 > chars)
        x[:, j + 6] = mean(~IS_WORD[flat[ends - 1]] & (flat[ends - 1] != 0x2E) & (flat[ends - 1] != 0x2C))
        x[:, j + 7] = mean(chars == 1)
        x[:, j + 8] = mean(flat[ends - 1] == 0x2E)
        slot = (h % np.uint64(HASHED)).astype(np.int64)
        x[:, -HASHED:] = np.bincount(passage * HASHED + slot, minlength=total * HASHED).reshape(total, HASHED) / words[:, None]
    x[:, len(CLASSES) + 9] = np.log1p(size) / np.log1p(PASSAGE)
    return x, pass_first


def _spread(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(values, np.diff(first), axis=0)


def _forward(w: dict, x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["P"] + w["p"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    top = np.maximum.reduceat(e, first[:-1])
    e = np.exp(e - _spread(top, first))
    a = e / _spread(np.add.reduceat(e, first[:-1]), first)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return h, t, g, a, z, 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Slopes of the mean log loss over the documents."""
    h, t, g, a, z, s = _forward(w, x, first)
    d = (s - y) / len(y)
    grad = {"c": z.T @ d, "b": d.sum()}
    dz = _spread(d[:, None] * w["c"], first)
    da = (dz * h).sum(axis=1)
    de = a * (da - _spread(np.add.reduceat(a * da, first[:-1]), first))
    grad["a"] = (t * g).T @ de
    dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    grad["P"], grad["p"] = x.T @ dh, dh.sum(axis=0)
    return grad


def fit_weights(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 11) -> dict:
    """Weights of the network by full-batch Adam steps on the log loss; both labels weigh alike
    up to the square root of their ratio."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / std, -6, 6)
    shape = {"P": (FEATURES, HIDDEN), "p": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "b": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(max(s[0] if s else 1, 1)), s) * (k not in "pb") for k, s in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grad = _gradients(w, x, first, y)
        for k in w:
            gk = grad[k] + DECAY * w[k] * (k not in "pb")
            m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "std": std, **w}


def score_passages(w: dict, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    if "share" in w:
        return np.full(len(first) - 1, float(w["share"]))
    return _forward(w, np.clip((x - w["mean"]) / w["std"], -6, 6), first)[-1]


def _encode(batches):
    release()  # what an earlier query left in this worker
    for batch in batches:
        for part in batch_rows(batch, BATCH_BYTES):
            x, first = passages(part.column("text"))
            flat = pa.array(x.astype(np.float32).ravel())
            n = pa.array(np.diff(first).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], n, pa.ListArray.from_arrays((first * FEATURES).astype(np.int32), flat)], ["key", "label", "hash", "n", "x"])
            release()


def _fit(table: pa.Table) -> pa.Table:
    import pickle

    table = table.sort_by("place")
    y = table.column("label").to_numpy().astype(np.float64)
    lists = table.column("x").combine_chunks()
    x = lists.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
    first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy() // FEATURES)])
    w = fit_weights(x, first, y) if 0 < y.sum() < len(y) else {"share": np.array(y.mean() if len(y) else 0.5)}
    return pa.table({"weights": pa.array([pickle.dumps(w)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN,
        max_passages: int = MAX_PASSAGES) -> dict:
    """The network's weights (a few kilobytes), learned from rows that are not held out."""
    import pickle

    told = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    told = told.orderBy(F.xxhash64("key"), "key", "label").limit(max_train)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    hashed = F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("hash")
    train = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(told), "key").select("key", "label", hashed, "text")
    with batch_bytes(spark, ARROW_BYTES):
        bags = stored(spark, train.mapInArrow(_encode, f"key {kind}, label int, hash string, n long, x array<float>"), "training-bags")
    one = bags.groupBy("key", "label").agg(F.min(F.struct("hash", "n")).alias("f"))
    rows = one.select("key", "label", "f.hash", "f.n").orderBy(F.xxhash64("key"), "key", "label").collect()  # max_train rows
    chosen, left = [], max_passages
    for place, (k, told_label, text_hash, n) in enumerate(rows):
        if n <= left:
            chosen.append((k, told_label, text_hash, place))
            left -= n
    if not chosen:
        forget(bags)
        return {"share": np.array(0.5)}
    side = spark.createDataFrame(chosen, f"key {kind}, label int, hash string, place int")
    picked = bags.join(F.broadcast(side), ["key", "label", "hash"]).select("place", "label", "x").dropDuplicates(["place"])
    got = picked.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda t: _fit(t), "weights binary").collect()
    forget(bags)
    return pickle.loads(got[0][0])


def score(docs: DataFrame, weights: dict, key: str = "doc_id") -> DataFrame:
    """``docs`` rows as ``key``, ``held_out``, ``score``, ``predicted`` and ``n_passages``."""

    def run(batches):
        for batch in batches:
            for part in batch_rows(batch, BATCH_BYTES):
                x, first = passages(part.column("text"))
                s = np.clip(score_passages(weights, x, first), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(s), pa.array(np.diff(first).astype(np.int32))], ["key", "score", "n_passages"])
                del x, first, s
                release()

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, score double, n_passages int")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages")


def keep_good(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, columns as they came."""

    def run(batches):
        release()  # what an earlier stage left in this worker
        for batch in batches:
            for part in batch_rows(batch, BATCH_BYTES):
                x, first = passages(part.column("text"))
                yield part.filter(pa.array(score_passages(weights, x, first) >= THRESHOLD))
                del x, first
                release()

    return docs.mapInArrow(run, docs.schema)
