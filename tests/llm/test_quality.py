import zlib

import numpy as np
import pyarrow as pa

from relspark.llm import quality

from .data import documents, empty, odd_rows, prose


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(80 + i, i)
        # only one passage of a bad document shows it
        rows.append((i, text + "\n" + " ".join(w.upper() + "!!" for w in prose(90, i).split()) if bad else text))
        labels.append((i, 0 if bad else 1, 0))
    return documents(spark, rows, clash=False), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == (r.doc_id % 4 != 0) for r in out]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_never_seen(spark):
    docs, labels = labelled(spark, 120)
    from pyspark.sql import functions as F

    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, wrong)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_odd_rows_and_tables(spark):
    docs, labels = labelled(spark, 60)
    weights = quality.fit(docs, labels)
    odd = documents(spark, odd_rows())
    got = quality.score(odd, weights).collect()
    assert len(got) == len(odd_rows()) and all(r.score is not None for r in got)
    assert {r.n_passages for r in got if r.doc_id in (1, 2, 10)} == {1}
    assert quality.score(empty(spark), weights).count() == 0
    assert quality.keep_good(odd, weights).columns == odd.columns
    # no usable labels: the share of label 1, or one half
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score(odd, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.score(odd, quality.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.fit(empty(spark), labels)["share"] == 0.5


def test_passages_cover_every_word():
    texts = [None, "", "a", "a b " * 100, "\n x\ty ", "z" * 5000]
    x, first = quality.passages(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [1, 1, 1, 4, 1, 1]
    sizes = np.expm1(x[:, len(quality.CLASSES) + 9] * np.log1p(quality.PASSAGE)).round().astype(int)
    assert [int(sizes[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)] == [0, 0, 1, 200, 2, 1]
    assert np.isfinite(x).all()


def small_net(seed=3):
    r = np.random.default_rng(seed)
    first = np.array([0, 3, 4, 9, 11])
    x, y = r.normal(size=(11, quality.FEATURES)), np.array([1.0, 0.0, 1.0, 0.0])
    shape = {"P": (quality.FEATURES, quality.HIDDEN), "p": (quality.HIDDEN,), "V": (quality.HIDDEN, quality.ATTENTION), "U": (quality.HIDDEN, quality.ATTENTION),
             "a": (quality.ATTENTION,), "c": (quality.HIDDEN,), "b": ()}
    return {k: np.array(r.normal(0, 0.4, s)) for k, s in shape.items()}, x, first, y


def twin_scores(w, x, first):
    """The forward pass, one document and one passage at a time."""
    out = []
    for a, b in zip(first[:-1], first[1:]):
        hidden = [np.tanh(sum(x[i, f] * w["P"][f] for f in range(x.shape[1])) + w["p"]) for i in range(a, b)]
        weigh = [sum(w["a"][k] * np.tanh(h @ w["V"][:, k]) / (1 + np.exp(-(h @ w["U"][:, k]))) for k in range(len(w["a"]))) for h in hidden]
        share = np.exp(np.array(weigh)) / np.exp(np.array(weigh)).sum()
        out.append(1 / (1 + np.exp(-(sum(s * h for s, h in zip(share, hidden)) @ w["c"] + w["b"]))))
    return np.array(out)


def test_forward_pass_equals_its_twin():
    w, x, first, _ = small_net()
    np.testing.assert_allclose(quality._forward(w, x, first)[-1], twin_scores(w, x, first), rtol=1e-12)


def test_gradients_are_the_losss_slopes():
    w, x, first, y = small_net()

    def loss(v):
        s = twin_scores(v, x, first)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = quality._gradients(w, x, first, y)
    r = np.random.default_rng(1)
    for k in w:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[k][at]) < 1e-7, k


def test_fit_is_bounded_and_does_not_depend_on_order_or_repeats(spark):
    docs, labels = labelled(spark, 200)
    a = quality.fit(docs, labels)
    again = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 7")).repartition(7)
    b = quality.fit(again, labels)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    # a hundred passages in all: fewer documents, in the same order
    c = quality.fit(docs, labels, max_passages=100)
    assert "share" in c or not np.array_equal(a["c"], c["c"])
    assert quality.fit(docs, labels, max_passages=0)["share"] == 0.5


def test_memory_beside_a_batch_is_that_of_small_parts():
    import tracemalloc

    class Rows:
        schema = None

        def mapInArrow(self, run, _schema):
            return run

    words = np.array(["ab", "cde", "f.", "ghij", "KL", "m", "1234", "opqrstu"])
    r = np.random.default_rng(3)
    texts = [" ".join(words[r.integers(0, 8, 500)]) for _ in range(3000)]  # 6 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    run = quality.keep_good(Rows(), {"share": np.array(0.5)})
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 3000 and peak < 90e6
