import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.operators import decode, targets, training
from relspark.session import scratch_path

SETTINGS = training.Settings(n_classes=3, n_features=64, learning_rate=4.0, threshold=0.5)


def texts(n=120, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 4
        words = [f"c{label}w{r.randrange(4)}" if r.random() < 0.6 else f"x{r.randrange(30)}" for _ in range(r.randrange(0, 12))]
        rows.append((i, " ".join(words) if i % 17 else None, label, i % 5 == 0))
    return rows


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "example_id long, sentence string, label int, held boolean").repartition(parts)
    return targets.soft_target(df, n_classes=3)


def twin(rows, s, epochs, steps_of=lambda r: 0):
    """The same training with dense numpy arrays."""
    x = np.zeros((len(rows), s.n_features + 1))
    t = np.zeros((len(rows), 3))
    for i, (_, text, label, _) in enumerate(rows):
        words = [w for w in (text or "").split(" ") if w]
        for w in words:
            x[i, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % s.n_features] += 1 / len(words)
        x[i, -1] = 1
        t[i] = 1 / 3 if label == 0 else np.eye(3)[label - 1]
    held, label = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    w, m, v, out, n = np.zeros((s.n_features + 1, 3)), 0, 0, [], 0

    def loss(rows):
        z = x[rows] @ w
        return (np.maximum(z, 0) - z * t[rows] + np.log1p(np.exp(-abs(z)))).mean()

    for e in range(epochs):
        train = loss(~held)
        grad = x[~held].T @ (1 / (1 + np.exp(-x[~held] @ w)) - t[~held]) / (3 * (~held).sum())
        n += 1
        if s.optimizer == "adamw":
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            grad = (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + s.epsilon)
        w = w * (1 - s.learning_rate * s.weight_decay) - s.learning_rate * grad
        z = x[held] @ w
        pred = np.where(1 / (1 + np.exp(-z.max(1))) >= s.threshold, z.argmax(1) + 1, 0)
        out.append((e + 1, train, loss(held), (pred == label[held]).mean()))
    return w, out


@pytest.mark.parametrize("kind", [{}, {"optimizer": "adamw", "learning_rate": 0.05, "weight_decay": 0.01}])
def test_equals_the_numpy_twin(spark, kind, monkeypatch):
    monkeypatch.setattr(training, "SLICE_CELLS", 50)
    s = training.replace(SETTINGS, **kind)
    rows = texts()
    state, told = training.fit(training.training_rows(frame(spark, rows), s), s, 5)
    w, want = twin(rows, s, 5)
    np.testing.assert_allclose(state.weights, w, atol=1e-8)
    np.testing.assert_allclose(told, want, atol=1e-8)
    assert told[-1][1] < told[0][1]


def test_gradient_is_the_losss_slope(spark):
    s, rows = SETTINGS, texts(40)
    table = training.training_rows(frame(spark, rows), s)
    w = np.random.default_rng(3).normal(size=(65, 3))
    one = 1 << training.GRADIENT_BITS

    def loss(w):
        found = training._sums(table.where("part = 0"), s, w, held=False)
        return found[-1][0] / one / (3 * found[-2][0]), found

    base, found = loss(w)
    for f in [k for k in found if k >= 0][:3] + [64]:
        moved = w.copy()
        moved[f, 1] += 1e-4
        assert (loss(moved)[0] - base) / 1e-4 == pytest.approx(found[f][1] / one / (3 * found[-2][0]), abs=1e-5)


def test_weights_do_not_depend_on_partitions(spark):
    rows = texts(200)
    a, b = (training.fit(training.training_rows(frame(spark, rows, n), SETTINGS), SETTINGS, 3)[0].weights for n in (1, 7))
    assert (a == b).all()


def test_steps_deal_every_training_row_once(spark):
    s = training.replace(SETTINGS, steps=4)
    rows = texts(200)
    table = training.training_rows(frame(spark, rows), s)
    assert table.where("part >= 0").count() == sum(not r[3] for r in rows) and table.where("part = -1").count() == sum(r[3] for r in rows)
    state, told = training.fit(table, s, 2)
    assert state.moved == 8 and told[1][1] < told[0][1]


def test_a_broken_run_ends_as_an_unbroken_one(spark, monkeypatch):
    s = training.replace(SETTINGS, optimizer="adamw", learning_rate=0.05)
    rows = training.training_rows(frame(spark, texts()), s)
    whole, told = training.fit(rows, s, 5)
    store = scratch_path(spark, "epochs")
    plain = training.EpochStore.write

    def dies(self, state):
        """The driver is lost in epoch 3: its weights are there, its figures are not."""
        plain(self, state)
        if state.epoch == 3:
            self.fs.delete(self._at("epoch-00003/figures"), True)
            raise KeyboardInterrupt

    monkeypatch.setattr(training.EpochStore, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        training.fit(rows, s, 5, store=store)
    monkeypatch.setattr(training.EpochStore, "write", plain)
    back, rest = training.fit(rows, s, 5, store=store)
    assert (back.weights == whole.weights).all() and (back.second == whole.second).all() and [r[0] for r in rest] == [3, 4, 5]
    assert rest == told[2:]
    again, none = training.fit(rows, s, 5, store=store)
    assert none == [] and (again.weights == whole.weights).all()
    with pytest.raises(ValueError, match="other settings"):
        training.fit(rows, training.replace(s, learning_rate=0.1), 5, store=store)


def test_the_best_three_and_the_newest_stay(spark):
    rows = training.training_rows(frame(spark, texts()), SETTINGS)
    store = scratch_path(spark, "epochs")
    _, told = training.fit(rows, SETTINGS, 7, store=store)
    kept = training.EpochStore(spark, store, SETTINGS)
    want = sorted(told, key=lambda r: (-r[3], r[2], -r[0]))[:3]
    assert set(kept.figures()) == {r[0] for r in want} | {7} and kept.best()[:3] == [r[0] for r in want]
    assert (kept.read(7).weights == training.fit(rows, SETTINGS, 7)[0].weights).all()


def test_scores_feed_the_decoder(spark):
    rows = texts(300)
    s = training.replace(SETTINGS, learning_rate=20.0, n_features=512)
    df = frame(spark, rows)
    state, told = training.fit(training.training_rows(df, s), s, 25)
    pred = decode.threshold_decode(training.score_texts(df, s, state.weights), threshold=0.5)
    hits = pred.join(df, "example_id").where("held").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert hits == pytest.approx(told[-1][3]) and hits > 0.6


def test_empty_and_bad_input(spark):
    none = training.training_rows(frame(spark, texts()).where("example_id < 0"), SETTINGS)
    state, told = training.fit(none, SETTINGS, 1)
    assert (state.weights == 0).all() and np.isnan(told[0][1:]).all()
    with pytest.raises(Exception, match="width"):
        training.training_rows(frame(spark, texts()).withColumn("target", F.array(F.lit(1.0))), SETTINGS)
    with pytest.raises(ValueError, match="fewer features"):
        training.replace(SETTINGS, n_features=1 << 24).check()
