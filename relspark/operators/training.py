"""A linear classifier of texts trained on soft target vectors by distributed gradient steps.

The loss is the reference head's: the mean over examples and classes of binary cross-entropy with logits
against a vector target (``targets.soft_target``: one-hot, or uniform for no relation).  A text's
features are its words hashed to ``n_features`` numbers, averaged; its logits are the mean of its
words' weight rows plus a bias.

One step is one job.  Tasks add up the gradient of their rows by (feature, class) and send on the
features they met, one row each; Spark sums those, and the driver, which holds the weights (bounded by
``WEIGHT_BYTES``), makes the step.  Nothing else is collected.  Gradients are added as integers
(multiples of ``2**-GRADIENT_BITS``), so the sums do not depend on order: any partitioning, and a run
with lost tasks, ends with the same weights to the last bit.

With a ``store`` every epoch's weights, optimizer moments and figures are written there, the figures
last, as the mark that the epoch is whole.  ``fit`` goes on from the last whole epoch of the same
settings; the ``keep`` best epochs by held-out accuracy stay, and the newest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import as_double_array
from ..plans.joins import require
from ..session import scratch_path
from .decode import EXCEPT0_THRESHOLD

WEIGHT_BYTES = 64 << 20
GRADIENT_BITS = 40
SLICE_CELLS = 1 << 21  # (word, class) cells handled at once
FLUSH_ROWS = 1 << 20  # rows after which a task sends its sums on, far from 64 bits

# rows of the partial sums that are not features
_TRAIN_LOSS, _TRAIN_ROWS, _HELD_LOSS, _HELD_ROWS, _HELD_HITS = -1, -2, -3, -4, -5


@dataclass(frozen=True)
class Settings:
    """What decides a run.  ``steps``: parts of the training rows, each one step an epoch."""

    n_classes: int
    n_features: int = 1 << 12
    learning_rate: float = 1.0
    optimizer: str = "sgd"  # or "adamw"
    weight_decay: float = 0.0
    steps: int = 1
    threshold: float = EXCEPT0_THRESHOLD
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8

    def check(self) -> None:
        if self.optimizer not in ("sgd", "adamw"):
            raise ValueError(f"unknown optimizer {self.optimizer!r}")
        if (self.n_features + 1) * self.n_classes * 8 > WEIGHT_BYTES:
            raise ValueError(f"weights above {WEIGHT_BYTES} bytes; take fewer features")


@dataclass
class State:
    """Weights (last row: bias), optimizer moments and figures after ``epoch`` epochs."""

    epoch: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    moved: int = 0
    figures: tuple[float, float, float] | None = None  # train loss, held-out loss, held-out accuracy

    @classmethod
    def start(cls, s: Settings) -> State:
        shape = s.n_features + 1, s.n_classes
        return cls(0, np.zeros(shape), np.zeros(shape), np.zeros(shape))


# --- rows ------------------------------------------------------------------------------------


def word_features(text: Column, n_features: int) -> Column:
    """Feature numbers of the words between spaces, one for each occurrence (null: none)."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % n_features).cast("int"))


def training_rows(df: DataFrame, settings: Settings, text_col: str = "sentence", target_col: str = "target",
                  label_col: str = "label", held_col: str = "held") -> DataFrame:
    """Rows written once for all steps: ``part`` (0 to ``steps`` - 1, or -1 held out), ``features``, ``target``, ``label``.

    Rows are dealt to parts by a hash of their features; targets must be ``n_classes`` wide."""
    settings.check()
    target = as_double_array(target_col)
    checked = require(df, F.coalesce(F.size(target_col), F.lit(-1)) != settings.n_classes, f"target width differs from {settings.n_classes}")
    rows = checked.select(word_features(F.col(text_col), settings.n_features).alias("features"), target.alias("target"),
                          F.col(label_col).cast("int").alias("label"), F.coalesce(held_col, F.lit(False)).alias("held"))
    part = F.when(F.col("held"), -1).otherwise(F.pmod(F.xxhash64("features", "label"), F.lit(settings.steps))).cast("int")
    path = scratch_path(df.sparkSession, "training-rows")
    rows.select(part.alias("part"), "features", "target", "label").write.partitionBy("part").option("compression", "zstd").parquet(path)
    schema = "features array<int>, target array<double>, label int, part int"
    return df.sparkSession.read.schema(schema).parquet(path)


def _slices(features, n_classes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded cells (one row at least)."""
    size = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin, cells = 0, 0
    for i, n in enumerate(size.tolist()):
        if cells and cells + n * n_classes > SLICE_CELLS:
            yield begin, i
            begin, cells = i, 0
        cells += n * n_classes
    yield begin, len(size)


def _logits(features, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits, the flat features, their rows, and each row's number of features (one at least)."""
    size = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = features.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    many = np.maximum(size, 1)
    z = np.stack([np.bincount(row, weights[flat, k], len(size)) for k in range(weights.shape[1])], 1) / many[:, None]
    return z + weights[-1], flat, row, many


def _losses(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))).sum(1)


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 << GRADIENT_BITS)).astype(np.int64)


# --- one job ---------------------------------------------------------------------------------


def _sums(rows: DataFrame, s: Settings, weights: np.ndarray, held: bool) -> dict[int, list[int]]:
    """Summed partial rows by feature (or figure), as integers: gradients of training rows, or the figures of held-out ones."""
    shipped = rows.sparkSession.sparkContext.broadcast(weights)  # within WEIGHT_BYTES

    def run(batches):
        import pyarrow as pa

        w = shipped.value
        total, seen, figures, since = np.zeros(w.shape, np.int64), np.zeros(len(w), bool), {}, 0

        def add(key, value):
            figures[key] = figures.get(key, 0) + int(value)

        def flush():
            at = np.flatnonzero(seen)
            keys = np.concatenate([at, list(figures)]).astype(np.int32)
            cells = np.concatenate([total[at], [[v] + [0] * (w.shape[1] - 1) for v in figures.values()] or np.zeros((0, w.shape[1]), np.int64)])
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * w.shape[1], pa.int32()), pa.array(cells.reshape(-1), pa.int64()))
            total[at], seen[at] = 0, False
            figures.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), sums], ["key", "sums"])

        for batch in batches:
            features = batch.column("features")
            target = batch.column("target").flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[1])
            label = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b in _slices(features, w.shape[1]) if batch.num_rows else ():
                z, flat, row, many = _logits(features.slice(a, b - a), w)
                loss = _units(_losses(z, target[a:b])).sum()
                if held:
                    kept = 1 / (1 + np.exp(-z.max(1))) >= s.threshold
                    add(_HELD_LOSS, loss)
                    add(_HELD_ROWS, b - a)
                    add(_HELD_HITS, (np.where(kept, z.argmax(1) + 1, 0) == label[a:b]).sum())
                else:
                    off = 1 / (1 + np.exp(-z)) - target[a:b]
                    share = _units(off / many[:, None])
                    order = np.argsort(flat, kind="stable")
                    found, first = np.unique(flat[order], return_index=True)
                    if len(found):
                        total[found] += np.add.reduceat(share[row[order]], first, axis=0)
                    total[-1] += _units(off).sum(0)
                    seen[found] = seen[-1] = True
                    add(_TRAIN_LOSS, loss)
                    add(_TRAIN_ROWS, b - a)
                since += b - a
                if since > FLUSH_ROWS:
                    yield flush()
                    since = 0
        if figures:
            yield flush()

    parts = rows.select("features", "target", "label").mapInArrow(run, "key int, sums array<long>")
    summed = parts.groupBy("key").agg(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(s.n_classes)])
    out = {r[0]: [int(x) for x in r[1:]] for r in summed.collect()}  # at most a row a feature
    shipped.unpersist()
    return out


def _step(state: State, s: Settings, grad: np.ndarray) -> State:
    decayed = state.weights * (1 - s.learning_rate * s.weight_decay)
    if s.optimizer == "sgd":
        return replace(state, weights=decayed - s.learning_rate * grad, moved=state.moved + 1)
    n, (b1, b2) = state.moved + 1, s.betas
    first, second = b1 * state.first + (1 - b1) * grad, b2 * state.second + (1 - b2) * grad**2
    by = (first / (1 - b1**n)) / (np.sqrt(second / (1 - b2**n)) + s.epsilon)
    return replace(state, weights=decayed - s.learning_rate * by, first=first, second=second, moved=n)


def train_epoch(rows: DataFrame, s: Settings, state: State) -> State:
    """One step a part, then the held-out figures of the new weights.  The training loss is that of the
    weights before each step."""
    one = 1 << GRADIENT_BITS
    loss, n = 0, 0
    for part in range(s.steps):
        found = _sums(rows.where(F.col("part") == part), s, state.weights, held=False)
        if _TRAIN_ROWS not in found:
            continue
        count = found[_TRAIN_ROWS][0]
        loss, n = loss + found[_TRAIN_LOSS][0], n + count
        grad = np.zeros_like(state.weights)
        for key, sums in found.items():
            if key >= 0:
                grad[key] = [x / one for x in sums]
        state = _step(state, s, grad / (count * s.n_classes))
    held = _sums(rows.where("part = -1"), s, state.weights, held=True)
    rows_held = held.get(_HELD_ROWS, [0])[0]

    def mean(total, count):
        return total / one / (count * s.n_classes) if count else float("nan")

    figures = (mean(loss, n), mean(held.get(_HELD_LOSS, [0])[0], rows_held), held.get(_HELD_HITS, [0])[0] / rows_held if rows_held else float("nan"))
    return replace(state, epoch=state.epoch + 1, figures=figures)


# --- stored epochs ---------------------------------------------------------------------------


class EpochStore:
    """Epochs below ``path``, a folder that driver and executors share.  ``settings`` hold for all of them."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def figures(self) -> dict[int, tuple]:
        """``epoch: (train loss, held-out loss, accuracy, steps made, settings)`` of the whole epochs."""
        out = {}
        for f in self.fs.listStatus(self.folder) if self.fs.exists(self.folder) else ():
            name = f.getPath().getName()
            if self.fs.exists(self._at(f"{name}/figures/_SUCCESS")):
                r = self.spark.read.json(f"{self.path}/{name}/figures", schema="train double, held double, accuracy double, moved int, settings string").first()
                out[int(name.split("-")[1])] = tuple(r)
        return out

    def write(self, state: State) -> None:
        base = f"{self.path}/epoch-{state.epoch:05d}"
        rows = [(i, w.tolist(), m.tolist(), v.tolist()) for i, (w, m, v) in enumerate(zip(state.weights, state.first, state.second, strict=True))]
        schema = "feature int, weights array<double>, first array<double>, second array<double>"
        self.spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{base}/weights")
        told = (*state.figures, state.moved, json.dumps(asdict(self.settings)))
        one = self.spark.createDataFrame([told], "train double, held double, accuracy double, moved int, settings string")
        one.coalesce(1).write.mode("overwrite").json(f"{base}/figures")

    def read(self, epoch: int) -> State:
        train, held, accuracy, moved, _ = self.figures()[epoch]
        state = State.start(self.settings)
        for r in self.spark.read.parquet(f"{self.path}/epoch-{epoch:05d}/weights").collect():  # within WEIGHT_BYTES
            state.weights[r.feature], state.first[r.feature], state.second[r.feature] = r.weights, r.first, r.second
        return replace(state, epoch=epoch, moved=moved, figures=tuple(float("nan") if x is None else x for x in (train, held, accuracy)))

    def last(self) -> State | None:
        found = self.figures()
        if not found:
            return None
        epoch = max(found)
        if json.loads(found[epoch][4]) != json.loads(json.dumps(asdict(self.settings))):
            raise ValueError(f"{self.path} holds epochs of other settings")
        return self.read(epoch)

    def best(self) -> list[int]:
        """Epochs by held-out accuracy, then loss, then the later."""
        found = self.figures()
        return sorted(found, key=lambda e: (-(found[e][2] or 0.0), found[e][1] if found[e][1] is not None else float("inf"), -e))

    def prune(self, keep: int) -> None:
        """Deletes all but the ``keep`` best epochs and the newest."""
        order = self.best()
        for epoch in set(order[keep:]) - {max(order)}:
            # the mark goes first: a half-deleted epoch is none
            self.fs.delete(self._at(f"epoch-{epoch:05d}/figures"), True)
            self.fs.delete(self._at(f"epoch-{epoch:05d}"), True)


def fit(rows: DataFrame, settings: Settings, epochs: int, store: str | None = None, keep: int = 3) -> tuple[State, list[tuple]]:
    """Train up to ``epochs`` epochs in all; returns the last state and ``(epoch, train loss, held-out loss,
    held-out accuracy)`` of the epochs that this call ran.  With ``store`` it goes on from there."""
    settings.check()
    kept = EpochStore(rows.sparkSession, store, settings) if store else None
    state = (kept.last() if kept else None) or State.start(settings)
    told = []
    while state.epoch < epochs:
        state = train_epoch(rows, settings, state)
        told.append((state.epoch, *state.figures))
        if kept:
            kept.write(state)
            kept.prune(keep)
    return state, told


def score_texts(df: DataFrame, settings: Settings, weights: np.ndarray, text_col: str = "sentence", model_id: str = "soft_linear") -> DataFrame:
    """``SCORES`` (logits of the classes 1 to ``n_classes``) of texts, for ``threshold_decode``."""
    shipped = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in _slices(batch.column("features"), weights_width) if batch.num_rows else ():
                z = _logits(batch.column("features").slice(a, b - a), shipped.value)[0]
                scores = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * weights_width, pa.int32()), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("example_id").slice(a, b - a), scores], ["example_id", "scores"])

    weights_width = weights.shape[1]
    rows = df.select(F.col("example_id").cast("long").alias("example_id"), word_features(F.col(text_col), settings.n_features).alias("features"))
    scored = rows.mapInArrow(run, "example_id long, scores array<double>")
    return scored.select("example_id", F.lit(0).alias("variant"), F.lit(model_id).alias("model_id"), "scores")


def history(spark: SparkSession, told: Sequence[tuple]) -> DataFrame:
    """``(epoch, train_loss, held_loss, held_accuracy)`` of a run."""
    return spark.createDataFrame([tuple(t) for t in told], "epoch int, train_loss double, held_loss double, held_accuracy double")
