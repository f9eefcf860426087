"""Mini-batch training of networks over folds and starts, with early stop and the best epoch's weights.

All models (fold x start) advance together: a step reads the rows of one mini-batch once, every task
adds up the gradients of every model over its Arrow batches, and one vector per model and task is
summed. The validation fold of each model is swept in one further scan per epoch, so the number of
scans is epochs x (mini-batches + 1), whatever the number of folds and starts. Weights and optimiser
state are small (checked) and live on the driver; after each epoch they are written to the shared
checkpoint folder, from which a broken run goes on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.functions.vectors import l1_normalise
from calorix.operators.metrics import TRAINING_POINTS, unit_thresholds
from calorix.operators.scoring import MAX_WEIGHTS, Dense
from calorix.session import checkpoint_root, collect_bounded, durable

MAX_MODELS = 1000


@dataclass(frozen=True)
class TrainingRules:
    """hidden: sizes of the hidden layers; activation: of them; rate: of Adam; batches: per epoch;
    max_epochs; patience: epochs without a gain of more than ``min_delta`` in the validation max-SP
    after which a model stops; points: thresholds of the sweep; inits: starts of each fold."""

    hidden: Sequence[int] = (8,)
    activation: str = "relu"
    rate: float = 1e-3
    batches: int = 4
    max_epochs: int = 50
    patience: int = 5
    min_delta: float = 1e-3
    points: int = TRAINING_POINTS
    inits: int = 1
    balanced: bool = True
    seed: int = 0


@dataclass
class ModelState:
    """One model: where it stands, and the weights and metrics of its best epoch."""

    fold: int
    init: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    wait: int = 0
    target: float = -np.inf
    stopped: bool = False
    best_epoch: int = 0
    best: np.ndarray | None = None
    record: dict = field(default_factory=dict)


def layer_shapes(width: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def unpack(weights: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight matrices and biases of a flat vector."""
    out, at = [], 0
    for a, b in shapes:
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def first_weights(shapes: list[tuple[int, int]], seed: Sequence[int]) -> np.ndarray:
    """Uniform in plus or minus one over the root of a layer's inputs."""
    draw = np.random.default_rng([int(s) & 0xFFFFFFFF for s in seed])
    parts = [draw.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in shapes]
    return np.concatenate(parts)


def _bend(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An activation and its slope."""
    if name == "relu":
        return np.maximum(z, 0.0), (z > 0).astype(float)
    if name == "tanh":
        h = np.tanh(z)
        return h, 1 - h * h
    if name == "sigmoid":
        h = 1 / (1 + np.exp(-z))
        return h, h * (1 - h)
    raise ValueError(f"no activation of kind {name} is known")


def logits(weights: np.ndarray, shapes: list, activation: str, x: np.ndarray) -> np.ndarray:
    layers = unpack(weights, shapes)
    for w, b in layers[:-1]:
        x, _ = _bend(activation, x @ w + b)
    w, b = layers[-1]
    return (x @ w + b)[:, 0]


def cross_entropies(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def gradient_sum(
    weights: np.ndarray, shapes: list, activation: str, x: np.ndarray, y: np.ndarray, cost: np.ndarray
) -> np.ndarray:
    """Rows, summed weighted loss, and the summed gradient of the weighted loss, as one vector."""
    layers = unpack(weights, shapes)
    inputs, slopes = [x], []
    for w, b in layers[:-1]:
        h, slope = _bend(activation, inputs[-1] @ w + b)
        inputs.append(h)
        slopes.append(slope)
    w, b = layers[-1]
    z = (inputs[-1] @ w + b)[:, 0]
    back = (cost * (1 / (1 + np.exp(-z)) - y))[:, None]
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(inputs[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = back @ layers[k][0].T * slopes[k - 1]
    return np.concatenate([[len(y), (cost * cross_entropies(y, z)).sum()], *parts[::-1]])


def adam_step(state: ModelState, gradient: np.ndarray, rate: float) -> None:
    state.steps += 1
    state.first = 0.9 * state.first + 0.1 * gradient
    state.second = 0.999 * state.second + 0.001 * gradient * gradient
    mean = state.first / (1 - 0.9**state.steps)
    spread = np.sqrt(state.second / (1 - 0.999**state.steps))
    state.weights = state.weights - rate * mean / (spread + 1e-8)


def working_point(pos: np.ndarray, neg: np.ndarray, thresholds: Sequence[float]) -> dict:
    """Area and point of the largest SP of a sweep; ``pos[k]`` are positives that reach ``k``
    thresholds. Among equals the highest threshold counts; an empty class has rates of zero."""
    tp = np.cumsum(pos[::-1])[::-1][1:]
    fp = np.cumsum(neg[::-1])[::-1][1:]
    p, n = pos.sum(), neg.sum()
    tpr = tp / p if p else np.zeros(len(tp))
    fpr = fp / n if n else np.zeros(len(fp))
    sp = np.sqrt(np.sqrt(tpr * (1 - fpr)) * (tpr + 1 - fpr) / 2)
    at = len(sp) - 1 - int(np.argmax(sp[::-1]))
    order = np.lexsort((tpr, fpr))
    area = float((np.diff(fpr[order]) * (tpr[order][1:] + tpr[order][:-1]) / 2).sum())
    return {
        "max_sp_acc": float((tp[at] + n - fp[at]) / (p + n)) if p + n else 0.0,
        "max_sp": float(sp[at]),
        "max_sp_fpr": float(fpr[at]),
        "max_sp_tpr": float(tpr[at]),
        "max_sp_tp": int(tp[at]),
        "max_sp_tn": int(n - fp[at]),
        "max_sp_fp": int(fp[at]),
        "max_sp_fn": int(p - tp[at]),
        "max_sp_thresh": float(thresholds[at]),
        "roc_auc": area,
    }


def training_table(
    df: DataFrame, vector: str, label: str, id_col: str, fold_col: str, rules: TrainingRules
) -> tuple[DataFrame, int]:
    """The written table ``x, y, fold, batch`` of the rows of the study, and the vectors' length.

    A row's mini-batch is a hash of its id. Rows are sorted by it inside each file, so a step skips
    the row groups of other mini-batches without a shuffle. Rows without a label of 0 or 1, with a
    null or negative fold, or with a vector that is missing, holds a null or has another length than
    most take no part.
    """
    v = F.col(vector)
    usable = df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.col(label).isin(0, 1) & (F.col(fold_col) >= 0))
    width = usable.agg(F.mode(F.size(v))).first()[0]
    if not width:
        raise ValueError("no rows to train on")
    rows = usable.where(F.size(v) == width).select(
        l1_normalise(vector).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.col(fold_col).cast("int").alias("fold"),
        mini_batch(id_col, rules).alias("batch"),
    )
    return durable(rows.sortWithinPartitions("batch"), "training"), width


def mini_batch(id_col: str, rules: TrainingRules) -> Column:
    return F.pmod(F.xxhash64(F.lit(rules.seed), F.col(id_col)), F.lit(rules.batches)).cast("int")


def fold_costs(rows: DataFrame, balanced: bool) -> dict[int, tuple[float, float]]:
    """Weights of the two classes for each fold, from the rows of the other folds, in one scan."""
    counts = rows.groupBy("fold").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    found = {r["fold"]: (r["n0"], r["n1"]) for r in collect_bounded(counts, 256, "folds")}
    out = {}
    for fold in sorted(found):
        n = [sum(c[y] for f, c in found.items() if f != fold) for y in (0, 1)]
        out[fold] = tuple(sum(n) / (2 * c) if c and balanced else 1.0 for c in n)
    return out


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _summed(found: DataFrame) -> dict[int, np.ndarray]:
    total = found.groupBy("model").agg(Summarizer.sum(array_to_vector("value")).alias("t"))
    return {r["model"]: r["t"].toArray() for r in collect_bounded(total, MAX_MODELS, "models")}


def _vectors(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
        names=["model", "value"],
    )


_OUT = "model int, value array<double>"


def batch_gradients(
    rows: DataFrame, models: list[ModelState], costs: dict, shapes: list, rules: TrainingRules
) -> dict[int, np.ndarray]:
    """For every model: rows, loss and gradient summed over the given rows outside its fold."""
    shared = rows.sparkSession.sparkContext.broadcast([(m.fold, m.weights, costs[m.fold]) for m in models])
    width, activation = shapes[0][0], rules.activation

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _matrix(batch, width)
            for k, (own, weights, cost) in enumerate(shared.value):
                use = fold != own
                if use.any():
                    part = gradient_sum(weights, shapes, activation, x[use], y[use], np.where(y[use] == 1, cost[1], cost[0]))
                    total[k] = total[k] + part if k in total else part
        yield _vectors(total)

    return _summed(rows.select("x", "y", "fold").mapInArrow(add, _OUT))


def validation_sweeps(
    rows: DataFrame, models: list[ModelState], shapes: list, rules: TrainingRules
) -> dict[int, dict]:
    """Metrics of every model on the rows of its fold, from counts per threshold; one scan."""
    thresholds = np.array(unit_thresholds(rules.points))
    shared = rows.sparkSession.sparkContext.broadcast([(m.fold, m.weights) for m in models])
    width, activation, bins = shapes[0][0], rules.activation, len(thresholds) + 1

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _matrix(batch, width)
            for k, (own, weights) in enumerate(shared.value):
                use = fold == own
                if use.any():
                    z = logits(weights, shapes, activation, x[use])
                    reached = np.searchsorted(thresholds, 1 / (1 + np.exp(-z)), "right")
                    hit = y[use] == 1
                    part = np.concatenate(
                        [
                            [use.sum(), cross_entropies(y[use], z).sum()],
                            np.bincount(reached[hit], minlength=bins),
                            np.bincount(reached[~hit], minlength=bins),
                        ]
                    )
                    total[k] = total[k] + part if k in total else part
        yield _vectors(total)

    out = {}
    for k, t in _summed(rows.select("x", "y", "fold").mapInArrow(sweep, _OUT)).items():
        # sums come from means, so a count may miss its integer by rounding
        counts = np.rint(t[2:])
        point = working_point(counts[:bins], counts[bins:], thresholds.tolist())
        out[k] = {"loss": float(t[1] / t[0]), **point}
    return out


def judge_epoch(state: ModelState, record: dict, rules: TrainingRules) -> None:
    """Keep the weights of the first epoch with the largest max-SP; stop after ``patience`` epochs
    without a gain of more than ``min_delta``."""
    state.epoch += 1
    value = record["max_sp"]
    if state.best is None or value > state.record["max_sp"]:
        state.best, state.best_epoch, state.record = state.weights.copy(), state.epoch, record
    if value - rules.min_delta > state.target:
        state.target, state.wait = value, 0
    else:
        state.wait += 1
    state.stopped = state.wait >= rules.patience or state.epoch >= rules.max_epochs


_STATE = (
    "fold int, init int, weights array<double>, first array<double>, second array<double>, steps int, epoch int, "
    "wait int, target double, stopped boolean, best_epoch int, best array<double>, record map<string,double>"
)
_ARRAYS = ("weights", "first", "second", "best")
_COUNTS = ("max_sp_tp", "max_sp_tn", "max_sp_fp", "max_sp_fn")


def save_states(spark: SparkSession, states: list[ModelState], path: str) -> None:
    rows = []
    for s in states:
        d = vars(s) | {a: vars(s)[a].tolist() for a in _ARRAYS}
        d["record"] = {k: float(v) for k, v in s.record.items()}
        rows.append(tuple(d[f.split()[0]] for f in _STATE.split(", ")))
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(path)


def load_states(spark: SparkSession, path: str) -> list[ModelState]:
    out = []
    for r in collect_bounded(spark.read.schema(_STATE).parquet(path), MAX_MODELS, "models"):
        d = r.asDict() | {a: np.array(r[a]) for a in _ARRAYS}
        d["record"] = {k: int(v) if k in _COUNTS else v for k, v in r["record"].items()}
        out.append(ModelState(**d))
    return sorted(out, key=lambda s: (s.fold, s.init))


def _last_epoch(spark: SparkSession, root: str) -> str | None:
    """The newest wholly written state below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = [str(f.getPath()) for f in files.listStatus(path)]
    whole = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    return max(whole, default=None)


def train_networks(
    df: DataFrame,
    vector: str,
    label: str,
    id_col: str,
    fold_col: str = "fold",
    rules: TrainingRules | None = None,
    run: str | None = None,
) -> list[ModelState]:
    """Train ``inits`` networks for every fold until each stops; ``best`` holds the returned weights.

    ``run`` names a folder below the checkpoint folder: a run of the same name goes on after the
    last epoch that was written, with the same result.
    """
    rules = rules or TrainingRules()
    spark = df.sparkSession
    rows, width = training_table(df, vector, label, id_col, fold_col, rules)
    shapes = layer_shapes(width, rules.hidden)
    costs = fold_costs(rows, rules.balanced)
    size = sum(a * b + b for a, b in shapes)
    if size * len(costs) * rules.inits > MAX_WEIGHTS:
        raise ValueError("too many weights to carry to every task")
    root = f"{checkpoint_root(spark)}/{run}" if run else None
    last = _last_epoch(spark, root) if root else None
    if last:
        states = load_states(spark, last)
    else:
        states = [
            ModelState(fold, init, first_weights(shapes, (rules.seed, fold, init)), np.zeros(size), np.zeros(size))
            for fold in costs
            for init in range(rules.inits)
        ]
    while active := [s for s in states if not s.stopped]:
        for b in range(rules.batches):
            found = batch_gradients(rows.where(F.col("batch") == b), active, costs, shapes, rules)
            for k, total in found.items():
                adam_step(active[k], total[2:] / total[0], rules.rate)
        for k, record in validation_sweeps(rows, active, shapes, rules).items():
            judge_epoch(active[k], record, rules)
        if root:
            save_states(spark, states, f"{root}/epoch-{max(s.epoch for s in states):06d}")
    return states


def training_report(spark: SparkSession, states: list[ModelState]) -> DataFrame:
    """One row per model: fold, init, epochs run, best epoch and its validation metrics."""
    rows = [{"fold": s.fold, "init": s.init, "epochs": s.epoch, "best_epoch": s.best_epoch, **s.record} for s in states]
    return spark.createDataFrame(rows)


def network_layers(state: ModelState, width: int, rules: TrainingRules) -> list[Dense]:
    """The best epoch's network for :func:`calorix.operators.scoring.score_mlp`."""
    layers = unpack(state.best, layer_shapes(width, rules.hidden))
    names = [rules.activation] * (len(layers) - 1) + [None]
    return [Dense(w.tolist(), b.tolist(), a) for (w, b), a in zip(layers, names, strict=True)]


# Workers need the helpers above even where the package itself is not installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
