"""Many clusterings in one scan, and starts in a few scans, for any named distance.

A fit is a number of clusters on the rows outside one fold (or on all rows), from one start. All
fits take a step together: the row carries its nearest centre in every fit, each task adds up
rows, distances and vectors per fit and cluster, and one vector per fit and cluster is summed. The
number of scans is that of the longest fit, whatever the number of folds, starts and sizes.

Starts come from candidates: a few rounds, each one scan, draw several rows at once in proportion to
their distance from the candidates so far; one more scan counts the rows
nearest to each candidate. The starts of every fit are then chosen among the few weighted
candidates, so the number of scans does not depend on the number of clusters either.
"""

from __future__ import annotations

import heapq
import math
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

from calorix.functions.distances import CUSTOM_DISTANCES, distance
from calorix.operators.kernels import BATCH_DISTANCES, nearest
from calorix.session import collect_bounded, durable

MAX_VALUES = 1_000_000
#: A fold number that no row has: the fit is on all rows.
ALL = -1


@dataclass
class Fit:
    """One clustering: its fold and centres, and what the last step said. ``size`` is the number of
    clusters asked for; where fewer rows differ there are fewer centres."""

    fold: int
    centers: np.ndarray
    start: int = 0
    inertia: float = math.inf
    rows: int = 0
    steps: int = 0
    done: bool = False

    size: int = 0

    def __post_init__(self):
        self.size = self.size or len(self.centers)


@dataclass(frozen=True)
class FitRules:
    """metric and its params; max_iter steps; tol: relative change of inertia, or of every centre,
    below which a fit ends; rounds and ahead: of drawing candidates, ``ahead`` times the largest k in
    each; farthest: a start is the candidate farthest from those before instead of a draw."""

    metric: str = "sqeuclidean"
    params: dict = field(default_factory=dict)
    max_iter: int = 100
    tol: float = 1e-4
    rounds: int = 4
    ahead: int = 2
    farthest: bool = False
    seed: int = 0


def nearest_column(spark: SparkSession, vector: str, centers: np.ndarray, rules: FitRules) -> Column:
    """``(cluster, distance)`` of the first nearest centre: in Arrow batches for metrics that have a
    kernel, else an expression."""
    if rules.metric in BATCH_DISTANCES and rules.metric not in CUSTOM_DISTANCES and not rules.params:
        return nearest(spark, centers, rules.metric)(F.col(vector))
    found = F.array(*[distance(vector, c, rules.metric, **rules.params) for c in centers.tolist()])
    least = F.array_min(found)
    return F.struct((F.array_position(found, least) - 1).cast("int").alias("cluster"), least.alias("distance"))


def fit_table(df: DataFrame, vector: str, id_col: str | None = None, fold_col: str | None = None) -> DataFrame:
    """The written table ``x, bits, fold`` of the usable rows.

    Usable are vectors without nulls that have the most frequent length. ``bits`` is a hash of the
    id, or of the vector where no id is given; without a fold column all rows have fold -2.
    """
    v = F.col(vector)
    whole = df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    width = whole.agg(F.mode(F.size(v))).first()[0]
    rows = whole.where(F.size(v) == F.lit(width or 0)).select(
        v.cast("array<double>").alias("x"),
        F.xxhash64(F.col(id_col) if id_col else v).alias("bits"),
        (F.col(fold_col).cast("int") if fold_col else F.lit(-2)).alias("fold"),
    )
    return durable(rows.where("fold IS NOT NULL"), "fit-rows")


def _check(sets: Sequence[np.ndarray]) -> None:
    if sum(c.size for c in sets) > MAX_VALUES:
        raise ValueError("too many centre values to carry to every task")


def _placed(rows: DataFrame, sets: Sequence[np.ndarray], rules: FitRules) -> DataFrame:
    """The rows with ``c``, an array with the nearest centre of every set."""
    _check(sets)
    found = [nearest_column(rows.sparkSession, "x", c, rules) for c in sets]
    return rows.select("x", "bits", "fold", *[f.alias(f"c{i}") for i, f in enumerate(found)])


def _uniform(bits: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that a retried task draws again."""
    x = bits.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(float) / 2**52 + 2.0**-53


def _drawn(
    rows: DataFrame, folds: Sequence[int], known: dict[int, np.ndarray], n: int, turn: int, rules: FitRules
) -> dict[int, np.ndarray]:
    """For every fold the ``n`` rows with the largest keys, in one scan.

    With ``u`` uniform, ``ln(u) / d`` is a key whose largest values are draws without repetition in
    proportion to ``d``; every task keeps its ``n`` largest keys per fold.
    """
    sets = [known[f] for f in folds if len(known[f])]
    placed = _placed(rows, sets, rules) if sets else rows
    seed = rules.seed

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {f: [] for f in folds}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bits, own = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for g, f in enumerate(folds):
                u = _uniform(bits, (seed * 1009 + turn) * 1009 + f)
                if sets:
                    d = batch.column(3 + g).field("distance").to_numpy(zero_copy_only=False)
                    good = np.isfinite(d) & (d > 0)
                    key = np.log(u) / np.where(good, d, 1.0)
                else:
                    good, key = np.ones(len(u), bool), np.log(u)
                use = np.flatnonzero(good & (own != f))
                use = use[np.argsort(-key[use], kind="stable")[:n]]
                for k in use.tolist():
                    best[f].append((float(key[k]), int(bits[k]), x[k].tolist()))
                best[f] = heapq.nlargest(n, best[f], key=lambda r: r[:2])
        found = [(f, *r) for f, rs in best.items() for r in rs]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["f", "key", "bits", "x"]
        )

    found = placed.mapInArrow(keep, "f int, key double, bits long, x array<double>")
    # n rows per fold and task, first merged in shares; struct comparison keeps the same rows on every run
    best = F.slice(F.sort_array(F.collect_list(F.struct("key", "bits", "x")), asc=False), 1, n).alias("r")
    shared = found.groupBy("f", F.pmod("bits", F.lit(64)).alias("share")).agg(best)
    top = shared.select("f", F.explode("r").alias("r")).select("f", "r.*").groupBy("f").agg(best)
    out = {f: np.zeros((0, 0)) for f in folds}
    for f, r in collect_bounded(top, len(folds), "folds"):
        out[f] = np.array([c["x"] for c in r])
    return out


def candidates(
    rows: DataFrame, folds: Sequence[int], k: int, rules: FitRules
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Candidate rows of every fold and the number of rows nearest to each; ``rounds`` + 2 scans."""
    known: dict[int, np.ndarray] = {f: np.zeros((0, 0)) for f in folds}
    known = _drawn(rows, folds, known, 1, 0, rules)
    if any(not len(c) for c in known.values()):
        raise ValueError("a fold leaves no rows to fit")
    for turn in range(1, rules.rounds + 1):
        more = _drawn(rows, folds, known, rules.ahead * k, turn, rules)
        known = {f: np.concatenate([c, more[f]]) if len(more[f]) else c for f, c in known.items()}
        known = {f: c[np.sort(np.unique(c, axis=0, return_index=True)[1])] for f, c in known.items()}
    found = _step(rows, [Fit(f, known[f]) for f in folds], rules)
    out = {}
    for g, f in enumerate(folds):
        weight = np.zeros(len(known[f]))
        for c, total in found[g].items():
            weight[c] = total[0]
        out[f] = (known[f], weight)
    return out


def chosen_starts(
    points: np.ndarray, weight: np.ndarray, k: int, start: int, rules: FitRules, measure
) -> np.ndarray:
    """``k`` of the weighted candidates: the first by weight, each next one in proportion to weight times
    distance from the ones before, or the farthest."""
    draw = np.random.default_rng([rules.seed & 0xFFFFFFFF, k, start])
    at = [int(draw.choice(len(points), p=weight / weight.sum()))]
    least = measure(points, points[at[0]])
    while len(at) < min(k, len(points)):
        gain = np.where(np.isfinite(least), np.maximum(least, 0.0), 0.0) * (weight > 0)
        if not gain.sum() > 0:
            break
        if rules.farthest:
            at.append(int(np.argmax(gain)))
        else:
            gain = gain * weight
            # the best of a few draws, by what is left of the weighted distances
            picks = np.unique(draw.choice(len(points), size=2 + int(math.log(k)), p=gain / gain.sum()))
            left = [float((weight * np.minimum(least, measure(points, points[p]))).sum()) for p in picks]
            at.append(int(picks[int(np.argmin(left))]))
        least = np.fmin(least, measure(points, points[at[-1]]))
    return points[at]


def candidate_distance(spark: SparkSession, rules: FitRules):
    """``measure(points, center)`` between candidates; metrics without a kernel run as expressions over
    the few candidates."""
    if rules.metric in BATCH_DISTANCES and rules.metric not in CUSTOM_DISTANCES and not rules.params:
        return BATCH_DISTANCES[rules.metric]

    def measure(points: np.ndarray, center: np.ndarray) -> np.ndarray:
        held = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, x array<double>")
        d = held.select("i", distance("x", center.tolist(), rules.metric, **rules.params).alias("d"))
        found = {r["i"]: r["d"] for r in collect_bounded(d, len(points), "candidates")}
        return np.array([np.nan if found[i] is None else found[i] for i in range(len(points))])

    return measure


def _step(rows: DataFrame, fits: Sequence[Fit], rules: FitRules) -> list[dict[int, np.ndarray]]:
    """For every fit and cluster: rows, summed distance, summed vector; one scan."""
    folds = [f.fold for f in fits]
    placed = _placed(rows, [f.centers for f in fits], rules)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = batch.column(2).to_numpy()
            for g, fold in enumerate(folds):
                near = batch.column(3 + g)
                d = near.field("distance").to_numpy(zero_copy_only=False)
                use = np.flatnonzero((own != fold) & near.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(d))
                cluster = near.field("cluster").to_numpy(zero_copy_only=False)[use].astype(int)
                order = np.argsort(cluster, kind="stable")
                values = np.column_stack([np.ones(len(use)), d[use], x[use]])[order]
                held, at = np.unique(cluster[order], return_index=True)
                if not len(held):
                    continue
                for c, part in zip(held.tolist(), np.add.reduceat(values, at, axis=0), strict=True):
                    total[g, c] = total[g, c] + part if (g, c) in total else part
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g for g, _ in total], pa.int32()),
                pa.array([c for _, c in total], pa.int32()),
                pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64())),
            ],
            names=["fit", "cluster", "value"],
        )

    found = placed.mapInArrow(add, "fit int, cluster int, value array<double>")
    summed = found.groupBy("fit", "cluster").agg(Summarizer.sum(array_to_vector("value")).alias("t"))
    out: list[dict[int, np.ndarray]] = [{} for _ in fits]
    for r in collect_bounded(summed, sum(len(f.centers) for f in fits), "clusters"):
        total = r["t"].toArray()
        total[0] = np.rint(total[0])  # sums come from means, so a count may miss its integer by rounding
        out[r["fit"]][r["cluster"]] = total
    return out


def advance(rows: DataFrame, fits: Sequence[Fit], rules: FitRules) -> None:
    """One step of all fits. A fit ends when its inertia or all its centres stay; centres that attract
    no row stay where they are."""
    for fit, found in zip(fits, _step(rows, fits, rules), strict=True):
        inertia = math.fsum(t[1] for t in found.values())
        fit.rows, fit.steps = int(sum(t[0] for t in found.values())), fit.steps + 1
        if math.isclose(inertia, fit.inertia, rel_tol=rules.tol, abs_tol=1e-8):
            fit.done = True
        else:
            moved = np.array([found[c][2:] / found[c][0] if c in found else old for c, old in enumerate(fit.centers)])
            if np.allclose(moved, fit.centers, rtol=rules.tol, atol=1e-8):
                fit.done = True
            else:
                fit.centers = moved
        fit.inertia = inertia
        fit.done = fit.done or fit.steps >= rules.max_iter


def fit_many(
    rows: DataFrame, ks: Sequence[int], folds: Sequence[int] = (ALL,), starts: int = 1, rules: FitRules | None = None
) -> list[Fit]:
    """Fit every (fold, k, start) on the rows of a :func:`fit_table`, all in the same scans."""
    rules = rules or FitRules()
    folds = list(folds)
    held = candidates(rows, folds, max(ks), rules)
    measure = candidate_distance(rows.sparkSession, rules)
    fits = [
        Fit(fold, chosen_starts(*held[fold], k, start, rules, measure), start, size=k)
        for fold in folds
        for k in ks
        for start in range(starts)
    ]
    run_fits(rows, fits, rules)
    return fits


def run_fits(rows: DataFrame, fits: Sequence[Fit], rules: FitRules) -> None:
    while active := [f for f in fits if not f.done]:
        advance(rows, active, rules)


def held_out_sums(rows: DataFrame, fits: Sequence[Fit], rules: FitRules) -> list[tuple[int, float]]:
    """Rows and summed distance of each fit on the rows of its own fold, in one scan."""
    placed = _placed(rows, [f.centers for f in fits], rules)
    parts = []
    for i, f in enumerate(fits):
        own = F.col("fold") == f.fold
        parts += [F.count_if(own), F.coalesce(F.sum(F.when(own, F.col(f"c{i}.distance"))), F.lit(0.0))]
    row = placed.agg(*parts).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(fits))]


# Workers need the helpers above even where the package itself is not installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
