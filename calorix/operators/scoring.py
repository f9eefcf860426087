"""Scoring trained networks on vector columns, in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.functions.physics import decide, sigmoid
from calorix.operators.kernels import stacked
from calorix.operators.scaling import standard_scale

MAX_WEIGHTS = 10_000_000


def activation(name: str | None) -> Callable[[np.ndarray], np.ndarray]:
    """Activation by name; None is the identity."""
    known = {
        None: lambda x: x,
        "relu": lambda x: np.maximum(x, 0.0),
        "tanh": np.tanh,
        "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    }
    if name not in known:
        raise ValueError(f"no layer of kind {name} is known")
    return known[name]


@dataclass(frozen=True)
class Dense:
    """One layer: ``activation(x @ weights + bias)``; weights are inputs x outputs."""

    weights: Sequence[Sequence[float]]
    bias: Sequence[float]
    activation: str | None = None


def _prepared(layers: Sequence[Dense]) -> list:
    out = []
    for layer in layers:
        activation(layer.activation)  # an unknown name fails here, not in a task
        out.append((np.asarray(layer.weights, float), np.asarray(layer.bias, float),
                    layer.activation))
    if sum(w.size for w, _, _ in out) > MAX_WEIGHTS:
        raise ValueError("network too large to broadcast")
    return out


def _forward(layers: list, x: np.ndarray) -> np.ndarray:
    for weights, bias, name in layers:
        x = activation(name)(x @ weights + bias)
    return x


def _normalised(x: np.ndarray) -> np.ndarray:
    """Rows divided by the absolute value of their sum (by 1 if that is zero)."""
    norm = np.abs(x.sum(axis=1))
    norm[norm == 0] = 1.0
    return x / norm[:, None]


def network(
    df: DataFrame, layers: Sequence[Dense], normalise: bool = False
) -> Callable[[Column], Column]:
    """A column function that applies a network with one output to a vector column.

    The weights travel once per executor as a broadcast variable; rows move in Arrow batches,
    and the optional normalisation runs on the batch as well.
    """
    shared = df.sparkSession.sparkContext.broadcast(_prepared(layers))

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for batch in batches:
            x, good = stacked(batch, net[0][0].shape[0])
            y = _forward(net, _normalised(x) if normalise else x)[:, 0]
            yield pd.Series(np.where(good, y, np.nan)).where(good, None)

    return apply


def two_branch_network(
    df: DataFrame, branch: Sequence[Dense], trunk: Sequence[Dense]
) -> Callable[[Column, Column], Column]:
    """Column function for the inner product of two networks on two vector columns.

    The first vector is normalised, the second is used as it is.
    """
    shared = df.sparkSession.sparkContext.broadcast((_prepared(branch), _prepared(trunk)))

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        left, right = shared.value
        for a, b in batches:
            xa, ok_a = stacked(a, left[0][0].shape[0])
            xb, ok_b = stacked(b, right[0][0].shape[0])
            good = ok_a & ok_b
            y = np.sum(_forward(left, _normalised(xa)) * _forward(right, xb), axis=1)
            yield pd.Series(np.where(good, y, np.nan)).where(good, None)

    return apply


def with_decision(df: DataFrame, threshold: float) -> DataFrame:
    """Add probability and label to a raw prediction."""
    return df.withColumn("proba", sigmoid("prediction")).withColumn(
        "predicted_label", decide("proba", threshold)
    )


def score_mlp(
    df: DataFrame,
    id_col: str,
    vector: str,
    layers: Sequence[Dense],
    threshold: float,
    filter_cond: str | None = None,
) -> DataFrame:
    """Filter, normalise, apply the network, decide: ``(id, prediction, proba, label)``."""
    rows = df.where(F.expr(filter_cond)) if filter_cond else df
    net = network(df, layers, normalise=True)
    raw = rows.select(id_col, net(F.col(vector)).alias("prediction"))
    return with_decision(raw, threshold)


def score_two_branch(
    df: DataFrame,
    id_col: str,
    vector: str,
    scaled: Sequence[str],
    params: dict[str, float],
    branch: Sequence[Dense],
    trunk: Sequence[Dense],
    threshold: float,
    absolute: Sequence[str] = (),
    filter_cond: str | None = None,
) -> DataFrame:
    """Score with one network on the normalised vector and one on the scaled quantities."""
    rows = df.where(F.expr(filter_cond)) if filter_cond else df
    ready = standard_scale(rows.select(id_col, vector, *scaled), params, scaled, absolute)
    net = two_branch_network(df, branch, trunk)
    raw = ready.select(id_col, net(F.col(vector), F.array(*scaled)).alias("prediction"))
    return with_decision(raw, threshold)


# Workers need the helpers above even where the package itself is not installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
