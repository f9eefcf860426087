"""Clustering with fixed or fitted centres, and its evaluation.

Centres are a small list on the driver (clusters x dimensions) that is broadcast or enters the
plan as literals, so an iteration is one scan with a partial aggregation and never grows the
lineage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions.distances import CUSTOM_DISTANCES, distance
from calorix.functions.physics import ratio
from calorix.operators import fits
from calorix.operators.compare import best_run, cumulative_cutoff, metric_diff
from calorix.operators.folds import fold_values
from calorix.operators.kernels import (
    BATCH_DISTANCES,
    covariance_of,
    inverse,
    nearest,
    product_sums,
)
from calorix.session import collect_bounded

Centers = list[list[float]]
MAX_CENTER_VALUES = 1_000_000
INVALID_SCORE = -1e6


def _check_size(centers: Centers) -> None:
    if sum(len(c) for c in centers) > MAX_CENTER_VALUES:
        raise ValueError("too many centre values to carry to every task")


def center_distances(vector: str, centers: Centers, metric="euclidean", **params) -> Column:
    """Array with the distance of a row to every centre, as an expression."""
    _check_size(centers)
    return F.array(*[distance(vector, c, metric, **params) for c in centers])


def nearest_center(
    df: DataFrame, vector: str, centers: Centers, metric="euclidean", **params
) -> DataFrame:
    """Add ``cluster`` (the first nearest centre) and ``distance`` to it.

    Common metrics run in Arrow batches; custom and parametric ones as column expressions.
    """
    _check_size(centers)
    # a metric registered under a kernel's name replaces it here as in the expressions
    if metric in BATCH_DISTANCES and metric not in CUSTOM_DISTANCES and not params:
        found = nearest(df.sparkSession, centers, metric)(F.col(vector))
        placed = df.withColumn("_nearest", found)
        return placed.withColumns(
            {"cluster": F.col("_nearest.cluster"), "distance": F.col("_nearest.distance")}
        ).drop("_nearest")
    placed = df.withColumn("_distances", center_distances(vector, centers, metric, **params))
    least = F.array_min("_distances")
    return placed.withColumns(
        {
            "cluster": (F.array_position("_distances", least) - 1).cast("int"),
            "distance": least,
        }
    ).drop("_distances")


def cluster_means(df: DataFrame, vector: str, by: str = "cluster") -> DataFrame:
    """Rows and mean vector of each cluster, aggregated in partial sums."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_samples"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("center"),
    )


def lloyd_step(df: DataFrame, vector: str, centers: Centers, metric="euclidean", **params):
    """Assign rows to centres and return the new centres with sizes and summed distances."""
    placed = nearest_center(df, vector, centers, metric, **params)
    return placed.groupBy("cluster").agg(
        F.count("*").alias("n_samples"),
        F.sum("distance").alias("inertia"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("center"),
    )


def farthest_point_init(
    df: DataFrame, vector: str, id_col: str, k: int, start_id, metric="euclidean", **params
) -> Centers:
    """Start from one row and keep adding the row farthest from its nearest centre.

    Each round is one aggregation that returns a single row; ties go to the smallest id.
    """
    first = df.where(F.col(id_col) == start_id).select(vector).first()
    if first is None:
        raise ValueError(f"no row with {id_col} = {start_id}")
    centers = [[float(x) for x in first[0]]]
    while len(centers) < k:
        gaps = nearest_center(df.select(id_col, vector), vector, centers, metric, **params)
        row = gaps.orderBy(F.desc("distance"), id_col).first()
        centers.append([float(x) for x in row[vector]])
    return centers


def proportional_init(
    df: DataFrame,
    vector: str,
    id_col: str,
    k: int,
    start_id,
    seed: int = 0,
    metric="euclidean",
    **params,
) -> Centers:
    """Like :func:`farthest_point_init`, but rows are drawn in proportion to their distance.

    A row with uniform number ``u`` and distance ``d`` competes with ``ln(u) / d``: the largest
    value wins with probability proportional to ``d``. The uniform number is a hash of the id,
    so a retried task draws the same row.
    """
    first = df.where(F.col(id_col) == start_id).select(vector).first()
    if first is None:
        raise ValueError(f"no row with {id_col} = {start_id}")
    centers = [[float(x) for x in first[0]]]
    while len(centers) < k:
        bits = F.xxhash64(F.lit(seed), F.lit(len(centers)), F.col(id_col))
        u = (F.pmod(bits, F.lit(1 << 52)) + 0.5) / float(1 << 52)
        gaps = nearest_center(df.select(id_col, vector), vector, centers, metric, **params)
        drawn = gaps.withColumn("_u", u).where(F.col("distance") > 0)
        row = drawn.orderBy(F.desc(F.log("_u") / F.col("distance")), id_col).first()
        if row is None:
            break
        centers.append([float(x) for x in row[vector]])
    return centers


def spread_params(df: DataFrame, vector: str, metric) -> dict:
    """Parameters of the metrics that are scaled by the data: variances for ``seuclidean``, the
    inverse covariance for ``mahalanobis`` (both with denominator n - 1); none for others.

    Both come from sums of products per Arrow batch, so one row per batch is added up.
    """
    if metric not in ("seuclidean", "mahalanobis") or metric in CUSTOM_DISTANCES:
        return {}
    sums = df.select(vector).where(F.col(vector).isNotNull())
    stat = sums.select(product_sums(F.col(vector)).alias("s"))
    total = stat.agg(Summarizer.sum(array_to_vector("s")).alias("t")).first()["t"]
    covariance = covariance_of(total.toArray())
    if metric == "seuclidean":
        return {"variances": [float(x) for x in covariance.diagonal()]}
    return {"inverse_covariance": [[float(x) for x in r] for r in inverse(covariance)]}


@dataclass
class MetricKMeans:
    """Lloyd iterations with any named distance.

    ``init`` is ``farthest_point`` or ``proportional`` (a scan per centre), or ``candidates`` or
    ``farthest_candidates``, which take a few scans whatever ``k`` is. Rows whose vector is missing, holds a null or has another length than most are left out of the
    fit; ``skipped`` is their number. ``seuclidean`` and ``mahalanobis`` take their variances from
    the rows unless ``params`` gives them.
    """

    k: int = 8
    init: str = "farthest_point"
    n_init: int = 1
    max_iter: int = 300
    tol: float = 1e-4
    metric: str | Callable = "euclidean"
    seed: int = 0
    params: dict = field(default_factory=dict)
    centers: Centers | None = None
    inertia: float | None = None
    inertia_inits: list[float] = field(default_factory=list)
    skipped: int = 0

    def _start(self, df: DataFrame, vector: str, id_col: str, attempt: int) -> Centers:
        order = F.xxhash64(F.lit(self.seed + attempt), F.col(id_col))
        start = df.orderBy(order, id_col).select(id_col).first()[0]
        if self.init == "farthest_point":
            return farthest_point_init(
                df, vector, id_col, self.k, start, self.metric, **self.params
            )
        if self.init == "proportional":
            return proportional_init(
                df, vector, id_col, self.k, start, self.seed + attempt, self.metric, **self.params
            )
        raise ValueError(f"no such start: {self.init}")

    def fit(self, df: DataFrame, vector: str, id_col: str) -> MetricKMeans:
        """Fit from ``n_init`` starts, all in the same scans, and keep the one with the least inertia."""
        v = F.col(vector)
        size = df.where(v.isNotNull()).agg(F.mode(F.size(v))).first()[0]
        usable = F.coalesce((F.size(v) == F.lit(size)) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
        self.skipped = df.agg(F.count_if(~usable)).first()[0]
        source = df.where(usable).select(id_col, vector)
        self.params = self.params or spread_params(source, vector, self.metric)
        rules = fits.FitRules(
            self.metric, self.params, self.max_iter, self.tol, farthest=self.init == "farthest_candidates", seed=self.seed
        )
        rows = fits.fit_table(source, vector, id_col)
        if self.init in ("candidates", "farthest_candidates"):
            found = fits.fit_many(rows, [self.k], starts=self.n_init, rules=rules)
        else:
            starts = [self._start(source, vector, id_col, i) for i in range(self.n_init)]
            found = [fits.Fit(fits.ALL, np.array(c), i) for i, c in enumerate(starts)]
            fits.run_fits(rows, found, rules)
        self.inertia_inits = [f.inertia for f in found]
        best = min(found, key=lambda f: f.inertia)
        self.inertia, self.centers = best.inertia, best.centers.tolist()
        return self

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        return nearest_center(df, vector, self.centers, self.metric, **self.params)


def cluster_class_counts(df: DataFrame, cluster: str, label: str, distance_sq: str) -> DataFrame:
    """Rows and summed squared distance per (cluster, class)."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("class_")).agg(
        F.count("*").alias("n"), F.sum(distance_sq).alias("ss")
    )


def _with_dominant_class(counts: DataFrame) -> DataFrame:
    per_class = Window.partitionBy("class_")
    share = 100 * F.col("n") / F.sum("n").over(per_class)
    ordered = Window.partitionBy("cluster").orderBy(F.desc("ratio"), "class_")
    return counts.withColumn("ratio", share).withColumn(
        "dominant", F.first("class_").over(ordered)
    )


def cluster_evaluation(counts: DataFrame, classes: Sequence, compat: bool = False) -> DataFrame:
    """Per cluster: inertia, variance, size, rows and share of each class, dominant class.

    ``compat`` divides the total inertia by the cluster's size, as some reports expect; the
    default is the cluster's own inertia over its size.
    """
    total = F.sum(F.sum("ss")).over(Window.partitionBy())  # one row per cluster
    inertia = total if compat else F.sum("ss")
    per_class = []
    for c in classes:
        own = F.col("class_") == c
        per_class += [
            F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"class_{c}_samples"),
            F.coalesce(F.sum(F.when(own, F.col("ratio"))), F.lit(0.0)).alias(f"class_{c}_ratio"),
        ]
    return (
        _with_dominant_class(counts)
        .groupBy("cluster")
        .agg(
            F.sum("ss").alias("inertia"),
            (inertia / F.sum("n")).alias("variance"),
            F.sum("n").alias("n_samples"),
            F.max("dominant").alias("class_"),
            *per_class,
        )
    )


def class_evaluation(counts: DataFrame) -> DataFrame:
    """One-vs-rest counts and rates per class when every cluster predicts its dominant class."""
    tagged = _with_dominant_class(counts)
    actual = tagged.groupBy(F.col("class_").alias("label")).agg(
        F.sum("n").alias("_actual"),
        F.sum(F.when(F.col("dominant") == F.col("class_"), F.col("n")).otherwise(0)).alias("tp"),
    )
    predicted = tagged.groupBy(F.col("dominant").alias("label")).agg(F.sum("n").alias("_pred"))
    total = F.sum("_actual").over(Window.partitionBy())  # one row per class
    joined = actual.join(predicted, "label", "left").withColumn("_total", total)
    rows = joined.select(
        "label",
        "tp",
        (F.coalesce("_pred", F.lit(0)) - F.col("tp")).alias("fp"),
        (F.col("_actual") - F.col("tp")).alias("fn"),
        (F.col("_total") - F.col("_actual") - F.coalesce("_pred", F.lit(0)) + F.col("tp")).alias(
            "tn"
        ),
    )
    return rows.select(
        "label", "tp", "fp", "tn", "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fn"), -1.0).alias("tpr"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn"), -1.0).alias("fpr"),
    )


def clustering_accuracy(counts: DataFrame) -> DataFrame:
    """Total inertia, variance and share of rows whose class is their cluster's dominant one."""
    hit = F.when(F.col("dominant") == F.col("class_"), F.col("n")).otherwise(0)
    return _with_dominant_class(counts).agg(
        F.sum("ss").alias("inertia"),
        (F.sum("ss") / F.sum("n")).alias("variance"),
        F.sum("n").alias("n_samples"),
        (F.sum(hit) / F.sum("n")).alias("accuracy"),
    )


def calinski_harabasz(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """Between over within dispersion; -1e6 when there is a single cluster.

    Per-cluster means and variances come from one partial aggregation; the rest runs on one row
    per cluster and position.
    """
    v = array_to_vector(F.col(vector))
    stats = df.groupBy(cluster).agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.mean(v)).alias("mean"),
        vector_to_array(Summarizer.variance(v)).alias("variance"),
    )
    cells = stats.select(
        cluster, "n", F.posexplode(F.arrays_zip("mean", "variance")).alias("position", "_c")
    )
    n = F.col("n").cast("double")
    mean, within = F.col("_c.mean"), F.col("_c.variance") * (n - 1)
    per_position = cells.groupBy("position").agg(
        F.sum(n).alias("rows"),
        F.count("*").alias("k"),
        F.sum(within).alias("w"),
        F.sum(n * mean).alias("s1"),
        F.collect_list(F.struct(n.alias("n"), mean.alias("m"))).alias("groups"),
    )
    grand = F.col("s1") / F.col("rows")
    between = F.aggregate(
        F.transform("groups", lambda g: g["n"] * (g["m"] - grand) * (g["m"] - grand)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    sums = per_position.select("rows", "k", "w", between.alias("b")).agg(
        F.max("k").alias("n_clusters"),
        F.max("rows").alias("_n"),
        F.sum("w").alias("_w"),
        F.sum("b").alias("_b"),
    )
    k = F.col("n_clusters")
    score = F.when(
        k > 1,
        F.when(F.col("_w") == 0, F.lit(1.0)).otherwise(
            (F.col("_b") / (k - 1)) / (F.col("_w") / (F.col("_n") - k))
        ),
    ).otherwise(F.lit(INVALID_SCORE))
    return sums.select("n_clusters", score.alias("calinski_harabasz_score"))


@dataclass
class Reduction:
    """Standard scaling, principal components and whitening, fitted on one frame."""

    model: PipelineModel
    n_components: int
    component_std: list[float]
    variance: list[tuple[int, float, float, bool]]
    vector: str

    def variance_frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            self.variance, "component int, variance_ratio double, cumulative double, kept boolean"
        )

    def transform(self, df: DataFrame, out: str = "components") -> DataFrame:
        """Add the whitened components as an array column."""
        inputs = df.withColumn("_vector", array_to_vector(F.col(self.vector)))
        projected = self.model.transform(inputs).withColumn("_p", vector_to_array("_pca"))
        scales = F.array(*[F.lit(s) for s in self.component_std])
        white = F.zip_with(F.slice("_p", 1, self.n_components), scales, lambda x, s: x / s)
        return projected.withColumn(out, white).drop("_vector", "_scaled", "_pca", "_p")


def fit_reduction(df: DataFrame, vector: str, max_variance: float = 0.99) -> Reduction:
    """Scale, rotate to principal components and keep them up to a share of the variance."""
    rows = df.select(F.col(vector), array_to_vector(F.col(vector)).alias("_vector"))
    width = rows.select(F.size(vector)).first()[0]
    pipeline = Pipeline(
        stages=[
            StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True),
            PCA(k=width, inputCol="_scaled", outputCol="_pca"),
        ]
    )
    model = pipeline.fit(rows)
    ratios = [float(x) for x in model.stages[1].explainedVariance.toArray()]
    series = df.sparkSession.createDataFrame(
        list(enumerate(ratios)), "component int, variance_ratio double"
    )
    cut = cumulative_cutoff(series, ["component"], "variance_ratio", max_variance)
    table = [
        (r["component"], r["variance_ratio"], r["cumulative"], r["kept"])
        for r in cut.orderBy("component").collect()
    ]
    kept = sum(1 for r in table if r[3])
    spread = model.transform(rows).agg(Summarizer.variance(F.col("_pca"))).first()[0].toArray()
    stds = [math.sqrt(v) if v > 0 else 1.0 for v in spread[:kept]]
    return Reduction(model, kept, stds, table, vector)


def fit_kmeans(
    df: DataFrame,
    vector: str,
    k: int,
    init: str = "k-means||",
    n_init: int = 1,
    max_iter: int = 300,
    tol: float = 1e-4,
    seed: int = 0,
):
    """Spark's k-means from several seeds; the model with the least training cost is kept."""
    rows = df.select(array_to_vector(F.col(vector)).alias("features")).persist()
    try:
        models = [
            KMeans(k=k, initMode=init, maxIter=max_iter, tol=tol, seed=seed + i).fit(rows)
            for i in range(n_init)
        ]
    finally:
        rows.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def search_k(
    df: DataFrame,
    vector: str,
    ks: Sequence[int],
    seed: int = 0,
    max_iter: int = 100,
    starts: int = 1,
    id_col: str | None = None,
) -> DataFrame:
    """Inertia per number of clusters and its change; one row per searched value.

    All sizes and starts are fitted in the same scans; the best start of a size counts.
    """
    rules = fits.FitRules(max_iter=max_iter, seed=seed)
    found = fits.fit_many(fits.fit_table(df, vector, id_col), ks, starts=starts, rules=rules)
    return _search_table(df, found)


def _search_table(df: DataFrame, found: Sequence[fits.Fit]) -> DataFrame:
    best = [min((f for f in found if f.size == k), key=lambda f: f.inertia) for k in sorted({f.size for f in found})]
    table = df.sparkSession.createDataFrame(
        [(f.size, float(f.inertia), float(f.inertia) / f.rows) for f in best],
        "n_clusters int, inertia double, variance double",
    )
    return metric_diff(table, "n_clusters", ["inertia", "variance"])


def best_k(search: DataFrame) -> DataFrame:
    """The number of clusters reached by the steepest fall of the inertia."""
    return best_run(search, "inertia_diff", ["n_clusters"], mode="min")


def kfold_search(
    df: DataFrame,
    vector: str,
    ks: Sequence[int],
    fold_col: str = "fold",
    seed: int = 0,
    starts: int = 1,
    id_col: str | None = None,
) -> DataFrame:
    """Search over the number of clusters on each fold's training rows.

    The size with the steepest fall of the inertia is chosen in every fold and scored on its
    validation rows. All folds, sizes and starts are fitted in the same scans, all folds scored in
    one more.
    """
    rules = fits.FitRules(seed=seed)
    rows = fits.fit_table(df.where(F.col(fold_col) >= 0), vector, id_col, fold_col)
    folds = fold_values(rows)
    found = fits.fit_many(rows, ks, folds, starts, rules)
    chosen = []
    for fold in folds:
        best = {
            k: min((f for f in found if f.fold == fold and f.size == k), key=lambda f: f.inertia)
            for k in sorted(set(ks))
        }
        sizes = list(best)
        falls = [(best[b].inertia - best[a].inertia, b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        chosen.append(best[min(falls)[1] if falls else sizes[0]])
    scored = fits.held_out_sums(rows, chosen, rules)
    results = [
        (f.fold, f.size, float(f.inertia), float(total), n) for f, (n, total) in zip(chosen, scored, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        results, "fold int, n_clusters int, train_inertia double, val_inertia double, n_val long"
    )
