"""Distributions: histograms, summaries, vector profiles, per-event aggregates, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions.physics import delta_r, in_box, ratio
from calorix.functions.vectors import l1_normalise, layer_slices, vector_sum
from calorix.schemas import RING_LAYERS
from calorix.session import durable, few


def linear_edges(low: float, high: float, nbins: int) -> list[float]:
    """``nbins`` evenly spaced edges, which is one interval fewer."""
    step = (high - low) / (nbins - 1)
    edges = [low + i * step for i in range(nbins - 1)] + [high]
    return sorted(set(edges)) if high > low else [low - 0.5, low + 0.5]


def value_range(df: DataFrame, column: str, low=None, high=None) -> tuple[float, float]:
    """Smallest and largest value of a column, unless given; two numbers reach the driver."""
    if low is None or high is None:
        v = F.col(column).cast("double")
        kept = df.where(v.isNotNull() & ~F.isnan(v))
        found = kept.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        if found["lo"] is None:
            raise ValueError(f"{column} has no values")
        low = found["lo"] if low is None else low
        high = found["hi"] if high is None else high
    return float(low), float(high)


def _binned(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Closed-left bins with a closed last edge; values outside the edges are left out."""
    v = F.col(column).cast("double")
    rows = df.where((v >= edges[0]) & (v <= edges[-1])).withColumn(f"_{out}", v)
    if len(edges) == 2:
        return rows.withColumn(out, F.lit(0)).drop(f"_{out}")
    binned = Bucketizer(splits=list(edges), inputCol=f"_{out}", outputCol=out).transform(rows)
    return binned.withColumn(out, F.col(out).cast("int")).drop(f"_{out}")


def _edge(edges: Sequence[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(float(e)) for e in edges]), index)


def histogram(
    df: DataFrame,
    column: str,
    nbins: int = 100,
    bin_min: float | None = None,
    bin_max: float | None = None,
    edges: Sequence[float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts and density per bin (empty bins are not listed).

    Several series share their edges by passing the series columns in ``by``.
    """
    if edges is None:
        edges = linear_edges(*value_range(df, column, bin_min, bin_max), nbins)
    counts = _binned(df.select(*by, column), column, edges, "bin").groupBy(*by, "bin").agg(
        F.count("*").alias("n")
    )
    low, high = _edge(edges, F.col("bin")), _edge(edges, F.col("bin") + 1)
    total = F.sum("n").over(Window.partitionBy(*by))  # one row per bin
    return counts.select(
        *by,
        "bin",
        low.alias("bin_low"),
        high.alias("bin_high"),
        "n",
        (F.col("n") / (total * (high - low))).alias("density"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of every category; the total is summed over the categories' counts."""
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", 100 * F.col("n") / total)


def histogram2d(
    df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float]
) -> DataFrame:
    """Counts, densities and both marginals of the non-empty cells of a 2-D grid."""
    rows = _binned(_binned(df.select(x, y), x, x_edges, "x_bin"), y, y_edges, "y_bin")
    cells = rows.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    area = (_edge(x_edges, F.col("x_bin") + 1) - _edge(x_edges, F.col("x_bin"))) * (
        _edge(y_edges, F.col("y_bin") + 1) - _edge(y_edges, F.col("y_bin"))
    )
    total = F.sum("n").over(Window.partitionBy())  # at most one row per grid cell
    return cells.select(
        "x_bin",
        "y_bin",
        "n",
        F.sum("n").over(Window.partitionBy("x_bin")).alias("n_x"),
        F.sum("n").over(Window.partitionBy("y_bin")).alias("n_y"),
        (F.col("n") / (total * area)).alias("density"),
    )


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing values, mean, sample spread, minimum and maximum of each column."""
    out = []
    for c in columns:
        v = F.col(c).cast("double")
        out += [
            F.count_if(v.isNull()).alias(f"{c}_null"),
            F.avg(v).alias(f"{c}_mean"),
            F.stddev_samp(v).alias(f"{c}_std"),
            F.min(v).alias(f"{c}_min"),
            F.max(v).alias(f"{c}_max"),
        ]
    return df.groupBy(*by).agg(F.count("*").alias("n_samples"), *out)


def sample_counts(df: DataFrame, event_col: str, approximate: bool = False) -> DataFrame:
    """Number of samples and of distinct events."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("n_samples"), distinct(event_col).alias("n_events"))


def ring_size_counts(df: DataFrame, rings: str, sizes: Sequence[int]) -> DataFrame:
    """How many vectors have each expected length, another length, or none of their elements."""
    n = F.size(rings)
    return df.agg(
        F.count("*").alias("n_samples"),
        *[F.count_if(n == s).alias(f"size_{s}") for s in sizes],
        F.count_if(~n.isin(*sizes)).alias("wrong"),
        F.count_if(n == 0).alias("no_rings"),
    )


def vector_profile(
    df: DataFrame, vector: str, normalise: bool = False, by: Sequence[str] = (), layers=RING_LAYERS
) -> DataFrame:
    """Mean and population spread of every vector position, with its layer name."""
    v = l1_normalise(vector) if normalise else F.col(vector)
    positions = df.select(*by, F.posexplode(v).alias("position", "_x"))
    stats = positions.groupBy(*by, "position").agg(
        F.count("*").alias("n"),
        F.avg(F.col("_x").cast("double")).alias("mean"),
        F.stddev_pop(F.col("_x").cast("double")).alias("std"),
    )
    layer = F.lit(None).cast("string")
    for name, start, size in layers:
        inside = (F.col("position") >= start) & (F.col("position") < start + size)
        layer = F.when(inside, name).otherwise(layer)
    return stats.withColumn("layer", layer)


def layer_energy(df: DataFrame, vector: str, keep: Sequence[str], layers=RING_LAYERS) -> DataFrame:
    """Sum of the vector inside each layer."""
    return df.select(
        *keep,
        *[vector_sum(s).alias(f"e_{n.lower()}") for n, s in layer_slices(vector, layers).items()],
    )


def event_top2(
    df: DataFrame, event: str, energy: str, eta: str, phi: str, tie: str, columns: Sequence[str]
) -> DataFrame:
    """Per event: objects, duplicate rows plus one, the two highest energies and their distance.

    Identical rows are merged first, so an event with very many copies is one row with a count.
    The rank filter lets every task keep at most two rows per event before the shuffle.
    """
    cols = list(dict.fromkeys([*columns, energy, eta, phi, tie]))
    distinct = df.groupBy(event, *cols).agg(F.count("*").alias("_copies"))
    counts = distinct.groupBy(event).agg(
        F.sum("_copies").alias("n_objects"),
        (F.sum("_copies") - F.count("*") + 1).alias("n_duplicates"),
    )
    order = Window.partitionBy(event).orderBy(F.desc(energy), F.asc(tie), F.asc("_copy"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least("_copies", F.lit(2)))).alias(
        "_copy"
    )
    top = (
        distinct.select(event, energy, eta, phi, tie, copies)
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= 2)
        .groupBy(event)
        .agg(
            *[
                F.max(F.when(F.col("_r") == r, F.col(c))).alias(name)
                for c, prefix in ((energy, "highest_e"), (eta, "eta"), (phi, "phi"))
                for r, name in ((1, f"{prefix}1"), (2, f"{prefix}2"))
            ]
        )
    )
    return counts.join(top, event).withColumn("delta_r", delta_r("eta1", "phi1", "eta2", "phi2"))


def weighted_stats(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, and spread with denominator ``(m - 1) * sum(w) / m``, m = non-zero weights.

    Deviations are taken from the mean of a first pass, so large values keep their digits.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    base = df.select(*by, v.alias("_v"), w.alias("_w"))
    weighted_mean = (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_mean")
    if by:
        centred = base.join(few(base.groupBy(*by).agg(weighted_mean), "group-means"), list(by))
    else:
        mean = base.agg(weighted_mean).first()["_mean"]
        centred = base.withColumn("_mean", F.lit(mean))
    gap = F.col("_v") - F.col("_mean")
    m = F.count_if(F.col("_w") != 0)
    return centred.groupBy(*by).agg(
        F.first("_mean").alias("weighted_mean"),
        F.sqrt(
            ratio(F.sum(F.col("_w") * gap * gap), (m - 1) * F.sum("_w") / m)
        ).alias("weighted_std"),
        m.alias("n_weights"),
    )


def frame_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Digest of a frame's content that does not depend on row order or on the engine.

    Each row's text is hashed to 128 bits; the digest is the row count with the sums of the
    hash's four 32-bit words, which tasks can add up independently. The sums are decimals, as a
    long would overflow after some 4e9 rows, and are given as text, which every engine writes alike.
    """
    names = list(columns) if columns else df.columns
    text = F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in names]
    )
    row = F.md5(text)
    words = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(28,0)"))
        .cast("string")
        .alias(f"word{i}")
        for i in range(4)
    ]
    return df.agg(F.count("*").alias("n_rows"), *words)


def stage_counters(df: DataFrame, file_col: str, stage_col: str, count_col: str) -> DataFrame:
    """Counters of every processing stage, added up over files."""
    return df.groupBy(stage_col).agg(
        F.count_distinct(file_col).alias("n_files"), F.sum(count_col).cast("long").alias("total")
    )


def efficiency(df: DataFrame, by: Sequence[str], passed: str, total: str) -> DataFrame:
    """Share that passed, per bin."""
    return df.groupBy(*by).agg(
        F.sum(passed).alias("passed"),
        F.sum(total).alias("total"),
        F.try_divide(F.sum(passed), F.sum(total)).alias("efficiency"),
    )


def energy_ratio(
    clusters: DataFrame, seeds: DataFrame, particles: DataFrame, cell: float = 0.25
) -> DataFrame:
    """Energy of the truth particles behind each cluster, compared with the cluster's own.

    One row per cluster id, over all combinations of cluster, seed and particle rows that share a
    seed; ids need not be unique, as inputs that each number from 1 may be united. Combinations
    are not formed: seeds and particles are summed per seed and weighted by how often cluster and
    seed are listed. Only the count of particles inside the cluster's box looks at pairs; it
    matches clusters and particles that share a seed **and** a grid cell of the eta-phi plane, so
    a seed with very many of both is split by cell and not paired in full. ``cell`` should be
    at least as wide as a box, which then lies in at most four cells. Rows without a cluster id
    are left out.

    Inputs: clusters ``id, seed_id, e, et, eta, phi, deta, dphi``; seeds ``id``; particles
    ``id, seed_id, e, et, eta, phi``.
    """
    listed = seeds.groupBy(F.col("id").alias("seed_id")).agg(F.count("*").alias("_times"))
    per_seed = particles.groupBy("seed_id").agg(
        F.count_distinct("id").alias("_ids"),
        F.sum(F.col("et").cast("double")).alias("_et"),
        F.sum(F.col("e").cast("double")).alias("_e"),
    )
    of_seed = listed.join(per_seed, "seed_id")
    rows = clusters.groupBy("id", "seed_id").agg(
        F.max("et").alias("cl_et"), F.max("e").alias("cl_e"), F.count("*").alias("_rows")
    )
    n = F.col("_rows") * F.col("_times")
    base = (
        rows.join(of_seed, "seed_id")
        .groupBy("id")
        .agg(
            F.max(F.col("id").isNotNull().cast("long")).alias("n_clusters"),
            F.max("cl_et").alias("cl_et"),
            F.max("cl_e").alias("cl_e"),
            F.count("seed_id").alias("n_seeds"),
            F.sum("_ids").alias("_ids"),
            F.sum(F.col("_et") * n).alias("_et"),
            F.sum(F.col("_e") * n).alias("_e"),
        )
        .where("n_clusters = 1")
    )
    base = durable(base, "cluster-sums")  # one row per cluster, read three times
    # a particle id may stand under several seeds of one cluster id: only those are counted apart
    several = base.where("n_seeds > 1").select("id")
    if several.isEmpty():
        base = base.withColumn("_apart", F.lit(None).cast("long"))
    else:
        apart = (
            rows.select("id", "seed_id")
            .join(several, "id")
            .join(listed.select("seed_id"), "seed_id")
            .join(particles.select("seed_id", F.col("id").alias("_particle")).distinct(), "seed_id")
            .groupBy("id")
            .agg(F.count_distinct("_particle").alias("_apart"))
        )
        base = base.join(apart, "id", "left")

    def at(value: Column) -> Column:
        return F.floor(value.cast("double") / cell)

    def cells(center: str, half: str) -> Column:
        # a little wider than the box, so that rounding cannot lose a cell on its rim
        middle, reach = F.col(center).cast("double"), F.col(half).cast("double") + cell * 1e-3
        return F.explode(F.sequence(at(middle - reach), at(middle + reach)))

    box = clusters.select("id", "seed_id", "eta", "phi", "deta", "dphi")
    boxes = (
        box.withColumn("_i", cells("eta", "deta")).withColumn("_j", cells("phi", "dphi")).alias("c")
    )
    # particles at the very same point are one row with a count
    points = (
        particles.groupBy("seed_id", "eta", "phi")
        .agg(F.count("*").alias("_copies"))
        .withColumns({"_i": at(F.col("eta")), "_j": at(F.col("phi"))})
        .alias("p")
    )
    hit = in_box("p.eta", "p.phi", "c.eta", "c.phi", "c.deta", "c.dphi")
    inside = (
        boxes.join(
            points,
            [F.col(f"c.{k}") == F.col(f"p.{k}") for k in ("seed_id", "_i", "_j")] + [hit],
        )
        .groupBy(F.col("c.seed_id").alias("seed_id"), F.col("c.id").alias("id"))
        .agg(F.sum("_copies").alias("_hits"))
        .join(listed, "seed_id")
        .groupBy("id")
        .agg(F.sum(F.col("_hits") * F.col("_times")).alias("in_cluster"))
    )
    joined = base.join(inside, "id", "left")
    total_et, total_e = F.col("_et") * 1000, F.col("_e") * 1000
    return joined.select(
        F.col("id").alias("cluster_id"),
        "n_clusters",
        "cl_et",
        "cl_e",
        "n_seeds",
        F.coalesce("_apart", "_ids").alias("n_particles"),
        F.coalesce("in_cluster", F.lit(0)).cast("long").alias("in_cluster"),
        total_et.alias("total_tp_et"),
        ratio(total_et, F.col("cl_et")).alias("total_tp_et_cl_et_ratio"),
        total_e.alias("total_tp_energy"),
        ratio(total_e, F.col("cl_e")).alias("total_tp_energy_cl_e_ratio"),
    )
