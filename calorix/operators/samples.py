"""Labelled samples: projecting clusters, tagging, filtering, casting, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.operators import nested
from calorix.operators.ordering import with_position
from calorix.schemas import SAMPLE_CLUSTER_FIELDS
from calorix.sources.writers import append_by_name


def sample_rows(
    clusters: DataFrame,
    events: DataFrame,
    source_id: int,
    label: int,
    fields: Sequence[str] = SAMPLE_CLUSTER_FIELDS,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Clusters joined to their event and renamed to ``cl_*``, with source and label.

    Only the needed event columns enter the join; the larger side keeps its partitioning when
    the event table is small enough for the planner to broadcast.
    """
    info = events.select(F.col("id").alias("event_id"), "eventNumber", "avgmu")
    return clusters.join(info, "event_id", "inner").select(
        F.lit(source_id).cast("long").alias("source_id"),
        "event_id",
        "eventNumber",
        "avgmu",
        F.col("pos" if "pos" in clusters.columns else "id").alias("cluster_id"),
        *[F.col(c).alias(f"cl_{c}") for c in (*fields, *extra)],
        F.lit(label).cast("byte").alias("label"),
    )


def event_samples(
    events: DataFrame,
    source_id: Column,
    label: Column,
    fields: Sequence[str] = SAMPLE_CLUSTER_FIELDS,
    key: str = "event_id",
) -> DataFrame:
    """Samples straight from nested events: the event's own values go along with its clusters, so
    nothing is joined. ``source_id`` and ``label`` are expressions over the event's columns."""
    info = F.get(nested.INFO, F.lit(0))
    carry = {
        "_source": source_id.cast("long"),
        "_label": label.cast("byte"),
        "eventNumber": info["eventNumber"],
        "avgmu": info["avgmu"],
    }
    return nested.cluster_table(events, key, carry).select(
        F.col("_source").alias("source_id"),
        key,
        "eventNumber",
        "avgmu",
        F.col("pos").alias("cluster_id"),
        *[F.col(c).alias(f"cl_{c}") for c in fields],
        F.col("_label").alias("label"),
    )


def build_samples(
    sources: Sequence[tuple[DataFrame, DataFrame]],
    labels: Sequence[int],
    fields: Sequence[str] = SAMPLE_CLUSTER_FIELDS,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Union of the labelled samples of several (clusters, events) inputs, matched by name."""
    if len(sources) != len(labels):
        raise ValueError(f"{len(sources)} sources but {len(labels)} labels")
    parts = [
        sample_rows(clusters, events, i, label, fields, extra)
        for i, ((clusters, events), label) in enumerate(zip(sources, labels), start=1)
    ]
    return append_by_name(*parts)


def tag_and_filter(
    df: DataFrame,
    label: int,
    order: Sequence[str],
    query: str | None = None,
    id_offset: int = 0,
) -> DataFrame:
    """Number and label all rows, then filter: the ids of dropped rows stay unused."""
    tagged = with_position(df, order, "id", id_offset).withColumn("label", F.lit(label))
    return tagged.where(F.expr(query)) if query else tagged


def cast_features(
    df: DataFrame,
    feature_cols: Sequence[str],
    label_cols: Sequence[str] = ("label",),
    feature_type: str = "float",
    label_type: str = "long",
    ids: DataFrame | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Typed feature array and labels, optionally only for the ids of another frame."""
    if ids is not None:
        df = df.join(ids.select(id_col), id_col, "left_semi")
    keep = [id_col] if id_col in df.columns else []
    features = F.array(*[F.col(c).cast(feature_type) for c in feature_cols])
    return df.select(
        *keep,
        features.alias("features"),
        *[F.col(c).cast(label_type).alias(c) for c in label_cols],
    )


def write_back(df: DataFrame, updates: DataFrame, id_col: str, column: str) -> DataFrame:
    """Set ``column`` from a frame keyed by id; rows without an update get NULL."""
    base = df.drop(column) if column in df.columns else df
    return base.join(updates.select(id_col, column), id_col, "left")


def unmatched_keys(child: DataFrame, parent: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Count child rows whose key is missing in the parent."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(on.values())])
    same = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(on)]
    return child.join(keys, same, "left_anti").agg(
        F.lit(name).alias("check"), F.count("*").alias("n_violations")
    )


def size_violations(df: DataFrame, container: str, expected: int = 1) -> DataFrame:
    """Rows whose container does not hold exactly the expected number of entries."""
    return df.where(F.coalesce(F.size(container), F.lit(-1)) != expected)


def paired(
    left: DataFrame, right: DataFrame, id_col: str, suffix: str, columns: Sequence[str]
) -> DataFrame:
    """Join two prediction sets on id; the right one's columns get a suffix."""
    renamed = right.select(id_col, *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return left.select(id_col, *columns).join(renamed, id_col, "inner")


def pairing_counts(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Rows on both sides, on the left only and on the right only, in one full join."""
    sides = left.select(id_col, F.lit(True).alias("_l")).join(
        right.select(id_col, F.lit(True).alias("_r")), id_col, "full_outer"
    )
    has_left, has_right = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return sides.agg(
        F.count_if(has_left & has_right).alias("n_both"),
        F.count_if(has_left & ~has_right).alias("n_left_only"),
        F.count_if(~has_left & has_right).alias("n_right_only"),
    )


def require_complete_pairing(left: DataFrame, right: DataFrame, id_col: str) -> None:
    counts = pairing_counts(left, right, id_col).first()
    if counts["n_left_only"] or counts["n_right_only"]:
        raise RuntimeError("Joined predictions length mismatch")


def validity_counts(df: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """How many values are inside ``(low, high)``, at or above, at or below, or missing."""
    return df.select(value.alias("_v")).agg(
        F.count("*").alias("n_samples"),
        F.count_if((F.col("_v") > low) & (F.col("_v") < high)).alias("n_valid"),
        F.count_if(F.col("_v") >= high).alias("n_over"),
        F.count_if(F.col("_v") <= low).alias("n_under"),
        F.count_if(F.col("_v").isNull()).alias("n_null"),
    )
