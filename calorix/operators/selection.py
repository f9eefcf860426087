"""Rule-based selection: a chain of cuts with thresholds looked up by energy and |eta|."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.functions import physics as ph
from calorix.sources.cutmaps import KEYS, CutMap
from calorix.sources.readers import read_inputs

PASSED = ""


@dataclass(frozen=True)
class TriggerColumns:
    """Names of the input columns."""

    l1_eta: str = "trig_L1_eta"
    l1_phi: str = "trig_L1_phi"
    eta: str = "trig_L2_calo_eta"
    phi: str = "trig_L2_calo_phi"
    et: str = "trig_L2_calo_et"
    e237: str = "trig_L2_calo_e237"
    e277: str = "trig_L2_calo_e277"
    emaxs1: str = "trig_L2_calo_emaxs1"
    e2tsts1: str = "trig_L2_calo_e2tsts1"
    weta2: str = "trig_L2_calo_weta2"
    wstot: str = "trig_L2_calo_wstot"
    energy_sample: str = "trig_L2_calo_energySample"
    l1_eta_max: float = 2.5


def _axis_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the closed-left interval that holds the value, NULL outside the edges."""
    inside = (value >= edges[0]) & (value < edges[-1])
    out = F.lit(0)
    for i, edge in enumerate(edges[1:-1], start=1):
        out = F.when(value >= edge, i).otherwise(out)
    return F.when(inside & ~F.isnan(value), out)


def grid_cell(
    et: Column, abs_eta: Column, et_edges: Sequence[float], eta_edges: Sequence[float]
) -> Column:
    """Cell number on a grid given by its edges, et bins outermost."""
    return _axis_bin(et, et_edges) * (len(eta_edges) - 1) + _axis_bin(abs_eta, eta_edges)


def box_index(boxes: Sequence[dict[str, float]], et: Column, abs_eta: Column) -> Column:
    """Number of the (et, |eta|) box that holds a row, as a plain expression.

    The usual set of boxes is a full grid, so each axis is binned on its own; any other set is
    tested box by box. No join is needed: a map is a few dozen rows.
    """
    ets = sorted({(r["et_min"], r["et_max"]) for r in boxes})
    etas = sorted({(r["eta_min"], r["eta_max"]) for r in boxes})
    corners = [(r["et_min"], r["et_max"], r["eta_min"], r["eta_max"]) for r in boxes]
    adjoining = all(a[1] == b[0] for axis in (ets, etas) for a, b in zip(axis, axis[1:]))
    if adjoining and corners == [(*e, *h) for e in ets for h in etas]:
        et_edges = [ets[0][0], *[b for _, b in ets]]
        eta_edges = [etas[0][0], *[b for _, b in etas]]
        return grid_cell(et, abs_eta, et_edges, eta_edges)
    out = F.when(F.lit(False), F.lit(0))
    for i, (et_min, et_max, eta_min, eta_max) in enumerate(corners):
        hit = (et >= et_min) & (et < et_max) & (abs_eta >= eta_min) & (abs_eta < eta_max)
        out = out.when(hit, i)
    return out


def cell_index(cut_map: CutMap, et: Column, abs_eta: Column) -> Column:
    """Row number of the map that covers (et, |eta|)."""
    return box_index(cut_map.rows, et, abs_eta)


def _pick(values: Sequence[float], index: Column) -> Column:
    """Value at an index; one literal when all values agree."""
    if len(set(values)) == 1:
        return F.lit(float(values[0]))
    return F.get(F.array(*[F.lit(float(v)) for v in values]), index)


def threshold(cut_map: CutMap, name: str, cell: Column) -> Column:
    """Threshold of a cell."""
    return _pick([cut_map.threshold(r, name) for r in cut_map.rows], cell)


def with_shapes(df: DataFrame, columns: TriggerColumns = TriggerColumns()) -> DataFrame:
    """Add the quantities the cuts look at, computed once for however many maps follow."""
    c = {
        k: F.col(v).cast("double")
        for k, v in vars(columns).items()
        if isinstance(v, str) and k != "energy_sample"
    }
    abs_eta = F.abs(c["eta"])
    return df.withColumns(
        {
            "_l1_eta": F.abs(c["l1_eta"]),
            "_deta": F.abs(c["eta"] - c["l1_eta"]),
            "_dphi": ph.trigger_delta_phi(c["l1_phi"], c["phi"]),
            "_abs_eta": abs_eta,
            "_rcore": ph.core_ratio(c["e237"], c["e277"]),
            "_eratio": ph.peak_ratio(c["emaxs1"], c["e2tsts1"]),
            "_f1": ph.first_layer_fraction(columns.energy_sample),
            "_crack": ph.in_crack(abs_eta),
            "_et": c["et"],
            "_had_et": ph.hadronic_et(c["et"], c["e277"], abs_eta),
            "_weta2": c["weta2"],
            "_wstot": c["wstot"],
            "_f3": ph.third_layer_fraction(columns.energy_sample),
        }
    )


def cut_reason(cut_map: CutMap, cell: Column, l1_eta_max: float = 2.5) -> Column:
    """Name of the first cut that fails, or an empty text, over :func:`with_shapes` columns.

    A missing or NaN shape fails no cut; a row whose energy or direction lies in no bin has no
    thresholds and counts as outside the |eta| range.
    """

    def thr(name: str) -> Column:
        return threshold(cut_map, name, cell)

    def above(name: str, limit: Column) -> Column:
        return ph.greater(F.col(name), limit)

    had_thr = F.when(above("_et", thr("et2")), thr("had_et")).otherwise(thr("had_et2"))
    shape_ok = ~F.col("_crack") & ~(F.col("_f1") < thr("f1"))
    chain = [
        (above("_l1_eta", F.lit(l1_eta_max)), "invalid_l1_eta"),
        (above("_deta", F.lit(cut_map.deta)), "deta_too_big"),
        (above("_dphi", F.lit(cut_map.dphi)), "dphi_too_big"),
        (above("_abs_eta", F.lit(cut_map.max_abs_eta)) | cell.isNull(), "invalid_l2_eta"),
        (F.col("_rcore") < thr("rcore"), "rcore_too_small"),
        (shape_ok & (F.col("_eratio") < thr("eratio")), "eratio_too_small"),
        (F.col("_et") * 1e-3 < thr("et"), "et_too_small"),
        (above("_had_et", had_thr), "had_et_too_big"),
        (above("_weta2", thr("weta2")), "weta2_too_big"),
        ((F.col("_wstot") >= thr("wstot")) & ~F.isnan("_wstot"), "wstot_too_big"),
        (above("_f3", thr("f3")), "f3_too_big"),
    ]
    out = F.when(chain[0][0], chain[0][1])
    for failed, reason in chain[1:]:
        out = out.when(failed, reason)
    return out.otherwise(PASSED)


def select_with_cuts(
    df: DataFrame,
    models: dict[str, CutMap],
    columns: TriggerColumns = TriggerColumns(),
    return_reason: bool = False,
    keep_input: bool = False,
    keep: Sequence[str] = (),
    et_scale: float = 1.0,
    name: str = "cutbased",
) -> DataFrame:
    """Classify rows with several cut maps in one scan: ``{model}_{name}[_reason]`` columns.

    ``et_scale`` converts the energy before the bin lookup, for maps whose edges are in another
    unit. Maps with the same bins share one lookup.
    """
    base = df.columns if keep_input else list(keep)
    grids: dict[tuple, str] = {}
    cell_of = {}
    for m, cut_map in models.items():
        corners = tuple(tuple(r[k] for k in KEYS) for r in cut_map.rows)
        cell_of[m] = grids.setdefault(corners, f"_cell{len(grids)}")
    shaped = with_shapes(df, columns)
    cells = {
        cell_of[m]: cell_index(cut_map, F.col("_et") * et_scale, F.col("_abs_eta"))
        for m, cut_map in models.items()
    }
    placed = shaped.withColumns(cells)
    reasons = {
        f"{m}_{name}_reason": cut_reason(cut_map, F.col(cell_of[m]), columns.l1_eta_max)
        for m, cut_map in models.items()
    }
    tagged = placed.select(*base, *[r.alias(c) for c, r in reasons.items()])
    out = []
    for m in models:
        reason = f"{m}_{name}_reason"
        out.append((F.col(reason) == PASSED).cast("int").alias(f"{m}_{name}"))
        if return_reason:
            out.append(F.col(reason))
    return tagged.select(*base, *out)


def predict_files(
    spark: SparkSession,
    paths,
    out: str,
    models: dict[str, CutMap],
    columns: TriggerColumns = TriggerColumns(),
    return_reason: bool = False,
    concat: bool = False,
    dev: bool = False,
) -> None:
    """Classify all input files in one job and write the result with each row's input file.

    ``concat`` keeps the input columns beside the new ones.
    """
    rows = read_inputs(spark, paths, dev=dev).withColumn("input_file", F.input_file_name())
    keep = rows.columns if concat else ["input_file"]
    select_with_cuts(rows, models, columns, return_reason, keep=keep).write.parquet(out)


def committee_decision(
    df: DataFrame,
    members: Sequence[dict[str, float]],
    score: str,
    et: str,
    abs_eta: str,
    pileup: str,
) -> DataFrame:
    """Member number and decision ``score > slope * min(pileup, cap) + offset`` per row.

    A member is a box in (et, |eta|) with ``slope``, ``offset`` and ``max_average_mu``; rows
    outside every box get NULL.
    """
    placed = df.withColumn("member", box_index(members, F.col(et), F.col(abs_eta)))

    def own(name: str) -> Column:
        return _pick([float(m[name]) for m in members], F.col("member"))

    limit = own("slope") * F.least(F.col(pileup), own("max_average_mu")) + own("offset")
    limited = placed.withColumn("score_threshold", F.when(F.col("member").isNotNull(), limit))
    return limited.withColumn("accepted", F.col(score) > F.col("score_threshold"))
