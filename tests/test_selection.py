"""Cut chain: every reason, every edge case of the inputs."""

import math

import pytest

from calorix.operators import selection as se
from calorix.sources.cutmaps import PID_NAMES, CutMap, builtin_cut_map, read_cut_map
from tests.conftest import rows

COLUMNS = [v for k, v in vars(se.TriggerColumns()).items() if isinstance(v, str)]
GOOD = {
    "trig_L1_eta": 0.3,
    "trig_L1_phi": 1.0,
    "trig_L2_calo_eta": 0.3,
    "trig_L2_calo_phi": 1.0,
    "trig_L2_calo_et": 30.0,
    "trig_L2_calo_e237": 29.0,
    "trig_L2_calo_e277": 30.0,
    "trig_L2_calo_emaxs1": 10.0,
    "trig_L2_calo_e2tsts1": 0.1,
    "trig_L2_calo_weta2": 0.01,
    "trig_L2_calo_wstot": 1.0,
    "trig_L2_calo_energySample": [1.0] * 24,
}
NAN = float("nan")


def reason(spark, cut_map=None, **change):
    values = {**GOOD, **{f"trig_{k}": v for k, v in change.items()}}
    schema = ", ".join(
        f"{c} {'array<double>' if c.endswith('energySample') else 'double'}" for c in COLUMNS
    )
    df = spark.createDataFrame([tuple(values[c] for c in COLUMNS)], schema)
    out = se.select_with_cuts(df, {"m": cut_map or builtin_cut_map("loose")}, return_reason=True)
    label, text = out.first()
    assert label == (1 if text == "" else 0)
    return text


CASES = [
    ({}, ""),
    ({"L1_eta": 2.6, "L2_calo_eta": 2.6}, "invalid_l1_eta"),
    ({"L1_eta": 0.45}, "deta_too_big"),
    ({"L1_phi": 1.2}, "dphi_too_big"),
    ({"L1_phi": 2 * math.pi - 0.02, "L2_calo_phi": -0.01}, ""),
    ({"L1_phi": 3.13, "L2_calo_phi": -3.13}, ""),
    ({"L1_eta": 2.48, "L2_calo_eta": 2.48}, "invalid_l2_eta"),
    ({"L1_eta": 2.47, "L2_calo_eta": 2.47}, "invalid_l2_eta"),
    ({"L2_calo_e237": 15.0}, "rcore_too_small"),
    ({"L2_calo_e277": 0.0}, "rcore_too_small"),
    ({"L2_calo_et": 15.0, "L2_calo_e277": 15.0, "L2_calo_e237": 14.0, "L2_calo_e2tsts1": 5.0},
     "eratio_too_small"),
    ({"L2_calo_et": 15.0, "L2_calo_e277": 15.0, "L2_calo_e237": 14.0, "L2_calo_emaxs1": 1.0,
      "L2_calo_e2tsts1": -1.0}, "eratio_too_small"),
    # no first-sampling energy, or the crack: the contrast of the peaks is not tested
    ({"L2_calo_et": 15.0, "L2_calo_e277": 15.0, "L2_calo_e237": 14.0, "L2_calo_e2tsts1": 5.0,
      "L2_calo_energySample": [0.0] * 24}, ""),
    ({"L1_eta": 1.4, "L2_calo_eta": 1.4, "L2_calo_et": 15.0, "L2_calo_e277": 15.0,
      "L2_calo_e237": 14.0, "L2_calo_e2tsts1": 5.0}, ""),
    ({"L2_calo_et": 5000.0}, "had_et_too_big"),
    ({"L2_calo_weta2": 1e6}, "weta2_too_big"),
    ({"L2_calo_wstot": 99999.0}, "wstot_too_big"),
    ({"L2_calo_weta2": 99999.0}, ""),
    # a missing shape fails no cut
    ({"L2_calo_weta2": NAN, "L2_calo_wstot": NAN, "L2_calo_e2tsts1": NAN}, ""),
    ({"L2_calo_e237": NAN}, ""),
    ({"L1_phi": NAN}, ""),
    ({"L2_calo_weta2": None}, ""),
]


@pytest.mark.parametrize("change,expected", CASES)
def test_reasons(spark, change, expected):
    assert reason(spark, **change) == expected


def test_optional_thresholds(spark):
    strict = CutMap(tuple({**r, "et": 1.0, "f3": 0.1} for r in builtin_cut_map("loose").rows))
    assert reason(spark, strict) == "et_too_small"
    f3 = CutMap(tuple({**r, "f3": 0.1} for r in builtin_cut_map("loose").rows))
    assert reason(spark, f3) == "f3_too_big"


def test_high_energy_uses_its_own_hadronic_threshold(spark):
    rows_ = tuple({**r, "et2": 20.0, "had_et": -1.0} for r in builtin_cut_map("loose").rows)
    assert reason(spark, CutMap(rows_)) == "had_et_too_big"


def test_boxes_that_are_no_grid(spark):
    rows_ = tuple(r for i, r in enumerate(builtin_cut_map("loose").rows) if i != 5)
    assert reason(spark, CutMap(rows_)) == ""
    assert reason(spark, CutMap(rows_), L2_calo_et=5.0, L1_eta=1.6, L2_calo_eta=1.6) == (
        "invalid_l2_eta"
    )


def test_several_models_beside_the_input(spark):
    schema = ", ".join(
        f"{c} {'array<double>' if c.endswith('energySample') else 'double'}" for c in COLUMNS
    )
    df = spark.createDataFrame([tuple(GOOD[c] for c in COLUMNS)], schema)
    maps = {n: builtin_cut_map(n) for n in PID_NAMES}
    out = se.select_with_cuts(df, maps, keep_input=True)
    assert out.columns == COLUMNS + [f"{n}_cutbased" for n in PID_NAMES]


def test_map_checks(spark, tmp_path):
    with pytest.raises(ValueError):
        builtin_cut_map("unknown")
    with pytest.raises(ValueError):
        CutMap(({"et_min": 0.0},))
    path = tmp_path / "map.csv"
    path.write_text("et_min,et_max,eta_min,eta_max,had_et,eratio,rcore\n0,10,0,1,1,0.5,0.5\n")
    assert read_cut_map(spark, str(path)).rows[0]["eratio"] == 0.5
    path.write_text("et_min,et_max,eta_min,eta_max,had_et,eratio,rcore\n0,10,0,1,1,,0.5\n")
    with pytest.raises(ValueError):
        read_cut_map(spark, str(path))


def test_names_share_maps():
    assert builtin_cut_map("lhtight") == builtin_cut_map("tight")
    merged = builtin_cut_map("mergedtight").rows
    assert [r["had_et"] for r in merged] == [r["had_et"] for r in builtin_cut_map("tight").rows]
    assert {r["rcore"] for r in merged} == {-9999.0}


def test_committee(spark):
    members = [
        {"et_min": 0.0, "et_max": 10.0, "eta_min": 0.0, "eta_max": 1.0, "slope": 0.1,
         "offset": 0.0, "max_average_mu": 5.0},
        {"et_min": 10.0, "et_max": 20.0, "eta_min": 0.0, "eta_max": 1.0, "slope": 0.0,
         "offset": 2.0, "max_average_mu": 5.0},
    ]
    data = [(0.55, 1.0, 0.5, 100.0), (0.5, 1.0, 0.5, 5.0), (2.1, 10.0, 0.5, 0.0), (9.0, 30.0, 0.5, 0.0)]
    df = spark.createDataFrame(data, "s double, et double, eta double, mu double")
    out = se.committee_decision(df, members, "s", "et", "eta", "mu")
    assert rows(out.select("s", "member", "accepted")) == [
        (0.5, 0, False), (0.55, 0, True), (2.1, 1, True), (9.0, None, None),
    ]
