"""Cut maps: thresholds per (transverse energy, |eta|) bin, built in or read from CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from calorix.session import collect_bounded

KEYS = ("et_min", "et_max", "eta_min", "eta_max")
REQUIRED = (*KEYS, "had_et", "eratio", "rcore")
# Thresholds a map may leave out.
DEFAULTS = {
    "eratio": 999.0,
    "et": 0.0,
    "et2": 90000.0,
    "f1": 0.005,
    "f3": 99999.0,
    "had_et": 999.0,
    "had_et2": 999.0,
    "weta2": 99999.0,
    "wstot": 99999.0,
}

# Bin edges shared by the built-in maps.
ET_EDGES = (-1e9, 12.0, 22.0, 1e9)
ETA_EDGES = (0.0, 0.6, 0.8, 1.15, 1.37, 1.52, 1.81, 2.01, 2.37, 2.47)

# had_et, eratio, rcore of each bin; et bins outermost, then |eta| bins.
LOOSE = """
0.2337 0.48 0.6806      0.2097 0.448 0.671      0.1392 0.1295 0.6306
0.1872 0.0137 0.6619    0.1255 -9999.0 0.4704   0.3234 0.0122 0.7094
0.384 0.512 0.7012      0.1901 0.6073 0.6977    0.1901 -9999.0 0.696
0.08472 0.5702 0.6806   0.05928 0.6063 0.671    0.054 0.4418 0.6306
0.0803 0.4257 0.6619    0.0829 -9999.0 0.4704   0.1932 0.3408 0.6616
0.159 0.5836 0.7012     0.1384 0.68 0.6977      0.1384 -999.0 0.696
0.0588 -999.0 0.7112    0.0564 -999.0 0.6968    0.054 -999.0 0.6952
0.048 -999.0 0.6864     0.0297 -999.0 0.5976    0.06 -999.0 0.6616
0.06 -999.0 0.704       0.06 -999.0 0.7008      0.054 -999.0 0.696
"""
VLOOSE = """
0.2337 0.48 0.448       0.20976 0.448 0.48      0.1392 0.1295 0.5414
0.1872 0.0137 0.576     0.1315 -9999.0 0.352    0.3234 0.0122 0.608
0.384 0.512 0.576       0.1901 0.6073 0.608     0.1901 -9999.0 0.55
0.0871 0.5702 0.6646    0.0617 0.6063 0.659     0.0564 0.4418 0.6226
0.0827 0.4257 0.6539    0.0889 -9999.0 0.4704   0.2052 0.3408 0.6536
0.1674 0.5836 0.6972    0.1481 0.68 0.6817      0.1481 -999.0 0.672
0.0612 -999.0 0.6912    0.0588 -999.0 0.6808    0.0564 -999.0 0.6832
0.0504 -999.0 0.6744    0.0357 -999.0 0.5976    0.072 -999.0 0.6416
0.0684 -999.0 0.692     0.0696 -999.0 0.6848    0.0636 -999.0 0.68
"""
MEDIUM = """
0.1872 0.48 0.448       0.1824 0.448 0.48       0.1392 0.288 0.544
0.1872 0.192 0.576      0.08196 -9999.0 0.352   0.2497 0.0176 0.608
0.384 0.512 0.576       0.19008 0.608 0.608     0.19008 -9999.0 0.598
0.0588 0.636 0.69896    0.0564 0.6064 0.68416   0.054 0.5552 0.64368
0.048 0.476 0.68488     0.06384 -9999.0 0.4704  0.17868 0.5536 0.6816
0.1284 0.664 0.704      0.07536 0.68 0.6992     0.07536 -9999.0 0.6992
0.0588 0.656 0.716      0.0564 0.66 0.712       0.054 0.6 0.6952
0.048 0.604 0.692       0.02376 -9999.0 0.5976  0.06 0.624 0.6816
0.06 0.664 0.7168       0.06 0.692 0.7128       0.054 -9999.0 0.716
"""
TIGHT = """
0.1872 0.48 0.448       0.1824 0.448 0.48       0.1392 0.288 0.544
0.1872 0.192 0.576      0.06864 -9999.0 0.352   0.24972 0.256 0.608
0.31368 0.512 0.576     0.1872 0.608 0.608      0.168 -9999.0 0.598
0.0588 0.636 0.71296    0.0564 0.652 0.69344    0.054 0.5552 0.64368
0.048 0.4768 0.69064    0.04368 -9999.0 0.4704  0.15612 0.6056 0.7036
0.11064 0.6696 0.73024  0.07536 0.7128 0.7164   0.07536 -9999.0 0.7164
0.0588 0.72 0.7288      0.0564 0.712 0.7296     0.054 0.68 0.72
0.048 0.672 0.7048      0.02376 -9999.0 0.6     0.06 0.68 0.7128
0.06 0.716 0.7312       0.06 0.74 0.7256        0.054 -9999.0 0.7192
"""
_TABLES = {"loose": LOOSE, "vloose": VLOOSE, "medium": MEDIUM, "tight": TIGHT}
PID_NAMES = (
    "vloose", "loose", "lhvloose", "lhloose", "medium", "lhmedium", "tight", "lhtight",
    "mergedtight",
)


@dataclass(frozen=True)
class CutMap:
    """Threshold rows of one identification name, with the two trigger-match tolerances."""

    rows: tuple[dict[str, float], ...]
    deta: float = 0.1
    dphi: float = 0.1

    def __post_init__(self):
        if self.deta < 0 or self.dphi < 0:
            raise ValueError("deta and dphi must not be negative")
        for row in self.rows:
            for name, value in row.items():
                if value is None or value != value:
                    raise ValueError(f"cut map column {name} has an empty value")
            missing = [c for c in REQUIRED if c not in row]
            if missing:
                raise ValueError(f"cut map lacks {', '.join(missing)}")

    @property
    def max_abs_eta(self) -> float:
        return max(r["eta_max"] for r in self.rows)

    def threshold(self, row: dict[str, float], name: str) -> float:
        return row.get(name, DEFAULTS.get(name))


def builtin_cut_map(name: str, deta: float = 0.1, dphi: float = 0.1) -> CutMap:
    """A named map. The likelihood names share the plain maps; ``mergedtight`` keeps only the
    hadronic thresholds of ``tight``."""
    if name not in PID_NAMES:
        raise ValueError(f"unknown cut map: {name}")
    merged = name == "mergedtight"
    base = "tight" if merged else name.removeprefix("lh")
    values = [float(x) for x in _TABLES[base].split()]
    rows = []
    for i, (et_min, et_max) in enumerate(zip(ET_EDGES, ET_EDGES[1:])):
        for j, (eta_min, eta_max) in enumerate(zip(ETA_EDGES, ETA_EDGES[1:])):
            at = 3 * (i * (len(ETA_EDGES) - 1) + j)
            had_et, eratio, rcore = values[at : at + 3]
            if merged:
                eratio = rcore = -9999.0
            cell = (et_min, et_max, eta_min, eta_max, had_et, eratio, rcore)
            rows.append(dict(zip(REQUIRED, cell)))
    return CutMap(tuple(rows), deta, dphi)


def read_cut_map(spark: SparkSession, path: str, deta: float = 0.1, dphi: float = 0.1) -> CutMap:
    """Read a map from CSV; a map is a few dozen rows and becomes part of the expression."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    rows = collect_bounded(df, 1000, "cut map rows")
    return CutMap(tuple(r.asDict() for r in rows), deta, dphi)
