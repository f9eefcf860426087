"""Explicit Spark schemas and the domain constants the operators share."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> list[T.StructField]:
    """Build fields from ``"a b c:int d:[float]"``; a bare name is a float."""
    kinds = {
        "float": T.FloatType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "bool": T.BooleanType(),
        "[float]": T.ArrayType(T.FloatType()),
        "[long]": T.ArrayType(T.LongType()),
        "[bool]": T.ArrayType(T.BooleanType()),
    }
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        out.append(T.StructField(name, kinds[kind or "float"]))
    return out


def _containers(spec: dict[str, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, T.ArrayType(T.StructType(_fields(f)))) for name, f in spec.items()]
    )


# Container names, field names and types of the nested event format.
# Unsigned 64-bit links and hashes are carried as long: only their equality is used.
EVENT_CONTAINERS = {
    "CaloCellContainer_Cells": "descriptor_link:long deta dphi e et eta phi tau",
    "CaloClusterContainer_Clusters": (
        "cell_links:[long] deta dphi e e0 e1 e2 e233 e237 e277 e2tsts1 e3 ehad1 ehad2 ehad3"
        " emaxs1 emaxs2 eratio et eta etot f0 f1 f2 f3 fracMax lambdaCenter lateralMom"
        " longitudinalMom phi reta rhad rhad1 rphi secondLambda secondR seed_link:int weta2"
    ),
    "CaloDetDescriptorContainer_Cells": (
        "bc_duration bcid_end:int bcid_start:int deta detector:int dphi e edep"
        " edep_per_bunch:[float] eta hash:long phi pulse:[float] sampling:int tau tof:[float] z"
    ),
    "CaloRingsContainer_Rings": "cluster_link:int rings:[float]",
    "ElectronContainer_Electrons": "cluster_link:int e et eta phi isEM:[bool]",
    "EventInfoContainer_Events": "avgmu eventNumber runNumber",
    "SeedContainer_Seeds": "e et eta id:int phi",
    "TruthParticleContainer_Particles": "e et eta pdgid:int phi px py pz seedid:int vx vy vz",
}
EVENT_SCHEMA = _containers(EVENT_CONTAINERS)

# Columns of the flat ntuple.
NTUPLE_SCHEMA = T.StructType(
    _fields(
        "EventNumber:int RunNumber:int avgmu:int cl_eta cl_phi cl_e cl_et cl_deta cl_dphi"
        " cl_e0 cl_e1 cl_e2 cl_e3 cl_ehad1 cl_ehad2 cl_ehad3 cl_etot cl_e233 cl_e237 cl_e277"
        " cl_emaxs1 cl_emaxs2 cl_e2tsts1 cl_reta cl_rphi cl_rhad cl_rhad1 cl_eratio"
        " cl_f0 cl_f1 cl_f2 cl_f3 cl_weta2 cl_rings:[float] cl_secondR cl_lambdaCenter"
        " cl_fracMax cl_lateralMom cl_longitudinalMom el_eta el_et el_phi el_tight:bool"
        " el_medium:bool el_loose:bool el_vloose:bool seed_eta seed_phi mc_pdgid:[float]"
        " mc_eta:[float] mc_phi:[float] mc_e:[float] mc_et:[float]"
    )
)

# Cluster quantities carried into a labelled sample, in table order.
SAMPLE_CLUSTER_FIELDS = (
    "eta phi e et deta dphi e0 e1 e2 e3 ehad1 ehad2 ehad3 etot e233 e237 e277 emaxs1 emaxs2"
    " e2tsts1 reta rphi rhad rhad1 eratio f0 f1 f2 f3 weta2 rings secondR lambdaCenter"
    " fracMax lateralMom"
).split()

# Ring layers as (name, first index, number of rings).
RING_LAYERS = (
    ("PS", 0, 8),
    ("EM1", 8, 64),
    ("EM2", 72, 8),
    ("EM3", 80, 8),
    ("HAD1", 88, 4),
    ("HAD2", 92, 4),
    ("HAD3", 96, 4),
)
N_RINGS = 100
LEGAL_RING_SIZES = (100, 18, 0)

# A row outside the cross-validation study has fold NULL or this value.
NO_FOLD = -1

# Detector and detector-sampling codes of the descriptor cells.
DETECTOR_NAMES = {0: "LAR", 1: "TILE", 2: "TTEM", 3: "TTHEC", 5: "FCALEM", 6: "FCALHAD"}
SAMPLING_NAMES = dict(
    enumerate(
        "PSB PSE EMB1 EMB2 EMB3 TILECAL1 TILECAL2 TILECAL3 TILEEXT1 TILEEXT2 TILEEXT3"
        " EMEC1 EMEC2 EMEC3 HEC1 HEC2 HEC3".split()
    )
)

# Positions in the trigger energy-per-sampling array. This numbering is not the
# one above.
ENERGY_SAMPLE_INDEX = {
    "PreSamplerB": 0,
    "EMB1": 1,
    "EMB2": 2,
    "EMB3": 3,
    "PreSamplerE": 4,
    "EME1": 5,
    "EME2": 6,
    "EME3": 7,
}
