"""Registered queries; importing this package fills the registry."""

from calorix.plans import (
    clustering,
    evaluation,
    events,
    ingest,
    layouts,
    models,
    profiles,
    samples,
    streams,
)
from calorix.plans.base import REGISTRY

__all__ = [
    "REGISTRY",
    "clustering",
    "evaluation",
    "events",
    "ingest",
    "layouts",
    "models",
    "profiles",
    "samples",
    "streams",
]
