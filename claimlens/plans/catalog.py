"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from claimlens.plans import (  # noqa: F401
    evaluation, experiment, features, ingest, scoring, serving, training)
from claimlens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
