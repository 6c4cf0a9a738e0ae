"""Registered queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from netweave.checks import balance, conform, evaluate, features, models, profile, streams  # noqa: F401
from netweave.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
