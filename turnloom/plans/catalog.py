"""All queries of the library's own operators, by name."""

from . import live, manifests, sampling, signals, timeline  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
