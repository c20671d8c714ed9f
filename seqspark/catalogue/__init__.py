"""Ready-made queries over the test tables, each next to the SQL it must agree with."""

from . import events, late, lifetimes, matching, messages, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
