"""Ordered event patterns on Spark tables and streams."""

from .functions import *  # noqa: F403
from .operators import *  # noqa: F403
from .plans import next_event, prev_event, window_join
from .plans.base import relevant_events
from .sources import *  # noqa: F403
from .spec import PatternSpec, Step, same_attribute
from .streaming import *  # noqa: F403

__all__ = [
    "PatternSpec", "Step", "next_event", "prev_event", "relevant_events", "same_attribute", "window_join",
    *[n for n in dir() if not n.startswith("_")],
]
