from .base import prepare
from .chain import next_chain
from .joins import window_join
from .scans import next_event, prev_event, running

__all__ = ["next_chain", "next_event", "prepare", "prev_event", "running", "window_join"]
