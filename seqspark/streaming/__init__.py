from .append import stream_sequence_append
from .gate import LatenessGate, stream_gate
from .keyed import stream_match
from .late import stream_dropped
from .snapshots import compact
from .store import correct, current_matches, live_matches, stream_match_batch

__all__ = [
    "LatenessGate", "compact", "correct", "current_matches", "live_matches", "stream_dropped", "stream_gate", "stream_match", "stream_match_batch",
    "stream_sequence_append",
]
