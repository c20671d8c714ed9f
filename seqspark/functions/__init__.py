from .text import capitalise_source, digits, map_symbol, parse_event_time, unmap_symbol
from .time import bucket_of, duration_ticks, from_ticks, ticks

__all__ = [
    "bucket_of",
    "capitalise_source",
    "digits",
    "duration_ticks",
    "from_ticks",
    "map_symbol",
    "parse_event_time",
    "ticks",
    "unmap_symbol",
]
