from .files import (
    read_check_events,
    read_json_events,
    read_ohlcv_events,
    read_stock_events,
)
from .kafka import kafka_options, number_arrivals, read_kafka_events, replay_range, with_topic, write_kafka
from .messages import (
    MESSAGE_KINDS,
    normalise,
    normalise_abc,
    normalise_fitbit,
    normalise_location,
    normalise_scale,
    quarantine,
    until_sentinel,
)
from .sinks import write_changelog, write_matches
from .tables import EventSource, source_table

__all__ = [
    "MESSAGE_KINDS",
    "EventSource",
    "kafka_options",
    "normalise",
    "normalise_abc",
    "normalise_fitbit",
    "normalise_location",
    "normalise_scale",
    "number_arrivals",
    "quarantine",
    "read_check_events",
    "read_json_events",
    "read_kafka_events",
    "read_ohlcv_events",
    "read_stock_events",
    "replay_range",
    "source_table",
    "until_sentinel",
    "with_topic",
    "write_changelog",
    "write_kafka",
    "write_matches",
]
