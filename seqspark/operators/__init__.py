from .corrections import apply_changelog, diff_matches, expire_events, expire_matches, invalidate
from .counting import count_matches
from .lateness import (
    adaptive_threshold,
    affected_ends,
    affected_range,
    classify_lateness,
    discard_too_late,
    lateness_score,
    observed_intervals,
    rematch,
    running_max_ts,
    watermark_delay,
)
from .lifetimes import match_lifetimes, match_provenance, match_status, portion_changelog
from .match import (
    format_matches,
    idle_events,
    match,
    match_at_end,
    match_many,
    negated_matches,
    participating_events,
    route_to_queries,
)
from .perturb import inject_delay, inject_disorder, inject_duplicates
from .quality import accuracy_under_disorder, changelog_accuracy
from .sizing import fit_to_data
from .sets import (
    compare_matches,
    dedup_events,
    distinct_matches,
    first_last_in_window,
    first_last_per_end,
    sort_by_event_time,
    sort_by_ingestion,
)
from .stats import (
    event_stats,
    global_stats,
    latency_stats,
    match_aggregates,
    match_stats,
    slide_stats,
    stats_rollup,
)
