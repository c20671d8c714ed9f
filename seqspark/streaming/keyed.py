"""Continuous matching with keyed state.

State is kept per (slot, time bucket), where a slot holds the keys of one hash value: an event
goes to its own bucket and the next one, an end only counts in its own.  A group therefore holds
two windows of events of its keys at most, also for a very busy key or none at all, and is dropped
once the watermark has passed it.  Calls and state accesses follow the slots, not the keys.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import bucket_of
from ..plans.base import as_column
from ..spec import PatternSpec, micros

if TYPE_CHECKING:
    import pandas as pd

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def end_matches(events, end, steps, within, policy):
    """Matches of one end among the events of its window, as tuples of ids.

    ``events`` are (t, id, flags) in time order, ``steps`` is a list of "is one-or-more".
    """
    last = len(steps) - 1
    inside = [e for e in events if end[0] - within <= e[0] < end[0]]
    of = [[e for e in inside if e[2][i]] for i in range(last + 1)]
    if not all(of[:last]):
        return

    # Of several ends at one time the lowest id is the next one.
    ends = of[last] + [e for e in events if e[0] == end[0] and e[1] <= end[1] and e[2][last]]

    def after(i, t):
        return next((e for e in (ends if i == last else of[i]) if e[0] > t), None)

    if policy == "next":
        for a in of[0]:
            run = [a]
            for i in range(1, last + 1):
                hop = after(i, run[-1][0]) if run else None
                run = [*run, hop] if hop else []
            if run and run[-1][1] == end[1]:
                sets = [
                    [e for e in of[i] if run[i - 1][0] < e[0] < end[0]] if many else [run[i]]
                    for i, many in enumerate(steps)
                ]
                yield tuple(e[1] for s in sets for e in s)
        return

    def left(i, head, floor, tail):
        if i < 0:
            yield tail
            return
        mine = [e for e in of[i] if e[0] < head and (floor is None or e[0] >= floor)]
        if not steps[i]:
            for e in mine:
                yield from left(i - 1, e[0], None, (e[1], *tail))
            return
        mine = [e for e in of[i] if e[0] < head]
        for j, e in enumerate(mine):
            prior = mine[j - 1][0] if j else None
            if i == 0 and j:
                break
            if i and not any(x[0] < e[0] and (prior is None or x[0] >= prior) for x in of[i - 1]):
                continue
            yield from left(i - 1, e[0], prior, (*[x[1] for x in mine[j:]], *tail))

    yield from left(last - 1, end[0], None, (end[1],))


STATE = "keys array<string>, t array<long>, id array<long>, own array<boolean>, flags array<long>"


class KeyedMatcher(StatefulProcessor):
    """Keeps the events of a group, one state row per micro-batch, and reports what new ones change.

    What was reported before follows from the events kept, so it is not kept itself.
    """

    def __init__(self, steps, within, policy, out_schema, with_correction, width, grace):
        self.steps, self.within, self.policy = steps, within, policy
        self.columns = out_schema.names
        self.with_correction, self.width, self.grace = with_correction, width, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", STATE)
        # which steps the bits of an event's flags name
        self.bits = [tuple(bool(m >> i & 1) for i in range(len(self.steps))) for m in range(1 << len(self.steps))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, fresh = defaultdict(dict), defaultdict(dict)
        come = [r for pdf in rows for r in zip(*[pdf[c].tolist() for c in ("key", "tick", "eid", "own", "flags")])]
        met = {r[0] for r in come}
        begun = False
        for kept in self.events.get():
            begun = True
            for k, t, i, own, flags in zip(*kept):
                if k in met:
                    held[k][t, i] = (own, flags)
        for k, t, i, own, flags in come:
            event = (int(t), int(i))
            if event not in held[k] and event not in fresh[k]:
                fresh[k][event] = (bool(own), int(flags))
        new = [(k, *event, *what) for k, events in fresh.items() for event, what in events.items()]
        if not new:
            return
        self.events.appendValue(tuple(map(list, zip(*new))))
        if not begun:
            self.handle.registerTimer((int(key[-1]) + 1) * self.width // 1000 + self.grace)
        out = [row for k, events in fresh.items() if events for row in self.corrected(k, held[k], events)]
        if out:
            import pandas as pd

            yield pd.DataFrame(out, columns=self.columns)

    def corrected(self, key, held, fresh):
        """The changes of one key's matches when ``fresh`` events join the ``held`` ones."""
        known, last = held | fresh, 1 << len(self.steps) - 1
        ends = sorted(e for e, (own, flags) in known.items() if own and flags & last)
        come = sorted(t for t, _ in fresh)
        # only ends with a fresh event in their window can change
        ends = [e for e in ends if (near := bisect_right(come, e[0])) and come[near - 1] >= e[0] - self.within]
        if not ends:
            return
        before, after = self.ordered(held), self.ordered(known)
        times = None
        for t, i in ends:
            end = (t, i, self.bits[known[t, i][1]])
            old, new = self.matches(before, end) if (t, i) in held else set(), self.matches(after, end)
            if old == new:
                continue
            times = times or {i: t for t, i in known}
            texts = [{",".join(map(str, m)) for m in found} for found in (old, new)]
            for kind, ids, was in self.changes(*texts, i):
                ev = [int(x) for x in ids.split(",")]
                yield [key, kind, times[ev[0]], times[ev[-1]], ev[-1], ev,
                       [int(x) for x in was.split(",")] if was is not None else None]

    def ordered(self, events):
        return sorted((t, i, self.bits[flags]) for (t, i), (_, flags) in events.items())

    def matches(self, events, end):
        """The ids of an end's matches; only its window of the sorted events is looked at."""
        lo, hi = (end[0] - self.within,), (end[0] + 1,)
        window = events[bisect_left(events, lo):bisect_left(events, hi)]
        return set(end_matches(window, end, self.steps, self.within, self.policy))

    def changes(self, old, new, end):
        """Updates, inserts and deletes for one end; an update contains what it replaces."""
        gone, come = sorted(old - new), sorted(new - old, key=lambda m: (m.count(","), m))
        if not self.with_correction:
            yield from (("insert", m, None) for m in come)
            return
        for m in come:
            ids = m.split(",")
            was = next(
                (g for g in gone if set(g.split(",")) < set(ids) and (self.steps[0] or g.split(",")[0] == ids[0])),
                None,
            )
            if was is not None:
                gone.remove(was)
            yield ("insert" if was is None else "update", m, was)
        yield from (("delete", g, None) for g in gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def key_text(sdf: DataFrame, keys) -> Column:
    """An event's keys as one text that ``key_columns`` turns back."""
    texts = []
    for k in keys:
        kind = sdf.schema[k].dataType
        if isinstance(kind, T.BinaryType):
            texts.append(F.hex(k))
        elif isinstance(kind, T.TimestampType):
            texts.append(F.unix_micros(F.col(k)).cast("string"))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            texts.append(F.to_json(F.struct(F.col(k).alias("k"))))
        else:
            texts.append(F.col(k).cast("string"))
    return F.to_json(F.array(*texts)) if texts else F.lit("[]")


def key_columns(sdf: DataFrame, keys, text: Column) -> list[Column]:
    out = []
    for n, k in enumerate(keys):
        kind, one = sdf.schema[k].dataType, F.from_json(text, "array<string>")[n]
        if isinstance(kind, T.BinaryType):
            one = F.unhex(one)
        elif isinstance(kind, T.TimestampType):
            one = F.timestamp_micros(one.cast("long"))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            one = F.from_json(one, T.StructType([T.StructField("k", kind)]))["k"]
        else:
            one = one.cast(kind)
        out.append(one.alias(k))
    return out


def stream_match(
    sdf: DataFrame, spec: PatternSpec, delay: str = "10 minutes", with_correction: bool = True, slots: int = 512
) -> DataFrame:
    """Changelog of a live stream: inserts as ends arrive, corrections as late events do.

    Takes policy any (plain steps, or one-or-more steps in mode maximal) and policy next
    with at most the middle step of three one-or-more; ids must be integers.  Events later
    than ``delay`` are lost with their state; longer histories, other modes and conditions
    on earlier events belong to ``stream_match_batch``.  Keys share state by a hash of
    ``slots`` values; more slots make smaller groups, and the number stays with the checkpoint.
    """
    steps = spec.positive
    if any(s.negated or s.folds or s.cross_when for s in spec.steps):
        raise ValueError("keyed state takes steps with plain conditions")
    fits = spec.policy == "any" and (not spec.has_kleene or spec.mode == "maximal")
    fits = fits or (spec.policy == "next" and (not spec.has_kleene or (spec.shape, spec.mode) == (".+.", "maximal")))
    if not fits:
        raise ValueError(f"keyed state does not run policy {spec.policy!r} with mode {spec.mode!r}")
    spark = sdf.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    within = micros(spec.within)
    width = max(1, within)
    timed = sdf.withColumn("event_time", F.col(spec.ts).cast("timestamp")).withWatermark("event_time", delay)
    t = F.unix_micros("event_time")
    own = bucket_of(t, width)
    used = F.lit(False)
    for s in steps:
        used = used | F.coalesce(as_column(s.when), F.lit(False))
    flags = [F.when(as_column(s.when), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(steps)]
    flag = reduce(lambda a, b: a + b, flags).cast("long")
    # Under policy any an event that is an end and nothing else serves no other end.
    early = F.lit(True) if spec.policy == "next" else F.coalesce(flag != 1 << len(steps) - 1, F.lit(True))
    copies = F.array(F.struct(own.alias("k"), F.lit(True).alias("own")), F.struct((own + 1).alias("k"), F.lit(False).alias("own")))
    rows = timed.filter(used).select(
        key_text(sdf, spec.keys).alias("key"), "event_time", t.alias("tick"), F.col(spec.id).cast("long").alias("eid"),
        flag.alias("flags"), F.explode(F.filter(copies, lambda b: b["own"] | early)).alias("b"),
    ).withColumns({"bucket": F.col("b.k"), "own": F.col("b.own")}).drop("b")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)))
    out = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("start_tick", T.LongType()),
            T.StructField("end_tick", T.LongType()),
            T.StructField("end_id", T.LongType()),
            T.StructField("event_ids", T.ArrayType(T.LongType())),
            T.StructField("old_ids", T.ArrayType(T.LongType())),
        ]
    )
    processor = KeyedMatcher(
        [s.kleene for s in steps], within, spec.policy, out, with_correction, width, width // 1000 + 1,
    )
    changes = rows.groupBy("slot", "bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime"
    )
    return changes.select(
        "kind", *key_columns(sdf, spec.keys, F.col("key")),
        F.timestamp_micros("start_tick").alias("start_ts"), F.timestamp_micros("end_tick").alias("end_ts"),
        "end_id", F.size("event_ids").alias("n_events"), "event_ids",
        F.xxhash64("event_ids").alias("match_id"),
        F.when(F.col("old_ids").isNotNull(), F.xxhash64("old_ids")).alias("old_match_id"),
    )
