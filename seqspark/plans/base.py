"""The frame every matcher starts from, and the match table every matcher ends with."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import replace as with_fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_ticks, from_ticks, ticks
from ..spec import PatternSpec, Step


SHORT_CHUNK = 300_000_000  # five minutes in ticks


def as_column(condition: Column | str) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def step_flag(spec: PatternSpec, step: Step) -> str:
    return f"_s{list(spec.steps).index(step)}"


def relevant_events(df: DataFrame, spec: PatternSpec) -> DataFrame:
    """Only the events some step of the pattern can use (the filter reaches the scan)."""
    return df.filter(either([as_column(s.when) for s in spec.steps]))


@dataclass(frozen=True)
class Prepared:
    """Narrow event frame: keys, ``_e`` struct(t, id, payload...), one flag per step."""

    df: DataFrame
    source: DataFrame
    spec: PatternSpec
    within: int
    chunk: int
    levels: int = 2
    rejected: bool | None = None
    base: DataFrame | None = None
    near: bool = False

    def flag(self, step: Step) -> Column:
        return F.col(step_flag(self.spec, step))

    def rows(self, step: Step) -> DataFrame:
        """The step's events; on an untouched table the bare condition reaches the scan."""
        if self.base is None:
            return self.df.filter(self.flag(step))
        return narrowed(self.base.filter(as_column(step.when)), self.source, self.spec)

    def having(self, df: DataFrame) -> Prepared:
        """The same with a frame that carries more than the table does."""
        return with_fields(self, df=df, base=None)

    def time(self, tick: Column) -> Column:
        return from_ticks(self.source, self.spec.ts, tick)

    def timed(self) -> Prepared:
        """Events carry their time in its own type: made once per event, where a match table would make it per match."""
        return self.having(self.df.withColumn("_e", F.col("_e").withField("_at", self.time(F.col("_e")["t"]))))

    def time_of(self, event: Column) -> Column:
        return event["_at"] if "_at" in self.df.schema["_e"].dataType.names else self.time(event["t"])


def prepare(events: DataFrame, spec: PatternSpec, *, keep_all: bool = False) -> Prepared:
    """Filter and narrow ``events`` for ``spec``.

    ``keep_all`` keeps events no step can use (strict contiguity needs them).  Rows
    without time or with a null key take part in no match.
    """
    within = duration_ticks(events, spec.ts, spec.within)
    chunk = max(1, within if spec.chunk is None else duration_ticks(events, spec.ts, spec.chunk))
    # Years of chunks below a few minutes are too many for one group per key.
    short = chunk < SHORT_CHUNK and "timestamp" in events.schema[spec.ts].dataType.simpleString()
    df = events if keep_all else relevant_events(events, spec)
    for name in [spec.ts, *spec.keys]:
        df = df.filter(F.col(name).isNotNull())
    narrow = narrowed(df, events, spec)
    return Prepared(narrow, events, spec, within, chunk, 3 if short else 2, None, df)


def narrowed(df: DataFrame, events: DataFrame, spec: PatternSpec) -> DataFrame:
    """Keys, ``_e`` and the step flags of the given rows."""
    event = F.struct(
        ticks(events, spec.ts).alias("t"),
        F.col(spec.id).alias("id"),
        *[F.col(p) for p in spec.payload],
        *[
            F.coalesce(as_column(s.first_when), F.lit(False)).alias(f"_first_{s.name}")
            for s in spec.steps
            if s.first_when is not None
        ],
    )
    flags = [
        F.coalesce(as_column(s.when), F.lit(False)).alias(step_flag(spec, s)) for s in spec.steps
    ]
    return df.select(*spec.keys, event.alias("_e"), *flags)


def visible(p: Prepared, step: Step) -> Column:
    """A step's column without the helper fields the planner added to its events."""
    hidden = [f for f in p.df.schema["_e"].dataType.names if f.startswith("_")]
    col = F.col(step.name)
    if not hidden:
        return col
    if step.kleene:
        return F.transform(col, lambda e: e.dropFields(*hidden)).alias(step.name)
    return col.dropFields(*hidden).alias(step.name)


def first_of(step: Step) -> Column:
    return F.get(F.col(step.name), F.lit(0)) if step.kleene else F.col(step.name)


def last_of(step: Step) -> Column:
    return F.element_at(F.col(step.name), -1) if step.kleene else F.col(step.name)


def ids_of(step: Step) -> Column:
    col = F.col(step.name)
    return F.transform(col, lambda e: e["id"]) if step.kleene else F.array(col["id"])


def count_of(step: Step) -> Column:
    return F.size(step.name) if step.kleene else F.lit(1)


def finish(df: DataFrame, p: Prepared) -> DataFrame:
    """Match table from a frame with the keys and one column per positive step."""
    steps = p.spec.positive
    last = steps[-1]
    if p.rejected is not None:
        df = df.filter(negation_hit(p) if p.rejected else ~negation_hit(p))
    out = df.select(
        *p.spec.keys,
        p.time_of(first_of(steps[0])).alias("start_ts"),
        p.time_of(F.col(last.name)).alias("end_ts"),
        F.col(last.name)["id"].alias("end_id"),
        reduce(lambda a, b: a + b, [count_of(s) for s in steps]).alias("n_events"),
        F.concat(*[ids_of(s) for s in steps]).alias("event_ids"),
        *[visible(p, s) for s in steps],
    )
    return out.select(
        *p.spec.keys,
        "start_ts",
        "end_ts",
        "end_id",
        "n_events",
        "event_ids",
        F.xxhash64("event_ids").alias("match_id"),
        *[s.name for s in steps],
    )


def negation_hit(p: Prepared) -> Column:
    """True when a negated event lies between its neighbours (bounds included).

    Every event carries how many negated events came before its time and up to its time,
    so no join is needed.
    """
    steps = list(p.spec.steps)
    at = next(i for i, s in enumerate(steps) if s.negated)
    return first_of(steps[at + 1])["_neg_upto"] > last_of(steps[at - 1])["_neg_before"]
