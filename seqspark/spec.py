"""How a pattern is described: steps, window, policy, mode, keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column

POLICIES = ("any", "next", "contiguous")
MODES = ("all", "prefix", "maximal", "maximal_compact")

# Which modes each policy offers once a pattern has a one-or-more step.
ALLOWED = {
    "any": ("all", "maximal", "maximal_compact"),
    "next": ("prefix", "maximal"),
    "contiguous": MODES,
}

# Unit words accepted in a duration text, in microseconds.
UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "sec": 1_000_000,
    "second": 1_000_000,
    "m": 60_000_000,
    "min": 60_000_000,
    "minute": 60_000_000,
    "h": 3_600_000_000,
    "hour": 3_600_000_000,
    "d": 86_400_000_000,
    "day": 86_400_000_000,
}


def micros(duration: timedelta | str) -> int:
    """Length of a ``timedelta`` or of a text such as ``"10 min"`` in microseconds."""
    if isinstance(duration, timedelta):
        return duration // timedelta(microseconds=1)
    found = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", duration.lower())
    unit = found and (found[2] if found[2] in UNIT_MICROS else found[2].removesuffix("s"))
    if not found or unit not in UNIT_MICROS:
        raise ValueError(f"not a duration: {duration!r} (units: {', '.join(UNIT_MICROS)})")
    return int(found[1]) * UNIT_MICROS[unit]


@dataclass(frozen=True)
class Step:
    """One position of a pattern.

    ``when``        condition on the event itself (Column or SQL text)
    ``kleene``      one or more events instead of exactly one
    ``negated``     no such event may lie between the neighbouring steps
    ``first_when``  extra condition on the first event of a one-or-more step
    ``iter_when``   ``f(cur, prev)`` compares with the event taken just before
    ``agg_when``    ``f(cur, acc)`` compares with ``acc.n/total/lo/hi/last``, running
                    values of ``agg_on`` over the events the step took so far
    ``cross_when``  ``f(cur, bound)`` compares with the last event of earlier steps,
                    ``bound["name"]``

    The functions get struct columns with fields ``t``, ``id`` and every column named
    in ``PatternSpec.payload``.
    """

    name: str
    when: Column | str
    kleene: bool = False
    negated: bool = False
    first_when: Column | str | None = None
    iter_when: Callable[[Column, Column], Column] | None = None
    cross_when: Callable[[Column, dict[str, Column]], Column] | None = None
    agg_when: Callable[[Column, Column], Column] | None = None
    agg_on: str | None = None

    @property
    def folds(self) -> bool:
        """True when taking an event depends on what the step took before."""
        return any(f is not None for f in (self.first_when, self.iter_when, self.agg_when))


@dataclass(frozen=True)
class PatternSpec:
    """A sequence pattern.

    ``within`` is a ``timedelta`` or text for timestamp columns and a plain number for
    numeric time columns.  ``chunk`` is the time span one task scans at a time in running
    scans (default: the window); make it shorter when one key is very busy.  ``salt``
    splits the ends of each (key, time bucket) over that many tasks in window joins.
    """

    steps: Sequence[Step]
    within: timedelta | str | int
    policy: str = "any"
    mode: str = "all"
    partition_by: Sequence[str] = ()
    same: Sequence[str] = ()
    ts: str = "ts"
    id: str = "event_id"
    payload: Sequence[str] = ()
    max_subset_candidates: int | None = None
    chunk: timedelta | str | int | None = None
    salt: int = 1

    def __post_init__(self):
        names = [s.name for s in self.steps]
        if len(set(names)) != len(names):
            raise ValueError(f"step names must be unique: {names}")
        if self.policy not in POLICIES or self.mode not in MODES:
            raise ValueError(f"unknown policy or mode: {self.policy!r}, {self.mode!r}")
        if len(self.positive) < 2:
            raise ValueError("a pattern needs at least two steps that are not negated")
        if self.steps[0].negated or self.steps[-1].negated:
            raise ValueError("the first and the last step cannot be negated")
        if sum(s.negated for s in self.steps) > 1:
            raise ValueError("only one negated step is supported")
        if self.steps[-1].kleene:
            raise ValueError("the last step cannot be one-or-more: its end is never known")
        if self.has_kleene and self.mode not in ALLOWED[self.policy]:
            raise ValueError(f"mode {self.mode!r} is not defined for policy {self.policy!r}")
        for s in self.steps:
            if s.folds and not s.kleene:
                raise ValueError(f"step {s.name}: first/iter/agg conditions need kleene=True")
            if s.negated and (s.kleene or s.cross_when):
                raise ValueError(f"step {s.name}: a negated step takes a plain condition only")
            if s.agg_when and s.agg_on not in self.payload:
                raise ValueError(f"step {s.name}: agg_on must name a payload column")
        if self.salt < 1:
            raise ValueError("salt must be at least 1")

    @property
    def positive(self) -> list[Step]:
        return [s for s in self.steps if not s.negated]

    @property
    def has_kleene(self) -> bool:
        return any(s.kleene for s in self.steps)

    @property
    def keys(self) -> list[str]:
        """Partition keys: ``partition_by`` and the attributes all events must share."""
        return list(dict.fromkeys([*self.partition_by, *self.same]))

    @property
    def shape(self) -> str:
        """Kleene layout of the positive steps, e.g. ``".+."`` for ``A B+ C``."""
        return "".join("+" if s.kleene else "." for s in self.positive)

    def but(self, **changes) -> PatternSpec:
        return replace(self, **changes)


def same_attribute(spec: PatternSpec, *cols: str) -> PatternSpec:
    """Every event of a match must agree on these columns."""
    return spec.but(same=[*spec.same, *cols])
