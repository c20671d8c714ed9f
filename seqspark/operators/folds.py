"""Conditions that depend on the events a one-or-more step has taken so far."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Prepared, both
from ..spec import Step


def bound_steps(p: Prepared, upto: Step) -> dict[str, Column]:
    """Last event of every step before ``upto``."""
    out = {}
    for s in p.spec.positive:
        if s.name == upto.name:
            break
        out[s.name] = F.element_at(F.col(s.name), -1) if s.kleene else F.col(s.name)
    return out


def walk(p: Prepared, step: Step, cross: bool = True):
    """(start, accept, add): the state of the events taken, whether it accepts one more, and the state with it.

    ``n``, ``total``, ``lo`` and ``hi`` skip null values. Without ``cross`` only conditions on the step's own events
    count.
    """
    kind = p.df.schema["_e"].dataType
    attr = step.agg_on or "t"
    number = kind[attr].dataType.simpleString() if step.agg_on else "bigint"

    def state(taken, n, total, lo, hi, last):
        return F.struct(
            taken.alias("taken"), n.alias("n"), total.alias("total"),
            lo.alias("lo"), hi.alias("hi"), last.alias("last"),
        )

    def none(of):
        return F.lit(None).cast(of)

    start = state(
        F.array().cast(f"array<{kind.simpleString()}>"),
        F.lit(0), F.lit(0.0), none(number), none(number), none(number),
    )

    def accept(acc, e):
        fresh = F.size(acc["taken"]) == 0
        ok = []
        if step.first_when is not None:
            ok.append(~fresh | e[f"_first_{step.name}"])
        if step.iter_when:
            ok.append(fresh | step.iter_when(e, F.element_at(acc["taken"], -1)))
        if step.agg_when:
            ok.append(fresh | step.agg_when(e, acc))
        if step.cross_when and cross:
            ok.append(step.cross_when(e, bound_steps(p, step)))
        return F.coalesce(both(ok), F.lit(False)) if ok else F.lit(True)

    def add(acc, e):
        v = e[attr]
        return state(
            F.concat(acc["taken"], F.array(e)),
            acc["n"] + v.isNotNull().cast("int"),
            acc["total"] + F.coalesce(v.cast("double"), F.lit(0.0)),
            F.least(acc["lo"], v),
            F.greatest(acc["hi"], v),
            v,
        )

    return start, accept, add


def greedy(p: Prepared, events: Column, step: Step) -> Column:
    """Walk the candidates in time order and take each one the conditions accept."""
    start, accept, add = walk(p, step)
    return F.aggregate(
        events, start, lambda acc, e: F.when(accept(acc, e), add(acc, e)).otherwise(acc), lambda acc: acc["taken"]
    )


def holds(p: Prepared, events: Column, step: Step) -> Column:
    """True when every event of the given set is accepted in turn."""
    return F.size(greedy(p, events, step)) == F.size(events)


def depends(step: Step) -> bool:
    return step.folds or step.cross_when is not None
