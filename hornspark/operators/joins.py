"""Rule bodies as join chains over fact tables, one plan for all rules of a shape."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import atom
from hornspark.plans.rules import Shape


def value(v: int) -> str:
    """The column of a slot: a variable's binding or a constant of the rule."""
    return f"v{v}" if v >= 0 else f"c{-v}"


def extend(now: DataFrame, shape: Shape, i: int, source: DataFrame, bound: set[int], needed: set[int] | None = None) -> DataFrame:
    """Join body atom ``i`` with ``source`` (pred, s, o and maybe more columns) on all that is bound.

    If none of the variables that the atom binds is needed later, the join is a semi-join.
    """
    a, b = shape.body[i]
    src = source.withColumnsRenamed({"pred": "_p", "s": "_s", "o": "_o"})
    if a == b:
        src = src.where("_s = _o")
    on = F.col(f"p{i}") == F.col("_p")
    fresh = {}
    for slot, col in ((a, "_s"), (b, "_o")):
        if slot < 0 or slot in bound:
            on &= F.col(value(slot)) == F.col(col)
        else:
            fresh[slot] = col
    if len(fresh) == len({a, b}) and bound:
        warnings.warn(f"body atom {i} shares no variable with the others: a join on its predicate only", stacklevel=2)
    if needed is not None and not (set(fresh) & needed):
        return now.join(src, on, "left_semi")
    out = now.join(src, on)
    for slot, col in fresh.items():
        out = out.withColumn(value(slot), F.col(col))
        bound.add(slot)
    return out.drop("_p", "_s", "_o")


def chain(rules: DataFrame, shape: Shape, sources: list[DataFrame], order: list[int], semi: bool = True) -> DataFrame:
    """All body atoms joined in ``order``, from the (broadcast) rules of the shape."""
    now, bound = F.broadcast(rules), set()
    for k, i in enumerate(order):
        needed = shape.needed_after(order[: k + 1]) if semi else None
        now = extend(now, shape, i, sources[i], bound, needed)
    return now


def head_of(shape: Shape) -> list[Column]:
    return [F.col("hp").alias("pred"), F.col(value(shape.head[0])).alias("s"), F.col(value(shape.head[1])).alias("o")]


def body_of(shape: Shape) -> Column:
    """The ground body as an array of atoms."""
    return F.array(*[atom(F.col(f"p{i}"), F.col(value(a)), F.col(value(b))) for i, (a, b) in enumerate(shape.body)])
