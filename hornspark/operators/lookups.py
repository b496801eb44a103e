"""Membership and index lookups of goals against a fact table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.plans.materialize import tasks

#: Facts up to which they are broadcast to the goals.
FEW = 100_000


def contains(atoms: DataFrame, facts: DataFrame, flag: str = "known") -> DataFrame:
    """``atoms`` (pred, s, o, ...) with a boolean column: whether each is in ``facts``."""
    return atoms.join(facts.select("pred", "s", "o").withColumn(flag, F.lit(True)), ["pred", "s", "o"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def kinds(goals: DataFrame) -> set[tuple[int, bool, bool]]:
    """The predicates of (pred, a0, a1) with which arguments are bound: few, whatever the data."""
    return {tuple(r) for r in goals.select("pred", F.col("a0") >= 0, F.col("a1") >= 0).distinct().collect()}


def matches(goals: DataFrame, facts: DataFrame, pred: str = "pred", a0: str = "a0", a1: str = "a1", present: set[tuple[int, bool, bool]] | dict[tuple[int, bool, bool], int] | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """Each goal with the facts that it unifies with, as columns fs and fo.

    ``present``: the ``kinds`` of the goals, if they are known; joins for others are left out,
    and each reads only its predicates. With the number of goals of each of these and with
    ``sizes``, the number of facts of each predicate, few facts are broadcast, and others are dealt
    out over as many tasks as the rows need.

    Goals are parted by which arguments are bound, so that each part is a pure equi-join on
    all bound columns; in goals with one variable twice, subject and object are equal.
    """
    p, x, y = F.col(pred), F.col(a0), F.col(a1)
    parts = []
    for bound0 in (True, False):
        for bound1 in (True, False):
            f = facts
            if present is not None:
                own = sorted(k[0] for k in present if k[1:] == (bound0, bound1))
                if not own:
                    continue
                f = f.where(F.col("pred").isin(own))
            f = f.select(F.col("pred").alias("_p"), F.col("s").alias("fs"), F.col("o").alias("fo"))
            on = p == F.col("_p")
            on = on & (x == F.col("fs")) if bound0 else on
            on = on & (y == F.col("fo")) if bound1 else on
            part = goals.where(((x >= 0) == bound0) & ((y >= 0) == bound1))
            if present is not None and sizes is not None and (bound0 or bound1):
                n_facts, n_goals = sum(sizes.get(k, 0) for k in own), sum(present[k, bound0, bound1] for k in own)
                parts_ = tasks(goals.sparkSession, max(n_goals, n_facts // 4))  # facts are narrow
                if n_facts <= FEW:
                    f = F.broadcast(f)
                elif parts_ is not None:
                    part = part.repartition(parts_, p, *([x] if bound0 else []), *([y] if bound1 else []))
                    f = f.repartition(parts_, "_p", *(["fs"] if bound0 else []), *(["fo"] if bound1 else []))
            part = part.join(f, on)
            parts.append(part if bound0 or bound1 else part.where((x != y) | (F.col("fs") == F.col("fo"))))
    if not parts:
        return goals.limit(0).withColumn("fs", F.lit(0).cast("bigint")).withColumn("fo", F.lit(0).cast("bigint"))
    return reduce(DataFrame.unionByName, parts).drop("_p")


def rules_for(goals: DataFrame, rules: DataFrame, pred: str = "pred") -> DataFrame:
    """Each goal with the rules whose head has its predicate. Rules are few: they are broadcast."""
    return goals.join(F.broadcast(rules), F.col(pred) == F.col("hp"))


def enumerate_objects(subjects: DataFrame, facts: DataFrame) -> DataFrame:
    """Objects o for rows of (pred, s)."""
    return subjects.join(facts, ["pred", "s"])


def enumerate_subjects(objects: DataFrame, facts: DataFrame) -> DataFrame:
    """Subjects s for rows of (pred, o)."""
    return objects.join(facts, ["pred", "o"])
