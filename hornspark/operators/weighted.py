"""Weighted closure: the best product of weights over all proofs of an atom.

Facts and rules have weights from 0 to 1. A proof weighs the product of its rules and facts, an
atom as much as its best proof. The rounds are semi-naive in improvements: an atom is in the
next delta if it is new or if its weight has risen. No weight is over 1, so a proof that
goes through its own atom can't be better than that atom, and the rounds end on cycles too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.operators.forward import KEY, MERGE_ROUNDS, only
from hornspark.operators.joins import chain, head_of
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, Parts
from hornspark.plans.rules import by_shape, local_frame, shape_table


def apply_weighted(kb: KnowledgeBase, known: DataFrame, delta: DataFrame | None = None, fresh: set[int] | None = None) -> DataFrame:
    """Heads (pred, s, o, w) that follow in one step from ``known`` (pred, s, o, w), each with its best weight.

    With ``delta`` only those with at least one of its atoms; ``fresh`` are its predicates.
    """
    parts = []
    weights = local_frame(kb.spark, [(r.rule_id, float(r.weight)) for r in kb.rules], "rule_id int, rw double")
    for shape, group in by_shape(kb.rules).items():
        for k in range(len(shape.body)) if delta is not None else [None]:
            some = [x for x in group if k is None or fresh is None or x[0].body[k].pred in fresh]
            if not some:
                continue
            rules = shape_table(kb.spark, shape, some, kb.heads).join(F.broadcast(weights), "rule_id")
            sources = [only(delta if j == k else known, {r.body[j].pred for r, _ in some}).withColumnRenamed("w", f"w{j}") for j in range(len(shape.body))]
            product = reduce(lambda a, b: a * b, [F.col("rw"), *(F.col(f"w{j}") for j in range(len(shape.body)))])
            parts.append(chain(rules, shape, sources, shape.order(k), semi=False).select(*head_of(shape), product.alias("w")))
    if not parts:
        return known.select(*KEY, "w").limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.max("w").alias("w"))


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max("w").alias("w"))


def weighted_closure(kb: KnowledgeBase, weights: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Atoms (pred, s, o, w) whose weight comes from a rule: derived ones, and facts that rules make heavier.

    ``weights``: (pred, s, o, w) of facts; a fact without one weighs 1, of several the best
    counts. Atoms that weigh ``least`` or less are dropped and prove nothing. Weights that aren't
    from 0 to 1 are refused.
    """
    if any(not 0 <= r.weight <= 1 for r in kb.rules):
        raise ValueError(f"rules weigh from 0 to 1, not {[r.weight for r in kb.rules if not 0 <= r.weight <= 1]}")
    rows = kb.facts.select(*KEY)
    if weights is not None:
        given = _best(weights.select(*KEY, F.col("w").cast("double").alias("w")))
        rows = rows.join(given, KEY, "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    written = Materialized(rows, "weighted-facts")
    if weights is not None and not written.df.where("w < 0 or w > 1 or isnan(w)").isEmpty():
        written.drop()
        raise ValueError("facts weigh from 0 to 1")
    facts = written.df.where(F.col("w") > least)
    found = Parts("improved", MERGE_ROUNDS, _best)
    delta, fresh = None, None
    while True:
        known = facts.unionByName(found.rows) if found else facts
        new = apply_weighted(kb, known, delta, fresh).where(F.col("w") > least).alias("n")
        old = known.withColumnsRenamed({c: f"_{c}" for c in (*KEY, "w")})
        better = new.join(old, [F.col(f"n.{c}") == F.col(f"_{c}") for c in KEY] + [F.col("_w") >= F.col("n.w")], "left_anti")
        delta = found.add(better)
        found.sweep(last=delta is None)
        if delta is None:
            break
        fresh = {r["pred"] for r in delta.select("pred").distinct().collect()}  # at most the rules' heads
    written.drop()
    return _best(found.rows) if found else rows.limit(0)
