"""Forward chaining: the semi-naive fixpoint, and a well-founded witness for each derived atom."""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM, STEP
from hornspark.operators.joins import body_of, chain, head_of, value
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, materialize
from hornspark.plans.rules import by_shape, shape_table
from hornspark.plans.statistics import join_order

KEY = ["pred", "s", "o"]
#: Rounds after which the atoms found so far are written out as one table, so that plans stay short.
MERGE_ROUNDS = 8


def only(source: DataFrame, predicates: set[int]) -> DataFrame:
    """Rows of some predicates; the filter reaches the scan."""
    return source.where(F.col("pred").isin(sorted(predicates)))


def apply_rules(kb: KnowledgeBase, known: DataFrame, delta: DataFrame | None = None, fresh: set[int] | None = None, witness: bool = False) -> DataFrame:
    """Heads that follow in one step from ``known``; with ``delta``, from at least one of its atoms.

    ``fresh``: the predicates of ``delta``, if they are known; rules that can't meet them are
    left out of the plan. Each body position reads only its rules' predicates. With ``witness``
    each head has the least (rule_id, body) that gives it, as column ``w``. Rules of one shape
    share a plan; if the knowledge base has statistics, those of one shape and join order do.
    """
    parts = []
    for shape, group in by_shape(kb.rules).items():
        for k in range(len(shape.body)) if delta is not None else [None]:
            some = [x for x in group if k is None or fresh is None or x[0].body[k].pred in fresh]
            orders: dict[tuple[int, ...], list] = {}
            for x in some:
                orders.setdefault(tuple(shape.order(k) if kb.statistics is None else join_order(x[0], kb.statistics, k)[0]), []).append(x)
            for order, same in orders.items():
                rules = shape_table(kb.spark, shape, same, kb.heads)
                sources = [only(delta if j == k else known, {r.body[j].pred for r, _ in same}) for j in range(len(shape.body))]
                own = [F.struct("rule_id", body_of(shape).alias("body")).alias("w")] if witness else []
                parts.append(chain(rules, shape, sources, list(order), semi=not witness).select(*head_of(shape), *own))
    if not parts:
        return known.select(*KEY, *([F.lit(None).cast(f"struct<rule_id:int,body:array<{ATOM}>>").alias("w")] if witness else [])).limit(0)
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy(*KEY).agg(F.min("w").alias("w")) if witness else found.distinct()


def forward_chain(kb: KnowledgeBase, depth: int | None = None, most_new: int | None = None, witness: bool = False) -> DataFrame:
    """Derived atoms (pred, s, o) with the ``step`` of their first derivation.

    With ``witness`` also ``w``, the first (rule_id, body) that proves the atom from atoms of
    earlier steps: an atom that is new in a round has no proof without one of the round before,
    so the round's own join has them all.

    The rounds go on to the fixpoint. With a ``depth`` there are at most so many, and a warning
    says if the last one still had new atoms, so that the closure may be incomplete.

    Base facts are among them only if a rule derives them again, marked ``is_base``. A round
    joins the atoms that are new in the last one with all known ones, drops the known by an
    anti-join and is written to the shared folder. ``most_new``: fail loudly if a round derives
    more than so many atoms. Without these two, transitive closures that no other rule reads are
    doubled: their rounds grow with the logarithm of the longest path, and the results are the same.
    """
    if depth is None and most_new is None:
        from hornspark.operators.doubling import long_chains  # which needs this module

        apart = long_chains(kb)
        if apart is not None:
            return apart.closure(witness)
    facts = materialize(kb.facts, "facts")
    base = only(facts, kb.heads).withColumn("is_base", F.lit(True))  # no other fact can be derived
    found, delta, fresh = None, None, None
    for step in count() if depth is None else range(depth):
        if step and step % MERGE_ROUNDS == 0:
            found = materialize(found, f"found-{step}")
        known = facts if found is None else facts.unionByName(found.where("not is_base").select(*KEY))
        new = apply_rules(kb, known, delta, fresh, witness)
        if found is not None:  # only predicates that rules derive can be known already
            new = new.join(found.select(*KEY), KEY, "left_anti")
        new = new.join(base, KEY, "left").select(*KEY, F.lit(step).alias("step"), F.coalesce("is_base", F.lit(False)).alias("is_base"), *(["w"] if witness else []))
        rows = Materialized(new, f"delta-{step}")
        counts = rows.df.groupBy("pred").agg(F.count("*").alias("n"), F.count_if(~F.col("is_base")).alias("new")).collect()  # one row per predicate
        n = sum(r["n"] for r in counts)
        if most_new is not None and n > most_new:
            raise RuntimeError(f"step {step} derived {n} atoms, more than {most_new}")
        if not n:
            break
        found = rows.df if found is None else found.unionByName(rows.df)
        delta = rows.df.where("not is_base").select(*KEY)
        fresh = {r["pred"] for r in counts if r["new"]}
    else:
        if fresh:
            warnings.warn(f"forward chaining ended after {depth} rounds, the last of which had new atoms", stacklevel=2)
    if found is None:
        return kb.spark.createDataFrame([], "pred int, s bigint, o bigint, step int, is_base boolean" + (f", w struct<rule_id:int,body:array<{ATOM}>>" if witness else ""))
    return found


def witnesses(kb: KnowledgeBase, closure: DataFrame | None = None) -> DataFrame:
    """For each derived atom (of ``closure``, if it is given) the first (rule_id, body) that proves it from atoms of earlier steps.

    Steps of the body are smaller than the atom's own, so following witnesses always ends in
    facts. A base fact that a rule derives again has one too.
    """
    found = forward_chain(kb, witness=True).select(*KEY, "w.rule_id", "w.body")
    return found if closure is None else found.join(closure.select(*KEY), KEY, "left_semi")


def inject_witnesses(groundings: DataFrame, queries: DataFrame, proofs: DataFrame) -> DataFrame:
    """``groundings`` (qid, gid, steps, depth) in which an empty proof of a ground query (qid, pred, a0, a1),
    a match with a known atom, becomes one step with the atom's witness, if it has one."""
    w = proofs.select(F.col("pred").alias("_p"), F.col("s").alias("_s"), F.col("o").alias("_o"), "rule_id", "body")
    q = queries.select("qid", "pred", "a0", "a1")
    on = (F.col("pred") == F.col("_p")) & (F.col("a0") == F.col("_s")) & (F.col("a1") == F.col("_o"))
    step = F.struct(F.lit(0).alias("depth"), F.col("rule_id"), F.struct("pred", "a0", "a1").alias("head"), F.col("body")).cast(STEP)
    have = q.join(w, on).groupBy("qid").agg(F.min(F.array(step)).alias("_w"))  # repeated queries are one
    rows = groundings.join(have, "qid", "left")
    return rows.withColumn("steps", F.when(F.size("steps") == 0, F.coalesce("_w", "steps")).otherwise(F.col("steps"))).drop("_w")


__all__ = ["apply_rules", "forward_chain", "inject_witnesses", "value", "witnesses"]
