"""Hard rules: bodies that hold although the head does not, and the facts to blame.

A hard rule derives nothing. Each way in which its body holds in the facts and the closure
while its head is neither is a violation. A violation rests on base facts: those of its body, and
for derived atoms those of their witnesses. Blamed is a set of base facts that every violation
rests on at least one of, and that has no fact to spare.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornspark.operators.forward import KEY, forward_chain, only, witnesses
from hornspark.operators.joins import body_of, chain, head_of
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, materialize
from hornspark.plans.rules import Rule, by_shape, shape_table


def violations(kb: KnowledgeBase, hard: list[Rule], known: DataFrame | None = None) -> DataFrame:
    """Violations (rule_id, pred, s, o, body) of hard rules: the head that is missing and the ground body.

    ``known``: facts and closure (pred, s, o); derived to the fixpoint if it isn't given. A rule
    whose head has a predicate that nothing has forbids its body.
    """
    if known is None:
        known = materialize(kb.facts.select(*KEY).unionByName(forward_chain(kb).where("not is_base").select(*KEY)), "known")
    parts = []
    for shape, group in by_shape(hard).items():
        rules = shape_table(kb.spark, shape, group, kb.heads)
        sources = [only(known, {r.body[j].pred for r, _ in group}) for j in range(len(shape.body))]
        parts.append(chain(rules, shape, sources, shape.order(None), semi=False).select("rule_id", *head_of(shape), body_of(shape).alias("body")))
    if not parts:
        raise ValueError("no hard rules")
    held = only(known, {r.head.pred for r in hard})
    return reduce(DataFrame.unionByName, parts).join(held, KEY, "left_anti").distinct().select("rule_id", *KEY, "body")


def supports(kb: KnowledgeBase, broken: DataFrame) -> DataFrame:
    """Base facts (_n, pred, s, o) that each violation ``_n`` rests on, by the witnesses of its derived atoms."""
    proofs = materialize(witnesses(kb), "witnesses")
    facts = kb.facts.select(*KEY)
    now = broken.select("_n", F.explode("body").alias("a")).select("_n", F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o")).distinct()
    found = None
    for level in count():
        now = materialize(now, f"support-{level}")
        base = now.join(facts, KEY, "left_semi")
        found = base if found is None else found.unionByName(base)
        open_ = now.join(facts, KEY, "left_anti")
        if open_.isEmpty():
            return materialize(found.distinct(), "supports")
        below = open_.join(proofs.select(*KEY, F.explode("body").alias("a")), KEY)
        now = below.select("_n", F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o")).distinct()
    raise AssertionError("unreachable")


def blame(links: DataFrame) -> DataFrame:
    """Facts (pred, s, o) such that every ``_n`` of ``links`` (_n, pred, s, o) has one of them, and none can be spared.

    In a round each uncovered violation votes for its fact that most uncovered ones rest on (of
    several the first), and facts with all votes of theirs are taken; the most frequent fact
    always is. Then facts whose violations all have another are given back, at once those that
    are the last such fact of each of their violations, which never share one.
    """
    left, taken = links, None
    for step in count():
        weight = left.groupBy(*KEY).agg(F.count("*").alias("_w"))
        votes = left.join(weight, KEY).groupBy("_n").agg(F.min(F.struct((-F.col("_w")).alias("_w"), *KEY)).alias("_v")).select("_n", "_v.*")
        won = votes.groupBy(*KEY, "_w").agg(F.count("*").alias("_votes")).where("_votes = -_w").select(*KEY)
        new = materialize(won, f"blamed-{step}")
        if new.isEmpty():
            break
        taken = new if taken is None else taken.unionByName(new)
        hit = left.join(new, KEY, "left_semi").select("_n").distinct()
        left = materialize(left.join(hit, "_n", "left_anti"), f"uncovered-{step}")
    if taken is None:
        return links.select(*KEY).limit(0)
    held = materialize(links.join(taken, KEY, "left_semi"), "held")
    while True:
        per = held.withColumn("_c", F.count("*").over(Window.partitionBy("_n")))
        spare = materialize(per.groupBy(*KEY).agg(F.min("_c").alias("_c")).where("_c > 1").select(*KEY), "spare")
        if spare.isEmpty():
            return held.select(*KEY).distinct()
        last = held.join(spare, KEY, "left_semi").groupBy("_n").agg(F.max(F.struct(*KEY)).alias("_l"))
        gone = held.join(spare, KEY, "left_semi").join(last, "_n").groupBy(*KEY).agg(F.min(F.struct(*KEY) == F.col("_l")).alias("_all")).where("_all").select(*KEY)
        held = Materialized(held.join(gone, KEY, "left_anti"), "held").df


def blamed(kb: KnowledgeBase, hard: list[Rule]) -> DataFrame:
    """Base facts (pred, s, o) to blame for all violations of hard rules."""
    broken = materialize(violations(kb, hard).withColumn("_n", F.monotonically_increasing_id()), "violations")
    return blame(supports(kb, broken))
