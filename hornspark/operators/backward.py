"""Backward chaining: depth-bounded resolution over a frontier of proof states.

A state is a row: qid, goals (array of atoms, the first is resolved next), steps (one entry
per rule applied: depth, rule, head, body), and optionally an excluded atom. Each depth is one
DataFrame transformation, written to the shared folder, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM, STEP, all_ground, atom, canonical_variables, shift_variables
from hornspark.functions.unify import Bindings, Unifier
from hornspark.operators import filters
from hornspark.operators.lookups import matches, rules_for
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, materialize, spread
from hornspark.plans.rules import rule_table

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    """``width``: ground non-facts allowed in a new body (None: any). ``prune_facts``: goals that are
    facts vanish without a step. ``keep_evidence``: carry the proofs. ``collect``: ``terminal``
    (no goals left) or ``grounded`` (only ground goals left; such states also go on).
    Caps are off; with one, states are kept in a total order and the rest is dropped:
    ``most_facts`` of a query's fact children at a depth, ``most_states`` of a query,
    ``most_frontier`` of the whole batch, ``most_groundings`` of a query. ``canonical``: the
    variables of a state are named by first appearance, in its goals, then in its proof.

    Hooks run in this order at each depth: ``rule_hooks`` on rule children (with their new body
    ``new``), ``fact_hooks`` on fact children (with the matched atom ``fact``), ``state_hooks``
    on all children before they are collected, ``step_hooks`` on the groundings collected."""

    depth: int = 2
    resolution: str = "sld"
    width: int | None = None
    prune_dead: bool = False
    prune_facts: bool = False
    closure_step: bool = False
    keep_evidence: bool = True
    collect: str = "terminal"
    canonical: bool = False
    most_facts: int | None = None
    most_states: int | None = None
    most_frontier: int | None = None
    most_groundings: int | None = None
    fact_hooks: list[Hook] = field(default_factory=list)
    rule_hooks: list[Hook] = field(default_factory=list)
    state_hooks: list[Hook] = field(default_factory=list)
    step_hooks: list[Callable[[DataFrame, int], DataFrame]] = field(default_factory=list)


def initial(queries: DataFrame) -> DataFrame:
    """States from ``queries`` (qid, and either pred, a0, a1 or goals; maybe active, excluded, steps).

    A frontier that an earlier search left can be given back as it is. Rows that aren't active are left out. A null argument is not a term, so such rows are too.
    """
    q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
    goals = F.col("goals") if "goals" in q.columns else F.array(atom(F.col("pred"), F.col("a0"), F.col("a1")))
    excluded = F.col("excluded") if "excluded" in q.columns else F.lit(None).cast(ATOM)
    steps = F.col("steps") if "steps" in q.columns else F.lit(None)
    rows = q.select("qid", goals.cast(f"array<{ATOM}>").alias("goals"), steps.cast(f"array<{STEP}>").alias("steps"), excluded.cast(ATOM).alias("excluded"))
    return rows.withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{STEP}>"))).where(F.forall("goals", lambda g: g["a0"].isNotNull() & g["a1"].isNotNull()))


def _open(states: DataFrame) -> DataFrame:
    """The selected goal and the rest."""
    first = F.element_at("goals", 1)
    return states.select(
        "qid", "steps", "excluded", first["pred"].alias("pred"), first["a0"].alias("a0"), first["a1"].alias("a1"), F.slice("goals", F.lit(2), F.greatest(F.size("goals") - 1, F.lit(0))).alias("rest")
    )


def _bind_to_fact(found: DataFrame) -> DataFrame:
    """Substitute what a matched fact (fs, fo) binds into the remaining goals and the history."""
    none = F.lit(None).cast("bigint")
    b = Bindings(F.when(F.col("a0") < 0, F.col("a0")).otherwise(none), F.col("fs"), F.when(F.col("a1") < 0, F.col("a1")).otherwise(none), F.col("fo"))
    fact = F.struct("pred", F.col("fs").alias("a0"), F.col("fo").alias("a1")).cast(ATOM)
    return found.select("qid", b.atoms(F.col("rest")).alias("goals"), b.steps(F.col("steps")).alias("steps"), "excluded", fact.alias("fact"))


def fact_children(opened: DataFrame, facts: DataFrame, present: dict | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """One child per fact (``fact``) that the selected goal unifies with, but not a query's own atom."""
    found = matches(opened, facts, present=present, sizes=sizes)
    e = F.col("excluded")
    return _bind_to_fact(found.where(~F.coalesce((F.col("pred") == e["pred"]) & (F.col("fs") == e["a0"]) & (F.col("fo") == e["a1"]), F.lit(False))))


def fact_sizes(facts: DataFrame) -> dict[int, int]:
    """The number of facts of each predicate."""
    return {r["pred"]: r["n"] for r in facts.groupBy("pred").agg(F.count("*").alias("n")).collect()}  # one row per predicate


def survey(opened: DataFrame) -> tuple[dict[tuple[int, bool, bool], int], int]:
    """The selected goals' predicates with which arguments are bound, and how many, and the least variable of the states (0: none)."""

    def least(atoms: Column) -> Column:
        return F.aggregate(atoms, F.lit(0).cast("bigint"), lambda m, a: F.least(m, a["a0"], a["a1"]))

    steps = F.aggregate("steps", F.lit(0).cast("bigint"), lambda m, s: F.least(m, s["head"]["a0"], s["head"]["a1"], least(s["body"])))
    excluded = F.least(F.coalesce(F.col("excluded")["a0"], F.lit(0)), F.coalesce(F.col("excluded")["a1"], F.lit(0)))
    lowest = F.min(F.least(F.col("a0"), F.col("a1"), least(F.col("rest")), steps, excluded)).alias("lowest")
    rows = opened.groupBy("pred", (F.col("a0") >= 0).alias("b0"), (F.col("a1") >= 0).alias("b1")).agg(lowest, F.count("*").alias("n")).collect()  # one row per kind of goal
    return {(r["pred"], r["b0"], r["b1"]): r["n"] for r in rows}, min([0, *(r["lowest"] for r in rows)])


def rule_children(opened: DataFrame, rules: DataFrame, shift: int, depth: int, keep: bool) -> DataFrame:
    """One child per rule whose renamed head unifies with the selected goal: body, then the rest.

    The rules' variables are moved below all those of the states: by ``shift`` away from zero.
    """

    def renamed(t: Column) -> Column:
        return F.when(t < 0, t - shift).otherwise(t)

    found = rules_for(opened, rules)
    found = found.withColumn("t0", renamed(F.col("h0"))).withColumn("t1", renamed(F.col("h1")))
    u = Unifier(F.col("a0"), F.col("a1"), F.col("t0"), F.col("t1"))
    found = found.where(u.ok).select("*", u.s0.alias("s0"), u.r0.alias("r0"), u.s1.alias("s1"), u.r1.alias("r1"))
    b = Bindings(F.col("s0"), F.col("r0"), F.col("s1"), F.col("r1"))
    found = found.withColumn("new", b.atoms(shift_variables(F.col("body"), shift))).withColumn("rest", b.atoms(F.col("rest")))
    steps = F.col("steps")
    if keep:
        step = F.struct(F.lit(depth).alias("depth"), F.col("rule_id"), b.atom(F.struct("pred", "a0", "a1")).alias("head"), F.col("new").alias("body"))
        steps = F.concat(b.steps(steps), F.array(step.cast(STEP)))
    return found.select("qid", F.concat("new", "rest").alias("goals"), steps.alias("steps"), "excluded", "new")


def _filtered(children: DataFrame, kb: KnowledgeBase, o: Options) -> DataFrame:
    """Search filters on the new bodies of rule children."""
    if o.width is not None or o.prune_dead or o.closure_step:
        rows = filters.numbered(children, "children")
        if o.prune_dead:
            rows = filters.prune_dead(rows, F.col("new"), kb)
        rows = filters.within_width(rows, F.col("new"), kb.facts, o.width)
        if o.closure_step:
            rows = filters.closure_step(rows, F.col("new"), kb)
        children = rows.drop("_n")
    for hook in o.rule_hooks:
        children = hook(children)
    return children


def expand(states: DataFrame, kb: KnowledgeBase, o: Options, depth: int, sizes: dict[int, int] | None = None) -> DataFrame:
    """All children of the states; ``sizes``: the number of facts of each predicate, if they are known."""
    opened = _open(states.where(F.size("goals") > 0))
    present, lowest = survey(opened)
    heads = {p for p, _, _ in present}
    usable = [r for r in kb.rules if r.head.pred in heads]
    if not usable and o.resolution != "rtf":
        ruled = None
    else:
        ruled = _filtered(rule_children(opened, rule_table(kb.spark, usable), -lowest, depth, o.keep_evidence), kb, o).drop("new")
    # rtf: a rule, then a fact for the first atom of its body
    facts = fact_children(_open(ruled), kb.facts) if o.resolution == "rtf" else fact_children(opened, kb.facts, present, sizes)
    for hook in o.fact_hooks:
        facts = hook(facts)
    facts = ordered(facts, "qid", o.most_facts, ["goals", "steps", "fact"]).drop("fact")
    return facts if ruled is None or o.resolution == "rtf" else ruled.unionByName(facts)


def ordered(states: DataFrame, partition: str, most: int | None, order: list) -> DataFrame:
    """At most ``most`` rows of each ``partition`` in a total order, if there is a cap."""
    from pyspark.sql import Window

    if most is None:
        return states
    w = Window.partitionBy(partition).orderBy(*order)  # pre-limited within each task by Spark
    return states.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def ground_queries(kb: KnowledgeBase, queries: DataFrame, o: Options | None = None, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Resolve all queries for ``o.depth`` steps; ``first`` is the number of the first, if a frontier is given back.

    Returns the groundings (qid, gid, steps, depth found) and the frontier that is left
    (qid, goals, steps, excluded). Groundings are distinct by query and steps; the order of
    facts and of partitions has no influence. An answer that is itself a fact has no steps.
    """
    o = o or Options()
    kb = replace(kb, facts=materialize(kb.facts, "facts"))
    sizes = fact_sizes(kb.facts)
    states = Materialized(initial(queries), "states").df
    hooked = bool(o.state_hooks) or o.most_states is not None or o.most_frontier is not None
    once = not first and not hooked and _proofs_tell(kb, states, o)
    parts = []
    for depth in range(first, first + o.depth):
        children = expand(states, kb, o, depth, sizes)
        if o.prune_facts:
            children = filters.prune_facts(filters.numbered(children, "children"), kb.facts, excluded="excluded").drop("_n")
        if o.canonical:
            children = canonical_states(children)
        if not o.keep_evidence:
            children = children.withColumn("steps", F.array().cast(f"array<{STEP}>"))
        if hooked:
            children = children.dropDuplicates(["qid", "goals", "steps"])
            for hook in o.state_hooks:
                children = hook(children)
            children = ordered(children, "qid", o.most_states, ["goals", "steps"])
            if o.most_frontier is not None:
                children = children.orderBy("qid", "goals", "steps").limit(o.most_frontier)
        now = _distinct(filters.numbered(children, f"depth-{depth}"), ["qid", "goals", "steps"], f"depth-{depth}", hooked or (once and depth > first))
        done = F.size("goals") == 0
        complete = F.forall("steps", lambda s: all_ground(s["body"]) & (s["head"]["a0"] >= 0) & (s["head"]["a1"] >= 0))
        take = (done if o.collect == "terminal" else all_ground(F.col("goals"))) & complete
        counts = now.agg(F.count_if(take).alias("taken"), F.count_if(~done).alias("left")).first()
        collected = now.where(take).select("qid", "steps", F.lit(depth).alias("depth"), (F.col("_n") * o.depth + depth - first).alias("gid"))
        for hook in o.step_hooks:
            collected = hook(collected.drop("gid"), depth)
        if counts["taken"] or o.step_hooks:
            parts.append(collected)
        states = now.where(~done).drop("_n")
        if not counts["left"]:
            break
    if not parts:
        return filters.numbered(states.select("qid", "steps", F.lit(0).alias("depth")).limit(0), "groundings").withColumnRenamed("_n", "gid"), states
    found = reduce(DataFrame.unionByName, parts)
    if not o.step_hooks and o.most_groundings is None and ((once and o.collect == "terminal") or not _repeated(found, ["qid", "steps"])):
        return found, states
    best = found.groupBy("qid", "steps").agg(F.min("depth").alias("depth"))
    best = ordered(best, "qid", o.most_groundings, ["depth", "steps"])
    return filters.numbered(best, "groundings").withColumnRenamed("_n", "gid"), states


def _proofs_tell(kb: KnowledgeBase, states: DataFrame, o: Options) -> bool:
    """Whether a state's proof says how it was reached, so that after the first depth no state is reached twice.

    So it is if each query starts with one goal and no proof: all its bindings are then in the
    heads and bodies of its steps, and the depths of the steps tell which goals were facts.
    """
    if not o.keep_evidence or o.resolution != "sld" or o.prune_facts or o.canonical or o.fact_hooks or o.rule_hooks:
        return False
    if len({(r.rule_id, r.head, r.body) for r in kb.rules}) < len(kb.rules):
        return False
    odd = states.groupBy("qid").agg(F.count("*").alias("n"), F.max(F.size("goals")).alias("goals"), F.max(F.size("steps")).alias("steps"))
    return odd.where("n > 1 or goals > 1 or steps > 0").isEmpty()


def _repeated(rows: DataFrame, key: list[str]) -> bool:
    """Whether two rows may have one key; only two hashes of it are shuffled. No is certain."""
    hashes = rows.select(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit("key"), *key).alias("b"))
    return not spread(hashes, rows.count(), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _distinct(rows: DataFrame, key: list[str], name: str, known: bool) -> DataFrame:
    """Written ``rows`` with one of each key. They are wide and seldom repeated (never, if that is ``known``), so only then dealt out whole."""
    if known or not _repeated(rows, key):
        return rows
    return Materialized(rows.dropDuplicates(key), name).df


def canonical_states(states: DataFrame) -> DataFrame:
    """States whose goals and proofs are renamed together, to -1, -2, ... by first appearance, goals first."""
    atoms = F.concat("goals", F.flatten(F.transform("steps", lambda s: F.concat(F.array(s["head"]), s["body"]))))
    names = F.array_distinct(F.filter(F.flatten(F.transform(atoms, lambda a: F.array(a["a0"], a["a1"]))), lambda t: t < 0))

    def new(a: Column) -> Column:
        term = lambda t: F.when(t < 0, -F.array_position(F.col("_names"), t)).otherwise(t)
        return atom(a["pred"], term(a["a0"]), term(a["a1"]))

    steps = F.transform("steps", lambda s: F.struct(s["depth"].alias("depth"), s["rule_id"].alias("rule_id"), new(s["head"]).alias("head"), F.transform(s["body"], new).alias("body")))
    return states.withColumn("_names", names).withColumns({"goals": F.transform("goals", new), "steps": steps.cast(f"array<{STEP}>")}).drop("_names")


def answers(groundings: DataFrame) -> DataFrame:
    """Ground answers (qid, pred, s, o) of groundings with at least one rule: the first head."""
    head = F.element_at("steps", 1)["head"]
    return groundings.where(F.size("steps") > 0).select("qid", head["pred"].alias("pred"), head["a0"].alias("s"), head["a1"].alias("o")).distinct()


def proof_depth(kb: KnowledgeBase, queries: DataFrame, most: int, prune_facts: bool = False) -> DataFrame:
    """Per query the number of steps of its shortest proof, -1 if there is none within ``most``.

    States carry no proofs and are distinct by their goals up to names of variables, within a
    depth and across depths; queries that are proved leave the search. Across depths goals are
    known by two hashes, so what is kept of earlier depths is three numbers a state.
    """
    o = Options(depth=1, prune_facts=prune_facts, keep_evidence=False)
    kb = replace(kb, facts=materialize(kb.facts, "facts"))
    sizes = fact_sizes(kb.facts)
    states = Materialized(initial(queries), "states").df
    seen, found = None, None
    for depth in range(most):
        children = expand(states, kb, o, depth, sizes)
        if prune_facts:
            children = filters.prune_facts(filters.numbered(children, "children"), kb.facts, excluded="excluded").drop("_n")
        children = children.withColumn("goals", canonical_variables(F.col("goals"))).dropDuplicates(["qid", "goals"])
        children = children.withColumns({"_g": F.xxhash64("goals"), "_h": F.xxhash64(F.lit("goals"), "goals")})
        if seen is not None:
            children = children.join(seen, ["qid", "_g", "_h"], "left_anti")
        now = Materialized(children, f"depth-{depth}").df
        proved = now.where(F.size("goals") == 0).select("qid").distinct().withColumn("depth", F.lit(depth + 1))
        found = proved if found is None else found.unionByName(proved.join(found.select("qid"), "qid", "left_anti"))
        states = now.where(F.size("goals") > 0).join(proved.select("qid"), "qid", "left_anti").drop("_g", "_h")
        own = now.select("qid", "_g", "_h")
        seen = own if seen is None else seen.unionByName(own)
        if states.isEmpty():
            break
    return queries.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("depth", F.lit(-1)).alias("depth"))
