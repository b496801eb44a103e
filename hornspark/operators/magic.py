"""Goal-directed forward chaining: the program is rewritten for the bindings of the queries.

A predicate is adorned with which of its arguments are bound when it is called. Bindings pass
from a rule's head along its body, atoms with more bound arguments first. Each adorned predicate
has a magic predicate, whose atoms are the bindings that are asked for: a rule fires only for
those, and the atoms before a body atom say for which bindings that one is asked. The queries'
constants seed the magic predicates, and the usual fixpoint of the rewritten rules derives the
answers of all queries of a batch, and little else. From one bound end of a transitive closure
of facts the answers are walked instead, in steps that double, so that rounds do not grow with its
longest path.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.operators.forward import KEY, forward_chain
from hornspark.operators.doubling import chains
from hornspark.operators.lookups import kinds, matches
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, Parts
from hornspark.plans.rules import Atom, Rule, shape_of

#: A predicate with whether its first and its second argument are bound.
Adorned = tuple[int, bool, bool]
#: Both arguments of the magic atom of a predicate without bound arguments.
NOTHING = 0


@dataclass
class Program:
    """Rewritten ``rules``; ``answers`` and ``magic`` are the numbers of the adorned predicates and of their magic ones."""

    rules: list[Rule] = field(default_factory=list)
    answers: dict[Adorned, int] = field(default_factory=dict)
    magic: dict[Adorned, int] = field(default_factory=dict)


def magic_terms(a: Adorned, a0, a1) -> tuple:
    """The arguments of a magic atom: the bound ones; a single one stands twice."""
    return {(True, True): (a0, a1), (True, False): (a0, a0), (False, True): (a1, a1), (False, False): (NOTHING, NOTHING)}[a[1:]]


def rewrite(rules: list[Rule], goals: set[Adorned], stored: set[int] | None = None) -> Program:
    """The magic program of ``rules`` for queries of these kinds.

    ``stored``: predicates that may have facts (None: any); facts of a predicate that rules
    derive too are answers of their own.
    """
    heads = {r.head.pred for r in rules}
    number = max([0, *(p for p, _, _ in goals), *(stored or ()), *(a.pred for r in rules for a in (r.head, *r.body))])
    out = Program()
    todo: list[Adorned] = []

    def adorned(a: Adorned) -> int:
        nonlocal number
        if a not in out.answers:
            out.answers[a], out.magic[a] = number + 1, number + 2
            number += 2
            todo.append(a)
        return out.answers[a]

    def add(head: Atom, body: list[Atom], weight: float = 1.0) -> None:
        if body != [head]:
            out.rules.append(Rule(len(out.rules) + 1, head, tuple(body), weight))

    for a in sorted(goals):
        if a[0] in heads:
            adorned(a)
    while todo:
        a = todo.pop(0)
        if stored is None or a[0] in stored:
            add(Atom(out.answers[a], -1, -2), [Atom(out.magic[a], *magic_terms(a, -1, -2)), Atom(a[0], -1, -2)])
        for r in (r for r in rules if r.head.pred == a[0]):
            shape, _ = shape_of(r)
            asked = Atom(out.magic[a], *magic_terms(a, r.head.a0, r.head.a1))
            bound = {t for t, b in zip((r.head.a0, r.head.a1), a[1:], strict=True) if b and t < 0}
            slots = frozenset(s for s, b in zip(shape.head, a[1:], strict=True) if b and s >= 0)
            body = [asked]
            for i in shape.order(None, slots):
                x = r.body[i]
                if x.pred in heads:
                    own = (x.pred, x.a0 >= 0 or x.a0 in bound, x.a1 >= 0 or x.a1 in bound)
                    pred = adorned(own)
                    add(Atom(out.magic[own], *magic_terms(own, x.a0, x.a1)), list(body))
                    x = Atom(pred, x.a0, x.a1)
                body.append(x)
                bound |= {t for t in (x.a0, x.a1) if t < 0}
            add(Atom(out.answers[a], r.head.a0, r.head.a1), body, r.weight)
    return out


def seeds(queries: DataFrame, program: Program) -> DataFrame:
    """The magic atoms of the queries' constants."""
    parts = []
    for a, number in program.magic.items():
        own = queries.where((F.col("pred") == a[0]) & ((F.col("a0") >= 0) == a[1]) & ((F.col("a1") >= 0) == a[2]))
        s, o = magic_terms(a, F.col("a0"), F.col("a1"))
        parts.append(own.select(F.lit(number).alias("pred"), *((F.lit(x) if isinstance(x, int) else x).cast("bigint").alias(n) for x, n in ((s, "s"), (o, "o")))))
    return reduce(DataFrame.unionByName, parts).distinct()


def magic_chain(kb: KnowledgeBase, queries: DataFrame) -> tuple[DataFrame, Program]:
    """All atoms (pred, s, o, step, is_base) that the rewritten program derives for a batch of queries, and the program.

    Queries have pred, a0 and a1 (negative: a variable) and maybe active; rows with a null argument are left out.
    """
    q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
    q = q.select("pred", "a0", "a1").dropna().distinct()
    stored = {r["pred"] for r in kb.facts.where(F.col("pred").isin(sorted(kb.heads))).select("pred").distinct().collect()}  # at most the rules' heads
    program = rewrite(kb.rules, kinds(q), stored)
    if not program.rules:
        return forward_chain(replace(kb, facts=kb.facts.limit(0))), program
    used = {b.pred for r in program.rules for b in r.body} - set(program.answers.values()) - set(program.magic.values())
    facts = kb.facts.where(F.col("pred").isin(sorted(used)))
    own = KnowledgeBase(facts.select(*KEY).unionByName(seeds(q, program)), program.rules, kb.predicates)
    return forward_chain(own), program


#: Walks of twice as many edges are made while there are at most so many times as many as edges.
MOST_WALKS = 2


def walked(seeds_: DataFrame, edges: DataFrame) -> DataFrame:
    """All (x, y) with a path of one edge or more from a seed (x) to y along edges (x, y), in written form.

    A round adds what is a walk of 2^k edges further than the last one's; these walks double
    with each round, while they don't outgrow the edges (in a tree or a chain they never do).
    """
    step = Materialized(edges.select("x", "y").distinct(), "walks")
    n_edges, doubles = step.df.count(), True
    found, rounds = Parts("walked", 8), 0
    last = found.add(seeds_.select("x").distinct().join(step.df, "x").distinct())
    if last is None:
        return edges.select("x", "y").limit(0)
    while last is not None:
        far = step.df.select(F.col("x").alias("y"), F.col("y").alias("z"))
        # walks that doubled reach what is new from all that is known, others from the last round's
        source = found.rows if doubles else last
        new = source.join(far, "y").select("x", F.col("z").alias("y")).distinct().join(found.rows, ["x", "y"], "left_anti")
        last = found.add(new)
        found.sweep()
        rounds += 1
        if doubles and last is not None:
            twice = Materialized(step.df.join(far, "y").select("x", F.col("z").alias("y")).distinct(), "walks")
            if twice.df.count() > MOST_WALKS * n_edges:
                twice.drop()
                doubles = False
            else:
                step.drop()
                step = twice
    found.sweep(last=True)
    step.drop()
    return found.rows


def _walked_answers(kb: KnowledgeBase, q: DataFrame, asked: Adorned) -> DataFrame | None:
    """The answers of queries that bind one argument of a transitive closure of facts; None if they ask for something else."""
    chain = next((c for c in chains(kb.rules) if c.head == asked[0]), None)
    if chain is None or asked[1] == asked[2] or not kb.facts.where(F.col("pred") == chain.head).isEmpty():
        return None
    bound, free = ("s", "o") if asked[1] else ("o", "s")
    arg = "a0" if asked[1] else "a1"
    own = q.where((F.col("pred") == asked[0]) & ((F.col("a0") >= 0) == asked[1]) & ((F.col("a1") >= 0) == asked[2])).select("qid", F.col(arg).alias("x"))
    edges = kb.facts.where(F.col("pred") == chain.edge).select(F.col(bound).alias("x"), F.col(free).alias("y"))
    pairs = own.join(walked(own, edges), "x").select("qid", F.lit(chain.head).alias("pred"), F.col("x").alias(bound), F.col("y").alias(free))
    return pairs.select("qid", "pred", "s", "o")


def answers(kb: KnowledgeBase, queries: DataFrame) -> DataFrame:
    """Answers (qid, pred, s, o) of a batch of queries (qid, pred, a0, a1), complete whatever the depth of their proofs.

    Facts that a query matches are answers too. Each query is joined with the atoms of its own
    adornment only, on its bound arguments.
    """
    q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
    q = q.select("qid", "pred", "a0", "a1").dropna()
    present, apart = kinds(q), []
    for a in sorted(present):
        own = _walked_answers(kb, q, a)
        if own is not None:
            apart.append(own)
            present = present - {a}
            q = q.where(~((F.col("pred") == a[0]) & ((F.col("a0") >= 0) == a[1]) & ((F.col("a1") >= 0) == a[2])))
    if apart and not present:
        return reduce(DataFrame.unionByName, apart).distinct()
    derived, program = magic_chain(kb, q)
    given = matches(q, kb.facts, present={a for a in present if a not in program.answers})
    parts = [given.select("qid", "pred", F.col("fs").alias("s"), F.col("fo").alias("o"))]
    for a in present & set(program.answers):
        atoms = derived.where(F.col("pred") == program.answers[a]).select(F.lit(a[0]).alias("pred"), "s", "o")
        found = matches(q.where((F.col("pred") == a[0]) & ((F.col("a0") >= 0) == a[1]) & ((F.col("a1") >= 0) == a[2])), atoms, present={a})
        parts.append(found.select("qid", "pred", F.col("fs").alias("s"), F.col("fo").alias("o")))
    return reduce(DataFrame.unionByName, [*parts, *apart]).distinct()
