"""Closures of linear chain rules by path doubling: rounds grow with the logarithm of the longest path.

``T(X,Y) :- E(X,Y)`` with ``T(X,Z) :- E(X,Y), T(Y,Z)`` or ``T(X,Z) :- T(X,Y), E(Y,Z)`` is the
transitive closure of E. All shortest paths of up to 2^k edges give those of up to 2^(k+1): one of
more than 2^k edges is one of just 2^k and a rest, so a round joins only the paths of 2^k edges
with all. The semi-naive rounds of ``forward_chain`` find an atom in the step of its shortest path
less one; that number comes along.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import atom
from hornspark.operators.forward import KEY, MERGE_ROUNDS, forward_chain, only
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Parts, materialize
from hornspark.plans.rules import Rule, local_frame, shape_of


@dataclass(frozen=True)
class Chain:
    """``head`` is the transitive closure of ``edge``, by a rule ``step`` of one atom and a rule ``more`` of two; head and edge tell chains apart."""

    head: int
    edge: int
    step: Rule | None = field(default=None, compare=False)
    more: Rule | None = field(default=None, compare=False)


def chains(rules: list[Rule]) -> list[Chain]:
    """Heads that are defined as transitive closures by just two rules, of an edge that no rule derives."""
    by_head: dict[int, list[Rule]] = defaultdict(list)
    for r in rules:
        by_head[r.head.pred].append(r)
    out = []
    for head, own in by_head.items():
        step = [r for r in own if len(r.body) == 1]
        more = [r for r in own if len(r.body) == 2]
        if len(own) != 2 or len(step) != 1 or len(more) != 1:
            continue
        edge = step[0].body[0].pred
        plain = shape_of(step[0])[0].head == (0, 1) and shape_of(step[0])[0].body == ((0, 1),)
        preds = tuple(b.pred for b in more[0].body)
        shape = shape_of(more[0])[0]
        linked = shape.head == (0, 1) and shape.body in (((0, 2), (2, 1)), ((2, 1), (0, 2)))
        # the atom from the head's subject comes first or second
        ordered = preds if shape.body[0] == (0, 2) else preds[::-1]
        if plain and linked and edge not in by_head and ordered in ((edge, head), (head, edge)):
            out.append(Chain(head, edge, step[0], more[0]))
    return out


def double(edges: DataFrame) -> tuple[DataFrame, int]:
    """All (pred, s, o, n) with the ``n`` edges of the shortest path from s to o along edges (pred, s, o), and the rounds."""
    first = edges.select(*KEY).distinct().withColumn("n", F.lit(1).cast("bigint"))
    found, rounds = Parts("paths", MERGE_ROUNDS), 0
    longest = found.add(first)
    if longest is None:
        return first.limit(0), 0
    while longest is not None and not longest.isEmpty():
        known = found.rows
        tail = known.select("pred", F.col("s").alias("_m"), F.col("o").alias("_o"), F.col("n").alias("_n"))
        far = longest.withColumnRenamed("o", "_m").join(tail, ["pred", "_m"]).groupBy("pred", "s", F.col("_o").alias("o")).agg(F.min(F.col("n") + F.col("_n")).alias("n"))
        new = found.add(far.join(known.select(*KEY), KEY, "left_anti"))
        found.sweep()
        rounds += 1
        longest = None if new is None else new.where(F.col("n") == 2**rounds)
    found.sweep(last=True)
    return found.rows, rounds


def _proofs(chain: Chain, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``paths`` (pred, s, o, n) of a chain with ``w``, the least (rule_id, body) that gives an atom from a path shorter by one edge."""
    e = edges.where(F.col("pred") == chain.head).select("s", "o")
    own = paths.where(F.col("pred") == chain.head)
    near = own.where("n = 1").withColumn("w", F.struct(F.lit(chain.step.rule_id).alias("rule_id"), F.array(atom(F.lit(chain.edge), F.col("s"), F.col("o"))).alias("body")))
    ends = [(b.pred == chain.edge, (b.a0, b.a1)) for b in chain.more.body]
    start = chain.more.head.a0
    edge_first = next(is_edge for is_edge, terms in ends if terms[0] == start)  # whether the edge leaves the head's subject
    part = own.select(F.col("s").alias("_s"), F.col("o").alias("_o"), (F.col("n") + 1).alias("n"))
    link = e.select(F.col("s").alias("_x"), F.col("o").alias("_y"))
    if edge_first:
        both = part.join(link, F.col("_s") == F.col("_y")).select(F.col("_x").alias("s"), F.col("_o").alias("o"), "n", F.col("_s").alias("_m"))
        atoms = {True: atom(F.lit(chain.edge), F.col("s"), F.col("_m")), False: atom(F.lit(chain.head), F.col("_m"), F.col("o"))}
    else:
        both = part.join(link, F.col("_o") == F.col("_x")).select(F.col("_s").alias("s"), F.col("_y").alias("o"), "n", F.col("_o").alias("_m"))
        atoms = {True: atom(F.lit(chain.edge), F.col("_m"), F.col("o")), False: atom(F.lit(chain.head), F.col("s"), F.col("_m"))}
    body = F.array(*[atoms[is_edge] for is_edge, _ in ends])
    far = both.join(own.where("n > 1").select("s", "o", "n"), ["s", "o", "n"]).groupBy("s", "o", "n").agg(F.min(F.struct(F.lit(chain.more.rule_id).alias("rule_id"), body.alias("body"))).alias("w"))
    return near.select(*KEY, "n", "w").unionByName(far.select(F.lit(chain.head).alias("pred"), "s", "o", "n", "w"))


@dataclass(frozen=True)
class Apart:
    """A knowledge base whose ``chains`` are closed by doubling; ``rest`` has the other rules."""

    kb: KnowledgeBase
    chains: list[Chain]
    rest: list[Rule]

    def closure(self, witness: bool) -> DataFrame:
        names = local_frame(self.kb.spark, [(c.edge, c.head) for c in self.chains], "edge int, head int")
        edges = materialize(only(self.kb.facts, {c.edge for c in self.chains}).join(F.broadcast(names), F.col("pred") == F.col("edge")).select(F.col("head").alias("pred"), "s", "o"), "edges")
        paths, _ = double(edges)
        if witness:
            paths = reduce(DataFrame.unionByName, [_proofs(c, edges, paths) for c in self.chains])
        closed = paths.select(*KEY, (F.col("n") - 1).cast("int").alias("step"), F.lit(False).alias("is_base"), *(["w"] if witness else []))
        return closed if not self.rest else forward_chain(replace(self.kb, rules=self.rest), witness=witness).unionByName(closed)


def long_chains(kb: KnowledgeBase) -> Apart | None:
    """The transitive closures that can be told apart from the other rules: no other rule reads them, and they have no facts."""
    found = [c for c in chains(kb.rules) if not any(b.pred == c.head for r in kb.rules if r.head.pred != c.head for b in r.body)]
    if not found:
        return None
    given = {r["pred"] for r in only(kb.facts, {c.head for c in found}).select("pred").distinct().collect()}  # heads of rules at most
    found = [c for c in found if c.head not in given]
    return Apart(kb, found, [r for r in kb.rules if r.head.pred not in {c.head for c in found}]) if found else None


def forward_chain_doubling(kb: KnowledgeBase) -> DataFrame:
    """Derived atoms (pred, s, o, step, is_base) as ``forward_chain`` gives them, transitive closures by doubling.

    The other rules follow by ``forward_chain`` over facts and closures; where a body has an atom
    of such a closure, their steps count from there on. Closures whose head has facts too are
    left to it altogether.
    """
    found = chains(kb.rules)
    given = {r["pred"] for r in only(kb.facts, {c.head for c in found}).select("pred").distinct().collect()} if found else set()  # heads of rules at most
    found = [c for c in found if c.head not in given]
    if not found:
        return forward_chain(kb).select(*KEY, "step", "is_base")
    names = local_frame(kb.spark, [(c.edge, c.head) for c in found], "edge int, head int")
    edges = only(kb.facts, {c.edge for c in found}).join(F.broadcast(names), F.col("pred") == F.col("edge")).select(F.col("head").alias("pred"), "s", "o")
    paths, _ = double(edges)
    closed = paths.select(*KEY, (F.col("n") - 1).cast("int").alias("step"), F.lit(False).alias("is_base"))
    rest = [r for r in kb.rules if r.head.pred not in {c.head for c in found}]
    if not rest:
        return closed
    more = forward_chain(replace(kb, facts=kb.facts.select(*KEY).unionByName(paths.select(*KEY)), rules=rest))
    return closed.unionByName(more.select(*closed.columns))
