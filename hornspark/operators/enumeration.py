"""Grounding by enumeration: instances of rules over a shared table of goals, with a width.

The width bounds how many body atoms of an instance may be unproved. For each choice of the
unproved atoms the others are joined with the facts and the chosen ones anti-joined, so each
instance comes from exactly one choice. Unproved atoms are the goals of the next depth. Where any
number may be unproved and every variable has a domain, the choices together are the goals times
the candidates; at the last depth they are made at once, without the facts.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM
from hornspark.operators.filters import prune_instances
from hornspark.operators.forward import only
from hornspark.operators.joins import body_of, extend, value
from hornspark.operators.lookups import FEW
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import materialize, spread
from hornspark.plans.rules import Rule, Shape, by_shape, local_frame, shape_of, shape_table

KEY = ["pred", "s", "o"]
#: Candidates up to which they are broadcast; more are cut into pieces of this size.
BROADCAST_MEMBERS = 100_000
#: Parts into which rows are dealt where candidates aren't broadcast; each piece goes to every part.
PARTS = 64
#: The candidates of a variable whose arguments have no domain.
ANY = "*"


@dataclass(frozen=True)
class Domains:
    """``members`` (domain, entity), and of each predicate the domains of its arguments (None: any entity).

    A variable's candidates are the entities that are in the domains of all arguments where its
    rule has it.
    """

    members: DataFrame
    arguments: dict[int, tuple[str | None, str | None]] = field(default_factory=dict)

    @staticmethod
    def of(domain: DataFrame) -> Domains:
        """One domain (entity) for all."""
        return Domains(domain.select(F.lit(ANY).alias("domain"), "entity"))

    def names(self, rule: Rule, shape: Shape, slot: int) -> str:
        """The domains of a variable of a rule, joined by ``&``."""
        atoms = [(rule.head.pred, shape.head), *zip((b.pred for b in rule.body), shape.body, strict=True)]
        found = {self.arguments.get(p, (None, None))[i] for p, slots in atoms for i, v in enumerate(slots) if v == slot} - {None}
        return "&".join(sorted(found)) or ANY

    def typed(self, rule: Rule, shape: Shape) -> bool:
        """Whether each variable that only the body has is in a domain."""
        return all(self.names(rule, shape, v) != ANY for v in _variables(shape) - set(shape.head))

    def needed_for(self, rules: list[Rule]) -> Domains:
        """Without the members that these rules don't ask for."""
        shapes = [(r, shape_of(r)[0]) for r in rules]
        if not all(self.typed(r, shape) for r, shape in shapes):
            return self
        wanted = {n for r, shape in shapes for v in _variables(shape) for n in self.names(r, shape, v).split("&")}
        return replace(self, members=self.members.where(F.col("domain").isin(sorted(wanted))))

    def candidates(self, names: set[str]) -> DataFrame:
        """(names, entity): the entities that are in all of the domains."""
        every = self.members.select("domain", "entity").distinct()
        parts = []
        for n in sorted(names):
            if n == ANY:
                own = every.select("entity").distinct()
            else:
                wanted = n.split("&")
                own = every.where(F.col("domain").isin(wanted)).groupBy("entity").count().where(F.col("count") == len(wanted)).select("entity")
            parts.append(own.select(F.lit(n).alias("_names"), "entity"))
        return reduce(DataFrame.unionByName, parts)

    def _named(self, now: DataFrame, shape: Shape, group: Sequence[tuple[Rule, list[int]]], slot: int) -> tuple[DataFrame, set[str]]:
        names = {r.rule_id: self.names(r, shape, slot) for r, _ in group}
        return now.join(F.broadcast(local_frame(now.sparkSession, sorted(names.items()), "rule_id int, _names string")), "rule_id"), set(names.values())

    def check(self, now: DataFrame, shape: Shape, group: Sequence[tuple[Rule, list[int]]], slot: int) -> DataFrame:
        """Rows whose binding of a variable is among its candidates."""
        rows, names = self._named(now, shape, group, slot)
        if names == {ANY}:
            return now
        found = self.candidates(names - {ANY}).select(F.col("_names").alias("_d"), F.col("entity").alias("_e"), F.lit(True).alias("_in"))  # each once, so no row is doubled
        kept = rows.join(found, (F.col("_names") == F.col("_d")) & (F.col(value(slot)) == F.col("_e")), "left")
        return kept.where((F.col("_names") == ANY) | F.col("_in")).drop("_names", "_d", "_e", "_in")

    def bind(self, now: DataFrame, shape: Shape, group: Sequence[tuple[Rule, list[int]]], slot: int, n_rows: int = 0) -> DataFrame:
        """Each row with each candidate of a variable.

        The result has rows times candidates, whatever the plan. Few candidates are broadcast,
        and if there are ``n_rows`` at most, these are dealt out by the size of the result.
        More are cut into pieces: a row meets each piece in the part that it was dealt to.
        """
        rows, names = self._named(now, shape, group, slot)
        found = materialize(self.candidates(names).withColumnRenamed("entity", value(slot)), "candidates")
        n = found.count()
        if n <= BROADCAST_MEMBERS:
            rows = spread(rows, n_rows * n, *now.columns)
            return rows.join(F.broadcast(found), "_names").drop("_names")
        pieces = math.ceil(n / BROADCAST_MEMBERS)
        cells = found.withColumn("_piece", F.pmod(F.xxhash64(value(slot)), F.lit(pieces))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*now.columns), F.lit(PARTS)).cast("int")).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))))
        # compressed they may look small enough to be broadcast, which they aren't
        return dealt.join(cells.hint("merge"), ["_names", "_part", "_piece"]).drop("_names", "_part", "_piece")


def _variables(shape: Shape) -> set[int]:
    return {v for slots in (shape.head, *shape.body) for v in slots if v >= 0}


def step(kb: KnowledgeBase, goals: DataFrame, width: int | None, domain: DataFrame | Domains | None = None, skipped: list | None = None, last: bool = False) -> DataFrame:
    """Instances (rule_id, pred, s, o, body, unknown) for ground goals (pred, s, o), written choice by choice so that plans stay short.

    ``unknown`` has the body atoms that aren't facts, at most ``width`` (None: any number); each
    of them has a predicate that heads a rule (unless the width is None), and no body atom is
    the goal itself. A variable that only unproved atoms hold ranges over ``domain``: a table
    (entity) of all, or ``Domains``, which the other variables have to fit too. Without one,
    such choices are left out and their rules noted in ``skipped``. ``last``: ``unknown`` isn't
    asked for; it is null where telling it would be all that the facts are needed for.
    """
    parts = []
    domain = Domains.of(domain) if isinstance(domain, DataFrame) else domain
    g = goals.select(F.col("pred").alias("gp"), F.col("s").alias("gs"), F.col("o").alias("go"))
    asked = {r["gp"]: r["n"] for r in g.groupBy("gp").agg(F.count("*").alias("n")).collect()}  # at most the predicates; rules without goals need no candidates
    sizes: dict[int, int] | None = None
    for shape, every in by_shape([r for r in kb.rules if r.head.pred in asked]).items():
        whole = [x for x in every if last and width is None and domain is not None and domain.typed(x[0], shape)]
        if whole:
            parts.append(_whole(kb, shape, whole, g, sum(asked[r.head.pred] for r, _ in whole), domain))
        group = [x for x in every if x not in whole]
        if not group:
            continue
        if sizes is None:
            sizes = {r["pred"]: r["n"] for r in kb.facts.groupBy("pred").agg(F.count("*").alias("n")).collect()}  # one row per predicate
        m = len(shape.body)
        for size in range(m + 1 if width is None else min(width, m) + 1):
            for chosen in combinations(range(m), size):
                rest = tuple(i for i in range(m) if i not in chosen)
                own = [(r, c) for r, c in group if width is None or all(r.body[i].pred in kb.heads for i in chosen)]
                bound = {v for slots in (shape.head, *(shape.body[i] for i in rest)) for v in slots}
                if domain is None and {v for i in chosen for v in shape.body[i] if v >= 0} - bound:
                    if skipped is not None:
                        skipped += [r.rule_id for r, _ in own]
                    continue
                own = [(r, c) for r, c in own if all(sizes.get(r.body[i].pred) for i in rest)]
                if own:
                    parts.append(materialize(_choice(kb, shape, own, g, chosen, rest, domain, sizes), "choice"))
    if not parts:
        return kb.spark.createDataFrame([], "rule_id int, pred int, s bigint, o bigint, body array<struct<pred:int,a0:bigint,a1:bigint>>, unknown array<struct<pred:int,a0:bigint,a1:bigint>>")
    return reduce(DataFrame.unionByName, parts)


def _heads(kb: KnowledgeBase, shape: Shape, group: list, goals: DataFrame) -> tuple[DataFrame, set[int]]:
    """The goals with the rules for them, and the variables that they bind."""
    now = goals.join(F.broadcast(shape_table(kb.spark, shape, group, kb.heads)), F.col("gp") == F.col("hp"))
    bound: set[int] = set()
    for slot, col in zip(shape.head, ("gs", "go"), strict=True):
        if slot < 0 or slot in bound:
            now = now.where(F.col(value(slot)) == F.col(col))
        else:
            now = now.withColumn(value(slot), F.col(col))
            bound.add(slot)
    return now, bound


def _instances(now: DataFrame, shape: Shape, unknown) -> DataFrame:
    """Rows with all variables bound as instances, without those that have their goal as a body atom."""
    for i, (a, b) in enumerate(shape.body):
        now = now.where(~((F.col(f"p{i}") == F.col("gp")) & (F.col(value(a)) == F.col("gs")) & (F.col(value(b)) == F.col("go"))))
    return now.select("rule_id", F.col("gp").alias("pred"), F.col("gs").alias("s"), F.col("go").alias("o"), body_of(shape).alias("body"), unknown.alias("unknown"))


def _whole(kb: KnowledgeBase, shape: Shape, group: list, goals: DataFrame, n_goals: int, domain: Domains) -> DataFrame:
    """All instances of rules whose variables are in domains, whichever atoms are unproved: the ``n_goals`` goals of the rules times the candidates."""
    now, bound = _heads(kb, shape, group, goals)
    for v in sorted(bound):
        now = domain.check(now, shape, group, v)
    for v in sorted(_variables(shape) - bound):
        now, n_goals = domain.bind(now, shape, group, v, n_goals), 0  # dealt out once
    return _instances(now, shape, F.lit(None).cast(f"array<{ATOM}>"))


def _choice(kb: KnowledgeBase, shape: Shape, group: list, goals: DataFrame, chosen: tuple[int, ...], rest: tuple[int, ...], domain: Domains | None, sizes: dict[int, int]) -> DataFrame:
    """The instances in which just the ``chosen`` atoms are unproved. Each atom meets the facts of its predicates only, of which there are ``sizes``; few are broadcast."""

    def source(i: int) -> DataFrame:
        preds = {r.body[i].pred for r, _ in group}
        found = only(kb.facts, preds)
        return F.broadcast(found) if sum(sizes.get(p, 0) for p in preds) <= FEW else found

    now, bound = _heads(kb, shape, group, goals)
    for i in shape.order(None, frozenset(bound), rest):
        now = extend(now, shape, i, source(i), bound)
    if domain is not None:
        for v in sorted(bound):
            now = domain.check(now, shape, group, v)
    for v in sorted({v for i in chosen for v in shape.body[i] if v >= 0} - bound):
        now = domain.bind(now, shape, group, v)
    for i in chosen:
        a, b = shape.body[i]
        if any(sizes.get(r.body[i].pred) for r, _ in group):
            f = source(i).select(F.col("pred").alias("_p"), F.col("s").alias("_s"), F.col("o").alias("_o"))
            now = now.join(f, (F.col(f"p{i}") == F.col("_p")) & (F.col(value(a)) == F.col("_s")) & (F.col(value(b)) == F.col("_o")), "left_anti")
    body = body_of(shape)
    return _instances(now, shape, F.array(*[body[i] for i in chosen]) if chosen else F.slice(body, 1, 0))


def _met(rules: list[Rule], predicates: set[int], depth: int) -> list[Rule]:
    """Rules that goals of these predicates can use in so many steps."""
    met: set[int] = set()
    for _ in range(depth):
        now = [i for i, r in enumerate(rules) if r.head.pred in predicates]
        met.update(now)
        predicates = {b.pred for i in now for b in rules[i].body}
    return [rules[i] for i in sorted(met)]


def enumerate_groundings(kb: KnowledgeBase, queries: DataFrame, depth: int = 1, width: int | None = 1, last_width: int | None = 0, domain: DataFrame | Domains | None = None, skipped: list | None = None) -> DataFrame:
    """Distinct instances (rule_id, pred, s, o, body, depth) of rules that a batch of ground queries needs.

    Goals are shared by the batch: a goal is expanded once, at the depth where it first appears.
    ``last_width`` holds at the last depth (0: only facts). Variables that only unproved atoms hold
    range over ``domain`` (see ``step``); without one, a warning names the rules of which choices
    are left out, and ``skipped`` gets them.
    """
    left_out: list[int] = []
    kb = replace(kb, facts=materialize(kb.facts, "facts"))
    domain = Domains.of(domain) if isinstance(domain, DataFrame) else domain
    goals = materialize(queries.select(*KEY).distinct(), "goals")
    if domain is not None:
        asked = {r["pred"] for r in goals.select("pred").distinct().collect()}  # at most the predicates
        domain = domain.needed_for(_met(kb.rules, asked, depth))
        domain = replace(domain, members=materialize(domain.members, "domains"))
    seen, found = goals, None
    for d in range(depth):
        w = last_width if d == depth - 1 else width
        now = step(kb, goals, w, domain, left_out, last=d == depth - 1)
        part = now.select("rule_id", *KEY, "body", F.lit(d).alias("depth"))
        found = part if found is None else found.unionByName(part)
        if d < depth - 1:
            fresh = now.select(F.explode("unknown").alias("a")).select(F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o")).distinct()
            goals = materialize(fresh.join(seen, KEY, "left_anti"), "goals")
            seen = seen.unionByName(goals)
    if left_out:
        warnings.warn(f"without a domain, choices of the rules {sorted(set(left_out))} are left out", stacklevel=2)
        if skipped is not None:
            skipped += sorted(set(left_out))
    return found


def sound(kb: KnowledgeBase, found: DataFrame) -> DataFrame:
    """Instances whose bodies follow from facts and other kept instances."""
    return prune_instances(found, kb.facts)
