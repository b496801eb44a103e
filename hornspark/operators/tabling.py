"""Backward search with tables: complete on recursive rules, without a bound on the depth.

A call is a goal up to the names of its variables. Each call is made once; its clauses are
states of a search whose goals are resolved from the left. A goal whose predicate only facts
have is joined with them. Any other goal is a call of its own: its state becomes a consumer of
that call's table of answers, is resumed with those already there, and again with every answer
that a later round adds. The search ends when a round leaves no state: calls and answers are
finite, and a consumer meets an answer once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM, STEP, canonical_variables, ground
from hornspark.operators.backward import _bind_to_fact, rule_children
from hornspark.operators.lookups import kinds, matches
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized, Parts
from hornspark.plans.rules import rule_table

CALL = ["pred", "a0", "a1"]
ANSWER = [*CALL, "s", "o"]
STATE = ["call", "head", "goals"]
#: Rounds after which tables of many parts are written as one.
MERGE_ROUNDS = 8


@dataclass(frozen=True)
class Tables:
    """``calls`` (pred, a0, a1; variables are -1 and -2), their ``answers`` (the call, s, o), and the number of ``rounds``."""

    calls: DataFrame
    answers: DataFrame
    rounds: int


def variant(pred: Column, a0: Column, a1: Column) -> list[Column]:
    """The call of a goal: a first variable is -1, another one -2."""
    x = F.when(a0 < 0, -1).otherwise(a0)
    y = F.when(a1 >= 0, a1).when((a0 < 0) & (a0 != a1), -2).otherwise(-1)
    return [pred.cast("int").alias("pred"), x.cast("bigint").alias("a0"), y.cast("bigint").alias("a1")]


def _named(states: DataFrame) -> DataFrame:
    """States (call, head, goals) with variables by first appearance, without repetitions."""
    named = states.select("call", canonical_variables(F.concat(F.array("head"), "goals")).alias("_all"))
    return named.select("call", F.element_at("_all", 1).alias("head"), F.slice("_all", F.lit(2), F.size("_all") - 1).alias("goals")).distinct()


def _clauses(calls: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """The states that calls start with: one for each rule whose head unifies."""
    opened = calls.select(F.struct(*CALL).alias("qid"), F.array().cast(f"array<{STEP}>").alias("steps"), F.lit(None).cast(ATOM).alias("excluded"), *CALL, F.array().cast(f"array<{ATOM}>").alias("rest"))
    found = rule_children(opened, rule_table(kb.spark, kb.rules), 2, 0, keep=True)
    return found.select(F.col("qid").alias("call"), F.element_at("steps", 1)["head"].alias("head"), "goals")


def _opened(states: DataFrame, *more: str) -> DataFrame:
    """States by their first goal: pred, a0, a1. The head travels as a step, so that bindings reach it."""
    first = F.get("goals", F.lit(0))
    head = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("rule_id"), F.col("head"), F.array().cast(f"array<{ATOM}>").alias("body")).cast(STEP)
    return states.select(
        F.col("call").alias("qid"), F.array(head).alias("steps"), F.lit(None).cast(ATOM).alias("excluded"), *more,
        first["pred"].alias("pred"), first["a0"].alias("a0"), first["a1"].alias("a1"), F.slice("goals", F.lit(2), F.greatest(F.size("goals") - 1, F.lit(0))).alias("rest"),
    )


def _bound(found: DataFrame) -> DataFrame:
    """States whose first goal is bound to (fs, fo)."""
    return _bind_to_fact(found).select(F.col("qid").alias("call"), F.element_at("steps", 1)["head"].alias("head"), "goals")


def _waiting(states: DataFrame) -> DataFrame:
    """States as consumers, with the call ``wait`` whose answers they need."""
    first = F.get("goals", F.lit(0))
    return states.select(*STATE, F.struct(*variant(first["pred"], first["a0"], first["a1"])).alias("wait"))


def _resumed(consumers: DataFrame, answers: DataFrame) -> DataFrame:
    """Each consumer with each answer of the call that it waits for."""
    given = answers.select(F.struct(*CALL).alias("wait"), F.col("s").alias("fs"), F.col("o").alias("fo"))
    return _bound(_opened(consumers.join(given, "wait"), "fs", "fo"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Table(Parts):
    """A growing set of rows in written parts."""

    def __init__(self, name: str, key: list[str]):
        super().__init__(name, MERGE_ROUNDS)
        self.key = key

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Writes the distinct ``rows`` that aren't there yet and returns them, None if there are none."""
        new = rows.distinct()
        return super().add(new.join(self.rows.select(*self.key), self.key, "left_anti") if self else new)


def tabled(kb: KnowledgeBase, queries: DataFrame) -> Tables:
    """All calls that a batch of queries (pred, a0, a1) leads to, with all their answers.

    Rules whose head has a variable that their body lacks have no ground answers and give none.
    In the end only the tables of calls and answers are left in the shared folder.
    """
    heads = sorted(kb.heads)
    written = Materialized(kb.facts, "facts")
    facts, last = written.df, None
    calls, answers, consumers = _Table("calls", CALL), _Table("answers", ANSWER), _Table("consumers", STATE)
    fresh = calls.add(queries.select(*CALL).dropna().select(*variant(*map(F.col, CALL))))
    if fresh is None:
        written.drop()
        return Tables(queries.select(*CALL).limit(0), queries.select(*CALL, F.col("a0").alias("s"), F.col("a1").alias("o")).limit(0), 0)
    first = F.get("goals", F.lit(0))
    ours = first["pred"].isin(heads)
    states = None
    for rounds in count(1):
        found, going = [], []
        if states is not None:
            kind = states.select(first["pred"].alias("pred"), first["a0"].alias("a0"), first["a1"].alias("a1"))
            present = kinds(kind)  # a null predicate: no goal is left
            if any(p is None for p, _, _ in present):
                found.append(states.where((F.size("goals") == 0) & ground(F.col("head"))).select(*[F.col(f"call.{c}") for c in CALL], F.col("head.a0").alias("s"), F.col("head.a1").alias("o")))
            given = {k for k in present if k[0] is not None and k[0] not in heads}
            if given:
                going.append(_bound(matches(_opened(states.where((F.size("goals") > 0) & ~ours)), facts, present=given)))
        if fresh is not None:
            found.append(matches(fresh, facts, present=kinds(fresh)).select(*CALL, F.col("fs").alias("s"), F.col("fo").alias("o")))
            going.append(_clauses(fresh, kb))
        old = consumers.rows if consumers else None
        new_answers = answers.add(_union(found)) if found else None
        waiting = consumers.add(_waiting(states.where((F.size("goals") > 0) & ours))) if states is not None and any(k[0] in heads for k in present) else None
        fresh = calls.add(waiting.select("wait.*").distinct()) if waiting is not None else None
        if waiting is not None and answers:
            going.append(_resumed(waiting, answers.rows))
        if old is not None and new_answers is not None:
            going.append(_resumed(old, new_answers))
        now = Materialized(_named(_union(going)), "states") if going else None
        states = None if now is None or now.df.isEmpty() else now.df
        ended = states is None and fresh is None
        if last is not None:  # all that reads the last states is written
            last.drop()
        last = now
        for table in (calls, answers, consumers):
            table.sweep(last=ended)
        if ended:
            for table in (t for t in (now, consumers, written) if t is not None):
                table.drop()
            return Tables(calls.rows, answers.rows if answers else calls.rows.select(*CALL, F.col("a0").alias("s"), F.col("a1").alias("o")).limit(0), rounds)
    raise AssertionError("unreachable")


def answers(kb: KnowledgeBase, queries: DataFrame) -> DataFrame:
    """Answers (qid, pred, s, o) of a batch of queries (qid, pred, a0, a1), complete whatever the depth of their proofs."""
    q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
    q = q.select("qid", *CALL).dropna()
    found = tabled(kb, q).answers
    return q.select("qid", *variant(*map(F.col, CALL))).join(found, CALL).select("qid", "pred", "s", "o").distinct()
