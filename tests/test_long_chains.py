"""The fixpoint of transitive closures takes few rounds, with the steps and witnesses of one round a step."""

import random

import pytest

from hornspark.operators import filters, forward, magic
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.rules import encode_rule, parse_rule

NAMES = {"e": 1, "t": 2, "g": 3, "h": 4}
RIGHT = ["t(X,Y) :- e(X,Y)", "t(X,Z) :- e(X,Y), t(Y,Z)", "h(Y,X) :- g(X,Y)"]
LEFT = ["t(X,Z) :- e(Y,Z), t(X,Y)", "t(X,Y) :- e(X,Y)", "h(Y,X) :- g(X,Y)"]


def base(spark, lines, edges):
    rows = [(1, a, b) for a, b in edges] + [(3, 1, 2)]
    return KnowledgeBase(spark.createDataFrame(rows, "pred int, s bigint, o bigint"), [encode_rule(parse_rule(x, "x"), i + 1, NAMES, {}) for i, x in enumerate(lines)], NAMES)


@pytest.mark.parametrize("lines", [RIGHT, LEFT])
def test_doubled_closures_are_those_of_single_steps(spark, lines):
    rng = random.Random(4)
    kb = base(spark, lines, {(rng.randrange(12), rng.randrange(12)) for _ in range(16)})
    want = forward.forward_chain(kb, 14, witness=True)  # a bound goes step by step
    got = forward.forward_chain(kb, witness=True)
    cols = ["pred", "s", "o", "step", "is_base", "w"]
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    calls, own = [], forward.apply_rules
    monkeypatch.setattr(forward, "apply_rules", lambda *a, **b: calls.append(1) or own(*a, **b))
    found = forward.forward_chain(base(spark, RIGHT, [(i, i + 1) for i in range(70)]))
    assert found.where("pred = 2").count() == 70 * 71 // 2 and len(calls) <= 4
    assert found.where("pred = 2 and step <> o - s - 1").isEmpty()


@pytest.mark.parametrize("most", [2, 0])
@pytest.mark.parametrize("lines", [RIGHT, LEFT])
def test_walked_answers_are_those_of_the_closure(spark, lines, most, monkeypatch):
    monkeypatch.setattr(magic, "MOST_WALKS", most)  # 0: walks never double
    monkeypatch.setattr(magic, "magic_chain", None)  # no round of a rewritten program
    rng = random.Random(6)
    kb = base(spark, lines, {(rng.randrange(12), rng.randrange(12)) for _ in range(16)} | {(i, i + 1) for i in range(20, 40)})
    closed = {(r["s"], r["o"]) for r in forward.forward_chain(kb).where("pred = 2").collect()}
    goals = [(1, 2, 20, -1), (2, 2, 3, -1), (3, 2, -1, 40), (4, 2, -1, 5), (5, 2, 20, -2)]
    got = {tuple(r) for r in magic.answers(kb, spark.createDataFrame(goals, "qid bigint, pred int, a0 bigint, a1 bigint")).collect()}
    assert got == {(n, 2, s, o) for n, _, a, b in goals for s, o in closed if a in (s, -1) and (b < 0 or b == o)}


def test_support_follows_chains_in_few_rounds(spark, monkeypatch):
    written, own = [], filters.Materialized
    monkeypatch.setattr(filters, "Materialized", lambda df, name: written.append(name) or own(df, name))
    step = lambda h, *b: (0, 1, (2, h, h), [(2, x, x) for x in b])
    proofs = [[(0, 1, (2, 0, 0), [(1, 0, 0)])], *[[step(i + 1, i)] for i in range(60)]]  # a chain on a fact
    proofs += [[step(100, 101)], [step(101, 102)], [step(102, 100)], [step(103, 102)]]  # a circle, and what rests on it
    proofs += [[step(200, 30, 60)], [step(201, 30, 103)], [step(202, 103)], [step(202, 60)], [step(203, 202)], [step(204, 999)]]
    rows = spark.createDataFrame(list(enumerate(proofs)), "gid bigint, steps array<struct<depth:int,rule_id:int,head:struct<pred:int,a0:bigint,a1:bigint>,body:array<struct<pred:int,a0:bigint,a1:bigint>>>>")
    facts = spark.createDataFrame([(1, 0, 0)], "pred int, s bigint, o bigint")
    got = {r["gid"] for r in filters.fp_batch(rows, facts).select("gid").collect()}
    assert got == {*range(61), 65, 68, 69} and written.count("hits") <= 5
    assert {r["gid"] for r in filters.fp_batch(rows, facts, rounds=3).select("gid").collect()} == {0, 1, 2, 3}
