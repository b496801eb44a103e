"""Instances of rules over typed variables are the goals times the candidates: no choice of unproved atoms is joined with the facts."""

from itertools import product

import pytest

from hornspark.operators import enumeration, forward
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import materialize
from hornspark.plans.rules import encode_rule, parse_rule

NAMES = {"p": 1, "q": 2, "h": 3, "k": 4, "none": 5}
RULES = ["h(X,Y) :- p(X,Z), q(Z,W)", "k(X,Y) :- p(X,Y), none(Y,Z)", "k(X,Y) :- p(X,Z), k(Z,Y)", "h(X,X) :- p(X,X)"]
FACTS = [(1, 1, 2), (1, 1, 12), (1, 2, 2), (2, 2, 3), (2, 12, 3), (2, 12, 4), (3, 3, 4), (4, 1, 2)]
GOALS = [(3, 1, 4), (3, 1, 1), (3, 2, 2), (3, 5, 4), (4, 1, 2), (4, 2, 7), (4, 1, 12)]
ROWS = "pred int, s bigint, o bigint"
MEMBERS = [("a", i) for i in (1, 2, 4)] + [("b", i) for i in (2, 12)] + [("c", i) for i in (3, 4, 4)] + [("unused", 90)]
#: The last argument of ``none`` has no domain: the rule that has a variable there only is not typed.
DOMAINS = {1: ("a", "b"), 2: ("b", "c"), 3: (None, None), 4: ("a", None), 5: (None, None)}


@pytest.fixture(scope="module")
def kb(spark):
    return KnowledgeBase(spark.createDataFrame(FACTS, ROWS), [encode_rule(parse_rule(x, "x"), i, NAMES, {}) for i, x in enumerate(RULES)], NAMES)


@pytest.fixture(scope="module")
def typed(spark):
    return enumeration.Domains(spark.createDataFrame(MEMBERS, "domain string, entity bigint"), DOMAINS)


def shown(rows):
    return sorted((r["rule_id"], r["pred"], r["s"], r["o"], tuple(map(tuple, r["body"]))) for r in rows.collect())


def by_hand(rule: int) -> list:
    """The instances of a typed rule from its definition."""
    of = {d: {e for x, e in MEMBERS if x == d} for d in "abc"}
    if rule == 0:
        return [(0, 3, x, y, ((1, x, z), (2, z, w))) for p, x, y in GOALS if p == 3 and x in of["a"] for z, w in product(of["b"], of["c"])]
    if rule == 2:
        return [(2, 4, x, y, ((1, x, z), (4, z, y))) for p, x, y in GOALS if p == 4 and x in of["a"] for z in of["a"] & of["b"] if z != x]
    return [(3, 3, x, y, ((1, x, y),)) for p, x, y in GOALS if p == 3 and x == y and x in of["a"] & of["b"]]


@pytest.mark.parametrize(("members", "few"), [(100_000, 100_000), (1, 0)])
def test_whole_instances_are_those_of_all_choices(spark, kb, typed, monkeypatch, members, few):
    monkeypatch.setattr(enumeration, "BROADCAST_MEMBERS", members)
    monkeypatch.setattr(enumeration, "PARTS", 3)
    monkeypatch.setattr(enumeration, "FEW", few)
    goals = spark.createDataFrame(GOALS, ROWS)
    whole = enumeration.step(kb, goals, None, typed, last=True)
    choices = enumeration.step(kb, goals, None, typed)
    assert shown(whole) == shown(choices)
    assert [x for x in shown(whole) if x[0] != 1] == sorted(by_hand(0) + by_hand(2) + by_hand(3))
    assert any(x[0] == 1 for x in shown(whole))
    assert all(list(map(tuple, r["unknown"])) == [a for a in map(tuple, r["body"]) if a not in FACTS] for r in choices.collect())


def test_typed_rules_meet_no_facts(spark, kb, typed, monkeypatch):
    def refuse(*_):
        raise AssertionError("a choice of unproved atoms")

    monkeypatch.setattr(enumeration, "_choice", refuse)
    goals = spark.createDataFrame([g for g in GOALS if g[0] == 3], ROWS)
    assert shown(enumeration.enumerate_groundings(kb, goals, 1, None, None, typed)) == sorted(by_hand(0) + by_hand(3))


def test_only_asked_domains_are_kept(spark, kb, typed):
    rules = [kb.rules[i] for i in (0, 3)]
    assert {r["domain"] for r in typed.needed_for(rules).members.collect()} == {"a", "b", "c"}
    assert {r["domain"] for r in typed.needed_for(rules[1:]).members.collect()} == {"a", "b"}
    assert typed.needed_for(kb.rules) is typed  # a variable may be any entity
    assert enumeration._met(kb.rules, {4}, 2) == kb.rules[1:3] and enumeration._met(kb.rules, {3}, 1) == rules


def test_choices_without_facts_are_not_made(spark, kb, monkeypatch):
    made = []
    monkeypatch.setattr(enumeration, "_choice", lambda kb, shape, group, g, chosen, *_: made.append(([r.rule_id for r, _ in group], chosen)) or g.limit(0))
    skipped = []
    enumeration.step(kb, spark.createDataFrame(GOALS, ROWS), None, None, skipped)
    assert not any(1 in rules for rules, _ in made) and 1 in skipped  # no fact proves ``none``, and without it Z is free
    assert ([3], ()) in made and ([0], ()) in made


def test_derived_facts_are_still_marked(spark, kb):
    for written in (kb.facts, materialize(kb.facts)):
        found = forward.forward_chain(KnowledgeBase(written, [encode_rule(parse_rule("k(X,Y) :- p(X,Y)", "x"), 0, NAMES, {})], NAMES), 1)
        assert {(r["s"], r["o"], r["is_base"]) for r in found.collect()} == {(1, 2, True), (1, 12, False), (2, 2, False)}


def test_written_tables_are_not_written_again(kb):
    once = materialize(kb.facts)
    assert materialize(once) is once and materialize(once.where("pred = 1")) is not once
