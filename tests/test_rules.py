"""Parsing, shapes, relevance and engine specifications; nothing here needs Spark."""

import pytest

from hornspark.plans.rules import Atom, Rule, by_shape, encode_rule, is_variable, parse_rule, parse_rules, reachable, shape_of
from hornspark.plans.spec import parse_spec


def test_variables_are_spelled_with_a_capital_or_one_letter():
    assert [is_variable(x) for x in ("X", "Paris", "a", "ab", "region_0", "1")] == [True, True, True, False, False, False]


def test_both_grammars_give_the_same_rule():
    one = parse_rule("gp(X,Z) :- p(X,Y), p(Y,Z).", "r0")
    other = parse_rule("r0:0.5:p(X,Y), p(Y,Z) -> gp(X,Z)", "r0")
    assert (one.head, one.body) == (other.head, other.body)
    assert (one.weight, other.weight) == (1.0, 0.5)


def test_bad_lines_are_reported_not_dropped():
    found, rejected = parse_rules(["# comment", "", "p(X,Y) :- q(X,Y)", "nonsense", "r1:1:q(X) -> p(X,Y)"])
    assert len(found) == 1 and rejected == ["nonsense", "r1:1:q(X) -> p(X,Y)"]


def test_rules_of_one_shape_share_a_plan():
    rules = [encode_rule(parse_rule(t, "r"), i, {"p": 0, "q": 1, "r": 2}, {"const": 7}) for i, t in enumerate(["p(X,Z) :- q(X,Y), r(Y,Z)", "q(A,C) :- p(A,B), p(B,C)", "p(X,X) :- q(X,const)"])]
    shapes = by_shape(rules)
    assert sorted(len(g) for g in shapes.values()) == [1, 2]
    shape, constants = shape_of(rules[2])
    assert shape.head == (0, 0) and shape.body == ((0, -1),) and constants == [7]


def test_join_order_follows_bound_variables():
    shape, _ = shape_of(Rule(0, Atom(0, -1, -4), (Atom(1, -1, -2), Atom(2, -3, -4), Atom(3, -2, -3))))
    assert shape.order(None) == [0, 2, 1]
    assert shape.order(1) == [1, 2, 0]


def test_a_rule_needs_a_body():
    with pytest.raises(ValueError):
        Rule(0, Atom(0, -1, -2), ())


def test_relevance_follows_bodies():
    rules = [Rule(0, Atom(1, -1, -2), (Atom(2, -1, -2),)), Rule(1, Atom(2, -1, -2), (Atom(3, -1, -2),)), Rule(2, Atom(4, -1, -2), (Atom(1, -1, -2),))]
    assert [r.rule_id for r in reachable(rules, {1})] == [0, 1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sld.pd.w1.d2", ("sld", "none", 2, 1, True)),
        ("sld.w1.d2", ("sld", "none", 2, 1, False)),
        ("rtf.pd.d3", ("rtf", "none", 3, 1, True)),
        ("enum.pd.w1.d2", ("enum", "fp_batch", 2, 1, True)),
        ("sld.fp_batch.d2", ("sld", "fp_batch", 2, 1, False)),
        ("sld.fp_global.d2", ("sld", "fp_global", 2, 1, False)),
        ("enum.prune.w1.d2", ("enum", "fp_batch", 2, 1, False)),
        ("enum.provset.w1.d2", ("enum", "fp_global", 2, 1, False)),
        ("enum.full", ("enum", "fp_batch", 1, None, False)),
        ("sld.flat.d3", ("sld", "none", 3, 1, False)),
    ],
)
def test_specifications(text, want):
    s = parse_spec(text)
    assert (s.resolution, s.filter, s.depth, s.width, s.prune_dead) == want


@pytest.mark.parametrize("text", ["", "bfs.d2", "sld.d2.w1", "sld.x", "sld.wx"])
def test_bad_specifications(text):
    with pytest.raises(ValueError):
        parse_spec(text)
