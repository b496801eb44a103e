"""Chains are told apart by head and edge, whatever rules define them."""

from hornspark.operators.doubling import Chain, chains
from hornspark.plans.rules import encode_rule, parse_rule

NAMES = {"e": 1, "t": 2}


def test_chains_by_other_rules_are_equal():
    one, other = ([encode_rule(parse_rule(x, "x"), i, NAMES, {}) for i, x in enumerate(["t(X,Y) :- e(X,Y)", more])] for more in ("t(X,Z) :- e(X,Y), t(Y,Z)", "t(X,Z) :- t(X,Y), e(Y,Z)"))
    assert chains(one) == chains(other) == [Chain(2, 1)] != [Chain(2, 3)]
    assert chains(one)[0].more == one[1] and len({*chains(one), *chains(other)}) == 1
