"""The identity of states, and join orders from statistics, against all permutations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM, canonical_set
from hornspark.operators import forward
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.rules import Atom, Rule, shape_of
from hornspark.plans.statistics import Size, Statistics, join_order


def least_form(atoms):
    """The least sorted set over all namings of the variables."""
    names = sorted({t for a in atoms for t in a[1:] if t < 0})
    return min(tuple(sorted({(p, *(n.get(t, t) for t in (x, y))) for p, x, y in atoms})) for q in itertools.permutations(names) for n in [{v: -1 - i for i, v in enumerate(q)}])


def test_states_have_one_form_just_if_they_are_alike(spark):
    r = random.Random(2)
    states = [[], [(1, 3, 4)], [(1, -1, -1)], [(1, -1, -2), (1, -2, -1)]]
    # cycles of one length and two of half the length look alike locally; copies of a pattern; twins
    for cycle in ([[1, 2, 3, 4, 5, 6]], [[1, 2, 3], [4, 5, 6]]):
        states.append([(1, -c[i], -c[(i + 1) % len(c)]) for c in cycle for i in range(len(c))])
    states += [[(1, -i, -i - 3) for i in (1, 2, 3)], [(1, -i, 9) for i in range(1, 6)]]
    for _ in range(40):
        states.append([(r.randint(1, 2), *(r.choice([-1, -2, -3, -4, 7]) for _ in range(2))) for _ in range(r.randint(1, 5))])
    rows = []
    for i, s in enumerate(states):
        for j in range(3):
            new = dict(zip(range(-6, 0), r.sample(range(-20, 0), 6), strict=True))
            t = [(p, *(new.get(x, x) for x in (a, b))) for p, a, b in s] + s[:0]
            r.shuffle(t)
            rows.append((i, t + t[: j % 2]))
    df = spark.createDataFrame(rows, f"i int, atoms array<{ATOM}>").select("i", canonical_set(F.col("atoms")).alias("form"))
    forms = {}
    for x in df.collect():
        forms.setdefault(x["i"], set()).add(tuple(tuple(a) for a in x["form"]))
    assert all(len(f) == 1 for f in forms.values())
    by_form, by_brute = {}, {}
    for i, s in enumerate(states):
        by_form.setdefault(next(iter(forms[i])), set()).add(i)
        by_brute.setdefault(least_form(s), set()).add(i)
    assert sorted(map(sorted, by_form.values())) == sorted(map(sorted, by_brute.values()))


def cost(rule, stats, order):
    """Rows of all intermediate results of an order."""
    return sum(stats.rows(rule, order[: i + 1]) for i in range(len(order)))


def test_expected_rows():
    stats = Statistics({1: Size(100, 10, 50), 2: Size(40, 20, 5)})
    rule = Rule(1, Atom(9, -1, -2), (Atom(1, -1, -2), Atom(2, -2, -3), Atom(2, -3, 8), Atom(1, -4, -4), Atom(3, -1, -1)))
    assert [stats.rows(rule, p) for p in ((), (0,), (0, 1), (2,), (3,), (4,))] == [1, 100, 80, 8, 2, 1]
    assert stats.rows(rule, (0, 1), frozenset({1})) == 4


@pytest.mark.parametrize("seed", range(20))
def test_the_order_is_the_cheapest_of_all(seed):
    r = random.Random(seed)
    stats = Statistics({p: Size(n, r.randint(1, n), r.randint(1, n)) for p in range(1, 5) for n in [r.randint(1, 1000)]})
    body = tuple(Atom(r.randint(1, 5), r.choice([-1, -2, -3, -4, 8]), r.choice([-1, -2, -3, -4])) for _ in range(4))
    rule = Rule(1, Atom(9, -1, -2), body)
    order, total = join_order(rule, stats)
    all_ = {o: cost(rule, stats, o) for o in itertools.permutations(range(4))}
    assert total == pytest.approx(min(all_.values())) and cost(rule, stats, order) == pytest.approx(total)
    first, total = join_order(rule, stats, 2)
    assert first[0] == 2 and total == pytest.approx(min(c for o, c in all_.items() if o[0] == 2))


def test_statistics_change_the_plan_and_not_the_closure(spark):
    facts = [(1, i, 0) for i in range(20)] + [(2, 0, i) for i in range(20)] + [(3, 4, 5)]
    rules = [Rule(0, Atom(7, -1, -3), (Atom(1, -1, -2), Atom(2, -2, -3), Atom(3, -1, -3))), Rule(1, Atom(8, -1, -3), (Atom(3, -1, -2), Atom(3, -2, -3), Atom(7, -1, -3)))]
    kb = KnowledgeBase.of(spark.createDataFrame(facts, "pred int, s bigint, o bigint"), rules)
    with_ = kb.with_statistics()
    assert with_.statistics.sizes == {1: Size(20, 20, 1), 2: Size(20, 1, 20), 3: Size(1, 1, 1)}
    assert join_order(rules[0], with_.statistics)[0] == [2, 0, 1]
    rows = lambda k: {tuple(x) for x in forward.forward_chain(k).select("pred", "s", "o", "step").collect()}
    assert rows(kb) == rows(with_) == {(7, 4, 5, 0)}
    assert kb.most_rules == 1 and {(x["most_rules"], x["most_body_atoms"]) for x in kb.fan_out().collect()} == {(1, 3)}
