"""Magic sets, tabling and weighted closures against plain Python on small knowledge bases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hornspark.operators import doubling, forward, magic, tabling, weighted
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import shared_dir
from hornspark.plans.rules import Atom, Rule

X, Y, Z = -1, -2, -3
RIGHT = [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(1, X, Y), (2, Y, Z)])]
LEFT = [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(2, X, Y), (1, Y, Z)])]


def base(spark, facts, rules, weights=None):
    return KnowledgeBase.of(spark.createDataFrame(facts, "pred int, s bigint, o bigint"), [Rule(i, Atom(*h), tuple(Atom(*b) for b in body), (weights or [1.0] * len(rules))[i]) for i, (h, body) in enumerate(rules)])


def ask(spark, *goals):
    return spark.createDataFrame([(i, *g) for i, g in enumerate(goals)], "qid bigint, pred int, a0 bigint, a1 bigint")


def bindings(body, known, env=None):
    """All ways to match a body with atoms (with weights), and the product of these."""
    if not body:
        yield dict(env or {}), 1.0
        return
    (p, a, b), env = body[0], env or {}
    for (q, s, o), w in known.items():
        if p != q:
            continue
        now = dict(env)
        if all(now.setdefault(t, v) == v if t < 0 else t == v for t, v in ((a, s), (b, o))):
            for e, x in bindings(body[1:], known, now):
                yield e, w * x


def best(facts, rules, weights=None):
    """Every atom's best weight, by going over all rules until nothing rises."""
    known = {tuple(f): w for f, w in facts.items()} if isinstance(facts, dict) else dict.fromkeys(map(tuple, facts), 1.0)
    while True:
        new = {}
        for i, ((p, a, b), body) in enumerate(rules):
            for env, w in bindings(body, known):
                k = (p, env.get(a, a), env.get(b, b))
                new[k] = max(new.get(k, 0), w * (weights[i] if weights else 1.0))
        risen = {k: w for k, w in new.items() if w > known.get(k, 0) + 1e-12}
        if not risen:
            return known
        known |= risen


def wanted(goals, known):
    return {(i, p, s, o) for i, (p, a, b) in enumerate(goals) for (q, s, o) in known if q == p and (a < 0 or a == s) and (b < 0 or b == o) and (a != b or a >= 0 or s == o)}


def got(df):
    return {(r["qid"], r["pred"], r["s"], r["o"]) for r in df.collect()}


def random_base(seed):
    """Facts of predicates 1 to 3 over few entities, and rules for 2 to 5: recursive, mutually recursive, with constants."""
    r = random.Random(seed)
    facts = list({(r.randint(1, 3), r.randint(0, 5), r.randint(0, 5)) for _ in range(12)})
    rules = []
    for _ in range(5):
        body = [(r.randint(1, 5), X, Y)] if r.random() < 0.3 else [(r.randint(1, 5), *r.choice([(X, Y), (Y, X)])), (r.randint(1, 5), *r.choice([(Y, Z), (Z, Y), (Y, Y), (Y, r.randint(0, 5))]))]
        free = sorted({t for b in body for t in b[1:] if t < 0})
        rules.append(((r.randint(2, 5), r.choice(free), r.choice([*free, r.randint(0, 5)])), body))
    return facts, rules


GOALS = [(2, 0, -1), (2, -1, 3), (3, -4, -7), (4, 1, 2), (5, -1, -1), (1, 0, -1), (9, 0, -1), (5, 2, -3)]


@pytest.mark.parametrize("seed", [3])
def test_magic_and_tables_answer_like_the_closure(spark, seed):
    facts, rules = random_base(seed)
    want = wanted(GOALS, best(facts, rules))
    kb, goals = base(spark, facts, rules), ask(spark, *GOALS)
    assert got(magic.answers(kb, goals)) == want
    assert got(tabling.answers(kb, goals)) == want


@pytest.mark.parametrize("rules", [RIGHT, LEFT])
def test_cycles_end(spark, rules):
    facts = [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 7, 8)]
    kb, goals = base(spark, facts, rules), [(2, 0, -1), (2, -1, 3), (2, 3, 0)]
    want = wanted(goals, best(facts, rules))
    assert got(magic.answers(kb, ask(spark, *goals))) == want
    assert got(tabling.answers(kb, ask(spark, *goals))) == want


def test_rules_that_only_support_each_other_prove_nothing(spark):
    kb = base(spark, [(1, 1, 2)], [((2, X, Y), [(3, X, Y)]), ((3, X, Y), [(2, X, Y)])])
    goals = ask(spark, (2, 1, 2), (3, 1, 2))
    assert got(tabling.answers(kb, goals)) == got(magic.answers(kb, goals)) == set()


def test_tables_of_past_rounds_are_deleted(spark, monkeypatch):
    """Parts are merged every other round here; what is left in the shared folder is the result's."""
    for module in (tabling, weighted, doubling):
        monkeypatch.setattr(module, "MERGE_ROUNDS", 2)
    facts = [(1, i, i + 1) for i in range(7)]
    kb = base(spark, facts, RIGHT)
    closed = {(2, i, j) for i in range(7) for j in range(i + 1, 8)}
    folder = shared_dir(spark).removeprefix("file:")
    runs = {
        "tabling": lambda: tabling.tabled(kb, ask(spark, (2, -1, -2))).answers.where("pred = 2 and a0 = -1 and a1 = -2").select("pred", "s", "o"),
        "weighted": lambda: weighted.weighted_closure(kb).select("pred", "s", "o"),
        "doubling": lambda: doubling.double(kb.facts)[0].select(F.lit(2).alias("pred"), "s", "o"),
    }
    for name, run in runs.items():
        before = set(os.listdir(folder))
        found = run()
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
        assert len(set(os.listdir(folder)) - before) <= 4 and left <= {"calls", "answers", "improved", "paths"}, (name, left)
        assert {tuple(r) for r in found.collect()} == closed, name
        assert weighted.weighted_closure(base(spark, facts, [((5, X, Y), [(4, X, Y)])])).isEmpty()


def test_calls_are_variants_and_made_once(spark):
    kb = base(spark, [(1, i, i + 1) for i in range(6)], RIGHT)
    t = tabling.tabled(kb, ask(spark, (2, 3, -1), (2, 3, -8), (2, 3, -2)))
    assert {tuple(r) for r in t.calls.collect()} == {(2, i, -1) for i in range(3, 7)}
    assert t.answers.count() == 3 + 2 + 1
    goals = ask(spark, (2, -5, -5), (2, -5, -6)).select(*tabling.variant(*map(F.col, ("pred", "a0", "a1"))))
    assert {tuple(r) for r in goals.collect()} == {(2, -1, -1), (2, -1, -2)}


def test_magic_derives_what_the_goals_reach(spark):
    chains = [(1, 10 * c + i, 10 * c + i + 1) for c in range(5) for i in range(6)]
    kb = base(spark, chains, RIGHT)
    derived, program = magic.magic_chain(kb, ask(spark, (2, 3, -1)))
    assert forward.forward_chain(kb).count() == 5 * 21
    # the closure from 3 on, and a magic atom for each of its turns but the seed
    assert derived.count() == 6 + 3
    assert set(program.answers) == {(2, True, False)}
    # bound from the other side only the object is passed on
    assert set(magic.rewrite(kb.rules, {(2, False, True)}, set()).answers) == {(2, False, True)}


def test_magic_without_goals_or_rules_for_them(spark):
    kb = base(spark, [(1, 1, 2), (2, 5, 6)], RIGHT)
    assert magic.answers(kb, ask(spark, (2, 1, -1)).limit(0)).count() == 0
    assert got(magic.answers(kb, ask(spark, (1, 1, -1)))) == {(0, 1, 1, 2)}
    # a fact of a predicate that rules derive, and a goal with a null argument
    rows = spark.createDataFrame([(0, 2, 5, -1), (1, 2, None, -1)], "qid bigint, pred int, a0 bigint, a1 bigint")
    assert got(magic.answers(kb, rows)) == got(tabling.answers(kb, rows)) == {(0, 2, 5, 6)}
    assert tabling.tabled(kb, rows.limit(0)).rounds == 0


@pytest.mark.parametrize("seed", [0])
def test_weighted_closure(spark, seed):
    facts, rules = random_base(seed + 50)
    r = random.Random(seed)
    weight = {f: r.choice([0.25, 0.5, 0.9, 1.0]) for f in facts}
    rule_weights = [r.choice([0.3, 0.8, 1.0]) for _ in rules]
    kb = base(spark, facts, rules, rule_weights)
    w = spark.createDataFrame([(*f, x) for f, x in weight.items()], "pred int, s bigint, o bigint, w double")
    want = {k: x for k, x in best(weight, rules, rule_weights).items() if x > weight.get(k, 0) + 1e-12}
    found = {(x["pred"], x["s"], x["o"]): x["w"] for x in weighted.weighted_closure(kb, w).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_a_later_and_longer_proof_may_weigh_more(spark):
    kb = base(spark, [(1, 0, 3), (3, 0, 1), (3, 1, 2), (3, 2, 3)], [((2, X, Y), [(1, X, Y)]), ((2, X, Y), [(3, X, Y)]), ((2, X, Z), [(2, X, Y), (3, Y, Z)]), ((4, X, Y), [(2, X, Y)])], [0.1, 1.0, 0.9, 0.5])
    found = {(x["pred"], x["s"], x["o"]): round(x["w"], 9) for x in weighted.weighted_closure(kb).collect()}
    assert found[2, 0, 3] == 0.81 and found[4, 0, 3] == 0.405
    assert (4, 0, 3) not in {(x["pred"], x["s"], x["o"]) for x in weighted.weighted_closure(kb, least=0.41).collect()}


@pytest.mark.parametrize("weight", [1.5, -0.1, float("nan")])
def test_weights_beyond_one_are_refused(spark, weight):
    with pytest.raises(ValueError):
        weighted.weighted_closure(base(spark, [(1, 1, 2)], RIGHT, [1.0, weight]))
    with pytest.raises(ValueError):
        weighted.weighted_closure(base(spark, [(1, 1, 2)], RIGHT), spark.createDataFrame([(1, 1, 2, weight)], "pred int, s bigint, o bigint, w double"))
