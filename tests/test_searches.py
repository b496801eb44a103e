"""Hard rules, inner products, closures by doubling and closures of a stream, on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornspark.operators import constraints, doubling, forward, inner_products
from hornspark.operators.forward import KEY
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.rules import Atom, Rule
from hornspark.streaming.ground import ClosureStream

X, Y, Z = -1, -2, -3
FACTS = "pred int, s bigint, o bigint"
ANCESTOR = [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(1, X, Y), (2, Y, Z)])]


def rules_of(rules):
    return [Rule(i, Atom(*h), tuple(Atom(*b) for b in body)) for i, (h, body) in enumerate(rules)]


def base(spark, facts, rules):
    return KnowledgeBase.of(spark.createDataFrame(facts, FACTS), rules_of(rules))


def atoms(df):
    return {(r["pred"], r["s"], r["o"]) for r in df.collect()}


# hard rules


def test_violations_and_whom_to_blame(spark):
    kb = base(spark, [(1, 1, 2), (1, 2, 3), (1, 5, 6), (3, 1, 3)], ANCESTOR)
    # every ancestor pair must be known as 3, and nobody may be an ancestor of 6
    hard = rules_of([((3, X, Y), [(2, X, Y)]), ((9, X, X), [(2, X, 6)])])
    found = constraints.violations(kb, hard)
    assert {(r["rule_id"], r["pred"], r["s"], r["o"]) for r in found.collect()} == {(0, 3, 1, 2), (0, 3, 2, 3), (0, 3, 5, 6), (1, 9, 5, 5)}
    assert atoms(constraints.blamed(kb, hard)) == {(1, 1, 2), (1, 2, 3), (1, 5, 6)}
    assert constraints.violations(kb, rules_of([((2, X, Y), [(1, X, Y)])])).count() == 0
    assert constraints.blamed(kb, rules_of([((2, X, Y), [(1, X, Y)])])).count() == 0
    with pytest.raises(ValueError):
        constraints.violations(kb, [])


@pytest.mark.parametrize("seed", range(2))
def test_blame_hits_every_violation_and_spares_no_fact(spark, seed):
    r = random.Random(seed)
    sets = [{r.randint(0, 11) for _ in range(r.randint(1, 4))} for _ in range(25)]
    links = spark.createDataFrame([(i, 1, f, 0) for i, s in enumerate(sets) for f in s], f"_n bigint, {FACTS}")
    got = {s for _, s, _ in atoms(constraints.blame(links))}
    assert all(s & got for s in sets)
    assert all(any(s & got == {f} for s in sets) for f in got)
    least = next(n for n in range(13) if any(all(s & set(c) for s in sets) for c in itertools.combinations(range(12), n)))
    assert len(got) <= least + 2


# inner products


@pytest.mark.parametrize("block", [3, 1000])
def test_best_products_equal_all_products(spark, block):
    g = np.random.default_rng(block)
    items = g.normal(size=(60, 4)) * g.exponential(size=(60, 1))
    items[7] = items[8]
    queries = np.vstack([g.normal(size=(20, 4)), np.zeros((1, 4)), -items[:2]])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "entity bigint, e array<double>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "id bigint, q array<double>")
    got = {r["id"]: r["best"] for r in inner_products.best_products(q, v, block).collect()}
    assert sorted(got) == list(range(23)) and np.allclose([got[i] for i in range(23)], (queries @ items.T).max(axis=1))
    assert inner_products.best_products(q.limit(0), v).count() == inner_products.best_products(q, v.limit(0)).count() == 0


def test_short_vectors_are_never_multiplied(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    whole = inner_products._best_of_blocks

    def counted(key, queries, items):
        seen.add(len(queries) * len(items))
        return whole(key, queries, items)

    monkeypatch.setattr(inner_products, "_best_of_blocks", counted)
    v = spark.createDataFrame([(i, [100.0 if i < 4 else 1.0, 0.0]) for i in range(64)], "entity bigint, e array<double>")
    q = spark.createDataFrame([(i, [1.0 + i, 0.5]) for i in range(10)], "id bigint, q array<double>")
    assert {r["best"] for r in inner_products.best_products(q, v, 4).collect()} == {100.0 * (1 + i) for i in range(10)}
    assert seen.value == 40


def test_best_objects_of_goals(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0])], "entity bigint, e array<double>")
    goals = spark.createDataFrame([(1, 1, 9), (1, 2, 9), (1, 3, 9), (1, 8, 9), (1, 1, 9)], FACTS)
    w = spark.createDataFrame([(1, [1.0, -1.0])], "pred int, w array<double>")
    assert {r["s"]: r["best"] for r in inner_products.best_objects(goals, v).collect()} == {1: 1.0, 2: 4.0, 3: 2.0, 8: 0.0}
    assert {r["s"]: r["best"] for r in inner_products.best_objects(goals, v, w).collect()} == {1: 1.0, 2: 2.0, 3: 2.0, 8: 0.0}


# doubling


def closure_steps(df):
    return {(r["pred"], r["s"], r["o"]): (r["step"], r["is_base"]) for r in df.collect()}


LEFT = [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(2, X, Y), (1, Y, Z)])]
SWAPPED = [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(2, Y, Z), (1, X, Y)])]
NOT_CHAINS = [
    [((2, X, Y), [(1, Y, X)]), ((2, X, Z), [(1, X, Y), (2, Y, Z)])],
    [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(1, Y, X), (2, Y, Z)])],
    [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(3, X, Y), (2, Y, Z)])],
    [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(2, X, Y), (2, Y, Z)])],
    [*ANCESTOR, ((1, X, Y), [(3, X, Y)])],
    [*ANCESTOR, ((2, X, Y), [(3, X, Y)])],
]


def test_chains_are_recognised():
    for rules in (ANCESTOR, LEFT, SWAPPED):
        assert doubling.chains(rules_of(rules)) == [doubling.Chain(2, 1)]
    for rules in NOT_CHAINS:
        assert doubling.chains(rules_of(rules)) == []


def test_doubling_equals_the_rounds_of_one_hop(spark):
    r = random.Random(4)
    facts = [(1, r.randint(0, 14), r.randint(0, 14)) for _ in range(22)]
    rules = [*LEFT, ((4, X, Y), [(2, X, Y), (2, Y, X)])]
    kb = base(spark, facts, rules)
    want, got = closure_steps(forward.forward_chain(kb)), closure_steps(doubling.forward_chain_doubling(kb))
    assert got.keys() == want.keys() and all(got[a] == want[a] for a in want if a[0] == 2)
    given = base(spark, [*facts, (2, 0, 14)], LEFT)
    assert closure_steps(doubling.forward_chain_doubling(given)) == closure_steps(forward.forward_chain(given))


def test_rounds_grow_with_the_logarithm(spark):
    path = spark.range(1000).select(F.lit(1).alias("pred"), F.col("id").alias("s"), (F.col("id") + 1).alias("o"))
    paths, rounds = doubling.double(path)
    assert rounds == 10
    assert paths.agg(F.count("*"), F.count_if(F.col("n") == F.col("o") - F.col("s"))).first() == (500500, 500500)
    assert doubling.double(path.limit(0))[1] == 0


# a stream of facts


def test_a_stream_of_facts_and_a_repeated_batch(spark, tmp_path):
    kb = base(spark, [(1, 0, 0)], ANCESTOR)
    s = ClosureStream(kb, f"file://{tmp_path}/closure")
    facts = lambda *rows: spark.createDataFrame([(1, a, b) for a, b in rows], FACTS)
    s.batch(facts((1, 2), (3, 4)), 0)
    s.batch(facts((2, 3), (None, 4)), 1)
    want = {(p, a, b) for a in range(1, 5) for b in range(a + 1, 5) for p in (1, 2) if p == 2 or b == a + 1}
    assert s.committed() == [0, 1] and atoms(s.snapshot()) == want and s.snapshot().count() == len(want)
    assert atoms(s.snapshot(0)) == {(p, a, b) for a, b in ((1, 2), (3, 4)) for p in (1, 2)}
    # repeated after its commit: nothing changes, whatever it brings
    s.batch(facts((7, 8)), 1)
    assert atoms(s.snapshot()) == want
    # a batch that was lost between its part and its commit is not seen, and is done anew
    spark.createDataFrame([(1, 70, 80, -1)], ClosureStream.SCHEMA).write.parquet(f"file://{tmp_path}/closure/part=2")
    assert atoms(s.snapshot()) == want
    s.batch(facts((4, 5)), 2)
    assert atoms(s.snapshot()) == want | {(1, 4, 5)} | {(2, a, 5) for a in range(1, 5)}
    assert atoms(ClosureStream(kb, f"file://{tmp_path}/closure").snapshot().where("step = -1").select(*KEY)) == {(1, a, a + 1) for a in range(1, 5)}
