"""The engine on hand-made knowledge bases, and against a plain Python fixpoint on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from hornspark.functions.terms import ATOM, STEP, atom, canonical_variables, show
from hornspark.functions.unify import Unifier
from hornspark.operators import backward, enumeration, export, filters, forward, lookups, scoring
from hornspark.operators.backward import Options, ground_queries
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.rules import Atom, Rule
from hornspark.plans.spec import Engine
from hornspark.streaming.ground import extend_closure

X, Y, Z = -1, -2, -3


def base(spark, facts, rules):
    return KnowledgeBase.of(spark.createDataFrame(facts, "pred int, s bigint, o bigint"), [Rule(i, Atom(*h), tuple(Atom(*b) for b in body)) for i, (h, body) in enumerate(rules)])


def ask(spark, *goals):
    return spark.createDataFrame([(i, *g) for i, g in enumerate(goals)], "qid bigint, pred int, a0 bigint, a1 bigint")


def counts(groundings):
    return {r["qid"]: r["n"] for r in groundings.groupBy("qid").agg(F.count("*").alias("n")).collect()}


def atoms(df):
    return {(r["pred"], r["s"], r["o"]) for r in df.collect()}


GRAND = ([(1, 1, 2), (1, 2, 3), (1, 5, 6)], [((2, X, Z), [(1, X, Y), (1, Y, Z)])])
ANCESTOR = ([(1, 1, 2), (1, 2, 3)], [((2, X, Y), [(1, X, Y)]), ((2, X, Z), [(1, X, Y), (2, Y, Z)])])


@pytest.mark.parametrize(
    ("q", "t", "ok", "pairs"),
    [
        ((1, 2), (1, 2), True, [None, None]),
        ((1, 2), (1, 3), False, None),
        ((-1, 2), (5, 2), True, [(-1, 5), None]),
        ((1, 2), (-9, 2), True, [(-9, 1), None]),
        ((-1, -2), (-9, -8), True, [(-9, -1), (-8, -2)]),
        ((-1, -1), (5, 6), False, None),
        ((-1, -1), (5, 5), True, [(-1, 5), None]),
        ((-1, -1), (5, -8), True, [(-1, 5), (-8, 5)]),
        ((1, 2), (-9, -9), False, None),
        ((1, -2), (-9, -9), True, [(-9, 1), (-2, 1)]),
        ((-1, -1), (-9, -9), True, [(-9, -1), None]),
    ],
)
def test_unification(spark, q, t, ok, pairs):
    df = spark.createDataFrame([(*q, *t)], "q0 bigint, q1 bigint, t0 bigint, t1 bigint")
    u = Unifier(*[F.col(c) for c in df.columns])
    r = df.select(u.ok.alias("ok"), u.s0.alias("s0"), u.r0.alias("r0"), u.s1.alias("s1"), u.r1.alias("r1")).first()
    assert r["ok"] == ok
    if ok:
        assert [(r["s0"], r["r0"]) if r["s0"] is not None else None, (r["s1"], r["r1"]) if r["s1"] is not None else None] == pairs


def test_canonical_variables(spark):
    df = spark.range(1).select(F.array(atom(F.lit(1), F.lit(-7), F.lit(3)), atom(F.lit(2), F.lit(-4), F.lit(-7))).alias("g"))
    assert df.select(show(canonical_variables(F.col("g"))).alias("x")).first()["x"] == "1(-1,3);2(-2,-1)"


def test_lookups(spark):
    facts = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 3), (1, 4, 4)], "pred int, s bigint, o bigint")
    goals = spark.createDataFrame([(0, 1, 1, 2), (1, 1, 1, -1), (2, 1, -1, 3), (3, 1, -1, -2), (4, 1, -1, -1), (5, 3, -1, -2), (6, 2, 1, 2)], "qid int, pred int, a0 bigint, a1 bigint")
    want = {(0, 1, 2), (1, 1, 2), (2, 2, 3), (3, 1, 2), (3, 2, 3), (3, 4, 4), (4, 4, 4)}
    for present in (None, lookups.kinds(goals)):
        assert {(r["qid"], r["fs"], r["fo"]) for r in lookups.matches(goals, facts, present=present).collect()} == want
    flags = lookups.contains(spark.createDataFrame([(1, 1, 2), (1, 3, 1)], "pred int, s bigint, o bigint"), facts)
    assert {(r["s"], r["known"]) for r in flags.collect()} == {(1, True), (3, False)}


def test_grandparent(spark):
    kb = base(spark, *GRAND)
    found, _ = ground_queries(kb, ask(spark, (2, 1, -1), (2, 3, -1)), Options(depth=3))
    assert counts(found) == {0: 1}
    assert export.evidence_flat(found).first()["body"] == "1(1,2);1(2,3)"


def test_masked_and_null_queries_have_no_answers(spark):
    kb = base(spark, *GRAND)
    q = spark.createDataFrame([(0, 2, 1, -1, False), (1, 2, 1, -1, True), (2, 2, None, -1, True)], "qid bigint, pred int, a0 bigint, a1 bigint, active boolean")
    assert counts(ground_queries(kb, q, Options(depth=3))[0]) == {1: 1}


def test_a_query_that_is_a_fact_has_an_empty_proof(spark):
    found, _ = ground_queries(base(spark, *GRAND), ask(spark, (1, 1, 2)), Options(depth=1))
    assert [len(r["steps"]) for r in found.collect()] == [0]


def test_two_levels_of_evidence(spark):
    kb = base(spark, [(1, 1, 2), (1, 2, 3)], [((3, X, Y), [(2, X, Y)]), ((2, X, Y), [(1, X, Z), (1, Z, Y)])])
    found, _ = ground_queries(kb, ask(spark, (3, 1, 3)), Options(depth=4))
    assert export.evidence_flat(found).first()["body"] == "2(1,3);1(1,2);1(2,3)"


def test_repeated_rule_variable_binds_consistently(spark):
    kb = base(spark, [(1, 1, 1), (1, 1, 2)], [((2, X, X), [(1, X, X)])])
    found, _ = ground_queries(kb, ask(spark, (2, -1, -2), (2, 1, 2)), Options(depth=2))
    assert atoms(backward.answers(found)) == {(2, 1, 1)}


def test_a_knowledge_base_needs_rules(spark):
    with pytest.raises(ValueError):
        base(spark, [(1, 1, 2)], [])


def test_forward_chaining_steps(spark):
    c = forward.forward_chain(base(spark, [(1, i, i + 1) for i in range(5)], ANCESTOR[1]))
    assert {(r["s"], r["o"], r["step"]) for r in c.collect()} == {(i, j, j - i - 1) for i in range(6) for j in range(i + 1, 6)}


def test_forward_chaining_heads_with_constants_and_disconnected_bodies(spark):
    with pytest.warns(UserWarning):
        kb = base(spark, [(1, 1, 2), (3, 7, 8)], [((2, X, 99), [(1, X, Y)]), ((4, X, Z), [(1, X, Y), (3, Z, -4)])])
        assert atoms(forward.forward_chain(kb)) == {(2, 1, 99), (4, 1, 7)}


def test_base_facts_that_are_derived_again_are_marked(spark):
    c = forward.forward_chain(base(spark, [(1, 1, 2), (2, 1, 2)], [((2, X, Y), [(1, X, Y)])]))
    assert [r["is_base"] for r in c.collect()] == [True]


def test_the_guard_on_new_atoms(spark):
    with pytest.raises(RuntimeError):
        forward.forward_chain(base(spark, [(1, i, i + 1) for i in range(5)], ANCESTOR[1]), most_new=3)


def test_empty_facts(spark):
    kb = base(spark, [], GRAND[1])
    assert forward.forward_chain(kb).count() == 0
    assert ground_queries(kb, ask(spark, (2, 1, -1)), Options(depth=3))[0].count() == 0


def test_witnesses_come_from_earlier_steps(spark):
    kb = base(spark, *ANCESTOR)
    w = {(r["s"], r["o"]): (r["rule_id"], [tuple(b) for b in r["body"]]) for r in forward.witnesses(kb, forward.forward_chain(kb)).collect()}
    assert w == {(1, 2): (0, [(1, 1, 2)]), (2, 3): (0, [(1, 2, 3)]), (1, 3): (1, [(1, 1, 2), (2, 2, 3)])}


def test_circular_support_proves_nothing(spark):
    kb = base(spark, [(3, 1, 2)], [((1, X, Y), [(2, X, Y)]), ((2, X, Y), [(1, X, Y)])])
    found, _ = ground_queries(kb, ask(spark, (1, 1, 2), (2, 1, 2)), Options(depth=2, collect="grounded"))
    assert found.count() > 0
    assert filters.fp_batch(found, kb.facts).count() == 0


def test_batch_support(spark):
    kb = base(spark, *ANCESTOR)
    q = ask(spark, (2, 1, 3), (2, 2, 3))
    one, _ = ground_queries(kb, q.where("qid = 0"), Options(depth=2, collect="grounded"))
    both, _ = ground_queries(kb, q, Options(depth=2, collect="grounded"))
    assert set(counts(filters.fp_batch(both, kb.facts))) == {0, 1}
    assert counts(filters.fp_batch(both.where("size(steps) = 1"), kb.facts)) == {0: 1, 1: 1}
    assert counts(filters.fp_batch(one.where("size(steps) = 1"), kb.facts)) == {}
    closed = kb.with_closure(forward.forward_chain(kb))
    assert 0 in counts(filters.fp_global(one, closed.known()))


def test_pruning_facts_is_free_but_not_for_the_query_itself(spark):
    kb = base(spark, [*ANCESTOR[0], (2, 1, 3)], ANCESTOR[1])
    found, _ = ground_queries(kb, ask(spark, (2, 1, 2)), Options(depth=1, prune_facts=True))
    assert counts(found) == {0: 1}
    q = ask(spark, (2, 1, 3)).withColumn("excluded", atom(F.lit(2), F.lit(1), F.lit(3)))
    proofs = ground_queries(kb, q, Options(depth=4, prune_facts=True))[0].collect()
    assert proofs and all(r["steps"] for r in proofs)


def test_width_and_dead_goals(spark):
    kb = base(spark, [(1, 1, 2)], [((2, X, Y), [(1, X, Y), (3, X, Y)]), ((3, X, Y), [(4, X, Y)])])
    rows = filters.numbered(spark.createDataFrame([(0, [(1, 1, 2), (3, 1, 2)]), (1, [(3, 1, 2), (3, 5, 6)]), (2, [(4, 1, -1)]), (3, [(1, -1, 9)])], "k int, g array<struct<pred:int,a0:bigint,a1:bigint>>"))
    assert {r["k"] for r in filters.within_width(rows, F.col("g"), kb.facts, 1).collect()} == {0, 2, 3}
    assert {r["k"] for r in filters.prune_dead(rows, F.col("g"), kb).collect()} == {0, 1}


def test_rule_then_fact(spark):
    kb = base(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 4)], [((2, X, Y), [(1, X, Y)])])
    found, _ = ground_queries(kb, ask(spark, (2, 1, -1), (2, 2, -1)), Options(depth=1, resolution="rtf"))
    assert atoms(backward.answers(found)) == {(2, 1, 2), (2, 2, 3)}


def test_proof_depths(spark):
    kb = base(spark, [(1, i, i + 1) for i in range(4)], ANCESTOR[1])
    d = backward.proof_depth(kb, ask(spark, (2, 0, 1), (2, 0, 2), (2, 0, 4), (2, 4, 0)), 6)
    assert {r["qid"]: r["depth"] for r in d.collect()} == {0: 2, 1: 4, 2: -1, 3: -1}


def test_enumeration_widths(spark):
    kb = base(spark, *ANCESTOR)
    goals = spark.createDataFrame([(2, 1, 3), (2, 1, 2)], "pred int, s bigint, o bigint")
    shown = lambda df: {(r["rule_id"], r["s"], r["o"], r["b"]) for r in df.select("rule_id", "s", "o", show(F.col("body")).alias("b")).collect()}
    assert shown(enumeration.enumerate_groundings(kb, goals, 1, 0)) == {(0, 1, 2, "1(1,2)")}
    # the goal's own atom is no body of it
    assert shown(enumeration.enumerate_groundings(kb, goals, 1, 1, 1)) == {(0, 1, 2, "1(1,2)"), (1, 1, 3, "1(1,2);2(2,3)"), (1, 1, 2, "1(1,2);2(2,2)")}
    two = enumeration.enumerate_groundings(kb, goals, 2, 1)
    assert (0, 2, 3, "1(2,3)") in shown(two)
    assert shown(enumeration.sound(kb, two)) == {(0, 1, 2, "1(1,2)"), (1, 1, 3, "1(1,2);2(2,3)"), (0, 2, 3, "1(2,3)")}


@pytest.mark.parametrize("most", [1, 100_000])
def test_domains_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(enumeration, "BROADCAST_MEMBERS", most)
    kb = base(spark, *GRAND)
    goals = spark.createDataFrame([(2, 1, 3), (2, 5, 1)], "pred int, s bigint, o bigint")
    shown = lambda df: sorted((r["s"], r["o"], r["b"]) for r in df.select("s", "o", show(F.col("body")).alias("b")).collect())
    full = [(s, o, f"1({s},{y});1({y},{o})") for s, o in ((1, 3), (5, 1)) for y in (1, 2, 3, 5, 6)]
    assert shown(enumeration.enumerate_groundings(kb, goals, 1, None, None, kb.entities())) == full
    # people 1 to 3 and things 5 and 6: predicate 1 takes a person and anything, predicate 2 a person and a person
    members = spark.createDataFrame([("person", i) for i in (1, 2, 3)] + [("thing", 5), ("thing", 6), ("blue", 2), ("blue", 6)], "domain string, entity bigint")
    typed = enumeration.Domains(members, {1: ("person", None), 2: ("person", "person")})
    assert shown(enumeration.enumerate_groundings(kb, goals, 1, None, None, typed)) == [x for x in full[:5] if int(x[2][4]) < 4]
    both = enumeration.Domains(members, {1: ("person", "blue")})
    assert shown(enumeration.enumerate_groundings(kb, spark.createDataFrame([(2, 1, 2)], goals.schema), 1, None, None, both)) == [(1, 2, "1(1,2);1(2,2)")]


def test_choices_left_out_are_reported(spark):
    kb = base(spark, [(1, 1, 2)], [((2, X, Z), [(2, X, Y), (2, Y, Z)]), ((2, X, Y), [(1, X, Y)])])
    engine = Engine("enum.w2.d2", kb)
    with pytest.warns(UserWarning, match="left out"):
        engine.ground(ask(spark, (2, 1, 2)))
    assert engine.skipped == [0]


def test_evidence_of_enumeration_is_that_of_resolution(spark):
    n = 3
    facts = [(1, i, i + 1) for i in range(n)] + [(1, 0, 2), (3, 1, 2), (3, 0, 1)]
    rules = [*ANCESTOR[1], ((2, X, Y), [(3, X, Y)]), ((4, X, Z), [(2, X, Y), (1, Y, Z)])]
    kb, q = base(spark, facts, rules), ask(spark, (4, 0, n), (2, 0, n), (1, 0, 1), (2, n, 0), (4, 0, 3))
    shown = lambda df: sorted(tuple(r) for r in export.evidence_flat(df).select("qid", "rules", "body").collect())
    want = shown(ground_queries(kb, q, Options(depth=3 * n + 4))[0])
    assert len(want) == len(set(want)) and want
    assert shown(Engine("enum.w1.d" + str(n + 2), kb).evidence(q, 1000)) == want
    # the k smallest are the first of all by number of steps
    few = shown(Engine("enum.w1.d" + str(n + 2), kb).evidence(q, 2))
    for i in range(5):
        sizes = sorted(len(r[1].split(",")) if r[1] else 0 for r in want if r[0] == i)
        assert sorted(len(r[1].split(",")) if r[1] else 0 for r in few if r[0] == i) == sizes[:2]


def test_smallest_proofs_on_a_cycle(spark):
    kb = base(spark, [(1, 1, 2)], [((2, X, Y), [(3, X, Y)]), ((3, X, Y), [(2, X, Y)]), ((3, X, Y), [(1, X, Y)])])
    found = Engine("enum.w1.d5", kb).evidence(ask(spark, (2, 1, 2)), 3).orderBy("depth").collect()
    assert [(len(r["steps"]), r["depth"]) for r in found] == [(2, 2), (4, 4)]


def test_a_closure_of_any_depth_and_its_witnesses(spark):
    kb = base(spark, [(1, 1, 2)], [((i + 1, X, Y), [(i, X, Y)]) for i in range(1, 16)])
    q = ask(spark, (16, 1, 2), (16, 2, 1), (1, 1, 2))
    found = Engine("sld.fp_global.d1", kb).ground(q)
    assert {r["qid"]: r["body"] for r in export.evidence_flat(found).collect()} == {0: "15(1,2)", 2: ""}
    with pytest.warns(UserWarning):
        assert counts(Engine("sld.fp_global.d1", kb, fc_depth=10).ground(q)) == {2: 1}


def test_ties_of_rule_children_go_to_the_first_rule(spark):
    kb = base(spark, [(1, 1, 2)], [((2, X, Y), [(1, X, Y)]), ((2, X, Y), [(1, X, Z), (2, Z, Y)])])
    zero = lambda atoms: atoms.withColumn("score", F.lit(0.0))
    left = ground_queries(kb, ask(spark, (2, 1, 2), (2, 5, 6)), Options(depth=1, rule_hooks=[lambda c: scoring.top_k_children(c, zero, 1)]))[1]
    assert {(r["qid"], r["rule"]) for r in left.select("qid", F.element_at("steps", 1)["rule_id"].alias("rule")).collect()} == {(0, 0), (1, 0)}


def test_engines_from_specifications(spark):
    kb = base(spark, *ANCESTOR)
    q = ask(spark, (2, 1, 3), (2, 3, 1))
    assert set(counts(Engine("sld.fp_batch.d4", kb).ground(q))) == {0}
    assert set(counts(Engine("sld.fp_global.d4", kb).ground(q))) == {0}
    assert atoms(Engine("enum.w1.d2", kb).ground(q)) == {(2, 1, 3), (2, 2, 3)}


def test_export_tables(spark):
    kb = base(spark, *GRAND)
    inst = export.rule_groundings(ground_queries(kb, ask(spark, (2, 1, -1)), Options(depth=3))[0])
    table = export.atom_table(inst)
    assert [(r["pred"], r["s"], r["o"]) for r in table.orderBy("atom_id").collect()] == [(1, 1, 2), (1, 2, 3), (2, 1, 3)]
    assert {(r["head_id"], r["pos"], r["body_id"]) for r in export.edges(inst, table).collect()} == {(2, 0, 0), (2, 1, 1)}


def test_scores_and_samples(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [0.0, 1.0])], "entity bigint, e array<double>")
    kb = base(spark, *GRAND)
    found, _ = ground_queries(kb, ask(spark, (2, 1, -1)), Options(depth=3))
    s = scoring.score_groundings(found, scoring.DistMult(vec)).first()["score"]
    assert abs(s - 1 / (1 + 2.718281828459045**-1)) < 1e-9
    w = spark.createDataFrame([(1, [0.0, 2.0])], "pred int, w array<double>")
    scored = {(r["s"], r["o"]): r["score"] for r in scoring.TransE(vec, w)(kb.facts).collect()}
    assert scored[1, 2] == 0.0 and scored[5, 6] == 0.0 and scored[2, 3] < -3
    ranked = scoring.top_k(spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.9), (1, 4, 0.1)], "qid int, gid int, score double"), 2)
    assert {(r["qid"], r["gid"]) for r in ranked.collect()} == {(0, 2), (0, 3), (1, 4)}
    rows = spark.range(20).select((F.col("id") % 2).alias("qid"), F.col("id").alias("gid"))
    assert scoring.sample(rows, 3, seed=1).count() == 6
    assert {r["gid"] for r in scoring.sample(rows, 2, train=False).collect()} == {0, 1, 2, 3}
    net = scoring.attention(spark.createDataFrame([([1.0, -1.0],)], "x array<double>"), [[[1.0], [1.0]], [[2.0]]], [[0.5], [1.0]])
    assert net.first()["score"] == 2.0


def test_hooks_filter_children(spark):
    kb = base(spark, *GRAND)
    o = Options(depth=3, rule_hooks=[lambda c: c.where("false")])
    assert ground_queries(kb, ask(spark, (2, 1, -1)), o)[0].count() == 0


def test_closure_extends_by_new_facts(spark):
    kb = base(spark, *ANCESTOR)
    closed = kb.with_closure(forward.forward_chain(kb)).facts
    new = spark.createDataFrame([(1, 3, 4), (1, 1, 2)], "pred int, s bigint, o bigint")
    assert atoms(extend_closure(kb, closed, new)) == {(1, 3, 4), (2, 3, 4), (2, 2, 4), (2, 1, 4)}


def fixpoint(facts, rules):
    """Brute force over all substitutions that the known atoms allow."""
    known = set(facts)
    while True:
        new = set()
        for head, body in rules:
            subs = [{}]
            for p, a, b in body:
                out = []
                for s in subs:
                    for q, x, y in known:
                        t = dict(s)
                        if q == p and all(t.setdefault(v, c) == c if v < 0 else v == c for v, c in ((a, x), (b, y))):
                            out.append(t)
                subs = out
            new |= {(head[0], *(s.get(v, v) for v in head[1:])) for s in subs}
        if new <= known:
            return known - set(facts)
        known |= new


@pytest.mark.parametrize("seed", range(2))
def test_random_bases_agree(spark, seed):
    r = random.Random(seed)
    facts = sorted({(r.randint(1, 2), r.randint(1, 5), r.randint(1, 5)) for _ in range(8)})
    rules = [((3, X, Z), [(1, X, Y), (2, Y, Z)]), ((3, X, Y), [(1, Y, X)]), ((4, X, Y), [(3, X, Z), (3, Z, Y)]), ((4, X, X), [(2, X, 3)])]
    want = fixpoint(facts, rules)
    kb = base(spark, facts, rules)
    assert atoms(forward.forward_chain(kb)) == want
    goals = [(p, a, b) for p in (3, 4) for a in range(1, 6) for b in range(1, 6)]
    found, _ = ground_queries(kb, ask(spark, *goals), Options(depth=5, prune_facts=True))
    proved = {goals[r["qid"]] for r in found.select("qid").distinct().collect()}
    assert proved == {g for g in goals if g in want}
    shuffled = base(spark, r.sample(facts, len(facts)), rules)
    again, _ = ground_queries(shuffled, ask(spark, *goals).repartition(3), Options(depth=5, prune_facts=True))
    key = lambda df: {(x["qid"], x["body"]) for x in export.evidence_flat(df).collect()}
    assert key(again) == key(found)


def test_closures_go_on_to_the_fixpoint_and_a_bound_is_reported(spark):
    kb = base(spark, [(1, i, i + 1) for i in range(13)], ANCESTOR[1])
    c = forward.forward_chain(kb).collect()
    assert {(r["s"], r["o"], r["step"]) for r in c} == {(i, j, j - i - 1) for i in range(14) for j in range(i + 1, 14)}
    with pytest.warns(UserWarning, match="ended after 2 rounds"):
        assert {r["step"] for r in forward.forward_chain(kb, depth=2).collect()} == {0, 1}


@pytest.mark.parametrize("v", [-1, -3, -6, -7, -8, -50])
def test_rules_are_renamed_apart_from_any_variable(spark, v):
    kb = base(spark, [(1, 10, 11), (2, 11, 12), (1, 20, 20)], [((3, X, Z), [(1, X, Y), (2, Y, Z)])])
    goals = spark.createDataFrame([(0, [(3, 10, -1), (1, v if v != -1 else -2, 20)])], "qid bigint, goals array<struct<pred:int,a0:bigint,a1:bigint>>")
    found, _ = ground_queries(kb, goals, Options(depth=4))
    assert counts(found) == {0: 1}
    early, left = ground_queries(kb, goals, Options(depth=1))
    again, _ = ground_queries(kb, left, Options(depth=3), first=1)
    assert early.count() == 0 and [tuple(r) for r in export.evidence_flat(again).collect()] == [tuple(r) for r in export.evidence_flat(found).collect()]


def test_step_filter_modes(spark):
    score = lambda atoms: atoms.withColumn("score", F.col("o").cast("double"))
    step = "array<struct<depth:int,rule_id:int,head:struct<pred:int,a0:bigint,a1:bigint>,body:array<struct<pred:int,a0:bigint,a1:bigint>>>>"
    rows = [(0, [(0, 0, (9, 1, 1), [(1, 1, o)])]) for o in (1, 2, 3)] + [(0, [(0, 0, (9, 1, 1), [(1, 5, -1)])]), (0, [(0, 0, (9, 1, 1), [(1, -1, -2)])]), (0, [])]
    df = spark.createDataFrame(rows, f"qid bigint, steps {step}")
    partial = (spark.createDataFrame([(1, 5, 2.5)], "pred int, s bigint, best double"), spark.createDataFrame([], "pred int, o bigint, best double"))
    kept = lambda mode: sorted((b["a0"], b["a1"]) for r in scoring.top_k_steps(df, score, 2, mode, partial).collect() for s in r["steps"] for b in s["body"])
    assert kept("ground_only") == [(-1, -2), (1, 2), (1, 3), (5, -1)]
    assert kept("partial_only") == [(-1, -2), (1, 1), (1, 2), (1, 3), (5, -1)]
    assert kept("both") == [(-1, -2), (1, 3), (5, -1)]
    with pytest.raises(ValueError):
        scoring.top_k_steps(df, score, 2, "none")


def test_canonical_names_reach_goals_and_proofs(spark):
    kb = base(spark, [(1, 1, 2), (1, 2, 3), (1, 2, 4)], ANCESTOR[1])
    q = ask(spark, (2, 1, -7), (2, -3, -9))
    shown = lambda df: sorted(tuple(r) for r in export.evidence_flat(df).select("qid", "rules", "body").collect())
    plain, renamed = (ground_queries(kb, q, Options(depth=4, canonical=c)) for c in (False, True))
    assert shown(plain[0]) == shown(renamed[0])
    one = spark.createDataFrame([([(1, -8, 5), (2, -3, -8)], [(0, 0, (3, -3, -6), [(1, -6, 4)])])], f"goals array<{ATOM}>, steps array<{STEP}>")
    r = backward.canonical_states(one).select(show(F.col("goals")).alias("g"), show(F.array(F.col("steps")[0]["head"])).alias("h"), show(F.col("steps")[0]["body"]).alias("b")).first()
    assert tuple(r) == ("1(-1,5);2(-2,-1)", "3(-2,-3)", "1(-3,4)")
