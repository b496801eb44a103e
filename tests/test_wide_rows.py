"""Wide rows (vectors, proofs) stay where they are: what is shuffled is narrow, and the results are those of the plain ways."""

import re

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark import catalogue
from hornspark.functions.terms import atom
from hornspark.operators import enumeration, inner_products, scoring
from hornspark.operators.backward import Options, ground_queries
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.rules import encode_rule, parse_rule

SMALL = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)
E = RNG.normal(size=(20, 4))


def exchanged(df) -> set[str]:
    """The columns that go through shuffles."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\(\d+\) Exchange\n(?:Input \[\d+\]: \[(.*?)\]|Input: \[(.*?)\])\n", text)
    return {c.split("#")[0].strip() for b in blocks for c in "".join(b).split(",")}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(E)], "key bigint, e array<double>")


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame([(1, s, o) for s in range(0, 60, 3) for o in range(0, 60, 7)] + [(1, 1, 1000), (1, 1000, 1)], "pred int, s bigint, o bigint")


def keyed(table):
    return scoring.Keyed(table, lambda e: F.when(e < 100, e % 20))


@pytest.mark.parametrize("block", [32_768, 6])
def test_shared_vectors_score_as_vectors_of_entities(spark, table, atoms, block, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", block)
    own = spark.createDataFrame([(i, [float(x) for x in E[i % 20]]) for i in range(100)], "entity bigint, e array<double>")
    for model in (lambda v: scoring.DistMult(v, scale=0.5), lambda v: scoring.Neural(v, [np.arange(16).reshape(8, 2) / 7 - 1, [[1.0], [-1.0]]], [[0.1, 0.2], [0.3]])):
        want = {(r["s"], r["o"]): r["score"] for r in model(own)(atoms).collect()}
        got = {(r["s"], r["o"]): r["score"] for r in model(keyed(table))(atoms).collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want) and got[1, 1000] == 0.0


def test_best_objects_of_shared_vectors(spark, table, atoms):
    entities = spark.range(0, 90).select(F.col("id").alias("entity"))
    got = {r["s"]: r["best"] for r in inner_products.best_objects(atoms, keyed(table), entities=entities).collect()}
    assert got[1000] == 0.0
    assert all(abs(b - (E[s % 20] @ E.T).max()) < 1e-9 for s, b in got.items() if s < 1000)


@pytest.mark.parametrize("name", ["score_min", "score_max", "score_product", "score_soft_known", "score_neural", "score_attention", "attention_top", "topk_groundings", "partial_scores"])
def test_no_vector_is_shuffled(spark, name):
    found = exchanged(catalogue.QUERIES[name](spark, SMALL))
    assert found and not found & {"e", "_es", "_eo", "x", "v", "steps", "_ps", "_po"}


def test_proofs_are_not_dealt_out_to_tell_them_apart(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("whole states are shuffled")

    monkeypatch.setattr(DataFrame, "dropDuplicates", refuse)
    for name in ("groundings_per_query", "per_rule_depth_counts", "sld_nested", "sld_conjunction", "sld_canonical", "sld_reentry", "sample_counts"):
        assert catalogue.QUERIES[name](spark, SMALL).count()


def test_states_that_are_reached_twice_are_one(spark):
    names = {"p": 1, "h": 2, "r": 3}
    kb = KnowledgeBase(spark.createDataFrame([(1, 1, 5), (1, 1, 6), (3, 7, 7)], "pred int, s bigint, o bigint"), [encode_rule(parse_rule("h(X,Y) :- p(X,Y)", "x"), 1, names, {})], names)
    lit = lambda p, a, b: atom(F.lit(p), F.lit(a), F.lit(b))
    # the first goal's two facts leave the same state; the second goal's leave two
    goals = spark.range(1).select(F.lit(0).cast("bigint").alias("qid"), F.array(lit(1, 1, -1), lit(2, 1, -2)).alias("goals"))
    found = ground_queries(kb, goals, Options(depth=3))[0]
    assert sorted(r["steps"][0]["head"]["a1"] for r in found.collect()) == [5, 6]
    assert found.select("gid").distinct().count() == 2
    twice = spark.createDataFrame([(0, 2, 1, -1), (0, 2, 1, -1)], "qid bigint, pred int, a0 bigint, a1 bigint")
    assert ground_queries(kb, twice, Options(depth=2))[0].count() == 2


def test_only_rules_with_goals_get_candidates(spark, monkeypatch):
    asked, own = set(), enumeration.Domains.candidates

    def candidates(self, names):
        asked.update(names)
        return own(self, names)

    monkeypatch.setattr(enumeration.Domains, "candidates", candidates)
    assert catalogue.QUERIES["enum_full_typed"](spark, SMALL).count()
    assert "nation" in asked and "order" not in asked
