"""Groundings as tables: flat evidence, rule groundings, and hyperedges over numbered atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornspark.functions.terms import body_flat, show
from hornspark.plans.materialize import materialize


def evidence_flat(groundings: DataFrame) -> DataFrame:
    """Per grounding: its rules and all body atoms as text, and how many."""
    return groundings.select("qid", F.array_join(F.transform("steps", lambda s: s["rule_id"].cast("string")), ",").alias("rules"), show(body_flat(F.col("steps"))).alias("body"), F.size(body_flat(F.col("steps"))).alias("n_atoms"))


def rule_groundings(groundings: DataFrame) -> DataFrame:
    """Distinct rule applications (rule_id, pred, s, o, body) of all proofs; bodies are sorted."""
    st = groundings.select(F.explode("steps").alias("st"))
    return st.select(F.col("st.rule_id").alias("rule_id"), F.col("st.head.pred").alias("pred"), F.col("st.head.a0").alias("s"), F.col("st.head.a1").alias("o"), F.array_sort("st.body").alias("body")).distinct()


def atom_table(instances: DataFrame) -> DataFrame:
    """All atoms of rule applications, numbered from 0 in the order of (pred, s, o).

    Atoms are ranked within a range partition and shifted by the counts of those before it, so
    no task orders more than one partition, however many atoms a predicate has.
    """
    head = instances.select("pred", "s", "o")
    body = instances.select(F.explode("body").alias("a")).select(F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o"))
    atoms = head.unionByName(body).distinct().repartitionByRange("pred", "s", "o").withColumn("part", F.spark_partition_id())
    ranged = materialize(atoms, "ranged-atoms")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("pred", "s", "o")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(base), "part").select((F.col("base") + F.col("rank")).cast("bigint").alias("atom_id"), "pred", "s", "o")


def edges(instances: DataFrame, atoms: DataFrame) -> DataFrame:
    """Hyperedges: (rule_id, head atom, position, body atom) by atom numbers."""
    body = instances.select("rule_id", "pred", "s", "o", F.posexplode("body").alias("pos", "a"))
    body = body.select("rule_id", "pred", "s", "o", "pos", F.col("a.pred").alias("bp"), F.col("a.a0").alias("bs"), F.col("a.a1").alias("bo"))
    out = body.join(atoms.withColumnRenamed("atom_id", "head_id"), ["pred", "s", "o"])
    other = atoms.select(F.col("atom_id").alias("body_id"), F.col("pred").alias("bp"), F.col("s").alias("bs"), F.col("o").alias("bo"))
    return out.join(other, ["bp", "bs", "bo"]).select("rule_id", "head_id", "pos", "body_id")
