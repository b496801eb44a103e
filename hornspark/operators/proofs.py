"""Proofs of each query from the shared rule instances of an enumeration.

Instances are a hypergraph: an atom is proved by an instance whose body atoms are facts or are
proved themselves. A proof is unfolded as the list of its steps, first the atom's own, then
those of its unproved body atoms from the left. Of each atom only the k smallest proofs are
made, by number of steps, then by the steps themselves. That is enough: in a proof among an
atom's k smallest every part is among the k smallest of its own atom, since a smaller part makes
a smaller whole. The lists grow from the facts upwards, and an instance is looked at again only
when the list of one of its body atoms has changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornspark.functions.terms import STEP
from hornspark.operators.filters import ATOM_KEY, exploded, numbered
from hornspark.plans.materialize import Materialized, materialize

LIST = [*ATOM_KEY, "n", "steps"]


def _deeper(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.struct((s["depth"] + 1).alias("depth"), s["rule_id"].alias("rule_id"), s["head"].alias("head"), s["body"].alias("body")))


def _smallest(proofs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*ATOM_KEY).orderBy("n", "steps")  # cut down within each task first by Spark
    return proofs.dropDuplicates([*ATOM_KEY, "steps"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def smallest_proofs(instances: DataFrame, facts: DataFrame, k: int, height: int | None = None) -> DataFrame:
    """The ``k`` smallest proofs (pred, s, o, n, steps) of every head of ``instances`` (rule_id, pred, s, o, body).

    ``n`` is the number of steps; a step's ``depth`` counts the steps above it. Body atoms that
    are facts need no step. Proofs have at most ``height`` levels (None: any); on cycles an
    atom may stand below itself, in ever larger proofs.
    """
    rows = numbered(instances.select("rule_id", *ATOM_KEY, "body").distinct(), "instances")
    open_ = exploded(rows, F.col("body")).join(facts.select(*ATOM_KEY), ATOM_KEY, "left_anti")
    lists = open_.groupBy("_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *ATOM_KEY))), lambda x: F.struct(x["pred"].alias("pred"), x["s"].alias("s"), x["o"].alias("o"))).alias("open"))  # a body's atoms at most
    step = F.array(F.struct(F.lit(0).alias("depth"), F.col("rule_id"), F.struct("pred", F.col("s").alias("a0"), F.col("o").alias("a1")).alias("head"), F.col("body")).cast(STEP))
    whole = materialize(rows.join(lists, "_n", "left").select("_n", *ATOM_KEY, step.alias("own"), "open"), "hyperedges")
    links = materialize(whole.where("open is not null").select("_n", F.size("open").alias("m"), F.explode("open").alias("a")).select("_n", "m", "a.*").distinct(), "links")
    sizes = sorted(r["m"] for r in links.select("m").distinct().collect())  # lengths of bodies
    proofs = Materialized(_smallest(whole.where("open is null").select(*ATOM_KEY, F.lit(1).alias("n"), F.col("own").alias("steps")), k), "proofs")
    changed, level = proofs.df.select(*ATOM_KEY).distinct(), 1
    while sizes and (height is None or level < height):
        again = materialize(links.join(changed, ATOM_KEY, "left_semi").select("_n").distinct(), "again")
        parts = [proofs.df.select(*LIST)]
        for m in sizes:
            now = whole.where(F.size("open") == m).join(again, "_n", "left_semi").select(*ATOM_KEY, F.lit(1).alias("n"), F.col("own").alias("steps"), "open")
            for j in range(m):
                child = proofs.df.select(F.struct(*ATOM_KEY).alias("_a"), F.col("n").alias("_n"), F.col("steps").alias("_steps"))
                now = now.withColumn("_a", F.col("open")[j]).join(child, "_a").select(*ATOM_KEY, (F.col("n") + F.col("_n")).alias("n"), F.concat("steps", _deeper(F.col("_steps"))).alias("steps"), "open")
            parts.append(now.select(*LIST))
        new = Materialized(_smallest(reduce(DataFrame.unionByName, parts), k), "proofs")
        changed = materialize(new.df.join(proofs.df, [*ATOM_KEY, "steps"], "left_anti").select(*ATOM_KEY).distinct(), "changed")
        proofs.drop()
        proofs, level = new, level + 1
        if changed.isEmpty():
            break
    return proofs.df


def evidence(queries: DataFrame, instances: DataFrame, facts: DataFrame, k: int, height: int | None = None) -> DataFrame:
    """Groundings (gid, qid, steps, depth) of ground queries (qid, pred, a0, a1): each query's ``k`` smallest proofs.

    A query that is a fact has an empty proof besides, as in the backward search. ``depth`` is
    the number of levels of a proof.
    """
    q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
    q = q.select("qid", "pred", F.col("a0").alias("s"), F.col("a1").alias("o"))
    none = F.array().cast(f"array<{STEP}>")
    given = q.join(facts.select(*ATOM_KEY), ATOM_KEY, "left_semi").select("qid", none.alias("steps"))
    found = q.join(smallest_proofs(instances, facts, k, height), ATOM_KEY).select("qid", "steps").unionByName(given).distinct()
    levels = F.coalesce(F.array_max(F.transform("steps", lambda s: s["depth"])) + 1, F.lit(0))
    return numbered(found.select("qid", "steps", levels.alias("depth")), "groundings").withColumnRenamed("_n", "gid")
