"""Best inner products over all entities, exact, in blocks with a bound from the norms.

Vectors are ordered by their norm, the longest first, and cut into waves of doubling size. A
query goes on to a wave only while its own norm times the longest of the wave exceeds the
best product that it has found (no vector of the wave can do better otherwise). In a wave blocks
of queries meet blocks of vectors as matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornspark.operators.scoring import Keyed, Vectors, dot
from hornspark.plans.materialize import materialize

#: Vectors of a block, on either side.
BLOCK = 16_384
#: Queries of a block that are multiplied at a time.
ROWS = 512
#: Room for rounding: a bound that is this little under the best product still counts.
SLACK = 1e-9


def by_norm(vectors: DataFrame) -> DataFrame:
    """``vectors`` (entity, e) with ``norm`` and ``rank`` from 0, the longest first.

    They are ranked within a range of norms and shifted by the counts of the ranges before it.
    """
    own = materialize(vectors.select("entity", "e", (-F.sqrt(dot(F.col("e"), F.col("e")))).alias("order")), "norms")
    ranged = materialize(own.repartitionByRange("order", "entity").withColumn("part", F.spark_partition_id()), "by-norm")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("order", "entity")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(base), "part").select("entity", "e", (-F.col("order")).alias("norm"), (F.col("base") + F.col("rank")).cast("bigint").alias("rank"))


def _best_of_blocks(key: tuple, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(items):
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "best": pd.Series(dtype="float64")})
    q, e = np.stack(queries["q"].to_numpy()), np.stack(items["e"].to_numpy()).T
    best = np.concatenate([(q[i : i + ROWS] @ e).max(axis=1) for i in range(0, len(q), ROWS)])
    return pd.DataFrame({"id": queries["id"], "best": best})


def best_products(queries: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each query (id, q; ids are unique) the ``best`` inner product with any of ``vectors`` (entity, e).

    Wave w has the 2^w blocks of vectors from block 2^w - 1 on. In it a query goes once to each
    block of vectors, and a vector once to each block of the queries that are left.
    """
    items = materialize(by_norm(vectors).withColumn("ib", F.expr(f"rank div {block}")).withColumn("wave", F.length(F.bin(F.col("ib") + 1)) - 1), "items")
    waves = items.groupBy("wave").agg(F.max("norm").alias("top"), F.max("ib").alias("last")).orderBy("wave").collect()  # they double, so they are few
    left = materialize(queries.select("id", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("norm")), "queries")
    best = None
    for w in waves:
        if best is not None:
            left = materialize(left.join(best, "id").where(F.col("norm") * w["top"] * (1 + SLACK) + SLACK > F.col("best")).drop("best"), "queries-left")
        n = -(-left.count() // block)
        if not n:
            break
        q = left.select(F.pmod(F.xxhash64("id"), F.lit(n).cast("bigint")).alias("qb"), F.explode(F.sequence(F.lit(2 ** w["wave"] - 1).cast("bigint"), F.lit(w["last"]).cast("bigint"))).alias("ib"), "id", "q")
        e = items.where(F.col("wave") == w["wave"]).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("qb"), "ib", "e")
        found = q.groupBy("qb", "ib").cogroup(e.groupBy("qb", "ib")).applyInPandas(_best_of_blocks, "id bigint, best double")
        found = found if best is None else found.unionByName(best)
        best = materialize(found.groupBy("id").agg(F.max("best").alias("best")), "best")
    return left.select("id", F.lit(0.0).alias("best")).limit(0) if best is None else best


def best_objects(goals: DataFrame, vectors: Vectors, relations: DataFrame | None = None, scale: float = 1.0, subjects: bool = False, entities: DataFrame | None = None) -> DataFrame:
    """For goals (pred, s) the ``best`` bilinear score of (pred, s, o) over all entities o that have a vector.

    ``relations`` (pred, w) as in ``scoring.DistMult``; goals whose entity has no vector score 0,
    as there. With ``subjects`` goals are (pred, o) and all subjects are tried: the score is the
    same from either side. ``Keyed`` vectors need the ``entities`` (entity) that there are; those
    that share a vector are one candidate, and goals that share one are searched once.
    """
    name = "o" if subjects else "s"
    if isinstance(vectors, Keyed):
        keys = materialize(entities.select(vectors.key(F.col("entity")).alias("entity")).distinct(), "keys")
        table = materialize(vectors.table.select(F.col("key").alias("entity"), F.col("e").cast("array<double>").alias("e")).join(keys, "entity", "left_semi"), "vectors")
        own = materialize(goals.select("pred", name).distinct(), "goals")
        shared = own.select("pred", vectors.key(F.col(name)).alias("_key")).distinct()
        best = best_objects(shared.withColumnRenamed("_key", name), table, relations, scale, subjects).withColumnRenamed(name, "_key")
        return own.withColumn("_key", vectors.key(F.col(name))).join(best, ["pred", "_key"], "left").select("pred", name, F.coalesce("best", F.lit(0.0)).alias("best"))
    own = materialize(goals.select("pred", name).distinct().withColumn("id", F.monotonically_increasing_id()), "goals")
    rows = own.join(vectors.select(F.col("entity").alias(name), F.col("e").alias("q")), name)
    if relations is not None:
        rows = rows.join(F.broadcast(relations.select("pred", "w")), "pred").withColumn("q", F.zip_with("q", "w", lambda x, y: x * y))
    found = best_products(rows.select("id", F.transform("q", lambda x: x * scale).alias("q")), vectors)
    return own.join(found, "id", "left").select("pred", name, F.coalesce("best", F.lit(0.0)).alias("best"))
