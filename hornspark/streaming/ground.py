"""Queries that arrive as a stream, and facts that are appended to a materialised closure."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hornspark.operators.forward import KEY, apply_rules
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized


def ground_stream(queries: DataFrame, ground: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Grounds each micro-batch of a stream of queries and writes the result to ``sink`` once.

    A batch goes to a folder of its own number, which a repeated attempt overwrites.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ground(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extend_closure(kb: KnowledgeBase, known: DataFrame, new_facts: DataFrame, depth: int | None = None) -> DataFrame:
    """Atoms that follow once ``new_facts`` join ``known`` (facts and closure, already closed).

    Only what has a new atom in its body is evaluated: the rounds of the fixpoint start with the
    new facts as the delta, and go on to the end unless a ``depth`` bounds them.
    """
    delta = Materialized(new_facts.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti"), "new-facts").df
    known = known.select(*KEY).unionByName(delta)
    found = delta.withColumn("step", F.lit(-1))
    for step in count() if depth is None else range(depth):
        rows = Materialized(apply_rules(kb, known, delta).join(known, KEY, "left_anti"), f"extend-{step}").df
        if rows.isEmpty():
            break
        known, delta = known.unionByName(rows), rows
        found = found.unionByName(rows.withColumn("step", F.lit(step)))
    return found


class ClosureStream:
    """A closure that grows with a stream of facts, in numbered parts below a shared ``folder``.

    Part n has the new facts of micro-batch n and what follows from them and the parts before; it
    counts once it is committed, which is the last thing that a batch does. A batch that is
    repeated before that writes its part anew from the same earlier parts; one that is repeated
    later finds its commit and changes nothing. So each fact is worked on once, whatever fails.
    """

    SCHEMA = "pred int, s bigint, o bigint, step int"

    def __init__(self, kb: KnowledgeBase, folder: str):
        self.kb, self.folder, self.spark = kb, folder.rstrip("/"), kb.spark
        self._jvm = self.spark.sparkContext._jvm

    def _path(self, *names: str):
        at = self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        at, fs = self._path("commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def snapshot(self, number: int | None = None) -> DataFrame:
        """Facts and derived atoms (pred, s, o, step; -1 for facts) of the committed parts, up to batch ``number``."""
        parts = [f"{self.folder}/part={n}" for n in self.committed() if number is None or n <= number]
        return self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def batch(self, rows: DataFrame, number: int) -> None:
        """Takes in the facts (pred, s, o) of a micro-batch."""
        if number in self.committed():
            return
        clean = rows.select(F.col("pred").cast("int").alias("pred"), F.col("s").cast("bigint").alias("s"), F.col("o").cast("bigint").alias("o")).dropna()
        new = extend_closure(self.kb, self.snapshot(number - 1), clean)
        new.select(*KEY, F.col("step").cast("int").alias("step")).write.mode("overwrite").parquet(f"{self.folder}/part={number}")
        at, fs = self._path("commits", str(number))
        fs.create(at, True).close()

    def start(self, facts: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in all facts that a stream has by now, then ends; the next start goes on from there."""
        return facts.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
