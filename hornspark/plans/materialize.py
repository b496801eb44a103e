"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs locally."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hornspark-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


#: Rows of a task, where tables are dealt out by their size.
ROWS = 1 << 18


def tasks(spark: SparkSession, n: int) -> int | None:
    """The number of tasks over which to deal out ``n`` rows; None, Spark's own number, if they are few.

    That number is fixed by the session, and tasks are merged by bytes on disk, so the memory of
    a task would grow with the table.
    """
    return max(-(-n // ROWS), spark.sparkContext.defaultParallelism) if n > ROWS else None


def spread(rows: DataFrame, n: int, *keys) -> DataFrame:
    """``n`` ``rows`` dealt out by keys so that a task has about ``ROWS`` of them."""
    parts = tasks(rows.sparkSession, n)
    return rows if parts is None else rows.repartition(parts, *keys)


class Materialized:
    """A table written once to the shared folder; ``df`` reads it back with a short lineage."""

    def __init__(self, df: DataFrame, name: str = "step"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Parts:
    """A table that grows by written parts; beyond ``most`` of them they are written as one (through ``merge``).

    A round adds parts, reads them and the last round's, and ends with ``sweep``. Parts that were
    merged are deleted by the sweep of the round after, when nothing reads them any more.
    """

    def __init__(self, name: str, most: int, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.name, self.most, self.merge = name, most, merge or (lambda rows: rows)
        self.tables: list[Materialized] = []
        self._merged: list[Materialized] = []
        self._stale: list[Materialized] = []

    def __bool__(self) -> bool:
        return bool(self.tables)

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.df for t in self.tables])

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Writes ``rows`` as a part and returns it, None if there are none."""
        new = Materialized(rows, self.name)
        if new.df.isEmpty():
            new.drop()
            return None
        self.tables.append(new)
        if len(self.tables) > self.most:
            self._merged += self.tables
            self.tables = [Materialized(self.merge(self.rows), self.name)]
        return new.df

    def sweep(self, last: bool = False) -> None:
        """Ends a round; after the ``last`` one only ``rows`` is read."""
        stale = self._stale + self._merged if last else self._stale
        self._stale, self._merged = ([], []) if last else (self._merged, [])
        for t in stale:
            t.drop()

    def drop(self) -> None:
        """Deletes all parts."""
        self.sweep(last=True)
        for t in self.tables:
            t.drop()
        self.tables = []


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Unlike a cached table it survives the loss of executors, and unlike an RDD checkpoint
    it stays columnar, so later readers prune columns and push filters down. A table that this
    function has written is returned as it is.
    """
    if vars(df).get("_written"):
        return df
    out = Materialized(df, name).df
    out._written = True
    return out
