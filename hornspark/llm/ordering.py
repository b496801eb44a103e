"""Rows written in a total order, so that later jobs can count along it without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornspark.plans.materialize import Materialized

#: Bits of ``seq`` that number the rows of a partition (those of monotonically_increasing_id).
ROW_BITS = 33


def in_order(rows: DataFrame, *columns: str, name: str = "ordered") -> DataFrame:
    """``rows`` range-partitioned and sorted by ``columns`` (ascending, nulls first), with ``seq``.

    ``seq`` rises along the whole order; its bits over ``ROW_BITS`` are the partition. Give enough
    columns to tell rows apart: equal rows can't be parted. ``rows`` should be a written table,
    since they are read once for the bounds and once for the rows.
    """
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return Materialized(ranged.withColumn("seq", F.monotonically_increasing_id()), name).df


def part() -> Column:
    """The partition of a row of ``in_order``."""
    return F.shiftright("seq", ROW_BITS)


def numbered(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among those of equal ``key`` (not null) by ``columns``, and ``n``, how many these are.

    Places are counted within a partition and moved on by the counts of the partitions before it,
    so a key of any size is dealt over many tasks; rows of a key and a partition stay together.
    """
    run = in_order(rows, key, *columns).withColumn("_part", part())
    sizes = run.groupBy(key, "_part").agg(F.count("*").alias("_m"), F.min("seq").alias("_first"))
    whole = Window.partitionBy(key)
    base = sizes.select(key, "_part", "_first", (F.sum("_m").over(whole.orderBy("_part")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("n"))
    placed = run.join(base, [key, "_part"])
    return placed.withColumn("pos", F.col("_before") + F.col("seq") - F.col("_first")).drop("_part", "_first", "_before", "seq")
