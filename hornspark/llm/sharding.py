"""Shards of bounded size by extendible hashing, in DataFrame operations only.

Rows are hashed by their key; a bucket is the set of rows whose hashes share a prefix, and
the directory, indexed by prefix bits, names the bucket of each prefix. Only a bucket over
the byte limit is split on one more bit. The splits of many bits are planned at once from
byte counts per prefix, which are aggregated before they are shuffled; a pass plans a few bits
more than shards of equal size need, and what is then still too large takes another.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.plans.materialize import Materialized, materialize

#: Bits of the hash, the first 15 hex digits of the key's MD5.
HASH_BITS = 60
#: Depths whose sizes one aggregation adds up.
CHUNK = 8
#: Bits that a pass plans beyond those that shards of equal size would need.
SPARE_BITS = 3
#: Directory entries up to which the directory is broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 1 << 18


def key_hash(col: str):
    """A 60-bit hash of a key's text; a null key hashes as the empty text."""
    digest = F.md5(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(bits):
    """The first ``bits`` bits of a row's hash, as a number (0 bits: 0)."""
    return F.shiftrightunsigned("h", HASH_BITS - bits) if bits else F.lit(0).cast("bigint")


def _sizes(cells: DataFrame, low: int, high: int) -> list[DataFrame]:
    """Sizes of the buckets of depths ``low`` to ``high``, from cells of ``high`` bits.

    Some depths are added up at once, the deepest first; the next are added up from the
    shallowest of these, so the work is a few times the cells, whatever their number of bits.
    """
    out, now, at, top = [], cells, high, high
    while top >= low:
        bottom = max(low, top - CHUNK + 1)
        b = (
            now.select(F.explode(F.sequence(F.lit(bottom), F.lit(top))).alias("depth"), "cell", "bytes", "n", "h_min", "h_max")
            .select("depth", F.expr(f"shiftright(cell, {at} - depth)").alias("prefix"), "bytes", "n", "h_min", "h_max")
            .groupBy("depth", "prefix")
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("h_min").alias("h_min"), F.max("h_max").alias("h_max"))
        )
        if bottom > low:
            b = materialize(b, "buckets")
        out.append(b)
        now, at, top = b.where(F.col("depth") == bottom).withColumnRenamed("prefix", "cell"), bottom, bottom - 1
    return out


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets that are not split further, and those of the last depth that would have to be."""
    b = reduce(DataFrame.unionByName, _sizes(cells, low, high)).withColumn("fits", (F.col("bytes") <= limit) | (F.col("h_min") == F.col("h_max")))
    split = b.where("not fits").select((F.col("depth") + 1).alias("depth"), "prefix")
    parent = F.shiftright("prefix", 1)
    child = b.where((F.col("depth") > low) & (F.col("fits") | (F.col("depth") == high))).withColumn("up", parent)
    below = child.join(split.select("depth", F.col("prefix").alias("up")), ["depth", "up"], "left_semi").drop("up")
    return b.where((F.col("depth") == low) & (F.col("fits") | F.lit(low == high))).unionByName(below)


def _bits(total: int, limit: int) -> int:
    """Bits that part so many bytes into shards of half the limit, and some more."""
    return max(1, math.ceil(math.log2(max(1.0, 2 * total / limit)))) + SPARE_BITS


def extendible_shards(df: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every row, so that each shard's texts have at most ``limit`` UTF-8 bytes.

    Columns: the key, ``n_bytes`` of its text (null: 0), ``shard`` (the bucket's prefix bits;
    the empty string if nothing had to be split), ``page``, and ``shard_bytes`` and
    ``shard_rows`` of the bucket. Bits cannot part rows of one key. If those of a single key
    are over the limit, the bucket gets overflow pages (numbered from 0; 0 elsewhere) of at
    most ``limit`` bytes each; a single text over the limit is a page of its own. Rows of a
    page are numbered within the input's partitions first, so no key's rows meet in one task.
    Repeated rows stay; an empty table gives an empty one; other columns are dropped.
    """
    sized = df.select(
        F.col(f"`{key_col}`").alias("key"), key_hash(key_col).alias("h"), F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("seq")
    )
    rows = materialize(sized, "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, _bits(total, limit))
    pending, done = rows, None
    while True:
        cells = Materialized(pending.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h_min"), F.max("h").alias("h_max")), "cells")
        leaves = Materialized(_leaves(cells.df, low, high, limit), "leaves")
        # the directory: the bucket of every prefix of ``high`` bits that has rows
        depths = sorted(r["depth"] for r in leaves.df.select("depth").distinct().collect())  # HASH_BITS at most
        if not depths:
            break
        entries = cells.df.select("cell", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        directory = entries.join(leaves.df, ["depth", "prefix"])
        n_cells = cells.df.count()
        directory = F.broadcast(directory) if n_cells <= BROADCAST_ENTRIES else directory
        found = pending.withColumn("cell", _prefix(high)).join(directory, "cell")
        now = found.where("fits").select("key", "n_bytes", "seq", "h", "depth", "prefix", "bytes", "n")
        done = now if done is None else done.unionByName(now)
        most = leaves.df.where("not fits").agg(F.max("bytes")).first()[0]
        if high == HASH_BITS or most is None:
            break
        pending = materialize(found.where("not fits").select("key", "h", "n_bytes", "seq"), "pending")
        low, high = high, min(HASH_BITS, high + _bits(most, limit))
    if done is None:
        done = rows.select("key", "n_bytes", "seq", "h", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("n")).limit(0)
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    one = done.where((F.col("bytes") <= limit) | (F.col("n") == 1)).withColumn("page", F.lit(0).cast("bigint"))
    over = done.where((F.col("bytes") > limit) & (F.col("n") > 1))
    paged = _pages(over, limit) if not over.isEmpty() else over.withColumn("page", F.lit(0).cast("bigint"))
    return one.unionByName(paged).select(F.col("key").alias(key_col), "n_bytes", shard.alias("shard"), "page", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets that hold one key.

    Running byte counts are taken within each input partition, and those of whole partitions
    are added up from their totals; a page is a stretch of the sum of both. Stretches are
    shorter than the limit by the bucket's longest text that is within it.
    """
    from pyspark.sql import Window

    part = F.shiftright("seq", 33).alias("part")
    small = over.where(F.col("n_bytes") <= limit).withColumn("part", part)
    sums = small.groupBy("h", "part").agg(F.sum("n_bytes").alias("own"), F.max("n_bytes").alias("longest"))
    by_part = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("h", "part", F.coalesce(F.sum("own").over(by_part), F.lit(0)).alias("ahead"), F.max("longest").over(Window.partitionBy("h")).alias("longest"))
    by_row = Window.partitionBy("h", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("at", F.coalesce(F.sum("n_bytes").over(by_row), F.lit(0))).join(ahead, ["h", "part"])
    page = F.floor((F.col("ahead") + F.col("at")) / F.greatest(F.lit(1), limit - F.col("longest"))).cast("bigint")
    # texts over the limit: pages of their own, numbered backwards from -1
    large = over.where(F.col("n_bytes") > limit)
    alone = large.withColumn("page", -F.col("seq") - 1)
    return placed.withColumn("page", page).drop("part", "at", "ahead", "longest").unionByName(alone)


def write_shards(df: DataFrame, shards: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """Rows of ``df`` with unique keys as Parquet, one folder for each shard and page."""
    df.join(shards.select(key_col, "shard", "page"), key_col).repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
