"""Counts and comparisons of groundings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groundings_per_query(queries: DataFrame, groundings: DataFrame) -> DataFrame:
    """Every query with its number of groundings, 0 if none."""
    counts = groundings.groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_groundings"))


def grounding_stats(per_query: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and percentiles of the counts, and the share proved."""
    n = F.col("n_groundings")
    p = F.percentile("n_groundings", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return per_query.agg(
        F.count("*").alias("n_queries"), F.sum(n).cast("bigint").alias("total"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.max(n).alias("most"),
        F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"), F.round(p[2], 6).alias("p99"), F.count_if(n > 0).alias("n_proved"), F.round(F.count_if(n > 0) / F.count("*"), 6).alias("prove_rate"),
    )


def per_rule_depth(groundings: DataFrame) -> DataFrame:
    """How often each rule is applied at each depth."""
    return groundings.select(F.explode("steps").alias("st")).groupBy(F.col("st.depth").alias("depth"), F.col("st.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def depth_histogram(depths: DataFrame) -> DataFrame:
    """Queries per proof depth, and those proved up to it; -1 is not proved and not added up."""
    counts = depths.groupBy("depth").agg(F.count("*").alias("n"))
    a, b = counts.alias("a"), counts.where("depth >= 0").alias("b")
    upto = a.join(F.broadcast(b), (F.col("b.depth") <= F.col("a.depth")), "left").groupBy(F.col("a.depth").alias("depth"), F.col("a.n").alias("n"))
    return upto.agg(F.coalesce(F.sum("b.n"), F.lit(0)).cast("bigint").alias("n_up_to"))


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """Sizes of two sets of proved atoms, of their intersection and differences, and their Jaccard index."""
    a, b = one.select("pred", "s", "o").distinct().withColumn("a", F.lit(1)), other.select("pred", "s", "o").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["pred", "s", "o"], "full")
    counts = both.agg(F.count("a").alias("n_one"), F.count("b").alias("n_other"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))
    return counts.select("n_one", "n_other", "n_both", (F.col("n_one") - F.col("n_both")).alias("only_one"), (F.col("n_other") - F.col("n_both")).alias("only_other"), F.round(F.col("n_both") / F.col("n_any"), 6).alias("jaccard"))


def compare_all(engines: dict[str, DataFrame]) -> DataFrame:
    """``compare`` for any number of engines' atoms: for each set of engines (their names, comma-joined)
    the number of atoms that exactly these have."""
    tagged = [df.select("pred", "s", "o").distinct().withColumn("name", F.lit(n)) for n, df in sorted(engines.items())]
    owners = reduce(DataFrame.unionByName, tagged).groupBy("pred", "s", "o").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("engines"))  # one entry per engine
    return owners.groupBy("engines").agg(F.count("*").alias("n"))


def report(per_query: DataFrame, depths: DataFrame, **about: str) -> DataFrame:
    """A JSON summary as one row: statistics of groundings, the depth histogram, and what it is ``about``."""
    histogram = depth_histogram(depths).agg(F.sort_array(F.collect_list(F.struct("depth", "n", "n_up_to"))).alias("depths"))  # one row per depth
    extra = [F.lit(v).alias(k) for k, v in sorted(about.items())]
    return grounding_stats(per_query).crossJoin(histogram).select(F.to_json(F.struct(*extra, "*")).alias("report"))
