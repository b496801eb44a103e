"""Datasets of text files: facts, rules, query splits, entity domains; and text sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import materialize
from hornspark.plans.rules import NamedRule, encode_rule, is_variable, parse_rules


def parse_triples(lines: DataFrame, columns: str = "pso") -> DataFrame:
    """Facts (pred, s, o as names) from a column ``value`` of text lines, and rejected lines.

    ``pred(a,b).`` with an optional dot, split at the last parenthesis and the first comma; or
    three tab-separated fields in the order of ``columns``. Blank lines and those that begin
    with # are skipped. Anything else has a null predicate and its text in ``rejected``.
    """
    line = F.trim("value")
    rows = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    call = r"^(.+)\(([^(,]+),(.+?)\)\s*\.?$"
    tabs = F.split("line", "\t")
    is_tabs = (F.size(tabs) == 3) & ~F.col("line").rlike(call)
    is_call = F.col("line").rlike(call)

    def part(group: int, at: str) -> Column:
        return F.when(is_tabs, F.trim(F.get(tabs, F.lit(columns.index(at))))).when(is_call, F.trim(F.regexp_extract("line", call, group)))

    return rows.select(part(1, "p").alias("pred"), part(2, "s").alias("s"), part(3, "o").alias("o"), F.when(~is_tabs & ~is_call, F.col("line")).alias("rejected"))


def read_triples(spark: SparkSession, path: str, columns: str = "pso") -> DataFrame:
    return parse_triples(spark.read.text(path), columns)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, entity) from lines of a name and its members."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(words, F.lit(0)).alias("domain"), F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).alias("entity"))


def dictionary(names: DataFrame, column: str) -> DataFrame:
    """Distinct ``name`` with ``id`` from 0 in alphabetical order.

    Names are ranked within a range partition and shifted by the counts of those before it, so
    that no task sorts all of them.
    """
    from pyspark.sql import Window

    ranged = materialize(names.select(F.col(column).alias("name")).dropna().distinct().repartitionByRange("name").withColumn("part", F.spark_partition_id()), "names")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(base), "part").select("name", (F.col("base") + F.col("rank")).alias("id"))


@dataclass
class Dataset:
    """A dataset directory with encoded facts and splits; names resolve through the dictionaries."""

    kb: KnowledgeBase
    entities: DataFrame
    predicates: dict[str, int]
    splits: dict[str, DataFrame]
    named_rules: list[NamedRule]
    rejected_rules: list[str]
    rejected_facts: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str, facts: str = "facts.txt", rules: str = "rules.txt", columns: str = "pso") -> Dataset:
        """``facts`` (or train.txt where it is missing), ``rules``, and train, valid and test queries."""
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def exists(name: str) -> bool:
            p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            return p.getFileSystem(conf).exists(p)

        facts = facts if exists(facts) else "train.txt"
        lines = [r["value"] for r in spark.read.text(f"{folder}/{rules}").collect()]  # a program, not data
        splits = {s: read_triples(spark, f"{folder}/{s}.txt", columns) for s in ("train", "valid", "test") if exists(f"{s}.txt")}
        return Dataset.of(spark, read_triples(spark, f"{folder}/{facts}", columns), lines, splits)

    @staticmethod
    def of(spark: SparkSession, triples: DataFrame, rule_lines: list[str], splits: dict[str, DataFrame] | None = None) -> Dataset:
        named, rejected = parse_rules(rule_lines)
        good = triples.where("pred is not null")
        all_triples = good
        for t in (splits or {}).values():
            all_triples = all_triples.unionByName(t.where("pred is not null"))
        atoms = [a for r in named for a in (r.head, *r.body)]
        constants = sorted({x for a in atoms for x in a.args if not is_variable(x)})
        names = all_triples.select(F.explode(F.array("s", "o")).alias("name"))
        if constants:
            names = names.unionByName(spark.createDataFrame([(c,) for c in constants], "name string"))
        entities = materialize(dictionary(names, "name"), "entities")
        found = {r["pred"] for r in all_triples.select("pred").distinct().collect()}  # predicates are few
        predicates = {p: i for i, p in enumerate(sorted(found | {a.pred for a in atoms}))}
        ids = {r["name"]: r["id"] for r in entities.where(F.col("name").isin(constants)).collect()} if constants else {}
        rules = [encode_rule(r, i, predicates, ids) for i, r in enumerate(named)]
        d = Dataset(None, entities, predicates, {}, named, rejected, triples.where("pred is null").select("rejected"))
        d.splits = {s: d.encode(t) for s, t in (splits or {}).items()}
        d.kb = KnowledgeBase.of(d.encode(good), rules, predicates)
        return d

    def predicate_table(self) -> DataFrame:
        return self.entities.sparkSession.createDataFrame(sorted(self.predicates.items()), "name string, id int")

    def encode(self, triples: DataFrame) -> DataFrame:
        """(pred, s, o) as numbers; names that aren't in the dictionaries are left out."""
        p = F.broadcast(self.predicate_table().select(F.col("name").alias("pred"), F.col("id").alias("p")))
        e = self.entities
        rows = triples.where("pred is not null").join(p, "pred")
        rows = rows.join(e.select(F.col("name").alias("s"), F.col("id").alias("si")), "s").join(e.select(F.col("name").alias("o"), F.col("id").alias("oi")), "o")
        return rows.select(F.col("p").alias("pred"), F.col("si").alias("s"), F.col("oi").alias("o"))

    def decode(self, atoms: DataFrame) -> DataFrame:
        """``atoms`` (pred, s, o, ...) with a readable ``atom``; variables are shown as V1, V2, ..."""
        p = F.broadcast(self.predicate_table().select(F.col("id").alias("pred"), F.col("name").alias("_p")))
        e = self.entities
        rows = atoms.join(p, "pred").join(e.select(F.col("id").alias("s"), F.col("name").alias("_s")), "s", "left").join(e.select(F.col("id").alias("o"), F.col("name").alias("_o")), "o", "left")

        def shown(name: str, term: str) -> Column:
            return F.coalesce(F.col(name), F.concat(F.lit("V"), (-F.col(term)).cast("string")))

        return rows.withColumn("atom", F.format_string("%s(%s,%s)", "_p", shown("_s", "s"), shown("_o", "o"))).drop("_p", "_s", "_o")

    def queries(self, split: str) -> DataFrame:
        """The distinct atoms of a split, numbered; an absent split has none."""
        rows = self.splits.get(split)
        if rows is None:
            return self.entities.sparkSession.createDataFrame([], "qid bigint, pred int, a0 bigint, a1 bigint")
        return materialize(rows.distinct().select(F.monotonically_increasing_id().alias("qid"), "pred", F.col("s").alias("a0"), F.col("o").alias("a1")), split)


def write_depths(depths: DataFrame, path: str) -> None:
    """One line ``atom depth`` per row of (atom, depth)."""
    depths.select(F.concat_ws(" ", "atom", F.col("depth").cast("string")).alias("value")).write.text(path)


TRIPLES = T.StructType([T.StructField("pred", T.StringType()), T.StructField("s", T.StringType()), T.StructField("o", T.StringType())])
