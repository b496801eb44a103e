"""Relational tables as a knowledge base: foreign keys are facts, and a rule program over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.operators.enumeration import Domains
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import spread
from hornspark.plans.rules import Rule, encode_rule, parse_rule

#: Kinds of entities; an entity is tag * 10^12 + key.
TAGS = {"customer": 1, "supplier": 2, "nation": 3, "region": 4, "order": 5, "part": 6, "turn": 7}
PREDICATES = {
    "c_nation": 1, "s_nation": 2, "in_region": 3, "placed": 4, "has_part": 5, "shipped_by": 6, "supplies": 7, "next_turn": 8,
    "in_region_of": 11, "bought": 12, "bought_from": 13, "local_buy": 14, "follows": 15, "same_region": 16, "sold_to": 17, "african": 18,
}
#: The kinds of the arguments of each predicate.
ARGUMENTS = {
    "c_nation": ("customer", "nation"), "s_nation": ("supplier", "nation"), "in_region": ("nation", "region"), "placed": ("customer", "order"),
    "has_part": ("order", "part"), "shipped_by": ("order", "supplier"), "supplies": ("supplier", "part"), "next_turn": ("turn", "turn"),
    "in_region_of": (None, "region"), "bought": ("customer", "part"), "bought_from": ("customer", "supplier"), "local_buy": ("customer", "supplier"),
    "follows": ("turn", "turn"), "same_region": ("nation", "nation"), "sold_to": ("supplier", "customer"), "african": ("nation", "nation"),
}
#: The predicates that each table gives.
TABLES = {
    "customer": ("c_nation",), "supplier": ("s_nation",), "nation": ("in_region",), "orders": ("placed",),
    "lineitem": ("has_part", "shipped_by", "supplies"), "conversations": ("next_turn",),
}
PROGRAM = [
    "in_region_of(X,Z) :- c_nation(X,W), in_region(W,Z)",
    "in_region_of(X,Z) :- s_nation(X,W), in_region(W,Z)",
    "bought(C,P) :- placed(C,O), has_part(O,P)",
    "bought_from(C,S) :- placed(C,O), shipped_by(O,S)",
    "local_buy(C,S) :- bought_from(C,S), c_nation(C,N), s_nation(S,N)",
    "follows(X,Y) :- next_turn(X,Y)",
    "follows(X,Z) :- next_turn(X,Y), follows(Y,Z)",
    "same_region(N,M) :- in_region(N,R), in_region(M,R)",
    "sold_to(S,C) :- bought_from(C,S)",
    "african(N,N) :- in_region(N,region_0)",
]


def entity(kind: str, key: str) -> Column:
    return F.lit(TAGS[kind] * 10**12) + F.col(key).cast("bigint")


#: Turns that one conversation may have. Turns are the last kind of entity, so any number of conversations fits.
TURNS = 10**6


def turn(number: Column) -> Column:
    """The entity of a turn of ``conv_id``."""
    return F.lit(TAGS["turn"] * 10**12) + F.col("conv_id") * TURNS + number


def facts(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Facts (pred, s, o) of the tables, without duplicates; ``only`` some predicates."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def next_turn() -> DataFrame:
        c = t("conversations").select("conv_id", "turn").distinct()
        after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
        return c.join(after, ["conv_id", "turn"]).select(turn(F.col("turn")).alias("s"), turn(F.col("turn") + 1).alias("o"))

    def pairs(table: str, *columns: tuple[str, Column, Column]) -> Callable[[list[str]], list[DataFrame]]:
        """The wanted predicates among some of one table's columns, in one scan."""

        def make(wanted: list[str]) -> list[DataFrame]:
            own = [F.struct(F.lit(PREDICATES[p]).alias("pred"), s.alias("s"), o.alias("o")) for p, s, o in columns if p in wanted]
            return [t(table).select(F.explode(F.array(*own)).alias("f")).select("f.*")] if len(own) > 1 else [t(table).select(x.alias("f")).select("f.*") for x in own]

        return make

    makers = [
        pairs("customer", ("c_nation", entity("customer", "c_custkey"), entity("nation", "c_nationkey"))),
        pairs("supplier", ("s_nation", entity("supplier", "s_suppkey"), entity("nation", "s_nationkey"))),
        pairs("nation", ("in_region", entity("nation", "n_nationkey"), entity("region", "n_regionkey"))),
        pairs("orders", ("placed", entity("customer", "o_custkey"), entity("order", "o_orderkey"))),
        pairs(
            "lineitem",
            ("has_part", entity("order", "l_orderkey"), entity("part", "l_partkey")),
            ("shipped_by", entity("order", "l_orderkey"), entity("supplier", "l_suppkey")),
            ("supplies", entity("supplier", "l_suppkey"), entity("part", "l_partkey")),
        ),
        lambda wanted: [next_turn().select(F.lit(PREDICATES["next_turn"]).alias("pred"), "s", "o")] if "next_turn" in wanted else [],
    ]
    wanted = [p for p in PREDICATES if only is None or p in only]
    found = reduce(DataFrame.unionByName, [part for make in makers for part in make(wanted)]).dropna()
    used = {t for t, names in TABLES.items() for p in names if p in wanted}
    n = sum(t(name).count() * sum(p in wanted for p in TABLES[name]) for name in sorted(used))  # of Parquet files' footers
    return spread(found, n // 4, "pred", "s", "o").distinct()  # facts are narrow


def domains(kb: KnowledgeBase) -> Domains:
    """The seven kinds of entities as domains of the predicates' arguments."""
    kind = F.create_map(*[F.lit(x) for k, t in TAGS.items() for x in (t, k)])
    members = kb.entities().select(kind[F.expr(f"cast(entity div {10**12} as int)")].alias("domain"), "entity")
    return Domains(members, {PREDICATES[p]: a for p, a in ARGUMENTS.items()})


def rules(heads: tuple[str, ...] | None = None) -> list[Rule]:
    """The program, or its rules for some head predicates; ids are positions in the program."""
    constants = {"region_0": TAGS["region"] * 10**12}
    out = [encode_rule(parse_rule(line, f"r{i}"), i + 1, PREDICATES, constants) for i, line in enumerate(PROGRAM)]
    wanted = {PREDICATES[h] for h in heads} if heads else None
    return [r for r in out if wanted is None or r.head.pred in wanted]


def knowledge_base(spark: SparkSession, sf_dir: str, heads: tuple[str, ...] | None = None, only: tuple[str, ...] | None = None) -> KnowledgeBase:
    """The tables' facts with the program; with ``heads`` only these rules and the facts that they read."""
    program = rules(heads)
    if only is None and heads is not None:
        used = {b.pred for r in program for b in r.body}
        only = tuple(n for n, p in PREDICATES.items() if p in used)
    return KnowledgeBase(facts(spark, sf_dir, only), program, PREDICATES)
