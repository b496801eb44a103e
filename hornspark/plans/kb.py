"""A knowledge base: facts, rules, and optionally a materialised closure."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.plans.rules import Rule, reachable, rule_table
from hornspark.plans.statistics import Statistics


@dataclass(frozen=True)
class KnowledgeBase:
    """``facts`` has columns pred, s, o and no duplicates; ``rules`` are few and live on the driver."""

    facts: DataFrame
    rules: list[Rule]
    predicates: dict[str, int] = field(default_factory=dict)
    closure: DataFrame | None = None
    statistics: Statistics | None = None

    @staticmethod
    def of(facts: DataFrame, rules: list[Rule], predicates: dict[str, int] | None = None) -> KnowledgeBase:
        if not rules:
            raise ValueError("a knowledge base needs at least one rule")
        clean = facts.select(F.col("pred").cast("int"), F.col("s").cast("bigint"), F.col("o").cast("bigint")).dropna().distinct()
        return KnowledgeBase(clean, list(rules), predicates or {})

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    @property
    def heads(self) -> set[int]:
        return {r.head.pred for r in self.rules}

    @property
    def most_body_atoms(self) -> int:
        return max(len(r.body) for r in self.rules)

    def rule_frame(self) -> DataFrame:
        return rule_table(self.spark, self.rules)

    def known(self) -> DataFrame:
        """Facts and, if materialised, derived atoms."""
        return self.facts if self.closure is None else self.facts.unionByName(self.closure.select("pred", "s", "o")).distinct()

    def with_closure(self, closure: DataFrame) -> KnowledgeBase:
        """A knowledge base whose facts include the derived atoms; this one stays as it is."""
        new = closure.select("pred", "s", "o").join(self.facts, ["pred", "s", "o"], "left_anti")
        return replace(self, facts=self.facts.unionByName(new), closure=closure)

    def relevant_to(self, predicates: set[int]) -> KnowledgeBase:
        """Only the rules that goals of these predicates can reach."""
        return replace(self, rules=reachable(self.rules, predicates))

    def entities(self) -> DataFrame:
        return self.facts.select(F.explode(F.array("s", "o")).alias("entity")).distinct()

    def with_statistics(self) -> KnowledgeBase:
        """A knowledge base whose rules are joined in the order that the facts' sizes suggest."""
        return replace(self, statistics=Statistics.of(self.facts))

    @property
    def most_rules(self) -> int:
        """The most rules that one predicate heads."""
        return max(Counter(r.head.pred for r in self.rules).values())

    def fan_out(self) -> DataFrame:
        """The most facts that a predicate has for one subject, and for one object; of the program the most
        rules of one head and the most body atoms of one rule, the same in each row."""
        by_s = self.facts.groupBy("pred", "s").count().groupBy("pred").agg(F.max("count").alias("most_objects"))
        by_o = self.facts.groupBy("pred", "o").count().groupBy("pred").agg(F.max("count").alias("most_subjects"))
        return by_s.join(by_o, "pred").withColumns({"most_rules": F.lit(self.most_rules), "most_body_atoms": F.lit(self.most_body_atoms)})
