"""The search's joins are dealt out over as many tasks as their rows need, whatever the session's number is."""

from hornspark.operators import backward, lookups
from hornspark.plans import materialize


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(materialize, "ROWS", 50)
    monkeypatch.setattr(lookups, "FEW", 10)
    facts = spark.range(4000).selectExpr("4 as pred", "id % 1000 as s", "id as o")
    goals = spark.range(1000).selectExpr("id as qid", "4 as pred", "id as a0", "-1L as a1")
    found = lookups.matches(goals, facts, present={(4, True, False): 1000}, sizes=backward.fact_sizes(facts))
    assert found.count() == 4000
    sizes = [r["n"] for r in found.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) > 10 and max(sizes) < 1000  # the session has 4 partitions
