"""Text datasets and the relational tables."""

from hornspark.operators import forward
from hornspark.sources.tables import knowledge_base
from hornspark.sources.text import Dataset, parse_triples, read_domains, write_depths

LINES = ["# comment", "", "likes(ann,bob).", "likes(bob, cat)", "is_a\tdog\tanimal", "odd(a,b,c).", "broken", "f(g(x),y)."]


def test_triples_and_rejected_lines(spark):
    rows = parse_triples(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert {(r["pred"], r["s"], r["o"]) for r in rows if r["pred"]} == {("likes", "ann", "bob"), ("likes", "bob", "cat"), ("is_a", "dog", "animal"), ("odd", "a", "b,c"), ("f(g", "x)", "y")}
    assert {r["rejected"] for r in rows if r["rejected"]} >= {"broken"}
    assert ("likes", "bob", "cat") in {(r["pred"], r["s"], r["o"]) for r in rows}


def test_column_order_of_tab_separated_facts(spark):
    row = parse_triples(spark.createDataFrame([("ann\tlikes\tbob",)], "value string"), "spo").first()
    assert (row["pred"], row["s"], row["o"]) == ("likes", "ann", "bob")


def test_dataset_directory(spark, tmp_path):
    (tmp_path / "train.txt").write_text("parent(ann,bob).\nparent(bob,cat).\nparent(ann,bob).\n")
    (tmp_path / "test.txt").write_text("grand(ann,cat).\n")
    (tmp_path / "rules.txt").write_text("r0:0.9:parent(X,Y), parent(Y,Z) -> grand(X,Z)\n???\n")
    d = Dataset.read(spark, f"file://{tmp_path}")
    assert d.kb.facts.count() == 2 and d.rejected_rules == ["???"] and d.kb.rules[0].weight == 0.9
    assert [r["name"] for r in d.entities.orderBy("id").collect()] == ["ann", "bob", "cat"]
    closure = d.decode(forward.forward_chain(d.kb))
    assert [r["atom"] for r in closure.collect()] == ["grand(ann,cat)"]
    assert d.queries("test").count() == 1 and d.queries("valid").count() == 0
    write_depths(spark.createDataFrame([("grand(ann,cat)", 2)], "atom string, depth int"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()["value"] == "grand(ann,cat) 2"


def test_domains(spark, tmp_path):
    (tmp_path / "d.txt").write_text("country de fr\nempty\n\n")
    assert {tuple(r) for r in read_domains(spark, f"file://{tmp_path}/d.txt").collect()} == {("country", "de"), ("country", "fr")}


def test_tables_give_the_expected_facts(spark):
    kb = knowledge_base(spark, "/root/testdata/sf0.001")
    counts = {r["pred"]: r["count"] for r in kb.facts.groupBy("pred").count().collect()}
    assert counts[3] == 25 and len(kb.rules) == 10
