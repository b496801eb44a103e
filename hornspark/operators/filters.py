"""Filters on search states, and soundness filters on finished groundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import ground
from hornspark.operators.lookups import contains
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import Materialized

ATOM_KEY = ["pred", "s", "o"]


def numbered(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` written out with a number ``_n`` each, which stays the same from then on."""
    return Materialized(rows.withColumn("_n", F.monotonically_increasing_id()), name).df


def exploded(rows: DataFrame, atoms: Column) -> DataFrame:
    """One row per atom: _n, its position and its columns."""
    return rows.select("_n", F.posexplode(atoms).alias("pos", "_a")).select("_n", "pos", F.col("_a.pred").alias("pred"), F.col("_a.a0").alias("s"), F.col("_a.a1").alias("o"))


def unknown_counts(rows: DataFrame, atoms: Column, facts: DataFrame) -> DataFrame:
    """For each _n the number of ground atoms that aren't facts."""
    known = contains(exploded(rows, F.filter(atoms, ground)), facts)
    return known.groupBy("_n").agg(F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("n_unknown"))


def within_width(rows: DataFrame, atoms: Column, facts: DataFrame, width: int | None) -> DataFrame:
    """Rows (with _n) with at most ``width`` ground non-facts among ``atoms``; None keeps all."""
    if width is None:
        return rows
    bad = unknown_counts(rows, atoms, facts).where(F.col("n_unknown") > width).select("_n")
    return rows.join(bad, "_n", "left_anti")


def prune_dead(rows: DataFrame, atoms: Column, kb: KnowledgeBase) -> DataFrame:
    """Rows (with _n) without an atom that can't succeed: no fact matches it and no rule heads its predicate."""
    heads = F.array(*[F.lit(p) for p in sorted(kb.heads)])
    open_ = exploded(rows, F.filter(atoms, lambda a: ~F.array_contains(heads, a["pred"])))
    f = kb.facts
    s, o = F.col("s"), F.col("o")
    dead = (
        open_.where((s >= 0) & (o >= 0)).join(f, ATOM_KEY, "left_anti").select("_n")
        .unionByName(open_.where((s >= 0) & (o < 0)).join(f.select("pred", "s").distinct(), ["pred", "s"], "left_anti").select("_n"))
        .unionByName(open_.where((s < 0) & (o >= 0)).join(f.select("pred", "o").distinct(), ["pred", "o"], "left_anti").select("_n"))
        .unionByName(open_.where((s < 0) & (o < 0)).join(f.select("pred").distinct(), ["pred"], "left_anti").select("_n"))
    )
    return rows.join(dead, "_n", "left_anti")


def prune_facts(rows: DataFrame, facts: DataFrame, goals: str = "goals", excluded: str | None = None, true_pred: int | None = None) -> DataFrame:
    """Rows (with _n) without the goals that are ground facts; order is kept.

    ``excluded`` names an atom column: a goal equal to it stays, so a query can't prove itself.
    Goals of the predicate ``true_pred`` always hold.
    """
    atoms = exploded(rows, F.filter(F.col(goals), ground))
    flagged = contains(atoms.select(*ATOM_KEY).distinct(), facts).where("known").select(*ATOM_KEY)
    gone = atoms.join(flagged, ATOM_KEY, "left_semi").groupBy("_n").agg(F.collect_set(F.struct("pred", F.col("s").alias("a0"), F.col("o").alias("a1"))).alias("_facts"))
    out = rows.join(gone, "_n", "left")

    def stays(g: Column) -> Column:
        fact = F.coalesce(F.array_contains("_facts", F.struct(g["pred"].alias("pred"), g["a0"].alias("a0"), g["a1"].alias("a1"))), F.lit(False))
        if excluded:
            e = F.col(excluded)
            fact &= ~F.coalesce((g["pred"] == e["pred"]) & (g["a0"] == e["a0"]) & (g["a1"] == e["a1"]), F.lit(False))
        if true_pred is not None:
            fact |= g["pred"] == true_pred
        return ~fact

    return out.withColumn(goals, F.filter(F.col(goals), stays)).drop("_facts")


def closure_step(rows: DataFrame, atoms: Column, kb: KnowledgeBase) -> DataFrame:
    """Rows (with _n) whose ground atoms are all facts or derivable; the closure must be materialised."""
    return within_width(rows, atoms, kb.known(), 0)


def fp_global(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """Groundings (qid, gid, steps) whose body atoms are all in ``known``, facts and closure."""
    atoms = evidence.select("gid", F.explode("steps").alias("st")).select("gid", F.explode("st.body").alias("a")).select("gid", F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o"))
    bad = atoms.join(known, ATOM_KEY, "left_anti").select("gid").distinct()
    return evidence.join(bad, "gid", "left_anti")


def _roots(steps: DataFrame, open_: DataFrame) -> DataFrame | None:
    """Atoms (pred, s, o) that hold just if another does, with the last (_rp, _rs, _ro) of such a chain; None if there are none.

    Such an atom is the head of steps (_n, pred, s, o) that all have one open atom (``open_``), the
    same. The links are followed by doubling; those of circles never end and stay as they are.
    """
    root = F.struct("_rp", "_rs", "_ro")
    one = open_.groupBy("_n").agg(F.count("*").alias("k"), F.min(F.struct(F.col("pred").alias("_rp"), F.col("s").alias("_rs"), F.col("o").alias("_ro"))).alias("r"))
    per = steps.join(one, "_n", "left").groupBy(*ATOM_KEY).agg(F.min(F.coalesce("k", F.lit(0))).alias("least"), F.max("k").alias("most"), F.min("r").alias("r"), F.max("r").alias("last"))
    links = Materialized(per.where((F.col("least") == 1) & (F.col("most") == 1) & (F.col("r") == F.col("last"))).select(*ATOM_KEY, "r.*"), "links")
    n, ended, going = links.df.count(), None, links
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        known = going.df.withColumn("_ends", F.lit(False))
        known = known if ended is None else known.unionByName(ended.withColumn("_ends", F.lit(True)))
        ahead = known.select(F.col("pred").alias("_rp"), F.col("s").alias("_rs"), F.col("o").alias("_ro"), F.struct("_rp", "_rs", "_ro").alias("_next"), "_ends")
        moved = Materialized(going.df.join(ahead, ["_rp", "_rs", "_ro"], "left").select(*ATOM_KEY, F.coalesce("_next", root).alias("r"), F.coalesce("_ends", F.lit(True)).alias("_ends")), "links")
        now = moved.df.select(*ATOM_KEY, "r.*", "_ends")
        new = now.where("_ends").drop("_ends")
        ended = new if ended is None else ended.unionByName(new)
        going.drop()
        going = Materialized(now.where("not _ends").drop("_ends"), "links")
        if going.df.isEmpty():
            break
    return ended


def fp_batch(evidence: DataFrame, facts: DataFrame, rounds: int | None = None) -> DataFrame:
    """Groundings of a whole batch that support each other down to the facts.

    A (grounding, depth) is proved when all its body atoms are facts or heads of proved ones;
    this is repeated until nothing is new (or for ``rounds``). Kept are the groundings all of
    whose depths are proved; circular support proves nothing. A round joins the open body atoms
    with the atoms that the last one proved only; each step counts how many of its own are.
    Unless ``rounds`` are bounded, chains of atoms that rest on just one other are followed to
    their ends before, so rounds are as many as the choices in a row, not as the longest chain.
    """
    steps = evidence.select("gid", F.explode("steps").alias("st")).select("gid", F.col("st.head").alias("head"), F.col("st.body").alias("body"))
    steps = Materialized(steps.withColumn("_n", F.monotonically_increasing_id()), "steps")
    atoms = steps.df.select("_n", F.explode("body").alias("a")).select("_n", F.col("a.pred").alias("pred"), F.col("a.a0").alias("s"), F.col("a.a1").alias("o")).distinct().join(facts, ATOM_KEY, "left_anti")
    open_ = Materialized(atoms, "open")  # body atoms that aren't facts
    if rounds is None:
        ends = _roots(steps.df.select("_n", F.col("head.pred").alias("pred"), F.col("head.a0").alias("s"), F.col("head.a1").alias("o")), open_.df)
        if ends is not None:  # two atoms of a step may end in one, which then counts twice
            last = open_.df.join(ends, ATOM_KEY, "left")
            open_ = Materialized(last.select("_n", *[F.coalesce(r, k).alias(k) for r, k in zip(("_rp", "_rs", "_ro"), ATOM_KEY, strict=True)]), "open")
    needed = Materialized(open_.df.groupBy("_n").agg(F.count("*").alias("needed")), "needed")
    heads = steps.df.select("_n", F.col("head.pred").alias("pred"), F.col("head.a0").alias("s"), F.col("head.a1").alias("o"))
    closed = steps.df.select("_n").join(needed.df, "_n", "left_anti")  # steps whose body is proved
    fresh = Materialized(heads.join(closed, "_n").select(*ATOM_KEY).distinct(), "proved").df
    proved, hits, done = fresh, None, 1
    while not fresh.isEmpty():
        now = Materialized(open_.df.join(fresh, ATOM_KEY).groupBy("_n").agg(F.count("*").alias("hits")), "hits").df
        hits = now if hits is None else hits.unionByName(now)
        total = hits.join(now.select("_n"), "_n", "left_semi").groupBy("_n").agg(F.sum("hits").alias("hits"))
        full = Materialized(total.join(needed.df, "_n").where("hits = needed").select("_n"), "closed").df
        closed = closed.unionByName(full)
        if rounds is not None and done >= rounds:
            break
        fresh = Materialized(heads.join(full, "_n").select(*ATOM_KEY).distinct().join(proved, ATOM_KEY, "left_anti"), "proved").df
        proved, done = proved.unionByName(fresh), done + 1
    bad = steps.df.join(closed, "_n", "left_anti").select("gid").distinct()
    return evidence.join(bad, "gid", "left_anti")


def prune_instances(instances: DataFrame, facts: DataFrame) -> DataFrame:
    """Rule instances (rule_id, pred, s, o, body) whose bodies follow from facts and kept instances."""
    rows = numbered(instances, "instances")
    evidence = rows.select(F.col("_n").alias("gid"), F.array(F.struct(F.lit(0).alias("depth"), F.col("rule_id"), F.struct("pred", F.col("s").alias("a0"), F.col("o").alias("a1")).alias("head"), F.col("body"))).alias("steps"))
    kept = fp_batch(evidence, facts).select(F.col("gid").alias("_n"))
    return rows.join(kept, "_n", "left_semi").drop("_n")
