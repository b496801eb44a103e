"""Terms and atoms as columns.

A term is a BIGINT: a constant is 0 or more, a variable negative. An atom is a struct of a
predicate (INT) and two terms. A goal list or a rule body is an array of atoms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = "struct<pred:int,a0:bigint,a1:bigint>"
STEP = f"struct<depth:int,rule_id:int,head:{ATOM},body:array<{ATOM}>>"


def atom(pred: Column, a0: Column, a1: Column) -> Column:
    return F.struct(pred.cast("int").alias("pred"), a0.cast("bigint").alias("a0"), a1.cast("bigint").alias("a1"))


def is_var(term: Column) -> Column:
    return term < 0


def ground(a: Column) -> Column:
    """Whether an atom has no variable."""
    return (a["a0"] >= 0) & (a["a1"] >= 0)


def all_ground(atoms: Column) -> Column:
    return F.forall(atoms, ground)


def body_flat(steps: Column) -> Column:
    """All body atoms of a proof, in the order in which its rules were applied."""
    return F.flatten(F.transform(steps, lambda s: s["body"]))


def show(atoms: Column) -> Column:
    """Readable text of an array of atoms: ``pred(a0,a1)`` joined by semicolons."""
    return F.array_join(F.transform(atoms, lambda a: F.concat(a["pred"].cast("string"), F.lit("("), a["a0"].cast("string"), F.lit(","), a["a1"].cast("string"), F.lit(")"))), ";")


def canonical_variables(atoms: Column) -> Column:
    """Atoms with their variables renamed -1, -2, ... by first appearance."""
    terms = F.flatten(F.transform(atoms, lambda a: F.array(a["a0"], a["a1"])))
    names = F.array_distinct(F.filter(terms, is_var))

    def new(t: Column) -> Column:
        return F.when(is_var(t), -F.array_position(names, t)).otherwise(t)

    return F.transform(atoms, lambda a: atom(a["pred"], new(a["a0"]), new(a["a1"])))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _refined(atoms: Column, names: Column, colours: Column) -> Column:
    """Colours of the variables by their colours and by the atoms that they are in, until these tell no more apart."""

    def once(c: Column) -> Column:
        def seen(x: Column, i: Column) -> Column:
            def term(t: Column) -> Column:
                return F.when(t == x, -1).when(is_var(t), -2 - F.get(c, F.array_position(names, t).cast("int") - 1)).otherwise(t).cast("bigint")

            own = F.transform(F.filter(atoms, lambda a: (a["a0"] == x) | (a["a1"] == x)), lambda a: F.struct(a["pred"].alias("p"), term(a["a0"]).alias("x"), term(a["a1"]).alias("y")))
            return F.struct(F.get(c, i).alias("c"), F.array_sort(own).alias("seen"))

        return let(F.transform(names, seen), lambda all_: let(F.array_sort(F.array_distinct(all_)), lambda order: F.transform(all_, lambda s: F.array_position(order, s).cast("int") - 1)))

    return F.aggregate(names, colours, lambda c, _: once(c))


def _swapped(atoms: Column, x: Column, y: Column) -> Column:
    """Atoms with two variables exchanged, sorted."""

    def new(t: Column) -> Column:
        return F.when(t == x, y).when(t == y, x).otherwise(t)

    return F.array_sort(F.transform(atoms, lambda a: atom(a["pred"], new(a["a0"]), new(a["a1"]))))


def _branches(atoms: Column, names: Column, colours: Column) -> Column:
    """The colourings that follow by singling out one variable of the first colour that several have.

    Variables that can be exchanged for an earlier one without a change of the atoms aren't tried.
    """
    shared = F.array_min(F.filter(colours, lambda c: F.size(F.filter(colours, lambda d: d == c)) > 1))

    def single(cell: Column) -> Column:
        tried = F.filter(cell, lambda v: ~F.exists(cell, lambda u: (u > v) & (_swapped(atoms, u, v) == atoms)))
        return F.transform(tried, lambda v: _refined(atoms, names, F.transform(names, lambda u, i: 2 * F.get(colours, i) + F.when(F.array_contains(cell, u) & (u != v), 1).otherwise(0))))

    return F.when(shared.isNull(), F.array(colours)).otherwise(let(F.filter(names, lambda v, i: F.get(colours, i) == shared), single))


def canonical_set(atoms: Column) -> Column:
    """Atoms as a set in a form that neither their order nor the names of their variables decide.

    Two states have one form just if a renaming of variables makes them the same set. Variables
    get colours by the atoms that they are in, and by their neighbours' colours; where several
    keep one colour, each of them is singled out in turn, and the least of all forms is taken.
    Only states with many parts that are alike but not exchangeable one by one have many
    such forms: k! for k copies of a pattern of two variables or more.
    """

    def form(a: Column, names: Column) -> Column:
        start = F.array(_refined(a, names, F.transform(names, lambda _: F.lit(0))))
        leaves = F.aggregate(names, start, lambda found, _: F.flatten(F.transform(found, lambda c: _branches(a, names, c))))

        def named(c: Column) -> Column:
            def new(t: Column) -> Column:
                return F.when(is_var(t), -1 - F.get(c, F.array_position(names, t).cast("int") - 1)).otherwise(t)

            return F.array_sort(F.transform(a, lambda x: atom(x["pred"], new(x["a0"]), new(x["a1"]))))

        return canonical_variables(F.array_min(F.transform(leaves, named)))

    def with_names(a: Column) -> Column:
        terms = F.flatten(F.transform(a, lambda x: F.array(x["a0"], x["a1"])))
        return let(F.array_distinct(F.filter(terms, is_var)), lambda names: form(a, names))

    plain = F.transform(atoms, lambda a: atom(a["pred"], a["a0"], a["a1"]))
    return let(F.array_sort(F.array_distinct(plain)), with_names)


def shift_variables(atoms: Column, by: Column | int) -> Column:
    """Atoms with every variable moved away from zero by ``by``."""
    by = F.lit(by) if isinstance(by, int) else by

    def new(t: Column) -> Column:
        return F.when(is_var(t), t - by).otherwise(t)

    return F.transform(atoms, lambda a: atom(a["pred"], new(a["a0"]), new(a["a1"])))
