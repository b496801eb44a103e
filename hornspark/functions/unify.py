"""Most general unifiers of binary atoms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hornspark.functions.terms import atom, is_var


class Unifier:
    """The unifier of two atoms' arguments, as at most two bindings applied one after the other.

    The first binding is applied to the second arguments before these are compared, so that a
    variable that occurs twice is bound consistently. Between two variables the one of the
    second atom (the rule's or the fact's) is bound to that of the first.
    """

    def __init__(self, q0: Column, q1: Column, t0: Column, t1: Column):
        none = F.lit(None).cast("bigint")

        def bind(q: Column, t: Column) -> tuple[Column, Column, Column]:
            source = F.when(is_var(t) & (t != q), t).when(is_var(q) & (t != q), q).otherwise(none)
            target = F.when(is_var(t), q).otherwise(t)
            return source, target, is_var(t) | is_var(q) | (q == t)

        self.s0, self.r0, ok0 = bind(q0, t0)
        after = lambda x: F.when(x == self.s0, self.r0).otherwise(x)
        self.s1, self.r1, ok1 = bind(after(q1), after(t1))
        self.ok = ok0 & ok1


class Bindings:
    """Two bindings held in columns s0, r0, s1, r1."""

    def __init__(self, s0: Column, r0: Column, s1: Column, r1: Column):
        self.pairs = [(s0, r0), (s1, r1)]

    def term(self, x: Column) -> Column:
        for s, r in self.pairs:
            x = F.when(x == s, r).otherwise(x)
        return x

    def atom(self, a: Column) -> Column:
        return atom(a["pred"], self.term(a["a0"]), self.term(a["a1"]))

    def atoms(self, atoms: Column) -> Column:
        return F.transform(atoms, self.atom)

    def steps(self, steps: Column) -> Column:
        """The substitution over a proof's history."""
        return F.transform(steps, lambda s: F.struct(s["depth"].alias("depth"), s["rule_id"].alias("rule_id"), self.atom(s["head"]).alias("head"), self.atoms(s["body"]).alias("body")))
