"""Join orders from the sizes of predicates and the fan-outs of their arguments."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.plans.rules import Rule, shape_of


@dataclass(frozen=True)
class Size:
    """Atoms of a predicate, and how many different subjects and objects they have."""

    atoms: float
    subjects: float
    objects: float


def sizes(atoms: DataFrame) -> DataFrame:
    """``n``, ``n_subjects`` and ``n_objects`` of each predicate of distinct atoms (pred, s, o)."""
    by_s = atoms.groupBy("pred", "s").agg(F.count("*").alias("n")).groupBy("pred").agg(F.sum("n").alias("n"), F.count("*").alias("n_subjects"))
    by_o = atoms.groupBy("pred", "o").agg(F.lit(1).alias("n")).groupBy("pred").agg(F.count("*").alias("n_objects"))
    return by_s.join(by_o, "pred")


@dataclass(frozen=True)
class Statistics:
    """The sizes of predicates. A predicate without one counts as the largest, all its values different."""

    sizes: dict[int, Size]

    @staticmethod
    def of(atoms: DataFrame) -> Statistics:
        """From a table (pred, s, o) of distinct atoms; a row for each predicate goes to the driver."""
        return Statistics({r["pred"]: Size(r["n"], r["n_subjects"], r["n_objects"]) for r in sizes(atoms).collect()})

    def size(self, pred: int) -> Size:
        if pred in self.sizes:
            return self.sizes[pred]
        most = max((s.atoms for s in self.sizes.values()), default=1.0)
        return Size(most, most, most)

    def rows(self, rule: Rule, positions: tuple[int, ...], bound: frozenset[int] = frozenset()) -> float:
        """Rows expected of the join of some body atoms, whatever their order.

        All combinations of atoms, thinned out by each constant and each variable that stands
        several times: of the numbers of values at its places all but the smallest divide (all of
        them, if it is ``bound`` to one value).
        """
        shape, _ = shape_of(rule)
        places: dict[int, list[float]] = {}
        rows = 1.0
        for i in positions:
            size = self.size(rule.body[i].pred)
            rows *= size.atoms
            for v, values in zip(shape.body[i], (size.subjects, size.objects), strict=True):
                if v < 0:
                    rows /= values
                else:
                    places.setdefault(v, []).append(values)
        for v, counts in places.items():
            rows /= prod(counts) / (1 if v in bound else min(counts))
        return rows


def join_order(rule: Rule, stats: Statistics, first: int | None = None, bound: frozenset[int] = frozenset()) -> tuple[list[int], float]:
    """Body positions in the order whose intermediate results have the fewest rows together, and that number.

    The best order of each set of body atoms is built up from the best ones of its subsets: a
    set has the same rows in any order, so the 2^m steps find the best of all m! orders. Of
    equal ones the first in the order of positions is taken. ``first`` is joined first;
    ``bound`` are variables (as in ``Shape``) that have values already.
    """
    m = len(rule.body)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # set: rows so far, order
    for done in range(1 << m):
        if done not in best:
            continue
        total, order = best[done]
        for i in range(m):
            if done >> i & 1 or (not order and first is not None and i != first):
                continue
            new = (total + stats.rows(rule, (*order, i), bound), [*order, i])
            at = done | 1 << i
            if at not in best or new < best[at]:
                best[at] = new
    total, order = best[(1 << m) - 1]
    return order, total
