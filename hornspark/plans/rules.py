"""Rules as Python values: parsing, shapes, join orders, relevance."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hornspark.functions.terms import ATOM


@dataclass(frozen=True, order=True)
class Atom:
    """Terms are constants (0 or more) or variables (-1, -2, ...)."""

    pred: int
    a0: int
    a1: int


@dataclass(frozen=True)
class Rule:
    rule_id: int
    head: Atom
    body: tuple[Atom, ...]
    weight: float = 1.0

    def __post_init__(self):
        if not self.body:
            raise ValueError(f"rule {self.rule_id} has no body")


@dataclass(frozen=True)
class NamedAtom:
    pred: str
    args: tuple[str, str]


@dataclass(frozen=True)
class NamedRule:
    """A parsed rule before its names are encoded."""

    name: str
    head: NamedAtom
    body: tuple[NamedAtom, ...]
    weight: float = 1.0


_ATOM = re.compile(r"\s*([^\s(),]+)\s*\(\s*([^(),]+?)\s*,\s*([^(),]+?)\s*\)")


def is_variable(name: str) -> bool:
    """Variables are spelled with an initial capital or as one lower-case letter."""
    return bool(re.fullmatch(r"[a-z]|[A-Z].*", name))


def parse_atoms(text: str) -> tuple[NamedAtom, ...]:
    found = tuple(NamedAtom(m[1], (m[2], m[3])) for m in _ATOM.finditer(text))
    left = _ATOM.sub("", text).strip(" ,.\t")
    if not found or left:
        raise ValueError(f"not a list of binary atoms: {text!r}")
    return found


def parse_rule(line: str, name: str) -> NamedRule:
    """``head :- body.`` or ``name:weight:body -> head``."""
    if ":-" in line:
        head, body = line.split(":-", 1)
        return NamedRule(name, parse_atoms(head)[0], parse_atoms(body))
    parts = line.split(":", 2)
    body, arrow, head = parts[-1].rpartition("->")
    if len(parts) < 3 or not arrow:
        raise ValueError(f"not a rule: {line!r}")
    return NamedRule(parts[0].strip() or name, parse_atoms(head)[0], parse_atoms(body), float(parts[1] or 1))


def parse_rules(lines: list[str]) -> tuple[list[NamedRule], list[str]]:
    """Rules in alphabetical order of their text, and the lines that aren't rules."""
    rules, rejected = [], []
    for line in sorted(x.strip() for x in lines if x.strip() and not x.strip().startswith("#")):
        try:
            rules.append(parse_rule(line, f"r{len(rules)}"))
        except ValueError:
            rejected.append(line)
    return rules, rejected


def encode_rule(rule: NamedRule, rule_id: int, predicates: dict[str, int], entities: dict[str, int]) -> Rule:
    variables: dict[str, int] = {}

    def term(name: str) -> int:
        return variables.setdefault(name, -1 - len(variables)) if is_variable(name) else entities[name]

    def of(a: NamedAtom) -> Atom:
        return Atom(predicates[a.pred], *map(term, a.args))

    return Rule(rule_id, of(rule.head), tuple(map(of, rule.body)), rule.weight)


@dataclass(frozen=True)
class Shape:
    """The pattern of variables of head and body: 0, 1, ... by first appearance; constants are -1, -2, ..."""

    head: tuple[int, int]
    body: tuple[tuple[int, int], ...]

    def order(self, first: int | None, bound: frozenset[int] = frozenset(), among: tuple[int, ...] | None = None) -> list[int]:
        """Body positions in a join order: next is the atom with the most bound arguments."""
        rest = list(range(len(self.body)) if among is None else among)
        known, out = set(bound), []
        while rest:
            i = first if first in rest else max(rest, key=lambda j: (sum(v < 0 or v in known for v in self.body[j]), -j))
            rest.remove(i)
            out.append(i)
            known.update(v for v in self.body[i] if v >= 0)
        return out

    def needed_after(self, done: list[int]) -> set[int]:
        """Variables that the head or other atoms than ``done`` use."""
        return {v for v in self.head if v >= 0} | {v for j, b in enumerate(self.body) if j not in done for v in b if v >= 0}


def shape_of(rule: Rule) -> tuple[Shape, list[int]]:
    names: dict[int, int] = {}
    constants: list[int] = []

    def slot(t: int) -> int:
        if t < 0:
            return names.setdefault(t, len(names))
        constants.append(t)
        return -len(constants)

    return Shape((slot(rule.head.a0), slot(rule.head.a1)), tuple((slot(b.a0), slot(b.a1)) for b in rule.body)), constants


def by_shape(rules: list[Rule]) -> dict[Shape, list[tuple[Rule, list[int]]]]:
    """Rules of one shape share one join plan; only their predicates and constants differ."""
    out: dict = defaultdict(list)
    for r in rules:
        shape, constants = shape_of(r)
        out[shape].append((r, constants))
    return dict(out)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation: the plan holds them, so no job and no Python worker reads them."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    if any(isinstance(f.dataType, T.ArrayType) for f in fields):
        names = ("pred", "a0", "a1")
        columns = [[[dict(zip(names, a, strict=True)) for a in x] for x in c] if isinstance(f.dataType, T.ArrayType) else c for f, c in zip(fields, columns, strict=True)]
    return spark.createDataFrame(pa.table([pa.array(list(c), t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow), fields)


def shape_table(spark: SparkSession, shape: Shape, group: list[tuple[Rule, list[int]]], heads: set[int]) -> DataFrame:
    """The rules of a shape: rule_id, head predicate hp, body predicates p0.., constants c1.., and
    whether each body predicate heads a rule (d0..). As large as the program, so it is broadcast."""
    m = len(shape.body)
    n = len(group[0][1])
    schema = "rule_id int, hp int, " + ", ".join([*(f"p{i} int" for i in range(m)), *(f"d{i} boolean" for i in range(m)), *(f"c{k + 1} bigint" for k in range(n))])
    rows = [(r.rule_id, r.head.pred, *(b.pred for b in r.body), *(b.pred in heads for b in r.body), *c) for r, c in group]
    return local_frame(spark, rows, schema)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule: rule_id, hp, h0, h1, body, weight."""
    rows = [(r.rule_id, r.head.pred, r.head.a0, r.head.a1, [(b.pred, b.a0, b.a1) for b in r.body], float(r.weight)) for r in rules]
    return local_frame(spark, rows, f"rule_id int, hp int, h0 bigint, h1 bigint, body array<{ATOM}>, weight double")


def reachable(rules: list[Rule], predicates: set[int]) -> list[Rule]:
    """Rules that a backward search from goals of these predicates can use."""
    wanted, todo = set(), list(predicates)
    by_head: dict = defaultdict(list)
    for r in rules:
        by_head[r.head.pred].append(r)
    while todo:
        p = todo.pop()
        if p not in wanted:
            wanted.add(p)
            todo += [b.pred for r in by_head[p] for b in r.body]
    return [r for r in rules if r.head.pred in wanted]
