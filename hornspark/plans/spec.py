"""Engines from specifications such as ``sld.fp_batch.w1.d3``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.operators import enumeration, filters, proofs
from hornspark.operators.backward import Options, ground_queries
from hornspark.operators.export import rule_groundings
from hornspark.operators.forward import KEY, forward_chain, inject_witnesses
from hornspark.plans.kb import KnowledgeBase
from hornspark.plans.materialize import materialize

RESOLUTIONS = ("sld", "rtf", "enum")
#: Names of terminal filters, with two older ones.
FILTERS = {"fp_batch": "fp_batch", "fp_global": "fp_global", "none": "none", "prune": "fp_batch", "provset": "fp_global"}


@dataclass(frozen=True)
class Spec:
    """``width`` None is unlimited; it is 1 unless the text says otherwise, as is the depth."""

    resolution: str
    filter: str
    depth: int = 1
    width: int | None = 1
    prune_dead: bool = False
    full: bool = False


def parse_spec(text: str) -> Spec:
    """Parts in this order, all but the first optional: resolution, filter, pd, full or w<N>, d<N>; flat is ignored."""
    parts = [p for p in text.split(".") if p != "flat"]
    if not parts or parts[0] not in RESOLUTIONS:
        raise ValueError(f"unknown engine {text!r}")
    out = Spec(parts[0], "fp_batch" if parts[0] == "enum" else "none")
    rank = 0
    for p in parts[1:]:
        number = p[1:].isdigit() and int(p[1:])
        if p in FILTERS:
            now, out = 1, replace(out, filter=FILTERS[p])
        elif p == "pd":
            now, out = 2, replace(out, prune_dead=True)
        elif p == "full":
            now, out = 3, replace(out, full=True, width=None, depth=1)
        elif p[:1] == "w" and number is not False:
            now, out = 3, replace(out, width=number)
        elif p[:1] == "d" and number is not False:
            now, out = 4, replace(out, depth=out.depth if out.full else number)
        else:
            raise ValueError(f"unknown part {p!r} of {text!r}")
        if now <= rank:
            raise ValueError(f"{p!r} is out of place in {text!r}")
        rank = now
    return out


class Engine:
    """Grounds batches of queries over one knowledge base as a specification says.

    With ``fp_global`` the closure is derived once, to the fixpoint unless ``fc_depth`` bounds its
    rounds (then a warning says if it is incomplete), and its atoms count as facts; a query that
    is such an atom has its witness as proof. ``domains`` are those of enum; ``skipped`` has the
    rules of which it left out choices for want of one.
    """

    def __init__(self, spec: str | Spec, kb: KnowledgeBase, fc_depth: int | None = None, options: Options | None = None, grounding_hooks: list | None = None, domains: enumeration.Domains | None = None):
        self.spec = parse_spec(spec) if isinstance(spec, str) else spec
        self.kb = kb
        self.hooks = grounding_hooks or []
        self.domains = domains
        self.skipped: list[int] = []
        base = options or Options()
        self.options = replace(base, resolution=self.spec.resolution, depth=self.spec.depth, width=self.spec.width, prune_dead=self.spec.prune_dead)
        self.witnesses: DataFrame | None = None
        if self.spec.filter == "fp_global":
            closure = materialize(forward_chain(kb, fc_depth, witness=True), "closure")
            self.witnesses = closure.select(*KEY, "w.rule_id", "w.body")
            self.kb = kb.with_closure(closure.where("not is_base"))

    def ground(self, queries: DataFrame) -> DataFrame:
        """Groundings (gid, qid, steps, depth) of sld and rtf; instances (rule_id, pred, s, o, body, depth) of enum."""
        if self.spec.resolution == "enum":
            q = queries.where(F.coalesce("active", F.lit(True))) if "active" in queries.columns else queries
            q = q.select("pred", F.col("a0").alias("s"), F.col("a1").alias("o"))
            domain = self.domains or (self.kb.entities() if self.spec.full else None)
            self.skipped = []
            found = enumeration.enumerate_groundings(self.kb, q, self.spec.depth, self.spec.width, None if self.spec.full else 0, domain, self.skipped)
            if self.spec.filter != "none":
                found = enumeration.sound(self.kb, found)
        else:
            found, _ = ground_queries(self.kb, queries, self.options)
            if self.spec.filter == "fp_batch":
                found = filters.fp_batch(found, self.kb.facts)
            elif self.spec.filter == "fp_global":
                found = inject_witnesses(filters.fp_global(found, self.kb.known()), queries, self.witnesses)
        for hook in self.hooks:
            found = hook(found)
        return found

    def evidence(self, queries: DataFrame, k: int) -> DataFrame:
        """Groundings (gid, qid, steps, depth) of a batch of queries whatever the resolution.

        Those of enum are unfolded from the shared instances: the ``k`` smallest of each query,
        within the depth of the enumeration.
        """
        found = self.ground(queries)
        if self.spec.resolution != "enum":
            return found
        return proofs.evidence(queries, found, self.kb.facts, k, self.spec.depth)

    def rule_groundings(self, queries: DataFrame) -> DataFrame:
        found = self.ground(queries)
        return found.select("rule_id", "pred", "s", "o", F.array_sort("body").alias("body")).distinct() if self.spec.resolution == "enum" else rule_groundings(found)


def create_engine(spec: str, kb: KnowledgeBase, **options) -> Engine:
    return Engine(spec, kb, **options)
