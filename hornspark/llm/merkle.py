"""Merkle manifest of a table: a tree of SHA-256 digests for each group, and one over the groups' roots.

Parents are combined by key: a partial parent holds the digests of those of its children that
its task has seen, by their place. The number of leaves gives every parent's number of
children; a parent that has all of them becomes a digest at once and goes on as a child of its
own parent in the same task. As leaves come in order, nearly all of a tree closes where its
leaves lie. What stays partial is a few parents a task and level, which are shuffled by their key
and combined again, until nothing is left. Finished parents keep their children's digests; these
links, followed from the root down, give every leaf its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.llm.ordering import numbered
from hornspark.plans.materialize import Materialized, materialize

#: Children of a node.
ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The steps from a leaf to the root: the digests on both sides of the path, joined.
PATH = "array<struct<left:string,right:string>>"
_PARENT = "key string, n bigint, level int, idx bigint, slots array<int>, children array<string>, digest string"


def digest_of(values: list[Column]) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _levels(n: Column, arity: int) -> Column:
    """Levels of parents over ``n`` leaves (63 bits of them at most); none over one."""
    deepest = next(d for d in range(64) if arity**d >= 2**63)
    return sum((F.when(n > F.lit(arity**d), 1).otherwise(0) for d in range(deepest)), F.lit(0))


class Parents:
    """Partial parents of one tree: created by a first child, merged with more, closed when all are there."""

    def __init__(self, arity: int, n: int):
        self.arity, self.n = arity, n
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.closed: list[tuple] = []

    def add(self, level: int, idx: int, slots: list[int], digests: list[str]) -> None:
        while True:
            below = -(-self.n // self.arity ** (level - 1))
            children = self.partial.setdefault((level, idx), {})
            children.update(zip(slots, digests, strict=True))
            if len(children) < min(self.arity, below - self.arity * idx):
                return
            del self.partial[level, idx]
            ordered = [children[i] for i in range(len(children))]
            digest = hashlib.sha256("".join(ordered).encode()).hexdigest()
            self.closed.append((level, idx, list(range(len(ordered))), ordered, digest))
            if below <= self.arity:
                return
            level, idx, slots, digests = level + 1, idx // self.arity, [idx % self.arity], [digest]

    def rows(self, last: bool) -> list[tuple]:
        """Closed parents, and after the last child also the partial ones."""
        out, self.closed = self.closed, []
        if last:
            out += [(*at, sorted(c), [c[i] for i in sorted(c)], None) for at, c in self.partial.items()]
        return out


def _combine(arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Combines children (key, n, level, idx of the parent, slots, children), which come sorted by key."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]
    names = ["key", "n", "level", "idx", "slots", "children", "digest"]

    def batch(key: str, n: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[key] * len(rows), [n] * len(rows), *map(list, zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parents = None, None
        for b in batches:
            for k, n, level, idx, slots, digests in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    if parents and (rows := parents.rows(last=True)):
                        yield batch(key, parents.n, rows)
                    key, parents = k, Parents(arity, n)
                parents.add(level, idx, slots, digests)
            if parents and (rows := parents.rows(last=False)):
                yield batch(key, parents.n, rows)
        if parents and (rows := parents.rows(last=True)):
            yield batch(key, parents.n, rows)

    return run


def build(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """All inner nodes (key, n, level, idx, children, digest) of the trees over ``leaves`` (key, pos, n, digest).

    A tree of one leaf has none. The rounds are at most the levels, since each closes all parents
    whose children are closed.
    """
    now = leaves.where("n > 1").select(
        "key", "n", F.lit(1).alias("level"), F.expr(f"pos div {arity}").alias("idx"), F.array((F.col("pos") % arity).cast("int")).alias("slots"), F.array("digest").alias("children"), "pos"
    )
    now = now.sortWithinPartitions("key", "pos").drop("pos")
    done = None
    while True:
        rows = Materialized(now.mapInArrow(_combine(arity), _PARENT), "parents").df
        closed = rows.where("digest is not null").drop("slots")
        done = closed if done is None else done.unionByName(closed)
        frontier = rows.where("digest is null").drop("digest")
        if frontier.isEmpty():
            return done
        now = frontier.repartition("key", "level", "idx").sortWithinPartitions("key")


def roots(leaves: DataFrame, parents: DataFrame, arity: int = ARITY) -> DataFrame:
    """(key, n, digest) of every tree."""
    top = parents.where(F.col("level") == _levels(F.col("n"), arity)).select("key", "n", "digest")
    return top.unionByName(leaves.where("n = 1").select("key", "n", "digest"))


def with_paths(leaves: DataFrame, parents: DataFrame, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` with ``path``, their way up to the root of their tree and on along ``above``.

    ``above`` has one row for each tree: key, n, ``up`` (the path that follows) and more columns,
    which the leaves get too. A parent passes its own path to its children, level by level, so
    no join has more than ``arity`` rows of a key.
    """
    more = [c for c in above.columns if c not in ("key", "n", "up")]
    starts = above.withColumn("_level", _levels(F.col("n"), arity))
    depth = parents.agg(F.max("level")).first()[0] or 0

    def longer(slot: Column) -> Column:
        side = F.struct(F.array_join(F.slice("children", F.lit(1), slot), "").alias("left"), F.array_join(F.slice("children", slot + 2, F.lit(arity)), "").alias("right"))
        return F.concat(F.array(side), F.col("up"))

    nodes, out = None, None
    for level in range(depth, 0, -1):
        start = starts.where(F.col("_level") == level).select("key", F.lit(0).cast("bigint").alias("idx"), "up", *more)
        nodes = start if nodes is None else nodes.unionByName(start)
        at = parents.where(F.col("level") == level).select("key", "idx", "children").join(nodes, ["key", "idx"])
        if level > 1:
            child = at.select("*", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("_slot"))
            nodes = child.select("key", (F.col("idx") * arity + F.col("_slot")).alias("idx"), longer(F.col("_slot")).alias("up"), *more)
        else:
            found = leaves.where("n > 1").withColumn("idx", F.expr(f"pos div {arity}")).join(at, ["key", "idx"])
            out = found.withColumn("path", longer((F.col("pos") % arity).cast("int"))).select(*leaves.columns, "path", *more)
    alone = leaves.where("n = 1").join(starts.where("_level = 0").select("key", F.col("up").alias("path"), *more), "key").select(*leaves.columns, "path", *more)
    return alone if out is None else out.unionByName(alone)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", arity: int = ARITY, forged: Column | None = None) -> DataFrame:
    """For each row its id and group, ``leaf``, ``subroot`` of its group, ``root`` of the table and ``path`` between.

    A leaf is the digest of ``columns``. Leaves of a group ascend by id (nulls first), rows of
    equal ids by their digests; groups ascend bytewise, the null group first. Runs of ``arity``
    nodes become one until one is left, so the root of one row is its leaf. Repeated rows are
    leaves of their own; an empty table has no rows; other columns are dropped, whatever their
    names. ``forged``: another digest for a row, carried along as ``forged`` (null: none).
    """
    group = F.col(f"`{group_col}`").cast("string")
    own = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("g"), group)).alias("key"),
        F.col(f"`{id_col}`").alias("_id"),
        digest_of([F.col(f"`{c}`") for c in columns]).alias("digest"),
        (F.lit(None).cast("string") if forged is None else forged).alias("forged"),
    )
    leaves = numbered(materialize(own, "leaves"), "key", "_id", "digest")
    parents = build(leaves, arity)
    groups = materialize(roots(leaves, parents, arity), "subroots").select(F.lit("").alias("key"), F.col("key").alias("_group"), F.col("n").alias("_n"), "digest")
    tops = numbered(groups, "key", "_group")
    over = build(tops, arity)
    root = roots(tops, over, arity).select("key", "n", F.col("digest").alias("root"), F.array().cast(PATH).alias("up"))
    above = with_paths(tops, over, root, arity).select(F.col("_group").alias("key"), F.col("_n").alias("n"), F.col("path").alias("up"), F.col("digest").alias("subroot"), "root")
    found = with_paths(leaves, parents, materialize(above, "above"), arity)
    named = F.when(F.col("key") != "", F.substr("key", F.lit(2)))
    return found.select(F.col("_id").alias(id_col), named.alias(group_col), F.col("digest").alias("leaf"), "subroot", "root", "path", "forged")


def tampered(text_col: str, columns: tuple[str, ...], where: Column) -> Column:
    """Another digest for the rows of ``where``: of the same fields, but the text's A-Z lower-cased."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    return F.when(where, digest_of([text if c == text_col else F.col(f"`{c}`") for c in columns]))


def audit(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", text_col: str = "text", every: int = 5, **options) -> DataFrame:
    """The manifest, with the roots recomputed from leaves of which about one in ``every`` is tampered with.

    Tampered with are the rows the CRC-32 of whose decimal id is divisible by ``every``; a null id
    never is. ``folded_root`` is recomputed from that leaf and the siblings of the manifest,
    ``verified`` says that it is the root.
    """
    where = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % every == 0
    m = manifest(docs, columns, id_col, forged=tampered(text_col, columns, where), **options)
    folded = fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root")
    out = m.select(*[c for c in m.columns if c not in ("path", "forged")], proof_digest(F.col("path")).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
