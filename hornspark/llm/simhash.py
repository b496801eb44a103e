"""SimHash near-duplicates: BK-trees over shards of fingerprints that can be within the radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.batches import map_texts
from hornspark.llm.components import components
from hornspark.plans.materialize import Materialized, materialize

WORDS, SEED, BITS = 3, 42, 64
#: Fingerprints in one BK-tree; a larger shard is dealt over several trees, each searched by all.
TREE_NODES = 16384


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hash of each shingle of a text, repeats included; empty without words."""
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as meant here
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, ">u8")
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), ">u8", max(1, len(w) - words + 1))


def simhash_of(h: np.ndarray) -> int:
    """The 64-bit SimHash of (big-endian) shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">u8")[0]


def fingerprints_of(texts: list, words: int = WORDS) -> np.ndarray:
    """The 64-bit SimHash of each text, as unsigned integers."""
    out = np.zeros(len(texts), ">u8")
    for i, t in enumerate(texts):
        h = shingle_hashes(t, words)
        if len(h):
            out[i] = simhash_of(h)
    return out.astype(np.uint64)


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a (signed) long; ``prefix`` goes before its name.

    Words are lower-cased (A-Z) runs without ASCII white space; shingles of three words keep
    their repeats; fewer words give one shingle; none, or a null text, give fingerprint zero.
    """
    return map_texts(df, lambda: lambda texts: {"fp": pa.array(fingerprints_of(texts).view(np.int64))}, {"fp": "bigint"}, text_col, list(keep), prefix=prefix)


class BKTree:
    """A BK-tree over distinct 64-bit integers, searched by many at once.

    Children are keyed by their integer Hamming distance to the parent. By the triangle
    inequality a query at distance d from a node finds matches only below children keyed
    d - radius to d + radius; all other edges are not followed.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.root = 0
        todo = [(0, np.arange(1, len(values)))] if len(values) else []
        while todo:  # all values below a node are dealt to its children at once
            node, rest = todo.pop()
            if not len(rest):
                continue
            d = np.bitwise_count(values[rest] ^ values[node])
            order = np.argsort(d, kind="stable")
            cuts = np.flatnonzero(np.diff(d[order])) + 1
            for part in np.split(rest[order], cuts):
                child = int(part[0])
                self.children[node][int(np.bitwise_count(values[child] ^ values[node]))] = child
                todo.append((child, part[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each node with the indexes of the queries within the radius of it."""
        todo = [(self.root, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, at = todo.pop()
            d = np.bitwise_count(queries[at] ^ self.values[node]).astype(np.int64)
            near = at[d <= radius]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                below = at[np.abs(d - key) <= radius]
                if len(below):
                    todo.append((child, below))


def linked(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a tree's values and the queries.

    All links are found; those within a group of already connected values are not returned,
    so what leaves a task is no more than its values.
    """
    both = np.r_[tree, queries]
    label = np.arange(len(both))
    a, b = [], []
    for node, near in BKTree(tree).search(queries, radius):
        near = near + len(tree)
        differ = near[label[near] != label[node]]
        while len(differ):
            other = differ[0]
            if both[other] != both[node]:
                a.append(both[node])
                b.append(both[other])
            label[label == label[other]] = label[node]
            differ = differ[label[differ] != label[node]]
    return np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)


def block_keys(radius: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number, bit ranges) of each combination of blocks that close fingerprints may share.

    The 64 bits are cut into radius + 2 blocks. Fingerprints that differ in at most ``radius``
    bits agree in at least two of these, so each such pair shares at least one shard.
    """
    n = radius + 2
    cut = [round(i * BITS / n) for i in range(n + 1)]
    ranges = [(cut[i], cut[i + 1] - cut[i]) for i in range(n)]
    return [(k, list(pair)) for k, pair in enumerate(combinations(ranges, 2))]


class Scratch:
    """Written tables of one computation, deleted together once its result is written too."""

    def __init__(self):
        self.tables: list[Materialized] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Materialized(df, name))
        return self.tables[-1].df

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables = []


def dealt(keyed: DataFrame, keys: list[str], tree_nodes: int = TREE_NODES, more: DataFrame | None = None, write: Callable = materialize) -> DataFrame:
    """Rows of ``keyed`` (``keys``, ``fp``, ...) whose shard has another row, as tasks (``keys``, i, j).

    Shards are counted before any row moves, so most rows never do, and a large shard is no
    task of its own: one of over ``tree_nodes`` rows is dealt over several trees, and every
    pair i, j of these is a task; ``own`` is the row's tree. Trees hold TREE_BYTES of a column
    ``bytes``, if there is one. Rows that go on get the columns of ``more`` by ``fp``.
    """
    size = F.count("*") / F.lit(tree_nodes)
    if "bytes" in keyed.columns:
        size = F.greatest(size, F.sum("bytes") / F.lit(TREE_BYTES))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__n"), F.ceil(size).cast("int").alias("__parts"))
    shared = write(counts.where("__n > 1").drop("__n"), "shared")
    own = F.pmod(F.xxhash64("fp"), F.col("__parts")).cast("int")
    rest = [c for c in keyed.columns if c not in keys]
    rows = (
        keyed.join(shared, keys)
        .select(*keys, *rest, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__other"))
        .select(*keys, F.least("own", "__other").alias("i"), F.greatest("own", "__other").alias("j"), "own", *rest)
    )
    if more is not None:
        rows = rows.join(more, "fp")
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "fp")


def shards(batches: Iterator[pa.RecordBatch], width: int, text: bool = False) -> Iterator[tuple[np.ndarray, list]]:
    """The rows of each task, which are consecutive and have equal first ``width`` columns.

    All columns are integers; with ``text`` the last is a string and comes as a list.
    """
    held: list[tuple[np.ndarray, list]] = []

    def whole() -> tuple[np.ndarray, list]:
        return (held[0] if len(held) == 1 else (np.concatenate([r for r, _ in held]), [t for _, ts in held for t in ts]))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = batch.columns[:-1] if text else batch.columns
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        texts = batch.columns[-1].to_pylist() if text else []
        cut = [0, *(np.flatnonzero((np.diff(rows[:, :width], axis=0) != 0).any(axis=1)) + 1), len(rows)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if held and (held[0][0][0, :width] != rows[lo, :width]).any():
                yield whole()
                held = []
            held.append((rows[lo:hi], texts[lo:hi]))  # the last may go on in the next batch
    if held:
        yield whole()


def edge_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(nodes: DataFrame, radius: int = 2, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct ``fp`` of ``nodes`` within the radius.

    Every shard is a set of fingerprints that agree in two of the blocks, and has its own
    BK-trees; the trees travel to their tasks by a shuffle. (A broadcast of all shard trees
    would grow with the corpus.) See ``dealt`` for shards of over ``tree_nodes`` fingerprints.
    """

    def bits(start: int, n: int):
        return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND((1 << n) - 1)

    keys = []
    for k, ranges in block_keys(radius):
        value = F.lit(0).cast("bigint")
        for start, n in ranges:
            value = F.shiftleft(value, n).bitwiseOR(bits(start, n))
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("key")))
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.k", "x.key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in shards(batches, 4):
            i, j = rows[0, 2], rows[0, 3]
            fp = rows[:, 5]
            tree = fp if i == j else fp[rows[:, 4] == i]
            queries = fp if i == j else fp[rows[:, 4] == j]
            yield edge_batch(*linked(tree.view(np.uint64), queries.view(np.uint64), radius))

    return dealt(keyed, ["k", "key"], tree_nodes).mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, radius: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of ``df``: its id, ``fingerprint`` (16 hex digits), ``component_id`` and ``root``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable over links, the row's own included, and ``root`` the component's
    smallest fingerprint as a long. Equal fingerprints are one node, so copies are never
    paired with each other. Texts without words have fingerprint zero and are linked like any
    other. A null id is never the smallest; ``component_id`` is null only if no row of the
    component has an id. Repeated rows stay repeated; an empty table gives an empty one; other
    columns are dropped.
    """
    rows = materialize(fingerprints(df, text_col, (id_col,)).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    return labelled(rows, nodes, links(nodes, radius), id_col)


def labelled(rows: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, write: Callable = materialize) -> DataFrame:
    """The result of ``near_duplicates`` from rows (id, fp), nodes (fp, least) and edges of nodes."""
    found = components(edges)
    named = found.join(nodes, found["node"] == nodes["fp"]).select("fp", "root", "least")
    named = write(named, "named")  # linked fingerprints only
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = named.join(least, "root").select("fp", "root", "component_id")
    labels = nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # written out, so that the join below has its own exchange on either side and a fingerprint
    # with a third of all rows can be split at run time
    labels = write(labels, "labels")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


#: Words of a shingle, and least Jaccard similarity of linked documents, of ``similar_documents``.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: Documents of similarity 0.8 differ in 15 % of their SimHash bits on average, in 19 % if they are
#: so short that sums tie; the radius lies nearly four standard deviations above 19 % of 64 bits.
SIMILAR_RADIUS = 24
#: A shard is a set of documents with equal least hashes in one band of permutations. Two of
#: similarity s are together in none of the bands with probability (1 - s^BAND_ROWS)^BANDS:
#: 3 in a million at 0.8.
BANDS, BAND_ROWS = 24, 4
BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]
#: The lowest bytes of the least hashes, eight to a column. Two sets of similarity 0.8 agree in 77 of
#: the 96 on average, and in fewer than SAME_LEAST, nearly five standard deviations less, in some
#: 3 of a million cases.
SAME_COLUMNS = [f"m{k}" for k in range(BANDS * BAND_ROWS // 8)]
SAME_LEAST = 58
#: Documents, and bytes of their texts, in one tree of the second round, which verifies as it searches.
TREE_TEXTS, TREE_BYTES = 512, 32 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the permutations of 64-bit integers.
PERMUTATIONS = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of SIMILAR_WORDS words; fewer words are one shingle."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w, repeat(SEED)), np.uint64, len(w))
    n = max(1, len(w) - SIMILAR_WORDS + 1)
    s = np.full(n, min(len(w), SIMILAR_WORDS), np.uint64)
    for k in range(min(len(w), SIMILAR_WORDS)):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[k : k + n]
    s = mixed(s)
    s.sort()
    return s[np.flatnonzero(np.diff(s, prepend=~s[:1]))]


def similar_sets(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILAR at least."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return bool(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)


class ShingleSets:
    """The sets of one task, with shingles numbered, so that one set is held against many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, sets)]).tolist()
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.own = np.zeros(len(known), np.int32)

    def similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """For each of ``others`` whether its Jaccard similarity to ``one`` is SIMILAR at least."""
        mine, *rest = (self.ids[self.ends[k] : self.ends[k + 1]] for k in (one, *others.tolist()))
        n = np.array(list(map(len, rest)))
        ends = np.cumsum(n)
        self.own[mine] = 1
        shared = np.r_[0, np.cumsum(self.own[np.concatenate(rest)])]
        self.own[mine] = 0
        both = shared[ends] - shared[ends - n]
        return both >= SIMILAR * (n + len(mine) - both) - 1e-9


def bands_of(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard keys of a set of hashes, one for each band from its least hashes, and these hashes' lowest bytes."""
    least = np.full(len(PERMUTATIONS), 2**64 - 1, np.uint64)
    for lo in range(0, len(u), 1024):
        np.minimum(least, (u[lo : lo + 1024] * PERMUTATIONS[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key, (mixed(least) & np.uint64(255)).astype(np.uint8).view(np.uint64)


def sketches(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, ``fp`` and ``fp2`` (128 bits of digest of the set of shingles), ``n`` (its size), ``sim`` (its SimHash), the shard keys and SAME_COLUMNS."""
    names = ("fp", "fp2", "n", "sim", *BAND_COLUMNS, *SAME_COLUMNS)

    def f(texts):
        out = np.zeros((len(texts), len(names)), np.uint64)
        for i, t in enumerate(texts):
            u = shingle_set(t)
            if len(u):
                out[i, :4] = xxhash.xxh64_intdigest(u.tobytes(), SEED), xxhash.xxh3_64_intdigest(u.tobytes(), SEED), len(u), simhash_of(u.astype(">u8"))
            out[i, 4:] = np.concatenate(bands_of(u))
        return {c: pa.array(out[:, k].copy().view(np.int64)) for k, c in enumerate(names)}

    return map_texts(df, lambda: f, dict.fromkeys(names, "bigint"), text_col, list(keep), prefix=prefix)


def forest(rows: np.ndarray, texts: list | None = None) -> tuple[list, list, list]:
    """A spanning forest of the similar pairs of one task (rows: key, i, j, own, fp, n, sim, SAME_COLUMNS),
    and for each pair the digest of its tree's members.

    Candidates are fingerprints within the radius of a BK-tree's node, of sets whose sizes and
    least hashes allow the similarity. With ``texts`` each is verified before it counts as a link. Pairs that the
    links found so far connect are not looked at again.
    """
    at = np.arange(len(rows))
    alone = rows[0, 1] == rows[0, 2]
    tree, asked = (at, at) if alone else (at[rows[:, 3] == rows[0, 1]], at[rows[:, 3] == rows[0, 2]])
    label = at.copy()
    n, sim = rows[:, 5], np.ascontiguousarray(rows[:, 6]).view(np.uint64)
    same = np.ascontiguousarray(rows[:, 7:]).view(np.uint8)
    sets = None if texts is None else ShingleSets([shingle_set(t) for t in texts])
    a, b, at_node = [], [], []
    for node, near in BKTree(sim[tree]).search(sim[asked], SIMILAR_RADIUS):
        node, near = tree[node], asked[near]
        near = near[label[near] != label[node]]
        near = near[np.minimum(n[near], n[node]) >= SIMILAR * np.maximum(n[near], n[node]) - 1e-6]
        near = near[(same[near] == same[node]).sum(axis=1) >= SAME_LEAST]
        if sets is not None and len(near):
            near = near[sets.similar(node, near)]
        while len(near):
            other = near[0]
            a.append(rows[node, 4])
            b.append(rows[other, 4])
            at_node.append(node)
            label[label == label[other]] = label[node]
            near = near[label[near] != label[node]]
    if not a:
        return [], [], []
    order = np.lexsort((rows[:, 4], label))
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    digest = {int(label[m[0]]): xxhash.xxh64_intdigest(rows[m, 4].tobytes(), SEED) for m in np.split(order, cuts) if len(m) > 1}
    groups = np.array([digest[int(x)] for x in label[at_node]], np.uint64).view(np.int64)
    return groups.tolist(), a, b


def candidates(keyed: DataFrame, nodes: DataFrame, tree_nodes: int = TREE_NODES, write: Callable = materialize) -> DataFrame:
    """Pairs ``a``, ``b`` that connect those of ``keyed`` (key, fp) that may be similar.

    ``nodes`` has n, sim and SAME_COLUMNS of each fp. ``key`` of a pair is the digest of the
    members of its tree of pairs: shards with equal members have equal ones. If the nodes have
    a ``text`` (and ``keyed`` its ``bytes``), the pairs are verified, and connect those that are similar.
    """
    text = "text" in nodes.columns
    columns = ["n", "sim", *SAME_COLUMNS, *(["text"] if text else [])]
    tasks = dealt(keyed, ["key"], tree_nodes, nodes.select("fp", *columns), write).select("key", "i", "j", "own", "fp", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in shards(batches, 3, text):
            key, a, b = forest(rows, found if text else None)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, map(min, a, b), map(max, a, b))], names=["key", "a", "b"])

    return tasks.mapInArrow(run, "key bigint, a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose sets of shingles (``fp``, ``text``) have a Jaccard similarity of SIMILAR at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, x = None, None
        for batch in batches:
            good = []
            texts = batch.column(2), batch.column(3)
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a != before:
                    before, x = a, shingle_set(texts[0][k].as_py())
                y = shingle_set(texts[1][k].as_py())
                good.append(similar_sets(x, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], tree_nodes: int = TREE_NODES, write: Callable = materialize) -> DataFrame:
    """Edges ``a``, ``b`` that connect the ``nodes`` (of ``sketches``, distinct by fp) whose texts are similar.

    ``texts`` gives (fp, text), one row for each fp of a table.

    The first round takes a spanning forest of the candidates of each shard, so a large group of
    near copies gives no square of pairs, and verifies its edges. The members of a tree in which
    an edge fails are searched once more, now with their texts: each pair is verified where it is
    found. Trees of several shards with the same members are searched once, and those of two
    members, whose only pair is known, not at all.
    """

    keyed = nodes.select(F.explode(F.array(*BAND_COLUMNS)).alias("key"), "fp")
    tried = write(candidates(keyed, nodes, tree_nodes, write).distinct(), "tried")
    pairs = tried.select("a", "b").distinct()
    ends = Materialized(texts(tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "texts")
    good = write(verified(pairs, ends.df), "verified")
    open_ = tried.join(good.withColumn("ok", F.lit(True)), ["a", "b"], "left").groupBy("key").agg(F.count("*").alias("n"), F.count("ok").alias("n_ok"))
    again = write(tried.join(open_.where("n > 1 and n_ok < n").select("key"), "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("fp")).distinct(), "again")
    if again.isEmpty():
        ends.drop()
        return good
    # the members of a tree are ends of its pairs, so their texts are there
    own = ends.df.join(again.select("fp").distinct(), "fp", "left_semi").join(nodes.select("fp", "n", "sim", *SAME_COLUMNS), "fp")
    sized = again.join(ends.df.select("fp", F.octet_length("text").cast("bigint").alias("bytes")), "fp")
    more = write(candidates(sized, own, min(tree_nodes, TREE_TEXTS), write).select("a", "b").distinct(), "more")
    ends.drop()
    return good.unionByName(more)


def similar_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", write: Callable = materialize) -> DataFrame:
    """As ``near_duplicates``, but links are pairs of documents whose sets of shingles of five
    words have a Jaccard similarity of 0.8 at least; ``fingerprint`` and ``root`` are of the digests of the sets.

    Equal sets, by 128 bits of digest, are one node. Texts aren't written again but for those of candidates. Candidates share a shard and have close SimHashes, found by the
    shard's BK-trees; all are verified over the whole texts. A pair of similarity 0.8 is missed
    about once in some thousands, one of 0.85 or more hardly ever. ``write`` writes the
    intermediate tables; the result reads some of them.
    """
    text = F.col(f"`{text_col}`").cast("string")
    marked = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("mark"))
    rows, nodes = apart(write(sketches(marked, "text", ("id", "mark")), "sketches"), write)

    def texts(ends: DataFrame) -> DataFrame:
        """Texts by the id and the mark of one document of each set; repeated rows are one."""
        wanted = nodes.join(ends, "fp", "left_semi").select("fp", F.col("one.mark").alias("mark"), F.col("one.id").alias("_id"))
        return marked.join(wanted, "mark").where(F.col("id").eqNullSafe(F.col("_id"))).select("mark", "fp", "text").dropDuplicates(["mark", "fp"]).select("fp", "text")

    edges = similar_links(nodes.drop("least", "one"), texts, write=write)
    return labelled(rows.select("id", "fp"), nodes.select("fp", "least"), edges, id_col, write)


def apart(rows: DataFrame, write: Callable = materialize) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sketches`` (with id and mark) and their nodes, one for each set: unlike sets never share an ``fp``.

    Where sets of different ``fp2`` have one ``fp``, all but the first get another, made of both.
    """

    def grouped(rows: DataFrame) -> DataFrame:
        firsts = [F.first(c).alias(c) for c in ("n", "sim", *BAND_COLUMNS, *SAME_COLUMNS)]
        return write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "mark")).alias("one"), F.min("fp2").alias("lo"), F.max("fp2").alias("hi"), *firsts), "nodes")

    nodes = grouped(rows)
    clashes = nodes.where("lo <> hi").select("fp", "lo")
    if not clashes.isEmpty():
        other = F.when(F.col("fp2") != F.col("lo"), F.xxhash64("fp", "fp2")).otherwise(F.col("fp"))
        rows = write(rows.join(clashes, "fp", "left").withColumn("fp", other).drop("lo"), "sketches")
        nodes = grouped(rows)
    return rows, nodes.drop("lo", "hi")


def one_of_each(df: DataFrame, radius: int = 2, text_col: str = "text", id_col: str = "doc_id", similar: bool = False) -> DataFrame:
    """The rows of ``df`` that stand for their near-duplicate component: those with its smallest id.

    The components are those of ``near_duplicates``, or with ``similar`` of ``similar_documents``.
    Rows that repeat an id are one document, of which any one row stays. A row without an id
    stays only if no row of its component has one, and then one row of the component does.
    """
    written = Scratch()
    found = materialize(similar_documents(df, text_col, id_col, written) if similar else near_duplicates(df, radius, text_col, id_col), "duplicates")
    written.drop()
    key = F.col(f"`{id_col}`")
    keep = found.where(key == F.col("component_id")).groupBy(key.alias("__id")).agg(F.count("*").alias("n"))
    drop = materialize(found.where(key.isNotNull()).select(key.alias("__id")).distinct().join(keep, "__id", "left_anti"), "drop")
    # broadcast by Spark while the written list is small, shuffled beyond that
    kept = df.where(key.isNotNull()).join(drop, key == F.col("__id"), "left_anti")
    repeated = keep.where("n > 1").select("__id")
    if not repeated.isEmpty():
        again = kept.join(repeated, key == F.col("__id"), "left_semi").dropDuplicates([id_col])
        kept = kept.join(repeated, key == F.col("__id"), "left_anti").unionByName(again)
    nameless = found.where(key.isNull() & F.col("component_id").isNull()).select("fingerprint", "root").distinct()
    if not nameless.isEmpty():
        rows = (sketches if similar else fingerprints)(df.where(key.isNull()), text_col, tuple(df.columns), prefix="__")
        rows = rows.join(nameless.select(F.conv("fingerprint", 16, -10).cast("bigint").alias("__fp"), F.col("root").alias("__root")), "__fp")
        kept = kept.unionByName(rows.dropDuplicates(["__root"]).select(*[F.col(f"`{c}`") for c in df.columns]))
    return kept
