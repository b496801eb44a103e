"""How text filters interact: what each removes at each place of every order.

A document is a mask of the filters that it fails, and the documents of a part are counts of
masks, at most 2^k cells. All orders of the filters are visited by swapping two neighbours at a
time; a swap changes what is kept after one step only, so two steps are recomputed from the
cells. Each filter's removals are added up along the walk, which gives its Shapley value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.plans.materialize import materialize

#: The filters by letter; bit i of a mask is the i-th. E needs the whole table, the others a text.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: What parts words: blank and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
#: Parts whose orders are held in memory at once.
PARTS = 64

_ROWS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text (not null) fails.

    A: under 50 words. B: under 65 % of the words are distinct. C: over 5 % of the code points
    are A-Z. D: one of ``#$%&*|`` occurs. A text without words fails only A of these.
    """
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of documents (part, mask, n, good, toxic) by the filters that they fail.

    A null text is empty, a null part the empty string. E fails for a text that a smaller id has
    too; a null id is neither smaller nor larger than another and has no labels. Labels of one id that differ count
    as good or toxic if one of them does.

    Rows are aggregated before each shuffle. All copies of a text but those of its smallest id
    fail E: so all are counted as failing, and those of the smallest id, found by a join on text
    and id, are taken back. No key of that join has more rows than there are parts to share an id.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")
    )
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    key = ["part", "mask", "good", "toxic"]
    groups = materialize(rows.groupBy("digest", *key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min("id").alias("id"), F.min_by("n", "id").alias("first")), "texts")
    firsts = groups.join(groups.groupBy("digest").agg(F.min("id").alias("id")), ["digest", "id"], "left_semi")
    own = [F.col(c) for c in ("part", "good", "toxic")]
    counted = [
        groups.select(*own, F.col("mask").bitwiseOR(REPEATED).alias("mask"), (F.col("n") - F.col("no_id")).alias("n")),
        groups.where("no_id > 0").select(*own, "mask", F.col("no_id").alias("n")),
        firsts.select(*own, "mask", F.col("first").alias("n")),
        firsts.select(*own, F.col("mask").bitwiseOR(REPEATED).alias("mask"), (-F.col("first")).alias("n")),
    ]
    found = reduce(DataFrame.unionByName, counted)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def adjacent_swaps(k: int) -> Iterator[int]:
    """Places i whose swap with i + 1, one after the other, visits all orders of k things."""
    order, left = list(range(k)), [True] * k
    while True:
        for x in range(k - 1, -1, -1):  # the largest that can move the way that it looks
            i = order.index(x)
            j = i - 1 if left[x] else i + 1
            if 0 <= j < k and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, k):
            left[y] = not left[y]
        yield min(i, j)


def walk(counts: np.ndarray, k: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Visits all orders over ``counts`` (kind, part, mask).

    Returns the orders' letters, the filter at each (order, step), what is ``kept`` after and
    ``removed`` at it, as (order, step, kind, part).
    """
    masks = np.arange(1 << k)

    def free_of(failed: int) -> np.ndarray:
        return counts[:, :, masks & failed == 0].sum(-1)

    order = list(range(k))
    kept = [free_of((1 << i) - 1) for i in range(k + 1)]
    removed = [kept[i] - kept[i + 1] for i in range(k)]
    names, at, all_kept, all_removed = [], [], [], []

    def visit() -> None:
        names.append("".join(FILTERS[f] for f in order))
        at.append(list(order))
        all_kept.append(np.stack(kept[1:]))
        all_removed.append(np.stack(removed))

    visit()
    for i in adjacent_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        kept[i + 1] = free_of(sum(1 << f for f in order[: i + 1]))
        removed[i], removed[i + 1] = kept[i] - kept[i + 1], kept[i + 1] - kept[i + 2]
        visit()
    return names, np.array(at), np.stack(all_kept), np.stack(all_removed)


def _orders(parts: list[str], cells: list[list[dict]]) -> pa.RecordBatch:
    k = len(FILTERS)
    counts = np.zeros((3, len(parts), 1 << k), np.int64)
    for p, found in enumerate(cells):
        for c in found:
            counts[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
    names, at, kept, removed = walk(counts, k)
    n_orders = len(names)
    fails = np.stack([counts[0][:, np.arange(1 << k) >> f & 1 == 1].sum(-1) for f in range(k)])
    alone = np.stack([counts[0][:, 1 << f] for f in range(k)])
    shapley = np.zeros((k, len(parts)), np.int64)
    for f, r in zip(at.reshape(-1), removed[:, :, 0].reshape(-1, len(parts)), strict=True):
        shapley[f] += r
    gone = removed[:, :, 0]
    columns = [
        pa.array(np.tile(np.array(parts, dtype=object), n_orders * k), pa.string()),
        pa.array(np.repeat(np.array(names, dtype=object), k * len(parts)), pa.string()),
        pa.array(np.tile(np.repeat(np.arange(1, k + 1), len(parts)), n_orders), pa.int32()),
        *(pa.array(x.reshape(-1), pa.int64()) for x in (kept[:, :, 0], gone, fails[at] - gone, alone[at], removed[:, :, 1], removed[:, :, 2], shapley[at])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _ROWS.split(", ")])


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the five filters and step.

    ``kept`` after the step; ``removed`` at it, and of these ``good_lost`` and ``toxic_lost``;
    ``redundant``: fail this filter but are gone already; ``unique_fails``: fail only this one;
    ``shapley``: removed by this filter in all orders together. Parts without failures have
    zeros; an empty table has no rows; other columns of ``docs`` are dropped, whatever their names.
    """
    by_part = cells(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^5 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PARTS):
                some = b.slice(start, PARTS)
                yield _orders(some.column(0).to_pylist(), some.column(1).to_pylist())

    return by_part.mapInArrow(run, _ROWS)
