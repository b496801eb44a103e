"""Size-partitioned MinHash containment search of short items in long documents.

An item counts as contained if a document has at least ``threshold`` of its distinct word
shingles. Only the short side is sketched: of an item with n shingles the
n - ceil(threshold * n) + 1 with the lowest hash values are kept (a bottom-k MinHash). A
document that contains the item can lack at most n - ceil(threshold * n) shingles, so it has
at least one of the sketch: the search finds every contained item, with no false negatives.
Documents are partitioned by size (powers of two of their word count), and those of a
partition look only for items small enough to be contained in them. Every candidate is
verified by counting exactly which of the item's shingles the document has.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.batches import slices
from hornspark.plans.materialize import materialize

WORDS, THRESHOLD = 5, 0.8
#: Shingles of items that are broadcast at once; more items are searched for in further passes.
BLOCK_SHINGLES = 200_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int) -> zip:
    return zip(*(words[i:] for i in range(n)), strict=False)


def needed(n: int, threshold: float) -> int:
    """Shingles of n that make up the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


class Sketches:
    """The sketches of a block of items, by the size that a document needs to contain them."""

    def __init__(self, items: list[tuple[str, list[str]]], threshold: float):
        self.threshold = threshold
        self.items = []
        by_size: dict = defaultdict(lambda: defaultdict(list))
        for key, words in items:
            m = min(WORDS, len(words))
            own = set(shingles(words, m))
            need = needed(len(own), threshold)
            sketch = sorted(own, key=lambda s: (xxhash.xxh64_intdigest(" ".join(s)), s))[: len(own) - need + 1]
            for s in sketch:
                by_size[(need + m - 1).bit_length(), m][s].append(len(self.items))
            self.items.append((key, m, own, need))
        #: (least bits of a document's word count, words of a shingle) -> shingle -> items
        self.by_size = {k: dict(v) for k, v in by_size.items()}
        self.probes: dict[int, list] = {}

    def probe(self, bits: int) -> list:
        """(words of a shingle, shingle -> items) for documents whose word count has so many bits."""
        if bits not in self.probes:
            merged: dict = defaultdict(dict)
            for (least, m), sketch in self.by_size.items():
                if least <= bits:
                    for s, at in sketch.items():
                        merged[m].setdefault(s, []).extend(at)
            self.probes[bits] = [(m, sketch, frozenset(sketch)) for m, sketch in merged.items()]
        return self.probes[bits]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(item, its shingles, those that the text has) for each item that the text contains."""
        words = words_of(text)
        found = []
        for m, sketch, keys in self.probe(len(words).bit_length()):
            some = keys.intersection(shingles(words, m))
            if not some:
                continue
            hits = set(shingles(words, m))
            for i in sorted({i for s in some for i in sketch[s]}):
                key, _, own, need = self.items[i]
                if (shared := len(own & hits)) >= need:
                    found.append((key, len(own), shared))
        return found


def _blocks(items: DataFrame, item_text: str, item_id: str, block_shingles: int) -> tuple[DataFrame, list]:
    """Items with their normalised words and key, and a function that reads each block of distinct ones."""
    item_type = items.schema[item_id].dataType.simpleString()

    def normal(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "words", "n"])

    normalized = items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`").cast("string")).mapInArrow(normal, f"item {item_type}, words string, n bigint").where("n > 0")
    normalized = materialize(normalized.withColumn("key", F.md5("words")), "items")
    distinct = materialize(normalized.groupBy("key").agg(F.first("words").alias("words"), F.max("n").alias("n")), "distinct-items")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(total / (block_shingles / 2)))  # half full on average, so that chance overfills none

    def read(k: int) -> list[tuple[str, list[str]]]:
        block = distinct.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k).select("key", "words")
        return [(r["key"], r["words"].split(" ")) for r in block.collect()]

    return normalized, [(lambda k=k: read(k)) for k in range(count)]


def contained(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row for each document and item that it contains.

    Columns: the ids, ``n_shingles`` of the item, ``n_shared`` of them in the document, and
    ``containment``. Words are lower-cased runs of letters and digits; shingles have five
    words (an item of fewer is one shingle of all its words). Items and documents that are
    null or have no word contain and are contained in nothing. Items of the same words are
    searched for once; repeated rows on either side give repeated results. Items are broadcast
    in blocks of ``block_shingles`` shingles, and each block is one pass over the documents,
    which aren't shuffled. Other columns are dropped.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    normalized, blocks = _blocks(items, item_text, item_id, block_shingles)
    schema = f"id {id_type}, key string, n_shingles bigint, n_shared bigint"
    found = spark.createDataFrame([], schema)
    for read in blocks:
        if not (rows := read()):
            continue
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            sketches = Sketches(shared.value, threshold)
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                for lo, hi in slices(texts):
                    out = [(i, *x) for i in range(lo, hi) for x in sketches.find(texts[i])]
                    cols = list(zip(*out, strict=True)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                        names=["id", "key", "n_shingles", "n_shared"],
                    )

        found = found.unionByName(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema))
    return found.join(normalized.select("key", "item"), "key").select(
        F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def without_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, as they are, whose text contains no item; see ``contained``. No shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for read in _blocks(items, item_text, item_id, block_shingles)[1]:
        if not (rows := read()):
            continue
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            sketches = Sketches(shared.value, threshold)
            for b in batches:
                yield b.filter(pa.array([not sketches.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
