"""Applying a function of whole texts to a column, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python worker works on at a time (one longer text is a slice of its own).
SLICE_CHARS = 4 << 20

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def arrow_type(name: str) -> pa.DataType:
    """The Arrow type of a simple Spark type name or an array of one."""
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return ARROW[name]


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    fields: dict[str, str],
    text_col: str,
    keep: list[str],
    limit: int = SLICE_CHARS,
    prefix: str = "",
) -> DataFrame:
    """``keep`` columns of ``df`` as they are, and ``fields`` computed from ``text_col``.

    ``make()`` is called once in each task and returns a function from a list of texts (None
    for null) to one list for each field. Only ``keep`` and the text travel to Python (the
    text once, if it is kept and a string); other columns of ``df`` are pruned, so their names
    can't clash with ``fields``. ``prefix`` goes before the names of the fields, for callers
    that keep columns of any name. No shuffle.
    """
    kept = [f for c in keep for f in df.schema.fields if f.name == c]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"`{prefix}{n}` {t}" for n, t in fields.items())).fields])
    types = {n: arrow_type(t) for n, t in fields.items()}
    columns = [F.col(f"`{c}`") for c in keep]
    if text_col in keep and df.schema[text_col].dataType == T.StringType():
        at = list(keep).index(text_col)
    else:
        at = len(columns)
        columns.append(F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            texts = b.column(at).to_pylist()
            own = [b.column(i) for i in range(len(kept))]
            for lo, hi in slices(texts, limit):
                out = f(texts[lo:hi])
                arrays = [c.slice(lo, hi - lo) for c in own] + [x if isinstance(x := out[n], pa.Array) else pa.array(x, t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ``like``, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
