"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from hornspark.llm.batches import map_texts

#: Texts longer than this are cut at safe boundaries before they are encoded.
SEGMENT_CHARS = 1 << 16

# Places that no match of the split pattern can span: white space after something that isn't,
# and a change between letters, digits and ASCII punctuation (but after an apostrophe, which
# may open a contraction). What stands right before such a place is never white space, so the
# pattern's look-ahead behind white space sees the same in a segment as in the whole text.
_SAFE = re.compile(r"(?<=\S)[ \t\r\n]|(?<=[A-Za-z])[0-9!-/:-@\[-`{-~]|(?<=[0-9])[A-Za-z!-/:-@\[-`{-~]|(?<=[!-&(-/:-@\[-`{-~])[A-Za-z0-9]")

#: Runs of white space from this length on are given to the library as a single match of the
#: pattern: its regular expressions overflow their stack on a run of a million.
WHITE_CHARS = 4096
_MAYBE_WHITE = re.compile(r"\s{%d,}" % WHITE_CHARS)
_WHITE = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{%d,}" % WHITE_CHARS)

_ENCODERS: dict = {}


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """``text`` cut into pieces of at least ``limit`` characters at boundaries of the split pattern.

    A run without such a boundary (say a million letters) stays whole.
    """
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(path: str, pattern: str):
    """The library's encoder for a rank file, built once in each Python worker."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def encode_text(enc, text: str, limit: int = SEGMENT_CHARS) -> list[int]:
    """Ids of a whole text, special tokens read as ordinary text."""
    if len(text) <= WHITE_CHARS:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    if _MAYBE_WHITE.search(text):
        for m in _WHITE.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last one may belong to the match behind it
            ids += [i for s in segments(text[at : m.start()], limit) for i in enc.encode_ordinary(s)]
            ids += enc._encode_single_piece(m[0][: end - m.start()])
            at = end
    return ids + [i for s in segments(text[at:], limit) for i in enc.encode_ordinary(s)]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``token_ids`` of every whole text.

    A null text counts as empty; an empty text has no ids. Repeated rows stay repeated; an
    empty table gives an empty one. Columns not in ``keep`` are dropped.
    """

    def make():
        enc = encoder(path, pattern)
        return lambda texts: {"token_ids": [encode_text(enc, t or "") for t in texts]}

    return map_texts(df, make, {"token_ids": "array<int>"}, text_col, list(keep))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the raw bytes of an array of ids.

    Bytes, not a string: a part of a text's ids may end inside a character. Null ids give
    null; an id outside the vocabulary fails.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    import pyarrow as pa

    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            out = pa.array([None if x is None else enc.decode_bytes(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], out], names=schema.names)

    return df.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, schema)


ROUND_TRIP = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "lossless": "boolean"}


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded
    bytes, ``lossless`` says whether these are the text's own. A null text counts as empty.
    With ``with_ids`` the ids are returned too. Nulls in ``keep`` columns pass through.
    """

    def make():
        enc = encoder(path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]

        def f(texts):
            out = {n: [] for n in (*ROUND_TRIP, *["token_ids"] * with_ids)}
            for t in texts:
                t = t or ""
                ids = encode_text(enc, t)
                back = enc.decode_bytes(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["lossless"].append(back == t.encode())
                if with_ids:
                    out["token_ids"].append(ids)
            return out

        return f

    return map_texts(df, make, ROUND_TRIP | ({"token_ids": "array<int>"} if with_ids else {}), text_col, list(keep))
