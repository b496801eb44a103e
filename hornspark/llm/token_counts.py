"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch are held as one flat array of symbols with a sequence
number each. In a round every sequence that still has a mergeable pair applies its own
lowest-rank pair, all its occurrences at once; the rounds of all sequences run together as
array operations. The symbols that survive are counted.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from hornspark.llm.batches import map_texts

#: Distinct pre-tokens whose counts a Python worker remembers; beyond it starts anew.
CACHE_ENTRIES = 400_000

#: The split of the byte-level pre-tokenizer (a fixed value of the format).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Texts without any character outside these blocks need no Unicode property: there a letter is
#: a word character that is no ASCII digit or underscore, and the faster standard module splits alike.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u2010-\u2027]")
_PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?[^\s\w]+(?:_+[^\s\w]*)*| ?_+(?:[^\s\w]+_*)*|\s+(?!\S)|\s+")

_TABLES: dict = {}


def pre_tokens(text: str) -> list[str]:
    return SPLIT.findall(text) if _OTHER.search(text) else _PLAIN.findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Ranks of a tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence of bytes."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        # the rank of the pair that starts at each symbol; the last of a sequence starts none
        rank = np.full(len(symbols), self.none)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(seq):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(seq)])
            live = least < self.none
            if not live.all():  # sequences without a mergeable pair are done
                on = np.repeat(live, sizes)
                symbols, seq, rank, least, sizes = symbols[on], seq[on], rank[on], least[live], sizes[live]
                if not len(seq):
                    break
            hit = rank == np.repeat(least, sizes)
            # occurrences that overlap (aaa) are taken from the left: every other one of a run
            at = np.flatnonzero(hit)
            fresh = np.r_[True, at[1:] != at[:-1] + 1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            gone = np.zeros(len(seq), bool)
            gone[at + 1] = True
            counts -= np.bincount(seq[at], minlength=len(counts))
            left = np.cumsum(~gone) - 1  # where each symbol goes
            symbols, seq, rank = symbols[~gone], seq[~gone], rank[~gone]
            at = left[at]
            touched = np.zeros(len(seq), bool)  # pairs that start or end at a new symbol
            touched[at] = touched[at[at > 0] - 1] = True
            redo = np.flatnonzero(touched)
            rank[redo] = self.none
            redo = redo[redo + 1 < len(seq)]
            redo = redo[seq[redo] == seq[redo + 1]]
            rank[redo] = self.rank(symbols[redo], symbols[redo + 1])
        return counts


class Counter:
    """Counts tokens of texts; the counts of pre-tokens seen before are remembered."""

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        self.merges, self.cache, self.known = Merges(path), cache, {}
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __call__(self, texts: list) -> list[int]:
        counts, pieces = [], []
        for t in texts:
            parts = self.special.split(t) if t and self.special and self.special.search(t) else [t or ""]
            counts.append(len(parts) - 1)
            pieces.append([w for p in parts for w in pre_tokens(p)])
        if len(self.known) > self.cache:
            self.known.clear()
        known = self.known
        fresh = list({w for ws in pieces for w in ws}.difference(known))
        fresh.sort(key=len)
        for lo in range(0, len(fresh), 50_000):  # sequences of like length end together
            some = fresh[lo : lo + 50_000]
            known.update(zip(some, self.merges.count([w.encode() for w in some]).tolist(), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, ws)) for n, ws in zip(counts, pieces, strict=True)]


def counter(path: str) -> Counter:
    if path not in _TABLES:
        _TABLES[path] = Counter(path)
    return _TABLES[path]


def token_counts(df: DataFrame, path: str, limit: int = 512, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text.

    The counts are those of the tokenizers library for the same file without added special
    tokens; a special string inside a text is one token, as is the library's default. A null
    text counts as empty (0 bytes, 0 tokens). Repeated rows stay; an empty table gives an
    empty one; other columns are dropped.
    """

    def make():
        count = counter(path)

        def f(texts):
            n = count(texts)
            return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return f

    return map_texts(df, make, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, text_col, list(keep))
