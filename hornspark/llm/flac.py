"""FLAC columns: lossless 8-bit mono streams, written and read in array operations over all frames.

A stream is the marker, STREAMINFO, a seek table, and frames of 192 samples with fixed
block size. The encoder gives each frame the cheapest of: constant, verbatim, fixed linear
predictors of order 0 to 2, and a quantised linear predictor of order 2, with Rice-coded
residuals. The reader takes any frames of this shape (8-bit mono, one block size for all
frames): constant, verbatim, fixed of order 0 to 4, LPC of order 1 to 32, all partition
orders, both residual coding methods and escaped partitions; it verifies both checksums of
every frame and the stream's MD5.

Frames are parsed side by side: step t handles sample t of all frames of a batch, so the
Python work is that of one frame per batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hornspark.llm.batches import map_texts

BLOCK = 192
RATE = 8000
#: A seek point for every so many frames.
SEEK_FRAMES = 64
#: Frames that are written or read side by side; a longer stream takes several turns.
TURN = 1 << 13
LPC_PRECISION, LPC_SHIFT = 12, 10

# fixed values of the format
MARKER = b"fLaC"
SYNC = (0xFF, 0xF8)  # sync code, fixed block size
BLOCK_CODE, RATE_CODE, SAMPLE_CODE = 1, 4, 1  # 192 samples, 8 kHz, 8 bits
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
#: Leading zeros of each 16-bit number.
ZEROS = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)


def crc(table: np.ndarray, bits: int, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksum of the first ``lengths`` bytes of each row."""
    out = np.zeros(len(rows), np.int64)
    mask = (1 << bits) - 1
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # rows longer than each position
    cols = rows[order].T.copy()
    acc = out.copy()
    for t, n in enumerate(live):
        acc[:n] = ((acc[:n] << 8) & mask) ^ table[(acc[:n] >> (bits - 8)) ^ cols[t, :n]]
    out[order] = acc
    return out


class Writer:
    """Bits appended to every row of a byte matrix at once."""

    def __init__(self, rows: int, width: int):
        self.bytes = np.zeros((rows, width), np.uint8)
        self.flat = self.bytes.reshape(-1)
        self.base = np.arange(rows, dtype=np.int64) * width
        self.at = np.zeros(rows, np.int64)

    def put(self, value, bits) -> None:
        """``bits`` (16 at most) of ``value``, a number or one for each row."""
        v = np.broadcast_to(np.asarray(value, np.int64), self.at.shape) << (24 - bits - (self.at & 7))
        i = self.base + (self.at >> 3)
        self.flat[i] |= (v >> 16).astype(np.uint8)
        self.flat[i + 1] |= (v >> 8 & 255).astype(np.uint8)
        self.flat[i + 2] |= (v & 255).astype(np.uint8)
        self.at += bits

    def rice(self, u: np.ndarray, k: np.ndarray) -> None:
        """A unary quotient (zeros, then a one) and k bits; k is 14 at most."""
        self.at += u >> k
        self.put((1 << k) | (u & ((1 << k) - 1)), k + 1)


def number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (rows of 7) and how many."""
    out = np.zeros((len(n), 7), np.int64)
    size = np.ones(len(n), np.int64)
    out[:, 0] = n
    for length, bits in ((2, 11), (3, 16), (4, 21), (5, 26), (6, 31), (7, 36)):
        least = 7 if length == 2 else bits - 5
        at = np.flatnonzero(n >= 1 << least)
        if not len(at):
            break
        size[at] = length
        for j in range(length):
            part = n[at] >> (6 * (length - 1 - j))
            out[at, j] = (part & 63 | 0x80) if j else (part | (0xFF00 >> length & 0xFF))
    return out, size


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order 2 for each frame, from its autocorrelation."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    ok = det > 1e-6 * (r0 * r0 + 1)
    det = np.where(ok, det, 1)
    a = np.where(ok, (r1 * r0 - r1 * r2) / det, 0)
    b = np.where(ok, (r0 * r2 - r1 * r1) / det, 0)
    top = (1 << (LPC_PRECISION - 1)) - 1
    return tuple(np.clip(np.rint(c * (1 << LPC_SHIFT)), -top, top).astype(np.int64) for c in (a, b))


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames for rows of 192 samples: a byte matrix and each row's length."""
    n = len(x)
    x = x.astype(np.int64)
    c1, c2 = predictors(x)
    d1 = np.diff(x, axis=1)
    residuals = {
        ("fixed", 0): x,
        ("fixed", 1): d1,
        ("fixed", 2): np.diff(d1, axis=1),
        ("lpc", 2): x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> LPC_SHIFT),
    }
    best = np.full(n, 8 + 8 * BLOCK)  # verbatim
    kind, rice = np.zeros(n, np.int64), np.zeros(n, np.int64)
    kinds = [("verbatim", 0), ("constant", 0), *residuals]
    folded = {}
    for code, (name, order) in enumerate(residuals, 2):
        r = residuals[name, order]
        u = folded[name, order] = (r << 1) ^ (r >> 63)
        guess = np.clip(np.floor(np.log2(u.mean(axis=1) + 0.5)), 0, 13).astype(np.int64)
        for k in (guess, guess + 1):
            bits = (u >> k[:, None]).sum(axis=1) + u.shape[1] * (k + 1) + 18 + 8 * order + (9 + order * LPC_PRECISION) * (name == "lpc")
            better = bits < best
            best, kind, rice = np.where(better, bits, best), np.where(better, code, kind), np.where(better, k, rice)
    kind[(x == x[:, :1]).all(axis=1)] = 1
    num, size = number_bytes(numbers)
    head = np.concatenate([np.tile([*SYNC, BLOCK_CODE << 4 | RATE_CODE, SAMPLE_CODE << 1], (n, 1)), num], axis=1)
    out = np.zeros((n, BLOCK + 32), np.uint8)
    out[:, : head.shape[1]] = head
    check = crc(CRC8, 8, head, 4 + size)
    out[np.arange(n), 4 + size] = check
    lengths = np.zeros(n, np.int64)
    for code, (name, order) in enumerate(kinds):
        rows = np.flatnonzero(kind == code)
        if not len(rows):
            continue
        w = Writer(len(rows), out.shape[1])
        w.bytes[:] = out[rows]
        w.flat = w.bytes.reshape(-1)
        w.at = (5 + size[rows]) * 8
        own = x[rows]
        w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[name] << 1, 8)
        for j in range({"constant": 1, "verbatim": BLOCK}.get(name, order)):
            w.put(own[:, j] & 255, 8)
        if name == "lpc":
            w.put(LPC_PRECISION - 1, 4)
            w.put(LPC_SHIFT, 5)
            for c in (c1, c2):
                w.put(c[rows] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        if name in ("fixed", "lpc"):
            k = rice[rows]
            w.put(0, 6)  # Rice parameters of 4 bits, one partition
            w.put(k, 4)
            u = np.ascontiguousarray(folded[name, order][rows].T)
            for t in range(len(u)):
                w.rice(u[t], k)
        end = (w.at + 7) >> 3
        check = crc(CRC16, 16, w.bytes, end)
        at = np.arange(len(rows))
        w.bytes[at, end], w.bytes[at, end + 1] = check >> 8, check & 255
        out[rows], lengths[rows] = w.bytes, end + 2
    return out, lengths


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its length is a positive multiple of 192 bytes, its samples are byte - 128."""
    frames = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload's length must be a positive multiple of {BLOCK}")
    signed = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    first = np.cumsum(frames) - frames
    numbers = np.arange(len(signed)) - np.repeat(first, frames)
    body, sizes = bytearray(), []
    for lo in range(0, len(signed), TURN):
        rows, size = encode_frames(signed[lo : lo + TURN], numbers[lo : lo + TURN])
        body += rows[np.arange(rows.shape[1]) < size[:, None]].tobytes()
        sizes.append(size)
    lengths = np.concatenate([*sizes, np.zeros(0, np.int64)])
    ends = np.cumsum(lengths)
    out = []
    for i, n in enumerate(frames.tolist()):
        own = slice(first[i], first[i] + n)
        sizes, at = lengths[own], int(ends[own.start] - lengths[own.start])
        offsets = (ends[own] - sizes - at).tolist()
        points = b"".join((j * BLOCK).to_bytes(8) + offsets[j].to_bytes(8) + BLOCK.to_bytes(2) for j in range(0, n, SEEK_FRAMES))
        total = RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK
        info = BLOCK.to_bytes(2) * 2 + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3) + total.to_bytes(8) + hashlib.md5(signed[own]).digest()
        out.append(MARKER + b"\0" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points + body[at : int(ends[own.stop - 1])])
    return out


class Reader:
    """Bits taken from every row of a byte matrix at once."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        flat = np.concatenate([rows.reshape(-1), np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
        self.base = np.arange(n, dtype=np.int64) * width
        self.last = len(self.words) - 1
        self.at = np.zeros(n, np.int64)

    def window(self, which=slice(None)) -> np.ndarray:
        """At least 25 bits from each row's place, at the top of 32."""
        at = self.at[which]
        i = self.base[which] + (at >> 3)
        return (self.words[np.minimum(i, self.last)].astype(np.int64) << (at & 7)) & 0xFFFFFFFF

    def take(self, bits) -> np.ndarray:
        out = self.window() >> (32 - bits)
        self.at += bits
        return out

    def signed(self, bits) -> np.ndarray:
        v = self.take(bits)
        return np.where(np.asarray(bits) > 0, v - ((v >> np.maximum(bits - 1, 0) & 1) << bits), 0)

    def unary(self) -> np.ndarray:
        q = ZEROS[self.window() >> 16]
        self.at += q
        rest = np.flatnonzero(q == 16)
        while len(rest):
            more = ZEROS[self.window(rest) >> 16]
            q[rest] += more
            self.at[rest] += more
            rest = rest[(more == 16) & (q[rest] < 1 << 20)]
        self.at += 1
        return q

    def rice(self, k: np.ndarray) -> np.ndarray:
        u = self.unary() << k | self.take(k)
        return (u >> 1) ^ -(u & 1)


def parse_number(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers behind the first four bytes, and the bytes they take (0: not a number)."""
    first = rows[:, 4].astype(np.int64)
    size = np.where(first < 0x80, 1, ZEROS[(first << 8 ^ 0xFFFF) & 0xFF00])
    size[(first >= 0x80) & ((size < 2) | (size > 7))] = 0
    value = np.where(size == 1, first, first & (0x7F >> np.maximum(size, 1)))
    for j in range(1, 7):
        more = size > j
        value = np.where(more, value << 6 | rows[:, 4 + j].astype(np.int64) & 63, value)
    return value, size


def decode_frames(data: np.ndarray, starts: np.ndarray, block: int, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples, ends, numbers and soundness (both checksums) of the frames that begin at ``starts``."""
    n = len(starts)
    width = widest + 8
    rows = data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)]
    number, size = parse_number(rows)
    at = np.arange(n)
    sound = (size > 0) & (crc(CRC8, 8, rows[:, :16], 4 + size) == rows[at, 4 + size])
    kinds = rows[at, 5 + size] >> 1
    kinds[~sound] = 255
    samples = np.zeros((n, block), np.int64)
    bits_end = np.zeros(n, np.int64)
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        r = Reader(rows[own])
        r.at = (6 + size[own]) * 8
        x = np.zeros((block, len(own)), np.int64)
        if kind == 0:
            x[:] = r.signed(8)
        elif kind == 1:
            for t in range(block):
                x[t] = r.signed(8)
        elif 8 <= kind <= 12 or kind >= 32 and kind < 64:
            order = kind - 8 if kind < 32 else kind - 31
            for t in range(order):
                x[t] = r.signed(8)
            if kind >= 32:
                precision = r.take(4) + 1
                shift = r.signed(5)
                coefficients = [r.signed(precision) for _ in range(order)]
            else:
                shift, coefficients = 0, FIXED[order]
            residual(r, x, order, block)
            for t in range(order, block):
                x[t] += sum(c * x[t - 1 - j] for j, c in enumerate(coefficients)) >> shift if order else 0
        else:
            sound[own] = False
        samples[own] = x.T
        bits_end[own] = r.at
    end = np.minimum((bits_end + 7) >> 3, width - 2)
    sound &= crc(CRC16, 16, rows, np.where(sound, end, 0)) == (rows[at, end].astype(np.int64) << 8 | rows[at, end + 1])
    return samples, starts + end + 2, number, sound


def residual(r: Reader, x: np.ndarray, order: int, block: int) -> None:
    """Reads the residuals of all rows into ``x``; rows may differ in method and partitions."""
    method, parts = r.take(2), r.take(4)
    for m, p in sorted(set(zip(method.tolist(), parts.tolist(), strict=True))):
        some = np.flatnonzero((method == m) & (parts == p))
        if m > 1 or block >> p << p != block or (block >> p) < order:
            continue  # not a frame of the format; its checksum fails
        sub = Reader.__new__(Reader)
        sub.words, sub.last, sub.base, sub.at = r.words, r.last, r.base[some], r.at[some]
        width = 4 if m == 0 else 5
        t = order
        for part in range(1 << p):
            k = sub.take(width)
            raw = np.flatnonzero(k == (1 << width) - 1)
            bits = np.zeros(len(some), np.int64)
            if len(raw):
                sub_raw = sub.window(raw) >> 27
                sub.at[raw] += 5
                bits[raw] = sub_raw
                k = np.where(k == (1 << width) - 1, 0, k)
            end = (part + 1) * (block >> p)
            while t < end:
                if len(raw):
                    keep = sub.at[raw].copy()
                    v = sub.rice(k)
                    sub.at[raw] = keep
                    w = sub.window(raw) >> (32 - bits[raw])
                    sub.at[raw] += bits[raw]
                    v[raw] = np.where(bits[raw] > 0, w - ((w >> np.maximum(bits[raw] - 1, 0) & 1) << bits[raw]), 0)
                else:
                    v = sub.rice(k)
                x[t, some] = v
                t += 1
        r.at[some] = sub.at


def header(stream: bytes) -> dict:
    """STREAMINFO, the seek points and where the frames begin."""
    if stream[:4] != MARKER:
        raise ValueError("not a FLAC stream")
    at, out = 4, {}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        b = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            bits = int.from_bytes(b[10:18])
            out |= {"block": int.from_bytes(b[2:4]), "widest": int.from_bytes(b[7:10]), "rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "bits": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": b[18:34]}
        elif kind & 127 == 3:
            out["seek"] = [(int.from_bytes(b[i : i + 8]), int.from_bytes(b[i + 8 : i + 16])) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 128:
            return out | {"frames": at}


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (int8) of each stream; ValueError if a checksum or the MD5 does not match."""
    heads = [header(s) for s in streams]
    out: list = [None] * len(streams)
    if any((h["channels"], h["bits"]) != (1, 8) for h in heads):
        raise ValueError("8-bit mono streams only")
    for shape in {h["block"] for h in heads}:
        some = [i for i, h in enumerate(heads) if h["block"] == shape]
        data = np.frombuffer(b"".join(streams[i][heads[i]["frames"] :] for i in some), np.uint8)
        sizes = np.array([len(streams[i]) - heads[i]["frames"] for i in some])
        begin = np.cumsum(sizes) - sizes
        counts = np.array([-(-heads[i]["samples"] // shape) for i in some])
        starts, whose = boundaries(data, begin, sizes, counts, shape, max(heads[i]["widest"] for i in some))
        flat = np.empty((len(starts), shape), np.int8)
        for lo in range(0, len(starts), TURN):
            samples, _, _, sound = decode_frames(data, starts[lo : lo + TURN], shape, max(heads[i]["widest"] for i in some))
            if not sound.all():
                raise ValueError(f"{(~sound).sum()} frames fail their checksums")
            flat[lo : lo + TURN] = samples
        at = np.cumsum(counts) - counts
        for j, i in enumerate(some):
            out[i] = flat[at[j] : at[j] + counts[j]].reshape(-1)[: heads[i]["samples"]]
            if hashlib.md5(out[i]).digest() != heads[i]["md5"]:
                raise ValueError("the MD5 of the samples differs")
    return out


def boundaries(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, counts: np.ndarray, block: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the frames of all streams begin.

    Candidates are sync codes whose header has the right checksum, numbered as expected. A
    stream where these don't give each number once is read frame by frame instead.
    """
    at = np.flatnonzero((data[:-1] == SYNC[0]) & (data[1:] == SYNC[1]))
    rows = data[np.minimum(at[:, None] + np.arange(16), len(data) - 1)]
    number, size = parse_number(rows)
    ok = (size > 0) & (crc(CRC8, 8, rows, 4 + size) == rows[np.arange(len(at)), 4 + size])
    at, number = at[ok], number[ok]
    whose = np.searchsorted(begin, at, side="right") - 1
    starts, owners = [], []
    low = np.searchsorted(whose, np.arange(len(begin)))
    high = np.searchsorted(whose, np.arange(len(begin)), side="right")
    for i, n in enumerate(counts.tolist()):
        mine = at[low[i] : high[i]]
        if len(mine) != n or (number[low[i] : high[i]] != np.arange(n)).any():
            mine = np.zeros(n, np.int64)
            pos = begin[i]
            for j in range(n):
                mine[j] = pos
                pos = decode_frames(data, np.array([pos]), block, widest)[1][0]
        starts.append(mine)
        owners.append(np.full(n, i))
    return np.concatenate(starts), np.concatenate(owners)


def seek(stream: bytes, sample: int, count: int) -> np.ndarray:
    """``count`` samples from ``sample`` on, read from the seek point before it only."""
    h = header(stream)
    point = max((p for p in h["seek"] if p[0] <= sample), default=(0, 0))
    data = np.frombuffer(stream[h["frames"] :], np.uint8)
    pos, got, first = point[1], [], point[0]
    while pos < len(data) and first + sum(map(len, got)) < min(sample + count, h["samples"]):
        x, end, _, sound = decode_frames(data, np.array([pos]), h["block"], h["widest"])
        if not sound[0]:
            raise ValueError("a frame fails its checksums")
        got.append(x[0])
        pos = int(end[0])
    return np.concatenate([*got, np.zeros(0, np.int64)])[sample - first : sample - first + count].astype(np.int8)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text (null: empty), filled with spaces to a positive multiple of 192."""
    b = (text or "").encode()
    return b + b" " * (-len(b) % BLOCK or (BLOCK if not b else 0))


def pcm_blocks(samples: np.ndarray, size: int = BLOCK * SEEK_FRAMES) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of the samples with their offsets; they begin at the seek points."""
    for at in range(0, len(samples), size):
        yield at, samples[at : at + size]


class Features:
    """Energy, zero crossings, and least and most amplitude of PCM blocks, as exact integers."""

    def __init__(self):
        self.energy = self.crossings = 0
        self.low, self.high, self.last = 127, -128, None

    def add(self, block: np.ndarray) -> None:
        x = block.astype(np.int64)
        below = x < 0
        self.energy += int((x * x).sum())
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.last is not None and self.last != below[0])
        self.low, self.high, self.last = min(self.low, int(x.min())), max(self.high, int(x.max())), below[-1]

    def __str__(self) -> str:
        return f"energy={self.energy};crossings={int(self.crossings)};min={self.low};max={self.high}"


def features(samples: np.ndarray) -> str:
    f = Features()
    for _, block in pcm_blocks(samples):
        f.add(block)
    return str(f)


def to_flac(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``flac``, the stream of each whole text's payload. Null counts as empty."""
    return map_texts(df, lambda: lambda texts: {"flac": pa.array(encode([payload(t) for t in texts]), pa.binary())}, {"flac": "binary"}, text_col, list(keep))


def to_pcm(df: DataFrame, flac_col: str = "flac", id_col: str = "doc_id", block_samples: int = BLOCK * SEEK_FRAMES) -> DataFrame:
    """One row per PCM block: id, ``block``, ``sample_offset``, ``pcm`` (signed 8-bit samples).

    Blocks begin at the seek points, so that any of them can be read again from the stream by
    its offset. A null stream has no blocks; a damaged one fails.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                if s is None:
                    continue
                at, blocks = zip(*pcm_blocks(decode([s])[0], block_samples), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * len(at), pa.int64())), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.int64()), pa.array([x.tobytes() for x in blocks], pa.binary())],
                    names=["id", "block", "sample_offset", "pcm"],
                )

    return df.select(id_col, flac_col).mapInArrow(run, f"id {id_type}, block bigint, sample_offset bigint, pcm binary").withColumnRenamed("id", id_col)


DIGESTS = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "n_blocks": "bigint"}


def media_digests(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Store every whole text as FLAC, read the stored bytes back, and describe both.

    All digests of the payload and the features come from the PCM blocks that were read back,
    one by one; ``n_blocks`` is their number. A null text counts as empty (a payload of 192 spaces); equal texts give equal values. Other
    columns are dropped. No shuffle.
    """

    def f(texts):
        out = {n: [] for n in DIGESTS}
        stored = encode([payload(t) for t in texts])
        for t, s, x in zip(texts, stored, decode(stored), strict=True):
            digest, feature, n, back = hashlib.sha256(), Features(), 0, b""
            for at, block in pcm_blocks(x):
                back = (block.view(np.uint8) ^ 128).tobytes()  # blocks hold whole frames, so the last has 16 bytes
                digest.update(back)
                feature.add(block)
                n += 1
            row = (len((t or "").encode()), at + len(back), digest.hexdigest(), zlib.crc32(back[-16:]), len(s), hashlib.sha256(s).hexdigest(), str(feature), n)
            for n, v in zip(DIGESTS, row, strict=True):
                out[n].append(v)
        return out

    return map_texts(df, lambda: f, DIGESTS, text_col, list(keep))
