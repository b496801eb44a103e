"""Tokens, counts, FLAC, secrets and personal data on awkward rows and against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from hornspark.llm import bpe, flac, pii, secrets, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "123", "²", "Ⅷ", "!!", "...", "<|endoftext|>", "\x1c", " ", "​", "👍🏽", "́", "x" * 30, "_", "\r\n", "ªº", "\x85", "\x00"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 60))) for _ in range(n)]


def texts_of(df, key="doc_id"):
    return [(r[key], r["text"] or "") for r in df.collect()]


def test_round_trip_of_awkward_rows(awkward, none):
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    out = bpe.round_trip(awkward, RANKS, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    want = []
    for i, t in texts_of(awkward):
        ids = enc.encode_ordinary(t)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_segments_never_change_the_ids():
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    for t in random_texts(600):
        assert bpe.encode_text(enc, t, 10) == enc.encode_ordinary(t)
        assert "".join(bpe.segments(t, 10)) == t
    t = "a b" + " \n" * 5000 + " c" + "\t" * 5000
    assert bpe.encode_text(enc, t) == enc.encode_ordinary(t)
    t = "x" + " " * 1_000_000 + "y"  # more than the library's regular expressions bear
    assert enc.decode(bpe.encode_text(enc, t)) == t


def test_decoding_gives_raw_bytes(spark, awkward):
    ids = bpe.encode(awkward, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted(t.encode() for _, t in texts_of(awkward))
    half = spark.createDataFrame([(1, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(RANKS, public_tokenizers.PATTERN)._mergeable_ranks, special_tokens={}).encode_ordinary("👍")[:1])], "doc_id int, token_ids array<int>")
    assert "👍".encode().startswith(bytes(bpe.decode(half, RANKS, public_tokenizers.PATTERN).first()["decoded"]))


def test_counts_equal_the_library():
    count, library = token_counts.Counter(JSON), tokenizers.Tokenizer.from_file(JSON)
    texts = [*random_texts(1500), "a" * 5000, "ab" * 3000, " " * 4000, "", "!" * 999, "\n" * 500 + "x", "aaaaaaa aaaa aaaaa"]
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_starts_anew():
    texts = random_texts(200, 5)
    assert token_counts.Counter(JSON, cache=3)(texts[:100]) == token_counts.Counter(JSON)(texts[:100])
    small = token_counts.Counter(JSON, cache=3)
    small(texts[:100])
    assert small(texts[100:]) == token_counts.Counter(JSON)(texts[100:])


def test_token_counts_of_awkward_rows(awkward, none):
    library = tokenizers.Tokenizer.from_file(JSON)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(awkward, JSON).collect())
    want = [(-1 if i is None else i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts_of(awkward)]
    assert got == sorted(want)
    assert token_counts.token_counts(none, JSON).count() == 0


@pytest.mark.parametrize(
    "payload",
    [b" " * 192, bytes(range(192)), bytes(192), b"\xff" * 384, np.random.default_rng(0).integers(0, 256, 192 * 9, dtype=np.uint8).tobytes(), (128 + 100 * np.sin(np.arange(192 * 300) / 20)).astype(np.uint8).tobytes(), b"\xff\xf8\x14\x02" * 480],
)
def test_flac_is_lossless(payload):
    stream = flac.encode([payload])[0]
    back = flac.decode([stream])[0]
    assert (back.astype(np.int16) + 128).astype(np.uint8).tobytes() == payload
    lo = max(0, len(payload) - 100)
    assert (flac.seek(stream, lo, 50) == back[lo : lo + 50]).all()


def test_flac_predictors_of_all_kinds_are_read():
    """Frames written bit by bit: fixed order 3 with two partitions, one escaped; LPC of order 4; five-bit parameters."""
    r = np.random.default_rng(1)
    x = np.cumsum(r.integers(-1, 2, flac.BLOCK)).clip(-100, 100).astype(np.int64)

    def frame(kind, body):
        w = flac.Writer(1, 2000)
        for v, n in ((0xFFF8, 16), (0x14, 8), (0x02, 8), (0, 8)):
            w.put(v, n)
        w.put(int(flac.crc(flac.CRC8, 8, w.bytes, np.array([5]))[0]), 8)
        w.put(kind << 1, 8)
        body(w)
        end = int(w.at[0] + 7) >> 3
        check = int(flac.crc(flac.CRC16, 16, w.bytes, np.array([end]))[0])
        return w.bytes[0, :end].tobytes() + check.to_bytes(2)

    def rest(w, e, order, method, parts):
        w.put(method, 2)
        w.put(parts, 4)
        width, at = (5 if method else 4), order
        for p in range(1 << parts):
            end = (p + 1) * flac.BLOCK >> parts
            if p == 1:  # escaped: raw numbers of 11 bits
                w.put((1 << width) - 1, width)
                w.put(11, 5)
                for v in e[at - order : end - order]:
                    w.put(int(v) & 2047, 11)
            else:
                w.put(2, width)
                for v in e[at - order : end - order]:
                    w.rice(np.array([(int(v) << 1) ^ (int(v) >> 63)]), np.array([2]))
            at = end

    def fixed(w):
        for v in x[:3]:
            w.put(int(v) & 255, 8)
        rest(w, np.diff(x, 3), 3, 0, 1)

    coefficients = [1800, -900, 200, -50]

    def lpc(w):
        for v in x[:4]:
            w.put(int(v) & 255, 8)
        w.put(11, 4)
        w.put(10, 5)
        for c in coefficients:
            w.put(c & 4095, 12)
        e = [int(x[t]) - (sum(c * int(x[t - 1 - j]) for j, c in enumerate(coefficients)) >> 10) for t in range(4, flac.BLOCK)]
        rest(w, np.array(e), 4, 1, 2)

    for kind, body in ((8 + 3, fixed), (31 + 4, lpc)):
        f = frame(kind, body)
        samples, end, number, sound = flac.decode_frames(np.frombuffer(f, np.uint8), np.array([0]), flac.BLOCK, len(f))
        assert sound[0] and end[0] == len(f) and number[0] == 0 and (samples[0] == x).all()


def test_damaged_streams_are_refused():
    stream = bytearray(flac.encode([bytes(range(192)) * 4])[0])
    stream[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])
    with pytest.raises(ValueError):
        flac.encode([b"short"])


def test_large_frame_numbers():
    n = np.array([0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26, 2**31 - 1])
    b, size = flac.number_bytes(n)
    rows = np.zeros((len(n), 16), np.uint8)
    rows[:, 4:11] = b
    value, length = flac.parse_number(rows)
    assert (value == n).all() and (length == size).all()
    assert bytes(b[4, : size[4]].astype(np.uint8)).decode() == chr(2048)


def test_media_of_awkward_rows(awkward, none):
    rows = flac.media_digests(awkward).collect()
    for r in rows:
        pass
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    want = []
    for i, t in texts_of(awkward):
        p = t.encode()
        p += b" " * (-len(p) % 192 or (192 if not p else 0))
        want.append((-1 if i is None else i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    assert flac.media_digests(none).count() == 0


def test_pcm_blocks_have_seekable_offsets(awkward):
    blocks = flac.to_pcm(flac.to_flac(awkward.where("doc_id = 7"))).orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [i * flac.BLOCK * flac.SEEK_FRAMES for i in range(len(blocks))] and len(blocks) > 5
    text = awkward.where("doc_id = 7").first()["text"]
    joined = b"".join(bytes(b["pcm"]) for b in blocks)
    assert (np.frombuffer(joined, np.int8).astype(np.int16) + 128).astype(np.uint8).tobytes().rstrip(b" ") == text.encode().rstrip(b" ")


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = [c for c in m[0] if c in "0123456789"]
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and pii.luhn("".join(d)), 9 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(pii.BASE[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choices("a1.@-+ ()0%4_é", k=r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


def test_the_field_adds_spans_and_keeps_the_others():
    model = pii.train()
    maker = pii.Maker(77)
    hit = wrong = missed = 0
    for _ in range(200):
        text, spans = maker.sentence()
        base, found = pii.all_spans(model, text)
        assert set(base) <= set(found)
        added = set(found) - set(base)
        hit, wrong, missed = hit + len(added & set(spans)), wrong + len(added - set(spans)), missed + len(set(spans) - added)
    assert hit > 80 and wrong <= 0.06 * hit and missed <= 0.06 * hit


def test_best_segmentation_is_the_best_of_all():
    """The dynamic program against all segmentations of short stretches."""
    model, maker = pii.train(), pii.Maker(5)

    def every(island, scores, i, before):
        if i == len(island.tokens):
            yield 0.0, ()
            return
        kind = island.tokens[i][2]
        y = pii.KINDS.index(kind) + 1 if kind else 0
        for s, rest in every(island, scores, i + 1, y):
            yield s + model.moves[before, y], rest
        for j, v in scores.get(i, ()):
            for a, w in enumerate(v):
                y = 1 + len(pii.BASE) + a
                for s, rest in every(island, scores, j, y):
                    yield s + w + model.moves[before, y], ((i, j, y), *rest)

    tried = 0
    for _ in range(60):
        text, _ = maker.sentence()
        for island in pii.islands(text, pii.base_spans(text)):
            if len(island.segments()) > 8 or len(island.tokens) > 18:
                continue
            scores: dict = {}
            for i, j, v in model.scores(island):
                scores.setdefault(i, []).append((j, v))
            _, best = max(every(island, scores, 0, 0), key=lambda x: x[0])
            assert model.best(island) == [(pii.KINDS[y - 1], island.tokens[i][0], island.tokens[j - 1][1]) for i, j, y in best]
            tried += 1
    assert tried > 20


def test_personal_data_of_awkward_rows(awkward, none):
    model = pii.train()
    rows = {(r["doc_id"], r["source"]) if "source" in r else r["doc_id"]: r for r in pii.find(awkward, model).collect()}
    r = rows[10]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert len(rows[0]["base_sha256"]) == 64 and rows[0]["spans"] == ""
    masked = {r["doc_id"]: r["redacted"] for r in pii.redact(awkward, model).collect()}
    assert masked[10].startswith("mail <EMAIL> ip <IP> card <CARD> tel <PHONE> token") and masked[0] is None and masked[1] == ""
    assert pii.find(none, model).count() == 0


def added(text):
    base, found = pii.all_spans(pii.train(), text)
    return [(kind, text[a:b]) for kind, a, b in found if (kind, a, b) not in base]


def test_addresses_partly_in_words_and_of_any_length():
    r = random.Random(3)
    name = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    right = tried = 0
    for form in ("{} at {} dot com", "{}(at){}.org", "{} [at] {}.de", "{}@{} dot net", "{}[at]{}[dot]com", "{} at {}.com"):
        for n in (5, 9, 70, 200):
            for _ in range(5):
                x = form.format(name(n), name(8))
                right += added(f"some words before; contact: {x} and some words after") == [("obfuscated_email", x)]
                tried += 1
    assert right >= 0.95 * tried
    places = ["the tickets are available at example.com today", "look at report.txt first", "we met at noon. Later at home", "see more at shop.example.org or call", "he stood at point a dot b was far"]
    assert [t for t in places if added(t)] == []


def test_numbers_without_marks_go_by_their_cue():
    r = random.Random(8)
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    known = [f"my {cue} {x} is secret" for cue in ("ssn", "ssn:", "social security") for x in (f"{d(3)}-{d(2)}-{d(4)}", d(9)) for _ in range(20)]
    assert sum([k for k, _ in added(t)] == ["national_id"] for t in known) >= 0.9 * len(known)
    orders = [f"your {cue} {x} was sent" for cue in ("order", "invoice") for x in (f"{d(3)}-{d(2)}-{d(5)}", d(9)) for _ in range(20)]
    assert sum(added(t) != [] for t in orders) <= 0.05 * len(orders)


def test_hard_texts_take_linear_time():
    model = pii.train()
    for t in ("a at " * 20_000, "a at a." * 10_000, "a" * 50_000 + " at a dot com", "a@a dot " * 5_000):
        pii.all_spans(model, t)
    for t in ("1" * 50_000, "a" * 50_000, "+1" + "(" * 50_000, "1." * 20_000, "a@" * 20_000, "12 " * 20_000, "at dot " * 20_000):
        pii.all_spans(model, t)


def test_secrets(awkward, none):
    model = secrets.train()
    rows = {r["doc_id"]: r for r in secrets.scan(awkward, model).collect()}
    text = awkward.where("doc_id = 10").first()["text"]
    spans = [tuple(map(int, s.split(":"))) for s in rows[10]["spans"].split(",")]
    assert [text[a:b] for a, b in spans] == ["5f367f08b1a810c7777ad785b0be5f367f08b1a8"]
    assert rows[0]["n_candidates"] == 0 and secrets.scan(none, model).count() == 0
    maker = secrets.Maker(99)
    right = 0
    for _ in range(300):
        t, lo, hi, path, secret = maker.finding()
        found, p = model([t], [path])
        right += secret == any(q >= 0.5 for (a, b), q in zip(found[0], p[0], strict=True) if a < hi and lo < b)
    assert right >= 285


def test_every_labelled_secret_is_a_candidate():
    maker, secret = secrets.Maker(5), 0
    for _ in range(1500):
        text, lo, hi, _, is_secret = maker.finding()
        secret += is_secret
        assert not is_secret or any(a <= lo and hi <= b + 1 for a, b in secrets.candidates(text)), text
    assert secret > 600


def test_short_passwords_and_urls_are_found():
    r, model = random.Random(2), secrets.train()
    mixed = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    word = lambda n: "".join(r.choice(mixed) for _ in range(n))
    found = lambda t: [t[a:b] for (a, b), q in zip(*(x[0] for x in model([t], [""])), strict=True) if q >= 0.5]
    for make in (lambda x: f'password = "{x}"', lambda x: f"DB_PASSWORD={x}\n", lambda x: f"postgres://admin:{x}@host/db"):
        passwords = [word(12) for _ in range(40)]
        assert sum(found("set " + make(x) + " here") == [x] for x in passwords) >= 38
    assert not any(found(f"commit {''.join(r.choice('0123456789abcdef') for _ in range(40))} was merged") for _ in range(40))
    assert found("the key thing is that tokens count and a secret ingredient matters") == []


def test_pass_phrases_are_found_whole():
    r, model = random.Random(4), secrets.train()
    nouns = "correct horse battery staple velvet anchor pickle thunder marble copper lantern walrus cactus orbit pepper saddle canyon ribbon turtle magnet".split()
    found = lambda t: [t[a:b] for (a, b), q in zip(*(x[0] for x in model([t], [""])), strict=True) if q >= 0.5]
    right = 0
    for _ in range(100):
        x = " ".join(r.sample(nouns, r.randint(4, 6)))
        right += found("set " + r.choice([f'password = "{x}"', f"passphrase: '{x}'", f'"secret": "{x}"']) + " here") == [x]
    assert right >= 90
    prompts = ["Please enter your password", "The token is invalid or has expired.", "Forgot your password?", "must be at least eight characters long", "your secret key goes here", "Choose a new password for the account"]
    assert sum(found(f'"password": "{x}",') != [] for x in prompts) == 0
    # quotes of the other kind and escaped ones do not end a value; a line does
    assert secrets.candidates('password = "a \'b\' c \\" d"')[0] == (12, 24)
    assert secrets.candidates('password = "open end\n') == []


def test_the_user_of_a_url_may_be_long():
    text = "see postgres://" + "u" * 300 + ":Xk29vQm1Lp7z@host/db"
    assert [text[a:b] for a, b in secrets.candidates(text)][-1] == "Xk29vQm1Lp7z"
    assert secrets.candidates("://a:" * 40_000) == []  # linear in unmatched beginnings


def test_the_forest_is_the_mean_of_its_trees():
    model, maker = secrets.train(), secrets.Maker(8)
    rows = []
    for _ in range(60):
        text, _, _, path, _ = maker.finding()
        rows += [secrets.features(text, a, b, path) for a, b in secrets.candidates(text)]

    def walk(tree, x):
        k = 0
        while tree.feature[k] >= 0:
            k = tree.left[k] if x[tree.feature[k]] <= tree.cut[k] else tree.right[k]
        return tree.value[k]

    got = model.forest.probability(np.array(rows, float))
    assert np.allclose(got, [np.mean([walk(t, x) for t in model.forest.trees]) for x in rows])


def test_secrets_of_awkward_rows(awkward):
    model = secrets.train()
    rows = awkward.collect()
    want = []
    for r in rows:
        found, p = model([r["text"]], [r["source"]])
        good = [f"{a}:{b}" for (a, b), q in zip(found[0], p[0], strict=True) if q >= 0.5]
        want.append((str(r["doc_id"]), len(found[0]), len(good), ",".join(good)))
    got = secrets.scan(awkward, model)
    assert got.columns == ["doc_id", "n_candidates", "n_secrets", "spans"]
    assert sorted((str(r["doc_id"]), r["n_candidates"], r["n_secrets"], r["spans"]) for r in got.collect()) == sorted(want)


class Bits:
    """Bits of a stream, one after the other."""

    def __init__(self, data, at):
        self.data, self.at = data, at * 8

    def take(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.data[self.at >> 3] >> (7 - self.at % 8) & 1
            self.at += 1
        return v

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def rice(self, k):
        q = 0
        while not self.take(1):
            q += 1
        u = q << k | self.take(k)
        return u >> 1 if u % 2 == 0 else -(u >> 1) - 1


def plain_crc(data, poly, width):
    c = 0
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def plain_flac(stream):
    """A scalar decoder by the published format, for 8-bit mono streams of blocks of 192 samples."""
    at, last = 4, False
    while not last:
        last, at = bool(stream[at] >> 7), at + 4 + int.from_bytes(stream[at + 1 : at + 4])
    out = []
    while at < len(stream):
        b, start = Bits(stream, at), at
        assert b.take(16) == 0xFFF8
        code = b.take(8) >> 4
        b.take(8)
        first = b.take(8)
        for _ in range(max(0, next(i for i in range(9) if not first << i & 128) - 1)):
            b.take(8)
        n = 192 if code == 1 else b.take(8) + 1 if code == 6 else b.take(16) + 1
        assert plain_crc(stream[start : b.at >> 3], 7, 8) == b.take(8)
        kind, x = b.take(8) >> 1, []
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            if kind >= 32:
                precision, shift = b.take(4) + 1, b.signed(5)
                c = [b.signed(precision) for _ in range(order)]
            else:
                shift, c = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            width, parts = (4, 5)[b.take(2)], b.take(4)
            for part in range(1 << parts):
                k = b.take(width)
                raw = b.take(5) if k == (1 << width) - 1 else None
                while len(x) < (part + 1) * n >> parts:
                    e = b.rice(k) if raw is None else b.signed(raw)
                    x.append(e + (sum(a * x[-1 - j] for j, a in enumerate(c)) >> shift))
        b.at = (b.at + 7) // 8 * 8
        assert plain_crc(stream[start : b.at >> 3], 0x8005, 16) == b.take(16)
        out += x
        at = b.at >> 3
    return np.array(out, np.int8)


def test_streams_are_read_by_a_plain_decoder():
    r = random.Random(1)
    texts = ["", "a" * 400, "The cat and the dog. " * 30, "".join(chr(r.randint(32, 0x2FF)) for _ in range(900)), "äöü 日本 " * 50]
    for t in texts:
        p = flac.payload(t)
        stream = flac.encode([p])[0]
        assert (plain_flac(stream).view(np.uint8) ^ 128).tobytes() == p


def test_long_streams_take_several_turns(monkeypatch):
    texts = ["one two three " * 5000, "", "x" * 192 * 7, "日本語" * 3000]
    whole = flac.encode([flac.payload(t) for t in texts])
    monkeypatch.setattr(flac, "TURN", 5)
    assert flac.encode([flac.payload(t) for t in texts]) == whole
    for t, x in zip(texts, flac.decode(whole), strict=True):
        assert (x.view(np.uint8) ^ 128).tobytes() == flac.payload(t)
        y = x.astype(np.int64)
        assert flac.features(x) == f"energy={(y * y).sum()};crossings={((y[1:] < 0) != (y[:-1] < 0)).sum()};min={y.min()};max={y.max()}"


@pytest.mark.parametrize("gap", [" ", "\n"])
@pytest.mark.parametrize("n", [3, 10, 1000])
def test_lists_of_numbers_are_personal_data(gap, n):
    for form in (lambda k: f"212-555-{1234 + k}", lambda k: f"({212 + k % 700}) 555-{1234 + k}", lambda k: f"{123 + k % 600}-45-{6789 - k}"):
        items = [form(k) for k in range(n)]
        text = "list " + gap.join(items) + " end"
        starts = np.cumsum([5] + [len(s) + len(gap) for s in items[:-1]]).tolist()
        found = {(lo, hi) for _, lo, hi in pii.all_spans(pii.train(), text)[1]}
        assert found == {(lo, lo + len(s)) for lo, s in zip(starts, items, strict=True)}


def test_tables_of_numbers_hold_no_personal_data():
    r = random.Random(0)
    days = "\n".join(f"20{r.randint(10, 25)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" for _ in range(100))
    shares = " ".join(f"{r.random() * 100:.2f}" for _ in range(300))
    for text in (days, shares):
        base, spans = pii.all_spans(pii.train(), text)
        assert spans == base
