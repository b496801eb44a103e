"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position of the chain and has one of the learned languages. Its
features are affixes, character n-grams and membership in the lexicon of frequent training
words; transitions between languages are learned from code-switched sequences, which are
made from passages of labelled documents. Forward-backward gives each word's marginals; a
document's prediction is the language with the largest sum of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.batches import map_texts
from hornspark.plans.materialize import materialize

UNKNOWN = "und"
#: Bounds of the training sample: documents of a language (about), and words of a document, in
#: passages spread evenly over its whole text.
DOCS_PER_LANG, WORDS_PER_DOC, PASSAGE = 150, 320, 40
#: Hashed features: half a megabyte of weights for each language.
DIMENSIONS = 1 << 17
#: Values of ``lang`` up to which their rates are broadcast.
BROADCAST_LANGS = 1 << 16
#: Letters of a chain position. A longer run, as in scripts without spaces, is cut into several.
RUN = 32
LEXICON = 200
#: Training sequences for each language, their length, and steps of a pass over all of them: with
#: more languages a step has more sequences, so that each language is seen as often.
SEQUENCES, LENGTH, SWITCH, EPOCHS, STEPS, RATE = 375, 64, 0.04, 3, 30, 0.3
#: Numbers (words times languages) that a worker remembers, or works on at a time.
CACHE, CELLS = 4_800_000, 1 << 21
CACHE_WORDS = 300_000
BLOCK = 128
#: Languages up to which chains are cut into blocks, at the cube of their number a word; beyond, at the square.
FEW = 16
#: Chains of similar length that run side by side there.
LANES = 64

_WORD = re.compile(r"[^\W\d_]{1,%d}" % RUN)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, cut every RUN letters; none if no character is a letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed affix, n-gram and lexicon features of a word."""
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)]
    b = f"<{word}>"
    names += [b[i : i + 2] for i in range(len(b) - 1)] + [b[i : i + 3] for i in range(len(b) - 2)]
    if word in lexicon:
        names += [f"w{word}", f"l{lexicon[word]}"]
    return [zlib.crc32(n.encode("utf-8", "replace")) % DIMENSIONS for n in names]


def forward_backward(psi: np.ndarray, starts: np.ndarray, move: np.ndarray, begin: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of all positions of many chains laid end to end.

    psi: the factor of each position and label; starts: True where a chain begins; move: the
    factors of transitions; begin: those of a chain's first label. At a start the transition
    is the same from every label, which parts the chains, so all of them are one product of
    matrices; it is taken in blocks that run side by side, exactly.
    """
    n, k = psi.shape
    blocks = -(-n // block)
    p = np.ones((blocks * block, k))
    p[:n] = psi
    s = np.zeros(blocks * block, bool)
    s[:n] = starts
    s[n:] = True  # what fills the last block is no part of the last chain
    p, s = p.reshape(blocks, block, k).swapaxes(0, 1), s.reshape(blocks, block).T
    at = [np.flatnonzero(x) for x in s]
    # the matrix of each block
    m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(block):
        was = m
        m = (m.reshape(-1, k) @ move).reshape(blocks, k, k)
        if len(at[t]):
            m[at[t]] = was[at[t]].sum(axis=2, keepdims=True) * begin
        m *= p[t][:, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    x = np.full(k, 1 / k)
    for i in range(blocks):
        ahead[i] = x
        x = x @ m[i]
        x /= x.sum()
    x = np.full(k, 1 / k)
    for i in reversed(range(blocks)):
        behind[i] = x
        x = m[i] @ x
        x /= x.sum()
    alpha = np.empty((block, blocks, k))
    x = ahead
    for t in range(block):
        y = x @ move
        if len(at[t]):
            y[at[t]] = x[at[t]].sum(axis=1, keepdims=True) * begin
        y *= p[t]
        y /= y.sum(axis=1, keepdims=True)
        alpha[t] = x = y
    x = behind
    for t in reversed(range(block)):
        alpha[t] *= x
        y = p[t] * x
        x = y @ move.T
        if len(at[t]):
            x[at[t]] = (y[at[t]] @ begin)[:, None]
        x /= x.sum(axis=1, keepdims=True)
    gamma = alpha.swapaxes(0, 1).reshape(-1, k)[:n]
    return gamma / gamma.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """A trained field; ``labels`` is empty if there was nothing to learn from."""

    labels: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, 0), np.float32))
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w, self.lexicon) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = self.weights[np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))]
        return np.add.reduceat(rows, np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / np.sqrt(sizes)[:, None]


class Tagger:
    """Applies a model; remembers the scores of words seen before."""

    def __init__(self, model: Model, cache: int | None = None):
        self.model = model
        self.cache = min(CACHE_WORDS, CACHE // max(1, len(model.labels))) if cache is None else cache
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)))
        self.move, self.begin = (np.exp(x - x.max(initial=-np.inf)) for x in (model.move, model.begin))

    def factors(self, words: list[str]) -> np.ndarray:
        """A row of factors for each word, 1 for its best label."""
        if len(self.known) > self.cache:
            self.known, self.scores = {}, self.scores[:0]
        known = self.known
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            step = max(1, min(20_000, CELLS // len(self.model.labels) // 16))
            self.scores = np.concatenate([self.scores, *(self.model.emissions(fresh[i : i + step]) for i in range(0, len(fresh), step))])
        s = self.scores[np.fromiter((known[w] for w in words), np.int64, len(words))]
        return np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -60))

    def marginals(self, chains: list[list[str]]) -> np.ndarray:
        """Rows of label probabilities for the words of all (non-empty) chains."""
        sizes = np.fromiter(map(len, chains), np.int64, len(chains))
        starts = np.zeros(int(sizes.sum()), bool)
        starts[np.r_[0, np.cumsum(sizes)[:-1]]] = True
        return forward_backward(self.factors([w for c in chains for w in c]), starts, self.move, self.begin)

    def shares(self, chains: list[list[str]]) -> np.ndarray:
        """The mean of the label probabilities of each (non-empty) chain's words."""
        sizes = np.fromiter(map(len, chains), np.int64, len(chains))
        if len(self.model.labels) <= FEW:
            return np.add.reduceat(self.marginals(chains), np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
        out = np.empty((len(chains), len(self.model.labels)))
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), LANES):
            pick = order[lo : lo + LANES]
            out[pick] = self.side_by_side([chains[i] for i in pick]) / sizes[pick, None]
        return out

    def side_by_side(self, chains: list[list[str]], cells: int = CELLS) -> np.ndarray:
        """Sums of the label probabilities of chains in falling order of length, word by word of all of them.

        The chains are taken in pieces; of the way forward only the state before each piece is
        kept, and the way back computes the piece again. So memory doesn't grow with a chain.
        """
        k, lanes = len(self.model.labels), len(chains)
        sizes = np.array([len(c) for c in chains])
        step = max(1, cells // (lanes * k))
        total, cuts = np.zeros((lanes, k)), range(0, int(sizes[0]), step)

        def forward(lo, x):
            parts = [c[lo : lo + step] for c in chains[: int((sizes > lo).sum())]]
            lengths = np.array([len(c) for c in parts])
            psi = np.ones((int(lengths[0]), len(parts), k))
            psi[np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(parts)), lengths)] = self.factors([w for c in parts for w in c])
            alpha = np.ones_like(psi)
            for t in range(len(psi)):
                n = int((sizes > lo + t).sum())
                x = (x[:n] @ self.move if lo + t else np.broadcast_to(self.begin, (n, k))) * psi[t, :n]
                x /= x.sum(axis=1, keepdims=True)
                alpha[t, :n] = x
            return psi, alpha, x

        before, x = [], None
        for lo in cuts:
            before.append(x)
            psi, alpha, x = forward(lo, x)
        x = np.ones((lanes, k))
        for lo in reversed(cuts):
            if lo != cuts[-1]:
                psi, alpha, _ = forward(lo, before[lo // step])
            for t in reversed(range(len(psi))):
                n = int((sizes > lo + t).sum())
                g = alpha[t, :n] * x[:n]
                total[:n] += g / g.sum(axis=1, keepdims=True)
                y = (psi[t, :n] * x[:n]) @ self.move.T
                x[:n] = y / y.sum(axis=1, keepdims=True)
        return total

    def __call__(self, texts: list) -> dict:
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        chains = [words_of(t) for t in texts]
        at = [i for i, c in enumerate(chains) if c]
        if at and self.model.labels:
            share = self.shares([chains[i] for i in at])
            for i, best, p in zip(at, share.argmax(axis=1), share.max(axis=1), strict=True):
                pred[i], score[i] = self.model.labels[best], float(min(1.0, p))
        return {"lang_pred": pred, "score": score}


def sequences_of(passages: list[list[list[str]]], count: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Code-switched sequences of LENGTH words, and the number of each word's language."""
    words, gold = [], []
    for _ in range(count):
        w: list[str] = []
        g: list[int] = []
        while len(w) < LENGTH:
            lang = int(rng.integers(len(passages)))
            own = passages[lang][rng.integers(len(passages[lang]))]
            n = min(len(own), int(rng.geometric(SWITCH)), LENGTH - len(w))
            lo = int(rng.integers(len(own) - n + 1))
            w += own[lo : lo + n]
            g += [lang] * n
        words.append(w)
        gold.append(g)
    return words, np.array(gold)


def expected(psi: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels of sequences of one length, and the expected counts of transitions."""
    length, k = psi.shape[1:]
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    alpha[:, 0] = psi[:, 0] * begin
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        alpha[:, t] = (alpha[:, t - 1] @ move) * psi[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    beta[:, -1] = 1
    for t in range(length - 2, -1, -1):
        beta[:, t] = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    after = ((psi * beta)[:, 1:]).reshape(-1, k)
    ahead = alpha[:, :-1].reshape(-1, k)
    ahead = ahead / ((ahead @ move) * after).sum(axis=1, keepdims=True)
    return gamma, move * (ahead.T @ after)


def sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The rows of each number in ``at``, added up; every number below n occurs."""
    order = np.argsort(at, kind="stable")
    return np.add.reduceat(rows[order], np.searchsorted(at[order], np.arange(n)), axis=0)


def fit(rows: list[tuple[str, list[str]]], seed: int = 7, sequences: int = SEQUENCES) -> Model:
    """Maximise the conditional likelihood of code-switched sequences made of labelled passages.

    ``sequences`` for each language. Time and the weights grow with the number of languages;
    what a step works on at once doesn't.
    """
    labels = sorted({lang for lang, words in rows if words})
    if not labels:
        return Model([])
    rng = np.random.default_rng(seed)
    numbers = {lang: i for i, lang in enumerate(labels)}
    passages = [[] for _ in labels]
    counts = [Counter() for _ in labels]
    for lang, words in sorted(rows):
        counts[numbers[lang]].update(words)
        passages[numbers[lang]] += [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    best: dict[str, tuple[float, int]] = {}
    for c in counts:
        for w in sorted(c, key=lambda x: (-c[x], x))[:LEXICON]:
            best[w] = (-1.0, 0)
    for i, c in enumerate(counts):
        for w in c.keys() & best.keys():
            if c[w] / c.total() > best[w][0]:
                best[w] = (c[w] / c.total(), i)
    lexicon = {w: i for w, (_, i) in best.items()}
    k = len(labels)
    model = Model(labels, lexicon, np.zeros((DIMENSIONS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    words, gold = sequences_of(passages, sequences * k, rng)
    types = sorted({x for w in words for x in w})
    index = {x: i for i, x in enumerate(types)}
    found = [features(x, lexicon) for x in types]
    first = np.r_[0, np.cumsum([len(f) for f in found])]
    found = np.array([i for f in found for i in f])
    tokens = np.array([[index[x] for x in w] for w in words])
    squares, move_squares, begin_squares = np.full((DIMENSIONS, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    batch = -(-len(tokens) // STEPS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(tokens))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            seen, back = np.unique(tokens[pick], return_inverse=True)
            back = back.reshape(len(pick), LENGTH)
            sizes = first[seen + 1] - first[seen]
            heads = np.r_[0, np.cumsum(sizes)[:-1]]
            own = found[np.repeat(first[seen] - heads, sizes) + np.arange(sizes.sum())]
            scale = 1 / np.sqrt(sizes)[:, None]
            width = max(1, 4 * CELLS // len(own))
            blocks = [slice(at, at + width) for at in range(0, k, width)]
            emit = np.concatenate([np.add.reduceat(model.weights[:, b][own], heads, axis=0) * scale for b in blocks], axis=1)
            move, begin = np.exp(model.move), np.exp(model.begin)
            per_type, g_move, g_begin = np.zeros((len(seen), k)), np.zeros((k, k)), np.zeros(k)
            part = max(1, CELLS // (LENGTH * k))
            for at in range(0, len(pick), part):
                want, e = gold[pick[at : at + part]], emit[back[at : at + part]]
                off, pairs = expected(np.exp(e - e.max(axis=2, keepdims=True)).astype(float), move, begin)
                # gradients: expected less observed counts
                off.reshape(-1, k)[np.arange(want.size), want.ravel()] -= 1
                g_move += pairs
                np.add.at(g_move, (want[:, :-1].ravel(), want[:, 1:].ravel()), -1)
                g_begin += off[:, 0].sum(axis=0)
                some, to = np.unique(back[at : at + part], return_inverse=True)
                per_type[some] += sums(off.reshape(-1, k), to.ravel(), len(some))
            touched, to = np.unique(own, return_inverse=True)
            ranks = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[ranks], np.arange(len(touched)))
            source = np.repeat(np.arange(len(seen)), sizes)[ranks]
            for b in blocks:
                g = np.add.reduceat((per_type[:, b] * scale)[source], ends, axis=0) / len(pick) + 1e-4 * model.weights[touched, b]
                squares[touched, b] += (g * g).astype(np.float32)
                model.weights[touched, b] -= (RATE * g / np.sqrt(squares[touched, b])).astype(np.float32)
            for p, q, sq in ((model.move, g_move, move_squares), (model.begin, g_begin, begin_squares)):
                q = q / len(pick)
                sq += q * q
                p -= RATE * q / np.sqrt(sq)
    return model


def held_out(id_col: str = "doc_id"):
    """True for the rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(df: DataFrame, text_col: str, lang_col: str, id_col: str, docs_per_lang: int = DOCS_PER_LANG) -> list[tuple[str, list[str]]]:
    """A bounded sample of (language, words) of rows that may be learned from.

    About ``docs_per_lang`` rows of each language are picked by a hash of id and text, at a rate
    from the language's row count; of each, words in passages spread over the whole text. Rows
    that repeat id and text count once. Every language is sampled.
    """
    may = df.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id"))
    counts = materialize(may.groupBy("lang").agg((F.lit((1 << 30) * docs_per_lang) / F.count("*")).alias("rate")), "languages")
    # one row per language: broadcast, so that the texts stay where they are, unless there are very many
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts
    picked = may.join(counts, "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) <= F.col("rate")).dropDuplicates(["id", "text", "lang"]).select("lang", "text")

    def passages(batches):
        for b in batches:
            out = [spread(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    rows = picked.mapInArrow(passages, "lang string, words array<string>").collect()
    return [(r["lang"], list(r["words"])) for r in rows if r["words"]]


def spread(words: list[str]) -> list[str]:
    """Passages of PASSAGE words, evenly over the text, WORDS_PER_DOC words at most."""
    if len(words) <= WORDS_PER_DOC:
        return words
    n = WORDS_PER_DOC // PASSAGE
    starts = [i * (len(words) - PASSAGE) // (n - 1) for i in range(n)]
    return [w for lo in starts for w in words[lo : lo + PASSAGE]]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    return fit(training_rows(df, text_col, lang_col, id_col, docs_per_lang))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (its share of the words) of every whole text.

    A null text, or one without a letter, gives ``und`` with score 0; so does every text if the
    model has learned no language. Repeated rows stay; an empty table gives an empty one; other
    columns are dropped. Null ids pass through and count as not held out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: half a megabyte of weights and a short lexicon for each language
    return map_texts(df, lambda: Tagger(shared.value), {"lang_pred": "string", "score": "double"}, text_col, list(keep), prefix=prefix)
