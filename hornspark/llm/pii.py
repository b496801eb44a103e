"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give emails, IP addresses, cards and phones. Around every place that can hold
more, the field scores whole candidate segments (their digit grouping, checksums, neighbours
and cue words) of a bounded number of tokens, and a dynamic program chooses boundaries and
types of all segments jointly. Pattern spans are fixed segments of it. Elsewhere a text has no
candidate segment, so its only labelling there is "outside" and the islands are exact.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hornspark.llm.batches import map_texts

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the field finds.
ADDED = ("obfuscated_email", "local_phone", "iban", "national_id")
KINDS = BASE + ADDED
#: Tokens of digit groups and their separators that an entity may have, and characters around a place that
#: may hold one: more than any such entity has on one side of it, with its cue words.
LONGEST, REACH = 14, 120
#: Tokens that an address in words may have (a token is a word of any length or a sign).
LONGEST_WRITTEN = 64

# fixed values of the contract
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind.

    Leftmost and non-overlapping within each kind; a match that fails its test is dropped
    without another try. An address is sought from its @ sign leftwards, and a number from the
    first digit of its run, which finds the same in linear time.
    """
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at)):
            out.append((lo, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(BASE[k], lo, hi) for lo, k, hi in sorted(out)]


_TRIGGER = re.compile(r"[0-9]{2,}")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CUES = {
    "phone": frozenset("tel phone call fax mobile cell telephone telefon handy rufnummer teléfono telefono móvil llame téléphone portable appelez whatsapp sms ring dial".split()),
    "iban": frozenset("iban account konto kontonummer cuenta compte bank transfer überweisung bic wire".split()),
    "id": frozenset("ssn social security id passport tax national nif dni steuer identification nss insee".split()),
    "mail": frozenset("mail email e contact write reach kontakt contacto courriel correo".split()),
    "number": frozenset("order invoice ticket ref reference case batch serial part item tracking parcel article bestellung rechnung pedido factura facture commande".split()),
}
_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?| at |@", re.I)
_DOMAIN_IN_WORDS = re.compile(r"[\w-]++(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[\w-]++)+", re.I)
_LOCAL_IN_WORDS = re.compile(r"[\w.+-]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_DATE = re.compile(r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}(?: [0-9]{1,2}:?[0-9]{0,2})?")
_GROUPS = re.compile(r"[0-9]+")


def iban_ok(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    return bool(15 <= len(s) <= 34 and s.isascii() and s.isalnum()) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def written_addresses(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans that may be an address with its "at" or a "dot" in words, by start.

    Sought from the "at" to both sides, as pattern addresses are; parts have any length.
    """
    out = []
    end = len(text) if end is None else end
    done = start
    for at in _AT.finditer(text, start, end):
        if at.start() < done or not (m := _DOMAIN_IN_WORDS.match(text, at.end(), end)) or at[0] == "@" and "dot" not in m[0].lower():
            continue
        lo = at.start()
        while lo > done and _LOCAL_IN_WORDS.match(text, lo - 1):
            lo -= 1
        if lo < at.start():
            out.append((lo, m.end()))
            done = m.end()
    return out


@dataclass
class Island:
    """Tokens (start, end, pattern kind or None) of a stretch of text."""

    text: str
    tokens: list[tuple[int, int, str | None]]

    def segments(self) -> list[tuple[int, int]]:
        """Candidate entities as token ranges; pattern spans are not among them.

        They are parts of a run of digit groups that stand one character apart (7 to 13
        digits in LONGEST tokens at most, anywhere in a run of any length), IBAN-like runs,
        and addresses in words of LONGEST_WRITTEN tokens at most.
        """
        out = []
        text, tokens = self.text, self.tokens
        numeric = [not kind and text[a].isdigit() and text[a:b].isdigit() for a, b, kind in tokens]
        i = 0
        while i < len(tokens):
            if not numeric[i]:
                i += 1
                continue
            end = i + 1
            while end < len(tokens) and not tokens[end][2] and tokens[end][0] - tokens[end - 1][1] <= 1 and (numeric[end] or text[tokens[end][0]] in "()-./"):
                end += 1
            opened = i > 0 and text[tokens[i - 1][0]] == "("
            for lo in range(i - opened, end):
                if not (numeric[lo] or text[tokens[lo][0]] == "("):
                    continue
                digits = 0
                for hi in range(lo, min(end, lo + LONGEST)):
                    digits += (tokens[hi][1] - tokens[hi][0]) * numeric[hi]
                    if digits > 13:
                        break
                    if digits >= 7 and numeric[hi]:
                        out.append((lo, hi + 1))
            i = end
        if tokens:
            first = {t[0]: k for k, t in enumerate(tokens)}
            last = {t[1]: k + 1 for k, t in enumerate(tokens)}
            lo, hi = tokens[0][0], tokens[-1][1]
            for a, b in written_addresses(text, lo, hi) + [m.span() for m in _IBAN.finditer(text, lo, hi)]:
                lo, hi = first.get(a, -1), last.get(b, -1)
                if 0 <= lo < hi <= lo + LONGEST_WRITTEN and not any(t[2] for t in tokens[lo:hi]):
                    out.append((lo, hi))
        return sorted(set(out))

    def features(self, i: int, j: int) -> list[int]:
        """Numbers of the features that a segment has."""
        lo, hi = self.tokens[i][0], self.tokens[j - 1][1]
        s = self.text[lo:hi]
        n = len(_digits(s))
        groups = [len(g) for g in _GROUPS.findall(s)]
        letters = sum(c.isalpha() for c in s)
        written = letters and _AT.search(s)
        left = [self.text[a:b].lower() for a, b, _ in self.tokens[max(0, i - 4) : i]]
        before, after = self.text[lo - 1 : lo], self.text[hi : hi + 1]
        beyond = self.text[hi + 1 : hi + 2]
        flags = [
            True,
            n < 7,
            n in (7, 8),
            n == 9,
            n == 10,
            11 <= n <= 13,
            14 <= n <= 24,
            n > 24,
            letters == 0,
            0 < letters <= 6,
            letters > 6,
            len(groups) == 1,
            groups == [3, 3, 4],
            groups == [3, 2, 4],
            len(groups) >= 4 and all(g == 2 for g in groups[1:]) and groups[0] <= 3,
            len(groups) == 2,
            len(groups) == 3 and groups != [3, 3, 4] and groups != [3, 2, 4],
            s.count("-") == len(groups) - 1 > 0,
            s.count(".") == len(groups) - 1 > 0,
            s.count(" ") == len(groups) - 1 > 0,
            "(" in s and ")" in s,
            ("(" in s) != (")" in s),
            "/" in s or ":" in s or "," in s,
            "\n" in s or "  " in s,
            bool(written),
            bool(written) and written[0] == " at ",
            bool(written) and "dot" not in s[written.end() :].lower(),
            bool(_IBAN.fullmatch(s)) and iban_ok(s),
            bool(_IBAN.fullmatch(s)) and not iban_ok(s),
            bool(_DATE.fullmatch(s)),
            any(w in _CUES["phone"] for w in left),
            any(w in _CUES["iban"] for w in left),
            any(w in _CUES["id"] for w in left),
            any(w in _CUES["mail"] for w in left),
            before.isalnum() or before in tuple("-./#_=+$€\"'"),
            after.isalnum() or after in tuple("-/_=%") or after in tuple(".,:") and beyond.isdigit(),
            s.startswith("0"),
            before.isspace() and self.text[max(0, lo - 2) : lo - 1].isdigit(),
            after.isspace() and beyond.isdigit(),
            len(groups) == 1 and any(w in _CUES["id"] for w in left),
            any(w in _CUES["number"] for w in left),
            bool(written) and any(w in _CUES["mail"] for w in left),
        ]
        return [k for k, f in enumerate(flags) if f]


FEATURES = 42


@dataclass
class Model:
    """Weights of features by type, and of neighbouring labels (outside, then the kinds)."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, island: Island) -> list[tuple[int, int, list[float]]]:
        return [(i, j, self.weights[self_f].sum(axis=0).tolist()) for i, j in island.segments() if (self_f := island.features(i, j))]

    def best(self, island: Island) -> list[tuple[str, int, int]]:
        """The field's own spans of the best segmentation."""
        ending: dict = {}
        for i, j, s in self.scores(island):
            ending.setdefault(j, []).append((i, s))
        n, k = len(island.tokens), len(KINDS) + 1
        moves = self.moves
        score = np.full((n + 1, k), -np.inf)
        score[0, 0] = 0
        back: list = [[None] * k for _ in range(n + 1)]
        for j in range(1, n + 1):
            kind = island.tokens[j - 1][2]
            y = KINDS.index(kind) + 1 if kind else 0
            come = score[j - 1] + moves[:, y]
            score[j, y], back[j][y] = come.max(), (j - 1, int(come.argmax()))
            for i, s in ending.get(j, ()):
                come = (score[i][:, None] + moves[:, 1 + len(BASE) :]).max(axis=0) + s
                for a, v in enumerate(come.tolist()):
                    y = 1 + len(BASE) + a
                    if v > score[j, y]:
                        score[j, y], back[j][y] = v, (i, int((score[i] + moves[:, y]).argmax()))
        out = []
        j, y = n, int(score[n].argmax())
        while j > 0:
            i, before = back[j][y]
            if y > len(BASE):
                out.append((KINDS[y - 1], island.tokens[i][0], island.tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]


def islands(text: str, base: list[tuple[str, int, int]]) -> list[Island]:
    """Stretches of text around each place that may hold an entity of the field."""
    at = sorted([m.span() for m in _TRIGGER.finditer(text)] + written_addresses(text))
    if not at:
        return []
    covered, at_kept, k = sorted((lo, hi, kind) for kind, lo, hi in base), [], 0
    for p, q in at:  # places inside pattern spans hold nothing more
        while k < len(covered) and covered[k][1] <= p:
            k += 1
        if not (k < len(covered) and covered[k][0] <= p):
            at_kept.append((p, q))
    out: list[Island] = []
    reach = -1
    for p, q in at_kept:
        lo, hi = max(0, p - REACH), min(len(text), q + REACH)
        if lo <= reach:
            bounds[-1] = (bounds[-1][0], max(hi, reach))
        elif reach < 0:
            bounds = [(lo, hi)]
        else:
            bounds.append((lo, hi))
        reach = max(reach, hi)
    for lo, hi in bounds if at_kept else []:
        tokens: list = []
        pos = lo
        for a, b, kind in [x for x in covered if x[1] > lo and x[0] < hi] + [(hi, hi, None)]:
            if a < pos and kind:  # overlaps the pattern span before it
                continue
            tokens += [(m.start(), m.end(), None) for m in _TOKEN.finditer(text, pos, max(pos, min(a, hi)))]
            if kind:
                tokens.append((a, b, kind))
                pos = b
        out.append(Island(text, tokens))
    return out


def all_spans(model: Model, text: str) -> tuple[list, list]:
    """Pattern spans, and these with the field's, each by start and then kind as listed."""
    base = base_spans(text)
    more = [s for island in islands(text, base) for s in model.best(island)]
    return base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# training: sentences with known spans are made up here


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(["an", "the", "er", "ou", "ti", "on", "re", "de", "la", "ung"]) for _ in range(r.randint(1, 4))) for _ in range(n))

    def entity(self, kind: str) -> str:
        r, d = self.r, self.d
        if kind == "obfuscated_email":
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", "."), ("(at)", "."), (" [at] ", "."), ("@", " dot "), ("@", "[dot]")])
            local = "".join(self.words(1) for _ in range(8)) if r.random() < 0.1 else self.words(1)
            return f"{local}{r.choice(['', '.x', d(2)])}{at}{self.words(1)}{dot}{r.choice(['com', 'org', 'de', 'net'])}"
        if kind == "local_phone":
            a, b, c = str(r.randint(2, 9)) + d(2), str(r.randint(2, 9)) + d(2), d(4)
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{r.randint(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(7)}", f"0{d(3)}-{d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"])
        if kind == "iban":
            body = d(18)
            land = r.choice(["DE", "FR", "ES", "NL"])
            check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
            s = f"{land}{check:02d}{body}"
            return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))
        gap = r.choice(["-", "-", "-", " ", ""])
        return f"{r.choice('12345678')}{d(2)}{gap}{r.choice('123456789')}{d(1)}{gap}{r.choice('123456789')}{d(3)}"

    def other(self) -> str:
        r, d = self.r, self.d
        return r.choice([
            d(16), d(8), d(10), f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(3)}.{d(3)}", f"token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"",
            f"{d(1)},{d(3)},{d(3)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(4)}", f"{d(5)} {d(4)} {d(3)}", f"#{d(9)}", f"{d(4)}/{d(4)}", f"DE{d(20)}",
            f"{self.words(1)} at {self.words(1)}", f"{self.words(1)} at {self.words(1)}.{r.choice(['com', 'org', 'de', 'net'])}", f"{r.choice(['see', 'look', 'available', 'visit', 'found'])} at {self.words(1)}.{r.choice(['com', 'org', 'de', 'net'])}",
            f"{r.choice(sorted(_CUES['number']))} {d(3)}-{d(2)}-{d(5)}", f"{r.choice(sorted(_CUES['number']))} {d(9)}", f"{d(3)}-{d(2)}-{d(5)}", f"{d(2)}-{d(4)}-{d(4)}", f"{d(9)}", f"{d(4)}-{d(3)}-{d(3)}", f"{self.words(2)} dot {self.words(1)}", f"{d(3)} {d(3)} {d(2)} {d(5)}", f"19{d(2)}-20{d(2)}", f"{d(3)}-{d(3)}-{d(3)}-{d(3)}", f"{d(7)}", f"EUR {d(4)},{d(2)}", f"{d(3)}-{d(2)}-{d(4)}-{d(2)}", f"0x{d(12)}", f"{d(2)} {d(2)} {d(2)}",
        ])

    def sentence(self) -> tuple[str, list]:
        r = self.r
        text, spans = self.words(r.randint(1, 6)), []
        for _ in range(r.choice([0, 1, 1, 2])):
            if r.random() < 0.5:
                kind = r.choice(ADDED)
                cue = {"obfuscated_email": "mail", "local_phone": "phone", "iban": "iban", "national_id": "id"}[kind]
                s = self.entity(kind)
                # bare digits are an identity number, and a plain "at" with a plain dot an address, by their cue only
                bare = kind == "national_id" and "-" not in s or kind == "obfuscated_email" and " at " in s and " dot " not in s
                text += " " + (r.choice(sorted(_CUES[cue])) + r.choice([" ", ": ", " is "]) if bare or r.random() < 0.5 else "")
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += " " + self.other()
            text += r.choice([" ", ", ", ". ", "; "]) + self.words(r.randint(1, 5))
        return text, spans

    def listing(self) -> tuple[str, list]:
        """A list of entities of one form, or a table of numbers that holds none."""
        r, d = self.r, self.d
        text, spans = self.words(r.randint(1, 3)) + r.choice(["\n", " ", ": "]), []
        entities, form, columns = r.random() < 0.5, r.randrange(7), r.randint(2, 6)
        kind = r.choice(["local_phone", "national_id"])
        gap = r.choice([" ", "\n"])
        for k in range(r.randint(3, 9)):
            if k:
                text += gap
            if entities:
                while (s := self.entity(kind)).isdigit() or kind == "national_id" and " " in s:
                    pass
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = [
                    lambda: f"{r.choice(['19', '20'])}{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
                    lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.choice(['19', '20'])}{d(2)}",
                    lambda: " ".join(f"{d(r.randint(1, 3))}.{d(2)}" for _ in range(columns)),
                    lambda: " ".join(str(int(d(4))) for _ in range(columns)),
                    lambda: " ".join(d(3) for _ in range(columns)),
                    lambda: f"{d(2)}:{d(2)}:{d(2)} " + d(r.randint(1, 5)),
                    lambda: " ".join(d(columns) for _ in range(columns)),
                ][form]()
            text += s
        return text + r.choice([" ", "\n", ". "]) + self.words(2), spans


@lru_cache(maxsize=2)
def train(sentences: int = 500, epochs: int = 9, seed: int = 5, lists: int = 160) -> Model:
    """Fit the field by its conditional likelihood on made-up sentences; some seconds on the driver."""
    maker = Maker(seed)
    data = []
    for k in range(sentences + lists):
        text, spans = maker.sentence() if k < sentences else maker.listing()
        base = base_spans(text)
        if any(a < hi and lo < b for _, a, b in base for _, lo, hi in spans):
            continue
        for island in islands(text, base):
            first = {t[0]: i for i, t in enumerate(island.tokens)}
            last = {t[1]: i + 1 for i, t in enumerate(island.tokens)}
            gold = {(first[lo], last[hi]): ADDED.index(kind) for kind, lo, hi in spans if lo in first and hi in last}
            segments = island.segments()
            if set(gold) <= set(segments):
                data.append((island, segments, [island.features(i, j) for i, j in segments], gold))
    k, e = len(KINDS) + 1, len(ADDED)
    model = Model(np.zeros((FEATURES, e)), np.zeros((k, k)))
    squares, move_squares = np.full((FEATURES, e), 1e-3), np.full((k, k), 1e-3)
    order = random.Random(seed)
    lo_e = 1 + len(BASE)
    for _ in range(epochs):
        order.shuffle(data)
        for island, segments, found, gold in data:
            n = len(island.tokens)
            s = np.array([model.weights[f].sum(axis=0) for f in found]).reshape(-1, e)
            starts: dict = {}
            ends: dict = {}
            for x, (i, j) in enumerate(segments):
                starts.setdefault(i, []).append(x)
                ends.setdefault(j, []).append(x)
            labels = [KINDS.index(t[2]) + 1 if t[2] else 0 for t in island.tokens]
            move = model.moves
            alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
            alpha[0, 0] = 0
            inner = np.full((n + 1, k), -np.inf)  # log of sum over labels before, with the transition
            with np.errstate(divide="ignore"):
                for j in range(n + 1):
                    if j:
                        alpha[j, labels[j - 1]] = inner[j - 1, labels[j - 1]]
                        for x in ends.get(j, ()):
                            alpha[j, lo_e:] = np.logaddexp(alpha[j, lo_e:], inner[segments[x][0], lo_e:] + s[x])
                    top = alpha[j].max()
                    inner[j] = np.log(np.exp(alpha[j] - top) @ np.exp(move)) + top
                beta[n] = 0
                for i in range(n - 1, -1, -1):
                    out = np.full(k, -np.inf)  # log weight of what begins at i, by its label
                    out[labels[i]] = beta[i + 1, labels[i]]
                    for x in starts.get(i, ()):
                        out[lo_e:] = np.logaddexp(out[lo_e:], s[x] + beta[segments[x][1], lo_e:])
                    top = out.max()
                    beta[i] = np.log(np.exp(move) @ np.exp(out - top)) + top
                total = np.logaddexp.reduce(alpha[n])
                g_w, g_m = np.zeros_like(model.weights), np.zeros_like(move)
                for x, (i, j) in enumerate(segments):
                    p = np.exp(inner[i, lo_e:] + s[x] + beta[j, lo_e:] - total)
                    if (i, j) in gold:
                        p[gold[i, j]] -= 1
                    g_w[found[x]] += p
                    g_m[:, lo_e:] += np.exp(alpha[i][:, None] + move[:, lo_e:] + (s[x] + beta[j, lo_e:])[None, :] - total)
                for i in range(n):
                    y = labels[i]
                    g_m[:, y] += np.exp(alpha[i] + move[:, y] + beta[i + 1, y] - total)
            # observed transitions
            j, before = 0, 0
            at = {i: (j, lo_e + y) for (i, j), y in gold.items()}
            while j < n:
                j, y = at.get(j, (j + 1, labels[j]))
                g_m[before, y] -= 1
                before = y
            g_w += 2e-3 * model.weights
            squares += g_w * g_w
            move_squares += g_m * g_m
            model.weights -= 0.5 * g_w / np.sqrt(squares)
            model.moves -= 0.2 * g_m / np.sqrt(move_squares)
    return model


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_added": "bigint"}


def find(df: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the personal data of every whole text (null: empty).

    ``n_email`` to ``n_phone`` and ``base_sha256`` are of the pattern spans; ``spans`` has all
    of them and those that the field adds (``n_added``; kinds of their own), by start and then
    kind, in code points. Repeated rows stay; an empty table gives an empty one; other columns
    are dropped. No shuffle.
    """

    def f(texts):
        out = {n: [] for n in FIELDS}
        for t in texts:
            base, spans = all_spans(model, t or "")
            for kind in BASE:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_added"].append(len(spans) - len(set(base)))
        return out

    return map_texts(df, lambda: f, FIELDS, text_col, list(keep))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], f"<{kind.upper()}>"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns and ``redacted``, the text without its personal data (null stays null)."""
    return map_texts(df, lambda: lambda texts: {"redacted": [t and mask(t, all_spans(model, t)[1]) for t in texts]}, {"redacted": "string"}, text_col, list(keep), prefix=prefix)
