"""Secret scans: candidate strings, and a random forest that removes false findings.

The forest sees a candidate's length, its character transitions, how much of it dictionary
words cover, the path of the text, and the words next to it. It is trained from labelled
findings, which are made up here from published token formats and common look-alikes.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.batches import slices
from hornspark.llm.trees import Forest, forest

#: Least characters of a candidate, and of one that is assigned to a name, quoted or part of a URL.
SHORTEST, SHORTEST_ASSIGNED = 16, 6
FINDINGS = 4000

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_~.-]{%d,}={0,2}" % SHORTEST)
# fixed values: names of secrets
_NAMES = "secret token password passwd pwd passphrase key auth credential credentials bearer basic".split()
_CUED = "|".join(sorted((f(w) for w in _NAMES for f in (str.lower, str.title, str.upper)), reverse=True))
_SET = r"\s{0,4}(?::=|=>|[=:])\s{0,4}"
#: Values after = or : in quotes, passwords in URLs, values after a name with or without = or :, and
#: values with blanks in quotes after a name.
_ASSIGNED = [
    re.compile(p.replace("%d", str(SHORTEST_ASSIGNED)))
    for p in (
        r"""[=:]\s{0,4}(?:"([^"\s]{%d,})"|'([^'\s]{%d,})')""",
        r"""://[^\s/:@"']*+:([^\s/@"']{%d,}+)@""",
        rf"""(?:{_CUED})["']?(?:{_SET}|\s)["']?([^\s"'<>]{{%d,}})""",
        rf"""(?:{_CUED})["']?{_SET}(?:"((?:[^"\\\r\n]|\\.){{%d,}}+)"|'((?:[^'\\\r\n]|\\.){{%d,}}+)')""",
    )
]
_TRAILING = ".,;:)]}"
_WORDS = re.compile(r"[A-Za-z]+")
# fixed values: cue words, common words of identifiers, token prefixes
GOOD_CUES = frozenset("token secret key apikey api password passwd pwd auth bearer credential credentials private access authorization client signing webhook".split())
BAD_CUES = frozenset("sha sha1 sha256 md5 commit hash checksum digest integrity uuid guid id version revision example sample placeholder dummy public fingerprint etag blob tree image file path url href class".split())
PROMPTS = frozenset("enter please choose invalid wrong forgot forgotten required expired missing must should incorrect reset change changed your here failed optional unknown used type".split())
FUNCTION_WORDS = frozenset("a an the and or for with that this from have not are is was were be been will would can could of to in on at by it its if as no your you we our they their what when which how than then".split())
DICTIONARY = (
    "the and for with that this from have not are was were been will would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after work first well even want because these give most "
    "user name data file path test example config server client http https www com org html json xml image images static assets content page index main app src lib module package version release build docker node python java script style error warning info debug default value type list map string number object array function class method public private return import export table column query update delete insert select create read write open close start stop service account payment order product customer address street country language english session request response header body"
).split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_", "pypi-", "dop_v1_")
_COVER = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) >= 4), key=len, reverse=True)))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SAFE_PATH = re.compile(r"test|spec|example|fixture|sample|doc|readme|lock|vendor|mock", re.I)
_CODE_PATH = re.compile(r"\.(?:env|ya?ml|json|py|js|ts|go|java|rb|php|tf|ini|cfg|conf|toml|sh|properties)$", re.I)


def _letters() -> dict[str, float]:
    """Log probabilities of letter pairs in words, from the dictionary with add-one smoothing."""
    pairs, singles = Counter(), Counter()
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] += 1
            singles[a] += 1
    return {a + b: math.log((pairs[a + b] + 0.5) / (singles[a] + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


PAIRS = _letters()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be a secret, by start, without overlaps.

    Runs of SHORTEST characters of one alphabet with a letter, but for plain words (all lower
    case, all upper case, or a title); and whatever is assigned to a name, in quotes or after a
    cue word, or is the password of a URL, from SHORTEST_ASSIGNED characters on. A value in quotes
    after a cue word is one candidate to its closing quote, blanks included. Of candidates that
    overlap the first one stays, of those with one start the longest.
    """
    found = []
    for pattern in _ASSIGNED:
        for m in pattern.finditer(text):
            lo, hi = m.span(m.lastindex)
            if pattern is _ASSIGNED[2]:  # not quoted: the end of a sentence is no part of it
                hi = lo + len(text[lo:hi].rstrip(_TRAILING))
            if hi - lo >= SHORTEST_ASSIGNED:
                found.append((lo, hi))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or lo >= out[-1][1]:
            out.append((lo, hi))
    at = 0
    more = []
    for m in _CANDIDATE.finditer(text):
        lo = m.start() + len(m[0]) - len(m[0].lstrip("./-_"))
        hi = lo + len(m[0].strip("./-_"))
        core = text[lo:hi]
        if len(core) < SHORTEST or not any(map(str.isalpha, core)) or core.isalpha() and (core.istitle() or core.islower() or core.isupper()):
            continue
        while at < len(out) and out[at][1] <= lo:
            at += 1
        if at == len(out) or out[at][0] >= hi:
            more.append((lo, hi))
    return sorted(out + more)


def features(text: str, lo: int, hi: int, path: str) -> list[float]:
    s = text[lo:hi]
    n = len(s)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s]
    counts = Counter(s)
    low = s.lower()
    pairs = [PAIRS[p] for a, b in zip(low, low[1:], strict=False) if (p := a + b) in PAIRS]
    before, after = text[max(0, lo - 48) : lo], text[hi : hi + 24]
    left = [w.lower() for w in _WORDS.findall(before)][-4:]
    right = [w.lower() for w in _WORDS.findall(after)][:2]
    inside = [w.lower() for w in _WORDS.findall(s)] if " " in s else []
    near = before.rstrip(" \"'`")[-1:]
    return [
        n,
        n in (32, 40, 64),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("s") / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(pairs) / len(pairs) if pairs else -6.0,
        len(pairs) / n,
        sum(len(m[0]) for m in _COVER.finditer(low)) / n,
        bool(_HEX.fullmatch(s)),
        bool(_UUID.fullmatch(s)),
        s.startswith(PREFIXES),
        s.count("/") + s.count("."),
        max(map(len, re.split(r"[^A-Za-z0-9]+", s))) / n,
        sum(w in GOOD_CUES for w in left),
        sum(w in BAD_CUES for w in left),
        any(w in BAD_CUES for w in right),
        near in ("=", ":") and near != "",
        before[-1:] in ('"', "'", "`") and after[:1] in ('"', "'", "`") and before[-1:] != "",
        before.rstrip(" \"'`").lower().endswith(("bearer", "basic", "token")),
        "://" in before[-12:] or before.endswith(("/", "@", "#")),
        bool(_SAFE_PATH.search(path)),
        bool(_CODE_PATH.search(path)),
        s.count(" "),
        sum(w in FUNCTION_WORDS for w in inside) / max(1, len(inside)),
        sum(w in PROMPTS or w in GOOD_CUES for w in inside),
        " " in s and s[0].isupper(),
        s[-1] in ".:?!",
    ]


@dataclass
class Scanner:
    forest: Forest
    threshold: float = 0.5

    def __call__(self, texts: list, paths: list) -> tuple[list, list]:
        """Candidates of each text, and their probabilities."""
        found = [candidates(t) if t else [] for t in texts]
        rows = [features(t, lo, hi, p or "") for t, p, c in zip(texts, paths, found, strict=True) for lo, hi in c]
        p = self.forest.probability(np.array(rows, float)).tolist() if rows else []
        out, at = [], 0
        for c in found:
            out.append(p[at : at + len(c)])
            at += len(c)
        return found, out


class Maker:
    """Labelled findings: a text around a candidate, a path, and whether it is a secret."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def words(self, n: int) -> str:
        r = self.r
        return " ".join(r.choice([r.choice(DICTIONARY), "".join(r.choice(["an", "the", "er", "ou", "ti", "on", "re", "ung", "ción"]) for _ in range(r.randint(1, 4)))]) for _ in range(n))

    def password(self) -> str:
        r = self.r
        return r.choice([
            self.chars(string.ascii_letters + string.digits, r.randint(8, 15)),
            self.chars(string.ascii_letters + string.digits + "!#$%&*+-.=?^_~", r.randint(8, 24)),
            r.choice(DICTIONARY).title() + self.chars(string.digits, r.randint(2, 4)) + r.choice("!#$%&*"),
            "".join(r.choice("4310$@" if r.random() < 0.25 else c) for c in r.choice(DICTIONARY) + r.choice(DICTIONARY)) + self.chars(string.digits, 2),
            "-".join(r.choice(DICTIONARY) for _ in range(r.randint(4, 6))),
        ])

    def phrase(self) -> str:
        """Words drawn by chance, as a pass phrase has them."""
        r = self.r
        n = r.randint(3, 7)
        made = ["".join(r.choice(["an", "er", "ou", "ti", "on", "re", "ka", "lo", "mi", "st"]) for _ in range(r.randint(2, 4))) for _ in range(n)]
        words = [r.choice([m, m, w]) for m, w in zip(made, r.sample([w for w in DICTIONARY if w not in FUNCTION_WORDS], n), strict=True)]
        words = [w.title() for w in words] if r.random() < 0.25 else words
        return " ".join(words) + (r.choice([" ", ""]) + self.chars(string.digits, r.randint(1, 3)) if r.random() < 0.25 else "")

    def prompt(self) -> str:
        """A sentence about a secret, as forms and messages have it."""
        r = self.r
        first = r.choice([*sorted(PROMPTS), "the", "a", "this", "no", "at least", "use", "set", "see", "how to", "stored in"])
        rest = [r.choice([r.choice(sorted(FUNCTION_WORDS)), r.choice(DICTIONARY), r.choice(sorted(PROMPTS)), r.choice(sorted(GOOD_CUES)), self.words(1)]) for _ in range(r.randint(1, 8))]
        out = " ".join([first, *rest])
        return (out[:1].upper() + out[1:] if r.random() < 0.6 else out) + r.choice(["", "", ".", ":", "?", "!", "..."])

    def finding(self) -> tuple[str, int, int, str, bool]:
        r = self.r
        hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
        secret = r.random() < 0.5
        paths = ["config/prod.env", "deploy.yaml", "app/settings.py", "notes", "", "docs/readme.md", "index.html", "app/main.py", "feed"]
        if secret:
            kind = r.randrange(9)
            s = [
                lambda: self.chars(hexes, r.choice([32, 40, 40, 40, 48, 64])),
                lambda: self.chars(mixed, r.choice([20, 24, 32, 40])),
                lambda: r.choice(PREFIXES) + self.chars(mixed, r.choice([16, 24, 36])),
                lambda: self.chars(mixed + "+/", r.choice([40, 43, 64])),
                lambda: "-".join(self.chars(mixed, 8) for _ in range(3)),
                self.password,
                self.password,
                lambda: self.chars(mixed, r.randint(10, 24)) if r.random() < 0.5 else self.password().replace("@", "_").replace("/", "_"),
                self.phrase,
            ][kind]()
            s = s.upper() if kind == 0 and r.random() < 0.2 else s
            cue = r.choice(["token", "api_key", "secret", "password", "auth_token", "access key", "client_secret", "TOKEN", "Bearer", "key"])
            if kind == 2 and r.random() < 0.3:
                cue = self.words(1)
            if kind in (5, 6, 8):
                cue = r.choice(["password", "db_password", "PASSWORD", "passwd", "pwd", "secret", "passphrase", "admin_password"])
            before = cue + r.choice([' = "', ": ", "=", " ", ' := "', "='"] if kind < 5 else [' = "', ": ", "=", ' := "', "='", '": "'])
            if kind == 8:
                before = cue + r.choice([' = "', "='", '": "', ': "', '="'])
            if kind == 7:
                before = r.choice(["postgres", "mysql", "amqp", "redis", "https", "mongodb"]) + "://" + r.choice(["admin", "root", "app", "user", ""]) + ":"
            path = r.choice(paths)
        else:
            kind = r.randrange(13)
            camel = "".join(w.title() for w in self.words(4).split() if w.isascii())
            s = [
                lambda: self.chars(hexes, r.choice([32, 40, 64])),
                lambda: "-".join(self.chars(hexes, n) for n in (8, 4, 4, 4, 12)),
                lambda: camel + self.chars(string.digits, 2) + "Handler",
                lambda: "/".join(r.choice(DICTIONARY) for _ in range(4)) + f"/v{r.randint(1, 9)}.{r.randint(0, 9)}",
                lambda: f"{self.words(1).encode('ascii', 'ignore').decode() or 'x'}.{self.chars(string.digits, 2)}.mail{r.randint(0, 9)}.example.com",
                lambda: f"20{self.chars(string.digits, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{self.chars(string.digits, 2)}-00-00Z",
                lambda: r.choice(["xxxxxxxxxxxxxxxx1234", "YOUR_API_KEY_HERE_0", "changeme-changeme-1", "1234567890abcdef1234567890abcdef", "EXAMPLEKEY0123456789"]),
                lambda: "_".join(r.choice(DICTIONARY) for _ in range(4)) + f"_{r.randint(1, 99)}",
                lambda: self.chars(mixed, 24),
                lambda: r.choice(["/", "-", "_", "."]).join(r.choice(DICTIONARY) for _ in range(r.randint(4, 6))),
                lambda: r.choice([r.choice(DICTIONARY) * 2, r.choice(DICTIONARY) + "-" + r.choice(DICTIONARY), f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-beta", "#" + self.chars(hexes, 6), "os.environ", "required", "process.env." + self.chars(string.ascii_uppercase, 6), "${" + r.choice(DICTIONARY).upper() + "_KEY}", "********", "<redacted>", "undefined", "application/json", f"{r.randint(10, 99)}:{r.randint(10, 59)}:{r.randint(10, 59)}"]),
                lambda: "".join(r.choice(["an", "the", "er", "ou", "ti", "on", "re", "ung"]) for _ in range(r.randint(3, 8))),
                self.prompt,
            ][kind]()
            s = s if kind >= 10 or len(s) >= SHORTEST else s + "-" + self.chars(string.digits, SHORTEST)
            if kind in (0, 8):
                cue, path = r.choice(["commit", "sha256", "md5", "checksum", "integrity", "etag", "hash", "blob", "revision"]), r.choice(["yarn.lock", "feed", "package-lock.json", "", "tests/data.txt"])
                before = cue + r.choice([": ", " ", "=", ' = "', ":"])
            elif kind == 12:
                before = r.choice(["password", "token", "secret", "key", "auth", "passwd", "credentials", "passphrase"]) + r.choice([' = "', '": "', "='", ': "'])
                path = r.choice([*paths, "locale/en.json"])
            elif kind == 10:
                before = r.choice(["name", "password", "token", "color", "version", "type", "secret", "key", "title", "time"]) + r.choice([' = "', ": ", "=", '": "', "='"])
                path = r.choice([*paths, "tests/test_x.py"])
            elif kind == 11:
                before = r.choice(["key ", "the token ", "name: \"", "basic ", "label = '", "a secret ", "Key: ", self.words(1) + ": "])
                path = r.choice(paths)
            else:
                before = r.choice([self.words(1) + " ", "id: ", 'href="', "see ", "key = ", "url=", "import "])
                path = r.choice([*paths, "tests/test_x.py"])
        head = self.words(r.randint(1, 6)) + " " + before
        quote = '"' if before.endswith('"') else "'" if before.endswith("'") else "@db.example.org/main" if secret and kind == 7 else ""
        return head + s + quote + r.choice([" ", ", ", ".\n", "; "] if not quote or quote[0] != "@" else [" ", "\n"]) + self.words(3), len(head), len(head) + len(s), path, secret


@lru_cache(maxsize=2)
def train(findings: int = FINDINGS, seed: int = 3) -> Scanner:
    """Fit the forest on ``findings`` labelled findings made up here."""
    maker = Maker(seed)
    x, y = [], []
    for _ in range(findings):
        text, lo, hi, path, secret = maker.finding()
        for a, b in candidates(text):
            if a < hi and lo < b:
                x.append(features(text, a, b, path))
                y.append(secret)
    return Scanner(forest(np.array(x, float), np.array(y, float)))


def scan(df: DataFrame, model: Scanner, text_col: str = "text", path_col: str | None = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_candidates``, ``n_secrets``, ``spans`` (start:end of each secret, by start).

    What is no candidate (see ``candidates``) is never a secret: a bare plain word, a bare run
    of under SHORTEST characters, digits alone.

    Offsets are code points, the end exclusive. A null text has no candidates, a null path is
    empty. Repeated rows stay; an empty table gives an empty one; other columns are dropped.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")

    def run(batches):
        for b in batches:
            texts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in slices(texts):
                found, p = model(texts[lo:hi], paths[lo:hi])
                good = [[f"{a}:{z}" for (a, z), q in zip(c, ps, strict=True) if q >= model.threshold] for c, ps in zip(found, p, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(c) for c in found], pa.int64()), pa.array([len(g) for g in good], pa.int64()), pa.array([",".join(g) for g in good], pa.string())],
                    names=["id", "n_candidates", "n_secrets", "spans"],
                )

    out = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), path).mapInArrow(run, f"id {id_type}, n_candidates bigint, n_secrets bigint, spans string")
    return out.withColumnRenamed("id", id_col)
