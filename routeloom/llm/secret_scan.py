"""Secret scanning: base patterns and a linear-chain conditional random field.

The base patterns (assignments, access ids, long hex) give spans that always stay.
Beside them a linear-chain CRF tags every token of the text as begin, inside or outside
a secret from its shape, the words around it and features of the whole file, and is
decoded by Viterbi. Scores of all tokens are computed; from them follows, for each
place, the most that a secret beginning there could add to the best path. Where that
is below zero for a whole stretch, the best path is outside there, so the recursion
runs over the other stretches only, with outside on both borders: the result is that
of the whole chain.

The field is trained here, on sequences this module writes from a seed: credentials
of many formats in code and prose, and look-alikes (dates, versions, phone and card
numbers, addresses, paths, decorated words).

Offsets are code points, end exclusive. Null or empty text: no spans. Repeated rows:
scanned each. Empty table: no rows. A very long text is one chain in one task. All
other columns, whatever their names, pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, with_text

# The base patterns and the words that announce a credential.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CREDENTIAL_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private_key", "pwd")
PREFIXES = ("ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "glpat-", "eyJ", "AIza", "ya29.", "npm_", "shpat_")
WORDS = re.compile("|".join(map(re.escape, CREDENTIAL_WORDS)))
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}

TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]")
LONG = 12  # characters from which entropy and changes of kind are features
KEEP_TOKENS = 400_000
TAGS = 3  # outside, begin, inside


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]]))


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in Counter(t).values())


def shape(t: str) -> str:
    kinds = ("U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else c for c in t[:64])
    out = []
    for k in kinds:
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6])


def is_word(token: str) -> bool:
    return WORDS.search(token.lower()) is not None


def length_kind(token: str) -> int:
    return min(len(token), 64).bit_length()


def character_kinds(token: str) -> int:
    """How many of digits, upper case and lower case it has."""
    return any(map(str.isdigit, token)) + any(map(str.isupper, token)) + any(c.isalpha() and not c.isupper() for c in token)


def neighbour(token: str) -> str:
    return token if len(token) == 1 and not token.isalnum() else "w"


def own_features(t: str) -> list[str]:
    """What a token shows by itself."""
    n, classes = len(t), character_kinds(t)
    digits, letters = sum(map(str.isdigit, t)), sum(map(str.isalpha, t))
    f = ["bias", f"len{length_kind(t)}", f"classes{classes}", f"shape:{shape(t)}"]
    if n >= LONG:
        switches = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:], strict=False))
        f += [f"entropy{int(_entropy(t) * 2)}", f"switches{min(switches, 8) // 2}", f"classes{classes}long"]
    if digits == n:
        f.append("number")
    if (n - digits - letters) * 4 > n or "." in t or "/" in t:
        f.append("punctuated")
    if any(t.startswith(p) for p in PREFIXES):
        f.append("prefix")
    if is_word(t):
        f.append("word")
    return f


def near_features(near: int, classes: int, length: int) -> list[str]:
    """near: how many tokens back the closest credential word is, 0 for none within 4."""
    return [f"word-{near}", f"after-word:classes{classes}", f"after-word:len{length}"] if near else ["noword"]


def token_features(tokens: list[str], file_features: list[str]) -> list[list[str]]:
    words = list(map(is_word, tokens))
    out = []
    for i, t in enumerate(tokens):
        near = next((d for d in (1, 2, 3, 4) if i >= d and words[i - d]), 0)
        f = own_features(t) + near_features(near, character_kinds(t), length_kind(t))
        f += [f"{d}:{neighbour(tokens[i + d])}" for d in (-1, 1) if 0 <= i + d < len(tokens)]
        out.append(f + file_features)
    return out


def features_of_file(text: str, low: str) -> list[str]:
    out = []
    if "-----BEGIN" in text:
        out.append("file:pem")
    if any(w in low for w in CREDENTIAL_WORDS):
        out.append("file:words")
    if text.count("=") * 40 > len(text):
        out.append("file:config")
    return out


class Field:
    """Linear-chain CRF: a weight row per feature, a transition table."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((TAGS, TAGS))
        self.moves[0, 2] = -1e4  # inside follows begin or inside alone
        self.first = np.array([0.0, 0.0, -1e4])
        self._coder: Coder | None = None

    def emissions(self, fs: list[list[str]]) -> np.ndarray:
        zero = np.zeros(TAGS)
        return np.array([sum((self.weights.get(f, zero) for f in row), np.zeros(TAGS)) for row in fs])

    def path(self, e: np.ndarray, before: bool = False, after: bool = False) -> list[int]:
        """The best tags of tokens with scores e; before, after: outside is on that border."""
        score, back = (self.moves[0] if before else self.first) + e[0], []
        for row in e[1:]:
            total = score[:, None] + self.moves
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + row
        tags = [int((score + self.moves[:, 0] if after else score).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def stretches(self, e: np.ndarray) -> list[tuple[int, int]]:
        """[first, last] of the tokens that the best path may tag begin or inside: elsewhere it is outside.

        A secret from i to j adds at most enter + leave + begin_i + inside_(i+1) + ... + inside_j
        to the path without it, whatever stands beside it; one that adds less than nothing is in no best path.
        """
        m = self.moves - self.moves[0, 0]
        enter = (m[:, 1] - m[:, 0]).max()
        leave = max(0.0, (m[1:, :2] - m[0, :2]).max())
        begin = e[:, 1] - e[:, 0] + enter
        begin[0] = max(begin[0], begin[0] - enter + self.first[1] - self.first[0])
        inside = np.cumsum(e[:, 2] - e[:, 0] + m[1:, 2].max())
        most = np.maximum.accumulate(inside[::-1])[::-1]  # falls from left to right
        starts = np.flatnonzero(begin + leave - inside + most > -1e-6)
        if not len(starts):
            return []
        lasts = np.searchsorted(-most, (begin + leave - inside)[starts] + 1e-6) - 1
        out: list[list[int]] = []
        for a, b in zip(starts.tolist(), np.maximum(lasts, starts).tolist(), strict=True):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def decode(self, e: np.ndarray) -> list[tuple[int, list[int]]]:
        """(first token, tags) of the stretches that are not surely outside."""
        n = len(e)
        return [(a, self.path(e[a : b + 1], a > 0, b < n - 1)) for a, b in (self.stretches(e) if n else [])]

    def coder(self) -> "Coder":
        if self._coder is None:
            self._coder = Coder(self)
        return self._coder

    def __getstate__(self):
        return self.__dict__ | {"_coder": None}

    def step(self, fs: list[list[str]], tags: list[int], rate: float, decay: float) -> None:
        """One stochastic gradient step on the log-likelihood of a tagged sequence."""
        e = self.emissions(fs)
        n = len(e)
        forward, backward = np.zeros((n, TAGS)), np.zeros((n, TAGS))
        forward[0] = self.first + e[0]
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.moves, axis=0) + e[i]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.moves + (e[i + 1] + backward[i + 1])[None], axis=1)
        z = np.logaddexp.reduce(forward[-1])
        marginal = np.exp(forward + backward - z)
        for i, row in enumerate(fs):
            g = -marginal[i]
            g[tags[i]] += 1
            if np.abs(g).max() < 1e-4:
                continue
            for f in row:
                w = self.weights.get(f)
                self.weights[f] = rate * g if w is None else w * (1 - rate * decay) + rate * g
        for i in range(n - 1):
            pair = np.exp(forward[i][:, None] + self.moves + (e[i + 1] + backward[i + 1])[None] - z)
            g = -pair
            g[tags[i], tags[i + 1]] += 1
            g[0, 2] = 0
            self.moves += rate * 0.2 * g


class Coder:
    """Scores of token sequences. Tokens that show the same share a row; a token's row is kept."""

    def __init__(self, field: Field):
        self.field = field
        self.ids: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.plain: dict[tuple, int] = {}
        # of each row: its own scores, those it gives its next and its previous token, then word, classes, length
        self.rows = np.zeros((1024, 3 * TAGS + 3))
        self.near = np.array([[[self.sums(near_features(d, c, n)) for n in range(8)] for c in range(4)] for d in range(5)])

    def sums(self, fs: list[str]) -> np.ndarray:
        return self.field.emissions([fs])[0]

    def row(self, t: str) -> int:
        fs = own_features(t)
        kind = (neighbour(t), *fs)
        at = self.kinds.setdefault(kind, len(self.kinds))
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if at == len(self.kinds) - 1:
            self.rows[at] = [*self.sums(fs), *self.sums([f"-1:{kind[0]}"]), *self.sums([f"1:{kind[0]}"]), is_word(t), character_kinds(t), length_kind(t)]
        return at

    def learn(self, tokens: set[str]) -> None:
        if len(self.ids) > KEEP_TOKENS:
            self.ids.clear()
        ids, plain = self.ids, self.plain
        for t in tokens.difference(ids):
            if len(t) < LONG and t.isascii() and t.isalpha() and t.islower():
                # lower-case letters alone: length, credential words and known beginnings are all there is
                key = (len(t), is_word(t), t.startswith(PREFIXES))
                if (at := plain.get(key)) is None:
                    at = plain[key] = self.row(t)
                ids[t] = at
            else:
                ids[t] = self.row(t)

    def emissions(self, tokens: list[str], file_features: list[str]) -> np.ndarray:
        """Equal to the sums of the tokens' feature weights."""
        if unknown := set(tokens).difference(self.ids):
            self.learn(unknown if len(self.ids) <= KEEP_TOKENS else set(tokens))
        rows = self.rows[np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))]
        word, classes, length = rows[:, 3 * TAGS :].astype(np.int64).T
        near = np.zeros(len(tokens), np.int64)
        for d in (4, 3, 2, 1):
            near[d:][word[:-d] > 0] = d
        e = rows[:, :TAGS] + self.near[near, classes, length] + self.field.emissions([file_features])[0]
        e[1:] += rows[:-1, TAGS : 2 * TAGS]
        e[:-1] += rows[1:, 2 * TAGS : 3 * TAGS]
        return e


def _sequences(seed: int, n: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, secret spans) of written examples."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("aeiourstlnmdhéèüß", r.randint(2, 9)) + r.choice(["", "", "", ",", ".", "***", "%%%", "!!"])
    d = lambda k: pick(string.digits, k)
    b62, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def mixed(chars: str, k: int) -> str:
        while True:
            s = pick(chars, k)
            if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
                return s

    secrets = [
        lambda: r.choice(["ghp_", "gho_", "npm_"]) + mixed(b62, 36), lambda: r.choice(["sk-", "sk_live_"]) + mixed(b62, r.randint(24, 48)), lambda: "xoxb-" + d(11) + "-" + mixed(b62, 24),
        lambda: "AIza" + mixed(b62 + "_-", 35), lambda: "eyJ" + mixed(b62, 30) + "." + mixed(b62, 40) + "." + mixed(b62 + "_-", 43), lambda: mixed(b64, r.randint(32, 64)), lambda: mixed(b62, r.randint(24, 44)),
    ]
    weak = [lambda: mixed(b62, r.randint(10, 20)), lambda: pick(string.ascii_lowercase, r.randint(5, 8)) + d(r.randint(2, 5)), lambda: mixed(b62 + "_-", r.randint(12, 30))]
    harmless = [
        lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}Z", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: d(r.choice([4, 10, 12, 14, 15, 16, 16, 16, 19])), lambda: " ".join(d(4) for _ in range(4)), lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"{word().strip('.,*%!')}.{d(2)}@mail{d(1)}.example.com",
        lambda: f"https://www.{word().strip('.,*%!')}.com/{word().strip('.,*%!')}/{d(3)}?page={d(1)}", lambda: f"/usr/lib/python3.{d(2)}/{word().strip('.,*%!')}_{d(1)}.py", lambda: pick(string.ascii_lowercase, r.randint(3, 8)) + d(r.randint(1, 4)),
        lambda: pick(string.ascii_uppercase, 3) + "-" + d(r.randint(3, 6)), lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: pick("0123456789abcdef", 8) + "-" + "-".join(pick("0123456789abcdef", 4) for _ in range(3)) + "-" + pick("0123456789abcdef", 12),
        lambda: pick(string.ascii_lowercase, r.randint(12, 30)), lambda: word() + d(r.randint(1, 8)) + r.choice(["###", "$$$", "!!", "&&&"]),
    ]
    for _ in range(n):
        parts: list[tuple[str, bool]] = [(" ".join(word() for _ in range(r.randint(0, 6))) + " ", False)]
        kind = r.random()
        if kind < 0.25:
            quote = r.choice(["", '"', "'"])
            parts += [(r.choice(["export ", "", "client_", "db_"]) + r.choice(CREDENTIAL_WORDS) + r.choice(["=", " = ", ": ", " => "]) + quote, False), (r.choice(secrets + weak)(), True), (quote, False)]
        elif kind < 0.4:
            parts += [(f"the {r.choice(CREDENTIAL_WORDS)} {r.choice(['is', 'was', 'für', 'est'])} ", False), (r.choice(secrets + weak)(), True)]
        elif kind < 0.5:
            parts += [(r.choice(secrets)(), True)]
        elif kind < 0.6:
            parts += [(f"the {r.choice(CREDENTIAL_WORDS)} of {word()} {word()} {word()} on ", False), (r.choice(harmless)(), False)]
        else:
            parts += [(r.choice(harmless)(), False)]
        parts.append((" " + " ".join(word() for _ in range(r.randint(0, 5))), False))
        text, spans = "", []
        for s, secret in parts:
            if secret:
                spans.append((len(text), len(text) + len(s)))
            text += s
        yield text, spans


def train_field(seed: int = 5, sequences: int = 900, epochs: int = 6, rate: float = 0.1, decay: float = 0.002) -> Field:
    field, data = Field(), []
    for text, spans in _sequences(seed, sequences):
        low = text.lower()
        found = list(TOKEN.finditer(text))
        tags = [next((1 if m.start() == a else 2 for a, b in spans if a <= m.start() < b), 0) for m in found]
        if found:
            data.append((token_features([m[0] for m in found], features_of_file(text, low)), tags))
    r = random.Random(seed)
    for epoch in range(epochs):
        r.shuffle(data)
        for fs, tags in data:
            field.step(fs, tags, rate / (1 + epoch), decay)
    return field


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    found = field.decode(field.coder().emissions(tokens, features_of_file(text, text.lower())))
    if not any(any(tags) for _, tags in found):
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    out: list[tuple[int, int]] = []
    for first, tags in found:
        open_ = False
        for (a, b), tag in zip(places[first:], tags, strict=False):
            if tag == 1:
                out.append((a, b))
            elif tag == 2 and open_:
                out[-1] = (out[-1][0], b)
            open_ = tag > 0
    return out


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, base and added): an added span overlaps no base span."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in field_spans(text, field) if not any(a < e and s < b for _, s, e in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_field: dict[int, Field] = {}


def trained(seed: int = 5) -> Field:
    if seed not in _field:
        _field[seed] = train_field(seed)
    return _field[seed]


def scan(docs: DataFrame, *, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, found (array of kind, start, end)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trained(seed))
    rows = with_text(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    kind = rows.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [all_spans(t, shared.value) for t in b.column(1).to_pylist()]
            counts = [Counter(k for k, _, _ in base) for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in ("assign", "access", "hex")),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string()), pa.array([joined(every) for _, every in both], pa.string()),
                    pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in every] for _, every in both], pa.list_(span)),
                ],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    return rows.mapInArrow(run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, *, seed: int = 5, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced; overlapping spans become one mark."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trained(seed))
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, upto = [], 0
        for _, a, b in all_spans(text, shared.value)[1]:
            if a >= upto:
                out += [text[upto:a], mark]
            upto = max(upto, b)
        return "".join([*out, text[upto:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
