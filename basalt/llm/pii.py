"""Personal data: generators propose spans, gradient-boosted trees judge them by format and context.

Base spans come from four fixed patterns (email, ip, card, phone) and their checks, and always stay.
Wider generators propose further, overlapping spans: spaced or obfuscated mail addresses, digit runs
of any separator, IPv6 addresses, account numbers and long opaque strings. Trees boosted on logistic
loss score each by its format and by the words around it; a logistic fit on examples held back turns
margins into probabilities, and for each kind the least threshold whose precision there is 0.97 selects
spans. A selected span that meets a base span, or a better selected one, is left out.

The trees are trained here, on examples built from a seeded grammar of formats and contexts, positive
and misleading ones; the examples held back have formats and cue words that the others lack. Nothing of
the documents is gathered. Proposals are sought around digits and at signs, as far as the words there
reach, however long; the time is linear in the text.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive;
null ids and repeated rows are returned as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import plain

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "account", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]", re.IGNORECASE)
AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?", re.IGNORECASE)
NAME_END = re.compile(r"[\s@<>\"']")
HOST = re.compile(r"[^\s@<>\"']+(?: ?(?:\.|\(dot\)|\[dot\]) ?[^\s@<>\"']+)*", re.IGNORECASE)
AROUND = 96
#: By kind, the mail addresses of ``obfuscated`` apart.
GENERATORS = (
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|[0-9]{1,3}(?:[ ._-][0-9]{1,3}){3}")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .\-_/]?[0-9]){11,18}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}(?![0-9A-Za-z+/_=-])")),
)
CUES = (
    ("email", "mail", "contact", "write to", "reach"),
    ("ip ", "host", "server", "address", "from"),
    ("card", "visa", "pay", "credit"),
    ("phone", "tel", "call", "mobile", "fax"),
    ("ssn", "iban", "account", "social", "tax"),
    ("token", "key", "secret", "password", "api", "bearer"),
    ("version", "isbn", "order", "ref", "page", "total", "date", "year", "http", "www", "commit", "section"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that hold anything a pattern can start from; no pattern crosses a line."""
    m = TRIGGER.search(text)
    while m:
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        yield a, b
        m = TRIGGER.search(text, b)


def emails(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, sought from each @ outwards, in linear time."""
    p = text.find("@", a, b)
    while p >= 0:
        s = p
        while s > a and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, p + 1, b) if s < p else None
        if m:
            yield s, m.end()
            a = m.end()
        else:
            a = p + 1
        p = text.find("@", a, b)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base spans, in order."""
    out = []
    for a, b in lines(text):
        out += [(s, 0, e) for s, e in emails(text, a, b)]
        for m in IP.finditer(text, a, b):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, a, b):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if text.find("+", a, b) >= 0:
            for m in PHONE.finditer(text, a, b):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the lines within AROUND characters of a trigger, and on to the ends of the words they would cut."""
    for a, b in lines(text):
        lo = hi = a - 1
        for m in TRIGGER.finditer(text, a, b):
            if m.start() - AROUND > hi:
                if hi > lo:
                    yield lo, hi
                lo, floor = max(a, m.start() - AROUND), max(a, hi)
                while lo > floor and not text[lo - 1].isspace():
                    lo -= 1
            if m.end() + AROUND > hi:
                hi = min(b, max(hi, m.end() + AROUND))
                while hi < b and not text[hi].isspace():
                    hi += 1
        if hi > lo:
            yield lo, hi


def obfuscated(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Names and hosts around each at sign, spelled out or spaced too; from sign to sign, so in linear time."""
    signs = list(AT.finditer(text, a, b))
    for i, m in enumerate(signs):
        floor, top = (signs[i - 1].end() if i else a), (signs[i + 1].start() if i + 1 < len(signs) else b)
        s = m.start()
        while s > floor and not NAME_END.match(text[s - 1]):
            s -= 1
        host = HOST.match(text, m.end(), top) if s < m.start() else None
        if host:
            yield s, host.end()


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind's place, start, end) of all proposals, overlapping ones included."""

    def trimmed(a: int, b: int) -> int:
        while b > a and text[b - 1] in ".,;:!?":
            b -= 1
        return b

    for lo, hi in lines(text):
        for a, b in obfuscated(text, lo, hi):
            yield 0, a, trimmed(a, b)
    for lo, hi in windows(text):
        for kind, pattern in GENERATORS:
            for m in pattern.finditer(text, lo, hi):
                yield KINDS.index(kind), m.start(), trimmed(*m.span())


def describe(text: str, kind: int, a: int, b: int) -> list[float]:
    """Format and context features of a proposal."""
    s, before, after = text[a:b], text[max(0, a - 32) : a].lower(), text[b : b + 12].lower()
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    parts = re.split(r"[ ._-]", s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    cues = [float(any(c in before for c in group)) for group in CUES]
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(s), len(d), letters, len(s) - len(d) - letters, len(set(s)) / len(s),
        float(luhn(d)) if 12 <= len(d) <= 19 else -1.0,
        float(len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)),
        float(len(parts) == 4 and "." in s), float("@" in s), float("." in s.partition("@")[2]), float(s[0] == "+"), float("(" in s),
        float(all(c in "0123456789abcdefABCDEF" for c in s)), float(any(c.isupper() for c in s)), float(any(c.islower() for c in s)),
        len(groups), max(groups, default=0), min(groups, default=0), float(len(d) > 0 and d[0] == "0"), float(":" in s), float(s.count("/")),
        float(before[-1:] in ("=", '"', "'", ":")), float(before.rstrip(" \"'")[-1:] == "="), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.match(r"(19|20)[0-9]{2}[-/.]", s))),
        float(after[:1] in ('"', "'")), *cues, kind == 3 and cues[3] + 0.0, kind == 2 and cues[2] + 0.0,
    ]


class Trees:
    """Boosted regression trees on logistic loss, with a logistic calibration and a threshold a kind."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, precision: float = 0.97):
        self.rounds, self.depth, self.rate, self.precision = rounds, depth, rate, precision

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, kind: np.ndarray) -> Trees:
        """Trees from the rows that are not ``held``; calibration and the thresholds of each kind from those that are."""
        xt, yt = x[~held], y[~held]
        cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0.04, 0.96, 12))) for f in range(x.shape[1])]
        self.start = float(np.log((yt.mean() + 1e-6) / (1 - yt.mean() + 1e-6)))
        self.trees, margin = [], np.full(len(yt), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(xt, yt - p, p * (1 - p), cuts, np.arange(len(yt)), 0)
            self.trees.append(tree)
            margin += self.rate * self._walk(tree, xt)
        z, t = self.margin(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * np.mean((p - t) * z), b - 0.05 * np.mean(p - t)
        self.scale = (float(a), float(b))
        p = self.probability(x[held])
        self.thresholds = np.full(int(kind.max()) + 1, 0.99)
        for k in range(len(self.thresholds)):
            own = kind[held] == k
            good = [c for c in np.linspace(0.05, 0.99, 95) if (own & (p >= c)).any() and t[own & (p >= c)].mean() >= self.precision]
            self.thresholds[k] = good[0] if good else 0.99
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        def gain_of(gs, hs):
            return gs * gs / (hs + 1.0)

        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None, None)
        if depth < self.depth and len(rows) >= 16:
            for f, c in enumerate(cuts):
                v = x[rows, f]
                for cut in c:
                    left = v <= cut
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gain_of(gl, hl) + gain_of(total_g - gl, total_h - hl) - gain_of(total_g, total_h)
                    if gain > best[0]:
                        best = (gain, f, float(cut), left)
        if best[1] is None:
            return float(total_g / (total_h + 1.0))
        _, f, cut, left = best
        return (f, cut, self._grow(x, g, h, cuts, rows[left], depth + 1), self._grow(x, g, h, cuts, rows[~left], depth + 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        left, out = x[:, f] <= cut, np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -500, 500)))


def examples(n: int = 400, seed: int = 3) -> list[tuple[str, int, int, int, int, bool]]:
    """(text, kind's place, start, end, personal, held) built from formats and contexts; n of each kind and label.

    The last format and the last cue words of a list are for held examples only, a quarter of all.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    hexa = lambda k: "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, k))
    word = lambda: "".join("aeioustnrlmdcp"[d] for d in rng.integers(0, 14, rng.integers(2, 9)))
    many = lambda: int(rng.integers(16, 320))
    opaque = lambda k: "".join("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"[d] for d in rng.integers(0, 59, k))
    letters = lambda k: "".join("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"[d] for d in rng.integers(0, 49, k))

    def card(between: str, wrong: bool = False) -> str:
        d = num(15)
        d += str(next(c for c in range(10) if luhn(f"{d}{c}")) if not wrong else next(c for c in range(10) if not luhn(f"{d}{c}")))
        return between.join(d[i : i + 4] for i in range(0, 16, 4))

    good = {
        0: [lambda: f"{word()}.{word()} @ {word()}.com", lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{word()}(at){word()}.{pick(('de', 'fr', 'com'))}", lambda: f"é{word()}@{word()}.com", lambda: f"{word()} (AT) {word()} (dot) net"],
        1: [lambda: ":".join(hexa(4) for _ in range(8)), lambda: "-".join(str(rng.integers(1, 255)) for _ in range(4)), lambda: "_".join(str(rng.integers(1, 255)) for _ in range(4))],
        2: [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card("/"), lambda: card(".")],
        3: [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(2)} {num(4)} {num(4)}", lambda: f"({num(3)}) 555-{num(4)}", lambda: f"({num(4)}) {num(6)}"],
        4: [lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"{pick(('DE', 'FR', 'ES', 'GB'))}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", lambda: f"GB{num(2)}ABCD{num(12)}", lambda: f"NL{num(2)} ABNA {num(4)} {num(4)} {num(2)}"],
        5: [lambda: hexa(40), lambda: hexa(32), lambda: opaque(24), lambda: opaque(40), lambda: f"sk_{opaque(24)}", lambda: opaque(many()), lambda: f"{letters(many())}{num(1)}{letters(many())}", lambda: f"{opaque(30)}/{opaque(20)}+{opaque(12)}="],
    }
    bad = {
        0: [lambda: f"{word()} @ {num(2)}", lambda: f"{word()}@{word()}", lambda: f"{word()} @ {word()}"],
        1: [lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}.{rng.integers(256, 999)}", lambda: f"{num(3)} {num(3)} {num(3)} {num(3)}"],
        2: [lambda: f"20{num(2)}{num(10)}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: num(14), lambda: card("", wrong=True), lambda: card(" ", wrong=True), lambda: card(".", wrong=True)],
        3: [lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: num(8), lambda: num(10), lambda: f"{num(4)}-{num(4)}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"{num(3)} {num(3)} {num(3)}"],
        4: [lambda: f"AB{num(2)}{num(8)}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"XY{num(2)} {num(4)} {num(4)}"],
        5: [lambda: "-".join(word() for _ in range(5)) + f"-{num(1)}", lambda: "=" * 24 + "1", lambda: "-" * 20 + "2", lambda: "/".join(word() for _ in range(5)) + f"/{num(2)}", lambda: "A" * 20 + "1", lambda: num(18), lambda: f"{word()}_{word()}_{word()}_{num(3)}_{word()}"],
    }
    helps = {0: CUES[0], 1: ("host", "address", "ip "), 2: CUES[2], 3: CUES[3], 4: CUES[4], 5: CUES[5]}
    out = []
    for k in range(len(KINDS)):
        for label, formats in ((1, good[k]), (0, bad[k])):
            for i in range(n):
                held = i % 4 == 3
                some = lambda x: pick(x[-2:] if held else x[:-1])  # noqa: B023, E731
                s, cue = (formats[-1] if held else pick(formats[:-1]))(), ""
                if label and (k in (3, 4, 5) or rng.random() < 0.4):
                    cue = f"{some(helps[k])}{pick((': ', ' ', ' is ', ' = '))}" if rng.random() < 0.9 else ""
                elif not label and rng.random() < 0.6:
                    cue = f"{some(CUES[6])}{pick((': ', ' ', ' no. '))}"
                elif not label and k == 5 and rng.random() < 0.2:
                    cue = "key "
                quote = '"' if k == 5 and rng.random() < 0.6 and label else ""
                head = f"{word()} {word()} {cue}{quote}"
                out.append((f"{head}{s}{quote} {word()} {word()}", k, len(head), len(head) + len(s), label, held))
    return out


@lru_cache(maxsize=1)
def model() -> Trees:
    """The fitted trees; the same in every process."""
    rows = examples()
    x = np.array([describe(t, k, a, b) for t, k, a, b, _, _ in rows], float)
    kind, y, held = (np.array([r[c] for r in rows]) for c in (1, 4, 5))
    return Trees().fit(x, y.astype(float), held, kind)


def find(texts: list[str], trees: Trees) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int, str]]]]:
    """Base spans and all spans of each text, as (start, kind's place, end)."""
    bases, asked, rows = [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text) if text else []
        bases.append(base)
        for k, a, b in candidates(text) if text else ():
            if b - a >= 7 and all(b <= s or a >= e for s, _, e in base):
                asked.append((t, k, a, b))
                rows.append(describe(text, k, a, b))
    every = [list(b) for b in bases]
    if rows:
        p = trees.probability(np.array(rows, float))
        for i in np.argsort(-p, kind="stable").tolist():
            t, k, a, b = asked[i]
            if p[i] >= trees.thresholds[k] and all(b <= s or a >= e for s, _, e in every[t]):
                every[t].append((a, k, b))
    return bases, [sorted(e) for e in every]


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email .. n_phone and base_sha256 of the base spans, spans (all), n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(model())
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
                bases, every = find(texts, sent.value)
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in bases], pa.int64()) for kind in range(4)]
                sha = [hashlib.sha256(told(b).encode()).hexdigest() for b in bases]
                added = [len(e) - len(b) for e, b in zip(every, bases, strict=True)]
                yield pa.record_batch([batch.column(0).slice(i, 256), *counts, pa.array(sha, pa.string()), pa.array([told(e) for e in every], pa.string()), pa.array(added, pa.int64())], names=names)

    return plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, and n_chars, if there is one, counted anew; null texts stay null."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model()), docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                for text, spans in zip(part, find([t or "" for t in part], sent.value)[1], strict=True):
                    made, last = [], 0
                    for a, k, b in spans:
                        if b > last:
                            made += [text[last : max(a, last)], f"[{KINDS[k].upper()}]"]
                            last = b
                    out.append(text if not spans else "".join([*made, text[last:]]))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if count is not None:
                field = batch.schema.field(count)
                batch = batch.set_column(count, field, pa.array([None if t is None else len(t) for t in out], field.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
