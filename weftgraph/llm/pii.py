"""Operator 7: personal data by candidate spans and gradient boosted trees.

High-recall generators propose overlapping spans (addresses, numbers, keys);
boosted trees judge each by its format (digits, separators, checksums, entropy)
and its context (neighbouring characters, words before it); a monotone
calibration on held-out candidates turns scores into probabilities, and each
kind's threshold is the smallest probability from which candidates of further
held-out sentences are true with PRECISION; spans over the kind's threshold are
taken greedily, the most probable first, so that the selected ones don't
overlap.

The trees are trained here, on candidates from generated sentences that hold
known personal data and look-alikes (dates, versions, order numbers, prices,
commit hashes, card numbers with a wrong check digit); fit() is deterministic
and takes a few seconds.  All patterns take time in proportion to a text, also
where it is one run of millions of characters: an address is read outwards from
its '@', and selected spans are kept sorted.

Defined cases: null and empty texts have no spans; rows without an id are read
too, with a null id; spans are [start, end) in characters of the whole text, of
any length; of rows that repeat an id each is read by itself; of spans with
equal probability the longer wins, then the first kind and place; other columns
are ignored by personal_spans and kept by redacted, which touches n_chars only
if it holds integers; an empty table gives no row.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = r"[^\s@<>()\[\]{}|,;:\"']"
#: The part before an '@', read backwards, the part after it, and what ends a domain.
_BEFORE, _AFTER, _TOP = re.compile(f"{_PART}+"), re.compile(f"{_PART}+"), re.compile(r"\.[A-Za-z]{2,}")
KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "secret")
#: Kind, what every match holds (looked for first, once a text), and the spans.
GENERATORS = [
    ("ip", r"[\d:]", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", r"\d", re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")),
    ("ssn", r"\d", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("iban", r"\d", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}\b")),
    ("phone", r"\d", re.compile(r"(?<![\w.])(?:\+|\(|00)?\d[\d ().\-/]{5,18}\d(?!\w)")),
    ("phone", r"\d", re.compile(r"(?<!\d)\+?\d{0,3} ?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)")),
    ("secret", "", re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})")),
    ("secret", "", re.compile(r"(?<![\w/+=-])[A-Za-z0-9_/+\-]{20,}={0,2}(?![\w/+=-])")),
]
NEEDS = sorted({need for _, need, _ in GENERATORS})
HINTS = [r"mail|contact|write", r"phone|tel|call|fax|mobile|cell", r"\bip\b|host|server|address|login", r"card|visa|credit|pay|charge", r"iban|bank|transfer|account", r"ssn|social", r"token|secret|key|passw|pwd|auth|bearer", r"version|v\.|release|build|update", r"order|invoice|item|ticket|isbn|no\.|page|number|#", r"commit|sha|hash|digest|checksum|id\b", r"\$|€|£|usd|eur|price|total|cost", r"date|year|since|until|from|born"]
_HINTS = [re.compile(h, re.I) for h in HINTS]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans around each '@': the characters of an address on both sides, up to the last dot with letters."""
    end = 0
    for m in re.finditer("@", text):
        at = m.start()
        # The stretch since the last '@' is read once, from its end.
        local = _BEFORE.match(text[end:at][::-1])
        end = at + 1
        after = _AFTER.match(text, at + 1)
        if local and after:
            top = None
            for top in _TOP.finditer(text, at + 2, after.end()):
                pass
            if top:
                yield at - local.end(), top.end()


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    has = {need for need in NEEDS if re.search(need, text)}
    for kind, need, pattern in GENERATORS:
        for m in pattern.finditer(text) if need in has else ():
            g = 1 if pattern.groups and m.group(1) is not None else 0
            s, e = m.span(g)
            while e > s and text[e - 1] in ".-/ (":
                e -= 1
            while s < e and text[s] == " ":
                s += 1
            if e > s:
                out.append((kind, s, e))
    return list(dict.fromkeys(out))


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'" else 5 if c in "=:" else 6 if c in "$€£%#" else 7


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    v = text[s:e]
    digits = re.sub(r"\D", "", v)
    before = text[max(0, s - 28) : s]
    n = len(v)
    counts = Counter(v)
    share = lambda test: sum(k for c, k in counts.items() if test(c)) / n
    entropy = -sum(x / n * math.log2(x / n) for x in counts.values())
    octets = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", v)
    groups = re.split(r"\D+", v.strip("+()"))
    hexa = bool(re.fullmatch(r"[0-9a-fA-F]+", v))
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, share(str.isalpha), share(str.isupper), entropy, len(groups), max(map(len, groups)), min(map(len, groups)),
        float(v.startswith("+")), float("(" in v), v.count("-"), v.count("."), v.count(" "), float("/" in v), float(13 <= len(digits) <= 19 and _luhn(digits)), float(bool(octets) and all(int(x) < 256 for x in octets.groups())),
        float(kind == "iban" and v.replace(" ", "").isalnum() and _iban(v)), float(hexa), float(bool(re.fullmatch(r"(19|20)\d\d[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./](19|20)?\d\d", v))), float(any(map(str.islower, counts))) + 2 * float(any(map(str.isupper, counts))) + 4 * float(bool(digits)),
        _class(before[-1:]), _class(text[e : e + 1]), *(float(bool(h.search(before))) for h in _HINTS),
    ]


@dataclass
class Trees:
    """Gradient boosted regression trees on the logistic loss, over quantile bins."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    knots: np.ndarray
    levels: np.ndarray
    threshold: dict[str, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels) if len(x) else np.zeros(0)


DEPTH, ROUNDS, STEP, BINS, L2 = 4, 60, 0.2, 32, 1.0


def boost(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> Trees:
    """Trees fitted to (x, y) and calibrated on (hx, hy) by pooling adjacent violators."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    model = Trees(edges, [], base, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    b = model.binned(x)
    width = BINS + 1
    flat = b + np.arange(x.shape[1]) * width
    score = np.full(len(y), base)
    inner = 2**DEPTH - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, width), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 8:
                size = x.shape[1] * width
                gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
                f, c = divmod(int(gain.argmax()), width)
                if gain[f, c] > 1e-6:
                    feature[node], cut[node] = f, c
            at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + L2) * STEP
        score += leaf[at - inner]
        model.trees.append((feature, cut, leaf))
    raw = model.raw(hx)
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for v, s in zip(hy[order], raw[order]):
        pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, n, s2 = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, s2]
    model.knots = np.array([q[2] for q in pools])
    model.levels = np.array([(q[0] + 0.01) / (q[1] + 0.02) for q in pools])
    return model


def _sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence with the true spans in it."""
    word = lambda: "".join(r.choice(["the", "ne", "ra", "to", "is", "con", "ter", "al", "é", "ou", "st"]) for _ in range(r.randint(1, 4)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            x = r.choice("3456789") + d(15)
            if _luhn(x) == valid:
                return x if r.random() < 0.6 else r.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        body, land = d(18), r.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        x = f"{land}{check:02d}{body}"
        return x if r.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    ip = lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))
    true = {
        "email": [lambda: f"{word()}{r.choice(['.', '_', '-', '+', ''])}{r.choice([word(), d(2)])}@{word()}{r.choice(['', d(1)])}.{r.choice(['example.com', 'org', 'net', 'co.uk', 'de'])}"],
        "phone": [lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+{r.randint(1, 99)}{d(10)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
        "ip": [ip, ip, ip, lambda: ":".join(hexa(4) for _ in range(8))],
        "card": [lambda: card(True)],
        "iban": [iban],
        "ssn": [lambda: f"{d(3)}-{d(2)}-{d(4)}"],
        "secret": [lambda: hexa(40), lambda: hexa(32), lambda: alnum(24), lambda: "sk-" + alnum(32), lambda: "AKIA" + alnum(16).upper(), lambda: alnum(10)],
    }
    lead = {"email": ["mail", "contact", ""], "phone": ["call", "phone", "tel.", ""], "ip": ["from", "host", "ip", ""], "card": ["card", "pay with", ""], "iban": ["IBAN", "account", ""], "ssn": ["SSN", "ssn:", ""], "secret": ['token = "', "api_key: ", "password=", "secret = '", "key: "]}
    false = [lambda: card(False), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: "version " + ".".join(d(1) for _ in range(4)), lambda: f"v. {d(1)}.{d(2)}.{d(1)}.{d(3)}", lambda: f"order {d(8)}", lambda: f"invoice #{d(10)}", lambda: f"ISBN 978-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"${d(1)},{d(3)},{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)} euro", lambda: f"commit {hexa(40)}", lambda: f"sha {hexa(32)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1990, 2030)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(4)} {d(4)}", lambda: word() * 8, lambda: "_".join(word() for _ in range(7)), lambda: f"{d(3)}.{r.randint(256, 999)}.{d(3)}.{d(3)}", lambda: f"pages {d(3)}-{d(4)}", lambda: f"{d(1)}.{d(12)}", lambda: f"id {d(14)}", lambda: f"{word()}/{word()}/{word()}-{word()}-{word()}"]
    text, spans = " ".join(word() for _ in range(r.randint(0, 8))), []
    for _ in range(r.randint(1, 3)):
        text += r.choice([" ", " ", " ", "\n", " | ", ", "])
        if r.random() < 0.55:
            kind = r.choice(KINDS)
            value = r.choice(true[kind])()
            bare = value.startswith(("AKIA", "sk-")) and r.random() < 0.5  # such keys tell by themselves
            start = r.choice(lead[kind]) if kind == "secret" and not bare or r.random() < 0.4 else ""
            text += start + (" " if start and kind != "secret" else "")
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + ('"' if start.endswith('"') else "'" if start.endswith("'") else r.choice(["", "", "", "."]))
        else:
            text += r.choice(false)()
        text += " " + " ".join(word() for _ in range(r.randint(0, 8)))
    return text, spans


PRECISION = 0.9


@lru_cache(maxsize=1)
def fit(sentences: int = 6000, seed: int = 11) -> Trees:
    """The trees, from generated sentences: a half fits them, a quarter calibrates, a quarter sets the thresholds."""
    r = random.Random(seed)
    x: list[list[float]] = []
    y: list[float] = []
    part: list[int] = []
    kinds: list[str] = []
    for i in range(sentences):
        text, spans = _sentence(r)
        truth = set(spans)
        for kind, s, e in candidates(text):
            x.append(features(text, kind, s, e))
            y.append(float((kind, s, e) in truth))
            part.append(i % 4)
            kinds.append(kind)
    xs, ys, ps, ks = np.array(x), np.array(y), np.array(part), np.array(kinds)
    model = boost(xs[ps < 2], ys[ps < 2], xs[ps == 2], ys[ps == 2])
    p = model.probability(xs)
    for kind in KINDS:
        mine = (ps == 3) & (ks == kind)
        model.threshold[kind] = _threshold(p[mine], ys[mine])
    return model


def _threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The middle between the smallest probability from which candidates are true with the precision and the next one; 1.01 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.flatnonzero(np.concatenate([p[1:] != p[:-1], [True]])) if len(p) else np.zeros(0, np.int64)
    good = last[np.cumsum(y)[last] >= precision * (last + 1)]
    if not len(good):
        return 1.01
    at = int(good[-1])
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def spans(texts: list[str | None], model: Trees) -> list[list[tuple[int, int, str, float]]]:
    """The selected spans (start, end, kind, probability) of each text, in order."""
    found, x = [], []
    for i, t in enumerate(texts):
        if t:
            for kind, s, e in candidates(t):
                found.append((i, kind, s, e))
                x.append(features(t, kind, s, e))
    p = model.probability(np.array(x)) if x else []
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    order = sorted((j for j in range(len(found)) if p[j] >= model.threshold[found[j][1]]), key=lambda j: (-p[j], found[j][2] - found[j][3], found[j]))
    for j in order:
        i, kind, s, e = found[j]
        mine, new = out[i], (s, e, kind, float(p[j]))
        at = bisect(mine, new)
        if (not at or mine[at - 1][1] <= s) and (at == len(mine) or e <= mine[at][0]):
            mine.insert(at, new)
    return out


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    parts, at = [], 0
    for s, e, kind, _ in found:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(parts) + text[at:]


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, score): every span to redact (see the module's text)."""
    model = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, fs in zip(batch.column(0).to_pylist(), spans(batch.column(1).to_pylist(), model)) for f in fs]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "kind", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return wanted.mapInArrow(run, "doc_id long, start int, end int, kind string, score double")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each selected span replaced by its kind in brackets; n_chars, if there, follows the new text."""
    model = fit()
    at = docs.columns.index("text")
    size = next((i for i, (name, kind) in enumerate(docs.dtypes) if name == "n_chars" and kind in ("int", "bigint")), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = spans(texts, model)
            cols = batch.columns
            if any(found):
                new = [redact(t, f) if f else t for t, f in zip(texts, found)]
                cols[at] = pa.array(new, cols[at].type)
                if size is not None:
                    cols[size] = pa.array([len(t) if f else n for t, f, n in zip(new, found, cols[size].to_pylist())], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
