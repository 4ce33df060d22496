"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base finds, per kind, leftmost non-overlapping matches and drops those that fail their check.
The field segments *islands*: stretches of digits and separators, and address-like stretches. Segments
longer than one token carry a kind and are scored by features of the whole span (length, Luhn sum,
number shape, how the span is cut off); dynamic programming over segments of at most ``MAX_TOKENS``
tokens chooses boundaries and kinds jointly. No entity can lie outside an island and plain tokens score
0, so segmenting the islands alone gives the best segmentation of the whole text.

It is trained on islands of a bounded sample of documents, labelled by the base, with written variants
of the labelled spans (without a plus sign, with "at" and "dot", other separators) as further examples and
spoiled ones (wrong check digit, part beyond 255) as counter-examples.
Added spans never overlap base spans. Offsets are code points, ends exclusive. Null text is empty.
A table without any base match trains no field, and only the base counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
SAMPLE_DOCS = 4000  # bound: documents whose islands train the field
SAMPLE_ISLANDS = 3000  # bound: islands kept of them
RESULT = "base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"

# The base patterns. Possessive repeats and the look-behind change no match, only the time on long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])")
_DOT = r"(?:\.|\x20?[(\[][Dd][Oo][Tt][)\]]\x20?|\x20[Dd][Oo][Tt]\x20)"
_ADDRESS = re.compile(
    r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}(?:\x20?@\x20?|\x20?[(\[][Aa][Tt][)\]]\x20?|\x20[Aa][Tt]\x20)[A-Za-z0-9-]{1,63}"
    rf"(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}"
)
# What every address holds from its "at" on: cheap to look for, and no text without it has an address.
_AT = re.compile(rf"(?:@\x20?|[(\[][Aa][Tt][)\]]\x20?|\x20[Aa][Tt]\x20)[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at, free = t.find("@"), 0
    while at >= 0:
        start = at
        while start > free and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = t.find("@", free)


def base_spans(t: str | None) -> list[Span]:
    """The base matches by start, then kind as listed."""
    if not t:
        return []
    out = [(0, s, e) for s, e in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return [(KINDS[k], s, e) for k, s, e in sorted(out, key=lambda x: (x[1], x[0]))]


def islands(t: str) -> list[tuple[int, int]]:
    """Merged stretches that can hold an entity."""
    found = [m.span() for rx in (_NUMBER, _QUAD) for m in rx.finditer(t)]
    if _AT.search(t):
        found += [m.span() for m in _ADDRESS.finditer(t)]
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def features(t: str, s: int, e: int, n_tokens: int) -> np.ndarray:
    """Features of the whole span t[s:e]."""
    x = t[s:e]
    digits = re.sub(r"[^0-9]", "", x)
    n = len(digits)
    left, right = t[s - 1 : s], t[e : e + 1]
    letters = bool(re.search("[A-Za-z]", x))
    parts = re.split(r"[ ().-]+", x.strip("+() .-"))
    sizes = tuple(len(p) for p in parts)
    quad = len(parts) == 4 and bool(re.fullmatch(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", x))
    small = quad and all(int(p) <= 255 for p in parts)
    spelled = bool(re.search(r"[(\[ ][Aa][Tt][)\] ]", x)) and bool(re.search(r"[(\[ .]([Dd][Oo][Tt])?[)\] ]?", x))
    address = bool(_ADDRESS.fullmatch(x))
    return np.array(
        [
            1, letters, x.count("@") == 1, spelled, address, letters and not address, n < 7, 7 <= n <= 9, 10 <= n <= 11,
            12 <= n <= 13, 14 <= n <= 15, n == 16, 17 <= n <= 19, n > 19, 14 <= n <= 19 and luhn(digits),
            14 <= n <= 19 and not luhn(digits), quad, small, x[0] == "+", "(" in x, sizes[-3:] == (3, 3, 4),
            len(sizes) >= 3 and all(2 <= k <= 4 for k in sizes[-3:]), len(sizes) == 1, len(sizes) >= 4 and set(sizes) == {4},
            left.isalnum() or left in ("@", "+", "(") and left != "", right.isalnum() or right == "@", n_tokens / MAX_TOKENS,
            x.count("(") != x.count(")"), not letters and max(sizes, default=0) > 4,
        ],
        np.float64,
    )


WIDTH = 29


class Lattice:
    """The candidate segments of one island: (first token, token after, start, end, features)."""

    def __init__(self, t: str, lo: int, hi: int):
        toks = [(lo + m.start(), lo + m.end()) for m in _TOKEN.finditer(t[lo:hi])]
        self.n = len(toks)
        self.segs = []
        for i, (s, _) in enumerate(toks):
            if t[s] in ").-" or t[s] == "@":
                continue
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                e = toks[j][1]
                c = t[s:e]
                if not t[e - 1].isalnum() or (j == i and e - s < 7):
                    continue
                if sum("0" <= k <= "9" for k in c) >= 4 or "@" in c or re.search(r"[ (\[][Aa][Tt]", c):
                    self.segs.append((i, j + 1, s, e))
        self.f = np.array([features(t, s, e, j - i) for i, j, s, e in self.segs]).reshape(-1, WIDTH)
        self.by_end: dict[int, list[int]] = {}
        for k, (_, j, _, _) in enumerate(self.segs):
            self.by_end.setdefault(j, []).append(k)

    def best(self, w: np.ndarray) -> list[Span]:
        """The best segmentation's entities."""
        score = self.f @ w.T  # segments x kinds
        value, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1]
            for k in self.by_end.get(j, ()):
                v = value[self.segs[k][0]] + score[k].max()
                if v > value[j]:
                    value[j], back[j] = v, k
        out, j = [], self.n
        while j > 0:
            k = back[j]
            if k < 0:
                j -= 1
            else:
                i, _, s, e = self.segs[k]
                out.append((KINDS[int(score[k].argmax())], s, e))
                j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: set[Span]) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold entities and its gradient, by forward-backward over segments."""
        score = self.f @ w.T
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        a = np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            a[j] = np.logaddexp.reduce([a[j - 1]] + [a[self.segs[k][0]] + total[k] for k in self.by_end.get(j, ())])
        b = np.zeros(self.n + 1)
        start: dict[int, list[int]] = {}
        for k, (i, _, _, _) in enumerate(self.segs):
            start.setdefault(i, []).append(k)
        for i in range(self.n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + 1]] + [b[self.segs[k][1]] + total[k] for k in start.get(i, ())])
        z = a[self.n]
        g, ll = np.zeros_like(w), -z
        for k, (i, j, s, e) in enumerate(self.segs):
            p = np.exp(a[i] + score[k] + b[j] - z)
            for y, kind in enumerate(KINDS):
                if (kind, s, e) in gold:
                    p[y] -= 1
                    ll += score[k, y]
            g -= p[:, None] * self.f[k][None]
        return ll, g


def variants(kind: str, x: str) -> list[str]:
    """Other ways to write a base match."""
    if kind == "email":
        return [x.replace("@", " at ").replace(".", " dot "), x.replace("@", " (at) "), x.replace("@", " [at] "), x.replace("@", "[at]").replace(".", "[dot]")]
    if kind == "phone":
        bare = x.lstrip("+")
        short = re.sub(r"^[0-9]+[ -](?=\()", "", bare)
        return [bare, short, re.sub(r"[() -]+", "-", short).strip("-"), re.sub(r"[() -]+", ".", short).strip(".")]
    if kind == "card":
        d = re.sub("[^0-9]", "", x)
        return [" ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [x.replace(".", " . ")]


def spoiled(kind: str, x: str) -> list[str]:
    """Changed base matches that are no personal data any more: a wrong check digit, a part beyond 255."""
    if kind == "card":
        return [x[:-1] + str((int(x[-1]) + k) % 10) for k in (1, 5)]
    return [re.sub("^[0-9]+", "999", x)] if kind == "ip" else []


def fit(samples: list[str], epochs: int = 60, rate: float = 0.1, l2: float = 1e-3) -> np.ndarray | None:
    """Weights (kinds x features) from island texts with a little context; None without a base match."""
    data = []
    for t in samples:
        gold = base_spans(t)
        data += [(t, gold)]
        for kind, s, e in gold:
            if len(gold) == 1:
                data += [(t[:s] + v + t[e:], [(kind, s, s + len(v))]) for v in variants(kind, t[s:e])]
                data += [(t[:s] + v + t[e:], []) for v in spoiled(kind, t[s:e])]
    if not any(g for _, g in data):
        return None
    built = [(Lattice(t, a, b), set(g)) for t, g in data for a, b in islands(t)]
    built = [(x, g) for x, g in built if x.segs]
    w = np.zeros((len(KINDS), WIDTH))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(5)
    for _ in range(max(3, min(epochs, 60_000 // max(1, len(built))))):
        for k in np.array_split(rng.permutation(len(built)), max(1, len(built) // 50)):
            g = sum((built[i][0].gradient(w, built[i][1])[1] for i in k), np.zeros_like(w)) / max(1, len(k)) - l2 * w
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Weights from the islands of at most SAMPLE_DOCS documents, chosen by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL")
    few = rows.select("i").orderBy(F.xxhash64("i"), "i").limit(SAMPLE_DOCS)

    @F.pandas_udf("array<string>")
    def cut(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([[t[max(0, a - 12) : b + 12] for a, b in islands(t) if b - a < 400][:20] if isinstance(t, str) else [] for t in s])

    got = rows.join(F.broadcast(few.distinct()), "i", "left_semi").select(F.explode(cut("t")).alias("x"))
    texts = [r["x"] for r in got.distinct().orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ISLANDS).collect()]
    return fit(texts)


def find(t: str | None, w: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that the field adds."""
    base = base_spans(t)
    if not t or w is None:
        return base, []
    added = []
    for a, b in islands(t):
        for kind, s, e in Lattice(t, a, b).best(w):
            if all(e <= s2 or s >= e2 for _, s2, e2 in base):
                added.append((kind, s, e))
    return base, added


def spans_column(text: Column, w: np.ndarray | None) -> Column:
    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            got = [find(t if isinstance(t, str) else None, w) for t in s]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in r] for r in got]
            yield pd.DataFrame({"base": [r[0] for r in rows], "added": [r[1] for r in rows]})

    return run(text)


def in_order(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    key = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(rank, x["kind"]).alias("r"), x["end"].alias("e"), x["kind"].alias("k")))
    return F.concat_ws(",", F.transform(F.array_sort(key), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))))


def masked_column(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (overlapping spans as one)."""

    @F.pandas_udf("string")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([mask(x, [] if v is None else [(y["kind"], int(y["start"]), int(y["end"])) for y in v]) if isinstance(x, str) else None for x, v in zip(t, s)])

    return run(text, spans)


def mask(t: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out.append(t[at:s] + f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + t[at:] if spans else t


def sha(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
