"""Language identification by a byte convolutional network (several filter widths, max pooling, softmax).

The network is trained in numpy on a bounded sample of labelled texts and then applied to every
fixed-length window of every whole text; the windows of an Arrow batch run as one batch.
Null text, or text without a letter: ``und`` with score 0. No labelled text at all: ``und``.
Repeated rows get equal answers; ties go to the alphabetically first language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 192  # bytes per window
WIDTHS = (2, 3, 4, 5)
FILTERS = 16  # per width
EMBED = 8
PAD = 256  # index of the zero vector
PER_LANG = 400  # bound: training documents per language
PER_DOC = 3  # bound: training windows per document
LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no decimal digits
RESULT = "lang string, score double"


def has_letter(text: str) -> bool:
    """True for a letter of any script; raised, circled and Roman numbers, fractions and the like are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text as rows of byte indexes, the last one padded."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteCnn:
    """Embedding, convolutions of several widths, max over positions, dense layer, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.5, (257, EMBED)), "b": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)
        self.p["d"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][PAD] = 0

    @staticmethod
    def _spans(e: np.ndarray, w: int) -> np.ndarray:
        n, size, _ = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * EMBED), (s[0], s[1], s[2])).reshape(-1, w * EMBED)

    def forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        pooled, keep = [], []
        for w in WIDTHS:
            a = (self._spans(e, w) @ self.p[f"k{w}"]).reshape(len(x), -1, FILTERS)
            at = a.argmax(1)
            m = np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p[f"c{w}"]
            pooled.append(np.maximum(m, 0))
            keep.append((at, m))
        h = np.concatenate(pooled, 1)
        z = h @ self.p["d"] + self.p["b"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        return q / q.sum(1, keepdims=True), e, h, keep

    def predict(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        return np.concatenate([self._pooled(x[i : i + step]) for i in range(0, len(x), step)])

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        h = [
            np.maximum((self._spans(e, w) @ self.p[f"k{w}"]).reshape(len(x), -1, FILTERS).max(1) + self.p[f"c{w}"], 0)
            for w in WIDTHS
        ]
        z = np.concatenate(h, 1) @ self.p["d"] + self.p["b"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        return q / q.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                g = self._grad(x[rows], y[rows])
                t += 1
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    s[k] += 0.001 * (d * d - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                self.p["emb"][PAD] = 0
        return self

    def _grad(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        q, e, h, keep = self.forward(x)
        n = len(x)
        dz = q.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"d": h.T @ dz, "b": dz.sum(0), "emb": np.zeros_like(self.p["emb"])}
        dh = dz @ self.p["d"].T
        for j, w in enumerate(WIDTHS):
            at, m = keep[j]
            d = dh[:, j * FILTERS : (j + 1) * FILTERS] * (m > 0)
            g[f"c{w}"] = d.sum(0)
            pos = at[:, :, None] + np.arange(w)  # rows x filters x width
            r = np.arange(n)[:, None, None]
            g[f"k{w}"] = np.einsum("nfwe,nf->wef", e[r, pos], d).reshape(w * EMBED, FILTERS)
            k = self.p[f"k{w}"].reshape(w, EMBED, FILTERS)
            de = np.einsum("nf,wef->nfwe", d, k)
            np.add.at(g["emb"], x[r, pos], de)
        return g


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG, per_doc: int = PER_DOC) -> ByteCnn | None:
    """Fit on at most ``per_lang`` usable labelled documents of each language, chosen by a hash of the id.

    Only ids and labels take part in the choice; the texts of the chosen few are read afterwards,
    and at most ``per_doc`` windows of each reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("y"), F.col(text_col).alias("t"), usable.alias("ok"))
    rows = rows.filter("ok AND i IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    few = rows.select("i", "y").withColumn("r", rank).filter(F.col("r") <= per_lang).select("i", "y")
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(per_doc - 1)),
        lambda k: F.expr("t").substr((F.length("t") * k / per_doc).cast("int") + 1, F.lit(WINDOW)),
    )
    got = rows.select("i", "y", cut.alias("w")).join(F.broadcast(few.dropDuplicates(["i"])), ["i", "y"], "left_semi").collect()
    sample = sorted({(r["y"], r["i"], tuple(dict.fromkeys(r["w"]))) for r in got})
    sample = [(y, w) for y, _, ws in sample for w in ws if has_letter(w)]
    if not sample:
        return None
    langs = sorted({y for y, _ in sample})
    rng = np.random.default_rng(11)
    x, y = [], []
    for lang, w in sample:
        data = w.encode()[:WINDOW]
        x.append(windows(data)[0])
        y.append(langs.index(lang))
        n = int(rng.integers(12, 64))  # short pieces too, for short texts and last windows
        if len(data) > n and has_letter(data[:n].decode(errors="ignore")):
            x.append(windows(data[:n])[0])
            y.append(langs.index(lang))
    return ByteCnn(langs).fit(np.stack(x), np.array(y))


def languages(texts: list[str | None], net: ByteCnn | None) -> tuple[list[str], list[float]]:
    """Per text: the language of the highest mean log-probability over its windows, and its mean probability."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if net is not None and t is not None and has_letter(t)]
    at = 0
    while at < len(use):
        rows, total = [], 0
        own = []
        while at < len(use) and total < 8_000:  # windows held at once
            w = windows(texts[use[at]].encode("utf-8", "replace"))
            own.append((use[at], len(w), (w != PAD).sum(1)))
            rows.append(w)
            total += len(w)
            at += 1
        q = net.predict(np.concatenate(rows))
        k = 0
        for i, n, size in own:
            part, weight = q[k : k + n].astype(np.float64), size / size.sum()
            k += n
            best = int((np.log(part + 1e-6) * weight[:, None]).sum(0).argmax())
            lang[i] = net.langs[best]
            score[i] = float(min(1.0, (part[:, best] * weight).sum()))
    return lang, score


def language_column(text: Column, net: ByteCnn | None) -> Column:
    """struct(lang, score) of a text column."""

    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            lang, score = languages([None if t is None or t != t else t for t in s], net)
            yield pd.DataFrame({"lang": lang, "score": score})

    return run(text)
