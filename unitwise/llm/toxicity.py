"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates, free of its length: shares of words on lexicons, second-person words near
lexicon words, capitals, punctuation, and signs of obfuscation (symbols or digits inside words, stretched
letters, spaced-out letters). The lexicons are learned from the labelled sample: words and word beginnings
by their smoothed log-odds between toxic and other documents, in three bands of strength, as found
plainly and as found after undoing obfuscation.

Training takes at most `sample` labelled rows (chosen by hash over all of them), on the driver, in numpy.
Lexicon, trees and calibration each learn from their own share of the sample, so that neither the trees nor
the calibration see what the lexicon has memorised. Scoring is one pass over all whole texts.

Null and empty texts have all features 0 and get the score of such. Without any label of one class the
score is the prior. Texts without labels are scored alike; clashing extra columns are ignored. Of rows that share
an id the least text is learned from; `held_out` is false for a row without an id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mix64, ship

#: English, German, French and Spanish words of address.
SECOND_PERSON = frozenset("you your yours u ur yourself du dich dir dein deine deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]+[@$!*#013457+|]+[^\W\d_]+")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_SPACED_HINT = re.compile(r"[^\W\d_][ .*_-][^\W\d_][ .*_-][^\W\d_][ .*_-]").search
_CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
_CAPITALS = bytes(range(65, 91))
_LEET = str.maketrans("@$!013457|+", "asioieastlt")
PREFIXES = (4, 5, 6)
BANDS = (2.0, 3.5, 5.0)
NAMES = ("n", *(f"{w}_{b}" for w in ("word", "start") for b in BANDS), "strongest", "sum", "hidden", "second", "second_near", "caps_words", "caps", "marks", "mixed", "stretched", "spaced", "distinct_hits")


def plain(text: str) -> str:
    """The text with spaced-out letters joined, symbols inside words read as letters, stretched letters shortened."""
    text = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text)
    text = _MIXED.sub(lambda m: m[0].translate(_LEET).replace("*", "").replace("#", ""), text)
    return _STRETCH.sub(r"\1", text)


def terms(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words marked by a trailing hyphen."""
    out = set(words)
    for w in words:
        n = len(w)
        for k in PREFIXES:
            if n > k:
                out.add(w[:k] + "-")
    return out


@dataclass
class Lexicon:
    """term -> log-odds."""

    odds: dict[str, float] = field(default_factory=dict)
    memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def learn(cls, texts: list[str], labels: np.ndarray, least: int = 4) -> Lexicon:
        seen = (Counter(), Counter())
        for t, y in zip(texts, labels, strict=True):
            seen[int(y)].update(terms(set(_WORD.findall(plain(t).lower()))))
        n1, n0 = max(1, int(labels.sum())), max(1, len(labels) - int(labels.sum()))
        odds = {}
        for w, c in seen[1].items():
            if c >= least:
                o = np.log((c + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1))
                if o >= BANDS[0]:
                    odds[w] = float(o)
        return cls(odds)

    def of(self, word: str) -> tuple[float, float]:
        get, n = self.odds.get, len(word)
        return get(word, 0.0), max((get(word[:k] + "-", 0.0) for k in PREFIXES if n > k), default=0.0)

    def token(self, token: str) -> Token | None:
        """What a lower-case token between white space adds to the features; None if nothing but a word."""
        found = self.memo.get(token, self)
        if found is self:
            if len(self.memo) > 150_000:
                self.memo.clear()
            found = self.memo[token] = self._token(token)
        return found

    def _token(self, token: str) -> Token | None:
        words = _WORD.findall(token)
        odds = max((self.of(w) for w in words), key=max, default=NONE)
        mixed, stretched = len(_MIXED.findall(token)), len(_STRETCH.findall(token))
        hidden = 0.0
        if mixed or stretched:
            hidden = max((max(self.of(w)) for w in _WORD.findall(plain(token))), default=0.0)
        second = any(w in SECOND_PERSON for w in words)
        if odds == NONE and not (mixed or stretched or second):
            return None
        return Token(odds[0], odds[1], second, mixed, stretched, hidden >= BANDS[1] and max(odds) < BANDS[1])


class Token(NamedTuple):
    word: float
    start: float
    second: bool
    mixed: int
    stretched: int
    hidden: bool


NONE = (0.0, 0.0)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    tokens = text.lower().split()
    n, counts = len(tokens) or 1, Counter(tokens)
    known = {t: x for t in counts if (x := lexicon.token(t)) is not None}
    hits = {t: x for t, x in known.items() if x.word or x.start}
    banded = [sum(counts[t] for t, x in hits.items() if x[part] >= b) / n for part in (0, 1) for b in BANDS]
    sums = [sum(counts[t] * x[k] for t, x in known.items()) for k in (2, 3, 4, 5)]
    second, mixed, stretched, hidden = sums
    near = 0
    if second and hits:
        who = np.array([i for i, t in enumerate(tokens) if t in known and known[t].second])
        at = np.array([i for i, t in enumerate(tokens) if t in hits])
        right = np.minimum(np.searchsorted(who, at), len(who) - 1)
        near = int(((np.abs(who[right] - at) <= 5) | (np.abs(who[np.maximum(right - 1, 0)] - at) <= 5)).sum())
    spaced = 0
    if sum(c for t, c in counts.items() if len(t) == 1) >= 4 or "." in text or "-" in text or "_" in text:
        found = _SPACED.findall(text) if _SPACED_HINT(text) else []
        spaced = len(found)
        hidden += sum(max(lexicon.of(re.sub(r"[ .*_-]", "", x).lower())) >= BANDS[1] for x in found)
    best = max((max(x.word, x.start) for x in hits.values()), default=0.0)
    total = sum(counts[t] * max(x.word, x.start) for t, x in hits.items())
    capitals = len(text.encode("utf-8", "surrogatepass")) - len(text.encode("utf-8", "surrogatepass").translate(None, _CAPITALS))
    return [
        float(np.log1p(n)), *banded, best, total / n, hidden / n, second / n, near / n,
        len(_CAPS.findall(text)) / n, capitals / len(text), (text.count("!") + text.count("?")) / n, mixed / n, stretched / n, spaced / n, float(min(20, len(hits))),
    ]


class Trees:
    """Gradient boosting of depth-limited trees on binned features with logistic loss, in numpy."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        def edges(v: np.ndarray) -> np.ndarray:
            rare = v[v > 0]  # most rates are 0 in most rows: cut both at 0 and among the rest
            return np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, self.bins // 2)[1:-1]), np.quantile(rare, np.linspace(0, 1, self.bins // 2)[:-1]) if len(rare) else []]))

        self.edges = [edges(x[:, j]) for j in range(x.shape[1])]
        b, p0 = self._binned(x), np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(len(y), self.base)
        width = max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            node = np.zeros(len(y), int)
            for i in range(size):
                rows = np.flatnonzero(node == i)
                if not len(rows):
                    continue
                sg, sh = g[rows].sum(), h[rows].sum()
                value[i] = self.rate * sg / (sh + self.l2)
                if i >= 2**self.depth - 1 or len(rows) < 8:
                    continue
                best = (1e-6, -1, 0)
                for j in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], width))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], width))[:-1]
                    ok = (hl > 0.2) & (sh - hl > 0.2)
                    gain = np.where(ok, gl**2 / (hl + self.l2) + (sg - gl) ** 2 / (sh - hl + self.l2) - sg**2 / (sh + self.l2), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[i], cut[i] = best[1], best[2]
                    node[rows] = np.where(b[rows, best[1]] <= best[2], 2 * i + 1, 2 * i + 2)
            self.trees.append((feature, cut, value))
            f += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[node]
                go = np.where(j < 0, node, np.where(b[rows, np.maximum(j, 0)] <= cut[node], 2 * node + 1, 2 * node + 2))
                node = go
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit (pool adjacent violators), with half a case of each class added at the ends. Equal x are one case."""
    xs, place = np.unique(x, return_inverse=True)
    weights, sums = np.bincount(place).astype(float), np.bincount(place, y)
    weights[0] += 0.5
    weights[-1] += 0.5
    sums[-1] += 0.5
    blocks: list[list[float]] = []
    for i in range(len(xs)):
        blocks.append([sums[i], weights[i], xs[i], xs[i]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    kx = np.array([v for b in blocks for v in (b[2], b[3])])
    ky = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return kx, ky


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.empty(0)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def fit(texts: list[str], labels: np.ndarray, shares: np.ndarray) -> Model:
    """shares: a hash-drawn number in [0, 1) for each row; it deals rows to lexicon, trees and calibration."""
    prior = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.5
    parts = [shares < 0.4, (shares >= 0.4) & (shares < 0.75), shares >= 0.75]
    if any(not 0 < labels[p].sum() < p.sum() for p in parts):
        if not 0 < labels.sum() < len(labels):
            return Model(Lexicon(), None, None, prior)
        parts = [np.ones(len(labels), bool)] * 3
    of = lambda p: [texts[i] for i in np.flatnonzero(p)]
    lexicon = Lexicon.learn(of(parts[0]), labels[parts[0]])
    x = lambda p: np.array([features(t, lexicon) for t in of(p)])
    trees = Trees().fit(x(parts[1]), labels[parts[1]])
    return Model(lexicon, trees, isotonic(trees.raw(x(parts[2])), labels[parts[2]]), prior)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most about `sample` labelled rows, drawn by the hash of their id from all that may be learned from.

    Only the ids and labels are joined before the draw; the texts of the drawn rows alone come to the driver."""
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn_from is not None:
        wanted = wanted.where(learn_from)
    wanted = wanted.groupBy(id_col).agg(F.max(label_col).alias("__y"))
    n = wanted.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30))
    drawn = wanted.where(draw < int((1 << 30) * min(1.0, sample / max(1, n))))
    # the draw bounds its size: about `sample` rows of two numbers
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(drawn), id_col)
    # of rows that share an id the least text stands for all, so that the draw's bound holds
    rows = rows.groupBy(id_col).agg(F.min("__text").alias("__text"), F.first("__y").alias("__y"), F.xxhash64(F.col(id_col), F.lit(19)).alias("__share")).collect()
    rows.sort(key=lambda r: (r["__share"], r["__text"] or ""))
    shares = (mix64(np.array([r["__share"] for r in rows], np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) / 2**53
    return fit([r["__text"] or "" for r in rows], np.array([r["__y"] for r in rows], float), shares)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, with their columns as they are."""
    spark = ship(docs.sparkSession)
    sent, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.score(b.column(place).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted; labels of rows held out (crc32 of the id modulo 4 is 2) are never seen."""
    held_out = F.coalesce(fold(id_col, 4) == 2, F.lit(False))  # labels are joined by id, so rows without one are never learned from
    model = train(docs, labels, ~held_out, id_col=id_col)
    return score(docs, model, id_col).select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
