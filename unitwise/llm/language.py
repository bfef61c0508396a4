"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text (A-Z in lower case, white space as single spaces), forwards and
backwards, and labels every byte position; a document's probabilities are the mean of those of all its positions.
Texts are read in windows: of the positions of a text, each `STRIDE` form one window's own, read with `CONTEXT`
bytes more on either side, so that each position is labelled once, with what stands around it in neighbouring
words. All cuts lie before the first byte of a character. Windows of many texts go through the network together.

Training is back-propagation through time in numpy on a bounded sample: about `per_language` documents of each
language by hash, and `n_windows` windows of `TRAINED` bytes of them, languages weighing alike.

A null text, or one without a letter, is "und" with score 0. Without training rows every text is. A row without
an id is never learned from, and `held_out` is false for it. Repeated rows are labelled alike; of equal
probabilities the first language in order wins. Work and memory grow with a text's length, whatever that is. An empty table
gives no rows; columns besides id, text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, ship

CONTEXT, STRIDE, TRAINED = 16, 320, 48
PAD = 256
_LETTER = re.compile(r"[^\W\d_]").search


def read_as(text: str) -> bytes:
    """The bytes that the network reads of a text."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def cuts(text: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Where the windows' own positions begin, and the end of the text; each cut stands before a character's first byte."""
    at = np.arange(stride, len(text), stride)
    for _ in range(3):
        at -= (text[at] & 0xC0) == 0x80
    return np.concatenate(([0], at, [len(text)]))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded windows of all texts, each one's text, and the first and last (exclusive) of its own places."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    first, last, low, high, owner, start = [], [], [], [], [], 0
    for i, t in enumerate(texts):
        c = cuts(joined[start : start + len(t)])
        c = c[np.concatenate(([True], c[1:] > c[:-1]))] + start
        edges = c[:, None] + np.arange(-CONTEXT, -CONTEXT + 4)[None]  # a context begins before a character, too
        inside = np.clip(edges, start, start + len(t))
        good = np.append(joined, 0)[inside] & 0xC0 != 0x80
        lead = inside[np.arange(len(c)), good.argmax(1)]
        first.append(c[:-1])
        last.append(c[1:])
        low.append(np.maximum(lead[:-1], start))
        high.append(np.minimum(c[1:] + CONTEXT, start + len(t)))
        owner.append(np.full(len(c) - 1, i))
        start += len(t)
    first, last, low, high, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, last, low, high, owner))
    width = int((high - low).max()) if len(low) else 0
    at = low[:, None] + np.arange(width)[None]
    x = np.where(at < high[:, None], joined[np.minimum(at, max(0, len(joined) - 1))], PAD).astype(np.int64) if width else np.empty((0, 0), np.int64)
    return x, owner, first - low, last - low


def padded(words: list[bytes]) -> np.ndarray:
    width = max(map(len, words))
    x = np.full((len(words), width), PAD, np.int64)
    for i, w in enumerate(words):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    return x


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


@dataclass
class BiGru:
    """p: parameters E (byte inputs of the three gates), U (recurrent), b (inner bias) by direction; V, c of the output."""

    p: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def new(cls, languages: list[str], hidden: int = 8, seed: int = 0) -> BiGru:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            p[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            p[f"b{d}"] = np.zeros(hidden, np.float32)
        p["V"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        p["c"] = np.zeros(len(languages), np.float32)
        return cls(p, languages)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        e, u, b = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"b{d}"]
        n, k = x.shape[0], u.shape[0]
        h, states, cache = np.zeros((n, k), np.float32), np.zeros((x.shape[1], n, k), np.float32), []
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            a, r_u = e[x[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * k] + r_u[:, : 2 * k])
            z, r, c = zr[:, :k], zr[:, k:], r_u[:, 2 * k :] + b
            new = np.tanh(a[:, 2 * k :] + r * c)
            m = (x[:, t] != PAD)[:, None]
            before, h = h, np.where(m, new + z * (h - new), h)
            states[t] = h
            if keep:
                cache.append((t, before, z, r, c, new, m))
        return states, cache

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
        f, cf = self._run(x, "f", True)
        b, cb = self._run(x, "b", True)
        return self._out(np.concatenate((f, b), 2)), cf, cb, np.concatenate((f, b), 2)

    def _out(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["V"] + self.p["c"]
        q = np.exp(logits - logits.max(2, keepdims=True))
        return q / q.sum(2, keepdims=True)

    def _logits(self, x: np.ndarray, shortest: int) -> np.ndarray:
        """Logits (time, language, window) of windows whose padding, at the end, begins at `shortest` or later.

        Windows lie along the last axis, so that every step works on long runs of memory, and both directions go together:
        one reads place t, the other place T - 1 - t. exp alone is cheap: a gate is 1 / (1 + exp(-a)), tanh(a) is
        2 / (1 + exp(-2 a)) - 1. Padding read backwards leaves the state at zero; read forwards it comes after all places."""
        k, (n, length) = len(self.p["Uf"]), x.shape
        scale = np.repeat(np.float32([-1, -2]), [2 * k, k])
        e = [np.ascontiguousarray((self.p[f"E{d}"] * scale).T) for d in "fb"]
        u = np.stack([(self.p[f"U{d}"] * scale).T for d in "fb"])
        b = np.stack([self.p[f"b{d}"] * scale[2 * k :] for d in "fb"])[:, :, None]
        by_time = np.ascontiguousarray(x.T)
        h, a, r = np.zeros((2, k, n), np.float32), np.empty((2, 3 * k, n), np.float32), np.empty((2, 3 * k, n), np.float32)
        states = np.empty((2, length, k, n), np.float32)
        for t in range(length):
            back = length - 1 - t
            np.take(e[0], by_time[t], 1, a[0], "clip")
            np.take(e[1], by_time[back], 1, a[1], "clip")
            np.matmul(u, h, out=r)
            gates, new = a[:, : 2 * k], r[:, 2 * k :]
            gates += r[:, : 2 * k]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new += b
            new *= gates[:, k:]
            new += a[:, 2 * k :]
            np.exp(new, out=new)
            new += 1
            np.divide(np.float32(2), new, out=new)
            new -= 1
            h -= new
            h *= gates[:, :k]
            h += new
            if back >= shortest:
                h[1] *= by_time[back] != PAD
            states[0, t], states[1, back] = h[0], h[1]
        v = self.p["V"].T
        out = np.matmul(v[:, :k], states[0])
        out += np.matmul(v[:, k:], states[1])
        out += self.p["c"][:, None]
        return out

    def pooled(self, texts: list[bytes], most: int = 1024) -> np.ndarray:
        """The sum of the probabilities of all positions of each text."""
        x, owner, first, last = windows(texts)
        out = np.zeros((len(texts), len(self.languages)))
        length = (x != PAD).sum(1)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), most):
            part = order[i : i + most]
            w = x[part, : length[part].max()]
            with np.errstate(over="ignore"):
                q = self._logits(w, int(length[part].min()))
            q -= q.max(1, keepdims=True)
            np.exp(q, out=q)
            q /= q.sum(1, keepdims=True)
            t = np.arange(len(q))[:, None]
            q *= ((t >= first[part]) & (t < last[part]))[:, None, :]
            np.add.at(out, owner[part], q.sum(0).T)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        q, cf, cb, states = self.probabilities(x)
        mask = (x != PAD).T.astype(np.float32)
        total = mask.sum()
        d = q.copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= mask[:, :, None] / total
        k = self.p["Uf"].shape[0]
        g = {"V": np.einsum("tnk,tnl->kl", states, d), "c": d.sum((0, 1))}
        back = d @ self.p["V"].T
        for name, cache, part in (("f", cf, back[:, :, :k]), ("b", cb, back[:, :, k:])):
            u = self.p[f"U{name}"]
            du, db, de = np.zeros_like(u), np.zeros(k, np.float32), np.zeros_like(self.p[f"E{name}"])
            dh = np.zeros((len(y), k), np.float32)
            for t, before, z, r, c, new, m in reversed(cache):
                dh = dh + part[t]
                inner = np.where(m, dh, 0)
                dz, dn = inner * (before - new) * z * (1 - z), inner * (1 - z) * (1 - new * new)
                dr, dc = dn * c * r * (1 - r), dn * r
                rec = np.concatenate((dz, dr, dc), 1)
                np.add.at(de, x[:, t], np.concatenate((dz, dr, dn), 1))
                du += before.T @ rec
                db += dc.sum(0)
                dh = np.where(m, inner * z, dh) + rec @ u.T
            g |= {f"U{name}": du, f"b{name}": db, f"E{name}": de}
        loss = -(np.log(np.maximum(q[:, np.arange(len(y)), y], 1e-9)) * mask).sum() / total
        return float(loss), g

    def fit(self, words: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 1) -> BiGru:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(words), batch)
            _, g = self.gradient(padded([words[i] for i in at]), y[at])
            lr = rate * (1 - step / (steps + 1))
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def labelled(net: BiGru, texts: list[str | None], step: int = 2_000_000) -> tuple[list[str], list[float]]:
    """The language and its probability for each text; some `step` bytes go through the network at a time."""
    read = [read_as(t) if t and _LETTER(t) else b"" for t in texts]
    ends, start, sums = np.cumsum([len(r) for r in read]), 0, []
    while start < len(read):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, "right")))
        sums.append(net.pooled(read[start:stop]))
        start = stop
    names, scores = [], []
    for r, s in zip(read, np.concatenate(sums) if sums else (), strict=True):
        best = int(s.argmax())
        names.append(net.languages[best] if r else "und")
        scores.append(float(min(1.0, s[best] / s.sum())) if r else 0.0)
    return names, scores


def train(docs: DataFrame, learn_from: Column | None = None, per_language: int = 400, n_windows: int = 30_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """Fits a network; None without rows to learn from. Documents are drawn by hash, about `per_language` of each language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    counts = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for a language
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(29)), F.lit(1 << 30))
    take = None
    for lang, n in counts.items():
        one = (F.col(lang_col) == lang) & (draw < int((1 << 30) * min(1.0, per_language / n)))
        take = one if take is None else take | one
    sample = sorted((str(r[id_col]), r[lang_col], r[text_col]) for r in rows.where(take).select(id_col, lang_col, text_col).collect())
    rng = np.random.default_rng(5)
    words, y = [], []
    share = n_windows // max(1, len(sample)) + 1
    for _, lang, text in sample:
        own = np.frombuffer(read_as(text), np.uint8)
        heads = np.flatnonzero(own & 0xC0 != 0x80)
        for at in rng.choice(heads, min(share, len(heads) // 16 + 1)).tolist() if len(heads) else ():
            words.append(own[at : at + TRAINED].tobytes())
            y.append(languages.index(lang))
    if not words:
        return None
    y = np.array(y)
    even = np.bincount(y, minlength=len(languages)).max() // np.maximum(1, np.bincount(y, minlength=len(languages)))  # languages weigh alike
    at = np.concatenate([np.repeat(np.flatnonzero(y == k), even[k]) for k in range(len(languages))])
    return BiGru.new(languages).fit([words[i] for i in at], y[at])


def label(docs: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of docs."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            n = b.num_rows
            names, scores = labelled(net, b.column(1).to_pylist()) if net else (["und"] * n, [0.0] * n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred, score; rows held out (crc32 of the id modulo 3 is 1) are never learned from."""
    held_out = F.coalesce(fold(id_col, 3) == 1, F.lit(False))
    return label(docs, train(docs, ~held_out & F.col(id_col).isNotNull(), id_col=id_col), id_col).select(id_col, held_out.alias("held_out"), "lang_pred", "score")
