"""Secrets: base patterns, and a character convolutional network over every candidate with its context.

Base kinds are assign (a value after password, secret, token and the like), access (AKIA...) and hex (long
runs). A candidate is any run of 12 or more key characters with a digit among letters, or of 20 or more with
capitals among small letters. The network sees the candidate and the characters around it, and scores every
candidate and every base finding; candidates that it accepts and that overlap no base span are added under the
kind "model", base findings stay whatever their score.

The network is trained in numpy on labelled findings: base findings of a bounded sample of documents
against the sample's other candidates, numbers and words, and findings made by recipes for known key and
no-key formats, in contexts of the sample. Half the positives lose their telling context. Probabilities are
calibrated by Platt scaling on held-back findings; the threshold is the highest that keeps `recall` of the
held-back positives. Bounds of what is learned from: about `sample` documents, `most` findings of each sort and three
plain runs of each.

Nulls and empty texts have no spans. Offsets are code points, ends exclusive; scans are linear. Repeated
rows give equal results. Runs of fewer characters than a candidate's are not scored. An empty table gives no rows; columns besides
id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "model")
Span = tuple[int, int, str]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").finditer
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}").finditer
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}").finditer
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}").finditer
_DIGIT, _ALPHA = re.compile(r"[0-9]").search, re.compile(r"[A-Za-z]").search
_UPPER, _LOWER = re.compile(r"[A-Z]").search, re.compile(r"[a-z]").search

LEFT, BODY, RIGHT = 20, 48, 8
WIDTH = LEFT + BODY + RIGHT


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS(text)]
    out += [(*m.span(), "hex") for m in _HEX(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN(text) if (_DIGIT(m[0]) and _ALPHA(m[0])) or (len(m[0]) >= 20 and _UPPER(m[0]) and _LOWER(m[0]))]


def view(text: str, start: int, end: int) -> str:
    """What the network sees: context and candidate in fixed places; a long candidate by its head and tail."""
    body = text[start:end]
    body = body if len(body) <= BODY else body[: BODY - 16] + body[-16:]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + body.ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def coded(views: list[str]) -> np.ndarray:
    """Character codes: printable ASCII, one for all else, none; the candidate's own characters apart from context."""
    raw = np.frombuffer("".join(views).encode("utf-32-le"), "<u4").reshape(-1, WIDTH).astype(np.int64)
    x = np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 30, 1))
    x[:, LEFT : LEFT + BODY] = np.where(x[:, LEFT : LEFT + BODY] > 0, x[:, LEFT : LEFT + BODY] + 97, 0)
    return x


@dataclass
class Cnn:
    """Embedding, one convolution, max and mean pooling, a linear output; `scale` holds Platt's slope and shift."""

    p: dict[str, np.ndarray]
    width: int = 5
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    @classmethod
    def new(cls, dims: int = 10, filters: int = 24, width: int = 5, seed: int = 0) -> Cnn:
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        return cls({"E": f(194, dims), "W": f(width * dims, filters), "b": np.zeros(filters, np.float32), "V": f(2 * filters), "c": np.zeros(1, np.float32)}, width)

    def _forward(self, x: np.ndarray):
        e = self.p["E"][x]
        n, t, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.width, 1).transpose(0, 1, 3, 2).reshape(n, t - self.width + 1, self.width * d)
        a = cols @ self.p["W"] + self.p["b"]
        r = np.maximum(a, 0)
        pooled = np.concatenate((r.max(1), r.mean(1)), 1)
        return pooled @ self.p["V"] + self.p["c"], cols, a, r, pooled

    def logits(self, views: list[str]) -> np.ndarray:
        out = [self._forward(coded(views[i : i + 512]))[0] for i in range(0, len(views), 512)]
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def probabilities(self, views: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(views).astype(float) + self.scale[1], -40, 40)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, cols, a, r, pooled = self._forward(x)
        n, t, k = r.shape
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)
        dp = d[:, None] * self.p["V"]
        dr = np.repeat(dp[:, None, k:] / t, t, 1)
        np.put_along_axis(dr, r.argmax(1)[:, None, :], np.take_along_axis(dr, r.argmax(1)[:, None, :], 1) + dp[:, None, :k], 1)
        da = np.where(a > 0, dr, 0)
        dcols = (da @ self.p["W"].T).reshape(n, t, self.width, -1)
        de = np.zeros((n, t + self.width - 1, dcols.shape[3]), np.float32)
        for j in range(self.width):
            de[:, j : j + t] += dcols[:, :, j]
        g = np.zeros_like(self.p["E"])
        np.add.at(g, x, de)
        return {"E": g, "W": np.einsum("ntc,ntk->ck", cols, da), "b": da.sum((0, 1)), "V": pooled.T @ d, "c": d.sum(keepdims=True)}

    def fit(self, views: list[str], y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Cnn:
        rng = np.random.default_rng(seed)
        x = coded(views)
        sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(s, batch // 2) for s in sides])
            for k, a in self.gradient(x[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def calibrate(self, views: list[str], y: np.ndarray, recall: float) -> Cnn:
        """Platt scaling by Newton steps with its smoothed targets, then the recall-constrained threshold."""
        z = self.logits(views).astype(float)
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.array([1.0, 0.0])
        design = np.stack((z, np.ones_like(z)), 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, design.T @ (p - target) + 1e-4 * w), -2, 2)
        self.scale = (float(w[0]), float(w[1]))
        own = np.sort(self.probabilities([v for v, t in zip(views, y, strict=True) if t == 1]))
        self.threshold = float(own[int((1 - recall) * len(own))]) if len(own) else 0.5
        return self


def recipes(rng: np.random.Generator, n: int) -> tuple[list[str], list[str]]:
    """Made keys of known formats, and made strings that look like keys but are none."""
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    words = ["data", "user", "index", "report", "version", "final", "image", "static", "assets", "build", "model", "config", "page", "view"]
    b64 = lambda k: base64.b64encode(rng.bytes(k)).decode()
    keys, others = [], []
    for i in range(n):
        keys.append([lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: b64(30), lambda: "eyJ" + b64(20).strip("=") + "." + b64(24).strip("="), lambda: pick(alnum, int(rng.integers(20, 44))), lambda: pick(hexa, int(rng.integers(16, 41))), lambda: "AIza" + pick(alnum + "_-", 35)][i % 8]())
        others.append([lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(rng.choice(words, 4)) + f"/{rng.integers(1, 99)}", lambda: "_".join(rng.choice(words, 3)) + f"_{rng.integers(2000, 2030)}", lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-{rng.integers(10, 60)}", lambda: "-".join(rng.choice(words, 3)) + f"-v{rng.integers(1, 9)}", lambda: "".join(str(w).title() for w in rng.choice(words, 3)) + str(rng.integers(1, 99)), lambda: pick(string.digits, int(rng.integers(16, 20))), lambda: "=" * int(rng.integers(16, 30)) + "1a"][i % 8]())
    return keys, others


def fit(found: list[tuple[str, int]], n_made: int = 800, recall: float = 0.95, seed: int = 3) -> Cnn:
    """found: (view, 1 if a base finding else 0) of a sample of documents."""
    rng = np.random.default_rng(seed)
    contexts = [v for v, _ in found] or ["\0" * WIDTH]
    views, y = [v for v, _ in found], [t for _, t in found]
    keys, others = recipes(rng, n_made)
    for made, label in ((keys, 1), (others, 0)):
        for s in made:
            c = contexts[int(rng.integers(len(contexts)))] if label == 0 or rng.random() < 0.5 else "\0" * WIDTH
            left = c[:LEFT].strip("\0") if label else re.sub(r"(?i)\S*(?:pass|secret|token|key)\S*.*", "", c[:LEFT].strip("\0"))
            views.append(view(left + s + c[LEFT + BODY :].strip("\0"), len(left), len(left) + len(s)))
            y.append(label)
    y = np.array(y, float)
    for i in np.flatnonzero((y == 1) & (rng.random(len(y)) < 0.5)):
        views[i] = "\0" * LEFT + views[i][LEFT:]
    for i in np.flatnonzero((y == 0) & (rng.random(len(y)) < 0.3)):
        views[i] = "\0" * LEFT + views[i][LEFT:]
    held = rng.random(len(y)) < 0.3
    part = lambda m: [views[i] for i in np.flatnonzero(m)]
    return Cnn.new().fit(part(~held), y[~held]).calibrate(part(held), y[held], recall)


def findings(text: str, most: int = 20) -> list[tuple[str, int]]:
    """Labelled views of one training document: base findings, other candidates, numbers and long words; `most` of each at most."""
    base = base_spans(text)
    inside = lambda s, e: any(a < e and s < b for a, b, _ in base)
    out = []
    for s, e, kind in base[:most]:
        s, e = _value(text, s, e, kind)
        out.append((view(text, s, e), 1))
    out += [(view(text, s, e), 0) for s, e in candidates(text)[:most] if not inside(s, e)]
    plain = [m.span() for m in islice(re.finditer(r"[A-Za-z]{12,}|[0-9][0-9 .-]{12,}[0-9]", text), 3)]
    return out + [(view(text, s, e), 0) for s, e in plain if not inside(s, e)]


def train(docs: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Cnn:
    """Fits on the findings of about `sample` documents, drawn by the hash of their id from all."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(43)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for t in b.column(0).to_pylist() for x in findings(t)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], names=["view", "y"])

    found = [(r.view, r.y) for r in rows.where(draw).select(text_col).mapInArrow(run, "view string, y long").distinct().collect()]
    return fit(sorted(found))


def _value(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The place of what a finding holds: of an assignment its value alone."""
    if kind != "assign":
        return start, end
    value = text.rfind(text[start:end].split("=")[-1].split(":")[-1].strip(" \"'"), start, end)
    return (value if value >= 0 else start), end


def scored(texts: list[str | None], net: Cnn) -> list[list[tuple[int, int, str, float]]]:
    """Each text's findings with their scores, in order: base spans, and candidates that the network accepts. It runs once over all."""
    asked, views = [], []
    for i, t in enumerate(texts):
        base = base_spans(t) if t else []
        for s, e, kind in base:
            asked.append((i, s, e, kind))
            views.append(view(t, *_value(t, s, e, kind)))
        for s, e in candidates(t) if t else ():
            if not any(a < e and s < b for a, b, _ in base):
                asked.append((i, s, e, "model"))
                views.append(view(t, s, e))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, s, e, kind), p in zip(asked, net.probabilities(views).tolist(), strict=True):
        if kind != "model" or p >= net.threshold:
            out[i].append((s, e, kind, p))
    return [sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for found in out]


def spans(texts: list[str | None], net: Cnn) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    return [([x[:3] for x in found if x[2] != "model"], [x[:3] for x in found]) for found in scored(texts, net)]


def find(docs: DataFrame, net: Cnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: array<struct<kind, start, end, base, score>> of each row."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(net)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "base": k != "model", "score": p} for s, e, k, p in found] for found in scored(b.column(1).to_pylist(), sent.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(struct))], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, base_sha256, spans, n_model (spans that only the network finds)."""
    found = find(docs, train(docs, id_col=id_col, text_col=text_col), id_col, text_col)
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts[:3], F.expr(f"sha2(cast({joined('filter(spans, x -> x.base)')} as binary), 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"), counts[3])
