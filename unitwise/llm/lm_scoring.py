"""Scores of texts under a language model learned from the same table.

Model. A causal self-attention layer over subword ids predicts the class of the next id; the id within its
class follows the counts of all training texts (smoothed, so every id is possible). Classes are the most
frequent ids, each alone, and clusters of the others by their neighbours. Texts are cut into windows that
overlap by `OVERLAP` ids; a window's attention is masked to what precedes, and each id is scored in the one
window where it lies past the overlap. A text ends with an end id, which is scored too.

What is learned grows with the corpus. Word counts, id counts and each id's neighbours (hashed into `BUCKETS`
buckets before and after it), from which the classes come, are summed over all training texts. Weights start
from Adam in numpy on a bounded sample (`sample` texts); then every partition goes on from there over all windows
of all its own texts, once, and what each partition changed is averaged parameter by parameter, an id's vector by
how often each partition met it.

Base. Unigram counts of lower-cased words and one end for each text, add-one smoothed. Counts are summed over
all training texts by the words' 64-bit hashes; the `frequent` most common and the end are sent to the tasks (a fixed
size), the others are joined to the documents' own rare words by a shuffle. Only a word that is rare in training and
frequent in texts held out can be a frequent key there; adaptive execution splits such a partition.

Nulls count as empty texts: one token, the end. Repeated rows score alike. Without training rows all counts
are 0 and the model stays at its start. A row without an id is held in neither part: it is never learned from,
and `held_out` is false for it. Whole texts are scored, whatever their length. An empty table gives no rows; columns besides
id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import MARKS, ChunkIds, encode_lines, load_ranks
from .common import coded_words, discard, fold, materialize, mix64, most_frequent, ship, spread

OVERLAP, STRIDE = 6, 14
LENGTH = OVERLAP + STRIDE
#: The end of a text among word hashes; no word hashes to it but by chance in 2^64.
END_WORD = 0x454E44
#: Exponents up to this size are not shifted by their row's maximum.
SAFE = 60.0
#: Buckets of neighbours on each side of an id.
BUCKETS = 16


class Subwords:
    """Subword ids of a text with A-Z in lower case; the end id follows the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

        self.chunks = ChunkIds(encode_lines(lambda text: self.encoding.encode_to_numpy(text, disallowed_special=())), 400_000, MARKS)

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the end."""
        return self.chunks.ids(pc.ascii_lower(texts), self.end)


_subwords: dict[tuple[str, str], Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _subwords:
        _subwords[path, pattern] = Subwords(path, pattern)
    return _subwords[path, pattern]


def windows_of(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, LENGTH) and targets (n, STRIDE) of texts, one after the other, and how many windows each has; -1 pads.

    Input i predicts what follows it; before a text stands the end id."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-sizes // STRIDE)
    lengths = OVERLAP + n * STRIDE + 1
    at = np.cumsum(lengths) - lengths
    line = np.full(int(lengths.sum()), -1, np.int64)
    line[at + OVERLAP] = end
    line[spread(at + OVERLAP + 1, sizes)] = np.concatenate(texts) if texts else line[:0]
    start = (np.repeat(at - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum()))[:, None]
    return line[start + np.arange(LENGTH)], line[start + OVERLAP + 1 + np.arange(STRIDE)], n


def windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return windows_of([ids], end)[:2]


@dataclass
class Attention:
    p: dict[str, np.ndarray]
    cls: np.ndarray  # class of each id
    within: np.ndarray  # log p(id | class)

    @classmethod
    def new(cls, vocabulary: int, classes: np.ndarray, within: np.ndarray, dims: int = 12, seed: int = 0) -> Attention:
        rng = np.random.default_rng(seed)
        f = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        n = int(classes.max()) + 1
        empty = np.where(np.bincount(classes, minlength=n) == 0, -30, 0).astype(np.float32)
        return cls({"E": f(0.3, vocabulary, dims), "q": f(0.3, dims, dims), "k": f(0.3, dims, dims), "v": f(0.3, dims, dims), "o": f(0.3, dims, n), "u": f(0.3, dims, n), "b": empty, "r": np.zeros(LENGTH, np.float32)}, classes, within)

    def _bias(self) -> np.ndarray:
        """Relative bias of the positions that are scored; -1e9 for what follows."""
        i, j = np.arange(OVERLAP, LENGTH)[:, None], np.arange(LENGTH)[None, :]
        return np.where(i >= j, self.p["r"][np.abs(i - j)], np.float32(-1e9)).astype(np.float32)

    @staticmethod
    def _exp(a: np.ndarray) -> None:
        """In place; each row is shifted by its maximum where an exponent could pass `SAFE`."""
        if max(a.max(), -a.min()) > SAFE:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)

    def gradient(self, x: np.ndarray, y: np.ndarray, some: int = 128) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of the targets and its gradient; `some` windows at a time, so few that their logits stay in a core's cache."""
        p, dims, n = self.p, self.p["E"].shape[1], (y >= 0).sum()
        qkv, ou = np.concatenate((p["q"], p["k"], p["v"]), 1), np.concatenate((p["o"], p["u"]))
        bias, gap, ones = self._bias(), np.arange(OVERLAP, LENGTH)[:, None] - np.arange(LENGTH)[None, :], np.ones(ou.shape[1], np.float32)
        d_qkv, d_ou, d_b, d_bias, d_e, loss = np.zeros_like(qkv), np.zeros_like(ou), np.zeros_like(p["b"]), np.zeros_like(bias), np.zeros_like(p["E"]), 0.0
        for i in range(0, len(x), some):
            xi, yi = x[i : i + some], y[i : i + some]
            at, rows = np.maximum(xi, 0), len(xi)
            e = p["E"].take(at, 0)
            f = (e.reshape(-1, dims) @ qkv).reshape(rows, LENGTH, 3 * dims)
            q, k, v = f[:, OVERLAP:, :dims], f[:, :, dims : 2 * dims], f[:, :, 2 * dims :]
            a = q @ k.transpose(0, 2, 1)
            shift = max(a.max(), -a.min()) + np.abs(p["r"]).max() > SAFE
            a += bias
            padded = np.flatnonzero((xi < 0).any(1))
            a[padded] += np.where(xi[padded] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
            if shift:
                a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            a /= (a.reshape(-1, LENGTH) @ np.ones(LENGTH, np.float32)).reshape(rows, STRIDE, 1)
            cd = np.concatenate((a @ v, e[:, OVERLAP:]), 2).reshape(-1, 2 * dims)
            g = cd @ ou
            g += p["b"]
            target = self.cls[np.maximum(yi, 0)].reshape(-1)
            picked = np.arange(len(g)), target
            weight = (yi >= 0).reshape(-1).astype(np.float32) / np.float32(n)
            self._exp(g)
            total = g @ ones
            loss -= float(np.log(g[picked] / total + 1e-30) @ weight)
            g *= (weight / total)[:, None]
            g[picked] -= weight
            d_ou += cd.T @ g
            d_b += np.ones(len(g), np.float32) @ g
            d_cd = (g @ ou.T).reshape(rows, STRIDE, 2 * dims)
            d_ctx = d_cd[:, :, :dims]
            da = d_ctx @ v.transpose(0, 2, 1)
            da -= np.einsum("bij,bij->bi", da, a)[..., None]
            da *= a
            d_bias += da.sum(0)
            df = np.zeros_like(f)
            df[:, OVERLAP:, :dims] = da @ k
            df[:, :, dims : 2 * dims] = da.transpose(0, 2, 1) @ q
            df[:, :, 2 * dims :] = a.transpose(0, 2, 1) @ d_ctx
            df = df.reshape(-1, 3 * dims)
            d_qkv += e.reshape(-1, dims).T @ df
            de = (df @ qkv.T).reshape(e.shape)
            de[:, OVERLAP:] += d_cd[:, :, dims:]
            de[padded] *= (xi[padded] >= 0)[..., None]
            np.add.at(d_e.reshape(-1), (at[..., None] * dims + np.arange(dims)).reshape(-1), de.reshape(-1))
        r = np.bincount(gap[gap >= 0], d_bias[gap >= 0], LENGTH).astype(np.float32)
        dq, dk, dv = np.split(d_qkv, 3, 1)
        return loss, {"E": d_e, "q": dq, "k": dk, "v": dv, "o": d_ou[:dims], "u": d_ou[dims:], "b": d_b, "r": r}

    def step(self, x: np.ndarray, y: np.ndarray, moments: tuple[dict, dict], done: int, rate: float) -> None:
        """One step of Adam; `done` counts the steps with these moments, this one included."""
        m, v = moments
        for k, g in self.gradient(x, y)[1].items():
            m[k] *= 0.9
            m[k] += 0.1 * g
            v[k] *= 0.99
            v[k] += 0.01 * g * g
            down = v[k] / (1 - 0.99**done)
            np.sqrt(down, out=down)
            down += 1e-8
            np.divide(m[k], down, out=down)
            down *= rate / (1 - 0.9**done)
            self.p[k] = self.p[k] - down

    def moments(self) -> tuple[dict, dict]:
        return {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.03, seed: int = 1) -> Attention:
        """Adam on windows drawn at random."""
        rng = np.random.default_rng(seed)
        moments = self.moments()
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            self.step(x[at], y[at], moments, step, rate * (1 - step / (steps + 1)))
        return self


class Scorer:
    """Scores windows with two tables of a model, computed once: queries and vectors of the ids that are scored from, keys and values of all.

    Where no exponent can pass `SAFE`, none is shifted by its row's maximum."""

    def __init__(self, model: Attention):
        self.model, p = model, model.p
        e, one = p["E"], np.ones((len(p["E"]), 1), np.float32)
        q, k, v = e @ p["q"], e @ p["k"], e @ p["v"]
        self.own, self.all, self.dims = np.concatenate((q, e, one), 1), np.concatenate((k, v, one), 1), e.shape[1]
        self.out = np.concatenate((p["o"], p["u"], p["b"][None]))
        self.bias = model._bias()
        size = lambda a: float(np.sqrt((a.astype(float) ** 2).sum(1).max()))
        self.shift_scores = size(q) * size(k) + float(np.abs(p["r"]).max()) > SAFE
        self.shift_logits = size(v) * size(p["o"].T) + size(e) * size(p["u"].T) + float(np.abs(p["b"]).max()) > SAFE
        self.cls, self.within, self.ones = model.cls.astype(np.int64), model.within.astype(np.float32), np.ones(self.out.shape[1], np.float32)

    def logs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target; 0 where padded."""
        at, dims = np.maximum(x, 0), self.dims
        own, met = self.own.take(at[:, OVERLAP:], 0), self.all.take(at, 0)
        a = own[:, :, :dims] @ met[:, :, :dims].transpose(0, 2, 1)
        a += self.bias
        first = np.flatnonzero(x[:, 0] < 0)  # only a text's first window has padding before its ids
        if len(first):
            a[first] += np.where(x[first] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        if self.shift_scores:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        ctx = a @ met[:, :, dims:]  # values, and the sum of the weights
        own = own.reshape(-1, own.shape[-1])
        logits = np.concatenate((ctx[:, :, :dims] / ctx[:, :, dims:], own[:, dims:].reshape(*ctx.shape[:2], -1)), 2).reshape(len(own), -1) @ self.out
        target = np.maximum(y, 0).reshape(-1)
        picked = logits[np.arange(len(target)), self.cls[target]]
        top = logits.max(-1) if self.shift_logits else 0
        if self.shift_logits:
            logits -= top[:, None]
        total = np.log(np.exp(logits, out=logits) @ self.ones) + top
        return np.where(y >= 0, (picked - total + self.within[target]).reshape(y.shape), 0.0)

    def score(self, texts: list[np.ndarray], end: int, most: int = 4096) -> list[float]:
        """log10 probabilities; windows of many texts go through attention together."""
        out, first = np.zeros(len(texts)), 0
        ends = np.cumsum([-(-len(t) // STRIDE) for t in texts])
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            x, y, n = windows_of(texts[first:last], end)
            who = np.repeat(np.arange(first, last), n)
            for i in range(0, len(x), 96):  # so few that the logits stay in a core's cache
                np.add.at(out, who[i : i + 96], self.logs(x[i : i + 96], y[i : i + 96]).sum(1, dtype=np.float64))
            first = last
        return (out / np.log(10)).tolist()


def classes_of(counts: np.ndarray, around: np.ndarray, alone: int = 24, clusters: int = 56, seed: int = 0) -> np.ndarray:
    """The `alone` most frequent ids by themselves; the others by k-means on which buckets of ids stand before and after them."""
    order = np.argsort(-counts, kind="stable")
    cls = np.full(len(counts), alone + clusters - 1, np.int64)  # ids hardly met
    seen = np.flatnonzero(around.sum(1) >= 5)
    rest = np.setdiff1d(seen, order[:alone])
    if len(rest) > clusters:
        from .near_vectors import centroids, unit

        share = around[rest] / np.maximum(1, around.sum(0))
        x = unit(np.sqrt(share))
        c = centroids(x, clusters - 1, seed=seed)
        cls[rest] = alone + np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    cls[order[:alone]] = np.arange(alone)
    return cls


def within_class(counts: np.ndarray, cls: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    mass = np.bincount(cls, counts + smooth)
    return np.log((counts + smooth) / mass[cls])


def _encoded(docs: DataFrame, learn: Column, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """One pass over docs, written by kind of row: 0, a word's hash and count in some texts; 1, an id, its count and its neighbours
    by bucket in a task's texts; 2, a document with its ids. Counts are those of texts to learn from."""
    end = subwords(path, pattern).end
    raw = "<u2" if end < 1 << 16 else "<u4"
    of_id = docs.schema[id_col].dataType
    columns = {"kind": pa.int32(), "key": pa.int64(), "n": pa.int64(), "around": pa.list_(pa.int32()), "text": pa.string(), "ids": pa.binary(), "learn": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, of = subwords(path, pattern), pa.null()
        width, size, ends = 2 * BUCKETS, coder.end + 1, 0
        bucket = (mix64(np.arange(size, dtype=np.uint64) + np.uint64(11)) % np.uint64(BUCKETS)).astype(np.int64)
        ids_n, around = np.zeros(size, np.int64), np.zeros(size * width, np.int64)

        def rows(kind: int, **given) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            arrays = [pa.array(np.full(n, kind, np.int32)) if c == "kind" else given.get(c, pa.nulls(n, t)) for c, t in columns.items()]
            return pa.RecordBatch.from_arrays([*arrays, given.get("id", pa.nulls(n, of))], names=[*columns, "id"])

        def count(ids: np.ndarray) -> None:
            """Adds ids that stand one after the other, with an end before and after each text."""
            ids_n[:] += np.bincount(ids[1:], minlength=size)
            around[:] += np.bincount(ids[1:] * width + bucket[ids[:-1]], minlength=len(around))
            around[:] += np.bincount(ids[:-1] * width + BUCKETS + bucket[ids[1:]], minlength=len(around))

        for b in batches:
            of, learned = b.column(0).type, b.column(2)
            line, held, packed = [np.array([coder.end], np.uint32)], 0, []
            for ids, used in zip(coder.ids(b.column(1)), learned.to_pylist(), strict=True):
                packed.append(ids.astype(raw).tobytes())
                if used:
                    line.append(ids)
                    held += len(ids)
                    if held > 3_000_000:
                        count(np.concatenate(line).astype(np.int64))
                        line, held = [np.array([coder.end], np.uint32)], 0
            if held:
                count(np.concatenate(line).astype(np.int64))
            ends += pc.sum(learned).as_py() or 0
            words = [(hashed, np.bincount(at, minlength=len(hashed))) for hashed, at, _ in coded_words(b.column(1).filter(learned))]
            if words:
                key, place = np.unique(np.concatenate([h for h, _ in words]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n for _, n in words]), len(key)).astype(np.int64)
                yield rows(0, key=pa.array(key.view(np.int64)), n=pa.array(n))
            for i in range(0, b.num_rows, 1000):
                yield rows(2, id=b.column(0).slice(i, 1000), text=b.column(1).slice(i, 1000), ids=pa.array(packed[i : i + 1000], pa.binary()), learn=learned.slice(i, 1000))
        if ends:
            yield rows(0, key=pa.array([END_WORD]), n=pa.array([ends]))
            used = np.flatnonzero(ids_n)
            yield rows(1, key=pa.array(used), n=pa.array(ids_n[used]), around=pa.array(list(around.reshape(size, width)[used].astype(np.int32)), pa.list_(pa.int32())))

    schema = f"kind int, key long, n long, around array<int>, text string, ids binary, learn boolean, id {of_id.simpleString()}"
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(run, schema)
    return materialize(made, "lm-encoded", "kind")


def _unpacked(column: pa.Array, end: int) -> list[np.ndarray]:
    raw = "<u2" if end < 1 << 16 else "<u4"
    return [np.frombuffer(x, raw).astype(np.int64) for x in column.to_pylist()]


def _vectors(model: Attention) -> np.ndarray:
    """All parameters but the ids' vectors, as rows as wide as these."""
    flat = np.concatenate([model.p[k].reshape(-1) for k in sorted(model.p) if k != "E"])
    return np.pad(flat, (0, -len(flat) % model.p["E"].shape[1])).reshape(-1, model.p["E"].shape[1])


def _with_vectors(model: Attention, ids: np.ndarray, rest: np.ndarray) -> Attention:
    p, at, flat = {"E": ids.astype(np.float32)}, 0, rest.reshape(-1)
    for k in sorted(model.p):
        if k != "E":
            size = model.p[k].size
            p[k], at = flat[at : at + size].reshape(model.p[k].shape).astype(np.float32), at + size
    return replace(model, p=p)


def _cut(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    return windows_of(texts, end)[:2]


def refine(docs: DataFrame, model: Attention, batch: int = 512, rows: int = 400) -> Attention:
    """Goes on training in every partition over each window of its encoded texts once, and averages the changes.

    `rows` texts are cut into windows at a time; these are taken in an order drawn at random."""
    dims = model.p["E"].shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["place", "met", *(f"d{i}" for i in range(dims))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        own, met, rng = replace(start, p=dict(start.p)), np.zeros(len(start.p["E"])), np.random.default_rng(1)
        moments, done, steps = own.moments(), 0, 0
        for b in batches:
            for i in range(0, b.num_rows, rows):
                x, y = _cut(_unpacked(b.column(0).slice(i, rows), len(met) - 1), len(met) - 1)
                order = rng.permutation(len(x))
                for at in np.array_split(order, -(-len(order) // batch)):
                    steps += 1
                    own.step(x[at], y[at], moments, steps, 0.003)
                done += len(x)
                met += np.bincount(x[x >= 0], minlength=len(met))
        if not done:
            return
        at = np.flatnonzero(met)
        change = np.concatenate(((own.p["E"] - start.p["E"])[at], _vectors(own) - _vectors(start))).astype(float)
        place = np.concatenate((at, len(met) + np.arange(len(change) - len(at))))
        weight = np.concatenate((met[at], np.full(len(change) - len(at), float(done))))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(weight), *(pa.array(change[:, i] * weight) for i in range(dims))], names=names)

    changes = docs.select("ids").mapInArrow(run, "place long, met double, " + ", ".join(f"{c} double" for c in names[2:]))
    mean = changes.groupBy("place").agg(*((F.sum(c) / F.sum("met")).alias(c) for c in names[2:])).toPandas()  # a row for an id of the vocabulary at most
    ids, rest = model.p["E"].astype(float), _vectors(model).astype(float)
    both = np.concatenate((ids, rest))
    both[mean["place"].to_numpy(np.int64)] += mean[names[2:]].to_numpy(float)
    return _with_vectors(model, both[: len(ids)], both[len(ids) :])


def train(docs: DataFrame, counts: np.ndarray, around: np.ndarray, sample: int) -> Attention:
    """Starts the layer on about `sample` encoded texts drawn by the hash of id and text, and goes on over all of them in every partition."""
    cls, end = classes_of(counts, around), len(counts) - 1
    model = Attention.new(len(counts), cls, within_class(counts, cls))
    draw = F.pmod(F.xxhash64("id", "ids", F.lit(53)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, counts[-1])))
    rows = sorted(bytes(r[0]) for r in docs.where(draw).select("ids").collect())
    if rows:
        model.fit(*_cut(_unpacked(pa.array(rows, pa.binary()), end), end))
    return refine(docs, model)


def score(docs: DataFrame, path: str, pattern: str, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, frequent: int = 200_000) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = ship(docs.sparkSession)
    encoded = _encoded(docs, F.lit(True) if learn_from is None else learn_from, id_col, text_col, path, pattern)
    words = materialize(encoded.where("kind = 0 and n > 0").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = subwords(path, pattern).end + 1
    ids_n, around = np.zeros(size), np.zeros((size, 2 * BUCKETS))
    sums = [F.sum(F.col("around")[i]).alias(f"a{i}") for i in range(2 * BUCKETS)]
    of_ids = encoded.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), *sums).toPandas()  # a row for an id of the vocabulary at most
    ids_n[of_ids["key"]], around[of_ids["key"]] = of_ids["n"], of_ids[[f"a{i}" for i in range(2 * BUCKETS)]]
    end_n = words.where(F.col("key") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # every text has an end, so it is sent whatever its rank
    top = most_frequent(words.where(F.col("key") != END_WORD), "n", frequent).toPandas()
    model = train(encoded.where("kind = 2 and learn").select("id", "ids"), ids_n, around, sample)
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((model, key[order], top["n"].to_numpy(np.int64)[order]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, counts = sent.value
        scorer, row, last = Scorer(model), TaskContext.get().partitionId() << 33, size - 1
        logs = np.append(np.log10(counts + 1.0), 0.0)  # the last stands for words that are not known here
        for b in batches:
            n, part_known, part, tail, scores = [], [], [], [], []
            for hashed, at, cuts in coded_words(b.column(1)):
                place = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
                place = np.where(known[place] == hashed, place, len(known)) if len(known) else np.zeros(len(hashed), np.int64)
                place = place[at]
                hit = place < len(known)
                sums = np.concatenate(([0.0], np.cumsum(logs[place])))
                hits = np.concatenate(([0], np.cumsum(hit)))
                rest = pa.array(hashed[at[~hit]].view(np.int64))
                n.append(np.diff(cuts) + 1)
                part.append(sums[cuts[1:]] - sums[cuts[:-1]] + np.log10(end_n + 1.0))
                part_known.append(hits[cuts[1:]] - hits[cuts[:-1]] + (end_n > 0))
                tail.append(pa.ListArray.from_arrays(pa.array((cuts - hits[cuts]).astype(np.int32)), rest))
            for i in range(0, b.num_rows, 256):
                scores += scorer.score(_unpacked(b.column(2).slice(i, 256), last), last)
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            joined = [pa.array(np.concatenate(x) if x else np.empty(0), t) for x, t in ((n, pa.int64()), (part_known, pa.int64()), (part, pa.float64()))]
            tails = pa.concat_arrays(tail) if tail else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows, *joined, tails, pa.array(scores, pa.float64())], names=[id_col, "row", "n_tokens", "known", "part", "tail", "score"])

    texts = encoded.where("kind = 2").select("id", "text", "ids")
    scored = materialize(texts.mapInArrow(run, f"`{id_col}` {kind}, row long, n_tokens long, known long, part double, tail array<long>, score double"), "lm-scored")
    discard(encoded)
    found = scored.where("size(tail) > 0").select("row", F.explode("tail").alias("key")).join(words, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("rest"))
    per_token = F.log10(F.lit(float(totals["n"] + totals["v"] + 1)))
    both = scored.drop("tail").join(found, "row", "left")
    return both.select(
        id_col,
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(totals["n"])).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", **options) -> DataFrame:
    """As `score`, with held_out; rows held out (crc32 of the id modulo 7 is 2) are never learned from."""
    held_out = F.coalesce(fold(id_col, 7) == 2, F.lit(False))
    return score(docs, path, pattern, ~held_out & F.col(id_col).isNotNull(), id_col, **options).select(id_col, held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
