"""Learned models against plain loops: trees, isotonic fit, pooled labels, gradients, forward passes."""

import math

import numpy as np
import pytest

from unitwise.llm import language, lm_scoring, secret_scan, toxicity


def test_trees_equal_a_plain_walk():
    g = np.random.default_rng(3)
    x = np.where(g.random((400, 5)) < 0.3, 0.0, g.random((400, 5)))
    y = (x[:, 0] + 0.3 * g.random(400) > 0.6).astype(float)
    model = toxicity.Trees(rounds=12).fit(x, y)

    def plain(row):
        f = model.base
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row, strict=True)]
        for feature, cut, value in model.trees:
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (1 if bins[feature[node]] <= cut[node] else 2)
            f += value[node]
        return f

    raw = model.raw(x)
    assert np.allclose(raw, [plain(r) for r in x])
    assert ((raw > 0) == (y > 0)).mean() > 0.95


def test_isotonic_equals_the_least_squares_step_fit():
    g = np.random.default_rng(5)
    for _ in range(20):
        x, y = np.sort(g.integers(0, 7, 12)).astype(float), (g.random(12) < 0.5).astype(float)
        kx, ky = toxicity.isotonic(x, y)
        xs = np.unique(x)
        cases = [[(v, 1.0) for u, v in zip(x, y, strict=True) if u == w] for w in xs]
        cases[0].append((0.0, 0.5))
        cases[-1].append((1.0, 0.5))

        def mean(a, b, cases=cases):
            return sum(v * w for c in cases[a : b + 1] for v, w in c) / sum(w for c in cases[a : b + 1] for _, w in c)

        n = len(xs)
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # the step fit by its formula
        assert np.allclose(np.interp(xs, kx, ky), want)


def test_isotonic_pools_equal_scores():
    kx, ky = toxicity.isotonic(np.array([-5.0] * 40 + [6.0] * 20), np.array([0.0] * 36 + [1.0] * 4 + [1.0] * 20))
    assert np.interp(-5.0, kx, ky) < 0.15 and np.interp(6.0, kx, ky) > 0.95


def test_language_labels_each_position_once_in_its_context():
    net = language.BiGru.new(["a", "b", "c"], hidden=5, seed=2)
    text = language.read_as("Ein Wort, zwei \u00e4\u00f6\u00fc\u4e2d\u6587 " * 40 + "\n end")
    raw = np.frombuffer(text, np.uint8)
    x, owner, first, last = language.windows([b"short", text, b""])
    assert [(owner == i).sum() for i in range(3)] == [1, len(language.cuts(raw)) - 1, 0]
    cuts = language.cuts(raw)
    assert all(raw[c] & 0xC0 != 0x80 for c in cuts[:-1])

    def plain(window):
        """Positions' probabilities by the network's own formula, one byte after the other."""
        p, k = {n: a.astype(float) for n, a in net.p.items()}, 5
        out = {}
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = np.zeros(k)
            for t in order:
                a, r = p[f"E{d}"][window[t]], h @ p[f"U{d}"]
                z, q = 1 / (1 + np.exp(-(a[:k] + r[:k]))), 1 / (1 + np.exp(-(a[k : 2 * k] + r[k : 2 * k])))
                new = np.tanh(a[2 * k :] + q * (r[2 * k :] + p[f"b{d}"]))
                h = new + z * (h - new)
                out[d, t] = h
        rows = [np.concatenate((out["f", t], out["b", t])) @ p["V"] + p["c"] for t in range(len(window))]
        return [np.exp(r - r.max()) / np.exp(r - r.max()).sum() for r in rows]

    total, places = np.zeros(3), 0
    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
        low = c - language.CONTEXT
        while low > 0 and raw[low] & 0xC0 == 0x80:
            low += 1
        low, high = max(0, low), min(len(raw), d + language.CONTEXT)
        q = plain(raw[low:high])
        total += np.sum(q[c - low : d - low], axis=0)
        places += d - c
    assert places == len(raw)
    assert np.allclose(net.pooled([b"short", text, b""])[1], total, rtol=1e-3)
    assert math.isclose(net.pooled([text]).sum(), len(raw), rel_tol=1e-4)


def checked(p, gradient, rel=0.03, step=1e-2):
    """Compares the steepest entry of each parameter's gradient with a difference of losses."""
    g = gradient()[1]
    for k, a in p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old = a[at]
        a[at] = old + step
        up = gradient()[0]
        a[at] = old - step
        down = gradient()[0]
        a[at] = old
        assert math.isclose((up - down) / (2 * step), g[k][at], rel_tol=rel, abs_tol=1e-4), k


def test_attention_gradients_and_scores():
    cls = np.arange(40) % 6
    model = lm_scoring.Attention.new(40, cls, lm_scoring.within_class(np.arange(40.0), cls), dims=4, seed=1)
    g = np.random.default_rng(0)
    texts = [g.integers(0, 39, n) for n in (3, 14, 40)]
    x, y = lm_scoring._cut([np.append(t, 39) for t in texts], 39)
    checked(model.p, lambda: model.gradient(x, y))
    own = lm_scoring.Scorer(model).logs(x, y)
    for i in range(len(x)):
        for j in range(lm_scoring.STRIDE):
            if y[i, j] < 0:
                assert own[i, j] == 0
                continue
            line = [(t, x[i, t]) for t in range(lm_scoring.OVERLAP + j + 1) if x[i, t] >= 0]
            e = {t: model.p["E"][v].astype(float) for t, v in line}
            at = lm_scoring.OVERLAP + j
            a = np.array([e[at] @ model.p["q"] @ (e[t] @ model.p["k"]) + model.p["r"][at - t] for t, _ in line])
            a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
            logits = sum(w * (e[t] @ model.p["v"]) for w, (t, _) in zip(a, line, strict=True)) @ model.p["o"] + e[at] @ model.p["u"] + model.p["b"]
            prob = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            assert own[i, j] == pytest.approx(np.log(prob[cls[y[i, j]]]) + model.within[y[i, j]], rel=1e-3)


@pytest.mark.parametrize("size", [1, 30])  # with 30, exponents pass what needs no shift
def test_attention_gradients_a_few_windows_at_a_time(size):
    cls = np.arange(40) % 6
    model = lm_scoring.Attention.new(40, cls, lm_scoring.within_class(np.arange(40.0), cls), dims=4, seed=1)
    for k in "Eou":
        model.p[k] *= size
    g = np.random.default_rng(0)
    texts = [np.append(g.integers(0, 39, n), 39) for n in (0, 3, 13, 14, 15, 40, 100)]
    x, y, n = lm_scoring.windows_of(texts, 39)
    alone = [lm_scoring.windows(t, 39) for t in texts]
    assert n.tolist() == [len(a) for a, _ in alone] and np.array_equal(x, np.concatenate([a for a, _ in alone])) and np.array_equal(y, np.concatenate([b for _, b in alone]))
    loss, whole = model.gradient(x, y, len(x))
    few_loss, few = model.gradient(x, y, 2)
    assert few_loss == pytest.approx(loss, rel=1e-5)
    for k in whole:
        assert np.isfinite(few[k]).all() and np.allclose(few[k], whole[k], rtol=1e-3, atol=1e-4 * np.abs(whole[k]).max()), k
    logs = lm_scoring.Scorer(model).logs(x, y)[y >= 0] - model.within[y[y >= 0]]
    assert loss == pytest.approx(np.minimum(-logs, 30 * math.log(10)).mean(), rel=1e-3)  # the loss adds 1e-30 to a probability


def test_convolution_gradients():
    net = secret_scan.Cnn.new(dims=3, filters=4, seed=2)
    x = secret_scan.coded([secret_scan.view("key = abc123XYZ9 end", 6, 16), secret_scan.view("no", 0, 2)])
    y = np.array([1.0, 0.0])

    def gradient():
        z = net._forward(x)[0].astype(float)
        return float((np.log1p(np.exp(z)) - y * z).mean()), net.gradient(x, y)

    checked(net.p, gradient, step=1e-3)
