"""The text operators against brute force on small tables with nulls, empty texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from unitwise.llm import decontaminate, jaccard_join, language, lm_scoring, near_vectors, pii, secret_scan, toxicity

CLASHING = "doc_id long, text string, n long, e long, sig long, spans string, score string, lang string"


def table(spark, texts, lang=None):
    rows = [(i, t, 1, 2, 3, "x", "y", lang[i] if lang else "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def rng():
    return random.Random(4)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


# ---- Jaccard join


def brute_classes(texts, k, threshold):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= threshold * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(rng):
    texts = [None, "", "  \t", "one two", "ONE two", "one two three four", prose(rng, 40), None]
    for size in (6, 9, 14, 30, 80, 300):
        for _ in range(3):
            base = prose(rng, size, 10_000).split()
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 18))):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
                texts.append(" ".join(copy))
    shared = prose(rng, 60, 10_000)
    return texts + [f"{shared} {prose(rng, 50, 10_000)}" for _ in range(25)] + texts[8:12]


@pytest.mark.parametrize(("k", "threshold"), [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, rng, k, threshold):
    texts = near_copies(rng)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(table(spark, texts), k, threshold).collect()}
    assert got == brute_classes(texts, k, threshold)


@pytest.mark.parametrize(("k", "threshold"), [(4, 85), (5, 80)])
def test_jaccard_join_of_one_word_more_at_every_size(spark, k, threshold):
    texts = []
    for n in range(1, 61):
        base = [f"s{n}w{i}" for i in range(n + k - 1)]
        texts += [" ".join(base), " ".join([*base, "more"])]
        other = [f"t{n}w{i}" for i in range(n + k - 1)]
        texts += [" ".join(other), " ".join(other[1:])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(table(spark, texts), k, threshold).collect()}
    assert got == brute_classes(texts, k, threshold)


def test_linked_sets_share_a_signature(rng):
    part = jaccard_join.Partition(85)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    gen = np.random.default_rng(2)
    for n in [*range(7, 60), 100, 333, 1000]:
        for _ in range(5):
            a = np.unique(gen.integers(0, 2**63, n).astype(np.uint64))
            b = a[gen.random(len(a)) > rng.random() * 0.15]
            b = np.union1d(b, gen.integers(0, 2**63, rng.randint(0, max(1, n // 12))).astype(np.uint64))
            o = len(np.intersect1d(a, b))
            if 100 * o >= 85 * (len(a) + len(b) - o) and len(a) != o:
                heavy = np.sort(gen.choice(part.indexed(a, none), 1))
                for order in (none, (heavy, np.array([9]))):
                    assert len(np.intersect1d(part.indexed(a, order), part.indexed(b, order)))


def test_keep_one_keeps_columns_and_the_least_id(spark, rng):
    base = prose(rng, 60, 10_000)
    docs = table(spark, [base, base, base + " end", "other", None])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert jaccard_join.classes(docs.where(F.lit(False)), 4, 85).count() == 0


# ---- decontamination


def brute_hits(text, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    d, hit, found = w(text), set(), set()
    for item, t in items:
        b = w(t)
        k = min(13, len(b))
        for i in range(len(b) - k + 1 if k else 0):
            for j in range(len(d) - k + 1):
                if d[j : j + k] == b[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(d), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(d)


def test_decontamination_equals_brute_force(spark, rng):
    items = [(1, prose(rng, 30)), (2, "Tiny item"), (10, prose(rng, 13)), (3, None), (4, "!!"), (1, prose(rng, 20)), (7, "é one")]
    texts = [None, "", "...", "a tiny ITEM here", prose(rng, 200)]
    texts += [f"{prose(rng, rng.randint(0, 300))} {' '.join(items[i][1].upper().split()[s:e])}, {prose(rng, 20)}" for i, s, e in [(0, 0, 30), (0, 3, 17), (0, 3, 15), (2, 0, 13), (5, 1, 20), (0, 0, 13)]]
    texts.append("tiny item " * 50)
    texts.append("é one é one")
    docs = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for map_bits in (None, 3):
        got = {r.doc_id: r for r in decontaminate.report(docs, bench, map_bits=map_bits).collect()}
        kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench, map_bits=map_bits).collect()}
        for i, t in enumerate(texts):
            n, hit, found, bad = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), bad)
            assert got[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() == decontaminate.digest_of(found)
            assert (i in kept) == (not bad)
    assert decontaminate.report(docs, bench.where("item_id = 3")).where("n_hit > 0").count() == 0


# ---- personal data and secrets


def brute_pii(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_equals_the_patterns(rng):
    parts = ["a", "b.", "@", ".", "1", "25", "0", "255", "300", "-", " ", "+1", "(", "x@y.z", "4041894974608795", "%", "é", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_pii(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("write jane at mail dot example dot org", "email", "jane at mail dot example dot org"),
        ("call plus one five five five two zero one nine eight seven six ok", "phone", "plus one five five five two zero one nine eight seven six"),
        ("host 10[.]20[.]30[.]40 up", "ip", "10[.]20[.]30[.]40"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("4041​8949​7460​8795", "card", "4041​8949​7460​8795"),
    ],
)
def test_pii_in_disguise(text, kind, found):
    base, every = pii.spans(text)
    assert not base
    assert [(k, text[s:e]) for s, e, k in every] == [(kind, found)]
    assert pii.masked(text) == text.replace(found, f"[{kind.upper()}]")


def test_pii_leaves_plain_text_alone(spark):
    texts = [None, "", "we met at noon. dot com was seen", "a@b.co and 1.2.3.4", "7 " * 30_000]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert [got[i].spans for i in range(4)] == ["", "", "", "email:0:6,ip:11:18"]
    assert got[3].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[0] is None and masked[2] == texts[2] and masked[3] == "[EMAIL] and [IP]"
    assert pii.mask(docs).columns == docs.columns


def brute_secrets(t):
    out = [(*m.span(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return secret_scan.ordered(out + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_base_equals_the_patterns(rng):
    parts = ["Password", "token", "=", " ", ":", '"', "abc123", "AKIA", "XYZ0", "ABCDEFGH", "deadbeef", "0" * 8, "api_key", "apikey", "ſecret", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert secret_scan.base_spans(t) == brute_secrets(t)


def test_secret_network(spark, rng):
    texts = [None, ""] + [f"{prose(rng, 30)} password={rng.randbytes(9).hex()} {prose(rng, 5)}" for _ in range(40)] + [prose(rng, 40) for _ in range(40)]
    docs = table(spark, texts)
    net = secret_scan.train(docs)
    keys, others = secret_scan.recipes(np.random.default_rng(99), 160)
    found = lambda made: sum(len(a) > len(b) for b, a in secret_scan.spans([f"use {s} now" for s in made if len(secret_scan.candidates(s))], net))
    assert found(keys) >= 0.8 * sum(bool(secret_scan.candidates(s)) and not secret_scan.base_spans(s) for s in keys)
    assert found(others) <= 0.1 * len(others)
    rows = {r.doc_id: r for r in secret_scan.find(docs, net).collect()}
    assert rows[0].spans == [] and rows[2].spans[0].kind == "assign"


# ---- learned scores


def test_toxicity(spark, rng):
    bad = ["loser", "moron", "scum", "idiot"]
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(5, 80)).split()
        toxic = i % 3 == 0
        for _ in range(toxic * rng.randint(1, 4)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts[5] = None
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in toxicity.report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(rows) == 600
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2 and i != 5]
    assert all(rows[i].held_out for i in held)
    assert np.mean([rows[i].predicted == labels[i][1] for i in held]) > 0.95
    assert 0 <= rows[5].score <= 1
    kept = toxicity.keep_clean(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert kept.columns == docs.columns and 380 <= kept.count() <= 420
    assert toxicity.report(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 600


def test_isotonic_is_monotone():
    g = np.random.default_rng(0)
    x = g.normal(size=300)
    kx, ky = toxicity.isotonic(x, (g.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(kx) >= 0).all() and (np.diff(ky) >= -1e-12).all()


def test_language(spark, rng):
    syllables = {"aa": "th er on an re".split(), "bb": "sch ein ung lich keit".split(), "cc": "que eau oi ez ais".split()}
    texts, lang = [None, "12 34 !!", ""], ["aa", "bb", None]
    for i in range(450):
        k = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        texts.append(" ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4))) for _ in range(30)))
        lang.append(k)
    texts.append("x" * 5000)
    lang.append(None)
    rows = {r.doc_id: r for r in language.report(table(spark, texts, lang)).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0.0
    held = [i for i in range(3, 453) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([rows[i].lang_pred == lang[i] for i in held]) > 0.97
    assert rows[453].lang_pred in ("aa", "bb", "cc")


def test_recurrent_gradients():
    net = language.BiGru.new(["a", "b"], hidden=3)
    x, y = language.padded([b"abc", b"zz", b"q"]), np.array([0, 1, 1])
    _, g = net.gradient(x, y)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = net.gradient(x, y)[0]
        p[at] = old - 1e-2
        down = net.gradient(x, y)[0]
        p[at] = old
        assert math.isclose((up - down) / 2e-2, g[k][at], rel_tol=0.02, abs_tol=1e-4)


def test_lm_scoring(spark, rng):
    texts = [None, "", "Same text", "same TEXT", prose(rng, 2000)] + [prose(rng, rng.randint(1, 60)) for _ in range(120)]
    rows = {r.doc_id: r for r in lm_scoring.report(table(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, frequent=50).collect()}
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    seen = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    total, kinds = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        w, r = words(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(seen[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((seen[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert rows[2].score == pytest.approx(rows[3].score)


def test_windows_score_each_id_once():
    for n in (1, 5, 13, 14, 15, 200):
        ids = np.arange(100, 100 + n)
        x, y = lm_scoring.windows(ids, 7)
        assert (y[y >= 0] == ids).all()
        for a, b in zip(x, y, strict=True):
            for j, t in enumerate(b):
                if t >= 0:
                    assert a[lm_scoring.OVERLAP + j] == (t - 1 if t > 100 else 7)


# ---- vectors


def test_near_vectors_reach_brute_force(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(60, 16))
    v = [c + g.normal(size=16) * s for c in centres for s in (0.0, 0.02, 0.1, 0.2, 0.25)] + [centres[0]] * 30 + list(g.normal(size=(200, 16)))
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    n = len(rows)
    table = spark.createDataFrame([(None, rows[0][1]), (None, None)] + rows, "vec_id long, embedding array<double>")
    got = near_vectors.classes(table).where("vec_id is null or vec_id = 0").collect()
    assert sorted((r.vec_id is None, r.n_links > 0, r.component_id, r.kept) for r in got if r.n_links) == [(False, True, 0, True), (True, True, 0, False)]
    assert [(r.vec_id, r.component_id, r.kept) for r in got if not r.n_links] == [(None, None, False)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    for options in ({}, {"shard_rows": 60, "block_rows": 50, "region_rows": 150}, {"shard_rows": 60, "block_rows": 50, "overlap": 9}):
        got = {r.vec_id: r for r in near_vectors.classes(table, **options).collect()}
        assert len(got) == n + len(odd)
        assert all((got[n + i].n_links, got[n + i].component_id, got[n + i].kept) == (0, n + i, True) for i in range(len(odd)))
        found = np.array([got[i].n_links for i in range(n)])
        assert (found <= near.sum(1)).all() and found.sum() >= (1 if "overlap" in options else 0.95) * near.sum()  # more shards than allowed: the exact way
        assert all(got[i].component_id == got[0].component_id for i in range(300, 330))
    assert near_vectors.classes(table.where(F.lit(False))).count() == 0


def test_graph_by_insertion_finds_nearest_neighbours():
    g = np.random.default_rng(4)
    x = near_vectors.unit(g.normal(size=(600, 12)))
    lists = near_vectors.graph(x)
    block = near_vectors.Block(x, lists)
    best = [int(np.argsort(-(x @ q))[1]) for q in x]
    assert max(map(len, lists)) < 200
    assert np.mean([b in block.within(q, i, float(x[b] @ q) - 1e-9, 0.3) for i, (q, b) in enumerate(zip(x, best, strict=True))]) > 0.97
