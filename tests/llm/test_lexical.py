"""Ranked search against brute force, bounds against scores, slices against the whole."""

import math
import random
import re

import numpy as np
import pytest

from unitwise.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k=10):
    vectors = [(i, terms(t)) for i, t in docs]
    vectors = [(i, v) for i, v in vectors if v]
    n_docs, n_terms = len(vectors), sum(len(v) for _, v in vectors)
    out = []
    for item, text in items:
        scored = []
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in v for _, v in vectors) + 1))) for t in set(terms(text))}
        for i, v in vectors:
            m = 100 - 90 + 90 * len(v) * n_docs // n_terms
            score = sum(w * (1_000_000_000 * v.count(t) // (1000 * v.count(t) + 8 * m)) for t, w in weights.items())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def corpus(rng, n):
    words = [f"w{j}" for j in range(60)] + ["The", "the", "é", "Éa", "x9", "_", "a-b", "zz@q"]
    weights = [1 / (j + 1) for j in range(len(words))]
    return [(j, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 4, 30, 90])))) for j in range(n)]


def rows(df):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.mark.parametrize("shard,leaf,slice_terms", [(16384, 32, 10**6), (37, 3, 10**6), (64, 1, 12)])
def test_search_equals_brute_force(spark, monkeypatch, shard, leaf, slice_terms):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical.Tree.__init__, "__defaults__", (leaf,))
    rng = random.Random(3)
    docs = corpus(rng, 300)
    docs += [(1000 - j, docs[5][1]) for j in range(40)] + [(None, docs[7][1]), (None, docs[7][1]), (7, docs[7][1]), (7, None), (2000, "--- !"), (2001, "w59 " * 4000)]
    items = [(1, docs[5][1]), (2, "w59 W58, w57; é"), (3, None), (4, "!!!"), (5, "unseen"), (6, "THE the w0"), (6, "THE the w0"), (None, "zz q 9")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, n int").repartition(4)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(lexical.search(d, b, slice_terms=slice_terms)) == brute(docs, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    terms_of_docs, tf, m = [], [], []
    for _ in range(600):
        t = np.flatnonzero(rng.random(50) < 1 / np.arange(1, 51) ** 0.7)
        terms_of_docs.append(t)
        tf.append(rng.integers(1, 9, len(t)))
        m.append(int(rng.integers(10, 500)))
    tree = lexical.Tree(terms_of_docs, tf, m, list(range(600)), 8)
    weights = (np.arange(50) * 40 + 3).astype(np.int64)
    cuts = np.arange(0, 21, 4)
    search = lexical.Search(rng.permutation(50)[:20].astype(np.int64), cuts, weights, 3)
    every, stack, n_rows = np.arange(5), [tree.root], 0
    while stack:
        node = stack.pop()
        if node.children:
            stack += node.children
            continue
        n_rows += len(node.rows)
        for r in node.rows:
            exact = search._sums(tree.terms[r], lexical.contribution(tree.tf[r], tree.m[r])[None, :], every)[0]
            assert (exact <= search.bound(node, every)).all() and (exact <= search.bound(tree.root, every)).all()
    assert n_rows == len(tree.terms)
    search.add(tree)
    assert 0 < search.visited < n_rows


def test_slices_are_bounded(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}_{j} x,{j}" for j in range(20))) for i in range(30)] + [(99, " ".join(f"u{j}" for j in range(500)))], "item_id long, text string")
    parts = list(lexical.slices(items, "item_id", "text", 100))
    assert sorted(i for p in parts for i in p.ids) == [*range(30), 99]
    assert all(len(p.terms) <= 100 or len(p.ids) == 1 for p in parts)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id string, text string")
    none = lexical.search(docs, items.where("item_id = 'x'"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs.where("doc_id > 5"), items).collect() == []
    assert len(lexical.search(docs, items).collect()) == 1
