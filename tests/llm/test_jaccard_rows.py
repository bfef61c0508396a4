"""Rows without ids, of repeated ids, and equal rows in the Jaccard join."""

import random

import numpy as np
import pyarrow as pa
import pytest

from unitwise.llm import jaccard_join


def words(seed, n=70):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_rows_of_one_id_are_told_apart(spark):
    a, b = words(1), words(2)
    rows = [(1, a), (1, b), (5, a + " more"), (3, b + " tail")]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 67, 1), (1, 67, 1), (3, 68, 1), (5, 68, 1)]


def test_rows_without_an_id_are_documents(spark):
    a, b = words(3), words(4)
    rows = [(None, a), (None, a), (7, a + " x"), (None, b), (None, None), (None, "")]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)) == [(0, 0, 0), (0, 0, 0), (0, 67, 0), (0, 67, 7), (0, 67, 7), (7, 68, 7)]


def test_keep_one_of_equal_rows(spark):
    a, b = words(5), words(6)
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "x"), (1, b, "x"), (None, b + " z", "x"), (9, None, "x"), (9, None, "x")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, th string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept) == sorted([(1, a[:9]), (1, b[:9]), (9, ""), (9, "")])


@pytest.mark.parametrize(("threshold", "n"), [(85, 60), (80, 60), (85, 400), (80, 1500)])
def test_sketches_tell_apart_what_is_near_but_does_not_link(threshold, n):
    part, gen = jaccard_join.Partition(threshold), np.random.default_rng(n)
    s = np.unique(gen.integers(0, 2**63, n).astype(np.uint64))
    (band, allowed), passed = part.places(len(s))[0], 0
    own = part.sketch(s, band)
    for differences in [*range(0, allowed + 1, 2), *[2 * round(0.75 * allowed)] * 40]:
        half = differences // 2
        other = np.union1d(s[half:], gen.integers(0, 2**63, half).astype(np.uint64))
        apart = int(np.bitwise_count((part.sketch(other, band) ^ own).view(np.uint64)).sum())
        assert apart <= differences
        passed += differences > allowed and apart <= allowed
    assert passed <= 4  # nearly all of them with cells for three differences each


def test_near_copies_that_do_not_link_are_seldom_read(spark, monkeypatch):
    rng, base, read = random.Random(8), words(9, 200).split(), []
    texts = [" ".join(f"x{i}y{j}" if j in own else w for j, w in enumerate(base)) for i in range(60) for own in [set(rng.sample(range(200), 3))]]
    links = jaccard_join.Verifier.links
    monkeypatch.setattr(jaccard_join.Verifier, "links", lambda self, pairs: read.append(pairs.count()) or links(self, pairs))
    got = jaccard_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    sets = [set(zip(*(t.split()[i:] for i in range(4)), strict=False)) for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert sum(read) <= 300


def test_sketches_are_dealt_once_for_all_turns(spark):
    sketches = spark.createDataFrame([(i, i, 50, [i]) for i in range(9)], "s long, e long, n long, cells array<long>")
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    v = jaccard_join.Verifier(docs, spark.createDataFrame([(1, 1, 1)], "e long, doc long, th long"), sketches, "doc_id", "text", 4, 85)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(1, 2)], "sa long, sb long")
        met = v.side("a").join(pairs, "sa")
        assert [r.sb for r in met.collect()] == [2]
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        v.sketches.unpersist()
    assert "InMemoryTableScan" in plan
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]  # the sketches stay where they were dealt


def test_sets_and_signatures_of_many_texts_are_made_together(monkeypatch):
    rng, part, calls = random.Random(4), jaccard_join.Partition(85), []
    texts = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 90, 400]))) for _ in range(300)] + [None, " \t", "A\nb  c\x0bd e"]
    hashes, signatures = jaccard_join.shingle_hashes, jaccard_join.Partition.signatures
    monkeypatch.setattr(jaccard_join, "shingle_hashes", lambda *a: calls.append(1) or hashes(*a))
    ((values, cuts),) = jaccard_join.joined_sets(pa.array(texts), 4)
    assert len(calls) == 1
    sizes = [len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}) if (w := (t or "").lower().split()) else 0 for t in texts]
    assert np.diff(cuts).tolist() == sizes

    monkeypatch.setattr(jaccard_join.Partition, "signatures", lambda *a: calls.append(1) or signatures(*a))
    sets, found = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [[] for _ in texts]
    frequent = np.unique(np.concatenate([part.indexed(s, (values[:0], np.empty(0, np.int64))) for s in sets[::3]]))
    heavy, counts = (frequent, np.arange(len(frequent)) % 5 + 1), jaccard_join.Heavy(frequent, np.arange(len(frequent)) % 5 + 1)
    calls.clear()
    for band, which, d, s, owner in part.by_band(values, cuts):
        sigs, size = part.chosen(s, owner, d, band, counts)
        cells = part.sketches(s, owner, len(which), band)
        for i, own, cell in zip(which.tolist(), np.split(sigs, np.cumsum(size)[:-1]), cells, strict=True):
            found[i].append(own)
            assert np.array_equal(cell, part.sketch(sets[i], band))
    assert len(calls) < 30  # not once for each set
    for s, own in zip(sets, found, strict=True):
        assert np.array_equal(np.unique(np.concatenate([s[:0], *own])), part.indexed(s, heavy))
