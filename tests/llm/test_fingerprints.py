"""Closed syncmers, likeness and the order of documents against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitwise.llm import fingerprints as fp
from unitwise.llm.common import mix64


def plain_anchors(text, k, s):
    """Places of k-mers whose least s-mer hash stands at an edge."""
    out = []
    for i in range(len(text) - k + 1):
        hashes = []
        for j in range(i, i + k - s + 1):
            h = 0
            for c in text[j : j + s]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
            hashes.append(int(mix64(np.array([h], np.uint64))[0]))
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("k,s", [(12, 6), (7, 3), (9, 4), (5, 5)])
def test_anchors_are_closed_syncmers(k, s):
    rng = random.Random(k)
    for letters in ("ab", "abcdefgh é\U0001f600"):
        for n in (0, 3, k - 1, k, 60):
            text = "".join(rng.choice(letters) for _ in range(n))
            at, hashes = fp.anchors(np.array([ord(c) for c in text], np.uint64), k, s)
            assert at.tolist() == plain_anchors(text, k, s)
            of = {}
            for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
                assert of.setdefault(text[i : i + k], h) == h
            assert len(set(of.values())) == len(of)


def test_no_window_without_an_anchor():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    at, _ = fp.anchors(np.array([ord(c) for c in text], np.uint64))
    assert np.diff(at).max() <= fp.K - fp.S + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\U0001f600", max_size=60), max_size=6), st.integers(1, 40))
def test_fingerprints_do_not_depend_on_their_neighbours(texts, most):
    together = fp.fingerprints(texts, most=most)
    assert together == [fp.fingerprints([t], most=most)[0] for t in texts]
    for t, f in zip(texts, together, strict=True):
        level, hashes, places = fp.parsed(f)
        assert len(hashes) <= most or not any(h % (2 << level) == 0 for h in hashes.tolist())
        assert len(set(hashes.tolist())) == len(hashes) and (np.diff(places.astype(np.int64)) > 0).all()
        assert all(h % (1 << level) == 0 for h in hashes.tolist()) and fp.likeness(f, f) == 1
        assert (len(hashes) == 0) == (t == "")


def longest_chain(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_likeness_is_the_longest_common_order():
    rng = random.Random(11)
    for _ in range(80):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(20, 200)))
        cut, size = rng.randrange(len(a)), rng.randrange(40)
        b = a[cut:] + a[: cut // 2] + "".join(rng.choice("abc ") for _ in range(size))
        fa, fb = fp.fingerprints([a, b], most=None)
        ha, hb = fp.parsed(fa)[1].tolist(), fp.parsed(fb)[1].tolist()
        assert fp.likeness(fa, fb) == pytest.approx(2 * longest_chain(ha, hb) / (len(ha) + len(hb)) if fa != fb else 1)
        assert fp.likeness(fa, fb) == fp.likeness(fb, fa)


def test_selected_anchors_estimate_the_whole():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    a = " ".join(rng.choice(words) for _ in range(9000))
    b = a[: len(a) // 2] + " ".join(rng.choice(words) for _ in range(4500))
    whole = fp.likeness(*fp.fingerprints([a, b], most=None))
    few = fp.fingerprints([a, b])
    assert fp.parsed(few[0])[0] > 0 and abs(fp.likeness(*few) - whole) < 0.12


def test_query_against_plain_order(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefg hé\U0001f600") for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in rng.sample(range(-500, 10**15), 90)]
    rows += [(None, text(70)), (None, "null"), (5, None), (6, "same"), (6, "same"), (6, "other"), (2**53 + 1, text(50)), (2**53 + 2, text(50)), (8, "long " * 60000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, o string").repartition(5)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r)) for r in fp.report(docs).collect())
    hashes = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = fp.fingerprints([t, new, after])
        want.append((i is not None, i or 0, (i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c))))
    assert got == sorted(want)
    assert fp.report(docs).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a passage that is long enough"), (2, None)], "doc_id long, text string")
    row = docs.withColumn("f", fp.fingerprint(F.col("text"))).withColumn("l", fp.alike(F.col("f"), F.col("f"))).orderBy("doc_id").collect()
    assert [r["l"] for r in row] == [1, 1] and row[0]["f"] == fp.fingerprints(["a passage that is long enough"])[0]
    assert fp.report(docs.where("doc_id > 5")).collect() == []
    only = fp.report(docs.where("doc_id = 1")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1


def test_no_anchor_of_a_long_text_is_left_out(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklm ") for _ in range(n)) for n in (4000, 30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fp.report(docs).orderBy("doc_id").collect()
    column = docs.orderBy("doc_id").select(fp.fingerprint(F.col("text"))).collect()
    for t, r, c in zip(texts, rows, column, strict=True):
        level, _, places = fp.parsed(r["fingerprint"])
        first = {t[i : i + fp.K]: i for i in reversed(plain_anchors(t, fp.K, fp.S))} if len(t) < 5000 else None
        assert level == 0 and len(places) > 900 and c[0] == r["fingerprint"]
        assert first is None or places.tolist() == sorted(first.values())
        assert fp.parsed(r["edited_fingerprint"])[0] == 0


def test_anchors_are_written_in_few_characters(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijk é") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 60, 3000, 9000)]
    texts.append(texts[2] * 3 + texts[3] + "x" * 100_000 + texts[1][::-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t, r in zip(texts, fp.report(docs).orderBy("doc_id").collect(), strict=True):
        at, hashes = fp.anchors(np.array([ord(c) for c in t], np.uint64))
        _, first = np.unique(hashes, return_index=True)
        level, kept, places = fp.parsed(r["fingerprint"])
        assert level == 0 and places.tolist() == at[np.sort(first)].tolist()
        assert len(np.unique(kept)) == len(np.unique(hashes)) and ((hashes[np.sort(first)] ^ kept) % (1 << 40) == 0).all()
        for f in (r["fingerprint"], r["edited_fingerprint"]):
            assert len(f) < 8 * len(fp.parsed(f)[1]) + 16  # as Parquet: the row's size, since hashes do not compress


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.one_of(st.integers(0, 40), st.integers(0, (1 << 32) - 2)), st.integers(0, (1 << 42) - 1), max_size=8), max_size=5))
def test_what_is_written_is_read_again(all_marks):
    marks = [(i, np.array([m[p] for p in sorted(m)], np.uint64), np.array(sorted(m), np.int64)) for i, m in enumerate(all_marks)]
    for (level, hashes, places), f in zip(marks, fp.written(marks), strict=True):
        got = fp.parsed(f)
        assert got[0] == level and got[1].tolist() == hashes.tolist() and got[2].tolist() == places.tolist()


def test_first_of_its_kind_in_long_and_short_lists():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500, (1 << 22) + 5):
        hashes = rng.integers(0, max(1, n // 3), n, np.uint64) << np.uint64(20)
        want = np.zeros(n, bool)
        want[np.unique(hashes, return_index=True)[1]] = True
        assert (fp._firsts(hashes) == want).all()
    assert fp._firsts(np.array([0, (1 << 42) - 1, 0, (1 << 42) - 1], np.uint64)).tolist() == [True, True, False, False]
