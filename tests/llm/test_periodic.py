"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitwise.llm import periodic


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), s, length, q, 1000 * length // q if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def words_like(rng, n, letters):
    out = []
    while len(out) < n:
        if rng.random() < 0.4:
            unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 31]))]
            out += (unit * 20)[: rng.randrange(1, 9 * len(unit))]
        else:
            out += [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
    return out[:n]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("tile,group", [(256, 1 << 20), (8, 100)])
def test_tiles_and_stitching_find_what_brute_force_finds(tile, group, monkeypatch):
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "GROUP_WORDS", group)
    rng = random.Random(5)
    for letters in ("ab", "abc", "abcdefghij"):
        docs = [words_like(rng, rng.choice([0, 1, 5, 6, 7, 30, 100, 400]), letters) for _ in range(120)]
        docs += [["a"] * 50, ["a", "b"] * 40, list("abcabcabcabc"), ["x"] * 5, ["x"] * 6]
        codes, cuts, numbers = [], [0], periodic.Codes()
        for d, words in enumerate(docs):
            codes += [numbers[w] for w in words] + [-1 - d]
            cuts.append(len(codes))
        pieces = {}
        for d, octave, at, marks, part in periodic.tiles(np.array(codes, np.int32), np.array(cuts)):
            for q, s, e in periodic.solve(octave, marks.tolist(), part.tolist()):
                pieces.setdefault((d, q), []).append((at + s, at + e))
        got = {d: {} for d in range(len(docs))}
        for (d, q), parts in sorted(pieces.items(), key=lambda p: p[0][1]):
            merged = []
            for s, e in sorted(parts):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            for s, e in merged:
                if e - s + q >= max(6, 4 * q):
                    got[d].setdefault((s, e - s + q), q)
        for d, words in enumerate(docs):
            assert sorted((s, n, q) for (s, n), q in got[d].items()) == brute(words), words


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(12))]
        assert periodic.z_function(x) == [next((j for j in range(len(x) - i) if x[j] != x[i + j]), len(x) - i) for i in range(len(x))]


def test_query_columns_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words_like(rng, rng.choice([3, 40, 300]), "abcd"))) for i in range(150)]
    rows += [(None, "a a a a a a a"), (7, None), (8, ""), (9, " \t\n "), (7, None), (10, "é é " * 9), (11, "x y\x0bz\x0c" * 8), (12, " ".join(f"w{i % 997}" for i in range(9000)))]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, words string, row_key int").repartition(3)
    edited = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.report(edited).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(i, t)) for i, t in rows)
    listed = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic.runs(docs).collect()}
    assert listed == {(i, *r) for i, t in rows for r in brute((t or "").encode().split())}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.report(docs).collect() == [] and periodic.runs(docs).collect() == []
