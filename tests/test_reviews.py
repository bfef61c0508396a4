"""Merged units, bounded pairs, sides of folds, resumed work, report files, huge numbers, the folder fallback."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitwise.functions import names as N
from unitwise.operators import components as CC
from unitwise.operators import dedup as D
from unitwise.operators import experiments as X
from unitwise.operators import leakage as L
from unitwise.operators import metrics as M
from unitwise.operators import similar as SIM
from unitwise.operators import splits as P
from unitwise.operators.resume import resumed
from unitwise.sources import tree as T


def table(spark, vectors, blocks):
    return spark.createDataFrame([(i, [float(x) for x in v], b) for i, (v, b) in enumerate(zip(vectors, blocks, strict=True))], "id long, v array<double>, c string")


def brute(vectors, blocks, t):
    s = vectors @ vectors.T
    return {(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors)) if blocks[i] == blocks[j] and s[i, j] > t}


@pytest.mark.parametrize("chunk", [7, 2048])
def test_similarity_pairs_are_all_pairs(spark, chunk):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(40, 8)) * 0.15 + c for c in rng.normal(size=(4, 8))] + [np.zeros((2, 8)), rng.normal(size=(1, 8)).repeat(3, 0)])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    blocks = [str(i % 2) for i in range(len(v))]
    df = table(spark, v, blocks).unionByName(spark.createDataFrame([(900, None, "0"), (901, [1.0], "0")], "id long, v array<double>, c string"))
    got = {(r["a"], r["b"]): r["similarity"] for r in SIM.similarity_pairs(df, "id", "v", 0.8, "c", chunk_rows=chunk).collect()}
    assert set(got) == brute(v, blocks, 0.8)
    assert all(s == pytest.approx(float(v[a] @ v[b])) for (a, b), s in got.items())
    assert SIM.similarity_pairs(df.where("id > 5000"), "id", "v", 0.8, "c").collect() == []


def test_bounds_leave_few_full_products(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = table(spark, v, [str(i % 2) for i in range(400)])
    assert SIM.full_products(df, "id", "v", 0.6, "c") < 0.1 * 2 * 200 * 199 / 2
    centres = rng.normal(size=(8, 64))
    tight = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(50, 64)) * 0.01 for c in centres])
    tight /= np.linalg.norm(tight, axis=1, keepdims=True)
    assert SIM.full_products(table(spark, tight, ["x"] * 400), "id", "v", 0.9, "c", chunk_rows=60) < 0.2 * 400 * 399 / 2


def test_merged_units_need_both_signals(spark):
    rows = [("a", [1.0, 0.0], 10.0), ("b", [1.0, 0.05], 10.5), ("c", [1.0, 0.1], 11.9), ("d", [1.0, 0.0], 30.0), ("e", [0.0, 1.0], 10.0), ("f", [0.0, 0.0], 10.0)]
    units = spark.createDataFrame(rows, "unit string, mean array<double>, level double")
    got = {r["unit"]: r["root"] for r in SIM.merged_units(units, "unit", "mean", "level").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}  # c is too far from a, and near b
    assert {(r["a"], r["b"]) for r in SIM.merge_edges(units, "unit", "mean", "level").collect()} == {("a", "b"), ("b", "c")}


def test_no_unit_stands_on_two_sides_of_a_fold(spark):
    rng = random.Random(1)
    rows = [(i, f"c{u % 3}", f"u{u}") for i, u in enumerate(rng.randrange(20) for _ in range(900))]
    frames = spark.createDataFrame(rows, "frame_id long, class string, unit string")
    folds = P.grouped_folds(frames, 4)
    sides = P.fold_sides(folds, [0, 1]).collect()
    seen = {}
    for r in sides:
        assert seen.setdefault((r["fold"], r["seed"], r["class"], r["unit"]), r["side"]) == r["side"]
    assert len(seen) == len(sides) == 4 * 2 * 20
    for fold in range(4):
        for seed in (0, 1):
            for c in ("c0", "c1", "c2"):
                of = [r["side"] for r in sides if (r["fold"], r["seed"], r["class"]) == (fold, seed, c)]
                assert of.count("val") == max(1, round(0.15 * (len(of) - of.count("test"))))
    assert {(r["fold"], r["unit"]) for r in sides if r["side"] == "test"} == {(r["fold"], r["unit"]) for r in folds.collect()}
    mine = P.coverage_sides(frames, "u3", [0, 1]).collect()
    own = sum(u == "u3" for _, _, u in rows)
    for condition, half in (("held_out", "out"), ("half_in", "train")):
        for seed in (0, 1):
            of = [r for r in mine if (r["condition"], r["seed"]) == (condition, seed)]
            assert sum(r["unit"] == "u3" and r["side"] == half for r in of) == own // 2 and sum(r["side"] == "test" for r in of) == own - own // 2
            assert sum(r["side"] == "val" for r in of) == int(0.15 * (900 - own)) and not any(r["unit"] == "u3" and r["side"] == "val" for r in of)


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    units = spark.createDataFrame([(f"u/{i}",) for i in range(7)], "unit string")
    seen, fail_at = [], [2]

    def work(step):
        names = sorted(r["unit"] for r in step.collect())
        if len(seen) == fail_at[0]:
            raise RuntimeError("stopped")
        seen.append(names)
        return step.withColumn("x", F.length("unit")).unionByName(step.withColumn("x", F.lit(-1)))

    path = str(tmp_path / "done")
    with pytest.raises(RuntimeError):
        resumed(units, path, work, at_once=2)
    assert spark.read.parquet(path).select("unit").distinct().count() == 4
    fail_at[0] = -1
    out = resumed(units, path, work, at_once=2)
    assert seen == [["u/0", "u/1"], ["u/2", "u/3"], ["u/4", "u/5"], ["u/6"]]
    whole = resumed(units, str(tmp_path / "whole"), work)
    assert sorted(map(tuple, out.select("unit", "x").collect())) == sorted(map(tuple, whole.select("unit", "x").collect())) and out.count() == 14
    with pytest.raises(ValueError, match="no rows"):
        resumed(units, str(tmp_path / "none"), lambda step: step.where("false").withColumn("x", F.lit(1)))


def test_reports_are_written_whole(spark, tmp_path):
    folder = str(tmp_path)
    one = spark.createDataFrame([(0.25, None)], "score double, gap double").withColumn("drone recall", F.struct(F.lit(0.5).alias("mean")))
    T.write_report(one, folder, "stage")
    assert json.load(open(tmp_path / "stage.json")) == {"score": 0.25, "gap": None, "drone recall": {"mean": 0.5}}
    with pytest.raises(ValueError, match="one row"):
        T.write_report(one.unionByName(one), folder, "stage")
    with pytest.raises(ValueError, match="one row"):
        T.write_report(one.where("false"), folder, "stage")
    assert json.load(open(tmp_path / "stage.json"))["score"] == 0.25
    T.write_report(one.withColumn("score", F.lit(0.75)), folder, "stage")
    T.write_report(one, folder, "stage_old")
    assert [p.name for p in tmp_path.glob("*") if not p.name.endswith(".crc")] in (["stage.json", "stage_old.json"], ["stage_old.json", "stage.json"])
    read = T.read_reports(spark, folder, {"s": ["none.json", "stage.json", "stage_old.json"]}).select("name", F.try_variant_get("body", "$.score", "double").alias("x")).collect()
    assert [(r["name"], r["x"]) for r in read] == [("s", 0.75)]


def test_names_with_huge_numbers(spark):
    huge = "1" * 24
    df = spark.createDataFrame([(f"f{huge}.csv",), ("f12_7.csv",), ("none.csv",), ("f007.csv",), (f"f{huge[:-1]}2.csv",)], "n string")
    got = {r["n"]: (r["all"], r["last"]) for r in df.select("n", N.numbers(F.col("n")).alias("all"), N.last_number(F.col("n")).alias("last")).collect()}
    assert got[f"f{huge}.csv"] == ([None], None) and got["f12_7.csv"] == ([12, 7], 7) and got["none.csv"] == ([], None)
    assert [r["n"] for r in df.orderBy(N.number_order(F.col("n"))).collect()] == ["none.csv", "f007.csv", "f12_7.csv", f"f{huge}.csv", f"f{huge[:-1]}2.csv"]


def test_folder_without_the_setting(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(CC, "_local", {})
    first = CC.shared_folder(spark)
    assert first.startswith("file:///") and CC.shared_folder(spark) == first


def test_similar_pairs_in_buckets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 4]), rng.uniform(-5, 5), rng.choice([0.0, 1.0])) for i in range(120)] + [(500, 3, None, 0.0)]
    df = spark.createDataFrame(rows, "k long, n long, x double, y double")
    got = {(r["a"], r["b"]) for r in D.similar_pairs(df, "k", "n", {"x": 0.3, "y": 0.0}).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 0.3 and a[3] == b[3]}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)]
    got = {r["node"]: r["component"] for r in CC.components(spark.createDataFrame(edges, "a long, b long"), spark.range(500, 502).withColumnRenamed("id", "node")).collect()}
    assert got == {500: 500, 501: 501}
    got = {r["node"]: r["component"] for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}}


def test_shares_above_across_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, vectors = [], []
    for u in range(12):
        centre = rng.normal(size=6)
        for _ in range(15):
            v = centre + rng.normal(size=6) * 0.8
            vectors.append(v / np.linalg.norm(v))
            rows.append((len(rows), "c", f"u{u}", [float(x) for x in vectors[-1]]))
    rows.append((999, "c", "alone", [1.0] + [0.0] * 5))
    rows.append((1000, "d", "only", [1.0] + [0.0] * 5))
    got = L.within_above_across(spark.createDataFrame(rows, "id long, class string, unit string, v array<double>"), "id", "v", per_unit=400).collect()
    assert [r["class"] for r in got] == ["c"]
    s, unit = np.array(vectors) @ np.array(vectors).T, np.arange(180) // 15
    i, j = np.triu_indices(180, 1)
    same = unit[i] == unit[j]
    p95 = np.quantile(s[i, j][~same], 0.95)
    assert got[0]["within"] == pytest.approx(s[i, j][same].mean(), abs=0.02) and got[0]["across"] == pytest.approx(s[i, j][~same].mean(), abs=0.02)
    assert got[0]["share_above"] == pytest.approx((s[i, j][same] > p95).mean(), abs=0.03)


def test_interaction_interval_and_deltas(spark):
    cells = {"n": [0.9, 0.8, 0.85], "i": [0.7, 0.7, 0.6], "w": [0.8, 0.75, 0.8], "b": [0.3, 0.2, 0.35]}
    runs = spark.createDataFrame([(c, s, v) for c, vs in cells.items() for s, v in enumerate(vs)] + [("n", 9, 0.5)], "c string, s long, v double")
    r = M.interaction_interval(runs, "s", "c", ("n", "i", "w", "b"), "v", resamples=4000).collect()[0]
    each = [b - i - w + n for n, i, w, b in zip(*cells.values(), strict=True)]
    assert r["n"] == 3 and r["mean"] == pytest.approx(np.mean(each)) and r["sd"] == pytest.approx(np.std(each, ddof=1))
    assert min(each) - 1e-9 <= r["low"] <= r["mean"] <= r["high"] <= max(each) + 1e-9
    apart = {**cells, "n": [*cells["n"], 0.5]}
    se = math.sqrt(sum(np.var(v, ddof=1) / len(v) for v in apart.values()))
    point = np.mean(apart["b"]) - np.mean(apart["i"]) - np.mean(apart["w"]) + np.mean(apart["n"])
    assert r["unpaired_t"] == pytest.approx(point / se) and r["unpaired_low"] < point < r["unpaired_high"]
    recalls = spark.createDataFrame([("u", "a", f, s, v) for f, vs in (("1", [0.1, 0.2]), ("4", [0.2, 0.1])) for s, v in enumerate(vs)] + [("w", "a", "1", 0, 0.5), ("w", "a", "4", 0, 0.75), ("x", "a", "1", 0, 0.5)], "unit string, class string, factor string, seed long, recall double")
    d = X.deltas(recalls, "factor", "1", "4")
    assert {r["unit"]: r["delta"] for r in d.collect()} == {"u": 0.0, "w": 0.25}
    one = X.delta_summary(d).collect()[0]
    assert (one["n"], one["n_improved"], one["p_one_sided"], one["p_two_sided"]) == (2, 1, 0.75, 1.0)
    assert X.delta_summary(d.where("false")).collect()[0]["n"] == 0


def test_similarity_forest_has_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs, tree = ([tuple(r) for r in f(df, "id", "v", 0.3).collect()] for f in (SIM.similarity_pairs, SIM.similarity_forest))
    assert set(tree) <= set(pairs)
    assert len(tree) < 90 < len(pairs) / 5

    def sizes(edges, threshold):
        root = list(range(90))
        for a, b, s in edges:
            if s > threshold and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
        return sorted(np.unique(root, return_counts=True)[1].tolist())

    for threshold in (0.3, 0.9, 0.95, 0.97, 0.99):
        assert sizes(tree, threshold) == sizes(pairs, threshold)
    got = CC.sweep(spark.createDataFrame(tree, "a long, b long, similarity double"), df.select(F.col("id").alias("node")), [0.95, 0.99]).collect()
    for r in got:
        n = sizes(pairs, r["threshold"])
        assert (r["n"], r["n_components"], r["largest"], r["singletons"]) == (90, len(n), max(n), n.count(1))
    assert [r["threshold"] for r in got] == [0.95, 0.99]
