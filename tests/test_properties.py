"""Invariants of the frame, split, sequence and statistics operators on small literal inputs."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from unitwise.functions import arrays as A
from unitwise.functions import names as N
from unitwise.operators import components as C
from unitwise.operators import dedup as D
from unitwise.operators import metrics as M
from unitwise.operators import sequences as S
from unitwise.operators import splits as P
from unitwise.plans import claims as K
from unitwise.streaming import triplets as ST


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, [rng.uniform(-110, -40) for _ in range(11 * 61)]) for i in range(6)], "frame_id long, cells array<double>")


def test_reduction_conserves_power(frames):
    power = lambda c: A.total(F.transform(c, lambda x: F.pow(F.lit(10.0), x / 10)))
    first60 = A.total(F.transform(F.filter(F.transform(F.col("cells"), lambda x, i: F.struct(x.alias("x"), (i % 61).alias("c"))), lambda s: s["c"] < 60), lambda s: F.pow(F.lit(10.0), s["x"] / 10)))
    for r in frames.select(power(A.reduce_columns(F.col("cells"), 11, 61, 2)).alias("a"), first60.alias("b"), *[F.size(A.reduce_columns(F.col("cells"), 11, 61, f)).alias(f"n{f}") for f in (1, 2, 4, 8)]).collect():
        assert math.isclose(r.a, r.b, rel_tol=1e-9)
        assert (r.n1, r.n2, r.n4, r.n8) == (671, 330, 165, 77)


def test_quantiser(frames):
    q = A.quantise(F.col("cells"), 8, F.lit(-110.0), F.lit(-40.0))
    worst = F.array_max(F.zip_with(q, "cells", lambda a, b: F.abs(a - b)))
    assert frames.select(F.max(worst)).first()[0] <= 70 / 255 / 2 + 1e-9
    same = A.quantise(F.col("cells"), 32, F.lit(-110.0), F.lit(-40.0))
    assert frames.where(same != F.col("cells")).count() == 0
    flat = A.quantise(F.col("cells"), 4, F.lit(-50.0), F.lit(-50.0))
    assert frames.where(flat != F.col("cells")).count() == 0


def test_offset_on_fixed_cells(spark):
    one = spark.createDataFrame([([-60.0, 0.0, -120.0],)], "cells array<double>")
    assert one.select(A.normalise(F.col("cells"), "offset")).first()[0] == [0.0, 1.0, -1.0]
    with pytest.raises(ValueError):
        A.normalise(F.col("cells"), "other")


def test_flat_frame_has_no_excess(spark):
    one = spark.createDataFrame([([-60.0] * 24,)], "cells array<double>")
    assert one.select(A.concentration(F.col("cells"))).first()[0] is None
    assert one.select(A.features(F.col("cells"), 6)["row_centroid"]).first()[0] == 0.0


def test_shift_keeps_values_and_fills_with_the_median(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "cells array<double>")
    assert one.select(A.shift_columns(F.col("cells"), 2, 3, F.lit(1))).first()[0] == [3.5, 1.0, 2.0, 3.5, 4.0, 5.0]


def test_names(spark):
    rows = spark.createDataFrame([("/data/Drones/15-55a",), ("/data/Vehicles/15-56",), ("/x/People/other",), ("/x/none",)], "p string")
    got = [tuple(r) for r in rows.select(N.class_of(F.col("p")), N.unit_of(F.col("p"))).collect()]
    assert got == [("drone", "15-55"), ("car", "15-56"), ("person", "other"), (None, "none")]


def test_folders_drop_twins_and_partials(spark):
    rows = [("d", "a/12-41", "12-41", 20, "x"), ("d", "a/b/12-41", "12-41", 20, "x"), ("d", "c/12-41", "12-41", 12, "y"), ("e", "q/12-41", "12-41", 5, "z")]
    got = {r.folder: (r.kept, r.reason) for r in D.dedupe_folders(spark.createDataFrame(rows, "class string, folder string, name string, n long, digest string")).collect()}
    assert got["a/12-41"] == (True, None)
    assert got["a/b/12-41"] == (False, "identical")
    assert got["c/12-41"] == (False, "partial (12 of 20 files)")
    assert got["q/12-41"][0]


def plan(spark, classes=3, units=6, files=12):
    return spark.createDataFrame([(f"c{c}", f"c{c}/u{u}", c * 1000 + u * 100 + f) for c in range(classes) for u in range(units) for f in range(files)], "class string, unit string, frame_id long")


def test_splits_cover_each_row_once(spark):
    f = plan(spark)
    g = P.grouped_split(f, 0.3)
    assert g.count() == f.count() and P.straddling(g).count() == 0
    r = P.random_split(f, 0.3)
    assert r.count() == f.count() and r.where("side = 'test'").count() == round(0.3 * f.count())
    assert P.straddling(r).count() > 0


def test_folds_balance(spark):
    f = plan(spark)
    folds = P.grouped_folds(f, 3)
    assert folds.count() == 18
    assert {r.s for r in folds.groupBy("class", "fold").agg(F.sum("n").alias("s")).collect()} == {24}
    r = P.random_folds(f, folds)
    assert r.count() == f.count()
    assert {x.c for x in r.groupBy("class", "fold").agg(F.count("*").alias("c")).collect()} == {24}


def test_sequences(spark):
    rows = [("13-48", i, i) for i in (1, 2, 3, 9, 10, 11)] + [("13-49", 4, 100), ("13-49", 5, 101)]
    f = spark.createDataFrame(rows, "folder string, idx long, id long")
    assert sorted(r.centre for r in S.triplets(f, "folder", "idx", "id").collect()) == [2, 10]
    ten = spark.createDataFrame([("a", i, i) for i in range(10)], "folder string, idx long, id long")
    for r in S.random_companions(ten, "folder", "idx", "id").collect():
        assert not r.fallback and r.first != r.second
        assert not {r.first, r.second} & {r.centre - 1, r.centre, r.centre + 1}
    three = spark.createDataFrame([("a", i, i) for i in range(3)], "folder string, idx long, id long")
    assert [({r.first, r.second}, r.fallback) for r in S.random_companions(three, "folder", "idx", "id").collect()] == [({0, 2}, True)]


def test_clean_companions_never_cross(spark):
    f = spark.createDataFrame([("a", i, i, "test" if i % 3 == 0 else "train") for i in range(40)], "folder string, idx long, id long, side string")
    side = {r.id: r.side for r in f.collect()}
    for r in S.clean_companions(f, "folder", "idx", "id", "side").collect():
        assert side[r.first] == side[r.second] == r.side


def test_statistics(spark):
    s = spark.createDataFrame([(5, 3), (5, 5), (5, 0)], "n long, k long").select(M.sign_test(F.col("n"), F.col("k")).alias("s")).collect()
    assert (s[0].s.upper, s[0].s.two_sided) == (0.5, 1.0)
    assert math.isclose(s[1].s.upper, 1 / 32) and math.isclose(s[2].s.lower, 1 / 32)
    runs = spark.createDataFrame([(i, c, 1.0) for i in range(4) for c in "ab"], "seed long, condition string, value double")
    assert M.paired(runs, "seed", "condition", "a", "b", "value").first().t is None
    assert M.welch(runs, "condition", "a", "b", "value").first().t is None
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert two.agg(M.pearson(F.col("x"), F.col("y"))).first()[0] is None
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert M.mann_whitney(tied, "g", "a", "v").first().u == 0.5


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 10, 11, 20)], "node long")
    assert {r.node: r.component for r in C.components(e, nodes).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 10: 10, 11: 10, 20: 20}


def test_claims(spark):
    reports = spark.createDataFrame([("r", '{"drone recall": {"grouped": {"mean": 0.84, "runs": [1.5, 2.5]}}}')], "name string, j string").select("name", F.parse_json("j").alias("body"))
    claims = spark.createDataFrame([("a", "r", "drone recall.grouped.mean", 0.84, 0.0), ("b", "r", "drone recall.grouped.runs.1", 2.5, 0.0), ("c", "r", "nothing.here", 1.0, 1.0), ("d", "s", "x", 1.0, 1.0), ("e", "r", "drone recall.grouped.mean", 0.9, 0.01)], "id string, report string, path string, expect double, tol double")
    checked = K.check(claims, reports)
    assert {r.id: r.verdict for r in checked.collect()} == {"a": "ok", "b": "ok", "c": "FAIL: no such value", "d": "untested", "e": "FAIL"}
    assert tuple(K.summary(checked).first()) == (4, 2, 2, 1, True)


def test_derivations(spark):
    assert len(K.DERIVATIONS) == 22
    units = spark.createDataFrame([("car/15-37", "car", 0.8, 1.0, 0.1), ("drone/13-48", "drone", 0.25, 2.0, 0.7), ("drone/14-00", "drone", 0.9, 3.0, 0.0)], "unit string, class string, recall double, headroom double, recovery double")
    runs = spark.createDataFrame([(s, c, v + s * w) for s in range(4) for c, v, w in (("neither", 0.9, 0.01), ("input", 0.8, 0.02), ("weights", 0.7, 0.0), ("both", 0.5, 0.03))], "seed long, condition string, value double")
    got = lambda name, *a: K.DERIVATIONS[name](*a).first().got
    assert got("session_recall", units, "13-48") == 0.25
    assert got("units_above", units, 0.5, None, "14-00") == 1
    assert got("recovery_extreme", units, "max", "13-48") == 0.1
    assert got("paired_n_positive", runs, "neither", "both") == 4
    assert math.isclose(got("interaction_contrast", runs), -0.1 + 1.5 * 0.02, abs_tol=1e-9)
    assert got("sign_test_p", runs, "neither", "both") == 1 / 16


def test_streaming_triplets(spark, tmp_path):
    schema = "folder string, idx long, id long"
    for n, rows in enumerate(([("a", 1, 1), ("a", 2, 2), ("b", 7, 70)], [("a", 3, 3), ("a", 5, 5), ("b", 8, 80)], [("b", 9, 90)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = ST.triplets(source).writeStream.format("memory").queryName("t").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.folder, r.before, r.centre, r.after) for r in spark.table("t").collect()) == [("a", 1, 2, 3), ("b", 70, 80, 90)]


def test_derivations_of_one_class_and_unit(spark):
    from unitwise.plans.claims import DERIVATIONS

    rows = [("car/12-41", "car", 0.9, 1.0), ("drone/12-41", "drone", 0.2, 2.0), ("drone/112-41", "drone", 0.6, 5.0), ("drone/13-00", "drone", 0.8, 3.0), ("drone/14-00", "drone", 0.5, 4.0)]
    units = spark.createDataFrame(rows, "unit string, class string, recall double, headroom double")
    got = lambda name, *a, **k: DERIVATIONS[name](*a, **k).first().got
    assert got("session_recall", units, "12-41", cls="car") == 0.9
    assert got("session_recall", units, "12-41", cls="drone") == 0.2
    assert got("min_session_recall", units, "car") == 0.9
    assert got("session_recall_extreme", units, "min", "12-41", "drone") == 0.5
    assert got("units_above", units, 0.55, "drone", "13-00") == 1
    assert abs(got("recall_sd_excluding", units, "12-41", "drone") - statistics.stdev([0.6, 0.8, 0.5])) < 1e-9
    assert abs(got("pearson_excluding", units, "headroom", "112-41", "drone") - statistics.correlation([0.2, 0.8, 0.5], [2.0, 3.0, 4.0])) < 1e-9
    pred = spark.createDataFrame([("drone/12-41", "held", "car"), ("drone/12-41", "held", "drone"), ("drone/12-41", "half", "drone"), ("drone/112-41", "held", "drone")], "unit string, condition string, y_pred string")
    assert got("predicted_fraction", pred, "drone", "12-41", "held") == 0.5
