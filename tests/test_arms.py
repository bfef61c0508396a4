"""Arms by name, their channels and contrasts; masked vectors."""

import math

import pytest
from pyspark.sql import functions as F

from unitwise.functions import arrays as A
from unitwise.operators import arms as R


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(f * 100 + i, f"f{f}", i, "ab"[f % 2], "test" if (f + i) % 3 == 0 else "train", [float(f), float(i)]) for f in range(4) for i in range(3 + 2 * f) if (f, i) != (3, 4)]
    return spark.createDataFrame(rows, "id long, unit string, i long, class string, tag string, x array<double>")


def test_every_arm_has_the_same_centres(spark, tagged):
    made = R.channels(R.members(tagged, ["single", "index", "shuffle", "clean"], "unit", "i", "id", "tag"), tagged, "id", "x").collect()
    centres = {name: sorted(r["centre"] for r in made if r["arm"] == name) for name in ("single", "index", "shuffle", "clean")}
    assert len(set(map(tuple, centres.values()))) == 1 and 304 not in centres["index"] and 303 not in centres["index"]
    for r in made:
        f, i = divmod(r["centre"], 100)
        assert len(r["channels"]) == (1 if r["arm"] == "single" else 3)
        assert r["channels"][len(r["channels"]) // 2] == [f, i] and {c[0] for c in r["channels"]} == {f}
        if r["arm"] == "index":
            assert [c[1] for c in r["channels"]] == [i - 1, i, i + 1]
        if r["arm"] == "clean":
            assert all((f + int(c[1])) % 3 == 0 for c in r["channels"]) == ((f + i) % 3 == 0)


def test_arms_are_found_by_name(spark, tagged):
    with pytest.raises(ValueError, match="no such arm: none"):
        R.members(tagged, ["none"], "unit", "i", "id", "tag")

    @R.arm("twice")
    def twice(frames, trips, folder, index, key, tag, seed):
        return trips.select("centre", F.col("centre").alias("first"), F.col("centre").alias("second"))

    try:
        made = R.channels(R.members(tagged, ["twice"], "unit", "i", "id", "tag"), tagged, "id", "x").collect()
        assert made and all(r["channels"] == [r["channels"][0]] * 3 for r in made)
    finally:
        del R.ARMS["twice"]


def test_contrasts_pair_seeds(spark):
    runs = spark.createDataFrame([("u", a, s, v) for a, vs in (("index", [0.5, 0.7, 0.9]), ("clean", [0.4, 0.4, 0.4]), ("single", [0.5])) for s, v in enumerate(vs)], "setting string, arm string, seed long, value double")
    got = {r["contrast"]: r for r in R.contrasts(runs, [("index", "clean"), ("index", "single"), ("index", "shuffle")]).collect()}
    assert set(got) == {"index-clean", "index-single"}
    assert got["index-clean"]["n"] == 3 and got["index-clean"]["mean"] == pytest.approx(0.3) and got["index-clean"]["t"] == pytest.approx(0.3 / (0.2 / math.sqrt(3)))
    assert got["index-single"]["n"] == 1 and got["index-single"]["sd"] == 0 and got["index-single"]["t"] is None
    assert R.contrasts(runs.where("false"), [("index", "clean")]).collect() == []


def test_validation_rows_are_alike_in_every_arm(spark):
    rows = spark.createDataFrame([(a, s, c, "ab"[c % 2], "t" if c < 4 else "o", [1.0, float(c % 2)]) for a in ("single", "index") for s in (0, 1) for c in range(40)], "arm string, seed long, centre long, class string, unit string, v array<double>")
    got = {(r["arm"], r["seed"]): r["value"] for r in R.unseen_runs(rows, "t").collect()}
    assert got == {(a, s): 1.0 for a in ("single", "index") for s in (0, 1)}


def test_masked_unit_vectors(spark):
    rows = [(1, [0.0, -5.0, -30.0]), (2, [1.0, 1.0, 1.0]), (3, [0.0, -50.0, -60.0]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r["id"]: r for r in df.select("id", A.masked_unit(F.col("x"), 10).alias("m"), A.masked_unit(F.col("x")).alias("p"), A.kept_cells(F.col("x"), 10).alias("k")).collect()}
    half = math.sqrt(0.5)
    assert got[1]["m"] == pytest.approx([half, -half, 0.0]) and got[1]["k"] == 2
    assert got[2]["m"] == [0.0, 0.0, 0.0] and got[3]["m"] == [0.0, 0.0, 0.0] and got[3]["k"] == 1
    assert got[4]["m"] == [] and got[5]["m"] is None
    assert sum(x * x for x in got[3]["p"]) == pytest.approx(1)


def test_a_frame_is_judged_once_for_all_runs(spark):
    frames = [("p", "a", [1.0, 0.0], [0, 1], []), ("p", "b", [0.0, 1.0], [0], [1]), ("p", "b", [1.0, 1.0], [1], []), ("p", "a", [0.9, 0.2], [], [0, 1]), ("q", "a", [0.3, 1.0], [0], [0])]
    rows = spark.createDataFrame(frames, "protocol string, class string, v array<double>, train array<int>, test array<int>")
    got = sorted(map(tuple, R.judged_once(rows, "protocol", 3).collect()))
    flat = spark.createDataFrame([(p, r, c, v, side) for p, c, v, train, test in frames for side, runs in (("train", train), ("test", test)) for r in runs], "protocol string, run long, class string, v array<double>, side string")
    assert got == sorted((r.protocol, r.run, r["class"], r.y_pred) for r in R.judged(flat, ["protocol", "run"]).collect())
    assert len(got) == 4
