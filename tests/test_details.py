"""Critical values, error structure, ranks against others, statistics of cells, tokens and keys, scopes, registries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitwise.functions import arrays as A
from unitwise.functions import names as N
from unitwise.operators import metrics as M
from unitwise.plans import claims as K


def test_critical_values(spark):
    rows = spark.createDataFrame([(5, 2.9), (5, -2.9), (5, 2.7), (2, 13.0), (40, 2.1), (3, None)], "n long, t double")
    assert [r["significant"] for r in M.judged_t(rows).collect()] == [True, True, False, True, True, False]
    assert [r["critical"] for r in M.judged_t(rows).collect()] == [2.78, 2.78, 2.78, 12.71, 2.0, 4.30]


def test_error_structure(spark):
    pred = [("x", "d", "d")] * 8 + [("x", "d", "c")] * 2 + [("x", "c", "d")] * 5 + [("x", "c", "c")] * 5 + [("x", "p", "p")] * 9
    r = M.error_structure(spark.createDataFrame(pred, "g string, y_true string, y_pred string"), ["g"], ["c", "d", "p"], "d", "c").collect()[0]
    assert r["precision"] == pytest.approx(8 / 13) and r["recall"] == 0.8 and r["precision_lower"] and (r["other_as_focus"], r["focus_as_other"], r["other_leaks_more"]) == (5, 2, True)
    assert r["weakest"] == "c" and r["weakest_f1"] == pytest.approx(2 * (5 / 7) * 0.5 / (5 / 7 + 0.5))


def test_against_others(spark):
    rows = [("a", 0.9, 0.1, "k"), ("b", 0.2, 0.5, "k"), ("c", 0.1, 0.6, "k"), ("d", 0.3, 0.2, "k"), ("e", 0.4, 0.4, "m")]
    df = spark.createDataFrame(rows, "u string, r double, b double, c string")
    got = M.against_others(df, F.col("u") == "b", "r", "b", ["c"]).collect()
    assert len(got) == 1 and got[0]["rank"] == 3 and got[0]["n"] == 4
    others = [0.9, 0.1, 0.3]
    assert got[0]["z"] == pytest.approx((0.2 - np.mean(others)) / np.std(others, ddof=1)) and got[0]["others_median"] == 0.3
    assert got[0]["pearson_without"] == pytest.approx(np.corrcoef([0.1, 0.6, 0.2], others)[0, 1])
    assert M.against_others(df, F.col("u") == "a", "r", "b").collect()[0]["rank"] == 1


def test_statistics_over_finite_cells(spark):
    cells = [0.0, -2.0, -5.0, -9.0, -30.0, -31.0, float("nan"), float("-inf")]
    df = spark.createDataFrame([(1, cells), (2, [float("nan")]), (3, []), (4, None)], "i int, x array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", A.sample_stats(F.col("x")).alias("s")).collect()}
    finite = np.array(cells[:6])
    floor = np.percentile(finite, 10)
    assert (got[1]["n"], got[1]["within_3"], got[1]["within_6"], got[1]["within_10"]) == (6, 2, 3, 4)
    assert got[1]["floor"] == pytest.approx(floor) and got[1]["sd"] == pytest.approx(finite.std()) and got[1]["mean"] == pytest.approx(finite.mean())
    assert [got[1][f"above_{k}"] for k in (6, 12, 20)] == [int((finite >= floor + k).sum()) for k in (6, 12, 20)]
    assert got[2] is None and got[3] is None and got[4] is None


def test_tokens_and_keys(spark):
    df = spark.createDataFrame([("run_7_2024-01-05_10-11-12.csv",), ("plain.csv",), ("trialrun3",)], "n string")
    got = df.select("n", *[N.first_token(F.col("n"), k).alias(k) for k in N.TOKEN_PATTERNS]).collect()
    assert tuple(got[0])[1:] == ("7", "2024-01-05", "24-01-05", "run_7") and tuple(got[1])[1:] == (None,) * 4 and got[2]["keyword_run"] is None
    cls, name = N.split_key(F.col("k"))
    keys = df.limit(1).select(N.unit_key(F.lit("car"), F.lit("a/b")).alias("k")).select("k", cls.alias("c"), name.alias("n")).collect()[0]
    assert tuple(keys) == ("car/a/b", "car", "a/b")
    assert tuple(df.limit(1).select(F.lit("x").alias("k")).select(cls.alias("c"), name.alias("n")).collect()[0]) == (None, "x")


def test_scopes_and_reports(spark):
    checked = spark.createDataFrame([("r", "ok", None), ("r", "FAIL", "manuscript"), ("r", "ok", "artefact"), ("s", "untested", "artefact")], "report string, verdict string, scope string")
    got = {r["scope"]: tuple(r)[1:] for r in K.summary_by_scope(checked).collect()}
    assert got == {"manuscript": (2, 2, 1, 1, 0), "artefact": (2, 1, 1, 0, 1)}
    assert {r["report"]: (r["present"], r["claims"]) for r in K.summary_by_report(checked).collect()} == {"r": (True, 3), "s": (False, 1)}


def test_metrics_by_name(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "y_true string, y_pred string")
    one = pred.agg(M.metric("accuracy").alias("x"), M.metric(("a", "recall")).alias("y"), M.metric(("b", "precision")).alias("z")).collect()[0]
    assert tuple(one) == (0.75, 0.5, pytest.approx(2 / 3))
    with pytest.raises(ValueError, match="no such metric"):
        M.metric("f7")


def test_seed_gaps(spark):
    runs = spark.createDataFrame([("a", v) for v in (0.1, 0.15, 0.9)] + [("b", 0.5), ("b", 0.6)], "c string, v double")
    got = {r["c"]: r for r in M.seed_gaps(runs, ["c"], "v").collect()}
    assert got["a"]["split"] and got["a"]["gap"] == pytest.approx(0.75 / 0.8) and got["a"]["values"] == [0.1, 0.15, 0.9] and not got["b"]["split"]
    assert math.isclose(got["b"]["mean"], 0.55)
