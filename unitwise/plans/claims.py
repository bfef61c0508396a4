"""Checks of published numbers: claims against values in reports kept as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M


def json_path(dotted: str) -> str:
    """a.b.0.c as a path; digits index lists, and names may hold spaces."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' for p in dotted.split("."))


def dig(body: Column, dotted: str, kind: str = "double") -> Column:
    """The value at a dotted path; null where it is missing."""
    return F.try_variant_get(body, json_path(dotted), kind)


def values(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """claims joined with the value at their path, and whether their report exists."""
    joined = claims.join(reports, claims["report"] == reports["name"], "left")
    step = F.concat(F.lit("$"), F.array_join(F.transform(F.split("path", r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit('["'), p, F.lit('"]')))), ""))
    return joined.withColumn("jsonpath", step).withColumn("got", F.expr("try_variant_get(body, jsonpath, 'double')")).withColumn("present", F.col("name").isNotNull()).drop("body", "name", "jsonpath")


def verdict(got: Column, expect: Column, tol: Column, present: Column) -> Column:
    """untested without a report; FAIL for a missing or undefined value or one out of tolerance (+1e-9); else ok."""
    return F.when(~present, "untested").when(got.isNull(), "FAIL: no such value").when(F.isnan(got), "FAIL: not a number").when(F.abs(got - expect) <= tol + F.lit(1e-9), "ok").otherwise("FAIL")


def check(claims: DataFrame, reports: DataFrame) -> DataFrame:
    v = values(claims, reports)
    return v.withColumn("verdict", verdict(F.col("got"), F.col("expect"), F.col("tol"), F.col("present")))


def summary(checked: DataFrame) -> DataFrame:
    """One row: tested, agreed, disagreed, untested, and whether the whole run fails (a disagreement, or nothing tested)."""
    g = checked.agg(F.count_if(F.col("verdict") != "untested").alias("tested"), F.count_if(F.col("verdict") == "ok").alias("agreed"), F.count_if(F.col("verdict").startswith("FAIL")).alias("disagreed"), F.count_if(F.col("verdict") == "untested").alias("untested"))
    return g.withColumn("failed", (F.col("disagreed") > 0) | (F.col("tested") == 0))


def summary_by_scope(checked: DataFrame, scope: str = "scope") -> DataFrame:
    """By scope (null: manuscript): claims, tested, agreed, disagreed, untested."""
    g = checked.groupBy(F.coalesce(F.col(scope), F.lit("manuscript")).alias("scope"))
    return g.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") != "untested").alias("tested"), F.count_if(F.col("verdict") == "ok").alias("agreed"), F.count_if(F.col("verdict").startswith("FAIL")).alias("disagreed"), F.count_if(F.col("verdict") == "untested").alias("untested"))


def summary_by_report(checked: DataFrame) -> DataFrame:
    """By report: whether it was there, and how many claims it covers."""
    return checked.groupBy("report").agg(F.max((F.col("verdict") != "untested").cast("int")).cast("boolean").alias("present"), F.count(F.lit(1)).alias("claims"))


#: Derivations by name: each takes the relation it reads and its arguments, and returns one row with `got`.
DERIVATIONS: dict[str, Callable[..., DataFrame]] = {}


def derivation(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    DERIVATIONS[f.__name__] = f
    return f


def _named(name: str) -> Column:
    """Whether a unit, kept as class/name, has that name."""
    return F.element_at(F.split("unit", "/"), -1) == name


def _but(units: DataFrame, exclude: str | None, cls: str | None = None) -> DataFrame:
    """The units of a class (of all without one), without those of a name."""
    kept = units if cls is None else units.where(F.col("class") == cls)
    return kept if exclude is None else kept.where(~_named(exclude))


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("got"))


@derivation
def session_recall(units: DataFrame, unit: str, cls: str | None = None) -> DataFrame:
    return _one(_but(units, None, cls).where(_named(unit)), F.min("recall"))


@derivation
def min_session_recall(units: DataFrame, cls: str | None = None) -> DataFrame:
    return _one(_but(units, None, cls), F.min("recall"))


@derivation
def session_recall_extreme(units: DataFrame, which: str, exclude: str | None = None, cls: str | None = None) -> DataFrame:
    return _one(_but(units, exclude, cls), F.max("recall") if which == "max" else F.min("recall"))


@derivation
def units_above(units: DataFrame, threshold: float, cls: str | None = None, exclude: str | None = None) -> DataFrame:
    return _one(_but(units, exclude, cls), F.count_if(F.col("recall") > threshold))


@derivation
def recall_sd_excluding(units: DataFrame, exclude: str | None = None, cls: str | None = None) -> DataFrame:
    return _one(_but(units, exclude, cls), M.sd0("recall"))


@derivation
def pearson_excluding(units: DataFrame, other: str = "headroom", exclude: str | None = None, cls: str | None = None) -> DataFrame:
    return _one(_but(units, exclude, cls), M.pearson(F.col("recall"), F.col(other)))


@derivation
def recovery_of(units: DataFrame, unit: str) -> DataFrame:
    return _one(units.where(_named(unit)), F.min("recovery"))


@derivation
def recovery_extreme(units: DataFrame, which: str, exclude: str | None = None) -> DataFrame:
    return _one(_but(units, exclude), F.max("recovery") if which == "max" else F.min("recovery"))


@derivation
def recovery_sd_excluding(units: DataFrame, exclude: str | None = None) -> DataFrame:
    return _one(_but(units, exclude), M.sd0("recovery"))


@derivation
def predicted_fraction(pred: DataFrame, cls: str, unit: str | None = None, condition: str | None = None) -> DataFrame:
    """The share of predictions of a class among one unit's rows under one condition."""
    kept = pred if unit is None else pred.where(_named(unit))
    return _one(kept if condition is None else kept.where(F.col("condition") == condition), F.avg((F.col("y_pred") == cls).cast("double")))


@derivation
def welch_t(runs: DataFrame, first: str, second: str) -> DataFrame:
    return M.welch(runs, "condition", first, second, "value").select(F.col("t").alias("got"))


@derivation
def welch_t_abs(runs: DataFrame, first: str, second: str) -> DataFrame:
    return welch_t(runs, first, second).select(F.abs("got").alias("got"))


@derivation
def augment_value(runs: DataFrame, condition: str) -> DataFrame:
    return _one(runs.where(F.col("condition") == condition), F.avg("value"))


@derivation
def ablate_drop(runs: DataFrame, base: str, condition: str) -> DataFrame:
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("value")))
    return _one(runs, mean(base) - mean(condition))


def _interaction(runs: DataFrame) -> DataFrame:
    return M.interaction(runs, "seed", "condition", ("neither", "input", "weights", "both"), "value")


@derivation
def interaction_contrast(runs: DataFrame) -> DataFrame:
    return _interaction(runs).select(F.col("mean").alias("got"))


@derivation
def interaction_contrast_t(runs: DataFrame) -> DataFrame:
    return _interaction(runs).select(F.col("t").alias("got"))


def _paired(runs: DataFrame, first: str, second: str, column: str) -> DataFrame:
    return M.paired(runs, "seed", "condition", first, second, "value").select(F.col(column).cast("double").alias("got"))


@derivation
def paired_t(runs: DataFrame, first: str, second: str) -> DataFrame:
    return _paired(runs, first, second, "t")


@derivation
def paired_t_abs(runs: DataFrame, first: str, second: str) -> DataFrame:
    return _paired(runs, first, second, "t").select(F.abs("got").alias("got"))


@derivation
def paired_mean_diff(runs: DataFrame, first: str, second: str) -> DataFrame:
    return _paired(runs, first, second, "mean_diff")


@derivation
def paired_n_positive(runs: DataFrame, first: str, second: str) -> DataFrame:
    return _paired(runs, first, second, "n_positive")


@derivation
def separation_gap(runs: DataFrame, first: str, second: str) -> DataFrame:
    return M.separation(runs, "condition", first, second, "value").select(F.col("separation").alias("got"))


@derivation
def sign_test_p(runs: DataFrame, first: str, second: str, sided: str = "upper") -> DataFrame:
    p = M.paired(runs, "seed", "condition", first, second, "value")
    return p.select(M.sign_test(F.col("n"), F.col("n_positive"))[sided].alias("got"))
