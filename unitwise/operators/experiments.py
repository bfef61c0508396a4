"""Protocol and condition experiments with nearest centroids, as plans over all folds and conditions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, unit
from .metrics import sd0, sign_test


def fold_centroids(rows: DataFrame, run: list[str], fold: str = "fold", cls: str = "class", vector: str = "v") -> DataFrame:
    """(run, fold, cs): for each fold the unit centroids of all other folds' rows, as an array by class name.

    A fold's training sums are the totals less its own sums, so no row is copied for each fold."""
    flat = rows.select(*run, fold, cls, F.posexplode(vector).alias("pos", "x")).groupBy(*run, fold, cls, "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = flat.groupBy(*run, cls, "pos").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = rows.select(*run, fold).distinct()
    every = folds.join(total, run) if run else folds.crossJoin(total)
    own = flat.select(*run, fold, cls, "pos", "s", "n")
    train = every.join(own, [*run, fold, cls, "pos"], "left").select(*run, fold, cls, "pos", (F.col("ts") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    means = train.groupBy(*run, fold, cls).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("m"))
    return means.groupBy(*run, fold).agg(F.array_sort(F.collect_list(F.struct(F.col(cls).alias("name"), unit(F.col("m")).alias("c")))).alias("cs"))


def predict(rows: DataFrame, centroids: DataFrame, on: list[str], vector: str = "v") -> DataFrame:
    """rows with y_pred: the class of the largest dot (ties: first name). Centroids are a row for each fold and run, so they are broadcast."""
    near = F.array_max(F.transform("cs", lambda s: F.struct(dot(F.col(vector), s["c"]).alias("sim"), s["name"].alias("name"))))
    return rows.join(F.broadcast(centroids), on).withColumn("y_pred", near["name"]).drop("cs")


def cross_validate(rows: DataFrame, run: list[str], fold: str = "fold") -> DataFrame:
    """rows with y_pred from centroids of the other folds."""
    return predict(rows, fold_centroids(rows, run, fold), [*run, fold])


def accuracy(pred: DataFrame, by: list[str]) -> DataFrame:
    right = (F.col("class") == F.col("y_pred")).cast("double")
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"))


def with_conditions(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each row once for each condition, with the condition's vector as v."""
    made = F.array(*[F.struct(F.lit(k).alias("condition"), c.alias("v")) for k, c in conditions.items()])
    return rows.withColumn("x", F.explode(made)).select(*[c for c in rows.columns if c != "v"], "x.condition", "x.v")


def coverage_predictions(rows: DataFrame, half: Column, vector: str = "v", unit_col: str = "unit") -> DataFrame:
    """Rows of every unit's second half with (condition, y_pred): judged when the unit is held out, and when its first half trains.

    Centroids of "all but the unit" and "all but its second half" are totals less sums, for all units in one plan."""
    sided = rows.withColumn("half", F.when(half, "a").otherwise("b"))
    flat = sided.select("class", unit_col, "half", F.posexplode(vector).alias("pos", "x")).groupBy("class", unit_col, "half", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = flat.groupBy("class", "pos").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    own = flat.groupBy("class", unit_col, "pos").agg(F.sum("s").alias("s_out"), F.sum("n").alias("n_out"), F.sum(F.when(F.col("half") == "b", F.col("s"))).alias("s_half"), F.sum(F.when(F.col("half") == "b", F.col("n"))).alias("n_half"))
    units = rows.select(unit_col, F.col("class").alias("own_class")).distinct()
    parts = units.crossJoin(F.broadcast(total)).join(own, ["class", unit_col, "pos"], "left")  # units by classes by places
    both = parts.select("class", unit_col, "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), (F.col("ts") - F.coalesce(f"s_{k}", F.lit(0.0))).alias("s"), (F.col("tn") - F.coalesce(f"n_{k}", F.lit(0))).alias("n")) for c, k in (("held_out", "out"), ("half_in", "half"))])).alias("x")).select("class", unit_col, "pos", "x.*").where("n > 0")
    means = both.groupBy(unit_col, "condition", "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("m"))
    cs = means.groupBy(unit_col, "condition").agg(F.array_sort(F.collect_list(F.struct(F.col("class").alias("name"), unit(F.col("m")).alias("c")))).alias("cs"))
    near = F.array_max(F.transform("cs", lambda s: F.struct(dot(F.col(vector), s["c"]).alias("sim"), s["name"].alias("name"))))["name"]
    return sided.where("half = 'b'").join(cs, unit_col).withColumn("y_pred", near).drop("cs", "half")


def coverage(rows: DataFrame, half: Column, vector: str = "v", unit_col: str = "unit") -> DataFrame:
    """For every unit at once: recall of its second half when the unit is held out, and when its first half trains."""
    scored = coverage_predictions(rows, half, vector, unit_col).withColumn("hit", (F.col("y_pred") == F.col("class")).cast("double"))
    r = lambda c: F.avg(F.when(F.col("condition") == c, F.col("hit")))
    g = scored.groupBy("class", unit_col).agg((F.count(F.lit(1)) / 2).cast("long").alias("n"), r("held_out").alias("held_out"), r("half_in").alias("half_in"))
    return g.withColumn("recovery", F.col("half_in") - F.col("held_out"))


def leave_one_out(rows: DataFrame, factor: str, seed: str, val_frac: float = 0.15, unit_col: str = "unit", key: str = "frame_id", vector: str = "v") -> DataFrame:
    """(unit, class, n, factor, seed, recall): every unit judged by centroids of all other units' rows, for each factor and seed at once.

    Rows drawn by seed with probability val_frac are validation, alike for every unit, and train nothing; all rows of the unit
    are judged. Centroids are totals less the unit's own sums; no row is repeated for the units left out."""
    kept = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(seed).cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1000)) >= round(1000 * val_frac)
    run = [factor, seed]
    train = rows.where(kept)
    cs = fold_centroids(train.select(*run, unit_col, "class", vector), run, unit_col, "class", vector)
    near = F.array_max(F.transform("cs", lambda s: F.struct(dot(F.col(vector), s["c"]).alias("sim"), s["name"].alias("name"))))["name"]
    judged = rows.join(cs, [*run, unit_col]).withColumn("hit", (near == F.col("class")).cast("double"))
    return judged.groupBy(unit_col, "class", *run).agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("recall"))


def deltas(recalls: DataFrame, factor: str, low: str, high: str, unit_col: str = "unit") -> DataFrame:
    """(unit, class, delta): mean recall over seeds at one factor less that at another, to 12 decimals, so that equal means differ by 0."""
    at = lambda f: F.avg(F.when(F.col(factor) == f, F.col("recall")))
    return recalls.groupBy(unit_col, "class").agg((F.round(at(high) - at(low), 12) + 0.0).alias("delta")).where("delta IS NOT NULL")


def delta_summary(changes: DataFrame) -> DataFrame:
    """One row: n, mean, sd, paired t, how many improved, and the exact sign test of that, one and two sided."""
    g = changes.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), sd0("delta").alias("sd"), F.count_if(F.col("delta") > 0).alias("n_improved"))
    g = g.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))).withColumn("s", F.when(F.col("n") > 0, sign_test(F.col("n"), F.col("n_improved"))))
    return g.select("n", "mean", "sd", "t", "n_improved", F.col("s.upper").alias("p_one_sided"), F.col("s.two_sided").alias("p_two_sided"))


def coverage_verdict(recovery: Column) -> Column:
    """coverage: the model had no comparable rows (a recovery above 0.30); partial: above 0.10; else little."""
    return F.when(recovery > 0.30, "coverage").when(recovery > 0.10, "partial").otherwise("little")


def predicted_fractions(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, y_pred, fraction): the share of each group's rows that each class is given."""
    counted = pred.groupBy(*by, "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(pred.groupBy(*by).agg(F.count(F.lit(1)).alias("of")), by).select(*by, "y_pred", (F.col("n") / F.col("of")).alias("fraction"))
