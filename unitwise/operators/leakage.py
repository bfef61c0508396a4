"""Similarity within and across units, nearest centroids, and joins of similar units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, draw, unit


def vector_mean(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, n, mean): the mean vector of each group, summed by position so that a group's rows combine before the shuffle."""
    flat = rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return flat.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def gap(rows: DataFrame, vector: str, unit_col: str = "unit", by: str = "class") -> DataFrame:
    """By class: mean dot within units and across units, exactly, without any pairs.

    With S the sum of a unit's vectors, its mean over pairs is (|S|^2 - sum |f|^2)/(n(n-1)); pairs across units follow
    from the class total in the same way. Units of one row are left out; classes of fewer than two units give no row."""
    kept = rows.withColumn("sq", dot(F.col(vector), F.col(vector)))
    sizes = kept.groupBy(by, unit_col).agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("sq")).where("n > 1")
    means = vector_mean(rows, [by, unit_col], vector).drop("n").join(sizes, [by, unit_col])
    sums = means.select(by, unit_col, "n", "sq", F.transform("mean", lambda x: x * F.col("n")).alias("s")).withColumn("ss", dot(F.col("s"), F.col("s")))
    total = sums.select(by, F.posexplode("s").alias("pos", "x")).groupBy(by, "pos").agg(F.sum("x").alias("x")).groupBy(by).agg(F.sum(F.col("x") * F.col("x")).alias("tt"))
    g = sums.groupBy(by).agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("ss").alias("ss"), F.sum("sq").alias("sq")).where("n_units > 1")
    within = (F.col("ss") - F.col("sq")) / (F.col("nn") - F.col("n"))
    across = (F.col("tt") - F.col("ss")) / (F.col("n") * F.col("n") - F.col("nn"))
    return g.join(total, by).select(by, "n_units", within.alias("within"), across.alias("across"), (within - across).alias("gap"))


def sampled_pairs(rows: DataFrame, key: str, vector: str, n_pairs: int, seed: int = 0) -> DataFrame:
    """(a, b, similarity) of about n_pairs pairs a <> b, drawn by hash: places are hash buckets, so no row is ranked against all others."""
    n = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))  # one row
    placed = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).join(F.broadcast(n)).withColumn("pos", draw(f"{seed}p", F.col("k"), F.col("n")))
    asked = rows.sparkSession.range(n_pairs).join(F.broadcast(n)).select("id", draw(f"{seed}a", F.col("id"), F.col("n")).alias("pa"), draw(f"{seed}b", F.col("id"), F.col("n")).alias("pb"))
    a = placed.select(F.col("k").alias("a"), F.col("v").alias("va"), F.col("pos").alias("pa"))
    b = placed.select(F.col("k").alias("b"), F.col("v").alias("vb"), F.col("pos").alias("pb"))
    return asked.join(a, "pa").join(b, "pb").where("a <> b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))


def _drawn_pairs(asked: DataFrame, placed: DataFrame, by: str) -> DataFrame:
    """(by, similarity) of asked (by, ua, pa, ub, pb): rows found by unit and place."""
    at = lambda s: placed.select(F.col(by), F.col("unit").alias(f"u{s}"), F.col("pos").alias(f"p{s}"), F.col("v").alias(f"v{s}"))
    met = asked.join(at("a"), [by, "ua", "pa"]).join(at("b"), [by, "ub", "pb"])
    return met.select(by, dot(F.col("va"), F.col("vb")).alias("similarity"))


def within_above_across(rows: DataFrame, key: str, vector: str, unit_col: str = "unit", by: str = "class", per_unit: int = 100, n_pairs: int = 6000, seed: int = 0) -> DataFrame:
    """By class: mean similarity of drawn pairs within units and across units, their gap, the 95th percentile across, and the share of pairs within above it.

    Within: per_unit pairs of different rows of each unit of two rows or more. Across: n_pairs times two different units, a row
    of each. Pairs are drawn by hash and found by joins on (class, unit, place), so no pairs are made besides them. Classes of
    fewer than two such units give no row."""
    in_unit = Window.partitionBy(by, "unit")
    placed = rows.select(F.col(by), F.col(unit_col).alias("unit"), F.col(key).alias("k"), F.col(vector).alias("v"))
    placed = placed.withColumn("pos", F.row_number().over(in_unit.orderBy("k")) - 1).withColumn("n", F.count(F.lit(1)).over(in_unit)).where("n > 1")
    in_class = Window.partitionBy(by)
    units = placed.groupBy(by, "unit").agg(F.max("n").alias("n"))
    units = units.withColumn("no", F.row_number().over(in_class.orderBy("unit")) - 1).withColumn("units", F.count(F.lit(1)).over(in_class)).where("units > 1")
    one = units.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_unit - 1))))
    place = lambda tag, n: draw(f"{seed}{tag}", F.concat_ws("/", by, "unit", "i"), n)
    asked = one.withColumn("pa", place("wa", F.col("n"))).withColumn("pb", (F.col("pa") + 1 + place("wb", F.col("n") - 1)) % F.col("n"))
    within = _drawn_pairs(asked.select(by, F.col("unit").alias("ua"), "pa", F.col("unit").alias("ub"), "pb"), placed, by)
    classes = units.groupBy(by).agg(F.max("units").alias("units")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_pairs - 1))))
    pick = lambda tag, n: draw(f"{seed}{tag}", F.concat_ws("/", by, "i"), n)
    two = classes.withColumn("na", pick("ca", F.col("units"))).withColumn("nb", (F.col("na") + 1 + pick("cb", F.col("units") - 1)) % F.col("units"))
    named = lambda s: units.select(by, F.col("no").alias(f"n{s}"), F.col("unit").alias(f"u{s}"), F.col("n").alias(f"size_{s}"))
    two = two.join(named("a"), [by, "na"]).join(named("b"), [by, "nb"]).withColumn("pa", pick("ra", F.col("size_a"))).withColumn("pb", pick("rb", F.col("size_b")))
    across = _drawn_pairs(two.select(by, "ua", "pa", "ub", "pb"), placed, by)
    level = across.groupBy(by).agg(F.avg("similarity").alias("across"), F.percentile("similarity", 0.95).alias("across_p95"))
    found = within.join(level, by).groupBy(by).agg(F.avg("similarity").alias("within"), F.max("across").alias("across"), F.max("across_p95").alias("across_p95"), F.avg((F.col("similarity") > F.col("across_p95")).cast("double")).alias("share_above"))
    return found.select(by, "within", "across", (F.col("within") - F.col("across")).alias("gap"), "across_p95", "share_above")


def adjacent_against_random(rows: DataFrame, folder: str, index: str, key: str, vector: str, n_pairs: int = 4000, seed: int = 0, high: float = 0.9) -> DataFrame:
    """One row: mean and median similarity of rows next to each other in a folder's order and of drawn pairs, the gap of the means, and the share of neighbours above `high`."""
    w = Window.partitionBy(folder).orderBy(index, key)
    near = rows.select(dot(F.col(vector), F.lag(vector).over(w)).alias("s")).where("s IS NOT NULL")
    adjacent = near.agg(F.count(F.lit(1)).alias("n_adjacent"), F.avg("s").alias("adjacent_mean"), F.median("s").alias("adjacent_median"), F.avg((F.col("s") > high).cast("double")).alias("share_high"))
    random = sampled_pairs(rows, key, vector, n_pairs, seed).agg(F.count(F.lit(1)).alias("n_random"), F.avg("similarity").alias("random_mean"), F.median("similarity").alias("random_median"))
    return adjacent.join(random).withColumn("gap", F.col("adjacent_mean") - F.col("random_mean"))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, nearest, similarity): the centroid (name, mean) of the largest dot; ties go to the first name.

    Centroids are one row for a class: they are gathered into one array and met by each row without a shuffle."""
    all_of = centroids.agg(F.array_sort(F.collect_list(F.struct("name", unit(F.col("mean")).alias("c")))).alias("cs"))
    scored = rows.join(F.broadcast(all_of)).select(key, F.transform("cs", lambda s: F.struct(dot(F.col(vector), s["c"]).alias("sim"), s["name"].alias("name"))).alias("ss"))
    best: Column = F.array_max(F.transform("ss", lambda s: s["sim"]))
    return scored.select(key, best.alias("similarity"), "ss").select(key, F.filter("ss", lambda s: s["sim"] == F.col("similarity"))[0]["name"].alias("nearest"), "similarity")
