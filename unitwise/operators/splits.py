"""Group-disjoint and random splits, folds, and their checks. All draws order by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hex digits of md5 by which rows are counted before a cut: only one in 16^DIGITS of them is ranked.
DIGITS = 3


def shuffled(seed: str | int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def grouped_split(frames: DataFrame, frac: float, seed: int | str = 0, by: str = "class", unit: str = "unit", runs: tuple[str, ...] = ()) -> DataFrame:
    """frames with side: of each class's units, the first max(1, round half even(frac * n)) in drawn order are test.

    Only the distinct units are ranked; they come back by a join on class and unit. Rows of several `runs` are split
    apart; `seed` may name one of these columns."""
    units = frames.select(*runs, by, unit).distinct()
    w = Window.partitionBy(*runs, by)
    n_test = F.greatest(F.lit(1), F.bround(F.lit(frac) * F.count(F.lit(1)).over(w)).cast("int"))
    drawn = shuffled(seed, by, unit) if seed not in runs else F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (seed, by, unit)]))
    sided = units.withColumn("side", F.when(F.row_number().over(w.orderBy(drawn, unit)) <= n_test, "test").otherwise("train"))
    return frames.join(sided, [*runs, by, unit])


def random_split(frames: DataFrame, frac: float, seed: int | str = 0, key: str = "frame_id", runs: tuple[str, ...] = (), cut: str = "round") -> DataFrame:
    """frames with side: the first frac * n rows in drawn order (rounded half to even, or down for cut = "down") are test.

    The cut is found from row counts by md5 prefix, so only the rows of the one bucket that holds it are ranked. Rows of
    several `runs` are split apart; `seed` may name one of these columns."""
    drawn = shuffled(seed, key) if seed not in runs else F.md5(F.concat_ws("|", F.col(seed).cast("string"), F.col(key).cast("string")))
    drawn = frames.withColumn("h", drawn).withColumn("bucket", F.substring("h", 1, DIGITS))
    counts = drawn.groupBy(*runs, "bucket").agg(F.count(F.lit(1)).alias("c"))
    of_run = Window.partitionBy(*runs)
    edges = counts.select(*runs, "bucket", "c", F.sum("c").over(of_run.orderBy("bucket")).alias("upto"), F.sum("c").over(of_run).alias("n"))  # 16^DIGITS rows for a run at most
    at = F.lit(frac) * F.col("n")
    edges = edges.withColumn("cut", (F.bround(at) if cut == "round" else F.floor(at)).cast("long")).withColumn("before", F.col("upto") - F.col("c"))
    placed = drawn.join(F.broadcast(edges), [*runs, "bucket"])
    inside = (F.col("before") < F.col("cut")) & (F.col("cut") < F.col("upto"))
    ranked = placed.where(inside).withColumn("r", F.row_number().over(Window.partitionBy(*runs, "bucket").orderBy("h", key)))
    ranked = ranked.withColumn("side", F.when(F.col("before") + F.col("r") <= F.col("cut"), "test").otherwise("train")).drop("r")
    whole = placed.where(~inside).withColumn("side", F.when(F.col("upto") <= F.col("cut"), "test").otherwise("train"))
    return ranked.unionByName(whole).select(*frames.columns, "side")


def grouped_folds(frames: DataFrame, k: int, by: str = "class", unit: str = "unit") -> DataFrame:
    """(class, unit, n, fold): by class, units of falling size (ties by name) each to the least loaded fold (ties: the lowest).

    The greedy walk runs inside an aggregate over a class's units, which are far fewer than its rows."""
    sizes = frames.groupBy(by, unit).agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(unit).alias("u")))).alias("us"))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(0).cast("long"))
    start = F.struct(zeros.alias("load"), F.expr("cast(array() as array<int>)").alias("folds"))

    def place(acc: Column, x: Column) -> Column:
        f = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        return F.struct(F.transform(acc["load"], lambda v, i: F.when(i == f, v - x["m"]).otherwise(v)).alias("load"), F.concat(acc["folds"], F.array(f)).alias("folds"))

    dealt = ordered.select(by, "us", F.aggregate("us", start, place)["folds"].alias("folds"))
    rows = dealt.select(by, F.explode(F.arrays_zip("us", "folds")).alias("x"))
    return rows.select(by, F.col("x.us.u").alias(unit), (-F.col("x.us.m")).alias("n"), F.col("x.folds").cast("long").alias("fold"))


def random_folds(frames: DataFrame, folds: DataFrame, seed: int = 0, by: str = "class", key: str = "frame_id") -> DataFrame:
    """frames with a fold drawn by row, each class's folds as large as those of `folds` (from grouped_folds).

    As in `random_split`, only the rows of md5 buckets that hold a cut between folds are ranked, never a whole class."""
    sizes = folds.groupBy(by, "fold").agg(F.sum("n").alias("size"))
    upto = sizes.select(by, F.struct(F.sum("size").over(Window.partitionBy(by).orderBy("fold")).alias("upto"), "fold").alias("f"))
    ends = upto.groupBy(by).agg(F.array_sort(F.collect_list("f")).alias("ends"))  # one entry for a fold
    drawn = frames.withColumn("h", shuffled(seed, key)).withColumn("bucket", F.substring("h", 1, DIGITS))
    counts = drawn.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    edges = counts.withColumn("last", F.sum("c").over(Window.partitionBy(by).orderBy("bucket"))).withColumn("before", F.col("last") - F.col("c"))
    fold_of = lambda rank: F.filter("ends", lambda e: e["upto"] >= rank)[0]["fold"]
    edges = edges.join(ends, by).withColumn("one", fold_of(F.col("before") + 1) == fold_of(F.col("last")))
    placed = drawn.join(F.broadcast(edges), [by, "bucket"])  # 16^DIGITS rows for a class at most
    rank = F.col("before") + F.row_number().over(Window.partitionBy(by, "bucket").orderBy("h", key))
    ranked = placed.where("not one").withColumn("rank", rank).withColumn("fold", fold_of(F.col("rank"))).drop("rank")
    return placed.where("one").withColumn("fold", fold_of(F.col("last"))).unionByName(ranked).select(*frames.columns, "fold")


def straddling(sided: DataFrame, unit: str = "unit") -> DataFrame:
    """Units that stand on more than one side."""
    return sided.groupBy(unit).agg(F.countDistinct("side").alias("n_sides")).where("n_sides > 1")


def hold_out_unit(frames: DataFrame, target: str, val_frac: float = 0.15, seed: int = 0, unit: str = "unit", key: str = "frame_id") -> DataFrame:
    """frames with side: the target unit is test; the first int(val_frac * n) others in drawn order are val; the rest train."""
    others = frames.where(F.col(unit) != target)
    val = random_split(others, val_frac, seed, key, cut="down").withColumn("side", F.when(F.col("side") == "test", "val").otherwise("train"))
    return val.unionByName(frames.where(F.col(unit) == target).withColumn("side", F.lit("test")))


def coverage_split(frames: DataFrame, target: str, condition: str, seed: int = 0, unit: str = "unit", key: str = "frame_id") -> DataFrame:
    """frames with side: the target's second half is test; its first half trains if condition is half_in, else is left out; all others train."""
    own = frames.where(F.col(unit) == target)
    half = random_split(own, 0.5, seed, key).withColumn("side", F.when(F.col("side") == "train", "test").otherwise("train" if condition == "half_in" else "out"))
    return half.unionByName(frames.where(F.col(unit) != target).withColumn("side", F.lit("train")))


def balance(sided: DataFrame, by: str = "class") -> DataFrame:
    """Rows by side and class, with their share of the side."""
    counted = sided.groupBy("side", by).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("side")))


def validated(sided: DataFrame, frac: float = 0.15, seed: int = 0, grouped: bool = True, by: str = "class", unit: str = "unit", key: str = "frame_id") -> DataFrame:
    """sided with a validation side carved from its train rows: of each class's units (grouped), or of the rows."""
    train = sided.where("side = 'train'").drop("side")
    carved = grouped_split(train, frac, seed, by, unit) if grouped else random_split(train, frac, seed, key)
    carved = carved.withColumn("side", F.when(F.col("side") == "test", "val").otherwise("train"))
    return carved.select(sided.columns).unionByName(sided.where("side <> 'train'"))


def fold_sides(folds: DataFrame, seeds: list[int], val_frac: float = 0.15, by: str = "class", unit: str = "unit") -> DataFrame:
    """(fold, seed, class, unit, n, side) for every fold and seed at once: units of the fold are test; of each class's other
    units the first max(1, round half even(val_frac * n)) in an order drawn by seed are val; the rest train.

    `folds` is (class, unit, n, fold) of `grouped_folds`. Units, not rows, are repeated; rows take their side by a join on the
    unit. So no unit stands on two sides of a fold."""
    every = folds.select(F.col("fold").alias("own"), by, unit, "n").join(F.broadcast(folds.select("fold").distinct()))  # one row a fold
    seeded = every.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    pool = seeded.where("own <> fold")
    w = Window.partitionBy("fold", "seed", by)
    drawn = F.md5(F.concat_ws("|", F.col("seed").cast("string"), by, unit))
    n_val = F.greatest(F.lit(1), F.bround(F.lit(val_frac) * F.count(F.lit(1)).over(w)).cast("int"))
    carved = pool.withColumn("side", F.when(F.row_number().over(w.orderBy(drawn, unit)) <= n_val, "val").otherwise("train"))
    return carved.unionByName(seeded.where("own = fold").withColumn("side", F.lit("test"))).select("fold", "seed", by, unit, "n", "side")


def random_fold_sides(folded: DataFrame, seeds: list[int], val_frac: float = 0.15, key: str = "frame_id") -> DataFrame:
    """Rows with (fold, seed, side) for every fold and seed: rows of the fold are test, round half even(val_frac * n) of the
    others in an order drawn by seed are val, the rest train. `folded` has each row's own fold in `fold` (`random_folds`)."""
    named = folded.withColumnRenamed("fold", "own")
    every = named.join(F.broadcast(folded.select("fold").distinct()))  # one row a fold
    seeded = every.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    pool = random_split(seeded.where("own <> fold"), val_frac, "seed", key, runs=("fold", "seed"))
    pool = pool.withColumn("side", F.when(F.col("side") == "test", "val").otherwise("train"))
    return pool.unionByName(seeded.where("own = fold").withColumn("side", F.lit("test"))).drop("own")


def standard_sides(frames: DataFrame, seeds: list[int], k: int = 5, by: str = "class", unit: str = "unit") -> DataFrame:
    """Rows with (seed, side): the first of k grouped folds is test, validation units come from the rest."""
    sides = fold_sides(grouped_folds(frames, k, by, unit), seeds, by=by, unit=unit).where("fold = 0")
    return frames.join(sides.select("seed", by, unit, "side"), [by, unit])


def coverage_sides(frames: DataFrame, target: str, seeds: list[int], val_frac: float = 0.15, unit: str = "unit", key: str = "frame_id") -> DataFrame:
    """Rows with (condition, seed, side). Of the target unit, drawn by seed, the first half (rounded down) trains in the condition
    half_in and is left out (side out) in held_out; its other half is test in both. Of all other rows int(val_frac * n) are val, the rest train."""
    seeded = frames.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    own = random_split(seeded.where(F.col(unit) == target), 0.5, "seed", key, runs=("seed",), cut="down")
    rest = random_split(seeded.where(F.col(unit) != target), val_frac, "seed", key, runs=("seed",), cut="down")
    own = own.withColumn("side", F.when(F.col("side") == "test", "half").otherwise("test"))
    rest = rest.withColumn("side", F.when(F.col("side") == "test", "val").otherwise("train"))
    both = own.unionByName(rest).withColumn("condition", F.explode(F.array(F.lit("held_out"), F.lit("half_in"))))
    return both.withColumn("side", F.when(F.col("side") != "half", F.col("side")).when(F.col("condition") == "half_in", "train").otherwise("out"))


def first_of(frames: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each group in the given order; groups are cut before their rows are gathered."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
