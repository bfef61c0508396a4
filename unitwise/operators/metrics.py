"""Classification metrics and statistics of experiments, over long tables of predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pred: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """One row for each group and class: support, recall, precision, f1, and the group's accuracy. Denominators are at least 1 (f1: 1e-9)."""
    c = F.explode(F.array(*[F.lit(x) for x in classes])).alias("class")
    sums = pred.groupBy(*by).agg(*[F.count_if((F.col("y_true") == a) & (F.col("y_pred") == b)).alias(f"c_{a}_{b}") for a in classes for b in classes])
    rows = sums.select("*", c)
    pick = lambda parts: F.coalesce(*[F.when(F.col("class") == x, p) for x, p in parts])
    plus = lambda cols: sum((F.col(x) for x in cols), F.lit(0))
    hit = pick([(x, F.col(f"c_{x}_{x}")) for x in classes])
    support = pick([(x, plus([f"c_{x}_{b}" for b in classes])) for x in classes])
    said = pick([(x, plus([f"c_{a}_{x}" for a in classes])) for x in classes])
    accuracy = plus([f"c_{x}_{x}" for x in classes]) / F.greatest(F.lit(1), plus([f"c_{a}_{b}" for a in classes for b in classes]))
    base = rows.select(*by, "class", support.alias("support"), (hit / F.greatest(F.lit(1), support)).alias("recall"), (hit / F.greatest(F.lit(1), said)).alias("precision"), accuracy.alias("accuracy"))
    return base.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def recall_by_unit(pred: DataFrame, unit: str = "unit", seed: str = "seed") -> DataFrame:
    """(unit, n, recall, recall_sd): one recall for each unit and seed, then mean and population deviation over seeds."""
    one = pred.groupBy(unit, seed).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return one.groupBy(unit).agg(F.sum("n").alias("n"), F.avg("r").alias("recall"), F.stddev_pop("r").alias("recall_sd"))


def sd0(c: Column | str) -> Column:
    """Sample deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def decompose(runs: DataFrame, by: list[str], value: str, fold: str = "fold") -> DataFrame:
    """mean of fold means, their deviation, and the mean of the deviations over seeds within folds."""
    folds = runs.groupBy(*by, fold).agg(F.avg(value).alias("m"), sd0(value).alias("s"))
    return folds.groupBy(*by).agg(F.avg("m").alias("mean"), sd0("m").alias("between_fold_sd"), F.avg("s").alias("within_fold_sd"), F.count(F.lit(1)).alias("n_folds"))


def paired(runs: DataFrame, on: str, condition: str, first: str, second: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Paired differences first - second over `on`: n, mean_diff, sd, t (null without spread), n_positive."""
    by = by or []
    pair = runs.groupBy(*by, on).agg(F.avg(F.when(F.col(condition) == first, F.col(value))).alias("x"), F.avg(F.when(F.col(condition) == second, F.col(value))).alias("y"))
    d = pair.where("x is not null and y is not null").withColumn("d", F.col("x") - F.col("y"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("n_positive"))
    return g.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))))


def welch(runs: DataFrame, condition: str, first: str, second: str, value: str) -> DataFrame:
    """One row: means, and Welch's t of first against second; null with fewer than two values or no spread."""
    x, y = F.when(F.col(condition) == first, F.col(value)), F.when(F.col(condition) == second, F.col(value))
    g = runs.agg(F.avg(x).alias("mean_first"), F.avg(y).alias("mean_second"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.count(x).alias("nx"), F.count(y).alias("ny"))
    se = F.sqrt(F.col("vx") / F.col("nx") + F.col("vy") / F.col("ny"))
    return g.select("mean_first", "mean_second", F.when((F.col("nx") > 1) & (F.col("ny") > 1) & (se > 0), (F.col("mean_first") - F.col("mean_second")) / se).alias("t"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate over pairs; null for fewer than three or no variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def t_of_r(r: Column, n: Column) -> Column:
    return F.when((n >= 3) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """Correlation of ranks, ties broken by key."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, key)).cast("double")
    return rows.withColumn("rx", rank(x)).withColumn("ry", rank(y)).groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("spearman"), F.count(F.lit(1)).alias("n"))


def sign_test(n: Column, k: Column) -> Column:
    """Struct upper, lower, two_sided: exact tails of k successes in n fair draws, by the recurrence of binomial terms."""
    step = lambda acc, i: F.struct((acc["t"] * (n - i + 1) / i).alias("t"), F.when(i >= k, acc["up"] + acc["t"] * (n - i + 1) / i).otherwise(acc["up"]).alias("up"), F.when(i <= k, acc["lo"] + acc["t"] * (n - i + 1) / i).otherwise(acc["lo"]).alias("lo"))
    p0 = F.pow(F.lit(0.5), n)
    start = F.struct(p0.alias("t"), F.when(k <= 0, p0).otherwise(0.0).alias("up"), p0.alias("lo"))
    tails = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step)
    return F.struct(tails["up"].alias("upper"), tails["lo"].alias("lower"), F.least(F.lit(1.0), 2 * F.least(tails["up"], tails["lo"])).alias("two_sided"))


def mann_whitney(rows: DataFrame, group: str, first: str, value: str) -> DataFrame:
    """One row: U of the first group against the rest, and z without tie correction; tied values take their mean rank.

    Ranks come from counts by distinct value, so the one ordered window holds distinct values only."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(group) == first).alias("c1"))
    ranked = counts.withColumn("rank", F.sum("c").over(Window.orderBy("v")) - F.col("c") / 2 + 0.5)
    g = ranked.agg(F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n2"), F.sum(F.col("c1") * F.col("rank")).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return g.select("n1", "n2", u.alias("u"), ((u - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)).alias("z"))


def bootstrap_mean_diff(rows: DataFrame, group: str, first: str, value: str, key: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """One row: observed mean difference, and the 2.5 and 97.5 percentiles of resampled ones.

    Each resample draws by hash, joined on (group, place); `rows` is a table of runs, small beside frames."""
    from ..functions.arrays import draw

    sided = rows.select((F.col(group) == first).alias("g"), F.col(value).alias("v"), F.col(key).alias("k"))
    placed = sided.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    counts = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    drawn = rows.sparkSession.range(resamples).select(F.col("id").alias("b")).join(counts).select("b", "g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "n")
    drawn = drawn.select("b", "g", draw(seed, F.concat_ws("-", "b", "g", "i"), 1 << 31).alias("d"), "n").withColumn("pos", F.col("d") % F.col("n"))
    means = drawn.join(placed, ["g", "pos"]).groupBy("b").agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("d"))
    seen = sided.agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("observed"))
    return means.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high")).join(seen).select("observed", "low", "high")


def largest_gap(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest gap between neighbours as a share of the range; 0 for fewer than three values or no range."""
    w = Window.partitionBy(*by).orderBy(value)
    gaps = rows.withColumn("gap", F.lead(value).over(w) - F.col(value))
    rng = F.max(value) - F.min(value)
    return gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 3) & (rng > 0), F.max("gap") / rng).otherwise(0.0).alias("gap"))


def z_against_others(rows: DataFrame, target: Column, value: str) -> Column:
    """Aggregate: the target's mean against mean and population deviation (+1e-9) of all others."""
    other = F.when(~target, F.col(value))
    return (F.avg(F.when(target, F.col(value))) - F.avg(other)) / (F.stddev_pop(other) + F.lit(1e-9))


def interaction(runs: DataFrame, seed: str, condition: str, names: tuple[str, str, str, str], value: str) -> DataFrame:
    """By seed I = both - input - weights + neither, then mean, sd, se, t over seeds; names: neither, input, weights, both."""
    cell = [F.avg(F.when(F.col(condition) == n, F.col(value))).alias(k) for n, k in zip(names, ("neither", "input", "weights", "both"), strict=True)]
    i = runs.groupBy(seed).agg(*cell).withColumn("i", F.col("both") - F.col("input") - F.col("weights") + F.col("neither")).where("i is not null")
    g = i.agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("mean"), F.stddev_samp("i").alias("sd"))
    return g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def interaction_interval(runs: DataFrame, seed: str, condition: str, names: tuple[str, str, str, str], value: str, resamples: int = 20_000, draw_seed: int = 0) -> DataFrame:
    """One row: the contrast of `interaction`, its 2.5 and 97.5 percentiles with seeds drawn jointly over the four cells, and
    the unpaired form beside it: each cell's runs drawn apart (unpaired_low, unpaired_high), and its t from the cells' variances.

    Seeds without all four cells are left out of the joint form only. Draws are by hash; a table of runs is small beside frames."""
    from ..functions.arrays import draw

    sign = F.when(F.col(condition).isin(names[0], names[3]), 1.0).otherwise(-1.0)
    cells = runs.where(F.col(condition).isin(*names)).groupBy(F.col(condition).alias("cell"), F.col(seed).alias("k")).agg(F.avg(value).alias("v"), F.max(sign).alias("sign"))
    per_seed = cells.groupBy("k").agg(F.sum(F.col("v") * F.col("sign")).alias("v"), F.count(F.lit(1)).alias("c")).where("c = 4")
    values = per_seed.select(F.lit("joint").alias("cell"), "k", "v", F.lit(1.0).alias("sign")).unionByName(cells.select(F.col("cell").cast("string"), "k", "v", "sign"))
    of_cell = Window.partitionBy("cell")
    placed = values.withColumn("pos", F.row_number().over(of_cell.orderBy("k")) - 1).withColumn("n", F.count(F.lit(1)).over(of_cell))
    asked = placed.select("cell", "n", F.col("pos").alias("i")).join(runs.sparkSession.range(resamples).select(F.col("id").alias("b")))
    drawn = asked.withColumn("pos", draw(draw_seed, F.concat_ws("-", "b", "cell", "i"), F.col("n")))
    means = drawn.join(placed.select("cell", "pos", "v", "sign"), ["cell", "pos"]).groupBy("b", "cell").agg((F.avg("v") * F.max("sign")).alias("m"))
    boots = means.groupBy("b").agg(F.sum(F.when(F.col("cell") == "joint", F.col("m"))).alias("joint"), F.sum(F.when(F.col("cell") != "joint", F.col("m"))).alias("apart"))
    bounds = boots.agg(F.percentile("joint", 0.025).alias("low"), F.percentile("joint", 0.975).alias("high"), F.percentile("apart", 0.025).alias("unpaired_low"), F.percentile("apart", 0.975).alias("unpaired_high"))
    joint = per_seed.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), sd0("v").alias("sd"))
    spread = cells.groupBy("cell").agg((F.avg("v") * F.max("sign")).alias("m"), (F.var_samp("v") / F.count(F.lit(1))).alias("q")).agg(F.sum("m").alias("point"), F.sqrt(F.sum("q")).alias("se"))
    g = joint.join(spread).join(bounds)
    return g.select("n", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), "low", "high", "unpaired_low", "unpaired_high", F.when(F.col("se") > 0, F.col("point") / F.col("se")).alias("unpaired_t"))


def separation(rows: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """min(first) - max(second): positive without any overlap."""
    return rows.agg((F.min(F.when(F.col(group) == first, F.col(value))) - F.max(F.when(F.col(group) == second, F.col(value)))).alias("separation"))


#: Two-tailed critical t at 5 % by degrees of freedom; 2.0 beyond.
CRITICAL_T = {1: 12.71, 2: 4.30, 3: 3.18, 4: 2.78, 5: 2.57, 6: 2.45, 7: 2.36, 8: 2.31, 9: 2.26, 10: 2.23}


def critical_t(df: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CRITICAL_T.items() for x in kv]), df.cast("int")), F.lit(2.0))


def judged_t(tested: DataFrame) -> DataFrame:
    """Rows of `paired` with df, critical and significant (|t| above it; false without a t)."""
    critical = critical_t(F.col("n") - 1)
    return tested.withColumn("df", F.col("n") - 1).withColumn("critical", critical).withColumn("significant", F.coalesce(F.abs("t") > critical, F.lit(False)))


def error_structure(pred: DataFrame, by: list[str], classes: list[str], focus: str, other: str) -> DataFrame:
    """By group: precision and recall of the class in focus and whether the first is lower, how often `other` is taken for it
    and the reverse, and the class of the least F1 (ties: the first name)."""
    m = class_metrics(pred, by, classes)
    of = lambda c: F.max(F.when(F.col("class") == focus, F.col(c)))
    g = m.groupBy(*by).agg(of("precision").alias("precision"), of("recall").alias("recall"), F.min(F.struct("f1", "class")).alias("w"))
    n = lambda a, b: F.count_if((F.col("y_true") == a) & (F.col("y_pred") == b))
    mixed = pred.groupBy(*by).agg(n(other, focus).alias("other_as_focus"), n(focus, other).alias("focus_as_other"))
    return g.join(mixed, by).select(*by, "precision", "recall", (F.col("precision") < F.col("recall")).alias("precision_lower"), "other_as_focus", "focus_as_other", (F.col("other_as_focus") > F.col("focus_as_other")).alias("other_leaks_more"), F.col("w.class").alias("weakest"), F.col("w.f1").alias("weakest_f1"))


def against_others(rows: DataFrame, target: Column, value: str, base: str, by: list[str] | None = None) -> DataFrame:
    """By group: the target's value and rank (1 + those above it), its z against the others (sample deviation + 1e-12), the others' median, largest
    and deviation, and the correlation of base and value with and without the target. Groups without the target give no row."""
    by = by or []
    own, other = F.when(target, F.col(value)), F.when(~target, F.col(value))
    without = lambda c: F.when(~target, F.col(c))
    marked = rows.withColumn("t", target)
    top = marked.where("t").groupBy(*by).agg(F.max(value).alias("own")) if by else marked.where("t").agg(F.max(value).alias("own"))
    joined = rows.join(top, by) if by else rows.join(F.broadcast(top))  # one row
    g = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(own).alias("value"), (F.count_if(F.col(value) > F.col("own")) + 1).alias("rank"),
        F.when(F.count(other) > 1, (F.max(own) - F.avg(other)) / (F.stddev_samp(other) + F.lit(1e-12))).alias("z"),
        F.median(other).alias("others_median"), F.max(other).alias("others_most"), sd0(other).alias("others_sd"),
        pearson(F.col(base), F.col(value)).alias("pearson"), pearson(without(base), without(value)).alias("pearson_without"),
    )
    return g.where("value IS NOT NULL")


def seed_gaps(runs: DataFrame, by: list[str], value: str, large: float = 0.45) -> DataFrame:
    """By group: its values in order, mean, sd, the largest gap as a share of the range, and whether that splits the values."""
    listed = runs.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"), F.avg(value).alias("mean"), sd0(value).alias("sd"))
    return listed.join(largest_gap(runs, by, value), by).withColumn("split", F.col("gap") > large)


#: Metrics of predictions by name: each an aggregate, "of a class" where it takes one.
METRICS = {
    "accuracy": lambda cls=None: F.avg((F.col("y_true") == F.col("y_pred")).cast("double")),
    "recall": lambda cls: F.count_if((F.col("y_true") == cls) & (F.col("y_pred") == cls)) / F.greatest(F.lit(1), F.count_if(F.col("y_true") == cls)),
    "precision": lambda cls: F.count_if((F.col("y_true") == cls) & (F.col("y_pred") == cls)) / F.greatest(F.lit(1), F.count_if(F.col("y_pred") == cls)),
}


def metric(name: str | tuple[str, str]) -> Column:
    """The aggregate of a metric by its name, or by (class, name)."""
    cls, kind = (None, name) if isinstance(name, str) else name
    if kind not in METRICS:
        raise ValueError(f"no such metric: {kind}; known: {', '.join(sorted(METRICS))}")
    return METRICS[kind](cls) if cls is not None else METRICS[kind]()
