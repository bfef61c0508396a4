"""Comparisons of protocols over seeds and folds, and what datasets are built from: order, limits, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import experiments as X
from ..operators import metrics as M
from ..operators import splits as P
from ..sources import bindings as B
from ..sources import tree as T
from .experiments import ACC, DEALT, accuracies, files
from .frames import EMB, FRAMES, LINEAR, featured, vectors
from .registry import ORACLES, query, rounded
from .studies import CV, FOLD6, UNIT, protocol_rows

CLASSES = [str(i) for i in range(10)]
TARGET = "3"

#: Sides of a grouped and of a random split for each of some seeds; the rest of the SQL takes a side for a fold.
SPLITS = """sd AS (SELECT unnest(range({seeds})) AS seed), k AS (SELECT DISTINCT class, unit FROM u),
gu AS (SELECT seed, class, unit, CASE WHEN row_number() OVER (PARTITION BY seed, class ORDER BY md5(concat_ws('|', seed, class, unit)), unit) <= greatest(1, round_even(0.3 * count(*) OVER (PARTITION BY seed, class), 0)) THEN 'test' ELSE 'train' END AS side FROM k, sd),
ru AS (SELECT seed, frame_id, class, unit, v, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, frame_id)), frame_id) <= round_even(0.3 * count(*) OVER (PARTITION BY seed), 0) THEN 'test' ELSE 'train' END AS side FROM u, sd),
rows AS (SELECT frame_id, class, unit, v, 'grouped-' || seed AS protocol, side AS fold FROM u JOIN gu USING (class, unit) UNION ALL SELECT frame_id, class, unit, v, 'random-' || seed, side FROM ru)"""
#: Metrics of predictions pr by run: accuracy, macro means, and those of the target class.
METRICS = f"""tp AS (SELECT protocol, fold, class, y_pred FROM pr WHERE r = 1 AND {{test}}), kc AS (SELECT unnest({CLASSES}) AS k),
cm AS (SELECT protocol, fold, k, count(*) FILTER (WHERE class = k AND y_pred = k) AS hit, count(*) FILTER (WHERE class = k) AS support, count(*) FILTER (WHERE y_pred = k) AS said, count(*) FILTER (WHERE class = y_pred) / count(*) AS accuracy FROM tp, kc GROUP BY ALL),
rp AS (SELECT *, hit / greatest(1, support) AS recall, hit / greatest(1, said) AS precision FROM cm), fm AS (SELECT *, 2 * precision * recall / greatest(1e-9, precision + recall) AS f1 FROM rp),
mm AS (SELECT protocol, fold, max(accuracy) AS accuracy, avg(f1) AS macro_f1, avg(recall) AS macro_recall, max(f1) FILTER (WHERE k = '{TARGET}') AS target_f1, max(precision) FILTER (WHERE k = '{TARGET}') AS target_precision FROM fm GROUP BY ALL)"""
NAMES = ("accuracy", "macro_f1", "macro_recall", "target_f1", "target_precision")


def split_rows(spark, d, seeds: int) -> DataFrame:
    """The vectors' frames under a grouped and a random split for each seed, with `fold` naming the side."""
    v = vectors(spark, d).select("frame_id", "class", "unit", "v", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    grouped = P.grouped_split(v, 0.3, "seed", runs=("seed",)).withColumn("protocol", F.lit("grouped"))
    random = P.random_split(v, 0.3, "seed", runs=("seed",)).withColumn("protocol", F.lit("random"))
    return grouped.unionByName(random).withColumnRenamed("side", "fold")


def metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """By run: accuracy, macro F1 and recall, and F1 and precision of the target class."""
    m = M.class_metrics(pred.select(*by, F.col("class").alias("y_true"), "y_pred"), by, CLASSES)
    of_target = lambda c: F.max(F.when(F.col("class") == TARGET, F.col(c)))
    return m.groupBy(*by).agg(F.max("accuracy").alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), of_target("f1").alias("target_f1"), of_target("precision").alias("target_precision"))


def compared(spark, d, seeds: int) -> DataFrame:
    pred = X.cross_validate(split_rows(spark, d, seeds), ["protocol", "seed"]).where("fold = 'test'")
    return metrics(pred, ["protocol", "seed"])


RUNS = f"WITH {EMB}, {SPLITS.format(seeds=3)}, {CV}, {METRICS.format(test="fold = 'test'")}, s AS (SELECT split_part(protocol, '-', 1) AS protocol, mm.* EXCLUDE (protocol, fold) FROM mm)"


@query("j1_compare", f"{RUNS} SELECT protocol, count(*) AS n_seeds, " + ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}, round(stddev_pop({n}), 6) + 0.0 AS {n}_sd" for n in NAMES) + " FROM s GROUP BY protocol")
def compare(spark, d):
    """Random against grouped splits over seeds: mean and population deviation of each metric."""
    sides = [c for n in NAMES for c in (F.avg(n).alias(n), F.stddev_pop(n).alias(f"{n}_sd"))]
    return rounded(compared(spark, d, 3).groupBy("protocol").agg(F.count(F.lit(1)).alias("n_seeds"), *sides))


@query("j1_drop", f"{RUNS} SELECT " + ", ".join(f"round(avg({n}) FILTER (WHERE protocol = 'random') - avg({n}) FILTER (WHERE protocol = 'grouped'), 6) + 0.0 AS {n}" for n in NAMES) + " FROM s")
def drop(spark, d):
    """What each metric loses from random to grouped splits."""
    of = lambda p, n: F.avg(F.when(F.col("protocol") == p, F.col(n)))
    return rounded(compared(spark, d, 3).agg(*[(of("random", n) - of("grouped", n)).alias(n) for n in NAMES]))


KFOLD = (
    f"WITH RECURSIVE {EMB}, "
    + DEALT.replace("u AS (SELECT lang AS class, lang || '/' || source AS unit, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT *", "uu AS (SELECT class, unit, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT *").replace("AS i FROM u)", "AS i FROM uu)")
    + """, gf AS (SELECT class, unit, n, fold FROM w WHERE i > 0), z AS (SELECT class, fold, sum(n) AS size FROM gf GROUP BY ALL), q AS (SELECT class, fold, size, sum(size) OVER (PARTITION BY class ORDER BY fold) AS upto FROM z),
d AS (SELECT frame_id, class, unit, v, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '3', frame_id)), frame_id) AS r FROM u),
rows AS (SELECT frame_id, u.class, u.unit, v, 'grouped' AS protocol, fold FROM u JOIN gf ON u.class = gf.class AND u.unit = gf.unit UNION ALL SELECT frame_id, d.class, unit, v, 'random', fold FROM d JOIN q ON d.class = q.class AND r <= upto AND r > upto - size), """
    + f"{CV}, {METRICS.format(test='true')}"
)


def kfold(spark, d) -> DataFrame:
    """Metrics by protocol and fold; grouped folds are dealt greedily, random ones are as large."""
    v = vectors(spark, d).select("frame_id", "class", "unit", "v")
    folds = P.grouped_folds(v, 5)
    grouped = v.join(folds.select("class", "unit", "fold"), ["class", "unit"]).withColumn("protocol", F.lit("grouped"))
    random = P.random_folds(v, folds, 3).withColumn("protocol", F.lit("random"))
    return metrics(X.cross_validate(grouped.unionByName(random), ["protocol"]), ["protocol", "fold"])


@query("j3_kfold_metrics", f"{KFOLD} SELECT protocol, fold, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in NAMES) + " FROM mm")
def kfold_metrics(spark, d):
    return rounded(kfold(spark, d))


@query("j3_kfold_summary", f"{KFOLD}, l AS (SELECT fold, protocol, unnest({list(NAMES)}) AS metric, unnest([{', '.join(NAMES)}]) AS x FROM mm), p AS (SELECT metric, fold, max(x) FILTER (WHERE protocol = 'grouped') AS g, max(x) FILTER (WHERE protocol = 'random') AS r FROM l GROUP BY ALL)" + """
SELECT metric, round(avg(g), 6) + 0.0 AS grouped_mean, round(stddev_samp(g), 6) + 0.0 AS grouped_sd, round(avg(r), 6) + 0.0 AS random_mean, round(stddev_samp(r), 6) + 0.0 AS random_sd, round(avg(r - g), 6) + 0.0 AS mean_diff, count(*) FILTER (WHERE r > g) AS n_positive FROM p GROUP BY metric""")
def kfold_summary(spark, d):
    """Each metric's mean and deviation between folds under both protocols, and their difference paired by fold."""
    named = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in NAMES])
    m = kfold(spark, d).select("protocol", "fold", F.explode(named).alias("m")).select("protocol", "fold", "m.*")
    of = lambda p: F.max(F.when(F.col("protocol") == p, F.col("x")))
    p = m.groupBy("metric", "fold").agg(of("grouped").alias("g"), of("random").alias("r"))
    return rounded(p.groupBy("metric").agg(F.avg("g").alias("grouped_mean"), F.stddev_samp("g").alias("grouped_sd"), F.avg("r").alias("random_mean"), F.stddev_samp("r").alias("random_sd"), F.avg(F.col("r") - F.col("g")).alias("mean_diff"), F.count_if(F.col("r") > F.col("g")).alias("n_positive")))


@query("j12_ten_seeds", f"""WITH {EMB}, {SPLITS.format(seeds=10)},
h AS (SELECT frame_id, list_transform(range(32), lambda i: v[(i // 8) * 16 + (i % 8) * 2 + 1] + v[(i // 8) * 16 + (i % 8) * 2 + 2]) AS s FROM u), f AS (SELECT frame_id, list_transform(s, lambda x: x / CASE WHEN list_inner_product(s, s) > 0 THEN sqrt(list_inner_product(s, s)) ELSE 1 END) AS s FROM h),
a1 AS (WITH {CV} SELECT protocol, accuracy FROM acc WHERE fold = 'test'),
a2 AS (WITH rows AS (SELECT r.frame_id, class, unit, s AS v, protocol, fold FROM rows r JOIN f USING (frame_id)), {CV} SELECT protocol, accuracy FROM acc WHERE fold = 'test'),
p AS (SELECT split_part(protocol, '-', 1) AS protocol, a2.accuracy - a1.accuracy AS d FROM a1 JOIN a2 USING (protocol))
SELECT protocol, count(*) AS n, round(avg(d), 6) + 0.0 AS mean_diff, round(stddev_samp(d), 6) + 0.0 AS sd, count(*) FILTER (WHERE d > 0) AS n_positive, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) + 0.0 AS t FROM p GROUP BY protocol""".replace("(v) AS x, unnest(range(len(v)))", "(v) AS x, unnest(range(len(v)))"))
def ten_seeds(spark, d):
    """Columns summed in pairs against whole columns, paired by seed, under both protocols, for ten seeds."""
    rows = split_rows(spark, d, 10)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("v", (F.floor(i / 8) * 16 + (i % 8) * 2).cast("int")) + F.get("v", (F.floor(i / 8) * 16 + (i % 8) * 2 + 1).cast("int")))
    made = X.with_conditions(rows, {"1": F.col("v"), "2": A.unit(pairs)})
    acc = X.accuracy(X.cross_validate(made, ["protocol", "seed", "condition"]).where("fold = 'test'"), ["protocol", "seed", "condition"])
    return rounded(M.paired(acc, "seed", "condition", "2", "1", "accuracy", by=["protocol"]))


@query("b6_sorted_files", r"""SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY coalesce(CAST(regexp_extract_all(url, '(\d+)', 1)[-1] AS BIGINT), 0), url, page_id) AS place FROM pages""")
def sorted_files(spark, d):
    """Files of a folder by their last integer (0 without one), then by name."""
    from ..functions.names import number_order

    p = B.table(spark, d, "pages").select("page_id", "url", F.pmod("page_id", F.lit(10)).alias("folder"))
    w = Window.partitionBy("folder").orderBy(number_order(F.col("url")), "page_id")
    return p.select("page_id", F.row_number().over(w).cast("long").alias("place"))


@query("g4_first_frames", f"WITH {FRAMES}, r AS (SELECT unit, frame_id, row_number() OVER (PARTITION BY unit ORDER BY frame_idx, frame_id) AS r FROM frames) SELECT unit, frame_id FROM r WHERE r <= 5")
def first_frames(spark, d):
    from .frames import frames

    return P.first_of(frames(spark, d).select("unit", "frame_id", "frame_idx"), 5, ["unit"], ["frame_idx", "frame_id"]).select("unit", "frame_id")


@query("e8_against_others", f"""WITH {FRAMES}, {LINEAR}, g AS (SELECT unit, count(*) AS n, avg(col_centroid) AS mean, coalesce(stddev_samp(col_centroid), 0) AS sd FROM feat GROUP BY unit)
SELECT a.unit, a.n, round(a.mean, 6) + 0.0 AS mean, round(a.sd, 6) + 0.0 AS sd, round(min(b.mean), 6) + 0.0 AS others_min, round(max(b.mean), 6) + 0.0 AS others_max, count(b.unit) + 1 AS n_units FROM g a LEFT JOIN g b ON a.unit <> b.unit GROUP BY ALL""")
def against_others(spark, d):
    """Each unit's mean centroid and the least and greatest of all other units'; these come from the two outermost units of all."""
    g = featured(spark, d, "col_centroid").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg("col_centroid").alias("mean"), M.sd0("col_centroid").alias("sd"))
    ends = g.agg(F.min(F.struct("mean", "unit")).alias("lo"), F.max(F.struct("mean", "unit")).alias("hi"), F.count(F.lit(1)).alias("n_units"))
    one = g.join(F.broadcast(ends))  # one row
    inner = one.agg(F.min(F.when(F.col("unit") != F.col("lo.unit"), F.col("mean"))).alias("lo2"), F.max(F.when(F.col("unit") != F.col("hi.unit"), F.col("mean"))).alias("hi2"))
    both = one.join(F.broadcast(inner))
    return rounded(both.select("unit", "n", "mean", "sd", F.when(F.col("unit") == F.col("lo.unit"), F.col("lo2")).otherwise(F.col("lo.mean")).alias("others_min"), F.when(F.col("unit") == F.col("hi.unit"), F.col("hi2")).otherwise(F.col("hi.mean")).alias("others_max"), "n_units"))


@query("h3_random_validation", f"""WITH {FRAMES}, t AS (SELECT frame_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '11', frame_id)), frame_id) <= round_even(0.3 * count(*) OVER (), 0) THEN 'test' ELSE 'train' END AS side FROM frames),
w AS (SELECT frame_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '12', frame_id)), frame_id) <= round_even(0.15 * count(*) OVER (), 0) THEN 'val' ELSE 'train' END AS side FROM t WHERE side = 'train')
SELECT t.frame_id, coalesce(w.side, t.side) AS side FROM t LEFT JOIN w ON t.frame_id = w.frame_id""")
def random_validation(spark, d):
    """A random split whose train rows lose 15 % to validation."""
    from .frames import frames

    return P.validated(P.random_split(frames(spark, d).select("frame_id"), 0.3, 11), 0.15, 12, grouped=False)


@query("a6_manifest", r"""WITH f AS (SELECT lang || '/' || source AS folder, '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS place, count(*) OVER (PARTITION BY folder) AS n FROM f),
k AS (SELECT folder, n, unnest(list_distinct(list_transform(range(least(n, 60)), lambda j: CASE WHEN n <= 60 THEN j ELSE j * (n - 1) // 59 END))) AS place FROM (SELECT DISTINCT folder, n FROM o))
SELECT path, o.folder, CAST(o.place AS BIGINT) AS place, regexp_extract_all(path, '(\d+)', 1)[-1] AS last_int, length(text) AS n_chars FROM o JOIN k ON o.folder = k.folder AND o.place = k.place""")
def manifest(spark, d):
    """Sixty evenly spaced files of each folder, by path."""
    m = T.probe(files(spark, d).select("folder", "path", "content"), "folder", "path", 60)
    return m.select("path", "folder", F.col("place").cast("long").alias("place"), F.regexp_extract("path", r"(\d+)\D*$", 1).alias("last_int"), F.length("content").cast("long").alias("n_chars"))


WEIGHED = f"""WITH {EMB}, g AS (SELECT min(list_min(cells)) AS lo, max(list_max(cells)) AS hi FROM e),
i AS (SELECT frame_id, class, unit, 'plain' AS protocol, cells AS x FROM e UNION ALL SELECT frame_id, class, unit, 'input', list_transform(cells, lambda y: round_even((y - lo) / ((hi - lo) / 15), 0) * ((hi - lo) / 15) + lo) FROM e, g),
c AS (SELECT frame_id, class, unit, protocol, list_transform(x, lambda z: z - list_sum(x) / len(x)) AS c FROM i), rows AS (SELECT frame_id, class, unit, protocol, {UNIT.format('c.c')} AS v, {FOLD6} FROM c), {CV.split(",\npr AS")[0]},
cw AS (SELECT protocol, fold, y_pred, 'plain' AS weights, c FROM cu UNION ALL SELECT protocol, fold, y_pred, 'weights', list_transform(c, lambda x: round_even(x / mx * 7, 0) / 7 * mx) FROM (SELECT *, list_max(list_transform(c, lambda x: abs(x))) AS mx FROM cu)),
pw AS (SELECT protocol, weights, fold, frame_id, class, y_pred, row_number() OVER (PARTITION BY protocol, weights, frame_id ORDER BY list_inner_product(v, c) DESC, y_pred DESC) AS r FROM rows JOIN cw USING (protocol, fold))
SELECT protocol AS input, weights, count(*) AS n, round(avg(CAST(class = y_pred AS DOUBLE)), 6) + 0.0 AS accuracy FROM pw WHERE r = 1 GROUP BY ALL"""


@query("j11_axis_ablation", WEIGHED)
def axis_ablation(spark, d):
    """Accuracy with cells at 4 bits, with centroids at 4 bits (from minus to plus their largest weight), with both and with neither."""
    rows = protocol_rows(spark, d).where("protocol = 'grouped'").drop("protocol", "v").join(B.frames_from_embeddings(B.table(spark, d, "embeddings")).select("frame_id", "cells"), "frame_id")
    ends = rows.agg(F.min(F.array_min("cells")).alias("lo"), F.max(F.array_max("cells")).alias("hi"))
    x = F.col("cells")
    made = X.with_conditions(rows.join(F.broadcast(ends)), {"plain": A.unit(A.centre(x)), "input": A.unit(A.centre(A.quantise(x, 4, F.col("lo"), F.col("hi"))))}).drop("cells", "lo", "hi")
    plain = X.fold_centroids(made, ["condition"])

    def coarse(s):
        most = F.array_max(F.transform(s["c"], F.abs))
        return F.struct(s["name"].alias("name"), F.zip_with(s["c"], F.array_repeat(most, F.size(s["c"])), lambda w, m: F.rint(w / m * 7) / 7 * m).alias("c"))

    both = plain.withColumn("weights", F.lit("plain")).unionByName(plain.select("condition", "fold", F.transform("cs", coarse).alias("cs"), F.lit("weights").alias("weights")))
    return rounded(X.accuracy(X.predict(made, both, ["condition", "fold"]), ["condition", "weights"]).withColumnRenamed("condition", "input"))


@query("j16_reanalysis", f"""WITH {ACC}, q AS (SELECT condition, round(a, 4) AS v FROM acc), k AS (SELECT condition, avg(r) OVER (PARTITION BY v) AS rank FROM (SELECT condition, v, row_number() OVER (ORDER BY v) AS r FROM q)),
u AS (SELECT count(*) FILTER (WHERE condition = 'F') AS n1, count(*) FILTER (WHERE condition = 'O') AS n2, sum(rank) FILTER (WHERE condition = 'F') AS r1 FROM k)
SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) + 0.0 AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) + 0.0 AS z, b.observed, b.low, b.high, s.separation, s.separation > 0 AS fully_apart FROM u, ({ORACLES['i12_bootstrap']}) b, ({ORACLES['i19_separation']}) s""")
def reanalysis(spark, d):
    """Per-seed values of two conditions once more: rank statistic, bootstrapped gap, and whether all of one lie above the other."""
    runs = accuracies(spark, d)
    ranks = M.mann_whitney(runs.select("condition", F.round("a", 4).alias("v")), "condition", "F", "v")
    gap = M.bootstrap_mean_diff(runs.withColumn("k", F.col("fold") * 10 + F.col("seed")), "condition", "F", "a", "k", resamples=500)
    apart = M.separation(runs, "condition", "F", "O", "a")
    one = ranks.join(F.broadcast(gap)).join(F.broadcast(apart))  # one row each
    return rounded(one.select("n1", "n2", "u", "z", "observed", "low", "high", "separation", (F.col("separation") > 0).alias("fully_apart")))
