"""The comparison of protocols over folds and seeds: validation is drawn for each seed, so a fold's runs differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arms as R
from ..operators import metrics as M
from ..operators import splits as P
from ..operators.components import written
from .arms import JUDGED_SQL
from .frames import vectors
from .protocols import CLASSES, KFOLD, NAMES, TARGET, metrics
from .registry import query, rounded
from .studies import CV

SEEDS = [0, 1, 2]

SEEDED_SQL = (
    KFOLD[: KFOLD.index(CV)]
    + f"""
every AS (
  SELECT r.frame_id, r.class, r.unit, r.v, r.protocol, f.fold, s.seed, r.fold = f.fold AS test FROM rows r, (SELECT unnest(range(5)) AS fold) f, (SELECT unnest({SEEDS}) AS seed) s
),
pool_units AS (SELECT DISTINCT fold, seed, class, unit FROM every WHERE protocol = 'grouped' AND NOT test),
val_units AS (
  SELECT *, row_number() OVER (PARTITION BY fold, seed, class ORDER BY md5(concat_ws('|', seed, class, unit)), unit) AS r, count(*) OVER (PARTITION BY fold, seed, class) AS n FROM pool_units
),
val_rows AS (
  SELECT fold, seed, frame_id, row_number() OVER (PARTITION BY fold, seed ORDER BY md5(concat_ws('|', seed, frame_id)), frame_id) AS r, count(*) OVER (PARTITION BY fold, seed) AS n
  FROM every WHERE protocol = 'random' AND NOT test
),
sided AS (
  SELECT e.protocol || '/' || e.fold AS arm, e.seed, e.frame_id AS centre, e.class, e.v,
         CASE WHEN test THEN 'test' WHEN vu.r <= greatest(1, round_even(0.15 * vu.n, 0)) OR vr.r <= round_even(0.15 * vr.n, 0) THEN 'val' ELSE 'train' END AS side
  FROM every e
  LEFT JOIN val_units vu ON e.protocol = 'grouped' AND vu.fold = e.fold AND vu.seed = e.seed AND vu.class = e.class AND vu.unit = e.unit
  LEFT JOIN val_rows vr ON e.protocol = 'random' AND vr.fold = e.fold AND vr.seed = e.seed AND vr.frame_id = e.frame_id
),
{JUDGED_SQL.format('sided')},
counted AS (
  SELECT arm, seed, c, count(*) FILTER (WHERE class = c AND y_pred = c) AS hit, count(*) FILTER (WHERE class = c) AS support, count(*) FILTER (WHERE y_pred = c) AS said
  FROM (SELECT * FROM pred_sided WHERE k = 1), (SELECT unnest({CLASSES}) AS c) GROUP BY ALL
),
shares AS (SELECT *, hit / greatest(1, support) AS recall, hit / greatest(1, said) AS precision FROM counted),
scored AS (SELECT *, 2 * precision * recall / greatest(1e-9, precision + recall) AS f1 FROM shares),
named AS (
  SELECT split_part(arm, '/', 1) AS protocol, CAST(split_part(arm, '/', 2) AS BIGINT) AS fold, seed, sum(hit) / greatest(1, sum(support)) AS accuracy, avg(f1) AS macro_f1, avg(recall) AS macro_recall,
         max(f1) FILTER (WHERE c = '{TARGET}') AS target_f1, max(precision) FILTER (WHERE c = '{TARGET}') AS target_precision FROM scored GROUP BY arm, seed
),
long AS (SELECT protocol, fold, seed, unnest({list(NAMES)}) AS metric, unnest([{', '.join(NAMES)}]) AS value FROM named),
by_fold AS (SELECT protocol, metric, fold, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM long GROUP BY ALL)"""
)


def seeded_frames(spark, d) -> DataFrame:
    """(protocol, class, v, train, test): each frame once under grouped and random folds of one size, with the numbers of the runs
    (fold * seeds + seed's place) in which it trains and is tested."""
    v = written(vectors(spark, d).select("frame_id", "class", "unit", "v"))
    folds = written(P.grouped_folds(v, 5))
    run = (F.col("fold") * len(SEEDS) + F.array_position(F.array(*[F.lit(s).cast("long") for s in SEEDS]), F.col("seed")) - 1).cast("int")
    sides = [F.collect_list(F.when(F.col("side") == side, run)).alias(side) for side in ("train", "test")]
    grouped = v.join(P.fold_sides(folds, SEEDS).groupBy("class", "unit").agg(*sides), ["class", "unit"]).withColumn("protocol", F.lit("grouped"))
    own = P.random_folds(v.select("frame_id", "class"), folds, 3).select("frame_id", "fold")
    random = v.join(P.random_fold_sides(own, SEEDS).groupBy("frame_id").agg(*sides), "frame_id").withColumn("protocol", F.lit("random"))
    of = ["protocol", "class", "v", "train", "test"]
    return written(grouped.select(*of).unionByName(random.select(*of)))


def seeded_runs(spark, d) -> DataFrame:
    """(protocol, fold, seed, metric, value) of five metrics."""
    pred = R.judged_once(seeded_frames(spark, d), "protocol", 5 * len(SEEDS))
    seed = F.element_at(F.array(*[F.lit(s).cast("long") for s in SEEDS]), F.col("run") % len(SEEDS) + 1)
    pred = pred.select("protocol", F.floor(F.col("run") / len(SEEDS)).cast("long").alias("fold"), seed.alias("seed"), "class", "y_pred")
    runs = metrics(pred, ["protocol", "fold", "seed"])
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in NAMES]))
    return written(runs.select("protocol", "fold", "seed", named.alias("m")).select("protocol", "fold", "seed", "m.*"))


@query("j3_seeded_runs", f"{SEEDED_SQL} SELECT protocol, fold, CAST(seed AS BIGINT) AS seed, metric, round(value, 6) + 0.0 AS value FROM long")
def runs(spark, d) -> DataFrame:
    return rounded(seeded_runs(spark, d))


@query("j3_seeded_decomposition", f"""{SEEDED_SQL}
SELECT protocol, metric, round(avg(m), 6) + 0.0 AS mean, round(coalesce(stddev_samp(m), 0), 6) + 0.0 AS between_fold_sd, round(avg(s), 6) + 0.0 AS within_fold_sd, count(*) AS n_folds FROM by_fold GROUP BY protocol, metric""")
def decomposition(spark, d) -> DataFrame:
    """Each metric's mean, its deviation between folds, and that over seeds within folds, under both protocols."""
    return rounded(M.decompose(seeded_runs(spark, d), ["protocol", "metric"], "value"))


@query("j3_seeded_paired", f"""{SEEDED_SQL},
pair AS (SELECT metric, fold, max(m) FILTER (WHERE protocol = 'random') - max(m) FILTER (WHERE protocol = 'grouped') AS d FROM by_fold GROUP BY ALL),
tested AS (SELECT metric, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd, count(*) FILTER (WHERE d > 0) AS n_positive, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM pair GROUP BY metric)
SELECT metric, n, round(mean_diff, 6) + 0.0 AS mean_diff, round(sd, 6) + 0.0 AS sd, n_positive, round(t, 6) + 0.0 AS t, n - 1 AS df, 2.78::DOUBLE AS critical, coalesce(abs(t) > 2.78, false) AS significant FROM tested""")
def paired(spark, d) -> DataFrame:
    """What random folds add to each metric, paired by fold over means of seeds, against the critical value of four degrees of freedom."""
    return rounded(M.judged_t(M.paired(seeded_runs(spark, d), "fold", "protocol", "random", "grouped", "value", by=["metric"])))
