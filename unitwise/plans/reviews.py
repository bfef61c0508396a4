"""Queries on merged units, sides of folds, leave-one-out recall, quantiles of similarity, interactions and resumed work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import experiments as X
from ..operators import leakage as L
from ..operators import metrics as M
from ..operators import similar as SIM
from ..operators import splits as P
from ..operators.components import shared_folder, written
from ..operators.resume import resumed
from ..sources import bindings as B
from ..sources.tree import read_reports, write_report
from . import claims as K
from .experiments import ACC, DEALT, PRED, accuracies, documents_as_frames, predictions
from .frames import EMB, FRAMES, SAMPLED, UNITV, drawn, frames, vectors
from .registry import query, rounded
from .studies import COVER, _reduced

LEAST = 0.3

MERGES_SQL = f"""
{EMB},
m AS (SELECT class, unit, pos, avg(x) AS m FROM (SELECT class, unit, unnest(v) AS x, unnest(range(64)) AS pos FROM u) GROUP BY ALL),
c0 AS (SELECT class, unit, list(m ORDER BY pos) AS m FROM m GROUP BY ALL),
level AS (SELECT unit, median(list_max(cells) - list_median(cells)) AS level FROM e GROUP BY unit),
c AS (SELECT class, unit, level, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM c0 JOIN level USING (unit)),
edges AS (
  SELECT a.unit AS a, b.unit AS b, list_inner_product(a.c, b.c) AS similarity FROM c a JOIN c b ON a.class = b.class AND a.unit < b.unit
  WHERE list_inner_product(a.c, b.c) >= {LEAST} AND abs(a.level - b.level) <= 0.15 * greatest(1.0, abs(a.level))
)"""


def _unit_means(spark, d) -> DataFrame:
    v = vectors(spark, d).withColumn("range", F.array_max("cells") - A.median_of(F.col("cells")))
    return SIM.unit_means(v, ["class", "unit"], "v", "range")


@query("d6_merge_edges", f"WITH {MERGES_SQL} SELECT a, b, round(similarity, 6) + 0.0 AS similarity FROM edges")
def merge_edges(spark, d) -> DataFrame:
    """Pairs of units that mean vectors and levels both call the same."""
    return rounded(SIM.merge_edges(_unit_means(spark, d), "unit", "mean", "level", LEAST, block="class").select("a", "b", "similarity"))


@query("d6_merged_units", f"""WITH RECURSIVE {MERGES_SQL},
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(unit, seen) AS (SELECT unit, unit FROM c UNION SELECT reach.unit, sym.b FROM reach JOIN sym ON reach.seen = sym.a)
SELECT unit, min(seen) AS root FROM reach GROUP BY unit""")
def merged_units(spark, d) -> DataFrame:
    return SIM.merged_units(_unit_means(spark, d), "unit", "mean", "level", LEAST, block="class")


SIDES_SQL = f"""
{DEALT},
folds AS (SELECT class, unit, n, fold FROM w WHERE i > 0),
every AS (SELECT f.fold AS own, x.fold, s.seed, class, unit, n FROM folds f, (SELECT DISTINCT fold FROM folds) x, (SELECT unnest([0, 1, 2]) AS seed) s),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY fold, seed, class ORDER BY md5(concat_ws('|', seed, class, unit)), unit) AS r, count(*) OVER (PARTITION BY fold, seed, class) AS units
  FROM every WHERE own <> fold
), sides AS (
  SELECT fold, seed, class, unit, n, CASE WHEN r <= greatest(1, round_even(0.15 * units, 0)) THEN 'val' ELSE 'train' END AS side FROM pool
  UNION ALL SELECT fold, seed, class, unit, n, 'test' FROM every WHERE own = fold
)"""


@query("h6_unit_sides", f"WITH RECURSIVE {SIDES_SQL} SELECT fold, CAST(seed AS BIGINT) AS seed, class, unit, CAST(n AS BIGINT) AS n, side FROM sides")
def unit_sides(spark, d) -> DataFrame:
    """Train, validation and test units of every fold and seed."""
    return P.fold_sides(P.grouped_folds(documents_as_frames(spark, d), 5), [0, 1, 2])


@query("h6_random_sides", f"""WITH RECURSIVE {DEALT},
z AS (SELECT class, fold, sum(n) AS size FROM w WHERE i > 0 GROUP BY ALL),
q AS (SELECT class, fold, size, sum(size) OVER (PARTITION BY class ORDER BY fold) AS upto FROM z),
d AS (SELECT lang AS class, doc_id AS frame_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '3', doc_id)), doc_id) AS r FROM documents),
own AS (SELECT d.class, frame_id, fold AS own FROM d JOIN q ON d.class = q.class AND r <= upto AND r > upto - size),
every AS (SELECT own.*, f.fold, s.seed FROM own, (SELECT unnest(range(5)) AS fold) f, (SELECT unnest([0, 1]) AS seed) s),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY fold, seed ORDER BY md5(concat_ws('|', seed, frame_id)), frame_id) AS r, count(*) OVER (PARTITION BY fold, seed) AS n FROM every WHERE own <> fold
), sides AS (
  SELECT fold, seed, frame_id, CASE WHEN r <= round_even(0.15 * n, 0) THEN 'val' ELSE 'train' END AS side FROM pool UNION ALL SELECT fold, seed, frame_id, 'test' FROM every WHERE own = fold
)
SELECT fold, CAST(seed AS BIGINT) AS seed, side, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS ids FROM sides GROUP BY ALL""")
def random_sides(spark, d) -> DataFrame:
    """How many rows each side of a random fold holds, and the sum of their ids."""
    f = documents_as_frames(spark, d)
    folded = P.random_folds(f, P.grouped_folds(f, 5), 3).select("frame_id", "fold")
    sides = P.random_fold_sides(folded, [0, 1])
    return sides.groupBy("fold", "seed", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_id").alias("ids"))


@query("h7_standard_sides", f"""WITH RECURSIVE {SIDES_SQL}
SELECT CAST(seed AS BIGINT) AS seed, doc_id AS frame_id, side FROM documents JOIN sides ON lang = class AND concat_ws('/', lang, source) = unit WHERE fold = 0""")
def standard_sides(spark, d) -> DataFrame:
    return P.standard_sides(documents_as_frames(spark, d), [0, 1, 2]).select("seed", "frame_id", "side")


@query("h9_coverage_sides", f"""WITH {FRAMES},
f AS (SELECT frame_id, unit % 10 = 3 AS target, s.seed FROM frames, (SELECT unnest([0, 1]) AS seed) s),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY md5(concat_ws('|', seed, frame_id)), frame_id) AS r, count(*) OVER (PARTITION BY seed, target) AS n FROM f),
c AS (SELECT unnest(['held_out', 'half_in']) AS condition)
SELECT condition, CAST(seed AS BIGINT) AS seed, frame_id, CASE WHEN NOT target AND r <= floor(0.15 * n) THEN 'val' WHEN NOT target THEN 'train' WHEN r > floor(0.5 * n) THEN 'test' WHEN condition = 'half_in' THEN 'train' ELSE 'out' END AS side FROM r, c""")
def coverage_sides(spark, d) -> DataFrame:
    f = frames(spark, d).select("frame_id", F.pmod("unit", F.lit(10)).cast("string").alias("unit"))
    return P.coverage_sides(f, "3", [0, 1]).select("condition", "seed", "frame_id", "side")


UNITED = "list_transform({0}, lambda x: x / CASE WHEN list_inner_product({0}, {0}) > 0 THEN sqrt(list_inner_product({0}, {0})) ELSE 1 END)"
LOO_SQL = f"""
{EMB},
d AS (SELECT frame_id, class, unit, '1' AS factor, {_reduced(1)} AS x FROM e UNION ALL SELECT frame_id, class, unit, '4', {_reduced(4)} FROM e),
c AS (SELECT frame_id, class, unit, factor, list_transform(x, lambda y: y - list_sum(x) / len(x)) AS c FROM d),
rows AS (SELECT frame_id, class, unit, factor, seed, {UNITED.format('c.c')} AS v, {drawn("' || seed || '", 'frame_id').replace("'' || seed || ''", 'seed')} % 1000 >= 150 AS trains FROM c, (SELECT unnest([0, 1, 2]) AS seed)),
flat AS (SELECT factor, seed, class, unit, unnest(v) AS x, unnest(range(len(v))) AS pos FROM rows WHERE trains),
sums AS (SELECT factor, seed, class, unit, pos, sum(x) AS s, count(*) AS n FROM flat GROUP BY ALL),
total AS (SELECT factor, seed, class, pos, sum(s) AS s, sum(n) AS n FROM sums GROUP BY ALL),
units AS (SELECT DISTINCT factor, seed, unit FROM rows),
rest AS (
  SELECT factor, seed, k.unit, t.class, pos, (t.s - coalesce(o.s, 0)) / (t.n - coalesce(o.n, 0)) AS m FROM units k JOIN total t USING (factor, seed)
  LEFT JOIN sums o USING (factor, seed, unit, class, pos) WHERE t.n - coalesce(o.n, 0) > 0
), listed AS (SELECT factor, seed, unit, class, list(m ORDER BY pos) AS m FROM rest GROUP BY ALL),
cs AS (SELECT factor, seed, unit, class AS y_pred, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM listed),
pred AS (
  SELECT r.factor, r.seed, r.unit, r.class, y_pred, row_number() OVER (PARTITION BY r.factor, r.seed, frame_id ORDER BY list_inner_product(v, c) DESC, y_pred DESC) AS k
  FROM rows r JOIN cs USING (factor, seed, unit)
), recalls AS (SELECT unit, class, factor, seed, count(*) AS n, avg(CAST(class = y_pred AS DOUBLE)) AS recall FROM pred WHERE k = 1 GROUP BY ALL),
deltas AS (SELECT unit, class, round(avg(recall) FILTER (WHERE factor = '4') - avg(recall) FILTER (WHERE factor = '1'), 12) + 0.0 AS delta FROM recalls GROUP BY unit, class)"""


def _recalls(spark, d) -> DataFrame:
    e = B.frames_from_embeddings(B.table(spark, d, "embeddings"))
    reduced = X.with_conditions(e, {str(f): A.unit(A.centre(A.reduce_columns(F.col("cells"), 4, 16, f))) for f in (1, 4)}).drop("cells").withColumnRenamed("condition", "factor")
    return X.leave_one_out(reduced.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in (0, 1, 2)]))), "factor", "seed")


@query("j14_unit_recalls", f"WITH {LOO_SQL} SELECT unit, class, factor, CAST(seed AS BIGINT) AS seed, n, round(recall, 6) + 0.0 AS recall FROM recalls")
def unit_recalls(spark, d) -> DataFrame:
    """Recall of every unit left out of training, by factor and seed."""
    return rounded(_recalls(spark, d))


@query("j14_deltas", f"WITH {LOO_SQL} SELECT unit, class, round(delta, 6) + 0.0 AS delta FROM deltas")
def unit_deltas(spark, d) -> DataFrame:
    return rounded(X.deltas(_recalls(spark, d), "factor", "1", "4"))


@query("j14_delta_summary", f"""WITH {LOO_SQL},
g AS (SELECT count(*) AS n, avg(delta) AS mean, coalesce(stddev_samp(delta), 0) AS sd, count(*) FILTER (WHERE delta > 0) AS k FROM deltas),
t AS (SELECT i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS p, k FROM g, (SELECT unnest(range(0, 500)) AS i) WHERE i <= n),
p AS (SELECT sum(p) FILTER (WHERE i >= k) AS upper, sum(p) FILTER (WHERE i <= k) AS lower FROM t)
SELECT n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(mean / (sd / sqrt(n)), 6) + 0.0 AS t, k AS n_improved, round(upper, 6) + 0.0 AS p_one_sided, round(least(1.0, 2 * least(upper, lower)), 6) + 0.0 AS p_two_sided FROM g, p""")
def delta_summary(spark, d) -> DataFrame:
    """Whether the coarser input helps units left out: paired t and exact sign test over units."""
    return rounded(X.delta_summary(X.deltas(_recalls(spark, d), "factor", "1", "4")))


@query("f6_adjacent_against_random", f"""WITH {FRAMES}, {UNITV}, u AS (SELECT frame_id, v FROM uv), {SAMPLED.replace('range(2000)', 'range(4000)')},
a AS (SELECT list_inner_product(v, lag(v) OVER (PARTITION BY unit ORDER BY frame_idx, frame_id)) AS s FROM uv),
g AS (SELECT count(s) AS n_adjacent, avg(s) AS adjacent_mean, median(s) AS adjacent_median, avg(CAST(s > 0.9 AS DOUBLE)) AS share_high FROM a WHERE s IS NOT NULL),
r AS (SELECT count(*) AS n_random, avg(similarity) AS random_mean, median(similarity) AS random_median FROM sp)
SELECT n_adjacent, round(adjacent_mean, 6) + 0.0 AS adjacent_mean, round(adjacent_median, 6) + 0.0 AS adjacent_median, round(share_high, 6) + 0.0 AS share_high,
       n_random, round(random_mean, 6) + 0.0 AS random_mean, round(random_median, 6) + 0.0 AS random_median, round(adjacent_mean - random_mean, 6) + 0.0 AS gap FROM g, r""")
def adjacent_against_random(spark, d) -> DataFrame:
    v = frames(spark, d).select("unit", "frame_idx", "frame_id", A.unit(A.centre(F.col("cells"))).alias("v"))
    return rounded(L.adjacent_against_random(written(v), "unit", "frame_idx", "frame_id", "v"))


def _asked(tag: str, key: str) -> str:
    return f"CAST(('0x' || substr(md5('0{tag}|' || {key}), 1, 8)) AS BIGINT)"


@query("i17_within_above_across", f"""WITH {EMB},
pl AS (SELECT class, unit, v, row_number() OVER (PARTITION BY class, unit ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY class, unit) AS n FROM u),
k0 AS (SELECT class, unit, max(n) AS n FROM pl WHERE n > 1 GROUP BY ALL),
k1 AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY unit) - 1 AS no, count(*) OVER (PARTITION BY class) AS units FROM k0), k AS (SELECT * FROM k1 WHERE units > 1),
wa AS (SELECT class, unit, n, {_asked('wa', "class || '/' || unit || '/' || i")} % n AS pa, {_asked('wb', "class || '/' || unit || '/' || i")} % (n - 1) AS step FROM k, (SELECT unnest(range(100)) AS i)),
ws AS (SELECT wa.class, list_inner_product(x.v, y.v) AS s FROM wa JOIN pl x ON x.class = wa.class AND x.unit = wa.unit AND x.pos = pa JOIN pl y ON y.class = wa.class AND y.unit = wa.unit AND y.pos = (pa + 1 + step) % wa.n),
c0 AS (SELECT class, max(units) AS units FROM k GROUP BY class),
c1 AS (SELECT class, i, units, {_asked('ca', "class || '/' || i")} % units AS na, {_asked('cb', "class || '/' || i")} % (units - 1) AS step FROM c0, (SELECT unnest(range(6000)) AS i)),
c2 AS (
  SELECT c1.class, a.unit AS ua, b.unit AS ub, {_asked('ra', "c1.class || '/' || i")} % a.n AS pa, {_asked('rb', "c1.class || '/' || i")} % b.n AS pb
  FROM c1 JOIN k a ON a.class = c1.class AND a.no = na JOIN k b ON b.class = c1.class AND b.no = (na + 1 + step) % c1.units
), cs AS (SELECT c2.class, list_inner_product(x.v, y.v) AS s FROM c2 JOIN pl x ON x.class = c2.class AND x.unit = ua AND x.pos = pa JOIN pl y ON y.class = c2.class AND y.unit = ub AND y.pos = pb),
cl AS (SELECT class, avg(s) AS across, quantile_cont(s, 0.95) AS p95 FROM cs GROUP BY class)
SELECT class, round(avg(s), 6) + 0.0 AS within, round(max(across), 6) + 0.0 AS across, round(avg(s) - max(across), 6) + 0.0 AS gap, round(max(p95), 6) + 0.0 AS across_p95, round(avg(CAST(s > p95 AS DOUBLE)), 6) + 0.0 AS share_above
FROM ws JOIN cl USING (class) GROUP BY class""")
def within_above_across(spark, d) -> DataFrame:
    return rounded(L.within_above_across(written(vectors(spark, d).select("frame_id", "class", "unit", "v")), "frame_id", "v"))


@query("i13_interaction_interval", f"""WITH {PRED},
x AS (SELECT CAST(seed AS VARCHAR) AS cell, fold AS k, avg(CAST(y_true = y_pred AS INT)) AS v, CASE WHEN seed IN (0, 3) THEN 1.0 ELSE -1.0 END AS sign FROM pred WHERE seed < 4 GROUP BY ALL),
j AS (SELECT k, sum(v * sign) AS v FROM x GROUP BY k HAVING count(*) = 4),
vals AS (SELECT 'joint' AS cell, k, v, 1.0 AS sign FROM j UNION ALL SELECT cell, k, v, sign FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY cell) AS n FROM vals),
dr AS (SELECT b, p.cell, CAST(('0x' || substr(md5('0|' || b || '-' || p.cell || '-' || p.pos), 1, 8)) AS BIGINT) % n AS pos FROM p, (SELECT unnest(range(2000)) AS b)),
m AS (SELECT b, cell, avg(v) * max(sign) AS m FROM dr JOIN p USING (cell, pos) GROUP BY b, cell),
s AS (SELECT b, sum(m) FILTER (WHERE cell = 'joint') AS joint, sum(m) FILTER (WHERE cell <> 'joint') AS apart FROM m GROUP BY b),
q AS (SELECT sum(mm) AS point, sqrt(sum(vv)) AS se FROM (SELECT cell, avg(v) * max(sign) AS mm, var_samp(v) / count(*) AS vv FROM x GROUP BY cell)),
g AS (SELECT count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd FROM j)
SELECT n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(mean / (sd / sqrt(n)), 6) + 0.0 AS t,
       (SELECT round(quantile_cont(joint, 0.025), 6) + 0.0 FROM s) AS low, (SELECT round(quantile_cont(joint, 0.975), 6) + 0.0 FROM s) AS high,
       (SELECT round(quantile_cont(apart, 0.025), 6) + 0.0 FROM s) AS unpaired_low, (SELECT round(quantile_cont(apart, 0.975), 6) + 0.0 FROM s) AS unpaired_high, round(point / se, 6) + 0.0 AS unpaired_t FROM g, q""")
def interaction_interval(spark, d) -> DataFrame:
    """The interaction of two axes with its interval over seeds (here: folds), and the unpaired form for comparison."""
    a = predictions(spark, d).groupBy("fold", F.col("seed").cast("string").alias("seed")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a"))
    return rounded(M.interaction_interval(a, "fold", "seed", ("0", "1", "2", "3"), "a", resamples=2000))


@query("j9_resumed_coverage", f"""WITH {COVER} SELECT class, unit, n, round(held_out, 6) + 0.0 AS held_out, round(half_in, 6) + 0.0 AS half_in, round(half_in - held_out, 6) + 0.0 AS recovery, 2 * n < 40 AS few FROM g""")
def resumed_coverage(spark, d) -> DataFrame:
    """Coverage of every unit, written some units at a time; a run that stops goes on with the units that are missing. few: a unit of under 40 rows.

    A unit without rows in its second half has no coverage; it is kept as done, without values."""
    rows = written(vectors(spark, d).select("frame_id", "class", "unit", "v"))
    half = A.draw(8, F.col("frame_id"), 2) == 0
    work = lambda units: units.join(X.coverage(rows, half), "unit", "left")
    done = resumed(rows.select("unit").distinct(), f"{shared_folder(spark)}/coverage-{uuid.uuid4().hex[:12]}", work, at_once=40).where("held_out IS NOT NULL")
    return rounded(done.select("class", "unit", "n", "held_out", "half_in", "recovery", (2 * F.col("n") < 40).alias("few")))


@query("k_claims_of_files", f"""WITH {ACC}, v AS (SELECT 'mean.F' AS path, avg(a) FILTER (WHERE condition = 'F') AS got FROM acc UNION ALL SELECT 'mean.O', avg(a) FILTER (WHERE condition = 'O') FROM acc UNION ALL SELECT 'lowest', min(a) FROM acc),
c AS (SELECT * FROM (VALUES ('c1', 'accuracy', 'mean.F', 0.8, 0.1), ('c2', 'accuracy', 'mean.O', 0.5, 0.001), ('c3', 'accuracy', 'mean.Z', 0.5, 0.1), ('c4', 'absent', 'mean.F', 0.5, 0.1), ('c5', 'accuracy', 'lowest', 0.5, 0.5)) t(id, report, path, expect, tol))
SELECT c.id, CASE WHEN report = 'absent' THEN 'untested' WHEN got IS NULL THEN 'FAIL: no such value' WHEN abs(got - expect) <= tol + 1e-9 THEN 'ok' ELSE 'FAIL' END AS verdict FROM c LEFT JOIN v USING (path)""")
def claims_of_files(spark, d) -> DataFrame:
    """The claims against reports that stages wrote as JSON files and that are found by their candidate names."""
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex[:12]}"
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("a"))).alias(c)
    write_report(accuracies(spark, d).agg(F.struct(of("F"), of("O")).alias("mean"), F.min("a").alias("lowest")), folder, "accuracy_v2")
    reports = read_reports(spark, folder, {"accuracy": ["accuracy.json", "accuracy_v2.json"], "absent": ["absent.json"]})
    listed = spark.createDataFrame([("c1", "accuracy", "mean.F", 0.8, 0.1), ("c2", "accuracy", "mean.O", 0.5, 0.001), ("c3", "accuracy", "mean.Z", 0.5, 0.1), ("c4", "absent", "mean.F", 0.5, 0.1), ("c5", "accuracy", "lowest", 0.5, 0.5)], "id string, report string, path string, expect double, tol double")
    return K.check(listed, reports).select("id", "verdict")
