"""Whole experiments: protocols, normalisation, compression, coverage, arms; and reports made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import experiments as X
from ..operators import leakage as L
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators import similar as SIM
from ..operators.components import written
from ..sources import bindings as B
from ..streaming.triplets import remaining
from .experiments import PRED, files, predictions
from .frames import EMB, FRAMES, LINEAR, SAMPLED, SIDED, featured, frames, sided_turns, vectors
from .registry import query, r6, rounded

FOLDS = f"""{EMB}, rows AS (SELECT frame_id, class, unit, v, p AS protocol, CAST(('0x' || substr(md5(concat_ws('|', '6', CASE WHEN p = 'grouped' THEN unit ELSE CAST(frame_id AS VARCHAR) END)), 1, 8)) AS BIGINT) % 5 AS fold FROM u, (SELECT unnest(['grouped', 'random']) AS p))"""
CV = """fc AS (SELECT protocol, f.fold, class, pos, avg(x) AS m FROM (SELECT protocol, fold AS own, class, unnest(v) AS x, unnest(range(len(v))) AS pos FROM rows) r JOIN (SELECT DISTINCT protocol, fold FROM rows) f USING (protocol) WHERE r.own <> f.fold GROUP BY ALL),
ce AS (SELECT protocol, fold, class, list(m ORDER BY pos) AS m FROM fc GROUP BY ALL), cu AS (SELECT protocol, fold, class AS y_pred, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM ce),
pr AS (SELECT protocol, fold, frame_id, class, unit, y_pred, row_number() OVER (PARTITION BY protocol, frame_id ORDER BY list_inner_product(v, c) DESC, y_pred DESC) AS r FROM rows JOIN cu USING (protocol, fold)),
acc AS (SELECT protocol, fold, count(*) AS n, avg(CAST(class = y_pred AS DOUBLE)) AS accuracy FROM pr WHERE r = 1 GROUP BY ALL)"""


def protocol_rows(spark, d) -> DataFrame:
    v = vectors(spark, d).select("frame_id", "class", "unit", "v", F.explode(F.array(F.lit("grouped"), F.lit("random"))).alias("protocol"))
    return v.withColumn("fold", A.draw(6, F.when(F.col("protocol") == "grouped", F.col("unit")).otherwise(F.col("frame_id").cast("string")), 5))


@query("j3_protocol_folds", f"WITH {FOLDS}, {CV} SELECT protocol, fold, n, round(accuracy, 6) + 0.0 AS accuracy FROM acc")
def protocol_folds(spark, d):
    return rounded(X.accuracy(X.cross_validate(protocol_rows(spark, d), ["protocol"]), ["protocol", "fold"]))


@query("j3_protocol_paired", f"""WITH {FOLDS}, {CV}, p AS (SELECT fold, avg(accuracy) FILTER (WHERE protocol = 'random') - avg(accuracy) FILTER (WHERE protocol = 'grouped') AS d FROM acc GROUP BY fold)
SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean_diff, round(stddev_samp(d), 6) + 0.0 AS sd, count(*) FILTER (WHERE d > 0) AS n_positive, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) + 0.0 AS t FROM p""")
def protocol_paired(spark, d):
    acc = X.accuracy(X.cross_validate(protocol_rows(spark, d), ["protocol"]), ["protocol", "fold"])
    return rounded(M.paired(acc, "fold", "protocol", "random", "grouped", "accuracy"))


@query("j5_recall_against_headroom", f"""WITH {FOLDS}, {CV}, r AS (SELECT class, unit, avg(CAST(class = y_pred AS DOUBLE)) AS recall FROM pr WHERE r = 1 AND protocol = 'grouped' GROUP BY ALL),
h AS (SELECT unit, median(list_max(cells) - list_median(cells)) AS headroom FROM e GROUP BY unit)
SELECT count(*) AS n_units, round(corr(recall, headroom), 6) + 0.0 AS pearson, round(stddev_pop(recall), 6) + 0.0 AS recall_sd FROM r JOIN h USING (unit)""")
def recall_against_headroom(spark, d):
    pred = X.cross_validate(protocol_rows(spark, d).where("protocol = 'grouped'"), ["protocol"])
    recall = pred.groupBy("class", "unit").agg(F.avg((F.col("class") == F.col("y_pred")).cast("double")).alias("recall"))
    head = vectors(spark, d).groupBy("unit").agg(F.median(F.array_max("cells") - A.median_of(F.col("cells"))).alias("headroom"))
    return rounded(recall.join(head, "unit").agg(F.count(F.lit(1)).alias("n_units"), M.pearson(F.col("recall"), F.col("headroom")).alias("pearson"), F.stddev_pop("recall").alias("recall_sd")))


#: Lists x of rows made unit vectors v; with `centred`, their mean is taken off first.
UNIT = "list_transform({0}, lambda x: x / CASE WHEN list_inner_product({0}, {0}) > 0 THEN sqrt(list_inner_product({0}, {0})) ELSE 1 END)"
FOLD6 = "CAST(('0x' || substr(md5(concat_ws('|', '6', unit)), 1, 8)) AS BIGINT) % 5 AS fold"


@query("j4_normalisation", f"""WITH {EMB}, g AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest(cells) AS x FROM e)), b AS (SELECT *, list_max(cells) AS peak FROM e, g),
n AS (SELECT frame_id, class, unit, 'peak' AS protocol, list_transform(cells, lambda x: (x - peak) / 60) AS x FROM b UNION ALL SELECT frame_id, class, unit, 'offset', list_transform(cells, lambda x: (x + 60) / 60) FROM b
UNION ALL SELECT frame_id, class, unit, 'global', list_transform(cells, lambda x: (x - m) / (sd + 1e-6)) FROM b UNION ALL SELECT frame_id, class, unit, 'peak_level', list_concat(list_transform(cells, lambda x: (x - peak) / 60), list_transform(cells, lambda x: (peak + 60) / 60)) FROM b),
rows AS (SELECT frame_id, class, unit, protocol, {UNIT.format('n.x')} AS v, {FOLD6} FROM n), {CV} SELECT protocol AS condition, fold, n, round(accuracy, 6) + 0.0 AS accuracy FROM acc""")
def normalisation(spark, d):
    """Accuracy by scheme and grouped fold; the global scheme's mean and deviation come from per-frame sums."""
    rows = protocol_rows(spark, d).where("protocol = 'grouped'").drop("protocol", "v").join(B.frames_from_embeddings(B.table(spark, d, "embeddings")).select("frame_id", "cells"), "frame_id")
    x = F.col("cells")
    stats = rows.agg((F.sum(A.total(x)) / F.sum(F.size(x))).alias("m"), F.sqrt(F.sum(A.dot(x, x)) / F.sum(F.size(x)) - F.pow(F.sum(A.total(x)) / F.sum(F.size(x)), 2)).alias("sd"))
    made = X.with_conditions(rows.join(F.broadcast(stats)), {k: A.unit(A.normalise(x, k, F.col("m"), F.col("sd"))) for k in ("peak", "offset", "global", "peak_level")})
    return rounded(X.accuracy(X.cross_validate(made.drop("cells", "m", "sd"), ["condition"]), ["condition", "fold"]))


def _reduced(f: int) -> str:
    """SQL of cells (4 by 16) with f adjacent columns summed in linear power."""
    k = 16 // f
    return "cells" if f == 1 else f"list_transform(range({4 * k}), lambda i: 10 * log10(greatest(list_sum(list_transform(range({f}), lambda j: pow(10, cells[(i // {k}) * 16 + (i % {k}) * {f} + j + 1] / 10))), 1e-30)))"


@query("j10_compression_grid", f"""WITH {EMB}, d AS ({' UNION ALL '.join(f"SELECT frame_id, class, unit, '{f}' AS factor, {_reduced(f)} AS x FROM e" for f in (1, 2, 4))}),
b AS (SELECT factor, min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM d GROUP BY factor), k AS (SELECT unnest([4, 8, 32]) AS bits),
q AS (SELECT d.*, bits, CASE WHEN bits = 32 THEN x ELSE list_transform(x, lambda y: round_even((least(greatest(y, lo), hi) - lo) / ((hi - lo) / (pow(2, bits) - 1)), 0) * ((hi - lo) / (pow(2, bits) - 1)) + lo) END AS y FROM d JOIN b USING (factor), k),
c AS (SELECT frame_id, class, unit, factor || '-' || bits AS protocol, list_transform(y, lambda x: x - list_sum(y) / len(y)) AS c FROM q),
rows AS (SELECT frame_id, class, unit, protocol, {UNIT.format('c.c')} AS v, {FOLD6} FROM c), {CV} SELECT split_part(protocol, '-', 1) AS factor, split_part(protocol, '-', 2) AS bits, fold, n, round(accuracy, 6) + 0.0 AS accuracy FROM acc""")
def compression_grid(spark, d):
    """Accuracy by column factor and bits; each factor's range is taken over all its reduced cells."""
    return rounded(X.accuracy(X.cross_validate(compression_rows(spark, d), ["factor", "bits"]), ["factor", "bits", "fold"]))


def compression_rows(spark, d) -> DataFrame:
    """Frames with grouped folds under every factor and number of bits, as unit vectors."""
    rows = protocol_rows(spark, d).where("protocol = 'grouped'").drop("protocol", "v").join(B.frames_from_embeddings(B.table(spark, d, "embeddings")).select("frame_id", "cells"), "frame_id")
    reduced = X.with_conditions(rows, {str(f): A.reduce_columns(F.col("cells"), 4, 16, f) for f in (1, 2, 4)}).drop("cells").withColumnsRenamed({"condition": "factor", "v": "cells"})
    bounds = reduced.groupBy("factor").agg(F.min(F.array_min("cells")).alias("lo"), F.max(F.array_max("cells")).alias("hi"))
    ranged = reduced.join(F.broadcast(bounds), "factor")
    made = X.with_conditions(ranged, {str(b): A.unit(A.centre(A.quantise(F.col("cells"), b, F.col("lo"), F.col("hi")))) for b in (4, 8, 32)}).drop("cells", "lo", "hi").withColumnRenamed("condition", "bits")
    return made


HALF = "('0x' || substr(md5(concat_ws('|', '8', frame_id)), 1, 8))::BIGINT % 2 = 0"


COVER = f"""{EMB}, s AS (SELECT frame_id, class, unit, v, {HALF} AS half FROM u), x AS (SELECT frame_id, class, unit, half, unnest(v) AS x, unnest(range(64)) AS pos FROM s),
k AS (SELECT unit, c AS condition FROM (SELECT DISTINCT unit FROM u), (SELECT unnest(['held_out', 'half_in']) AS c)),
m AS (SELECT k.unit, condition, class, pos, avg(x) AS m FROM k JOIN x ON x.unit <> k.unit OR (condition = 'half_in' AND half) GROUP BY ALL),
c0 AS (SELECT unit, condition, class AS y_pred, list(m ORDER BY pos) AS m FROM m GROUP BY ALL), c1 AS (SELECT unit, condition, y_pred, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM c0),
p AS (SELECT s.class, s.unit, condition, frame_id, y_pred, row_number() OVER (PARTITION BY condition, frame_id ORDER BY list_inner_product(v, c) DESC, y_pred DESC) AS r FROM s JOIN c1 USING (unit) WHERE NOT half),
g AS (SELECT class, unit, count(*) // 2 AS n, avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE condition = 'held_out') AS held_out, avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE condition = 'half_in') AS half_in FROM p WHERE r = 1 GROUP BY ALL)"""


@query("j9_coverage", f"WITH {COVER} SELECT class, unit, n, round(held_out, 6) + 0.0 AS held_out, round(half_in, 6) + 0.0 AS half_in, round(half_in - held_out, 6) + 0.0 AS recovery FROM g")
def coverage(spark, d):
    return rounded(X.coverage(vectors(spark, d).select("frame_id", "class", "unit", "v"), A.draw(8, F.col("frame_id"), 2) == 0))


@query("i16_recovery_summary", f"""WITH {COVER}, d AS (SELECT class, held_out, half_in - held_out AS recovery FROM g)
SELECT class, count(*) AS n_units, round(median(recovery), 6) + 0.0 AS median, round(avg(recovery), 6) + 0.0 AS mean, round(coalesce(stddev_samp(recovery), 0), 6) + 0.0 AS sd, round(max(recovery), 6) + 0.0 AS most,
CASE WHEN stddev_pop(held_out) > 0 AND stddev_pop(recovery) > 0 THEN round(corr(held_out, recovery), 6) + 0.0 END AS pearson FROM d GROUP BY class""")
def recovery_summary(spark, d):
    c = X.coverage(vectors(spark, d).select("frame_id", "class", "unit", "v"), A.draw(8, F.col("frame_id"), 2) == 0)
    g = c.groupBy("class").agg(F.count(F.lit(1)).alias("n_units"), F.median("recovery").alias("median"), F.avg("recovery").alias("mean"), M.sd0("recovery").alias("sd"), F.max("recovery").alias("most"), M.pearson(F.col("held_out"), F.col("recovery")).alias("pearson"))
    return rounded(g)


@query("j15_arms", f"""WITH f AS (SELECT conv_id, conv_id * 100 + turn AS id, turn, length(text) AS x FROM conversations), w AS (SELECT *, lag(x) OVER k AS b, lead(x) OVER k AS a, lag(turn) OVER k AS bt, lead(turn) OVER k AS at_ FROM f WINDOW k AS (PARTITION BY conv_id ORDER BY turn, id))
SELECT id AS centre, x AS single, b AS before, a AS after FROM w WHERE bt = turn - 1 AND at_ = turn + 1""")
def arms(spark, d):
    """Channels of the consecutive-frame arm (before, centre, after), joined from ids last."""
    f = B.table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", F.length("text").cast("long").alias("x"))
    t = S.triplets(f, "conv_id", "turn", "id")
    x = lambda k, name: f.select(F.col("id").alias(k), F.col("x").alias(name))
    return t.join(x("before", "b"), "before").join(x("centre", "single"), "centre").join(x("after", "a"), "after").select("centre", "single", F.col("b").alias("before"), F.col("a").alias("after"))


@query("f5_clean_overlap", f"""WITH {SIDED}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, id) AS pos FROM sided),
c AS (SELECT a.id AS centre, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.pos - b.pos), b.pos) AS r FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.side = b.side AND a.id <> b.id WHERE a.side = 'train'),
w AS (SELECT id AS centre, id AS other FROM p WHERE side = 'train' UNION ALL SELECT centre, other FROM c WHERE r <= 2), h AS (SELECT centre, other FROM w JOIN sided ON other = id WHERE sided.side = 'test')
SELECT (SELECT count(DISTINCT centre) FROM h) AS n_touching, (SELECT count(DISTINCT other) FROM h) AS n_reached, (SELECT count(*) FROM p WHERE side = 'train') AS n_train""")
def clean_overlap(spark, d):
    """The clean arm never reaches a test frame from a training window."""
    turns = sided_turns(spark, d)
    c = S.clean_companions(turns, "conv_id", "turn", "id", "side").withColumnRenamed("id", "centre")
    return S.overlap(c, turns, "id", ["first", "second"]).select("n_touching", "n_reached", "n_train")


def _gap_of_top(k: int) -> str:
    """SQL of the leakage gap where all but the k largest cells are dropped."""
    return f"""(WITH t AS (SELECT class, unit, frame_id, cells, list_max(cells) AS peak, list_transform(list_sort(list_transform(cells, lambda x, i: {{'v': -x, 'i': i}}))[1:{k}], lambda s: s.i) AS k FROM e),
r AS (SELECT class, unit, frame_id, list_transform(cells, lambda x, i: CASE WHEN list_contains(k, i) THEN x - peak ELSE 0.0 END) AS r FROM t), c AS (SELECT class, unit, frame_id, list_transform(r, lambda x: x - list_sum(r) / len(r)) AS c FROM r),
x0 AS (SELECT class, unit, frame_id, list_transform(c, lambda x: x / CASE WHEN list_inner_product(c, c) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END) AS v FROM c),
k AS (SELECT class, unit FROM x0 GROUP BY ALL HAVING count(*) > 1), x AS (SELECT x0.* FROM x0 JOIN k USING (class, unit)), m AS (SELECT class, count(*) AS n_units FROM k GROUP BY class HAVING count(*) > 1),
p AS (SELECT a.class, a.unit = b.unit AS same, list_inner_product(a.v, b.v) AS s FROM x a JOIN x b ON a.class = b.class AND a.frame_id <> b.frame_id)
SELECT class, any_value(n_units) AS n_units, round(avg(s) FILTER (WHERE same), 6) + 0.0 AS within, round(avg(s) FILTER (WHERE NOT same), 6) + 0.0 AS across,
round(avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same), 6) + 0.0 AS gap, CAST({k} AS BIGINT) AS top_k FROM p JOIN m USING (class) GROUP BY class)"""


@query("i18_leakage_by_top_k", f"WITH {EMB} " + " UNION ALL ".join(map(_gap_of_top, (6, 12, 24))))
def leakage_by_top_k(spark, d):
    v = vectors(spark, d).drop("v")
    out = None
    for k in (6, 12, 24):
        one = L.gap(v.withColumn("v", A.top_cells(F.col("cells"), k)), "v").withColumn("top_k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("e15_leakage_verdict", f"""WITH {EMB}, k AS (SELECT class, unit FROM u GROUP BY ALL HAVING count(*) > 1), x AS (SELECT u.* FROM u JOIN k USING (class, unit)), c AS (SELECT class FROM k GROUP BY class HAVING count(*) > 1),
p AS (SELECT a.class, a.unit = b.unit AS same, list_inner_product(a.v, b.v) AS s FROM x a JOIN x b ON a.class = b.class AND a.frame_id <> b.frame_id JOIN c ON c.class = a.class),
g AS (SELECT class, avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same) AS gap FROM p GROUP BY class)
SELECT count(*) AS n_classes, round(max(gap), 6) + 0.0 AS largest_gap, max(gap) > 0.1 AS leaks FROM g""")
def leakage_verdict(spark, d):
    g = L.gap(vectors(spark, d), "v")
    return g.agg(F.count(F.lit(1)).alias("n_classes"), r6(F.max("gap")).alias("largest_gap"), (F.max("gap") > 0.1).alias("leaks"))


@query("c15_dynamic_range", f"""WITH {FRAMES}, x AS (SELECT unnest(cells) AS x FROM frames), b AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS sd FROM x)
SELECT round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round((SELECT count(*) FILTER (WHERE abs(x - lo) <= 1e-8 + 1e-5 * abs(lo)) / count(*) FROM x), 6) + 0.0 AS at_floor, (SELECT count(DISTINCT round(x, 6)) FROM x) AS n_distinct FROM b""")
def dynamic_range(spark, d):
    """Range, spread, share of cells at the floor, and distinct values over all cells, from the distinct values and how often each occurs.

    Frames are walked once; a frame sends its few distinct values, not its cells."""
    v, n = F.col("v.value"), F.col("v.n")
    x = written(frames(spark, d).select(F.explode(A.values(F.col("cells"))).alias("v")).groupBy(v.alias("x")).agg(F.sum(n).alias("n")))
    s = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("q"), F.countDistinct(F.round("x", 6)).alias("n_distinct"))
    s = s.select("lo", "hi", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("sd"), "n_distinct")
    floor = x.join(F.broadcast(s.select("lo"))).where(F.abs(F.col("x") - F.col("lo")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("lo")).agg(F.sum("n").alias("c"))
    return rounded(s.join(floor).select("lo", "hi", "mean", "sd", (F.col("c") / F.col("n")).alias("at_floor"), "n_distinct"))


@query("c18_column_profile", f"""WITH {FRAMES}, {LINEAR}, p AS (SELECT unit % 10 AS g, frame_id, c, list_sum(list_transform(range(5), lambda r: linear[r * 24 + c + 1])) AS s FROM lin, (SELECT unnest(range(24)) AS c)),
n AS (SELECT g, c, avg(s / mx) AS m FROM (SELECT *, max(s) OVER (PARTITION BY frame_id) AS mx FROM p) GROUP BY ALL), z AS (SELECT g, c, m - min(m) OVER (PARTITION BY g) AS m FROM n)
SELECT g, c AS col, round(m / max(m) OVER (PARTITION BY g), 6) + 0.0 AS profile FROM z""")
def column_profile(spark, d):
    """Mean over frames of each frame's column sums, scaled to 1 per frame first, then shifted to 0 and scaled to 1."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(B.COLS - 1)), lambda c: sum((F.get("l", c + r * B.COLS) for r in range(B.ROWS)), F.lit(0.0)))
    p = frames(spark, d).select(F.pmod("unit", F.lit(10)).alias("g"), A.peak_relative(F.col("cells")).alias("l")).select("g", sums.alias("s"))
    flat = p.select("g", F.posexplode(F.zip_with("s", F.array_repeat(F.array_max("s"), F.size("s")), lambda x, m: x / m)).alias("col", "x")).groupBy("g", "col").agg(F.avg("x").alias("m"))
    w = Window.partitionBy("g")
    z = flat.withColumn("m", F.col("m") - F.min("m").over(w))
    return rounded(z.select("g", "col", (F.col("m") / F.max("m").over(w)).alias("profile")))


@query("c20_colour_bounds", f"""WITH {FRAMES}, x AS (SELECT unit % 10 AS g, unnest(cells) AS x FROM frames), q AS (SELECT g, quantile_cont(x, 0.02) AS lo, max(x) AS hi FROM x GROUP BY g)
SELECT round(min(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi FROM q""")
def colour_bounds(spark, d):
    x = frames(spark, d).select(F.pmod("unit", F.lit(10)).alias("g"), F.explode("cells").alias("x"))
    return rounded(x.groupBy("g").agg(F.percentile("x", 0.02).alias("lo"), F.max("x").alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


@query("f7_orderings", f"""WITH {EMB}, o AS (SELECT frame_id, v, o, CASE o WHEN 'number' THEN lpad(CAST(frame_id AS VARCHAR), 12, '0') WHEN 'text' THEN CAST(frame_id AS VARCHAR) ELSE class || lpad(CAST(frame_id AS VARCHAR), 12, '0') END AS k FROM u, (SELECT unnest(['number', 'text', 'class']) AS o)),
a AS (SELECT o, list_inner_product(v, lag(v) OVER (PARTITION BY o ORDER BY k)) AS s FROM o)
SELECT o AS ordering, round(avg(s), 6) + 0.0 AS adjacent FROM a GROUP BY o""")
def orderings(spark, d):
    """Mean similarity of neighbours under several orders; ranges of each order are dealt to tasks, the rows at their ends carried over."""
    pad = F.lpad(F.col("frame_id").cast("string"), 12, "0")
    made = F.array(*[F.struct(F.lit(n).alias("ordering"), k.alias("k")) for n, k in (("number", pad), ("text", F.col("frame_id").cast("string")), ("class", F.concat("class", pad)))])
    rows = vectors(spark, d).select("v", F.explode(made).alias("x")).select("v", "x.*")
    near = S.with_before(rows, "ordering", "k", "v")
    return rounded(near.select("ordering", A.dot(F.col("v"), F.col("before")).alias("s")).groupBy("ordering").agg(F.avg("s").alias("adjacent")))


@query("g8_largest_folder", """WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source DESC) AS r FROM g) SELECT lang, source, n FROM r WHERE r = 1""")
def largest_folder(spark, d):
    g = B.table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("lang").agg(F.max(F.struct("n", "source")).alias("x")).select("lang", "x.source", "x.n")


@query("e9_class_medians", f"WITH {EMB} SELECT class, count(*) AS n, round(median(list_max(cells)), 6) + 0.0 AS peak, round(median(list_max(cells) - list_min(cells)), 6) + 0.0 AS span FROM e GROUP BY class")
def class_medians(spark, d):
    return rounded(vectors(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.median(F.array_max("cells")).alias("peak"), F.median(F.array_max("cells") - F.array_min("cells")).alias("span")))


@query("e19_worst_units", f"""WITH {PRED}, u AS (SELECT unit, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall FROM pred GROUP BY unit) SELECT unit, n, round(recall, 6) + 0.0 AS recall FROM u ORDER BY u.recall, unit LIMIT 52""")
def worst_units(spark, d):
    g = predictions(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return rounded(g.orderBy("recall", "unit").limit(52))


@query("a10_remaining_units", "SELECT DISTINCT l_suppkey AS unit FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 5000 = 0)")
def remaining_units(spark, d):
    p = predictions(spark, d)
    return remaining(p.select("unit").distinct(), p.where("frame_id div 10 % 5000 = 0"))


@query("a11_shapes", """SELECT lang || '/' || source AS folder, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, count(*) AS n FROM documents GROUP BY ALL""")
def shapes(spark, d):
    return files(spark, d).groupBy("folder", F.size(F.split("content", "\n")).cast("long").alias("n_lines")).agg(F.count(F.lit(1)).alias("n"))


@query("d6_similar_units", f"""WITH {EMB}, m AS (SELECT class, unit, pos, avg(x) AS m FROM (SELECT class, unit, unnest(v) AS x, unnest(range(64)) AS pos FROM u) GROUP BY ALL), c0 AS (SELECT class, unit, list(m ORDER BY pos) AS m FROM m GROUP BY ALL),
c AS (SELECT class, unit, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM c0)
SELECT a.unit AS a, b.unit AS b, round(list_inner_product(a.c, b.c), 6) + 0.0 AS similarity FROM c a JOIN c b ON a.class = b.class AND a.unit < b.unit WHERE list_inner_product(a.c, b.c) > 0.3""")
def similar_units(spark, d):
    means = L.vector_mean(vectors(spark, d), ["class", "unit"], "v").withColumn("c", A.unit(F.col("mean")))
    return rounded(SIM.similarity_pairs(means, "unit", "c", 0.3, block="class"))


@query("j17_centroid_scatter", f"WITH {FRAMES}, {LINEAR} SELECT unit, round(avg(col_centroid), 6) + 0.0 AS mean, round(stddev_pop(col_centroid), 6) + 0.0 AS sd, unit % 10 = 3 AS target FROM feat GROUP BY unit")
def centroid_scatter(spark, d):
    return rounded(featured(spark, d, "col_centroid").groupBy("unit").agg(F.avg("col_centroid").alias("mean"), F.stddev_pop("col_centroid").alias("sd"))).withColumn("target", F.pmod("unit", F.lit(10)) == 3)


@query("b10_field_kinds", r"""WITH f AS (SELECT unnest(regexp_extract_all(url, '(\d+)', 1)) AS v, unnest(range(len(regexp_extract_all(url, '(\d+)', 1)))) AS i FROM pages), c AS (SELECT i, CAST(v AS BIGINT) AS v, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT i, count(*) AS d, max(v) - min(v) + 1 = count(*) AS contiguous, median(n) AS m FROM c GROUP BY i)
SELECT i AS field, CASE WHEN d = 1 THEN 'constant' WHEN d <= 30 AND m > 20 THEN 'group' WHEN contiguous AND m <= 1.5 THEN 'counter' ELSE 'other' END AS kind FROM g""")
def field_kinds(spark, d):
    """What each integer field of a name looks like: constant, a group (few values, each often), a running counter, or other."""
    from .experiments import fields

    g = fields(spark, d)
    kind = F.when(F.col("n_distinct") == 1, "constant").when((F.col("n_distinct") <= 30) & (F.col("median_count") > 20), "group").when(F.col("contiguous") & (F.col("median_count") <= 1.5), "counter").otherwise("other")
    return g.select("field", kind.alias("kind"))


@query("c14_energy_share", f"""WITH {FRAMES}, {LINEAR}, o AS (SELECT unit, frame_id, list_reverse_sort(linear) AS o FROM lin)
SELECT unit, round(median(list_sum(o[1:6]) / list_sum(o)), 6) + 0.0 AS top_5, round(median(list_sum(o[1:12]) / list_sum(o)), 6) + 0.0 AS top_10 FROM o GROUP BY unit""")
def energy_share(spark, d):
    """Median share of linear power in the strongest 5 and 10 percent of cells."""
    share = lambda k: A.let(lambda s: A.total(F.slice(s["o"], 1, k)) / A.total(s["o"]), o=F.sort_array(A.peak_relative(F.col("cells")), asc=False))
    return rounded(frames(spark, d).select("unit", share(6).alias("a"), share(12).alias("b")).groupBy("unit").agg(F.median("a").alias("top_5"), F.median("b").alias("top_10")))


@query("e5_units_by_class", """WITH u AS (SELECT lang AS class, source AS unit, count(DISTINCT doc_id % 3) AS folders FROM documents GROUP BY ALL)
SELECT class, count(*) AS n_units, CAST(sum(folders) AS BIGINT) AS n_folders, count(*) FILTER (WHERE folders > 1) AS n_multi FROM u GROUP BY class""")
def units_by_class(spark, d):
    u = B.table(spark, d, "documents").groupBy(F.col("lang").alias("class"), F.col("source").alias("unit")).agg(F.countDistinct(F.pmod("doc_id", F.lit(3))).alias("folders"))
    return u.groupBy("class").agg(F.count(F.lit(1)).alias("n_units"), F.sum("folders").alias("n_folders"), F.count_if(F.col("folders") > 1).alias("n_multi"))


@query("f8_adaptive_threshold", f"""WITH {EMB}, {SAMPLED}, a AS (SELECT list_inner_product(v, lag(v) OVER (PARTITION BY class ORDER BY frame_id)) AS s FROM u), m AS (SELECT (SELECT median(s) FROM a) AS adjacent, (SELECT median(similarity) FROM sp) AS random)
SELECT round(adjacent, 6) + 0.0 AS adjacent, round(random, 6) + 0.0 AS random, round(random + 0.5 * (adjacent - random), 6) + 0.0 AS threshold FROM m""")
def adaptive_threshold(spark, d):
    """Random median plus half its distance to the median of neighbours."""
    v = vectors(spark, d)
    near = S.with_before(v.select("class", "frame_id", "v"), "class", "frame_id", "v").agg(F.median(A.dot(F.col("v"), F.col("before"))).alias("adjacent"))
    random = L.sampled_pairs(v, "frame_id", "v", 2000).agg(F.median("similarity").alias("random"))
    return rounded(near.join(random).select("adjacent", "random", (F.col("random") + 0.5 * (F.col("adjacent") - F.col("random"))).alias("threshold")))


@query("h3_validation_carve", f"""WITH {FRAMES}, k AS (SELECT DISTINCT CAST(unit % 3 AS VARCHAR) AS class, unit FROM frames), t AS (SELECT class, unit, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '11', class, unit)), unit) <= greatest(1, round_even(0.3 * count(*) OVER (PARTITION BY class), 0)) THEN 'test' ELSE 'train' END AS side FROM k),
w AS (SELECT class, unit, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '12', class, unit)), unit) <= greatest(1, round_even(0.15 * count(*) OVER (PARTITION BY class), 0)) THEN 'val' ELSE 'train' END AS side FROM t WHERE side = 'train')
SELECT frame_id, coalesce(w.side, t.side) AS side FROM frames JOIN t USING (unit) LEFT JOIN w ON w.unit = t.unit""")
def validation_carve(spark, d):
    """Of the train side of a grouped split, 15 % of each class's units become validation."""
    from ..operators import splits as P

    f = frames(spark, d).select("frame_id", "unit", F.pmod("unit", F.lit(3)).cast("string").alias("class"))
    s = P.grouped_split(f, 0.3, 11)
    carved = P.grouped_split(s.where("side = 'train'").drop("side"), 0.15, 12).withColumn("side", F.when(F.col("side") == "test", "val").otherwise("train"))
    return carved.select("frame_id", "side").unionByName(s.where("side = 'test'").select("frame_id", "side"))


@query("h6_fold_sides", f"""WITH {FOLDS} SELECT frame_id, f.fold, CASE WHEN rows.fold = f.fold THEN 'test' ELSE 'train' END AS side FROM rows, (SELECT unnest(range(5)) AS fold) f WHERE protocol = 'grouped'""")
def fold_sides(spark, d):
    rows = protocol_rows(spark, d).where("protocol = 'grouped'").select("frame_id", F.col("fold").alias("own"))
    sides = rows.select("frame_id", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold"))
    return sides.select("frame_id", "fold", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("side"))


@query("i14_additive_excess", f"""WITH {PRED}, a AS (SELECT seed, avg(CAST(y_true = y_pred AS DOUBLE)) AS a FROM pred GROUP BY seed), d AS (SELECT max(a) FILTER (WHERE seed = 0) - max(a) FILTER (WHERE seed = 1) AS x, max(a) FILTER (WHERE seed = 0) - max(a) FILTER (WHERE seed = 2) AS y, max(a) FILTER (WHERE seed = 0) - max(a) FILTER (WHERE seed = 3) AS z FROM a)
SELECT round(x, 6) + 0.0 AS input_drop, round(y, 6) + 0.0 AS weights_drop, round(z, 6) + 0.0 AS joint_drop, round(z - x - y, 6) + 0.0 AS excess, z > 1.8 * (x + y) AS more_than_additive FROM d""")
def additive_excess(spark, d):
    """Drops of two axes alone and jointly, and whether the joint drop passes 1.8 times their sum."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    a = predictions(spark, d).groupBy("seed").agg(F.avg(right).alias("a"))
    at = lambda s: F.max(F.when(F.col("seed") == s, F.col("a")))
    g = a.agg((at(0) - at(1)).alias("input_drop"), (at(0) - at(2)).alias("weights_drop"), (at(0) - at(3)).alias("joint_drop"))
    both = F.col("input_drop") + F.col("weights_drop")
    return rounded(g.select("*", (F.col("joint_drop") - both).alias("excess"), (F.col("joint_drop") > 1.8 * both).alias("more_than_additive")))


@query("j7_label_check", f"""WITH {EMB}, m AS (SELECT class, pos, avg(x) AS m FROM (SELECT class, unnest(v) AS x, unnest(range(64)) AS pos FROM u WHERE NOT unit LIKE '%/3') GROUP BY ALL),
c0 AS (SELECT class, list(m ORDER BY pos) AS m FROM m GROUP BY class), c AS (SELECT class AS nearest, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM c0),
s AS (SELECT frame_id, nearest, list_inner_product(v, c) AS sim FROM u, c WHERE unit LIKE '%/3'), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY sim DESC, nearest) AS r FROM s)
SELECT nearest, count(*) AS n, round(avg(sim), 6) + 0.0 AS similarity FROM r WHERE r = 1 GROUP BY nearest""")
def label_check(spark, d):
    """By class: how near a target unit's frames are to each class's centroid, the target left out of the centroids."""
    v = vectors(spark, d)
    target = F.col("unit").endswith("/3")
    return rounded(L.nearest_centroid(v.where(target), L.vector_mean(v.where(~target), ["class"], "v").withColumnRenamed("class", "name"), "frame_id", "v").groupBy("nearest").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("similarity")))


@query("j13_shift_augmentation", f"""WITH {EMB}, s AS (SELECT unnest([0, 1, 2, 4]) AS protocol), b AS (SELECT *, list_median(cells) AS med, {FOLD6} FROM e, s),
y AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', 'shift' || protocol, frame_id)), 1, 8)) AS BIGINT) % (2 * protocol + 1) - protocol AS step FROM b),
m AS (SELECT frame_id, class, unit, protocol, fold, false AS moved, cells AS x FROM y UNION ALL SELECT frame_id, class, unit, protocol, fold, true, list_transform(range(64), lambda i: CASE WHEN i % 16 - step BETWEEN 0 AND 15 THEN cells[i - step + 1] ELSE med END) FROM y WHERE protocol > 0),
c AS (SELECT *, list_transform(x, lambda z: z - list_sum(x) / len(x)) AS c FROM m), copies AS (SELECT frame_id, class, unit, protocol, fold, moved, {UNIT.format('c.c')} AS v FROM c), rows AS (SELECT * FROM copies WHERE NOT moved),
{CV.replace('AS pos FROM rows)', 'AS pos FROM copies)')} SELECT CAST(protocol AS BIGINT) AS shift, fold, n, round(accuracy, 6) + 0.0 AS accuracy FROM acc""")
def shift_augmentation(spark, d):
    """Accuracy by shift width: train rows are joined by a shifted copy of themselves, test rows stay as they are."""
    rows = protocol_rows(spark, d).where("protocol = 'grouped'").drop("protocol", "v").join(B.frames_from_embeddings(B.table(spark, d, "embeddings")).select("frame_id", "cells"), "frame_id")
    out = None
    for k in (0, 1, 2, 4):
        by = A.draw(f"shift{k}", F.col("frame_id"), 2 * k + 1) - k
        plain = rows.withColumn("v", A.unit(A.centre(F.col("cells"))))
        copies = plain if k == 0 else plain.unionByName(rows.withColumn("v", A.unit(A.centre(A.shift_columns(F.col("cells"), 4, 16, by)))))
        acc = X.accuracy(X.predict(plain, X.fold_centroids(copies, []), ["fold"]), ["fold"]).withColumn("shift", F.lit(k))
        out = acc if out is None else out.unionByName(acc)
    return rounded(out)
