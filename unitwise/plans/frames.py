"""Queries over frames: per-frame properties, units, sequences, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import components as CC
from ..operators import leakage as L
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators import similar as SIM
from ..operators import splits as P
from ..sources import bindings as B
from .registry import query, r6, rounded

FRAMES = """s AS (
  SELECT user_id AS unit, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame_idx,
         CAST((list_position(['click','error','purchase','signup','view'], event_type) - 1) * 24 + hour(ts) AS BIGINT) AS pos, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM events GROUP BY ALL
), frames AS (
  SELECT k.unit * 100000 + k.frame_idx AS frame_id, k.unit, k.frame_idx, list(10 * log10(coalesce(s.v, 0.0) + 0.001) ORDER BY p.pos) AS cells
  FROM (SELECT DISTINCT unit, frame_idx FROM s) k CROSS JOIN (SELECT unnest(range(120)) AS pos) p
  LEFT JOIN s ON s.unit = k.unit AND s.frame_idx = k.frame_idx AND s.pos = p.pos GROUP BY ALL
)"""
LINEAR = """lin AS (SELECT *, list_max(cells) AS peak, list_transform(cells, lambda x: pow(10, (x - list_max(cells)) / 10)) AS linear FROM frames),
exc AS (SELECT *, list_median(linear) AS floor, list_transform(linear, lambda x: greatest(x - list_median(linear), 0.0)) AS e FROM lin),
mass AS (SELECT *, greatest(list_sum(e), 1e-12) AS mass,
  list_sum(list_transform(e, lambda x, i: x * ((i - 1) // 24))) / greatest(list_sum(e), 1e-12) AS row_centroid,
  list_sum(list_transform(e, lambda x, i: x * ((i - 1) % 24))) / greatest(list_sum(e), 1e-12) AS col_centroid FROM exc),
feat AS (SELECT frame_id, unit, frame_idx, peak AS peak_db, -10 * log10(greatest(floor, 1e-30)) AS headroom,
  (list_position(cells, peak) - 1) // 24 AS peak_row, (list_position(cells, peak) - 1) % 24 AS peak_col, row_centroid, col_centroid,
  sqrt(list_sum(list_transform(e, lambda x, i: x * pow((i - 1) // 24 - row_centroid, 2))) / mass) AS row_spread,
  sqrt(list_sum(list_transform(e, lambda x, i: x * pow((i - 1) % 24 - col_centroid, 2))) / mass) AS col_spread,
  len(list_filter(linear, lambda x: x > 0.1)) AS cells_10db, len(list_filter(linear, lambda x: x > 0.01)) AS cells_20db,
  peak - list_min(cells) AS dynamic_range, list_sum(cells) / len(cells) AS mean_db FROM mass)"""
R = "round({0}, 6) + 0.0 AS {0}"


def rs(*names: str) -> str:
    return ", ".join(R.format(n) for n in names)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return B.frames_from_events(B.table(spark, d, "events"))


def featured(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Frames with the named properties, or with all twelve."""
    return frames(spark, d).select("frame_id", "unit", "frame_idx", A.features(F.col("cells"), B.COLS, names or None).alias("f")).select("frame_id", "unit", "frame_idx", "f.*")


@query("e8_unit_centroids", f"WITH {FRAMES}, {LINEAR} SELECT unit, count(*) AS n, round(avg(col_centroid), 6) + 0.0 AS mean, round(coalesce(stddev_samp(col_centroid), 0), 6) + 0.0 AS sd FROM feat GROUP BY unit")
def unit_centroids(spark, d):
    return rounded(featured(spark, d, "col_centroid").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg("col_centroid").alias("mean"), M.sd0("col_centroid").alias("sd")))


@query("c9_features", f"WITH {FRAMES}, {LINEAR} SELECT frame_id, CAST(peak_row AS BIGINT) AS peak_row, CAST(peak_col AS BIGINT) AS peak_col, CAST(cells_10db AS BIGINT) AS cells_10db, CAST(cells_20db AS BIGINT) AS cells_20db, {rs('peak_db', 'headroom', 'row_centroid', 'col_centroid', 'row_spread', 'col_spread', 'dynamic_range', 'mean_db')} FROM feat")
def features(spark, d):
    return rounded(featured(spark, d).drop("unit", "frame_idx"))


@query("c10_signal_stats", f"WITH {FRAMES}, {LINEAR} SELECT unit, count(*) AS n, round(median(headroom), 6) + 0.0 AS median_headroom, round(quantile_cont(headroom, 0.1), 6) + 0.0 AS p10_headroom, round(median(cells_10db), 6) + 0.0 AS median_cells FROM feat GROUP BY unit")
def signal_stats(spark, d):
    return rounded(featured(spark, d, "headroom", "cells_10db").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.median("headroom").alias("median_headroom"), F.percentile("headroom", 0.1).alias("p10_headroom"), F.median("cells_10db").alias("median_cells")))


def _summed(name: str, cells) -> list:
    return [A.total(cells).alias(f"{name}_sum"), F.element_at(cells, 1).alias(f"{name}_first"), F.element_at(cells, -1).alias(f"{name}_last")]


def _sql_summed(name: str, expr: str) -> str:
    return f"round(list_sum({expr}), 6) + 0.0 AS {name}_sum, round(({expr})[1], 6) + 0.0 AS {name}_first, round(({expr})[-1], 6) + 0.0 AS {name}_last"


@query("c1_c4_normalise", f"""WITH {FRAMES}, g AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(cells) AS x FROM frames)), p AS (SELECT *, list_max(cells) AS peak FROM frames)
SELECT frame_id, {_sql_summed('peak', 'list_transform(cells, lambda x: (x - peak) / 60)')}, {_sql_summed('offset', 'list_transform(cells, lambda x: (x + 60) / 60)')},
round(list_sum(list_transform(cells, lambda x: (x - m) / (s + 1e-6))), 4) + 0.0 AS global_sum, round((peak + 60) / 60, 6) + 0.0 AS level FROM p, g""")
def normalised(spark, d):
    """The four schemes; the global one takes mean and deviation from per-frame sums, so that no cell is exploded."""
    f = frames(spark, d)
    x = F.col("cells")
    stats = f.select(F.size(x).alias("n"), A.total(x).alias("s"), A.dot(x, x).alias("q")).agg((F.sum("s") / F.sum("n")).alias("m"), F.sqrt(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("sd"))
    j = f.join(F.broadcast(stats))  # one row
    out = j.select("frame_id", *_summed("peak", A.normalise(x, "peak")), *_summed("offset", A.normalise(x, "offset")), F.round(A.total(A.normalise(x, "global", F.col("m"), F.col("sd"))), 4).alias("global_sum"), F.element_at(A.normalise(x, "peak_level"), -1).alias("level"))
    return rounded(out)


@query("c5_reduce_columns", f"""WITH {FRAMES}, r AS (SELECT frame_id, list_transform(range(5 * 6), lambda i: 10 * log10(greatest(list_sum(list_transform(cells[(i // 6) * 24 + (i % 6) * 4 + 1 : (i // 6) * 24 + (i % 6) * 4 + 4], lambda x: pow(10, x / 10))), 1e-30))) AS r FROM frames)
SELECT frame_id, CAST(len(r) AS BIGINT) AS n_cells, {_sql_summed('r', 'r')} FROM r""")
def reduced(spark, d):
    r = frames(spark, d).select("frame_id", A.reduce_columns(F.col("cells"), B.ROWS, B.COLS, 4).alias("r"))
    return rounded(r.select("frame_id", F.size("r").alias("n_cells"), *_summed("r", F.col("r"))))


@query("c6_quantise", f"""WITH {FRAMES}, g AS (SELECT min(list_min(cells)) AS lo, max(list_max(cells)) AS hi FROM frames),
q AS (SELECT frame_id, cells, list_transform(cells, lambda x: round_even((least(greatest(x, lo), hi) - lo) / ((hi - lo) / 15), 0) * ((hi - lo) / 15) + lo) AS q FROM frames, g)
SELECT frame_id, {_sql_summed('q', 'q')} FROM q""")
def quantised(spark, d):
    f = frames(spark, d)
    g = f.agg(F.min(F.array_min("cells")).alias("lo"), F.max(F.array_max("cells")).alias("hi"))
    q = f.join(F.broadcast(g)).select("frame_id", A.quantise(F.col("cells"), 4, F.col("lo"), F.col("hi")).alias("q"))
    return rounded(q.select("frame_id", *_summed("q", F.col("q"))))


@query("c8_shift_columns", f"""WITH {FRAMES}, b AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '3', frame_id)), 1, 8)) AS BIGINT) % 9 - 4 AS by_, list_median(cells) AS m FROM frames),
r AS (SELECT frame_id, by_, list_transform(range(120), lambda i: CASE WHEN i % 24 - by_ BETWEEN 0 AND 23 THEN cells[i - by_ + 1] ELSE m END) AS r FROM b)
SELECT frame_id, by_ AS shift, {_sql_summed('r', 'r')} FROM r""")
def shifted(spark, d):
    by = A.draw(3, F.col("frame_id"), 9) - 4
    r = frames(spark, d).select("frame_id", by.alias("shift"), A.shift_columns(F.col("cells"), B.ROWS, B.COLS, by).alias("r"))
    return rounded(r.select("frame_id", "shift", *_summed("r", F.col("r"))))


@query("c13_concentration", f"""WITH {FRAMES}, {LINEAR}, o AS (SELECT unit, frame_id, unnest(list_reverse_sort(e)) AS x, unnest(range(1, 121)) AS i FROM exc WHERE list_sum(e) > 0),
c AS (SELECT unit, frame_id, sum(x) OVER (PARTITION BY frame_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (PARTITION BY frame_id) AS t FROM o),
n AS (SELECT unit, frame_id, count(*) FILTER (WHERE c < 0.9 * t) + 1 AS k FROM c GROUP BY ALL)
SELECT unit, count(*) AS n_frames, round(median(k), 6) + 0.0 AS median_cells, round(quantile_cont(k, 0.25), 6) + 0.0 AS p25, round(quantile_cont(k, 0.75), 6) + 0.0 AS p75 FROM n GROUP BY unit""")
def concentration(spark, d):
    f = frames(spark, d).select("unit", A.concentration(F.col("cells")).alias("k")).where("k is not null")
    return rounded(f.groupBy("unit").agg(F.count(F.lit(1)).alias("n_frames"), F.median("k").alias("median_cells"), F.percentile("k", 0.25).alias("p25"), F.percentile("k", 0.75).alias("p75")))


@query("c17_mean_map", f"""WITH {FRAMES}, x AS (SELECT unit % 10 AS g, unnest(list_transform(cells, lambda x: x - list_max(cells))) AS x, unnest(range(120)) AS pos FROM frames)
SELECT g, pos, round(avg(x), 6) + 0.0 AS mean FROM x GROUP BY ALL""")
def mean_map(spark, d):
    """Mean of peak-relative decibels by place; rows combine by place before the shuffle."""
    x = F.zip_with("cells", F.array_repeat(F.array_max("cells"), F.size("cells")), lambda v, p: v - p)
    flat = frames(spark, d).select(F.pmod("unit", F.lit(10)).alias("g"), F.posexplode(x).alias("pos", "x"))
    return rounded(flat.groupBy("g", "pos").agg(F.avg("x").alias("mean")))


@query("f2_triplets", """WITH t AS (SELECT conv_id, turn, lag(turn) OVER w AS p, lead(turn) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn AS centre, p AS before, f AS after FROM t WHERE p = turn - 1 AND f = turn + 1""")
def triplets(spark, d):
    return S.triplets(B.table(spark, d, "conversations"), "conv_id", "turn", "turn")


SIDED = "sided AS (SELECT conv_id, conv_id * 100 + turn AS id, turn, CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '5', conv_id * 100 + turn)), 1, 8)) AS BIGINT) % 10 < 3 THEN 'test' ELSE 'train' END AS side FROM conversations)"


def sided_turns(spark, d):
    key = F.col("conv_id") * 100 + F.col("turn")
    return B.table(spark, d, "conversations").select("conv_id", key.alias("id"), "turn", F.when(A.draw(5, key, 10) < 3, "test").otherwise("train").alias("side"))


@query("d7_clean_companions", f"""WITH {SIDED}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, id) AS pos FROM sided),
c AS (SELECT a.conv_id, a.id, a.side, b.id AS other, abs(a.pos - b.pos) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.pos - b.pos), b.pos) AS r
  FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.side = b.side AND a.id <> b.id),
g AS (SELECT id, max(CASE WHEN r = 1 THEN other END) AS first, max(CASE WHEN r = 2 THEN other END) AS second, sum(dist) AS distance, count(*) AS n FROM c WHERE r <= 2 GROUP BY id)
SELECT p.conv_id, p.id, p.side, coalesce(first, p.id) AS first, coalesce(second, p.id) AS second, coalesce(n, 0) < 2 AS fallback, CAST(coalesce(distance, 0) AS BIGINT) AS distance FROM p LEFT JOIN g USING (id)""")
def clean_companions(spark, d):
    return S.clean_companions(sided_turns(spark, d), "conv_id", "turn", "id", "side")


@query("f3_random_companions", f"""WITH {SIDED}, pl AS (SELECT conv_id, id, turn, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM sided WINDOW w AS (PARTITION BY conv_id ORDER BY turn, id)),
t AS (SELECT *, n < 5 AS fallback, CASE WHEN n < 5 THEN n - 1 ELSE n - 3 END AS free, CASE WHEN n < 5 THEN pos ELSE pos - 1 END AS edge, CASE WHEN n < 5 THEN 1 ELSE 3 END AS gap FROM pl WHERE b = turn - 1 AND a = turn + 1),
q AS (SELECT *, CAST(('0x' || substr(md5('0a|' || id), 1, 8)) AS BIGINT) % 1048576 % free AS q1, CAST(('0x' || substr(md5('0b|' || id), 1, 8)) AS BIGINT) % 1048576 % (free - 1) AS q2 FROM t),
s AS (SELECT *, (q1 + 1 + q2) % free AS q3 FROM q), p AS (SELECT conv_id, id, fallback, CASE WHEN q1 < edge THEN q1 ELSE q1 + gap END AS p1, CASE WHEN q3 < edge THEN q3 ELSE q3 + gap END AS p2 FROM s)
SELECT p.conv_id, p.id AS centre, x.id AS first, y.id AS second, fallback FROM p JOIN pl x ON x.conv_id = p.conv_id AND x.pos = p1 JOIN pl y ON y.conv_id = p.conv_id AND y.pos = p2""")
def random_companions(spark, d):
    return S.random_companions(sided_turns(spark, d), "conv_id", "turn", "id")


@query("f5_overlap", f"""WITH {SIDED}, w AS (SELECT id AS centre, side, lag(id) OVER x AS b, lead(id) OVER x AS a, lag(turn) OVER x AS bt, turn, lead(turn) OVER x AS at_ FROM sided WINDOW x AS (PARTITION BY conv_id ORDER BY turn, id)),
t AS (SELECT * FROM w WHERE bt = turn - 1 AND at_ = turn + 1 AND side = 'train'),
m AS (SELECT centre, unnest([b, a]) AS id FROM t), h AS (SELECT m.centre, m.id FROM m JOIN sided USING (id) WHERE side = 'test')
SELECT (SELECT count(*) FROM t) AS n_train, (SELECT count(DISTINCT centre) FROM h) AS n_touching, (SELECT count(DISTINCT id) FROM h) AS n_reached,
round((SELECT count(DISTINCT id) FROM h) / (SELECT count(*) FROM sided WHERE side = 'test'), 6) + 0.0 AS share_of_test""")
def overlap(spark, d):
    turns = sided_turns(spark, d)
    return rounded(S.overlap(S.triplets(turns, "conv_id", "turn", "id"), turns, "id", ["before", "after"]))


UNITV = """cen AS (SELECT *, list_sum(cells) / len(cells) AS mu FROM frames), uv0 AS (SELECT *, list_transform(cells, lambda x: x - mu) AS c FROM cen),
uv AS (SELECT *, list_transform(c, lambda x: x / CASE WHEN sqrt(list_inner_product(c, c)) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END) AS v FROM uv0)"""


@query("f6_adjacency", f"WITH {FRAMES}, {UNITV} SELECT unit, frame_id, round(list_inner_product(v, lag(v) OVER (PARTITION BY unit ORDER BY frame_idx)), 6) + 0.0 AS corr FROM uv")
def adjacency(spark, d):
    return rounded(S.adjacency(frames(spark, d), "unit", "frame_idx", "frame_id", F.col("cells")).select("unit", "frame_id", "corr"))


@query("f9_runs", f"""WITH {FRAMES}, {UNITV}, c AS (SELECT unit, frame_idx, list_inner_product(v, lag(v) OVER (PARTITION BY unit ORDER BY frame_idx)) AS corr FROM uv),
r AS (SELECT unit, sum(CASE WHEN corr < 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM c),
l AS (SELECT unit, run, count(*) AS length FROM r GROUP BY ALL)
SELECT unit, count(*) AS n_runs, min(length) AS shortest, round(median(length), 6) + 0.0 AS median_length, max(length) AS longest FROM l GROUP BY unit""")
def runs(spark, d):
    scored = S.adjacency(frames(spark, d), "unit", "frame_idx", "frame_id", F.col("cells"))
    r = S.runs(scored, "unit", "frame_idx", "frame_id", 0.25)
    return rounded(r.groupBy("unit").agg(F.count(F.lit(1)).alias("n_runs"), F.min("length").alias("shortest"), F.median("length").alias("median_length"), F.max("length").alias("longest")))


EMB = """e AS (SELECT vec_id AS frame_id, CAST(label AS VARCHAR) AS class, concat_ws('/', label, ((vec_id % 7) + 7) % 7) AS unit, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 60 - 60) AS cells FROM embeddings),
u AS (SELECT frame_id, class, unit, list_transform(c, lambda x: x / CASE WHEN sqrt(list_inner_product(c, c)) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END) AS v
  FROM (SELECT *, list_transform(cells, lambda x: x - mu) AS c FROM (SELECT *, list_sum(cells) / len(cells) AS mu FROM e)))"""


def vectors(spark, d):
    return B.frames_from_embeddings(B.table(spark, d, "embeddings")).withColumn("v", A.unit(A.centre(F.col("cells"))))


@query("i17_leakage_gap", f"""WITH {EMB}, k AS (SELECT class, unit FROM u GROUP BY ALL HAVING count(*) > 1), x AS (SELECT u.* FROM u JOIN k USING (class, unit)),
c AS (SELECT class FROM k GROUP BY class HAVING count(*) > 1),
p AS (SELECT a.class, a.unit = b.unit AS same, list_inner_product(a.v, b.v) AS s FROM x a JOIN x b ON a.class = b.class AND a.frame_id <> b.frame_id)
SELECT class, (SELECT count(*) FROM k WHERE k.class = p.class) AS n_units, round(avg(s) FILTER (WHERE same), 6) + 0.0 AS within, round(avg(s) FILTER (WHERE NOT same), 6) + 0.0 AS across,
round(avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same), 6) + 0.0 AS gap FROM p JOIN c USING (class) GROUP BY class""")
def leakage_gap(spark, d):
    return rounded(L.gap(vectors(spark, d), "v"))


def drawn(seed: str, key: str) -> str:
    """SQL of `arrays.draw` before the remainder is taken."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 8)) AS BIGINT)"


SAMPLED = f"""n AS (SELECT count(*) AS n FROM u), pl AS (SELECT frame_id, v, {drawn('0p', 'frame_id')} % n AS pos FROM u, n),
ask AS (SELECT {drawn('0a', 'id')} % n AS pa, {drawn('0b', 'id')} % n AS pb FROM (SELECT unnest(range(2000)) AS id), n),
sp AS (SELECT list_inner_product(a.v, b.v) AS similarity FROM ask JOIN pl a ON a.pos = pa JOIN pl b ON b.pos = pb WHERE a.frame_id <> b.frame_id)"""


@query("i17_sampled_pairs", f"WITH {EMB}, {SAMPLED} SELECT count(*) AS n, round(avg(similarity), 6) + 0.0 AS mean, round(quantile_cont(similarity, 0.95), 6) + 0.0 AS p95 FROM sp")
def sampled_pairs(spark, d):
    return rounded(L.sampled_pairs(vectors(spark, d), "frame_id", "v", 2000).agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"), F.percentile("similarity", 0.95).alias("p95")))


@query("c11_top_cells", f"""WITH {EMB}, t AS (SELECT frame_id, cells, list_max(cells) AS peak, list_transform(list_sort(list_transform(cells, lambda x, i: {{'v': -x, 'i': i}}))[1:12], lambda s: s.i) AS k FROM e),
r AS (SELECT frame_id, list_transform(cells, lambda x, i: CASE WHEN list_contains(k, i) THEN x - peak ELSE 0.0 END) AS r FROM t),
c AS (SELECT frame_id, list_transform(r, lambda x: x - list_sum(r) / len(r)) AS c FROM r),
n AS (SELECT frame_id, list_transform(c, lambda x: x / CASE WHEN list_inner_product(c, c) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END) AS n FROM c)
SELECT frame_id, round(list_max(n), 6) + 0.0 AS hi, round(list_min(n), 6) + 0.0 AS lo, round(n[1], 6) + 0.0 AS first FROM n""")
def top_cells(spark, d):
    t = vectors(spark, d).select("frame_id", A.top_cells(F.col("cells"), 12).alias("n"))
    return rounded(t.select("frame_id", F.array_max("n").alias("hi"), F.array_min("n").alias("lo"), F.element_at("n", 1).alias("first")))


@query("d10_nearest_centroid", f"""WITH {EMB}, m AS (SELECT class, pos, avg(x) AS m FROM (SELECT class, unnest(v) AS x, unnest(range(64)) AS pos FROM u) GROUP BY ALL),
c0 AS (SELECT class, list(m ORDER BY pos) AS c FROM m GROUP BY class), c AS (SELECT class, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM c0),
s AS (SELECT frame_id, c.class, list_inner_product(u.v, c.c) AS sim, row_number() OVER (PARTITION BY frame_id ORDER BY list_inner_product(u.v, c.c) DESC, c.class) AS r FROM u, c)
SELECT frame_id, class AS nearest, round(sim, 6) + 0.0 AS similarity FROM s WHERE r = 1""")
def nearest_centroid(spark, d):
    v = vectors(spark, d)
    return rounded(L.nearest_centroid(v, L.vector_mean(v, ["class"], "v").withColumnRenamed("class", "name"), "frame_id", "v"))


@query("d5_similarity_pairs", f"WITH {EMB} SELECT a.frame_id AS a, b.frame_id AS b, round(list_inner_product(a.v, b.v), 6) + 0.0 AS similarity FROM u a JOIN u b ON a.class = b.class AND a.frame_id < b.frame_id WHERE list_inner_product(a.v, b.v) > 0.3")
def similarity_pairs(spark, d):
    return rounded(SIM.similarity_pairs(vectors(spark, d), "frame_id", "v", 0.3, block="class"))


@query("e12_components", f"""WITH RECURSIVE {EMB}, p AS (SELECT a.frame_id AS a, b.frame_id AS b FROM u a JOIN u b ON a.class = b.class AND a.frame_id <> b.frame_id WHERE list_inner_product(a.v, b.v) > 0.3),
r(node, seen) AS (SELECT frame_id, frame_id FROM u UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(spark, d):
    v = vectors(spark, d)
    return CC.components(SIM.similarity_forest(v, "frame_id", "v", 0.3, block="class"), v.select(F.col("frame_id").alias("node")))


@query("e13_threshold_sweep", f"""WITH RECURSIVE {EMB}, t AS (SELECT unnest([0.28, 0.3, 0.32, 0.35]) AS threshold),
p AS (SELECT a.frame_id AS a, b.frame_id AS b, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.class = b.class AND a.frame_id <> b.frame_id WHERE list_inner_product(a.v, b.v) > 0.28),
r(threshold, node, seen) AS (SELECT threshold, frame_id, frame_id FROM u, t UNION SELECT r.threshold, r.node, p.b FROM r JOIN p ON r.seen = p.a AND p.s > r.threshold),
l AS (SELECT threshold, node, min(seen) AS component FROM r GROUP BY ALL), z AS (SELECT threshold, component, count(*) AS size FROM l GROUP BY ALL),
g AS (SELECT threshold, CAST(sum(size) AS BIGINT) AS n, count(*) AS n_components, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS singletons,
  coalesce(sum(size) FILTER (WHERE size > 1), 0) / sum(size) AS frac_in_multi FROM z GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, n, n_components, largest, singletons, round(frac_in_multi, 6) + 0.0 AS frac_in_multi, round(frac_in_multi * (1 - largest / n), 6) + 0.0 AS score FROM g""")
def threshold_sweep(spark, d):
    v = vectors(spark, d)
    pairs = CC.written(SIM.similarity_forest(v, "frame_id", "v", 0.28, block="class"))
    return rounded(CC.sweep(pairs, v.select(F.col("frame_id").alias("node")), [0.28, 0.3, 0.32, 0.35]))


@query("e7_unit_headroom_spread", f"WITH {FRAMES}, {LINEAR}, h AS (SELECT unit, median(headroom) AS m FROM feat GROUP BY unit) SELECT unit % 5 AS g, count(*) AS n_units, round(median(m), 6) + 0.0 AS median_headroom, round(max(m) - min(m), 6) + 0.0 AS spread FROM h GROUP BY ALL")
def headroom_spread(spark, d):
    h = featured(spark, d, "headroom").groupBy("unit").agg(F.median("headroom").alias("m"))
    return rounded(h.groupBy(F.pmod("unit", F.lit(5)).alias("g")).agg(F.count(F.lit(1)).alias("n_units"), F.median("m").alias("median_headroom"), (F.max("m") - F.min("m")).alias("spread")))


NAMES12 = ("peak_db", "headroom", "peak_row", "peak_col", "row_centroid", "col_centroid", "row_spread", "col_spread", "cells_10db", "cells_20db", "dynamic_range", "mean_db")


@query("j6_target_profile", f"""WITH {FRAMES}, {LINEAR}, l AS (SELECT unit, unnest([{', '.join(repr(n) for n in NAMES12)}]) AS feature, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in NAMES12)}]) AS v FROM feat)
SELECT feature, round((avg(v) FILTER (WHERE unit % 10 = 3) - avg(v) FILTER (WHERE unit % 10 <> 3)) / (stddev_pop(v) FILTER (WHERE unit % 10 <> 3) + 1e-9), 6) + 0.0 AS z FROM l GROUP BY feature""")
def target_profile(spark, d):
    f = featured(spark, d)
    target = F.pmod("unit", F.lit(10)) == 3
    one = f.agg(*[M.z_against_others(f, target, n).alias(n) for n in NAMES12])
    return rounded(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("z")) for n in NAMES12])).alias("x")).select("x.*"))


@query("g1_top_features", f"""WITH {FRAMES}, {LINEAR}, l AS (SELECT unit, unnest([{', '.join(repr(n) for n in NAMES12)}]) AS feature, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in NAMES12)}]) AS v FROM feat),
z AS (SELECT feature, (avg(v) FILTER (WHERE unit % 10 = 3) - avg(v) FILTER (WHERE unit % 10 <> 3)) / (stddev_pop(v) FILTER (WHERE unit % 10 <> 3) + 1e-9) AS z FROM l GROUP BY feature)
SELECT feature, round(z, 6) + 0.0 AS z, abs(z) > 2 AS outlier FROM z ORDER BY abs(z) DESC, feature LIMIT 3""")
def top_features(spark, d):
    return target_profile(spark, d).withColumn("outlier", F.abs("z") > 2).orderBy(F.abs("z").desc(), "feature").limit(3)


@query("b7_numbering", """WITH g AS (SELECT conv_id, count(DISTINCT turn) AS n, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id)
SELECT conv_id, n, lo, hi, hi - lo + 1 AS span, hi - lo + 1 - n AS missing, hi - lo + 1 = n AS contiguous FROM g""")
def numbering(spark, d):
    return rounded(S.numbering(B.table(spark, d, "conversations"), "conv_id", "turn"))


@query("f13_missing_days", f"""WITH {FRAMES}, g AS (SELECT unit, count(DISTINCT frame_idx) AS n, min(frame_idx) AS lo, max(frame_idx) AS hi FROM frames GROUP BY unit)
SELECT unit, n, lo, hi, hi - lo + 1 AS span, hi - lo + 1 - n AS missing, hi - lo + 1 = n AS contiguous FROM g""")
def missing_days(spark, d):
    return rounded(S.numbering(frames(spark, d), "unit", "frame_idx"))


@query("f12_largest_gap", f"""WITH {FRAMES}, {LINEAR}, w AS (SELECT unit, col_centroid AS v, lead(col_centroid) OVER (PARTITION BY unit ORDER BY col_centroid) - col_centroid AS gap FROM feat)
SELECT unit, count(*) AS n, round(CASE WHEN count(*) >= 3 AND max(v) > min(v) THEN max(gap) / (max(v) - min(v)) ELSE 0 END, 6) + 0.0 AS gap FROM w GROUP BY unit""")
def largest_gap(spark, d):
    return rounded(M.largest_gap(featured(spark, d, "col_centroid"), ["unit"], "col_centroid"))


@query("h1_grouped_split", f"""WITH {FRAMES}, k AS (SELECT DISTINCT CAST(unit % 3 AS VARCHAR) AS class, unit FROM frames),
sd AS (SELECT class, unit, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '11', class, unit)), unit) <= greatest(1, round_even(0.3 * count(*) OVER (PARTITION BY class), 0)) THEN 'test' ELSE 'train' END AS side FROM k)
SELECT frame_id, sd.class, sd.side FROM frames JOIN sd USING (unit)""")
def grouped_split(spark, d):
    f = frames(spark, d).select("frame_id", "unit", F.pmod("unit", F.lit(3)).cast("string").alias("class"))
    return P.grouped_split(f, 0.3, 11).select("frame_id", "class", "side")


@query("h2_random_split", f"WITH {FRAMES} SELECT frame_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '11', frame_id)), frame_id) <= round_even(0.3 * count(*) OVER (), 0) THEN 'test' ELSE 'train' END AS side FROM frames")
def random_split(spark, d):
    return P.random_split(frames(spark, d).select("frame_id"), 0.3, 11)


@query("d8_straddling", f"""WITH {FRAMES}, r AS (SELECT unit, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '11', frame_id)), frame_id) <= round_even(0.3 * count(*) OVER (), 0) THEN 'test' ELSE 'train' END AS side FROM frames)
SELECT unit, count(DISTINCT side) AS n_sides FROM r GROUP BY unit HAVING count(DISTINCT side) > 1""")
def straddling(spark, d):
    return P.straddling(P.random_split(frames(spark, d).select("frame_id", "unit"), 0.3, 11))


@query("h9_coverage_split", f"""WITH {FRAMES}, t AS (SELECT frame_id, row_number() OVER (ORDER BY md5(concat_ws('|', '2', frame_id)), frame_id) AS r, count(*) OVER () AS n FROM frames WHERE unit % 10 = 3)
SELECT frame_id, CASE WHEN r <= round_even(0.5 * n, 0) THEN 'train' ELSE 'test' END AS side FROM t UNION ALL SELECT frame_id, 'train' FROM frames WHERE unit % 10 <> 3""")
def coverage_split(spark, d):
    f = frames(spark, d).select("frame_id", F.pmod("unit", F.lit(10)).cast("string").alias("unit"))
    return P.coverage_split(f, "3", "half_in", 2).select("frame_id", "side")


@query("h8_hold_out_unit", f"""WITH {FRAMES}, o AS (SELECT frame_id, row_number() OVER (ORDER BY md5(concat_ws('|', '2', frame_id)), frame_id) AS r, count(*) OVER () AS n FROM frames WHERE unit % 10 <> 3)
SELECT frame_id, CASE WHEN r <= floor(0.15 * n) THEN 'val' ELSE 'train' END AS side FROM o UNION ALL SELECT frame_id, 'test' FROM frames WHERE unit % 10 = 3""")
def hold_out_unit(spark, d):
    f = frames(spark, d).select("frame_id", F.pmod("unit", F.lit(10)).cast("string").alias("unit"))
    return P.hold_out_unit(f, "3", 0.15, 2).select("frame_id", "side")


@query("c19_peak_columns", f"WITH {FRAMES}, {LINEAR} SELECT unit, round(avg(peak_col), 6) + 0.0 AS mean, round(stddev_pop(peak_col), 6) + 0.0 AS sd FROM feat GROUP BY unit")
def peak_columns(spark, d):
    return rounded(featured(spark, d, "peak_col").groupBy("unit").agg(F.avg("peak_col").alias("mean"), F.stddev_pop("peak_col").alias("sd")))


@query("c16_frame_stats", f"""WITH {FRAMES} SELECT frame_id, round(list_max(cells), 6) + 0.0 AS peak, round(quantile_cont(x, 0.1), 6) + 0.0 AS p10, round(stddev_pop(x), 6) + 0.0 AS sd, count(*) FILTER (WHERE x >= mx - 3) AS within_3, count(*) FILTER (WHERE x >= mx - 6) AS within_6
FROM (SELECT frame_id, cells, list_max(cells) AS mx, unnest(cells) AS x FROM frames) GROUP BY frame_id, cells""")
def frame_stats(spark, d):
    x = F.col("cells")
    mean = A.total(x) / F.size(x)
    near = lambda db: F.size(F.filter(F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)), lambda v, p: p - v), lambda g: g <= db))
    sd = F.sqrt(A.dot(A.centre(x), A.centre(x)) / F.size(x))
    return rounded(frames(spark, d).select("frame_id", F.array_max(x).alias("peak"), A.quantile_of(x, 0.1).alias("p10"), sd.alias("sd"), near(3).alias("within_3"), near(6).alias("within_6"), mean.alias("m")).drop("m"))
