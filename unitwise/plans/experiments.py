"""Queries over predictions, files and names: metrics, statistics, splits, deduplication, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import dedup as D
from ..operators import metrics as M
from ..operators import splits as P
from ..sources import bindings as B
from . import claims as K
from .registry import query, rounded

PRED = """pred AS (SELECT l_orderkey * 10 + l_linenumber AS frame_id, l_suppkey AS unit, l_orderkey % 5 AS fold, CAST(l_linenumber % 5 AS BIGINT) AS seed, l_linestatus AS condition, l_returnflag AS y_true,
  CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '7', l_orderkey * 10 + l_linenumber)), 1, 8)) AS BIGINT) % 1000 < 50 + 30 * (l_suppkey % 10)
       THEN CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END ELSE l_returnflag END AS y_pred FROM lineitem)"""
ACC = f"{PRED}, acc AS (SELECT condition, fold, seed, avg(CAST(y_true = y_pred AS INT)) AS a FROM pred GROUP BY ALL)"
CLASSES = ["A", "N", "R"]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return B.predictions_from_lineitem(B.table(spark, d, "lineitem"))


def accuracies(spark: SparkSession, d: str) -> DataFrame:
    """One accuracy for each condition, fold and seed."""
    return predictions(spark, d).groupBy("condition", "fold", "seed").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a"))


@query("e10_class_metrics", f"""WITH {PRED}, c AS (SELECT condition, k.class, count(*) FILTER (WHERE y_true = k.class) AS support, count(*) FILTER (WHERE y_true = k.class AND y_pred = k.class) AS hit,
  count(*) FILTER (WHERE y_pred = k.class) AS said, count(*) FILTER (WHERE y_true = y_pred) / count(*) AS accuracy FROM pred, (SELECT unnest(['A','N','R']) AS class) k GROUP BY ALL),
m AS (SELECT *, hit / greatest(1, support) AS recall, hit / greatest(1, said) AS precision FROM c)
SELECT condition, class, support, round(recall, 6) + 0.0 AS recall, round(precision, 6) + 0.0 AS precision, round(accuracy, 6) + 0.0 AS accuracy, round(2 * precision * recall / greatest(1e-9, precision + recall), 6) + 0.0 AS f1 FROM m""")
def class_metrics(spark, d):
    return rounded(M.class_metrics(predictions(spark, d), ["condition"], CLASSES))


@query("e10_confusion", f"WITH {PRED} SELECT condition, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, d):
    return M.confusion(predictions(spark, d), ["condition"])


@query("e11_recall_by_unit", f"""WITH {PRED}, o AS (SELECT unit, seed, avg(CAST(y_true = y_pred AS DOUBLE)) AS r, count(*) AS n FROM pred GROUP BY ALL)
SELECT unit, CAST(sum(n) AS BIGINT) AS n, round(avg(r), 6) + 0.0 AS recall, round(stddev_pop(r), 6) + 0.0 AS recall_sd FROM o GROUP BY unit""")
def recall_by_unit(spark, d):
    return rounded(M.recall_by_unit(predictions(spark, d)))


@query("e14_predicted_fractions", f"WITH {PRED} SELECT condition, y_pred, round(count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) + 0.0 AS fraction FROM pred GROUP BY condition, y_pred")
def predicted_fractions(spark, d):
    n = predictions(spark, d).groupBy("condition", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.select("condition", "y_pred", (F.col("n") / F.sum("n").over(Window.partitionBy("condition"))).alias("fraction")))


@query("e16_weakest_units", f"""WITH {PRED}, r AS (SELECT y_true, unit, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall FROM pred GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY recall, unit) AS r FROM r)
SELECT y_true AS class, unit, round(recall, 6) + 0.0 AS recall FROM k WHERE r = 1""")
def weakest_units(spark, d):
    r = predictions(spark, d).groupBy("y_true", "unit").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return rounded(r.groupBy(F.col("y_true").alias("class")).agg(F.min(F.struct("recall", "unit")).alias("x")).select("class", "x.unit", "x.recall"))


@query("e17_grid_marginals", f"WITH {ACC} SELECT fold, seed, round(avg(a), 6) + 0.0 AS accuracy, count(*) AS n FROM acc WHERE seed <> 4 GROUP BY CUBE (fold, seed)")
def grid_marginals(spark, d):
    return rounded(accuracies(spark, d).where("seed <> 4").cube("fold", "seed").agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("n")))


@query("i5_decompose", f"""WITH {ACC}, f AS (SELECT condition, fold, avg(a) AS m, coalesce(stddev_samp(a), 0) AS s FROM acc GROUP BY ALL)
SELECT condition, round(avg(m), 6) + 0.0 AS mean, round(coalesce(stddev_samp(m), 0), 6) + 0.0 AS between_fold_sd, round(avg(s), 6) + 0.0 AS within_fold_sd, count(*) AS n_folds FROM f GROUP BY condition""")
def decompose(spark, d):
    return rounded(M.decompose(accuracies(spark, d), ["condition"], "a"))


PAIRED = "SELECT {by} count(*) AS n, round(avg(d), 6) + 0.0 AS mean_diff, round(stddev_samp(d), 6) + 0.0 AS sd, count(*) FILTER (WHERE d > 0) AS n_positive, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) + 0.0 AS t FROM p {group}"


@query("i6_paired_by_fold", f"WITH {ACC}, p AS (SELECT fold, avg(a) FILTER (WHERE condition = 'F') - avg(a) FILTER (WHERE condition = 'O') AS d FROM acc GROUP BY fold) " + PAIRED.format(by="", group=""))
def paired_by_fold(spark, d):
    return rounded(M.paired(accuracies(spark, d), "fold", "condition", "F", "O", "a"))


@query("i7_paired_by_seed", f"WITH {ACC}, p AS (SELECT fold, seed, avg(a) FILTER (WHERE condition = 'F') - avg(a) FILTER (WHERE condition = 'O') AS d FROM acc GROUP BY fold, seed) " + PAIRED.format(by="fold,", group="GROUP BY fold"))
def paired_by_seed(spark, d):
    return rounded(M.paired(accuracies(spark, d), "seed", "condition", "F", "O", "a", by=["fold"]))


@query("i8_welch", f"""WITH {ACC}, g AS (SELECT avg(a) FILTER (WHERE condition = 'F') AS x, avg(a) FILTER (WHERE condition = 'O') AS y, var_samp(a) FILTER (WHERE condition = 'F') AS vx, var_samp(a) FILTER (WHERE condition = 'O') AS vy,
  count(*) FILTER (WHERE condition = 'F') AS nx, count(*) FILTER (WHERE condition = 'O') AS ny FROM acc)
SELECT round(x, 6) + 0.0 AS mean_first, round(y, 6) + 0.0 AS mean_second, round((x - y) / sqrt(vx / nx + vy / ny), 6) + 0.0 AS t FROM g""")
def welch(spark, d):
    return rounded(M.welch(accuracies(spark, d), "condition", "F", "O", "a"))


UNITX = f"{PRED}, ux AS (SELECT unit, unit % 3 AS g, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall, count(*) AS n FROM pred GROUP BY ALL), uy AS (SELECT ux.*, s_acctbal AS x FROM ux JOIN supplier ON s_suppkey = unit)"


def units_with_balance(spark, d):
    r = predictions(spark, d).groupBy("unit").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n")).withColumn("g", F.pmod("unit", F.lit(3)))
    return r.join(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("x")), "unit")


@query("i1_pearson_t", f"WITH {UNITX}, c AS (SELECT g, corr(recall, x) AS r, count(*) AS n FROM uy GROUP BY g) SELECT g, n, round(r, 6) + 0.0 AS pearson, round(r * sqrt((n - 2) / (1 - r * r)), 6) + 0.0 AS t FROM c")
def pearson_t(spark, d):
    c = units_with_balance(spark, d).groupBy("g").agg(M.pearson(F.col("recall"), F.col("x")).alias("pearson"), F.count(F.lit(1)).alias("n"))
    return rounded(c.withColumn("t", M.t_of_r(F.col("pearson"), F.col("n"))))


@query("i2_spearman", f"""WITH {UNITX}, k AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY recall, unit) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY g ORDER BY x, unit) AS DOUBLE) AS b FROM uy)
SELECT g, round(corr(a, b), 6) + 0.0 AS spearman, count(*) AS n FROM k GROUP BY g""")
def spearman(spark, d):
    return rounded(M.spearman(units_with_balance(spark, d), ["g"], "recall", "x", "unit"))


@query("i4_regression", f"WITH {UNITX} SELECT g, round(regr_slope(recall, x), 9) + 0.0 AS slope, round(regr_intercept(recall, x), 6) + 0.0 AS intercept FROM uy GROUP BY g")
def regression(spark, d):
    g = units_with_balance(spark, d).groupBy("g").agg(F.regr_slope("recall", "x").alias("slope"), F.regr_intercept("recall", "x").alias("intercept"))
    return g.select("g", (F.round("slope", 9) + 0.0).alias("slope"), (F.round("intercept", 6) + 0.0).alias("intercept"))


@query("i10_sign_test", """WITH n AS (SELECT o_custkey % 40 AS k, CAST(5 + o_custkey % 16 AS BIGINT) AS n FROM orders GROUP BY ALL), m AS (SELECT DISTINCT n, k % (n + 1) AS k FROM n),
f AS (SELECT i, list_product(list_transform(range(1, i + 1), lambda x: CAST(x AS DOUBLE))) AS f FROM (SELECT unnest(range(1, 30)) AS i) UNION ALL SELECT 0, 1.0),
t AS (SELECT m.n, m.k, a.i, b.f / a.f / c.f * pow(0.5, m.n) AS p FROM m JOIN f b ON b.i = m.n JOIN f a ON a.i <= m.n JOIN f c ON c.i = m.n - a.i)
SELECT n, k, round(sum(p) FILTER (WHERE i >= k), 6) + 0.0 AS upper, round(sum(p) FILTER (WHERE i <= k), 6) + 0.0 AS lower, round(least(1.0, 2 * least(sum(p) FILTER (WHERE i >= k), sum(p) FILTER (WHERE i <= k))), 6) + 0.0 AS two_sided FROM t GROUP BY n, k""")
def sign_test(spark, d):
    n = B.table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(40)).alias("k"), (F.pmod("o_custkey", F.lit(16)) + 5).alias("n")).distinct()
    m = n.select("n", (F.col("k") % (F.col("n") + 1)).alias("k")).distinct()
    return rounded(m.select("n", "k", M.sign_test(F.col("n"), F.col("k")).alias("s")).select("n", "k", "s.*"))


@query("i11_mann_whitney", f"""WITH {UNITX}, q AS (SELECT CASE WHEN g = 0 THEN 'a' ELSE 'b' END AS s, round(recall, 2) AS v FROM uy), k AS (SELECT s, avg(r) OVER (PARTITION BY v) AS rank FROM (SELECT s, v, row_number() OVER (ORDER BY v) AS r FROM q)),
g AS (SELECT count(*) FILTER (WHERE s = 'a') AS n1, count(*) FILTER (WHERE s = 'b') AS n2, sum(rank) FILTER (WHERE s = 'a') AS r1 FROM k)
SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) + 0.0 AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) + 0.0 AS z FROM g""")
def mann_whitney(spark, d):
    u = units_with_balance(spark, d).select(F.when(F.col("g") == 0, "a").otherwise("b").alias("s"), F.round("recall", 2).alias("v"))
    return rounded(M.mann_whitney(u, "s", "a", "v"))


@query("i12_bootstrap", f"""WITH {ACC}, s AS (SELECT condition = 'F' AS g, a AS v, fold * 10 + seed AS k FROM acc), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM s),
i AS (SELECT b, p.g, p.pos AS i, p.n FROM (SELECT unnest(range(500)) AS b) CROSS JOIN p), dr AS (SELECT b, g, CAST(('0x' || substr(md5('0|' || b || '-' || (CASE WHEN g THEN 'true' ELSE 'false' END) || '-' || i), 1, 8)) AS BIGINT) % 2147483648 % n AS pos FROM i),
m AS (SELECT b, avg(v) FILTER (WHERE dr.g) - avg(v) FILTER (WHERE NOT dr.g) AS d FROM dr JOIN p ON dr.g = p.g AND dr.pos = p.pos GROUP BY b)
SELECT (SELECT round(avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g), 6) + 0.0 FROM s) AS observed, round(quantile_cont(d, 0.025), 6) + 0.0 AS low, round(quantile_cont(d, 0.975), 6) + 0.0 AS high FROM m""")
def bootstrap(spark, d):
    runs = accuracies(spark, d).withColumn("k", F.col("fold") * 10 + F.col("seed"))
    return rounded(M.bootstrap_mean_diff(runs, "condition", "F", "a", "k", resamples=500))


@query("i13_interaction", f"""WITH {PRED}, a AS (SELECT fold, seed, avg(CAST(y_true = y_pred AS INT)) AS a FROM pred GROUP BY ALL),
i AS (SELECT fold, avg(a) FILTER (WHERE seed = 3) - avg(a) FILTER (WHERE seed = 1) - avg(a) FILTER (WHERE seed = 2) + avg(a) FILTER (WHERE seed = 0) AS i FROM a GROUP BY fold)
SELECT count(*) AS n, round(avg(i), 6) + 0.0 AS mean, round(stddev_samp(i), 6) + 0.0 AS sd, round(stddev_samp(i) / sqrt(count(*)), 6) + 0.0 AS se, round(avg(i) / (stddev_samp(i) / sqrt(count(*))), 6) + 0.0 AS t FROM i""")
def interaction(spark, d):
    a = predictions(spark, d).groupBy("fold", F.col("seed").cast("string").alias("seed")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a"))
    return rounded(M.interaction(a, "fold", "seed", ("0", "1", "2", "3"), "a"))


@query("i19_separation", f"WITH {ACC} SELECT round(min(a) FILTER (WHERE condition = 'F') - max(a) FILTER (WHERE condition = 'O'), 6) + 0.0 AS separation FROM acc")
def separation(spark, d):
    return rounded(M.separation(accuracies(spark, d), "condition", "F", "O", "a"))


@query("f10_ranks", f"WITH {UNITX} SELECT g, unit, rank() OVER (PARTITION BY g ORDER BY recall DESC) AS rank FROM uy")
def ranks(spark, d):
    return units_with_balance(spark, d).select("g", "unit", F.rank().over(Window.partitionBy("g").orderBy(F.desc("recall"))).cast("long").alias("rank"))


@query("j2_structure", f"""WITH {PRED} SELECT condition, count(*) FILTER (WHERE y_true = 'A' AND y_pred = 'N') AS a_as_n, count(*) FILTER (WHERE y_true = 'N' AND y_pred = 'A') AS n_as_a,
count(*) FILTER (WHERE y_true = 'A' AND y_pred = 'N') > count(*) FILTER (WHERE y_true = 'N' AND y_pred = 'A') AS a_leaks_more FROM pred GROUP BY condition""")
def structure(spark, d):
    n = lambda a, b: F.count_if((F.col("y_true") == a) & (F.col("y_pred") == b))
    return predictions(spark, d).groupBy("condition").agg(n("A", "N").alias("a_as_n"), n("N", "A").alias("n_as_a"), (n("A", "N") > n("N", "A")).alias("a_leaks_more"))


@query("j14_leave_one_out", f"""WITH {PRED}, u AS (SELECT unit, avg(CAST(y_true = y_pred AS DOUBLE)) FILTER (WHERE condition = 'F') - avg(CAST(y_true = y_pred AS DOUBLE)) FILTER (WHERE condition = 'O') AS d FROM pred GROUP BY unit)
SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean_delta, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) + 0.0 AS t, count(*) FILTER (WHERE d > 0) AS n_improved FROM u WHERE d IS NOT NULL""")
def leave_one_out(spark, d):
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    runs = predictions(spark, d).select("unit", "condition", right.alias("a"))
    return rounded(M.paired(runs, "unit", "condition", "F", "O", "a").select("n", F.col("mean_diff").alias("mean_delta"), "t", F.col("n_positive").alias("n_improved")))


@query("d11_grid", "SELECT f.x AS factor, b.x AS bits, s.seed, 120 // f.x AS cells, 120 // f.x * b.x / 8.0 AS bytes FROM (SELECT unnest([1, 2, 4, 8]) AS x) f, (SELECT unnest([4, 8, 32]) AS x) b, (SELECT DISTINCT CAST(l_linenumber % 5 AS BIGINT) AS seed FROM lineitem) s")
def grid(spark, d):
    """Factors by bits by the seeds that occur: a product of three short dimensions."""
    seeds = predictions(spark, d).select("seed").distinct()
    sizes = seeds.select(F.explode(F.array(*[F.lit(x).cast("int") for x in (1, 2, 4, 8)])).alias("factor"), "seed").select("factor", F.explode(F.array(*[F.lit(x).cast("int") for x in (4, 8, 32)])).alias("bits"), "seed")
    cells = F.floor(120 / F.col("factor"))
    return sizes.select("factor", "bits", "seed", cells.cast("int").alias("cells"), (cells * F.col("bits") / 8.0).alias("bytes"))


# ---- files and names

FILES = "files AS (SELECT '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, lang AS class, lang || '/' || source AS folder, source AS name, doc_id AS file_no, text AS content, sha1(text) AS digest FROM documents)"


def files(spark, d):
    return D.file_digests(B.files_from_documents(B.table(spark, d, "documents")), None)


@query("e1_inventory", f"WITH {FILES} SELECT class, count(DISTINCT folder) AS n_folders, count(*) AS n_files FROM files GROUP BY ROLLUP (class)")
def inventory(spark, d):
    return D.inventory(files(spark, d))


@query("e2_duplicate_files", f"WITH {FILES} SELECT class, count(*) AS n_files, count(DISTINCT digest) AS n_distinct FROM files GROUP BY class")
def duplicate_files(spark, d):
    return files(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("digest").alias("n_distinct"))


FOLDERS = f"""{FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY class, folder ORDER BY path) - 1 AS o, count(*) OVER (PARTITION BY class, folder) AS n FROM files),
pr AS (SELECT * FROM o WHERE list_contains(list_transform(range(least(12, n)), lambda i: CAST(floor(i * (n - 1) / greatest(least(12, n) - 1, 1)) AS BIGINT)), o)),
fd AS (SELECT class, folder, any_value(name) AS name, any_value(n) AS n, sha1(string_agg(digest, '|' ORDER BY o) || '|' || any_value(n)) AS digest FROM pr GROUP BY class, folder)"""


@query("e3_folder_digests", f"""WITH {FILES}, s AS (SELECT class, folder, count(*) AS n, {', '.join(f"CAST(sum(CAST('0x' || substr(digest, {13 * i + 1}, 13) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(3))} FROM files GROUP BY ALL)
SELECT class, folder, n, sha1(concat_ws('|', s0, s1, s2, n)) AS digest FROM s""")
def folder_digests(spark, d):
    """Digests of folders over the whole contents of all their files."""
    return D.folder_digests(files(spark, d), None).select("class", "folder", "n", "digest")


@query("a6_probe", f"WITH {FOLDERS} SELECT path, o AS place FROM pr")
def probe(spark, d):
    by = Window.partitionBy("class", "folder")
    f = files(spark, d).select("path", (F.row_number().over(by.orderBy("path")) - 1).alias("place"), F.count(F.lit(1)).over(by).alias("n"))
    return f.where(D.probe(F.col("place"), F.col("n"), 12)).select("path", F.col("place").cast("long").alias("place"))


DUP = """dup AS (SELECT lang AS class, lang || '/' || (doc_id % 50) AS folder, CAST(doc_id % 25 AS VARCHAR) AS name, count(*) AS n, sha1(CAST(count(*) AS VARCHAR)) AS digest FROM documents GROUP BY ALL),
a AS (SELECT *, first(folder) OVER (PARTITION BY class, digest ORDER BY length(folder) - length(replace(folder, '/', '')), length(folder), folder) AS w1 FROM dup),
b AS (SELECT *, first(folder) OVER w AS w2, first(n) OVER w AS n2 FROM a WINDOW w AS (PARTITION BY class, name, w1 = folder ORDER BY n DESC, length(folder) - length(replace(folder, '/', '')), folder))"""


@query("e4_dedupe_folders", f"""WITH {DUP} SELECT class, folder, n, w1 = folder AND w2 = folder AS kept, CASE WHEN w1 <> folder THEN w1 WHEN w2 <> folder THEN w2 END AS winner,
CASE WHEN w1 <> folder THEN 'identical' WHEN w2 <> folder THEN 'partial (' || n || ' of ' || n2 || ' files)' END AS reason FROM b""")
def dedupe_folders(spark, d):
    f = B.table(spark, d, "documents").groupBy(F.col("lang").alias("class"), F.concat_ws("/", "lang", F.pmod("doc_id", F.lit(50)).cast("string")).alias("folder"), F.pmod("doc_id", F.lit(25)).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return D.dedupe_folders(f.withColumn("digest", F.sha1(F.col("n").cast("string").cast("binary"))))


@query("d9_content_collisions", f"""WITH {FILES}, s AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '9', file_no)), 1, 8)) AS BIGINT) % 10 < 3 THEN 'test' ELSE 'train' END AS side FROM files)
SELECT class, count(*) AS n_test, count(*) FILTER (WHERE digest IN (SELECT digest FROM s WHERE side = 'train')) AS n_hit FROM s WHERE side = 'test' GROUP BY class""")
def content_collisions(spark, d):
    from ..functions.arrays import draw

    return D.collisions(files(spark, d), F.when(draw(9, F.col("file_no"), 10) < 3, "test").otherwise("train"))


@query("d4_similar_folders", f"""WITH g AS (SELECT lang || '/' || source AS folder, count(*) AS n, median(n_chars) AS m FROM documents GROUP BY ALL)
SELECT a.folder AS a, b.folder AS b, a.n FROM g a JOIN g b ON a.n = b.n AND a.folder < b.folder AND abs(a.m - b.m) <= 400""")
def similar_folders(spark, d):
    g = B.table(spark, d, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("m"))
    return D.similar_pairs(g, "folder", "n", {"m": 400}).select("a", "b", "n")


@query("a3_dominant_shape", """WITH s AS (SELECT lang, len(string_split(text, chr(10))) AS n_lines, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS r FROM s)
SELECT lang, CAST(n_lines AS BIGINT) AS n_lines, n FROM r WHERE r = 1""")
def dominant_shape(spark, d):
    s = B.table(spark, d, "documents").select("lang", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return D.dominant_shape(s, ["lang"], ["n_lines"], "doc_id")


DEALT = """u AS (SELECT lang AS class, lang || '/' || source AS unit, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, unit) AS i FROM u),
w AS (SELECT class, CAST(0 AS BIGINT) AS i, [0::BIGINT, 0, 0, 0, 0] AS load, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS fold FROM o GROUP BY class
  UNION ALL SELECT w.class, o.i, list_transform(load, lambda v, j: CASE WHEN j = list_position(load, list_min(load)) THEN v + o.n ELSE v END), o.unit, o.n, CAST(list_position(load, list_min(load)) - 1 AS BIGINT) FROM w JOIN o ON w.class = o.class AND o.i = w.i + 1)"""


@query("h4_grouped_folds", f"WITH RECURSIVE {DEALT} SELECT class, unit, n, fold FROM w WHERE i > 0")
def grouped_folds(spark, d):
    return P.grouped_folds(documents_as_frames(spark, d), 5)


def documents_as_frames(spark, d):
    return B.table(spark, d, "documents").select(F.col("lang").alias("class"), F.concat_ws("/", "lang", "source").alias("unit"), F.col("doc_id").alias("frame_id"))


@query("h5_random_folds", f"""WITH RECURSIVE {DEALT}, z AS (SELECT class, fold, sum(n) AS size FROM w WHERE i > 0 GROUP BY ALL), q AS (SELECT class, fold, size, sum(size) OVER (PARTITION BY class ORDER BY fold) AS upto FROM z),
d AS (SELECT lang AS class, concat_ws('/', lang, source) AS unit, doc_id AS frame_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '3', doc_id)), doc_id) AS r FROM documents)
SELECT d.class, unit, frame_id, fold FROM d JOIN q ON d.class = q.class AND r <= upto AND r > upto - size""")
def random_folds(spark, d):
    f = documents_as_frames(spark, d)
    return P.random_folds(f, P.grouped_folds(f, 5), 3)


@query("e18_balance", """WITH r AS (SELECT lang AS class, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '4', doc_id)), doc_id) <= round_even(0.2 * count(*) OVER (), 0) THEN 'test' ELSE 'train' END AS side FROM documents)
SELECT side, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6) + 0.0 AS share FROM r GROUP BY side, class""")
def balance(spark, d):
    return rounded(P.balance(P.random_split(documents_as_frames(spark, d), 0.2, 4)))


@query("b1_class_of", "SELECT CASE WHEN lower(url) LIKE '%th%' THEN 'th' WHEN lower(url) LIKE '%er%' THEN 'er' WHEN lower(url) LIKE '%en%' THEN 'en' END AS class, count(*) AS n FROM pages GROUP BY 1")
def class_of(spark, d):
    c = N.class_of(F.col("url"), (("th", "th"), ("er", "er"), ("en", "en")))
    return B.table(spark, d, "pages").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b5_numbers", r"WITH n AS (SELECT page_id, regexp_extract_all(url, '(\d+)', 1) AS x FROM pages) SELECT page_id, CAST(len(x) AS BIGINT) AS n_fields, CAST(x[1] AS BIGINT) AS first, CAST(x[-1] AS BIGINT) AS last FROM n")
def numbers(spark, d):
    x = N.numbers(F.col("url"))
    first = F.when(F.size(x) > 0, F.element_at(x, 1))
    return B.table(spark, d, "pages").select("page_id", F.size(x).cast("long").alias("n_fields"), first.alias("first"), N.last_number(F.col("url")).alias("last"))


@query("b8_naming", r"SELECT CAST(len(regexp_extract_all(url, '(\d+)', 1)) AS BIGINT) AS n_fields, count(*) AS n FROM pages GROUP BY 1")
def naming(spark, d):
    return B.table(spark, d, "pages").groupBy(F.size(N.numbers(F.col("url"))).cast("long").alias("n_fields")).agg(F.count(F.lit(1)).alias("n"))


@query("b9_skeletons", r"WITH s AS (SELECT regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\d+', '#', 'g') AS skeleton FROM pages) SELECT skeleton, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, skeleton LIMIT 5")
def skeletons(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return B.table(spark, d, "pages").groupBy(N.skeleton(path).alias("skeleton")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skeleton").limit(5)


@query("b9_fields", r"""WITH f AS (SELECT unnest(regexp_extract_all(url, '(\d+)', 1)) AS v, unnest(range(len(regexp_extract_all(url, '(\d+)', 1)))) AS i FROM pages), c AS (SELECT i, CAST(v AS BIGINT) AS v, count(*) AS n FROM f GROUP BY ALL)
SELECT i AS field, count(*) AS n_distinct, min(v) AS lo, max(v) AS hi, max(v) - min(v) + 1 = count(*) AS contiguous, round(median(n), 6) + 0.0 AS median_count FROM c GROUP BY i""")
def fields(spark, d):
    f = B.table(spark, d, "pages").select(F.posexplode(N.numbers(F.col("url"))).alias("field", "v")).groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return rounded(f.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.max("v") - F.min("v") + 1 == F.count(F.lit(1))).alias("contiguous"), F.median("n").alias("median_count")))


@query("b11_patterns", r"""SELECT count(*) FILTER (WHERE regexp_extract(url, '\d+') <> '') AS n_integer, count(DISTINCT nullif(regexp_extract(url, '\d+'), '')) AS n_distinct, count(*) FILTER (WHERE regexp_extract(url, 'page=\d+') <> '') AS n_page FROM pages""")
def patterns(spark, d):
    hit = lambda p: F.regexp_extract("url", p, 0)
    return B.table(spark, d, "pages").agg(F.count_if(hit(r"\d+") != "").alias("n_integer"), F.countDistinct(F.when(hit(r"\d+") != "", hit(r"\d+"))).alias("n_distinct"), F.count_if(hit(r"page=\d+") != "").alias("n_page"))


@query("a8_dotted_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def dotted_path(spark, d):
    return B.table(spark, d, "events").select("event_id", K.dig(F.parse_json("props"), "k", "bigint").alias("k"))


@query("k_claims", f"""WITH {ACC}, v AS (SELECT 'mean.F' AS path, avg(a) FILTER (WHERE condition = 'F') AS got FROM acc UNION ALL SELECT 'mean.O', avg(a) FILTER (WHERE condition = 'O') FROM acc UNION ALL SELECT 'lowest', min(a) FROM acc),
c AS (SELECT * FROM (VALUES ('c1', 'accuracy', 'mean.F', 0.8, 0.1), ('c2', 'accuracy', 'mean.O', 0.5, 0.001), ('c3', 'accuracy', 'mean.Z', 0.5, 0.1), ('c4', 'absent', 'mean.F', 0.5, 0.1), ('c5', 'accuracy', 'lowest', 0.5, 0.5)) t(id, report, path, expect, tol))
SELECT c.id, CASE WHEN report = 'absent' THEN 'untested' WHEN got IS NULL THEN 'FAIL: no such value' WHEN abs(got - expect) <= tol + 1e-9 THEN 'ok' ELSE 'FAIL' END AS verdict FROM c LEFT JOIN v USING (path)""")
def claims(spark, d):
    acc = accuracies(spark, d)
    report = acc.agg(F.to_json(F.struct(F.struct(F.avg(F.when(F.col("condition") == "F", F.col("a"))).alias("F"), F.avg(F.when(F.col("condition") == "O", F.col("a"))).alias("O")).alias("mean"), F.min("a").alias("lowest"))).alias("json"))
    reports = report.select(F.lit("accuracy").alias("name"), F.parse_json("json").alias("body"))
    listed = spark.createDataFrame([("c1", "accuracy", "mean.F", 0.8, 0.1), ("c2", "accuracy", "mean.O", 0.5, 0.001), ("c3", "accuracy", "mean.Z", 0.5, 0.1), ("c4", "absent", "mean.F", 0.5, 0.1), ("c5", "accuracy", "lowest", 0.5, 0.5)], "id string, report string, path string, expect double, tol double")
    return K.check(listed, reports).select("id", "verdict")
