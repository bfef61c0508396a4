"""Queries on names, frame statistics, error structure, ranks, verdicts and scopes: the details of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import names as N
from ..operators import experiments as X
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators import splits as P
from ..operators.components import written
from ..sources import bindings as B
from . import claims as K
from .experiments import ACC, CLASSES, PRED, accuracies, predictions
from .frames import EMB, FRAMES, LINEAR, SIDED, featured, frames, sided_turns, vectors
from .registry import ORACLES, query, rounded
from .studies import COVER, CV, FOLDS, compression_rows, normalisation, protocol_rows

NAMED = """named AS (SELECT event_id, user_id % 5 AS folder, concat('pass_', user_id, '_', strftime(ts, '%Y-%m-%d_%H-%M-%S'), '_', event_id, '.csv') AS name FROM events)"""


def named_events(spark, d) -> DataFrame:
    """File names of events: a pass, a date and time, a number."""
    name = F.concat(F.lit("pass_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".csv"))
    return B.table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(5)).cast("long").alias("folder"), name.alias("name"))


@query("b8_naming_examples", f"""WITH {NAMED},
f AS (SELECT folder, name, len(regexp_extract_all(name, '(\\d+)', 1)) AS n_fields FROM named),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, n_fields ORDER BY name) AS r, count(*) OVER (PARTITION BY folder, n_fields) AS n FROM f)
SELECT folder, CAST(n_fields AS BIGINT) AS n_fields, any_value(n) AS n, string_agg(name, '|' ORDER BY name) AS examples FROM r WHERE r <= 6 GROUP BY ALL""")
def naming_examples(spark, d) -> DataFrame:
    """By folder and number of integer fields: how many names, and the first six."""
    f = named_events(spark, d).withColumn("n_fields", F.size(N.numbers(F.col("name"))).cast("long"))
    first = f.withColumn("r", F.row_number().over(Window.partitionBy("folder", "n_fields").orderBy("name"))).where("r <= 6")
    shown = first.groupBy("folder", "n_fields").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("examples"))
    return f.groupBy("folder", "n_fields").agg(F.count(F.lit(1)).alias("n")).join(shown, ["folder", "n_fields"])


@query("b11_token_patterns", f"WITH {NAMED} " + " UNION ALL ".join(f"SELECT folder, '{k}' AS pattern, count(*) AS n_names, count(*) FILTER (WHERE regexp_extract(name, '{p}') <> '') AS n_with, count(DISTINCT nullif(regexp_extract(name, '{p}'), '')) AS n_distinct FROM named GROUP BY folder" for k, p in N.TOKEN_PATTERNS.items()))
def token_patterns(spark, d) -> DataFrame:
    """By folder and kind of token: names that hold one, and how many different first ones."""
    tokens = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), N.first_token(F.col("name"), k).alias("token")) for k in N.TOKEN_PATTERNS]))
    f = named_events(spark, d).select("folder", tokens.alias("x")).select("folder", "x.*")
    return f.groupBy("folder", "pattern").agg(F.count(F.lit(1)).alias("n_names"), F.count("token").alias("n_with"), F.countDistinct("token").alias("n_distinct"))


@query("c13_corrected_concentration", f"""WITH {FRAMES}, {LINEAR},
o AS (SELECT frame_id, unnest(list_reverse_sort(e)) AS x, unnest(range(1, 121)) AS i FROM exc WHERE list_sum(e) > 0),
c AS (SELECT frame_id, sum(x) OVER (PARTITION BY frame_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (PARTITION BY frame_id) AS t FROM o),
k AS (SELECT frame_id, count(*) FILTER (WHERE c < 0.9 * t) + 1 AS k FROM c GROUP BY ALL),
a AS (SELECT frame_id, len(list_filter(linear, lambda x: x > 2 * floor)) / len(linear) AS above FROM exc)
SELECT unit, count(*) AS n, count(k) AS usable, round(median(cells_10db), 6) + 0.0 AS within_10, round(median(cells_20db), 6) + 0.0 AS within_20,
       round(median(k), 6) + 0.0 AS cells_90, round(quantile_cont(k, 0.25), 6) + 0.0 AS cells_90_p25, round(quantile_cont(k, 0.75), 6) + 0.0 AS cells_90_p75,
       round(median(headroom), 6) + 0.0 AS headroom, round(quantile_cont(headroom, 0.1), 6) + 0.0 AS headroom_p10, round(median(above), 6) + 0.0 AS above_floor
FROM feat JOIN a USING (frame_id) LEFT JOIN k USING (frame_id) GROUP BY unit""")
def corrected_concentration(spark, d) -> DataFrame:
    """By unit: extent near the peak, cells for 90 % of the excess over the floor, headroom, and the share of cells above twice the floor."""
    x = F.col("cells")
    f = frames(spark, d).select("unit", A.features(x, B.COLS, ("headroom", "cells_10db", "cells_20db")).alias("f"), A.concentration(x).alias("k"), A.above_floor(x).alias("above"))
    g = f.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("usable"), F.median("f.cells_10db").alias("within_10"), F.median("f.cells_20db").alias("within_20"), F.median("k").alias("cells_90"), F.percentile("k", 0.25).alias("cells_90_p25"), F.percentile("k", 0.75).alias("cells_90_p75"), F.median("f.headroom").alias("headroom"), F.percentile("f.headroom", 0.1).alias("headroom_p10"), F.median("above").alias("above_floor"))
    return rounded(g)


@query("c16_sample_stats", f"""WITH {FRAMES}, x AS (SELECT frame_id, CASE WHEN pos % 40 = frame_id % 40 THEN 'nan'::DOUBLE ELSE v END AS v FROM (SELECT frame_id, unnest(cells) AS v, unnest(range(120)) AS pos FROM frames)),
f AS (SELECT * FROM x WHERE isfinite(v)), g AS (SELECT frame_id, max(v) AS peak, quantile_cont(v, 0.1) AS floor, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM f GROUP BY frame_id)
SELECT frame_id, round(peak, 6) + 0.0 AS peak, round(floor, 6) + 0.0 AS floor, round(peak - floor, 6) + 0.0 AS range, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd,
       count(*) FILTER (WHERE v >= peak - 3) AS within_3, count(*) FILTER (WHERE v >= peak - 6) AS within_6, count(*) FILTER (WHERE v >= peak - 10) AS within_10,
       count(*) FILTER (WHERE v >= floor + 6) AS above_6, count(*) FILTER (WHERE v >= floor + 12) AS above_12, count(*) FILTER (WHERE v >= floor + 20) AS above_20, n
FROM f JOIN g USING (frame_id) GROUP BY ALL""")
def sample_stats(spark, d) -> DataFrame:
    """Statistics of every frame over its finite cells; every fortieth cell is made undefined."""
    holed = F.transform("cells", lambda x, i: F.when(i % 40 == F.pmod("frame_id", F.lit(40)), F.lit(float("nan"))).otherwise(x))
    return rounded(frames(spark, d).select("frame_id", A.sample_stats(holed).alias("s")).select("frame_id", "s.*"))


@query("e6_signal_summary", f"""WITH {FRAMES}, {LINEAR}, h AS (SELECT unit, median(headroom) AS m, median(cells_10db) AS c FROM feat GROUP BY unit)
SELECT unit % 3 AS class, count(*) AS n_units, round(median(m), 6) + 0.0 AS headroom, round(max(m) - min(m), 6) + 0.0 AS spread, round(median(c), 6) + 0.0 AS cells FROM h GROUP BY ALL""")
def signal_summary(spark, d) -> DataFrame:
    """By class: medians over units of headroom and of cells near the peak, and the spread of headroom."""
    h = featured(spark, d, "headroom", "cells_10db").groupBy("unit").agg(F.median("headroom").alias("m"), F.median("cells_10db").alias("c"))
    return rounded(h.groupBy(F.pmod("unit", F.lit(3)).alias("class")).agg(F.count(F.lit(1)).alias("n_units"), F.median("m").alias("headroom"), (F.max("m") - F.min("m")).alias("spread"), F.median("c").alias("cells")))


@query("e19_unit_table", f"""WITH {PRED}, s AS (SELECT unit, seed, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS r FROM pred GROUP BY ALL),
u AS (SELECT unit, CAST(sum(n) AS BIGINT) AS n, avg(r) AS recall, stddev_pop(r) AS recall_sd FROM s GROUP BY unit)
SELECT unit, n, round(recall, 6) + 0.0 AS recall, round(recall_sd, 6) + 0.0 AS recall_sd, round(s_acctbal, 6) + 0.0 AS headroom, rank() OVER (ORDER BY round(recall, 6), unit) AS place FROM u JOIN supplier ON s_suppkey = unit""")
def unit_table(spark, d) -> DataFrame:
    """Every unit's recall over seeds with its deviation and the level it is set against, worst first (place from counts by value, one row each)."""
    r = rounded(M.recall_by_unit(predictions(spark, d)))
    levels = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").cast("double").alias("headroom"))
    table = rounded(r.join(levels, "unit"))
    return table.withColumn("place", F.row_number().over(Window.orderBy("recall", "unit")).cast("long"))  # one row for a unit


@query("f5_shuffle_overlap", f"""WITH {SIDED}, pl AS (SELECT conv_id, id, turn, side, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM sided WINDOW w AS (PARTITION BY conv_id ORDER BY turn, id)),
t AS (SELECT *, CASE WHEN n < 5 THEN n - 1 ELSE n - 3 END AS free, CASE WHEN n < 5 THEN pos ELSE pos - 1 END AS edge, CASE WHEN n < 5 THEN 1 ELSE 3 END AS gap FROM pl WHERE b = turn - 1 AND a = turn + 1),
q AS (SELECT *, CAST(('0x' || substr(md5('0a|' || id), 1, 8)) AS BIGINT) % 1048576 % free AS q1, CAST(('0x' || substr(md5('0b|' || id), 1, 8)) AS BIGINT) % 1048576 % (free - 1) AS q2 FROM t),
s AS (SELECT *, (q1 + 1 + q2) % free AS q3 FROM q), p AS (SELECT conv_id, id, side, unnest([CASE WHEN q1 < edge THEN q1 ELSE q1 + gap END, CASE WHEN q3 < edge THEN q3 ELSE q3 + gap END]) AS at FROM s),
h AS (SELECT p.id AS centre, x.id AS other FROM p JOIN pl x ON x.conv_id = p.conv_id AND x.pos = p.at WHERE p.side = 'train' AND x.side = 'test')
SELECT (SELECT count(*) FROM t WHERE side = 'train') AS n_train, (SELECT count(DISTINCT centre) FROM h) AS n_touching, (SELECT count(DISTINCT other) FROM h) AS n_reached,
       round((SELECT count(DISTINCT other) FROM h) / (SELECT count(*) FROM sided WHERE side = 'test'), 6) + 0.0 AS share_of_test""")
def shuffle_overlap(spark, d) -> DataFrame:
    """How far randomly drawn companions carry test frames into training windows."""
    turns = sided_turns(spark, d)
    return rounded(S.overlap(S.random_companions(turns, "conv_id", "turn", "id"), turns, "id", ["first", "second"]))


ORDERS = {"as_listed": "{id}", "lexicographic": "{name}", "field_0": "{label}{id}", "field_1": "{mod}{id}", "field_2": "{id}", "grouped_by_0": "{label}{mod}{id}", "grouped_by_1": "{mod}{label}{id}", "grouped_by_2": "{id}{label}{mod}"}


def _keys(of: dict[str, object], join) -> dict[str, object]:
    """The sort key of each ordering, from padded fields."""
    return {o: join([of[f] for f in form[1:-1].split("}{")]) for o, form in ORDERS.items()}


_SQL_KEYS = _keys({"id": "lpad(CAST(frame_id AS VARCHAR), 12, '0')", "name": "('v' || class || '_' || CAST(frame_id % 7 AS VARCHAR) || '_' || CAST(frame_id AS VARCHAR))", "label": "lpad(class, 12, '0')", "mod": "lpad(CAST(frame_id % 7 AS VARCHAR), 12, '0')"}, " || ".join)


@query("f7_grouped_orderings", f"""WITH {EMB}, o AS ({' UNION ALL '.join(f"SELECT '{o}' AS ordering, v, {k} AS k FROM u" for o, k in _SQL_KEYS.items())}),
a AS (SELECT ordering, list_inner_product(v, lag(v) OVER (PARTITION BY ordering ORDER BY k)) AS s FROM o), g AS (SELECT ordering, round(avg(s), 6) + 0.0 AS adjacent FROM a GROUP BY ordering)
SELECT ordering, adjacent, row_number() OVER (ORDER BY adjacent DESC, ordering) = 1 AS best FROM g""")
def grouped_orderings(spark, d) -> DataFrame:
    """Mean similarity of neighbours as listed, by name, by each number of the name, and grouped by each number; and the best."""
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    mod = F.col("frame_id") % 7
    keys = _keys({"id": pad(F.col("frame_id")), "name": F.concat(F.lit("v"), "class", F.lit("_"), mod.cast("string"), F.lit("_"), F.col("frame_id").cast("string")), "label": pad(F.col("class")), "mod": pad(mod)}, lambda parts: F.concat(*parts))
    made = F.array(*[F.struct(F.lit(n).alias("ordering"), k.alias("k")) for n, k in keys.items()])
    near = S.with_before(vectors(spark, d).select("v", F.explode(made).alias("x")).select("v", "x.*"), "ordering", "k", "v")
    g = rounded(near.select("ordering", A.dot(F.col("v"), F.col("before")).alias("s")).groupBy("ordering").agg(F.avg("s").alias("adjacent")))
    return g.withColumn("best", F.row_number().over(Window.orderBy(F.desc("adjacent"), "ordering")) == 1)  # one row for an ordering


@query("f10_target_against_others", f"""WITH {COVER}, d AS (SELECT unit, unit LIKE '%/2' AS target, class, round(held_out, 6) AS base, round(half_in - held_out, 6) AS r FROM g),
t AS (SELECT class, max(r) AS own FROM d WHERE target GROUP BY class)
SELECT class, count(*) AS n, max(r) FILTER (WHERE target) + 0.0 AS value, count(*) FILTER (WHERE r > own) + 1 AS rank,
       round((max(r) FILTER (WHERE target) - avg(r) FILTER (WHERE NOT target)) / (stddev_samp(r) FILTER (WHERE NOT target) + 1e-12), 6) + 0.0 AS z,
       round(median(r) FILTER (WHERE NOT target), 6) + 0.0 AS others_median, round(max(r) FILTER (WHERE NOT target), 6) + 0.0 AS others_most, round(coalesce(stddev_samp(r) FILTER (WHERE NOT target), 0), 6) + 0.0 AS others_sd,
       CASE WHEN stddev_pop(base) > 0 AND stddev_pop(r) > 0 THEN round(corr(base, r), 6) + 0.0 END AS pearson,
       CASE WHEN stddev_pop(base) FILTER (WHERE NOT target) > 0 AND stddev_pop(r) FILTER (WHERE NOT target) > 0 THEN round(corr(base, r) FILTER (WHERE NOT target), 6) + 0.0 END AS pearson_without
FROM d JOIN t USING (class) GROUP BY class""")
def target_against_others(spark, d) -> DataFrame:
    """In each class one unit's recovery against the others': rank, z, their spread, and the correlation with baseline recall without it."""
    c = rounded(X.coverage(vectors(spark, d).select("frame_id", "class", "unit", "v"), A.draw(8, F.col("frame_id"), 2) == 0)).withColumn("recovery", F.round("recovery", 6))
    return rounded(M.against_others(c, F.col("unit").endswith("/2"), "recovery", "held_out", ["class"]))


@query("i6_significance", f"""WITH {ACC}, p AS (SELECT seed, fold, avg(a) FILTER (WHERE condition = 'F') - avg(a) FILTER (WHERE condition = 'O') AS d FROM acc GROUP BY seed, fold),
g AS (SELECT seed, count(*) AS n, avg(d) AS mean_diff, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM p WHERE d IS NOT NULL GROUP BY seed),
c AS (SELECT * FROM (VALUES {', '.join(map(str, M.CRITICAL_T.items()))}) v(df, critical))
SELECT seed, n, round(mean_diff, 6) + 0.0 AS mean_diff, round(t, 6) + 0.0 AS t, n - 1 AS df, CAST(coalesce(critical, 2.0) AS DOUBLE) AS critical, coalesce(abs(t) > coalesce(critical, 2.0), false) AS significant FROM g LEFT JOIN c ON df = n - 1""")
def significance(spark, d) -> DataFrame:
    """Differences paired by fold, for each seed, against the critical value of their degrees of freedom."""
    tested = M.paired(accuracies(spark, d), "fold", "condition", "F", "O", "a", by=["seed"])
    return rounded(M.judged_t(tested).select("seed", "n", "mean_diff", "t", "df", "critical", "significant"))


@query("j2_error_structure", f"""WITH {PRED}, k AS (SELECT condition, c AS class, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS hit, count(*) FILTER (WHERE y_true = c) AS support, count(*) FILTER (WHERE y_pred = c) AS said FROM pred, (SELECT unnest({CLASSES}) AS c) GROUP BY ALL),
m AS (SELECT *, hit / greatest(1, support) AS recall, hit / greatest(1, said) AS precision FROM k), f AS (SELECT *, 2 * precision * recall / greatest(1e-9, precision + recall) AS f1 FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY f1, class) AS r FROM f),
x AS (SELECT condition, count(*) FILTER (WHERE y_true = 'A' AND y_pred = 'N') AS other_as_focus, count(*) FILTER (WHERE y_true = 'N' AND y_pred = 'A') AS focus_as_other FROM pred GROUP BY condition)
SELECT condition, round(n.precision, 6) + 0.0 AS precision, round(n.recall, 6) + 0.0 AS recall, n.precision < n.recall AS precision_lower, other_as_focus, focus_as_other, other_as_focus > focus_as_other AS other_leaks_more, w.class AS weakest, round(w.f1, 6) + 0.0 AS weakest_f1
FROM x JOIN f n USING (condition) JOIN w USING (condition) WHERE n.class = 'N' AND w.r = 1""")
def error_structure(spark, d) -> DataFrame:
    return rounded(M.error_structure(predictions(spark, d), ["condition"], CLASSES, "N", "A"))


@query("j4_best_scheme", f"""WITH x AS ({ORACLES['j4_normalisation']}), m AS (SELECT condition, round(avg(accuracy), 6) + 0.0 AS accuracy FROM x GROUP BY condition), p AS (SELECT accuracy AS peak FROM m WHERE condition = 'peak')
SELECT condition, accuracy, row_number() OVER (ORDER BY accuracy DESC, condition) = 1 AS best, accuracy - peak > 0.01 AS beats_peak FROM m, p""")
def best_scheme(spark, d) -> DataFrame:
    """Mean accuracy over folds by scheme, the best of them, and which beat peak-referencing by more than a point."""
    m = rounded(normalisation(spark, d).groupBy("condition").agg(F.avg("accuracy").alias("accuracy")))
    all_of = Window.partitionBy(F.lit(0))  # four schemes
    return m.withColumn("best", F.row_number().over(all_of.orderBy(F.desc("accuracy"), "condition")) == 1).withColumn("beats_peak", F.col("accuracy") - F.max(F.when(F.col("condition") == "peak", F.col("accuracy"))).over(all_of) > 0.01)


@query("j5_recall_by_class", f"""WITH {FOLDS}, {CV}, r AS (SELECT class, unit, round(avg(CAST(class = y_pred AS DOUBLE)), 6) AS recall FROM pr WHERE r = 1 AND protocol = 'grouped' GROUP BY ALL),
h AS (SELECT unit, round(median(list_max(cells) - list_median(cells)), 6) AS headroom FROM e GROUP BY unit),
j AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY recall, unit) AS rr, row_number() OVER (PARTITION BY class ORDER BY headroom, unit) AS rh FROM r JOIN h USING (unit)),
g AS (SELECT class, count(*) AS n_units, corr(recall, headroom) AS p, corr(rr, rh) AS s, stddev_pop(recall) AS sd FROM j GROUP BY class), base AS (SELECT sd AS base FROM g WHERE class = '0')
SELECT class, n_units, round(p, 6) + 0.0 AS pearson, round(s, 6) + 0.0 AS spearman, round(p * sqrt((n_units - 2) / (1 - p * p)), 6) + 0.0 AS t, round(sd, 6) + 0.0 AS recall_sd, CASE WHEN base > 1e-6 THEN round(sd / base, 6) + 0.0 END AS spread_ratio FROM g, base""")
def recall_by_class(spark, d) -> DataFrame:
    """Out-of-fold recall of units against their level, by class, and how its spread compares with the first class's."""
    pred = X.cross_validate(protocol_rows(spark, d).where("protocol = 'grouped'"), ["protocol"])
    recall = pred.groupBy("class", "unit").agg(F.round(F.avg((F.col("class") == F.col("y_pred")).cast("double")), 6).alias("recall"))
    head = vectors(spark, d).groupBy("unit").agg(F.round(F.median(F.array_max("cells") - A.median_of(F.col("cells"))), 6).alias("headroom"))
    j = recall.join(head, "unit")
    g = j.groupBy("class").agg(F.count(F.lit(1)).alias("n_units"), M.pearson(F.col("recall"), F.col("headroom")).alias("pearson"), F.stddev_pop("recall").alias("recall_sd"))
    base = g.where("class = '0'").select(F.col("recall_sd").alias("base"))
    full = g.join(M.spearman(j, ["class"], "recall", "headroom", "unit").drop("n"), "class").join(F.broadcast(base))  # one row
    return rounded(full.select("class", "n_units", "pearson", "spearman", M.t_of_r(F.col("pearson"), F.col("n_units")).alias("t"), "recall_sd", F.when(F.col("base") > 1e-6, F.col("recall_sd") / F.col("base")).alias("spread_ratio")))


GRID = ORACLES["j10_compression_grid"].rsplit(" SELECT split_part(", 1)[0]


@query("j10_gap_verdict", f"""{GRID}, gap_rows AS (SELECT protocol, avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE unit <> '2/4') - avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE unit = '2/4') AS gap,
  avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE unit <> '2/4') AS standard, avg(CAST(class = y_pred AS DOUBLE)) FILTER (WHERE unit = '2/4') AS unseen FROM pr WHERE r = 1 AND class = '2' GROUP BY protocol),
gap_base AS (SELECT max(gap) FILTER (WHERE protocol = '1-32') AS base FROM gap_rows)
SELECT split_part(protocol, '-', 1) AS factor, split_part(protocol, '-', 2) AS bits, round(standard, 6) + 0.0 AS standard, round(unseen, 6) + 0.0 AS unseen, round(gap, 6) + 0.0 AS gap,
       CASE WHEN gap - base > 0.10 THEN 'widens' WHEN gap - base < -0.10 THEN 'narrows' ELSE 'no change' END AS verdict FROM gap_rows, gap_base""")
def gap_verdict(spark, d) -> DataFrame:
    """Recall of a class on its other units and on one unit left out, by factor and bits, and what that does to the gap of the uncompressed input."""
    pred = X.cross_validate(compression_rows(spark, d), ["factor", "bits"]).where("class = '2'")
    hit = (F.col("class") == F.col("y_pred")).cast("double")
    of = lambda own: F.avg(F.when((F.col("unit") == "2/4") == F.lit(own), hit))
    o = pred.groupBy("factor", "bits").agg(of(False).alias("standard"), of(True).alias("unseen")).withColumn("gap", F.col("standard") - F.col("unseen"))
    base = o.where("factor = '1' AND bits = '32'").select(F.col("gap").alias("base"))
    change = F.col("gap") - F.col("base")
    return rounded(o.join(F.broadcast(base)).select("factor", "bits", "standard", "unseen", "gap", F.when(change > 0.10, "widens").when(change < -0.10, "narrows").otherwise("no change").alias("verdict")))  # one row


@query("j16_seed_gaps", f"""WITH {ACC}, v AS (SELECT condition, fold, round(a, 6) AS a FROM acc), n AS (SELECT condition, fold, lead(a) OVER (PARTITION BY condition, fold ORDER BY a) - a AS gap, a FROM v),
g AS (SELECT condition, fold, string_agg(printf('%.6f', a), ' ' ORDER BY a) AS values, avg(a) AS mean, coalesce(stddev_samp(a), 0) AS sd, CASE WHEN count(*) >= 3 AND max(a) > min(a) THEN max(gap) / (max(a) - min(a)) ELSE 0.0 END AS gap FROM n GROUP BY ALL)
SELECT condition, fold, values, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(gap, 6) + 0.0 AS gap, gap > 0.45 AS split FROM g""")
def seed_gaps(spark, d) -> DataFrame:
    """Per-seed values of each condition and fold, and whether one gap splits them."""
    g = M.seed_gaps(accuracies(spark, d).withColumn("a", F.round("a", 6)), ["condition", "fold"], "a")
    return rounded(g.withColumn("values", F.array_join(F.transform("values", lambda x: F.format_string("%.6f", x)), " ")).drop("n"))


CLAIMS = [("c1", "accuracy", "mean.F", 0.8, 0.1, "manuscript"), ("c2", "accuracy", "mean.O", 0.5, 0.001, "artefact"), ("c3", "accuracy", "mean.Z", 0.5, 0.1, None), ("c4", "absent", "mean.F", 0.5, 0.1, "manuscript"), ("c5", "accuracy", "lowest", 0.5, 0.5, "artefact")]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in c) + ")" for c in CLAIMS)


@query("k_scopes", f"""WITH {ACC}, v AS (SELECT 'mean.F' AS path, avg(a) FILTER (WHERE condition = 'F') AS got FROM acc UNION ALL SELECT 'mean.O', avg(a) FILTER (WHERE condition = 'O') FROM acc UNION ALL SELECT 'lowest', min(a) FROM acc),
c AS (SELECT * FROM (VALUES {_VALUES}) t(id, report, path, expect, tol, scope)),
k AS (SELECT coalesce(scope, 'manuscript') AS scope, CASE WHEN report = 'absent' THEN 'untested' WHEN got IS NULL THEN 'FAIL' WHEN abs(got - expect) <= tol + 1e-9 THEN 'ok' ELSE 'FAIL' END AS verdict FROM c LEFT JOIN v USING (path))
SELECT scope, count(*) AS claims, count(*) FILTER (WHERE verdict <> 'untested') AS tested, count(*) FILTER (WHERE verdict = 'ok') AS agreed, count(*) FILTER (WHERE verdict = 'FAIL') AS disagreed, count(*) FILTER (WHERE verdict = 'untested') AS untested FROM k GROUP BY scope""")
def scopes(spark, d) -> DataFrame:
    """Claims of the manuscript and of the artefact, counted apart."""
    acc = accuracies(spark, d)
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("a"))).alias(c)
    report = acc.agg(F.to_json(F.struct(F.struct(of("F"), of("O")).alias("mean"), F.min("a").alias("lowest"))).alias("json"))
    listed = spark.createDataFrame(CLAIMS, "id string, report string, path string, expect double, tol double, scope string")
    return K.summary_by_scope(K.check(listed, report.select(F.lit("accuracy").alias("name"), F.parse_json("json").alias("body"))))


#: Relations that the derivations read: recall, level and recovery of units; runs by condition and seed; predictions.
DERIVED_SQL = f"""
{COVER}, {PRED},
units AS (SELECT class, unit, split_part(unit, '/', 2) AS name, round(held_out, 6) AS recall, round(half_in, 6) AS headroom, round(half_in - held_out, 6) AS recovery FROM g),
runs AS (SELECT CASE WHEN condition = 'F' THEN CASE WHEN fold % 2 = 0 THEN 'neither' ELSE 'input' END ELSE CASE WHEN fold % 2 = 0 THEN 'weights' ELSE 'both' END END AS condition, seed, avg(CAST(y_true = y_pred AS DOUBLE)) AS value FROM pred GROUP BY ALL),
ww AS (
  SELECT seed, max(value) FILTER (WHERE condition = 'neither') AS n, max(value) FILTER (WHERE condition = 'input') AS i, max(value) FILTER (WHERE condition = 'weights') AS w, max(value) FILTER (WHERE condition = 'both') AS b FROM runs GROUP BY seed
), dd AS (SELECT n - b AS d, b - i - w + n AS x FROM ww),
cc AS (SELECT condition, avg(value) AS m, var_samp(value) / count(*) AS q, min(value) AS lo, max(value) AS hi FROM runs GROUP BY condition),
kk AS (SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS k FROM dd)"""
WELCH = "(SELECT (x.m - y.m) / sqrt(x.q + y.q) FROM cc x, cc y WHERE x.condition = 'neither' AND y.condition = 'both')"
PAIR_T = "(SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) FROM dd)"
DERIVED = {
    "session_recall": "(SELECT min(recall) FROM units WHERE unit = '2/4')",
    "min_session_recall": "(SELECT min(recall) FROM units WHERE class = '2')",
    "session_recall_extreme": "(SELECT max(recall) FROM units WHERE class = '2' AND name <> '4')",
    "units_above": "(SELECT count(*) FROM units WHERE recall > 0.5 AND name <> '4')",
    "recall_sd_excluding": "(SELECT stddev_samp(recall) FROM units WHERE name <> '4')",
    "pearson_excluding": "(SELECT corr(recall, headroom) FROM units WHERE name <> '4')",
    "recovery_of": "(SELECT min(recovery) FROM units WHERE name = '4')",
    "recovery_extreme": "(SELECT max(recovery) FROM units WHERE name <> '4')",
    "recovery_sd_excluding": "(SELECT stddev_samp(recovery) FROM units WHERE name <> '4')",
    "predicted_fraction": "(SELECT avg(CAST(y_pred = 'N' AS DOUBLE)) FROM pred WHERE unit = 7 AND condition = 'F')",
    "welch_t": WELCH,
    "welch_t_abs": f"abs({WELCH})",
    "augment_value": "(SELECT m FROM cc WHERE condition = 'input')",
    "ablate_drop": "(SELECT max(m) FILTER (WHERE condition = 'neither') - max(m) FILTER (WHERE condition = 'both') FROM cc)",
    "interaction_contrast": "(SELECT avg(x) FROM dd)",
    "interaction_contrast_t": "(SELECT avg(x) / (stddev_samp(x) / sqrt(count(*))) FROM dd)",
    "paired_t": PAIR_T,
    "paired_t_abs": f"abs({PAIR_T})",
    "paired_mean_diff": "(SELECT avg(d) FROM dd)",
    "paired_n_positive": "(SELECT k FROM kk)",
    "separation_gap": "(SELECT max(lo) FILTER (WHERE condition = 'neither') - max(hi) FILTER (WHERE condition = 'both') FROM cc)",
    "sign_test_p": "(SELECT sum(factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER))) / pow(2, n)) FROM kk, (SELECT unnest(range(0, 50)) AS i) WHERE i >= k AND i <= n)",
}


@query("k_derivations", f"WITH {DERIVED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(CAST({q} AS DOUBLE), 6) + 0.0 AS got" for n, q in DERIVED.items()))
def derivations(spark, d) -> DataFrame:
    """Every registered derivation by its name, over units, runs and predictions made from the tables."""
    c = rounded(X.coverage(vectors(spark, d).select("frame_id", "class", "unit", "v"), A.draw(8, F.col("frame_id"), 2) == 0))
    units = written(c.select("class", "unit", F.col("held_out").alias("recall"), F.col("half_in").alias("headroom"), F.round("recovery", 6).alias("recovery")))
    pred = predictions(spark, d)
    even = F.pmod("fold", F.lit(2)) == 0
    condition = F.when(F.col("condition") == "F", F.when(even, "neither").otherwise("input")).otherwise(F.when(even, "weights").otherwise("both"))
    runs = written(pred.groupBy(condition.alias("condition"), "seed").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value")))
    pair = {"first": "neither", "second": "both"}
    asked = {
        "session_recall": (units, {"unit": "4", "cls": "2"}), "min_session_recall": (units, {"cls": "2"}), "session_recall_extreme": (units, {"which": "max", "cls": "2", "exclude": "4"}),
        "units_above": (units, {"threshold": 0.5, "exclude": "4"}), "recall_sd_excluding": (units, {"exclude": "4"}), "pearson_excluding": (units, {"exclude": "4"}),
        "recovery_of": (units, {"unit": "4"}), "recovery_extreme": (units, {"which": "max", "exclude": "4"}), "recovery_sd_excluding": (units, {"exclude": "4"}),
        "predicted_fraction": (pred.withColumn("unit", F.col("unit").cast("string")), {"cls": "N", "unit": "7", "condition": "F"}),
        "augment_value": (runs, {"condition": "input"}), "ablate_drop": (runs, {"base": "neither", "condition": "both"}),
        "interaction_contrast": (runs, {}), "interaction_contrast_t": (runs, {}), "sign_test_p": (runs, {**pair, "sided": "upper"}),
        **{n: (runs, pair) for n in ("welch_t", "welch_t_abs", "paired_t", "paired_t_abs", "paired_mean_diff", "paired_n_positive", "separation_gap")},
    }
    out = None
    for name, (relation, args) in asked.items():
        one = K.DERIVATIONS[name](relation, **args).select(F.lit(name).alias("name"), F.col("got"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("b4_session_units", r"""WITH s AS (SELECT DISTINCT 'c' || (user_id % 3) AS class, CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%H-%M') || '_' || user_id ELSE 'session ' || user_id END AS session FROM events),
u AS (SELECT class, session, coalesce(nullif(regexp_extract(session, '^(\d{1,2}-\d{2})', 1), ''), session) AS unit FROM s)
SELECT class, unit, class || '/' || unit AS key, count(*) AS n_sessions, min(session) AS first FROM u GROUP BY class, unit""")
def session_units(spark, d) -> DataFrame:
    """Units of each class from the leading HH-MM of session names (else the whole name), with their keys and how many sessions they join."""
    user = F.col("user_id")
    named = F.when(F.pmod(user, F.lit(2)) == 0, F.concat(F.date_format("ts", "HH-mm"), F.lit("_"), user.cast("string"))).otherwise(F.concat(F.lit("session "), user.cast("string")))
    sessions = B.table(spark, d, "events").select(F.concat(F.lit("c"), F.pmod(user, F.lit(3)).cast("string")).alias("class"), named.alias("session")).distinct()
    units = sessions.withColumn("unit", N.unit_of(F.concat(F.lit("x/"), "session"))).withColumn("key", N.unit_key(F.col("class"), F.col("unit")))
    cls, name = N.split_key(F.col("key"))
    return units.groupBy(cls.alias("class"), name.alias("unit"), "key").agg(F.count(F.lit(1)).alias("n_sessions"), F.min("session").alias("first"))


@query("f1_folder_index", r"""WITH i AS (SELECT page_id, page_id % 10 AS folder, TRY_CAST(regexp_extract_all(url, '(\d+)', 1)[-1] AS BIGINT) AS idx FROM pages)
SELECT folder, page_id, idx, row_number() OVER (PARTITION BY folder ORDER BY idx, page_id) - 1 AS pos FROM i WHERE idx IS NOT NULL""")
def folder_index(spark, d) -> DataFrame:
    pages = B.table(spark, d, "pages").select("page_id", "url", F.pmod("page_id", F.lit(10)).alias("folder"))
    return S.folder_index(pages, "folder", "url", "page_id")


@query("c11_first_frames", f"""WITH {EMB}, f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY CAST(frame_id AS VARCHAR)) AS r FROM e),
t AS (SELECT frame_id, unit, cells, list_max(cells) AS peak, list_transform(list_sort(list_transform(cells, lambda x, i: {{'v': -x, 'i': i}}))[1:12], lambda s: s.i) AS k FROM f WHERE r <= 5),
z AS (SELECT frame_id, unit, list_transform(cells, lambda x, i: CASE WHEN list_contains(k, i) THEN x - peak ELSE 0.0 END) AS z FROM t),
c AS (SELECT frame_id, unit, list_transform(z, lambda x: x - list_sum(z) / len(z)) AS c FROM z),
n AS (SELECT frame_id, unit, list_transform(c, lambda x: x / CASE WHEN list_inner_product(c, c) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END) AS n FROM c)
SELECT frame_id, unit, round(list_max(n), 6) + 0.0 AS hi, round(list_min(n), 6) + 0.0 AS lo FROM n""")
def first_frames(spark, d) -> DataFrame:
    """Features of the strongest cells for the first five frames of each unit, in the order of their names as text."""
    first = P.first_of(vectors(spark, d).withColumn("name", F.col("frame_id").cast("string")), 5, ["unit"], ["name"])
    return rounded(first.select("frame_id", "unit", A.top_cells(F.col("cells"), 12).alias("n")).select("frame_id", "unit", F.array_max("n").alias("hi"), F.array_min("n").alias("lo")))


@query("j8_predicted_fractions", f"""WITH {COVER} SELECT unit, condition, y_pred, round(count(*) / sum(count(*)) OVER (PARTITION BY unit, condition), 6) + 0.0 AS fraction FROM p WHERE r = 1 GROUP BY unit, condition, y_pred""")
def predicted_fractions(spark, d) -> DataFrame:
    """Which classes the second half of each unit is given, when the unit is held out and when its first half trains."""
    rows = vectors(spark, d).select("frame_id", "class", "unit", "v")
    return rounded(X.predicted_fractions(X.coverage_predictions(rows, A.draw(8, F.col("frame_id"), 2) == 0), ["unit", "condition"]))


@query("j8_verdicts", f"""WITH {COVER}, v AS (SELECT class, unit, round(half_in - held_out, 6) + 0.0 AS recovery FROM g) SELECT class, unit, recovery, CASE WHEN recovery > 0.30 THEN 'coverage' WHEN recovery > 0.10 THEN 'partial' ELSE 'little' END AS verdict FROM v""")
def verdicts(spark, d) -> DataFrame:
    """What each unit's recovery says: missing coverage, a part of it, or neither."""
    c = rounded(X.coverage(vectors(spark, d).select("frame_id", "class", "unit", "v"), A.draw(8, F.col("frame_id"), 2) == 0))
    return c.select("class", "unit", F.round("recovery", 6).alias("recovery")).withColumn("verdict", X.coverage_verdict(F.col("recovery")))
