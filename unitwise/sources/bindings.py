"""Relations of this library made from general tables: frames, predictions, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import draw

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ROWS, COLS = len(EVENT_TYPES), 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames_from_events(events: DataFrame) -> DataFrame:
    """One frame for each user and day: 5 event types by 24 hours, decibels of the summed value.

    Columns: frame_id, unit (user), frame_idx (day since 2024-01-01), cells. One shuffle sums the cells; those of
    a frame meet in a second one, at most 120 numbers each."""
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    cells = events.groupBy(F.col("user_id").alias("unit"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("frame_idx"), (kind * COLS + F.hour("ts")).cast("int").alias("pos")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(ROWS * COLS - 1)), lambda i: 10 * F.log10(F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)) + 0.001))
    frames = cells.groupBy("unit", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return frames.select((F.col("unit") * 100_000 + F.col("frame_idx")).alias("frame_id"), "unit", "frame_idx", filled.alias("cells"))


def frames_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, class (label), unit (label/(vec_id mod 7)), cells: 4 by 16 decibels x*60 - 60."""
    unit = F.concat_ws("/", F.col("label").cast("string"), F.pmod("vec_id", F.lit(7)).cast("string"))
    return embeddings.select(F.col("vec_id").alias("frame_id"), F.col("label").cast("string").alias("class"), unit.alias("unit"), F.transform("embedding", lambda x: x.cast("double") * 60 - 60).alias("cells"))


def files_from_documents(documents: DataFrame) -> DataFrame:
    """path /{lang}/{source}/{doc_id}.txt, class, folder, file number and content."""
    return documents.select(F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("class"), F.concat_ws("/", "lang", "source").alias("folder"), F.col("source").alias("name"), F.col("doc_id").alias("file_no"), F.col("text").alias("content"))


def predictions_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """y_true = return flag; y_pred is the next class for a share of rows that depends on the supplier. Columns: frame_id, unit, fold, seed, condition, y_true, y_pred."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    wrong = draw(7, key, 1000) < 50 + 30 * F.pmod("l_suppkey", F.lit(10))
    turned = F.when(F.col("l_returnflag") == "A", "N").when(F.col("l_returnflag") == "N", "R").otherwise("A")
    return lineitem.select(key.alias("frame_id"), F.col("l_suppkey").alias("unit"), F.pmod("l_orderkey", F.lit(5)).alias("fold"), F.pmod(F.col("l_linenumber"), F.lit(5)).cast("long").alias("seed"), F.col("l_linestatus").alias("condition"), F.col("l_returnflag").alias("y_true"), F.when(wrong, turned).otherwise(F.col("l_returnflag")).alias("y_pred"))
