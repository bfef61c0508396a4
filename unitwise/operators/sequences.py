"""Consecutive-frame windows and what they carry across a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import centre, dot, draw, unit
from ..functions.names import last_number
from .components import written


def folder_index(files: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """(folder, key, idx, pos): a folder's files in the order of the last integer of their names, then of key; names without one are left out."""
    indexed = files.select(folder, key, last_number(F.col(name)).alias("idx")).where("idx IS NOT NULL")
    return indexed.withColumn("pos", (F.row_number().over(Window.partitionBy(folder).orderBy("idx", key)) - 1).cast("long"))


def triplets(frames: DataFrame, folder: str, index: str, key: str) -> DataFrame:
    """(folder, before, centre, after): frames whose indices are i-1, i, i+1; never over a gap or a folder's end."""
    w = Window.partitionBy(folder).orderBy(index, key)
    near = frames.select(folder, F.col(key).alias("centre"), *[F.struct(F.lag(index, d).over(w).alias("i"), F.lag(key, d).over(w).alias("k")).alias(n) for d, n in ((1, "p"), (-1, "f"))], F.col(index).alias("i"))
    return near.where("p.i = i - 1 and f.i = i + 1").select(folder, F.col("p.k").alias("before"), "centre", F.col("f.k").alias("after"))


def random_companions(frames: DataFrame, folder: str, index: str, key: str, seed: int = 0) -> DataFrame:
    """For each triplet two other frames of its folder, drawn by position past the triplet's own three.

    In folders of under five frames, which have no two left, they are drawn from all but the centre (fallback)."""
    w = Window.partitionBy(folder).orderBy(index, key)
    placed = frames.select(folder, key, (F.row_number().over(w) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(folder)).alias("n"))
    centre_at = triplets(frames, folder, index, key).join(placed.withColumnRenamed(key, "centre"), [folder, "centre"])
    fallback = F.col("n") < 5
    free, gap, edge = F.when(fallback, F.col("n") - 1).otherwise(F.col("n") - 3), F.when(fallback, 1).otherwise(3), F.when(fallback, F.col("pos")).otherwise(F.col("pos") - 1)
    q1 = draw(f"{seed}a", F.col("centre"), 1 << 20) % free
    q2 = (q1 + 1 + draw(f"{seed}b", F.col("centre"), 1 << 20) % (free - 1)) % free
    skip = lambda q: F.when(q < edge, q).otherwise(q + gap)
    asked = centre_at.select(folder, "centre", fallback.alias("fallback"), skip(q1).alias("p1"), skip(q2).alias("p2"))
    at = lambda p, name: placed.select(folder, F.col("pos").alias(p), F.col(key).alias(name))
    return asked.join(at("p1", "first"), [folder, "p1"]).join(at("p2", "second"), [folder, "p2"]).select(folder, "centre", "first", "second", "fallback")


def clean_companions(frames: DataFrame, folder: str, index: str, key: str, tag: str) -> DataFrame:
    """For each frame the two nearest of its folder with the same tag, by distance of rank in the folder (ties: the earlier); itself where one is missing.

    Two frames on either side in the (folder, tag) order are enough, so windows take the place of a join."""
    placed = frames.select(folder, key, tag, F.row_number().over(Window.partitionBy(folder).orderBy(index, key)).alias("pos"))
    w = Window.partitionBy(folder, tag).orderBy("pos")
    side = [F.struct(F.abs(F.lag("pos", d).over(w) - F.col("pos")).alias("d"), F.lit(0 if d > 0 else 1).alias("s"), F.lag(key, d).over(w).alias("k")) for d in (1, 2, -1, -2)]
    near = F.slice(F.array_sort(F.filter(F.array(*side), lambda s: s["k"].isNotNull())), 1, 2)
    out = placed.select(folder, key, tag, near.alias("near"))
    pick = lambda i: F.coalesce(F.get("near", i)["k"], F.col(key))
    return out.select(folder, key, tag, pick(0).alias("first"), pick(1).alias("second"), (F.size("near") < 2).alias("fallback"), F.aggregate("near", F.lit(0), lambda a, s: a + s["d"]).cast("long").alias("distance"))


def overlap(companions: DataFrame, sides: DataFrame, key: str, members: list[str]) -> DataFrame:
    """One row: training windows, those that touch a test frame, distinct test frames reached, and their share of all test frames."""
    train = companions.join(sides.where("side = 'train'").select(F.col(key).alias("centre")), "centre", "left_semi")
    flat = train.select("centre", F.explode(F.array(*members)).alias(key)).join(sides.select(key, "side"), key)
    touched = flat.where("side = 'test'").agg(F.countDistinct("centre").alias("n_touching"), F.countDistinct(key).alias("n_reached"))
    return train.agg(F.count(F.lit(1)).alias("n_train")).join(touched).join(sides.where("side = 'test'").agg(F.count(F.lit(1)).alias("n_test"))).select("n_train", "n_touching", "n_reached", (F.col("n_reached") / F.col("n_test")).alias("share_of_test"))


def adjacency(frames: DataFrame, folder: str, index: str, key: str, cells: Column) -> DataFrame:
    """(folder, key, correlation with the frame before): dot of centred unit vectors; null for a folder's first."""
    w = Window.partitionBy(folder).orderBy(index, key)
    vectors = frames.select(folder, index, key, unit(centre(cells)).alias("v"))
    return vectors.select(folder, index, key, dot(F.col("v"), F.lag("v").over(w)).alias("corr"))


def runs(scored: DataFrame, folder: str, index: str, key: str, threshold: float) -> DataFrame:
    """(folder, run, length): a new run starts where the correlation with the frame before is below the threshold."""
    w = Window.partitionBy(folder).orderBy(index, key)
    cut = scored.withColumn("run", F.sum(F.when(F.col("corr") < threshold, 1).otherwise(0)).over(w))
    return cut.groupBy(folder, "run").agg(F.count(F.lit(1)).alias("length"))


def numbering(frames: DataFrame, folder: str, index: str) -> DataFrame:
    """(folder, n, lo, hi, span, missing, contiguous); rows without an index do not count."""
    g = frames.where(F.col(index).isNotNull()).groupBy(folder).agg(F.countDistinct(index).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    span = F.col("hi") - F.col("lo") + 1
    return g.select(folder, "n", "lo", "hi", span.alias("span"), (span - F.col("n")).alias("missing"), (span == F.col("n")).alias("contiguous"))


def with_before(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with `before`: the value of the row before in (by, order), null for a group's first. No group has to fit one task.

    Rows are dealt by ranges of (by, order) and written; inside a range a window looks back, and the first row of a
    range takes the last one of the ranges before it, of which there is one row each."""
    dealt = written(rows.repartitionByRange(by, order).withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part").agg(F.max_by(F.struct(F.col(by).alias("g"), F.col(value).alias("x")), F.struct(by, order)).alias("last"))
    edge = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("edge"))
    w = Window.partitionBy("part").orderBy(by, order)
    here = F.lag(F.struct(F.col(by).alias("g"), F.col(value).alias("x"))).over(w)
    near = F.coalesce(here, F.col("edge"))
    looked = dealt.join(F.broadcast(edge), "part").withColumn("near", near)
    return looked.select(*rows.columns, F.when(F.col("near.g") == F.col(by), F.col("near.x")).alias("before"))
