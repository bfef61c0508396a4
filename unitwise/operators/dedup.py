"""Content digests, duplicate folders, collisions across a split, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe(order: Column, n: Column, k: int) -> Column:
    """True for the places (from 0) that k evenly spaced, truncated steps over n rows reach."""
    k = F.lit(k)
    steps = F.transform(F.sequence(F.lit(0), F.least(k, n) - 1), lambda i: F.floor(i * (n - 1) / F.greatest(F.least(k, n) - 1, F.lit(1))))
    return F.array_contains(steps, order)


def file_digests(files: DataFrame, first_bytes: int | None = 65536) -> DataFrame:
    """files with the sha1 of the content's first bytes; first_bytes=None takes the whole content."""
    content = F.col("content").cast("binary")
    return files.withColumn("digest", F.sha1(content if first_bytes is None else F.substring(content, 1, first_bytes)))


def folder_digests(files: DataFrame, n_probe: int | None = 12) -> DataFrame:
    """(class, folder, name, n, digest): sha1 over the digests of up to n_probe evenly spaced files in path order, and the count.

    Only the probed rows of a folder meet in one list, so its size is bounded. n_probe=None takes all files: three sums over 52 bits
    each of their digests, and the count, are hashed, so that a folder of any size is combined by partial sums; its order does not count."""
    if n_probe is None:
        part = lambda i: F.sum(F.conv(F.substring("digest", 13 * i + 1, 13), 16, 10).cast("decimal(20,0)")).cast("string")
        g = files.groupBy("class", "folder").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), *[part(i).alias(f"s{i}") for i in range(3)])
        return g.select("class", "folder", "name", "n", F.sha1(F.concat_ws("|", "s0", "s1", "s2", F.col("n").cast("string"))).alias("digest"))
    by = Window.partitionBy("class", "folder")
    placed = files.withColumn("o", F.row_number().over(by.orderBy("path")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    kept = placed.where(probe(F.col("o"), F.col("n"), n_probe))
    joined = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("o", "digest"))), lambda s: s["digest"]), F.first("n").cast("string"))
    return kept.groupBy("class", "folder").agg(F.first("name").alias("name"), F.first("n").alias("n"), F.sha1(joined).alias("digest"))


def dedupe_folders(folders: DataFrame) -> DataFrame:
    """folders with kept, winner and reason.

    First, of folders with one digest in a class the one of fewest separators, then shortest, then first stays;
    then, of those with one short name, the one of most files, then fewest separators, then first."""
    depth = F.size(F.split("folder", "/"))
    one = Window.partitionBy("class", "digest").orderBy(depth, F.length("folder"), "folder")
    first = folders.withColumn("w1", F.first("folder").over(one))
    two = Window.partitionBy("class", "name", F.col("w1") == F.col("folder")).orderBy(F.desc("n"), depth, "folder")
    second = first.withColumn("w2", F.first("folder").over(two)).withColumn("n2", F.first("n").over(two))
    identical, partial = F.col("w1") != F.col("folder"), F.col("w2") != F.col("folder")
    return second.select(
        "class", "folder", "n",
        (~identical & ~partial).alias("kept"),
        F.when(identical, F.col("w1")).when(partial, F.col("w2")).alias("winner"),
        F.when(identical, F.lit("identical")).when(partial, F.format_string("partial (%d of %d files)", F.col("n"), F.col("n2"))).alias("reason"),
    )


def collisions(files: DataFrame, side: Column) -> DataFrame:
    """By class: test files, and those whose content digest stands on the train side too. No content is joined, only digests."""
    sided = files.select("class", "path", "digest", side.alias("side"))
    train = sided.where("side = 'train'").select("digest").distinct().withColumn("hit", F.lit(1))
    test = sided.where("side = 'test'").join(train, "digest", "left")
    return test.groupBy("class").agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_hit"))


def inventory(files: DataFrame) -> DataFrame:
    """Folders and files by class, and in total (class null)."""
    return files.rollup("class").agg(F.countDistinct("folder").alias("n_folders"), F.count(F.lit(1)).alias("n_files"))


def dominant_shape(rows: DataFrame, group: list[str], shape: list[str], order: str) -> DataFrame:
    """The most frequent shape of each group; ties go to the shape seen first in `order`."""
    counted = rows.groupBy(*group, *shape).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", best).where("r = 1").drop("r", "first")


def similar_pairs(units: DataFrame, key: str, n: str, near: dict[str, float]) -> DataFrame:
    """Pairs a < b of equal n whose columns differ by at most the given amounts.

    Rows meet on n and on a bucket of each column, as wide as its amount (a tenth more), so units of one size do not all meet; those
    of side b stand in the neighbouring buckets too. Columns with an amount of 0 have to be equal; nulls are near nothing."""
    at = lambda c: F.floor(F.col(c) / (1.1 * near[c])) if near[c] else F.col(c)
    columns = list(near)

    def side(x: str, spread: bool) -> DataFrame:
        out = units.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)) if columns else units
        out = out.select(F.col(n).alias("n"), F.col(key).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns], *[at(c).alias(f"bucket_{c}") for c in columns])
        for c in columns:
            if spread and near[c]:
                out = out.withColumn(f"bucket_{c}", F.explode(F.sequence(F.col(f"bucket_{c}") - 1, F.col(f"bucket_{c}") + 1)))
        return out

    pairs = side("a", False).join(side("b", True), ["n", *[f"bucket_{c}" for c in columns]]).where("a < b")
    for c, most in near.items():
        pairs = pairs.where(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= most)
    return pairs.drop(*[f"bucket_{c}" for c in columns])
