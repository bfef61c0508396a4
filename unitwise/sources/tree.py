"""Trees of small matrix files, and the tables and reports that are written from them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import KEYWORDS, class_of, last_number, short_name, unit_of
from ..operators.splits import straddling, validated


def parse_matrix(text: Column) -> Column:
    """A struct n_rows, n_cols, cells of a text of numbers; null if it is no matrix of two rows and columns at least, or is ragged.

    Commas are tried first, then white space, then semicolons; a parse counts if every field is a number."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")

    def parsed(delimiter: str) -> Column:
        rows = F.transform(lines, lambda x: F.transform(F.split(x, delimiter), lambda y: F.trim(y).try_cast("double")))
        widths = F.transform(rows, F.size)
        cells = F.flatten(rows)
        good = (F.size(rows) > 1) & (F.array_min(widths) == F.array_max(widths)) & (F.array_min(widths) > 1) & ~F.exists(cells, lambda v: v.isNull())
        return F.when(good, F.struct(F.size(rows).alias("n_rows"), F.array_max(widths).alias("n_cols"), cells.alias("cells")))

    return F.coalesce(parsed(","), parsed(r"\s+"), parsed(";"))


def _below(spark: SparkSession, path: Column, root: str) -> Column:
    """The components of a file's path below the root, the file's own name last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    depth = len([x for x in re.sub("^[a-z0-9+.-]+:/+", "", whole).split("/") if x])
    return F.slice(F.filter(F.split(F.regexp_replace(path, "^[a-z0-9+.-]+:/+", ""), "/"), lambda x: x != ""), depth + 1, 1 << 20)


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("csv", "txt", "dat"), keywords: tuple[tuple[str, str], ...] = KEYWORDS) -> DataFrame:
    """Every data file below root whose path below it names a class: path, class, folder, name (last folder), unit, frame_idx, content.

    Suffixes match whatever their case. The class is that of the last folder that names one; unmapped files fall away.
    Spark's readers pass over files without a byte; `empty_files` lists these."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = raw.select("path", F.col("content").cast("string").alias("content"), _below(spark, F.col("path"), root).alias("parts"))
    parts = F.slice("parts", 1, F.size("parts") - 1)
    classes = F.filter(F.transform(parts, lambda p: class_of(p, keywords)), lambda c: c.isNotNull())
    folder = F.array_join(parts, "/")
    out = files.select("path", F.when(F.size(classes) > 0, F.element_at(classes, -1)).alias("class"), folder.alias("folder"), "content").where("class is not null")
    return out.select("path", "class", "folder", short_name(F.col("folder")).alias("name"), unit_of(F.col("folder")).alias("unit"), last_number(short_name(F.col("path"))).alias("frame_idx"), "content")


def empty_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("csv", "txt", "dat")) -> DataFrame:
    """(path, error) of the data files below root that hold nothing, from the file system's own listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and f.getPath().getName().lower().endswith(tuple(f".{s}" for s in suffixes)):
            found.append((f.getPath().toString(), "empty"))
    return spark.createDataFrame(found, "path string, error string")


def probe(files: DataFrame, folder: str, path: str, n: int) -> DataFrame:
    """At most n (two or more) evenly spaced files of each folder in the order of their paths, with place; all files of smaller folders."""
    w = Window.partitionBy(folder)
    placed = files.withColumn("place", F.row_number().over(w.orderBy(path)) - 1).withColumn("n_files", F.count(F.lit(1)).over(w))
    j = F.ceil(F.col("place") * (n - 1) / (F.col("n_files") - 1)).cast("long")  # the one step that can fall on this place
    hit = F.floor(j * (F.col("n_files") - 1) / F.lit(n - 1))
    return placed.where((F.col("n_files") <= n) | (hit == F.col("place"))).drop("n_files")


def manifest(files: DataFrame, n: int | None = 60) -> DataFrame:
    """(path, class, folder, place, numbers in the name, n_rows, n_cols, low, high, mean, error) of evenly spaced files of each folder (n None: of all)."""
    chosen = probe(files, "folder", "path", n or 1 << 40)
    m = chosen.withColumn("m", parse_matrix(F.col("content")))
    cells = F.col("m.cells")
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)
    error = F.when(F.length(F.trim("content")) == 0, "empty").when(F.col("m").isNull(), "no matrix of numbers")
    return m.select("path", "class", "folder", "place", F.regexp_extract_all(short_name(F.col("path")), F.lit("([0-9]+)"), 1).alias("numbers"), "m.n_rows", "m.n_cols", F.array_min(cells).alias("low"), F.array_max(cells).alias("high"), mean.alias("mean"), error.alias("error"))


def shapes_and_failures(files: DataFrame, n: int = 40) -> tuple[DataFrame, DataFrame]:
    """(folder, n_rows, n_cols, n) of evenly spaced files, and the (folder, path, error) of those that hold no matrix."""
    m = manifest(files, n)
    return m.where("error is null").groupBy("folder", "n_rows", "n_cols").agg(F.count(F.lit(1)).alias("n")), m.where("error is not null").select("folder", "path", "error")


def dataset(files: DataFrame, sides: DataFrame, val_frac: float = 0.15, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames with sides, the files set aside, and the units that stand on several sides (none, or the split is at fault).

    sides: (class, unit, side). Files are parsed, those of the most frequent shape are kept, and of each class's train
    units a share goes to validation."""
    frames, rest = frames_of(files)
    sided = frames.join(sides.select("class", "unit", "side"), ["class", "unit"])
    carved = validated(sided, val_frac, seed, key="path")
    return carved, rest, straddling(carved.withColumn("unit", F.concat_ws("/", "class", "unit")))


def frames_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, quarantine): parsed files of the most frequent shape, and those that did not parse or have another shape."""
    parsed = files.withColumn("m", parse_matrix(F.col("content"))).drop("content")
    shapes = parsed.where("m is not null").groupBy("m.n_rows", "m.n_cols").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    top = shapes.orderBy(F.desc("n"), "first").limit(1).select("n_rows", "n_cols")
    flat = parsed.select("*", "m.n_rows", "m.n_cols", "m.cells").drop("m")
    frames = flat.join(F.broadcast(top), ["n_rows", "n_cols"])  # one row
    rest = flat.join(F.broadcast(top), ["n_rows", "n_cols"], "left_anti").select("path", "class", "folder", "n_rows", "n_cols")
    return frames, rest


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.partitionBy("class").mode("overwrite").parquet(path)


def write_split(sided: DataFrame, path: str, protocol: str, seed: int) -> None:
    """Writes a split, one folder for each protocol and seed; one written before under the same names is replaced."""
    named = sided.withColumns({"protocol": F.lit(protocol), "seed": F.lit(seed)})
    named.write.partitionBy("protocol", "seed").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_split(spark: SparkSession, path: str, protocol: str, seed: int) -> DataFrame:
    """A split as it was written."""
    return spark.read.parquet(path).where((F.col("protocol") == protocol) & (F.col("seed") == seed)).drop("protocol", "seed")


def write_report(body: DataFrame, folder: str, name: str) -> None:
    """Writes the one row of `body` as <folder>/<name>.json, whole or not at all; one written before under the name is replaced.

    The row becomes a file beside its place and is renamed there, so a reader sees the old report or the new one. A table
    of several rows is an error, an empty one too: a report is one document."""
    spark = body.sparkSession
    lines = body.limit(2).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"ignoreNullFields": "false"}).alias("value"))
    apart = f"{folder.rstrip('/')}/.{name}-{uuid.uuid4().hex[:12]}"
    lines.coalesce(1).write.text(apart)
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, target = hadoop.Path(apart), hadoop.Path(f"{folder.rstrip('/')}/{name}.json")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if spark.read.text(apart).count() != 1:
            raise ValueError(f"report {name}: one row is needed")
        part = next(s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-") and s.getLen())
        if fs.exists(target) and not fs.rename(target, hadoop.Path(f"{apart}/before")):
            raise OSError(f"report {name}: the old one cannot be put aside")
        if not fs.rename(part, target):
            raise OSError(f"report {name}: cannot be put in place")
    finally:
        fs.delete(place, True)


def read_reports(spark: SparkSession, folder: str, candidates: dict[str, list[str]]) -> DataFrame:
    """(name, body): for each report the first of its candidate files that exists, as a VARIANT."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(short_name(F.col("_metadata.file_path")).alias("file"), "value")
    asked = spark.createDataFrame([(n, f, i) for n, fs in candidates.items() for i, f in enumerate(fs)], "name string, file string, rank int")
    first = Window.partitionBy("name").orderBy("rank")
    return raw.join(F.broadcast(asked), "file").withColumn("r", F.row_number().over(first)).where("r = 1").select("name", F.parse_json("value").alias("body"))
