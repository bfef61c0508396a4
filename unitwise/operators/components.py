"""Connected components of an edge table, and a sweep over similarity thresholds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SALTS = 8
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that the driver and all executors see; in local mode, where it is unset, a temporary one of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="unitwise-"))


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder, so that lineage ends and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/components-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): each node of edges (a, b), and of `nodes`, with the least node of its component.

    Label propagation with pointer jumping. Edges are dealt by both ends' salted keys, so that a hub's edges lie in
    `SALTS` tasks; its label is sent to each of them. A component's own label is looked up once and sent to as many
    tasks, so a large component does not meet in one. Each round's labels replace those before."""
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    changed, before = 1, None
    while changed:
        known = labels.select(F.col("node").alias("b"), "component", every.alias("salt"))
        near = both.withColumn("salt", salt("a")).join(known, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"), salt("node").alias("salt"))
        roots = lower.select("c").distinct().join(labels.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c").withColumn("salt", every)
        new = written(lower.join(roots, ["c", "salt"]).select("node", "old", F.least("c", "cc").alias("component")))
        changed = new.where("old <> component").limit(1).count()
        if before is not None:
            discard(before)
        labels, before = new.drop("old"), new
    if nodes is not None:
        labels = nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return labels


def summary(labels: DataFrame) -> DataFrame:
    """One row: n, n_components, largest, singletons, frac_in_multi."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"), F.sum(F.when(F.col("size") == 1, 1).otherwise(0)).alias("singletons"), (F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("frac_in_multi"))


def sweep(pairs: DataFrame, nodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """By threshold on pairs (a, b, similarity): the summary, and frac_in_multi * (1 - largest/n).

    From the highest threshold down, each takes only the pairs that it adds, as edges between the components so far."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    every = nodes.select("node", F.lit(1).alias("listed")).unionByName(ends.withColumn("listed", F.lit(0)))
    labels = written(every.groupBy("node").agg(F.max("listed").alias("listed")).withColumn("component", F.col("node")))
    rows, above = {}, None
    for t in sorted(set(thresholds), reverse=True):
        added = F.col("similarity") > t
        new = pairs.where(added if above is None else added & ~(F.col("similarity") > above))
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        met = new.join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
        found = components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        labels = written(labels.join(found, "component", "left").select("node", "listed", F.coalesce("joined", "component").alias("component")))
        rows[t], above = summary(labels.where("listed = 1")).withColumn("threshold", F.lit(t)), t
    out = None
    for t in thresholds:
        out = rows[t] if out is None else out.unionByName(rows[t])
    return out.withColumn("score", F.col("frac_in_multi") * (1 - F.col("largest") / F.col("n")))


def best(swept: DataFrame, least: float = 0.15) -> DataFrame:
    """The row of the highest score, if it reaches `least`."""
    return swept.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "threshold"))).where((F.col("r") == 1) & (F.col("score") >= least)).drop("r")
