"""Work done unit by unit that can stop at any time and go on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, path: str, unit: str = "unit") -> DataFrame | None:
    """The units whose rows stand in the table, by its folders alone; None before the first."""
    try:
        return spark.read.parquet(path).select(unit).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def remaining(units: DataFrame, done: DataFrame | None, unit: str = "unit") -> DataFrame:
    """Units without a row in what was written so far."""
    return units if done is None else units.join(done.select(unit).distinct(), unit, "left_anti")


def resumed(units: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], unit: str = "unit", at_once: int = 64) -> DataFrame:
    """Runs `work` over the units that the table at `path` lacks, `at_once` of them in one plan, and returns the table.

    work takes a table of units and returns rows that carry the unit, at least one for each. Each step's rows go to a folder
    for each unit and replace what stood there, so a step that was cut off is done again without leaving rows twice, and
    what other steps wrote stays. Units are taken in their order; a unit for which work gives no row is an error, as it would come up for ever."""
    spark = units.sparkSession
    kind = units.schema[unit].dataType.simpleString()
    while True:
        todo = [r[0] for r in remaining(units.select(unit).distinct(), finished(spark, path, unit), unit).orderBy(unit).limit(at_once).collect()]
        if not todo:
            return spark.read.parquet(path).withColumn(unit, F.col(unit).cast(kind))
        step = spark.createDataFrame([(u,) for u in todo], f"`{unit}` {kind}")
        work(step).write.partitionBy(unit).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        left = remaining(step, finished(spark, path, unit), unit).collect()
        if left:
            raise ValueError(f"no rows came for units {sorted(str(r[0]) for r in left)}")
