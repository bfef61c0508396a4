"""Triplets of a stream against those of a table, and the state of silent folders."""

import time

from unitwise.operators import sequences as S
from unitwise.streaming.triplets import triplets

SCHEMA = "folder string, idx long, id long"


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def once(spark, source, folder, idle_ms):
    """One batch over what is new in the source; what it sent, and the states that are held after it."""
    stream = triplets(spark.readStream.schema(SCHEMA).json(source), idle_ms)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").outputMode("append").trigger(once=True).start()
    try:
        assert run.awaitTermination(90)
        return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), run.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        run.stop()


def test_stream_equals_table_and_silent_folders_are_forgotten(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path)
    a = [("a", i, 10 + i) for i in (1, 2, 3, 5, 6, 7)]
    b = [("b", i, 50 + i) for i in (1, 2, 3, 4)]
    put(spark, a[:2] + b[:3], source)
    assert once(spark, source, folder, 15_000) == ([("b", 51, 52, 53)], 2)
    put(spark, a[2:] + b[3:], source)
    got, held = once(spark, source, folder, 15_000)
    table = spark.createDataFrame(a + b, SCHEMA)
    assert held == 2 and got == sorted(tuple(r) for r in S.triplets(table, "folder", "idx", "id").select("folder", "before", "centre", "after").collect())
    time.sleep(16)
    put(spark, [("c", 1, 90)], source)
    assert once(spark, source, folder, 15_000) == (got, 1)  # a and b are forgotten
    put(spark, [("a", 8, 18), ("a", 9, 19)], source)
    assert once(spark, source, folder, 15_000)[0] == got  # 7, 8, 9 lie on both sides of a silence
