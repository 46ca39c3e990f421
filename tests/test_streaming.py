"""Incremental scoring stream: files arriving later only score unseen pairs."""

from pyspark.sql import functions as F

from dpmine.sources import io as IO
from dpmine.streaming.scoring import read_scored, score_group_stream

LONG = "qid long, role string, pos int, pid long, score double"


def test_second_file_reuses_cache(spark, tmp_path):
    root = str(tmp_path)

    def scorer(pairs):
        return pairs.withColumn("score", (F.col("qid") * 100 + F.col("pid")).cast("double"))

    first = spark.createDataFrame([(1, "pos", 0, 5, 1.0), (1, "neg", 0, 6, 0.0)], LONG)
    IO.write_groups(first, None, f"{root}/groups/r0")
    q = score_group_stream(spark, f"{root}/groups/*", f"{root}/cache", f"{root}/out", scorer, f"{root}/ck")
    q.awaitTermination()
    second = spark.createDataFrame([(1, "pos", 0, 5, 1.0), (1, "neg", 0, 7, 0.0)], LONG)
    IO.write_groups(second, None, f"{root}/groups/r1")
    q = score_group_stream(spark, f"{root}/groups/*", f"{root}/cache", f"{root}/out", scorer, f"{root}/ck")
    q.awaitTermination()
    cache = spark.read.parquet(f"{root}/cache/data")
    per_batch = {r.batch: r.n for r in cache.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(per_batch.values()) == [1, 2]          # (1,5),(1,6) first; only (1,7) second
    out = {(r.pid, r.score) for r in read_scored(spark, f"{root}/out").collect()}
    assert out == {(5, 105.0), (6, 106.0), (7, 107.0)}


def test_new_checkpoint_over_old_folders(spark, tmp_path):
    """A stream with a checkpoint of its own does not take an older stream's batch 0 for its own."""
    root = str(tmp_path)

    def scorer(pairs):
        return pairs.withColumn("score", F.col("pid").cast("double"))

    for i, pid in enumerate((5, 6)):
        IO.write_groups(spark.createDataFrame([(i, "pos", 0, pid, 1.0)], LONG), None, f"{root}/groups{i}")
        score_group_stream(spark, f"{root}/groups{i}", f"{root}/cache", f"{root}/out", scorer, f"{root}/ck{i}").awaitTermination()
    assert {(r.qid, r.pid) for r in read_scored(spark, f"{root}/out").collect()} == {(0, 5), (1, 6)}
    spark.createDataFrame([(9, "pos", 0, 9, 1.0)], LONG).write.parquet(f"{root}/out/batch=left")     # interrupted output
    import os
    os.remove(f"{root}/out/batch=left/_SUCCESS")
    assert read_scored(spark, f"{root}/out").count() == 2
    assert read_scored(spark, f"{root}/none").collect() == []
