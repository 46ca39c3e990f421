"""Score training groups as their files arrive, through the shared score cache.

Each mining round drops a new group file; the teacher should only see pairs
it has not scored before.  As a stream:

    readStream.json(groups_dir)  →  foreachBatch:
        explode + cap  →  anti join cache  →  scorer  →  append batch=<id> to the cache
                       →  attach scores     →  write scored groups batch=<id>

The cache is the only state.  A replayed micro-batch (after a failure) finds
its batch committed and reuses it, so a pair is scored once and the output is
exactly once.  Batches are named by the id of the stream's checkpoint and the
micro-batch: a new checkpoint over old folders starts batches of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from dpmine.operators.groups import cap_candidates, explode_groups
from dpmine.operators.scoring import (ScoreCache, Scorer, attach_scores, needed_scores, score_pairs,
                                      unscored_pairs)
from dpmine.sources.commits import exists, folders
from dpmine.sources.io import GROUP_SCHEMA


def score_group_stream(spark: SparkSession, groups_dir: str, cache_root: str, out_dir: str, scorer: Scorer,
                       checkpoint_location: str, cap: int = 100, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery`` (``available_now`` drains what is there and stops)."""
    cache = ScoreCache(spark, cache_root)
    stream = spark.readStream.schema(GROUP_SCHEMA).json(groups_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint_location.rstrip('/')}/metadata").first()["value"])["id"]
        name = f"{stream_id}-{batch_id}"
        long = cap_candidates(explode_groups(batch.withColumnRenamed("query_id", "qid")), cap)
        pairs = unscored_pairs(long, None)
        if name not in cache.batches():
            known = needed_scores(cache.read(), pairs)
            cache.append_new(score_pairs(unscored_pairs(pairs, known), scorer), name)
        table = needed_scores(cache.read(), pairs)
        out_path = f"{out_dir.rstrip('/')}/batch={name}"
        if not exists(spark, f"{out_path}/_SUCCESS"):
            attach_scores(long, table).write.mode("overwrite").parquet(out_path)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """The scored groups of all finished micro-batches."""
    root = out_dir.rstrip("/")
    done = [f"{root}/{n}" for n in folders(spark, root) if n.startswith("batch=") and exists(spark, f"{root}/{n}/_SUCCESS")]
    schema = "qid long, role string, pos int, pid long, score double"
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
