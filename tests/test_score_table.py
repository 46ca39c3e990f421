"""The score table's commit log, buckets, compaction."""

import os

from pyspark.sql import functions as F

from dpmine.operators import scoring as SC
from dpmine.sources.commits import CommitLog
from dpmine.sources.score_table import ScoreCache

SCHEMA = "qid long, pid long, score double"


def _scores(spark, rows):
    return spark.createDataFrame([(q, p, float(s)) for q, p, s in rows], SCHEMA)


def _all(df):
    return sorted((r.qid, r.pid, r.score) for r in df.select("qid", "pid", "score").collect())


def test_interrupted_batch_is_neither_read_nor_taken_for_scored(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path / "c"), "teacher", buckets=4)
    rows = _scores(spark, [(1, 1, 10), (1, 2, 20)])
    # what a writer that died before its commit leaves: files of the batch, no log entry
    cache._write(_scores(spark, [(1, 1, 10)]).withColumn("batch", F.lit("a")), "a", 4)
    assert cache.read().collect() == [] and cache.batches() == []
    assert _all(cache.append_new(rows, "a")) == [(1, 1, 10.0), (1, 2, 20.0)]
    assert _all(cache.read()) == [(1, 1, 10.0), (1, 2, 20.0)]
    # one that died inside the write leaves no _SUCCESS either
    os.makedirs(f"{cache.root}/data/piece=b-x")
    _scores(spark, [(7, 7, 7)]).write.mode("overwrite").parquet(f"{cache.root}/data/piece=b-x")
    os.remove(f"{cache.root}/data/piece=b-x/_SUCCESS")
    assert _all(cache.append_new(_scores(spark, [(7, 7, 70)]), "b")) == [(7, 7, 70.0)]
    assert len(cache.vacuum()) == 2 and _all(cache.read()) == [(1, 1, 10.0), (1, 2, 20.0), (7, 7, 70.0)]
    assert cache.vacuum() == []


def test_batches_are_idempotent_and_first_score_wins(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path), buckets=3)
    assert _all(cache.append_new(_scores(spark, [(1, 1, 1), (1, 1, 1), (2, 1, 2)]), "one")) == [(1, 1, 1.0), (2, 1, 2.0)]
    assert _all(cache.append_new(_scores(spark, [(9, 9, 9)]), "one")) == [(1, 1, 1.0), (2, 1, 2.0)]      # a rerun
    assert _all(cache.append_new(_scores(spark, [(1, 1, 5), (3, 1, 3)]), "it's two/2")) == [(3, 1, 3.0)]
    assert _all(cache.append_new(_scores(spark, []), "empty")) == []
    assert cache.batches() == ["empty", "it's two/2", "one"]
    assert _all(ScoreCache(spark, str(tmp_path)).read()) == [(1, 1, 1.0), (2, 1, 2.0), (3, 1, 3.0)]
    other = ScoreCache(spark, str(tmp_path), "x")
    assert other.read().count() == 0


def test_compaction_keeps_scores_batches_and_earlier_readers(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path), buckets=2)
    for i in range(4):
        cache.append_new(_scores(spark, [(i, p, i * 10 + p) for p in range(5)]), f"b{i}")
    before, want = cache.read(), _all(cache.read())
    assert cache.compact() == 4 and cache.compact() == 0
    assert _all(cache.read()) == want and _all(before) == want
    assert len(cache._state()[2]) == 1 and cache.batches() == ["b0", "b1", "b2", "b3"]
    assert _all(cache.append_new(_scores(spark, []), "b2")) == [(2, p, 20.0 + p) for p in range(5)]     # still known
    cache.append_new(_scores(spark, [(8, 8, 8)]), "later")
    assert len(cache.vacuum()) == 4 and _all(cache.read()) == want + [(8, 8, 8.0)]
    assert len(cache.log.entries()[1]) == 2                                                             # from the snapshot on
    assert cache.compact(small=10) == 0                                                                 # one small piece only


def test_second_writer_keeps_only_what_is_missing(spark, tmp_path, monkeypatch):
    cache, rival = ScoreCache(spark, str(tmp_path), buckets=2), ScoreCache(spark, str(tmp_path), buckets=2)
    write, done, scored = cache._write, [], spark.sparkContext.accumulator(0)

    def write_late(rows, name, buckets):
        piece = write(rows, name, buckets)
        if not done:
            done.append(rival.append_new(_scores(spark, [(1, 1, 1)]), "rival"))
        return piece
    monkeypatch.setattr(cache, "_write", write_late)

    def score(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b
    new = _scores(spark, [(1, 1, 100), (2, 2, 2)]).mapInArrow(score, SCHEMA)
    assert _all(cache.append_new(new, "own")) == [(2, 2, 2.0)]
    assert _all(cache.read()) == [(1, 1, 1.0), (2, 2, 2.0)] and scored.value == 2                       # not scored again


def test_log_numbers_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.entries() == (-1, [])
    assert log.commit({"a": 1}, -1) and not log.commit({"a": 2}, -1) and log.commit({"a": 3}, 0)
    assert log.entries() == (1, [{"a": 1}, {"a": 3}])
    assert all(n.endswith((".json", ".crc")) for n in os.listdir(tmp_path / "log") if not n.endswith(".tmp.crc"))


def test_cache_side_is_not_exchanged(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path), buckets=4)
    cache.append_new(_scores(spark, [(q, p, q) for q in range(20) for p in range(10)]), "a")
    cache.append_new(_scores(spark, [(q, p, q) for q in range(20) for p in range(10, 15)]), "b")
    pairs = spark.createDataFrame([(q, p) for q in range(30) for p in range(12)], "qid long, pid long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, n in ((SC.needed_scores(cache.read(), pairs), 240), (SC.unscored_pairs(pairs, cache.read()), 120)):
            assert df.count() == n
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            side = [x for x in plan.split("\n") if "Exchange" in x]
            assert side and all("REPARTITION" not in x for x in side)
            joined = plan[plan.index("SortMergeJoin"):]
            scan = joined.index("FileScan")
            above = joined[joined.rindex("Sort [", 0, scan):scan]
            assert "Exchange" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
