"""Mining, sampling, scoring cache, merge."""

import pytest
from pyspark.sql import functions as F

from dpmine.operators import groups as G
from dpmine.operators import scoring as SC

LONG = "qid long, role string, pos int, pid long, score double"


def test_depth_cut_drops_short_queries(spark):
    # Query 2 has depth - 1 survivors after removing its positive
    run = spark.createDataFrame([(1, p, r) for r, p in enumerate([10, 11, 12, 13], 1)] +
                                [(2, p, r) for r, p in enumerate([20, 21, 22, 23], 1)], "qid long, pid long, rank int")
    qrels = spark.createDataFrame([(1, 99, 1), (2, 21, 1), (2, 22, 1)], "qid long, pid long, rel int")
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, query string")
    hn = G.hard_negatives(qrels, run, queries, depth=3, max_rank=4)
    rows = {(r.qid, r.role, r.pos, r.pid) for r in hn.collect()}
    assert rows == {(1, "pos", 0, 99), (1, "neg", 0, 10), (1, "neg", 1, 11), (1, "neg", 2, 12)}
    short = {(r.qid, r.n_neg) for r in G.short_queries(qrels, run, queries, depth=3, max_rank=4).collect()}
    assert short == {(2, 2)}


def test_ranked_array_pads_and_rejects_conflicts(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 7, 3)], "qid long, pid long, rank int")
    assert G.ranked_array(run, 4).first().pids == [5, 0, 7, 0]
    dup = spark.createDataFrame([(1, 5, 1), (1, 6, 1)], "qid long, pid long, rank int")
    with pytest.raises(Exception):
        G.ranked_array(dup, 2).collect()
    assert G.ranked_array(dup, 2, on_dup="max_pid").first().pids == [6, 0]


def test_sampling_is_repeatable_and_padded(spark):
    # 3 negatives, n = 7 → 1 + 7 div 3 = 3 copies to draw from
    rows = [(1, "pos", 0, 100, 1.0)] + [(1, "neg", i, 200 + i, 0.0) for i in range(3)]
    long = spark.createDataFrame(rows, LONG)
    a = G.sample_negatives(long, 7, seed=1).orderBy("slot").collect()
    b = G.sample_negatives(long, 7, seed=1).orderBy("slot").collect()
    assert a == b and len(a) == 7
    assert max(sum(1 for r in a if r.pid == p) for p in (200, 201, 202)) <= 3
    c = [r.pid for r in G.sample_negatives(long, 7, seed=2).orderBy("slot").collect()]
    assert len(c) == 7 and set(c) <= {200, 201, 202}
    assert max(c.count(p) for p in (200, 201, 202)) <= 3


def test_incomplete_groups_are_rejected(spark):
    # Empty positives / empty negatives
    rows = [(1, "neg", 0, 10, 0.0), (2, "pos", 0, 20, 1.0), (3, "pos", 0, 30, 1.0), (3, "neg", 0, 31, 0.0)]
    long = spark.createDataFrame(rows, LONG)
    assert {r.qid for r in G.assemble_groups(long, 2).collect()} == {3}
    assert {r.qid for r in G.rejected_groups(long).collect()} == {1, 2}


def test_nested_round_trip(spark):
    rows = [(1, "pos", 0, 5, 1.0), (1, "neg", 0, 7, 0.0), (1, "neg", 1, 6, 0.0)]
    long = spark.createDataFrame(rows, LONG)
    nested = G.to_nested(long).first()
    assert nested.negatives.doc_id == [7, 6]
    back = {tuple(r) for r in G.explode_groups(G.to_nested(long)).collect()}
    assert back == set(rows)


def test_cache_skips_known_and_repeated_pairs(spark):
    # A pair in both lists and one already cached; E14: empty input gives a null rate
    rows = [(1, "pos", 0, 5, 1.0), (1, "neg", 0, 5, 0.0), (1, "neg", 1, 6, 0.0), (1, "neg", 2, 7, 0.0)]
    long = spark.createDataFrame(rows, LONG)
    cache = spark.createDataFrame([(1, 7, 0.25)], "qid long, pid long, score double")

    def scorer(pairs):
        return pairs.withColumn("score", (F.col("pid") * 10).cast("double"))

    scored, new, stats = SC.score_groups(long, cache, scorer)
    assert {(r.qid, r.pid) for r in new.collect()} == {(1, 5), (1, 6)}
    assert {(r.pid, r.score) for r in scored.collect()} == {(5, 50.0), (6, 60.0), (7, 0.25)}
    s = stats.first()
    assert (s.total, s.new, s.skip) == (4, 2, 2)
    empty = spark.createDataFrame([], LONG)
    assert SC.score_groups(empty, None, scorer)[2].first().skip_rate is None


def test_merge_keeps_duplicates_and_last_line(spark):
    # E16
    own = spark.createDataFrame([(1, "pos", 0, 5, 1.0), (1, "neg", 0, 6, 0.0), (2, "pos", 0, 8, 1.0),
                                 (2, "neg", 0, 9, 0.0)], LONG)
    other = spark.createDataFrame([(1, "neg", 0, 6, 0.5, 1), (1, "neg", 0, 30, 0.5, 2), (1, "neg", 1, 31, 0.5, 2),
                                   (3, "neg", 0, 40, 0.5, 1)], LONG + ", line int")
    m = {(r.qid, r.role, r.pos, r.pid) for r in SC.merge_negatives(own, other).collect()}
    assert m == {(1, "pos", 0, 5), (1, "neg", 0, 6), (1, "neg", 1, 30), (1, "neg", 2, 31),
                 (2, "pos", 0, 8), (2, "neg", 0, 9)}
    other2 = spark.createDataFrame([(1, "neg", 0, 6, 0.5)], LONG)
    assert SC.merge_negatives(own, other2).filter("qid = 1 and pid = 6").count() == 2
    assert SC.merge_negatives(own, other2, dedup=True).filter("qid = 1 and pid = 6").count() == 1


def test_score_cache_appends_only_new_keys(spark, tmp_path):
    cache = SC.ScoreCache(spark, str(tmp_path / "cache"))
    assert cache.read().count() == 0
    first = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], "qid long, pid long, score double")
    cache.append_new(first, "0")
    second = spark.createDataFrame([(1, 3, 9.9), (1, 4, 0.1)], "qid long, pid long, score double")
    added = cache.append_new(second, "1")
    assert {(r.pid, r.score) for r in added.collect()} == {(4, 0.1)}
    assert {(r.pid, r.score) for r in cache.read().collect()} == {(2, 0.5), (3, 0.7), (4, 0.1)}


def test_ordinal_within_splits_hot_key(spark):
    from dpmine.operators.ordinal import ordinal_within
    rows = [(1, p) for p in range(3000)] + [(2, p) for p in range(5)]
    df = spark.createDataFrame(rows, "qid long, pid long").repartition(7)
    got = {(r.qid, r.pid): r.pos for r in ordinal_within(df, "qid", ["pid"]).collect()}
    assert got == {(q, p): p for q, p in rows}


def test_preview_and_head_sample_are_repeatable(spark):
    from dpmine.operators.ordinal import head_sample
    df = spark.createDataFrame([(i, f"q{i}") for i in range(50)], "qid long, query string").repartition(5)
    a = [r.qid for r in G.preview(df, 3, seed=1).collect()]
    b = [r.qid for r in G.preview(df.repartition(3), 3, seed=1).collect()]
    assert a == b and len(a) == 3
    assert [r.qid for r in head_sample(df, 4, ["qid"]).collect()] == [0, 1, 2, 3]


def test_a_list_too_long_for_one_row_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_LIST", 3)
    long = spark.createDataFrame([(1, "neg", i, i, 0.0) for i in range(4)], "qid long, role string, pos int, pid long, score double")
    with pytest.raises(Exception, match="more than 3 entries"):
        G.to_nested(long).collect()
    assert G.to_nested(long.filter("pos < 3")).count() == 1


def test_epochs_draw_from_buckets_without_an_exchange(spark, tmp_path):
    """Groups stored once by query: the draw of the second epoch has no exchange, and is the draw of the plain rows."""
    from dpmine.sources.io import save_bucketed_groups
    rows = [(q, G.POS, i, 1000 + i, 1.0) for q in range(12) for i in range(1 + q % 3)] + [
        (q, G.NEG, i, 2000 + i, 0.0) for q in range(12) for i in range(3 + q)]
    long = spark.createDataFrame(rows, "qid long, role string, pos int, pid long, score double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = save_bucketed_groups(long, "groups_by_query", str(tmp_path / "g"), 3)
        draws = []
        for epoch in (1, 2):
            drawn = G.assemble_groups(stored, 4, 7, epoch)
            draws.append(sorted(tuple(r) for r in drawn.collect()))
            assert draws[-1] == sorted(tuple(r) for r in G.assemble_groups(long, 4, 7, epoch).collect())
            plan = drawn._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
        assert draws[0] != draws[1]
    finally:
        spark.sql("DROP TABLE IF EXISTS groups_by_query")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_too_long_a_list_of_positives_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 1)], "qid long, pid long")
    assert [tuple(r) for r in G.collect_positives(rows).orderBy("qid").collect()] == [(1, list(range(5))), (2, [1])]
    monkeypatch.setattr(G, "MAX_LIST", 4)
    with pytest.raises(Exception, match="more than 4 entries"):
        G.collect_positives(rows).collect()
