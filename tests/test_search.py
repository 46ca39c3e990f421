"""Exact top-k invariants."""

import numpy as np
import pytest

from dpmine.operators.search import gaussian_topk, mips_topk, score_matrix


def _vectors(spark, n, d, seed, id_name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{id_name} long, vec array<double>")


def _brute(q, p, k):
    pi, P = zip(*p)
    out = set()
    for qid, vec in q:
        scores = [sum(a * b for a, b in zip(vec, v)) for v in P]
        order = sorted(range(len(pi)), key=lambda c: (-scores[c], pi[c]))[:k]
        out |= {(qid, pi[c], rank + 1) for rank, c in enumerate(order)}
    return out


@pytest.mark.parametrize("parts,block_bytes,score_bytes", [(1, 16 << 20, 32 << 20), (4, 600, 4000), (17, 3000, 800), (4, 1, 1)])
def test_topk_independent_of_partitioning_and_cells(spark, parts, block_bytes, score_bytes):
    q = _vectors(spark, 23, 8, 1, "qid")
    p = _vectors(spark, 60 if block_bytes == 1 else 300, 8, 2, "pid").repartition(parts)
    got = {(r.qid, r.pid, r.rank) for r in mips_topk(q, p, 7, block_bytes=block_bytes, score_bytes=score_bytes).collect()}
    assert got == _brute([(r.qid, r.vec) for r in q.collect()], [(r.pid, r.vec) for r in p.collect()], 7)


def test_small_scores_rank_exactly(spark):
    q = spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>")
    p = spark.createDataFrame([(i, [i * 1e-8]) for i in range(1, 6)], "pid long, vec array<double>")
    assert [r.pid for r in mips_topk(q, p, 3).orderBy("rank").collect()] == [5, 4, 3]


def test_equal_vectors_rank_by_id_in_every_cell(spark):
    rng = np.random.default_rng(9)
    base = [float(x) for x in rng.normal(size=13)]
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=13)]) for i in range(9)], "qid long, vec array<double>")
    p = spark.createDataFrame([(i, base) for i in range(200)], "pid long, vec array<double>")
    for r in mips_topk(q, p, 4, block_bytes=13 * 8 * 3, lot_bytes=13 * 8 * 30).collect():
        assert r.pid == r["rank"] - 1


@pytest.mark.parametrize("queries, passages", [
    ([(1, [1.0]), (1, [2.0])], [(1, [1.0])]), ([(1, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])]), ([(1, [1.0])], [(1, None)]),
    ([(1, [float("nan")])], [(1, [1.0])]), ([(1, [1.0])], [(1, [float("inf")])]), ([(1, [1.0, 2.0])], [(1, [1.0])]),
    ([(None, [1.0])], [(1, [1.0])])])
def test_bad_input_is_an_error(spark, queries, passages):
    with pytest.raises(ValueError):
        mips_topk(spark.createDataFrame(queries, "qid long, vec array<double>"),
                  spark.createDataFrame(passages, "pid long, vec array<double>"), 1)


def test_variance_must_be_positive(spark):
    q = spark.createDataFrame([(1, [1.0])], "qid long, mean array<double>")
    p = spark.createDataFrame([(1, [1.0], [0.0])], "pid long, mean array<double>, var array<double>")
    with pytest.raises(ValueError):
        gaussian_topk(q, p, 1)


def test_k_larger_than_corpus_and_ties(spark):
    # K > passages; E8: two equal vectors in different partitions rank by pid
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    p = spark.createDataFrame([(5, [1.0, 1.0]), (3, [1.0, 1.0]), (9, [0.0, 1.0])], "pid long, vec array<double>")
    got = mips_topk(q, p.repartition(3), 10).orderBy("rank").collect()
    assert [(r.pid, r.rank) for r in got] == [(3, 1), (5, 2), (9, 3)]


def test_score_matrix_is_all_pairs_of_a_batch(spark):
    q = _vectors(spark, 6, 4, 3, "qid").selectExpr("qid", "vec", "qid % 2 AS batch")
    p = _vectors(spark, 9, 4, 4, "pid").selectExpr("pid", "vec", "pid % 3 AS batch")
    sm = score_matrix(q, p).collect()
    assert {(r.qid, r.pid) for r in sm} == {(a, b) for a in range(6) for b in range(9) if a % 2 == b % 3}
    Q = {r.qid: np.array(r.vec) for r in q.collect()}
    P = {r.pid: np.array(r.vec) for r in p.collect()}
    assert all(abs(r.score - Q[r.qid] @ P[r.pid]) < 1e-9 for r in sm)


def test_gaussian_fold_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    qs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(4)]
    ps = [(i, [float(x) for x in rng.normal(size=6)], [float(x) for x in rng.uniform(0.2, 2.0, size=6)])
          for i in range(40)]
    q = spark.createDataFrame(qs, "qid long, mean array<double>")
    p = spark.createDataFrame(ps, "pid long, mean array<double>, var array<double>")
    got = gaussian_topk(q, p, 5).collect()
    for r in got:
        m = np.array(qs[r.qid][1])
        _, mp, v = ps[r.pid]
        closed = -0.5 * np.sum(np.log(v) + (m - np.array(mp)) ** 2 / np.array(v))
        assert abs(r.score - closed) < 1e-9
    best = {r.qid: r.pid for r in got if r.rank == 1}
    for qid, m in qs:
        dens = [-0.5 * np.sum(np.log(v) + (np.array(m) - np.array(mp)) ** 2 / np.array(v)) for _, mp, v in ps]
        assert best[qid] == int(np.argmax(dens))


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark, monkeypatch):
    """The passages are mapped where they lie: the only exchange is of local results, by query."""
    from dpmine.operators import search as S
    plans, write = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: plans.append((name, _executed(df))) or write(df, name))
    run = mips_topk(_vectors(spark, 3, 4, 6, "qid"), _vectors(spark, 20, 4, 7, "pid").repartition(2), 2)
    scans = [plan for name, plan in plans if name == "local-results"]
    assert len(scans) == 1 and "MapInArrow" in scans[0]
    final = _executed(run)
    assert "WindowGroupLimit" in final and final.count("Exchange") == 1
    stored = spark.read.parquet(_stored(spark, 30, 4, "pid"))
    plans.clear()
    mips_topk(_vectors(spark, 3, 4, 6, "qid"), stored, 2, lot_bytes=1)           # many lots: a sample, then the scan
    assert [name for name, _ in plans] == ["local-results", "bounds", "local-results", "bounds"]
    assert all("Exchange" not in plan for name, plan in plans if name == "local-results")
    assert not any("CartesianProduct" in p or "BroadcastNestedLoopJoin" in p for _, p in plans + [("", final)])


def _stored(spark, n, d, name, parts=3):
    from dpmine.session import scratch_path
    path = scratch_path(spark, "test-vectors")
    _vectors(spark, n, d, 11, name).repartition(parts).write.parquet(path)
    return path


def _counting(spark, df, id_name, counter):
    """The rows as a model would give them, each counted when it runs."""
    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, f"{id_name} long, vec array<double>")


@pytest.mark.parametrize("lot_bytes", [64 << 20, 200])
def test_each_side_runs_once(spark, lot_bytes):
    asked, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    q = _counting(spark, _vectors(spark, 20, 4, 1, "qid"), "qid", asked)
    p = _counting(spark, _vectors(spark, 400, 4, 2, "pid").repartition(5), "pid", seen)
    got = {(r.qid, r.pid, r.rank) for r in mips_topk(q, p, 3, lot_bytes=lot_bytes).collect()}
    assert (asked.value, seen.value) == (20, 400)
    assert got == _brute([(r.qid, r.vec) for r in _vectors(spark, 20, 4, 1, "qid").collect()],
                         [(r.pid, r.vec) for r in _vectors(spark, 400, 4, 2, "pid").collect()], 3)


def test_candidates_of_a_hundred_lots(spark):
    """With k = 100 and a hundred lots of 200 passages, under 3 000 rows a query reach the exchange."""
    from dpmine.operators.search import topk_candidates
    q = _vectors(spark, 12, 8, 1, "qid")
    p = spark.read.parquet(_stored(spark, 20_000, 8, "pid", parts=25))
    found = topk_candidates(q, p, 100, lot_bytes=200 * 64)
    assert found.groupBy("qid").count().agg({"count": "max"}).first()[0] < 3000
    got = {(r.qid, r.pid, r.rank) for r in mips_topk(q, p, 100, lot_bytes=200 * 64, state_bytes=24 * 300).collect()}
    P = p.collect()
    V, ids = np.array([r.vec for r in P]), np.array([r.pid for r in P])
    for r in q.collect():
        scores = V @ np.array(r.vec)
        order = np.lexsort((ids, -scores))[:100]
        assert {x for x in got if x[0] == r.qid} == {(r.qid, int(ids[i]), n + 1) for n, i in enumerate(order)}


def test_blocks_by_broadcast_where_the_folder_does_not_open(spark, monkeypatch):
    from dpmine.operators import search as S
    q, p = _vectors(spark, 23, 8, 1, "qid"), _vectors(spark, 90, 8, 2, "pid").repartition(3)
    want = {tuple(r) for r in mips_topk(q, p, 4).collect()}
    monkeypatch.setattr(S, "_opens", lambda place: False)
    assert {tuple(r) for r in mips_topk(q, p, 4, block_bytes=600).collect()} == want
    assert mips_topk(q, p.limit(0), 4).collect() == [] and mips_topk(q.limit(0), p, 4).collect() == []


def test_a_task_holds_the_results_of_one_query_block(spark, monkeypatch):
    """However many queries there are, the results that one task keeps fit its state."""
    from dpmine.operators import search as S
    from pyspark.sql import functions as F
    stored, write = [], S.materialize

    def keep(df, name):
        stored.append((name, write(df, name)))
        return stored[-1][1]
    monkeypatch.setattr(S, "materialize", keep)
    q, p = _vectors(spark, 40, 8, 1, "qid"), _vectors(spark, 300, 8, 2, "pid").repartition(2)
    got = {(r.qid, r.pid, r.rank) for r in mips_topk(q, p, 10, state_bytes=S.RESULT_BYTES * 100).collect()}
    assert got == _brute([(r.qid, r.vec) for r in q.collect()], [(r.pid, r.vec) for r in p.collect()], 10)
    local = next(df for name, df in stored if name == "local-results")
    assert max(r["count"] for r in local.groupBy(F.input_file_name().alias("task")).count().collect()) <= 100
