"""D3-D10, K5, K6, E1/E2/E5/E6 and the no-overlap error."""

import math

import pytest

from dpmine.operators import metrics as M

RUN = "qid long, pid long, rank int"
QRELS = "qid long, pid long, rel int"


def test_mrr_recall_denominator_counts_unranked(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 3), (3, 30, 1)], RUN)
    qrels = spark.createDataFrame([(1, 11, 1), (2, 99, 1), (4, 40, 1), (3, 30, 1)], QRELS)
    m = M.evaluate(run, qrels).first()
    # judged queries: 1, 2, 3, 4 → hits for 1 (rank 2) and 3 (rank 1)
    assert m.mrr_at_10 == pytest.approx((0.5 + 1.0) / 4)
    assert m.recall_at_1 == pytest.approx(1 / 4)
    assert m.recall_at_all == pytest.approx(2 / 4)
    assert m.queries_ranked == 3 and m.queries_judged == 4 and m.queries_evaluated == 3


def test_zero_pad_reproduces_phantom_hits(spark):
    # Qid 1 has ranks 1 and 3; pid 0 relevant → the gap at rank 2 is a hit only with zero_pad
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 3)], RUN)
    qrels = spark.createDataFrame([(1, 0, 1)], QRELS)
    assert M.evaluate(run, qrels).first().mrr_at_10 == 0.0
    assert M.evaluate(run, qrels, zero_pad=True).first().mrr_at_10 == pytest.approx(0.5)


def test_rel_ignored_unless_asked(spark):
    # A rel = 0 judgement counts by default
    run = spark.createDataFrame([(1, 5, 1)], RUN)
    qrels = spark.createDataFrame([(1, 5, 0)], QRELS)
    assert M.evaluate(run, qrels).first().recall_at_1 == 1.0
    assert M.evaluate(run, qrels, min_rel=1).first().recall_at_1 == 0.0


def test_duplicate_check_reports_all_but_pid_zero(spark):
    # E6
    run = spark.createDataFrame([(1, 7, 2), (1, 7, 5), (1, 0, 3), (1, 0, 4), (2, 8, 1), (2, 8, 2)], RUN)
    got = {(r.qid, r.pid, r.n) for r in M.duplicate_check(run).collect()}
    assert got == {(1, 7, 2), (2, 8, 2)}


def test_no_overlap_raises(spark):
    run = spark.createDataFrame([(1, 5, 1)], RUN)
    qrels = spark.createDataFrame([(2, 5, 1)], QRELS)
    with pytest.raises(ValueError):
        M.evaluate_checked(run, qrels)


def test_metric_report_names_sorted(spark):
    run = spark.createDataFrame([(1, 5, 1)], RUN)
    qrels = spark.createDataFrame([(1, 5, 1)], QRELS)
    rows = M.metric_report(M.evaluate(run, qrels)).collect()
    assert [r.metric for r in rows] == ["MRR @10", "QueriesRanked", "recall@1", "recall@50", "recall@all"]


def test_log_softmax_and_kl(spark):
    df = spark.createDataFrame([(0, 1, s, t) for s, t in [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]] +
                               [(0, 2, s, t) for s, t in [(0.5, 3.0), (1.5, 0.0)]],
                               "batch long, qid long, student double, score double")
    lp = M.group_log_softmax(df, "student", ("qid",), "lp").collect()
    for q in (1, 2):
        assert sum(math.exp(r.lp) for r in lp if r.qid == q) == pytest.approx(1.0)
    kl = M.distill_kl(df).first()
    # query 1 has equal scores → 0; query 2 positive; batchmean over 2 queries
    s = [0.5, 1.5]
    t = [3.0, 0.0]
    ls = [x - math.log(sum(math.exp(y) for y in s)) for x in s]
    lt = [x - math.log(sum(math.exp(y) for y in t)) for x in t]
    want = sum(math.exp(b) * (b - a) for a, b in zip(ls, lt)) / 2
    assert kl.n_queries == 2 and kl.kl == pytest.approx(want) and kl.kl >= 0


def test_in_batch_accuracy_uses_whole_batch(spark):
    # two queries, groups of 2; query 2's own positive loses to query 1's negative
    groups = spark.createDataFrame([(0, 1, 0, 10), (0, 1, 1, 11), (0, 2, 0, 20), (0, 2, 1, 21)],
                                   "batch long, qid long, slot int, pid long")
    qv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, vec array<double>")
    pv = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 5.0]), (20, [0.0, 1.0]), (21, [0.0, 0.5])],
                               "pid long, vec array<double>")
    r = M.in_batch_accuracy(groups, qv, pv, 2).first()
    assert (r.n_queries, r.n_correct) == (2, 1)


def test_zero_pad_counts_distinct_ranks(spark):
    """A rank given twice is one slot of the padded array: ranks 1, 1, 2 leave the first gap at 3."""
    from dpmine.operators.metrics import first_hits
    run = spark.createDataFrame([(1, 8, 1), (1, 9, 1), (1, 7, 2)], "qid long, pid long, rank int")
    qrels = spark.createDataFrame([(1, 0, 1)], "qid long, pid long, rel int")
    assert [tuple(r) for r in first_hits(run, qrels, zero_pad=True).collect()] == [(1, 3)]
