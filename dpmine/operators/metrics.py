"""Ranking evaluation (D3-D7, S10) and group losses.

Evaluation is one qid-keyed plan: relevant hits (semi join run ⋉ qrels on
``(qid, pid)``), first hit per query, then a single union-and-aggregate by
qid that also carries "judged" and "ranked" flags, and one final one-row
aggregate.  No cross join, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: metric names as the evaluation prints them
METRIC_NAMES = {
    "mrr_at_10": "MRR @10",
    "recall_at_1": "recall@1",
    "recall_at_50": "recall@50",
    "recall_at_all": "recall@all",
    "queries_ranked": "QueriesRanked",
}
MRR_DEPTH = 10


def first_hits(run: DataFrame, qrels: DataFrame, *, zero_pad: bool = False, min_rel: int | None = None,
               size: int = 1000) -> DataFrame:
    """``qid, first_rank``: the best rank of a judged-relevant passage per query.

    ``min_rel`` keeps only judgements with ``rel >= min_rel`` (by default the
    grade is ignored, every listed pair counts).  ``zero_pad=True`` reproduces
    the padded-array reading where every missing rank in ``1..size`` holds
    passage 0 (so a judged pid 0 is hit in the first gap).
    """
    rel = qrels
    if min_rel is not None:
        rel = rel.filter(F.col("rel") >= min_rel)
    rel = rel.select("qid", "pid")
    hits = run.select("qid", "pid", "rank").join(rel, ["qid", "pid"], "left_semi")
    fh = hits.groupBy("qid").agg(F.min("rank").alias("first_rank"))
    if zero_pad:
        # padded reading: the first rank in 1..size without a run row holds passage 0
        w = Window.partitionBy("qid").orderBy("rank")
        ranks = run.select("qid", "rank").distinct()
        inner = (ranks
                 .withColumn("expect", F.row_number().over(w))
                 .filter(F.col("rank") != F.col("expect"))
                 .groupBy("qid").agg(F.min("expect").alias("inner_gap")))
        counts = ranks.groupBy("qid").agg((F.count(F.lit(1)) + 1).alias("after_last"))
        gaps = (counts.join(inner, "qid", "left")
                .select("qid", F.coalesce("inner_gap", "after_last").alias("gap_rank"))
                .filter(F.col("gap_rank") <= size))
        gaps = gaps.join(rel.filter(F.col("pid") == 0).select("qid").distinct(), "qid", "left_semi")
        fh = (fh.join(gaps, "qid", "full")
              .select("qid", F.least("first_rank", "gap_rank").alias("first_rank")))
    return fh


def evaluate(run: DataFrame, qrels: DataFrame, *, mrr_depth: int = MRR_DEPTH, recall_ks=(1, 50),
             zero_pad: bool = False, min_rel: int | None = None, size: int = 1000) -> DataFrame:
    """One row: ``mrr_at_10, recall_at_1, recall_at_50, recall_at_all, queries_ranked, queries_evaluated, queries_judged``.

    Denominators are the number of judged queries, ranked or not.
    ``queries_ranked`` counts every query of the run.
    """
    fh = first_hits(run, qrels, zero_pad=zero_pad, min_rel=min_rel, size=size)
    judged = qrels.select("qid", F.lit(1).alias("judged"), F.lit(0).alias("ranked"),
                          F.lit(None).cast("int").alias("first_rank"))
    ranked = run.select("qid", F.lit(0).alias("judged"), F.lit(1).alias("ranked"),
                        F.lit(None).cast("int").alias("first_rank"))
    hits = fh.select("qid", F.lit(0).alias("judged"), F.lit(0).alias("ranked"), F.col("first_rank").cast("int"))
    per_q = (judged.unionByName(ranked).unionByName(hits).groupBy("qid")
             .agg(F.max("judged").alias("judged"), F.max("ranked").alias("ranked"),
                  F.min("first_rank").alias("first_rank")))
    fr = F.col("first_rank")
    is_judged = F.col("judged") == 1
    n_judged = F.sum(F.col("judged")).cast("double")
    aggs = [
        F.try_divide(F.sum(F.when(is_judged & (fr <= mrr_depth), F.lit(1.0) / fr).otherwise(F.lit(0.0))),
                     n_judged).alias(f"mrr_at_{mrr_depth}"),
    ]
    for k in recall_ks:
        aggs.append(F.try_divide(F.count(F.when(is_judged & (fr <= k), True)).cast("double"), n_judged)
                    .alias(f"recall_at_{k}"))
    aggs += [
        F.try_divide(F.count(F.when(is_judged & fr.isNotNull(), True)).cast("double"), n_judged)
        .alias("recall_at_all"),
        F.sum("ranked").cast("long").alias("queries_ranked"),
        F.count(F.when(is_judged & (F.col("ranked") == 1), True)).cast("long").alias("queries_evaluated"),
        F.sum("judged").cast("long").alias("queries_judged"),
    ]
    return per_q.agg(*aggs)


def evaluate_checked(run: DataFrame, qrels: DataFrame, **kw) -> DataFrame:
    """``evaluate`` plus the no-overlap error: fails when no ranked query is judged.

    Fetches the one metrics row, so the check costs no second pass.
    """
    metrics = evaluate(run, qrels, **kw)
    row = metrics.first()
    if row is None or not row["queries_evaluated"]:
        raise ValueError("the run and the judgements have no query in common")
    return metrics.sparkSession.createDataFrame([row], metrics.schema)


def metric_report(metrics: DataFrame, names: dict | None = None) -> DataFrame:
    """One-row metrics → ``metric, value`` rows, named as printed, sorted by name."""
    names = names or METRIC_NAMES
    cols = [c for c in names if c in metrics.columns]
    renamed = metrics.select(*[F.col(c).cast("double").alias(names[c]) for c in cols])
    return (renamed.unpivot([], [names[c] for c in cols], "metric", "value")
            .orderBy("metric"))


def duplicate_check(run: DataFrame) -> DataFrame:
    """Every ``(qid, pid)`` ranked more than once (pid 0 exempt) → ``qid, pid, n``."""
    return (run.filter(F.col("pid") != 0).groupBy("qid", "pid")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


# ---------------------------------------------------------------- group losses
def group_log_softmax(df: DataFrame, score: str, by=("qid",), name: str | None = None) -> DataFrame:
    """``score - max - ln Σ exp(score - max)`` inside each group (stable log-softmax)."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_m", F.max(score).over(w))
    d = d.withColumn("_lse", F.log(F.sum(F.exp(F.col(score) - F.col("_m"))).over(w)))
    return d.withColumn(name or f"{score}_logp", F.col(score) - F.col("_m") - F.col("_lse")).drop("_m", "_lse")


def own_group_scores(groups: DataFrame, qvecs: DataFrame, pvecs: DataFrame) -> DataFrame:
    """Student scores of each query against its own group's passages → ``qid, slot, pid, student``.

    These are the columns ``i·(n+1) … i·(n+1)+n`` of the in-batch matrix,
    fetched by key instead of by position: two equi-joins, no matrix.
    """
    from dpmine.functions.vectors import dot
    q = qvecs.select("qid", F.col("vec").alias("_qv"))
    p = pvecs.select("pid", F.col("vec").alias("_pv"))
    return (groups.join(q, "qid").join(p, "pid")
            .select("qid", "slot", "pid", dot("_qv", "_pv").alias("student"), *[
                c for c in groups.columns if c not in ("qid", "slot", "pid")]))


def distill_kl(scored: DataFrame, batch: str = "batch", student: str = "student", teacher: str = "score") -> DataFrame:
    """Listwise distillation loss per batch → ``batch, n_queries, kl``.

    Per query ``Σ eᵗ (t − s)`` over its group, with ``s``/``t`` the
    log-softmaxed student/teacher scores; averaged over the batch's queries
    (``batchmean`` with log targets).

    One exchange by query: the group's score pairs (a training group: n + 1 of
    them; more than ``MAX_LIST`` are an error) meet in one array, whose two
    largest scores, sums of exponentials and weighted difference give
    ``Σ p (t − s) − lse(t) + lse(s)`` without a window or a sort.
    """
    from dpmine.operators.groups import MAX_LIST
    pair = F.struct(F.col(student).cast("double").alias("s"), F.col(teacher).cast("double").alias("t"))
    g = scored.groupBy(batch, "qid").agg(F.collect_list(pair).alias("_g"))
    many = F.raise_error(F.concat(F.lit("group too large: qid "), F.col("qid").cast("string"))).cast("double")
    top = lambda c: F.array_max(F.transform("_g", lambda x: x[c]))
    total = lambda f: F.aggregate("_g", F.lit(0.0), lambda acc, x: acc + f(x))
    g = g.withColumns({"_ms": top("s"), "_mt": top("t")})
    g = g.withColumns({"_zs": total(lambda x: F.exp(x["s"] - F.col("_ms"))), "_zt": total(lambda x: F.exp(x["t"] - F.col("_mt"))),
                       "_d": total(lambda x: F.exp(x["t"] - F.col("_mt")) * ((x["t"] - F.col("_mt")) - (x["s"] - F.col("_ms"))))})
    kl = F.col("_d") / F.col("_zt") - F.log("_zt") + F.log("_zs")
    per_q = g.select(batch, "qid", F.when(F.size("_g") > MAX_LIST, many).otherwise(kl).alias("kl_q"))
    return per_q.groupBy(batch).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("kl_q").alias("kl"))


def in_batch_accuracy(groups: DataFrame, qvecs: DataFrame, pvecs: DataFrame, group_size: int,
                      batch: str = "batch", digits: int = 6) -> DataFrame:
    """Share of queries whose best passage over the *whole batch* is their own positive.

    ``groups``: ``batch, qid, slot, pid`` with slot 0 the positive.  Column
    of a passage in the batch matrix = query position in batch × group_size +
    slot; ties go to the lower column (argmax).  The pairing is an equi-join
    on the batch id, so work per batch is bounded by the batch size.
    """
    from dpmine.functions.vectors import dot
    qpos = groups.select(batch, "qid").distinct().withColumn(
        "_qi", F.dense_rank().over(Window.partitionBy(batch).orderBy("qid")) - 1)
    cols = (groups.join(qpos, [batch, "qid"])
            .select(batch, (F.col("_qi") * group_size + F.col("slot")).alias("_col"), "pid")
            .join(pvecs.select("pid", F.col("vec").alias("_pv")), "pid"))
    rows = qpos.join(qvecs.select("qid", F.col("vec").alias("_qv")), "qid")
    pairs = rows.join(cols, batch).select(batch, "qid", "_qi", "_col", F.round(dot("_qv", "_pv"), digits).alias("_s"))
    w = Window.partitionBy(batch, "qid").orderBy(F.col("_s").desc(), F.col("_col").asc())
    best = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return best.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count(F.when(F.col("_col") == F.col("_qi") * group_size, True)).alias("n_correct")).withColumn(
        "accuracy", F.col("n_correct") / F.col("n_queries"))
