"""Composite jobs (P1-P7): retrieve, mine, score, merge, evaluate, training table, rounds.

Each job is a chain of the library's DataFrame operators with its outputs
written as stages (``dpmine.sources.io.Stage``) or checkpoints in the shared
folder, so a round can resume and lost executors cost a re-read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.operators import encode as EN
from dpmine.operators import groups as G
from dpmine.operators import metrics as M
from dpmine.operators import scoring as SC
from dpmine.operators import search as S
from dpmine.sources.commits import CommitLog, delete, exists, rename
from dpmine.sources.io import Stage, fingerprint, write_run


SPREAD_BYTES = 32 << 20     # of a shard's files that one task encodes


def retrieve(queries: DataFrame, passages: DataFrame, k: int, gaussian: bool = False, **kw) -> DataFrame:
    """Top-k run ``qid, pid, rank, score``; ``gaussian`` ranks passages ``pid, mean, var`` by log-density."""
    if gaussian:
        return S.gaussian_topk(queries, passages, k, **kw)
    return S.mips_topk(queries, passages, k, **kw)


def encode_shards(rows: DataFrame, root: str, id_col: str, text_cols: list[str], make_model, model_key: str, shards: int = 16,
                  batch_size: int = 2048) -> DataFrame:
    """U1 with a restart by shard: ``id, vec`` of all rows, encoded shard by shard into ``root``.

    The texts are stored once, dealt by a hash of the id; every shard is encoded by a job of its own and then committed
    to the folder's log, which is the manifest.  A restart encodes only the shards that are not in it.  The folder is
    keyed by the input (plan and files) and ``model_key``: name a new version of a model anew.
    """
    spark, what = rows.sparkSession, {"model": model_key, "texts": text_cols, "shards": shards}
    of = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")
    keyed = Stage(spark, root, "encode", what, [rows])
    texts = Stage(spark, keyed.path, "texts")
    if not texts.exists():
        held = f"{texts.path}.{uuid.uuid4().hex[:12]}.tmp"
        dealt = rows.select(id_col, *text_cols, of.alias("shard")).hint("rebalance", "shard")     # a large shard: several tasks
        dealt.write.partitionBy("shard").parquet(held)
        if not rename(spark, held, texts.path):
            delete(spark, held)
    log = CommitLog(spark, f"{keyed.path}/log")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(id_col, *text_cols).schema)
    for shard in range(shards):
        while shard not in (done := {e["shard"]: e["folder"] for e in log.entries()[1]}):
            last, folder = log.entries()[0], f"{keyed.path}/vectors/shard={shard}-{uuid.uuid4().hex[:12]}"
            place = f"{texts.path}/shard={shard}"
            if exists(spark, place):                              # a shard without a row has no folder
                own = spark.read.schema(schema).parquet(place)
                EN.encode(spread(own), id_col, text_cols, make_model, batch_size, model_key=model_key).write.parquet(folder)
            log.commit({"shard": shard, "folder": folder if exists(spark, folder) else None}, last)
    folders = [f for _, f in sorted(done.items()) if f]
    out = f"`{id_col}` long, vec array<double>"
    return spark.read.schema(out).parquet(*folders) if folders else spark.createDataFrame([], out)


def spread(rows: DataFrame) -> DataFrame:
    """One stored file is one scan task: deal it over the cluster, so that every worker has a model at work.

    Tasks grow with the stored size, so that none reads more than some ``SPREAD_BYTES`` of files.
    """
    tasks = math.ceil(S.stored_bytes(rows) / SPREAD_BYTES)
    return rows.repartition(max(1, tasks, rows.sparkSession.sparkContext.defaultParallelism))


def retrieve_texts(spark: SparkSession, root: str, queries: DataFrame, corpus: DataFrame, make_query_model,
                   make_passage_model, k: int, model_key: str, gaussian: bool = False, run_path: str | None = None,
                   shards: int = 16, batch_size: int = 2048, **search) -> DataFrame:
    """P1 from texts to a run: encode both sides, fold, search, write → stored ``qid, pid, rank, score``.

    ``make_query_model()(texts)`` and ``make_passage_model()((title, contents) pairs)`` give vectors; with ``gaussian``
    a passage's is its mean followed by its variance.  Encoded shards and the run are stored under ``root``, keyed by
    their inputs and ``model_key``: a restart goes on where the job stopped.  ``run_path`` also gets the run as a TSV file.
    """
    q = encode_shards(queries.select("qid", F.coalesce("query", F.lit("")).alias("query")), f"{root}/queries", "qid", ["query"],
                      make_query_model, f"{model_key}-queries", max(1, shards // 8), batch_size)
    p = encode_shards(corpus.select("pid", "title", "contents"), f"{root}/passages", "pid", ["title", "contents"],
                      make_passage_model, f"{model_key}-passages", shards, batch_size)
    if gaussian:
        half = (F.size("vec") / 2).cast("int")
        p = p.select("pid", F.slice("vec", F.lit(1), half).alias("mean"), F.slice("vec", half + 1, half).alias("var"))
        q = q.select("qid", F.col("vec").alias("mean"))
    run = Stage(spark, root, "run", {"k": k, "gaussian": gaussian}, [q, p]).get(lambda: retrieve(q, p, k, gaussian, **search))
    if run_path:
        write_run(run, run_path)
    return run


def evaluate(run: DataFrame, qrels: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """P5: the metrics row with the number of repeated ``(qid, pid)``, and those pairs.

    Repeats are reported, not an error; a run that shares no query with the
    judgements is one.
    """
    from dpmine.operators.rows import side_by_side
    repeats = M.duplicate_check(run)
    row = side_by_side([M.evaluate_checked(run, qrels, **kw), repeats.agg(F.count(F.lit(1)).alias("repeated_pairs"))])
    return row, repeats


def training_table(groups_long: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, seed: int = 42,
                   epoch: int = 0, strict: bool = False, query_len: int | None = None,
                   passage_len: int | None = None, reserve: int = 0) -> DataFrame:
    """Sampled groups with texts, one row per ``(qid, slot)``.

    Queries are cut to ``query_len`` tokens and (title, contents) pairs to
    ``passage_len`` tokens together, less ``reserve`` for special tokens.  An
    unknown passage or query is an error; groups that can't be completed are
    left out (``rejected_groups``) or, with ``strict``, an error.
    """
    from dpmine.functions.text import words
    from dpmine.operators.text import truncate_pair, truncate_tokens
    g = G.assemble_groups(groups_long, n, seed, epoch, strict)
    g = G.lookup_passages(g, corpus).join(queries.select("qid", "query"), "qid", "left")
    g = g.withColumn("query", F.when(F.col("query").isNull(), F.raise_error(F.concat(
        F.lit("query without a text: "), F.col("qid").cast("string"))).cast("string")).otherwise(F.col("query")))
    if query_len is not None:
        g = g.withColumn("query", F.array_join(truncate_tokens(words("query"), query_len), " "))
    if passage_len is not None:
        g = g.withColumn("_a", words("title")).withColumn("_b", words("contents"))
        a, b = truncate_pair("_a", "_b", passage_len, reserve)
        g = g.withColumn("title", F.array_join(a, " ")).withColumn("contents", F.array_join(b, " ")).drop("_a", "_b")
    return g.select("qid", "slot", "pid", "score", "query", "title", "contents")


@dataclass
class RoundConfig:
    train_k: int = 200          # top-k for mining (train queries)
    dev_k: int = 1000           # top-k for evaluation (dev queries)
    depth: int = 100            # negatives kept per query
    cap: int = 100              # candidates scored per list
    gaussian: bool = False      # rank by Gaussian log-density (passages carry mean, var)
    negatives: int = 8          # of a training group
    seed: int = 42
    query_len: int | None = 32  # tokens kept in the training table
    passage_len: int | None = 144
    search: dict = field(default_factory=dict)


def _searches(train_q: DataFrame, dev_q: DataFrame, passages: DataFrame, cfg: RoundConfig, cut) -> tuple:
    """The train and dev runs; queries that are the same table are searched once, at the larger k."""
    if dev_q is train_q:
        run = cut(lambda: retrieve(train_q, passages, max(cfg.train_k, cfg.dev_k), cfg.gaussian, **cfg.search), "run")
        return run.filter(F.col("rank") <= cfg.train_k), run.filter(F.col("rank") <= cfg.dev_k)
    return (cut(lambda: retrieve(train_q, passages, cfg.train_k, cfg.gaussian, **cfg.search), "run"),
            cut(lambda: retrieve(dev_q, passages, cfg.dev_k, cfg.gaussian, **cfg.search), "dev_run"))


def _round(round_id: int, run: DataFrame, dev_run: DataFrame, qrels: DataFrame, dev_qrels: DataFrame, query_texts: DataFrame,
           corpus: DataFrame | None, score_new, other: DataFrame | None, cfg: RoundConfig, cut) -> dict:
    """Mine, score, merge, assemble and evaluate; ``cut(build, name)`` stores a stage, ``score_new(pairs)`` gives
    (known, new) score tables."""
    from dpmine.operators.rows import side_by_side
    mined = cut(lambda: G.hard_negatives(qrels, run, query_texts, depth=cfg.depth, max_rank=cfg.train_k), "mined")
    capped = G.cap_candidates(mined, cfg.cap)
    known, new = score_new(SC.unscored_pairs(capped, None))
    scored = cut(lambda: SC.attach_scores(capped, new if known is None else known.unionByName(new)), "scored")
    merged = cut(lambda: SC.merge_negatives(scored, other), "merged") if other is not None else scored
    training = cut(lambda: G.assemble_groups(merged, cfg.negatives, cfg.seed, round_id) if corpus is None else
                   training_table(merged, query_texts, corpus, cfg.negatives, cfg.seed, round_id,
                                  query_len=cfg.query_len, passage_len=cfg.passage_len), "training")
    metrics, repeats = evaluate(dev_run, dev_qrels)
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((merged, "merged_rows"), (training, "training_rows"))]
    n_mined = mined.agg(F.countDistinct("qid").alias("mined_queries"))
    summary = side_by_side([n_mined, SC.cache_stats(capped, new), metrics, *counts]).select(F.lit(round_id).alias("round"), "*")
    return {"run": run, "mined": mined, "new_scores": new, "scored": scored, "merged": merged, "training": training,
            "dev_run": dev_run, "metrics": metrics, "repeats": repeats, "summary": summary}


def mining_round(spark: SparkSession, *, round_id: int, train_queries: DataFrame, dev_queries: DataFrame,
                 passages: DataFrame, qrels: DataFrame, dev_qrels: DataFrame, query_texts: DataFrame,
                 scorer: SC.Scorer, cache: DataFrame | None, other: DataFrame | None, corpus: DataFrame | None = None,
                 cfg: RoundConfig = RoundConfig()) -> dict:
    """P7, one round: retrieve → mine → score through the cache → merge → training table → evaluate.

    The model update between mining and the dev retrieval happens outside
    (the vectors passed in are the model's).  Every stage is stored before the
    next reads it.  Returns the round's tables and a one-row ``summary``.
    """
    from dpmine.session import materialize

    def cut(build, name):
        return materialize(build(), name)

    def score_new(pairs):
        known = cut(lambda: SC.needed_scores(cache, pairs), "known") if cache is not None else None
        return known, cut(lambda: SC.score_pairs(SC.unscored_pairs(pairs, known), scorer), "new_scores")

    run, dev_run = _searches(train_queries, dev_queries, passages, cfg, cut)
    return _round(round_id, run, dev_run, qrels, dev_qrels, query_texts, corpus, score_new, other, cfg, cut)


def mining_rounds(spark: SparkSession, root: str, rounds: int, *, vectors_for_round, train_queries_text: DataFrame,
                  qrels: DataFrame, dev_qrels: DataFrame, scorer_for_round, other: DataFrame | None = None,
                  corpus: DataFrame | None = None, cfg: RoundConfig = RoundConfig(), scorer_id: str = "teacher",
                  input_version: str = "0") -> DataFrame:
    """P7, the loop: rounds 1..n, every output in ``root/round=<i>/…``, the score cache shared across rounds.

    ``vectors_for_round(i)`` returns ``(train_queries, dev_queries, passages)``
    as the model of round i encodes them; ``scorer_for_round(i)`` the teacher.
    Stage folders and cache batches are keyed by all parameters, ``scorer_id``
    and the fingerprints of all input frames (plan, file paths, sizes, times),
    so a rerun resumes after the last finished stage and a run with other
    parameters or changed files never reads a stale one.  Only frames made from
    rows of the driver look alike whatever they hold: name a new
    ``input_version`` when those change.  The score cache
    itself is keyed by the teacher.  A missing score is an error.
    Returns the union of the rounds' one-row summaries.
    """
    cache = SC.ScoreCache(spark, f"{root.rstrip('/')}/score_cache", scorer_id)
    summaries = []
    for i in range(1, rounds + 1):
        base = f"{root.rstrip('/')}/round={i}"
        train_q, dev_q, passages = vectors_for_round(i)
        frames = [train_q, dev_q, passages, qrels, dev_qrels, train_queries_text, corpus, other]
        params = {**asdict(cfg), "scorer": scorer_id, "inputs": input_version, "other": other is not None,
                  "reads": [fingerprint(f) for f in frames if f is not None]}
        batch = f"{i}-{Stage(spark, base, 'batch', params).path.rsplit('-', 1)[-1]}"

        def cut(build, name, base=base, params=params):
            return Stage(spark, base, name, params).get(build)

        def score_new(pairs, i=i, batch=batch, cut=cut):
            def build():
                known = SC.needed_scores(cache.read(), pairs)
                return cache.append_new(SC.score_pairs(SC.unscored_pairs(pairs, known), scorer_for_round(i)), batch)
            new = cut(build, "new_scores").select("qid", "pid", "score")
            known = SC.needed_scores(cache.read(), pairs).join(new.select("qid", "pid"), ["qid", "pid"], "left_anti")
            return known, new

        run, dev_run = _searches(train_q, dev_q, passages, cfg, cut)
        out = _round(i, run, dev_run, qrels, dev_qrels, train_queries_text, corpus, score_new, other, cfg, cut)
        summaries.append(out["summary"])
    return reduce(DataFrame.unionByName, summaries)
