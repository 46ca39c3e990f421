"""The registered queries: each operator bound to the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
work grows with the input tables.  Score-like doubles are rounded to six
digits in the registered output only (the operators return full precision),
so that the DuckDB oracle compares equal regardless of summation order.
"""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.operators import groups as G
from dpmine.operators import metrics as M
from dpmine.operators import ordinal as O
from dpmine.operators import scoring as SC
from dpmine.operators import text as TX
from dpmine.operators import pooling as PL
from dpmine.operators import encode as EN
from dpmine.functions import vectors as V
from dpmine.sources import io as IO
from dpmine.plans import jobs as J
from dpmine.session import materialize, scratch_path
from dpmine.functions import text as TF
from dpmine.operators import search as S
from dpmine.sources import testbed as T

DIGITS = 6
TOPK = 10
EVAL_RUN_K = 100
MINING_RUN_K = 200
DEPTH = 100
SEED = 42
N_NEG = 8
N_NEG_PADDED = 150
CAP = 100
PREV_RUN_K, PREV_DEPTH = 100, 50     # the previous round whose scores fill the cache
OTHER_K = 20                        # second negative set: Gaussian top-20 minus positives
BATCH_QUERIES = 5
NGRAM_N = 2
QUERY_LEN, PASSAGE_LEN, PAIR_RESERVE = 32, 144, 3
SCORE_BATCH = 100
HEAD_N = 10
HASH_DIM = 64
SEQ_MASK_MOD = 5
VECTOR_DIM = 64


#: Of the query that is being built: shared inputs are stored once per query, never across queries or threads.
_stages: ContextVar[dict] = ContextVar("stages")


def _once(name: str, build):
    held = _stages.get()
    if name not in held:
        held[name] = build()
    return held[name]


def _fresh(fn):
    """A registered query: starts with no stored stage."""
    def run(spark, sf):
        token = _stages.set({})
        try:
            return fn(spark, sf)
        finally:
            _stages.reset(token)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def stage(df: DataFrame) -> DataFrame:
    """Materialise a pipeline stage (run, mined groups, scores) and cut its lineage.

    Written as parquet under the shared folder named by ``spark.checkpoint.dir``,
    so a lost executor costs a re-read, not a re-run of the upstream search.
    """
    return materialize(df)


def _r(col: str, name: str | None = None):
    return F.round(F.col(col), DIGITS).alias(name or col)


# ---------------------------------------------------------------- search
def q_vectors(spark, sf):
    return _once("q", lambda: T.query_vectors(spark, sf))


def run_k(spark, sf, k):
    """The run's first ``k`` ranks; a query searches once, at the depth of its first use (mining is deepest)."""
    deep = _once("run", lambda: (k, stage(S.mips_topk(q_vectors(spark, sf), T.passage_vectors(spark, sf), k))))
    if k > deep[0]:
        raise ValueError("ask for the deepest run first")
    return deep[1].filter(F.col("rank") <= k)


def gaussian_run(spark, sf, k):
    def search():
        q = T.query_vectors(spark, sf).select("qid", F.col("vec").alias("mean"))
        return stage(S.gaussian_topk(q, T.passage_gaussians(spark, sf), max(k, OTHER_K)))
    return _once("gaussian", search).filter(F.col("rank") <= k)


def qrels(spark, sf):
    return _once("qrels", lambda: stage(T.qrels(spark, sf)))


def q_score_matrix(spark, sf):
    """All pairs of a batch: the queries and passages of a hundred neighbouring ids."""
    batch = lambda df, c: df.withColumn("batch", F.floor(F.col(c) / SCORE_BATCH))
    sm = S.score_matrix(batch(T.query_vectors(spark, sf), "qid"), batch(T.passage_vectors(spark, sf), "pid"))
    return sm.select("batch", "qid", "pid", _r("score"))


def q_mips_topk(spark, sf):
    run = S.mips_topk(T.query_vectors(spark, sf), T.searched_vectors(spark, sf), TOPK)
    return run.select("qid", "pid", "rank", _r("score"))


def q_gaussian_topk(spark, sf):
    q = T.query_vectors(spark, sf).select("qid", F.col("vec").alias("mean"))
    run = S.gaussian_topk(q, T.gaussians(T.searched_vectors(spark, sf)), TOPK)
    return run.select("qid", "pid", "rank", _r("score"))


# ---------------------------------------------------------------- evaluation
def _eval(spark, sf):
    return M.evaluate(run_k(spark, sf, EVAL_RUN_K), T.qrels_eval(spark, sf))


def q_eval_mrr(spark, sf):
    return _eval(spark, sf).select(_r("mrr_at_10"))


def q_eval_recall(spark, sf):
    return _eval(spark, sf).select(_r("recall_at_1"), _r("recall_at_50"), _r("recall_at_all"))


def q_eval_all(spark, sf):
    return _eval(spark, sf).select(_r("mrr_at_10"), _r("recall_at_1"), _r("recall_at_50"),
                                   _r("recall_at_all"), "queries_ranked", "queries_evaluated", "queries_judged")


def q_evaluate_job(spark, sf):
    """The evaluation job: metrics of the fused run, with the number of passages it ranks twice."""
    row, _ = J.evaluate(fused_run(spark, sf), T.qrels_eval(spark, sf))
    return row.select(_r("mrr_at_10"), _r("recall_at_1"), _r("recall_at_50"), _r("recall_at_all"), "queries_ranked",
                      "queries_evaluated", "queries_judged", F.col("repeated_pairs").cast("long"))


def q_metric_report(spark, sf):
    return M.metric_report(_eval(spark, sf)).select("metric", _r("value"))


def fused_run(spark, sf):
    """Two retrievers' top-10 lists appended naively (ranks 1-10, then 11-20): repeats appear."""
    a = run_k(spark, sf, TOPK).select("qid", "pid", "rank")
    b = gaussian_run(spark, sf, TOPK).select("qid", "pid", (F.col("rank") + TOPK).alias("rank"))
    return a.unionByName(b)


def q_duplicate_check(spark, sf):
    return M.duplicate_check(fused_run(spark, sf))


def q_ranked_array(spark, sf):
    return G.ranked_array(run_k(spark, sf, EVAL_RUN_K), EVAL_RUN_K)


# ---------------------------------------------------------------- mining
def _mining_inputs(spark, sf):
    return qrels(spark, sf), run_k(spark, sf, MINING_RUN_K), T.query_texts(spark, sf)


def mined(spark, sf):
    def mine():
        qr, run, qt = _mining_inputs(spark, sf)
        return stage(G.hard_negatives(qr, run, qt, depth=DEPTH, max_rank=MINING_RUN_K))
    return _once("mined", mine)


def q_collect_positives(spark, sf):
    return G.collect_positives(qrels(spark, sf))


def q_mining_queries(spark, sf):
    return G.mining_queries(*_mining_inputs(spark, sf))


def q_exclude_positives(spark, sf):
    qr, run, _ = _mining_inputs(spark, sf)
    return G.exclude_positives(run, qr).select("qid", "pid", "rank", _r("score"))


def q_hard_negatives(spark, sf):
    return mined(spark, sf)


def q_explode_groups(spark, sf):
    return G.explode_groups(G.to_nested(mined(spark, sf)))


def q_mining_report(spark, sf):
    qr, run, qt = _mining_inputs(spark, sf)
    return G.mining_report(qr, run, qt, depth=DEPTH, max_rank=MINING_RUN_K)


def q_sample_positive(spark, sf):
    return G.sample_positive(mined(spark, sf), SEED)


def q_sample_negatives(spark, sf):
    return G.sample_negatives(mined(spark, sf), N_NEG, SEED)


def q_sample_negatives_padded(spark, sf):
    return G.sample_negatives(mined(spark, sf), N_NEG_PADDED, SEED)


def q_train_groups(spark, sf):
    return G.train_groups(mined(spark, sf), T.query_texts(spark, sf), N_NEG, SEED)


def q_lookup_passages(spark, sf):
    g = G.assemble_groups(mined(spark, sf), N_NEG, SEED)
    return G.lookup_passages(g, T.corpus(spark, sf)).select("qid", "slot", "pid", "title", "contents")


def q_training_table(spark, sf):
    """Training groups with truncated texts, as the trainer reads them."""
    return J.training_table(mined(spark, sf), T.query_texts(spark, sf), T.corpus(spark, sf), N_NEG, SEED,
                            query_len=QUERY_LEN, passage_len=PASSAGE_LEN, reserve=PAIR_RESERVE)


def q_rejected_groups(spark, sf):
    """Queries that cannot be sampled when only their ten nearest passages are candidates."""
    g = G.hard_negatives(qrels(spark, sf), run_k(spark, sf, TOPK), T.query_texts(spark, sf), depth=1, max_rank=TOPK)
    some = mined_or_all(g, qrels(spark, sf))
    return G.rejected_groups(some)


def mined_or_all(long, judged):
    """Long rows with every judged query present (by its positives)."""
    pos = judged.select("qid", F.lit(G.POS).alias("role"), F.lit(0).alias("pos"), "pid", F.lit(1.0).alias("score"))
    return long.filter(F.col("role") == G.NEG).unionByName(pos)


def q_preview(spark, sf):
    nested = G.to_nested(G.preview_groups(mined(spark, sf), 3, SEED), T.query_texts(spark, sf))
    flat = nested.select("qid", "query", F.col("positives.doc_id").alias("pos_ids"),
                         F.col("negatives.doc_id").alias("neg_ids"))
    return G.preview(flat, 3, SEED)


# ---------------------------------------------------------------- scoring
def teacher(spark, sf):
    return SC.vector_teacher(T.query_vectors(spark, sf), T.passage_vectors(spark, sf))


def score_cache(spark, sf):
    """Teacher scores of the previous (shallower) round's mined pairs."""
    def score():
        run = run_k(spark, sf, MINING_RUN_K).filter(F.col("rank") <= PREV_RUN_K)
        prev = G.hard_negatives(qrels(spark, sf), run, T.query_texts(spark, sf), depth=PREV_DEPTH, max_rank=PREV_RUN_K)
        return stage(SC.score_pairs(SC.unscored_pairs(prev, None), teacher(spark, sf)))
    return _once("cache", score)


def other_negatives(spark, sf):
    """Second negative set in long form: Gaussian top-20 without the judged passages."""
    g = G.exclude_positives(gaussian_run(spark, sf, OTHER_K), qrels(spark, sf))
    from pyspark.sql import Window
    return g.select("qid", F.lit(G.NEG).alias("role"),
                    (F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1).cast("int").alias("pos"),
                    "pid", "score")


def q_cap_candidates(spark, sf):
    merged = SC.merge_negatives(mined(spark, sf), other_negatives(spark, sf))
    return G.cap_candidates(merged, CAP).select("qid", "role", "pos", "pid", _r("score"))


def q_unscored_pairs(spark, sf):
    return SC.unscored_pairs(G.cap_candidates(mined(spark, sf), CAP), score_cache(spark, sf))


def q_score_pairs(spark, sf):
    pairs = SC.unscored_pairs(mined(spark, sf), None)
    scorer = SC.overlap_scorer(T.query_texts(spark, sf), T.corpus(spark, sf))
    return SC.score_pairs(pairs, scorer).select("qid", "pid", _r("score"))


def _new_scores(spark, sf):
    todo = SC.unscored_pairs(G.cap_candidates(mined(spark, sf), CAP), score_cache(spark, sf))
    return SC.score_pairs(todo, teacher(spark, sf))


def q_score_upsert(spark, sf):
    return SC.score_upsert(score_cache(spark, sf), _new_scores(spark, sf)).select("qid", "pid", _r("score"))


def q_attach_scores(spark, sf):
    g = mined(spark, sf)
    scores = SC.score_pairs(SC.unscored_pairs(g, None),
                            SC.overlap_scorer(T.query_texts(spark, sf), T.corpus(spark, sf)))
    return SC.attach_scores(g, scores).select("qid", "role", "pos", "pid", _r("score"))


def scored_groups(spark, sf):
    return _once("scored", lambda: stage(SC.score_groups(
        mined(spark, sf), score_cache(spark, sf), teacher(spark, sf), CAP)[0]))


def q_score_groups(spark, sf):
    return scored_groups(spark, sf).select("qid", "role", "pos", "pid", _r("score"))


def q_cache_stats(spark, sf):
    _, _, stats = SC.score_groups(mined(spark, sf), score_cache(spark, sf), teacher(spark, sf), CAP)
    return stats.select("total", "new", "skip", _r("skip_rate"))


def q_merge_negatives(spark, sf):
    merged = SC.merge_negatives(scored_groups(spark, sf), other_negatives(spark, sf))
    return merged.select("qid", "role", "pos", "pid", _r("score"))


# ---------------------------------------------------------------- losses
def batched_groups(spark, sf):
    """Training groups of the scored set, n = 8, with batches of five queries in qid order."""
    g = G.assemble_groups(scored_groups(spark, sf), N_NEG, SEED)
    qb = O.batches(g.select("qid").distinct(), BATCH_QUERIES, ["qid"]).select("qid", "batch")
    return stage(g.join(qb, "qid"))


def q_batches(spark, sf):
    return O.batches(G.assemble_groups(scored_groups(spark, sf), N_NEG, SEED).select("qid").distinct(),
                     BATCH_QUERIES, ["qid"]).select("qid", "ordinal", "batch")


def q_own_group_scores(spark, sf):
    g = batched_groups(spark, sf)
    o = M.own_group_scores(g, T.query_vectors(spark, sf), T.passage_vectors(spark, sf))
    return o.select("qid", "slot", "pid", _r("student"))


def q_group_log_softmax(spark, sf):
    g = batched_groups(spark, sf)
    return M.group_log_softmax(g, "score", ("qid",), "logp").select("qid", "slot", "pid", _r("logp"))


def q_distill_kl(spark, sf):
    g = batched_groups(spark, sf)
    o = M.own_group_scores(g, T.query_vectors(spark, sf), T.passage_vectors(spark, sf))
    return M.distill_kl(o, "batch", "student", "score").select("batch", "n_queries", _r("kl"))


def q_in_batch_accuracy(spark, sf):
    g = batched_groups(spark, sf)
    acc = M.in_batch_accuracy(g, T.query_vectors(spark, sf), T.passage_vectors(spark, sf), N_NEG + 1)
    return acc.select("batch", "n_queries", "n_correct", _r("accuracy"))


# ---------------------------------------------------------------- text
def _docs(spark, sf):
    """Documents as scanned, or dealt to ``dpmine.text.partitions`` partitions where the session names a number.

    For files of one row group, which a scan can't split; leave it unset where a scan has enough splits.
    """
    parts = spark.conf.get("dpmine.text.partitions", None)
    docs = T.documents(spark, sf)
    return docs.repartition(int(parts)) if parts else docs


def q_tokenize(spark, sf):
    return TX.tokenize_docs(_docs(spark, sf))


def q_words_uncased(spark, sf):
    return TX.tokenize_docs(_docs(spark, sf), uncased=True)


def q_token_count(spark, sf):
    return _docs(spark, sf).select("doc_id", TF.token_count("text").cast("int").alias("n_tokens"))


def q_token_offsets(spark, sf):
    return TX.token_table(_docs(spark, sf)).select("doc_id", "i", "token", "start", "end")


def q_untokenize(spark, sf):
    return TX.untokenize_docs(_docs(spark, sf))


def q_token_slice(spark, sf):
    return TX.untokenize_docs(_docs(spark, sf), 2, -2)


def _punct_word(w):
    """n-gram filter: drop a gram when one of its words does not start with a letter, digit or mark."""
    return ~w.rlike(r"^[\p{L}\p{N}\p{M}]")


def q_ngrams(spark, sf):
    return TX.ngram_rows(_docs(spark, sf), NGRAM_N, True, drop_word=_punct_word)


def q_ngram_counts(spark, sf):
    return TX.ngram_counts(_docs(spark, sf), NGRAM_N, True, drop_word=_punct_word)


def q_entity_groups(spark, sf):
    return TX.entity_runs(_docs(spark, sf), TX.capital_tag)


def q_annotations(spark, sf):
    """The attached entity tags of every token."""
    return TX.annotation(TX.capital_tags(TX.token_table(_docs(spark, sf))), "tag")


def q_ngram_spans(spark, sf):
    return TX.ngram_spans(_docs(spark, sf), NGRAM_N).select("doc_id", F.col("s").cast("int"), F.col("e").cast("int"))


def q_truncate_query(spark, sf):
    t = T.query_texts(spark, sf).select("qid", TX.truncate_tokens(TF.words("query"), QUERY_LEN).alias("t"))
    return t.select("qid", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("text"))


def q_truncate_pair(spark, sf):
    c = T.corpus(spark, sf).select("pid", TF.words("title").alias("a"), TF.words("contents").alias("b"))
    a, b = TX.truncate_pair("a", "b", PASSAGE_LEN, PAIR_RESERVE)
    c = c.select("pid", a.alias("a"), b.alias("b"))
    return c.select("pid", F.size("a").alias("len_a"), F.size("b").alias("len_b"),
                    F.array_join("a", " ").alias("text_a"), F.array_join("b", " ").alias("text_b"))


def q_passage_text(spark, sf):
    return T.corpus(spark, sf).select("pid", TF.passage_text("title", "contents").alias("text"))


# ---------------------------------------------------------------- ordinals
def q_with_ordinal(spark, sf):
    return O.with_ordinal(_docs(spark, sf), ["doc_id"]).select("doc_id", "text", "ordinal")


def q_head_sample(spark, sf):
    return O.head_sample(_docs(spark, sf).select("doc_id", "text"), HEAD_N, ["doc_id"])


# ---------------------------------------------------------------- vectors
def _explode_vec(df, id_col, vec_col):
    return df.select(id_col, F.posexplode(vec_col).alias("i", "x")).select(id_col, "i", _r("x"))


def q_fold_query(spark, sf):
    p = T.all_vectors(spark, sf)
    return _explode_vec(p.select("pid", V.fold_query("vec").alias("v")), "pid", "v")


def q_fold_passage(spark, sf):
    g = T.gaussians(T.all_vectors(spark, sf))
    return _explode_vec(g.select("pid", V.fold_passage("mean", "var").alias("v")), "pid", "v")


def q_softplus(spark, sf):
    return _explode_vec(T.all_vectors(spark, sf).select("pid", V.softplus("vec").alias("v")), "pid", "v")


def token_sequences(spark, sf):
    """The vectors of one label, in id order, as one token sequence; every fifth id masked."""
    p = T.all_vectors(spark, sf)
    return p.select(F.col("label").alias("seq"), F.col("pid").alias("pos"), "vec",
                    (F.col("pid") % SEQ_MASK_MOD != 0).alias("mask"))


def q_first_token_pool(spark, sf):
    return _explode_vec(PL.first_token_pool(token_sequences(spark, sf)), "seq", "vec")


def q_attention_pool(spark, sf):
    return PL.attention_pool(token_sequences(spark, sf), projections=projections()).select("seq", "i", _r("x"))


def projections():
    """Three different matrices from the vectors' 64 components to 16, 16 and 8, with biases."""
    m = lambda out, seed: np.array(T.projection(out, VECTOR_DIM, seed))
    return PL.Projections(m(16, 1), m(16, 2), m(8, 5), np.arange(16) / 10, np.arange(8) / 10)


def q_passage_model(spark, sf):
    """Folded passage vectors from token rows: first token as mean, softplus of the attention pool as variance."""
    m = np.array(T.projection(VECTOR_DIM, VECTOR_DIM, 4))
    model = replace(projections(), value=m, value_bias=None)
    return _explode_vec(PL.folded_passages(token_sequences(spark, sf), model), "seq", "vec")


def q_embeddings_store(spark, sf):
    path = scratch_path(spark, "embeddings")
    IO.write_embeddings(T.all_vectors(spark, sf), path, "pid", "vec")
    return _explode_vec(IO.read_embeddings(spark, path).withColumnRenamed("id", "pid"), "pid", "vec")


def q_encode_hashed(spark, sf):
    return EN.hashed_bag(_docs(spark, sf), dim=HASH_DIM).select("doc_id", F.col("bucket").cast("int"), "n")


def make_length_model():
    """A deterministic stand-in for an encoder: text lengths and numbers of spaces of every field."""
    return lambda rows: [[float(f(x or "")) for x in row for f in (len, lambda t: t.count(" "))] for row in rows]


def q_encode_passages(spark, sf):
    """The encoder hook on (title, contents) pairs."""
    out = EN.encode(T.corpus(spark, sf), "pid", ["title", "contents"], make_length_model, model_key="lengths")
    return _explode_vec(out, "pid", "vec")


def q_encode_queries(spark, sf):
    """The encoder hook on single texts."""
    out = EN.encode(T.query_texts(spark, sf), "qid", ["query"], make_length_model, model_key="lengths")
    return _explode_vec(out, "qid", "vec")


def make_query_side_model():
    """Stand-in for the query encoder: length and number of spaces, twice, to match the pairs' four numbers."""
    return lambda rows: [2 * [float(len(x or "")), float((x or "").count(" "))] for (x,) in rows]


def q_retrieve_texts(spark, sf):
    """The whole retrieval job on texts: both sides encoded in shards, searched, and the run read from its file."""
    root = scratch_path(spark, "retrieve")
    J.retrieve_texts(spark, root, T.query_texts(spark, sf), T.corpus(spark, sf), make_query_side_model, make_length_model, TOPK,
                     "lengths-1", run_path=f"{root}/run.tsv", shards=4)
    return IO.read_run(spark, f"{root}/run.tsv", max_rank=TOPK, over="error")


def make_overlap_model():
    """A deterministic stand-in for a cross-encoder: difference of text lengths."""
    return lambda queries, passages: [float(len(p) - len(q)) for q, p in zip(queries, passages)]


def q_batch_scorer(spark, sf):
    """The batched model scorer on the mined pairs."""
    scorer = SC.batch_scorer(make_overlap_model, T.query_texts(spark, sf), T.corpus(spark, sf), model_key="length-gap")
    return SC.score_pairs(SC.unscored_pairs(mined(spark, sf), None), scorer)


def q_stage(spark, sf):
    """A stored stage read twice: the second call finds the first one's output."""
    root = scratch_path(spark, "stages")
    first = IO.Stage(spark, root, "qrels", {"mod": T.QRELS_MOD}).get(lambda: T.qrels(spark, sf))
    again = IO.Stage(spark, root, "qrels", {"mod": T.QRELS_MOD}).get(lambda: first.limit(0))
    return again.select("qid", "pid", "rel")


# ---------------------------------------------------------------- file formats
def q_read_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    IO.write_corpus(T.corpus(spark, sf), path)
    return IO.read_corpus(spark, path)


def query_file_rows(spark, sf):
    """Benchmark texts as a query file holds them: one line each, line breaks flattened."""
    q = T.query_texts(spark, sf)
    return q.select("qid", F.regexp_replace("query", "[\\t\\r\\n]", " ").alias("query"))


def q_read_queries(spark, sf):
    path = scratch_path(spark, "queries")
    IO.write_queries(query_file_rows(spark, sf), path)
    return IO.read_queries(spark, path)


def q_read_qrels(spark, sf):
    path = scratch_path(spark, "qrels")
    IO.write_qrels(T.qrels_eval(spark, sf), path)
    return IO.read_qrels(spark, path).drop("line")


def q_read_run(spark, sf):
    path = scratch_path(spark, "run")
    IO.write_run(run_k(spark, sf, EVAL_RUN_K), path)
    return IO.read_run(spark, path, max_rank=1000, over="error")


def q_write_run(spark, sf):
    path = scratch_path(spark, "run10")
    IO.write_run(run_k(spark, sf, TOPK), path, ordered=True)
    return IO.read_run(spark, path, max_rank=TOPK, over="skip")


def _groups_file(spark, sf):
    path = scratch_path(spark, "groups")
    IO.write_groups(mined(spark, sf), T.query_texts(spark, sf), path)
    return path


def q_read_groups(spark, sf):
    g = IO.read_groups(spark, _groups_file(spark, sf))
    return g.select("qid", "query", F.col("positives.doc_id").alias("pos_ids"), F.col("positives.score").alias("pos_scores"),
                    F.col("negatives.doc_id").alias("neg_ids"), F.col("negatives.score").alias("neg_scores"))


def q_write_groups(spark, sf):
    return IO.read_groups_long(spark, _groups_file(spark, sf))


# ---------------------------------------------------------------- the round
def round_inputs(spark, sf):
    qv = q_vectors(spark, sf)
    return dict(train_queries=qv, dev_queries=qv, passages=T.passage_vectors(spark, sf), qrels=qrels(spark, sf),
                dev_qrels=T.qrels_eval(spark, sf), query_texts=T.query_texts(spark, sf), corpus=T.corpus(spark, sf))


ROUND = J.RoundConfig(train_k=MINING_RUN_K, dev_k=EVAL_RUN_K, depth=DEPTH, cap=CAP, negatives=N_NEG, seed=SEED)


def _summary(s):
    return s.select("round", F.col("mined_queries").cast("long"), "total", "new", "skip", _r("skip_rate"),
                    _r("mrr_at_10"), _r("recall_at_1"), _r("recall_at_50"), _r("recall_at_all"), "queries_ranked",
                    F.col("merged_rows").cast("long"), F.col("training_rows").cast("long"))


def q_mining_rounds(spark, sf):
    """Two rounds of the loop over one score cache: the second finds every pair scored."""
    i = round_inputs(spark, sf)
    return _summary(J.mining_rounds(
        spark, scratch_path(spark, "rounds"), 2, vectors_for_round=lambda _: (i["train_queries"], i["dev_queries"], i["passages"]),
        train_queries_text=i["query_texts"], qrels=i["qrels"], dev_qrels=i["dev_qrels"], corpus=i["corpus"],
        scorer_for_round=lambda _: teacher(spark, sf), other=other_negatives(spark, sf), cfg=ROUND))


def q_mining_round(spark, sf):
    cfg = ROUND
    out = J.mining_round(spark, round_id=1, scorer=teacher(spark, sf), cache=score_cache(spark, sf),
                         other=other_negatives(spark, sf), cfg=cfg, **round_inputs(spark, sf))
    return _summary(out["summary"])


def flagship(spark, sf):
    return _fresh(q_mining_round)(spark, sf)


# ---------------------------------------------------------------- streaming
def q_score_stream(spark, sf):
    """The mined groups written as two group files, scored by the incremental stream from an empty cache."""
    from dpmine.streaming.scoring import read_scored, score_group_stream
    root = scratch_path(spark, "stream")
    g = mined(spark, sf)
    IO.write_groups(g.filter(F.col("qid") % 2 == 0), T.query_texts(spark, sf), f"{root}/groups/round=0")
    IO.write_groups(g.filter(F.col("qid") % 2 == 1), T.query_texts(spark, sf), f"{root}/groups/round=1")
    q = score_group_stream(spark, f"{root}/groups/*", f"{root}/cache", f"{root}/scored", teacher(spark, sf),
                           f"{root}/checkpoint", cap=CAP)
    q.awaitTermination()
    return read_scored(spark, f"{root}/scored").select("qid", "role", "pos", "pid", _r("score"))


QUERIES = {
    "score_matrix": q_score_matrix,
    "mips_topk": q_mips_topk,
    "gaussian_topk": q_gaussian_topk,
    "eval_mrr": q_eval_mrr,
    "eval_recall": q_eval_recall,
    "eval_all": q_eval_all,
    "metric_report": q_metric_report,
    "duplicate_check": q_duplicate_check,
    "ranked_array": q_ranked_array,
    "collect_positives": q_collect_positives,
    "mining_queries": q_mining_queries,
    "exclude_positives": q_exclude_positives,
    "hard_negatives": q_hard_negatives,
    "explode_groups": q_explode_groups,
    "mining_report": q_mining_report,
    "sample_positive": q_sample_positive,
    "sample_negatives": q_sample_negatives,
    "sample_negatives_padded": q_sample_negatives_padded,
    "train_groups": q_train_groups,
    "lookup_passages": q_lookup_passages,
    "preview": q_preview,
    "cap_candidates": q_cap_candidates,
    "unscored_pairs": q_unscored_pairs,
    "score_pairs": q_score_pairs,
    "score_upsert": q_score_upsert,
    "attach_scores": q_attach_scores,
    "score_groups": q_score_groups,
    "cache_stats": q_cache_stats,
    "merge_negatives": q_merge_negatives,
    "batches": q_batches,
    "own_group_scores": q_own_group_scores,
    "group_log_softmax": q_group_log_softmax,
    "distill_kl": q_distill_kl,
    "in_batch_accuracy": q_in_batch_accuracy,
    "tokenize": q_tokenize,
    "words_uncased": q_words_uncased,
    "token_count": q_token_count,
    "token_offsets": q_token_offsets,
    "untokenize": q_untokenize,
    "token_slice": q_token_slice,
    "ngrams": q_ngrams,
    "ngram_counts": q_ngram_counts,
    "entity_groups": q_entity_groups,
    "truncate_query": q_truncate_query,
    "truncate_pair": q_truncate_pair,
    "passage_text": q_passage_text,
    "with_ordinal": q_with_ordinal,
    "head_sample": q_head_sample,
    "fold_query": q_fold_query,
    "fold_passage": q_fold_passage,
    "softplus": q_softplus,
    "first_token_pool": q_first_token_pool,
    "attention_pool": q_attention_pool,
    "passage_model": q_passage_model,
    "embeddings_store": q_embeddings_store,
    "encode_hashed": q_encode_hashed,
    "read_corpus": q_read_corpus,
    "read_queries": q_read_queries,
    "read_qrels": q_read_qrels,
    "read_run": q_read_run,
    "write_run": q_write_run,
    "read_groups": q_read_groups,
    "write_groups": q_write_groups,
    "mining_round": q_mining_round,
    "mining_rounds": q_mining_rounds,
    "score_stream": q_score_stream,
    "training_table": q_training_table,
    "rejected_groups": q_rejected_groups,
    "annotations": q_annotations,
    "ngram_spans": q_ngram_spans,
    "encode_passages": q_encode_passages,
    "encode_queries": q_encode_queries,
    "batch_scorer": q_batch_scorer,
    "retrieve_texts": q_retrieve_texts,
    "evaluate_job": q_evaluate_job,
    "stage": q_stage,
}
QUERIES = {name: _fresh(fn) for name, fn in QUERIES.items()}
