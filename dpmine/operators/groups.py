"""Training groups: mining, nesting, sampling, assembly.

Work form is *long*: one row per ``(qid, role, pos)`` with ``pid`` and
``score``; ``role`` is ``'pos'`` or ``'neg'``, ``pos`` the 0-based place in
the query's list.  Nested groups (the JSON-lines shape) are made only at
sinks by ``to_nested`` and read back by ``explode_groups``.  Every per-query
step is keyed by ``qid`` (one exchange, windows share it); lists per query
are bounded by the run depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS, NEG = "pos", "neg"
LONG_COLS = ["qid", "role", "pos", "pid", "score"]
MAX_LIST = 1_000_000        # entries of one list in the nested form


def _wq(*order: Column | str):
    w = Window.partitionBy("qid")
    return w.orderBy(*order) if order else w


# ---------------------------------------------------------------- nesting
def to_nested(long: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Long rows → ``qid[, query], positives{doc_id[], score[]}, negatives{…}`` in ``pos`` order.

    One row holds a query's whole lists, as the file format has it; a list
    longer than ``MAX_LIST`` is an error before any list is collected.
    """
    too_long = F.raise_error(F.concat(F.lit(f"more than {MAX_LIST} entries in a list of qid "), F.col("qid").cast("string")))
    long = long.withColumn("pos", F.when(F.col("pos") >= MAX_LIST, too_long.cast("int")).otherwise(F.col("pos")))

    def side(role):
        items = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "pid", "score"))))
        return items.alias(role)

    g = long.groupBy("qid").agg(side(POS), side(NEG))

    def pack(col):
        return F.struct(F.transform(col, lambda x: x["pid"]).alias("doc_id"),
                        F.transform(col, lambda x: x["score"]).alias("score"))

    out = g.select("qid", pack(F.col(POS)).alias("positives"), pack(F.col(NEG)).alias("negatives"))
    if queries is not None:
        out = out.join(queries.select("qid", "query"), "qid", "left").select(
            "qid", "query", "positives", "negatives")
    return out


def explode_groups(nested: DataFrame) -> DataFrame:
    """Nested groups → long rows ``qid, role, pos, pid, score`` (pairs zipped, order kept)."""
    def tagged(side, role):
        pairs = F.zip_with(F.col(f"{side}.doc_id"), F.col(f"{side}.score"),
                           lambda a, b: F.struct(a.cast("long").alias("pid"), b.cast("double").alias("score")))
        return F.transform(pairs, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("pos"),
                                                         x["pid"].alias("pid"), x["score"].alias("score")))

    items = F.concat(F.coalesce(tagged("positives", POS), F.array()),
                     F.coalesce(tagged("negatives", NEG), F.array()))
    return nested.select(F.col("qid").cast("long").alias("qid"), F.inline(items)).select(*LONG_COLS)


def collect_positives(qrels: DataFrame, order: str = "pid") -> DataFrame:
    """``qid, doc_ids``: every query's judged passages in order, duplicates kept.

    A list longer than ``MAX_LIST`` is an error before it is collected (the count shares the list's exchange).
    """
    too_long = F.raise_error(F.concat(F.lit(f"more than {MAX_LIST} entries in a list of qid "), F.col("qid").cast("string")))
    n = F.count(F.lit(1)).over(_wq())
    rows = qrels.withColumn("_n", n).withColumn("pid", F.when(F.col("_n") > MAX_LIST, too_long.cast("long")).otherwise(F.col("pid")))
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("pid"))))
    return rows.groupBy("qid").agg(F.transform(items, lambda x: x["pid"]).alias("doc_ids"))


def ranked_array(run: DataFrame, size: int, pad: int = 0, on_dup: str = "error") -> DataFrame:
    """``qid, pids``: slot ``rank-1`` holds the pid, empty slots hold ``pad``.

    Ranks outside ``1..size`` are skipped.  Two rows for one ``(qid, rank)``
    fail (``on_dup="error"``) or keep the larger pid (``on_dup="max_pid"``).
    """
    r = run.filter(F.col("rank").between(1, size)).select("qid", "rank", "pid")
    if on_dup == "max_pid":
        r = r.groupBy("qid", "rank").agg(F.max("pid").alias("pid"))
    m = r.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("rank", "pid"))).alias("m"))
    return m.select("qid", F.transform(F.sequence(F.lit(1), F.lit(size)),
                                       lambda i: F.coalesce(F.try_element_at("m", i), F.lit(pad).cast("long")))
                    .alias("pids"))


# ---------------------------------------------------------------- mining
def pad_run(run: DataFrame, size: int) -> DataFrame:
    """Reproduce the padded-array reading: every missing rank in ``1..size`` becomes pid 0."""
    qids = run.select("qid").distinct()
    slots = qids.select("qid", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("rank"))
    filled = slots.join(run.select("qid", "rank"), ["qid", "rank"], "left_anti").select(
        "qid", F.lit(0).cast("long").alias("pid"), "rank")
    return run.select("qid", "pid", "rank").unionByName(filled)


def mining_queries(qrels: DataFrame, run: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, query``: queries that have judgements, a run and a text."""
    return (queries.select("qid", "query")
            .join(qrels.select("qid"), "qid", "left_semi")
            .join(run.select("qid"), "qid", "left_semi"))


def exclude_positives(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows whose ``(qid, pid)`` is not judged."""
    return run.join(qrels.select("qid", "pid"), ["qid", "pid"], "left_anti")


def _mine(qrels, run, queries, depth, max_rank, zero_pad):
    r = run.filter(F.col("rank").between(1, max_rank)).select("qid", "pid", "rank")
    if zero_pad:
        r = pad_run(r, max_rank)
    mq = mining_queries(qrels, r, queries)
    negs = exclude_positives(r.join(mq.select("qid"), "qid", "left_semi"), qrels)
    negs = (negs.withColumn("pos", F.row_number().over(_wq("rank", "pid")) - 1)
            .withColumn("n_neg", F.count(F.lit(1)).over(_wq())))
    return mq, negs


def hard_negatives(qrels: DataFrame, run: DataFrame, queries: DataFrame, depth: int = 100,
                   max_rank: int = 200, zero_pad: bool = False, qrels_order: str = "pid") -> DataFrame:
    """Mined groups in long form ``qid, role, pos, pid, score``.

    Negatives are the run's passages (ranks ``1..max_rank``) that are not
    judged for the query, first ``depth`` by rank; queries with fewer
    survivors are dropped (see ``mining_report``).  Positives are all judged
    passages.  Scores are 1.0 for positives and 0.0 for negatives.

    Negatives are bounded per query by ``max_rank``: one window pass on the
    ``qid`` exchange numbers and counts them (the kept-query list reuses that
    exchange).  Positives are not bounded — one query may hold a large share of
    the judgements — so their positions come from ``ordinal_within``, which
    never gives a whole group to one task.
    """
    from dpmine.operators.ordinal import ordinal_within
    r = run.filter(F.col("rank").between(1, max_rank)).select("qid", "pid", "rank")
    if zero_pad:
        r = pad_run(r, max_rank)
    mq = mining_queries(qrels, r, queries).select("qid")
    negs = exclude_positives(r.join(mq, "qid", "left_semi"), qrels).select("qid", "pid", "rank")
    negs = (negs.withColumn("pos", (F.row_number().over(_wq("rank", "pid")) - 1).cast("int"))
            .withColumn("_n_neg", F.count(F.lit(1)).over(_wq())))
    neg_rows = negs.filter((F.col("_n_neg") >= depth) & (F.col("pos") < depth))
    kept = neg_rows.filter(F.col("pos") == 0).select("qid")
    pos = qrels.select("qid", "pid", F.col(qrels_order).alias("_o")).join(kept, "qid", "left_semi")
    pos_rows = ordinal_within(pos, "qid", ["_o", "pid"], "pos")
    return (pos_rows.select("qid", F.lit(POS).alias("role"), "pos", "pid", F.lit(1.0).alias("score"))
            .unionByName(neg_rows.select("qid", F.lit(NEG).alias("role"), "pos", "pid", F.lit(0.0).alias("score"))))


def mining_report(qrels: DataFrame, run: DataFrame, queries: DataFrame, depth: int = 100,
                  max_rank: int = 200, zero_pad: bool = False) -> DataFrame:
    """One row of load and mining counts (the reference's log lines as numbers)."""
    mq, negs = _mine(qrels, run, queries, depth, max_rank, zero_pad)
    per_q = negs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_neg"))
    mined = mq.select("qid").join(per_q, "qid", "left").fillna(0, ["n_neg"])
    stats = mined.agg(F.count(F.lit(1)).alias("n_candidates"),
                      F.count(F.when(F.col("n_neg") >= depth, True)).alias("n_mined"),
                      F.count(F.when(F.col("n_neg") < depth, True)).alias("n_short"))
    counts = [
        qrels.agg(F.countDistinct("qid").alias("n_qrels_queries")),
        run.agg(F.countDistinct("qid").alias("n_run_queries")),
        queries.agg(F.countDistinct("qid").alias("n_text_queries")),
        stats,
    ]
    from dpmine.operators.rows import side_by_side
    out = side_by_side(counts)
    return out.select(*[F.col(c).cast("long") for c in out.columns])


def short_queries(qrels: DataFrame, run: DataFrame, queries: DataFrame, depth: int = 100,
                  max_rank: int = 200, zero_pad: bool = False) -> DataFrame:
    """``qid, n_neg``: queries dropped for having fewer than ``depth`` negatives."""
    mq, negs = _mine(qrels, run, queries, depth, max_rank, zero_pad)
    per_q = negs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_neg"))
    return (mq.select("qid").join(per_q, "qid", "left").fillna(0, ["n_neg"])
            .filter(F.col("n_neg") < depth))


def cap_candidates(long: DataFrame, cap: int = 100) -> DataFrame:
    """First ``cap`` positives and first ``cap`` negatives of every group."""
    return long.filter(F.col("pos") < cap)


# ---------------------------------------------------------------- sampling
def sample_key(seed: int, epoch: int, *cols) -> Column:
    """md5 of ``seed:epoch:c1:c2:…`` — a uniform, repeatable order (same string in DuckDB)."""
    parts = [F.lit(str(seed)), F.lit(str(epoch))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                     for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def sample_positive(long: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """One uniformly drawn positive per query → ``qid, pid, score``.

    An aggregation (``min_by`` over the md5 key), so it combines map-side: a
    query with a huge positive list costs one row per task, not a sort.
    """
    p = long.filter(F.col("role") == POS).withColumn("copy", F.lit(0))
    key = sample_key(seed, epoch, "qid", "pid", "pos", "copy")
    best = p.groupBy("qid").agg(F.min_by(F.struct("pid", "score"), key).alias("_b"))
    return best.select("qid", F.col("_b.pid").alias("pid"), F.col("_b.score").alias("score"))


def replicate_pad(long: DataFrame, n: int) -> DataFrame:
    """Negatives of lists shorter than ``n`` repeated ``1 + n div len`` times (``copy`` column)."""
    negs = long.filter(F.col("role") == NEG).withColumn("len", F.count(F.lit(1)).over(_wq()))
    copies = F.when(F.col("len") < n, F.lit(1) + F.floor(F.lit(n) / F.col("len"))).otherwise(F.lit(1))
    return negs.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).drop("len")


def sample_negatives(long: DataFrame, n: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``n`` negatives per query without replacement (after ``replicate_pad``) → ``qid, slot, pid, score``.

    ``slot`` runs 1..n in draw order.
    """
    c = replicate_pad(long, n)
    w = _wq(sample_key(seed, epoch, "qid", "pid", "pos", "copy"))
    return (c.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= n)
            .select("qid", F.col("slot").cast("int"), "pid", "score"))


def assemble_groups(long: DataFrame, n: int, seed: int = 42, epoch: int = 0, strict: bool = False) -> DataFrame:
    """Training groups in long form ``qid, slot, pid, score``: slot 0 the positive, 1..n negatives.

    Only complete groups (a positive and ``n`` negatives) are returned; the
    rest are in ``rejected_groups``, or an error with ``strict``.
    """
    pos = sample_positive(long, seed, epoch).select("qid", F.struct(F.lit(0).alias("slot"), "pid", "score").alias("_p"))
    if n == 0:
        return pos.select("qid", "_p.*")
    neg = sample_negatives(long, n, seed, epoch).select("qid", F.struct("slot", "pid", "score").alias("_n"))
    # a list that is not empty always yields n negatives, so a query that both sides have is complete; the positive
    # comes along with the first negative (a union would lose the partitioning by query that both sides have)
    rows = neg.join(pos, "qid", "full" if strict else "inner")
    items = F.when(F.col("_n.slot") == 1, F.array("_p", "_n")).otherwise(F.array("_n"))
    if strict:
        items = F.when(F.col("_p").isNull() | F.col("_n").isNull(), F.raise_error(F.concat(
            F.lit("incomplete group: qid "), F.col("qid").cast("string"))).cast("array<struct<slot:int,pid:bigint,score:double>>")).otherwise(items)
    return rows.select("qid", F.inline(items))


def rejected_groups(long: DataFrame) -> DataFrame:
    """``qid, n_pos, n_neg`` for groups that cannot be sampled (an empty list)."""
    per_q = long.groupBy("qid").agg(F.count(F.when(F.col("role") == POS, True)).alias("n_pos"),
                                    F.count(F.when(F.col("role") == NEG, True)).alias("n_neg"))
    return per_q.filter((F.col("n_pos") == 0) | (F.col("n_neg") == 0))


def train_groups(long: DataFrame, queries: DataFrame | None, n: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Nested training groups ``qid[, query], doc_ids[n+1], scores[n+1]`` (positive first)."""
    g = assemble_groups(long, n, seed, epoch)
    items = F.sort_array(F.collect_list(F.struct("slot", "pid", "score")))
    out = g.groupBy("qid").agg(items.alias("items")).select(
        "qid", F.transform("items", lambda x: x["pid"]).alias("doc_ids"),
        F.transform("items", lambda x: x["score"]).alias("scores"))
    if queries is not None:
        out = out.join(queries.select("qid", "query"), "qid", "left").select("qid", "query", "doc_ids", "scores")
    return out


# ---------------------------------------------------------------- lookup
def lookup_passages(ids: DataFrame, corpus: DataFrame, strict: bool = True) -> DataFrame:
    """Attach ``title, contents`` to every row of ``ids`` (key ``pid``).

    A left join: AQE turns it into a broadcast join when the id side or the
    corpus is small at run time, a sort-merge join otherwise.  An id that the
    corpus lacks is an error, or with ``strict=False`` keeps null text
    (``missing_passages`` lists those).
    """
    found = ids.join(corpus.select("pid", "title", "contents", F.lit(True).alias("_known")), "pid", "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("passage not in the corpus: "), F.col("pid").cast("string")))
        found = found.withColumn("title", F.when(F.col("_known").isNull(), unknown.cast("string")).otherwise(F.col("title")))
    return found.drop("_known")


def missing_passages(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    return ids.select("pid").distinct().join(corpus.select("pid"), "pid", "left_anti")


def preview_groups(long: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """Long rows of ``n`` randomly ordered queries: the keys are picked first, only those groups are kept."""
    picked = preview(long.select("qid").distinct(), n, seed)
    return long.join(picked, "qid", "left_semi")


def preview(df: DataFrame, n: int = 3, seed: int = 42, key: str = "qid") -> DataFrame:
    """``n`` rows in a seeded pseudo-random order (a top-n, not a sort of everything)."""
    return df.orderBy(sample_key(seed, 0, key), F.col(key)).limit(n)
