"""Teacher scoring with a keyed score cache.

Long form throughout (``qid, role, pos, pid, score``).  The expensive step —
the scorer — sees only pairs that are neither repeated nor already in the
cache: ``dropDuplicates`` + ``left_anti`` run *before* it.  The cache is a
table bucketed by ``(qid, pid)`` with a commit log (``sources.score_table``); an
upsert commits only the new keys as one more batch, so the cache is never
rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.functions.text import jaccard, passage_text, words
from dpmine.functions.vectors import squared_distance
from dpmine.operators.encode import batches_by_length, worker_model
from dpmine.operators.groups import NEG, POS, cap_candidates
from dpmine.session import materialize
from dpmine.sources.score_table import ScoreCache

Scorer = Callable[[DataFrame], DataFrame]   # pairs (qid, pid, …) -> pairs + score


# ---------------------------------------------------------------- scorers
def _absent(what: str):
    """An error that names the pair for which ``what`` is missing (a double, to stand for a score)."""
    return F.raise_error(F.concat(F.lit(what + " missing: qid "), F.col("qid").cast("string"), F.lit(", pid "),
                                  F.col("pid").cast("string"))).cast("double")


def vector_teacher(qvecs: DataFrame, pvecs: DataFrame) -> Scorer:
    """Scorer ``-Σ (q - p)²`` from vector tables ``qid, vec`` / ``pid, vec`` (JVM-side); a missing vector is an error."""
    def score(pairs: DataFrame) -> DataFrame:
        q = qvecs.select("qid", F.col("vec").alias("qv"))
        p = pvecs.select("pid", F.col("vec").alias("pv"))
        both = pairs.join(q, "qid", "left").join(p, "pid", "left")
        score = F.when(F.col("qv").isNull() | F.col("pv").isNull(), _absent("vector")).otherwise(
            -squared_distance("qv", "pv"))
        return both.withColumn("score", score).drop("qv", "pv")
    return score


def text_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach ``query`` and the cross-encoder passage text ``passage``; an unknown query or passage is an error."""
    c = corpus.select("pid", passage_text("title", "contents").alias("passage"))
    q = queries.select("qid", F.coalesce("query", F.lit("")).alias("query"))
    both = pairs.join(q, "qid", "left").join(c, "pid", "left")
    return both.withColumns({
        "query": F.when(F.col("query").isNull(), _absent("query text").cast("string")).otherwise(F.col("query")),
        "passage": F.when(F.col("passage").isNull(), _absent("passage text").cast("string")).otherwise(F.col("passage"))})


def overlap_scorer(queries: DataFrame, corpus: DataFrame) -> Scorer:
    """Test scorer: Jaccard overlap of lower-cased query and passage tokens (JVM-side)."""
    def score(pairs: DataFrame) -> DataFrame:
        t = text_pairs(pairs, queries, corpus)
        return t.withColumn("score", jaccard(words("query", True), words("passage", True))).drop("query", "passage")
    return score


def batch_scorer(make_model: Callable[[], Callable[[list, list], list]], queries: DataFrame, corpus: DataFrame,
                 batch_size: int = 512, model_key: str = "scorer", profile=None) -> Scorer:
    """Wrap a model ``make_model()(queries, passages) -> scores`` as an Arrow-batched scorer.

    Runs in ``mapInPandas``: a Python worker builds the model once (by
    ``model_key``) and calls it once per batch of ``batch_size`` pairs of about
    equal length, never per row.  ``profile``: the stage's ``ResourceProfile``.
    """
    def score(pairs: DataFrame) -> DataFrame:
        t = text_pairs(pairs.select("qid", "pid"), queries, corpus)

        def run(it):
            model = worker_model(model_key, make_model)
            for pdf in it:
                lengths = (pdf["query"].str.len() + pdf["passage"].str.len()).to_numpy(int)
                for rows in batches_by_length(lengths, batch_size):
                    part = pdf.iloc[rows]
                    s = model(part["query"].tolist(), part["passage"].tolist())
                    yield pd.DataFrame({"qid": part["qid"].values, "pid": part["pid"].values,
                                        "score": pd.Series(s, dtype="float64").values})

        return t.mapInPandas(run, "qid long, pid long, score double", profile=profile)
    return score


# ---------------------------------------------------------------- cache
def unscored_pairs(long: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct ``(qid, pid)`` of the groups that the cache does not hold."""
    pairs = long.select("qid", "pid").dropDuplicates(["qid", "pid"])
    if cache is None:
        return pairs
    return pairs.join(cache.select("qid", "pid"), ["qid", "pid"], "left_anti")


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """``qid, pid, score`` for every pair (one scorer call per Arrow batch or a JVM expression)."""
    return scorer(pairs.select("qid", "pid")).select("qid", "pid", F.col("score").cast("double"))


def score_upsert(cache: DataFrame | None, new: DataFrame) -> DataFrame:
    """Insert-if-absent: the cache's score wins, then the first new score per key."""
    fresh = new.select("qid", "pid", "score").dropDuplicates(["qid", "pid"])
    if cache is None:
        return fresh
    fresh = fresh.join(cache.select("qid", "pid"), ["qid", "pid"], "left_anti")
    return cache.select("qid", "pid", "score").unionByName(fresh)


def attach_scores(long: DataFrame, scores: DataFrame, strict: bool = True) -> DataFrame:
    """Replace each group row's score by the table's score for ``(qid, pid)``.

    A row without a score is an error, or with ``strict=False`` keeps a null
    score (``missing_scores`` lists those).
    """
    out = long.drop("score").join(scores.select("qid", "pid", "score"), ["qid", "pid"], "left")
    if strict:
        out = out.withColumn("score", F.when(F.col("score").isNull(), _absent("score")).otherwise(F.col("score")))
    return out.select("qid", "role", "pos", "pid", "score")


def missing_scores(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score").isNull())


def cache_stats(capped: DataFrame, new_scores: DataFrame) -> DataFrame:
    """One row ``total, new, skip, skip_rate``: references, newly scored keys, the rest."""
    tagged = capped.select(F.lit(1).alias("_t"), F.lit(0).alias("_n")).unionByName(
        new_scores.select(F.lit(0).alias("_t"), F.lit(1).alias("_n")))
    out = tagged.agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("total"), F.coalesce(F.sum("_n"), F.lit(0)).alias("new"))
    return out.select(F.col("total").cast("long"), F.col("new").cast("long"),
                      (F.col("total") - F.col("new")).cast("long").alias("skip"),
                      F.try_divide((F.col("total") - F.col("new")).cast("double"),
                                   F.col("total").cast("double")).alias("skip_rate"))


def needed_scores(cache: DataFrame, pairs: DataFrame) -> DataFrame:
    """The cache rows a set of pairs needs: ``cache ⋉ pairs``.

    The pairs of one round are the small side: they are broadcast where they are
    small enough, else they alone are exchanged into the cache's buckets.
    """
    return cache.select("qid", "pid", "score").join(pairs.select("qid", "pid"), ["qid", "pid"], "left_semi")


def score_groups(long: DataFrame, cache: DataFrame | None, scorer: Scorer, cap: int = 100):
    """Score capped groups through the cache.

    Returns ``(scored_long, new_scores, stats)``: the groups with teacher
    scores, the pairs that had to be scored (to append to the cache), and the
    cache statistics row.  The cache is cut down to this round's pairs first
    (``needed_scores``), so the later anti join and attach never touch the rest.
    The new scores are stored before anything reads them: a pair is scored once.
    """
    capped = cap_candidates(long, cap)
    pairs = unscored_pairs(capped, None)
    known = needed_scores(cache, pairs) if cache is not None else None
    new = materialize(score_pairs(unscored_pairs(pairs, known), scorer), "new-scores")
    table = new if known is None else known.unionByName(new)
    return attach_scores(capped, table), new, cache_stats(capped, new)


def merge_negatives(own: DataFrame, other: DataFrame, dedup: bool = False) -> DataFrame:
    """Append the other set's negatives after each group's own (long form).

    Groups are ``own``'s; their positives stay; a query missing from
    ``other`` keeps its list.  ``other`` is long form too; if it carries a
    ``line`` column, only the last line per query is used.
    """
    o = other.filter(F.col("role") == NEG)
    if "line" in o.columns:
        last = o.groupBy("qid").agg(F.max("line").alias("line"))
        o = o.join(last, ["qid", "line"], "left_semi")
    o = o.join(own.select("qid").distinct(), "qid", "left_semi")
    own_n = own.filter(F.col("role") == NEG).groupBy("qid").agg(F.count(F.lit(1)).alias("n_own"))
    shifted = (o.join(own_n, "qid", "left").fillna(0, ["n_own"])
               .select("qid", F.lit(NEG).alias("role"), (F.col("pos") + F.col("n_own")).cast("int").alias("pos"),
                       "pid", "score"))
    merged = own.select("qid", "role", "pos", "pid", "score").unionByName(shifted)
    if dedup:
        from pyspark.sql import Window
        w = Window.partitionBy("qid", "role", "pid").orderBy("pos")
        merged = merged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
        w2 = Window.partitionBy("qid", "role").orderBy("pos")
        merged = merged.withColumn("pos", (F.row_number().over(w2) - 1).cast("int"))
    return merged


__all__ = ["vector_teacher", "overlap_scorer", "batch_scorer", "text_pairs", "unscored_pairs", "score_pairs",
           "score_upsert", "needed_scores", "ScoreCache", "attach_scores", "missing_scores", "cache_stats", "score_groups",
           "merge_negatives", "POS", "NEG"]
