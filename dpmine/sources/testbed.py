"""Bindings of the library's inputs to the driver's generated tables.

The driver ships no retrieval data, so the operators are bound to its
``embeddings``, ``documents``, ``benchmark`` and ``events`` tables by fixed
rules.  Everything here is a lazy DataFrame over those parquet files; its size
grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.functions.vectors import as_double_vector, softplus

# fixed binding values
QUERY_MOD = 10                # embeddings with vec_id mod 10 = 0 are queries; mining takes the others with a document as passages
SPAN = 500                    # judgements stay inside spans of 500 ids, so their number grows with the table
QRELS_MOD = 7                 # qrels: equal label and equal vec_id mod 7
EVAL_MUL, EVAL_MOD = 31, 41   # evaluation qrels: (31 · qid + pid) mod 41 = 0; qid a query or vec_id mod 100 = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, vec, label``: the query side of the vector table."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter(F.col("vec_id") % QUERY_MOD == 0).select(
        F.col("vec_id").alias("qid"), as_double_vector("embedding").alias("vec"), "label")


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, vec, label``: the whole vector table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"), as_double_vector("embedding").alias("vec"), "label")


def searched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, vec, label``: every vector that is not a query, with a text or without."""
    return all_vectors(spark, sf_dir).filter(F.col("pid") % QUERY_MOD != 0)


def gaussians(vectors: DataFrame) -> DataFrame:
    """``pid, mean, var``: mean = the vector, var = softplus of it."""
    return vectors.select("pid", F.col("vec").alias("mean"), softplus("vec").alias("var"))


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, vec, label``: the passages of mining and scoring, which need a text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    e = table(spark, sf_dir, "embeddings").join(d, "vec_id", "left_semi")
    return e.filter(F.col("vec_id") % QUERY_MOD != 0).select(
        F.col("vec_id").alias("pid"), as_double_vector("embedding").alias("vec"), "label")


def passage_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaussians(passage_vectors(spark, sf_dir))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training judgements ``qid, pid, rel``: same span, same label and same id mod 7 (an equi-join)."""
    key = lambda c: [(F.col(c) % QRELS_MOD).alias("m"), F.floor(F.col(c) / SPAN).alias("g")]
    q = query_vectors(spark, sf_dir).select("qid", "label", *key("qid"))
    p = passage_vectors(spark, sf_dir).select("pid", "label", *key("pid"))
    return q.join(p, ["label", "m", "g"]).select("qid", "pid", F.lit(1).alias("rel"))


def qrels_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation judgements: same span and (31·qid + pid) mod 41 = 0, for queries and ids that are 5 mod 100.

    Written as an equi-join on ``pid mod 41 = (-31·qid) mod 41``.  The judged
    ids that are 5 mod 100 are passages, so they are never ranked.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    judged = (F.col("vec_id") % QUERY_MOD == 0) | (F.col("vec_id") % 100 == 5)
    span = F.floor(F.col("vec_id") / SPAN).alias("g")
    q = e.filter(judged).select(
        F.col("vec_id").alias("qid"), F.pmod(-F.col("vec_id") * EVAL_MUL, F.lit(EVAL_MOD)).alias("m"), span)
    p = e.filter(~judged).select(
        F.col("vec_id").alias("pid"), F.pmod(F.col("vec_id"), F.lit(EVAL_MOD)).alias("m"), span)
    return q.join(p, ["m", "g"]).select("qid", "pid", F.lit(1).alias("rel"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, title, contents`` from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), F.col("text").alias("contents"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query`` from ``benchmark``: item i is the text of the query vector 10 · i."""
    b = table(spark, sf_dir, "benchmark")
    return b.select((F.col("item_id") * QUERY_MOD).alias("qid"), F.col("text").alias("query"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def projection(out: int, wide: int, seed: int) -> list[list[float]]:
    """A fixed matrix for the model's projections: ``((7 i + 3 j + seed (i + 1) (j + 1)) mod 23 - 11) / 40``."""
    return [[((7 * i + 3 * j + seed * (i + 1) * (j + 1)) % 23 - 11) / 40 for j in range(wide)] for i in range(out)]
