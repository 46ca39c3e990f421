"""Token-sequence pooling (F5, F6) on long token rows ``seq, pos, vec[, mask]``.

A sequence may be long and sequences are many: both are reduced by
aggregations that combine before the exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.functions.vectors import fold_passage, softplus

MATRIX_BYTES = 512 << 20        # of the three projections together, which every worker holds


@dataclass
class Projections:
    """Weights ``(out, in)`` and biases ``(out)`` of the query, key and value projections; None leaves the vector as it is."""

    query: np.ndarray | None = None
    key: np.ndarray | None = None
    value: np.ndarray | None = None
    query_bias: np.ndarray | None = None
    value_bias: np.ndarray | None = None    # a key bias adds the same to all logits of a sequence: softmax drops it

    def __post_init__(self) -> None:
        size = sum(m.nbytes for m in (self.query, self.key, self.value) if m is not None)
        if size > MATRIX_BYTES:
            raise ValueError(f"projections of {size} bytes are too large to send to every worker (limit {MATRIX_BYTES})")

    def asked(self, first: np.ndarray) -> np.ndarray:
        """What a sequence's token vectors are multiplied with: ``Kt (Q first + bias)``, a row for each sequence."""
        q = first if self.query is None else first @ self.query.T
        q = q if self.query_bias is None else q + self.query_bias
        return q if self.key is None else q @ self.key

    def valued(self, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sums of projected values from weighted sums of token vectors."""
        v = sums if self.value is None else sums @ self.value.T
        return v if self.value_bias is None else v + weights[:, None] * self.value_bias


def _matrix(rb: pa.RecordBatch, column: str) -> np.ndarray:
    return rb.column(column).flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)


def first_token_pool(tokens: DataFrame, seq: str = "seq", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """``seq, vec``: the vector at the first position of each sequence."""
    return tokens.groupBy(seq).agg(F.min_by(vec, pos).alias(vec))


def attention_pool(tokens: DataFrame, seq: str = "seq", pos: str = "pos", vec: str = "vec", mask: str = "mask",
                   key: str | None = None, value: str | None = None, projections: Projections | None = None) -> DataFrame:
    """``seq, i, x``: softmax-weighted sum of value vectors over the unmasked tokens.

    The query is the first token's vector (masked or not); weights are
    ``softmax(Q(first) · K(tokenᵢ) / √h)`` over tokens with ``mask`` true, h the
    length of the token vector; the output dimension ``i`` is ``Σ wᵢ V(tokenᵢ)[i]``.
    ``projections`` holds the matrices; without it, ``key``/``value`` name columns
    that are projected already, else the token vector serves as both.

    No token is multiplied by a matrix: ``Q(first) · K x = (Kᵀ Q(first)) · x`` needs
    one product a sequence, and ``Σ w V x = V Σ w x`` one for each partial sum.
    One join with the query vectors and one pass: every Arrow batch folds its
    tokens into a row per sequence (largest logit, sum of weights, weighted sum
    of values), and these partial rows are merged per sequence by rescaling to
    the largest logit.  A long sequence is never sorted or held by one task.
    """
    key, value = key or vec, value or vec
    held = tokens.sparkSession.sparkContext.broadcast(projections or Projections())
    q = first_token_pool(tokens, seq, pos, vec).select(F.col(seq).cast("long").alias("_seq"), F.col(vec).cast("array<double>").alias("_q"))

    def ask(batches):
        for rb in batches:
            if rb.num_rows:
                first = _matrix(rb, "_q")
                asked = held.value.asked(first) / np.sqrt(first.shape[1])
                yield pa.RecordBatch.from_arrays([rb.column("_seq"), pa.array(list(asked), pa.list_(pa.float64()))], names=["_seq", "_q"])
    q = q.mapInArrow(ask, "_seq long, _q array<double>")
    t = tokens.filter(F.col(mask)).select(F.col(seq).cast("long").alias("_seq"), F.col(key).cast("array<double>").alias("_k"),
                                          F.col(value).cast("array<double>").alias("_v"))
    t = t.join(q, "_seq")

    def fold(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            Q, K, V = (_matrix(rb, c) for c in ("_q", "_k", "_v"))
            logit = np.einsum("ij,ij->i", Q, K)
            names, at = np.unique(rb.column("_seq").to_numpy(zero_copy_only=False), return_inverse=True)
            top = np.full(len(names), -np.inf)
            np.maximum.at(top, at, logit)
            weight = np.exp(logit - top[at])
            total, sums = np.bincount(at, weight, len(names)), np.zeros((len(names), V.shape[1]))
            np.add.at(sums, at, weight[:, None] * V)
            sums = held.value.valued(sums, total)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(top), pa.array(total), pa.array(list(sums), pa.list_(pa.float64()))],
                                             names=["_seq", "m", "z", "s"])
    part = t.mapInArrow(fold, "_seq long, m double, z double, s array<double>")
    top = part.groupBy("_seq").agg(F.max("m").alias("top"))              # partial rows: one a sequence and batch
    part = part.join(top, "_seq").withColumn("w", F.exp(F.col("m") - F.col("top")))
    rows = part.select("_seq", "z", "w", F.posexplode("s").alias("i", "x"))
    out = rows.groupBy("_seq", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum(F.col("w") * F.col("z"))).alias("x"))
    return out.select(F.col("_seq").cast(tokens.schema[seq].dataType).alias(seq), "i", "x")


def passage_gaussians(tokens: DataFrame, projections: Projections | None = None, seq: str = "seq", pos: str = "pos",
                      vec: str = "vec", mask: str = "mask", beta: float = 1.0) -> DataFrame:
    """``seq, mean, var``: the passage side of the model on token rows.

    The mean is the first token's vector, the variance the softplus of the attention pool.
    """
    pooled = attention_pool(tokens, seq, pos, vec, mask, projections=projections)
    pooled = pooled.groupBy(seq).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_x"))     # a vector's components
    var = pooled.select(seq, softplus(F.transform("_x", lambda e: e["x"]), beta).alias("var"))
    mean = first_token_pool(tokens, seq, pos, vec).select(seq, F.col(vec).cast("array<double>").alias("mean"))
    return mean.join(var, seq)


def folded_passages(tokens: DataFrame, projections: Projections | None = None, seq: str = "seq", **kw) -> DataFrame:
    """``seq, vec``: token rows to the folded vector whose dot product with a folded query is the log-density."""
    return passage_gaussians(tokens, projections, seq, **kw).select(seq, fold_passage("mean", "var").alias("vec"))
