"""Text → vector encoding.

``encode`` runs a user model over Arrow batches (``mapInPandas``): the model
is built once per Python worker and called per batch, never per row.
``hashed_bag`` is the JVM-side test encoder: md5 buckets of lower-cased
tokens counted per document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.functions.text import words

_MODELS: dict = {}


def worker_model(key: str, make_model: Callable[[], Callable]) -> Callable:
    """The Python worker's model ``key``, built by ``make_model`` on first use.

    A function of this module, so every task of a worker sees the same cache
    (a batch function only carries a reference to it).
    """
    if key not in _MODELS:
        _MODELS[key] = make_model()
    return _MODELS[key]


def batches_by_length(lengths: np.ndarray, batch_size: int) -> list[np.ndarray]:
    """Row numbers in batches of about equal text lengths (longest first, so that a batch too large shows at once)."""
    order = np.argsort(-lengths, kind="stable")
    return [order[at:at + batch_size] for at in range(0, len(order), batch_size)]


def encode(df: DataFrame, id_col: str, text_cols: list[str], make_model: Callable[[], Callable],
           batch_size: int = 2048, out: str = "vec", model_key: str = "encoder", profile=None) -> DataFrame:
    """``id, vec``: ``model(list_of_text_tuples) -> 2-D array`` over batches of ``batch_size`` rows.

    Passages are encoded from (title, contents) pairs, queries from the text
    alone — the caller picks ``text_cols``.  Select and filter before calling:
    the batch function is opaque to the optimiser.  ``model_key`` names the
    model: a worker builds it once and keeps it for all tasks (give each
    version of a model its own key).  The texts of an Arrow batch are dealt to
    model batches by length, so that a model that pads to the longest text of
    a batch pads little; rows come back in that order.  ``profile`` is the
    ``ResourceProfile`` of the stage (GPUs, memory), where the model needs one.
    """
    cols = [id_col] + list(text_cols)

    def run(it):
        model = worker_model(model_key, make_model)
        for pdf in it:
            lengths = sum(pdf[c].fillna("").str.len().to_numpy(np.int64) for c in text_cols)
            for rows in batches_by_length(lengths, batch_size):
                part = pdf.iloc[rows]
                texts = list(zip(*[part[c].tolist() for c in text_cols]))
                vecs = np.asarray(model(texts), dtype=np.float64)
                yield pd.DataFrame({id_col: part[id_col].values, out: list(vecs)})

    return df.select(*cols).mapInPandas(run, f"{id_col} long, {out} array<double>", profile=profile)


def bucket_of(token, dim: int):
    """md5 bucket of a token: first 32 bits of the digest mod ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashed_bag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """Sparse hashed bag of words ``id, bucket, n`` (lower-cased tokens)."""
    # explode_outer: a plain explode makes Catalyst add a size() filter that re-runs the tokeniser
    toks = docs.select(id_col, F.explode_outer(words(text_col, True)).alias("_t")).filter(
        F.col("_t").isNotNull())
    return toks.groupBy(id_col, bucket_of(F.col("_t"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def dense_vectors(sparse: DataFrame, id_col: str, dim: int, index: str = "bucket", value: str = "n") -> DataFrame:
    """Sparse ``id, index, value`` rows → ``id, vec`` of length ``dim`` (missing entries 0)."""
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(index, F.col(value).cast("double"))))
                                   .alias("_m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)).cast("array<long>"),
                                        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vec"))
