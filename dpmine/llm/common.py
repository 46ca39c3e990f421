"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.operators.rows import pieces
from dpmine.session import release_memory

#: A word is a maximal run of characters that are not ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def forget_garbage() -> None:
    """Free what earlier tasks of this worker left in cycles, and hand freed memory back to the system."""
    gc.collect()
    release_memory()


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_key(key: str, text: str) -> list[Column]:
    """Two non-null key columns for a row: its id (null has a value of its own) and a hash of its text."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_row_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row_hash")]


def keep_rows(docs: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose :func:`row_key` is in ``kept`` (``_row_id, _row_hash``, unique).

    One hash join on a high-cardinality key; null ids take part.  All columns of ``docs`` come back unchanged.
    """
    a, b = row_key(key, text)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), a, b)
    return (marked.join(kept.select("_row_id", "_row_hash"), ["_row_id", "_row_hash"], "left_semi")
            .select("_row.*"))


#: Bytes of a word that :func:`distinct_words` can tell from others.
LONGEST_WORD = 4096
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)     # the first n of 8 bytes
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def cut_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last position of every word in UTF-8 bytes."""
    edge = np.flatnonzero(np.diff(_IN_WORD[codes], prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, which is read eight bytes at a time."""
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    sizes = stops - starts
    hashed, check = (sizes.astype(np.uint64) * m for m in _MULTIPLIERS)
    at = np.arange(len(starts))
    for k in range(0, int(sizes.max(initial=0)), 8):
        if k:
            at = at[sizes[at] > k]
        chunk = eights[starts[at] + k] & _KEEP[np.minimum(sizes[at] - k, 8)]
        for h, m in ((hashed, _MULTIPLIERS[0]), (check, _MULTIPLIERS[1])):
            x = (h[at] ^ chunk) * m
            h[at] = x ^ (x >> np.uint64(31))
            chunk = chunk + m
    return hashed, check


def distinct_words(data: bytes, starts: np.ndarray, stops: np.ndarray):
    """The different words: (first occurrence, hash, second hash) by rising hash, and the group of every word.

    None where two words have the same first hash (the caller then goes without this shortcut).
    """
    hashed, check = word_hashes(data, starts, stops)
    order = np.argsort(hashed)
    ranked = hashed[order]
    fresh = np.diff(ranked, prepend=~ranked[:1]) != 0
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    if (check != check[first][group]).any():
        return None
    return first, ranked[fresh], check[first], group
