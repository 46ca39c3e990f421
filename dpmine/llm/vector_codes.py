"""Product codes of vectors: codebooks by rounds of exact assignment over a lexicographic trie of distinct parts.

Vectors become integers and are cut into equal consecutive parts.  The different parts of each position, with their
counts, are range-partitioned and sorted, so that a task holds a contiguous piece of the trie of all parts.  A task
walks its piece depth first: a node keeps the distances of its prefix to every entry, its children add one dimension to
that vector, and a leaf takes the nearest entry and adds its part to that entry's sum, weighted by its count.  Only sums
per entry leave a task; the new entries are floors of exact integer quotients.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces
from dpmine.session import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 26           # of an integer component: squared distances of up to 512 dimensions stay below 2^63
TRIE_ROWS = 8192            # distinct parts that are walked together; bounds the distance vectors of one level


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def is_whole(vector: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False))


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index) and squared distance of lexicographically sorted, different ``parts``.

    Depth first over the trie of the rows.  A node is a range of rows with a common prefix and the distances of that
    prefix to all entries; one row's remaining dimensions have no branch and are added at once.
    """
    n, d = parts.shape
    nearest, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n else []
    while stack:
        lo, hi, depth, so_far = stack.pop()
        while depth < d and parts[lo, depth] == parts[hi - 1, depth]:      # a single child
            if hi - lo == 1:
                tail = parts[lo, depth:] - entries[:, depth:]
                so_far, depth = so_far + (tail * tail).sum(axis=1), d
            else:
                step = parts[lo, depth] - entries[:, depth]
                so_far, depth = so_far + step * step, depth + 1
        if depth == d:
            nearest[lo] = best = int(so_far.argmin())
            distance[lo] = so_far[best]
            continue
        column = parts[lo:hi, depth]
        starts = np.flatnonzero(np.diff(column, prepend=column[0] - 1))
        stops = np.append(starts[1:], hi - lo)
        step = column[starts][:, None] - entries[:, depth]
        below = so_far + step * step                                       # a row for each child
        alone = stops - starts == 1
        rows = starts[alone] + lo
        total = below[alone]
        for k in range(depth + 1, d):                                      # leaves: their tails, one dimension at a time
            step = parts[rows, k][:, None] - entries[:, k]
            total += step * step
        best = total.argmin(axis=1)
        nearest[rows], distance[rows] = best, total[np.arange(len(rows)), best]
        for child in np.flatnonzero(~alone)[::-1]:
            stack.append((lo + int(starts[child]), lo + int(stops[child]), depth + 1, below[child]))
    return nearest, distance


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of any ``parts``: each different part is looked up once."""
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, back = np.unique(parts, axis=0, return_inverse=True)
    found = [walk(distinct[at:at + TRIE_ROWS], entries) for at in range(0, len(distinct), TRIE_ROWS)]
    nearest, distance = (np.concatenate(x) for x in zip(*found))
    return nearest[back.ravel()], distance[back.ravel()]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _sums(distinct: DataFrame, books: list[np.ndarray], d: int) -> np.ndarray:
    """One round: the count and the component sums of every part position and entry (``parts x entries x (1 + d)``)."""
    parts, k = len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, d + 1), np.int64)
        for batch in pieces(batches, TRIE_ROWS * 8 * d):
            part = batch.column("part").to_numpy()
            values, counts = _matrix(batch.column("values"), d), batch.column("count").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                for at in range(lo, hi, TRIE_ROWS):
                    rows = slice(at, min(at + TRIE_ROWS, hi))
                    p, weight = int(part[at]), counts[rows]
                    nearest, _ = walk(values[rows], books[p])
                    np.add.at(total[p], nearest, np.column_stack([weight, values[rows] * weight[:, None]]))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "value": pa.array(total.ravel()[cell])})

    cells = distinct.mapInArrow(run, "cell int, value long").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(parts * k * (d + 1), np.int64)
    total[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    return total.reshape(parts, k, d + 1)


def sorted_parts(rows: DataFrame, parts: int, d: int) -> DataFrame:
    """The different parts of every position with their counts, stored in lexicographic order: ``part, values, count``."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(
        p.alias("part"), F.slice("vec", p * d + 1, d).alias("values")))
    each = rows.select(F.inline(cut)).groupBy("part", "values").agg(F.count(F.lit(1)).alias("count"))
    # an explicit number of partitions: the walk costs far more than its bytes suggest
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(each.repartitionByRange(n, "part", "values").sortWithinPartitions("part", "values"), "parts")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of ``id, vec`` rows (integer vectors of one length): an integer matrix for each part position.

    Starts from the parts of the ``entries`` smallest ids (fewer rows give fewer entries; null ids come last, equal ids
    by vector).  Each round assigns all parts and replaces an entry by the floor of its parts' mean; unused ones stay.
    Driver and tasks hold the codebooks only: ``entries`` vectors.
    """
    first = [r["vec"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()]
    if not first:
        return []
    books = np.array(first, np.int64)
    if books.shape[1] % parts:
        raise ValueError(f"vectors of {books.shape[1]} components cannot be cut into {parts} equal parts")
    d = books.shape[1] // parts
    books = [np.ascontiguousarray(books[:, p * d:(p + 1) * d]) for p in range(parts)]
    distinct = sorted_parts(rows, parts, d)
    for _ in range(rounds):
        for book, total in zip(books, _sums(distinct, books, d)):
            used = total[:, 0] > 0
            book[used] = total[used, 1:] // total[used, :1]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` (with ``vec``) and their ``code`` (hex, two digits a part) and ``error``; no exchange."""
    parts, d = len(books), books[0].shape[1]
    kept = [c for c in rows.columns if c != "vec"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            vectors = _matrix(batch.column("vec"), parts * d)
            found = [assign(vectors[:, p * d:(p + 1) * d], books[p]) for p in range(parts)]
            codes = np.stack([nearest for nearest, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array([x.tobytes().hex() for x in codes], pa.string()),
                                                   pa.array(sum(distance for _, distance in found), pa.int64())],
                names=kept + ["code", "error"])
    return rows.mapInArrow(run, f"{schema}, code string, error long")


def integer_rows(vectors: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, label, vec`` of the rows whose vector is whole, stored; components out of range are an error."""
    v = integers(F.col(vector), scale)
    vec = F.when(F.exists(v, lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(
        f"a component is beyond {LARGEST} after scaling"))).otherwise(v)
    return materialize(vectors.filter(is_whole(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), vec.alias("vec")), "vectors")


def vector_codes(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE,
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` of every whole vector.

    ``label_error`` is the error summed over equal labels (nulls are one label).  Vectors that are null, empty or hold a
    null, NaN or infinite component are dropped; rows with a null id and repeated rows take part, each for itself.
    Vectors of different lengths, a length that ``parts`` does not divide and components beyond ``LARGEST`` after
    scaling are errors.  An empty table gives no row.  Other columns of the table play no part.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = integer_rows(vectors, key, label, vector, scale)
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError("vectors with different numbers of components")
    books = train(rows, parts, entries, rounds)
    if not books:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(encode(rows, books), "codes")
    # stored before the join, so that a label with many rows is a skewed side that Spark can split
    total = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    total = total.withColumnRenamed("label", "_label")
    return (coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
            .select("id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")))
