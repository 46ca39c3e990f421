"""Exact top-k inner products by norm buckets with local cosine thresholds.

Vectors are made integers and dealt by length into buckets (split by hash where many vectors have one length), queries
by hash into blocks; a cell is a block against a bucket.  A first pass takes each query's k-th best product in its
share of a fixed number of the longest vectors as a lower bound.  In every cell the bound becomes a cosine threshold
for the bucket: above 1 the bucket is skipped for the query; a high one is served by the ranges that single
coordinates of a match must lie in; a low one by length alone.  What is left is verified by exact integer products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dpmine.session import materialize

BUCKET = 2048          # vectors of a bucket
BLOCK = 2048           # queries of a block
SEEDS = 4096           # of the longest vectors that give the first bounds
COORDINATES = 4        # a query's largest coordinates whose ranges are looked up
COSINE = 0.6           # local threshold from which coordinates prune better than lengths
SCALE = 256


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def is_whole(vector: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False))


class Bucket:
    """Vectors by falling length, with their unit vectors sorted by each coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        square = (vectors * vectors).sum(axis=1)
        order = np.lexsort((ids, -square))
        self.ids, self.vectors = ids[order], vectors[order]
        most = float(np.abs(vectors).max(initial=0))
        if most * most * vectors.shape[1] < 2 ** 53:      # products are whole numbers that doubles hold exactly
            self.vectors = self.vectors.astype(np.float64)
        self.lengths = np.sqrt(square[order].astype(np.float64))
        self.unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.order: dict[int, tuple] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.order:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.order[f] = (self.unit[order, f], order)
        return self.order[f]

    def candidates(self, query: np.ndarray, length: float, bound: float) -> np.ndarray:
        """Rows whose product with ``query`` can be ``bound`` or more (ascending, that is by falling length)."""
        if bound <= 0 or not length:
            return np.arange(len(self.ids))
        # LENGTH: |q| |p| >= bound
        most = int(np.searchsorted(-self.lengths, -(bound / length) * (1 - 1e-9), "right"))
        cosine = bound / (length * self.lengths[0]) * (1 - 1e-9) if self.lengths[0] else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine < COSINE:
            return np.arange(most)
        # COORD: a unit vector at cosine c or more to q lies within q_f c -+ sqrt((1 - c^2) (1 - q_f^2)) on axis f,
        # or, on the side of q_f, closer to it than the nearest bound; the widest interval over [c, 1] is taken
        unit = query / length
        slack = math.sqrt(max(0.0, 1 - cosine * cosine))
        rows = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:COORDINATES].tolist():
            x = float(unit[f])
            side = slack * math.sqrt(max(0.0, 1 - x * x))
            low = -1.0 if x < -cosine else x * cosine - side
            high = 1.0 if x > cosine else x * cosine + side
            values, order = self.by_coordinate(f)
            a, b = np.searchsorted(values, low - 1e-9), np.searchsorted(values, high + 1e-9, "right")
            own = order[a:b]
            rows = own if rows is None else rows[(self.unit[rows, f] >= low - 1e-9) & (self.unit[rows, f] <= high + 1e-9)]
            if len(rows) < 64:
                break
        return np.sort(rows[rows < most])

    def top(self, query_id: int, query: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """Up to ``k`` best (score, id) in the bucket with a score of at least ``bound``, without ``query_id`` itself."""
        length = math.sqrt(float((query * query).sum()))
        best, at, step = [], 0, max(4 * k, 256)
        rows = self.candidates(query, length, -1.0 if bound is None else float(bound))
        while at < len(rows):
            if bound is not None and bound > 0 and length * self.lengths[rows[at]] * (1 + 1e-9) < bound:
                break                                    # lengths only fall from here
            some = rows[at:at + step]
            at, step = at + len(some), step * 4
            scores = (self.vectors[some] @ query).astype(np.int64)
            ids = self.ids[some]
            keep = ids != query_id
            if bound is not None:
                keep &= scores >= bound
            best += zip(scores[keep].tolist(), ids[keep].tolist())
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if len(best) == k:
                bound = best[-1][0] if bound is None else max(bound, best[-1][0])
        return best


def _arrays(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = part.column("id").to_numpy().astype(np.int64)
    flat = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.int64) if len(ids) else np.zeros((0, 0), np.int64)


def _cells(queries: DataFrame, vectors: DataFrame, blocks: int, k: int) -> DataFrame:
    """Per query and cell the best ``k`` rows: ``query_id, vec_id, score``.

    ``queries`` has a row for each bucket it has to see (``bucket, block, id, vec, bound``); ``vectors`` has ``bucket``.
    """
    sides = (queries.select("bucket", "block", "id", "vec", "bound", F.lit(True).alias("asks"))
             .unionByName(vectors.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                         "id", "vec", F.lit(None).cast("long").alias("bound"), F.lit(False).alias("asks"))))

    def search(data: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        asking = data.column("asks")
        ask, have = data.filter(asking), data.filter(pc.invert(asking))
        out: list[tuple] = []
        if ask.num_rows and have.num_rows:
            bucket = Bucket(*_arrays(have))
            for (i, q), bound in zip(zip(*_arrays(ask)), ask.column("bound").to_pylist()):
                out += [(int(i), v, s) for s, v in bucket.top(int(i), q, k, bound)]
        q, v, s = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})
    return sides.groupBy("block", "bucket").applyInArrow(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """The ``k`` highest integer products of every query row with all other rows: ``query_id, rank, vec_id, score``.

    Ties go to the smaller id; fewer than ``k`` other rows give them all.  Vectors that are null, empty or hold a null,
    NaN or infinite component and rows without an id take no part.  Rows with one id and equal integer vectors are one
    row (a query if one of them is); of rows that share an id otherwise, all take part and none is a candidate for a
    query of that id.  Vectors with different numbers of components are an error.  An empty table gives no row.
    """
    rows = vectors.filter(F.col(key).isNotNull() & is_whole(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # copies go before anything counts rows: a bound or a cell's best k must not be taken up by them
    rows = rows.groupBy("id", "vec").agg(F.bool_or("is_query").alias("is_query"))
    rows = materialize(rows.withColumn("square", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)), "vectors")
    about = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("int")).alias("q"), F.min(F.size("vec")).alias("least"),
                     F.max(F.size("vec")).alias("most")).first()
    if about["n"] and about["least"] != about["most"]:
        raise ValueError("vectors with different numbers of components")
    blocks = max(1, math.ceil((about["q"] or 0) / block))
    # cuts by length, at most a thousand, and hash parts inside a length class that is larger than a bucket
    classes = min(1000, max(1, math.ceil(about["n"] / bucket)))
    cuts = sorted(set(rows.approxQuantile("square", [i / classes for i in range(1, classes)], 1 / (4 * classes)))) if classes > 1 else []
    of_class = sum((F.when(F.col("square") >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    if len(cuts) > 30:
        of_class = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("square")))
    rows = rows.withColumn("class", of_class.cast("int"))
    about = {r["class"]: r for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.max("square").alias("most")).collect()}
    number, first, parts = 0, {}, {}
    for c in sorted(about, reverse=True):                 # buckets are numbered by falling length
        first[c], parts[c] = number, math.ceil(about[c]["n"] / bucket)
        number += parts[c]
    table = lambda m, kind: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.lit(None).cast(f"map<int,{kind}>")
    first_of, parts_of = table(first, "int"), table(parts, "int")
    rows = rows.withColumn("bucket", (first_of[F.col("class")] + F.pmod(F.xxhash64("id"), parts_of[F.col("class")])).cast("int"))
    queries = rows.filter("is_query").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(blocks)).cast("int"))
    queries = queries.select("id", "vec", "square", "block")
    longest = rows.orderBy(F.desc("square"), "id").limit(seeds).select("id", "vec", F.lit(0).alias("bucket"))
    first_pass = _cells(queries.withColumns({"bound": F.lit(None).cast("long"), "bucket": F.lit(0)}), longest, blocks, k)
    bounds = first_pass.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
    bounds = bounds.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    queries = materialize(queries.join(bounds, "id", "left"), "queries")
    # a query goes to the classes whose longest vector can reach its bound, and there to every bucket
    classes_of = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(about[c]["most"])).alias("most")) for c in about]) \
        if about else F.array().cast("array<struct<c:int,most:double>>")
    seen = (queries.withColumn("to", F.explode(classes_of))
            .filter(F.col("bound").isNull() | (F.sqrt("square") * F.sqrt("to.most") * (1 + 1e-9) >= F.col("bound")))
            .withColumn("bucket", F.explode(F.sequence(first_of[F.col("to.c")], first_of[F.col("to.c")] + parts_of[F.col("to.c")] - 1))))
    found = _cells(seen, rows.select("id", "vec", "bucket"), blocks, k)
    return _best(found, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
