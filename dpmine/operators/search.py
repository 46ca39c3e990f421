"""Exact maximum-inner-product search.

Plan shape
----------
Passages are scanned where they lie; queries are stored in blocks under the
shared checkpoint folder, and every task reads the blocks from there:

    passages --mapInArrow(lots × one query block: BLAS, running top-k)--> stored local results
    --exchange by qid--> row_number() ≤ k  (WindowGroupLimit partial+final)

The passage side is never exchanged, and neither side passes through the
driver.  A task compares its passages with one block of queries, small enough
for the best k of its queries to fit the task's state, so a worker's memory
does not grow with the queries: more queries are more blocks, each with a scan
of its own.  A task keeps the best k of its queries over all its lots (compacted
as it goes); a query's k-th best so far is the bar for what comes later.  With
many lots two more bounds keep the exchange small: the k-th best score in a
hash sample of the passages is every task's first bar, and the k-th best among
the first few local results of all tasks is the bar to reach the exchange.
Bounds are scores of real passages, so nothing that belongs to a result is cut.

Order is ``score desc, pid asc`` on exact scores: BLAS only picks the rows that
can be among the best (with a margin for its rounding), and their scores are
then summed again one row at a time in a fixed order, so that equal vectors have
equal scores wherever they are compared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dpmine.functions.vectors import as_double_vector, dot, fold_passage, fold_query
from dpmine.session import materialize, release_memory, scratch_path

BLOCK_BYTES = 32 << 20      # vectors of one query block: what a worker holds of the queries at a time
LOT_BYTES = 16 << 20        # passage vectors compared at a time
SCORE_BYTES = 16 << 20      # one tile of scores in a task
STATE_BYTES = 32 << 20      # a task's running results; beyond them it hands out what it has
RESULT_BYTES = 24           # one running result: query row, passage, score
SCANS = 64                  # blocks that one job scans for
FEW_LOTS = 64               # up to here the local results are exchanged without further bounds
SAMPLE = 64                 # one passage in so many gives the first bounds
BOUNDS_BYTES = 64 << 20     # bounds that are broadcast; more of them meet the local results by a shuffle
EXPAND = 3                  # vectors in memory over vectors in Parquet files, at most as a rule
CANDIDATES = "qid long, pid long, score double, place int"


# ---------------------------------------------------------------- the query side
def stored_bytes(df: DataFrame) -> int:
    """Size of a plan's result as Spark estimates it: of stored tables, that of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _stored_queries(queries: DataFrame, k: int, block_bytes: int, state_bytes: int) -> list[str]:
    """Paths of the stored blocks (``id, vec, bound``); the input runs once.

    As many as the size of the files asks for, and so many that the results of a block fill half of a task's state.
    """
    path = scratch_path(queries.sparkSession, "queries")
    queries.write.parquet(path)
    stored = queries.sparkSession.read.schema(queries.schema).parquet(path)
    rows = stored.count()
    blocks = max(math.ceil(EXPAND * stored_bytes(stored) / max(block_bytes, 1)),
                 math.ceil(2 * RESULT_BYTES * rows * k / max(state_bytes, 1)))
    return [path] if blocks <= 1 else _in_blocks(stored, min(blocks, max(1, rows)))


def _in_blocks(rows: DataFrame, blocks: int) -> list[str]:
    path = scratch_path(rows.sparkSession, "query-blocks")
    rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block") \
        .write.partitionBy("block").parquet(path)
    have = rows.sparkSession.read.parquet(path).select("block").distinct().collect()      # at most ``blocks`` rows
    return [f"{path}/block={r['block']}" for r in sorted(have)]


_held: dict = {}            # the query block that this worker used last


def _block(place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, bounds) of a stored block: from the shared folder, or from a broadcast where Arrow can't open it.

    Bad rows are errors, never dropped; equal ids are always in one block.
    """
    key, held = place if isinstance(place, tuple) else (place, None)
    if key not in _held:
        _held.clear()
        if held is None:
            from pyarrow import fs, parquet
            files, path = fs.FileSystem.from_uri(place)
            table = parquet.read_table(path, filesystem=files, partitioning=None)
        else:
            table = held.value
        ids, vectors = _checked(table.column("id"), table.column("vec").combine_chunks(), "query")
        if len(np.unique(ids)) != len(ids):
            raise ValueError("repeated query ids")
        _held[key] = ids, vectors, pc.fill_null(table.column("bound"), -np.inf).to_numpy().copy()
    return _held[key]


def _forget() -> None:
    """Let go of the block when its task ends: the worker lives on."""
    _held.clear()
    release_memory()


def _checked(ids, vec: pa.ListArray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of their vectors; what is missing, not finite or of another length is an error."""
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    if ids.null_count or vec.null_count or not np.isfinite(flat).all():
        raise ValueError(f"{side} rows have no id, no vector or a non-finite component")
    lengths = pc.unique(pc.list_value_length(vec)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"{side} vectors have different lengths ({min(lengths)}..{max(lengths)})")
    return ids.to_numpy(), np.ascontiguousarray(flat.reshape(len(vec), lengths[0] if lengths else 0), np.float64)


def _opens(place: str) -> bool:
    from pyarrow import fs
    try:
        return bool(fs.FileSystem.from_uri(place))
    except (pa.ArrowException, OSError, ValueError):
        return False


# ---------------------------------------------------------------- the scan
def best_of(Q: np.ndarray, bounds: np.ndarray, pids: np.ndarray, P: np.ndarray, k: int, score_bytes: int):
    """(query row, pid, score) of the k best passages of each query that reach its bound, in tiles of query rows."""
    longest = np.sqrt((P * P).sum(axis=1).max(initial=0.0))
    step, d, out = max(1, score_bytes // (8 * max(len(pids), 1))), P.shape[1], []
    for lo in range(0, len(Q), step):
        part, bar = Q[lo:lo + step], bounds[lo:lo + step].copy()
        margin = 8 * d * np.finfo(np.float64).eps * np.sqrt((part * part).sum(axis=1)) * longest
        S = part @ P.T
        over = np.flatnonzero((S >= (bar - margin)[:, None]).sum(axis=1) > k)
        if len(over) and len(pids) > k:
            ranked = S[over]
            ranked.partition(len(pids) - k, axis=1)
            bar[over] = ranked[:, len(pids) - k]
            del ranked
        r, c = np.nonzero(S >= (bar - margin)[:, None])
        score, pairs = np.empty(len(r)), max(1, score_bytes // (16 * d))
        for at in range(0, len(r), pairs):
            one = slice(at, at + pairs)
            score[one] = np.einsum("ij,ij->i", part[r[one]], P[c[one]])
        good = score >= bounds[lo + r]
        r, c, score = r[good], c[good], score[good]
        order = np.lexsort((pids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        out.append((lo + r[keep], pids[c[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


class _Running:
    """The best ``k`` passages of every query of a block so far, and each query's bound."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, k: int, state_bytes: int):
        self.ids, self.bounds, self.k, self.most = ids, bounds.copy(), k, max(1, state_bytes // RESULT_BYTES)
        self.parts, self.new, self.kept = [], 0, 0

    def add(self, rows: np.ndarray, pids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((rows, pids, scores))
        self.new += len(rows)
        if self.new > self.kept + min(self.most, 1 << 20):
            self.compact()
            if self.kept > self.most:
                yield from self.hand_out()

    def compact(self) -> np.ndarray:
        rows, pids, scores = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.lexsort((pids, -scores, rows))
        rows = rows[order]
        fresh = np.flatnonzero(np.diff(rows, prepend=-1) != 0)
        place = np.arange(len(rows)) - np.repeat(fresh, np.diff(np.append(fresh, len(rows))))
        keep = place < self.k
        rows, place, order = rows[keep], place[keep], order[keep]
        pids, scores = pids[order], scores[order]
        self.parts = [(rows, pids, scores)]
        self.new = self.kept = len(rows)
        last = place == self.k - 1
        self.bounds[rows[last]] = np.maximum(self.bounds[rows[last]], scores[last])
        return place

    def hand_out(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            place = self.compact()
            rows, pids, scores = self.parts[0]
            for at in range(0, len(rows), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    self.ids[rows[part]], pids[part], scores[part], place[part].astype(np.int32) + 1)],
                    names=["qid", "pid", "score", "place"])
        self.parts, self.new, self.kept = [], 0, 0


def _lots(batches: Iterator[pa.RecordBatch], lot_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the passages in lots."""
    ids, vectors, size = [], [], 0
    for batch in batches:
        wide = max(1, batch.column("vec").nbytes // max(batch.num_rows, 1))
        for at in range(0, batch.num_rows, max(1, lot_bytes // wide)):
            piece = batch.slice(at, max(1, lot_bytes // wide))
            i, v = _checked(piece.column("id"), piece.column("vec"), "passage")
            if vectors and v.shape[1] != vectors[0].shape[1]:
                raise ValueError("passage vectors have different lengths")
            ids.append(i)
            vectors.append(v)
            size += v.nbytes
            if size >= lot_bytes:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(vectors)


def _scan(passages: DataFrame, places: list, k: int, lot_bytes: int, score_bytes: int, state_bytes: int) -> DataFrame:
    """A pass over the passages for each query block, in one job; each task's best k per query of its block with their
    place, stored: ``qid, pid, score, place``."""
    def against(place):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            running = None
            for pids, P in _lots(batches, lot_bytes):
                ids, Q, bounds = _block(place)
                if not len(ids):
                    continue
                if P.shape[1] != Q.shape[1]:
                    raise ValueError(f"passage vectors have length {P.shape[1]}, query vectors {Q.shape[1]}")
                running = running or _Running(ids, bounds, k, state_bytes)
                yield from running.add(*best_of(Q, running.bounds, pids, P, k, score_bytes))
            if running:
                yield from running.hand_out()
            running = None
            _forget()
        return passages.mapInArrow(run, CANDIDATES)
    try:
        return materialize(reduce(DataFrame.unionByName, [against(place) for place in places]), "local-results")
    except PySparkException as e:
        if said := re.search(r"ValueError: ((?:passage|query|repeated query)[^\n]*)", str(e)):
            raise ValueError(said[1]) from e
        raise


def _in_place(df: DataFrame) -> bool:
    """The plan is a scan with projections and filters, so that reading it twice costs no model or join."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.MULTILINE)
    return set(nodes) <= {"Project", "Filter", "Relation", "LocalRelation", "Range", "Union"}


def topk_candidates(queries: DataFrame, passages: DataFrame, k: int, *, qid: str = "qid", pid: str = "pid",
                    vec: str = "vec", block_bytes: int = BLOCK_BYTES, lot_bytes: int = LOT_BYTES,
                    score_bytes: int = SCORE_BYTES, state_bytes: int = STATE_BYTES) -> DataFrame:
    """Stored passages (``qid, pid, score``) among which every query's best k are; they reach the qid exchange."""
    spark = queries.sparkSession
    q = queries.select(F.col(qid).cast("long").alias("id"), as_double_vector(vec).alias("vec"), F.lit(None).cast("double").alias("bound"))
    p = passages.select(F.col(pid).cast("long").alias("id"), as_double_vector(vec).alias("vec"))
    places = _stored_queries(q, k, block_bytes, state_bytes)
    if (len(places) > 1 or EXPAND * stored_bytes(p) > FEW_LOTS * lot_bytes) and not _in_place(p):
        p = materialize(p, "passages")                       # several passes follow
    many = EXPAND * stored_bytes(p) > FEW_LOTS * lot_bytes

    def scan(rows: DataFrame, places: list) -> DataFrame:
        found = []
        if _opens(places[0]):
            for at in range(0, len(places), SCANS):
                found.append(_scan(rows, places[at:at + SCANS], k, lot_bytes, score_bytes, state_bytes))
            return reduce(DataFrame.unionByName, found)
        for place in places:                                 # a block at a time through the driver, never all
            held = spark.sparkContext.broadcast(spark.read.parquet(place).toArrow())
            found.append(_scan(rows, [(place, held)], k, lot_bytes, score_bytes, state_bytes))
            held.destroy()
        return reduce(DataFrame.unionByName, found)

    by_query = Window.partitionBy("qid").orderBy(F.desc("score"))

    def kth(found: DataFrame) -> DataFrame:
        """``qid, bar``: the k-th best of some real scores of each query that has so many."""
        ranked = found.select("qid", "score").withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k)
        return materialize(ranked.filter(F.col("r") == k).select("qid", F.col("score").alias("bar")), "bounds")

    if many:
        first = kth(scan(p.filter(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(SAMPLE)) == 0), places))
        stored = reduce(DataFrame.unionByName, [spark.read.parquet(x) for x in places]).drop("bound")
        stored = stored.join(first.select(F.col("qid").alias("id"), F.col("bar").alias("bound")), "id", "left")
        places = _in_blocks(stored, len(places))
    found = scan(p, places)
    if many:
        tasks = max(1, len(found.inputFiles()) // len(places))        # that scanned for a query
        bars = kth(found.filter(F.col("place") <= math.ceil(2 * k / tasks)))
        bars = F.broadcast(bars) if stored_bytes(bars) <= BOUNDS_BYTES else bars
        found = found.join(bars, "qid", "left").filter(F.col("bar").isNull() | (F.col("score") >= F.col("bar")))
    return found.select("qid", "pid", "score")


def mips_topk(queries: DataFrame, passages: DataFrame, k: int, **kw) -> DataFrame:
    """Exact top-k passages per query by inner product → ``qid, pid, rank, score``.

    ``rank`` is 1-based; a query sees ``min(k, |passages|)`` rows.
    ``queries``: ``qid, vec``; ``passages``: ``pid, vec`` (numeric arrays);
    each side runs once (passages that are more than a scan are stored first
    where they are read more than once).  Keywords: ``qid, pid, vec`` column names and
    the byte budgets ``block_bytes`` (a query block), ``lot_bytes`` (passages
    compared at a time), ``score_bytes`` (score tile), ``state_bytes`` (a
    task's running results).  Missing or non-finite vectors, vectors of other
    lengths and repeated query ids are errors.
    """
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("pid").asc())
    return (topk_candidates(queries, passages, k, **kw).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select("qid", "pid", "rank", "score"))


def score_matrix(queries: DataFrame, passages: DataFrame, *, batch: str = "batch", vec: str = "vec") -> DataFrame:
    """Every (query, passage) inner product inside a batch → ``batch, qid, pid, score``.

    An equi-join on the batch, as a training step compares its own queries and
    passages; the output is bounded by the batch size, not by |Q|·|P|.
    """
    q = queries.select(batch, "qid", as_double_vector(vec).alias("_q"))
    p = passages.select(batch, "pid", as_double_vector(vec).alias("_p"))
    return q.join(p, batch).select(batch, "qid", "pid", dot("_q", "_p").alias("score"))


def gaussian_topk(queries: DataFrame, passages: DataFrame, k: int, *, qid: str = "qid", pid: str = "pid",
                  mean: str = "mean", var: str = "var", **kw) -> DataFrame:
    """Top-k passages by Gaussian log-density: fold both sides, then ``mips_topk``.

    ``queries``: ``qid, mean``; ``passages``: ``pid, mean, var``.  A variance
    that is not positive makes the folded vector non-finite, which is an error.
    """
    q = queries.select(F.col(qid).alias("qid"), fold_query(as_double_vector(mean)).alias("vec"))
    v = F.transform(as_double_vector(var), lambda x: F.when(x > 0, x).otherwise(F.lit(float("nan"))))
    p = passages.select(F.col(pid).alias("pid"), fold_passage(as_double_vector(mean), v).alias("vec"))
    return mips_topk(q, p, k, **kw)
