"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Rows -> fingerprints (Arrow batches) -> distinct fingerprints -> tiles of one population count -> cells (pairs of
tiles whose counts differ by at most the radius) -> numpy exclusive-or and bit counts inside a cell -> a spanning
forest of the links of each cell -> connected components by alternating stars.  No pair list of a group is made: a
cell returns fewer edges than it has fingerprints.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces, release_memory, row_key, utf8
from dpmine.session import materialize

SHINGLE = 3          # words of a shingle
RADIUS = 3           # most differing bits of a link
SEED = 42            # of XXH64
TILE = 32768         # distinct fingerprints of a tile (with their ids 0.5 MB)
SUB = 256            # fingerprints of a sub-tile inside a cell
_CHUNK = 1 << 15     # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of UTF-8 bytes: A-Z lower-cased, words joined by a space, a bit per majority of hashes.

    Fewer words than a shingle: the whole sequence is one shingle; no word: zero.
    """
    words = text.lower().split()          # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        runs = zip(*(words[at + k:end + k] for k in range(shingle))) if len(words) >= shingle else [words]
        raw = b"".join([digest(b" ".join(run), seed) for run in runs])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: ``key``, ``_row_id``, ``_row_hash`` (:func:`~dpmine.llm.common.row_key`), ``fp`` (signed)."""
    def run(batches):
        for part in pieces(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in utf8(part.column(0))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fps.view(np.int64))],
                                             names=["_key", "_row_id", "_row_hash", "fp"])
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(key).cast("long").alias("_key"),
                       *row_key(key, text))
    out = rows.mapInArrow(run, "_key long, _row_id long, _row_hash long, fp long")
    return out.withColumnRenamed("_key", key)


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _arranged(fps: np.ndarray, ids: np.ndarray):
    """Fingerprints ordered by the population counts of their quarters, with the range of those in each sub-tile."""
    q = _quarters(fps)
    order = np.lexsort(q.T)
    fps, ids, q = fps[order], ids[order], q[order]
    starts = np.arange(0, len(fps), SUB)
    return fps, ids, starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges ``u - v``: (member, least member) without the roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        if not len(a):
            break
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def linked_forest(fps_a: np.ndarray, ids_a: np.ndarray, fps_b: np.ndarray | None, ids_b: np.ndarray | None,
                  radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact comparison of two tiles (``fps_b`` None: of a tile with itself), as a forest over the ids.

    Sub-tiles whose ranges of quarter population counts are further apart than the radius are skipped: each quarter's
    difference is a lower bound of its differing bits.  Links found so far are folded into a forest whenever their
    number passes that of the fingerprints, so memory stays at a multiple of the tile.
    """
    a = _arranged(fps_a, ids_a)
    b = a if fps_b is None else _arranged(fps_b, ids_b)
    left, right, held = [], [], 0
    limit = 8 * (len(a[0]) + len(b[0])) + 4096

    def fold():
        nonlocal left, right, held
        u, v = _forest(np.concatenate(left), np.concatenate(right))
        left, right, held = [u], [v], 0

    for i, at in enumerate(a[2]):
        apart = (np.maximum(a[3][i] - b[4], 0) + np.maximum(b[3] - a[4][i], 0)).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        if fps_b is None:
            near = near[near >= i]
        rows, row_ids = a[0][at:at + SUB], a[1][at:at + SUB]
        for chunk in np.array_split(near, max(1, math.ceil(len(near) / 16))):
            if not len(chunk):
                continue
            cols = np.concatenate([np.arange(b[2][j], min(b[2][j] + SUB, len(b[0]))) for j in chunk])
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ b[0][cols][None, :]) <= radius)
            u, v = row_ids[x], b[1][cols[y]]
            differ = u != v
            if differ.any():
                left.append(u[differ])
                right.append(v[differ])
                held += len(left[-1])
                if held > limit:
                    fold()
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fold()
    return left[0], right[0]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` whose components are those of all links of ``distinct`` (``fp`` unique, ``id``).

    Tiles hold one population count each; a large count is dealt by hash into ``ceil(n / tile)`` tiles.  Only the 65
    counts reach the driver: a tile finds its cells (itself and every tile of a count within the radius) by itself.
    """
    rows = distinct.select("fp", "id", F.bit_count("fp").cast("int").alias("pop"))
    sizes = {r["pop"]: math.ceil(r["n"] / tile) for r in rows.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.lit(None).cast("map<int,int>")
    tiles = (rows.withColumn("sub", F.pmod(F.xxhash64("fp"), parts[F.col("pop")]).cast("int"))
             .groupBy("pop", "sub").agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids")))
    met = (tiles.withColumn("q", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)))
           .filter(parts[F.col("q")].isNotNull())
           .withColumn("t", F.explode(F.sequence(F.lit(0), parts[F.col("q")] - 1))))
    first = (F.col("pop") < F.col("q")) | ((F.col("pop") == F.col("q")) & (F.col("sub") <= F.col("t")))
    either = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    dealt = met.select(either("pop", "q").alias("p1"), either("sub", "t").alias("s1"), either("q", "pop").alias("p2"),
                       either("t", "sub").alias("s2"), (~first).alias("second"), "fps", "ids")

    def compare(data: pa.Table) -> pa.Table:
        side = {}
        for row in range(data.num_rows):
            part = data.slice(row, 1)
            fps, ids = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("fps", "ids"))
            side[part.column("second")[0].as_py()] = (fps.astype(np.int64).view(np.uint64), ids.astype(np.int64))
        u, v = linked_forest(*side[False], *side.get(True, (None, None)), radius)
        release_memory()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return dealt.groupBy("p1", "s1", "p2", "s2").applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``edges`` (``u, v``): alternating large and small stars.

    Each half round is a minimum per node (with map-side combine) and a join; every round is written to the shared
    scratch folder, so a lost executor costs one round.  Ends when a round changes nothing.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter("u <> v").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(state)
    while before[0]:
        wide = both(state)
        least = wide.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (wide.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))))
                 .select(F.col("col.v").alias("u"), F.col("col.m").alias("v")).filter("u <> v").distinct())
        state = materialize(small, "links")
        after = mark(state)
        if after == before:
            break
        before = after
    return (state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(state.select(F.col("v"), F.col("v"))).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per input row: ``key``, ``_row_id``, ``_row_hash``, ``fp``, ``component_id``.

    ``component_id`` is the least ``key`` reachable by links (null ids count as the least id and come back null).
    Null and empty texts have fingerprint zero and are linked like any other; repeated rows share a component; an
    empty table gives an empty result; other columns of ``docs`` play no part.
    """
    fps = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("_row_id").alias("id")), "distinct")
    # ids can repeat over texts: number the nodes by fingerprint, take the least row id of a component at the end
    edges = fingerprint_links(distinct.select("fp", F.col("fp").alias("id")), radius, tile)
    found = components(edges).withColumnRenamed("node", "fp")
    named = distinct.select("fp", "id").join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.join(ids, "component").select("fp", "component", "component_id")
    return fps.join(classes, "fp").select(
        key, "_row_id", "_row_hash", "fp", "component",
        F.when(F.col("component_id") > F.lit(-(1 << 63)).cast("long"), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id (then text hash).

    Columns come back unchanged; among rows equal in id and text one stays.
    """
    from pyspark.sql import Window as W
    classes = near_duplicates(docs, key, text, shingle, radius)
    kept = (classes.groupBy("component").agg(F.min(F.struct("_row_id", "_row_hash")).alias("k"))
            .select("k._row_id", "k._row_hash"))
    a, b = row_key(key, text)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), a, b)
    first = W.partitionBy("_row_id", "_row_hash").orderBy("_order")
    return (marked.join(kept, ["_row_id", "_row_hash"], "left_semi")
            .withColumn("_order", F.xxhash64("_row"))
            .withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*"))
