"""Shared by the two exact repeat removals: windows of a fixed length that occur more than once.

Every window gets an anchor that depends on its content alone.  Neighbouring windows of one document with one anchor
are a segment.  Equal windows have anchors of equal content (the class) at equal places, so only segments of a class
can share windows:

1. one row per segment: class hash, hash of the whole segment, document, place;
2. classes that occur once end here; segments that are equal as a whole are settled by a count per (class, hash);
3. of classes with several different segments one document per different segment sends its content, and the windows
   are compared inside the class; what is found there holds wherever else the segment lies in rows of that document's id;
4. a class with very many different segments is dealt into parts that are compared in the same way, and then one window of
   each run of equal ones is compared with those of the other parts.

Counts combine map-side; joins are on hashes with stored tables and can be split where a class is frequent; no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces, release_memory, row_key, utf8
from dpmine.session import materialize

_M = 0x9E3779B97F4A7C15                  # odd: has an inverse modulo 2**64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
MANY = 4000                              # different segments of a class that are compared in one task, about
TASK_BYTES = 1 << 20                     # content of the segments that are compared in one task, about
FILTER_BITS = 1 << 26                    # of the fixed-size filter of affected documents


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = max(n + 1, 2 * len(_POWERS))
        start = np.ones(1, np.uint64)
        _POWERS = np.cumprod(np.concatenate([start, np.full(size - 1, np.uint64(_M))]))
        _INVERSES = np.cumprod(np.concatenate([start, np.full(size - 1, np.uint64(pow(_M, -1, 1 << 64)))]))
    return _POWERS[:n], _INVERSES[:n]


class PrefixHash:
    """Polynomial hashes (modulo 2**64, then mixed) of all substrings of ``symbols``."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(len(symbols) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1])])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = self.raw(start, stop)
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(32))


@dataclass
class Texts:
    """Symbols of some documents one after the other, with the first and past-the-last of each."""

    symbols: np.ndarray
    first: np.ndarray
    past: np.ndarray


def bounded(texts: Texts, window: int, most: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """Cut into lots of about ``most`` symbols: (lot, document of each part, offset of each part in its document).

    A longer document is cut into parts that overlap by a window less one, so each window is in one part.
    """
    def lot(parts):
        sizes = np.array([b - a for _, a, b in parts], np.int64)
        past = np.cumsum(sizes)
        return (Texts(np.concatenate([texts.symbols[a:b] for _, a, b in parts]), past - sizes, past),
                np.array([d for d, _, _ in parts], np.int64),
                np.array([a - texts.first[d] for d, a, _ in parts], np.int64))
    parts, held = [], 0
    for d, (a, b) in enumerate(zip(texts.first.tolist(), texts.past.tolist())):
        while b - a >= window:
            end = min(b, a + most)
            if parts and held + end - a > most:
                yield lot(parts)
                parts, held = [], 0
            parts.append((d, a, end))
            held += end - a
            if end == b:
                break
            a = end - window + 1
    if parts:
        yield lot(parts)


def segments(texts: Texts, hashes: PrefixHash, anchor: np.ndarray, window: int, gram: int):
    """(part, first window, windows, class hash, segment hash, anchor's distance from the first window) from ``anchor``,
    the anchor's place for each window start.

    Window starts without a whole window in their part, or with anchor -1, are left out.
    """
    n = len(anchor)
    part = np.repeat(np.arange(len(texts.first)), texts.past - texts.first)[:n]
    whole = (np.arange(n) + window <= texts.past[part]) & (anchor >= 0)
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], n)
    good = whole[begin]
    begin, stop = begin[good], stop[good]
    at = anchor[begin]
    return part[begin], begin, stop - begin, hashes(at, at + gram), hashes(begin, stop - 1 + window), at - begin


SEGMENT_SCHEMA = "_row_id long, _row_hash long, cls long, seg long, start long, n int, off int"


def segment_rows(docs: DataFrame, read: Callable, anchors: Callable, window: int, gram: int, most: int,
                 key: str, text: str) -> DataFrame:
    """Rows of :data:`SEGMENT_SCHEMA`: ``read(list of UTF-8) -> Texts``, ``anchors(Texts, PrefixHash) -> places``."""
    def run(batches):
        for batch in pieces(batches, 2 << 20):
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
            for lot, doc, offset in bounded(read(utf8(batch.column(0))), window, most):
                hashes = PrefixHash(lot.symbols)
                part, begin, n, cls, seg, off = segments(lot, hashes, anchors(lot, hashes), window, gram)
                at = begin - lot.first[part] + offset[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[0][doc[part]]), pa.array(ids[1][doc[part]]), pa.array(cls.view(np.int64)),
                     pa.array(seg.view(np.int64)), pa.array(at), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))],
                    names=["_row_id", "_row_hash", "cls", "seg", "start", "n", "off"])
    rows = docs.select(docs[text].cast("string").alias("_text"), *row_key(key, text))
    return rows.mapInArrow(run, SEGMENT_SCHEMA)


def bit_filter(hashes: DataFrame, column: str, bits: int, probes: int = 1) -> np.ndarray:
    """A bitmap of ``bits`` (a fixed size) with ``probes`` bits set for each 64-bit hash; built and combined in the executors."""
    places = F.explode(F.array(*[filter_place(F.col(column), bits, k) for k in range(probes)]))
    found = (hashes.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in found:                                      # buckets of 32768 bits, numbered from 1
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def filter_place(h: Column, bits: int, probe: int = 0) -> Column:
    """Place (from 1) of a hash in the filter: bits of the hash from 28 * probe on."""
    return F.shiftrightunsigned(h, 28 * probe).bitwiseAND(F.lit(bits - 1)) + 1


def in_filter(bitmap: np.ndarray, h: np.ndarray, probes: int = 1) -> np.ndarray:
    """Which hashes (uint64) have all their bits set; one that was added always has."""
    bits, out = np.uint64(8 * len(bitmap) - 1), np.ones(len(h), bool)
    for k in range(probes):
        # bucket b holds places 32768 (b - 1) + 1 ... 32768 b, and bit position is (place - 1) modulo 32768
        at = (h >> np.uint64(28 * k)) & bits
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def affected(docs: DataFrame, ids: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    """``docs`` rows that may be among ``ids`` (by a filter of fixed size: all that are, and as it fills up, others).

    Returns the marked documents (``_row, _row_id, _row_hash``) and the condition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        bit_filter(ids.select(F.xxhash64("_row_id", "_row_hash").alias("h")).distinct(), "h", FILTER_BITS))

    @F.pandas_udf("boolean")
    def may_be(h):
        import pandas as pd
        return pd.Series(in_filter(shared.value, h.to_numpy(np.int64).view(np.uint64)))
    a, b = row_key(key, text)
    marked = docs.select(docs[key].cast("long").alias("_key"), docs[text].cast("string").alias("_text"), a, b)
    return marked, may_be(F.xxhash64("_row_id", "_row_hash"))


def in_runs(run: np.ndarray, ids: np.ndarray, earlier: bool) -> np.ndarray:
    """Which windows are not alone in their run of equal windows (``earlier``: not of the smallest id in it)."""
    if not len(run):
        return np.zeros(0, bool)
    return ids > smallest(run, ids)[run] if earlier else np.bincount(run)[run] > 1


def smallest(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each run."""
    low = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, run, ids)
    return low


def repeated(rows: DataFrame, docs: DataFrame, read: Callable, window: int, compare: Callable, symbol: str,
             earlier: bool, key: str, text: str, many: int = MANY) -> DataFrame:
    """``_row_id, _row_hash, start, stop``: stretches of symbols covered by windows that occur elsewhere.

    ``earlier``: only windows that also occur in a document with a smaller id count (the id is ``_row_id``).
    ``compare(classes, anchor distances, symbols, first symbol and windows of each segment, window)`` compares the
    windows of some segments in one task and returns (segment, place, run) of each: equal windows have one run number.
    Tables that a frequent class is joined with are stored first, so that the join can be split.
    """
    rows = materialize(rows, "segments")
    good = rows.groupBy("cls").agg(F.count("*").alias("k"), F.min("_row_id").alias("lo"), F.max("_row_id").alias("hi"))
    good = materialize(good.filter("lo < hi" if earlier else "k > 1").select("cls"), "classes")
    live = materialize(rows.join(good, "cls", "left_semi"), "live")
    kinds = live.groupBy("cls", "seg").agg(F.count("*").alias("k"),
                                           F.min(F.struct("_row_id", "_row_hash", "start", "n", "off")).alias("rep"))
    kinds = materialize(kinds.select("cls", "seg", "k", "rep.*"), "kinds")
    if earlier:
        shared = live.join(kinds.select("cls", "seg", F.col("_row_id").alias("lo")), ["cls", "seg"]).filter("_row_id > lo")
    else:
        shared = live.join(kinds.filter("k > 1").select("cls", "seg"), ["cls", "seg"], "left_semi")
    shared = shared.select("_row_id", "_row_hash", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop"))
    several = kinds.groupBy("cls").agg(F.count("*").alias("kinds"), F.min("_row_id").alias("lo"), F.max("_row_id").alias("hi"))
    several = materialize(several.filter("kinds > 1 and lo < hi" if earlier else "kinds > 1").select("cls", "kinds"), "several")
    asked = materialize(kinds.join(several, "cls").select("_row_id", "_row_hash", "start", "n", "off", "cls", "seg", "k", "kinds"), "asked")
    size = asked.agg(F.sum(F.col("n") + window).alias("s")).first()["s"] or 0
    if not size:
        return shared
    width = np.dtype(symbol).itemsize
    lots = int(max(1, -(-size * width // TASK_BYTES)))

    # every document that is asked meets its text once, with the list of its segments (no longer than the document)
    marked, may_be = affected(docs, asked, key, text)
    wanted = marked.filter(may_be).select("_text", "_row_id", "_row_hash").dropDuplicates(["_row_id", "_row_hash"])
    asks = asked.groupBy("_row_id", "_row_hash").agg(F.collect_list(F.struct("start", "n", "off", "cls", "seg", "kinds")).alias("asks"))
    asks = materialize(asks, "asks")

    def fetch(batches):
        for batch in pieces(batches, 1 << 20):
            lists = batch.column(3)
            ask = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            texts = read(utf8(batch.column(0)))
            n = ask.field("n").to_numpy().astype(np.int64)
            start = texts.first[of] + ask.field("start").to_numpy()
            symbols = texts.symbols.astype(symbol, copy=False)
            content = [symbols[a:b].tobytes() for a, b in zip(start.tolist(), (start + n - 1 + window).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(c).to_numpy()[of]) for c in (1, 2)]
                + [ask.field(c) for c in ("start", "n", "off", "cls", "seg", "kinds")] + [pa.array(content, pa.binary())],
                names=["_row_id", "_row_hash", "start", "n", "off", "cls", "seg", "kinds", "content"])
    contents = wanted.join(asks, ["_row_id", "_row_hash"]).select("_text", "_row_id", "_row_hash", "asks").mapInArrow(
        fetch, "_row_id long, _row_hash long, start long, n int, off int, cls long, seg long, kinds long, content binary")
    contents = materialize(contents, "contents")

    def windows(data: pa.Table):
        """Symbols of the segments in ``data``, their first ones, and (segment, place, run) of all windows."""
        n = data.column("n").to_numpy().astype(np.int64)
        sizes = n + window - 1
        symbols = np.frombuffer(b"".join(data.column("content").to_pylist()), symbol)
        first = np.cumsum(sizes) - sizes
        return symbols, first, *compare(data.column("cls").to_numpy(), data.column("off").to_numpy(), symbols, first, n, window)

    def settle(data: pa.Table) -> pa.Table:
        ids = [data.column(c).to_numpy() for c in ("_row_id", "_row_hash", "start")]
        _, _, seg, at, run = windows(data)
        hit = np.flatnonzero(in_runs(run, ids[0][seg], earlier))
        hit = hit[np.lexsort((at[hit], seg[hit]))]
        seg, at = seg[hit], at[hit]
        if len(seg):                                     # neighbouring windows of one segment make one stretch
            new = np.ones(len(seg), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
            begin, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(seg)) - 1
            seg, lo, hi = seg[begin], at[begin], at[end]
        else:
            lo = hi = at
        release_memory()
        return pa.table({"_row_id": ids[0][seg], "_row_hash": ids[1][seg], "cls": data.column("cls").to_numpy()[seg],
                         "seg": data.column("seg").to_numpy()[seg], "first": ids[2][seg], "at": lo, "size": hi - lo + window})
    out = "_row_id long, _row_hash long, cls long, seg long, first long, at long, size long"
    few = (contents.filter(F.col("kinds") <= many).withColumn("lot", F.pmod(F.xxhash64("cls"), F.lit(lots)))
           .groupBy("lot").applyInArrow(settle, out))

    def placed(hits: DataFrame) -> DataFrame:
        """``shared`` and the stretches ``hits``, each given as a place in its segment."""
        if earlier:                                      # the segment may lie elsewhere in rows of its smallest id, too
            hits = materialize(hits, "hits")
            other = (F.col("start") != F.col("first")) | (F.col("twin_hash") != F.col("_row_hash"))
            twins = live.select("_row_id", F.col("_row_hash").alias("twin_hash"), "cls", "seg", "start")
            twins = twins.join(asked.filter("k > 1").select("cls", "seg", "_row_id"), ["cls", "seg", "_row_id"], "left_semi")
            twins = hits.join(twins, ["cls", "seg", "_row_id"]).filter(other).select(
                "_row_id", F.col("twin_hash").alias("_row_hash"), "cls", "seg", F.col("start").alias("first"), "at", "size")
            hits = hits.union(twins.select(*hits.columns))
        start = F.col("first") + F.col("at")
        return shared.union(hits.select("_row_id", "_row_hash", start.alias("start"), (start + F.col("size")).alias("stop")))
    crowd = contents.filter(F.col("kinds") > many)
    if crowd.isEmpty():
        return placed(few)

    # A class too large for one task: its segments are dealt into parts, each part is compared like a small class, and
    # one window of every run meets the equal-looking ones of the other parts.
    def part(data: pa.Table) -> pa.Table:
        symbols, first, seg, at, run = windows(data)
        start, ids = first[seg] + at, data.column("_row_id").to_numpy()[seg]
        count, (_, one) = np.bincount(run), np.unique(run, return_index=True)
        one_of = np.zeros(len(run), bool)
        one_of[one] = True
        columns = {c: data.column(c).to_numpy()[seg] for c in ("_row_id", "_row_hash", "cls", "seg", "part", "start")}
        table = pa.table({**columns, "at": at, "w": PrefixHash(symbols)(start, start + window).view(np.int64), "run": run,
                          "lo": smallest(run, ids)[run], "k": count[run], "one": one_of})
        release_memory()
        return table
    parts = crowd.withColumn("part", F.pmod("seg", F.ceil(F.col("kinds") / F.lit(max(many, 1)))))
    single = materialize(parts.groupBy("cls", "part").applyInArrow(
        part, "_row_id long, _row_hash long, cls long, seg long, part long, start long, at long, w long, run long, lo long, "
              "k long, one boolean"), "windows")
    ones = single.filter("one").select("cls", "part", "run", "w", "seg", "at", "lo", "k")
    again = materialize(ones.groupBy("cls", "w").agg(F.count("*").alias("parts")).filter("parts > 1").select("cls", "w"), "again")
    content = F.expr(f"substring(content, cast(at as int) * {width} + 1, {window * width})")
    met = materialize(ones.join(again, ["cls", "w"], "left_semi").join(crowd.select("cls", "seg", "content"), ["cls", "seg"])
                      .select("cls", "part", "run", "w", "lo", "k", content.alias("content"),
                              F.lit(1).alias("n"), F.lit(0).alias("off")), "met")
    lots = int(max(1, -(-met.count() * window * width // TASK_BYTES)))

    def meet(data: pa.Table) -> pa.Table:
        _, _, seg, _, run = windows(data)
        lo, k = (data.column(c).to_numpy()[seg] for c in ("lo", "k"))
        total = np.zeros(int(run.max()) + 1, np.int64)
        np.add.at(total, run, k)
        return pa.table({**{c: data.column(c).to_numpy()[seg] for c in ("cls", "part", "run")},
                         "all_lo": smallest(run, lo)[run], "all_k": total[run]})
    known = (met.withColumn("lot", F.pmod(F.xxhash64("cls", "w"), F.lit(lots))).groupBy("lot")
             .applyInArrow(meet, "cls long, part long, run long, all_lo long, all_k long"))
    known = materialize(known, "runs")
    hit = F.col("_row_id") > F.coalesce("all_lo", "lo") if earlier else F.coalesce("all_k", "k") > 1
    hits = single.join(known, ["cls", "part", "run"], "left").filter(hit)
    return placed(few.union(hits.select("_row_id", "_row_hash", "cls", "seg", F.col("start").alias("first"), "at",
                                        F.lit(window).cast("long").alias("size"))))


def covered(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as sorted, separate stretches; ones that only touch are joined."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return starts[begin], reach[np.append(begin[1:], len(starts)) - 1]


def without(docs: DataFrame, found: DataFrame, cut: Callable, schema: str, key: str, text: str) -> DataFrame:
    """``cut(text, starts, stops) -> values`` for every document, given the stretches to take away.

    ``schema`` names what follows ``key``.  Documents surely without stretches are cut in place; the others meet
    their stretches by id.
    """
    found = materialize(found, "stretches")
    marked, may_be = affected(docs, found, key, text)
    names = [key] + [c.split()[0] for c in schema.split(", ")]
    none = np.zeros(0, np.int64)

    def table(ids, rows) -> pa.Table:
        return pa.Table.from_arrays([ids, *[pa.array(list(c)) for c in zip(*rows)]], names=names)

    def plain(batches):
        for batch in pieces(batches):
            rows = [cut(t, none, none) for t in utf8(batch.column(1))]
            yield from table(batch.column(0), rows).to_batches()
    out = f"{key} long, {schema}"
    clean = marked.filter(~may_be).select("_key", "_text").mapInArrow(plain, out)

    def meet(k, doc: pa.Table, gone: pa.Table) -> pa.Table:
        if not doc.num_rows:
            return pa.table({c: pa.array([], pa.int64() if "long" in t else pa.binary() if "binary" in t else pa.string())
                             for c, t in zip(names, ["long", *[c.split()[1] for c in schema.split(", ")]])})
        starts, stops = covered(gone.column("start").to_numpy(), gone.column("stop").to_numpy())
        texts = utf8(doc.column("_text").combine_chunks())
        row = cut(texts[0], starts, stops)               # rows of one id and text are equal
        return table(doc.column("_key").combine_chunks(), [row] * doc.num_rows)
    touched = marked.filter(may_be).groupBy("_row_id", "_row_hash").cogroup(
        found.groupBy("_row_id", "_row_hash")).applyInArrow(meet, out)
    return clean.unionByName(touched)
