"""Benchmark decontamination: BM25 block-max WAND over test items, every training passage a query.

Items are cut into segments of at most ``SEGMENT`` words, passages are windows of ``2 * SEGMENT`` words that start every
``SEGMENT`` words, so some window holds any copied segment as a whole.  A segment's score is divided by its score
against itself; a passage retrieves every segment from ``threshold`` of that on.  The documents of retrieved items are
then verified: the five-word runs of the item's question and of its answer must be in the document.

Items are dealt into shards of a bounded number of words; the index of one shard at a time is broadcast and the
documents are read once a shard.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces, row_key
from dpmine.session import materialize

SEGMENT = 64               # words of an index segment; a passage has twice as many
BLOCK = 16                 # postings of a block with a maximum of its own
RANGE = 2                  # neighbouring segments that share the maxima of the first test of all passages
THRESHOLD = 0.6            # of a segment's score against itself: what a copy with a fifth of its words lost still reaches
RUN, OVERLAP = 5, 0.8      # words of a run, and the share of an item's runs that a contaminated document has
SHARD_WORDS = 2_000_000    # words of the items in one broadcast index
K1, B = 1.2, 0.75
_CELLS = 4 << 20          # entries of the dense table of the first test
_SPACES = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def runs_of(words: list[bytes], run: int = RUN) -> set:
    """Different runs of ``run`` words; a shorter text is one run; no word: none."""
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(run)))) if len(words) >= run else {tuple(words)}


@dataclass
class Index:
    """Postings of one shard by term, ordered by segment: ``start[t] .. start[t + 1]`` of ``segment`` and ``impact``.

    ``impact`` is the normalised BM25 contribution; ``list_max[t]`` its maximum; ``block_last`` and ``block_max`` give
    the last segment and the maximum of every ``BLOCK`` postings (``block_start`` by term).

    The most frequent terms whose joint contribution stays below half the threshold in every segment are not essential:
    no segment can be retrieved by them alone.  ``common_max`` bounds what they give together in each range of ``RANGE``
    segments; ``range_id`` and ``range_max`` list the maxima of every other term by range (``range_start`` by term).
    """

    terms: dict
    start: np.ndarray
    segment: np.ndarray
    impact: np.ndarray
    list_max: np.ndarray
    block_start: np.ndarray
    block_last: np.ndarray
    block_max: np.ndarray
    range_start: np.ndarray
    range_id: np.ndarray
    range_max: np.ndarray
    common_max: np.ndarray
    item_of: list
    parts: dict            # item -> (runs of the question, runs of the answer)
    wholes: dict           # item -> runs of the whole text, where question and answer are halves of one


def build_index(items: list[tuple], weight: dict[bytes, float], average: float,
                threshold: float = THRESHOLD, whole: bool = False) -> Index:
    """``items``: (id, question words, answer words); ``weight``: inverse document frequencies; ``average``: segment words."""
    postings, item_of, parts, wholes = defaultdict(list), [], {}, {}
    for item, question, answer in items:
        parts[item] = (runs_of(question), runs_of(answer))
        text = question + answer
        if whole:
            wholes[item] = runs_of(text)
        count = max(1, math.ceil(len(text) / SEGMENT))
        for part in range(count if text else 0):
            words = text[part * len(text) // count:(part + 1) * len(text) // count]
            tf: dict = defaultdict(int)
            for w in words:
                tf[w] += 1
            raw = {w: weight[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / average)) for w, n in tf.items()}
            total = sum(raw.values())
            for w, x in raw.items():
                postings[w].append((len(item_of), x / total))
            item_of.append(item)
    terms = {w: i for i, w in enumerate(sorted(postings))}
    lists = [postings[w] for w in terms]
    n_ranges = -(-len(item_of) // RANGE)
    together, common = np.zeros(len(item_of)), set()
    for t in sorted(range(len(lists)), key=lambda t: (-len(lists[t]), t)):
        segments, impacts = np.array([s for s, _ in lists[t]]), np.array([x for _, x in lists[t]])
        if (together[segments] + impacts).max() >= threshold / 2:
            break
        together[segments] += impacts
        common.add(t)
    by_range: list[dict] = []
    for t, p in enumerate(lists):
        most: dict = {}
        for s, x in p if t not in common else ():
            most[s // RANGE] = max(most.get(s // RANGE, 0.0), x)
        by_range.append(most)
    blocks = [[p[at:at + BLOCK] for at in range(0, len(p), BLOCK)] for p in lists]
    return Index(
        terms, np.cumsum([0] + [len(p) for p in lists]), np.array([s for p in lists for s, _ in p], np.int64),
        np.array([x for p in lists for _, x in p]), np.array([max(x for _, x in p) for p in lists]),
        np.cumsum([0] + [len(b) for b in blocks]), np.array([b[-1][0] for bs in blocks for b in bs], np.int64),
        np.array([max(x for _, x in b) for bs in blocks for b in bs]),
        np.cumsum([0] + [len(m) for m in by_range]), np.array([r for m in by_range for r in m], np.int64),
        np.array([x for m in by_range for x in m.values()]),
        np.maximum.reduceat(together, np.arange(0, len(item_of), RANGE)) if n_ranges else np.zeros(0), item_of, parts, wholes)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> dict[int, float]:
    """All segments whose score for the (different) ``terms`` is at least ``threshold``, with the score.

    Lists are kept by their current segment.  The pivot is the first list at which the list maxima add up to the
    threshold; if the maxima of the blocks that hold the pivot segment can't, the lists jump past the nearest block end.
    """
    slack, end = threshold - 1e-9, len(index.item_of)
    start, segment, impact = index.start, index.segment, index.impact
    at = {t: int(start[t]) for t in terms}
    now = {t: int(segment[at[t]]) for t in terms}

    def seek(t, target):
        a = int(start[t]) + int(np.searchsorted(segment[start[t]:start[t + 1]], target))
        at[t] = a
        now[t] = int(segment[a]) if a < start[t + 1] else end

    found = {}
    while True:
        order = sorted((t for t in terms if now[t] < end), key=now.__getitem__)
        total, pivot = 0.0, None
        for i, t in enumerate(order):
            total += index.list_max[t]
            if total >= slack:
                pivot = i
                break
        if pivot is None:
            return found
        target = now[order[pivot]]
        while pivot + 1 < len(order) and now[order[pivot + 1]] == target:
            pivot += 1
        bound, jump = 0.0, end
        for t in order[:pivot + 1]:
            lo, hi = int(index.block_start[t]), int(index.block_start[t + 1])
            b = lo + int(np.searchsorted(index.block_last[lo:hi], target))
            if b < hi:
                bound += index.block_max[b]
                jump = min(jump, int(index.block_last[b]) + 1)
        if bound < slack:
            if pivot + 1 < len(order):
                jump = min(jump, now[order[pivot + 1]])
            jump = max(jump, target + 1)
            for t in order[:pivot + 1]:
                if now[t] < jump:
                    seek(t, jump)
        elif now[order[0]] == target:
            score = 0.0
            for t in order[:pivot + 1]:
                if now[t] == target:
                    score += impact[at[t]]
                    seek(t, target + 1)
            if score >= slack:
                found[target] = score
        else:
            for t in order[:pivot]:
                if now[t] < target:
                    seek(t, target)


def search(index: Index, docs: list[list[bytes]], threshold: float) -> list[tuple[int, int, float]]:
    """(document, segment, best score) of every passage-segment pair from ``threshold`` on.

    For all passages at once the maxima of their essential terms are summed by range of segments, half window by half
    window (which can only be more); only passages that can reach the threshold in some range enter the traversal.
    """
    get, counts = index.terms.get, np.array([len(d) for d in docs], np.int64)
    ids = np.fromiter((get(w, -1) for d in docs for w in d), np.int64, int(counts.sum()))
    cells = np.maximum(1, -(-counts // SEGMENT))
    first_cell = np.cumsum(cells) - cells
    where = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    cell = np.repeat(first_cell, counts) + where // SEGMENT
    known = ids >= 0
    size, n_cells, n_ranges = max(len(index.terms), 1), int(cells.sum()), len(index.common_max)
    pairs = np.unique(cell[known] * size + ids[known])
    at, term = np.divmod(pairs, size)
    last = np.zeros(n_cells, bool)
    last[first_cell + cells - 1] = True
    alone = np.zeros(n_cells, bool)                       # the last half window is a passage only if it is the only one
    alone[first_cell[cells == 1]] = True
    passage = ~last | alone
    hot = np.zeros(n_cells, bool)
    edges = np.searchsorted(at, np.arange(n_cells + 1))
    step = max(1, _CELLS // max(n_ranges, 1))
    for low in range(0, n_cells, step):                   # a dense table of some half windows by all ranges
        high = min(n_cells, low + step)
        own = slice(edges[low], edges[min(high + 1, n_cells)])
        sizes = index.range_start[term[own] + 1] - index.range_start[term[own]]
        slot = np.repeat(index.range_start[term[own]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        key = np.repeat(at[own] - low, sizes) * n_ranges + index.range_id[slot]
        rows = high - low + 1
        half = np.bincount(key, index.range_max[slot], rows * n_ranges).reshape(rows, n_ranges)
        bound = half[:-1] + np.where(last[low:high, None], 0, half[1:]) + index.common_max
        hot[low:high] = (bound >= threshold - 1e-9).any(axis=1)
    hot = np.flatnonzero(hot & passage)
    doc_of = np.repeat(np.arange(len(docs)), cells)
    best: dict = {}
    for c in hot.tolist():
        stop = c + (1 if last[c] else 2)
        terms = np.unique(term[edges[c]:edges[stop]])
        if index.list_max[terms].sum() < threshold - 1e-9:
            continue
        for s, x in block_max_wand(index, terms.tolist(), threshold).items():
            key = (int(doc_of[c]), s)
            best[key] = max(best.get(key, 0.0), x)
    return [(d, s, x) for (d, s), x in best.items()]


def verify(index: Index, words: list[bytes], items) -> list[tuple]:
    """(item, question overlap, answer overlap) of those ``items`` whose runs are in the text.

    Enough of both parts have to be there (a part without a word counts as there); of an item whose parts are halves of
    one text, enough of the whole will do.
    """
    runs, out = runs_of(words), []
    lengths = {len(next(iter(part))) for i in items for part in (*index.parts[i], index.wholes.get(i)) if part}
    for n in lengths - {RUN}:                              # parts shorter than a run are looked for as a whole
        runs |= set(zip(*(words[k:] for k in range(n))))
    for item in items:
        share = [len(part & runs) / len(part) if part else 1.0 for part in index.parts[item]]
        own = index.wholes.get(item)
        if min(share) >= OVERLAP or own and len(own & runs) >= OVERLAP * len(own):
            out.append((item, *share))
    return out


def index_shards(items: DataFrame, key: str, question: str, answer: str, shard_words: int = SHARD_WORDS,
                 threshold: float = THRESHOLD, whole: bool = False):
    """Yield an :class:`Index` for each shard of ``items``; statistics are those of all items."""
    def split(batches):
        for part in pieces(batches):
            q, a = ([words_of(x) for x in part.column(c).to_pylist()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(q, pa.list_(pa.binary())), pa.array(a, pa.list_(pa.binary()))],
                names=["item", "question", "answer"])
    rows = items.select(
        F.col(key).cast("long").alias("item"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    rows = rows.dropDuplicates(["item", "q", "a"]).mapInArrow(
        split, "item long, question array<binary>, answer array<binary>")
    rows = rows.withColumn("n", F.size("question") + F.size("answer")).filter("n > 0")
    rows = materialize(rows, "items")
    stats = rows.agg(F.sum("n").alias("words"), F.sum(F.ceil(F.col("n") / SEGMENT)).alias("segments")).first()
    if not stats["words"]:
        return
    shards = math.ceil(stats["words"] / shard_words)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item", "question"), F.lit(shards)))
    word = rows.select("shard", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("w"))
    df = materialize(word.groupBy("w").agg(F.count("*").alias("df")), "terms")
    total, average = stats["segments"], stats["words"] / stats["segments"]
    for shard in range(shards):
        own = rows.filter(F.col("shard") == shard)
        seen = word.filter(F.col("shard") == shard).select("w").distinct().join(df, "w").toArrow()
        weight = {w: math.log(1 + (max(total, n) - n + 0.5) / (n + 0.5))
                  for w, n in zip(seen.column("w").to_pylist(), seen.column("df").to_pylist())}
        got = own.select("item", "question", "answer").orderBy("item", "question").toArrow().to_pylist()
        # rows with the same id (or none) but other texts are items of their own
        yield build_index([((i, r["item"]), r["question"], r["answer"]) for i, r in enumerate(got)], weight, average,
                          threshold, whole)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 question: str = "question", answer: str = "answer", threshold: float = THRESHOLD,
                 shard_words: int = SHARD_WORDS, whole: bool = False) -> DataFrame:
    """One row per input row and test item that its text holds: ``key, _row_id, _row_hash, item_id, score,
    question_overlap, answer_overlap``.

    A text holds an item when four fifths of the five-word runs of its question and of its answer are in it; with
    ``whole`` (question and answer are halves of one text) four fifths of the whole item's runs will do as well.
    Null and empty texts and items hold nothing and are not held; an item without an id is searched like any other and
    reported with a null id; repeated items count once, repeated documents each; an empty table gives no row.  Whole
    texts of any length are searched.
    """
    spark = docs.sparkSession
    schema = f"{key} long, _row_id long, _row_hash long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(docs[text].cast("string").alias("_text"), docs[key].cast("long").alias("_key"), *row_key(key, text))
    found = []
    for index in index_shards(items, item_key, question, answer, shard_words, threshold, whole):
        shared = spark.sparkContext.broadcast(index)      # at most ``shard_words`` words

        def run(batches, shared=shared):
            own = shared.value
            for part in pieces(batches, 2 << 20):
                words = [words_of(t) for t in part.column(0).to_pylist()]
                by_doc: dict = defaultdict(dict)
                for d, s, x in search(own, words, threshold):
                    item = own.item_of[s]
                    by_doc[d][item] = max(by_doc[d].get(item, 0.0), x)
                hits = [(d, i[1], by_doc[d][i], q, a) for d in sorted(by_doc)
                        for i, q, a in verify(own, words[d], sorted(by_doc[d]))]
                at = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in part.columns[1:]), pa.array([h[1] for h in hits], pa.int64()),
                     *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))],
                    names=[c.strip().split()[0] for c in schema.split(",")])
        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def halves(items: DataFrame, text: str = "text") -> DataFrame:
    """``items`` with ``question`` and ``answer`` columns for a table with one text: its first and its second half by words."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D ]+", " ")), " ")
    mid = F.ceil(F.size(words) / 2).cast("int")
    return items.withColumns({"question": F.array_join(F.slice(words, F.lit(1), mid), " "),
                              "answer": F.array_join(F.slice(words, mid + 1, F.size(words)), " ")})


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns unchanged."""
    # the hits take one pass over the text; they are few rows next to the documents
    hits = materialize(contaminated(docs, items, key, text, **options).select("_row_id", "_row_hash").distinct(), "hits")
    a, b = row_key(key, text)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), a, b)
    return marked.join(hits, ["_row_id", "_row_hash"], "left_anti").select("_row.*")
