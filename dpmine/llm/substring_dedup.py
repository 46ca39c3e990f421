"""Repeat removal by fixed-block anchors over words.

Every document is cut into non-overlapping blocks of ``BLOCK`` words; the hashes of all blocks are the index.  Every
rolling window of a block's length probes it, and a hit anchors the windows of ``WINDOW`` words around it: a window
that also occurs in another document holds one of that document's blocks as a whole.  Hits are extended to maximal
repeats by comparing the stretches around equal anchors.

The index is kept as bitmaps, 16 bits and more a block, of up to ``INDEX_BITS`` each: a bitmap holds the blocks of one
range of hashes and is probed by the windows of that range.  It never misses a block, and the probes it lets through by
chance only make more anchors (a chance hit depends on the words alone, so equal windows still agree on their anchors).
A window has an anchor for each range that it hits; a repeated one holds a whole block, so it has one in that block's range.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.llm import repeats
from dpmine.llm.common import cut_words, pieces, utf8, word_hashes
from dpmine.llm.repeats import PrefixHash, Texts
from dpmine.session import materialize

WINDOW = 50
BLOCK = 25               # any window holds at least one whole block of a document that it occurs in
LOT = 1 << 18            # words that are hashed at once
BLOCK_BITS = 16          # of the index for each block, at least: about 1.4 % of windows hit by chance
INDEX_BITS = 1 << 29     # of the index that are broadcast at a time (64 MB)
PROBES = 2


def read_words(texts: list[bytes]) -> Texts:
    """A 64-bit hash per word."""
    data = b" ".join(texts)
    starts, stops = cut_words(np.frombuffer(data, np.uint8))
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return Texts(word_hashes(data, starts, stops)[0], at[:-1], at[1:])


def block_hashes(docs: DataFrame, text: str, block: int) -> DataFrame:
    """``h`` of every non-overlapping block of every document."""
    def run(batches):
        for batch in pieces(batches):
            texts = read_words(utf8(batch.column(0)))
            count = (texts.past - texts.first) // block
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(texts.first, count) + step * block
            h = np.unique(PrefixHash(texts.symbols)(at, at + block))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
    return docs.select(docs[text].cast("string").alias("_text")).mapInArrow(run, "h long")


def index_size(blocks: int, most: int = INDEX_BITS, least: int = 1 << 15) -> tuple[int, int]:
    """(bits of one bitmap, number of hash ranges) for so many blocks; both are powers of two, at most 128 ranges."""
    bits = max(least, 1 << max(0, blocks * BLOCK_BITS - 1).bit_length())
    return min(bits, most), min(128, max(1, bits // most))


def hits(index, window: int, block: int, part: int = 0, ranges: int = 1):
    """Anchors: for each window start the first rolling window in it that is in the index of hash range ``part``; none: -1."""
    def anchors(texts: Texts, hashes: PrefixHash) -> np.ndarray:
        n = len(texts.symbols) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.arange(len(texts.symbols) - block + 1)
        h = hashes(at, at + block)
        inside = np.flatnonzero(h >> np.uint64(65 - ranges.bit_length()) == part) if ranges > 1 else at
        places = np.append(inside[repeats.in_filter(index.value, h[inside], PROBES)], 1 << 62)
        place = places[np.searchsorted(places, np.arange(n))]
        return np.where(place <= np.arange(n) + window - block, place, -1)
    return anchors


def equal_windows(cls, off, symbols, first, n, window):
    """(segment, place, run) of all windows of the segments; equal ones of a class (by hash) have one run number."""
    seg = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    starts = first[seg] + step
    h = PrefixHash(symbols)(starts, starts + window)
    order = np.lexsort((h, cls[seg]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (cls[seg[order[1:]]] != cls[seg[order[:-1]]])
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    return seg, step, run


def cut_words_out(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    """``n_words, n_removed, kept_sha256``."""
    words, at, kept = text.split(), 0, []
    if not len(starts):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    for a, b in zip(starts.tolist(), stops.tolist()):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK,
                   lot: int = LOT, many: int = repeats.MANY, bits: int = INDEX_BITS) -> DataFrame:
    """``_row_id, _row_hash, start, stop``: stretches of words covered by windows that occur in a row with a smaller id."""
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    blocks = materialize(block_hashes(docs, text, block), "blocks")
    size, ranges = index_size(blocks.count(), bits)
    rows = []
    for part in range(ranges):
        # ranges are told by up to seven upper bits; the places of both probes are bits 0 to 56 at most
        own = blocks.filter(F.shiftrightunsigned("h", 65 - ranges.bit_length()) == part) if ranges > 1 else blocks
        index = docs.sparkSession.sparkContext.broadcast(repeats.bit_filter(own, "h", size, PROBES))     # at most ``bits``
        rows.append(repeats.segment_rows(docs, read_words, hits(index, window, block, part, ranges), window, block, lot, key, text))
    rows = reduce(DataFrame.union, rows)
    return repeats.repeated(rows, docs, read_words, window, equal_windows, "u8", True, key, text, many)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK,
                   lot: int = LOT, many: int = repeats.MANY, bits: int = INDEX_BITS) -> DataFrame:
    """One row per input row: ``key, n_words, n_removed, kept_sha256``.

    Removed is each word covered by a window of ``window`` words that also starts in a row with a smaller id (a null id
    is the smallest; rows with one id don't remove from each other).  Null and empty texts have no words; an empty
    table gives none; other columns play no part.
    """
    found = repeated_words(docs, key, text, window, block, lot, many, bits)
    return repeats.without(docs, found, cut_words_out, "n_words long, n_removed long, kept_sha256 string", key, text)
