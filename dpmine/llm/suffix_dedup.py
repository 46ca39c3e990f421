"""Repeat removal by hash-compared suffix sorting of bytes.

Suffixes are grouped by an anchor: the smallest hash of ``GRAM`` bytes in their first ``WINDOW`` bytes.  Suffixes with
equal windows have equal anchors, so the groups are sorted apart: a bottom-up mergesort whose comparisons find the
common extension of two suffixes by binary search over prefix polynomial hashes.  Neighbours in suffix order with a
common extension of a window are compared byte by byte before they count.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from dpmine.llm import repeats
from dpmine.llm.repeats import PrefixHash, Texts

WINDOW = 200
GRAM = 32
LOT = 1 << 19            # bytes that are hashed at once


def read_bytes(texts: list[bytes]) -> Texts:
    past = np.cumsum([len(t) for t in texts])
    return Texts(np.frombuffer(b"".join(texts), np.uint8), past - [len(t) for t in texts], past)


def smallest_grams(window: int, gram: int):
    """Anchors: for each window start the leftmost place of the smallest ``gram`` hash inside the window."""
    span, low = window - gram + 1, 22

    def anchors(texts: Texts, hashes: PrefixHash) -> np.ndarray:
        n = len(texts.symbols) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.arange(len(texts.symbols) - gram + 1)
        ranked = hashes(at, at + gram) >> np.uint64(low) << np.uint64(low) | at.astype(np.uint64)
        padded = np.concatenate([ranked, np.full(-len(ranked) % span, ~np.uint64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1:span - 1 + n])
        return (least & np.uint64((1 << low) - 1)).astype(np.int64)
    return anchors


def common_extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``most``, by binary search over hashes."""
    sums, low, step = hashes.sums, np.zeros(len(a), np.int64), 1 << (most.bit_length() - 1)
    at_a, at_b, by_a, by_b = sums[a], sums[b], hashes.inverse[a], hashes.inverse[b]
    while step:
        further = low + step
        end = np.minimum(further, most)
        same = ((sums[a + end] - at_a) * by_a == (sums[b + end] - at_b) * by_b) & (further <= most)
        low[same] += step
        step >>= 1
    return low


def sort_suffixes(symbols: np.ndarray, hashes: PrefixHash, starts: np.ndarray, group: np.ndarray, most: int,
                  whole: np.ndarray | None = None) -> np.ndarray:
    """Order of ``starts`` by (group, first ``most`` symbols); ``group`` must be ascending.

    Mergesort in all groups at once: the place of a suffix in a merged run is its place in its own run and the number
    of suffixes before it in the neighbouring run, found by binary search; a comparison takes a common extension, unless
    the hashes of the first ``most`` symbols (``whole``) are equal.
    """
    n = len(starts)
    whole = hashes.raw(starts, starts + most) if whole is None else whole
    order = np.arange(n)
    head = np.flatnonzero(np.diff(group, prepend=group[:1] - 1) != 0) if n else order
    size = np.diff(np.append(head, n))
    of = np.repeat(np.arange(len(head)), size)
    base, size = head[of], size[of]
    place = np.arange(n) - base
    run = 1
    while n and run < size.max():
        busy = np.flatnonzero(size > run)
        own = place[busy] // run
        left = own % 2 == 0
        lo = np.minimum((own ^ 1) * run, size[busy])
        hi = np.minimum(lo + run, size[busy])
        begin = lo.copy()
        mine = order[busy]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            own_one, other = mine[todo], order[base[busy[todo]] + mid]
            before = ~left[todo]                         # equal suffixes of the left run come first
            differ = np.flatnonzero(whole[own_one] != whole[other])
            x, y = starts[own_one[differ]], starts[other[differ]]
            k = np.minimum(common_extension(hashes, x, y, most), most - 1)
            before[differ] = symbols[y + k] < symbols[x + k]
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        target = base[busy] + own // 2 * 2 * run + (place[busy] - own * run) + (lo - begin)
        moved = order.copy()
        moved[target] = order[busy]
        order = moved
        run *= 2
    return order


def equal_windows(cls, off, symbols, first, n, window):
    """(segment, place, run) of all windows of the segments; equal ones of a class have one run number, by suffix sorting.

    Equal windows have their anchor at the same distance, so suffixes are sorted apart by class and distance.
    """
    seg = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    group = np.unique(cls, return_inverse=True)[1][seg] * window + off[seg] - step
    by_group = np.argsort(group, kind="stable")
    seg, step, group = seg[by_group], step[by_group], group[by_group]
    hashes = PrefixHash(symbols)
    starts = first[seg] + step
    whole = hashes.raw(starts, starts + window)
    order = sort_suffixes(symbols, hashes, starts, group, window, whole)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (whole[a] == whole[b]))
    x, y, equal = starts[a[near]], starts[b[near]], np.ones(len(near), bool)
    eights = np.ndarray(max(0, len(symbols) - 7), "<u8", symbols.tobytes(), strides=(1,))
    for at in [*range(0, window - 8, 8), window - 8]:    # collision verification, eight bytes at a time
        equal &= eights[x + at] == eights[y + at]
    fresh = np.ones(len(order), bool)
    fresh[near[equal] + 1] = False
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(fresh) - 1
    return seg, step, run


def cut_bytes(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    """``n_bytes, n_removed, n_spans, kept_sha256``."""
    kept, at, gone = hashlib.sha256(), 0, 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        kept.update(memoryview(text)[at:a])
        at, gone = b, gone + b - a
    kept.update(memoryview(text)[at:])
    return len(text), gone, len(starts), kept.hexdigest()


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   lot: int = LOT, many: int = repeats.MANY) -> DataFrame:
    """``_row_id, _row_hash, start, stop``: byte stretches covered by windows that also start anywhere else (they may overlap)."""
    rows = repeats.segment_rows(docs, read_bytes, smallest_grams(window, gram), window, gram, lot, key, text)
    return repeats.repeated(rows, docs, read_bytes, window, equal_windows, "u1", False, key, text, many)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   lot: int = LOT, many: int = repeats.MANY) -> DataFrame:
    """One row per input row: ``key, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte covered by a ``window``-byte string (eight bytes at least) that also starts elsewhere, in the same or another row.
    Null and empty texts have no bytes; of repeated rows all count, so both lose what they share; texts shorter than a
    window keep all; an empty table gives none; other columns play no part.
    """
    found = repeated_bytes(docs, key, text, window, gram, lot, many)
    return repeats.without(docs, found, cut_bytes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", key, text)
