"""Token-id output: documents -> ids -> Re-Pair grammar blocks in Parquet -> ids again, by block or by position.

File format: a Parquet folder with one row per block.  Blocks follow each other by ``shard, block``, documents by id.
``rules`` (uint32 pairs; rule r makes symbol ``base + r``), ``symbols`` (uint32 sequence) and ``lengths`` (uint32,
expansion length of each rule) are little-endian binaries; ``doc_ids`` and ``doc_lengths`` list the block's documents;
``shard_ids`` counts the ids of the shard before the block.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dpmine.llm.common import LONGEST_WORD, cut_words, distinct_words, forget_garbage, pieces, utf8
from dpmine.session import scratch_path

BLOCK_IDS = 1 << 20      # ids of a block, but for a document that is longer by itself
MIN_COUNT = 64           # a pair is replaced while it occurs that often in its block
PAIRS = 4096             # pairs replaced in one pass over a block
CACHE_WORDS = 1_000_000  # distinct words that a worker keeps encoded (as numbers, some 50 bytes each)
CACHE_PARTS = 150_000    # distinct parts of words that it keeps (as text, some 250 bytes each)
MIN_GAIN = 0.005         # a pass that shortens its block by a smaller share is the last one
_HASH_BITS = 18
_MOST = 1 << 16          # counts of pairs are told apart up to here
_SEPARATORS = "\x1c\x1d\x1e\x1f"     # white space to Python's str.split, not to the tokenizer
_BLOCK_SCHEMA = ("shard int, block int, shard_ids long, n_ids long, base long, rules binary, symbols binary, "
                 "lengths binary, doc_ids array<long>, doc_lengths array<long>")


def _byte_alphabet() -> dict[int, str]:
    """Code point -> its UTF-8 bytes in the printable byte alphabet of byte-level BPE, for Latin letters (below U+0250)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0x250)}


class TextEncoder:
    """Ids of whole texts by the tokenizers library, with every distinct word encoded once per worker.

    Words can be encoded apart when the file normalises by NFC, white-space folding and lower-casing and cuts at white
    space without looking across it; a file of another shape goes through the library text by text.  Words are cut at
    ASCII white space and looked up by a 128-bit hash in a sorted table; new Latin words are normalised and cut by the
    file's own pattern, and each distinct part goes through the library's model.  New words with an added token, a
    letter beyond U+024F, a dotted capital I or a separator that only Python takes for white space go through the
    library as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                        and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
                        and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
                        and not any(x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]))
        if self.by_word:
            self.split = regex.compile(pre[0]["pattern"]["Regex"] + r"|\n")
            self.added = [x["content"] for x in spec["added_tokens"]]
            self.alphabet = _byte_alphabet()
            self.tokenize = self.whole.model.tokenize
            self._reset()

    def _reset(self):
        # number of a word: its row in the pool; the table is sorted by the first hash
        self.hashes, self.checks, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.word_ids = _Pool()
        self._reset_parts()

    def _reset_parts(self):
        self.part_ids = _Pool()
        self.parts = _Numbers({"\n": 0})                # parts a word from the next, no id
        self.part_ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin words: normalised and cut here, every distinct part through the library's model."""
        if len(self.parts) > CACHE_PARTS:
            self._reset_parts()
        cut = self.split.findall("\n".join(words).lower() + "\n")
        at = np.fromiter(map(self.parts.__getitem__, cut), np.int64, len(cut))
        tokenize, alphabet = self.tokenize, self.alphabet
        self.part_ids.add(*_flat([[t.id for t in tokenize(p if p.isascii() else p.translate(alphabet))]
                                  for p in self.parts.taken()]))
        ids, sizes = self.part_ids.of(at)
        return ids, np.diff(np.cumsum(sizes)[at == 0], prepend=0)

    def _learn(self, words: list[str]) -> None:
        """Give the next numbers of ``word_ids`` to ``words``."""
        whole = np.array([not (w.isascii() or (max(w) < "ɐ" and "İ" not in w)) for w in words], bool)
        text = "\n".join(words)
        odd = [x for x in [*self.added, *_SEPARATORS] if x in text]
        if odd:
            whole |= np.array([any(x in w for x in odd) for w in words], bool)
        plain = [w for w, x in zip(words, whole.tolist()) if not x]
        other = [w for w, x in zip(words, whole.tolist()) if x]
        a, n = self._plain(plain) if plain else _flat([])
        b, m = _flat([e.ids for e in self.whole.encode_batch(other, add_special_tokens=False)])
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[~whole], sizes[whole] = n, m
        starts[~whole], starts[whole] = np.cumsum(n) - n, np.cumsum(m) - m + len(a)
        self.word_ids.add(*ragged(np.concatenate([a, b]), starts, sizes))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 ``texts`` one after the other, and their number in each."""
        data = b" ".join(texts)
        codes = np.frombuffer(data, np.uint8)
        starts, stops = cut_words(codes)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = None
        if self.by_word and int((stops - starts).max()) <= LONGEST_WORD:
            if len(self.numbers) > CACHE_WORDS:
                self._reset()
            found = self._look_up(data, starts, stops)
        if found is None:
            return _flat([e.ids for e in self.whole.encode_batch([t.decode("utf-8", "replace") for t in texts],
                                                                 add_special_tokens=False)])
        ids, sizes = self.word_ids.of(found)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)])

    def _look_up(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray | None:
        """The number of every word, new ones learnt; None where hashes can't tell the words apart."""
        words = distinct_words(data, starts, stops)
        if words is None:
            return None
        first, kinds, check, group = words
        row = np.minimum(np.searchsorted(self.hashes, kinds), max(len(self.hashes) - 1, 0))
        known = self.hashes[row] == kinds if len(self.hashes) else np.zeros(len(kinds), bool)
        if (self.checks[row[known]] != check[known]).any():
            return None
        number = np.empty(len(kinds), np.int64)
        number[known] = self.numbers[row[known]]
        new = first[~known]
        if len(new):
            number[~known] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self._learn([data[x:y].decode("utf-8", "replace") for x, y in zip(starts[new].tolist(), stops[new].tolist())])
            keys = np.concatenate([self.hashes, kinds[~known]])
            by_hash = np.argsort(keys, kind="stable")
            self.hashes = keys[by_hash]
            self.checks = np.concatenate([self.checks, check[~known]])[by_hash]
            self.numbers = np.concatenate([self.numbers, number[~known]])[by_hash]
        return number[group]


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    fresh: list

    def __init__(self, known: dict):
        super().__init__(known)
        self.fresh = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def taken(self) -> list[str]:
        """Keys numbered since the last call."""
        out, self.fresh = self.fresh, []
        return out


class _Pool:
    """Sequences of ids by number, stored one after the other; the space doubles when it is full."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends, self.count = np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.ends[self.count + 1:self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.count = self.used + len(ids), self.count + len(sizes)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.ends[at]
        return ragged(self.ids, starts, self.ends[at + 1] - starts)


def _flat(found: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``pool[start:start + size]`` one after the other, and the sizes."""
    total = int(sizes.sum())
    step = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) if total else starts[:0]
    return pool[step + np.arange(total)], sizes


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a file, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair of one block: (rules (r, 2), symbols), both uint32; symbol ``base + r`` stands for the pair of rule r.

    A pass counts all neighbouring pairs, makes rules of up to ``pairs`` of the most frequent ones and replaces them
    from left to right; passes go on until no pair occurs ``min_count`` times or one shortens the block by less
    than ``MIN_GAIN``.
    """
    s, rules, n_rules = ids.astype(np.uint32), [], 0
    owner = np.empty(1 << _HASH_BITS, np.uint64)
    while len(s) > min_count:
        slot = ((s[:-1] * np.uint32(2654435761)) ^ (s[1:] * np.uint32(2246822519))) >> np.uint32(32 - _HASH_BITS)
        heat = np.bincount(slot, minlength=len(owner))
        often = np.cumsum(np.bincount(np.minimum(heat, _MOST))[::-1])      # slots by falling count
        least = max(min_count, len(often) - 1 - int(np.searchsorted(often, pairs, "right")))
        where = np.flatnonzero((heat >= least)[slot])
        # a slot stands for one of its pairs in this pass; others that fall into it wait for a later one
        slot = slot[where]
        key = s[where].astype(np.uint64) << np.uint64(32) | s[where + 1]
        owner[slot] = key
        own = owner[slot] == key
        where, slot = where[own], slot[own]
        good = np.bincount(slot, minlength=len(owner))[slot] >= min_count
        where, slot = where[good], slot[good]
        # a run of overlapping pairs gives every other one, from its left end
        n = np.arange(len(where))
        head = np.maximum.accumulate(np.where(np.diff(where, prepend=-2) != 1, n, 0)) if len(where) else n
        pick = (n - head) % 2 == 0
        where, slot = where[pick], slot[pick]
        used = np.bincount(slot, minlength=len(owner)) >= 2
        kept = used[slot]
        where, slot = where[kept], slot[kept]
        if not len(where):
            break
        made = owner[np.flatnonzero(used)]
        names = (np.cumsum(used) + (base + n_rules - 1)).astype(np.uint32)
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        s = s.copy()
        s[where] = names[slot]
        n_rules += len(made)
        stay = np.ones(len(s), bool)
        stay[where + 1] = False
        s = s[stay]
        if len(where) < MIN_GAIN * len(stay):
            break
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), s


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((1 if a < base else size[a - base]) + (1 if b < base else size[b - base]))
    return np.array(size, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    whole: list[list[int]] = []
    for a, b in rules.tolist():
        whole.append(([a] if a < base else whole[a - base]) + ([b] if b < base else whole[b - base]))
    sizes = np.array([len(x) for x in whole], np.int64)
    pool = np.concatenate([np.fromiter(chain.from_iterable(whole), np.uint32), symbols]).astype(np.uint32)
    pair = symbols >= base
    at, size = np.arange(len(symbols)) + int(sizes.sum()), np.ones(len(symbols), np.int64)
    if len(whole):
        starts = np.cumsum(sizes) - sizes
        rule = symbols[pair].astype(np.int64) - base
        at[pair], size[pair] = starts[rule], sizes[rule]
    return ragged(pool, at, size)[0]


def block_slice(row, start: int, stop: int) -> np.ndarray:
    """Ids ``start .. stop - 1`` of a stored block; only the symbols that cover them are expanded."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    symbols, lengths, base = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["lengths"], "<u4"), row["base"]
    size = np.ones(len(symbols), np.int64)
    pair = symbols >= base
    size[pair] = lengths[symbols[pair].astype(np.int64) - base]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skip = start - (int(ends[a - 1]) if a else 0)
    todo, out = symbols[a:b + 1].tolist()[::-1], []
    while todo and len(out) < skip + stop - start:
        x = todo.pop()
        if x < base:
            out.append(x)
        else:
            todo += [int(rules[x - base][1]), int(rules[x - base][0])]
    return np.array(out[skip:skip + stop - start], np.uint32)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id",
                    text: str = "text", block_ids: int = BLOCK_IDS, min_count: int = MIN_COUNT) -> None:
    """Write the ids of every text (null: empty) and ``end_id`` after each, by ascending ``key`` (nulls first).

    Texts are dealt by ranges of the key (equal keys by text hash); a task encodes its range in order and writes a
    block whenever ``block_ids`` ids are there, so it holds one block and one slice of texts.
    """
    def run(batches):
        forget_garbage()                # of the stages that this worker served before
        enc, shard, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        base = max(enc.whole.get_vocab_size(), end_id + 1)
        held, sizes, keys, n = [], [], [], 0

        def cut():
            nonlocal held, sizes, keys, n, block, before
            rules, symbols = compress(np.concatenate(held), base, min_count)
            row = [shard, block, before, n, base, rules.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(),
                   expansion_lengths(rules, base).astype("<u4").tobytes(), keys, sizes]
            block, before, held, sizes, keys, n = block + 1, before + n, [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                        pa.binary(), pa.binary(), pa.binary(),
                                                        pa.list_(pa.int64()), pa.list_(pa.int64())])],
                names=[x.split()[0] for x in _BLOCK_SCHEMA.split(", ")])

        for part in pieces(batches):
            ids, counts = enc(utf8(part.column(1)))
            ends = np.cumsum(counts)
            for doc, e, c in zip(part.column(0).to_pylist(), ends.tolist(), counts.tolist()):
                held += [ids[e - c:e], np.array([end_id], np.uint32)]
                sizes.append(c + 1)
                keys.append(doc)
                n += c + 1
                if n >= block_ids:
                    yield cut()
        if keys:
            yield cut()

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    order = ["_key", F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, _BLOCK_SCHEMA).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per stored document: ``key, start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary
    little-endian uint32) or, with ``digest``, their ``ids_crc32``."""
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
                             row["base"]).astype("<u4")
                sizes = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                cut = zlib.crc32 if digest else bytes
                for a in range(0, len(sizes), 512):
                    e, s = ends[a:a + 512], sizes[a:a + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:a + 512], pa.int64()), pa.array(e - s + row["start"]), pa.array(s),
                         pa.array([cut(raw[4 * (y - x):4 * y]) for x, y in zip(s.tolist(), e.tolist())],
                                  pa.int64() if digest else pa.binary())],
                        names=[key, "start", "n_tokens", last])
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(path)
    # one row per writing task
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    placed = blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("at") + F.col("shard_ids"))
    return placed.select("start", "base", "rules", "symbols", "doc_ids", "doc_lengths").mapInArrow(
        run, f"{key} long, start long, n_tokens long, {last} {kind}")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` (``doc_id, text``) to ``path`` (a new folder by default) and read the files back.

    One row per input row, repeated and null ids included (nulls come first); an empty table gives none; other columns
    play no part.  ``ids_crc32`` is the CRC-32 of the document's ids as little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer, end_id)
    return read_token_ids(spark, path, digest=True)
