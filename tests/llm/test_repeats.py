import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from dpmine.llm import queries, repeats, substring_dedup, suffix_dedup


def brute_bytes(rows, window=200):
    seen = defaultdict(int)
    data = [(key, (text or "").encode()) for key, text in rows]
    for _, t in data:
        for p in range(len(t) - window + 1):
            seen[t[p:p + window]] += 1
    out = []
    for key, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if seen[t[p:p + window]] > 1:
                gone[p:p + window] = True
        edge = np.diff(gone.astype(int), prepend=0)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((key, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window=50):
    first = {}
    data = [(key, (text or "").encode().split()) for key, text in rows]
    low = lambda key: -1 if key is None else key
    for key, w in data:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, 1 << 60), low(key))
    out = []
    for key, w in data:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < low(key):
                gone.update(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def tangled(seed, n=60, letters="abc", unit=1, length=400):
    """Documents cut together from few pieces, with edits, copies and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(letters, k=unit))
    pieces = [[word() for _ in range(rng.randint(5, length // 3))] for _ in range(8)] + [[word()] * length]
    docs = []
    for i in range(n):
        doc = []
        while len(doc) < rng.randint(0, length):
            piece = rng.choice(pieces)
            a = rng.randint(0, len(piece) - 1)
            doc += piece[a:a + rng.randint(1, length // 2)]
            if rng.random() < 0.4:
                doc.append(word())
        docs.append((i, doc))
    return docs + [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 5)]


@pytest.mark.parametrize("seed, lot, many", [(1, 1 << 20, 2000), (2, 300, 2000), (3, 1 << 20, 2), (4, 150, 0)])
def test_bytes_equal_brute_force(spark, seed, lot, many):
    rows = [(k, "".join(d)) for k, d in tangled(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, window=40, gram=8, lot=lot, many=many).collect()), key=repr)
    want = brute_bytes(rows, 40)
    assert got == want and any(w[2] for w in want) and any(w[1] > w[2] for w in want)


@pytest.mark.parametrize("seed, lot, many, bits", [(1, 1 << 18, 2000, 1 << 20), (2, 60, 2000, 1 << 15), (3, 1 << 18, 2, 1 << 15), (4, 45, 0, 1 << 20)])
def test_words_equal_brute_force(spark, seed, lot, many, bits):
    rows = [(k, " ".join(d)) for k, d in tangled(seed, letters="abcdef", unit=3, length=200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, window=20, block=10, lot=lot, many=many, bits=bits).collect()), key=repr)
    want = brute_words(rows, 20)
    assert got == want and any(w[2] for w in want) and any(w[1] > w[2] for w in want)


def test_index_grows_with_the_blocks(spark, monkeypatch):
    assert substring_dedup.index_size(0) == (1 << 15, 1) and substring_dedup.index_size(3_000_000) == (1 << 26, 1)
    assert substring_dedup.index_size(200_000_000) == (1 << 29, 8) and substring_dedup.index_size(1 << 60) == (1 << 29, 128)
    monkeypatch.setattr(substring_dedup, "BLOCK_BITS", 128)      # several ranges for few blocks
    sizes = []
    size = substring_dedup.index_size
    monkeypatch.setattr(substring_dedup, "index_size", lambda *a: sizes.append(size(*a)) or sizes[-1])
    rows = [(k, " ".join(d)) for k, d in tangled(6, letters="abcdef", unit=3, length=200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, window=20, block=10, bits=1 << 15).collect()), key=repr)
    assert got == brute_words(rows, 20) and sizes[0][1] > 1


def test_class_of_thousands_of_segments_is_sorted_in_parts(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=260))
    mark = lambda: "".join(rng.choices("xyz", k=3))
    rows = [(i, mark() * rng.randint(0, 4) + passage[rng.choice([0, 0, 30]):rng.choice([240, 260, 260])] + mark() + str(i))
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, many=400).collect()), key=repr)
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("many", [repeats.MANY, 0])
def test_passage_repeated_inside_a_document(spark, many):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    p = words("p", 100)
    twice = words("y", 30) + p + words("z", 30) + p + words("v", 30)
    rows = [(1, p[:60] + words("x", 40)), (2, twice), (2, words("u", 7) + p + words("t", 9)), (3, words("s", 5) + p)]
    rows = [(k, " ".join(d)) for k, d in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, many=many).collect()), key=repr)
    assert got == brute_words(rows) and [r[2] for r in got if r[0] == 2 and r[1] == 290] == [120]


def test_suffix_sort():
    rng = np.random.default_rng(3)
    for _ in range(40):
        symbols = rng.integers(97, 99, 300).astype(np.uint8)
        starts = rng.integers(0, 260, int(rng.integers(0, 200)))
        group = np.sort(rng.integers(0, 5, len(starts)))
        order = suffix_dedup.sort_suffixes(symbols, repeats.PrefixHash(symbols), starts, group, 40)
        keys = [(int(g), symbols[s:s + 40].tobytes()) for g, s in zip(group, starts)]
        assert [keys[i] for i in order] == sorted(keys) and sorted(order.tolist()) == list(range(len(starts)))
    a, b = np.array([0, 5]), np.array([0, 7])
    text = np.frombuffer(b"abcdeabcdeabcxe", np.uint8)
    assert suffix_dedup.common_extension(repeats.PrefixHash(text), a, np.array([5, 0]), 10).tolist() == [8, 8]
    assert suffix_dedup.common_extension(repeats.PrefixHash(text), a, b, 8).tolist() == [8, 0]


def test_queries_equal_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op5_suffix_array_dedup(spark, path).collect()), key=repr)
    assert got == brute_bytes(rows)
    got = sorted((tuple(r) for r in queries.op7_substring_dedup(spark, path).collect()), key=repr)
    assert got == brute_words(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(odd_docs, window=60, gram=10).collect()), key=repr)
    assert got == brute_bytes(rows, 60)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(odd_docs, window=10, block=5).collect()), key=repr)
    assert got == brute_words(rows, 10)
    none = odd_docs.limit(0)
    assert suffix_dedup.remove_repeats(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(odd_docs, window=10, block=6)
