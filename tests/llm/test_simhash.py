import re

import numpy as np
import pytest
import xxhash

from dpmine.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, slow_components(fps))}
    got = [tuple(r) for r in queries.op8_simhash_near_dedup(spark, path).collect()]
    assert len(got) == len(rows) and set(got) == want


@pytest.mark.parametrize("tile", [7, 64, 1000])
def test_tiles_find_every_link(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 1 << 63, 40)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.integers(0, 60, n)) for b in base for n in range(6)}
    fps |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)} | {0, 1, 3, -1}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.node: r.component for r in simhash.components(simhash.fingerprint_links(frame, 3, tile)).collect()}
    want = slow_components([f & (2**64 - 1) for f in fps])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_forest_is_small_for_a_large_group():
    fps = np.array([1 << i for i in range(60)] + [(1 << i) | (1 << j) for i in range(60) for j in range(i)], np.uint64)
    u, v = simhash.linked_forest(fps, np.arange(len(fps)), None, None, 3)
    assert len(u) == len(fps) - 1 and len(set(v.tolist())) == 1


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[2] == 1 and by_id[5] == 4 and by_id[6] == 4 and by_id[8] == 7
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids.count((False, 1)) == 1 and (False, 2) not in ids and (True, 0) in ids


def test_empty_table(spark, odd_docs):
    none = odd_docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203
