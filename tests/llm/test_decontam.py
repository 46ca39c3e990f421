import math
import random
from collections import Counter

import pytest

from dpmine.llm import decontam, queries


def brute_scores(items, weight, average, words):
    out = []
    for _, q, a in items:
        whole = q + a
        count = max(1, math.ceil(len(whole) / decontam.SEGMENT))
        for part in range(count if whole else 0):
            tf = Counter(whole[part * len(whole) // count:(part + 1) * len(whole) // count])
            n = sum(tf.values())
            one = lambda w: weight[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * n / average))
            out.append(sum(one(w) for w in tf if w in words) / sum(one(w) for w in tf))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7))}".encode() for _ in range(4000)]
    items = [(i, rng.choices(vocab, k=rng.randint(0, 90)), rng.choices(vocab, k=rng.randint(0, 40))) for i in range(60)]
    df = Counter(w for _, q, a in items for w in set(q + a))
    weight = {w: math.log(1 + (max(60, n) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    index = decontam.build_index(items, weight, 40.0, 0.4)
    docs = [rng.choices(vocab, k=rng.choice([0, 3, 64, 65, 300])) + (items[i][1] if i % 3 else []) for i in range(60)]
    got = {(d, s): x for d, s, x in decontam.search(index, docs, 0.4)}
    want = {}
    for d, words in enumerate(docs):
        last = max(1, math.ceil(len(words) / 64))
        for c in range(max(1, last - 1)):
            for s, x in enumerate(brute_scores(items, weight, 40.0, set(words[64 * c:64 * (c + 2)]))):
                if x >= 0.4:
                    want[d, s] = max(want.get((d, s), 0), x)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert len(want) > 5


def test_query_finds_every_planted_passage(spark):
    path = "/root/testdata/sf0.1"
    got = {(r.doc_id, r.item_id) for r in queries.op1_benchmark_decontamination(spark, path).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    planted = {(d, i) for d, t in docs for i, x in items if x in t}
    assert planted <= got
    for d, i in got - planted:                       # the others hold four fifths of the item's runs
        words, item = (decontam.runs_of(decontam.words_of(x)) for x in (dict(docs)[d], dict(items)[i]))
        assert len(words & item) >= 0.7 * len(item)
    assert len(planted) > 100


def test_long_items_shards_and_odd_rows(spark, odd_docs):
    long_text = " ".join(f"w{i % 977}" for i in range(20000))
    items = spark.createDataFrame(
        [(1, "The QUICK brown fox jumps over", "the lazy dog and runs far away!"), (2, long_text[3000:6000], long_text[6000:9000]),
         (3, None, None), (4, "", "one two"), (5, "never seen anywhere in text", "at all"), (None, "one", "two"),
         (1, "The QUICK brown fox jumps over", "the lazy dog and runs far away!"), (6, "the quick brown", "cat sleeps all day")],
        "item_id long, question string, answer string")
    want = {(1, 1), (2, 1), (3, 1), (7, 2), (8, 2), (10, 4), (10, None)}
    for shard_words in (10**6, 300):
        rows = decontam.contaminated(odd_docs, items, shard_words=shard_words).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert len(rows) == 8                        # the repeated document counts twice
    kept = decontam.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 7
    assert kept.filter("doc_id is null").count() == 1
    assert decontam.contaminated(odd_docs, items.limit(0)).count() == 0
    assert decontam.contaminated(odd_docs.limit(0), items).count() == 0


def test_halves(spark):
    rows = spark.createDataFrame([(1, " a b\n c "), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    got = {r.item_id: (r.question, r.answer) for r in decontam.halves(rows).collect()}
    assert got == {1: ("a b", "c"), 2: ("", ""), 3: ("", ""), 4: ("x", "")}


def test_most_of_a_one_text_item(spark):
    """The first 85 of 100 words hold the item as a whole, though not four fifths of its second half."""
    words = [f"w{i}" for i in range(100)]
    items = decontam.halves(spark.createDataFrame([(1, " ".join(words)), (None, " ".join(f"v{i}" for i in range(40)))], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[:85]) + " z"), (2, " ".join(words[:75])), (3, " ".join(f"v{i}" for i in range(36))),
                                  (4, "w1 w2 clean text")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, whole=True).collect()} == {(1, 1), (3, None)}
    assert {r.doc_id for r in decontam.contaminated(docs, items).collect()} == set()
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items, whole=True).collect()) == [2, 4]
