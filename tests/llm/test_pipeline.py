import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from dpmine.llm import decontam, langid
from tests.llm.test_simhash import slow_components, slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_tokens(rows):
    whole, start, out = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER)), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_every_stage_on_its_own_input(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(docs)
    items = [(r.item_id, *(decontam.words_of(x) for x in (r.question, r.answer)))
             for r in decontam.halves(spark.read.parquet(f"{path}/benchmark.parquet")).collect()]
    parts = [(decontam.runs_of(q), decontam.runs_of(a)) for _, q, a in items]
    for n, (name, stage) in enumerate(P.STAGES):
        got = P.materialize(stage(spark, docs, path), f"test-{n}")
        before, after = ([tuple(r) for r in d.collect()] for d in (docs, got))
        if n < 4:
            assert got.columns == COLUMNS
        if n == 0:
            rejected = langid.predict(model, [r[1] for r in before])[3]
            want = [r for r, x in zip(before, rejected) if not x]
            assert len(want) > 0.95 * len(before)
        elif n == 1:
            before.sort()
            roots = slow_components([slow_fingerprint(r[1]) for r in before])
            want = [r for i, r in enumerate(before) if roots[i] == i]
            assert len(want) < len(before)
        elif n == 2:
            want = []
            for r in before:
                runs = decontam.runs_of(decontam.words_of(r[1]))
                if not any(all(len(x & runs) >= 0.8 * len(x) for x in part) for part in parts):
                    want.append(r)
            assert len(want) < len(before)
        elif n == 3:
            times = Counter(after)
            assert set(times) <= set(before) and max(times.values()) <= 3
            sizes = defaultdict(int)
            for r in before:
                sizes[r[3]] += len(r[1].encode().split())
            taken = defaultdict(int)
            for r, k in times.items():
                taken[r[3]] += k * len(r[1].encode().split())
            weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
            from dpmine.llm.mixing import targets
            aim = targets(dict(sizes), weights)
            assert sum(abs(taken[s] - aim[s]) for s in aim) < 0.05 * sum(sizes.values())
            want = after
        else:
            assert sorted(after) == sorted(brute_tokens([(r[0], r[1]) for r in before]))
            want = after
        assert sorted(after) == sorted(want)
        docs = got
    assert sorted(tuple(r) for r in P.run(spark, path).collect()) == sorted(after)


def test_odd_rows_and_empty_table(spark, odd_docs):
    path = "/root/testdata/sf0.001"
    for docs in (odd_docs, odd_docs.limit(0)):
        columns = docs.columns
        for n, (name, stage) in enumerate(P.STAGES):
            docs = P.materialize(stage(spark, docs, path), f"odd-{n}")
            assert n == 4 or docs.columns == columns
        assert docs.filter(F.col("n_tokens") < 1).count() == 0
