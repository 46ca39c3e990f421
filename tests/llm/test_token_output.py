import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dpmine.llm import queries, token_output
from dpmine.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow(rows):
    whole, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op9_token_id_output(spark, path).collect())
    assert got == slow(rows)


def test_texts_that_need_the_whole_pipeline():
    texts = ["", "it's 12ab <|endoftext|>x y<|startoftext|>", "a\x1cb c", "ÉTÉ é İ ß ẞ ΣΑΣ中文  x", "l'été\tc'est 3½",
             "\U0001f600 !!?? 'S 'll", "don't\nDON'T   z\x85y", "ŉ Ǆ ɐ"] * 2
    whole = Tokenizer.from_file(PATH)
    enc = token_output.TextEncoder(PATH)
    for some in (texts, [t for t in texts if "\x1c" not in t], texts[:1], ["x" * 5000, "a b"], ["", " \n"], []):
        ids, counts = enc([t.encode() for t in some])
        want = [whole.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n, kinds", [(0, 3), (1, 3), (5000, 1), (5000, 2), (20000, 7), (20000, 3000)])
def test_grammar_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    rules, symbols = token_output.compress(ids, 50000, 4, 64)
    assert np.array_equal(token_output.expand(symbols, rules, 50000), ids)
    row = {"rules": rules.tobytes(), "symbols": symbols.tobytes(), "base": 50000,
           "lengths": token_output.expansion_lengths(rules, 50000).tobytes()}
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, n // 2 + 1), (n, n)):
        assert token_output.block_slice(row, a, min(b, n)).tolist() == ids[a:b].tolist()
    if n >= 5000 and kinds < 10:
        assert len(symbols) < n / 2


def test_blocks_and_odd_rows(spark, odd_docs):
    path = scratch_path(spark, "ids")
    token_output.write_token_ids(odd_docs, path, PATH, 2, block_ids=50)
    got = token_output.read_token_ids(spark, path).orderBy("start").collect()
    want = slow([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert [(r.doc_id, r.start, r.n_tokens) for r in got if r.doc_id != 1] == [w[:3] for w in want if w[0] != 1]
    assert sorted(zlib.crc32(r.ids) for r in got) == sorted(w[3] for w in want)
    assert token_output.token_output(odd_docs.limit(0), PATH).count() == 0
