import random

import numpy as np
import public_tokenizers

from dpmine.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(vocabulary, word, prefix):
    text, n, longest = prefix + word, 0, max(map(len, vocabulary))
    while text:
        size = next((k for k in range(min(longest, len(text)), 0, -1) if text[:k] in vocabulary), 0)
        if not size:
            return 1
        text, n = text[size:], n + 1
    return n


def test_automaton_equals_greedy_match():
    rng = random.Random(1)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abc"
        vocabulary = {"".join(rng.choices(letters + "_", k=rng.randint(1, 5))).encode() for _ in range(rng.randint(1, 14))}
        auto = token_counts.Automaton(sorted(vocabulary), b"_" if trial % 3 else b"")
        words = ["".join(rng.choices(letters, k=rng.randint(1, 12))).encode() for _ in range(80)] + [b"a" * 100, b"ab" * 70]
        want = [greedy(vocabulary, w, auto.prefix) for w in words]
        assert [auto.count(w) for w in words] == want
        codes = np.frombuffer(b" ".join(words), np.uint8)
        stops = np.cumsum([len(w) + 1 for w in words]) - 1
        assert auto.counts(codes, stops - [len(w) for w in words], stops).tolist() == want


def test_query_equals_greedy_match(spark):
    path = "/root/testdata/sf0.001"
    vocabulary = set(token_counts.sentencepiece_vocabulary(PATH))
    assert all(bytes([b]) in vocabulary for b in range(256))
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    known = {}
    got = queries.op3_token_counts(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        words = docs[r.doc_id].split()
        for w in words:
            if w not in known:
                known[w] = greedy(vocabulary, w, "▁".encode())
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_odd_rows(spark, odd_docs):
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(odd_docs, PATH).collect()]
    assert len(got) == odd_docs.count() and {g[0]: g[1:] for g in got if g[0] in (4, 5, 6)} == {k: (0, 0) for k in (4, 5, 6)}
    assert token_counts.token_counts(odd_docs.limit(0), PATH).count() == 0
    auto = token_counts.automaton(PATH)
    words, tokens = token_counts.text_counts(auto, [b"x" * 9000 + b" ab", b"", b"ab"])
    assert words.tolist() == [2, 0, 1] and tokens[0] == auto.count(b"x" * 9000) + tokens[2]
