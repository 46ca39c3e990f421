"""G1-G8, B5 against a plain-Python scan of the same token rule."""

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from dpmine.functions import text as TF
from dpmine.operators import text as TX

TEXTS = ["", "   ", "  lead and trail  ", "combining é marks", "emoji 👍🏽 ok!", "tab\tand\nnewline",
         "a-b", "Hello, World. Über Straße", "x"]


def _kind(char):
    """w: letter, number or mark; gap: separator or control; else a token of its own."""
    major = unicodedata.category(char)[0]
    return "w" if major in "LNM" else "gap" if major in "ZC" else "one"


def python_tokens(text):
    """(token, token with the gap after it, span), from a scan by Unicode category."""
    starts, at = [], 0
    for kind, run in itertools.groupby(text, _kind):
        size = len(list(run))
        if kind == "w":
            starts.append((at, at + size))
        elif kind == "one":
            starts += [(at + k, at + k + 1) for k in range(size)]
        at += size
    nexts = [s for s, _ in starts[1:]] + [starts[-1][1]] if starts else []
    return [(text[s:e], text[s:n], (s, e)) for (s, e), n in zip(starts, nexts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("method", ["arrow", "window"])
def test_tokens_and_spans_match_python(docs, method):
    toks = TX.token_table(docs, method=method).collect()
    for did, text in enumerate(TEXTS):
        want = [(t, ws, s[0], s[1]) for t, ws, s in python_tokens(text)]
        got = sorted((r.i, r.token, r.token_ws, r.start, r.end) for r in toks if r.doc_id == did)
        assert [g[1:] for g in got] == want, text


def test_untokenize_round_trip(docs):
    got = {r.doc_id: r.text for r in TX.untokenize_rows(TX.token_table(docs)).collect()}
    for did, text in enumerate(TEXTS):
        if python_tokens(text):
            assert got[did] == "".join(ws for _, ws, _ in python_tokens(text)).strip()


def test_untokenize_text_per_row(docs):
    full = {r.doc_id: r.t for r in docs.select("doc_id", TX.untokenize_text("text").alias("t")).collect()}
    sl = {r.doc_id: r.t for r in docs.select("doc_id", TX.untokenize_text("text", 1, -1).alias("t")).collect()}
    for did, text in enumerate(TEXTS):
        toks = python_tokens(text)
        assert full[did] == ("".join(ws for _, ws, _ in toks).strip() if toks else None)
        mid = toks[1:-1]
        assert sl[did] == ("".join(ws for _, ws, _ in mid).strip() if mid else None)


def test_untokenize_docs(docs):
    full = {r.doc_id: r.text for r in TX.untokenize_docs(docs).collect()}
    sl = {r.doc_id: r.text for r in TX.untokenize_docs(docs, 1, -1).collect()}
    for did, text in enumerate(TEXTS):
        toks = python_tokens(text)
        assert full.get(did) == ("".join(ws for _, ws, _ in toks).strip() if toks else None)
        mid = toks[1:-1]
        assert sl.get(did) == ("".join(ws for _, ws, _ in mid).strip() if mid else None)


def test_words_count_slice(docs):
    rows = {r.doc_id: r for r in docs.select("doc_id", TF.words("text", True).alias("w"),
                                             TF.token_count("text").alias("n")).collect()}
    for did, text in enumerate(TEXTS):
        assert rows[did].w == [t.lower() for t, _, _ in python_tokens(text)]
        assert rows[did].n == len(python_tokens(text))
    sl = {r.doc_id: r.text for r in TX.untokenize_rows(TX.token_table(docs), lo=1, hi=-1).collect()}
    for did, text in enumerate(TEXTS):
        toks = python_tokens(text)[1:-1]
        if toks:
            assert sl[did] == "".join(ws for _, ws, _ in toks).strip()


def test_ngrams_order_and_filter(spark):
    df = spark.createDataFrame([(0, "a b , c")], "doc_id long, text string")
    rows = [r.gram for r in TX.ngram_rows(df, 2, True).orderBy("g").collect()]
    assert rows == ["a", "a b", "b", "b ,", ",", ", c", "c"]

    def punct(g):
        return F.exists(g, lambda w: w == ",")

    kept = [r.gram for r in TX.ngram_rows(df, 2, True, punct).orderBy("g").collect()]
    assert kept == ["a", "a b", "b", "c"]
    spans = sorted((r.s, r.e) for r in TX.ngram_spans(df, 2).collect())
    assert spans == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_entity_runs(spark):
    tags = ["O", "CAP", "CAP", "O", "CAP", "LOC", "LOC"]
    rows = [(0, i, f"t{i}", f"t{i} ", t) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, "doc_id long, i int, token string, token_ws string, tag string")
    got = sorted((r.first_i, r.last_i, r.text, r.tag) for r in TX.entity_groups(df).collect())
    assert got == [(1, 2, "t1 t2", "CAP"), (4, 4, "t4", "CAP"), (5, 6, "t5 t6", "LOC")]


@pytest.mark.parametrize("la,lb,n,want", [(5, 5, 11, (5, 5)), (2, 9, 11, (2, 9)), (9, 2, 11, (9, 2)),
                                          (7, 7, 11, (5, 6)), (5, 5, 7, (3, 4)), (2, 9, 7, (2, 5)),
                                          (9, 2, 7, (5, 2)), (7, 7, 7, (3, 4))])
def test_pair_truncation(spark, la, lb, n, want):
    df = spark.createDataFrame([(list(map(str, range(la))), list(map(str, range(lb))))], "a array<string>, b array<string>")
    a, b = TX.truncate_pair("a", "b", n)
    r = df.select(F.size(a).alias("x"), F.size(b).alias("y")).first()
    assert (r.x, r.y) == want


def test_annotation_present_or_none(spark):
    t = spark.createDataFrame([(0, 0, "A", "NNP")], "doc_id long, i int, token string, pos string")
    assert TX.annotation(t, "lemma") is None
    assert [tuple(r) for r in TX.annotation(t, "pos").collect()] == [(0, 0, "NNP")]


def test_token_rows_come_in_bounded_batches():
    """A worker makes rows of a slice of the documents, however many an Arrow batch holds."""
    import pyarrow as pa
    from dpmine.operators import text as T
    n, words = 10_000, [f"word{i}" for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()),
                                        pa.array([[w + " " for w in words]] * n), pa.array([words] * n)],
                                       names=["doc_id", "_lead", "_p", "_t"])
    out = list(T._token_rows("doc_id")([batch]))
    assert sum(b.num_rows for b in out) == 100 * n
    assert max(b.num_rows for b in out) < 100 * n / 2


def test_ngram_rows_run_in_batches_and_match_brute_force(spark):
    from pyspark.sql import functions as F
    from dpmine.operators.text import ngram_rows
    texts = ["A b, c d", "", None, "x", "! a ! b c", "one two three four five", ". , ;"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for n in (1, 2, 3):
        got = ngram_rows(docs, n, True, drop_word=lambda w: ~w.rlike("^[a-z]"))
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        want = set()
        for i, t in enumerate(texts):
            w = "".join(f" {c} " if c in "!,.;" else c for c in (t or "").lower()).split()
            grams = [w[s:s + L] for s in range(len(w)) for L in range(1, n + 1) if s + L <= len(w)]
            want |= {(i, g, " ".join(x)) for g, x in enumerate([x for x in grams if all(y.isalpha() for y in x)])}
        assert {(r.doc_id, r.g, r.gram) for r in got.collect()} == want
    empty = ngram_rows(docs.select(F.lit("k").alias("doc_id"), "text").limit(0), 2)
    assert empty.collect() == [] and dict(empty.dtypes)["doc_id"] == "string"
