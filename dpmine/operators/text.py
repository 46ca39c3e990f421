"""Tokeniser operators over a documents table.

Array form (one row per document) where the work is per document and needs
no order across rows: tokens, words, counts, slices, n-grams, truncation.
Long form (one row per token) where a running sum is needed: character
offsets and entity runs.  For the long form the documents are
hash-partitioned by id *before* the explode, so the per-document window
needs no second (token-level) exchange: ``Generate`` keeps the partitioning.
Tokens are cut JVM-side; Arrow batch functions make rows of them, in slices of
bounded size.  N-grams with a predicate on whole grams use ``explode_outer`` (a
plain ``explode`` makes Catalyst push an inferred ``size(..) > 0`` filter that
inlines the regex into every lambda).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpmine.functions.text import TOKEN, leading_gap, token_pieces, words
from dpmine.operators.rows import pieces as slices

# fixed values: characters Python's str.strip() removes (isspace)
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
NON_ENTITY = "O"
TOKEN_BYTES = 4 << 20       # of an Arrow batch whose tokens become rows at a time


def strip_py(col: Column) -> Column:
    return F.regexp_replace(col, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


# ---------------------------------------------------------------- array form
def tokenize_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uncased: bool = False) -> DataFrame:
    """``id, tokens`` (token texts in order)."""
    return docs.select(id_col, words(text_col, uncased).alias("tokens"))


def py_bound(i, n: Column) -> Column:
    """Python slice bound → 0-based index in ``[0, n]`` (None = open)."""
    if i is None:
        return None
    v = F.lit(i)
    v = v + n if i < 0 else v
    return F.least(F.greatest(v, F.lit(0)), n)


def slice_tokens(arr, i: int | None = None, j: int | None = None) -> Column:
    """``arr[i:j]`` with Python slice bounds."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(a)
    s = py_bound(i, n) if i is not None else F.lit(0)
    e = py_bound(j, n) if j is not None else n
    return F.slice(a, s + 1, F.greatest(e - s, F.lit(0)))


def ngrams(tokens, n: int = 2, drop: Callable[[Column], Column] | None = None) -> Column:
    """All 1..n-grams as word arrays, ordered by start then length; ``drop(gram)`` true → left out."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    size = F.size(t)

    def at(s):
        lens = F.sequence(F.lit(1), F.least(F.lit(n), size - s))
        return F.transform(lens, lambda L: F.slice(t, s + 1, L))

    grams = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), at))
    grams = F.when(size > 0, grams).otherwise(F.array().cast("array<array<string>>"))
    if drop is not None:
        grams = F.filter(grams, lambda g: ~drop(g))
    return grams


def _gram_strings(toks: DataFrame, id_col: str, n: int, drop_word) -> DataFrame:
    """Per length L, the L-gram strings and drop flags as parallel arrays (``zip_with`` of shifted slices).

    No array is allocated per gram: O(tokens · n) string concatenations.
    """
    w = F.col("_w")
    size = F.size(w)
    flags = F.transform(w, lambda x: drop_word(x)) if drop_word is not None else F.transform(w, lambda x: F.lit(False))
    cols = [id_col, w.alias("_w"), flags.alias("_f1")]
    d = toks.select(*cols)
    d = d.withColumn("_g1", F.col("_w"))
    for L in range(2, n + 1):
        tail_w = F.slice("_w", L, F.greatest(size - L + 1, F.lit(0)))
        tail_f = F.slice("_f1", L, F.greatest(size - L + 1, F.lit(0)))
        d = d.withColumn(f"_g{L}", F.zip_with(F.slice(f"_g{L - 1}", 1, F.greatest(size - L + 1, F.lit(0))), tail_w,
                                              lambda a, b: F.concat(a, F.lit(" "), b)))
        d = d.withColumn(f"_f{L}", F.zip_with(F.slice(f"_f{L - 1}", 1, F.greatest(size - L + 1, F.lit(0))), tail_f,
                                              lambda a, b: a | b))
    return d


def _gram_rows(n: int, id_col: str):
    """Arrow batch function: documents (id, words, drop flags) → one row per kept n-gram, by start, then length.

    All documents of a slice at once: per length, the places at which a whole gram of kept words starts, and one join of
    the words there; a sort of the places puts the lengths in turn.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for rb in slices(batches, TOKEN_BYTES):
            words_, flags = rb.column("_w"), pc.fill_null(rb.column("_f").flatten(), True).to_numpy(zero_copy_only=False)
            counts = np.diff(words_.offsets.to_numpy())
            flat, total = words_.flatten(), len(flags)
            row = np.repeat(np.arange(len(counts)), counts)
            left = np.repeat(np.cumsum(counts), counts) - np.arange(total)       # words from here to the document's end
            places, grams, ok = [], [], np.ones(total, bool)
            for L in range(1, n + 1):
                ok &= left >= L
                ok[:max(total - L + 1, 0)] &= ~flags[L - 1:]
                at = np.flatnonzero(ok)
                places.append(at * n + L - 1)
                parts = [flat.take(pa.array(at + i)) for i in range(L)]
                grams.append(pc.binary_join_element_wise(*parts, " ") if L > 1 else parts[0])
            place = np.concatenate(places)
            order = np.argsort(place, kind="stable")
            doc = row[place[order] // n]
            g = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
            if len(doc):
                yield pa.RecordBatch.from_arrays([rb.column(id_col).take(pa.array(doc)), pa.array(g.astype(np.int32)),
                                                  pa.concat_arrays(grams).take(pa.array(order))], names=[id_col, "g", "gram"])

    return run


def ngram_rows(docs: DataFrame, n: int = 2, uncased: bool = True, drop=None, id_col: str = "doc_id",
               text_col: str = "text", drop_word=None) -> DataFrame:
    """``id, g, gram`` — every kept n-gram of every document as a space-joined string.

    ``drop(gram_words)`` is a predicate on the word array of a gram;
    ``drop_word(word)`` the common special case "drop a gram when any of its
    words matches", which needs no per-gram arrays.  ``g`` is the gram's place
    among the kept grams (by start, then length).
    """
    # tokens first, as a column: an expression referenced inside the lambdas would be re-run per start
    toks = docs.select(id_col, words(text_col, uncased).alias("_w"))
    if drop is None:
        flag = (lambda x: drop_word(x)) if drop_word is not None else (lambda x: F.lit(False))
        flagged = toks.select(id_col, "_w", F.transform("_w", flag).alias("_f"))
        kind = toks.schema[id_col].dataType.simpleString()
        return flagged.mapInArrow(_gram_rows(n, id_col), f"`{id_col}` {kind}, g int, gram string")
    out = toks.select(id_col, F.posexplode_outer(ngrams("_w", n, drop)).alias("g", "words"))
    return out.filter(F.col("words").isNotNull()).select(id_col, "g", F.array_join("words", " ").alias("gram"))


def ngram_spans(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, s, e``: n-grams as token index spans ``[s, e)`` (the non-string form)."""
    docs = docs.select(id_col, F.size(words(text_col)).alias("_n"))
    size = F.col("_n")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(n), size - s)), lambda L: F.struct(s.alias("s"), (s + L).alias("e")))))
    spans = F.when(size > 0, spans)
    return docs.select(id_col, F.explode_outer(spans).alias("sp")).filter(F.col("sp").isNotNull()).select(
        id_col, "sp.s", "sp.e")


def ngram_counts(docs: DataFrame, n: int = 2, uncased: bool = True, drop=None, text_col: str = "text",
                 drop_word=None) -> DataFrame:
    """``gram, n``: corpus frequency of every kept gram (partial counts map-side, so hot grams do not skew)."""
    if drop is None:
        toks = docs.select(words(text_col, uncased).alias("_w"), F.lit(0).alias("_d"))
        d = _gram_strings(toks, "_d", n, drop_word)
        kept = [F.filter(F.arrays_zip(F.col(f"_g{L}").alias("g"), F.col(f"_f{L}").alias("f")), lambda x: ~x["f"])
                for L in range(1, n + 1)]
        rows = d.select(F.explode_outer(F.concat(*kept)).alias("it")).filter(F.col("it").isNotNull())
        return rows.groupBy(F.col("it.g").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    rows = ngram_rows(docs.select(F.lit(0).alias("_d"), text_col), n, uncased, drop, "_d", text_col)
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def truncate_tokens(tokens, n: int, reserve: int = 0) -> Column:
    """The first ``n - reserve`` tokens."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(t, 1, max(n - reserve, 0))


def truncate_pair(a, b, n: int, reserve: int = 0) -> tuple[Column, Column]:
    """Cut a pair to ``n - reserve`` tokens together, the longer side first.

    When ``la + lb`` exceeds the budget, the shorter side keeps
    ``min(its length, budget div 2)`` and the longer side the rest; on equal
    lengths ``b`` counts as the longer.
    """
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    budget = F.lit(max(n - reserve, 0))
    la, lb = F.size(ca), F.size(cb)
    fits = la + lb <= budget
    a_short = la <= lb
    half = F.floor(budget / 2).cast("int")
    keep_a = F.when(fits, la).when(a_short, F.least(la, half)).otherwise(budget - F.least(lb, half))
    keep_b = F.when(fits, lb).when(a_short, budget - F.least(la, half)).otherwise(F.least(lb, half))
    return F.slice(ca, 1, keep_a), F.slice(cb, 1, keep_b)


# ---------------------------------------------------------------- long form
def _token_rows(id_col: str):
    """Arrow batch function: documents (id, lead, pieces, tokens) → one row per token with offsets.

    Vectorised over the whole batch: the list columns are flattened, piece
    lengths (code points) are prefix-summed once, and each document's base is
    subtracted — no per-row Python.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for rb in slices(batches, TOKEN_BYTES):
            pieces, toks = rb.column("_p"), rb.column("_t")
            offs = pieces.offsets.to_numpy()
            offs = offs - offs[0]
            counts = np.diff(offs)
            flat_p, flat_t = pieces.flatten(), toks.flatten()
            total = len(flat_p)
            if total == 0:
                continue
            lp = pc.utf8_length(flat_p).to_numpy(zero_copy_only=False).astype(np.int64)
            lt = pc.utf8_length(flat_t).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            excl = np.cumsum(lp) - lp
            first = offs[:-1]
            base = np.where(counts > 0, excl[np.minimum(first, total - 1)], 0)
            idx = np.arange(total) - first[row]
            lead = rb.column("_lead").to_numpy(zero_copy_only=False).astype(np.int64)
            start = lead[row] + excl - base[row]
            last = idx == counts[row] - 1
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col).take(pa.array(row)), pa.array(idx.astype(np.int32)), flat_t,
                 pc.if_else(pa.array(last), flat_t, flat_p), pa.array(start.astype(np.int32)),
                 pa.array((start + lt).astype(np.int32))],
                names=[id_col, "i", "token", "token_ws", "start", "end"])

    return run


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: str = "arrow") -> DataFrame:
    """``id, i, token, token_ws, start, end`` — one row per token, ``[start, end)`` in code points.

    ``token_ws`` is the token with the whitespace up to the next token (the
    last token has none).  The default (``arrow``) needs no exchange: the JVM
    extracts each document's token pieces, and an Arrow batch function turns
    them into rows with prefix-summed offsets.  ``window`` is the all-JVM
    alternative: documents hash-partitioned by id, ``posexplode``, and a
    running sum over a per-document window (``Generate`` keeps the
    partitioning, so the window adds no token-level exchange — but the text is
    shuffled once).
    """
    if method == "arrow":
        d = docs.select(F.col(id_col).cast("long").alias(id_col), leading_gap(text_col).cast("long").alias("_lead"),
                                token_pieces(text_col).alias("_p"))
        d = d.select(id_col, "_lead", "_p",
                     F.transform("_p", lambda p: F.regexp_extract(p, "^(?:" + TOKEN + ")", 0)).alias("_t"))
        schema = f"{id_col} long, i int, token string, token_ws string, start int, end int"
        return d.mapInArrow(_token_rows(id_col), schema)
    d = (docs.select(id_col, text_col).repartition(id_col)
         .select(id_col, leading_gap(text_col).alias("_lead"), token_pieces(text_col).alias("_p")))
    d = d.select(id_col, "_lead", F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("i", "_piece"))
    d = d.filter(F.col("_piece").isNotNull())
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    tok = F.regexp_extract("_piece", "^(?:" + TOKEN + ")", 0)
    start = F.col("_lead") + F.coalesce(F.sum(F.length("_piece")).over(w), F.lit(0))
    out = d.select(id_col, F.col("i").cast("int").alias("i"), tok.alias("token"),
                   F.when(F.col("i") == F.col("_n") - 1, tok).otherwise(F.col("_piece")).alias("token_ws"),
                   start.cast("int").alias("start"))
    return out.withColumn("end", (F.col("start") + F.length("token")).cast("int"))


def untokenize_docs(docs: DataFrame, lo: int | None = None, hi: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, text``: each document's tokens ``[lo, hi)`` re-joined with their whitespace (documents with an
    empty range are left out).

    The tokeniser runs once per document: pieces, their lengths and the
    leading gap are columns before any sum refers to them.
    """
    d = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_x"))
    d = d.select(id_col, "_x", token_pieces("_x").alias("_p"), leading_gap("_x").alias("_lead"))
    d = d.select(id_col, "_x", "_p", "_lead", F.transform("_p", lambda p: F.length(p)).alias("_len"),
                 F.size("_p").alias("_n"))
    n = F.col("_n")
    s = py_bound(lo, n) if lo is not None else F.lit(0)
    e = py_bound(hi, n) if hi is not None else n
    d = d.select(id_col, "_x", "_p", "_lead", "_len", s.alias("_s"), e.alias("_e"))

    def upto(k):
        return F.aggregate(F.slice("_len", 1, k), F.lit(0), lambda a, x: a + x)

    start = F.col("_lead") + F.when(F.col("_s") > 0, upto(F.col("_s"))).otherwise(F.lit(0))
    last_tok = F.regexp_extract(F.element_at("_p", F.greatest(F.col("_e"), F.lit(1))), "^(?:" + TOKEN + ")", 0)
    end = F.col("_lead") + F.when(F.col("_e") > 1, upto(F.col("_e") - 1)).otherwise(F.lit(0)) + F.length(last_tok)
    d = d.filter(F.col("_e") > F.col("_s")).select(id_col, "_x", start.alias("_a"), end.alias("_b"))
    return d.select(id_col, strip_py(F.substring("_x", F.col("_a") + 1, F.col("_b") - F.col("_a"))).alias("text"))


def untokenize_text(text, lo: int | None = None, hi: int | None = None) -> Column:
    """Text of tokens ``[lo, hi)`` (Python slice bounds) with their inner whitespace, stripped — per row.

    The joined pieces of a token range are a substring of the text: from the
    first token's start to the last token's end.  Offsets come from sums over
    piece lengths (``aggregate`` over a slice, linear in the document), so no
    token rows are needed.  Null when the range is empty.
    """
    pieces = token_pieces(text)
    lens = F.transform(pieces, lambda p: F.length(p))
    n = F.size(pieces)
    s = py_bound(lo, n) if lo is not None else F.lit(0)
    e = py_bound(hi, n) if hi is not None else n

    def upto(k):
        return F.aggregate(F.slice(lens, 1, k), F.lit(0), lambda a, x: a + x)

    lead = leading_gap(text)
    start = lead + F.when(s > 0, upto(s)).otherwise(F.lit(0))
    last_tok = F.regexp_extract(F.element_at(pieces, F.greatest(e, F.lit(1))), "^(?:" + TOKEN + ")", 0)
    end = lead + F.when(e > 1, upto(e - 1)).otherwise(F.lit(0)) + F.length(last_tok)
    txt = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(e > s, strip_py(F.substring(txt, start + 1, end - start)))


def untokenize_rows(tokens: DataFrame, id_col: str = "doc_id", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """``id, text``: the (optionally sliced ``[lo, hi)``) tokens joined with their whitespace, stripped."""
    t = tokens
    if lo is not None or hi is not None:
        n = F.max("i").over(Window.partitionBy(id_col)) + 1
        t = t.withColumn("_n", n)
        s = py_bound(lo, F.col("_n")) if lo is not None else F.lit(0)
        e = py_bound(hi, F.col("_n")) if hi is not None else F.col("_n")
        t = t.filter((F.col("i") >= s) & (F.col("i") < e))
    items = F.sort_array(F.collect_list(F.struct("i", "token_ws")))
    return t.groupBy(id_col).agg(strip_py(F.array_join(F.transform(items, lambda x: x["token_ws"]), "")).alias("text"))


def entity_groups(tagged: DataFrame, id_col: str = "doc_id", tag_col: str = "tag",
                  non_ent: str = NON_ENTITY) -> DataFrame:
    """Maximal runs of one non-``non_ent`` tag → ``id, first_i, last_i, text, tag``.

    Gaps and islands: ``i - row_number() over (id, tag by i)`` is constant
    along a run of equal tags.  The run's text is its tokens joined with
    their whitespace, stripped (as ``slice(..).untokenize()``).
    """
    w = Window.partitionBy(id_col, tag_col).orderBy("i")
    t = tagged.filter(F.col(tag_col) != non_ent).withColumn("_grp", F.col("i") - F.row_number().over(w))
    items = F.sort_array(F.collect_list(F.struct("i", "token_ws")))
    g = t.groupBy(id_col, tag_col, "_grp").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"),
                                                items.alias("_items"))
    return g.select(id_col, "first_i", "last_i",
                    strip_py(F.array_join(F.transform("_items", lambda x: x["token_ws"]), "")).alias("text"),
                    F.col(tag_col).alias("tag"))


def entity_runs(docs: DataFrame, tag, non_ent: str = NON_ENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, first_i, last_i, text, tag`` of maximal runs, found where the document is (no exchange).

    ``tag`` maps a token Column to its tag.  The JVM cuts and tags the tokens;
    an Arrow batch function finds the runs of all documents of a batch at once.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for rb in slices(batches, TOKEN_BYTES):
            offs = rb.column("_p").offsets.to_numpy()
            counts = np.diff(offs)
            if not counts.sum():
                continue
            pieces, toks, tags = (rb.column(c).flatten() for c in ("_p", "_t", "_g"))
            kind = tags.dictionary_encode()
            code = kind.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            new = np.ones(len(row), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(row)) - 1
            names = np.array(kind.dictionary.to_pylist(), dtype=object)
            keep = names[code[begin]] != non_ent
            begin, end = begin[keep], end[keep]
            first = offs[:-1] - offs[0]
            texts = ["".join(pieces.slice(a, b - a).to_pylist() + [toks[b].as_py()]).strip()
                     for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col).take(pa.array(row[begin])), pa.array((begin - first[row[begin]]).astype(np.int32)),
                 pa.array((end - first[row[begin]]).astype(np.int32)), pa.array(texts, pa.string()),
                 pa.array(names[code[begin]].tolist(), pa.string())],
                names=[id_col, "first_i", "last_i", "text", "tag"])
    d = docs.select(F.col(id_col).cast("long").alias(id_col), token_pieces(text_col).alias("_p"))
    d = d.select(id_col, "_p", F.transform("_p", lambda p: F.regexp_extract(p, "^(?:" + TOKEN + ")", 0)).alias("_t"))
    d = d.select(id_col, "_p", "_t", F.transform("_t", tag).alias("_g"))
    return d.mapInArrow(run, f"{id_col} long, first_i int, last_i int, text string, tag string")


def capital_tag(token) -> Column:
    """Rule tag of a token: ``CAP`` when it starts upper-case, else ``O``."""
    return F.when(token.rlike(r"^\p{Lu}"), F.lit("CAP")).otherwise(F.lit(NON_ENTITY))


def capital_tags(tokens: DataFrame) -> DataFrame:
    """Rule tagger used as the annotation input: ``CAP`` when a token starts upper-case, else ``O``."""
    return tokens.withColumn("tag", capital_tag(F.col("token")))


def annotation(tokens: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame | None:
    """``id, i, <name>`` for an attached token annotation (``pos``, ``lemma``, ``ner``…); None when absent."""
    if name not in tokens.columns:
        return None
    return tokens.select(id_col, "i", name)
