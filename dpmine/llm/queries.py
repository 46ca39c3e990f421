"""Registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.llm import chat, decontam, langid, mixing, secret_scan, simhash, substring_dedup, suffix_dedup, token_counts, \
    token_output, topk, vector_codes, whitening
from dpmine.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item: ``doc_id, item_id, score`` and both overlaps."""
    items = decontam.halves(table(spark, sf_dir, "benchmark"))
    found = decontam.contaminated(table(spark, sf_dir, "documents"), items, whole=True)
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` (and ``cross_entropy, rejected``) of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_tokens``: greedy longest-match pieces of every document."""
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every vector with an id divisible by 50: ``query_id, rank, vec_id, score``."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


TOOLS = [
    ("plan", [("query", "string", True), ("turn", "integer", True)], True),
    ("lookup", [("query", "string", True), ("turn", "integer", True), ("limit", "integer", False)], True),
    ("search", [("query", "string", True), ("turn", "integer", True), ("after", "string", True)], False),
]


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call and result of ``conversations`` linked, validated and written as JSON, a row a call id."""
    calls, results = chat.calls_of_conversations(table(spark, sf_dir, "conversations"))
    found = chat.format_tool_calls(calls, results, spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS))
    return found.select("conv_id", "call_id", "name", "level", "n_calls", "n_results",
                        F.array_join("errors", ",").alias("errors"), "json")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files written for the whole table."""
    import public_tokenizers
    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: 32 components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` (and ``n_learned``) of every document."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.train(docs))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector."""
    coded = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _vector_codes_sql() -> str:
    """All rounds of the product codes: squared distances from exact products of whole numbers, ties by entry."""
    near = """n{r} AS MATERIALIZED (
            SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
                SELECT p.vec_id, p.part, c.entry, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v)
                       + list_inner_product(c.v, c.v) AS d
                FROM p JOIN c{r} c ON p.part = c.part)
            GROUP BY ALL)"""
    update = """c{s} AS MATERIALIZED (
            SELECT c.part, c.entry, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT part, entry, list(m ORDER BY i) AS v FROM (
                    SELECT part, entry, i, CAST(sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END
                                                AS DOUBLE) AS m
                    FROM (SELECT p.part, n.entry, unnest(range(len(p.v))) AS i, CAST(unnest(p.v) AS BIGINT) AS x
                          FROM p JOIN n{r} n USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL) u
            ON u.part = c.part AND u.entry = c.entry)"""
    steps = [s for r in range(4) for s in (near.format(r=r), update.format(r=r, s=r + 1))] + [near.format(r=4)]
    return """
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS v
                                FROM v, (SELECT unnest(range(4)) AS part)),
             c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p
                                 WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
             """ + ",\n             ".join(steps) + """,
             r AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code,
                          CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY vec_id),
             h AS (SELECT sha256(coalesce(string_agg(x, ',' ORDER BY part, entry, i), '')) AS codebooks_sha256 FROM (
                       SELECT part, entry, unnest(range(len(v))) AS i, CAST(CAST(unnest(v) AS BIGINT) AS VARCHAR) AS x FROM c4))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM r JOIN v USING (vec_id), h"""


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_language_id, op3_token_counts, op4_exact_topk_search, op5_suffix_array_dedup,
                                  op6_chat_formatting, op7_substring_dedup, op8_simhash_near_dedup, op9_token_id_output, op10_source_mixing,
                                  op11_embedding_whitening, op12_secret_scan, op13_vector_codes)}
SQL: dict[str, str] = {
    "op4_exact_topk_search": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
                          CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_vector_codes": _vector_codes_sql(),
    "op6_chat_formatting": """
        WITH c AS (SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn, text,
                          CASE WHEN turn = 0 THEN 'plan' WHEN length(text) <= 80 THEN 'lookup' ELSE 'search' END AS name,
                          CASE WHEN turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2) END AS after
                   FROM conversations WHERE role = 'user'),
             r AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n
                   FROM conversations WHERE role = 'assistant' GROUP BY ALL),
             j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name, turn AS level,
                          CAST(CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls, coalesce(r.n, 0) AS n_results,
                          list_filter([CASE WHEN c.call_id IS NULL THEN 'no_call' END, CASE WHEN r.n IS NULL THEN 'no_result' END,
                                       CASE WHEN r.n > 1 THEN 'duplicate_result' END,
                                       CASE WHEN c.call_id IS NOT NULL AND text IS NULL THEN 'missing:query' END,
                                       CASE WHEN name = 'search' AND after IS NULL THEN 'missing:after' END,
                                       CASE WHEN name = 'lookup' AND after IS NOT NULL THEN 'extra:after' END],
                                      lambda x: x IS NOT NULL) AS e,
                          CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{' || array_to_string(list_filter(
                              ['"after":"' || after || '"', '"query":' || CAST(to_json(text) AS VARCHAR), '"turn":' || turn],
                              lambda x: x IS NOT NULL), ',') || '}' END AS arguments,
                          CASE WHEN after IS NULL THEN '[]' ELSE '["' || after || '"]' END AS needs, content
                   FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
        SELECT conv_id, call_id, name, level, n_calls, n_results, array_to_string(e, ',') AS errors,
               '{"arguments":' || arguments || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"depends_on":' || needs
               || ',"errors":[' || array_to_string(list_transform(e, lambda x: '"' || x || '"'), ',') || '],"level":'
               || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":'
               || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}' AS json
        FROM j""",
}
