"""DuckDB SQL for every registered query (the correctness oracle).

Plain brute force over the driver's views: cross products and
``list_dot_product`` are fine here, this is the check, not the engine.
Named CTEs are declared once with their dependencies; ``sql(body, *ctes)``
pulls in what a query needs, in dependency order.
"""

from __future__ import annotations


def _run(k: int, src: str = "q, p", score: str = "list_dot_product(q.vec, p.vec)", ids: str = "q.qid, p.pid") -> str:
    return (f"SELECT qid, pid, CAST(rank AS INTEGER) AS rank, score FROM ("
            f"SELECT {ids}, {score} AS score, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, "
            f"pid) AS rank FROM {src}) WHERE rank <= {k}")


def _hn(run: str, depth: int) -> str:
    return (f"WITH mq AS (SELECT qid, query FROM qt WHERE qid IN (SELECT qid FROM qr) AND qid IN (SELECT qid FROM {run})), "
            f"ng AS (SELECT r.qid, r.pid, r.rank FROM {run} r WHERE r.qid IN (SELECT qid FROM mq) "
            f"AND NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = r.qid AND qr.pid = r.pid)), "
            f"ng2 AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY rank, pid) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY qid) AS n_neg FROM ng), "
            f"nr AS (SELECT qid, 'neg' AS role, CAST(pos AS INTEGER) AS pos, pid, 0.0 AS score FROM ng2 "
            f"WHERE n_neg >= {depth} AND pos < {depth}), "
            f"pr AS (SELECT qid, 'pos' AS role, CAST(row_number() OVER (PARTITION BY qid ORDER BY pid) - 1 AS INTEGER) AS pos, "
            f"pid, 1.0 AS score FROM qr WHERE qid IN (SELECT qid FROM nr)) "
            f"SELECT * FROM pr UNION ALL SELECT * FROM nr")


def _key(*cols: str, seed: int = 42, epoch: int = 0) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', '{seed}', '{epoch}', {parts}))"


def _negs(src: str, n: int) -> str:
    """Seeded draw of n negatives after replicate padding."""
    return (f"SELECT qid, CAST(slot AS INTEGER) AS slot, pid, score FROM ("
            f"SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY {_key('qid', 'pid', 'pos', 'cp')}) AS slot "
            f"FROM (SELECT x.*, unnest(range(0, CASE WHEN len < {n} THEN 1 + {n} // len ELSE 1 END)) AS cp FROM ("
            f"SELECT *, count(*) OVER (PARTITION BY qid) AS len FROM {src} WHERE role = 'neg') x)) WHERE slot <= {n}")


def _pos(src: str) -> str:
    return (f"SELECT qid, pid, score FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY "
            f"{_key('qid', 'pid', 'pos', '0')}) AS rn FROM {src} WHERE role = 'pos') WHERE rn = 1")


def _groups(src: str, n: int) -> str:
    return (f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS size FROM ("
            f"SELECT qid, 0 AS slot, pid, score FROM ({_pos(src)}) UNION ALL {_negs(src, n)})) WHERE size = {n + 1}")


FOLD = ("[-0.5 * list_sum(list_transform(var, lambda x: ln(x)))] || list_transform(var, lambda x: -0.5 / x) || "
        "list_transform(list_zip(mean, var), lambda t: t[1] / t[2]) || "
        "[-0.5 * list_sum(list_transform(list_zip(mean, var), lambda t: t[1] * t[1] / t[2]))] AS v")
TEACH = "-list_sum(list_transform(list_zip(q.vec, p.vec), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
# fixed values: the token pattern and Python's white space, in this dialect
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
PIECE = r"(?:[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])[\p{Z}\p{C}]*"
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"


def _toks(col: str, lower: bool = False) -> str:
    t = f"regexp_extract_all(coalesce({col}, ''), '{TOKEN}')"
    return f"list_transform({t}, lambda w: lower(w))" if lower else t


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def _merge(own: str) -> str:
    return (f"SELECT qid, role, pos, pid, score FROM {own} UNION ALL SELECT o.qid, 'neg' AS role, "
            f"CAST(o.pos + coalesce(c.n_own, 0) AS INTEGER) AS pos, o.pid, o.score FROM other o LEFT JOIN "
            f"(SELECT qid, count(*) AS n_own FROM {own} WHERE role = 'neg' GROUP BY qid) c USING (qid) "
            f"WHERE o.qid IN (SELECT qid FROM {own})")


def _jac(a: str, b: str) -> str:
    da, db = f"list_distinct({a})", f"list_distinct({b})"
    inter = f"len(list_intersect({da}, {db}))"
    return f"CAST({inter} AS DOUBLE) / NULLIF(len({da}) + len({db}) - {inter}, 0)"



def _explode(src: str, id_col: str, vec: str) -> str:
    return (f"SELECT {id_col}, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT {id_col}, "
            f"unnest(generate_series(0, len({vec}) - 1)) AS i, unnest({vec}) AS x FROM {src})")


def _project(vec: str, out: int, seed: int, bias: bool) -> str:
    """Product of a vector with the bindings' fixed matrix, and the bias i / 10."""
    return (f"list_transform(range({out}), lambda i: list_sum(list_transform(range(len({vec})), lambda j: {vec}[j + 1] * "
            f"((7 * i + 3 * j + {seed} * (i + 1) * (j + 1)) % 23 - 11) / 40.0))" + (" + i / 10.0)" if bias else ")"))


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "q": ((), "SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings WHERE vec_id % 10 = 0"),
    "p": ((), "SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings "
          "WHERE vec_id % 10 <> 0 AND vec_id IN (SELECT doc_id FROM documents)"),
    "every": ((), "SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"),
    "ps": (("every",), "SELECT * FROM every WHERE pid % 10 <> 0"),
    "eg": (("every",), "SELECT pid, vec AS mean, list_transform(vec, lambda x: CASE WHEN x < 10 THEN ln(1 + exp(x)) "
                       "ELSE x END) AS var FROM every"),
    "pgs": (("eg",), "SELECT * FROM eg WHERE pid % 10 <> 0"),
    "pg": (("p",), "SELECT pid, vec AS mean, list_transform(vec, lambda x: CASE WHEN x < 10 THEN ln(1 + exp(x)) "
                   "ELSE x END) AS var FROM p"),
    "qr": (("q", "p"), "SELECT q.qid, p.pid, 1 AS rel FROM q JOIN p ON q.label = p.label AND q.qid % 7 = p.pid % 7 "
           "AND q.qid // 500 = p.pid // 500"),
    "qe": ((), "SELECT a.vec_id AS qid, b.vec_id AS pid, 1 AS rel FROM embeddings a, embeddings b "
               "WHERE (a.vec_id % 10 = 0 OR a.vec_id % 100 = 5) AND NOT (b.vec_id % 10 = 0 OR b.vec_id % 100 = 5) "
               "AND a.vec_id // 500 = b.vec_id // 500 AND (a.vec_id * 31 + b.vec_id) % 41 = 0"),
    "qt": ((), "SELECT item_id * 10 AS qid, text AS query FROM benchmark"),
    "corpus": ((), "SELECT doc_id AS pid, source AS title, text AS contents FROM documents"),
    "run10": (("q", "p"), _run(10)),
    "run100": (("q", "p"), _run(100)),
    "run200": (("q", "p"), _run(200)),
    "grun": (("q", "pg"), _run(10, "q, pg", "-0.5 * list_sum(list_transform(list_zip(q.vec, pg.mean, pg.var), "
                                           "lambda t: ln(t[3]) + (t[1] - t[2]) * (t[1] - t[2]) / t[3]))",
                               "q.qid, pg.pid")),
    "runs": (("q", "ps"), _run(10, "q, ps", "list_dot_product(q.vec, ps.vec)", "q.qid, ps.pid")),
    "gruns": (("q", "pgs"), _run(10, "q, pgs", "-0.5 * list_sum(list_transform(list_zip(q.vec, pgs.mean, pgs.var), "
                                               "lambda t: ln(t[3]) + (t[1] - t[2]) * (t[1] - t[2]) / t[3]))",
                                 "q.qid, pgs.pid")),
    "hn": (("qt", "qr", "run200"), _hn("run200", 100)),
    "fh": (("run100", "qe"), "SELECT r.qid, min(r.rank) AS first_rank FROM run100 r "
                             "JOIN (SELECT DISTINCT qid, pid FROM qe) j USING (qid, pid) GROUP BY r.qid"),
    "m": (("fh", "qe", "run100"),
          "SELECT (SELECT coalesce(sum(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END), 0) FROM fh) / nj.n "
          "AS mrr_at_10, (SELECT count(*) FILTER (WHERE first_rank <= 1) FROM fh) / nj.n AS recall_at_1, "
          "(SELECT count(*) FILTER (WHERE first_rank <= 50) FROM fh) / nj.n AS recall_at_50, "
          "(SELECT count(*) FROM fh) / nj.n AS recall_at_all, (SELECT count(DISTINCT qid) FROM run100) AS queries_ranked, "
          "(SELECT count(DISTINCT qid) FROM run100 WHERE qid IN (SELECT qid FROM qe)) AS queries_evaluated, "
          "nj.n AS queries_judged FROM (SELECT count(DISTINCT qid) AS n FROM qe) nj"),
    "ga8": (("hn",), _groups("hn", 8)),
    "run100b": (("q", "p"), _run(100)),
    "hnprev": (("qt", "qr", "run100"), _hn("run100", 50)),
    "cache": (("hnprev", "q", "p"), f"SELECT x.qid, x.pid, {TEACH} AS score FROM (SELECT DISTINCT qid, pid FROM hnprev) x "
                                     "JOIN q USING (qid) JOIN p USING (pid)"),
    "unsc": (("hn", "cache"), "SELECT DISTINCT qid, pid FROM hn WHERE pos < 100 EXCEPT SELECT qid, pid FROM cache"),
    "newsc": (("unsc", "q", "p"), f"SELECT u.qid, u.pid, {TEACH} AS score FROM unsc u JOIN q USING (qid) JOIN p USING (pid)"),
    "tbl": (("cache", "newsc"), "SELECT * FROM cache UNION ALL SELECT * FROM newsc"),
    "scored": (("hn", "tbl"), "SELECT h.qid, h.role, h.pos, h.pid, t.score FROM hn h LEFT JOIN tbl t USING (qid, pid) "
                              "WHERE h.pos < 100"),
    "grun20": (("q", "pg"), _run(20, "q, pg", "-0.5 * list_sum(list_transform(list_zip(q.vec, pg.mean, pg.var), "
                                              "lambda t: ln(t[3]) + (t[1] - t[2]) * (t[1] - t[2]) / t[3]))",
                                  "q.qid, pg.pid")),
    "other": (("grun20", "qr"), "SELECT qid, 'neg' AS role, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 "
                                "AS INTEGER) AS pos, pid, score FROM grun20 g WHERE NOT EXISTS "
                                "(SELECT 1 FROM qr WHERE qr.qid = g.qid AND qr.pid = g.pid)"),
    "mg": (("scored", "other"), _merge("scored")),
    "fused": (("run10", "grun"), "SELECT qid, pid, rank FROM run10 UNION ALL SELECT qid, pid, rank + 10 FROM grun"),
    "jac": (("hn", "qt", "corpus"), "SELECT x.qid, x.pid, " + _jac(_toks("qt.query", True),
                                    _toks("coalesce(c.title, '') || ': ' || coalesce(c.contents, '')", True)) +
            " AS score FROM (SELECT DISTINCT qid, pid FROM hn) x JOIN qt USING (qid) JOIN corpus c USING (pid)"),
    "ga8s": (("scored",), _groups("scored", 8)),
    "qb": (("ga8s",), "SELECT qid, CAST(o AS BIGINT) AS ordinal, CAST(o // 5 AS BIGINT) AS batch FROM "
                      "(SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS o FROM (SELECT DISTINCT qid FROM ga8s))"),
    "bg": (("ga8s", "qb"), "SELECT g.*, qb.batch FROM ga8s g JOIN qb USING (qid)"),
    "own": (("bg", "q", "p"), "SELECT g.qid, g.slot, g.pid, g.batch, g.score, list_dot_product(q.vec, p.vec) AS student "
                              "FROM bg g JOIN q USING (qid) JOIN p USING (pid)"),
    "lsm": (("own",), "SELECT *, score - ms - ln(sum(exp(score - ms)) OVER (PARTITION BY qid)) AS t, "
                      "student - mst - ln(sum(exp(student - mst)) OVER (PARTITION BY qid)) AS s FROM "
                      "(SELECT *, max(score) OVER (PARTITION BY qid) AS ms, max(student) OVER (PARTITION BY qid) AS mst "
                      "FROM own)"),
    "tok": ((), "SELECT doc_id, CAST(i AS INTEGER) AS i, piece, n, lead FROM (SELECT doc_id, "
                f"unnest(generate_series(0, len(pieces) - 1)) AS i, unnest(pieces) AS piece, len(pieces) AS n, lead FROM ("
                f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PIECE}') AS pieces, "
                f"length(regexp_extract(coalesce(text, ''), '^[\\p{{Z}}\\p{{C}}]*')) AS lead FROM documents) "
                "WHERE len(pieces) > 0)"),
    "toks": (("tok",), f"SELECT doc_id, i, regexp_extract(piece, '^(?:{TOKEN})') AS token, "
                       f"CASE WHEN i = n - 1 THEN regexp_extract(piece, '^(?:{TOKEN})') ELSE piece END AS token_ws, "
                       "CAST(lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN "
                       "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, n FROM tok"),
    "grams": ((), "SELECT doc_id, s, L, array_to_string(list_slice(w, s + 1, s + L), ' ') AS gram, "
                  "list_slice(w, s + 1, s + L) AS ws FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS s "
                  f"FROM (SELECT doc_id, {_toks('text', True)} AS w FROM documents) WHERE len(w) > 0) "
                  "CROSS JOIN (SELECT unnest([1, 2]) AS L) WHERE s + L <= len(w)"),
    "keptgrams": (("grams",), "SELECT * FROM grams WHERE NOT list_bool_or(list_transform(ws, lambda x: "
                              "NOT regexp_matches(x, '^[\\p{L}\\p{N}\\p{M}]')))"),
    "seqs": (("every",), "SELECT label AS seq, pid AS pos, vec, pid % 5 <> 0 AS mask FROM every"),
    "fq": (("seqs",), "SELECT seq, " + _project("first", 16, 1, True) + " AS q, first FROM "
                      "(SELECT seq, arg_min(vec, pos) AS first FROM seqs GROUP BY seq)"),
    "attn": (("seqs", "fq"), "SELECT seq, vec, e / sum(e) OVER (PARTITION BY seq) AS w FROM ("
                             "SELECT seq, vec, exp(a - max(a) OVER (PARTITION BY seq)) AS e FROM ("
                             "SELECT t.seq, t.vec, list_dot_product(fq.q, " + _project("t.vec", 16, 2, False) +
                             ") / sqrt(len(t.vec)) AS a FROM seqs t JOIN fq USING (seq) WHERE t.mask))"),
    "pooled": (("attn", "fq"), "SELECT seq, any_value(fq.first) AS mean, list(CASE WHEN x < 10 THEN ln(1 + exp(x)) ELSE x END "
                               "ORDER BY i) AS var FROM (SELECT seq, i, sum(w * x) AS x FROM (SELECT seq, w, "
                               "unnest(range(64)) AS i, unnest(" + _project("vec", 64, 4, False) + ") AS x FROM attn) "
                               "GROUP BY seq, i) JOIN fq USING (seq) GROUP BY seq"),
}


def sql(body: str, *names: str) -> str:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    if not seen:
        return body
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in seen) + " " + body


R = "round({0}, 6) AS {0}".format

SQL = {
    # search
    "score_matrix": sql("SELECT q.qid // 100 AS batch, q.qid, p.pid, round(list_dot_product(q.vec, p.vec), 6) AS score "
                        "FROM q JOIN p ON q.qid // 100 = p.pid // 100", "q", "p"),
    "mips_topk": sql(f"SELECT qid, pid, rank, {R('score')} FROM runs", "runs"),
    "gaussian_topk": sql(f"SELECT qid, pid, rank, {R('score')} FROM gruns", "gruns"),
    # evaluation
    "eval_mrr": sql(f"SELECT {R('mrr_at_10')} FROM m", "m"),
    "eval_recall": sql(f"SELECT {R('recall_at_1')}, {R('recall_at_50')}, {R('recall_at_all')} FROM m", "m"),
    "eval_all": sql(f"SELECT {R('mrr_at_10')}, {R('recall_at_1')}, {R('recall_at_50')}, {R('recall_at_all')}, "
                    "CAST(queries_ranked AS BIGINT) AS queries_ranked, "
                    "CAST(queries_evaluated AS BIGINT) AS queries_evaluated, "
                    "CAST(queries_judged AS BIGINT) AS queries_judged FROM m", "m"),
    "metric_report": sql("SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT mrr_at_10 AS \"MRR @10\", "
                         "recall_at_1 AS \"recall@1\", recall_at_50 AS \"recall@50\", recall_at_all AS \"recall@all\", "
                         "CAST(queries_ranked AS DOUBLE) AS \"QueriesRanked\" FROM m) ON COLUMNS(*) "
                         "INTO NAME metric VALUE value) ORDER BY metric", "m"),
    "duplicate_check": sql("SELECT qid, pid, count(*) AS n FROM (SELECT qid, pid, rank FROM run10 UNION ALL "
                           "SELECT qid, pid, rank + 10 FROM grun) WHERE pid <> 0 GROUP BY qid, pid HAVING count(*) > 1",
                           "run10", "grun"),
    "ranked_array": sql("SELECT s.qid, list(coalesce(r.pid, 0) ORDER BY s.i) AS pids FROM "
                        "(SELECT DISTINCT qid, unnest(range(1, 101)) AS i FROM run100) s "
                        "LEFT JOIN run100 r ON r.qid = s.qid AND r.rank = s.i GROUP BY s.qid", "run100"),
    # mining
    "collect_positives": sql("SELECT qid, list(pid ORDER BY pid) AS doc_ids FROM qr GROUP BY qid", "qr"),
    "mining_queries": sql("SELECT qid, query FROM qt WHERE qid IN (SELECT qid FROM qr) "
                          "AND qid IN (SELECT qid FROM run200)", "qt", "qr", "run200"),
    "exclude_positives": sql(f"SELECT qid, pid, rank, {R('score')} FROM run200 r WHERE NOT EXISTS "
                             "(SELECT 1 FROM qr WHERE qr.qid = r.qid AND qr.pid = r.pid)", "run200", "qr"),
    "hard_negatives": sql("SELECT * FROM hn", "hn"),
    "explode_groups": sql("SELECT * FROM hn", "hn"),
    "mining_report": sql(
        "SELECT (SELECT count(DISTINCT qid) FROM qr) AS n_qrels_queries, "
        "(SELECT count(DISTINCT qid) FROM run200) AS n_run_queries, (SELECT count(DISTINCT qid) FROM qt) AS n_text_queries, "
        "count(*) AS n_candidates, count(*) FILTER (WHERE n_neg >= 100) AS n_mined, "
        "count(*) FILTER (WHERE n_neg < 100) AS n_short FROM (SELECT mq.qid, (SELECT count(*) FROM run200 r "
        "WHERE r.qid = mq.qid AND NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = r.qid AND qr.pid = r.pid)) AS n_neg "
        "FROM (SELECT qid FROM qt WHERE qid IN (SELECT qid FROM qr) AND qid IN (SELECT qid FROM run200)) mq)",
        "qt", "qr", "run200"),
    # sampling and assembly
    "sample_positive": sql(_pos("hn"), "hn"),
    "sample_negatives": sql(_negs("hn", 8), "hn"),
    "sample_negatives_padded": sql(_negs("hn", 150), "hn"),
    "train_groups": sql("SELECT g.qid, qt.query, list(pid ORDER BY slot) AS doc_ids, list(score ORDER BY slot) AS scores "
                        "FROM ga8 g LEFT JOIN qt USING (qid) GROUP BY g.qid, qt.query", "ga8", "qt"),
    "lookup_passages": sql("SELECT g.qid, g.slot, g.pid, c.title, c.contents FROM ga8 g LEFT JOIN corpus c USING (pid)",
                           "ga8", "corpus"),
    "preview": sql("SELECT qid, query, pos_ids, neg_ids FROM (SELECT h.qid, qt.query, "
                   "list(pid ORDER BY pos) FILTER (WHERE role = 'pos') AS pos_ids, "
                   "list(pid ORDER BY pos) FILTER (WHERE role = 'neg') AS neg_ids FROM hn h LEFT JOIN qt USING (qid) "
                   f"GROUP BY h.qid, qt.query) ORDER BY {_key('qid')}, qid LIMIT 3", "hn", "qt"),
    # scoring
    "cap_candidates": sql("SELECT qid, role, pos, pid, round(score, 6) AS score FROM (" + _merge("hn") + ") WHERE pos < 100",
                          "hn", "other"),
    "unscored_pairs": sql("SELECT * FROM unsc", "unsc"),
    "score_pairs": sql("SELECT qid, pid, round(score, 6) AS score FROM jac", "jac"),
    "score_upsert": sql("SELECT qid, pid, round(score, 6) AS score FROM tbl", "tbl"),
    "attach_scores": sql("SELECT h.qid, h.role, h.pos, h.pid, round(j.score, 6) AS score FROM hn h "
                         "LEFT JOIN jac j USING (qid, pid)", "hn", "jac"),
    "score_groups": sql("SELECT qid, role, pos, pid, round(score, 6) AS score FROM scored", "scored"),
    "cache_stats": sql("SELECT CAST(t AS BIGINT) AS total, CAST(n AS BIGINT) AS new, CAST(t - n AS BIGINT) AS skip, "
                       "round((t - n) / t, 6) AS skip_rate FROM (SELECT (SELECT count(*) FROM hn WHERE pos < 100) AS t, "
                       "(SELECT count(*) FROM newsc) AS n)", "hn", "newsc"),
    "merge_negatives": sql("SELECT qid, role, pos, pid, round(score, 6) AS score FROM (" + _merge("scored") + ")",
                           "scored", "other"),
    # losses
    "batches": sql("SELECT * FROM qb", "qb"),
    "own_group_scores": sql("SELECT qid, slot, pid, round(student, 6) AS student FROM own", "own"),
    "group_log_softmax": sql("SELECT qid, slot, pid, round(t, 6) AS logp FROM lsm", "lsm"),
    "distill_kl": sql("SELECT batch, count(*) AS n_queries, round(avg(kl_q), 6) AS kl FROM (SELECT batch, qid, "
                      "sum(exp(t) * (t - s)) AS kl_q FROM lsm GROUP BY batch, qid) GROUP BY batch", "lsm"),
    "in_batch_accuracy": sql(
        "SELECT batch, count(*) AS n_queries, count(*) FILTER (WHERE col = qi * 9) AS n_correct, "
        "round(count(*) FILTER (WHERE col = qi * 9) / count(*), 6) AS accuracy FROM ("
        "SELECT *, row_number() OVER (PARTITION BY batch, qid ORDER BY sc DESC, col) AS r FROM ("
        "SELECT a.batch, a.qid, a.qi, b.col, round(list_dot_product(q.vec, p.vec), 6) AS sc FROM "
        "(SELECT batch, qid, dense_rank() OVER (PARTITION BY batch ORDER BY qid) - 1 AS qi FROM "
        "(SELECT DISTINCT batch, qid FROM bg)) a JOIN "
        "(SELECT g.batch, x.qi * 9 + g.slot AS col, g.pid FROM bg g JOIN (SELECT batch, qid, dense_rank() OVER "
        "(PARTITION BY batch ORDER BY qid) - 1 AS qi FROM (SELECT DISTINCT batch, qid FROM bg)) x USING (batch, qid)) b "
        "USING (batch) JOIN q ON q.qid = a.qid JOIN p ON p.pid = b.pid)) WHERE r = 1 GROUP BY batch", "bg", "q", "p"),
    # text
    "tokenize": f"SELECT doc_id, {_toks('text')} AS tokens FROM documents",
    "words_uncased": f"SELECT doc_id, {_toks('text', True)} AS tokens FROM documents",
    "token_count": f"SELECT doc_id, CAST(len({_toks('text')}) AS INTEGER) AS n_tokens FROM documents",
    "token_offsets": sql("SELECT doc_id, i, token, start, CAST(start + length(token) AS INTEGER) AS \"end\" FROM toks",
                         "toks"),
    "untokenize": sql(f"SELECT doc_id, {_strip('string_agg(token_ws, \'\' ORDER BY i)')} AS text FROM toks "
                      "GROUP BY doc_id", "toks"),
    "token_slice": sql(f"SELECT doc_id, {_strip('string_agg(token_ws, \'\' ORDER BY i)')} AS text FROM toks "
                       "WHERE i >= least(2, n) AND i < greatest(n - 2, 0) GROUP BY doc_id", "toks"),
    "ngrams": sql("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, L) - 1 AS INTEGER) AS g, gram "
                  "FROM keptgrams", "keptgrams"),
    "ngram_counts": sql("SELECT gram, count(*) AS n FROM keptgrams GROUP BY gram", "keptgrams"),
    "entity_groups": sql(
        f"SELECT doc_id, CAST(min(i) AS INTEGER) AS first_i, CAST(max(i) AS INTEGER) AS last_i, "
        f"{_strip('string_agg(token_ws, \'\' ORDER BY i)')} AS text, tag FROM ("
        "SELECT *, i - row_number() OVER (PARTITION BY doc_id, tag ORDER BY i) AS grp FROM ("
        "SELECT doc_id, i, token_ws, CASE WHEN regexp_matches(token, '^\\p{Lu}') THEN 'CAP' ELSE 'O' END AS tag "
        "FROM toks) WHERE tag <> 'O') GROUP BY doc_id, tag, grp", "toks"),
    "truncate_query": f"SELECT qid, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS text FROM ("
                      f"SELECT item_id * 10 AS qid, list_slice({_toks('text')}, 1, 32) AS t FROM benchmark)",
    "truncate_pair": (
        "SELECT pid, CAST(len(a2) AS INTEGER) AS len_a, CAST(len(b2) AS INTEGER) AS len_b, "
        "array_to_string(a2, ' ') AS text_a, array_to_string(b2, ' ') AS text_b FROM ("
        "SELECT pid, list_slice(a, 1, CASE WHEN la + lb <= 141 THEN la WHEN la <= lb THEN least(la, 70) "
        "ELSE 141 - least(lb, 70) END) AS a2, list_slice(b, 1, CASE WHEN la + lb <= 141 THEN lb WHEN la <= lb "
        "THEN 141 - least(la, 70) ELSE least(lb, 70) END) AS b2 FROM ("
        f"SELECT doc_id AS pid, {_toks('source')} AS a, {_toks('text')} AS b, len({_toks('source')}) AS la, "
        f"len({_toks('text')}) AS lb FROM documents))"),
    "passage_text": "SELECT doc_id AS pid, coalesce(source, '') || ': ' || coalesce(text, '') AS text FROM documents",
    # ordinals
    "with_ordinal": "SELECT doc_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS ordinal FROM documents",
    "head_sample": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10",
    # vectors
    "fold_query": sql(_explode("(SELECT pid, [1.0] || list_transform(vec, lambda x: x * x) || vec || [1.0] AS v FROM every)",
                               "pid", "v"), "every"),
    "fold_passage": sql(_explode(f"(SELECT pid, {FOLD} FROM eg)", "pid", "v"), "eg"),
    "softplus": sql(_explode("eg", "pid", "var"), "eg"),
    "first_token_pool": sql(_explode("(SELECT seq, arg_min(vec, pos) AS vec FROM seqs GROUP BY seq)", "seq", "vec"),
                            "seqs"),
    "attention_pool": sql("SELECT seq, CAST(i AS INTEGER) AS i, round(sum(w * x), 6) AS x FROM (SELECT seq, w, "
                          "unnest(range(8)) AS i, unnest(" + _project("vec", 8, 5, True) + ") AS x FROM attn) GROUP BY seq, i",
                          "attn"),
    "passage_model": sql(_explode(f"(SELECT seq, {FOLD} FROM pooled)", "seq", "v"), "pooled"),
    "embeddings_store": sql(_explode("every", "pid", "vec"), "every"),
    "encode_hashed": (f"SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, "
                      f"('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket FROM (SELECT doc_id, "
                      f"unnest({_toks('text', True)}) AS t FROM documents)) GROUP BY doc_id, bucket"),
    # file formats
    "read_corpus": ("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pid, source AS title, "
                    "text AS contents FROM documents"),
    "read_queries": ("SELECT item_id * 10 AS qid, " + _strip("regexp_replace(text, '[\\t\\r\\n]', ' ', 'g')") +
                     " AS query FROM benchmark"),
    "read_qrels": sql("SELECT qid, pid, rel FROM qe", "qe"),
    "read_run": sql("SELECT qid, pid, rank FROM run100", "run100"),
    "write_run": sql("SELECT qid, pid, rank FROM run10", "run10"),
    "read_groups": sql("SELECT h.qid, qt.query, list(pid ORDER BY pos) FILTER (WHERE role = 'pos') AS pos_ids, "
                       "list(score ORDER BY pos) FILTER (WHERE role = 'pos') AS pos_scores, "
                       "list(pid ORDER BY pos) FILTER (WHERE role = 'neg') AS neg_ids, "
                       "list(score ORDER BY pos) FILTER (WHERE role = 'neg') AS neg_scores "
                       "FROM hn h LEFT JOIN qt USING (qid) GROUP BY h.qid, qt.query", "hn", "qt"),
    "write_groups": sql("SELECT * FROM hn", "hn"),
    # the round
    "mining_round": sql(
        "SELECT 1 AS round, CAST((SELECT count(DISTINCT qid) FROM hn) AS BIGINT) AS mined_queries, "
        "CAST(t AS BIGINT) AS total, CAST(n AS BIGINT) AS new, CAST(t - n AS BIGINT) AS skip, "
        "round((t - n) / t, 6) AS skip_rate, round(m.mrr_at_10, 6) AS mrr_at_10, round(m.recall_at_1, 6) AS recall_at_1, "
        "round(m.recall_at_50, 6) AS recall_at_50, round(m.recall_at_all, 6) AS recall_at_all, "
        "CAST(m.queries_ranked AS BIGINT) AS queries_ranked, (SELECT count(*) FROM mg) AS merged_rows, "
        "(SELECT 9 * count(DISTINCT qid) FROM scored) AS training_rows FROM (SELECT (SELECT count(*) FROM hn WHERE pos < 100) AS t, "
        "(SELECT count(*) FROM newsc) AS n) x, m", "hn", "newsc", "scored", "mg", "m"),
    "mining_rounds": sql(
        "SELECT CAST(r AS INTEGER) AS round, CAST((SELECT count(DISTINCT qid) FROM hn) AS BIGINT) AS mined_queries, "
        "CAST(t AS BIGINT) AS total, CAST(CASE WHEN r = 1 THEN n ELSE 0 END AS BIGINT) AS new, "
        "CAST(CASE WHEN r = 1 THEN t - n ELSE t END AS BIGINT) AS skip, "
        "round(CASE WHEN r = 1 THEN (t - n) / t ELSE 1 END, 6) AS skip_rate, round(m.mrr_at_10, 6) AS mrr_at_10, "
        "round(m.recall_at_1, 6) AS recall_at_1, round(m.recall_at_50, 6) AS recall_at_50, "
        "round(m.recall_at_all, 6) AS recall_at_all, CAST(m.queries_ranked AS BIGINT) AS queries_ranked, "
        "(SELECT count(*) FROM mg) AS merged_rows, (SELECT 9 * count(DISTINCT qid) FROM scored) AS training_rows "
        "FROM (SELECT unnest([1, 2]) AS r), (SELECT (SELECT count(*) FROM hn WHERE pos < 100) AS t, "
        "(SELECT count(*) FROM (SELECT DISTINCT qid, pid FROM hn WHERE pos < 100)) AS n) x, m", "hn", "scored", "mg", "m"),
    "training_table": sql(
        "SELECT qid, slot, pid, score, query, array_to_string(list_slice(a, 1, CASE WHEN la + lb <= 141 THEN la WHEN la <= lb "
        "THEN least(la, 70) ELSE 141 - least(lb, 70) END), ' ') AS title, array_to_string(list_slice(b, 1, CASE WHEN la + lb <= 141 "
        "THEN lb WHEN la <= lb THEN 141 - least(la, 70) ELSE least(lb, 70) END), ' ') AS contents FROM ("
        f"SELECT g.qid, g.slot, g.pid, g.score, array_to_string(list_slice({_toks('qt.query')}, 1, 32), ' ') AS query, "
        f"{_toks('c.title')} AS a, {_toks('c.contents')} AS b, len({_toks('c.title')}) AS la, len({_toks('c.contents')}) AS lb "
        "FROM ga8 g JOIN qt USING (qid) JOIN corpus c USING (pid))", "ga8", "qt", "corpus"),
    "rejected_groups": sql(
        "SELECT qid, CAST(count(*) FILTER (WHERE role = 'pos') AS BIGINT) AS n_pos, "
        "CAST(count(*) FILTER (WHERE role = 'neg') AS BIGINT) AS n_neg FROM (SELECT qid, 'pos' AS role FROM qr UNION ALL "
        "SELECT r.qid, 'neg' FROM run10 r WHERE r.qid IN (SELECT qid FROM qt) AND r.qid IN (SELECT qid FROM qr) AND NOT EXISTS "
        "(SELECT 1 FROM qr WHERE qr.qid = r.qid AND qr.pid = r.pid)) GROUP BY qid HAVING n_pos = 0 OR n_neg = 0",
        "qr", "run10", "qt"),
    "annotations": sql("SELECT doc_id, i, CASE WHEN regexp_matches(token, '^\\p{Lu}') THEN 'CAP' ELSE 'O' END AS tag FROM toks", "toks"),
    "ngram_spans": sql("SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(s + L AS INTEGER) AS e FROM grams", "grams"),
    "encode_passages": ("SELECT doc_id AS pid, CAST(i AS INTEGER) AS i, x FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS i, unnest(["
                        "CAST(length(s) AS DOUBLE), length(s) - length(replace(s, ' ', '')), length(t), "
                        "length(t) - length(replace(t, ' ', ''))]) AS x FROM (SELECT doc_id, coalesce(source, '') AS s, "
                        "coalesce(text, '') AS t FROM documents))"),
    "encode_queries": ("SELECT item_id * 10 AS qid, CAST(i AS INTEGER) AS i, x FROM (SELECT item_id, unnest([0, 1]) AS i, unnest(["
                       "CAST(length(t) AS DOUBLE), length(t) - length(replace(t, ' ', ''))]) AS x "
                       "FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark))"),
    "batch_scorer": sql("SELECT x.qid, x.pid, CAST(length(coalesce(c.title, '') || ': ' || coalesce(c.contents, '')) - "
                        "length(qt.query) AS DOUBLE) AS score FROM (SELECT DISTINCT qid, pid FROM hn) x JOIN qt USING (qid) "
                        "JOIN corpus c USING (pid)", "hn", "qt", "corpus"),
    "retrieve_texts": (
        "SELECT qid, pid, CAST(rank AS INTEGER) AS rank FROM (SELECT q.qid, p.pid, row_number() OVER (PARTITION BY q.qid "
        "ORDER BY list_dot_product(q.v, p.v) DESC, p.pid) AS rank FROM (SELECT item_id * 10 AS qid, [CAST(length(t) AS DOUBLE), "
        "length(t) - length(replace(t, ' ', '')), length(t), length(t) - length(replace(t, ' ', ''))] AS v FROM "
        "(SELECT item_id, coalesce(text, '') AS t FROM benchmark)) q, (SELECT doc_id AS pid, [CAST(length(s) AS DOUBLE), "
        "length(s) - length(replace(s, ' ', '')), length(t), length(t) - length(replace(t, ' ', ''))] AS v FROM "
        "(SELECT doc_id, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents)) p) WHERE rank <= 10"),
    "evaluate_job": sql(
        "SELECT round(coalesce(sum(CASE WHEN f <= 10 THEN 1.0 / f END), 0) / nj, 6) AS mrr_at_10, "
        "round(count(*) FILTER (WHERE f <= 1) / nj, 6) AS recall_at_1, round(count(*) FILTER (WHERE f <= 50) / nj, 6) AS recall_at_50, "
        "round(count(f) / nj, 6) AS recall_at_all, CAST((SELECT count(DISTINCT qid) FROM fused) AS BIGINT) AS queries_ranked, "
        "CAST((SELECT count(DISTINCT qid) FROM fused WHERE qid IN (SELECT qid FROM qe)) AS BIGINT) AS queries_evaluated, "
        "CAST(nj AS BIGINT) AS queries_judged, CAST((SELECT count(*) FROM (SELECT 1 FROM fused WHERE pid <> 0 GROUP BY qid, pid "
        "HAVING count(*) > 1)) AS BIGINT) AS repeated_pairs FROM (SELECT count(DISTINCT qid) AS nj FROM qe) LEFT JOIN "
        "(SELECT qid, min(rank) AS f FROM fused JOIN (SELECT DISTINCT qid, pid FROM qe) USING (qid, pid) GROUP BY qid) ON true "
        "GROUP BY nj", "fused", "qe"),
    "stage": sql("SELECT qid, pid, rel FROM qr", "qr"),
    "score_stream": sql(f"SELECT h.qid, h.role, h.pos, h.pid, round({TEACH}, 6) AS score FROM hn h "
                        "JOIN q USING (qid) JOIN p USING (pid) WHERE h.pos < 100", "hn", "q", "p"),
}
