"""Rounds share the score cache and resume from their stage folders."""

import numpy as np
from pyspark.sql import functions as F

from dpmine.operators.scoring import vector_teacher
from dpmine.plans.jobs import RoundConfig, mining_rounds


def test_texts_of_a_shard_are_dealt_to_several_tasks(spark, tmp_path):
    from dpmine.plans.jobs import encode_shards
    rows = spark.range(600).select("id", F.repeat(F.md5(F.col("id").cast("string")), 40).alias("text")).repartition(6)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    try:
        out = encode_shards(rows, str(tmp_path), "id", ["text"], lambda: lambda texts: [[float(len(t))] for t, in texts], "m", shards=2)
        assert {(r.id, tuple(r.vec)) for r in out.collect()} == {(i, (1280.0,)) for i in range(600)}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [len(list(tmp_path.glob(f"*/texts-*/shard={s}/*.parquet"))) for s in range(2)]
    assert min(files) > 1, files


def test_two_rounds_reuse_cache(spark, tmp_path):
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(6)], "qid long, vec array<double>")
    p = spark.createDataFrame([(100 + i, [float(x) for x in rng.normal(size=4)]) for i in range(40)],
                              "pid long, vec array<double>")
    qrels = spark.createDataFrame([(i, 100 + i, 1) for i in range(6)], "qid long, pid long, rel int")
    texts = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "qid long, query string")
    cfg = RoundConfig(train_k=20, dev_k=10, depth=5, cap=100)
    calls = []

    def scorer_for_round(i):
        calls.append(i)
        return vector_teacher(q, p)

    args = dict(vectors_for_round=lambda i: (q, q, p), train_queries_text=texts, qrels=qrels, dev_qrels=qrels,
                scorer_for_round=scorer_for_round, cfg=cfg)
    s = {r["round"]: r for r in mining_rounds(spark, str(tmp_path), 2, **args).collect()}
    assert s[1]["new"] > 0 and s[2]["new"] == 0 and s[2]["skip_rate"] == 1.0
    assert s[1]["mrr_at_10"] == s[2]["mrr_at_10"]
    # a rerun finds every stage written: no scorer call, same summaries
    calls.clear()
    again = {r["round"]: r for r in mining_rounds(spark, str(tmp_path), 2, **args).collect()}
    assert calls == [] and again == s
    cache = spark.read.parquet(str(tmp_path / "score_cache" / "scorer=teacher" / "data"))
    # other parameters: other stages and cache batches, no stale score and no null
    deeper = mining_rounds(spark, str(tmp_path), 1, **{**args, "cfg": RoundConfig(train_k=20, dev_k=10, depth=10, cap=100, negatives=3)})
    row = deeper.first()
    assert row["new"] == 30 and row["total"] == 66 and row["merged_rows"] == 66 and row["training_rows"] == 24
    cache = spark.read.parquet(str(tmp_path / "score_cache" / "scorer=teacher" / "data"))
    assert cache.groupBy("qid", "pid").count().filter(F.col("count") > 1).count() == 0


def test_training_table_has_text_for_every_slot(spark):
    from dpmine.plans.jobs import training_table
    long = spark.createDataFrame([(1, "pos", 0, 5, 1.0)] + [(1, "neg", i, 10 + i, 0.0) for i in range(4)],
                                 "qid long, role string, pos int, pid long, score double")
    corpus = spark.createDataFrame([(p, f"t{p}", f"c{p}") for p in [5, 10, 11, 12, 13]],
                                   "pid long, title string, contents string")
    queries = spark.createDataFrame([(1, "q one")], "qid long, query string")
    rows = training_table(long, queries, corpus, n=3, seed=7).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2, 3]
    assert all(r.title == f"t{r.pid}" and r.query == "q one" for r in rows)
    assert [r.pid for r in rows if r.slot == 0] == [5]


def test_model_sees_each_pair_once(spark, tmp_path):
    from dpmine.operators import scoring as SC
    place = str(tmp_path)
    long = spark.createDataFrame([(1, "pos", 0, 5, 1.0)] + [(1, "neg", i, 10 + i, 0.0) for i in range(4)],
                                 "qid long, role string, pos int, pid long, score double")
    texts = spark.createDataFrame([(1, "q")], "qid long, query string")
    corpus = spark.createDataFrame([(p, "t", f"c{p}") for p in [5, 10, 11, 12, 13]], "pid long, title string, contents string")

    def make_model():
        def model(queries, passages):
            import uuid
            with open(f"{place}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(passages))
            return [1.0] * len(queries)
        return model
    scored, new, stats = SC.score_groups(long, None, SC.batch_scorer(make_model, texts, corpus, model_key="seen"))
    assert scored.count() == 5 and new.count() == 5 and stats.first()["new"] == 5
    import os
    assert sum(len(open(f"{place}/{n}").read().split("\n")) for n in os.listdir(place)) == 5


def test_training_table_is_strict(spark):
    import pytest
    from dpmine.plans.jobs import training_table
    long = spark.createDataFrame([(1, "pos", 0, 5, 1.0), (1, "neg", 0, 6, 0.0), (2, "pos", 0, 5, 1.0)],
                                 "qid long, role string, pos int, pid long, score double")
    corpus = spark.createDataFrame([(5, "a b", "c d e f"), (6, "a", "b")], "pid long, title string, contents string")
    queries = spark.createDataFrame([(1, "one two three")], "qid long, query string")
    rows = training_table(long, queries, corpus, n=1, query_len=2, passage_len=4).collect()
    assert {(r.slot, r.query, r.title, r.contents) for r in rows} == {(0, "one two", "a b", "c d"), (1, "one two", "a", "b")}
    with pytest.raises(Exception, match="incomplete group"):
        training_table(long, queries, corpus, n=1, strict=True).collect()
    with pytest.raises(Exception, match="not in the corpus"):
        training_table(long, queries, corpus.filter("pid = 5"), n=1).collect()


def test_clear_scratch_removes_this_applications_tables(spark):
    import os
    from dpmine.session import clear_scratch, materialize
    materialize(spark.range(3), "gone")
    root = os.path.join(spark.sparkContext.getCheckpointDir().split("file:")[-1], "..")
    found = [d for d, _, _ in os.walk(root) if d.endswith(spark.sparkContext.applicationId)]
    assert found
    clear_scratch(spark)
    assert not os.path.exists(found[0])


def _texts(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"t{i % 7}", "word " * (i % 23) + "end" * (i % 5)) for i in range(120)],
                                   "pid long, title string, contents string")
    queries = spark.createDataFrame([(i, "ask " * (i + 1)) for i in range(6)], "qid long, query string")
    corpus.write.parquet(str(tmp_path / "corpus"))
    queries.write.parquet(str(tmp_path / "queries"))
    return spark.read.parquet(str(tmp_path / "queries")), spark.read.parquet(str(tmp_path / "corpus"))


def test_retrieve_resumes_by_shard(spark, tmp_path):
    """Killed half way, the job encodes only the missing shards; the run is the one of an undisturbed job."""
    import pytest
    from dpmine.plans.jobs import retrieve_texts
    queries, corpus = _texts(spark, tmp_path)
    root, flag = str(tmp_path / "job"), tmp_path / "broken"
    flag.write_text("x")
    where, log = str(flag), str(tmp_path / "calls-")      # models live on in the workers: they count in files

    def calls(side):
        return sum(len(f.read_bytes()) for f in tmp_path.glob(f"calls-{side}-*"))

    def count(side, n):
        import os
        with open(f"{log}{side}-{os.getpid()}", "ab") as f:
            f.write(b"x" * n)

    def _numbers(*parts):                      # local, so that it travels to the workers with the models
        return [float(f(x or "")) for x in parts for f in (len, lambda t: t.count(" "))]

    def query_model():
        def run(rows):
            count("queries", len(rows))
            return [2 * _numbers(x) for (x,) in rows]
        return run

    def passage_model():
        import os

        def run(rows):
            if os.path.exists(where) and any(c.startswith("word " * 17 + "end") for _, c in rows):
                raise RuntimeError("model died")
            count("passages", len(rows))
            return [_numbers(*pair) for pair in rows]
        return run

    args = (root, queries, corpus, query_model, passage_model, 5, "v1")
    with pytest.raises(Exception, match="model died"):
        retrieve_texts(spark, *args, shards=24)
    before = calls("passages")
    assert calls("queries") == 6
    from dpmine.sources.commits import CommitLog, folders
    stage, = [f"{root}/passages/{n}" for n in folders(spark, f"{root}/passages") if n.startswith("encode-")]
    committed = [e for e in CommitLog(spark, f"{stage}/log").entries()[1]]
    kept = sum(spark.read.parquet(e["folder"]).count() for e in committed if e["folder"])
    assert 0 < kept <= before < 120                                    # some shards are done
    flag.unlink()
    run = retrieve_texts(spark, *args, shards=24, run_path=f"{root}/run.tsv")
    assert calls("queries") == 6 and calls("passages") - before == 120 - kept      # only what is missing
    P = {r.pid: _numbers(r.title, r.contents) for r in corpus.collect()}
    for r in queries.collect():
        q = 2 * _numbers(r.query)
        best = sorted(P, key=lambda p: (-sum(a * b for a, b in zip(q, P[p])), p))[:5]
        assert [x.pid for x in run.filter(F.col("qid") == r.qid).orderBy("rank").collect()] == best
    again = retrieve_texts(spark, *args, shards=24)
    assert (calls("queries"), calls("passages") - before) == (6, 120 - kept) and again.count() == 30
    from dpmine.sources import io as IO
    assert IO.read_run(spark, f"{root}/run.tsv").count() == 30


def test_retrieve_gaussian_texts(spark, tmp_path):
    from dpmine.plans.jobs import retrieve_texts
    queries, corpus = _texts(spark, tmp_path)
    gauss = lambda: lambda rows: [[len(c) / 10, c.count(" ") / 10, 1.0 + len(t), 2.0] for t, c in rows]
    point = lambda: lambda rows: [[len(x) / 10, x.count(" ") / 10] for (x,) in rows]
    run = retrieve_texts(spark, str(tmp_path / "g"), queries, corpus, point, gauss, 3, "g1", gaussian=True, shards=2).collect()
    P = {r.pid: (r.title, r.contents) for r in corpus.collect()}
    for r in queries.collect():
        m = point()([(r.query,)])[0]

        def density(p):
            a, b, v, w = gauss()([P[p]])[0]
            return -0.5 * (np.log(v) + np.log(w) + (m[0] - a) ** 2 / v + (m[1] - b) ** 2 / w)
        best = sorted((x for x in run if x.qid == r.qid), key=lambda x: x["rank"])
        assert np.allclose([density(x.pid) for x in best], sorted((density(p) for p in P), reverse=True)[:3])


def test_changed_judgements_rebuild_a_round(spark, tmp_path):
    """An input file changes: the round is mined anew without a version being named; unchanged, it is read."""
    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(4)], "qid long, vec array<double>")
    p = spark.createDataFrame([(100 + i, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "pid long, vec array<double>")
    texts = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "qid long, query string")
    judged, calls = str(tmp_path / "qrels"), []
    spark.createDataFrame([(0, 100, 1), (1, 101, 1)], "qid long, pid long, rel int").write.parquet(judged)

    def mine():
        qrels = spark.read.parquet(judged)
        out = mining_rounds(spark, str(tmp_path / "rounds"), 1, vectors_for_round=lambda i: (q, q, p), train_queries_text=texts,
                            qrels=qrels, dev_qrels=qrels, scorer_for_round=lambda i: calls.append(i) or vector_teacher(q, p),
                            cfg=RoundConfig(train_k=15, dev_k=10, depth=5, negatives=2))
        return out.first()["mined_queries"]
    assert mine() == 2 and mine() == 2 and calls == [1]
    spark.createDataFrame([(2, 102, 1)], "qid long, pid long, rel int").write.mode("append").parquet(judged)
    assert mine() == 3 and calls == [1, 1]
