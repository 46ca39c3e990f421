"""S1-S11 readers and writers (E3, E4, E9) and the stage helper."""

import pytest

from dpmine.sources import io as IO


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_queries_keep_quotes_and_na(spark, tmp_path):
    # No quoting, no NA words
    path = _write(tmp_path, "q.tsv", '1\t"abc\n2\tNA\n3\tnull\n')
    rows = sorted(tuple(r) for r in IO.read_queries(spark, path).collect())
    assert rows == [(1, '"abc'), (2, "NA"), (3, "null")]


def test_query_line_needs_two_fields(spark, tmp_path):
    path = _write(tmp_path, "bad.tsv", "1\ta\tb\n")
    with pytest.raises(Exception):
        IO.read_queries(spark, path).collect()


def test_qrels_any_whitespace_rel_kept(spark, tmp_path):
    # rel = 0 rows are read
    path = _write(tmp_path, "qrels.txt", "1 0 5 1\n2\t0\t7\t0\n")
    rows = IO.read_qrels(spark, path).orderBy("line").collect()
    assert [(r.qid, r.pid, r.rel) for r in rows] == [(1, 5, 1), (2, 7, 0)]


def test_run_rank_rules(spark, tmp_path):
    # Rank 0 fails; ranks above max: skipped by the mining reader, an error for evaluation
    good = _write(tmp_path, "run.tsv", "1\t5\t1\n1\t6\t1001\n")
    assert [tuple(r) for r in IO.read_run(spark, good, 1000, "skip").collect()] == [(1, 5, 1)]
    with pytest.raises(Exception):
        IO.read_run(spark, good, 1000, "error").collect()
    zero = _write(tmp_path, "run0.tsv", "1\t5\t0\n")
    with pytest.raises(Exception):
        IO.read_run(spark, zero, 1000).collect()
    # Repeated (qid, rank) is reported
    dup = _write(tmp_path, "rund.tsv", "1\t5\t2\n1\t6\t2\n")
    assert IO.run_conflicts(IO.read_run(spark, dup)).count() == 1


def test_run_round_trip_ordered(spark, tmp_path):
    run = spark.createDataFrame([(2, 9, 1), (1, 5, 2), (1, 4, 1)], "qid long, pid long, rank int")
    path = str(tmp_path / "out")
    IO.write_run(run, path)
    assert sorted(tuple(r) for r in IO.read_run(spark, path).collect()) == [(1, 4, 1), (1, 5, 2), (2, 9, 1)]


def test_corpus_ordinals_follow_file_order(spark, tmp_path):
    path = _write(tmp_path, "c.jsonl", "\n".join('{"title": "t%d", "contents": "c%d"}' % (i, i) for i in range(7)))
    rows = sorted(tuple(r) for r in IO.read_corpus(spark, path).collect())
    assert rows == [(i, f"t{i}", f"c{i}") for i in range(7)]


def test_groups_round_trip(spark, tmp_path):
    long = spark.createDataFrame([(1, "pos", 0, 5, 1.0), (1, "neg", 0, 7, 0.0), (1, "neg", 1, 6, 0.0)],
                                 "qid long, role string, pos int, pid long, score double")
    q = spark.createDataFrame([(1, "hello")], "qid long, query string")
    path = str(tmp_path / "g")
    IO.write_groups(long, q, path)
    g = IO.read_groups(spark, path).first()
    assert (g.qid, g.query, g.negatives.doc_id) == (1, "hello", [7, 6])
    assert {tuple(r) for r in IO.read_groups_long(spark, path).collect()} == {tuple(r) for r in long.collect()}


def test_stage_written_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    st = IO.Stage(spark, str(tmp_path), "run", {"k": 10})
    assert st.get(build).count() == 3 and st.get(build).count() == 3
    assert len(calls) == 1
    assert IO.Stage(spark, str(tmp_path), "run", {"k": 20}).path != st.path


def test_bucketed_corpus_lookup_shuffles_only_ids(spark, tmp_path):
    from dpmine.operators.groups import lookup_passages
    corpus = spark.createDataFrame([(i, f"t{i}", f"c{i}") for i in range(200)], "pid long, title string, contents string")
    table = IO.save_bucketed_corpus(corpus, "corpus_bucketed_test", str(tmp_path / "corpus"), 8)
    ids = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (2, 0, 199)], "qid long, slot int, pid long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_passages(ids, table)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.pid, r.title) for r in joined.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(5, "t5"), (7, "t7"), (199, "t199")]
    assert plan.count("Exchange hashpartitioning") == 1


def test_last_line_wins_when_asked(spark, tmp_path):
    q = _write(tmp_path, "dup.tsv", "1\tfirst\n2\tx\n1\tsecond\n")
    assert sorted(tuple(r) for r in IO.read_queries(spark, q, keep="last").collect()) == [(1, "second"), (2, "x")]
    assert IO.read_queries(spark, q).count() == 3
    r = _write(tmp_path, "dup_run.tsv", "1\t5\t2\n1\t6\t2\n1\t7\t1\n")
    assert sorted(tuple(x) for x in IO.read_run(spark, r, keep="last").collect()) == [(1, 6, 2), (1, 7, 1)]


def _corpus_files(tmp_path, gz=False):
    import gzip
    import json
    rows, folder = [], tmp_path / ("gz" if gz else "plain")
    folder.mkdir()
    for f in range(3):
        part = [{"title": f"t{f}", "contents": f"line {i} of {f} " + "x" * (i % 50)} for i in range(150 + 40 * f)]
        text = "\n\n".join(json.dumps(r) for r in part) + "\n  \n"                   # blank lines don't count
        if gz:
            (folder / f"part-{f}.json.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (folder / f"part-{f}.json").write_text(text)
        rows += [(r["title"], r["contents"]) for r in part]
    return str(folder), {(i, *r) for i, r in enumerate(rows)}


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("split", ["128m", "9k", "2k"])
def test_corpus_ids_are_line_ordinals_without_an_exchange_of_text(spark, tmp_path, split, gz):
    path, want = _corpus_files(tmp_path, gz)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, split)
        df = IO.read_corpus(spark, path)
        assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [value" not in plan
        assert "Exchange" not in plan[plan.index("BroadcastHashJoin"):plan.index("FileScan text")]
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_other_splits_fail_instead_of_renumbering(spark, tmp_path):
    path, _ = _corpus_files(tmp_path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    try:
        df = IO.read_corpus(spark, path)
        for n in names:
            spark.conf.set(n, "2k")
        with pytest.raises(Exception, match="splits changed"):
            df.select("pid").collect()
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_stage_is_keyed_by_its_inputs(spark, tmp_path):
    import os
    source, root, runs = str(tmp_path / "in"), str(tmp_path / "stages"), []
    spark.range(5).write.parquet(source)

    def chain():
        read = spark.read.parquet(source).filter("id > 0")
        a = IO.Stage(spark, root, "a", {"k": 1}, [read])
        one = a.get(lambda: runs.append("a") or read.selectExpr("id * 2 AS x"))
        b = IO.Stage(spark, root, "b", {}, [one])
        return sorted(r.x for r in b.get(lambda: runs.append("b") or one).collect())

    assert chain() == [2, 4, 6, 8] and chain() == [2, 4, 6, 8] and runs == ["a", "b"]
    spark.range(5, 7).write.mode("append").parquet(source)              # an input changes: no version has to be named
    assert chain() == [2, 4, 6, 8, 10, 12] and runs == ["a", "b", "a", "b"]
    assert not [n for n in os.listdir(root) if n.endswith(".tmp")]
    other = IO.Stage(spark, root, "a", {"k": 1}, [spark.read.parquet(source).filter("id > 1")])
    assert not other.exists()                                           # another plan over the same files


def test_interrupted_stage_is_built_anew(spark, tmp_path):
    stage = IO.Stage(spark, str(tmp_path), "s")
    with pytest.raises(Exception, match="model died"):
        stage.get(lambda: spark.range(3).selectExpr("raise_error('model died') AS x"))
    assert not stage.exists()
    assert stage.get(lambda: spark.range(3)).count() == 3 and stage.exists()
