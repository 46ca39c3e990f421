"""User model hooks (U1, U2), variance floor (E20), softplus edges."""

import math

import numpy as np
import pytest

from dpmine.functions import vectors as V
from dpmine.operators import encode as EN
from dpmine.operators import scoring as SC


def test_encode_calls_model_per_batch(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x" * i) for i in range(10)], "pid long, title string, contents string")

    def make_model():
        def model(pairs):
            return np.array([[len(a), len(b)] for a, b in pairs], dtype=float)
        return model

    got = {r.pid: r.vec for r in EN.encode(docs, "pid", ["title", "contents"], make_model, batch_size=3).collect()}
    assert got == {i: [float(len(f"t{i}")), float(i)] for i in range(10)}


def test_dense_vectors_from_hashed_bag(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "")], "doc_id long, text string")
    sparse = EN.hashed_bag(docs, dim=8)
    dense = {r.doc_id: r.vec for r in EN.dense_vectors(sparse, "doc_id", 8).collect()}
    assert sum(dense[0]) == 3.0 and len(dense[0]) == 8 and 1 not in dense


def test_batch_scorer(spark):
    q = spark.createDataFrame([(1, "hello world")], "qid long, query string")
    c = spark.createDataFrame([(5, "t", "hello"), (6, "t", "zzz")], "pid long, title string, contents string")
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "qid long, pid long")

    def make_model():
        return lambda queries, passages: [float(sum(w in p for w in qq.split())) for qq, p in zip(queries, passages)]

    got = {r.pid: r.score for r in SC.score_pairs(pairs, SC.batch_scorer(make_model, q, c, batch_size=1, model_key='contained')).collect()}
    assert got == {5: 1.0, 6: 0.0}


def test_softplus_edges_and_variance_floor(spark):
    xs = [-50.0, 0.0, 9.999, 10.0, 800.0]
    df = spark.createDataFrame([(xs,)], "v array<double>")
    got = df.select(V.softplus("v").alias("s")).first().s
    want = [math.log1p(math.exp(x)) if x < 10 else x for x in xs]
    assert got == pytest.approx(want, rel=1e-12)
    z = spark.createDataFrame([([0.5], [0.0])], "m array<double>, v array<double>")
    floored = z.select(V.fold_passage("m", "v", min_var=1e-12).alias("f")).first().f
    assert all(math.isfinite(x) for x in floored)
    assert z.select(V.non_finite(V.fold_passage("m", "v")).alias("bad")).first().bad


def test_model_is_built_once_per_worker(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "pid long, title string").repartition(40)
    place = str(tmp_path)

    def make_model():
        import os
        import uuid
        open(f"{place}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda rows: [[float(len(t))] for t, in rows]

    out = EN.encode(docs, "pid", ["title"], make_model, model_key="counted")
    assert out.count() == 200 and out.count() == 200
    import os
    built = [name.split("-")[0] for name in os.listdir(place)]
    assert len(built) == len(set(built)) <= spark.sparkContext.defaultParallelism * 2


def test_missing_text_or_vector_is_an_error(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 5)], "qid long, pid long")
    q = spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>")
    p = spark.createDataFrame([(5, [1.0])], "pid long, vec array<double>")
    with pytest.raises(Exception, match="missing"):
        SC.score_pairs(pairs, SC.vector_teacher(q, p)).collect()
    texts = spark.createDataFrame([(1, "a")], "qid long, query string")
    corpus = spark.createDataFrame([(5, "t", "c")], "pid long, title string, contents string")
    with pytest.raises(Exception, match="missing"):
        SC.score_pairs(pairs, SC.overlap_scorer(texts, corpus)).collect()


def test_batches_by_length_waste_little_padding():
    """Padding to the longest text of a batch: far less than with batches in the order of the rows."""
    import numpy as np
    from dpmine.operators.encode import batches_by_length
    rng = np.random.default_rng(0)
    lengths = rng.geometric(0.01, 5000)
    padded = lambda parts: sum(len(p) * lengths[p].max() for p in parts) / lengths.sum()
    sorted_parts = batches_by_length(lengths, 64)
    assert sorted(np.concatenate(sorted_parts).tolist()) == list(range(5000))
    assert padded(sorted_parts) < 1.1 and padded(np.array_split(np.arange(5000), 79)) > 3


def test_model_stages_carry_their_resources(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
    from dpmine.operators.encode import encode
    from dpmine.operators.scoring import batch_scorer
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    docs = spark.createDataFrame([(1, "a")], "pid long, contents string")
    model = lambda: lambda rows: [[1.0] for _ in rows]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan()

    def profile_of(node):
        while node.getClass().getSimpleName() != "MapInPandas":
            node = node.children().apply(0)
        return node.profile().isDefined()
    assert profile_of(plan(encode(docs, "pid", ["contents"], model, profile=profile)))
    assert not profile_of(plan(encode(docs, "pid", ["contents"], model)))
    queries = spark.createDataFrame([(1, "q")], "qid long, query string")
    pairs = spark.createDataFrame([(1, 1)], "qid long, pid long")
    scorer = batch_scorer(lambda: lambda q, p: [1.0] * len(q), queries, docs.withColumn("title", docs.contents), profile=profile)
    assert profile_of(plan(scorer(pairs)))
