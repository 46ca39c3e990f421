import numpy as np
import pytest
from pyspark.sql import functions as F

from dpmine.llm import queries, topk


def brute(ids, vectors, asked, k):
    out = []
    for i in asked:
        scores = vectors @ vectors[ids.index(i)]
        ranked = sorted((-int(s), v) for s, v in zip(scores, ids) if v != i)[:k]
        out += [(i, n + 1, v, -s) for n, (s, v) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("spread, bucket, seeds", [(0.0, 50, 20), (1.0, 64, 30), (3.0, 1000, 5), (0.0, 50, 3)])
def test_equals_brute_force(spark, spread, bucket, seeds):
    rng = np.random.default_rng(int(spread * 10) + bucket)
    x = rng.normal(size=(400, 8)) * np.exp(spread * rng.normal(size=(400, 1)))
    x[100:200] = x[100]                                       # a quarter of the rows are one vector
    x[200:230] = x[rng.integers(0, 100, 30)] + 0.01
    frame = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, 5, bucket=bucket, block=13, seeds=seeds).collect())
    assert got == brute(list(range(400)), np.floor(256 * x).astype(np.int64), range(0, 400, 10), 5)


def test_coordinate_ranges_lose_nothing():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = rng.normal(size=6)
        v = np.floor(100 * (base + rng.normal(size=(300, 6)) * rng.choice([0.05, 0.3, 1]))).astype(np.int64)
        bucket = topk.Bucket(np.arange(300), v)
        q = v[0]
        scores = bucket.vectors @ q
        bound = int(np.sort(scores)[-int(rng.integers(1, 20))])
        rows = bucket.candidates(q, float(np.sqrt(q @ q)), bound)
        assert set(np.flatnonzero(scores >= bound)) <= set(rows.tolist())


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    v = np.floor(256 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    got = sorted(tuple(r) for r in queries.op4_exact_topk_search(spark, path).collect())
    assert got == brute(ids, v, [i for i in ids if i % 50 == 0], 5)


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(120, 6))) / 256
    x[1:8] = x[0] * np.arange(8, 1, -1)[:, None]              # the best partners of 0 are in one bucket
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(x)]
    rows = 2 * rows + 7 * rows[1:3] + 3 * rows[:1]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(list(range(120)), np.floor(256 * x).astype(np.int64), range(0, 120, 10), 5)
    for bucket, seeds in ((2048, 4096), (30, 12)):
        got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, 5, bucket=bucket, block=5, seeds=seeds).collect())
        assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (50, [0.0, 0.0]), (5, [None, 1.0]),
            (6, []), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (100, [nan, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 7, 65536), (0, 3, 50, 0),
                   (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 7, 0)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True), 1)


def test_repeated_rows_are_one_row_in_the_sql_too(spark, tmp_path):
    """Rows of one id and vector count once on both sides; a vector under other ids counts for each."""
    import duckdb
    rng = np.random.default_rng(4)
    vecs = [[float(x) for x in rng.normal(0, 0.2, 6)] for _ in range(30)]
    rows = [(i, vecs[i % 30]) for i in range(120)] + [(i, vecs[i % 30]) for i in range(0, 120, 3) for _ in range(7)] + [
        (None, vecs[0]), (200, None), (201, [float("nan")] * 6), (202, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute("SELECT query_id, rank, vec_id, score FROM (" + queries.SQL["op4_exact_topk_search"] + ")").fetchall())
    got = sorted(tuple(r) for r in queries.op4_exact_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want and len(got) == 15
