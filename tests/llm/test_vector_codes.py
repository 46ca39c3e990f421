import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpmine.llm import vector_codes as VC
from dpmine.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def nearest(parts, entries):
    """Brute force: all differences, first smallest entry."""
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def brute(rows, parts, entries, rounds):
    """Sorted ``(id, label, vec)`` rows -> codes, errors, label errors and the digest, by the definition."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in rows], np.int64)
    d = x.shape[1] // parts
    books = [x[:entries, p * d:(p + 1) * d].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            part = x[:, p * d:(p + 1) * d]
            own, _ = nearest(part, books[p])
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p][e] = part[own == e].sum(axis=0) // (own == e).sum()
    found = [nearest(x[:, p * d:(p + 1) * d], books[p]) for p in range(parts)]
    errors = sum(f[1] for f in found)
    total = {}
    for r, e in zip(rows, errors.tolist()):
        total[r[1]] = total.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], r[1], "".join(f"{f[0][i]:02x}" for f in found), int(errors[i]), total[r[1]], digest)
                   for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("d,low,high", [(1, 0, 3), (3, -2, 2), (5, -1000, 1000), (8, 0, 1)])
def test_walk_is_brute_force(d, low, high):
    rng = np.random.default_rng(d)
    parts = np.unique(rng.integers(low, high + 1, (400, d)), axis=0)
    entries = rng.integers(low, high + 1, (17, d))                     # equal entries too: the lower index wins
    own, distance = VC.walk(parts, entries)
    want = nearest(parts, entries)
    assert (own == want[0]).all() and (distance == want[1]).all()
    repeated = parts[rng.integers(0, len(parts), 900)]
    own, distance = VC.assign(repeated, entries)
    want = nearest(repeated, entries)
    assert (own == want[0]).all() and (distance == want[1]).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda: [float(x) for x in rng.normal(0, 0.1, 8)]
    hot = v()
    rows = [(i, v(), i % 3 if i % 5 else None) for i in range(60)] + [(1000 + i, hot, 1) for i in range(50)] + [
        (7, v(), 1), (7, hot, None), (None, v(), None), (None, hot, 2)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 7 + [None], 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("id", "vec", "code", "part", "_label")})
    got = sorted((tuple(r) for r in VC.vector_codes(df, parts=4, entries=16, rounds=3).collect()), key=repr)
    whole = [(i, lab, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, lab in rows]
    assert got == brute(whole, 4, 16, 3)
    assert VC.vector_codes(df.limit(0)).collect() == []
    few = VC.vector_codes(df.filter("vec_id < 3")).collect()           # fewer rows than entries
    assert len(few) == 3 and all(r["error"] == 0 for r in few)
    with pytest.raises(ValueError):
        VC.vector_codes(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ValueError):
        VC.vector_codes(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="beyond"):
        VC.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<double>, label int"))


def test_label_join_can_split(spark):
    """The label totals are a stored table, not an aggregate in the join's stage."""
    df = spark.createDataFrame([(i, [float(i % 7)] * 4, 1) for i in range(40)], "vec_id long, embedding array<double>, label int")
    assert "Aggregate" not in VC.vector_codes(df)._jdf.queryExecution().optimizedPlan().toString()


def test_query_is_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(SQL["op13_vector_codes"]).df().sort_values("vec_id")
    got = QUERIES["op13_vector_codes"](spark, SF).toPandas().sort_values("vec_id")
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c
