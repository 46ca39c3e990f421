import numpy as np
import pytest
from pyspark.sql import functions as F

from dpmine.llm import whitening as WH
from dpmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(x, components):
    """Whitened vectors, eigenvalue shares and deviations from a full eigendecomposition."""
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return z @ u / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(axis=1)


def check(got, ids, x, components, tolerance=1e-9):
    white, explained, deviation = brute(x, components)
    at = {i: k for k, i in enumerate(ids)}
    rows = got.assign(row=[at[i] for i in got.id]).sort_values(["row", "component"])
    w = rows.whitened.to_numpy().reshape(len(x), components)
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w * signs - white).max() < tolerance
    assert np.abs(rows.explained.to_numpy().reshape(len(x), components) / explained - 1).max() < 1e-9
    assert (rows.deviation.to_numpy().reshape(len(x), components) == deviation[:, None]).all()
    assert set(rows.n) == {len(x)} and rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("d,n,components", [(64, 400, 32), (24, 60, 5), (40, 900, 3)])
def test_fit_is_the_eigendecomposition(spark, d, n, components):
    """Subspaces narrower than the vectors, with flat and with falling spectra."""
    rng = np.random.default_rng(d)
    x = rng.normal(0, 1, (n, d)) * (1 if d == 64 else 0.8 ** np.arange(d))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = WH.whiten(df.repartition(3), components=components).toPandas()
    check(got, range(n), np.floor(64 * x).astype(np.int64) + 10 ** 6, components)


def test_passes_multiply_and_certify(spark, monkeypatch):
    """The covariance comes in through passes over the rows only, and the residuals are under the bound."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 80)]) for i in range(500)], "vec_id long, embedding array<double>")
    passes, multiply = [], WH.multiply
    monkeypatch.setattr(WH, "multiply", lambda *a: passes.append(a[3].shape) or multiply(*a))
    found = WH.fit(WH.integer_rows(df, "vec_id", "embedding"), 32)
    assert set(passes) == {(80, 32 + WH.GUARD)} and len(passes) > WH.DEGREE
    assert found.residuals.max() <= WH.STALLED and (np.diff(found.values) <= 0).all()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(32)).max() < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    hot = [float(x) for x in rng.normal(0, 1, 6)]
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(40)] + [(100 + i, hot) for i in range(60)] + [(3, hot), (3, hot), (None, hot)]
    bad = [(900, None), (901, []), (902, [0.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("id", "vec", "n", "component", "i")})
    got = WH.whiten(df, components=4).toPandas()
    assert len(got) == 4 * len(rows) and sorted(set(got.component)) == [1, 2, 3, 4]
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 10 ** 6
    white, _, deviation = brute(x, 4)
    want = sorted((r[0] if r[0] is not None else -1, int(dv)) for r, dv in zip(rows, deviation))
    assert sorted((-1 if i != i else int(i), dv) for i, dv in zip(got[got.component == 1].id, got[got.component == 1].deviation)) == want
    first = got[got.component == 1].sort_values("whitened").whitened.to_numpy()
    assert min(np.abs(first - np.sort(s * white[:, 0])).max() for s in (1, -1)) < 1e-9
    assert WH.whiten(df.limit(0)).collect() == [] and WH.whiten(df.filter("vec_id >= 100")).collect() == []   # equal vectors
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in WH.whiten(flat).collect()} == {1}                                        # rank one
    with pytest.raises(ValueError):
        WH.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="(?i)beyond|overflow"):
        WH.whiten(spark.createDataFrame([(1, [1e20])], "vec_id long, embedding array<double>"))


def test_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    got = QUERIES["op11_embedding_whitening"](spark, SF).toPandas().rename(columns={"vec_id": "id"})
    check(got, e.vec_id.tolist(), np.floor(64 * np.stack(e.embedding).astype(np.float64)).astype(np.int64) + 10 ** 6, 32)
