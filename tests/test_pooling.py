"""pooling token rows, with projections and without."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpmine.functions import vectors as V
from dpmine.operators import pooling as PL


def _tokens(n=200, d=5, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(s), p, [float(x) for x in rng.normal(0, 3, d)], bool(p % 4)) for p, s in enumerate(rng.integers(0, 4, n))]


def _brute(rows, w):
    """Attention as the model computes it: every token projected, softmax over the unmasked, weighted sum."""
    out = {}
    for s in {r[0] for r in rows}:
        x = np.array([r[2] for r in rows if r[0] == s])
        mask = np.array([r[3] for r in rows if r[0] == s])
        q = w.query @ x[0] + w.query_bias
        k, v = x @ w.key.T, x @ w.value.T + w.value_bias
        a = np.where(mask, k @ q / np.sqrt(x.shape[1]), -np.inf)
        a = np.exp(a - a.max())
        out[s] = (x[0], (a / a.sum()) @ v)
    return out


def _weights(d, inner, out, seed=1):
    rng = np.random.default_rng(seed)
    m = lambda *s: rng.normal(0, 1, s)
    return PL.Projections(m(inner, d), m(inner, d), m(out, d), m(inner), m(out))


@pytest.mark.parametrize("parts", [1, 7])
def test_projected_attention_is_the_model(spark, parts):
    rows, w = _tokens(), _weights(5, 6, 3)
    df = spark.createDataFrame(rows, "seq long, pos long, vec array<double>, mask boolean").repartition(parts)
    got = {(r.seq, r.i): r.x for r in PL.attention_pool(df, projections=w).collect()}
    want = _brute(rows, w)
    assert set(got) == {(s, i) for s in want for i in range(3)}
    assert all(abs(got[s, i] - want[s][1][i]) < 1e-9 for s, i in got)


def test_folded_passages(spark):
    rows, w = _tokens(), _weights(5, 6, 5)
    df = spark.createDataFrame(rows, "seq long, pos long, vec array<double>, mask boolean")
    want = _brute(rows, w)
    point = np.arange(5) / 3
    folded = {r.seq: np.array(r.vec) for r in PL.folded_passages(df, w).collect()}
    q = np.array(spark.range(1).select(V.fold_query(F.array(*[F.lit(float(x)) for x in point])).alias("v")).first().v)
    for s, (mean, pool) in want.items():
        var = np.where(pool < 10, np.log1p(np.exp(np.minimum(pool, 10))), pool)
        assert abs(folded[s] @ q + 0.5 * (np.log(var) + (point - mean) ** 2 / var).sum()) < 1e-8


def test_projections_have_a_size_limit(monkeypatch):
    monkeypatch.setattr(PL, "MATRIX_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        _weights(5, 6, 3)
