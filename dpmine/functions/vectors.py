"""Vector functions on ``ARRAY<DOUBLE>`` columns, all as Catalyst expressions.

Spark 4.1 has no built-in vector arithmetic, so these are higher-order
functions (``transform`` / ``zip_with`` / ``aggregate``); they stay inside
whole-stage code generation.  Blocked matrix products live in
``dpmine.operators.search`` (BLAS in Arrow batches), these are for per-row work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# softplus defaults of the passage model: beta = 1, applied below 10 only
SOFTPLUS_BETA = 1.0
SOFTPLUS_THRESHOLD = 10.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_vector(col) -> Column:
    """float/int arrays → ``ARRAY<DOUBLE>`` (scores are computed in double)."""
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    """Σ aᵢ·bᵢ in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def softplus(col, beta: float = SOFTPLUS_BETA, threshold: float = SOFTPLUS_THRESHOLD) -> Column:
    """Element-wise ``ln(1 + e^{βx}) / β`` for x below the threshold, x itself from it on."""
    def one(x):
        return F.when(x < F.lit(threshold), F.log1p(F.exp(x * F.lit(beta))) / F.lit(beta)).otherwise(x)
    return F.transform(_c(col), one)


def fold_query(mean) -> Column:
    """Point query m → ``[1] ++ m² ++ m ++ [1]`` (length 2h + 2)."""
    m = _c(mean)
    return F.concat(F.array(F.lit(1.0)), F.transform(m, lambda x: x * x), m, F.array(F.lit(1.0)))


def fold_passage(mean, var, min_var: float | None = None) -> Column:
    """Diagonal Gaussian (m, v) → ``[-½Σln v] ++ (-½/v) ++ (m/v) ++ [-½Σm²/v]``.

    With ``fold_query`` the plain dot product equals the Gaussian log-density
    up to a constant: ``-½ Σ (ln v + (m_q - m_p)² / v)``.  ``min_var`` floors
    the variances (off by default: an underflowed variance gives ln 0).
    """
    m, v = _c(mean), _c(var)
    if min_var is not None:
        v = F.transform(v, lambda x: F.greatest(x, F.lit(min_var)))
    # try_divide: a zero variance gives null elements (flagged by non_finite), not a failed job
    first = F.lit(-0.5) * F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.ln(x))
    second = F.transform(v, lambda x: F.try_divide(F.lit(-0.5), x))
    third = F.zip_with(m, v, lambda a, b: F.try_divide(a, b))
    fourth = F.lit(-0.5) * F.aggregate(F.zip_with(m, v, lambda a, b: F.try_divide(a * a, b)), F.lit(0.0),
                                       lambda acc, x: acc + x)
    return F.concat(F.array(first), second, third, F.array(fourth))


def gaussian_log_density(q_mean, p_mean, p_var) -> Column:
    """Closed form the folded dot product must equal: ``-½ Σ (ln v + (q - m)² / v)``."""
    terms = F.zip_with(F.zip_with(_c(q_mean), _c(p_mean), lambda a, b: a - b), _c(p_var),
                       lambda d, v: F.ln(v) + d * d / v)
    return F.lit(-0.5) * vsum(terms)


def squared_distance(a, b) -> Column:
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return vsum(diff)


def non_finite(vec) -> Column:
    """True when any element is null, NaN or infinite (rows to count before a search)."""
    return F.exists(_c(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
