"""Least squares from grouped sums.

One and two regressors are closed forms over covariances, so they stay inside
the aggregate.  Wider systems reduce each group to its cross-product sums and
solve the small system where that one row lives.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments2(x: str, h: str, y: str) -> list[Column]:
    """Aggregates needed by :func:`fit2`: centred second moments times n."""
    n = F.count(F.lit(1))
    return [
        n.alias("_n"),
        F.avg(x).alias("_mx"), F.avg(h).alias("_mh"), F.avg(y).alias("_my"),
        (F.var_pop(x) * n).alias("_sxx"), (F.var_pop(h) * n).alias("_shh"),
        (F.var_pop(y) * n).alias("_syy"), (F.covar_pop(x, h) * n).alias("_sxh"),
        (F.covar_pop(x, y) * n).alias("_sxy"), (F.covar_pop(h, y) * n).alias("_shy"),
    ]


def fit2() -> dict[str, Column]:
    """Slopes, intercept and SSE of y on (1, x, h) from :func:`moments2`."""
    sxx, shh, syy, sxh, sxy, shy = (F.col(c) for c in ("_sxx", "_shh", "_syy", "_sxh", "_sxy", "_shy"))
    # Collinear regressors leave a determinant of rounding noise: no fit then.
    full = sxx * shh
    det = F.when(full - sxh * sxh > 1e-12 * full, full - sxh * sxh)
    bx = F.try_divide(sxy * shh - shy * sxh, det)
    bh = F.try_divide(shy * sxx - sxy * sxh, det)
    return {
        "bx": bx,
        "bh": bh,
        "b0": F.col("_my") - bx * F.col("_mx") - bh * F.col("_mh"),
        "sse": syy - bx * sxy - bh * shy,
    }


def cross_products(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Upper-triangle sums of products of ``columns`` per key, as one array ``xp``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xp"),
        F.count(F.lit(1)).alias("n"),
    )


def unpack(xp: Sequence[float], k: int) -> np.ndarray:
    """Symmetric k x k matrix from the array made by :func:`cross_products`."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(xp, dtype=float)
    return m + np.triu(m, 1).T


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction (Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-13:
            break
    return front * (f - 1.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not np.isfinite(f):
        return float("nan")
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def norm_sf2(z: float) -> float:
    from math import erfc, sqrt

    return erfc(abs(z) / sqrt(2))
