"""Chi-square upper tail probability as an Arrow-batched pandas UDF.

Q(k/2, x/2), the regularised upper incomplete gamma function, by its power series for
x < a + 1 and by a modified-Lentz continued fraction otherwise (Numerical-Recipes style),
vectorised over the batch with NumPy; both run to convergence or raise.  It runs on one row per
categorical feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 2.0**-53
_TINY = 1e-300


def _steps(a: np.ndarray) -> int:
    """More than enough: near x = a both expansions need a multiple of sqrt(a) terms."""
    return 1000 + int(60 * math.sqrt(float(a.max())))


def _gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.full(a.shape, np.nan)
    lg = np.array([math.lgamma(v) if v > 0 else np.nan for v in a])
    ok = (a > 0) & (x >= 0) & np.isfinite(x)
    out[(a > 0) & np.isinf(x) & (x > 0)] = 0.0
    zero = ok & (x == 0)
    out[zero] = 1.0
    series = ok & (x > 0) & (x < a + 1)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1.0 / aa
        total = term.copy()
        ap = aa.copy()
        for _ in range(_steps(aa)):
            ap = ap + 1.0
            term = term * xx / ap
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * _EPS):
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function did not converge")
        lower = total * np.exp(-xx + aa * np.log(xx) - lg[series])
        out[series] = 1.0 - lower
    frac = ok & (x > 0) & (x >= a + 1)
    if frac.any():
        aa, xx = a[frac], x[frac]
        b = xx + 1.0 - aa
        c = np.full(aa.shape, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, _steps(aa)):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < 4 * _EPS):
                break
        else:
            raise ArithmeticError("the continued fraction of the incomplete gamma function did not converge")
        out[frac] = np.exp(-xx + aa * np.log(xx) - lg[frac]) * h
    return np.clip(out, 0.0, 1.0)


def chi2_sf_numpy(stat, dof) -> np.ndarray:
    s = np.asarray(stat, dtype=float)
    k = np.asarray(dof, dtype=float)
    res = np.full(s.shape, np.nan)
    valid = np.isfinite(k) & (k > 0) & ~np.isnan(s)
    if valid.any():
        res[valid] = _gammaincc(k[valid] / 2.0, s[valid] / 2.0)
    return res


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= stat) for X ~ chi-square(dof); NULL for dof <= 0 or NULL input."""
    res = chi2_sf_numpy(stat.astype(float).to_numpy(), dof.astype(float).to_numpy())
    return pd.Series(res).where(~np.isnan(res), None)
