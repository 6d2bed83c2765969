"""Column-level building blocks (all native Spark expressions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyrisk.schemas import (ALERT_PAD, BADGE_THRESHOLD, ISCLOSE_ATOL, ISCLOSE_RTOL, NAME_SHORT_KEEP,
                             NAME_SHORTEN_AT, PSI_ALERT, PSI_WARN, RISK_BREAKS, RISK_LABELS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_category(score) -> Column:
    """<= 0.2 Very Low, <= 0.5 Low, <= 0.8 Medium, else High.  NULL / NaN fall through to High,
    negatives count as 0 (so they are Very Low)."""
    s = _c(score)
    lo, mid, hi = RISK_BREAKS
    return (F.when(F.isnan(s), F.lit(RISK_LABELS[3]))
            .when(s <= lo, F.lit(RISK_LABELS[0]))
            .when(s <= mid, F.lit(RISK_LABELS[1]))
            .when(s <= hi, F.lit(RISK_LABELS[2]))
            .otherwise(F.lit(RISK_LABELS[3])))


def hazard_class(pho="is_potentially_hazardous", sentry="is_sentry_object") -> Column:
    """both / pho / sentry / safe from the two flags (NULL flags count as false)."""
    p = F.coalesce(_c(pho), F.lit(False))
    s = F.coalesce(_c(sentry), F.lit(False))
    return (F.when(p & s, F.lit("both")).when(p, F.lit("pho"))
            .when(s, F.lit("sentry")).otherwise(F.lit("safe")))


def hazard_badge(pho="is_potentially_hazardous", sentry="is_sentry_object", risk=None, probability=None) -> Column:
    """Badge class where hazardous = flag OR risk >= 0.5 OR probability >= 0.5 (missing = 0)."""
    hazardous = F.coalesce(_c(pho), F.lit(False))
    if risk is not None:
        hazardous = hazardous | (F.coalesce(_c(risk), F.lit(0.0)) >= BADGE_THRESHOLD)
    if probability is not None:
        hazardous = hazardous | (F.coalesce(_c(probability), F.lit(0.0)) >= BADGE_THRESHOLD)
    return hazard_class(hazardous, sentry)


def psi_status(psi, warn: float = PSI_WARN, alert: float = PSI_ALERT) -> Column:
    p = _c(psi)
    return (F.when(p > alert, F.lit("High Drift")).when(p > warn, F.lit("Moderate Drift"))
            .otherwise(F.lit("No Drift")))


def drift_status(psi, p_value=None, warn: float = PSI_WARN, alert: float = PSI_ALERT, alpha: float = 0.05) -> Column:
    """PSI status (strict >), escalated to 'High Drift (chi2)' when p < alpha and not already High."""
    status = psi_status(psi, warn, alert)
    if p_value is None:
        return status
    p = _c(p_value)
    return F.when(p.isNotNull() & (p < alpha) & (status != "High Drift"), F.lit("High Drift (chi2)")).otherwise(status)


def isclose(a, b, atol: float = ISCLOSE_ATOL, rtol: float = ISCLOSE_RTOL) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= (F.lit(atol) + F.lit(rtol) * F.abs(b))


def clip01(x) -> Column:
    """Clamp to [0, 1], keeping NULL and NaN as they are."""
    v = _c(x)
    return F.when(v.isNull() | F.isnan(v), v).when(v < 0, F.lit(0.0)).when(v > 1, F.lit(1.0)).otherwise(v)


def finite_or_null(x) -> Column:
    """+-inf and NaN become NULL."""
    v = _c(x)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


def uniform(seed: int, key) -> Column:
    """Deterministic U[0,1) from md5(seed:key); DuckDB twin:
    ('0x' || substr(md5(seed || ':' || key), 1, 8))::BIGINT / 4294967296.0"""
    h = F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def short_name(name="name") -> Column:
    n = _c(name)
    return F.when(F.length(n) > NAME_SHORTEN_AT,
                  F.concat(F.substring(n, 1, NAME_SHORT_KEEP), F.lit("…"))).otherwise(n)


def pad_slot(value) -> Column:
    return F.coalesce(_c(value), F.lit(ALERT_PAD))
