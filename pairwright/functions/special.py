"""Scalar functions that Spark lacks: normal quantiles and the null law of log-likelihood ratios.

The null law is that of x = -ln(1 - z1 / (z1 + z2)) / 2 with independent z1 ~ chi2(n1) and
z2 ~ chi2(n2), so y = 1 - exp(-2x) is Beta(n1/2, n2/2).  Each function exists for NumPy
arrays; those that a query needs row by row also as a Column built from Spark's own functions.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published algorithm AS241 (PPND16), numerator then denominator, constant first.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(coefficients, x, lift=lambda v: v):
    out = lift(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal CDF, to about 1e-16 relative."""
    p = np.asarray(p, float)
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * _horner(_CENTRE[0], r) / _horner(_CENTRE[1], r)
    t = np.sqrt(-np.log(np.clip(np.minimum(p, 1 - p), 1e-320, None)))
    near = _horner(_NEAR[0], t - 1.6) / _horner(_NEAR[1], t - 1.6)
    far = _horner(_FAR[0], t - 5.0) / _horner(_FAR[1], t - 5.0)
    return np.where(np.abs(q) <= 0.425, centre, np.sign(q) * np.where(t <= 5.0, near, far))


def normal_quantile_column(p: Column) -> Column:
    """The same as a Column, for p strictly between 0 and 1."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    part = lambda c, x: _horner(c[0], x, F.lit) / _horner(c[1], x, F.lit)
    tail = F.when(t <= 5.0, part(_NEAR, t - F.lit(1.6))).otherwise(part(_FAR, t - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * part(_CENTRE, r)).otherwise(F.signum(q) * tail)


def normal_quantile_sql(p: str) -> str:
    """The same as SQL text that Spark and DuckDB read alike."""

    def poly(c, x: str) -> str:
        out = f"{c[-1]!r}::DOUBLE"
        for k in reversed(c[:-1]):
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    q, r = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1.0 - {p} END))"
    part = lambda c, x: f"{poly(c[0], x)} / {poly(c[1], x)}"
    return (
        f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {part(_CENTRE, r)} "
        f"ELSE sign({q}) * (CASE WHEN {t} <= 5.0 THEN {part(_NEAR, f'({t} - 1.6)')} ELSE {part(_FAR, f'({t} - 5.0)')} END) END)"
    )


def lgamma_half(n: int) -> float:
    """ln Gamma(n / 2)."""
    return math.lgamma(n / 2)


@lru_cache(maxsize=64)
def normal_scores(ns: int) -> np.ndarray:
    """Normal quantiles of i / (ns + 1), scaled to population variance 1; their mean is 0 by symmetry."""
    z = np.concatenate([normal_quantile(p) for p in np.array_split(np.arange(1, ns + 1) / (ns + 1), ns // 65_536 + 1)])  # in parts, as each takes ten arrays
    z = z - z.mean()
    return z / math.sqrt((z * z).mean()) if ns > 1 else z


def null_pdf(x: np.ndarray, n1: int, n2: int) -> np.ndarray:
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        body = (n1 / 2 - 1) * np.log(-np.expm1(-2 * x)) if n1 != 2 else 0.0
        return np.exp(body - n2 * x + math.log(2) + lgamma_half(n1 + n2) - lgamma_half(n1) - lgamma_half(n2))


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def null_sf(x: np.ndarray, n1: int, n2: int) -> np.ndarray:
    """P(X > x) under the null law, accurate in the far tail too; 1 at x <= 0, 0 at infinity, NaN stays."""
    x = np.asarray(x, float)
    a, b = n1 / 2, n2 / 2
    out = np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, 0.0))
    use = (x > 0) & np.isfinite(x)
    v = x[use]
    if n1 == 2:
        out[use] = np.exp(-n2 * v)
        return out
    y = -np.expm1(-2 * v)
    front = np.exp(a * np.log(y) - 2 * b * v + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    low = y < (a + 1) / (a + b + 2)
    res = np.empty_like(v)
    res[low] = 1.0 - front[low] * _beta_fraction(a, b, y[low]) / a
    res[~low] = front[~low] * _beta_fraction(b, a, np.exp(-2 * v[~low])) / b
    out[use] = np.clip(res, 0.0, 1.0)
    return out


def null_sf_column(x: Column, n1: int, n2: int) -> Column:
    """P(X > x) for fixed degrees of freedom, as finite sums of Spark expressions.

    Absolute accuracy about 1e-14; use `null_sf` where the relative accuracy of tiny tails matters.
    """
    a, b = n1 / 2, n2 / 2
    y = F.lit(1.0) - F.exp(F.lit(-2.0) * x)
    w = F.exp(F.lit(-2.0) * x)
    if n1 % 2 == 0:
        log_terms = [math.lgamma(b + j) - math.lgamma(b) - math.lgamma(j + 1) for j in range(n1 // 2)]
        total = F.lit(0.0)
        for j, t in enumerate(log_terms):
            total = total + F.lit(math.exp(t)) * F.pow(y, F.lit(float(j)))
        res = F.pow(w, F.lit(b)) * total
    else:
        root = F.sqrt(y)
        if n2 % 2 == 0:
            terms = [math.exp(math.lgamma(j + 0.5) - math.lgamma(0.5) - math.lgamma(j + 1)) for j in range(n2 // 2)]
            inner = F.aggregate(F.reverse(F.array(*[F.lit(t) for t in terms])), F.lit(0.0), lambda acc, t: acc * w + t)
            p = root * inner
        else:
            # sin(th) * (cos(th) + 2/3 cos^3(th) + ...), th = asin(sqrt(y)), cos^2(th) = w
            terms, t = [], 1.0
            for j in range((n2 - 1) // 2):
                terms.append(t)
                t *= (2 * j + 2) / (2 * j + 3)
            inner = F.aggregate(F.reverse(F.array(*[F.lit(t) for t in terms])), F.lit(0.0), lambda acc, t: acc * w + t) if terms else F.lit(0.0)
            p = F.lit(2 / math.pi) * (F.asin(root) + root * F.sqrt(w) * inner)
        res = F.lit(1.0) - p
        for j in range((n1 - 1) // 2):
            al = 0.5 + j
            log_c = math.lgamma(al + b) - math.lgamma(al + 1) - math.lgamma(b)
            res = res + F.lit(math.exp(log_c)) * F.pow(y, F.lit(al)) * F.pow(w, F.lit(b))
    return F.when(F.isnan(x), x).when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), res)))


def null_sf_sql(x: str, n1: int, n2: int) -> str:
    """The same finite sums for DuckDB, terms computed there.

    One minus a sum loses small tails, so below a thousandth the tail's own series is summed instead.
    """
    a, b = n1 / 2, n2 / 2
    y, w = f"(1 - exp(-2 * ({x})))", f"exp(-2 * ({x}))"
    if n1 % 2 == 0:
        res = f"pow({w}, {b!r}) * list_sum([exp(lgamma({b!r} + j) - lgamma({b!r}) - lgamma(j + 1.0)) * pow({y}, j) for j in range({n1 // 2})])"
    else:
        if n2 % 2 == 0:
            p = f"sqrt({y}) * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow({w}, j) for j in range({n2 // 2})])"
        else:
            more = f" + sqrt({y} * {w}) * list_sum([exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow({w}, j) for j in range({(n2 - 1) // 2})])" if n2 > 1 else ""
            p = f"2 / pi() * (asin(sqrt({y})){more})"
        res = f"1 - ({p})"
        for j in range((n1 - 1) // 2):
            al = 0.5 + j
            res += f" + exp(lgamma({al + b!r}) - lgamma({al + 1!r}) - lgamma({b!r})) * pow({y}, {al!r}) * pow({w}, {b!r})"
    res = f"greatest(0.0, least(1.0, {res}))"
    if n1 % 2:
        front = f"exp(-2 * {b!r} * ({x}) + {a!r} * ln({y}) + lgamma({a + b!r}) - lgamma({a!r}) - lgamma({b + 1!r}))"
        tail = f"{front} * list_sum([exp(lgamma({a + b!r} + j) - lgamma({a + b!r}) - lgamma({b + 1!r} + j) + lgamma({b + 1!r})) * pow({w}, j) for j in range(3000)])"
        res = f"CASE WHEN {res} >= 1e-3 THEN {res} ELSE {tail} END"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE {res} END)"


def quantiles_of_cdf(cdf, start: float, step: float, n: int, left: float, right: float, eps: float) -> np.ndarray:
    """Where `cdf` reaches start, start + step, ...: bisection of all targets together.

    Targets that share an interval shorter than `eps` are spread evenly over it.
    """
    out = np.empty(n)
    stack = [(0, n, left, right)]
    while stack:
        a, b, lo, hi = stack.pop()
        if a >= b:
            continue
        if hi - lo < eps:
            out[a:b] = lo + (hi - lo) / (b - a) * (np.arange(b - a) + 0.5)
            continue
        mid = (lo + hi) / 2
        cut = min(max(math.ceil((cdf(mid) - (start + a * step)) / step), 0), b - a)
        stack += [(a, a + cut, lo, mid), (a + cut, b, mid, hi)]
    return out
