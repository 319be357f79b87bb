"""Tail probabilities and Beta distributions that Spark lacks, as numpy code for pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# types as objects: a DDL string could only be parsed once a session is there
INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
PARAMETERS = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(k: int, a: int, b: int, total: int) -> float:
    """Logarithm of the probability that k of b drawn articles are among a of total."""
    return _log_choose(a, k) + _log_choose(total - a, b - k) - _log_choose(total, b)


def _decaying(log_terms) -> float:
    """Sum of exponentials of terms that have passed their peak once they fall far below it."""
    peak, total = -math.inf, 0.0
    for x in log_terms:
        if x > peak:
            total = total * math.exp(peak - x) + 1 if peak > -math.inf else 1.0
            peak = x
        else:
            total += math.exp(x - peak)
            if x < peak - 60:
                break
    return math.exp(peak) * total if peak > -math.inf else 0.0


def fisher_greater(ab: float, a: float, b: float, total: float) -> float:
    """One-sided Fisher test: at least ab articles have both terms."""
    if any(x is None or math.isnan(x) for x in (ab, a, b, total)) or not 0 <= ab <= min(a, b) or max(a, b) > total:
        return math.nan
    low = max(ab, a + b - total)
    return min(1.0, _decaying(hypergeometric(k, a, b, total) for k in range(int(low), int(min(a, b)) + 1)))


def fisher_two_sided(ab: float, a: float, b: float, total: float) -> float:
    """The tables that are no likelier than the one found."""
    if any(x is None or math.isnan(x) for x in (ab, a, b, total)) or not 0 <= ab <= min(a, b) or max(a, b) > total:
        return math.nan
    low, high = int(max(0, a + b - total)), int(min(a, b))
    limit = hypergeometric(ab, a, b, total) + 1e-7
    mode = min(high, max(low, int((a + 1) * (b + 1) / (total + 2))))
    up = _decaying(x for x in (hypergeometric(k, a, b, total) for k in range(mode, high + 1)) if x <= limit)
    down = _decaying(x for x in (hypergeometric(k, a, b, total) for k in range(mode - 1, low - 1, -1)) if x <= limit)
    return min(1.0, up + down)


def binomial_greater(k: float, n: float, p: float) -> float:
    """P(X >= k)."""
    if any(x is None or math.isnan(x) for x in (k, n, p)):
        return math.nan
    k, n = int(k), int(n)
    if k <= 0 or p >= 1 and k <= n:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    terms = (_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1))
    return min(1.0, _decaying(terms))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete Beta function, by Lentz's continued fraction, whose length grows with the root of a and b."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400 + 20 * math.isqrt(math.ceil(max(a, b)))):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + numerator * d or 1e-300)
        c = 1 + numerator / c or 1e-300
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    else:
        raise ArithmeticError(f"the incomplete Beta function of {x}, {a}, {b} does not converge")
    return min(1.0, max(0.0, front * (out - 1)))


def beta_ppf(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def beta_hdi(a: float, b: float, mass: float = 0.95) -> tuple[float, float]:
    """The narrowest interval of the given mass, by golden-section search over the lower tail."""

    def width(tail: float) -> float:
        return beta_ppf(tail + mass, a, b) - beta_ppf(tail, a, b)

    golden = (math.sqrt(5) - 1) / 2
    low, high = 0.0, 1 - mass
    x, y = high - golden * (high - low), low + golden * (high - low)
    fx, fy = width(x), width(y)
    for _ in range(60):
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - golden * (high - low)
            fx = width(x)
        else:
            low, x, fx = x, y, fy
            y = low + golden * (high - low)
            fy = width(y)
    tail = min((0.0, 1 - mass, (low + high) / 2), key=width)
    return beta_ppf(tail, a, b), beta_ppf(tail + mass, a, b)


def beta_pdf(x: float, a: float, b: float) -> float:
    if not (a > 0 and b > 0):
        return math.nan
    if not 0 < x < 1:
        return 0.0
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def beta_mle(mean_log: float, mean_log1m: float, a: float, b: float) -> tuple[float, float]:
    """Newton's method from (a, b), given the means of log x and log(1 - x); step halving keeps both positive."""
    for _ in range(200):
        s = digamma(a + b)
        ga, gb = s - digamma(a) + mean_log, s - digamma(b) + mean_log1m
        t = trigamma(a + b)
        ja, jb = t - trigamma(a), t - trigamma(b)
        det = ja * jb - t * t
        da, db = -(ga * jb - gb * t) / det, -(gb * ja - ga * t) / det
        scale = 1.0
        while a + scale * da <= 0 or b + scale * db <= 0:
            scale /= 2
        a, b = a + scale * da, b + scale * db
        if abs(scale * da) < 1e-12 * a and abs(scale * db) < 1e-12 * b:
            break
    return a, b


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([f(*x) for x in zip(*(c.astype("float64") for c in columns), strict=True)], dtype="float64")


@pandas_udf(T.DoubleType())
def fisher_greater_p(ab: pd.Series, a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
    return _each(fisher_greater, ab, a, b, total)


@pandas_udf(T.DoubleType())
def fisher_two_sided_p(ab: pd.Series, a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
    return _each(fisher_two_sided, ab, a, b, total)


@pandas_udf(T.DoubleType())
def binomial_greater_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _each(binomial_greater, k, n, p)


@pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(v) if not math.isnan(v) else math.nan for v in x.astype("float64")], dtype="float64")


@pandas_udf(INTERVAL)
def beta_interval_hdi(a: pd.Series, b: pd.Series, mass: pd.Series) -> pd.DataFrame:
    found = [beta_hdi(*x) for x in zip(a, b, mass, strict=True)]
    return pd.DataFrame(found, columns=["low", "high"])


@pandas_udf(INTERVAL)
def beta_interval_eti(a: pd.Series, b: pd.Series, mass: pd.Series) -> pd.DataFrame:
    found = [(beta_ppf((1 - m) / 2, x, y), beta_ppf((1 + m) / 2, x, y)) for x, y, m in zip(a, b, mass, strict=True)]
    return pd.DataFrame(found, columns=["low", "high"])


@pandas_udf(PARAMETERS)
def beta_mle_fit(mean_log: pd.Series, mean_log1m: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [beta_mle(*x) if not any(map(np.isnan, x)) else (np.nan, np.nan) for x in zip(mean_log, mean_log1m, a, b, strict=True)]
    return pd.DataFrame(found, columns=["a", "b"])


@pandas_udf(T.DoubleType())
def beta_density(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(beta_pdf, x, a, b)
