"""Null, NaN and division rules in one place.

Missing is NULL.  NaN and infinities are values that no statistic may see;
``finite`` turns them into NULL.  Division never raises: it is ``try_divide``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this size a relative comparison becomes an absolute one (square root of the double epsilon).
TINY = 1.4901161193847656e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value if it is a finite number, else NULL."""
    c = col(c).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def near_rel(x: Column | str, y: Column | str, tol: float) -> Column:
    """|x - y| / |y| < tol; absolute where y is next to 0; NULL if either is."""
    x, y = col(x), col(y)
    gap = F.abs(x - y)
    return F.when(F.abs(y) < TINY, gap < tol).otherwise(F.try_divide(gap, F.abs(y)) < tol)


def truthy(c: Column | str) -> Column:
    """NULL-safe truth of booleans and of the strings true, t, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "t", "1", "yes"), F.lit(False))


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one value is."""
    c = col(c)
    return F.when(F.count("*") == F.count(c), F.sum(c))


def trailing_int(c: Column | str) -> Column:
    """The digits at the end of a string as an integer; NULL if there are none."""
    return F.nullif(F.regexp_extract(col(c), r"[0-9]+$", 0), F.lit("")).try_cast("int")


def null_tokens(c: Column | str, tokens: tuple[str, ...] = ("", "NA", "NaN")) -> Column:
    c = F.trim(col(c))
    return F.when(~c.isin(*tokens), c)


def norm_diff(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a) - col(b), col(a) + col(b))


def cut_bin(x: Column | str, lo: Column | str, hi: Column | str, n: int) -> Column:
    """Equal-width right-closed bins 1..n over [lo, hi], the ends included; one value in all: bin 1."""
    x, lo, hi = col(x), col(lo), col(hi)
    raw = F.ceil(F.try_divide(x - lo, (hi - lo) / n))
    return F.greatest(F.lit(1), F.least(F.lit(n), F.coalesce(raw, F.lit(1)))).cast("int")


def mean_se(c: Column | str) -> dict[str, Column]:
    """n, mean, sd, se and cv_pct of the finite values; NULL where n < 2 leaves them open."""
    x = finite(c)
    n, sd = F.count(x), F.stddev_samp(x)
    return {"n": n, "mean": F.avg(x), "sd": sd, "se": F.try_divide(sd, F.sqrt(n)), "cv_pct": F.try_divide(100 * sd, F.avg(x))}


def linear_combination(weights: dict[str, float]) -> Column:
    """Sum of weighted bands, as for tasselled-cap indices."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * w
    return out


# ---------------------------------------------------------------- distributions, for small lookup tables


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def t_cdf(t: float, df: int) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b
    return 1 - tail / 2 if t >= 0 else tail / 2


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection; for lookup tables of a few hundred degrees of freedom."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
