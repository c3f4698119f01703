"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_nan(c: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def binary_entropy(p: Column, eps: float = 1e-12) -> Column:
    """Entropy in bits; p is kept away from 0 and 1."""
    q = clamp(p, eps, 1 - eps)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def slug(c: Column, limit: int = 120) -> Column:
    joined = F.regexp_replace(c, "[^0-9A-Za-z]+", "_")
    return F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, limit)


def mean_std_cell(mean: Column, std: Column, n: Column) -> Column:
    """``0.520 ± 0.016``; a single value has no spread, no value is blank."""
    one = F.format_string("%.3f", mean)
    return F.when(n == 0, F.lit("")).when(n == 1, one).otherwise(F.format_string("%.3f ± %.3f", mean, std))


def near(a: Column, b: Column, rel: float = 1e-6) -> Column:
    """Relative near-equality; two NULLs are equal."""
    close = F.abs(a - b) <= F.lit(1e-12) + F.lit(rel) * F.abs(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def jaccard(both: Column, a: Column, b: Column) -> Column:
    return F.coalesce(ratio(both, a + b - both), F.lit(0.0))


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: weighted Pearson correlation from six sums.

    NULL for fewer than three points, no weight, or a constant side.
    """
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull()
    n = F.count(F.when(ok, 1))
    sw = F.sum(F.when(ok, w))

    def mean(e: Column) -> Column:
        return F.try_divide(F.sum(F.when(ok, w * e)), sw)

    mx, my = mean(x), mean(y)
    vx, vy = mean(x * x) - mx * mx, mean(y * y) - my * my
    usable = (n >= 3) & (sw > 0) & (vx > 1e-12 * (mx * mx + 1e-12)) & (vy > 1e-12 * (my * my + 1e-12))
    return F.when(usable, F.try_divide(mean(x * y) - mx * my, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))))


def weighted_pearson_sql(x: str, y: str, w: str = "1.0") -> str:
    """The same aggregate as SQL text (inputs must not be NULL)."""
    mx, my = f"(sum(({w})*({x}))/nullif(sum({w}),0))", f"(sum(({w})*({y}))/nullif(sum({w}),0))"
    vx = f"(sum(({w})*({x})*({x}))/nullif(sum({w}),0) - {mx}*{mx})"
    vy = f"(sum(({w})*({y})*({y}))/nullif(sum({w}),0) - {my}*{my})"
    cov = f"(sum(({w})*({x})*({y}))/nullif(sum({w}),0) - {mx}*{my})"
    return (
        f"CASE WHEN count(*) >= 3 AND sum({w}) > 0 AND {vx} > 1e-12*({mx}*{mx}+1e-12) "
        f"AND {vy} > 1e-12*({my}*{my}+1e-12) THEN {cov}/sqrt(greatest({vx}*{vy}, 0)) END"
    )
