"""Column expressions for statistics that stay defined on degenerate groups.

Undefined values are NULL: a correlation or R² of a constant or single-row group never
fails the query. All are plain aggregates, so partial aggregation merges them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash01(*keys: Column | str, seed: int) -> Column:
    """A draw in [0, 1) from the keys and the seed alone, the same under any partitioning and in any engine with md5."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    d = value.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def safe_r(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL if either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def r_squared(actual: Column, predicted: Column, zero_variance: float | None = None) -> Column:
    """1 - SSE / SST; ``zero_variance`` (default NULL) if the truth is constant."""
    both = actual.isNotNull() & predicted.isNotNull()
    value = 1 - F.try_divide(F.sum((predicted - actual) * (predicted - actual)), F.nullif(F.var_pop(F.when(both, actual)) * F.count(F.when(both, 1)), F.lit(0.0)))
    return F.coalesce(value, F.lit(zero_variance)) if zero_variance is not None else value


def regression_metrics(actual: Column, predicted: Column, zero_variance: float | None = None) -> list[Column]:
    """count, r2, rmse, mae, bias and pearson_r of a group; rows with a NULL on either side don't count."""
    error = predicted - actual
    a, p = F.when(error.isNotNull(), actual), F.when(error.isNotNull(), predicted)
    return [
        F.count(error).alias("n"),
        r_squared(actual, predicted, zero_variance).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        safe_r(a, p).alias("pearson_r"),
    ]


def corrected_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL under three rows or without variance."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL under four rows or without variance."""
    n = F.count(x).cast("double")
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def standardised(x: Column, mean: Column, std_pop: Column) -> Column:
    """(x - mean) / std with the population std; a zero std counts as 1."""
    return (x - mean) / F.when(std_pop > 0, std_pop).otherwise(1.0)


#: Lanczos's coefficients of the gamma function for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1/2."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + i)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def beta_fraction(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, folded over ``steps`` pairs of terms.

    It has converged where x < (a + 1) / (a + b + 2); later terms then change nothing.
    """
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    d0 = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def term(s: Column, top: Column) -> Column:
        return F.transform(F.array(s), lambda s: F.struct(away(1 + top / s["c"]).alias("c"), (1 / away(1 + top * s["d"])).alias("d"), s["h"].alias("h")))[0]

    def turn(s: Column) -> Column:
        return F.transform(F.array(s), lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")))[0]

    def step(s: Column, m: Column) -> Column:
        s = turn(term(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))))
        return turn(term(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation under the t distribution with n - 2 degrees of freedom; NULL under three rows."""
    a, half, square = (n.cast("double") - 2) / 2, F.lit(0.5), r * r
    # Beyond a = 100 the difference of two large logarithms would lose digits that its series keeps.
    ratio = F.when(a < 100, log_gamma(a + 0.5) - log_gamma(a)).otherwise(0.5 * F.ln(a) - 1 / (8 * a) + 1 / (192 * a * a * a) - 1 / (640 * F.pow(a, 5)))
    front = F.exp(ratio - 0.5 * math.log(math.pi) + a * F.log1p(-square) + 0.5 * F.ln(square))
    swapped = 1 - square >= (a + 1) / (a + 2.5)
    one, two, x = F.when(swapped, half).otherwise(a), F.when(swapped, a).otherwise(half), F.when(swapped, square).otherwise(1 - square)
    tail = front * beta_fraction(one, two, x) / one
    return F.when(r.isNull() | F.isnan(r) | (n < 3), None).when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).when(swapped, 1 - tail).otherwise(tail)
