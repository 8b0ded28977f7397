"""Least-squares polynomials of indexed series, from one pass of power sums.

The index is scaled to z = (x - h) / h with h = (n - 1) / 2, which keeps the normal equations well conditioned. Up to degree 3
they are solved by formula in the engine; higher degrees in numpy, one small system for each series. Coefficients ascend: c0 + c1*x + ...
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

MAX_RANK = 10


def _check(rank: int) -> None:
    if not 1 <= rank <= MAX_RANK:
        raise ValueError(f"rank must be 1 to {MAX_RANK}")


def power_sums(series: DataFrame, degree: int) -> DataFrame:
    """series_id, n, h, s0..s(2 degree), t0..t(degree): sums of powers of z, and of these times y."""
    h = F.greatest((F.col("n") - 1) / 2, F.lit(0.5))
    z = (F.col("x") - (F.col("n") - 1) / 2) / h
    terms = [F.sum(F.pow(z, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow(z, F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]
    return series.groupBy("series_id").agg(F.max("n").alias("n"), F.max(h).alias("h"), *terms)


def scaled_solution(degree: int) -> list[Column]:
    """b0..b(degree) in powers of z; on a whole index odd sums vanish."""
    s, t = (lambda k: F.col(f"s{k}")), (lambda k: F.col(f"t{k}"))
    if degree == 0:
        return [t(0) / s(0)]
    if degree == 1:
        return [t(0) / s(0), F.try_divide(t(1), s(2))]
    even = s(0) * s(4) - s(2) * s(2)
    b0, b2 = F.try_divide(s(4) * t(0) - s(2) * t(2), even), F.try_divide(s(0) * t(2) - s(2) * t(0), even)
    if degree == 2:
        return [b0, F.try_divide(t(1), s(2)), b2]
    odd = s(2) * s(6) - s(4) * s(4)
    return [b0, F.try_divide(s(6) * t(1) - s(4) * t(3), odd), b2, F.try_divide(s(2) * t(3) - s(4) * t(1), odd)]


def unscaled(b: list[Column]) -> list[Column]:
    """Coefficients in powers of x; x = h z + h."""
    h = F.col("h")
    b = [*b, *[F.lit(0.0)] * (4 - len(b))]
    c = [b[0] - b[1] + b[2] - b[3], (b[1] - 2 * b[2] + 3 * b[3]) / h, (b[2] - 3 * b[3]) / (h * h), b[3] / (h * h * h)]
    return c


@pandas_udf(ArrayType(DoubleType()))
def _solve(rank: pd.Series, s: pd.Series, t: pd.Series, h: pd.Series) -> pd.Series:
    """Normal equations of one series a row, for ranks above 4."""
    out = []
    for r, sk, tk, hk in zip(rank, s, t, h):
        m = np.array([[sk[i + j] for j in range(r)] for i in range(r)])
        try:
            b = np.linalg.lstsq(m, np.array(tk[:r]), rcond=1e-15)[0]
            c = np.polynomial.Polynomial(b)(np.polynomial.Polynomial([-1, 1 / hk])).coef
            out.append(np.pad(c, (0, r - len(c))).tolist())
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out)


def fit_ranks(series: DataFrame, ranks: list[int]) -> DataFrame:
    """series_id, n, rank, coeffs for each rank, all from one pass of power sums."""
    for r in ranks:
        _check(r)
    top = max(ranks)
    sums = power_sums(series, max(top - 1, 3))
    s, t = F.array(*[F.col(f"s{k}") for k in range(2 * top - 1)]), F.array(*[F.col(f"t{k}") for k in range(top)])
    each = {f"c{r}": F.array(*unscaled(scaled_solution(r - 1))[:r]) if r <= 4 else _solve(F.lit(r), s, t, F.col("h")) for r in ranks}
    solved = sums.select("series_id", "n", *[F.when(F.col("n") >= r, each[f"c{r}"]).alias(f"c{r}") for r in ranks])
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"c{r}").alias("coeffs")) for r in ranks]))
    return solved.select("series_id", "n", one.alias("f")).select("series_id", "n", "f.rank", "f.coeffs")


def fit(series: DataFrame, rank: int) -> DataFrame:
    """series_id, n, coeffs (ascending, `rank` of them). Fewer than `rank` samples give null coefficients."""
    _check(rank)
    degree = rank - 1
    sums = power_sums(series, degree)
    if degree <= 3:
        coeffs = F.array(*unscaled(scaled_solution(degree))[:rank])
    else:
        coeffs = _solve(F.lit(rank), F.array(*[f"s{k}" for k in range(2 * degree + 1)]), F.array(*[f"t{k}" for k in range(rank)]), F.col("h"))
    return sums.select("series_id", "n", F.when(F.col("n") >= rank, coeffs).alias("coeffs"))


def evaluate(coeffs: Column | str, x: Column) -> Column:
    """Horner's rule over an ascending array."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda acc, c: acc * x + c)


def fitted(series: DataFrame, rank: int) -> DataFrame:
    """The series with its polynomial's values as y_fit."""
    return series.join(fit(series, rank).select("series_id", "coeffs"), "series_id").withColumn("y_fit", evaluate("coeffs", F.col("x").cast("double"))).drop("coeffs")


def extrapolate(fits: DataFrame, length: Column | int | None = None, start: int = 0, curve: Column | None = None) -> DataFrame:
    """series_id, x, y_fit at `length` (default n) places from start on, of fits with coeffs (or another curve in x)."""
    if isinstance(length, int) and length < 0:
        raise ValueError("a length must not be negative")
    size = F.col("n") if length is None or (isinstance(length, int) and length == 0) else (F.lit(length) if isinstance(length, int) else length)
    wide = fits.where(size > 0).withColumn("x", F.explode(F.sequence(F.lit(start).cast("long"), (F.lit(start) + size - 1).cast("long"))))
    y = evaluate("coeffs", F.col("x").cast("double")) if curve is None else curve
    return wide.select("series_id", "x", y.alias("y_fit"))


def regression(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Quadratic least squares with arbitrary x: key, q0, q1, q2. x is centred and scaled before its powers are summed."""
    stats = df.groupBy(key).agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"))
    u = (F.col(x) - F.col("mx")) / F.col("sx")
    sums = df.join(stats.where("sx > 0"), key).groupBy(key, "mx", "sx").agg(*[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(u, F.lit(k)) * F.col(y)).alias(f"t{k}") for k in range(3)])
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    whole = det(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    b0 = F.try_divide(det(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]), whole)
    b1 = F.try_divide(det(s[0], t[0], s[2], s[1], t[1], s[3], s[2], t[2], s[4]), whole)
    b2 = F.try_divide(det(s[0], s[1], t[0], s[1], s[2], t[1], s[2], s[3], t[2]), whole)
    m, w = F.col("mx"), F.col("sx")
    return sums.select(key, (b0 - b1 * m / w + b2 * m * m / (w * w)).alias("q0"), (b1 / w - 2 * b2 * m / (w * w)).alias("q1"), (b2 / (w * w)).alias("q2"))


def best_rank(series: DataFrame, ranks: range = range(2, 7)) -> DataFrame:
    """series_id, rank, rse, r_sq for each rank, all ranks from one pass of power sums (values by one more pass)."""
    from ..functions import metrics as M

    fits = fit_ranks(series, list(ranks)).select("series_id", "rank", "coeffs")
    joined = series.join(fits, "series_id").withColumn("y_fit", evaluate("coeffs", F.col("x").cast("double")))
    return joined.groupBy("series_id", "rank").agg(M.rse("y", "y_fit").alias("rse"), M.r_sq_fit("y", "y_fit").alias("r_sq"), M.concord("y", "y_fit").alias("concord"))


def settled_rank(ranked: DataFrame, start: int, eps: float = 1e-6) -> DataFrame:
    """series_id, rank: the first rank from which on neither rse nor r_sq changes (their changes' product is below eps), else start."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("rank")
    change = F.abs(F.lead("rse").over(w) - F.col("rse")) * F.abs(F.lead("r_sq").over(w) - F.col("r_sq"))
    return ranked.withColumn("change", change).groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("change") < eps, F.col("rank"))), F.lit(start)).alias("rank"))
