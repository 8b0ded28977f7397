"""Goodness-of-fit measures as aggregate expressions over two columns: left (ideal or data) and right (fitted).

All variances are population variances. Two forms of R squared exist: r_sq_fit divides by the fitted column's variation,
r2_observed by the data's. concord takes medians where the usual coefficient has means, and the absolute value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lin_div(left, right) -> Column:
    return F.sum(F.abs(_c(left) - _c(right)))


def rss(left, right) -> Column:
    return F.sum(F.pow(_c(left) - _c(right), 2))


def tss(x) -> Column:
    return F.var_pop(_c(x)) * F.count(_c(x))


def rse(left, right) -> Column:
    return F.sqrt(F.try_divide(rss(left, right), F.count(_c(left)) - 2))


def r_sq_fit(left, right) -> Column:
    return 1 - F.try_divide(rss(left, right), tss(right))


def r2_observed(left, right) -> Column:
    return 1 - F.try_divide(rss(left, right), tss(left))


def mse(left, right) -> Column:
    return F.avg(F.pow(_c(left) - _c(right), 2))


def mle(left, right) -> Column:
    return F.avg(F.abs(_c(left) - _c(right)))


def concord(left, right) -> Column:
    apart = F.median(_c(left)) - F.median(_c(right))
    return F.abs(F.try_divide(2 * F.covar_pop(_c(left), _c(right)), F.var_pop(_c(left)) + F.var_pop(_c(right)) + apart * apart))


def own_variance(x) -> Column:
    """Variance of a fit about its own mean."""
    return F.var_pop(_c(x))


def growth(y="y", x="x", n="n") -> Column:
    """Mean of first differences, which is (last - first) / (n - 1)."""
    return F.try_divide(F.max_by(_c(y), _c(x)) - F.min_by(_c(y), _c(x)), F.count(_c(y)) - 1)


def model_metrics(left, right) -> list[Column]:
    """rse, mse, sigma (population deviation of residuals), std (of the fit), r_sq, corr, ccord."""
    return [
        rse(left, right).alias("rse"), mse(left, right).alias("mse"), F.stddev_pop(_c(left) - _c(right)).alias("sigma"), F.stddev_pop(_c(right)).alias("std"),
        r_sq_fit(left, right).alias("r_sq"), F.corr(_c(left), _c(right)).alias("corr"), concord(left, right).alias("ccord"),
    ]


def same_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two series sets paired by series_id and x: y_left, y_right. Fails if one has a sample that the other lacks."""
    a, b = left.select("series_id", "x", F.col("y").alias("y_left")), right.select("series_id", "x", F.col("y").alias("y_right"))
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), ["series_id", "x"], "full")
    return j.where(F.assert_true(F.col("l").isNotNull() & F.col("r").isNotNull(), "Array sizes must be equal.").isNull()).drop("l", "r")


def statistics(df: DataFrame, data: str, fits: list[str], by_pair: bool = False) -> DataFrame:
    """One row for each series and fit (and the data itself): d_med, d_var, std_div, mse, lin_div, conc.

    by_pair: d_var is |median(data) - var(fit)| and the data has no row of its own.
    """
    labels = [*fits] + ([] if by_pair else [data])
    stack = F.explode(F.array(*[F.struct(F.lit("data" if c == data else c).alias("label"), F.col(data).alias("a"), F.col(c).alias("b")) for c in labels]))
    long = df.select("series_id", stack.alias("s")).select("series_id", "s.label", "s.a", "s.b")
    d_var = F.abs(F.median("a") - F.var_pop("b")) if by_pair else F.var_pop("b")
    return long.groupBy("series_id", "label").agg(
        F.abs(F.median("a") - F.median("b")).alias("d_med"), d_var.alias("d_var"), F.stddev_pop("b").alias("std_div"), mse("a", "b").alias("mse"), lin_div("a", "b").alias("lin_div"), concord("a", "b").alias("conc"),
    )


def summary(y="y") -> list[Column]:
    return [F.median(_c(y)).alias("median"), F.var_pop(_c(y)).alias("variance"), F.stddev_pop(_c(y)).alias("deviation")]


def histogram(df: DataFrame, bins: int, key: str = "series_id", y: str = "y") -> DataFrame:
    """key, bin, low, n: equal widths from least to largest value, the last bin closed. Empty bins have no row."""
    edges = df.groupBy(key).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col(y) - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.join(edges, key).groupBy(key, place.alias("bin"), (F.col("lo") + place * width).alias("low")).agg(F.count("*").alias("n"))
