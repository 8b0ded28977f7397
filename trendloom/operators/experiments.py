"""Sweeps: grids of sizes, ranks, noise levels and repeats, as one DataFrame of series that are fitted side by side."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.formula import Formula
from ..sources import generators as G
from . import balance as B
from . import fit as FT
from . import lsm


def repeats(series: DataFrame, runs: int) -> DataFrame:
    """Each series `runs` times, with the run's number in series_id after '#'."""
    each = series.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return each.withColumn("series_id", F.concat_ws("#", "series_id", F.col("run").cast("string"))).drop("run")


def prefixes(series: DataFrame, sizes: list[int]) -> DataFrame:
    """Each series cut to each size, with the size in series_id after '@'."""
    each = series.withColumn("size", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sizes]))).where("x < size AND size <= n")
    return each.withColumns({"series_id": F.concat_ws("@", "series_id", F.col("size").cast("string")), "n": F.col("size")}).drop("size")


def mass_test(spark: SparkSession, expression: str, curve: str, sizes: list[int], ranks: list[int], numeric: bool = False, noisy: bool = False) -> DataFrame:
    """series_id, rank, error (null where it could be fitted), r_sq against the ideal curve, for each size and rank.

    All ranks come from one pass over the grid, and one task fits a series for all of them.
    """
    grid = prefixes(G.curve(spark, curve, max(sizes)), sizes)
    grid = G.add_noise(grid) if noisy else grid.withColumn("y_ideal", F.col("y"))
    fits = FT.fit_each(grid.drop("y_ideal"), {r: (expression, r) for r in ranks}, numeric=numeric).withColumnRenamed("label", "rank")
    told = FT.with_fit(grid, fits.where("error IS NULL"), expression, keep=["rank"])
    return fits.select("series_id", "rank", "error").join(told.groupBy("series_id", "rank").agg(M.r_sq_fit("y_ideal", "y_fit").alias("r_sq")), ["series_id", "rank"], "left")


def polynomial_mass_test(spark: SparkSession, curve: str, sizes: list[int], ranks: range = range(2, 10)) -> DataFrame:
    """The polynomial itself as the formula, for each rank; its balance is its least-squares fit."""
    grid = prefixes(G.curve(spark, curve, max(sizes)), sizes)
    fits = lsm.fit_ranks(grid, list(ranks))
    told = grid.join(fits.select("series_id", "rank", "coeffs"), "series_id").withColumn("y_fit", lsm.evaluate("coeffs", F.col("x").cast("double")))
    scored = told.groupBy("series_id", "rank").agg(M.r_sq_fit("y", "y_fit").alias("r_sq"))
    error = F.when(F.col("coeffs").isNull(), "too few samples")
    return fits.select("series_id", "rank", error.alias("error")).join(scored, ["series_id", "rank"], "left")


def cells(spark: SparkSession, text: str, grid: list[dict]) -> DataFrame:
    """One series for each cell: (series_id, x, n, y, size, noise_coeff). text: a curve in t and, if need be, names that a cell has numbers for.

    A cell has a label, the size of the training part, test_ratio (samples after it, as a share; 1) and noise_coeff (10).
    """
    formula = Formula(text)
    names = formula.params
    rows = [(str(c["label"]), int(c["size"]), int(c["size"]) + math.ceil(c["size"] * c.get("test_ratio", 1.0)), float(c.get("noise_coeff", 10.0)), *(float(c[p]) for p in names)) for c in grid]
    table = spark.createDataFrame(rows, "series_id string, size long, n long, noise_coeff double" + "".join(f", p_{p} double" for p in names))
    wide = table.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    y = formula.column(F.col("x").cast("double"), {p: F.col(f"p_{p}") for p in names})
    return wide.select("series_id", "x", "n", y.alias("y"), "size", "noise_coeff")


def with_level_noise(grid: DataFrame, seed: int = 1) -> DataFrame:
    """y with normal noise of deviation (max - min) / noise_coeff of its series; the input's y stays as y_ideal."""
    spread = grid.groupBy("series_id").agg((F.max("y") - F.min("y")).alias("spread"))
    noisy = grid.join(spread, "series_id").withColumn("y_ideal", F.col("y"))
    return noisy.withColumn("y", F.col("y") + G.normal(seed, "series_id", "x") * F.col("spread") / F.col("noise_coeff")).drop("spread")


def perform(grid: DataFrame, expression: str, main_var: str = "t", rank: int = 0, numeric: bool = True, seed: int = 1) -> DataFrame:
    """Fit each cell's first `size` noisy samples, score the fit on these and on the rest against the ideal curve.

    series_id, train_rse, train_r_sq, test_rse, test_r_sq, error: one row for each cell, nulls and an error where no fit was found
    (and nulls for a rest that is empty).
    """
    noisy = with_level_noise(grid, seed)
    train = noisy.where("x < size").select("series_id", "x", F.col("size").alias("n"), "y")
    fits = FT.dsb_fit(train, expression, main_var, rank=rank, numeric=numeric)
    told = FT.with_fit(noisy, fits.where("error IS NULL"), expression, main_var)
    part = lambda test, c: F.when((F.col("x") >= F.col("size")) == F.lit(test), F.col(c))
    scores = [m(part(t, "y_ideal"), part(t, "y_fit")).alias(f"{'test' if t else 'train'}_{k}") for t in (False, True) for k, m in (("rse", M.rse), ("r_sq", M.r_sq_fit))]
    return fits.select("series_id", "error").join(told.groupBy("series_id").agg(*scores), "series_id", "left").select("series_id", "train_rse", "train_r_sq", "test_rse", "test_r_sq", "error")


def perform_test(series: DataFrame, expression: str, size: int, noise_coeff: float = 10.0, rank: int = 0, numeric: bool = False, seed: int = 1) -> DataFrame:
    """perform() of given series, of which the first `size` samples are learned from."""
    return perform(series.withColumns({"size": F.lit(size).cast("long"), "noise_coeff": F.lit(float(noise_coeff))}), expression, rank=rank, numeric=numeric, seed=seed)


def sensitivity(spark: SparkSession, expression: str, curve: str, n: int, sizes: list[int], noise: list[float], numeric: bool = True, seed: int = 1) -> DataFrame:
    """size, noise_coeff and the scores of perform() over a grid of training sizes and noise levels of one curve of n samples."""
    grid = [{"label": f"{s}/{c}", "size": s, "test_ratio": (n - s) / s, "noise_coeff": c} for s in sizes for c in noise]
    told = perform(cells(spark, G.CURVES[curve][1], grid), expression, numeric=numeric, seed=seed)
    at = lambda i, kind: F.substring_index("series_id", "/", i).cast(kind)
    return told.select(at(1, "int").alias("size"), at(-1, "double").alias("noise_coeff"), "train_rse", "train_r_sq", "test_rse", "test_r_sq", "error")


def complexity(series: DataFrame, expression: str, ranks: list[int], noise_coeff: float = 20.0, numeric: bool = True, seed: int = 1) -> DataFrame:
    """perform() on noisy polynomials of rising rank that are fitted to the series: series_id 'poly' and the rank; there is no rest."""
    fits = lsm.fit_ranks(series, ranks).select("series_id", "rank", "coeffs")
    wide = series.join(fits, "series_id").select(F.concat(F.lit("poly"), F.col("rank")).alias("series_id"), "x", "n", lsm.evaluate("coeffs", F.col("x").cast("double")).alias("y"))
    return perform(wide.withColumns({"size": F.col("n"), "noise_coeff": F.lit(noise_coeff)}), expression, numeric=numeric, seed=seed)


def manual_balance(series: DataFrame, expression: str, rank: int, main_var: str = "t") -> DataFrame:
    """series_id, stage, params, error: the raw balance against the first `rank` coefficients of a polynomial of one more.

    Stage 'first' balances as many orders as there are parameters, stage 'after' all of them by least squares from there.
    """
    formula = Formula(expression, main_var)
    m = len(formula.params)

    def run(batches):
        for b in batches:
            rows = []
            for key, c in zip(b.series_id, b.coeffs):
                for stage, used, over in (("first", m, False), ("after", rank, True)):
                    try:
                        if c is None:
                            raise B.BalanceError("too few samples")
                        rows.append((key, stage, B.solve(formula, np.array(c[:used], float), False, over).tolist(), None))
                    except (B.BalanceError, ValueError) as e:
                        rows.append((key, stage, None, str(e)))
            yield pd.DataFrame(rows, columns=["series_id", "stage", "params", "error"])

    return lsm.fit(series, rank + 1).select("series_id", "coeffs").mapInPandas(run, "series_id string, stage string, params array<double>, error string")


def deviation_by_noise(series: DataFrame, rank: int, sigmas: list[float], seed: int = 1) -> DataFrame:
    """series_id, sigma, mean, variance and deviation of how far a polynomial fit of the noisy series is from the ideal one."""
    levels = series.withColumn("sigma", F.explode(F.array(*[F.lit(float(v)) for v in sigmas])))
    noisy = levels.withColumns({"y_ideal": F.col("y"), "name": F.col("series_id"), "series_id": F.concat_ws("~", "series_id", F.col("sigma").cast("string"))})
    noisy = noisy.withColumn("y", F.col("y") + G.normal(seed, "name", "x") * F.col("sigma"))
    told = lsm.fitted(noisy, rank).withColumn("far", F.abs(F.col("y_fit") - F.col("y_ideal")))
    return told.groupBy(F.col("name").alias("series_id"), "sigma").agg(F.avg("far").alias("mean"), F.var_pop("far").alias("variance"), F.stddev_pop("far").alias("deviation"))


def monte_carlo(series: DataFrame, rank: int, runs: int, sigma: float, seed: int = 1) -> DataFrame:
    """series_id, runs, median and deviation of rse over noisy repeats of a polynomial fit."""
    noisy = G.add_noise(repeats(series, runs), 0.0, sigma, seed=seed)
    fitted = lsm.fitted(noisy, rank).groupBy("series_id").agg(M.rse("y_ideal", "y_fit").alias("rse"))
    return fitted.groupBy(F.substring_index("series_id", "#", 1).alias("series_id")).agg(F.count("*").alias("runs"), F.median("rse").alias("rse_median"), F.stddev_pop("rse").alias("rse_deviation"))


def growing_prefixes(series: DataFrame, sizes: list[int], rank: int = 10) -> DataFrame:
    """series_id, size, score: rse and 1 - r_sq of a polynomial on growing prefixes, each scaled to [0, 1] over the sizes, summed."""
    from pyspark.sql import Window

    grid = lsm.fitted(prefixes(series, sizes), rank).groupBy("series_id").agg(M.rse("y", "y_fit").alias("rse"), (1 - M.r_sq_fit("y", "y_fit")).alias("miss"))
    parts = grid.select(F.substring_index("series_id", "@", 1).alias("series_id"), F.substring_index("series_id", "@", -1).cast("int").alias("size"), "rse", "miss")
    w = Window.partitionBy("series_id")
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    return parts.select("series_id", "size", (unit("rse") + unit("miss")).alias("score"))


def timed(work: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str, float]:
    """(result, label, milliseconds) with the result computed in full."""
    began = time.perf_counter()
    df = work()
    df.write.format("noop").mode("overwrite").save()
    return df, label, (time.perf_counter() - began) * 1000
