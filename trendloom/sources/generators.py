"""Synthetic series, random laws and noise. Random numbers are hashes of (seed, x), alike for any partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Test curves by name: default length and formula in t (fixed values).
CURVES = {
    "exponential1": (10_000, "0.0000005*t**2"),
    "exponential2": (2_000, "1.2*t + 0.1*exp(0.011*t)"),
    "exponential2_shifted": (2_000, "30 + 0.01*t + 0.1*exp(0.011*t)"),
    "transcendental1": (1_000, "0.2*sin(0.005*t) + 2.12*cos(0.005*t)"),
    "transcendental2": (100, "21.5*sin(0.1*t) - 12.3*cos(0.1*t)"),
    "transcendental3": (500, "-7.22*cos(0.015*t) - 0.54*sin(0.015*t) + 1.9*cos(0.015*t)"),
    "combined1": (2_000, "30 + 0.05*t + 14*sin(0.002*t) + 17.5*cos(0.01*t)"),
    "lab_periodic": (50, "7.8*cos(0.05*t) + 9.5*sin(0.05*t)"),
    "notebook_quadratic": (100, "20 + 0.5*t + 0.05*t**2"),
    "notebook_sine": (1_000, "2.2*sin(0.01*t)"),
}


def from_formula(spark: SparkSession, name: str, text: str, n: int, var: str = "t") -> DataFrame:
    """(series_id, x, n, y) of a formula without parameters."""
    from ..functions.formula import Formula

    return spark.range(n).select(F.lit(name).alias("series_id"), F.col("id").alias("x"), F.lit(n).cast("long").alias("n"), Formula(text, var).column(F.col("id").cast("double"), {}).alias("y"))


def from_callable(spark: SparkSession, name: str, work: Callable[[np.ndarray], np.ndarray], n: int) -> DataFrame:
    """(series_id, x, n, y) of a Python function of an array of places, asked batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"series_id": name, "x": b.id, "n": n, "y": np.asarray(work(b.id.to_numpy(float)), float)})

    return spark.range(n).mapInPandas(run, "series_id string, x long, n long, y double")


def curve(spark: SparkSession, name: str, n: int | None = None) -> DataFrame:
    """(series_id, x, n, y) of a test curve."""
    size, text = CURVES[name]
    return from_formula(spark, name, text, size if n is None else n)


def uniform(seed: int, *keys: Column | str) -> Column:
    """U(0, 1), never 0 or 1: 52 bits of the MD5 of seed/key/key..., which other engines can repeat."""
    text = F.concat_ws("/", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """N(0, 1) by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(2 * seed, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *keys))


def exponential(seed: int, scale: float, *keys: Column | str) -> Column:
    return -scale * F.log(uniform(seed, *keys))


def chi_square(seed: int, k: int, *keys: Column | str) -> Column:
    return sum((F.pow(normal(seed * 1000 + i, *keys), 2) for i in range(1, k)), F.pow(normal(seed * 1000, *keys), 2))


def sample(spark: SparkSession, law: str, n: int, a: float, b: float = 0.0, seed: int = 1) -> DataFrame:
    """(x, y): n draws of uniform(a, b), normal(a, b), exponential(a) or chi_square(a)."""
    laws = {
        "uniform": lambda: uniform(seed, "id") * (b - a) + a,
        "normal": lambda: normal(seed, "id") * b + a,
        "exponential": lambda: exponential(seed, a, "id"),
        "chi_square": lambda: chi_square(seed, int(a), "id"),
    }
    return spark.range(n).select(F.col("id").alias("x"), laws[law]().alias("y"))


def outlier_positions(spark: SparkSession, n: int, count: int, seed: int = 1) -> DataFrame:
    """(draw, x): positions drawn with replacement from 1 to n - 1."""
    return spark.range(count).select(F.col("id").alias("draw"), (F.floor(uniform(seed, "id") * (n - 1)) + 1).cast("long").alias("x"))


def add_noise(series: DataFrame, mu: float = 0.0, sigma: float = 5.0, abnormal: bool = False, coeff: float = 3.0, dens: float = 10.0, seed: int = 1, replace: bool = False) -> DataFrame:
    """y with normal noise; if abnormal, dens percent of positions (drawn with replacement) get outliers of sigma * coeff.

    Outliers of one position add up on the noisy value; with replace, the last drawn takes the place of noise and value's noise.
    The input's y stays as y_ideal.
    """
    noisy = series.withColumn("y_ideal", F.col("y")).withColumn("y", F.col("y") + normal(seed, "series_id", "x") * sigma + mu)
    if not abnormal:
        return noisy
    sizes = series.groupBy("series_id").agg(F.max("n").alias("m"))
    draws = sizes.select("series_id", "m", F.explode(F.sequence(F.lit(1), F.floor(F.col("m") * dens / 100).cast("int"))).alias("draw")).where(F.col("draw") >= 1)
    draws = draws.select("series_id", "draw", (F.floor(uniform(seed + 7, "series_id", "draw") * (F.col("m") - 1)) + 1).cast("long").alias("x"), (normal(seed + 8, "series_id", "draw") * sigma * coeff + mu).alias("v"))
    at = draws.groupBy("series_id", "x").agg(F.sum("v").alias("total"), F.max_by("v", "draw").alias("last"))
    joined = noisy.join(at, ["series_id", "x"], "left")
    y = F.when(F.col("last").isNotNull(), F.col("y_ideal") + F.col("last")).otherwise(F.col("y")) if replace else F.col("y") + F.coalesce("total", F.lit(0.0))
    return joined.withColumn("y", y).drop("total", "last")
