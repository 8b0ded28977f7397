"""Fitting of formulas: balance against a polynomial, then, if asked for, numerical polishing; the curve is evaluated in the engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.formula import Formula
from ..sources.shared import written
from . import balance as B
from . import lsm

PARAMS_SCHEMA = "series_id string, n long, params array<double>, coeffs array<double>, error string"


class FittingModes(Enum):
    AUTO = 0
    DSB = 1
    DSBI = 2


@dataclass(frozen=True)
class FittingOptions:
    mode: FittingModes = FittingModes.AUTO
    full_model: bool = True
    numeric: bool = False


def solve_series(y: np.ndarray, formula: Formula, coeffs: np.ndarray, numeric: bool, discrete: bool, maxfev: int, overdetermined: bool = False, integral: bool = False, start: np.ndarray | None = None) -> np.ndarray:
    a = np.asarray(start, float) if start is not None else B.solve(formula, coeffs, discrete, overdetermined)
    if integral:
        a = B.integral(formula, coeffs, a)
    if numeric:
        t = np.arange(len(y), dtype=float)
        a, cost = B.least_squares(lambda p: formula.values(t, p) - y, a, max(10, min(maxfev, 2000)), lambda p: formula.values(t, p, True)[1])
        if not np.isfinite(cost):
            raise B.BalanceError("numerical fit diverged")
    return a


def raised_rank(y: np.ndarray, formula: Formula, rank: int, reach: int = 12, eps: float = 1e-6) -> int:
    """The first rank from `rank` on after which the polynomial's rse and r_sq don't change; `rank` itself if none is, or if the
    formula's series has no term of some order below it."""
    x = np.linspace(-1, 1, len(y))
    scores = []
    for r in range(rank, min(rank + reach, len(y) - 2)):
        f = np.polynomial.chebyshev.chebval(x, np.polynomial.chebyshev.chebfit(x, y, r - 1))
        rss = float(((y - f) ** 2).sum())
        scores.append((np.sqrt(rss / (len(y) - 2)), 1 - rss / max(float(((f - f.mean()) ** 2).sum()), 1e-300)))
    for i, (a, b) in enumerate(zip(scores, scores[1:])):
        if abs(b[0] - a[0]) * abs(b[1] - a[1]) < eps:
            r = min(rank + i, lsm.MAX_RANK)
            return r if len(formula.orders(r)) == r else rank
    return rank


def _solved(pdf: pd.DataFrame, formula: Formula, rank: int, coeffs: list | None, numeric: bool, discrete: bool, maxfev: int, raise_rank: bool, more: dict) -> tuple:
    """(params, coeffs, error) of one series, sorted by x."""
    m = len(formula.params)
    try:
        if coeffs is None:
            raise B.BalanceError("too few samples")
        y = pdf.y.to_numpy(float) if numeric or raise_rank else np.zeros(0)
        options = dict(more)
        if raise_rank and (r := raised_rank(y, formula, rank)) > rank:
            h = (len(y) - 1) / 2
            b = np.polynomial.polynomial.polyfit((np.arange(len(y)) - h) / h, y, r - 1)
            coeffs = np.polynomial.Polynomial(b)(np.polynomial.Polynomial([-1, 1 / h])).coef.tolist()
            options["overdetermined"] = len(coeffs) > m
        a = solve_series(y, formula, np.array(coeffs, float), numeric, discrete, maxfev, **options)
        return a.tolist(), list(coeffs), None
    except (B.BalanceError, ValueError, np.linalg.LinAlgError) as e:
        return None, None if coeffs is None else list(coeffs), str(e)


def _checked(text: str, var: str, rank: int) -> tuple[Formula, int]:
    formula = Formula(text, var)
    m = len(formula.params)
    rank = rank or m
    if not m <= rank <= lsm.MAX_RANK:
        raise ValueError(f"rank must be {m} (the number of parameters) to {lsm.MAX_RANK}")
    return formula, rank


def _fit(series: DataFrame, text: str, var: str, rank: int, numeric: bool, discrete: bool, maxfev: int, raise_rank: bool = False, **more) -> DataFrame:
    formula, rank = _checked(text, var, rank)

    def run(samples: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if fits.empty:
            return pd.DataFrame(columns=["series_id", "n", "params", "coeffs", "error"])
        params, coeffs, error = _solved(samples.sort_values("x", kind="stable"), formula, rank, fits.coeffs.iloc[0], numeric, discrete, maxfev, raise_rank, more)
        return pd.DataFrame({"series_id": [fits.series_id.iloc[0]], "n": [fits.n.iloc[0]], "params": [params], "coeffs": [coeffs], "error": [error]})

    return _with_samples(series if numeric or raise_rank else None, lsm.fit(series, rank), run, PARAMS_SCHEMA)


def _with_samples(series: DataFrame | None, fits: DataFrame, run, schema: str) -> DataFrame:
    """run(samples, fits) of each series; without a series (where coefficients are enough) no sample moves."""
    if series is None:
        none = pd.DataFrame({"x": [], "y": []})
        return fits.groupBy("series_id").applyInPandas(lambda pdf: run(none, pdf), schema)
    fits = fits.select(*[F.col(c).alias(c) for c in fits.columns])  # made from the series, so its columns need names of their own
    return series.select("series_id", "x", "y").groupBy("series_id").cogroup(fits.groupBy("series_id")).applyInPandas(run, schema)


def fit_each(series: DataFrame, formulas: dict[int, tuple[str, int]], main_var: str = "t", numeric: bool = True, discretes: bool = True, maxfev: int = 100_000) -> DataFrame:
    """dsb_fit of several formulas (by a label: text and rank) side by side: label and the columns of dsb_fit.

    The power sums of all ranks come from one pass, and a series meets its samples once.
    """
    known = {label: _checked(text, main_var, rank) for label, (text, rank) in formulas.items()}

    def run(samples: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        samples = samples.sort_values("x", kind="stable")
        by_rank = dict(zip(fits["rank"], fits.coeffs))
        rows = []
        for label, (formula, rank) in known.items() if len(fits) else ():
            params, coeffs, error = _solved(samples, formula, rank, by_rank[rank], numeric, discretes, maxfev, False, {})
            rows.append((fits.series_id.iloc[0], fits.n.iloc[0], params, coeffs, error, label))
        return pd.DataFrame(rows, columns=["series_id", "n", "params", "coeffs", "error", "label"])

    fits = lsm.fit_ranks(series, sorted({rank for _, rank in known.values()}))
    return _with_samples(series if numeric else None, fits, run, PARAMS_SCHEMA + ", label int")


def dsb_fit(series: DataFrame, expression: str, main_var: str = "t", rank: int = 0, numeric: bool = True, discretes: bool = True, maxfev: int = 100_000, long_series: bool = False) -> DataFrame:
    """series_id, n, params (by name), coeffs, error (null if fitted). With long_series, polishing leaves a series' samples where they
    are (see polish), at a pass over the data for each step; else a series is polished by one task."""
    if numeric and long_series:
        return polish(series, _fit(series, expression, main_var, rank, False, discretes, maxfev), expression, main_var)
    return _fit(series, expression, main_var, rank, numeric, discretes, maxfev)


#: Dampings that a pass over a long series tries side by side, as multiples of the last good one.
TRIED = (0.1, 1.0, 10.0, 1e3)


def _slopes(formula: Formula):
    """Of each series in a partition and each of its trials: the sums of products of derivatives, of derivatives and residuals, and of
    squared residuals."""
    m = len(formula.params)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for key, g in b.groupby("series_id", sort=False):
                x, y, row = g.x.to_numpy(float), g.y.to_numpy(float), g.iloc[0]
                told = []
                for k in range(len(TRIED)):
                    v, d = formula.values(x, [float(row[f"p{k}_{i}"]) for i in range(m)], True)
                    r = v - y
                    with np.errstate(all="ignore"):
                        told.append(np.concatenate([(d.T @ d).ravel(), d.T @ r, [r @ r]]))
                one = np.concatenate(told)
                sums[key] = sums[key] + one if key in sums else one
        if sums:
            yield pd.DataFrame({"series_id": list(sums), "sums": [x.tolist() for x in sums.values()]})

    return run


def _moved(m: int):
    """One step of Levenberg and Marquardt's method for each series: its state and the sums at its trials to the next state."""
    size = m * m + m + 1

    def run(state: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        trials, best, told, cost, damp, done = np.array(s.trials, float), s.best, s.told, s.cost, s.damp, bool(s.done)
        if not done:
            new = np.sum(np.array(sums.sums.tolist(), float), 0).reshape(-1, size) if len(sums) else np.full((len(TRIED), size), np.nan)
            costs = np.where(np.isfinite(new).all(1), new[:, -1], np.inf)
            k = int(np.argmin(costs))
            if costs[k] < (np.inf if best is None else cost):
                done = best is not None and cost - costs[k] <= 1e-12 * cost
                damp = max(damp * (TRIED[k] if best is not None else 1.0), 1e-15)
                best, told, cost = trials[m * k : m * k + m].tolist(), new[k].tolist(), float(costs[k])
            else:
                damp *= TRIED[-1]
            done = done or best is None or cost == 0 or damp > 1e12
            if not done:
                at = np.array(told, float)
                jj, jr = at[: m * m].reshape(m, m), at[m * m : m * m + m]
                scale = np.maximum(np.sqrt(np.diag(jj)), 1e-300)
                trials = np.concatenate([np.array(best, float) + np.linalg.lstsq(jj / scale / scale[:, None] + damp * f * np.eye(m), -jr / scale, rcond=None)[0] / scale for f in TRIED])
        return pd.DataFrame({"series_id": [s.series_id], "trials": [trials.tolist()], "best": [best], "told": [told], "cost": [cost], "damp": [damp], "done": [done]})

    return run


_STATE = "series_id string, trials array<double>, best array<double>, told array<double>, cost double, damp double, done boolean"


def polish(series: DataFrame, fits: DataFrame, expression: str, main_var: str = "t", rounds: int = 100) -> DataFrame:
    """fits with parameters of the least sum of squares, from theirs on, without bringing a series into one task.

    A step needs of the samples only sums of products of derivatives and residuals, which partitions make on their own; one small
    row for each series and partition moves. Each round is one pass over the series that aren't done, and its state a written table.
    A pass scores the steps of several dampings at once and takes the best.
    """
    formula = Formula(expression, main_var)
    m = len(formula.params)
    none = lambda kind: F.lit(None).cast(kind)
    state = fits.where("error IS NULL").select("series_id", F.flatten(F.array_repeat(F.col("params"), len(TRIED))).alias("trials"), none("array<double>").alias("best"), none("array<double>").alias("told"), none("double").alias("cost"), F.lit(1e-3).alias("damp"), F.lit(False).alias("done"))
    state = written(state, "polish")
    for _ in range(rounds):
        open_ = state.where("NOT done").select("series_id", *[F.col("trials")[m * k + i].alias(f"p{k}_{i}") for k in range(len(TRIED)) for i in range(m)])
        if open_.isEmpty():
            break
        sums = series.select("series_id", "x", "y").join(open_, "series_id").mapInPandas(_slopes(formula), "series_id string, sums array<double>")
        state = written(state.groupBy("series_id").cogroup(sums.groupBy("series_id")).applyInPandas(_moved(m), _STATE), "polish")
    told = fits.join(state.select("series_id", "best", F.lit(True).alias("tried")), "series_id", "left")
    error = F.when(F.col("tried") & F.col("best").isNull(), "numerical fit diverged").otherwise(F.col("error"))
    return told.select("series_id", "n", F.col("best").alias("params"), "coeffs", error.alias("error"))


def nonline_fit(series: DataFrame, expression: str, main_var: str = "t", rank: int = 0, numeric: bool = False, offset: bool = False, raise_rank: bool = False, maxfev: int = 100_000) -> DataFrame:
    """Raw balance (discrete with offset); with more coefficients than parameters, in the least-squares sense. raise_rank lets each
    series choose its rank, from `rank` up."""
    m = len(Formula(expression, main_var).params)
    return _fit(series, expression, main_var, rank, numeric, offset, maxfev, raise_rank, overdetermined=rank > m)


def dsbi_fit(series: DataFrame, expression: str, main_var: str = "t", rank: int = 0, numeric: bool = False) -> DataFrame:
    """Integral balance, from the raw balance's solution."""
    return _fit(series, expression, main_var, rank, numeric, False, 100_000, integral=True)


def iterative_fit(series: DataFrame, expression: str, start: list[float], main_var: str = "t", maxfev: int = 100_000) -> DataFrame:
    """Plain least squares from given parameters."""
    return _fit(series, expression, main_var, 0, True, False, maxfev, start=np.array(start, float))


def curve(fits: DataFrame, expression: str, main_var: str = "t", length: int = 0, start: int = 0) -> DataFrame:
    """series_id, x, y_fit of fitted formulas; length 0 means as many as the series has, more extrapolates."""
    formula = Formula(expression, main_var)
    y = formula.column(F.col("x").cast("double"), {p: F.col("params")[i] for i, p in enumerate(formula.params)})
    return lsm.extrapolate(fits.where("params IS NOT NULL"), length, start, y)


def with_fit(series: DataFrame, fits: DataFrame, expression: str, main_var: str = "t", keep: list[str] | None = None) -> DataFrame:
    """The series with the fitted curve as y_fit, and the columns of fits in `keep` (of which a series may have several)."""
    formula = Formula(expression, main_var)
    y = formula.column(F.col("x").cast("double"), {p: F.col("params")[i] for i, p in enumerate(formula.params)})
    return series.join(fits.select("series_id", "params", *(keep or [])), "series_id").withColumn("y_fit", y).drop("params")


class Model:
    """A formula or polynomial with the series it is fitted to."""

    def __init__(self, series: DataFrame, expression: str | None = None, main_var: str = "t"):
        self.series, self.expr, self.var = series, expression, main_var
        self._fits: DataFrame | None = None

    @property
    def is_fitted(self) -> bool:
        return self._fits is not None

    def _need(self) -> DataFrame:
        if self._fits is None:
            raise RuntimeError("the model has not been fitted")
        return self._fits

    def poly_fit(self, rank: int, update: bool = False) -> DataFrame:
        fits = lsm.fit(self.series, rank)
        if update:
            self._fits, self.expr = fits.withColumn("params", F.col("coeffs")), " + ".join(["c0"] + [f"c{k}*{self.var}**{k}" for k in range(1, rank)])
        return fits

    def nonline_fit(self, options: FittingOptions = FittingOptions()) -> Model | DataFrame:
        """Fit, and return the model, or (without full_model) only its formula and parameters, as as_lite() tells them."""
        if self.expr is None:
            raise RuntimeError("no formula given")
        if options.mode is FittingModes.DSBI:
            self._fits = dsbi_fit(self.series, self.expr, self.var, numeric=options.numeric)
        else:
            self._fits = dsb_fit(self.series, self.expr, self.var, numeric=options.numeric, discretes=options.mode is FittingModes.DSB)
        return self if options.full_model else self.as_lite()

    @property
    def coeffs(self) -> DataFrame:
        return self._need()

    def data_fit(self) -> DataFrame:
        self._need()
        return with_fit(self.series, self._fits, self.expr, self.var)

    def collapse(self, value: int = 0, length: int = 0) -> DataFrame:
        """The curve at [value, value + length), or at one place."""
        return curve(self._need(), self.expr, self.var, length or 1, value)

    __call__ = collapse

    def apply_trained(self, params: list[float]) -> Model:
        """Set the parameters by hand, alike for all series."""
        if len(params) != len(Formula(self.expr, self.var).params):
            raise RuntimeError("wrong number of parameters")
        sizes = self.series.groupBy("series_id").agg(F.max("n").alias("n"))
        self._fits = sizes.withColumns({"params": F.array(*[F.lit(float(p)) for p in params]), "error": F.lit(None).cast("string")})
        return self

    def as_lite(self) -> DataFrame:
        """series_id and struct(expr, var, params by name)."""
        names = sorted(Formula(self.expr, self.var).params)
        return self._need().select("series_id", F.struct(F.lit(self.expr).alias("expr"), F.lit(self.var).alias("var"), F.map_from_arrays(F.array(*map(F.lit, names)), F.col("params")).alias("params")).alias("model"))

    def told(self) -> DataFrame:
        """series_id and the formula with its parameters' numbers, as text (null where there was no fit)."""
        formula = Formula(self.expr, self.var)

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"series_id": b.series_id, "formula": [None if p is None else formula.filled(p) for p in b.params]})

        return self._need().select("series_id", "params").mapInPandas(run, "series_id string, formula string")

    def as_lambda(self, series_id: str):
        """The fitted curve of one series as a function of an array of places."""
        row = self._need().where(F.col("series_id") == series_id).select("params").first()
        if row is None or row.params is None:
            raise RuntimeError("the model has not been fitted")
        formula = Formula(self.expr, self.var)
        return lambda t: formula.values(np.atleast_1d(t), row.params)

    def __str__(self) -> str:
        return f"{self.expr} in {self.var}" if self.expr else "no formula"

    def metrics(self) -> DataFrame:
        return self.data_fit().groupBy("series_id").agg(*M.model_metrics("y", "y_fit"))


def spectrum(expression: str, params: list[float], order: int, main_var: str = "t", scale: bool = False) -> list[float]:
    """Power series coefficients of a formula; with scale, divided by those with all parameters 1."""
    f = Formula(expression, main_var)
    c = f.series(params, order)
    if scale:
        p = B.weights(f, order)
        c = np.divide(c, p, out=np.zeros(order), where=p != 0)
    return c.tolist()
