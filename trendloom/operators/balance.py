"""Balance of a formula's power series against polynomial coefficients.

Raw balance: the series coefficients m_k(params) equal the polynomial's c_k. Discrete balance: m_k is first divided by the
formula's own series coefficient with all parameters 1, that is, m_k equals p_k * c_k. Known forms have closed solutions, as
Spark columns; complex solutions are null. Any other formula is solved by damped Gauss-Newton from several starts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import Formula


#: Starts without a real gain after which a solver that is far from any solution gives up.
PATIENCE = 20


class BalanceError(RuntimeError):
    pass


#: Closed forms: formula, and its series coefficients with all parameters 1.
CLOSED = {
    "exp": ("a0 + a1*t + a2*exp(a3*t)", (2, 2, 1 / 2, 1 / 6)),
    "sincos": ("a0 + a1*t + a2*sin(a3*t) + a4*cos(a5*t)", (2, 2, -1 / 2, -1 / 6, 1 / 24, 1 / 120)),
    "sincos_one": ("a0*sin(a1*t) + a2*cos(a1*t)", (1, 1, -1 / 2)),
    "exp_const": ("a0 + exp(a1*t)", (2, 1)),
    "exp_linear": ("a0 + a1*t + exp(a2*t)", (2, 2, 1 / 2)),
    "sin_square": ("a0 + a1*t**2 + a2*sin(a3*t)", (1, 1, 1, -1 / 6)),
    "cos_cube": ("a0 + a1*t + a2*t**3 + a3*cos(a4*t)", (2, 1, -1 / 2, 1, 1 / 24)),
}


def root_column(x: Column) -> Column:
    return F.when(x > 0, F.sqrt(x))


def _root_of(x: float) -> float:
    return math.sqrt(x) if x > 0 else math.nan


def _quotient(a: float, b: float) -> float:
    return a / b if b else math.nan


def closed_form(name: str, c: list, discrete: bool = False) -> dict:
    """Parameters of a closed form from ascending coefficients, as columns or (of floats) as floats, NaN where there is no real
    one. Frequencies are positive (their sign doesn't change the curve); exp_linear takes the positive branch under a2 and the
    other one under a2_other (with a1_other); nearer_branch() chooses."""
    text, p = CLOSED[name]
    if discrete:
        c = [float(k) * x for k, x in zip(p, c)]
    d, _root = (F.try_divide, root_column) if isinstance(c[0], Column) else (_quotient, _root_of)
    if name == "exp":
        a3 = d(3 * c[3], c[2])
        a2 = d(2 * c[2], a3 * a3)
        return {"a0": c[0] - a2, "a1": c[1] - a2 * a3, "a2": a2, "a3": a3}
    if name == "sincos":
        w5, w3 = _root(d(-12 * c[4], c[2])), _root(d(-20 * c[5], c[3]))
        a4, a2 = d(-2 * c[2], w5 * w5), d(-6 * c[3], w3 * w3 * w3)
        return {"a0": c[0] - a4, "a1": c[1] - a2 * w3, "a2": a2, "a3": w3, "a4": a4, "a5": w5}
    if name == "sincos_one":
        w = _root(d(-2 * c[2], c[0]))
        return {"a0": d(c[1], w), "a1": w, "a2": c[0]}
    if name == "exp_const":
        return {"a0": c[0] - 1, "a1": c[1]}
    if name == "exp_linear":
        a2 = _root(2 * c[2])
        return {"a0": c[0] - 1, "a1": c[1] - a2, "a2": a2, "a1_other": c[1] + a2, "a2_other": -a2}
    if name == "sin_square":
        w = _root(d(-6 * c[3], c[1]))
        return {"a0": c[0], "a1": c[2], "a2": d(c[1], w), "a3": w}
    if name == "cos_cube":
        w = _root(d(-12 * c[4], c[2]))
        a3 = d(-2 * c[2], w * w)
        return {"a0": c[0] - a3, "a1": c[1], "a2": c[3], "a3": a3, "a4": w}
    raise KeyError(name)


def nearer_branch(series: DataFrame, fits: DataFrame, discrete: bool = False) -> DataFrame:
    """series_id, a0, a1, a2, rss of a0 + a1*t + exp(a2*t): of its two branches the one nearer to the series (the positive one if
    both are equally near); nulls where there is no real one. fits: series_id, coeffs."""
    a = closed_form("exp_linear", [F.col("coeffs")[k] for k in range(3)], discrete)
    both = fits.select("series_id", *[v.alias(k) for k, v in a.items()])
    x = F.col("x").cast("double")
    rss = lambda p, q: F.sum(F.pow(F.col("y") - (F.col("a0") + F.col(p) * x + F.exp(F.col(q) * x)), 2))
    told = series.select("series_id", "x", "y").join(both, "series_id").groupBy("series_id", *a).agg(rss("a1", "a2").alias("rss"), rss("a1_other", "a2_other").alias("rss_other"))
    other = F.col("rss_other") < F.col("rss")
    pick = lambda c: F.when(other, F.col(c + "_other")).otherwise(F.col(c)).alias(c)
    return told.select("series_id", F.when(F.col("a2").isNotNull(), F.col("a0")).alias("a0"), *map(pick, ("a1", "a2", "rss")))


@lru_cache(1)
def _shapes() -> dict[tuple, str]:
    return {Formula(text).shape(): name for name, (text, _) in CLOSED.items()}


def closed_name(formula: Formula) -> str | None:
    """The closed form that a formula is, whatever its names."""
    return _shapes().get(formula.shape())


def cosine_sine(c: list[Column]) -> dict[str, Column]:
    """a0*cos(w*t) + b0*sin(w*t) from a quadratic: w = sqrt(|c2 / c0|)."""
    w = F.sqrt(F.abs(F.try_divide(c[2], c[0])))
    return {"a0": c[0], "b0": F.try_divide(c[1], w), "w": w}


def weights(formula: Formula, order: int) -> np.ndarray:
    """Series coefficients with all parameters 1."""
    return formula.series(np.ones(len(formula.params)), order)


def _jacobian(f, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty((len(r), len(a)))
    for i in range(len(a)):
        h = 1e-6 * max(1.0, abs(a[i]))
        up, down = a.copy(), a.copy()
        up[i] += h
        down[i] -= h
        out[:, i] = (f(up) - f(down)) / (2 * h)
    return out


def least_squares(f, start: np.ndarray, steps: int = 300, jacobian=None) -> tuple[np.ndarray, float]:
    """Levenberg and Marquardt's method with column scaling: (parameters, sum of squares)."""
    a = np.array(start, float)
    r = f(a)
    cost, damp = float(r @ r), 1e-3
    if not np.isfinite(cost):
        return a, np.inf
    for _ in range(steps):
        j = jacobian(a) if jacobian else _jacobian(f, a, r)
        if not np.isfinite(j).all():
            break
        scale = np.maximum(np.linalg.norm(j, axis=0), 1e-300)
        q = j / scale
        g, h = q.T @ r, q.T @ q
        done = False
        for _ in range(25):
            try:
                step = np.linalg.solve(h + damp * np.eye(len(a)), -g) / scale
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            new = f(a + step)
            c = float(new @ new)
            if np.isfinite(c) and c < cost:
                done = cost - c <= 1e-15 * cost
                a, r, cost, damp = a + step, new, c, max(damp / 5, 1e-15)
                break
            damp *= 4
        else:
            break
        if done or cost == 0:
            break
    return a, cost


def solve(formula: Formula, coeffs: np.ndarray, discrete: bool = True, overdetermined: bool = False, tolerance: float = 1e-8) -> np.ndarray:
    """Parameters (by name) that balance the formula against ascending coefficients, or BalanceError."""
    m, rank = len(formula.params), len(coeffs)
    target = np.array(coeffs, float)
    have = formula.orders(rank)
    if rank < m:
        raise ValueError("rank is less than the number of parameters")
    if len(have) < m:
        raise BalanceError("the balance has fewer equations than parameters")
    if discrete:
        target = target * weights(formula, rank)
    if overdetermined and len(have) > m:  # from the first orders' solution, least squares of all orders as they are
        start = solve(formula, np.array(coeffs[: have[m - 1] + 1], float), discrete)
        return least_squares(lambda a: (formula.series(a, rank) - target)[have], start)[0]
    name = closed_name(formula)
    if name is not None:
        known = closed_form(name, [float(x) for x in coeffs[: have[m - 1] + 1]], discrete)
        found = np.array([known[p] for p in Formula(CLOSED[name][0]).params])
        if not np.isfinite(found).all():
            raise BalanceError("the balance has no real solution")
        return found
    use = have[:m]
    scale = np.maximum(np.abs(target[use]), 1e-12)

    def f(a: np.ndarray) -> np.ndarray:
        return (formula.series(a, rank)[use] - target[use]) / scale

    best, found = np.inf, None
    rng = np.random.default_rng(7)
    ratio = np.abs(target[1:] / np.where(target[:-1] == 0, np.nan, target[:-1]))
    pace = float(np.nanmedian(ratio)) if np.isfinite(ratio).any() else 1.0
    starts = [np.ones(m), np.full(m, 0.1), np.full(m, pace or 1.0)] + [rng.normal(size=m) * 10.0 ** rng.uniform(-3, 1, m) for _ in range(60)]
    idle = 0
    for s in starts:
        a, cost = least_squares(f, s, 120)
        idle = 0 if cost < 0.5 * best else idle + 1
        if cost < best:
            j = _jacobian(f, a, f(a))
            size = np.linalg.norm(j, axis=0)
            if np.all(size > 0) and np.linalg.matrix_rank(j / size, 1e-9) == m:
                best, found = cost, a
        if best < tolerance**2 or (idle >= PATIENCE and best > 1e-3):  # a system without a real solution
            break
    if found is None or best > 1e-8:
        raise BalanceError("the balance has no real solution")
    return found


def integral(formula: Formula, coeffs: np.ndarray, start: np.ndarray, horizon: float = 1.7, order: int = 7) -> np.ndarray:
    """Integral balance: the least horizon * sum over l of e2(l) / (l + 1), e2 the squared difference of the two series."""
    target = np.zeros(order)
    target[: min(order, len(coeffs))] = coeffs[:order]
    scale = max(np.abs(target).max(), 1e-12)
    # The sum is an integral of the squared difference, cut after `order` terms; as a quadrature it has non-negative weights.
    x, w = np.polynomial.legendre.leggauss(order + 2)
    x, w = (x + 1) / 2, w / 2
    basis = np.power(x[:, None], np.arange(order)) * np.sqrt(w * horizon)[:, None]

    def f(a: np.ndarray) -> np.ndarray:
        return basis @ (formula.series(a, order) - target) / scale

    return least_squares(f, start)[0]
