"""The engine's queries by name, and the SQL that tells the same for each where SQL can.

Series: EV events by type, OD orders by day, LI lineitem by day, PQ quantities by part. Doubles are rounded on both sides.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.formula import Formula
from ..operators import balance as B
from ..operators import cleaning as C
from ..operators import experiments as X
from ..operators import fit as FT
from ..operators import lsm
from ..sources import generators as G
from ..sources import html as H
from ..sources import series as S
from ..streaming import filters as SF
from ..streaming.run import drained

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL building blocks
EV = "ev AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x, count(*) OVER (PARTITION BY event_type) AS n, value AS y FROM events)"
OD = "od AS (SELECT 'orders' AS series_id, row_number() OVER (ORDER BY d) - 1 AS x, count(*) OVER () AS n, y FROM (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS y FROM orders GROUP BY 1))"
LI = "li AS (SELECT 'lineitem' AS series_id, row_number() OVER (ORDER BY d) - 1 AS x, count(*) OVER () AS n, y FROM (SELECT l_shipdate::DATE AS d, sum(l_extendedprice * (1 - l_discount)) AS y FROM lineitem GROUP BY 1))"


def sums(src: str) -> str:
    """q: scaled solutions of degree 1 to 3 and unscaled coefficients l0.., p0.., k0.. of each series."""
    z = "((x - (n - 1) / 2.0) / ((n - 1) / 2.0))"
    return f"""s AS (SELECT series_id, any_value(n) AS n, (any_value(n) - 1) / 2.0 AS h, count(*)::DOUBLE AS s0, sum(pow({z}, 2)) AS s2, sum(pow({z}, 4)) AS s4, sum(pow({z}, 6)) AS s6,
  sum(y) AS t0, sum(y * {z}) AS t1, sum(y * pow({z}, 2)) AS t2, sum(y * pow({z}, 3)) AS t3 FROM {src} GROUP BY series_id),
b AS (SELECT *, (s4*t0 - s2*t2) / (s0*s4 - s2*s2) AS e0, t1 / s2 AS e1, (s0*t2 - s2*t0) / (s0*s4 - s2*s2) AS e2,
  (s6*t1 - s4*t3) / (s2*s6 - s4*s4) AS g1, (s2*t3 - s4*t1) / (s2*s6 - s4*s4) AS g3 FROM s),
q AS (SELECT series_id, n, t0 / s0 - e1 AS l0, e1 / h AS l1, e0 - e1 + e2 AS p0, (e1 - 2*e2) / h AS p1, e2 / (h*h) AS p2,
  e0 - g1 + e2 - g3 AS k0, (g1 - 2*e2 + 3*g3) / h AS k1, (e2 - 3*g3) / (h*h) AS k2, g3 / (h*h*h) AS k3 FROM b)"""


QUAD = "(p0 + p1*x + p2*x*x)"
LINE = "(l0 + l1*x)"


def fitted_sql(src: str) -> str:
    return f"{sums(src)}, f AS (SELECT v.series_id, v.x, v.n, v.y, {QUAD} AS g, {LINE} AS g1 FROM {src} v JOIN q USING (series_id))"


def orthogonal(src: str, rank: int, extra: str = "") -> str:
    """Least squares of up to `rank` coefficients by the recurrence of discrete orthogonal polynomials, another way than normal equations.

    CTEs u{rank - 1} (the rows with fitted values g1, g2, ... of each rank, and the columns of `extra`) and o (series_id, n and the
    coefficients c0, c1, ... of the last rank in powers of x).
    """
    more = "".join(f", {c}" for c in extra.split())
    out = [f"u0 AS (SELECT series_id, x, n, y{more}, ((x - (n - 1) / 2.0) / ((n - 1) / 2.0)) AS z, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p FROM {src})"]
    for k in range(rank):
        out.append(f"v{k} AS (SELECT series_id, any_value(n) AS n, sum(p * p) AS s{k}, sum(z * p * p) / sum(p * p) AS a{k}, sum(y * p) / sum(p * p) AS d{k} FROM u{k} GROUP BY series_id)")
        told = "".join(f", g{j}" for j in range(1, k + 1))
        last = f"g{k} + " if k else ""
        back = f" - CASE WHEN e.s{k - 1} > 0 THEN v.s{k} / e.s{k - 1} ELSE 0 END * u.b" if k else ""
        before = f" JOIN v{k - 1} e ON e.series_id = u.series_id" if k else ""
        out.append(f"u{k + 1} AS (SELECT u.series_id, u.x, u.n, u.y{''.join(f', u.{c}' for c in extra.split())}, u.z{told}, {last}v.d{k} * u.p AS g{k + 1}, u.p AS b, (u.z - v.a{k}) * u.p{back} AS p FROM u{k} u JOIN v{k} v ON v.series_id = u.series_id{before})")
    q: list[list[str]] = [["1"]]  # q[k]: coefficients of the k-th polynomial in powers of z
    cols = []
    for k in range(rank):
        for j, c in enumerate(q[k]):
            cols.append(f"q{k}_{j} AS ({c})")
        up = ["0", *[f"q{k}_{j}" for j in range(k + 1)]]
        new = [f"{up[j]}" + (f" - a{k} * q{k}_{j}" if j <= k else "") + (f" - s{k} / s{k - 1} * q{k - 1}_{j}" if k and j <= k - 1 else "") for j in range(k + 2)]
        q.append(new)
    stage = f"(SELECT * FROM v0 {' '.join(f'JOIN (SELECT series_id, s{k}, a{k}, d{k} FROM v{k}) USING (series_id)' for k in range(1, rank))})"
    for c in cols:
        name, expr = c.split(" AS ", 1)
        stage = f"(SELECT *, {expr} AS {name} FROM {stage})"
    for j in range(rank):
        stage = f"(SELECT *, {' + '.join(f'd{k} * q{k}_{j}' for k in range(j, rank))} AS w{j} FROM {stage})"
    # z = x / h - 1
    cs = [" + ".join(f"{math.comb(j, i) * (-1) ** (j - i)} * w{j}" for j in range(i, rank)) for i in range(rank)]
    out.append(f"o AS (SELECT series_id, n, {', '.join(f'({c}) / pow((n - 1) / 2.0, {i}) AS c{i}' for i, c in enumerate(cs))} FROM {stage})")
    return ", ".join(out)


def uniform_sql(seed: int, *keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r})"


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(2 * seed, *keys)})) * cos({2 * math.pi!r} * {uniform_sql(2 * seed + 1, *keys)}))"


def curve_sql(name: str, n: int | None = None, cte: str = "cu") -> str:
    size = G.CURVES[name][0] if n is None else n
    return f"{cte} AS (SELECT '{name}' AS series_id, i AS x, {size}::BIGINT AS n, {_SQL_CURVES[name]} AS y FROM (SELECT i, i::DOUBLE AS t FROM range(0, {size}) r(i)))"


_SQL_CURVES = {
    "exponential1": "0.0000005 * t * t", "exponential2": "1.2 * t + 0.1 * exp(0.011 * t)", "exponential2_shifted": "30 + 0.01 * t + 0.1 * exp(0.011 * t)",
    "transcendental1": "0.2 * sin(0.005 * t) + 2.12 * cos(0.005 * t)", "transcendental2": "21.5 * sin(0.1 * t) - 12.3 * cos(0.1 * t)",
    "transcendental3": "-7.22 * cos(0.015 * t) - 0.54 * sin(0.015 * t) + 1.9 * cos(0.015 * t)", "combined1": "30 + 0.05 * t + 14 * sin(0.002 * t) + 17.5 * cos(0.01 * t)",
    "lab_periodic": "7.8 * cos(0.05 * t) + 9.5 * sin(0.05 * t)", "notebook_quadratic": "20 + 0.5 * t + 0.05 * t * t", "notebook_sine": "2.2 * sin(0.01 * t)",
}


def rounded(digits: int, **cols: Column) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in cols.items()]


def coefficients(df: DataFrame, rank: int, digits: int = 6) -> DataFrame:
    return lsm.fit(df, rank).select("series_id", *[F.round(F.col("coeffs")[k], digits).alias(f"c{k}") for k in range(rank)])


# ---------------------------------------------------------------- least squares
@query(f"WITH {EV}, {sums('ev')} SELECT series_id, round(l0, 6) AS c0, round(l1, 8) AS c1 FROM q")
def lsm_linear(spark: SparkSession, d: str) -> DataFrame:
    c = lsm.fit(S.events(spark, d), 2)
    return c.select("series_id", F.round(F.col("coeffs")[0], 6).alias("c0"), F.round(F.col("coeffs")[1], 8).alias("c1"))


@query(f"WITH {EV}, {sums('ev')} SELECT series_id, round(p0, 6) AS c0, round(p1, 8) AS c1, round(p2, 11) AS c2 FROM q")
def lsm_quadratic(spark: SparkSession, d: str) -> DataFrame:
    c = lsm.fit(S.events(spark, d), 3)
    return c.select("series_id", F.round(F.col("coeffs")[0], 6).alias("c0"), F.round(F.col("coeffs")[1], 8).alias("c1"), F.round(F.col("coeffs")[2], 11).alias("c2"))


@query(f"WITH {OD}, {sums('od')} SELECT series_id, round(k0, 2) AS c0, round(k1, 4) AS c1, round(k2, 7) AS c2, round(k3, 10) AS c3 FROM q")
def lsm_cubic(spark: SparkSession, d: str) -> DataFrame:
    c = lsm.fit(S.orders(spark, d), 4)
    return c.select("series_id", *[F.round(F.col("coeffs")[k], r).alias(f"c{k}") for k, r in enumerate((2, 4, 7, 10))])


@query(f"WITH {OD}, {fitted_sql('od')} SELECT series_id, x, round(g, 3) AS y_fit FROM f")
def lsm_fit_values(spark: SparkSession, d: str) -> DataFrame:
    return lsm.fitted(S.orders(spark, d), 3).select("series_id", "x", F.round("y_fit", 3).alias("y_fit"))


@query(f"WITH {OD}, {sums('od')} SELECT series_id, x, round({QUAD}, 3) AS y_fit FROM (SELECT *, unnest(range(0, (n + ceil(n * 0.5))::BIGINT)) AS x FROM q)")
def lsm_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    fits = lsm.fit(S.orders(spark, d), 3)
    return lsm.extrapolate(fits, F.col("n") + F.ceil(F.col("n") * 0.5)).select("series_id", "x", F.round("y_fit", 3).alias("y_fit"))


@query(f"WITH {EV}, {orthogonal('ev', 7)} SELECT series_id, x, round(g7, 3) AS y_fit FROM u7")
def lsm_high_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degree 6: values, since coefficients of high degrees have no common number of digits."""
    return lsm.fitted(S.events(spark, d), 7).select("series_id", "x", F.round("y_fit", 3).alias("y_fit"))


@query(f"WITH {EV}, {fitted_sql('ev')} SELECT series_id, round(median(y - g), 6) AS median, round(var_pop(y - g), 5) AS variance, round(stddev_pop(y - g), 6) AS deviation FROM f GROUP BY series_id")
def lsm_residual_stats(spark: SparkSession, d: str) -> DataFrame:
    f = lsm.fitted(S.events(spark, d), 3).withColumn("r", F.col("y") - F.col("y_fit"))
    return f.groupBy("series_id").agg(*rounded(6, median=F.median("r")), *rounded(5, variance=F.var_pop("r")), *rounded(6, deviation=F.stddev_pop("r")))


@query(f"WITH {EV}, {fitted_sql('ev')} SELECT series_id, round(1 - sum(pow(y - g, 2)) / (var_pop(y) * count(*)), 8) AS r2 FROM f GROUP BY series_id")
def r2_lab(spark: SparkSession, d: str) -> DataFrame:
    return lsm.fitted(S.events(spark, d), 3).groupBy("series_id").agg(*rounded(8, r2=M.r2_observed("y", "y_fit")))


@query(f"WITH {EV}, {fitted_sql('ev')} SELECT series_id, round(sum(abs(y - g)) / (count(*) + 1), 6) AS delta, round(stddev_pop(y - g), 6) AS deviation FROM f GROUP BY series_id")
def stat_out(spark: SparkSession, d: str) -> DataFrame:
    """Mean deviation of data from its trend, over one more than the samples."""
    f = lsm.fitted(S.events(spark, d), 3)
    return f.groupBy("series_id").agg(*rounded(6, delta=M.lin_div("y", "y_fit") / (F.count("*") + 1), deviation=F.stddev_pop(F.col("y") - F.col("y_fit"))))


@query(f"WITH {EV}, {fitted_sql('ev')} SELECT series_id, round(stddev_pop(y - g) * ceil(any_value(n) * 0.5), 3) AS interval FROM f GROUP BY series_id")
def stat_extrapol(spark: SparkSession, d: str) -> DataFrame:
    """Confidence interval of a forecast: deviation times its length, half the series."""
    f = lsm.fitted(S.events(spark, d), 3)
    return f.groupBy("series_id").agg(*rounded(3, interval=F.stddev_pop(F.col("y") - F.col("y_fit")) * F.ceil(F.max("n") * 0.5)))


# ---------------------------------------------------------------- goodness of fit
def _score(name: str, digits: int, sql: str, **measures) -> None:
    @query(f"WITH {EV}, {fitted_sql('ev')} SELECT series_id, {sql} FROM f GROUP BY series_id", name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lsm.fitted(S.events(spark, d), 3).groupBy("series_id").agg(*rounded(digits, **{k: m() for k, m in measures.items()}))


_score("lin_div", 4, "round(sum(abs(y - g)), 4) AS lin_div", lin_div=lambda: M.lin_div("y", "y_fit"))
_score("rss_tss", 3, "round(sum(pow(y - g, 2)), 3) AS rss, round(var_pop(y) * count(*), 3) AS tss", rss=lambda: M.rss("y", "y_fit"), tss=lambda: M.tss("y"))
_score("rse", 6, "round(sqrt(sum(pow(y - g, 2)) / (count(*) - 2)), 6) AS rse", rse=lambda: M.rse("y", "y_fit"))
_score("r_sq", 2, "round(1 - sum(pow(y - g, 2)) / (var_pop(g) * count(*)), 2) AS r_sq", r_sq=lambda: M.r_sq_fit("y", "y_fit"))
_score("mse", 5, "round(avg(pow(y - g, 2)), 5) AS mse", mse=lambda: M.mse("y", "y_fit"))
_score("mle", 6, "round(avg(abs(y - g)), 6) AS mle", mle=lambda: M.mle("y", "y_fit"))
_score("concord", 8, "round(abs(2 * covar_pop(y, g) / (var_pop(y) + var_pop(g) + pow(median(y) - median(g), 2))), 8) AS concord", concord=lambda: M.concord("y", "y_fit"))
_score("fit_own_variance", 7, "round(var_pop(g), 7) AS own_variance", own_variance=lambda: M.own_variance("y_fit"))


@query(f"""WITH {EV}, {fitted_sql('ev')} SELECT series_id, round(sqrt(sum(pow(y - g, 2)) / (count(*) - 2)), 6) AS rse, round(avg(pow(y - g, 2)), 5) AS mse, round(stddev_pop(y - g), 6) AS sigma,
  round(stddev_pop(g), 6) AS std, round(1 - sum(pow(y - g, 2)) / (var_pop(g) * count(*)), 2) AS r_sq, round(corr(y, g), 6) AS corr,
  round(abs(2 * covar_pop(y, g) / (var_pop(y) + var_pop(g) + pow(median(y) - median(g), 2))), 8) AS ccord FROM f GROUP BY series_id""")
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = FT.Model(S.events(spark, d))
    m.poly_fit(3, update=True)
    digits = {"rse": 6, "mse": 5, "sigma": 6, "std": 6, "r_sq": 2, "corr": 6, "ccord": 8}
    return m.metrics().select("series_id", *[F.round(k, r).alias(k) for k, r in digits.items()])


@query(f"WITH {EV} SELECT series_id, round((max_by(y, x) - min_by(y, x)) / (count(*) - 1), 8) AS growth FROM ev GROUP BY series_id")
def growth(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).groupBy("series_id").agg(*rounded(8, growth=M.growth()))


@query("""WITH v AS (SELECT l_partkey::VARCHAR AS series_id, row_number() OVER w - 1 AS x, l_quantity AS y, first_value(l_quantity) OVER w AS o FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice)),
p AS (SELECT *, sum((y = o)::INT) OVER (PARTITION BY series_id ORDER BY x) AS passes, sum((y <> o)::INT) OVER (PARTITION BY series_id ORDER BY x) AS others FROM v)
SELECT series_id, (min(others - 1) FILTER (y <> o AND passes = 2))::BIGINT AS period FROM p GROUP BY series_id""")
def period(spark: SparkSession, d: str) -> DataFrame:
    return C.period(S.part_quantities(spark, d))


@query(f"WITH {EV} SELECT series_id, x, round(d, 6) AS diff FROM (SELECT series_id, x, lead(y) OVER (PARTITION BY series_id ORDER BY x) - y AS d FROM ev) WHERE d IS NOT NULL")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    return C.first_difference(S.events(spark, d)).select("series_id", "x", F.round("diff", 6).alias("diff"))


_STATS = "round(abs(median(a) - median(b)), 6) AS d_med, round({}, 6) AS d_var, round(stddev_pop(b), 6) AS std_div, round(avg(pow(a - b, 2)), 5) AS mse, round(sum(abs(a - b)), 4) AS lin_div, round(abs(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + pow(median(a) - median(b), 2))), 8) AS conc"
_LONG = "g AS (SELECT series_id, 'linear' AS label, y AS a, g1 AS b FROM f UNION ALL SELECT series_id, 'quadratic', y, g FROM f{})"


def _statistics(spark: SparkSession, d: str, by_pair: bool) -> DataFrame:
    ev = S.events(spark, d)
    line = lsm.fit(ev, 2).select("series_id", F.col("coeffs").alias("line"))
    both = lsm.fitted(ev, 3).withColumnRenamed("y_fit", "quadratic").join(line, "series_id").withColumn("linear", lsm.evaluate("line", F.col("x").cast("double")))
    digits = {"d_med": 6, "d_var": 6, "std_div": 6, "mse": 5, "lin_div": 4, "conc": 8}
    return M.statistics(both, "y", ["linear", "quadratic"], by_pair).select("series_id", F.when(F.col("label") == "data", "data").otherwise(F.col("label")).alias("label"), *[F.round(k, r).alias(k) for k, r in digits.items()])


@query(f"WITH {EV}, {fitted_sql('ev')}, {_LONG.format(' UNION ALL SELECT series_id, ' + chr(39) + 'data' + chr(39) + ', y, y FROM f')} SELECT series_id, label, {_STATS.format('var_pop(b)')} FROM g GROUP BY ALL")
def statistics_table(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d, False)


@query(f"WITH {EV}, {fitted_sql('ev')}, {_LONG.format('')} SELECT series_id, label, {_STATS.format('abs(median(a) - var_pop(b))')} FROM g GROUP BY ALL")
def statistics_n_table(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d, True)


@query("""WITH e AS (SELECT event_type AS series_id, min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events GROUP BY 1)
SELECT series_id, least(floor((value - lo) / w), 19)::INTEGER AS bin, round(lo + least(floor((value - lo) / w), 19) * w, 6) AS low, count(*) AS n FROM events JOIN e ON event_type = series_id GROUP BY ALL""")
def histogram20(spark: SparkSession, d: str) -> DataFrame:
    e = S.read_table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("y"))
    return M.histogram(e, 20).withColumn("low", F.round("low", 6))


@query(f"WITH {EV} SELECT series_id, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(var_pop(y), 5) AS variance, round(stddev_pop(y), 6) AS deviation, round(max(y) - min(y), 6) AS spread FROM ev GROUP BY series_id")
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    e = S.read_table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("y"))
    return e.groupBy("series_id").agg(*rounded(6, mean=F.avg("y"), median=F.median("y")), *rounded(5, variance=F.var_pop("y")), *rounded(6, deviation=F.stddev_pop("y"), spread=F.max("y") - F.min("y")))


# ---------------------------------------------------------------- rows, windows, filters
@query(f"WITH {OD} SELECT series_id, x, round(y, 2) AS y FROM od WHERE x < 161")
def positional_slice(spark: SparkSession, d: str) -> DataFrame:
    return S.head(S.orders(spark, d), 161).select("series_id", "x", F.round("y", 2).alias("y"))


@query(f"WITH {OD} SELECT series_id, n - 1 - x AS x, round(y, 2) AS y FROM od")
def reverse_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.reverse(S.orders(spark, d)).select("series_id", "x", F.round("y", 2).alias("y"))


@query(f"WITH {EV} SELECT series_id, arg_min(x, (y, x)) AS x_min, round(min(y), 6) AS y_min, arg_min(x, (-y, x)) AS x_max, round(max(y), 6) AS y_max FROM ev GROUP BY series_id")
def extremum_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first least and the first greatest sample of each series."""
    return S.events(spark, d).groupBy("series_id").agg(F.min(F.struct("y", "x"))["x"].alias("x_min"), *rounded(6, y_min=F.min("y")), F.min(F.struct((-F.col("y")).alias("v"), "x"))["x"].alias("x_max"), *rounded(6, y_max=F.max("y")))


@query(f"""WITH {EV}, m AS (SELECT series_id, x, y, list(y) OVER (PARTITION BY series_id ORDER BY x ROWS 4 PRECEDING) AS w FROM ev)
SELECT series_id, x, round(CASE WHEN x < 5 THEN y ELSE list_median(w) END, 6) AS y_clean FROM m""".replace("list_median(w)", "list_aggregate(w, 'median')"))
def sliding_median(spark: SparkSession, d: str) -> DataFrame:
    return C.sliding_median(S.events(spark, d)).select("series_id", "x", F.round("y_clean", 6).alias("y_clean"))


@query(f"WITH {EV}, m AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY x)) SELECT series_id, x, round(y, 6) AS y FROM m WHERE y < a AND y < b")
def local_minima(spark: SparkSession, d: str) -> DataFrame:
    return C.local_minima(S.events(spark, d)).select("series_id", "x", F.round("y", 6).alias("y"))


@query(f"""WITH {EV}, t AS (SELECT series_id, unnest(range(0, floor((n - 1) / 2.5)::BIGINT + 1)) AS place FROM (SELECT DISTINCT series_id, n FROM ev))
SELECT t.series_id, place, place * 2.5::DOUBLE AS at, round(CASE WHEN floor(place * 2.5) = place * 2.5 THEN a.y ELSE a.y + (b.y - a.y) * (place * 2.5 - a.x) END, 6) AS y
FROM t JOIN ev a ON a.series_id = t.series_id AND a.x = floor(place * 2.5)::BIGINT LEFT JOIN ev b ON b.series_id = t.series_id AND b.x = a.x + 1""")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    r = C.resample(S.events(spark, d), 0.4)
    return r.where("y IS NOT NULL").select("series_id", "place", "at", F.round("y", 6).alias("y"))


@query(f"""WITH RECURSIVE {EV}, r AS (
  SELECT series_id, x, y, 2 * y AS o, y AS first, NULL::DOUBLE AS ahead, NULL::DOUBLE AS speed, NULL::DOUBLE AS al, NULL::DOUBLE AS be FROM ev WHERE x = 0
  UNION ALL
  SELECT e.series_id, e.x, e.y, CASE WHEN e.x = 1 THEN e.y ELSE r.ahead + r.al * (e.y - r.ahead) END, r.first,
    CASE WHEN e.x = 1 THEN e.y + (e.y - r.first) ELSE r.ahead + r.al * (e.y - r.ahead) + r.speed + r.be * (e.y - r.ahead) END,
    CASE WHEN e.x = 1 THEN e.y - r.first ELSE r.speed + r.be * (e.y - r.ahead) END,
    2.0 * (2 * e.x - 1) / (e.x * (e.x + 1)), 6.0 / (e.x * (e.x + 1))
  FROM r JOIN ev e ON e.series_id = r.series_id AND e.x = r.x + 1)
SELECT series_id, x, round(o, 4) AS y_clean FROM r""")
def alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    return C.alpha_beta(S.events(spark, d)).select("series_id", "x", F.round("y_clean", 4).alias("y_clean"))


_FOLD = """WITH RECURSIVE {pre}, k AS (SELECT series_id, list(y ORDER BY x) AS w, stddev_pop(y) AS ref FROM ev WHERE x < 5 GROUP BY series_id), r AS (
  SELECT series_id, 3::BIGINT AS x, ref, [w[1], w[1], w[2], w[3], w[4]] AS w FROM k
  UNION ALL
  SELECT e.series_id, e.x, r.ref, [r.w[2], r.w[3], r.w[4], r.w[5], CASE WHEN {test} THEN {value} ELSE e.y END]
  FROM r JOIN ev e ON e.series_id = r.series_id AND e.x = r.x + 1{more})
SELECT series_id, x, round(y, 6) AS y_clean FROM ev WHERE x < 4 UNION ALL SELECT series_id, x, round(w[5], 6) FROM r WHERE x > 3"""
_LAST5 = "[r.w[2], r.w[3], r.w[4], r.w[5], e.y]"


@query(_FOLD.format(pre=EV, test=f"list_aggregate({_LAST5}, 'stddev_pop') > 1.6 * r.ref", value=f"list_aggregate({_LAST5}, 'median')", more=""))
def detect_medium(spark: SparkSession, d: str) -> DataFrame:
    return C.detect_medium(S.events(spark, d)).select("series_id", "x", F.round("y_clean", 6).alias("y_clean"))


@query(_FOLD.format(pre=f"{EV}, {sums('ev')}", test=f"7 * sqrt(5) * list_aggregate({_LAST5}, 'stddev_pop') > sqrt(e.n)", value="p0 + p1 * e.x + p2 * e.x * e.x", more=" JOIN q ON q.series_id = e.series_id"))
def detect_mnk(spark: SparkSession, d: str) -> DataFrame:
    return C.detect_mnk(S.events(spark, d)).select("series_id", "x", F.round("y_clean", 6).alias("y_clean"))


@query(f"""WITH {OD}, tr AS (SELECT series_id, x, count(*) OVER () AS n, y FROM od WHERE x < floor(n * 0.8)), {sums('tr')}
SELECT series_id, split, round(sqrt(sum(pow(y - g, 2)) / (count(*) - 2)), 3) AS rse, round(avg(abs(y - g)), 3) AS mle FROM
(SELECT od.series_id, CASE WHEN x < floor(od.n * 0.8) THEN 'train' ELSE 'test' END AS split, y, {QUAD} AS g FROM od JOIN q USING (series_id)) GROUP BY ALL""")
def train_test_split_metrics(spark: SparkSession, d: str) -> DataFrame:
    od = S.split(S.orders(spark, d))
    train = od.where("split = 'train'").withColumn("n", F.floor(F.col("n") * F.lit(0.8)).cast("long")).drop("split")
    told = od.join(lsm.fit(train, 3).select("series_id", "coeffs"), "series_id").withColumn("y_fit", lsm.evaluate("coeffs", F.col("x").cast("double")))
    return told.groupBy("series_id", "split").agg(*rounded(3, rse=M.rse("y", "y_fit"), mle=M.mle("y", "y_fit")))


# ---------------------------------------------------------------- balance
def _significant(c: Column, digits: int = 6) -> Column:
    """Scientific notation with so many digits, as text, so that small and large parameters compare alike."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits - 1}e", c))


def _sig(sql: str, digits: int = 6) -> str:
    return f"CASE WHEN {sql} IS NOT NULL THEN printf('%.{digits - 1}e', {sql}) END"


def _balanced(name: str, form: str, rank: int, discrete: bool, source: str, sql: dict[str, str]) -> None:
    src = {"ev": EV, "li": LI, "od": OD}[source]
    read = {"ev": S.events, "li": S.lineitem, "od": S.orders}[source]
    base = {2: "l", 3: "p", 4: "k"}[rank]
    p = B.CLOSED[form][1]
    cs = ", ".join(f"{base}{k}{f' * {p[k]!r}' if discrete else ''} AS c{k}" for k in range(rank))
    text = f"WITH {src}, {sums(source)}, c AS (SELECT series_id, {cs} FROM q), r AS (SELECT series_id, c0"
    text += ", c1" + (", c2" if rank > 2 else "") + (", c3" if rank > 3 else "") + " FROM c)"
    stage = "r"
    for i, (k, expr) in enumerate(sql.items()):
        text += f", r{i} AS (SELECT *, {expr} AS {k} FROM {stage})"
        stage = f"r{i}"
    names = [k for k in sql if not k.startswith("_")]
    text += f" SELECT series_id, {', '.join(f'{_sig(k)} AS {k}' for k in names)} FROM {stage}"

    @query(text, name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        fits = lsm.fit(read(spark, d), rank)
        a = B.closed_form(form, [F.col("coeffs")[k] for k in range(rank)], discrete)
        return fits.select("series_id", *[_significant(a[k]).alias(k) for k in names])


_EXP = {"a3": "3 * c3 / c2", "a2": "2 * c2 / (a3 * a3)", "a1": "c1 - a2 * a3", "a0": "c0 - a2"}
_ONE = {"a1": "CASE WHEN -2 * c2 / c0 > 0 THEN sqrt(-2 * c2 / c0) END", "a0": "c1 / a1", "a2": "c0"}
_SQ = {"a3": "CASE WHEN -6 * c3 / c1 > 0 THEN sqrt(-6 * c3 / c1) END", "a2": "c1 / a3", "a1": "c2", "a0": "c0"}
_LIN = {"a2": "CASE WHEN 2 * c2 > 0 THEN sqrt(2 * c2) END", "a1": "c1 - a2", "a0": "c0 - 1", "a2_other": "-a2", "a1_other": "c1 + a2"}
_balanced("dsb_exp_raw", "exp", 4, False, "li", _EXP)
_balanced("dsb_exp_discrete", "exp", 4, True, "li", _EXP)
_balanced("dsb_exp_raw_events", "exp", 4, False, "ev", _EXP)
_balanced("dsb_sincos_raw", "sincos_one", 3, False, "ev", _ONE)
_balanced("dsb_sincos_discrete", "sincos_one", 3, True, "ev", _ONE)
_balanced("dsb_exp_const", "exp_const", 2, False, "ev", {"a0": "c0 - 1", "a1": "c1"})
_balanced("dsb_exp_linear", "exp_linear", 3, False, "ev", _LIN)
_balanced("dsb_sin_square_raw", "sin_square", 4, False, "od", _SQ)
_balanced("dsb_sin_square_discrete", "sin_square", 4, True, "od", _SQ)


@query(f"WITH {OD}, {sums('od')} SELECT series_id, {_sig('p0')} AS a0, {_sig('p1 / sqrt(abs(p2 / p0))')} AS b0, {_sig('sqrt(abs(p2 / p0))')} AS w FROM q")
def mnk_nl(spark: SparkSession, d: str) -> DataFrame:
    a = B.cosine_sine([F.col("coeffs")[k] for k in range(3)])
    return lsm.fit(S.orders(spark, d), 3).select("series_id", *[_significant(v).alias(k) for k, v in a.items()])


@query(f"""WITH {OD}, {sums('od')}, w AS (SELECT *, sqrt(abs(p2 / p0)) AS w, unnest(range(0, (n + ceil(n * 0.5))::BIGINT)) AS x FROM q)
SELECT series_id, x, round(p0 * cos(w * x) + p1 / w * sin(w * x), 2) AS y_fit, round({QUAD}, 3) AS y_poly FROM w""")
def mnk_nl_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    fits = lsm.fit(S.orders(spark, d), 3)
    a = B.cosine_sine([F.col("coeffs")[k] for k in range(3)])
    wide = fits.select("series_id", "coeffs", *[v.alias(k) for k, v in a.items()], F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.ceil(F.col("n") * 0.5) - 1)).alias("x"))
    at = F.col("w") * F.col("x")
    return wide.select("series_id", "x", F.round(F.col("a0") * F.cos(at) + F.col("b0") * F.sin(at), 2).alias("y_fit"), F.round(lsm.evaluate("coeffs", F.col("x").cast("double")), 3).alias("y_poly"))


@query(f"""WITH {LI}, {sums('li')}, e AS (SELECT *, 3 * k3 / k2 AS a3 FROM q), g AS (SELECT *, 2 * k2 / (a3 * a3) AS a2 FROM e)
SELECT v.series_id, v.x, CASE WHEN a3 * x < 600 THEN {_sig('(k0 - a2 + (k1 - a2 * a3) * x + a2 * exp(a3 * x))')} END AS y_fit FROM li v JOIN g USING (series_id)""")
def dsb_exp_fit_values(spark: SparkSession, d: str) -> DataFrame:
    li = S.lineitem(spark, d)
    a = B.closed_form("exp", [F.col("coeffs")[k] for k in range(4)])
    f = Formula(B.CLOSED["exp"][0])
    rows = li.join(lsm.fit(li, 4).select("series_id", "coeffs"), "series_id")
    y = f.column(F.col("x").cast("double"), a)
    return rows.select("series_id", "x", F.when(a["a3"] * F.col("x") < 600, _significant(y)).alias("y_fit"))


# ---------------------------------------------------------------- generators
def _generator(curve: str, sql: str) -> None:
    digits = 4 if curve.startswith("exponential2") else 8

    @query(f"SELECT '{curve}' AS series_id, i AS x, round({sql}, {digits}) AS y FROM (SELECT i, i::DOUBLE AS t FROM range(0, {G.CURVES[curve][0]}) r(i))", f"gen_{curve}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.curve(spark, curve).select("series_id", "x", F.round("y", digits).alias("y"))


for _name, _sql in _SQL_CURVES.items():
    _generator(_name, _sql)


@query("""SELECT k, round(CASE k % 4 WHEN 0 THEN 2.12 WHEN 1 THEN 0.2 WHEN 2 THEN -2.12 ELSE -0.2 END * pow(0.5, k) / factorial(k::INTEGER), 10) AS coefficient FROM range(0, 6) r(k)""")
def spectrum_values(spark: SparkSession, d: str) -> DataFrame:
    """Power series of 0.2 sin(0.5 t) + 2.12 cos(0.5 t)."""
    c = FT.spectrum("a0*sin(a1*t) + a2*cos(a1*t)", [0.2, 0.5, 2.12], 6)
    return spark.createDataFrame(list(enumerate(c)), "k long, coefficient double").select("k", F.round("coefficient", 10).alias("coefficient"))


# ---------------------------------------------------------------- ranks, regressions, sweeps
@query(f"""WITH {OD}, {sums('od')}, v AS (SELECT od.series_id, y, unnest([2, 3, 4]) AS rank, unnest([{LINE}, {QUAD}, k0 + k1*x + k2*x*x + k3*x*x*x]) AS g FROM od JOIN q USING (series_id)),
m AS (SELECT series_id, rank, abs(2 * covar_pop(y, g) / (var_pop(y) + var_pop(g) + pow(median(y) - median(g), 2))) AS c FROM v GROUP BY ALL)
SELECT series_id, max_by(rank, c)::INTEGER AS rank, round(max(c), 6) AS concord FROM m GROUP BY series_id""")
def best_rank(spark: SparkSession, d: str) -> DataFrame:
    r = lsm.best_rank(S.orders(spark, d), range(2, 5))
    return r.groupBy("series_id").agg(F.max_by("rank", "concord").alias("rank"), *rounded(6, concord=F.max("concord")))


@query(f"""WITH {EV}, u AS (SELECT series_id, y, lead(y) OVER (PARTITION BY series_id ORDER BY x) AS z FROM ev), a AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS w FROM u WHERE z IS NOT NULL GROUP BY 1),
c AS (SELECT series_id, m, w, (y - m) / w AS v, z FROM u JOIN a USING (series_id) WHERE z IS NOT NULL),
s AS (SELECT series_id, any_value(m) AS m, any_value(w) AS w, count(*)::DOUBLE AS s0, sum(v) AS s1, sum(v*v) AS s2, sum(v*v*v) AS s3, sum(v*v*v*v) AS s4, sum(z) AS t0, sum(v*z) AS t1, sum(v*v*z) AS t2 FROM c GROUP BY 1),
e AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d FROM s),
b AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / d AS b0, (s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / d AS b1, (s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / d AS b2 FROM e)
SELECT series_id, round(b0 - b1*m/w + b2*m*m/(w*w), 5) AS q0, round(b1/w - 2*b2*m/(w*w), 6) AS q1, round(b2/(w*w), 8) AS q2 FROM b""")
def metric_regression(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic regression of each value on the one before it."""
    from pyspark.sql import Window

    pairs = S.events(spark, d).withColumn("z", F.lead("y").over(Window.partitionBy("series_id").orderBy("x"))).where("z IS NOT NULL")
    return lsm.regression(pairs, "series_id", "y", "z").select("series_id", F.round("q0", 5).alias("q0"), F.round("q1", 6).alias("q1"), F.round("q2", 8).alias("q2"))


def _told(series: DataFrame, fits: DataFrame, expression: str, digits: int = 6) -> DataFrame:
    """series_id, error, rse, r_sq; a series without a fit has its error and nulls."""
    told = FT.with_fit(series, fits.where("error IS NULL"), expression).groupBy("series_id").agg(*rounded(digits, rse=M.rse("y", "y_fit"), r_sq=M.r_sq_fit("y", "y_fit")))
    return fits.select("series_id", "error").join(told, "series_id", "left")


def _found(fits: DataFrame, expression: str, main_var: str = "t", digits: int = 4) -> DataFrame:
    """series_id, error and the parameters by name, in so many significant digits."""
    names = Formula(expression, main_var).params
    return fits.select("series_id", "error", *[_significant(F.col("params")[i], digits).alias(p) for i, p in enumerate(names)])


def _truth(name: str, digits: int = 4, **params: float) -> str:
    """Rows of _found for a series that is made from the formula itself: its parameters come out."""
    return f"SELECT '{name}' AS series_id, NULL::VARCHAR AS error, " + ", ".join(f"{_sig(f'{v!r}::DOUBLE', digits)} AS {k}" for k, v in params.items())


def _taylor(form: str, params: list[float], rank: int) -> str:
    """The power series of a closed form, cut after `rank` terms, as a formula: a polynomial fits it exactly, and the balance is exact."""
    c = Formula(B.CLOSED[form][0]).series(params, rank)
    return " + ".join(f"{v!r} * t**{k}" for k, v in enumerate(c.tolist())).replace("+ -", "- ")


@query(f"WITH {curve_sql('transcendental1')} SELECT series_id, NULL::VARCHAR AS error, round(sqrt(sum(pow(y - (0.2 * sin(0.005 * x) + 2.12 * cos(0.005 * x)), 2)) / (count(*) - 2)), 6) AS rse, 1.0::DOUBLE AS r_sq FROM cu GROUP BY series_id")
def dsb_numeric_fit(spark: SparkSession, d: str) -> DataFrame:
    """The noise-free curve is found again, so nothing is left over."""
    s, e = G.curve(spark, "transcendental1"), B.CLOSED["sincos_one"][0]
    return _told(s, FT.dsb_fit(s, e), e)


@query(_truth("transcendental1", a0=0.2, a1=0.005, a2=2.12))
def dsb_long_fit(spark: SparkSession, d: str) -> DataFrame:
    """The same curve, polished without bringing its samples into one task."""
    e = B.CLOSED["sincos_one"][0]
    return _found(FT.dsb_fit(G.curve(spark, "transcendental1"), e, long_series=True), e)


@query(f"""WITH {curve_sql('exponential2', 1000)}, {orthogonal('cu', 4)}, c AS (SELECT series_id, 2 * c0 AS e0, 2 * c1 AS e1, c2 / 2 AS e2, c3 / 6 AS e3 FROM o), a AS (SELECT *, 3 * e3 / e2 AS a3 FROM c),
b AS (SELECT *, 2 * e2 / (a3 * a3) AS a2 FROM a) SELECT series_id, NULL::VARCHAR AS error, {_sig('(e0 - a2)', 4)} AS a0, {_sig('(e1 - a2 * a3)', 4)} AS a1, {_sig('a2', 4)} AS a2, {_sig('a3', 4)} AS a3 FROM b""")
def dsb_plain_fit(spark: SparkSession, d: str) -> DataFrame:
    s, e = G.curve(spark, "exponential2", 1000), B.CLOSED["exp"][0]
    return _found(FT.dsb_fit(s, e, numeric=False), e)


@query(_truth("wave", a0=9.5, a1=0.05, a2=7.8))
def nonline_lm(spark: SparkSession, d: str) -> DataFrame:
    """More equations than parameters: from the first ones' solution, least squares of all; the series is the formula's own up to its rank."""
    s = G.from_formula(spark, "wave", _taylor("sincos_one", [9.5, 0.05, 7.8], 6), 40)
    return _found(FT.nonline_fit(s, B.CLOSED["sincos_one"][0], rank=6), B.CLOSED["sincos_one"][0])


@query(_truth("wave", a0=9.5, a1=0.05, a2=7.8))
def dsbi(spark: SparkSession, d: str) -> DataFrame:
    s = G.from_formula(spark, "wave", _taylor("sincos_one", [9.5, 0.05, 7.8], 7), 40)
    return _found(FT.dsbi_fit(s, B.CLOSED["sincos_one"][0], rank=7), B.CLOSED["sincos_one"][0])


_MANUAL = 1460


@query(f"""WITH {curve_sql('transcendental1', _MANUAL)}, no AS (SELECT series_id, x, n, y + {normal_sql(1, 'series_id', 'x')} * 1.0 AS y FROM cu), {orthogonal('no', 7)}, w AS (SELECT *, sqrt(-2 * c2 / c0) AS a1 FROM o)
SELECT series_id, {_sig('(c1 / a1)', 4)} AS a0, {_sig('a1', 4)} AS a1, {_sig('c0', 4)} AS a2 FROM w""")
def manual_balance_first(spark: SparkSession, d: str) -> DataFrame:
    """The first equations of a balance of rank 6 against a polynomial of degree 6."""
    r = X.manual_balance(G.add_noise(G.curve(spark, "transcendental1", _MANUAL), 0.0, 1.0), B.CLOSED["sincos_one"][0], 6)
    return r.where("stage = 'first'").select("series_id", *[_significant(F.col("params")[i], 4).alias(f"a{i}") for i in range(3)])


@query(_truth("wave", a0=9.5, a1=0.05, a2=7.8).replace("NULL::VARCHAR AS error, ", "'after' AS stage, NULL::VARCHAR AS error, "))
def manual_balance(spark: SparkSession, d: str) -> DataFrame:
    """All equations of a balance of rank 6; the series is the formula's own up to degree 6."""
    s = G.from_formula(spark, "wave", _taylor("sincos_one", [9.5, 0.05, 7.8], 7), 40)
    r = X.manual_balance(s, B.CLOSED["sincos_one"][0], 6).where("stage = 'after'")
    return r.select("series_id", "stage", "error", *[_significant(F.col("params")[i], 4).alias(f"a{i}") for i in range(3)])


@query("SELECT 'transcendental1' AS series_id, 'the balance has no real solution' AS error, NULL::VARCHAR AS a0, NULL::VARCHAR AS a1, NULL::VARCHAR AS a2")
def nonline_unsolvable(spark: SparkSession, d: str) -> DataFrame:
    """Over more than a period the polynomial's curvature has the wrong sign; the error is told, and nothing else."""
    s = G.curve(spark, "transcendental1", 1000).withColumn("y", F.lit(1.0) + F.pow(F.col("x") / 100.0, 2))
    return _found(FT.nonline_fit(s, B.CLOSED["sincos_one"][0]), B.CLOSED["sincos_one"][0])


@query(_truth("exponential2", c0=0.0, c1=1.2, c2=0.1, c3=0.011).replace(_sig("0.0::DOUBLE", 4) + " AS c0, ", ""))
def iterative_exponent(spark: SparkSession, d: str) -> DataFrame:
    """c0 is 0 but for rounding, and left out."""
    s, e = G.curve(spark, "exponential2", 600), "c0 + c1*x + c2*exp(c3*x)"
    return _found(FT.iterative_fit(s, e, [1, 0.01, 1, 0.005], "x"), e, "x").drop("c0")


@query()
def nonline_raised(spark: SparkSession, d: str) -> DataFrame:
    s, e = G.curve(spark, "exponential2", 600), B.CLOSED["exp"][0]
    return _told(s, FT.nonline_fit(s, e, raise_rank=True), e)


@query(_truth("exponential2", a=0.1, b=0.011, d=1.2))
def expo_regression(spark: SparkSession, d: str) -> DataFrame:
    """a*exp(b*x) + c + d*x by iteration from a start of one number; c is 0 but for rounding, and left out."""
    s, e, b = G.curve(spark, "exponential2", 600), "a*exp(b*x) + c + d*x", 10
    return _found(FT.iterative_fit(s, e, [b / 10, b / 1000, b + 10, b / 10], "x"), e, "x").drop("c")


def _high(name: str, form: str, rank: int, true: list[float], sql: dict[str, str]) -> None:
    text = _taylor(form, true, rank)
    src = f"cu AS (SELECT '{form}' AS series_id, i AS x, 100::BIGINT AS n, {text.replace('**', '^')} AS y FROM (SELECT i, i::DOUBLE AS t FROM range(0, 100) r(i)))"
    stage = "o"
    for k, expr in sql.items():
        stage = f"(SELECT *, {expr} AS {k} FROM {stage})"

    @query(f"WITH {src}, {orthogonal('cu', rank)} SELECT series_id, {', '.join(f'{_sig(k, 4)} AS {k}' for k in sorted(sql))} FROM {stage}", name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        fits = lsm.fit(G.from_formula(spark, form, text, 100), rank)
        a = B.closed_form(form, [F.col("coeffs")[k] for k in range(rank)], False)
        return fits.select("series_id", *[_significant(v, 4).alias(k) for k, v in a.items()])


_high("dsb_cos_cube", "cos_cube", 5, [3.0, 0.5, 0.002, 4.0, 0.03], {"a4": "sqrt(-12 * c4 / c2)", "a3": "-2 * c2 / (a4 * a4)", "a2": "c3", "a1": "c1", "a0": "c0 - a3"})
_high("dsb_sincos_full", "sincos", 6, [3.0, 0.5, 2.0, 0.04, 5.0, 0.03], {"a5": "sqrt(-12 * c4 / c2)", "a3": "sqrt(-20 * c5 / c3)", "a4": "-2 * c2 / (a5 * a5)", "a2": "-6 * c3 / (a3 * a3 * a3)", "a1": "c1 - a2 * a3", "a0": "c0 - a4"})


@query(f"""WITH {curve_sql('exponential2', 300)}, {sums('cu')}, br AS (SELECT *, sqrt(2 * p2) AS a2 FROM q), rs AS (SELECT v.series_id, sum(pow(y - (p0 - 1 + (p1 - a2) * x + exp(a2 * x)), 2)) AS one, sum(pow(y - (p0 - 1 + (p1 + a2) * x + exp(-a2 * x)), 2)) AS other, any_value(p0) AS p0, any_value(p1) AS p1, any_value(a2) AS a2 FROM cu v JOIN br USING (series_id) GROUP BY 1)
SELECT series_id, {_sig('(p0 - 1)')} AS a0, {_sig('(p1 - CASE WHEN other < one THEN -a2 ELSE a2 END)')} AS a1, {_sig('(CASE WHEN other < one THEN -a2 ELSE a2 END)')} AS a2, {_sig('least(one, other)')} AS rss FROM rs""")
def dsb_exp_linear_branch(spark: SparkSession, d: str) -> DataFrame:
    """The branch that is nearer to the series."""
    s = G.curve(spark, "exponential2", 300)
    return B.nearer_branch(s, lsm.fit(s, 3)).select("series_id", *[_significant(F.col(c)).alias(c) for c in ("a0", "a1", "a2", "rss")])


def _rank_scores(src: str, ranks: range) -> str:
    """m: series_id, rank, rse, r_sq of each rank."""
    each = " UNION ALL ".join(f"SELECT series_id, {r} AS rank, y, g{r} AS g FROM u{ranks[-1]}" for r in ranks)
    return f"{orthogonal(src, ranks[-1])}, m AS (SELECT series_id, rank, sqrt(sum(pow(y - g, 2)) / (count(*) - 2)) AS rse, 1 - sum(pow(y - g, 2)) / (var_pop(g) * count(*)) AS r_sq FROM ({each}) GROUP BY ALL)"


@query(f"""WITH {OD}, {_rank_scores('od', range(2, 9))}, c AS (SELECT *, abs(lead(rse) OVER w - rse) * abs(lead(r_sq) OVER w - r_sq) AS change FROM m WINDOW w AS (PARTITION BY series_id ORDER BY rank))
SELECT series_id, coalesce(min(rank) FILTER (change < 1e-6), 2)::INTEGER AS rank FROM c GROUP BY series_id""")
def settled_rank(spark: SparkSession, d: str) -> DataFrame:
    return lsm.settled_rank(lsm.best_rank(S.orders(spark, d), range(2, 9)), 2)


def _scores(df: DataFrame) -> DataFrame:
    return df.select("series_id", "error", *[F.round(c, 6).alias(c) for c in ("train_rse", "train_r_sq", "test_rse", "test_r_sq")])


_SWEEP_EXP, _SWEEP_WAVE, _SWEEP_FULL = B.CLOSED["exp"][0], B.CLOSED["sincos_one"][0], B.CLOSED["sincos"][0]


def _sweep(name: str, expression: str, text: str, grid: list[dict]) -> None:
    @query(name=name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _scores(X.perform(X.cells(spark, text, grid), expression))


_sweep("sweep_ratio_exponential", _SWEEP_EXP, G.CURVES["exponential1"][1], [{"label": k / 4, "size": 10_000, "test_ratio": k / 4} for k in range(2, 8)])
_sweep("sweep_size_exponential", _SWEEP_EXP, G.CURVES["exponential1"][1], [{"label": k, "size": k} for k in range(1000, 10_000, 500)])
_sweep("sweep_ratio_wave", _SWEEP_WAVE, G.CURVES["transcendental1"][1], [{"label": k / 2, "size": 1000, "test_ratio": k / 2} for k in range(1, 10)])
_sweep("sweep_size_wave", _SWEEP_WAVE, G.CURVES["transcendental1"][1], [{"label": k, "size": k, "test_ratio": 2} for k in range(400, 3000, 100)])
_sweep("sweep_size_short_wave", _SWEEP_WAVE, G.CURVES["transcendental2"][1], [{"label": k, "size": k, "test_ratio": 2} for k in range(20, 200, 10)])
GROWTH = [{"label": k / 100, "size": 500, "g": k / 100} for k in range(1, 12)]
GROWTH_CURVE = "30 + 0.01*t + g*exp(0.011*t)"
_sweep("sweep_growth", _SWEEP_EXP, GROWTH_CURVE, GROWTH)


@query()
def sweep_growth_regression(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic regression of the scores on the untrained part, each as a share of the largest, on that part's growth."""
    grid = X.cells(spark, GROWTH_CURVE, GROWTH)
    scores = X.perform(grid, _SWEEP_EXP).where("error IS NULL").select("series_id", "test_rse", (-F.col("test_r_sq")).alias("test_miss"))
    rates = grid.where("x >= size").groupBy("series_id").agg(M.growth().alias("rate"))
    long = scores.join(rates, "series_id").select("rate", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("test_rse", "test_miss")])).alias("m")).select("rate", "m.measure", "m.v")
    top = long.groupBy("measure").agg(F.max("v").alias("top"))
    shares = long.join(top, "measure").withColumn("share", F.col("v") / F.col("top"))
    return lsm.regression(shares, "measure", "rate", "share").select("measure", *[F.round(c, 4).alias(c) for c in ("q0", "q1", "q2")])


@query()
def sweep_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _scores(X.complexity(G.curve(spark, "combined1"), _SWEEP_FULL, list(range(2, 10))))


@query()
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """From more than half a period on; with less, the balance has no real solution."""
    r = X.sensitivity(spark, _SWEEP_WAVE, "transcendental1", 1000, [700, 900], [5.0, 20.0])
    return r.select("size", "noise_coeff", "error", *[F.round(c, 6).alias(c) for c in ("train_rse", "train_r_sq", "test_rse", "test_r_sq")])


@query(f"""WITH {curve_sql('lab_periodic')}, w AS (SELECT series_id || '~' || s AS series_id, x, n, s AS sigma, y AS ideal, y + {normal_sql(1, 'series_id', 'x')} * s AS y FROM cu, (SELECT unnest([0.0, 0.5, 1.5])::DOUBLE AS s)),
{orthogonal('w', 3, 'sigma ideal')}, f AS (SELECT sigma, abs(g3 - ideal) AS far FROM u3)
SELECT 'lab_periodic' AS series_id, sigma, round(avg(far), 6) AS mean, round(var_pop(far), 6) AS variance, round(stddev_pop(far), 6) AS deviation FROM f GROUP BY sigma""")
def deviation_by_noise(spark: SparkSession, d: str) -> DataFrame:
    r = X.deviation_by_noise(G.curve(spark, "lab_periodic"), 3, [0.0, 0.5, 1.5])
    return r.select("series_id", "sigma", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "deviation")])


@query()
def mass_test(spark: SparkSession, d: str) -> DataFrame:
    return X.mass_test(spark, B.CLOSED["exp_linear"][0], "exponential2", [10, 100, 200, 500, 1000, 2000], [3, 4, 5, 6], numeric=True, noisy=True).withColumn("r_sq", F.round("r_sq", 6))


def _cut_sql(sizes: list[int], cte: str = "cu") -> str:
    """w: the series cut to each size."""
    return f"w AS (SELECT series_id || '@' || size AS series_id, x, size::BIGINT AS n, y, size FROM {cte}, (SELECT unnest({sizes}) AS size) WHERE x < size)"


@query(f"""WITH {curve_sql('exponential1')}, {_cut_sql([10, 100, 1000, 10_000])}, {_rank_scores('w', range(2, 10))}
SELECT series_id, rank, NULL::VARCHAR AS error, round(r_sq, 6) AS r_sq FROM m""")
def polynomial_mass_test(spark: SparkSession, d: str) -> DataFrame:
    return X.polynomial_mass_test(spark, "exponential1", [10, 100, 1000, 10_000], range(2, 10)).withColumn("r_sq", F.round("r_sq", 6))


@query()
def perform_test(spark: SparkSession, d: str) -> DataFrame:
    return _scores(X.perform_test(G.curve(spark, "transcendental1"), _SWEEP_WAVE, 800, numeric=True))


@query(f"""WITH {curve_sql('exponential1')}, w AS (SELECT series_id || '#' || run AS series_id, x, n, y AS ideal, y + {normal_sql(1, "series_id || '#' || run", 'x')} * 5.0 AS y FROM cu, (SELECT unnest(range(0, 100)) AS run)),
{orthogonal('w', 3, 'ideal')}, r AS (SELECT series_id, sqrt(sum(pow(ideal - g3, 2)) / (count(*) - 2)) AS rse FROM u3 GROUP BY 1)
SELECT 'exponential1' AS series_id, count(*) AS runs, round(median(rse), 6) AS rse_median, round(stddev_pop(rse), 6) AS rse_deviation FROM r""")
def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    r = X.monte_carlo(G.curve(spark, "exponential1", 10_000), 3, 100, 5.0)
    return r.select("series_id", "runs", F.round("rse_median", 6).alias("rse_median"), F.round("rse_deviation", 6).alias("rse_deviation"))


_SIZES = list(range(400, 2200, 20))


@query(f"""WITH {curve_sql('transcendental1', 2200)}, no AS (SELECT series_id, x, n, y + {normal_sql(1, 'series_id', 'x')} * 5.0 + 0.1 AS y FROM cu), {_cut_sql(_SIZES, 'no')}, {orthogonal('w', 10, 'size')},
m AS (SELECT size, sqrt(sum(pow(y - g10, 2)) / (count(*) - 2)) AS rse, sum(pow(y - g10, 2)) / (var_pop(g10) * count(*)) AS miss FROM u10 GROUP BY size)
SELECT 'transcendental1' AS series_id, size::INTEGER AS size, round((rse - min(rse) OVER ()) / (max(rse) OVER () - min(rse) OVER ()) + (miss - min(miss) OVER ()) / (max(miss) OVER () - min(miss) OVER ()), 4) AS score FROM m""")
def growing_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return X.growing_prefixes(G.add_noise(G.curve(spark, "transcendental1", 2200), 0.1), _SIZES, 10).withColumn("score", F.round("score", 4))


_NOISE = "round(median(e), 6) AS median, round(var_pop(e), 5) AS variance, round(stddev_pop(e), 6) AS deviation"
_OUTLIERS = f"""d AS (SELECT (floor({uniform_sql(8, "'exponential1'", 'draw')} * 9999) + 1)::BIGINT AS x, draw, {normal_sql(9, "'exponential1'", 'draw')} * 5.0 * 3.0 AS v FROM (SELECT unnest(range(1, 1001)) AS draw)),
hit AS (SELECT x, sum(v) AS total, max_by(v, draw) AS last FROM d GROUP BY x)"""


def _noise(df: DataFrame) -> DataFrame:
    e = df.withColumn("e", F.col("y") - F.col("y_ideal"))
    return e.groupBy("series_id").agg(*rounded(6, median=F.median("e")), *rounded(5, variance=F.var_pop("e")), *rounded(6, deviation=F.stddev_pop("e")))


@query(f"WITH {curve_sql('exponential1')}, e AS (SELECT series_id, {normal_sql(1, 'series_id', 'x')} * 5.0 AS e FROM cu) SELECT series_id, {_NOISE} FROM e GROUP BY series_id")
def noise_normal(spark: SparkSession, d: str) -> DataFrame:
    return _noise(G.add_noise(G.curve(spark, "exponential1"), 0.0, 5.0))


@query(f"WITH {curve_sql('exponential1')}, {_OUTLIERS}, e AS (SELECT series_id, {normal_sql(1, 'series_id', 'cu.x')} * 5.0 + coalesce(total, 0) AS e FROM cu LEFT JOIN hit ON hit.x = cu.x) SELECT series_id, {_NOISE} FROM e GROUP BY series_id")
def noise_outliers(spark: SparkSession, d: str) -> DataFrame:
    return _noise(G.add_noise(G.curve(spark, "exponential1"), 0.0, 5.0, abnormal=True))


@query(f"WITH {curve_sql('exponential1')}, {_OUTLIERS}, e AS (SELECT series_id, coalesce(last, {normal_sql(1, 'series_id', 'cu.x')} * 5.0) AS e FROM cu LEFT JOIN hit ON hit.x = cu.x) SELECT series_id, {_NOISE} FROM e GROUP BY series_id")
def noise_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Outliers take the place of the noise."""
    return _noise(G.add_noise(G.curve(spark, "exponential1"), 0.0, 5.0, abnormal=True, replace=True))


@query(f"SELECT i AS draw, (floor({uniform_sql(1, 'i')} * 9999) + 1)::BIGINT AS x FROM range(0, 1000) r(i)")
def outlier_positions(spark: SparkSession, d: str) -> DataFrame:
    return G.outlier_positions(spark, 10_000, 1000)


def _law(law: str, a: float, b: float, sql: str) -> None:
    @query(f"SELECT round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(var_pop(y), 6) AS variance FROM (SELECT {sql} AS y FROM range(0, 10000) r(i))", f"random_{law}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.sample(spark, law, 10_000, a, b).agg(*rounded(6, mean=F.avg("y"), median=F.median("y"), variance=F.var_pop("y")))


_law("uniform", 0.0, 10.0, f"{uniform_sql(1, 'i')} * 10")
_law("normal", 0.0, 5.0, f"{normal_sql(1, 'i')} * 5")
_law("exponential", 2.0, 0.0, f"-2 * ln({uniform_sql(1, 'i')})")
_law("chi_square", 3.0, 0.0, " + ".join(f"pow({normal_sql(1000 + k, 'i')}, 2)" for k in range(3)))


@query(f"WITH {OD}, {LI} SELECT od.x, round(od.y, 4) AS y_left, round(li.y, 4) AS y_right FROM od JOIN li ON li.x = od.x WHERE od.x < 1000")
def paired_series(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand days of two series, by place; a sample without partner would be an error."""
    a, b = (S.head(s(spark, d), 1000).withColumn("series_id", F.lit("pair")) for s in (S.orders, S.lineitem))
    return M.same_size(a, b).select("x", F.round("y_left", 4).alias("y_left"), F.round("y_right", 4).alias("y_right"))


@query(f"WITH {curve_sql('notebook_sine')} SELECT 'callable' AS series_id, x, round(y, 8) AS y FROM cu")
def gen_callable(spark: SparkSession, d: str) -> DataFrame:
    """A Python function as the data model."""
    return G.from_callable(spark, "callable", lambda t: 2.2 * np.sin(0.01 * t), 1000).select("series_id", "x", F.round("y", 8).alias("y"))


# ---------------------------------------------------------------- streams
def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream of files; as a pattern, its path may be a file or a folder."""
    return spark.readStream.schema(S.read_table(spark, d, "events").schema).parquet(f"{d}/events[.]parquet")


@query(ORACLES["alpha_beta"])
def alpha_beta_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The stateful filter over events as a stream that ends with what is there."""
    stream = _event_stream(spark, d)
    out = drained(SF.alpha_beta_stream(stream, "event_type", "ts", "value"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("at")) - 1
    return out.select("series_id", place.cast("long").alias("x"), F.round("y_clean", 4).alias("y_clean"))


@query("""WITH w AS (SELECT event_type AS series_id, date_trunc('day', ts) AS start, avg(value) AS y, count(*) AS n FROM events GROUP BY ALL)
SELECT series_id, start::TIMESTAMP AS start, round(y, 6) AS y, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def window_means_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of the windows that the watermark has closed."""
    stream = _event_stream(spark, d)
    out = drained(SF.window_means(stream, "event_type", "ts", "value"))
    return out.select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("y", 6).alias("y"), "n")


# ---------------------------------------------------------------- cleaning, then a trend: the composed runs
def _composed(name: str, clean, sql: str) -> None:
    @query(f"WITH RECURSIVE {EV}, {sql}, {fitted_sql('cl')} SELECT series_id, round(median(y - g), 5) AS median, round(var_pop(y - g), 4) AS variance, round(stddev_pop(y - g), 5) AS deviation, round(1 - sum(pow(y - g, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM f GROUP BY series_id", name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ev = S.events(spark, d)
        cleaned = ev.select("series_id", "x", "n").join(clean(ev).select("series_id", "x", F.col("y_clean").alias("y")), ["series_id", "x"])
        r = lsm.fitted(cleaned, 3).withColumn("r", F.col("y") - F.col("y_fit"))
        return r.groupBy("series_id").agg(*rounded(5, median=F.median("r")), *rounded(4, variance=F.var_pop("r")), *rounded(5, deviation=F.stddev_pop("r")), *rounded(6, r2=M.r2_observed("y", "y_fit")))


def _fold_sql(test: str, value: str, pre: str = "", more: str = "") -> str:
    """cl: the detector's cleaned series, as rows of a series."""
    last = "[r.w[2], r.w[3], r.w[4], r.w[5], e.y]"
    return f"""{pre}k AS (SELECT series_id, list(y ORDER BY x) AS w, stddev_pop(y) AS ref FROM ev WHERE x < 5 GROUP BY series_id), r AS (
  SELECT series_id, 3::BIGINT AS x, ref, [w[1], w[1], w[2], w[3], w[4]] AS w FROM k
  UNION ALL
  SELECT e.series_id, e.x, r.ref, [r.w[2], r.w[3], r.w[4], r.w[5], CASE WHEN {test.format(last)} THEN {value.format(last)} ELSE e.y END] FROM r JOIN ev e ON e.series_id = r.series_id AND e.x = r.x + 1{more}),
cl AS (SELECT series_id, x, n, y FROM ev WHERE x < 4 UNION ALL SELECT r.series_id, r.x, e.n, r.w[5] FROM r JOIN ev e ON e.series_id = r.series_id AND e.x = r.x WHERE r.x > 3)"""


_composed("clean_medium_trend", C.detect_medium, _fold_sql("list_aggregate({}, 'stddev_pop') > 1.6 * r.ref", "list_aggregate({}, 'median')"))
_TREND = sums("ev").replace("s AS (", "s_ AS (").replace("b AS (SELECT", "b_ AS (SELECT").replace("FROM s)", "FROM s_)").replace("q AS (", "q_ AS (").replace("FROM b)", "FROM b_)")
_composed("clean_mnk_trend", C.detect_mnk, _fold_sql("7 * sqrt(5) * list_aggregate({}, 'stddev_pop') > sqrt(e.n)", "p0 + p1 * e.x + p2 * e.x * e.x", f"{_TREND}, ", " JOIN q_ ON q_.series_id = e.series_id"))
_composed("clean_sliding_trend", C.sliding_median, "m AS (SELECT series_id, x, n, y, list(y) OVER (PARTITION BY series_id ORDER BY x ROWS 4 PRECEDING) AS l FROM ev), cl AS (SELECT series_id, x, n, CASE WHEN x < 5 THEN y ELSE list_aggregate(l, 'median') END AS y FROM m)")


# ---------------------------------------------------------------- pages, text, tables
@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] AS first_link FROM pages""")
def html_title_links(spark: SparkSession, d: str) -> DataFrame:
    p = S.read_table(spark, d, "pages").select("page_id", "html")
    return p.select("page_id", H.title("html").alias("title"), F.size(H.links("html")).cast("long").alias("n_links"), F.try_element_at(H.links("html"), F.lit(1)).alias("first_link"))


@query("""SELECT page_id::VARCHAR AS key, item, trim(regexp_replace(texts[item + 1], '\\s+', ' ', 'g')) AS text, NULL::VARCHAR AS href
FROM (SELECT page_id, texts, unnest(range(0, len(texts)))::INTEGER AS item FROM (SELECT page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) AS texts FROM pages))""")
def html_select(spark: SparkSession, d: str) -> DataFrame:
    return H.html_select(S.read_table(spark, d, "pages"), "div", "ad")


@query("""SELECT key, t AS table_no, r AS row_no, c AS col_no, v AS text FROM (SELECT c_custkey::VARCHAR AS key, unnest([
  {'t': 0, 'r': 0, 'c': 0, 'v': 'name'}, {'t': 0, 'r': 0, 'c': 1, 'v': c_name}, {'t': 0, 'r': 1, 'c': 0, 'v': c_nationkey::VARCHAR}, {'t': 1, 'r': 0, 'c': 0, 'v': c_custkey::VARCHAR}], recursive := true) FROM customer)""")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of pages that are made of a table's rows."""
    c = S.read_table(spark, d, "customer")
    parts = [F.lit("<p>x</p><table><tr><th>name</th><td> "), F.col("c_name"), F.lit("</td></tr><tr><td>"), F.col("c_nationkey").cast("string"), F.lit("</td></tr></table><TABLE><tr><td><b>"), F.col("c_custkey").cast("string"), F.lit("</b></td></tr></TABLE>")]
    return H.html_tables(c.select(F.col("c_custkey").alias("page_id"), F.concat(*parts).alias("html")))


@query("SELECT p_partkey::VARCHAR AS key, 0 AS item, p_name AS title, 'https://parts/p/' || p_partkey AS href, p_brand AS about FROM part")
def html_records(spark: SparkSession, d: str) -> DataFrame:
    """Cards of pages that are made of a table's rows; a card without a heading is skipped."""
    c = S.read_table(spark, d, "part")
    parts = [F.lit('<div class="card"><h2><a href="/p/'), F.col("p_partkey").cast("string"), F.lit('">'), F.col("p_name"), F.lit("</a></h2><p> "), F.col("p_brand"), F.lit(' </p></div><div class="card"><p>none</p></div>')]
    return H.html_records(c.select(F.col("p_partkey").alias("page_id"), F.concat(*parts).alias("html")), "card", "https://parts")


@query("SELECT page_id, trim(replace(regexp_extract(url, '^https?://([^/]*)', 1), 'www.', '')) AS host, 'https://' || regexp_extract(url, '^https?://(.*)$', 1) AS secure, to_json({'id': page_id, 'url': url})::VARCHAR AS record FROM pages WHERE url IS NOT NULL")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    p = S.read_table(spark, d, "pages").where("url IS NOT NULL")
    host = F.trim(F.replace(F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("www."), F.lit("")))
    return p.select("page_id", host.alias("host"), F.concat(F.lit("https://"), F.regexp_extract("url", "^https?://(.*)$", 1)).alias("secure"), F.to_json(F.struct(F.col("page_id").alias("id"), "url")).alias("record"))


@query("SELECT c_custkey, c_name, c_acctbal::DOUBLE AS y FROM customer WHERE c_acctbal IS NOT NULL")
def named_column(spark: SparkSession, d: str) -> DataFrame:
    return S.read_table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("y")).na.drop()
