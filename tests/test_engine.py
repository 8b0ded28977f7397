"""The engine against hand-computed values, numpy, and its own algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import metrics as M
from trendloom.functions.formula import Formula, FormulaError, polynomial
from trendloom.operators import balance as B
from trendloom.operators import cleaning as C
from trendloom.operators import experiments as X
from trendloom.operators import fit as FT
from trendloom.operators import lsm
from trendloom.sources import generators as G
from trendloom.sources import html as H
from trendloom.sources import series as S


def series(spark, **named):
    rows = [(k, i, len(v), float(y)) for k, v in named.items() for i, y in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, x long, n long, y double")


def values(df, col, key="x"):
    return [r[col] for r in df.orderBy("series_id", key).collect()]


# ------------------------------------------------------------------ measures
def test_measures_of_fixtures(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "l double, r double")
    r = d.agg(M.lin_div("l", "r"), M.rss("l", "r"), M.mse("l", "r"), M.rse("l", "r"), M.r_sq_fit("l", "r"), M.r2_observed("l", "r"), M.concord("l", "r"), M.mle("l", "r")).first()
    assert list(r) == pytest.approx([2, 4, 4 / 3, 2.0, 1 - 4 / (26 / 3), -1, 0.75, 2 / 3])


def test_two_forms_of_r_squared_differ(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "l double, r double")
    assert d.agg(M.r_sq_fit("l", "r")).first()[0] != d.agg(M.r2_observed("l", "r")).first()[0]


def test_growth_and_period(spark):
    s = series(spark, a=[1, 4, 9, 16], b=[0, 1, 2, 0, 1], c=[1, 2, 3], d=[5, 5, 5, 1])
    assert s.where("series_id = 'a'").agg(M.growth()).first()[0] == 5.0
    assert {r.series_id: r.period for r in C.period(s).collect()} == {"a": None, "b": 2, "c": None, "d": None}


def test_pairs_must_be_of_one_size(spark):
    a, b = series(spark, s=[1, 2, 3]), series(spark, s=[1, 2, 3, 4])
    assert M.same_size(a, a).count() == 3
    with pytest.raises(Exception, match="Array sizes must be equal"):
        M.same_size(a, b).collect()


def test_statistics_rows(spark):
    s = series(spark, s=[1, 2, 3, 4]).withColumn("fit", F.col("y") * 2)
    t = {r.label: r for r in M.statistics(s, "y", ["fit"]).collect()}
    assert set(t) == {"fit", "data"}
    assert (t["fit"].d_med, t["fit"].d_var, t["fit"].mse, t["fit"].lin_div) == (2.5, 5.0, 7.5, 10.0)
    n = M.statistics(s, "y", ["fit"], by_pair=True).collect()
    assert len(n) == 1 and n[0].d_var == 2.5


def test_histogram_closes_its_last_bin(spark):
    h = {r.bin: r.n for r in M.histogram(series(spark, s=[0, 1, 2, 3, 4]), 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}
    assert M.histogram(series(spark, s=[7, 7]), 4).first().n == 2


# ------------------------------------------------------------------ windows and filters
def test_sliding_median(spark):
    assert values(C.sliding_median(series(spark, s=[5, 1, 4, 2, 3, 9, 0])), "y_clean") == [5, 1, 4, 2, 3, 3, 3]
    assert values(C.sliding_median(series(spark, s=[5, 1, 4, 2]), 2), "y_clean") == [5, 1, 2.5, 3]


def test_alpha_beta(spark):
    assert values(C.alpha_beta(series(spark, s=[10, 20, 15])), "y_clean") == [20, 20, 15]
    assert values(C.alpha_beta(series(spark, s=[3])), "y_clean") == [6]


def test_detectors_see_their_own_replacements(spark):
    y = [1, 2, 1, 2, 1, 50, 1, 2, 1, 2]
    s, ref = np.array(y, float), np.std(y[:5])
    for last in range(4, len(s)):
        if np.std(s[last - 4 : last + 1]) > 1.6 * ref:
            s[last] = np.median(s[last - 4 : last + 1])
    assert values(C.detect_medium(series(spark, s=y)), "y_clean") == s.tolist() and s[5] == 2
    assert values(C.detect_medium(series(spark, s=[1, 2])), "y_clean") == [1, 2]
    fit, s = np.polyval(np.polyfit(range(10), y, 2), range(10)), np.array(y, float)
    for last in range(4, len(s)):
        if 7 * math.sqrt(5) * np.std(s[last - 4 : last + 1]) > math.sqrt(10):
            s[last] = fit[last]
    assert values(C.detect_mnk(series(spark, s=y)), "y_clean") == pytest.approx(s.tolist())


def test_resampling(spark):
    s = series(spark, s=[0, 10, 20, 30, 40])
    assert [(r.at, r.y) for r in C.resample(s, 0.4).orderBy("place").collect()] == [(0.0, 0.0), (2.5, 25.0)]
    with pytest.raises(ValueError):
        C.resample(s, 1.5)


def test_minima_and_differences(spark):
    s = series(spark, s=[3, 1, 2, 2, 0, 5])
    assert values(C.local_minima(s), "x") == [1, 4]
    assert values(C.first_difference(s), "diff") == [-2, 1, 0, -2, 5]


def test_index_is_dense_over_blocks(spark):
    rows = [("a" if i % 3 else "b", i // 7, i, float(i)) for i in range(100)]
    d = spark.createDataFrame(rows, "k string, block int, o long, v double").repartition(5)
    got = S.index_series(d, "k", ["o"], "v", F.col("block")).orderBy("series_id", "x").collect()
    for k in "ab":
        mine = [r for r in got if r.series_id == k]
        assert [r.x for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        assert [r.y for r in mine] == sorted(r.y for r in mine)


def test_split_and_head(spark):
    s = series(spark, s=range(10))
    assert [r.split for r in S.split(s).orderBy("x").collect()] == ["train"] * 8 + ["test"] * 2
    assert {(r.x, r.n) for r in S.head(s, 3).collect()} == {(0, 3), (1, 3), (2, 3)}
    assert values(S.reverse(s), "y") == list(range(9, -1, -1))


# ------------------------------------------------------------------ least squares
@pytest.mark.parametrize("rank", range(1, 11))
def test_least_squares_is_numpy_s(spark, rank):
    rng = np.random.default_rng(rank)
    y = np.cos(np.arange(300) / 40) * 5 + rng.normal(size=300)
    s = series(spark, s=y)
    assert values(lsm.fitted(s, rank), "y_fit") == pytest.approx(np.polyval(np.polyfit(range(300), y, rank - 1), range(300)).tolist(), abs=1e-6)


def test_fit_bounds(spark):
    s = series(spark, s=[1, 2])
    for bad in (0, 11):
        with pytest.raises(ValueError):
            lsm.fit(s, bad)
    assert lsm.fit(s, 3).first().coeffs is None
    assert lsm.fit(series(spark, s=[4]), 1).first().coeffs == [4.0]
    with pytest.raises(ValueError):
        lsm.extrapolate(lsm.fit(s, 2), -1)
    line = lsm.extrapolate(lsm.fit(s, 2), 4)
    assert values(line, "y_fit") == pytest.approx([1, 2, 3, 4])


def test_rank_choice(spark):
    s = G.curve(spark, "exponential1", 200)
    ranked = lsm.best_rank(s, range(2, 7))
    assert lsm.settled_rank(ranked, 2).first()["rank"] == 3


def test_regression_on_any_x(spark):
    d = spark.createDataFrame([("k", x, 2 - 3 * x + 0.5 * x * x) for x in (0.1, 5.0, 2.0, 9.0, -4.0)], "k string, x double, y double")
    r = lsm.regression(d, "k", "x", "y").first()
    assert [r.q0, r.q1, r.q2] == pytest.approx([2, -3, 0.5])


# ------------------------------------------------------------------ formulas
def test_formula_back_ends_agree(spark):
    f = Formula("a0 + a1*t + a2*exp(a3*t)/(1 + t**2) - sqrt(a0 + t) * sin(a1*t) + log(a2 + t)")
    a, t = [1.5, 0.2, 0.7, 0.05], np.linspace(0, 3, 7)
    v, d = f.values(t, a, derivatives=True)
    cols = spark.range(7).select(f.column(F.col("id") / 2, dict(zip(f.params, a))).alias("v")).collect()
    assert [r.v for r in cols] == pytest.approx(v.tolist())
    for i in range(4):
        up = list(a)
        up[i] += 1e-6
        assert (f.values(t, up) - v) / 1e-6 == pytest.approx(d[:, i], abs=1e-4)
    s = f.series(a, 9)
    assert np.polyval(s[::-1], 0.05) == pytest.approx(f.values([0.05], a)[0], abs=1e-9)


def test_formula_is_not_python():
    for text in ("__import__('os')", "t.real", "[t]", "lambda: t", "t if t else 1", "f(t)", "t = 1", "open('x')"):
        with pytest.raises(FormulaError):
            Formula(text)
    assert Formula("a10*t + a2").params == ["a10", "a2"]
    assert polynomial(3).text == "c0 + c1*t**1 + c2*t**2"


# ------------------------------------------------------------------ balance
COEFFS = {"exp": [3, 2, 1, 0.5], "sincos": [3, 2, -1, 0.5, 0.1, -0.02], "sincos_one": [2, 1, -0.5], "exp_const": [3, 2], "exp_linear": [3, 2, 1], "sin_square": [1, 2, 3, -0.5], "cos_cube": [1, 2, -0.5, 3, 0.1]}


@pytest.mark.parametrize("name", COEFFS)
@pytest.mark.parametrize("discrete", [False, True])
def test_closed_forms_reproduce_their_targets(spark, name, discrete):
    text, p = B.CLOSED[name]
    c = COEFFS[name] if not discrete else [x / k * abs(k) for x, k in zip(COEFFS[name], p)]
    row = spark.range(1).select(*[v.alias(k) for k, v in B.closed_form(name, [F.lit(float(x)) for x in c], discrete).items()]).first()
    f = Formula(text)
    target = np.array(c) * (np.array(p) if discrete else 1)
    have = f.orders(len(c))
    assert f.series([row[k] for k in f.params], len(c))[have] == pytest.approx(target[have])
    assert B.weights(f, len(c))[have] == pytest.approx(np.array(p)[have])


def test_closed_form_literals(spark):
    c = [F.lit(x) for x in (3.0, 2.0, 1.0, 0.5)]
    raw = spark.range(1).select(*[v.alias(k) for k, v in B.closed_form("exp", c).items()]).first()
    assert [raw.a3, raw.a2, raw.a1, raw.a0] == pytest.approx([1.5, 8 / 9, 2 / 3, 19 / 9])
    disc = spark.range(1).select(*[v.alias(k) for k, v in B.closed_form("exp", c, True).items()]).first()
    assert [disc.a3, disc.a2, disc.a1, disc.a0] == pytest.approx([0.5, 4, 2, 2])
    none = spark.range(1).select(*[v.alias(k) for k, v in B.closed_form("sincos_one", [F.lit(1.0)] * 3).items()]).first()
    assert none.a1 is None and none.a0 is None


@pytest.mark.parametrize("name", COEFFS)
def test_general_solver_balances(name):
    f = Formula(B.CLOSED[name][0])
    a = B.solve(f, np.array(COEFFS[name], float), discrete=False)
    have = f.orders(len(COEFFS[name]))
    assert f.series(a, len(COEFFS[name]))[have] == pytest.approx(np.array(COEFFS[name])[have], rel=1e-5)


def test_closed_forms_are_known_by_any_names():
    assert B.closed_name(Formula("b*sin(c*x) + d*cos(c*x)", "x")) == "sincos_one"
    assert B.closed_name(Formula("b*sin(c*x) + d*cos(e*x)", "x")) is None
    assert B.closed_name(Formula("a0 + a1*t + a2*exp(a3*t)")) == "exp"


def test_general_solver_without_a_closed_form():
    f = Formula("a0*exp(a1*t) + a2*t")
    c = f.series([2.0, 0.3, 1.5], 3)
    assert B.closed_name(f) is None and B.solve(f, c, discrete=False) == pytest.approx([2.0, 0.3, 1.5], rel=1e-6)
    assert B.solve(f, f.series([2.0, 0.3, 1.5], 6), discrete=False, overdetermined=True) == pytest.approx([2.0, 0.3, 1.5], rel=1e-6)
    with pytest.raises(B.BalanceError, match="no real solution"):
        B.solve(Formula("a0**2 + a1**2*t + a2**2*t**2"), np.array([1.0, -2.0, 3.0]), discrete=False)


def test_the_nearer_branch(spark):
    x = np.arange(40.0)
    s = series(spark, up=1 + x + np.exp(0.02 * x), down=30 - x + np.exp(-0.02 * x), none=-(x**2))
    told = {r.series_id: r for r in B.nearer_branch(s, lsm.fit(s, 3)).collect()}
    assert told["none"].a2 is None and told["none"].a0 is None and told["up"].a2 is not None
    for k, row in told.items():
        if row.a2 is not None:
            y = np.array([r.y for r in s.where(F.col("series_id") == k).orderBy("x").collect()])
            other = row.a1 + 2 * row.a2
            rss = [float(((y - (row.a0 + p * x + np.exp(q * x))) ** 2).sum()) for p, q in ((row.a1, row.a2), (other, -row.a2))]
            assert row.rss == pytest.approx(rss[0]) and rss[0] <= rss[1]


@pytest.mark.parametrize("text,curve,n", [("a0*sin(a1*t) + a2*cos(a1*t)", "transcendental1", 800), ("a0 + a1*t + a2*exp(a3*t)", "exponential2", 500)])
def test_numeric_fits_are_least(spark, text, curve, n):
    """At a fit's parameters the slope of the sum of squares is nil, and steps away from them make it larger."""
    s = G.add_noise(G.curve(spark, curve, n), 0, 0.05)
    row = FT.dsb_fit(s.select("series_id", "x", "n", "y"), text).first()
    f, y = Formula(text), np.array([r.y for r in s.orderBy("x").collect()])
    t = np.arange(float(n))
    v, d = f.values(t, row.params, True)
    r = v - y
    assert np.abs(d.T @ r / np.linalg.norm(d, axis=0)).max() < 1e-4 * np.linalg.norm(r)
    for i in range(len(row.params)):
        for step in (0.999, 1.001):
            moved = list(row.params)
            moved[i] *= step
            assert ((f.values(t, moved) - y) ** 2).sum() > (r**2).sum()


def test_long_series_are_polished_in_place(spark):
    """The fit of sums over partitions equals that of one task; a series without a balance keeps its error."""
    e = B.CLOSED["sincos_one"][0]
    s = G.add_noise(G.curve(spark, "transcendental1", 900), 0, 0.05).select("series_id", "x", "n", "y").repartition(3)
    flat = spark.range(30).select(F.lit("flat").alias("series_id"), F.col("id").alias("x"), F.lit(30).cast("long").alias("n"), F.lit(0.0).alias("y"))
    one = FT.dsb_fit(s, e).first()
    both = {r.series_id: r for r in FT.dsb_fit(s.unionByName(flat), e, long_series=True).collect()}
    assert both["transcendental1"].params == pytest.approx(one.params, rel=1e-5) and both["transcendental1"].error is None
    assert both["flat"].params is None and both["flat"].error


def test_unsolvable_models_fail_clearly():
    with pytest.raises(B.BalanceError):
        B.solve(Formula("a0 + a1*t + a2*sin(a3*t)"), np.array([1.0, 2.0, 3.0, 4.0]))
    with pytest.raises(B.BalanceError):
        B.solve(Formula("a0*cos(a1*t) + a2*sin(a1*t) + a3*cos(a1*t)"), np.array([1.0, 2.0, 3.0, 4.0]))
    with pytest.raises(ValueError):
        B.solve(Formula("a0 + a1*t"), np.array([1.0]))


def test_numeric_fit_recovers_a_curve(spark):
    s, e = G.curve(spark, "transcendental1"), B.CLOSED["sincos_one"][0]
    fits = FT.dsb_fit(s, e)
    assert fits.first().error is None
    told = FT.with_fit(s, fits, e).agg(M.rse("y", "y_fit")).first()[0]
    assert told < 1e-6
    ahead = FT.curve(fits, e, length=1500)
    assert ahead.count() == 1500
    last = ahead.where("x = 1400").first().y_fit
    assert last == pytest.approx(0.2 * math.sin(7) + 2.12 * math.cos(7), abs=1e-4)


def test_fit_errors(spark):
    s = G.curve(spark, "exponential1", 50)
    with pytest.raises(ValueError):
        FT.dsb_fit(s, "a0 + a1*t + a2*exp(a3*t)", rank=3)
    row = FT.dsb_fit(s, "a0 + a1*t + a2*sin(a3*t)", numeric=False).first()
    assert row.params is None and "fewer equations" in row.error


def test_modes_and_facade(spark):
    s, e = G.curve(spark, "lab_periodic", 30), B.CLOSED["sincos_one"][0]
    m = FT.Model(s, e)
    with pytest.raises(RuntimeError, match="has not been fitted"):
        m.metrics()
    for mode in (FT.FittingModes.AUTO, FT.FittingModes.DSBI):
        got = m.nonline_fit(FT.FittingOptions(mode, numeric=True)).metrics().first()
        assert got.rse < 1e-6 and got.corr == pytest.approx(1)
    short = FT.Model(s, e).nonline_fit(FT.FittingOptions(FT.FittingModes.DSB)).coeffs.first()
    assert short.params is None and short.error  # the discrete balance of half a period is complex
    assert m.is_fitted and m.collapse(5, 3).count() == 3 and m(7).first().x == 7
    assert m.as_lite().first().model.expr == e and str(m) == f"{e} in t"
    lite = FT.Model(s, e).nonline_fit(FT.FittingOptions(full_model=False))
    assert lite.columns == ["series_id", "model"] and lite.first().model.expr == e
    work, told = m.as_lambda("lab_periodic"), m.told().first().formula
    assert work([7.0])[0] == pytest.approx(m(7).first().y_fit) == pytest.approx(Formula(told).values([7.0], [])[0])
    with pytest.raises(RuntimeError):
        m.as_lambda("no such series")
    with pytest.raises(RuntimeError):
        m.apply_trained([1.0])
    assert values(FT.Model(s, "a0 + a1*t").apply_trained([1, 2]).collapse(0, 3), "y_fit") == [1, 3, 5]
    p = FT.Model(s)
    assert p.poly_fit(3).first().coeffs and not p.is_fitted
    p.poly_fit(3, update=True)
    assert p.is_fitted and p.data_fit().count() == 30


def test_overdetermined_balance_and_integral(spark):
    s, e = G.curve(spark, "transcendental2", 30), B.CLOSED["sincos_one"][0]
    for fits in (FT.nonline_fit(s, e, rank=7), FT.dsbi_fit(s, e, rank=7)):
        told = FT.with_fit(s, fits.where("error IS NULL"), e).agg(M.r2_observed("y", "y_fit")).first()[0]
        assert told > 0.98


def test_rank_raising(spark):
    f = Formula(B.CLOSED["exp"][0])
    y = f.values(np.arange(300), [1, 0.2, 3, 0.004])
    assert FT.raised_rank(y, f, 4) >= 4
    wave = Formula("a0 + a1*t**2 + a2*t**5")
    assert FT.raised_rank(np.arange(50.0) ** 6, wave, 3) == 3  # a raised series would have orders without a term
    s = series(spark, s=y)
    fits = FT.nonline_fit(s, f.text, raise_rank=True)
    assert fits.first().error is None
    assert FT.with_fit(s, fits, f.text).agg(M.r2_observed("y", "y_fit")).first()[0] > 0.99


def test_spectrum():
    assert FT.spectrum("a0 + a1*exp(a2*t)", [1, 2, 3], 4) == pytest.approx([3, 6, 9, 9])
    assert FT.spectrum("a0 + a1*exp(a2*t)", [1, 2, 3], 3, scale=True) == pytest.approx([1.5, 6, 18])


# ------------------------------------------------------------------ generators, sweeps, pages
def test_noise_is_repeatable_and_fair(spark):
    s = G.curve(spark, "exponential1")
    one, two = G.add_noise(s, 0, 5), G.add_noise(s.repartition(7), 0, 5)
    assert values(one, "y") == values(two, "y")
    e = one.agg(F.avg(F.col("y") - F.col("y_ideal")), F.stddev_pop(F.col("y") - F.col("y_ideal"))).first()
    assert abs(e[0]) < 0.2 and abs(e[1] - 5) < 0.2
    out = G.add_noise(s, 0, 5, abnormal=True)
    assert out.count() == 10_000
    assert out.agg(F.stddev_pop(F.col("y") - F.col("y_ideal"))).first()[0] > 5.5
    last = G.add_noise(s, 0, 0.0, abnormal=True, replace=True)
    assert last.where("y <> y_ideal").count() == 0  # outliers of no deviation take the place of noise


@pytest.mark.parametrize("law,a,b,mean,var", [("uniform", 2, 4, 3, 1 / 3), ("normal", 1, 2, 1, 4), ("exponential", 2, 0, 2, 4), ("chi_square", 3, 0, 3, 6)])
def test_random_laws(spark, law, a, b, mean, var):
    r = G.sample(spark, law, 40_000, a, b).agg(F.avg("y"), F.var_pop("y")).first()
    assert r[0] == pytest.approx(mean, rel=0.05) and r[1] == pytest.approx(var, rel=0.08)
    p = G.outlier_positions(spark, 50, 1000).agg(F.min("x"), F.max("x")).first()
    assert p[0] == 1 and p[1] == 49


def test_hashed_numbers_are_what_other_engines_make(spark):
    import hashlib

    u = lambda *k: (int(hashlib.md5("/".join(map(str, k)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    d = spark.range(3).select(G.uniform(5, F.lit("s"), "id").alias("u"), G.normal(5, F.lit("s"), "id").alias("z")).collect()
    assert [r.u for r in d] == [u(5, "s", i) for i in range(3)]
    assert [r.z for r in d] == pytest.approx([math.sqrt(-2 * math.log(u(10, "s", i))) * math.cos(2 * math.pi * u(11, "s", i)) for i in range(3)])


def test_a_function_as_the_data_model(spark):
    s = G.from_callable(spark, "f", lambda t: 2 * t + 1, 10)
    assert values(s, "y") == [2.0 * i + 1 for i in range(10)] and s.first().n == 10


def test_sweeps_cover_the_reference_s_grids(spark):
    from trendloom.plans import catalogue

    run = lambda name: {r.series_id: r for r in catalogue.QUERIES[name](spark, "").collect()}
    grids = {
        "sweep_ratio_exponential": np.arange(0.5, 2.0, 0.25), "sweep_size_exponential": np.arange(1000, 10000, 500), "sweep_ratio_wave": np.arange(0.5, 5.0, 0.5),
        "sweep_size_wave": np.arange(400, 3000, 100), "sweep_size_short_wave": np.arange(20, 200, 10), "sweep_growth": np.arange(0.01, 0.12, 0.01),
    }
    for name, grid in grids.items():
        got = run(name)
        assert sorted(float(k) for k in got) == pytest.approx(sorted(grid.tolist()))
        assert all((r.error is None) == (r.train_rse is not None) for r in got.values())
        assert any(r.error is None for r in got.values())
    assert set(run("sweep_complexity")) == {f"poly{k}" for k in range(2, 10)}
    waves = run("sweep_ratio_wave")
    assert all(r.train_r_sq > 0.99 for r in waves.values())


def test_growing_prefixes_cover_the_reference_s_grid(spark):
    from trendloom.plans import catalogue

    got = catalogue.QUERIES["growing_prefixes"](spark, "").collect()
    assert sorted(r["size"] for r in got) == list(range(400, 2200, 20))
    assert {r.series_id for r in got} == {"transcendental1"} and all(0 <= r.score <= 2 for r in got)


def test_mass_tests_cover_the_reference_s_grids(spark):
    from trendloom.plans import catalogue

    grid = lambda name: sorted((int(r.series_id.split("@")[1]), r["rank"]) for r in catalogue.QUERIES[name](spark, "").collect())
    assert grid("mass_test") == [(s, r) for s in (10, 100, 200, 500, 1000, 2000) for r in range(3, 7)]
    assert grid("polynomial_mass_test") == [(s, r) for s in (10, 100, 1000, 10_000) for r in range(2, 10)]


def test_sweeps(spark):
    m = {(r.series_id, r["rank"]): r for r in X.mass_test(spark, B.CLOSED["exp"][0], "exponential2", [100, 300], [4]).collect()}
    assert len(m) == 2 and all(r.error is None for r in m.values())
    bad = X.mass_test(spark, "a0 + a1*t + a2*sin(a3*t)", "exponential2", [100], [4]).first()
    assert bad.error and bad.r_sq is None
    assert all(r.r_sq > 0.999 for r in X.polynomial_mass_test(spark, "exponential1", [50], range(3, 5)).collect())
    p = X.perform_test(G.curve(spark, "transcendental1"), B.CLOSED["sincos_one"][0], 800, numeric=True).first()
    assert p.train_r_sq > 0.9 and p.test_rse < 1 and p.error is None
    grid = X.sensitivity(spark, B.CLOSED["sincos_one"][0], "transcendental1", 1000, [800], [20.0]).collect()
    assert [(r.size, r.noise_coeff) for r in grid] == [(800, 20.0)] and grid[0].train_rse < 0.1
    poor = X.perform(X.cells(spark, "1 + t**2", [{"label": "up", "size": 30}, {"label": "short", "size": 2}]), B.CLOSED["sincos_one"][0]).collect()
    assert {r.series_id for r in poor} == {"up", "short"} and all(r.error and r.train_rse is None for r in poor)
    far = {r.sigma: r["mean"] for r in X.deviation_by_noise(G.curve(spark, "exponential1", 200), 3, [0.0, 1.0]).collect()}
    assert far[0.0] < 1e-6 < far[1.0]
    mc = X.monte_carlo(G.curve(spark, "exponential1", 400), 3, 20, 5.0).first()
    assert mc.runs == 20 and 0 < mc.rse_median < 2
    assert X.growing_prefixes(G.curve(spark, "combined1", 900), [400, 600, 800], 5).count() == 3
    df, label, ms = X.timed(lambda: spark.range(3), "r")
    assert label == "r" and ms > 0 and df.count() == 3


PAGE = """<html><title>T</title><div class="card x"><h2><a href="/j/1"> One <b>job</b></a></h2><p> about
 it </p></div><div class="card"><p>no heading</p></div><div class="event">news <a href="u">link</a></div>
<table><tr><th>a</th><td> b </td></tr><tr><td>1</td></tr></table><table><tr><td>z</table>"""


def test_pages(spark):
    d = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in H.html_select(d, "div", "event").collect()] == [("1", 0, "news link", "u")]
    assert [tuple(r)[1:] for r in H.html_tables(d).collect()] == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (1, 0, 0, "z")]
    r = H.html_records(d, "card", "http://h").collect()
    assert [(x.title, x.href, x.about.split()) for x in r] == [("One job", "http://h/j/1", ["about", "it"])]
    up = d.where("page_id = 1").select(H.upper_tags(F.lit("a <b class='x'>Bold</b> c"))).first()[0]
    assert up == "a <B CLASS='X'>Bold</B> c"


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 'line\nbreak, "quoted"'), ("b", "\xa0x")], "k string, v string")
    S.write(d, f"{tmp_path}/c", "csv")
    assert sorted(S.read_csv(spark, f"{tmp_path}/c", "k string, v string").collect()) == sorted(d.collect())
    S.write(d, f"{tmp_path}/j", "json")
    assert sorted(spark.read.schema("k string, v string").json(f"{tmp_path}/j").collect()) == sorted(d.collect())
    n = spark.createDataFrame([("1.5",), (None,)], "v string")
    S.write(n, f"{tmp_path}/p")
    assert S.read_column(spark, f"{tmp_path}/p", "v").collect() == [(1.5,)]
