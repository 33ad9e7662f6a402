"""Operators of the option-market part against NumPy, pandas and hand-made cases."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import oracle
from skewline.functions import curves as C
from skewline.functions import special as S
from skewline.operators import asof, inference, kernel, options, ordered, panel, skew, surface
from skewline.plans import panels

D = dt.date(2024, 1, 1)


# --- as-of joins -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["plain", "repeated", "shard"])
def test_nearest_join_takes_the_lower_of_two_as_near(spark, how):
    rng = random.Random(9)
    left = [(k, float(rng.randrange(0, 120)), i) for i, k in enumerate(["a", "b", "c"] * 60)] + [("a", 10.0, 900), ("a", 25.0, 901), ("a", None, 902), (None, 5.0, 903)]
    right = [("a", n, n / 10) for n in (5.0, 15.0, 35.0)] + [("b", float(rng.randrange(0, 120)), rng.random()) for _ in range(15)] + [("b", None, 1.0), ("a", 5.0, 0.1)]
    df, curve = spark.createDataFrame(left, "by string, n double, id int"), spark.createDataFrame(right, "by string, n double, rate double")
    args = {"plain": {}, "repeated": {"repeated": True}, "shard": {"tolerance": 20.0, "shard": 7.0}}[how]
    got = {r["id"]: r["rate"] for r in asof.nearest_join(df, curve, ["by"], "n", "n", ["rate"], **args).collect()}
    assert len(got) == len(left)
    for by, n, i in left:
        near = sorted((abs(m - n), m, -v) for b, m, v in right if b == by and m is not None and n is not None)
        want = -near[0][2] if near and near[0][0] <= args.get("tolerance", math.inf) else None
        assert got[i] == want, (by, n)
    assert got[900] == 0.5 and got[901] == 1.5


# --- curves and special functions --------------------------------------------------------------------------------


def test_curve_functions_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.linspace(0.4, 2.0, 41)
    q = rng.random(41) + 0.1
    df = spark.createDataFrame([(x.tolist(), q.tolist())], "x array<double>, q array<double>")
    y, g = F.col("q"), F.col("x")
    grid = np.linspace(0.3, 2.1, 17)
    r = df.select(
        C.trapezoid(y, g).alias("mass"), C.cumulative_at(y, g, 0.9).alias("low"), C.normalised(y, g).alias("one"), C.interpolated(y, g, C.linspace(0.3, 2.1, 17), -1.0, -2.0).alias("on"),
        C.hump(y, g).alias("h"), F.array(*C.regions_by_mask(y, g)).alias("masks"), C.quantile_index(y, g, 0.9).alias("i"),
    ).first()
    cum = np.concatenate(([0.0], np.cumsum((q[1:] + q[:-1]) / 2 * np.diff(x))))
    assert r["mass"] == pytest.approx(cum[-1]) and r["low"] == pytest.approx(np.interp(0.9, x, cum))
    assert np.allclose(r["one"], q / cum[-1]) and np.allclose(r["on"], np.interp(grid, x, q, left=-1.0, right=-2.0))
    inside, = np.nonzero((x >= 0.9) & (x <= 1.1))
    peak = inside[np.argmax(q[inside])]
    left, = np.nonzero((x >= 0.7) & (x < x[peak]))
    assert r["h"]["height"] == pytest.approx(q[peak] - q[left].min())
    for value, keep in zip(r["masks"], (x < 0.9, (x >= 0.9) & (x <= 1.1), x > 1.1), strict=True):
        assert value == pytest.approx(np.trapezoid(q[keep], x[keep]))
    assert r["i"] == min(max(int(np.searchsorted(cum / cum[-1], 0.9)), 1), 39)


def test_normal_distribution_and_black_prices(spark):
    z = [-40.0, -9.0, -7.2, -3.0, -1e-9, 0.0, 0.5, 7.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert np.allclose(got, [math.erfc(-v / math.sqrt(2)) / 2 for v in z], rtol=1e-8, atol=1e-15)
    df = spark.createDataFrame([(100.0, 90.0, 0.5, 0.4), (100.0, 90.0, 0.0, 0.4), (100.0, 90.0, 0.5, 0.0)], "f double, k double, t double, s double")
    call, put = (S.black_price(F.col("f"), F.col("k"), F.col("t"), F.col("s"), F.lit(side)) for side in (True, False))
    for r in df.select(call.alias("c"), put.alias("p")).collect():
        assert r["c"] - r["p"] == pytest.approx(10.0)
    assert df.select(call).collect()[1][0] == 10.0


def test_flat_smile_gives_a_lognormal_density(spark):
    df = spark.range(1).select(F.lit(0.04).alias("w"), F.lit(0.0).alias("rho"), F.lit(1e-9).alias("phi"))
    d = df.select(surface.smile_density(F.col("w"), F.col("rho"), F.col("phi"), 801).alias("d")).first()["d"]
    r, q = np.array([s["r"] for s in d]), np.array([s["q"] for s in d])
    want = np.exp(-((np.log(r) + 0.02) ** 2) / 0.08) / (r * np.sqrt(2 * np.pi * 0.04))
    assert np.abs(q - want).max() < 2e-3 and np.trapezoid(q * r, r) == pytest.approx(1, abs=1e-3)


# --- surfaces and the kernel -------------------------------------------------------------------------------------


def test_calibration_recovers_volatilities(spark):
    rows, truth = [], {}
    for e, (theta, rho, eta, gamma) in enumerate([(0.02, -0.4, 1.1, 0.4), (0.05, 0.2, 0.8, 0.5), (0.1, -0.7, 0.9, 0.3)]):
        phi = eta / (theta**gamma * (1 + theta) ** (1 - gamma))
        for k in np.linspace(-0.3, 0.3, 13):
            w = theta / 2 * (1 + rho * phi * k + math.sqrt((phi * k + rho) ** 2 + 1 - rho * rho))
            rows.append((D, e, 0.1 * (e + 1), float(k), math.sqrt(w / (0.1 * (e + 1)))))
        truth[e] = theta
    rows += [(D, 9, 0.1, 0.1, 0.5)] * 3
    df = spark.createDataFrame(rows, "date date, expiration int, tau double, log_moneyness double, iv double")
    got = {r["expiration"]: r for r in surface.calibrated(df, ["date", "expiration"]).collect()}
    assert set(got) == set(truth)
    for e, r in got.items():
        assert r["status"] == "ok" and r["theta"] == pytest.approx(truth[e]) and r["rmse"] < 2e-3 and abs(r["rho"]) < 0.99


def test_smiles_are_fitted_for_every_slice_with_four_options(spark, monkeypatch):
    from skewline.plans import surface_queries

    slices = {("2024-01-02", "2024-01-10"): 5, ("2024-01-02", "2024-01-26"): 4, ("2024-01-03", "2024-01-10"): 6, ("2024-01-03", "2024-01-26"): 3}
    rows = [(d, e, 8, 0.05, -0.1 + 0.05 * i, 0.6 + 0.01 * i * i) for (d, e), n in slices.items() for i in range(n)]
    df = spark.createDataFrame(rows, "date string, expiration string, days_to_expiry int, tau double, log_moneyness double, iv double")
    monkeypatch.setattr(surface_queries, "cross_section", lambda spark, folder: df)
    got = {(r["date"], r["expiration"]): r["n_options"] for r in surface_queries.q_smile_fit(spark, "").collect()}
    assert got == {k: n for k, n in slices.items() if n >= 4}


def test_monotone_variance_is_the_pooled_fit(spark):
    v = [3.0, 1.0, 2.0, 5.0, 4.0, 4.0, 6.0]
    df = spark.createDataFrame([(D, float(i), x) for i, x in enumerate(v)], "date date, tau double, theta double")
    got = [r["theta"] for r in surface.monotone(df, ["date"]).orderBy("tau").collect()]
    assert got == pytest.approx([2, 2, 2, 13 / 3, 13 / 3, 13 / 3, 6])


def test_kernel_fit_recovers_its_coefficients(spark):
    rng = np.random.default_rng(5)
    x = np.linspace(0.4, 2.0, 60)
    p = np.exp(-((x - 1.1) ** 2) / 0.1)
    p /= np.trapezoid(p, x)
    theta = np.array([[-1.0, 0.4], [0.5, 0.2], [-0.3, 0.1]])
    s, rows = (x - 1.2) / 0.8, []
    for z in rng.normal(size=80):
        q = p * np.exp(np.stack([s, s**2, s**3]).T @ theta @ np.array([1.0, z]))
        rows.append(((q / np.trapezoid(q, x)).tolist(), p.tolist(), float(z)))
    df = spark.createDataFrame([*rows, (rows[0][0], rows[0][1], None)], "q array<double>, p array<double>, z double")
    got, value, n = kernel.fit_kernel(df, "q", "p", ["z"], x.tolist())
    assert n == 80 and np.allclose(got, theta, atol=1e-3)
    assert kernel.fit_kernel(df.limit(0), "q", "p", ["z"], x.tolist())[2] == 0


# --- inference ---------------------------------------------------------------------------------------------------


def test_bootstrap_means_equal_drawn_rows(spark):
    rng = np.random.default_rng(4)
    v, labels, block, draws = rng.normal(size=23), np.array(["u", "w"])[rng.integers(0, 2, 23)], 5, 40
    df = spark.createDataFrame([("k", i, float(a), b) for i, (a, b) in enumerate(zip(v, labels, strict=True))] + [("k", 99, None, "u")], "key string, i int, v double, l string")
    want = {"u": [], "w": [], "": []}
    for d in range(draws):
        rows = []
        for b in range(5):
            start = (1103515245 * (d * 5 + b) + 12345) % 2147483648 % 23
            rows += [(start + j) % 23 for j in range(min(block, 23 - b * block))]
        for name in want:
            own = [v[i] for i in rows if not name or labels[i] == name]
            if own:
                want[name].append(np.mean(own))
    r = inference.bootstrap_means(df, "key", "i", "v", block, draws).first()
    assert (r["n"], r["mean"]) == (23, pytest.approx(v.mean())) and r["error"] == pytest.approx(np.std(want[""], ddof=1))
    assert [r["low"], r["high"]] == pytest.approx(np.percentile(want[""], [2.5, 97.5]))
    for r in inference.bootstrap_means(df, "key", "i", "v", block, draws, "l").collect():
        assert r["error"] == pytest.approx(np.std(want[r["l"]], ddof=1)) and r["mean"] == pytest.approx(v[labels == r["l"]].mean())


@pytest.mark.parametrize("by_date", [False, True])
def test_robust_ols_equals_the_formula(spark, by_date):
    rng = np.random.default_rng(6)
    n, lags = 60, 4
    date = np.repeat(np.arange(n // 2), 2) if by_date else np.arange(n)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    y = x @ [1.0, 0.5, -2.0] + rng.normal(size=n)
    rows = [("k", int(d), float(a), float(b), float(c)) for d, a, (_, b, c) in zip(date, y, x, strict=True)] + [("k", 999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, d int, y double, a double, b double")
    got = {r["term"]: r for r in inference.robust_ols(df, "key", "d", "y", {"a": F.col("a"), "b": F.col("b")}, lags, by_date).collect()}
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    h = pd.DataFrame(x * (y - x @ beta)[:, None]).groupby(date).sum().to_numpy()
    s = h.T @ h
    for m in range(1, lags + 1):
        g = h[m:].T @ h[:-m]
        s += (1 - m / (lags + 1)) * (g + g.T)
    error = np.sqrt(np.diag(bread @ s @ bread))
    for i, term in enumerate(("const", "a", "b")):
        assert got[term]["estimate"] == pytest.approx(beta[i]) and got[term]["error"] == pytest.approx(error[i]) and got[term]["n"] == n


def test_student_tail():
    for t, df, p in ((2.0, 10, 0.07338803477074037), (0.5, 3, 1 - 2 / math.pi * (0.5 / math.sqrt(3) / (1 + 0.25 / 3) + math.atan(0.5 / math.sqrt(3)))), (12.706204736432095, 1, 0.05)):
        assert inference.student_p(t, df) == pytest.approx(p, rel=1e-7)
    assert inference.normal_p(1.959963984540054) == pytest.approx(0.05)


# --- options and ordered operators -------------------------------------------------------------------------------


def test_instrument_names(spark):
    names = ["BTC-28MAR25-60000-C", "BTC-1APR25-60000-P", "BTC-PERPETUAL", "BTC-10XYZ21-25000-C", "BTC-31MAR22-39000-C-X", "BTC-31JAN21-15000d-C", "BTC-31JAN21-15000-X", None, ""]
    df = options.with_instrument(spark.createDataFrame([(n,) for n in names], "instrument_name string"))
    got = {r["instrument_name"]: (r["expiration"], r["strike"], r["callput"]) for r in df.collect()}
    assert got[names[0]] == (dt.date(2025, 3, 28), 60000.0, "C") and got[names[1]] == (dt.date(2025, 4, 1), 60000.0, "P")
    assert all(got[n] == (None, None, None) for n in names[2:])


def test_parity_forward_falls_back_and_prefers_the_lower_strike(spark):
    e1, e2 = D + dt.timedelta(30), D + dt.timedelta(60)
    rows = [(D, e1, 90.0, "C", 12.0, 100.0), (D, e1, 90.0, "P", 3.0, 100.0), (D, e1, 110.0, "C", 1.0, 100.0), (D, e1, 110.0, "P", 30.0, 100.0), (D, e2, 100.0, "C", 5.0, 100.0)]
    df = spark.createDataFrame(rows, "date date, expiration date, strike double, callput string, settlementprice double, spot_price double")
    got = {(r["expiration"], r["strike"]): r["forward_price"] for r in options.parity_forward(df).collect()}
    assert got[e1, 110.0] == 99.0 and got[e2, 100.0] == 100.0


def test_runs_merge_below_sixty_days(spark):
    days, d = [], D
    for n, gap in ((14, 59), (20, 60), (15, 0)):
        days += [(("s", d + dt.timedelta(i)), True) for i in range(n)] + [(("s", d + dt.timedelta(n + i)), False) for i in range(gap - 1)]
        d += dt.timedelta(n - 1 + gap)
    df = spark.createDataFrame([(*k, f) for k, f in days], "key string, day date, flag boolean")
    found = ordered.runs(df, F.col("flag"), "day", ["key"])
    assert sorted(r["n_rows"] for r in found.collect()) == [14, 15, 20]
    merged = ordered.merged_runs(found, ["key"], 60)
    assert sorted((r["n_rows"], r["n_runs"]) for r in merged.collect()) == [(15, 1), (34, 2)]
    assert [(r["n_rows"], r["rank"]) for r in ordered.longest_runs(found, ["key"], 3, 15).orderBy("rank").collect()] == [(20, 1), (15, 2)]


def test_bins_equal_pandas(spark):
    v = [1.0, 1.0, 3.0, 3.0, 3.0, 7.0, 7.0, 9.0, 10.0, 11.0]
    df = spark.createDataFrame([("k", x) for x in v] + [("k", None)], "key string, x double")
    got = ordered.quantile_bins(df, "x", "bin", ["low", "mid", "high"], ["key"]).orderBy("x").collect()
    want = pd.qcut(pd.Series(v), 3, labels=["low", "mid", "high"]).tolist()
    assert [r["bin"] for r in got if r["x"] is not None] == want and [r["bin"] for r in got if r["x"] is None] == [None]


def test_stars_and_attrition(spark):
    df = spark.createDataFrame([(0.001,), (0.03,), (0.08,), (0.5,), (None,)], "p double")
    assert [r[0] for r in df.select(panel.stars(F.col("p"))).collect()] == ["***", "**", "*", "", ""]
    steps = [("known", F.col("p").isNotNull()), ("small", F.coalesce(F.col("p") < 0.05, F.lit(False)))]
    assert [(r["n_before"], r["n_after"]) for r in options.attrition(df, steps).orderBy("step_no").collect()] == [(5, 4), (4, 2)]


def test_correlations_of_constant_fields(spark, tmp_path):
    rng = np.random.default_rng(12)
    x, y = rng.normal(0, 1, 90), rng.normal(0, 1, 90)
    rows = [("plain", float(a), float(a + b)) for a, b in zip(x, y, strict=True)] + [("plain", 5.0, None), ("plain", None, 5.0)]
    rows += [("flat", 14.37, float(b)) for b in y] + [("both", 0.1, 0.3)] * 7 + [("one", 1.0, 2.0)] + [("apart", 1.0, None), ("apart", None, 1.0), ("apart", 2.0, None)]
    rows += [("small", float(a) * 1e-100, float(a + b) * 1e-100) for a, b in zip(x, y, strict=True)] + [("smaller", i * 1e-200, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r["k"]: (r["n"], r["correlation"]) for r in panel.correlations(df, ["x", "y"], ["k"]).collect()}
    r = np.corrcoef(x, x + y)[0, 1]
    assert got.pop("plain") == (90, pytest.approx(r)) and got.pop("small") == (90, pytest.approx(r)) and got.pop("apart") == (0, None)
    assert {k: n for k, (n, _) in got.items()} == {"flat": 90, "both": 7, "one": 1, "smaller": 3} and all(math.isnan(c) for _, c in got.values())

    # q_corr beside its SQL: a feed whose fng never changes, one with one day, one without rv
    def day(source, i, **odd):
        values = {c: float(rng.normal(20, 2)) for c in panels.FIELDS} | odd
        return {"source": source, "date": D + dt.timedelta(i), **values, "loaded_at": dt.datetime(2024, 6, 1)}

    feeds = [day("flat", i, fng=97.0) for i in range(40)] + [day("one", 0)] + [day("norv", i, rv=float("nan")) for i in range(5)] + [day("plain", i) for i in range(40)]
    pd.DataFrame(feeds).to_parquet(tmp_path / "cleaned_auxiliary.parquet", coerce_timestamps="us")
    ok, said = oracle.compare(spark, oracle.connect(str(tmp_path)), panels.q_corr, panels.SQL["q_corr"], str(tmp_path))
    assert ok and said == "24 rows", said


def test_robust_ols_equals_plain_sandwiches(spark):
    rng = np.random.default_rng(6)
    n, lags = 80, 5
    x = np.column_stack([np.ones(n), rng.normal(0, 1, (n, 2))])
    y = x @ [0.5, 2.0, -1.0] + np.convolve(rng.normal(0, 1, n + 3), np.ones(4) / 2, "valid")
    df = spark.createDataFrame([("a", i, float(y[i]), float(x[i, 1]), float(x[i, 2])) for i in range(n)], "k string, o int, y double, u double, v double")
    got = {r["term"]: r for r in inference.robust_ols(df, "k", "o", "y", {"u": F.col("u"), "v": F.col("v")}, lags).collect()}
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ y
    h = x * (y - x @ b)[:, None]
    meat = h.T @ h + sum((1 - m / (lags + 1)) * (h[m:].T @ h[:-m] + h[:-m].T @ h[m:]) for m in range(1, lags + 1))
    error = np.sqrt(np.diag(bread @ meat @ bread))
    for i, term in enumerate(("const", "u", "v")):
        assert got[term]["estimate"] == pytest.approx(b[i]) and got[term]["error"] == pytest.approx(error[i])


def test_statistics_of_draws_count_failures(spark):
    values = [None, 1.0, -1.0, 2.0, 3.0, 0.0, None]
    df = spark.createDataFrame([("k", -1, 1.5), *[("k", i, v) for i, v in enumerate(values)], ("lost", -1, None), ("lost", 0, None)], "key string, draw int, mean double")
    got = {r["key"]: r for r in inference.statistic_bands(df, ["key"], F.col("mean") * 2).collect()}
    drawn = np.array([v for v in values if v is not None]) * 2
    r = got["k"]
    assert r["estimate"] == 3.0 and r["n_ok"] == 5 and r["n_failed"] == 2 and r["share_low"] == pytest.approx(0.4) and r["p"] == pytest.approx(0.8)
    assert [r["low"], r["high"]] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist()) and r["error"] == pytest.approx(drawn.std(ddof=1))
    assert got["lost"]["estimate"] is None and got["lost"]["p"] is None and got["lost"]["n_failed"] == 1
    assert inference.statistic_bands(df.where("false"), ["key"], F.col("mean")).count() == 0


def test_joint_wald_equals_numpy(spark):
    rng = np.random.default_rng(4)
    drawn = rng.normal(0, 1, (60, 3)) @ np.array([[1.0, 0.3, 0.0], [0.0, 0.8, 0.2], [0.0, 0.0, 0.5]]) + [0.4, -0.2, 0.1]
    rows = [(-1, 0.4, -0.2, 0.1), *[(i, *map(float, d)) for i, d in enumerate(drawn)], (60, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "draw int, a double, b double, c double")
    (got,) = inference.joint_wald(df, ("a", "b", "c")).collect()
    inverse, e = np.linalg.inv(np.cov(drawn.T)), np.array([0.4, -0.2, 0.1])
    wald = e @ inverse @ e
    own = np.einsum("ni,ij,nj->n", drawn - e, inverse, drawn - e)
    assert got["wald"] == pytest.approx(wald) and got["p"] == pytest.approx((1 + (own >= wald).sum()) / 61)
    assert (got["n_ok"], got["n_failed"]) == (60, 1)
    assert inference.joint_wald(df.where("false"), ("a", "b", "c")).count() == 0


def test_draws_are_those_of_the_bands(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, i, float(v)) for k in "ab" for i, v in enumerate(rng.normal(0, 1, 40))] + [("a", 99, None)], "k string, o int, v double")
    draws = inference.bootstrap_draws(df, "k", "o", "v", 7, 50)
    assert draws.count() == 2 * 51
    bands = {r["key"]: r for r in inference.statistic_bands(draws.withColumnRenamed("k", "key"), ["key"], F.col("mean")).collect()}
    for r in inference.bootstrap_means(df, "k", "o", "v", 7, 50).collect():
        b = bands[r["k"]]
        assert [b["estimate"], b["low"], b["high"], b["error"]] == pytest.approx([r["mean"], r["low"], r["high"], r["error"]])


def test_interpolated_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(0, 1, 301).round(2), "b": np.array([5.0]), "c": np.array([1.0, 2.0]), "d": np.repeat([3.0, -3.0, 0.0], [5, 1, 2])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None), (None, 1.0), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    at = (0.0, 0.05, 0.5, 0.95, 1.0)
    frequencies = skew.value_frequencies(df, {"k": F.col("k")}, F.col("v"))
    got = {(r["k"], r["p"]): r["percentile"] for r in skew.interpolated_percentiles(frequencies, ["k"], at).collect()}
    assert set(got) == {(k, p) for k in values for p in at}
    for k, vs in values.items():
        assert [got[k, p] for p in at] == pytest.approx(np.quantile(vs, at).tolist())
    assert skew.interpolated_percentiles(frequencies.where("false"), ["k"], at).count() == 0
