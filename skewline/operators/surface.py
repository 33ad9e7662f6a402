"""Volatility smiles: at-the-money variance, monotone term structure, calibration per slice, fit errors, implied densities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.functions import special as S


def atm_variance(options: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, tau, n_options, theta): total variance at the forward of each slice with at least ``least`` options.

    Linear between the nearest log-moneynesses on either side of 0; where all lie on one side, that of the nearest.
    Input: keys, ``tau``, ``log_moneyness``, ``iv``.
    """
    k, w = F.col("log_moneyness"), F.col("iv") * F.col("iv") * F.col("tau")
    rows = options.where("iv > 0 and tau > 0 and log_moneyness is not null").select(*keys, "tau", k.alias("_k"), w.alias("_w"))
    sides = rows.groupBy(*keys).agg(
        F.min("tau").alias("tau"),
        F.count(F.lit(1)).alias("n_options"),
        F.max(F.when(F.col("_k") <= 0, F.struct("_k", "_w"))).alias("_a"),
        F.min(F.when(F.col("_k") >= 0, F.struct("_k", "_w"))).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    between = a["_w"] + (b["_w"] - a["_w"]) * F.try_divide(-a["_k"], b["_k"] - a["_k"])
    theta = F.when(a.isNull(), b["_w"]).when(b.isNull() | (a["_k"] == b["_k"]), a["_w"]).otherwise(between)
    return sides.where(F.col("n_options") >= least).select(*keys, "tau", "n_options", theta.alias("theta"))


def monotone(theta: DataFrame, day: list[str], order: str = "tau", value: str = "theta") -> DataFrame:
    """``theta`` with ``value`` made non-decreasing in ``order`` within each day: the least-squares (pooled) fit.

    The pooled value at i is the greatest over j <= i of the least over k >= i of the mean of j..k; a day has few maturities,
    so the means of all stretches are taken from prefix sums held in an array.
    """
    over = Window.partitionBy(*day)
    listed = theta.withColumns(
        {
            "_all": F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).over(over)),
            "_i": F.row_number().over(over.orderBy(order, value)) - 1,
        }
    )
    mean = lambda a, j, k: F.aggregate(F.slice(a, j + 1, k - j + 1), F.lit(0.0), lambda s, e: s + e["v"]) / (k - j + 1)
    i, a = F.col("_i"), F.col("_all")
    pooled = F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: F.array_min(F.transform(F.sequence(i, F.size(a) - 1), lambda k: mean(a, j, k)))))
    return listed.withColumn(value, pooled).drop("_all", "_i")


def _model(p: np.ndarray, k: np.ndarray, theta: float) -> np.ndarray:
    rho, eta, gamma = 0.99 * np.tanh(p[0]), np.exp(np.clip(p[1], -6, 3)), 0.05 + 0.9 / (1 + np.exp(-p[2]))
    t = max(theta, 1e-8)
    phi = eta / (t**gamma * (1 + t) ** (1 - gamma))
    return theta / 2 * (1 + rho * phi * k + np.sqrt((phi * k + rho) ** 2 + 1 - rho * rho))


def fit_slice(k: np.ndarray, iv: np.ndarray, tau: float, theta: float) -> tuple[float, float, float, float]:
    """(rho, eta, gamma, rmse) of one slice: damped least squares on volatility from three starts, parameters kept in
    bounds by their maps, the butterfly bound by a penalty."""
    best = (np.inf, None)
    for start in ((-0.3, 0.0, 0.0), (0.3, 0.0, 0.0), (-0.8, 0.7, 0.0)):
        p, damp = np.array(start), 1e-2

        def residual(p: np.ndarray) -> np.ndarray:
            rho, eta, gamma = 0.99 * np.tanh(p[0]), np.exp(np.clip(p[1], -6, 3)), 0.05 + 0.9 / (1 + np.exp(-p[2]))
            phi = eta / (max(theta, 1e-8) ** gamma * (1 + theta) ** (1 - gamma))
            over = max(theta * phi * (1 + abs(rho)) - 4, 0) + max(theta * phi * phi * (1 + abs(rho)) - 4, 0)
            return np.concatenate([np.sqrt(np.maximum(_model(p, k, theta), 1e-12) / tau) - iv, [10 * over, 1e-3 * p[2]]])

        r = residual(p)
        for _ in range(60):
            jac = np.stack([(residual(p + h) - r) / 1e-6 for h in 1e-6 * np.eye(3)], axis=1)
            step = np.linalg.solve(jac.T @ jac + damp * np.eye(3), -jac.T @ r)
            new = residual(p + step)
            if new @ new < r @ r:
                done = r @ r - new @ new < 1e-12 * (r @ r)
                p, r, damp = p + step, new, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e8:
                    break
        if r @ r < best[0]:
            best = (r @ r, p)
    p = best[1]
    error = np.sqrt(np.maximum(_model(p, k, theta), 1e-12) / tau) - iv
    return float(0.99 * np.tanh(p[0])), float(np.exp(np.clip(p[1], -6, 3))), float(0.05 + 0.9 / (1 + np.exp(-p[2]))), float(np.sqrt(np.mean(error**2)))


def calibrated(options: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, tau, n_options, theta, rho, eta, gamma, rmse, status): smile parameters of every slice.

    Each slice (keys: day and expiry) is a group of its own, so a day's slices are fitted side by side; a slice holds the contracts of one
    expiry and day. ``status`` is ``ok``, or what went wrong.
    """
    theta = atm_variance(options, keys, least)
    rows = options.where("iv > 0 and tau > 0 and log_moneyness is not null").select(*keys, "log_moneyness", "iv").join(theta, keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tau double, n_options bigint, theta double, rho double, eta double, gamma double, rmse double, status string"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        try:
            found, status = fit_slice(frame["log_moneyness"].to_numpy(), frame["iv"].to_numpy(), float(r["tau"]), float(r["theta"])), "ok"
        except (np.linalg.LinAlgError, FloatingPointError, ValueError) as error:
            found, status = (None,) * 4, str(error)
        return pd.DataFrame([[*(r[k] for k in keys), r["tau"], r["n_options"], r["theta"], *found, status]], columns=[*keys, "tau", "n_options", "theta", "rho", "eta", "gamma", "rmse", "status"])

    return rows.groupBy(*keys).applyInPandas(fit, schema)


def smile_density(theta: Column, rho: Column, phi: Column, points: int = 161, width: float = 1.5) -> Column:
    """Array of (r, q): the density of gross returns implied by a smile, on log-moneynesses within ``width``.

    Second difference of the undiscounted call prices (forward 1) over strikes exp(k), on its unequal steps; negative
    values are set to 0. The tails beyond the grid are left out.
    """
    from skewline.functions.curves import let, linspace

    k = linspace(-width, width, points)

    def prices(theta: Column, rho: Column, phi: Column) -> Column:
        return F.transform(k, lambda z: F.struct(F.exp(z).alias("r"), S.black_price(F.lit(1.0), F.exp(z), F.lit(1.0), F.sqrt(S.ssvi_variance(z, theta, rho, phi)), F.lit(True)).alias("c")))

    def second(a: Column) -> Column:
        def at(i: Column) -> Column:
            lo, mid, hi = a[i - 1], a[i], a[i + 1]
            h0, h1 = mid["r"] - lo["r"], hi["r"] - mid["r"]
            q = 2 * ((hi["c"] - mid["c"]) / h1 - (mid["c"] - lo["c"]) / h0) / (h0 + h1)
            return F.struct(mid["r"].alias("r"), F.greatest(q, F.lit(0.0)).alias("q"))

        return F.transform(F.sequence(F.lit(1), F.lit(points - 2)), at)

    return let(second, a=let(prices, theta=theta, rho=rho, phi=phi))
