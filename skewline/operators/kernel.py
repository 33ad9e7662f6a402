"""Conditional pricing kernel: an exponential family in R, R^2 and R^3 with coefficients affine in the day's state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.session import written


def _parts(q: np.ndarray, p: np.ndarray, z: np.ndarray, x: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over days of the cross-entropy of q against m p, with gradient and Hessian in theta (terms x states).

    m is exp(b s + c s^2 + d s^3), s = (R - 1.2) / 0.8, scaled to mean one under p: minus the mean of the exponent
    under q plus the log of its partition, which is convex in theta.
    """
    h = np.diff(x)
    weight = np.concatenate(([h[0] / 2], (h[1:] + h[:-1]) / 2, [h[-1] / 2]))
    s = (x - 1.2) / 0.8
    t = np.stack([s, s**2, s**3])
    coefficients = z @ theta.reshape(3, -1).T
    e = coefficients @ t
    top = e.max(axis=1, keepdims=True)
    m = np.exp(e - top) * (p * weight)
    total = m.sum(axis=1, keepdims=True)
    m /= total
    under_q, under_m = (q * weight) @ t.T, m @ t.T
    value = float(np.sum(top[:, 0] + np.log(total[:, 0]) - np.sum(coefficients * under_q, axis=1)))
    gradient = np.einsum("ni,nj->ij", under_m - under_q, z).ravel()
    spread = np.einsum("ng,ig,jg->nij", m, t, t) - under_m[:, :, None] * under_m[:, None, :]
    hessian = np.einsum("nij,nk,nl->ikjl", spread, z, z).reshape(theta.size, theta.size)
    return value, gradient, hessian


def fit_kernel(days: DataFrame, q: str, p: str, states: list[str], x: list[float], iterations: int = 30, tolerance: float = 1e-9) -> tuple[np.ndarray, float, int]:
    """(theta, mean cross-entropy, days): Newton steps with halving over all days of ``days`` (curves q and p, state columns).

    Every step is one distributed sum: tasks add up value, gradient and Hessian of the days they read, and hand on one row of
    numbers each. The rows of theta are the coefficients of s, s^2 and s^3, its columns the constant and the states.
    """
    grid, k = np.array(x), len(states) + 1
    rows = days.select(F.col(q).alias("_q"), F.col(p).alias("_p"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in states]).alias("_z")).where(
        "_q is not null and _p is not null and forall(_z, v -> v is not null)"
    )
    # every step reads the days again: they are written once
    rows = written(rows, "kernel-days")

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            value, gradient, hessian, n = 0.0, np.zeros(3 * k), np.zeros((3 * k, 3 * k)), 0
            for f in frames:
                if len(f):
                    a, b, c = _parts(np.stack(f["_q"]), np.stack(f["_p"]), np.stack(f["_z"]), grid, theta)
                    value, gradient, hessian, n = value + a, gradient + b, hessian + c, n + len(f)
            yield pd.DataFrame({"value": [value], "gradient": [gradient], "hessian": [hessian.ravel()], "n": [n]})

        size = 3 * k
        total = rows.mapInPandas(add, "value double, gradient array<double>, hessian array<double>, n bigint").agg(
            F.sum("value").alias("value"), F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("gradient")[i]) for i in range(size)]).alias("gradient"), F.array(*[F.sum(F.col("hessian")[i]) for i in range(size * size)]).alias("hessian"),
        ).first()
        n = total["n"] or 0
        return (total["value"] or 0.0) / max(n, 1), np.array(total["gradient"], float) / max(n, 1), np.array(total["hessian"], float).reshape(size, size) / max(n, 1), n

    theta = np.zeros(3 * k)
    value, gradient, hessian, n = sums(theta)
    for _ in range(iterations if n else 0):
        if np.abs(gradient).max() < tolerance:
            break
        step = -np.linalg.solve(hessian + 1e-10 * np.eye(3 * k), gradient)
        scale = 1.0
        while True:
            new = sums(theta + scale * step)
            if new[0] <= value + 1e-14 or scale < 1e-4:
                break
            scale /= 2
        theta = theta + scale * step
        value, gradient, hessian, n = new
    return theta.reshape(3, k), value, n
