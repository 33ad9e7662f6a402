"""Inference: circular block bootstrap by prefix sums, least squares with serial-correlation-robust errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_start(index: Column, n: Column) -> Column:
    """Start row of a block in a series of n rows: a linear congruential step of the block's number, below 2^31, mod n."""
    return (F.lit(1103515245).cast("bigint") * index + 12345) % 2147483648 % n


def _drawn(df: DataFrame, key: str, order: str, value: str, block: int, draws: int, label: str | None) -> tuple[DataFrame, DataFrame]:
    """(draws' means, totals) of ``value`` by key and label; see ``bootstrap_means``."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(value).cast("double").alias("_v"), (F.col(label) if label else F.lit("")).alias("_label"))
    labels = rows.select("_key", "_label").distinct()
    by = Window.partitionBy("_key")
    numbered = rows.withColumns({"_i": F.row_number().over(by.orderBy("_order")) - 1, "_n": F.count(F.lit(1)).over(by)})
    if label:
        # one series per label over the same rows: value and count are 0 where the label is another
        wanted = labels.withColumnRenamed("_label", "_of")
        numbered = numbered.join(wanted, "_key")
        hit = F.col("_label").eqNullSafe(F.col("_of"))
    else:
        numbered, hit = numbered.withColumn("_of", F.lit("")), F.lit(True)
    by_of = Window.partitionBy("_key", "_of").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    prefix = numbered.select(
        "_key", "_of", "_i", "_n", F.sum(F.when(hit, F.col("_v")).otherwise(0.0)).over(by_of).alias("_s"), F.sum(F.when(hit, 1).otherwise(0)).over(by_of).alias("_c")
    )
    totals = prefix.where("_i = _n - 1").select("_key", "_of", "_n", F.col("_s").alias("_total"), F.col("_c").alias("_count"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    most = totals.agg(F.max(blocks).alias("m")).scalar()
    each = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    start = block_start(F.col("draw") * most + F.col("block"), F.col("_n"))
    length = F.least(F.lit(block), F.col("_n") - F.col("block") * block)
    each = each.withColumn("_a", start).withColumn("_b", F.col("_a") + length - 1)
    ends = F.array(
        F.struct((F.col("_a") - 1).alias("_i"), F.lit(-1).alias("_sign")),
        F.struct((F.col("_b") % F.col("_n")).alias("_i"), F.lit(1).alias("_sign")),
    )
    looked = each.select("_key", "_of", "draw", F.when(F.col("_b") >= F.col("_n"), F.lit(1)).otherwise(0).alias("_round"), "_total", "_count", F.inline(ends))
    looked = looked.withColumn("_round", F.when(F.col("_sign") > 0, F.col("_round")).otherwise(0))
    sums = looked.join(prefix.select("_key", "_of", "_i", "_s", "_c"), ["_key", "_of", "_i"], "left")
    part = lambda total, own: F.sum(F.col("_sign") * F.coalesce(F.col(own), F.lit(0)) + F.col("_round") * F.col(total))
    means = sums.groupBy("_key", "_of", "draw").agg(part("_total", "_s").alias("_sum"), part("_count", "_c").alias("_rows")).withColumn("_mean", F.try_divide("_sum", "_rows"))
    return means, totals


def bootstrap_means(df: DataFrame, key: str, order: str, value: str, block: int = 27, draws: int = 200, label: str | None = None) -> DataFrame:
    """(key[, label], n, mean, low, high, error): the mean of ``value`` and its band over circular block draws.

    Null values are left out beforehand. A draw takes ceil(n / block) blocks from row u mod n on, around the end,
    the last one shortened to n rows in all. Its sum comes from two prefix sums a block, so no draw touches its rows
    one by one: draws x blocks lookups per key, whatever the length. With ``label``, rows keep theirs, and means are those
    of each label among the drawn rows; a draw without the label has none. low and high are the 2.5 and 97.5 percentiles, error the
    draws' sample deviation.
    """
    means, totals = _drawn(df, key, order, value, block, draws, label)
    bands = means.groupBy("_key", "_of").agg(F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"), F.stddev_samp("_mean").alias("error"))
    out = totals.join(bands, ["_key", "_of"])
    return out.select(
        F.col("_key").alias(key), *([F.col("_of").alias(label)] if label else []), F.col("_count").alias("n"), (F.col("_total") / F.col("_count")).alias("mean"),
        F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "error",
    )


def bootstrap_draws(df: DataFrame, key: str, order: str, value: str, block: int = 27, draws: int = 200, label: str | None = None) -> DataFrame:
    """(key[, label], draw, mean): the means of ``bootstrap_means`` draw by draw, those over all rows as draw -1.

    Keys with equally many rows share their blocks, so the means of one draw belong together. A draw without the label has a null mean.
    """
    means, totals = _drawn(df, key, order, value, block, draws, label)
    whole = totals.select("_key", "_of", F.lit(-1).alias("draw"), (F.col("_total") / F.col("_count")).alias("_mean"))
    rows = means.select("_key", "_of", "draw", "_mean").unionByName(whole)
    return rows.select(F.col("_key").alias(key), *([F.col("_of").alias(label)] if label else []), "draw", F.col("_mean").alias("mean"))


def statistic_bands(draws: DataFrame, keys: list[str], statistic: Column) -> DataFrame:
    """(keys, estimate, low, high, error, n_ok, n_failed, share_low, p): a statistic of each draw's means, one row per draw.

    The estimate is that of draw -1. Draws whose statistic is null have failed and are counted, not used. ``share_low`` is the share
    of draws at or below zero, ``p`` twice the smaller share on either side of zero, one at most.
    """
    rows = draws.select(*keys, "draw", statistic.cast("double").alias("_s"))
    drawn = F.when(F.col("draw") >= 0, F.col("_s"))
    out = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("draw") < 0, F.col("_s"))).alias("estimate"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("_p"), F.stddev_samp(drawn).alias("error"),
        F.count(drawn).alias("n_ok"), F.count_if((F.col("draw") >= 0) & F.col("_s").isNull()).alias("n_failed"),
        F.avg((drawn <= 0).cast("double")).alias("share_low"), F.avg((drawn >= 0).cast("double")).alias("_above"),
    )
    p = F.when(F.col("n_ok") > 0, F.least(F.lit(1.0), 2 * F.least("share_low", "_above")))
    return out.select(*keys, "estimate", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "error", "n_ok", "n_failed", "share_low", p.alias("p"))


def joint_wald(draws: DataFrame, terms: tuple[str, str, str]) -> DataFrame:
    """(wald, p, n_ok, n_failed): d' S^-1 d of three terms d, with S the covariance of the draws.

    One row per draw, that of the estimate as draw -1. p counts the draws whose own distance from the estimate, under the same S, is
    as great: (1 + count) / (draws + 1). Draws with a null term have failed. No inverse, no result.
    """
    d = [F.col(t) for t in terms]
    whole = F.lit(True)
    for t in d:
        whole = whole & t.isNotNull()
    drawn = whole & (F.col("draw") >= 0)
    own = lambda i: F.when(drawn, d[i])
    moments = draws.agg(
        *[F.covar_samp(own(i), own(j)).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)], *[F.max(F.when(F.col("draw") < 0, d[i])).alias(f"e{i}") for i in range(3)],
        F.count_if((F.col("draw") >= 0) & ~whole).alias("n_failed"),
    )
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    minor = lambda i, j: s((i + 1) % 3, (j + 1) % 3) * s((i + 2) % 3, (j + 2) % 3) - s((i + 1) % 3, (j + 2) % 3) * s((i + 2) % 3, (j + 1) % 3)
    determinant = sum((s(0, j) * minor(0, j) for j in range(3)), F.lit(0.0))
    form = lambda v: F.try_divide(sum((v[i] * v[j] * minor(i, j) for i in range(3) for j in range(3)), F.lit(0.0)), determinant)
    rows = draws.where(drawn).select(*terms).crossJoin(F.broadcast(moments))  # one row
    e = [F.col(f"e{i}") for i in range(3)]
    rows = rows.select("n_failed", form(e).alias("wald"), form([a - b for a, b in zip(d, e, strict=True)]).alias("_own"))
    return rows.groupBy("wald", "n_failed").agg(F.count(F.lit(1)).alias("n_ok"), ((F.count_if(F.col("_own") >= F.col("wald")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def normal_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def robust_ols(df: DataFrame, key: str, order: str, y: str, regressors: dict[str, Column], lags: int = 27, by_date: bool = False) -> DataFrame:
    """(key, term, n, estimate, error, t, p, r2): least squares per key with Bartlett-weighted errors of ``lags`` lags.

    by_date False: Newey and West over rows in ``order``, no small-sample correction, normal p. True: Driscoll and Kraay:
    scores are summed by ``order`` (a date) first, p from Student's t with dates less terms degrees of freedom.

    Two passes of sums: the cross products, solved to coefficients in a row of k numbers per key; then residual scores and
    their lagged products, by ``lag`` over the key's rows (or dates). Only k by k matrices reach Python. Rows with a null in
    any variable are left out. A key without a solution has null errors.
    """
    names = ["const", *regressors]
    k = len(names)
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(regressors.values(), 1)]).na.drop()
    products = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(k)] + [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k)]
    moments = rows.groupBy("_key").agg(F.array(*products).alias("_m"), F.count(F.lit(1)).alias("_n"), F.var_pop("_y").alias("_var"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.array(frame["_m"].iloc[0])
        xx, xy = m[: k * k].reshape(k, k), m[k * k :]
        return frame.assign(_b=[list(np.linalg.pinv(xx) @ xy)])[["_key", "_m", "_n", "_var", "_b"]]

    kind = dict(rows.dtypes)["_key"]
    fitted = moments.groupBy("_key").applyInPandas(solve, f"_key {kind}, _m array<double>, _n bigint, _var double, _b array<double>")
    joined = rows.join(fitted.select("_key", "_b"), "_key")
    residual = F.col("_y") - sum((F.col(f"_x{i}") * F.col("_b")[i] for i in range(k)), F.lit(0.0))
    scores = joined.withColumn("_u", residual).select("_key", "_order", "_u", *[(F.col(f"_x{i}") * F.col("_u")).alias(f"_h{i}") for i in range(k)])
    squares = scores.groupBy("_key").agg(F.sum(F.col("_u") * F.col("_u")).alias("_rss"))
    if by_date:
        scores = scores.groupBy("_key", "_order").agg(*[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(k)])
    over = Window.partitionBy("_key").orderBy("_order")
    size = F.greatest(F.least(F.lit(lags), F.count(F.lit(1)).over(Window.partitionBy("_key")) - 1), F.lit(0))
    scores = scores.withColumn("_size", size)
    # the lagged scores weighted and added up row by row: k sums of lags, not k by k by lags
    weight = lambda lag: F.greatest(1 - F.lit(float(lag)) / (F.col("_size") + 1), F.lit(0.0))
    before = [sum((weight(m) * F.coalesce(F.lag(f"_h{i}", m).over(over), F.lit(0.0)) for m in range(1, lags + 1)), F.lit(0.0)).alias(f"_g{i}") for i in range(k)]
    lagged = scores.select("_key", *[F.col(f"_h{i}") for i in range(k)], *before)
    h, g = [F.col(f"_h{i}") for i in range(k)], [F.col(f"_g{i}") for i in range(k)]
    meat = [F.sum(h[i] * h[j] + h[i] * g[j] + g[i] * h[j]) for i in range(k) for j in range(k)]
    filling = lagged.groupBy("_key").agg(F.array(*meat).alias("_s"), F.count(F.lit(1)).alias("_t"))

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        bread = np.linalg.pinv(np.array(r["_m"])[: k * k].reshape(k, k))
        cov = bread @ np.array(r["_s"]).reshape(k, k) @ bread
        b, error = np.array(r["_b"]), np.sqrt(np.maximum(np.diag(cov), 0))
        t = np.divide(b, error, out=np.full(k, np.nan), where=error > 0)
        freedom = max(int(r["_t"]) - k, 1)
        p = [None if np.isnan(v) else student_p(v, freedom) if by_date else normal_p(v) for v in t]
        tss = r["_var"] * r["_n"]
        r2 = 1 - r["_rss"] / tss if tss > 1e-20 else None
        return pd.DataFrame({"_key": [r["_key"]] * k, "term": names, "n": int(r["_n"]), "estimate": b, "error": error, "t": t, "p": p, "r2": r2})

    out = fitted.join(filling, "_key").join(squares, "_key").groupBy("_key").applyInPandas(finish, f"_key {kind}, term string, n bigint, estimate double, error double, t double, p double, r2 double")
    return out.withColumnRenamed("_key", key)
