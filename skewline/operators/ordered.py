"""Ordered operators: returns, rolling statistics, filling, binning, runs and sessions, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def log_return(x: Column, order: WindowSpec) -> Column:
    """ln(x / previous x); null at the start and where either isn't above zero."""
    before = F.lag(x).over(order)
    return F.when((x > 0) & (before > 0), F.log(x / before))


def realised_variance(r: Column, order: WindowSpec, rows: int = 30) -> Column:
    """Annualised sum of squared returns over ``rows`` rows; null unless all of them have one."""
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(r).over(frame) == rows, F.sum(r * r).over(frame) * F.lit(YEAR_DAYS / rows))


def rolling_variance(r: Column, order: WindowSpec, rows: int = 252, least: int = 60, scale: float = 1.0) -> Column:
    """Sample variance over the last ``rows`` rows, times ``scale``; null with fewer than ``least`` returns."""
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(r).over(frame) >= least, F.var_samp(r).over(frame) * F.lit(scale))


def rolling_mean(x: Column, order: WindowSpec, rows: int = 27, least: int = 10) -> Column:
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def forward_filled(x: Column, order: WindowSpec) -> Column:
    """The last value that isn't null, up to the row itself."""
    return F.last(x, True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def overlapping_return(x: Column, order: WindowSpec, rows: int = 27) -> Column:
    """x ``rows`` rows ahead over x; rows, not calendar days. Null at the end and where x isn't above zero."""
    ahead = F.lead(x, rows).over(order)
    return F.when((x > 0) & (ahead > 0), ahead / x)


def zscore(x: Column, over: WindowSpec) -> Column:
    """(x - mean) / population deviation; null for a constant column."""
    deviation = F.stddev_pop(x).over(over)
    return F.when(deviation > 1e-12, (x - F.avg(x).over(over)) / deviation)


def quantile_bins(df: DataFrame, value: str, name: str, labels: list[str], keys: list[str]) -> DataFrame:
    """``df`` with the equal-frequency bin of ``value`` within ``keys``.

    Edges are quantiles with linear interpolation; bins are closed on the right, the lowest value belongs to the first. Edges
    are an aggregate per key, joined back (broadcast if small). Null values have no bin.
    """
    shares = [i / len(labels) for i in range(1, len(labels))]
    edges = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("_edges"))
    joined = df.join(edges, keys, "left")
    label = F.when(F.col(value).isNull(), F.lit(None).cast("string"))
    for i, x in enumerate(labels[:-1]):
        label = label.when(F.col(value) <= F.col("_edges")[i], F.lit(x))
    return joined.withColumn(name, label.otherwise(F.lit(labels[-1]))).drop("_edges")


def bin_means(df: DataFrame, by: str, value: str, bins: int, keys: list[str]) -> DataFrame:
    """(keys, bin, n, mean_by, mean_value): means of ``value`` over equal-frequency bins of ``by``."""
    complete = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    binned = quantile_bins(complete, by, "_bin", [f"{i:02d}" for i in range(bins)], keys)
    return binned.groupBy(*keys, F.col("_bin").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(by).alias("mean_by"), F.avg(value).alias("mean_value")
    )


def runs(df: DataFrame, flag: Column, day: str, keys: list[str]) -> DataFrame:
    """(keys, first_day, last_day, n_rows): successive rows, ordered by ``day``, for which ``flag`` holds."""
    rows = df.select(*keys, F.col(day).alias("_day"), F.coalesce(flag, F.lit(False)).alias("_flag"))
    by_key, by_flag = Window.partitionBy(*keys).orderBy("_day"), Window.partitionBy(*keys, "_flag").orderBy("_day")
    islands = rows.withColumn("_island", F.row_number().over(by_key) - F.row_number().over(by_flag)).where("_flag")
    return islands.groupBy(*keys, "_island").agg(F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count(F.lit(1)).alias("n_rows")).drop("_island")


def merged_runs(found: DataFrame, keys: list[str], closer_than: int = 60) -> DataFrame:
    """Runs whose gap to the previous one is under ``closer_than`` days become one; rows add up."""
    order = Window.partitionBy(*keys).orderBy("first_day")
    new = F.coalesce((F.datediff("first_day", F.lag("last_day").over(order)) >= closer_than).cast("int"), F.lit(1))
    sessions = found.withColumn("_new", new).withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sessions.groupBy(*keys, "_session").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_runs")
    ).drop("_session")


def longest_runs(found: DataFrame, keys: list[str], k: int = 3, least: int = 15) -> DataFrame:
    """The ``k`` longest runs of each key with at least ``least`` rows, numbered from 1; ties by first day."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_rows"), "first_day")
    return found.where(F.col("n_rows") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resampled_deviation(df: DataFrame, millis: str, value: str, key: str, minutes: int = 15, least: int = 4) -> DataFrame:
    """(day, n_bars, deviation): sample deviation of log returns between the last values of bars of ``minutes`` within a day.

    Days with fewer than ``least`` returns have none. Bars without rows are skipped. The last value of a bar is that of the
    greatest (time, ``key``); it collapses before the window, whose partitions are days.
    """
    step = minutes * 60_000
    bars = (
        df.where(F.col(value) > 0)
        .groupBy(F.floor(F.col(millis) / step).alias("_bar"))
        .agg(F.max(F.struct(millis, key, value))[value].alias("_x"))
        .withColumn("day", F.timestamp_millis(F.col("_bar") * step).cast("date"))
    )
    r = log_return(F.col("_x"), Window.partitionBy("day").orderBy("_bar"))
    return bars.withColumn("_r", r).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_bars"), F.when(F.count("_r") >= least, F.stddev_samp("_r")).alias("deviation")
    )


def weighted_time(df: DataFrame, day: str, millis: str, weight: str) -> DataFrame:
    """(day, seconds, n_rows): volume-weighted mean time in whole seconds of the epoch."""
    return df.where(F.col(weight) > 0).groupBy(day).agg(
        F.round(F.sum(F.col(weight) * (F.col(millis) / 1000)) / F.sum(weight)).cast("bigint").alias("seconds"), F.count(F.lit(1)).alias("n_rows")
    )


def roll_half_spread(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, half_spread): square root of minus the lag-1 autocovariance of price changes, null where that is positive."""
    by = Window.partitionBy(*keys).orderBy(*order)
    change = F.col(value) - F.lag(value).over(by)
    rows = df.where(F.col(value).isNotNull()).withColumn("_d", change).withColumn("_b", F.lag("_d").over(by))
    cov = F.covar_samp("_d", "_b")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(cov < 0, F.sqrt(-cov)).alias("half_spread"))


def strip_weights(k: Column, forward: Column, order: WindowSpec) -> dict[str, Column]:
    """Weight and width of each strike of a variance strip: |2(1 - ln(K/F)) / K^2|, and half the distance between neighbours."""
    down, up = F.lag(k).over(order), F.lead(k).over(order)
    width = F.when(down.isNull(), up - k).when(up.isNull(), k - down).otherwise((up - down) / 2)
    return {"weight": F.abs(F.lit(2.0) * (1 - F.log(k / forward)) / (k * k)), "width": width}
