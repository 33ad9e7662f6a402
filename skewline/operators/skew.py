"""Per-key results where a few keys hold most records (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_code(column: Column) -> Column:
    """'C' or 'P' however spelled: case and blanks don't count; null stays null."""
    return F.upper(F.trim(column))


def value_frequencies(df: DataFrame, keys: dict[str, Column], value: Column, weight: Column | None = None) -> DataFrame:
    """Rows compressed to (key, value, rows, weight): the table all per-key results are derived from.

    The group is (key, value), so the rows of one key spread over as many tasks as it has values, and combining on
    the map side leaves at most one row per key, value and input task. ``value`` may be null (NaN counts as
    null); null keys stay, as keys of their own.
    """
    value = value.cast("double")
    picked = df.select(
        *[c.alias(k) for k, c in keys.items()],
        F.when(~F.isnan(value), value).alias("_value"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("_weight"),
    )
    return picked.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_weight").alias("_weight"))


def key_totals(frequencies: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, rows with a value, distinct values, mode (ties: the smallest), minimum, maximum, weighted mean."""
    has = F.col("_value").isNotNull()
    product = F.sum(F.when(has, F.col("_value") * F.col("_weight")))
    weights = F.sum(F.when(has & F.col("_weight").isNotNull(), F.col("_weight")))
    return frequencies.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("_rows"))), F.lit(0)).alias("n_values"),
        F.count("_value").alias("n_distinct"),
        F.max(F.when(has, F.struct("_rows", (-F.col("_value")).alias("_back"), "_value")))["_value"].alias("mode"),
        F.min("_value").alias("minimum"),
        F.max("_value").alias("maximum"),
        F.when(weights > 0, product / weights).alias("weighted_mean"),
    )


def key_percentiles(frequencies: DataFrame, keys: list[str], probabilities: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, p, percentile): exact percentiles, the smallest value whose cumulative rows reach p times all (discrete, type 1)."""
    ranks = [F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("_all")), F.lit(1)).alias("_rank"), F.lit(1.0).alias("_share")) for p in probabilities]
    return _at_ranks(frequencies, keys, F.array(*ranks)).select(*keys, "p", F.col("_value").alias("percentile"))


def interpolated_percentiles(frequencies: DataFrame, keys: list[str], probabilities: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, p, percentile): exact percentiles with linear interpolation between the two ranks around 1 + p (n - 1) (type 7)."""
    ranks = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("_all") - 1)
        low, part = F.floor(at), at - F.floor(at)
        ranks += [F.struct(F.lit(float(p)).alias("p"), (low + 1).alias("_rank"), (1 - part).alias("_share")), F.struct(F.lit(float(p)).alias("p"), (low + 2).alias("_rank"), part.alias("_share"))]
    found = _at_ranks(frequencies, keys, F.filter(F.array(*ranks), lambda r: r["_share"] > 0))
    return found.groupBy(*keys, "p").agg(F.sum(F.col("_value") * F.col("_share")).alias("percentile"))


def _at_ranks(frequencies: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """(keys, p, _share, _value): the values at ``ranks``, an array of (p, _rank, _share) that may refer to a key's rows ``_all``.

    A key's values are cut into logarithmic buckets of a quarter of a percent. Cumulative counts of the buckets show which one
    holds each rank; only that bucket's values are then put in order. So no window holds all values of a hot key:
    the first holds a key's buckets (bounded by the range of a double), the second one bucket.
    """
    bucket = _ordered_bucket(F.col("_value"))
    rows = frequencies.where("_value is not null").where(_all_present(keys)).select(*keys, "_value", "_rows", bucket.alias("_bucket"))
    by_bucket = rows.groupBy(*keys, "_bucket").agg(F.sum("_rows").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    wanted = (
        by_bucket.withColumn("_upto", F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("_in").over(Window.partitionBy(*keys)))
        .select(*keys, "_bucket", "_upto", "_in", F.inline(ranks))
        .where("_rank <= _upto and _rank > _upto - _in")
        .select(*keys, "_bucket", "p", "_share", (F.col("_rank") - (F.col("_upto") - F.col("_in"))).alias("_rest"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_cum", F.sum("_rows").over(inside))
    return (
        ranked.join(wanted, [*keys, "_bucket"])
        .where("_rest <= _cum and _rest > _cum - _rows")
        .select(*keys, "p", "_share", "_value")
    )


def _ordered_bucket(value: Column) -> Column:
    """Number of a logarithmic bucket that grows with the value; negative values mirror the positive, 0 has its own."""
    step = F.floor(F.least(F.log(F.abs(value)), F.lit(800.0)) * 400) + F.lit(1_000_000)
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0).cast("bigint"))


def _all_present(keys: list[str]) -> Column:
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return present


def heavy_keys(frequencies: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys (none of their fields null) with at least ``share`` of all rows, those with null keys counted in.

    The total is the sum of the keys' totals, a scalar subquery over the same compressed rows: whether a key has null fields is
    aggregated with it, so no filter makes the two read the input apart. Result: keys, ``n_rows``. No rows give no keys.
    """
    totals = frequencies.groupBy(*keys).agg(F.sum("_rows").alias("n_rows"), F.bool_and(_all_present(keys)).alias("_present"))
    total = totals.agg(F.sum("n_rows").cast("double").alias("total")).scalar()
    return totals.where("_present").where(F.col("n_rows") >= F.lit(share) * total).drop("_present")
