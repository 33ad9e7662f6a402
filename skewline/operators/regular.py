"""Irregular readings onto a regular grid (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods taken over from each neighbouring time shard: a cubic between two readings needs one more on either side.
HALO = 2


def period_readings(df: DataFrame, source: str, millis: str, fields: list[str], period_ms: int, key: str | None = None) -> DataFrame:
    """(``_source``, ``_field``, ``_period``, ``_mean``, ``_f1``, ``_f2``, ``_l1``, ``_l2``): one row per source, field and period with any reading.

    ``_mean`` is the mean of the period's readings; ``_f1``, ``_f2`` are its first two readings and ``_l1``, ``_l2`` its last two (from
    the end), as (t, v) with t in periods since the epoch. Readings of one source and time are one, their mean. Null and NaN are none.
    Rows with the same source, time and ``key`` count once.

    Rows are shuffled once, by source and period, whatever the number of fields: a hot source spreads over its periods.
    """
    names = [f"_v{i}" for i in range(len(fields))]
    rows = df.select(
        F.col(f"`{source}`").alias("_source"),
        F.floor(F.col(f"`{millis}`") / F.lit(period_ms)).alias("_period"),
        F.col(f"`{millis}`").alias("_millis"),
        *([F.col(f"`{key}`").alias("_id")] if key else []),
        *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(fields, names, strict=True)],
    ).where("_source is not null and _period is not null").where(" or ".join(f"({n} is not null and not isnan({n}))" for n in names))
    rows = rows.repartition("_source", "_period")
    if key:
        # a null key can't tell rows apart: such rows stand for themselves
        rows = rows.withColumn("_lone", F.when(F.col("_id").isNull(), F.monotonically_increasing_id()))
        rows = rows.groupBy("_source", "_period", "_millis", "_id", "_lone").agg(*[F.max(n).alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(f).alias("_field"), F.when(~F.isnan(n), F.col(n)).alias("_v")) for f, n in zip(fields, names, strict=True)])
    readings = rows.select("_source", "_period", "_millis", F.inline(each)).where("_v is not null")
    keys = ["_source", "_field", "_period"]
    knots = readings.groupBy(*keys, "_millis").agg(F.avg("_v").alias("v"), F.count(F.lit(1)).alias("_n")).withColumn("t", F.col("_millis") / F.lit(float(period_ms)))
    order = Window.partitionBy(*keys).orderBy("_millis")
    placed = knots.withColumns({"_nth": F.row_number().over(order), "_next": F.lead("t", 1).over(order), "_next2": F.lead("t", 2).over(order)})
    one = lambda which: F.max(F.when(which, F.struct("t", "v")))
    return placed.groupBy(*keys).agg(
        (F.sum(F.col("v") * F.col("_n")) / F.sum("_n")).alias("_mean"),
        one(F.col("_nth") == 1).alias("_f1"),
        one(F.col("_nth") == 2).alias("_f2"),
        one(F.col("_next").isNull()).alias("_l1"),
        one(F.col("_next").isNotNull() & F.col("_next2").isNull()).alias("_l2"),
    )


_ENDS = ["_f1", "_f2", "_l1", "_l2"]


def _halo(periods: DataFrame) -> DataFrame:
    """Each shard's neighbouring periods: the last ``HALO`` before it and the first ``HALO`` after it.

    A shard gives its first and last periods (an aggregate over at most one shard); the window over a source's
    shards then passes them on. ``HALO`` shards on either side suffice, as none is without a reading.
    """
    edges = periods.groupBy("_source", "_field", "_shard").agg(F.sort_array(F.collect_list(F.struct("_period", *_ENDS))).alias("_all"))
    edges = edges.select(
        "_source", "_field", "_shard", F.slice("_all", 1, HALO).alias("_first"), F.slice(F.reverse("_all"), 1, HALO).alias("_last")
    )
    order = Window.partitionBy("_source", "_field").orderBy("_shard")
    before, after = order.rowsBetween(-HALO, -1), order.rowsBetween(1, HALO)
    near = F.concat(
        F.slice(F.reverse(F.sort_array(F.flatten(F.collect_list("_last").over(before)))), 1, HALO),
        F.slice(F.sort_array(F.flatten(F.collect_list("_first").over(after))), 1, HALO),
    )
    return (
        edges.withColumn("_near", near)
        .select("_source", "_field", "_shard", F.explode("_near").alias("_near"))
        .select("_source", "_field", "_shard", "_near._period", F.lit(None).cast("double").alias("_mean"), *[f"_near.{c}" for c in _ENDS], F.lit(False).alias("_own"))
    )


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Slope at an inner knot after Fritsch and Butland: 0 at an extreme, else the weighted harmonic mean."""
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Slope at the first (or last) knot: the three-point formula, limited so that the shape is kept."""
    d = ((h0 * 2 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(F.signum(d) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(d) > F.abs(d0) * 3), d0 * 3)
        .otherwise(d)
    )


def regular_series(
    df: DataFrame,
    source: str,
    millis: str,
    fields: list[str],
    period_ms: int = 4 * 3600 * 1000,
    longest_gap: int = 12,
    shard_periods: int = 512,
    key: str | None = None,
) -> DataFrame:
    """A regular series per source and field, from the first to the last period with a reading.

    Result: ``source``, ``field_name``, ``period_start_ms``, ``value``, ``status``. Status ``observed``: the period
    has readings, ``value`` is their mean. ``filled``: it has none, ``value`` is the monotone cubic (shape-preserving
    Hermite, weighted harmonic slopes) through the readings at their own times, at the middle of the period. ``gap``: it lies in
    more than ``longest_gap`` successive empty periods; ``value`` is null. A cubic never spans a gap: slopes beside one are
    end slopes. Periods start at multiples of ``period_ms`` of the epoch. Rows with the same ``key`` (and time) count once.

    Method: readings are shuffled by source and period, which keep their ends and mean. Then each source is cut into time shards
    of ``shard_periods``, which receive the ``HALO`` neighbouring periods of the shards before and after, so windows
    hold one shard and the series is the same as over the whole source.

    Nulls: rows without source or time are left out; a null or NaN reading is none; rows with a null key count each. A source with
    one reading gives one row. Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    periods = period_readings(df, source, millis, fields, period_ms, key).withColumn("_shard", F.floor(F.col("_period") / shard_periods))
    rows = periods.select("_source", "_field", "_shard", "_period", "_mean", *_ENDS, F.lit(True).alias("_own")).unionByName(_halo(periods))
    order = Window.partitionBy("_source", "_field", "_shard").orderBy("_period")
    limit = longest_gap + 1
    ahead = {n: F.lead(c, k).over(order) for n, c, k in (("_p1", "_period", 1), ("_p2", "_period", 2), ("_n1", "_f1", 1), ("_n2", "_f2", 1), ("_n3", "_f1", 2))}
    steps = rows.withColumns({"_p0": F.lag("_period").over(order), "_b": F.lag("_l1").over(order)} | ahead)
    # the readings on either side of what is empty behind a period, and the next ones on both sides unless a gap lies between
    steps = steps.withColumns(
        {
            "_b": F.coalesce("_l2", F.when(F.col("_period") - F.col("_p0") <= limit, F.col("_b"))),
            "_e": F.coalesce("_n2", F.when(F.col("_p2") - F.col("_p1") <= limit, F.col("_n3"))),
        }
    )
    h0, h1, h2 = F.col("_l1.t") - F.col("_b.t"), F.col("_n1.t") - F.col("_l1.t"), F.col("_e.t") - F.col("_n1.t")
    steps = steps.withColumns({"_h0": h0, "_h1": h1, "_h2": h2})
    h0, h1, h2 = F.col("_h0"), F.col("_h1"), F.col("_h2")
    steps = steps.withColumns({"_d0": (F.col("_l1.v") - F.col("_b.v")) / h0, "_d1": (F.col("_n1.v") - F.col("_l1.v")) / h1, "_d2": (F.col("_e.v") - F.col("_n1.v")) / h2})
    d0, d1, d2 = F.col("_d0"), F.col("_d1"), F.col("_d2")
    left = F.when(h0.isNotNull(), _slope(h0, d0, h1, d1)).when(h2.isNotNull(), _end_slope(h1, d1, h2, d2)).otherwise(d1)
    right = F.when(h2.isNotNull(), _slope(h1, d1, h2, d2)).when(h0.isNotNull(), _end_slope(h1, d1, h0, d0)).otherwise(d1)
    # every row of the shard makes its own period and the empty ones up to the next row, wherever that is
    upto = F.coalesce(F.col("_p1") - 1, F.col("_period"))
    grid = steps.where("_own").withColumns({"_s1": left, "_s2": right}).withColumn("_at", F.explode(F.sequence("_period", upto)))
    t = (F.col("_at") + 0.5 - F.col("_l1.t")) / h1
    cubic = (
        F.col("_l1.v") * (t * t * t * 2 - t * t * 3 + 1)
        + F.col("_s1") * h1 * (t * t * t - t * t * 2 + t)
        + F.col("_n1.v") * (t * t * 3 - t * t * t * 2)
        + F.col("_s2") * h1 * (t * t * t - t * t)
    )
    observed, short = F.col("_at") == F.col("_period"), F.col("_p1") - F.col("_period") <= limit
    return grid.select(
        F.col("_source").alias(source),
        F.col("_field").alias("field_name"),
        (F.col("_at") * F.lit(period_ms)).cast("bigint").alias("period_start_ms"),
        F.when(observed, F.col("_mean")).when(short, cubic).alias("value"),
        F.when(observed, F.lit("observed")).when(short, F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
    )
