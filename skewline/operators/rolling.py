"""Rolling totals over trailing periods (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Above zero, not null and not NaN."""
    return column.isNotNull() & ~F.isnan(column) & (column > 0)


def daily_values(df: DataFrame, entity: str, day: str, fields: list[str], order: str | None) -> DataFrame:
    """One row per entity and day with the latest usable value of each field, or null.

    Days loaded again count once: the usable value with the greatest ``order`` stands, a tie goes to the greater
    value. Rows with a null entity or day belong to no series and are left out. The aggregate combines on the map
    side, so an entity with a third of all rows reaches the shuffle as one row per day and input task.
    """
    rows = df.select(
        F.col(f"`{entity}`").alias("_entity"),
        F.col(f"`{day}`").cast("date").alias("_day"),
        (F.col(f"`{order}`") if order else F.lit(0)).alias("_order"),
        *[F.col(f"`{f}`").cast("double").alias(f"_v{i}") for i, f in enumerate(fields)],
    ).where("_entity is not null and _day is not null")
    return rows.groupBy("_entity", "_day").agg(
        *[F.max(F.when(usable(F.col(f"_v{i}")), F.struct("_order", f"_v{i}")))[f"_v{i}"].alias(f"_v{i}") for i in range(len(fields))]
    )


def rolling_totals(
    df: DataFrame,
    entity: str,
    day: str,
    fields: list[str],
    periods: tuple[int, ...] = (7, 30),
    order: str | None = None,
) -> DataFrame:
    """Totals and averages of ``fields`` over trailing ``periods`` of days, for every entity and calendar day.

    Result: ``entity``, ``day``, and for each field ``{field}`` (the day's value or null) and for each period P
    ``{field}_total_{P}d``, ``{field}_avg_{P}d`` (the total over P, a fixed denominator) and ``{field}_days_{P}d``
    (days with a usable value in it). Calendar rows run from the entity's first to its last row, days without a
    usable value count as nothing.

    Method: sparse daily totals; the days missing between one row and the next are put in with ``sequence``; then
    frames by range over the integer day number. The daily aggregate is shuffled once by entity and day, its few rows
    once more by entity; both window steps share that partitioning. An entity has at most one row per calendar day
    in a window, whatever its number of input rows.

    Nulls: see ``daily_values``. An empty input gives no rows. Other columns of ``df`` are ignored, whatever
    their names.
    """
    days = daily_values(df, entity, day, fields, order)
    by_day = Window.partitionBy("_entity").orderBy("_day")
    values = [f"_v{i}" for i in range(len(fields))]
    calendar = (
        days.withColumn("_until", F.coalesce(F.date_sub(F.lead("_day").over(by_day), 1), F.col("_day")))
        .withColumn("_date", F.explode(F.sequence("_day", "_until")))
        .select(
            "_entity",
            "_date",
            F.unix_date("_date").alias("_number"),
            *[F.when(F.col("_date") == F.col("_day"), F.col(v)).alias(v) for v in values],
        )
    )
    numbers = Window.partitionBy("_entity").orderBy("_number")
    out = [F.col("_entity").alias(entity), F.col("_date").alias(day)]
    for v, field in zip(values, fields, strict=True):
        out.append(F.col(v).alias(field))
        for p in periods:
            frame = numbers.rangeBetween(-(p - 1), 0)
            total = F.coalesce(F.sum(v).over(frame), F.lit(0.0))
            out += [
                total.alias(f"{field}_total_{p}d"),
                (total / F.lit(float(p))).alias(f"{field}_avg_{p}d"),
                F.count(v).over(frame).alias(f"{field}_days_{p}d"),
            ]
    return calendar.select(*out)


def inactive_days(totals: DataFrame, entity: str, day: str, fields: list[str]) -> DataFrame:
    """(entity, day, field_name) of each calendar row of ``rolling_totals`` (with a period of 1) whose day's frame holds no usable value."""
    return totals.select(
        F.col(f"`{entity}`"),
        F.col(f"`{day}`"),
        F.explode(
            F.array_compact(F.array(*[F.when(F.col(f"`{f}_days_1d`") == 0, F.lit(f)) for f in fields]))
        ).alias("field_name"),
    )
