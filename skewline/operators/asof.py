"""As-of joins: the nearest row of another table by a number, within equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    tolerance: float | None = None,
    shard: float | None = None,
    repeated: bool = False,
) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that is nearest in ``right_on`` to ``left_on``, within equal ``by``.

    A tie goes to the lower number. Rows without a key, a number or a match within ``tolerance`` get nulls. Of right rows with
    the same key and number the one with the greatest values counts.

    Spark has no as-of join. Both sides are put into one table, and a window over each key carries the last right row
    before and the first one after to every left row: one shuffle and a sort, no pairs. With ``shard`` (which takes
    ``tolerance``), keys are cut into shards of that width and right rows are copied to every shard within the tolerance, so
    a key with most rows is spread over many tasks. With ``repeated``, left rows of the same key and number are looked up
    once: the window runs over distinct numbers and its result is joined to the rows on key and number.
    """
    if repeated:
        numbers = left.select(*by, F.col(f"`{left_on}`").cast("double").alias("_at")).where("_at is not null").distinct()
        found = nearest_join(numbers, right, by, "_at", right_on, [right_on, *[v for v in values if v != right_on]], tolerance, shard)
        found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_at", *[F.col(f"`{v}`").alias(f"_v{i}") for i, v in enumerate(values)])
        same = F.col(f"`{left_on}`").cast("double") == F.col("_at")
        for i, k in enumerate(by):
            same = same & (F.col(k) == F.col(f"_k{i}"))
        return left.join(found, same, "left").select(*[F.col(f"`{c}`") for c in left.columns if c not in values], *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])
    payload = [F.col(f"`{v}`").alias(f"_r{i}") for i, v in enumerate(values)]
    r = right.select(*by, F.col(f"`{right_on}`").cast("double").alias("_n"), *payload).where("_n is not null")
    r = r.groupBy(*by, "_n").agg(F.max(F.struct(*[f"_r{i}" for i in range(len(values))])).alias("_row"))
    everything = left.select(*by, F.col(f"`{left_on}`").cast("double").alias("_n"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    keys = list(by)
    if shard:
        if tolerance is None:
            raise ValueError("shard takes a tolerance")
        r = r.withColumn("_shard", F.explode(F.sequence(F.floor((F.col("_n") - tolerance) / shard), F.floor((F.col("_n") + tolerance) / shard))))
        everything = everything.withColumn("_shard", F.floor(F.col("_n") / shard))
        keys.append("_shard")
    empty_left, empty_row = F.lit(None).cast(everything.schema["_left"].dataType), F.lit(None).cast(r.schema["_row"].dataType)
    both = everything.withColumn("_row", empty_row).unionByName(r.withColumn("_left", empty_left))
    near = F.when(F.col("_row").isNotNull(), F.struct("_n", "_row"))
    # a frame that follows is built anew for every row; the same in descending order isn't
    up_order, down_order = Window.partitionBy(*keys).orderBy("_n"), Window.partitionBy(*keys).orderBy(F.desc("_n"))
    both = both.select(
        "_left",
        "_n",
        F.last(near, True).over(up_order.rangeBetween(Window.unboundedPreceding, 0)).alias("_before"),
        F.last(near, True).over(down_order.rangeBetween(Window.unboundedPreceding, 0)).alias("_after"),
    ).where("_left is not null")
    down, up = F.col("_n") - F.col("_before._n"), F.col("_after._n") - F.col("_n")
    chosen = F.when(F.col("_n").isNull(), None).when(up.isNull() | (down <= up), F.col("_before")).otherwise(F.col("_after"))
    both = both.withColumn("_chosen", chosen)
    distance: Column = F.abs(F.col("_chosen._n") - F.col("_n"))
    row = F.col("_chosen._row") if tolerance is None else F.when(distance <= tolerance, F.col("_chosen._row"))
    both = both.withColumn("_match", row)
    return both.select("_left.*", *[F.col("_match")[f"_r{i}"].alias(v) for i, v in enumerate(values)])
