"""Panels: coverage, correlations, venue differences, tables by regime and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, day: str, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys, field, n_valid, pct_valid, first_valid, last_valid), with a row 'complete case' for all fields at once. One pass."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    checks = [(f, F.col(f).isNotNull()) for f in fields] + [("complete case", whole)]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, (_, ok) in enumerate(checks):
        aggregates += [F.count_if(ok).alias(f"_n{i}"), F.min(F.when(ok, F.col(day))).alias(f"_a{i}"), F.max(F.when(ok, F.col(day))).alias(f"_b{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), F.col(f"_n{i}").alias("n_valid"), (F.col(f"_n{i}") * 100.0 / F.col("_n")).alias("pct_valid"),
                F.col(f"_a{i}").alias("first_valid"), F.col(f"_b{i}").alias("last_valid"),
            )
            for i, (name, _) in enumerate(checks)
        ]
    )
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(rows))


def correlations(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys, field_a, field_b, n, correlation) of each pair, over rows where both are known. One pass.

    NaN where a field has one value only in these rows or spreads less than a double can hold, null where there are none.
    """
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        # F.corr fails where the product of both sums of squares is 0, and merged deviations of a constant can differ from 0
        constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggregates += [F.count_if(both).alias(f"_n{i}"), F.when(constant | (spread == 0), F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spread).alias(f"_c{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"_n{i}").alias("n"), F.col(f"_c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(rows))


def venue_difference(df: DataFrame, day: str, venue: str, value: str, plus: str = "DER", minus: str = "CME") -> DataFrame:
    """(day, plus, minus, wedge): means of ``value`` by venue side by side, for days with both."""
    sides = df.where(F.col(venue).isin(plus, minus)).groupBy(day).pivot(venue, [plus, minus]).agg(F.avg(value))
    return sides.where(F.col(plus).isNotNull() & F.col(minus).isNotNull()).withColumn("wedge", F.col(plus) - F.col(minus))


def by_regime(df: DataFrame, keys: list[str], regime: str, values: list[str]) -> DataFrame:
    """(keys, regime, n, mean of each value): one row per regime and one ('all') over them, in one aggregate."""
    means = [F.avg(v).alias(v) for v in values]
    sets = df.groupingSets([[*[F.col(k) for k in keys], F.col(regime)], [F.col(k) for k in keys]], *[F.col(k) for k in keys], F.col(regime))
    out = sets.agg(F.grouping(regime).alias("_all"), F.count(F.lit(1)).alias("n"), *means)
    return out.where(F.col(regime).isNotNull() | (F.col("_all") == 1)).withColumn(regime, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(regime))).drop("_all")


def ratio_of_means(part: str, parts: list[str]) -> Column:
    """mean(part) / sum of the means of ``parts``; null where that is 0."""
    total = F.avg(parts[0])
    for p in parts[1:]:
        total = total + F.avg(p)
    return F.try_divide(F.avg(part), total)


def band_table(df: DataFrame, keys: list[str], value: str, band: str) -> DataFrame:
    """(keys, n, mean, median, share_inside, share_beyond_double) of |value| against a band."""
    rows = df.where(F.col(value).isNotNull() & F.col(band).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.avg((F.abs(value) <= F.col(band)).cast("double")).alias("share_inside"),
        F.avg((F.abs(value) > 2 * F.col(band)).cast("double")).alias("share_beyond_double"),
    )


def stars(p: Column) -> Column:
    """'***', '**', '*' below 1, 5 and 10 %."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def latest_rows(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``. Map-side combine; ties go to the greatest row."""
    rest = [c for c in df.columns if c not in key and c != order]
    return df.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in [order, *rest]])
