"""File sources and sinks: typed CSV, materialisation once, shards of bounded size, result tables, resume points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV file with a header under a stated schema; values that don't fit are null."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option("mode", "PERMISSIVE").csv(path)


def csv_to_parquet(spark: SparkSession, path: str, schema: StructType | str, to: str) -> DataFrame:
    """The CSV as Parquet at ``to``, written only if nothing is there."""
    read_csv(spark, path, schema).write.mode("ignore").parquet(to)
    return spark.read.parquet(to)


def zero_curve(spark: SparkSession, path: str, currency: str = "USD") -> DataFrame:
    """(date, days, rate) of one currency, in order."""
    rows = read_csv(spark, path, "date date, currency string, days int, rate double")
    return rows.where(F.col("currency") == currency).select("date", "days", "rate").orderBy("date", "days")


def window_scan(df: DataFrame, first: str, last: str, day: str = "date") -> DataFrame:
    """Rows whose day lies in [first, last]; reaches the file scan."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """Parquet files of at most ``rows_per_file`` rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)


def resume_point(shards: DataFrame, millis: str = "timestamp") -> int | None:
    """The greatest time taken in so far, None if there is none."""
    return shards.agg(F.max(millis).alias("m")).first()["m"]


def write_result(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def show_table(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Chosen columns in order, doubles rounded."""
    out = df.select(*(columns or df.columns))
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    return out.orderBy(*order) if order else out


def expect_rows(df: DataFrame, least: int, name: str) -> DataFrame:
    """``df`` if it has at least ``least`` rows, else ValueError; reads no more than needed."""
    got = df.limit(least).count()
    if got < least:
        raise ValueError(f"{name}: {got} rows, at least {least} expected")
    return df
