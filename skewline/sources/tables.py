"""Readers: Parquet tables by name, cleaned of NaN, and column resolution by candidate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(column: Column | str) -> Column:
    """NaN becomes null: Spark holds NaN = NaN and NaN > x, the engine's rules hold neither."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with NaN turned into null in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floating}) if floating else df


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of ``candidates`` that ``df`` has; raises KeyError when there is none."""
    for name in candidates:
        if name in df.columns:
            return name
    raise KeyError(f"none of {candidates} in {df.columns}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with just ``columns``; raises KeyError that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])
