"""Incremental trade ingest and windowed results on streams: extensions to the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def trade_stream(spark: SparkSession, folder: str, schema: StructType, delay: str = "2 days", files_per_trigger: int = 16) -> DataFrame:
    """Trades of the Parquet files that arrive in ``folder``, each ``trade_id`` once within ``delay``; ``event_time`` is added.

    Rows without a time or id are dropped. State is bounded by the watermark: ids older than it are forgotten.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    timed = rows.where("timestamp is not null and trade_id is not null").withColumn("event_time", F.timestamp_millis("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["trade_id"])


def daily_vwap(trades: DataFrame) -> DataFrame:
    """Tumbling days: volume-weighted price and volume per contract; a day comes out once the watermark has passed it."""
    w = F.col("amount")

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(w * F.col(c)), F.sum("amount"))

    return trades.groupBy(F.window("event_time", "1 day").alias("_w"), "instrument_name").agg(
        mean("price_btc").alias("price_btc"), mean("iv").alias("iv"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("n_trades")
    ).select(F.col("_w.start").cast("date").alias("date"), "instrument_name", "price_btc", "iv", "volume", "n_trades")


def bar_lasts(trades: DataFrame, minutes: int = 15) -> DataFrame:
    """Tumbling bars: the last index value of each, by (time, id)."""
    last = F.max(F.struct("timestamp", "trade_id", "index_price_usd"))["index_price_usd"]
    rows = trades.where("index_price_usd > 0").groupBy(F.window("event_time", f"{minutes} minutes").alias("_w")).agg(last.alias("last"), F.count(F.lit(1)).alias("n_trades"))
    return rows.select(F.col("_w.start").alias("bar"), "last", "n_trades")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that has arrived into Parquet files at ``sink`` and stops; a later run goes on from ``checkpoint``."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
