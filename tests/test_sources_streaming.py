"""File sources, sinks and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skewline.sources import files, tables
from skewline.streaming import ingest


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "zc.csv").write_text("date,currency,days,rate\n2024-01-02,USD,10,0.05\n2024-01-01,USD,30,x\n2024-01-01,EUR,30,0.01\n")
    assert [tuple(r) for r in files.zero_curve(spark, str(tmp_path / "zc.csv")).collect()] == [(dt.date(2024, 1, 1), 30, None), (dt.date(2024, 1, 2), 10, 0.05)]
    schema = "date date, currency string, days int, rate double"
    first = files.csv_to_parquet(spark, str(tmp_path / "zc.csv"), schema, str(tmp_path / "zc"))
    (tmp_path / "zc.csv").write_text("date,currency,days,rate\n")
    assert files.csv_to_parquet(spark, str(tmp_path / "zc.csv"), schema, str(tmp_path / "zc")).count() == first.count() == 3
    assert files.window_scan(first, "2024-01-02", "2024-01-09").count() == 1
    files.write_shards(spark.range(10).coalesce(1), str(tmp_path / "shards"), 4)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 3
    assert files.resume_point(spark.read.parquet(str(tmp_path / "shards")), "id") == 9
    files.write_result(first, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        files.expect_rows(first, 4, "curve")
    assert files.expect_rows(first, 3, "curve") is first


def test_columns(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double")
    assert tables.without_nan(df).first()["b"] is None
    assert tables.resolve_column(df, ["x", "b"]) == "b"
    with pytest.raises(KeyError):
        tables.require(df, ["a", "c"])


def test_streams_take_late_and_repeated_trades(spark, tmp_path):
    hour = 3_600_000
    schema = "timestamp bigint, trade_id string, instrument_name string, price_btc double, iv double, amount double, index_price_usd double"

    def trade(t, i, amount=1.0, price=0.1):
        return (t * hour, i, "X", price, 0.5, amount, 100.0 + t)

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([trade(1, "a"), trade(2, "b", 3.0, 0.3), trade(2, "b", 3.0, 0.3)])
    put([trade(3, "a2"), trade(1, "a"), (None, "n", "X", 0.1, 0.1, 1.0, 1.0)])
    struct = spark.createDataFrame([], schema).schema
    daily = ingest.daily_vwap(ingest.trade_stream(spark, str(tmp_path / "in"), struct))
    ingest.run_to_end(daily, str(tmp_path / "out"), str(tmp_path / "cp"))
    put([trade(24 * 9, "z")])
    ingest.run_to_end(ingest.daily_vwap(ingest.trade_stream(spark, str(tmp_path / "in"), struct)), str(tmp_path / "out"), str(tmp_path / "cp"))
    put([trade(24 * 20, "y")])
    ingest.run_to_end(ingest.daily_vwap(ingest.trade_stream(spark, str(tmp_path / "in"), struct)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["date"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = got[dt.date(1970, 1, 1)]
    assert first["n_trades"] == 3 and first["volume"] == 5.0 and first["price_btc"] == pytest.approx((0.1 + 0.9 + 0.1) / 5)
    bars = ingest.bar_lasts(ingest.trade_stream(spark, str(tmp_path / "in"), struct))
    ingest.run_to_end(bars, str(tmp_path / "bars"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "bars")).where(F.col("n_trades") > 1).count() == 0
