"""Option trades: parsing, unit conversion, filters with an attrition log, daily cross-sections and parity forwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def parsed_instrument(name: Column) -> dict[str, Column]:
    """expiration, strike and callput of names like BTC-28MAR25-60000-C; all null where the name has another form."""
    parts = F.split(name, "-")
    day = F.try_to_timestamp(parts[1], F.lit("dMMMyy")).cast("date")
    strike = F.when(parts[2].rlike(r"^[0-9]+([.][0-9]+)?$"), parts[2].try_cast("double"))
    side = F.when(parts[3].isin("C", "P"), parts[3])
    good = (F.size(parts) == 4) & day.isNotNull() & strike.isNotNull() & side.isNotNull()
    return {"expiration": F.when(good, day), "strike": F.when(good, strike), "callput": F.when(good, side)}


def with_instrument(df: DataFrame, name: str = "instrument_name") -> DataFrame:
    """``df`` with the columns of ``parsed_instrument``; four-part names only, others get nulls."""
    four = F.when(F.size(F.split(F.col(name), "-")) == 4, F.col(name))
    return df.withColumns(parsed_instrument(four))


def time_to_expiry(date: Column, expiration: Column) -> dict[str, Column]:
    """Days to expiry and the year fraction on 365.25 days."""
    days = F.datediff(expiration, date)
    return {"days_to_expiry": days, "tau": days / F.lit(YEAR_DAYS)}


def log_moneyness(strike: Column, forward: Column) -> Column:
    """ln(K/F); null where either isn't above zero."""
    return F.when((strike > 0) & (forward > 0), F.log(strike / forward))


def usable_trades(min_amount: float = 0.0) -> Column:
    """Implied volatility and both prices above zero, amount above ``min_amount``; null and NaN fail."""
    good = F.lit(True)
    for c, least in (("iv", 0.0), ("price_btc", 0.0), ("price_usd", 0.0), ("amount", min_amount)):
        good = good & F.coalesce(~F.isnan(c) & (F.col(c) > least), F.lit(False))
    return good


def no_sentinel(columns: list[str], sentinel: float = -99.99) -> Column:
    """None of ``columns`` is the missing-value sentinel; nulls pass."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.coalesce(F.col(c) != sentinel, F.lit(True))
    return keep


def maturity_between(least: int = 10, most: int = 180) -> Column:
    return F.coalesce(F.col("days_to_expiry").between(least, most), F.lit(False))


def volatility_between(least: float = 0.01, most: float = 5.0) -> Column:
    return F.coalesce(~F.isnan("iv") & F.col("iv").between(least, most), F.lit(False))


def no_static_arbitrage(settle: str, bid: str, offer: str) -> Column:
    """Settlement above zero, bid not below zero, offer not below bid."""
    return F.coalesce((F.col(settle) > 0) & (F.col(bid) >= 0) & (F.col(offer) >= F.col(bid)), F.lit(False))


def liquid(interest: str, volume: str, min_interest: float, min_volume: float) -> Column:
    """Open interest or volume high enough."""
    return F.coalesce(F.col(interest) >= min_interest, F.lit(False)) | F.coalesce(F.col(volume) >= max(min_volume, 1), F.lit(False))


def out_of_the_money(forward: str = "forward_price") -> Column:
    """Calls from the forward up, puts from it down; at the money both stay."""
    call, put = F.col("callput") == "C", F.col("callput") == "P"
    return F.coalesce((call & (F.col("strike") >= F.col(forward))) | (put & (F.col("strike") <= F.col(forward))), F.lit(False))


def within_moneyness(width: float = 3.0) -> Column:
    """|ln(K/F)| at most ``width`` times the square root of tau."""
    return F.coalesce(F.abs("log_moneyness") <= width * F.sqrt("tau"), F.lit(False))


def attrition(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, n_before, n_after) of filters applied one after another, counted in one pass over ``df``."""
    kept, counts, so_far = F.lit(True), [F.count(F.lit(1)).alias("n0")], []
    for i, (_, keep) in enumerate(steps, 1):
        kept = kept & keep
        counts.append(F.count_if(kept).alias(f"n{i}"))
        so_far.append(i)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step_no"), F.lit(steps[i - 1][0]).alias("step"), F.col(f"n{i - 1}").alias("n_before"), F.col(f"n{i}").alias("n_after"))
            for i in so_far
        ]
    )
    return df.agg(*counts).select(F.inline(rows))


def daily_cross_section(trades: DataFrame) -> DataFrame:
    """One row per (date, expiration, strike, callput): volume-weighted prices and volatility, the last marks and spot.

    Last is by (timestamp, trade_id); a last value skips nulls. Everything is one aggregate that combines on the map
    side. Rows with a null key field are left out.
    """
    w = F.col("amount")
    order = F.struct("timestamp", "trade_id")

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(w * F.col(c)), F.sum("amount"))

    def last(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("_o"), F.col(c).alias("_v"))))["_v"]

    keys = ["date", "expiration", "strike", "callput"]
    rows = trades
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(
        mean("price_btc").alias("price_btc"),
        mean("price_usd").alias("price_usd"),
        mean("iv").alias("iv"),
        last("mark_price_btc").alias("mark_price_btc"),
        last("mark_price_usd").alias("settlementprice"),
        last("index_price_usd").alias("spot_price"),
        F.sum("amount").alias("volume"),
        F.count("amount").alias("n_trades"),
        F.min("days_to_expiry").alias("days_to_expiry"),
        F.min("tau").alias("tau"),
    )


def parity_forward(daily: DataFrame, anchor: str = "spot_price", rate: Column | None = None) -> DataFrame:
    """``daily`` with ``forward_price``, ``basis`` and ``log_moneyness``.

    The at-the-money strike of a (date, expiration) is the one nearest its row's ``anchor``; a tie goes to the lower strike. Where it
    has a call and a put, F = K + exp(r tau)(C - P), else the anchor. Windows over a slice, no join; slices hold
    the contracts of one expiry and day.
    """
    slice_of = Window.partitionBy("date", "expiration")
    growth = F.lit(1.0) if rate is None else F.exp(rate * F.col("tau"))
    distance = F.abs(F.col("strike") - F.col(anchor))
    nearest = F.min(F.when(distance.isNotNull(), F.struct(distance.alias("d"), F.col("strike").alias("k")))).over(slice_of)["k"]
    rows = daily.withColumn("_atm", nearest)
    at = F.col("strike") == F.col("_atm")
    call = F.max(F.when(at & (F.col("callput") == "C"), F.col("settlementprice"))).over(slice_of)
    put = F.max(F.when(at & (F.col("callput") == "P"), F.col("settlementprice"))).over(slice_of)
    forward = F.coalesce(F.col("_atm") + growth * (F.col("_call") - F.col("_put")), F.col(anchor))
    return (
        rows.withColumns({"_call": call, "_put": put})
        .withColumn("forward_price", forward)
        .withColumns({"basis": F.try_divide(F.col("forward_price") - F.col(anchor), F.col(anchor)), "log_moneyness": log_moneyness(F.col("strike"), F.col("forward_price"))})
        .drop("_atm", "_call", "_put")
    )


def spot_convention(daily: DataFrame) -> DataFrame:
    """Forward convention F = S where a spot is known: log-moneyness moves by ln(F/S); the basis stays."""
    has = (F.col("spot_price") > 0) & (F.col("forward_price") > 0)
    return daily.withColumns(
        {
            "log_moneyness": F.when(has, F.col("log_moneyness") + F.log(F.col("forward_price") / F.col("spot_price"))).otherwise(F.col("log_moneyness")),
            "forward_price": F.when(has, F.col("spot_price")).otherwise(F.col("forward_price")),
        }
    )


def annual_basis(forward: Column, spot: Column, tau: Column) -> Column:
    """(F/S - 1) / tau with tau at least 1e-6."""
    return (F.try_divide(forward, spot) - 1) / F.greatest(tau, F.lit(1e-6))


def daily_basis(daily: DataFrame) -> DataFrame:
    """Per date: mean and median basis, last spot (of the greatest expiration, strike, side), mean forward, slices."""
    last = F.max(F.struct("expiration", "strike", "callput", "spot_price"))["spot_price"]
    return daily.groupBy("date").agg(
        F.avg("basis").alias("basis_mean"),
        F.percentile("basis", F.lit(0.5)).alias("basis_median"),
        last.alias("spot_price"),
        F.avg("forward_price").alias("forward_price_mean"),
        F.count_distinct("expiration").alias("n_slices"),
    )


def nearest_maturity(daily: DataFrame, target: int = 27) -> DataFrame:
    """Each date's expiry nearest ``target`` days, the shorter of two as near: (date, expiration, days_to_expiry, tau, ...)."""
    slices = daily.groupBy("date", "expiration").agg(
        F.min("days_to_expiry").alias("days_to_expiry"), F.min("tau").alias("tau"), F.avg("forward_price").alias("forward_price"), F.avg("spot_price").alias("spot_price")
    )
    order = Window.partitionBy("date").orderBy(F.abs(F.col("days_to_expiry") - target), "days_to_expiry", "expiration")
    return slices.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def data_summary(daily: DataFrame) -> DataFrame:
    """Rows, days, first and last day, median contracts per day and per slice, calls and puts: one row."""
    per_slice = daily.groupBy("date", "expiration").agg(F.count(F.lit(1)).alias("_s"), F.count_if(F.col("callput") == "C").alias("_c"), F.count_if(F.col("callput") == "P").alias("_p"))
    per_day = per_slice.groupBy("date").agg(F.sum("_s").alias("_d"), F.sum("_c").alias("_c"), F.sum("_p").alias("_p"), F.count(F.lit(1)).alias("_n"))
    days = per_day.agg(
        F.sum("_d").alias("n_rows"), F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.percentile("_d", F.lit(0.5)).alias("median_per_day"), F.sum("_c").alias("n_calls"), F.sum("_p").alias("n_puts"), F.sum("_n").alias("n_slices"),
    )
    median = per_slice.agg(F.percentile("_s", F.lit(0.5)).alias("median_per_slice")).scalar()
    return days.withColumn("median_per_slice", median)
