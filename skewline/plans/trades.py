"""Queries over the trade tape: cross-sections, filters, forwards, parsing, as-of and time lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.operators import asof, options, ordered, skew
from skewline.sources.tables import table, without_nan


def tape(spark: SparkSession, folder: str, columns: tuple[str, ...]) -> DataFrame:
    """``trade_id`` and ``columns`` of the trades once each, sides spelled alike, NaN as null.

    Of rows that arrive twice the first arrival stands. Only the columns asked for are read and shuffled; the aggregate combines on the
    map side, by hash where they are numbers.
    """
    rows = without_nan(table(spark, folder, "btc_options_trades").select("trade_id", "ingested_at", *columns))
    spelled = {"callput": skew.side_code(F.col("callput")), "direction": F.lower(F.trim("direction"))}
    rows = rows.withColumns({c: spelled[c] for c in columns if c in spelled})
    return rows.groupBy("trade_id").agg(*[F.min_by(c, "ingested_at").alias(c) for c in columns])


#: Columns of a daily cross-section.
CROSS = (
    "date", "timestamp", "expiration", "strike", "callput", "days_to_expiry", "tau", "price_btc", "price_usd", "mark_price_btc", "mark_price_usd", "iv", "index_price_usd", "amount",
)


#: Added before rounding, so that values half way between two roundings go the same way in Spark and in SQL.
NUDGE = 3.1e-10


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cross_section(spark: SparkSession, folder: str) -> DataFrame:
    """Daily contracts with a parity forward, from usable trades."""
    return options.parity_forward(options.daily_cross_section(tape(spark, folder, CROSS).where(options.usable_trades())))


def q_vwap(spark: SparkSession, folder: str) -> DataFrame:
    """Daily volume-weighted cross-section of all trades."""
    return _rounded(options.daily_cross_section(tape(spark, folder, CROSS)))


def q_min_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts and days with at least three trades."""
    return q_vwap(spark, folder).where("n_trades >= 3").select("date", "expiration", "strike", "callput", "n_trades")


def q_pcp_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Parity forward, basis and log-moneyness per contract and day."""
    out = cross_section(spark, folder)
    return _rounded(out.select("date", "expiration", "strike", "callput", "spot_price", "forward_price", "basis", "log_moneyness"))


def q_fs_override(spark: SparkSession, folder: str) -> DataFrame:
    """The same under the convention F = S."""
    out = options.spot_convention(cross_section(spark, folder))
    return _rounded(out.select("date", "expiration", "strike", "callput", "forward_price", "basis", "log_moneyness"))


def q_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts that pass maturity, moneyness side, moneyness width and volatility filters."""
    kept = cross_section(spark, folder).where(
        options.maturity_between() & options.out_of_the_money() & options.within_moneyness() & options.volatility_between()
    )
    return _rounded(kept.select("date", "expiration", "strike", "callput", "iv", "tau", "forward_price"))


_STEPS = ("positive volatility", "positive amount", "positive prices", "maturity 10 to 180", "volatility 0.01 to 5")


def q_attrition(spark: SparkSession, folder: str) -> DataFrame:
    """Trades left after each filter, in one pass."""
    positive = {c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("iv", "amount", "price_btc", "price_usd")}
    keep = [positive["iv"], positive["amount"], positive["price_btc"] & positive["price_usd"], options.maturity_between(), options.volatility_between()]
    return options.attrition(tape(spark, folder, ("iv", "amount", "price_btc", "price_usd", "days_to_expiry")), list(zip(_STEPS, keep, strict=True)))


def q_sentinels(spark: SparkSession, folder: str) -> DataFrame:
    """Fits per venue: rows, those with the missing-value sentinel, null or NaN, and those left."""
    rows = table(spark, folder, "ssvi_diagnostics").withColumn("venue", F.upper(F.trim("venue")))
    return rows.groupBy("venue").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("rmse") == -99.99).alias("n_sentinel"),
        F.count_if(F.col("rmse").isNull() | F.isnan("rmse")).alias("n_missing"),
        F.count_if(options.no_sentinel(["rmse"]) & F.col("rmse").isNotNull() & ~F.isnan("rmse")).alias("n_left"),
    )


def q_parse_instrument(spark: SparkSession, folder: str) -> DataFrame:
    """Instrument names parsed, per name."""
    names = table(spark, folder, "btc_options_trades").groupBy("instrument_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return options.with_instrument(names)


def q_units(spark: SparkSession, folder: str) -> DataFrame:
    """Per day: how often the stored maturity, year fraction and USD price agree with those derived."""
    rows = tape(spark, folder, ("date", "expiration", "days_to_expiry", "tau", "price_btc", "index_price_usd", "price_usd")).where("expiration is not null")
    derived = options.time_to_expiry(F.col("date"), F.col("expiration"))
    rows = rows.withColumns({f"_{k}": v for k, v in derived.items()})
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_days_to_expiry") == F.col("days_to_expiry")).alias("n_days_agree"),
        F.count_if(F.abs(F.col("_tau") - F.col("tau")) < 1e-5).alias("n_tau_agree"),
        F.count_if(F.abs(F.col("price_btc") * F.col("index_price_usd") - F.col("price_usd")) <= 1e-3 + 1e-6 * F.col("price_usd")).alias("n_price_agree"),
    )


def q_daily_basis(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(options.daily_basis(cross_section(spark, folder)), 7)


def q_carry_basis(spark: SparkSession, folder: str) -> DataFrame:
    """Annual basis of each day's expiry nearest 27 days."""
    near = options.nearest_maturity(cross_section(spark, folder))
    return _rounded(near.select("date", "expiration", "days_to_expiry", options.annual_basis(F.col("forward_price"), F.col("spot_price"), F.col("tau")).alias("carry")), 6)


def q_atm_iv(spark: SparkSession, folder: str) -> DataFrame:
    """Volatility at the strike nearest the forward, per day and expiry."""
    order = Window.partitionBy("date", "expiration").orderBy(F.abs(F.col("strike") - F.col("forward_price")), "strike", "callput")
    out = cross_section(spark, folder).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return _rounded(out.select("date", "expiration", "strike", "callput", "iv"))


def q_data_summary(spark: SparkSession, folder: str) -> DataFrame:
    return options.data_summary(options.daily_cross_section(tape(spark, folder, CROSS).where(options.usable_trades())))


def q_count_describe(spark: SparkSession, folder: str) -> DataFrame:
    """Trades per day described: by year."""
    per_day = table(spark, folder, "btc_options_trades").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(
        per_day.groupBy(F.year("date").alias("year")).agg(
            F.count(F.lit(1)).alias("n_days"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("deviation"), F.min("n").alias("least"),
            F.percentile("n", F.lit(0.25)).alias("p25"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.75)).alias("p75"), F.max("n").alias("most"),
        )
    )


def q_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tape(spark, folder, ("callput", "direction")).groupBy("callput", "direction").agg(F.count(F.lit(1)).alias("n_trades"))


def q_commonest_maturity(spark: SparkSession, folder: str) -> DataFrame:
    """The ten commonest days to expiry."""
    counts = tape(spark, folder, ("days_to_expiry",)).where("days_to_expiry is not null").groupBy("days_to_expiry").agg(F.count(F.lit(1)).alias("n_trades"))
    return counts.orderBy(F.desc("n_trades"), "days_to_expiry").limit(10)


def q_asof_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of the curve tenor nearest each line's quantity, within its line number."""
    curve = table(spark, folder, "part").groupBy((F.col("p_size") % 7 + 1).cast("int").alias("by"), F.col("p_size").cast("double").alias("days")).agg(
        (F.avg("p_retailprice") / 1e5).alias("rate")
    )
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").cast("int").alias("by"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("days"))
    out = asof.nearest_join(lines, curve, ["by"], "days", "days", ["rate"], repeated=True)
    return out.groupBy("by", F.col("l_suppkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("rate") + NUDGE, 8).alias("mean_rate"))


def q_nearest_time(spark: SparkSession, folder: str) -> DataFrame:
    """Index at 15:00 Chicago time of each day, from the trade nearest in time within 90 minutes."""
    trades = tape(spark, folder, ("timestamp", "index_price_usd")).where("index_price_usd > 0").withColumn("all", F.lit(0))
    days = trades.select(F.timestamp_millis("timestamp").cast("date").alias("day")).distinct()
    anchor = F.unix_millis(F.to_utc_timestamp(F.date_add("day", 0).cast("timestamp") + F.expr("interval 15 hours"), "America/Chicago"))
    anchors = days.select("day", F.lit(0).alias("all"), anchor.alias("anchor_ms"))
    rows = trades.groupBy("all", "timestamp").agg(F.min(F.struct("trade_id", "index_price_usd"))["index_price_usd"].alias("index_price_usd"))
    out = asof.nearest_join(anchors, rows, ["all"], "anchor_ms", "timestamp", ["index_price_usd"], 90 * 60_000, 24 * 3_600_000)
    return out.select("day", "anchor_ms", "index_price_usd")


def q_resample15(spark: SparkSession, folder: str) -> DataFrame:
    """Deviation of 15-minute log returns of the index per day."""
    return _rounded(ordered.resampled_deviation(tape(spark, folder, ("timestamp", "index_price_usd")), "timestamp", "index_price_usd", "trade_id"), 8)


def q_vw_time(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.weighted_time(tape(spark, folder, ("date", "timestamp", "amount")), "date", "timestamp", "amount")


def q_roll_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Roll half-spread of each contract and day."""
    rows = tape(spark, folder, ("instrument_name", "date", "timestamp", "strike", "price_usd")).where("strike is not null")
    return _rounded(ordered.roll_half_spread(rows, ["instrument_name", "date"], ["timestamp", "trade_id"], "price_usd"), 6)


def q_strip_cost(spark: SparkSession, folder: str, least_strikes: int = 2) -> DataFrame:
    """Cost of trading the variance strip of each day's expiry nearest 27 days at a relative half-spread of 5 %."""
    daily = cross_section(spark, folder).where(options.out_of_the_money())
    near = options.nearest_maturity(daily).select("date", "expiration")
    rows = daily.join(near, ["date", "expiration"], "left_semi")
    once = rows.groupBy("date", "expiration", "strike").agg(F.min(F.struct("callput", "settlementprice", "forward_price")).alias("_r"))
    once = once.select("date", "strike", "_r.settlementprice", "_r.forward_price").where("settlementprice > 0")
    day = Window.partitionBy("date")
    middle = once.withColumns({"_f": F.percentile("forward_price", F.lit(0.5)).over(day), "_n": F.count(F.lit(1)).over(day)}).where(F.col("_n") >= least_strikes)
    strip = middle.withColumns(ordered.strip_weights(F.col("strike"), F.col("_f"), day.orderBy("strike")))
    return _rounded(strip.groupBy("date").agg(F.count(F.lit(1)).alias("n_strikes"), F.sum(F.col("weight") * F.col("width") * F.col("settlementprice") * 0.05).alias("cost")), 10)


_TAPE = """
with tape as (select trade_id, date, timestamp, instrument_name, expiration, strike, upper(trim(callput)) as callput, lower(trim(direction)) as direction,
    days_to_expiry, tau, price_btc, price_usd, mark_price_btc, mark_price_usd, case when not isnan(iv) then iv end as iv, index_price_usd, amount
    from (select *, row_number() over (partition by trade_id order by ingested_at) as nth from btc_options_trades) where nth = 1)
"""
_DAILY = """, daily as (select date, expiration, strike, callput, sum(amount * price_btc) / nullif(sum(amount), 0) as price_btc,
    sum(amount * price_usd) / nullif(sum(amount), 0) as price_usd, sum(amount * iv) / nullif(sum(amount), 0) as iv,
    arg_max(mark_price_btc, (timestamp, trade_id)) filter (mark_price_btc is not null) as mark_price_btc,
    arg_max(mark_price_usd, (timestamp, trade_id)) filter (mark_price_usd is not null) as settlementprice,
    arg_max(index_price_usd, (timestamp, trade_id)) filter (index_price_usd is not null) as spot_price,
    sum(amount) as volume, count(amount) as n_trades, min(days_to_expiry) as days_to_expiry, min(tau) as tau
    from tape where date is not null and expiration is not null and strike is not null and callput is not null {usable}
    group by date, expiration, strike, callput)
"""
_ALL = _TAPE + _DAILY.format(usable="")
_USABLE = _TAPE + _DAILY.format(usable="and iv > 0 and price_btc > 0 and price_usd > 0 and amount > 0")
_FORWARD = (
    _USABLE
    + """, a as (select *, first_value(case when spot_price is not null then strike end) over (partition by date, expiration
        order by case when spot_price is null then 1 else 0 end, abs(strike - spot_price), strike) as atm from daily),
    b as (select *, max(case when strike = atm and callput = 'C' then settlementprice end) over s as c,
        max(case when strike = atm and callput = 'P' then settlementprice end) over s as p from a window s as (partition by date, expiration)),
    f as (select *, coalesce(atm + (c - p), spot_price) as forward_price from b),
    x as (select *, (forward_price - spot_price) / nullif(spot_price, 0) as basis,
        case when strike > 0 and forward_price > 0 then ln(strike / forward_price) end as log_moneyness from f)
"""
)
_OTM = "((callput = 'C' and strike >= forward_price) or (callput = 'P' and strike <= forward_price))"
_NEAR = """, sl as (select date, expiration, min(days_to_expiry) as days_to_expiry, min(tau) as tau, avg(forward_price) as forward_price, avg(spot_price) as spot_price
    from {t} group by all), near as (select * from (select *, row_number() over (partition by date order by abs(days_to_expiry - 27), days_to_expiry, expiration) as k from sl) where k = 1)"""

SQL = {
    "q_vwap": f"""{_ALL} select date, expiration, strike, callput, round(price_btc + 3.1e-10, 8) as price_btc, round(price_usd + 3.1e-10, 8) as price_usd, round(iv + 3.1e-10, 8) as iv,
        round(mark_price_btc + 3.1e-10, 8) as mark_price_btc, round(settlementprice + 3.1e-10, 8) as settlementprice, round(spot_price + 3.1e-10, 8) as spot_price, round(volume + 3.1e-10, 8) as volume,
        n_trades, days_to_expiry, round(tau + 3.1e-10, 8) as tau from daily""",
    "q_min_trades": f"{_ALL} select date, expiration, strike, callput, n_trades from daily where n_trades >= 3",
    "q_pcp_forward": f"""{_FORWARD} select date, expiration, strike, callput, round(spot_price + 3.1e-10, 8) as spot_price, round(forward_price + 3.1e-10, 8) as forward_price,
        round(basis + 3.1e-10, 8) as basis, round(log_moneyness + 3.1e-10, 8) as log_moneyness from x""",
    "q_fs_override": f"""{_FORWARD} select date, expiration, strike, callput,
        round(case when spot_price > 0 and forward_price > 0 then spot_price else forward_price end + 3.1e-10, 8) as forward_price, round(basis + 3.1e-10, 8) as basis,
        round(case when spot_price > 0 and forward_price > 0 then log_moneyness + ln(forward_price / spot_price) else log_moneyness end + 3.1e-10, 8) as log_moneyness from x""",
    "q_filters": f"""{_FORWARD} select date, expiration, strike, callput, round(iv + 3.1e-10, 8) as iv, round(tau + 3.1e-10, 8) as tau, round(forward_price + 3.1e-10, 8) as forward_price from x
        where days_to_expiry between 10 and 180 and {_OTM} and abs(log_moneyness) <= 3.0 * sqrt(tau) and iv between 0.01 and 5""",
    "q_attrition": f"""{_TAPE}, t as (select coalesce(iv > 0, false) as a, coalesce(amount > 0, false) as b, coalesce(price_btc > 0 and price_usd > 0, false) as c,
            coalesce(days_to_expiry between 10 and 180, false) as d, coalesce(iv between 0.01 and 5, false) as e from tape),
        n as (select count(*) as n0, count(*) filter (a) as n1, count(*) filter (a and b) as n2, count(*) filter (a and b and c) as n3,
            count(*) filter (a and b and c and d) as n4, count(*) filter (a and b and c and d and e) as n5 from t)
        select * from (select 1 as step_no, '{_STEPS[0]}' as step, n0 as n_before, n1 as n_after from n union all select 2, '{_STEPS[1]}', n1, n2 from n
        union all select 3, '{_STEPS[2]}', n2, n3 from n union all select 4, '{_STEPS[3]}', n3, n4 from n union all select 5, '{_STEPS[4]}', n4, n5 from n)""",
    "q_sentinels": """select upper(trim(venue)) as venue, count(*) as n_rows, count(*) filter (rmse = -99.99) as n_sentinel,
        count(*) filter (rmse is null or isnan(rmse)) as n_missing, count(*) filter (rmse <> -99.99 and rmse is not null and not isnan(rmse)) as n_left from ssvi_diagnostics group by 1""",
    "q_parse_instrument": """with n as (select instrument_name, count(*) as n_rows from btc_options_trades group by 1),
        p as (select *, string_split(instrument_name, '-') as s from n),
        g as (select *, try_strptime(lower(s[2]), '%-d%b%y')::date as d, try_cast(s[3] as double) as k, case when s[4] in ('C', 'P') then s[4] end as c from p)
        select instrument_name, n_rows, case when ok then d end as expiration, case when ok then k end as strike, case when ok then c end as callput
        from (select *, len(s) = 4 and d is not null and k is not null and c is not null as ok from g)""",
    "q_units": f"""{_TAPE} select date, count(*) as n_rows, count(*) filter (datediff('day', date, expiration) = days_to_expiry) as n_days_agree,
        count(*) filter (abs(datediff('day', date, expiration) / 365.25::double - tau) < 1e-5) as n_tau_agree,
        count(*) filter (abs(price_btc * index_price_usd - price_usd) <= 1e-3 + 1e-6 * price_usd) as n_price_agree from tape where expiration is not null group by 1""",
    "q_daily_basis": f"""{_FORWARD} select date, round(avg(basis) + 3.1e-10, 7) as basis_mean, round(median(basis) + 3.1e-10, 7) as basis_median,
        round(arg_max(coalesce(spot_price, 'nan'::double), (expiration, strike, callput)) + 3.1e-10, 7) as spot_price, round(avg(forward_price) + 3.1e-10, 7) as forward_price_mean, count(distinct expiration) as n_slices from x group by 1""",
    "q_carry_basis": f"""{_FORWARD}{_NEAR.format(t="x")} select date, expiration, days_to_expiry,
        round((forward_price / nullif(spot_price, 0) - 1) / greatest(tau, 1e-6) + 3.1e-10, 6) as carry from near""",
    "q_atm_iv": f"""{_FORWARD} select date, expiration, strike, callput, round(iv + 3.1e-10, 8) as iv from
        (select *, row_number() over (partition by date, expiration order by abs(strike - forward_price) nulls first, strike, callput) as k from x) where k = 1""",
    "q_data_summary": f"""{_USABLE}, s as (select date, expiration, count(*) as n, count(*) filter (callput = 'C') as c, count(*) filter (callput = 'P') as p from daily group by all),
        d as (select date, sum(n) as n, sum(c) as c, sum(p) as p, count(*) as k from s group by 1)
        select sum(n) as n_rows, count(*) as n_days, min(date) as first_day, max(date) as last_day, median(n) as median_per_day, sum(c) as n_calls, sum(p) as n_puts,
        sum(k) as n_slices, (select median(n) from s) as median_per_slice from d""",
    "q_count_describe": """with d as (select date, count(*) as n from btc_options_trades group by 1) select year(date) as year, count(*) as n_days, round(avg(n) + 3.1e-10, 8) as mean,
        round(stddev_samp(n) + 3.1e-10, 8) as deviation, min(n) as least, round(quantile_cont(n, 0.25) + 3.1e-10, 8) as p25, round(quantile_cont(n, 0.5) + 3.1e-10, 8) as p50, round(quantile_cont(n, 0.75) + 3.1e-10, 8) as p75, max(n) as most from d group by 1""",
    "q_value_counts": f"{_TAPE} select callput, direction, count(*) as n_trades from tape group by all",
    "q_commonest_maturity": f"{_TAPE} select days_to_expiry, count(*) as n_trades from tape where days_to_expiry is not null group by 1 order by 2 desc, 1 limit 10",
    "q_asof_rate": """with curve as (select cast(p_size % 7 + 1 as int) as by, cast(p_size as double) as days, avg(p_retailprice) / 1e5 as rate from part group by all),
        u as (select distinct cast(l_linenumber as int) as by, l_quantity as q from lineitem),
        m as (select u.by, u.q, arg_min(c.rate, (abs(c.days - u.q), c.days)) as rate from u left join curve c on c.by = u.by group by all)
        select m.by, l.l_suppkey, count(*) as n_lines, round(avg(m.rate) + 3.1e-10, 8) as mean_rate from lineitem l join m on m.by = l.l_linenumber and m.q = l.l_quantity group by all""",
    "q_nearest_time": f"""{_TAPE}, t as (select timestamp, arg_min(index_price_usd, trade_id) as index_price_usd from tape where index_price_usd > 0 group by 1),
        d as (select distinct cast(epoch_ms(timestamp) as date) as day from t),
        a as (select day, epoch_ms(timezone('America/Chicago', day::timestamp + interval 15 hour)) as anchor_ms from d)
        select a.day, a.anchor_ms, arg_min(t.index_price_usd, (abs(t.timestamp - a.anchor_ms), t.timestamp)) as index_price_usd
        from a left join t on t.timestamp between a.anchor_ms - 5400000 and a.anchor_ms + 5400000 group by all""",
    "q_resample15": f"""{_TAPE}, b as (select timestamp // 900000 as bar, arg_max(index_price_usd, (timestamp, trade_id)) as x from tape where index_price_usd > 0 group by 1),
        r as (select cast(epoch_ms(bar * 900000) as date) as day, ln(x / lag(x) over (partition by cast(epoch_ms(bar * 900000) as date) order by bar)) as r from b)
        select day, count(*) as n_bars, round(case when count(r) >= 4 then stddev_samp(r) end + 3.1e-10, 8) as deviation from r group by 1""",
    "q_vw_time": f"{_TAPE} select date, cast(round(sum(amount * (timestamp / 1000.0::double)) / sum(amount)) as bigint) as seconds, count(*) as n_rows from tape where amount > 0 group by 1",
    "q_roll_spread": f"""{_TAPE}, d as (select *, price_usd - lag(price_usd) over w as d from tape where strike is not null and price_usd is not null window w as (partition by instrument_name, date order by timestamp, trade_id)),
        e as (select *, lag(d) over (partition by instrument_name, date order by timestamp, trade_id) as b from d)
        select instrument_name, date, count(*) as n, round(case when covar_samp(d, b) < 0 then sqrt(-covar_samp(d, b)) end + 3.1e-10, 6) as half_spread from e group by all""",
    "q_strip_cost": f"""{_FORWARD}, o as (select * from x where {_OTM}){_NEAR.format(t="o")},
        u as (select o.date, strike, arg_min(settlementprice, callput) as s, arg_min(o.forward_price, callput) as f from o join near n on n.date = o.date and n.expiration = o.expiration group by all),
        v as (select *, median(f) over (partition by date) as m, count(*) over (partition by date) as n, lag(strike) over w as lo, lead(strike) over w as hi from u where s > 0 window w as (partition by date order by strike)),
        z as (select *, abs(2.0 * (1 - ln(strike / m)) / (strike * strike)) as weight, case when lo is null then hi - strike when hi is null then strike - lo else (hi - lo) / 2 end as width from v where n >= 2)
        select date, count(*) as n_strikes, round(sum(weight * width * s * 0.05) + 3.1e-10, 10) as cost from z group by 1""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
