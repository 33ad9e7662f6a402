"""Queries and SQL of the general training-data problems (1 and 3 to 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.operators import plausibility, regular, rolling, skew
from skewline.sources.tables import table

#: Period of the regular series: four hours.
PERIOD_MS = 4 * 3600 * 1000

CONTRACT = {"expiration": F.col, "strike": F.col, "callput": lambda c: skew.side_code(F.col(c))}


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages per feed and calendar day."""
    out = rolling.rolling_totals(table(spark, folder, "cleaned_auxiliary"), "source", "date", ["btc_spot", "rv"], (7, 30), "loaded_at")
    return out.select(*[F.round(c, 8 if c.startswith("rv") else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days without a usable value, by feed and field."""
    fields = ["btc_spot", "rv"]
    totals = rolling.rolling_totals(table(spark, folder, "cleaned_auxiliary"), "source", "date", fields, (1, 7, 30), "loaded_at")
    gaps = rolling.inactive_days(totals, "source", "date", fields)
    return gaps.select("source", F.date_format("date", "yyyy-MM-dd").alias("gap_date"), "field_name")


def _contract_frequencies(trades: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    keys = {c: f(c) for c, f in CONTRACT.items()}
    return skew.value_frequencies(trades, keys, F.col(value), F.col(weight) if weight else None)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts with at least 2 % of all rows."""
    heavy = skew.heavy_keys(_contract_frequencies(table(spark, folder, "btc_options_trades"), "price_btc"), list(CONTRACT), 0.02)
    return heavy.select(F.date_format("expiration", "yyyy-MM-dd").alias("expiration"), F.col("strike").cast("bigint").alias("strike"), "callput")


def p3_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Per contract: rows, distinct prices, most frequent price and volume-weighted price, of all rows as stored (as ``p3_found`` counts them)."""
    out = skew.key_totals(_contract_frequencies(table(spark, folder, "btc_options_trades"), "price_btc", "amount"), list(CONTRACT))
    return out.where("expiration is not null and strike is not null and callput is not null").select(
        *CONTRACT, "n_rows", "n_values", "n_distinct", "mode", "minimum", "maximum", F.round("weighted_mean", 10).alias("vwap")
    )


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quartiles of the USD price per contract, from weighted values."""
    return skew.key_percentiles(_contract_frequencies(table(spark, folder, "btc_options_trades"), "price_usd"), list(CONTRACT), (0.25, 0.5, 0.75))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Empty four-hour periods of each contract."""
    trades = table(spark, folder, "btc_options_trades").where("strike is not null")
    series = regular.regular_series(trades, "instrument_name", "timestamp", ["price_usd"], PERIOD_MS, key="trade_id")
    return series.where("(status = 'filled' and value is not null) or status = 'gap'").select("instrument_name", "period_start_ms")


def p4_series(spark: SparkSession, folder: str) -> DataFrame:
    """Regular four-hour series of price, volatility and mark per contract."""
    trades = table(spark, folder, "btc_options_trades").where("strike is not null")
    series = regular.regular_series(trades, "instrument_name", "timestamp", ["price_usd", "iv", "mark_price_usd"], PERIOD_MS, key="trade_id")
    return series.withColumn("value", F.round(F.col("value") + 3.1e-8, 6))


P5_RULES = [
    plausibility.Rule("iv", "neighbours", 3.0, 1 / 3, stuck=8),
    plausibility.Rule("price_btc", "mark_price_btc", 4.0, 0.25, upper="case when upper(trim(callput)) = 'C' then 1.0 end"),
    plausibility.Rule("amount", "median", 30.0),
    plausibility.Rule("index_price_usd", "index_reference", 1.25, 0.75, stuck=8),
]


def p5_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings with their contract."""
    trades = table(spark, folder, "btc_options_trades")
    reference = plausibility.time_reference(trades.where("strike is not null"), "timestamp", "index_price_usd")
    return plausibility.implausible_readings(
        trades.where("strike is not null"), "instrument_name", "timestamp", "trade_id", P5_RULES, 30, ("index_reference", reference)
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings: trade and field."""
    return p5_readings(spark, folder).select("trade_id", "field_name")


_P1_DAYS = """
with raw as (select source, date, loaded_at, case when btc_spot > 0 and not isnan(btc_spot) then btc_spot end as btc_spot,
    case when rv > 0 and not isnan(rv) then rv end as rv from cleaned_auxiliary where source is not null and date is not null),
spot as (select source, date, btc_spot from (select *, row_number() over (partition by source, date order by loaded_at desc, btc_spot desc) as k
    from raw where btc_spot is not null) where k = 1),
vol as (select source, date, rv from (select *, row_number() over (partition by source, date order by loaded_at desc, rv desc) as k
    from raw where rv is not null) where k = 1),
span as (select source, min(date) as a, max(date) as b from raw group by source),
cal as (select source, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from span),
days as (select c.source, c.date, s.btc_spot, v.rv from cal c left join spot s on s.source = c.source and s.date = c.date
    left join vol v on v.source = c.source and v.date = c.date)
"""


def _p1_totals_sql() -> str:
    columns = []
    for f in ("btc_spot", "rv"):
        for p in (7, 30):
            over = f"over (partition by source order by date range between interval {p - 1} day preceding and current row)"
            digits = 8 if f == "rv" else 4
            columns += [
                f"round(coalesce(sum({f}) {over}, 0), {digits}) as {f}_total_{p}d",
                f"round(coalesce(sum({f}) {over}, 0) / {p}.0::double, {digits}) as {f}_avg_{p}d",
                f"count({f}) {over} as {f}_days_{p}d",
            ]
    return f"{_P1_DAYS} select source, date, round(btc_spot, 4) as btc_spot, round(rv, 8) as rv, {', '.join(columns)} from days"



_P5 = """
with t as (select trade_id, any_value(instrument_name) as s, any_value(timestamp) as ts, any_value(case when not isnan(iv) then iv end) as iv,
        any_value(case when not isnan(price_btc) then price_btc end) as price, any_value(mark_price_btc) as mark,
        any_value(case when not isnan(amount) then amount end) as amount,
        any_value(case when not isnan(index_price_usd) then index_price_usd end) as idx, any_value(upper(trim(callput))) as side
    from btc_options_trades where strike is not null and trade_id is not null and instrument_name is not null and timestamp is not null group by trade_id),
u as (select * from (select *, count(*) over (partition by s) as n, median(amount) over (partition by s) as middle from t) where n >= 30),
h as (select ts // 3600000 as step, median(idx) as m, count(*) as n from t where idx > 0 group by 1),
r as (select step, {spans} from h),
ref as (select step, coalesce({chosen}, m24) as m from r),
ivrun as (select *, count(*) over (partition by s, iv, g) as len from (select *, row_number() over (partition by s order by ts, trade_id)
    - row_number() over (partition by s, iv order by ts, trade_id) as g from u where iv is not null)),
iv1 as (select *, median(ln(iv)) over (partition by s order by ts, trade_id rows between 4 preceding and 4 following exclude current row) as near
    from ivrun where iv > 0 and len < 8),
iv2 as (select *, median(case when near is null or abs(ln(iv) - near) < ln(2) then ln(iv) end) over (partition by s order by ts, trade_id
    rows between 8 preceding and 8 following exclude current row) as clean from iv1),
idxrun as (select *, count(*) over (partition by s, idx, g) as len from (select *, row_number() over (partition by s order by ts, trade_id)
    - row_number() over (partition by s, idx order by ts, trade_id) as g from u where idx is not null)),
found as (
    select trade_id, s, 'iv' as field_name from u where iv <= 0
    union select trade_id, s, 'iv' from iv2 where abs(ln(iv) - clean) >= ln(3)
    union select trade_id, s, 'iv' from ivrun where len >= 8
    union select trade_id, s, 'price_btc' from u where price <= 0 or (side = 'C' and price > 1) or (mark > 0 and (price >= 4 * mark or price <= mark / 4))
    union select trade_id, s, 'amount' from u where amount <= 0 or amount >= 30 * middle
    union select trade_id, s, 'index_price_usd' from u where idx <= 0
    union select trade_id, s, 'index_price_usd' from u join ref on ref.step = u.ts // 3600000 where idx >= 1.25 * m or idx <= 0.75 * m
    union select trade_id, s, 'index_price_usd' from idxrun where len >= 8)
"""
_P4_SERIES = f"""
with once as (select any_value(instrument_name) as s, any_value(timestamp) as ms, any_value(price_usd) as price_usd, any_value(iv) as iv, any_value(mark_price_usd) as mark_price_usd
        from btc_options_trades where strike is not null and instrument_name is not null and timestamp is not null group by trade_id),
r as (select s, 'price_usd' as f, ms, price_usd as v from once union all select s, 'iv', ms, iv from once union all select s, 'mark_price_usd', ms, mark_price_usd from once),
k as (select s, f, ms, ms // {PERIOD_MS} as p, ms / {PERIOD_MS}.0::double as t, avg(v) as v, count(*) as n from r where v is not null and not isnan(v) group by all),
m as (select s, f, p, sum(v * n) / sum(n) as mean from k group by all),
w as (select *, lag(t) over o as t0, lag(v) over o as v0, lag(p) over o as p0, lead(t) over o as t2, lead(v) over o as v2, lead(p) over o as p2,
        lead(t, 2) over o as t3, lead(v, 2) over o as v3, lead(p, 2) over o as p3 from k window o as (partition by s, f order by ms)),
g as (select *, p2 - p <= 13 as short, case when p - p0 <= 13 then t - t0 end as h0, t2 - t as h1, case when p3 - p2 <= 13 then t3 - t2 end as h2 from w where p2 > p + 1),
d as (select *, (v - v0) / h0 as d0, (v2 - v) / h1 as d1, (v3 - v2) / h2 as d2 from g),
c as (select *, case when h0 is not null then (case when d0 * d1 <= 0 then 0 else (3 * (h0 + h1)) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) end)
        when h2 is not null then (case when sign(ea) <> sign(d1) then 0 when sign(d1) <> sign(d2) and abs(ea) > 3 * abs(d1) then 3 * d1 else ea end) else d1 end as s1,
    case when h2 is not null then (case when d1 * d2 <= 0 then 0 else (3 * (h1 + h2)) / ((2 * h2 + h1) / d1 + (h2 + 2 * h1) / d2) end)
        when h0 is not null then (case when sign(eb) <> sign(d1) then 0 when sign(d1) <> sign(d0) and abs(eb) > 3 * abs(d1) then 3 * d1 else eb end) else d1 end as s2
    from (select *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) as ea, ((2 * h1 + h0) * d1 - h1 * d0) / (h1 + h0) as eb from d)),
x as (select *, unnest(range(p + 1, p2)) as cell from c),
y as (select *, (cell + 0.5::double - t) / h1 as u from x)
select s as instrument_name, f as field_name, cast(p * {PERIOD_MS} as bigint) as period_start_ms, round(mean + 3.1e-8, 6) as value, 'observed' as status from m
union all select s, f, cast(cell * {PERIOD_MS} as bigint), case when short then round(v * (2 * u * u * u - 3 * u * u + 1) + s1 * h1 * (u * u * u - 2 * u * u + u) + v2 * (3 * u * u - 2 * u * u * u)
    + s2 * h1 * (u * u * u - u * u) + 3.1e-8, 6) end, case when short then 'filled' else 'gap' end from y
"""

_SPANS = (2, 6, 24)
_P5 = _P5.replace(
    "{spans}",
    ", ".join(f"median(m) over (order by step range between {k} preceding and {k} following) as m{k}, sum(n) over (order by step range between {k} preceding and {k} following) as n{k}" for k in _SPANS),
).replace("{chosen}", ", ".join(f"case when n{k} >= 9 then m{k} end" for k in _SPANS))

SQL = {
    "p1_totals": _p1_totals_sql(),
    "p1_found": f"""{_P1_DAYS} select source, strftime(date, '%Y-%m-%d') as gap_date, 'btc_spot' as field_name from days where btc_spot is null
        union all select source, strftime(date, '%Y-%m-%d'), 'rv' from days where rv is null""",
    "p3_found": f"""select strftime(expiration, '%Y-%m-%d') as expiration, cast(strike as bigint) as strike, callput from
        (select expiration, strike, upper(trim(callput)) as callput, count(*) as n from btc_options_trades group by all)
        where expiration is not null and strike is not null and callput is not null and n >= 0.02 * (select count(*) from btc_options_trades)""",
    "p3_contracts": f"""with v as (select expiration, strike, upper(trim(callput)) as callput,
            case when not isnan(price_btc) then price_btc end as price, amount from btc_options_trades),
        f as (select expiration, strike, callput, price, count(*) as n from v where price is not null group by all),
        m as (select expiration, strike, callput, price as mode from
            (select *, row_number() over (partition by expiration, strike, callput order by n desc, price) as k from f) where k = 1),
        a as (select expiration, strike, callput, count(*) as n_rows, count(price) as n_values, count(distinct price) as n_distinct,
            min(price) as minimum, max(price) as maximum,
            round(case when sum(amount) filter (price is not null) > 0 then sum(price * amount) / sum(amount) filter (price is not null) end, 10) as vwap
            from v where expiration is not null and strike is not null and callput is not null group by all)
        select a.*, m.mode from a left join m on m.expiration = a.expiration and m.strike = a.strike and m.callput = a.callput""",
    "p3_percentiles": """select expiration, strike, callput, p, case p when 0.25 then a when 0.5 then b else c end as percentile from
        (select expiration, strike, upper(trim(callput)) as callput, quantile_disc(price_usd, 0.25) as a, quantile_disc(price_usd, 0.5) as b,
            quantile_disc(price_usd, 0.75) as c from btc_options_trades where price_usd is not null and not isnan(price_usd)
            and expiration is not null and strike is not null and callput is not null group by all),
        (select unnest([0.25::double, 0.5::double, 0.75::double]) as p)""",
    "p4_found": f"""with k as (select distinct instrument_name, timestamp // {PERIOD_MS} as period from btc_options_trades
            where strike is not null and price_usd is not null and not isnan(price_usd) and instrument_name is not null and timestamp is not null),
        n as (select *, lead(period) over (partition by instrument_name order by period) as next from k)
        select instrument_name, cast(unnest(range(period + 1, next)) * {PERIOD_MS} as bigint) as period_start_ms from n where next > period + 1""",
    "p4_series": _P4_SERIES,
    "p5_found": f"{_P5} select trade_id, field_name from found",
    "p5_readings": f"{_P5} select trade_id, field_name, s as instrument_name from found",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_totals": p1_totals,
    "p3_found": p3_found,
    "p3_contracts": p3_contracts,
    "p3_percentiles": p3_percentiles,
    "p4_found": p4_found,
    "p4_series": p4_series,
    "p5_found": p5_found,
    "p5_readings": p5_readings,
}
