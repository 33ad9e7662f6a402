"""Queries over the daily panels: returns, rolling statistics, regimes, runs, coverage, venue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from skewline.operators import ordered, panel, skew
from skewline.plans.trades import NUDGE, _rounded
from skewline.sources.tables import table, without_nan

FIELDS = ["btc_spot", "rv", "vix", "dvol", "baa_spread", "dgs2", "dxy", "fng"]
LABELS = ["low", "mid", "high"]


def by_day() -> WindowSpec:
    return Window.partitionBy("source").orderBy("date")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per feed and day: the latest load, NaN and zero prices as null."""
    rows = panel.latest_rows(without_nan(table(spark, folder, "cleaned_auxiliary")), ["source", "date"], "loaded_at")
    return rows.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("btc_spot", "rv")})


def fits(spark: SparkSession, folder: str) -> DataFrame:
    """Surface fits once each, venues spelled alike, sentinel and NaN as null."""
    rows = without_nan(table(spark, folder, "ssvi_diagnostics").select("fit_id", "date", "venue", "rmse", "n_slices", "n_options", "fitted_at"))
    rows = rows.groupBy("fit_id").agg(F.max(F.struct("fitted_at", "date", "venue", "rmse", "n_slices", "n_options")).alias("_r")).select("fit_id", "_r.*")
    return rows.withColumns({"venue": F.upper(F.trim("venue")), "rmse": F.when(F.col("rmse") != -99.99, F.col("rmse"))})


def _returns(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder).where("btc_spot is not null").select("source", "date", "btc_spot", "rv")
    return rows.withColumn("r", ordered.log_return(F.col("btc_spot"), by_day()))


def _variances(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder).withColumn("variance", ordered.realised_variance(F.col("r"), by_day(), 30))


def _terciles(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.quantile_bins(_variances(spark, folder).where("variance is not null"), "variance", "regime", LABELS, ["source"])


def q_ffill(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder).select("source", "date", *[ordered.forward_filled(F.col(c), by_day()).alias(c) for c in FIELDS[2:]])
    return _rounded(rows)


def q_logret_rv(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_variances(spark, folder).select("source", "date", "r", "variance"))


def q_roll_var252(spark: SparkSession, folder: str) -> DataFrame:
    rows = _returns(spark, folder)
    return _rounded(rows.select("source", "date", ordered.rolling_variance(F.col("r"), by_day(), 252, 60, 27.0).alias("var_p"), ordered.rolling_mean(F.col("r"), by_day()).alias("mean27")))


def q_overlap_ret(spark: SparkSession, folder: str) -> DataFrame:
    rows = _returns(spark, folder)
    return _rounded(rows.select("source", "date", ordered.overlapping_return(F.col("btc_spot"), by_day(), 27).alias("gross")).where("gross is not null"))


def q_qcut(spark: SparkSession, folder: str) -> DataFrame:
    return _terciles(spark, folder).select("source", "date", "regime")


def q_tercile_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_terciles(spark, folder).groupBy("source", "regime").agg(F.count(F.lit(1)).alias("n"), F.min("variance").alias("least"), F.max("variance").alias("most")))


def q_decile_bins(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ordered.bin_means(daily(spark, folder), "vix", "dvol", 10, ["source"]))


def _high_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.runs(_terciles(spark, folder), F.col("regime") == "high", "date", ["source"])


def q_islands(spark: SparkSession, folder: str) -> DataFrame:
    return _high_runs(spark, folder)


def q_sessions60(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.merged_runs(_high_runs(spark, folder), ["source"], 60)


def q_topk_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.longest_runs(ordered.merged_runs(_high_runs(spark, folder), ["source"], 60), ["source"], 3, 15)


def q_zscore(spark: SparkSession, folder: str) -> DataFrame:
    over = Window.partitionBy("source")
    rows = daily(spark, folder)
    return _rounded(rows.select("source", "date", *[ordered.zscore(F.col(c), over).alias(c) for c in ("vix", "baa_spread", "dgs2", "dxy", "fng")]), 7)


def q_conditioning(spark: SparkSession, folder: str) -> DataFrame:
    """Conditioning vectors: z-scored columns with their raw values, on days complete in all of them."""
    over = Window.partitionBy("source")
    rows = daily(spark, folder).select("source", "date", "rv", "fng", "vix").na.drop()
    return _rounded(rows.select("source", "date", *[ordered.zscore(F.col(c), over).alias(c) for c in ("rv", "fng", "vix")], *[F.col(c).alias(f"{c}_raw") for c in ("rv", "fng", "vix")]), 7)


def q_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(panel.coverage(daily(spark, folder), "date", FIELDS, ["source"]), 6)


def q_corr(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(panel.correlations(daily(spark, folder), ["rv", "vix", "dvol", "fng"], ["source"]), 7)


def q_pivot_wedge(spark: SparkSession, folder: str) -> DataFrame:
    out = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse")
    return _rounded(out.select("date", F.col("DER").alias("der"), F.col("CME").alias("cme"), "wedge"))


def q_date_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which both venues have a fit, and how many each has."""
    rows = fits(spark, folder).where("rmse is not null and venue in ('CME', 'DER')")
    sides = rows.groupBy("date").agg(F.count_if(F.col("venue") == "CME").alias("n_cme"), F.count_if(F.col("venue") == "DER").alias("n_der"))
    return sides.where("n_cme > 0 and n_der > 0")


def q_regime_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _terciles(spark, folder)
    return _rounded(panel.by_regime(rows, ["source"], "regime", ["variance", "rv", "btc_spot"]), 6)


def q_year_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Fit error per venue and year, with the row of all years."""
    rows = fits(spark, folder).where("rmse is not null and venue is not null").withColumn("year", F.year("date").cast("string"))
    # a row counts for its year and for all years; values are compressed before either is put in order
    frequencies = skew.value_frequencies(rows, {"venue": F.col("venue"), "year": F.col("year")}, F.col("rmse"))
    both = frequencies.withColumn("year", F.explode(F.array("year", F.lit("all")))).groupBy("venue", "year", "_value").agg(F.sum("_rows").alias("_rows"))
    totals = both.groupBy("venue", "year").agg(F.sum("_rows").alias("n"), (F.sum(F.col("_value") * F.col("_rows")) / F.sum("_rows")).alias("mean"))
    median = skew.interpolated_percentiles(both, ["venue", "year"]).select("venue", "year", F.col("percentile").alias("median"))
    return _rounded(totals.join(median, ["venue", "year"]))


def q_moment_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = fits(spark, folder).where("venue is not null")
    return _rounded(rows.groupBy("venue").agg(*[f(c).alias(f"{c}_{n}") for c in ("rmse", "n_slices", "n_options") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]))


def q_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = fits(spark, folder).where("venue is not null and rmse is not null")
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    q = skew.interpolated_percentiles(skew.value_frequencies(rows, {"venue": F.col("venue")}, F.col("rmse")), ["venue"], tuple(at))
    return _rounded(q.groupBy("venue").agg(*[F.max(F.when(F.col("p") == a, F.col("percentile"))).alias(f"p{int(a * 100):02d}") for a in at]))


def q_share(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of fits over 3 % error and with fewer than four slices."""
    rows = fits(spark, folder).where("venue is not null and rmse is not null")
    return _rounded(rows.groupBy("venue").agg((100 * F.avg((F.col("rmse") > 0.03).cast("double"))).alias("pct_poor"), (100 * F.avg((F.col("n_slices") < 4).cast("double"))).alias("pct_few")))


def q_band(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference in fit error against a band of 1 %, by year."""
    wedge = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse").withColumns({"band": F.lit(0.01), "year": F.year("date")})
    return _rounded(panel.band_table(wedge, ["year"], "wedge", "band"))


def q_slice_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Error of single maturities out of the fits' maps, by venue and maturity bucket."""
    rows = table(spark, folder, "ssvi_diagnostics").select("fit_id", F.upper(F.trim("venue")).alias("venue"), "slice_rmses")
    once = rows.groupBy("fit_id").agg(F.any_value("venue").alias("venue"), F.any_value("slice_rmses").alias("slice_rmses"))
    each = once.where("venue is not null").select("venue", F.explode("slice_rmses").alias("days", "error")).where(F.col("error").isNotNull() & ~F.isnan("error") & (F.col("error") != -99.99))
    bucket = F.when(F.col("days") <= 14, "short").when(F.col("days") <= 60, "middle").otherwise("long")
    return _rounded(each.groupBy("venue", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms")))


def q_worst_fits(spark: SparkSession, folder: str) -> DataFrame:
    """The five worst fits of each venue."""
    order = Window.partitionBy("venue").orderBy(F.desc("rmse"), "fit_id")
    rows = fits(spark, folder).where("rmse is not null and venue is not null").withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return rows.select("venue", "rank", "fit_id", "date", "rmse")


def q_commonest_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent number of slices per venue (the smaller of two as frequent)."""
    counts = fits(spark, folder).where("venue is not null and n_slices is not null").groupBy("venue", "n_slices").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("venue").agg(F.max(F.struct("n", (-F.col("n_slices")).alias("b"))).alias("_m")).select("venue", (-F.col("_m.b")).alias("n_slices"), F.col("_m.n").alias("n"))


def q_skew_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per year block: runs in which the venues' median skews have the same sign."""
    rows = without_nan(table(spark, folder, "ssvi_skew_summary").select("run_id", F.upper(F.trim("venue")).alias("venue"), "year", "rho_median"))
    rows = rows.where("rho_median <> -99.99").groupBy("run_id", "year").pivot("venue", ["CME", "DER"]).agg(F.max("rho_median")).where("CME is not null and DER is not null")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.signum("CME") == F.signum("DER")).alias("n_agree"))


def q_event_dummies(spark: SparkSession, folder: str) -> DataFrame:
    """Mean volatility inside and outside the windows around three market events, per feed."""
    events = {"may2021": ("2021-05-10", "2021-06-10"), "terra": ("2022-05-05", "2022-06-05"), "ftx": ("2022-11-05", "2022-12-05")}
    rows = daily(spark, folder).where("rv is not null")
    aggregates = [F.avg("rv").alias("rv_all")]
    for name, (a, b) in events.items():
        inside = F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        aggregates += [F.count_if(inside).alias(f"n_{name}"), F.avg(F.when(inside, F.col("rv"))).alias(f"rv_{name}")]
    return _rounded(rows.groupBy("source").agg(*aggregates))


_PANEL = """
with panel as (select source, date, case when btc_spot > 0 and not isnan(btc_spot) then btc_spot end as btc_spot, case when rv > 0 and not isnan(rv) then rv end as rv,
    {rest} from (select *, row_number() over (partition by source, date order by loaded_at desc) as nth from cleaned_auxiliary) where nth = 1)
""".replace("{rest}", ", ".join(f"case when not isnan({c}) then {c} end as {c}" for c in FIELDS[2:]))
_RET = _PANEL + ", ret as (select source, date, btc_spot, rv, ln(btc_spot / lag(btc_spot) over w) as r from panel where btc_spot is not null window w as (partition by source order by date))"
_VAR = (
    _RET
    + ", va as (select *, case when count(r) over w = 30 then sum(r * r) over w * (365.25 / 30)::double end as variance from ret window w as (partition by source order by date rows between 29 preceding and current row))"
)
_TER = (
    _VAR
    + """, e as (select source, quantile_cont(variance, 1.0/3) as e1, quantile_cont(variance, 2.0/3) as e2 from va where variance is not null group by 1),
    ter as (select va.*, case when variance <= e1 then 'low' when variance <= e2 then 'mid' else 'high' end as regime from va join e on e.source = va.source where variance is not null)"""
)
_RUNS = (
    _TER
    + """, i as (select *, row_number() over (partition by source order by date) - row_number() over (partition by source, regime = 'high' order by date) as g from ter),
    runs as (select source, min(date) as first_day, max(date) as last_day, count(*) as n_rows from i where regime = 'high' group by source, g)"""
)
_MERGED = (
    _RUNS
    + """, m1 as (select *, case when datediff('day', lag(last_day) over w, first_day) >= 60 or lag(last_day) over w is null then 1 else 0 end as new from runs window w as (partition by source order by first_day)),
    m2 as (select *, sum(new) over (partition by source order by first_day rows unbounded preceding) as s from m1),
    merged as (select source, min(first_day) as first_day, max(last_day) as last_day, sum(n_rows)::bigint as n_rows, count(*) as n_runs from m2 group by source, s)"""
)
_FITS = """
with fits as (select fit_id, date, upper(trim(venue)) as venue, case when not isnan(rmse) and rmse <> -99.99 then rmse end as rmse, n_slices, n_options
    from (select *, row_number() over (partition by fit_id order by fitted_at desc) as nth from ssvi_diagnostics) where nth = 1)
"""


def _r(x: str, digits: int = 8) -> str:
    return f"round({x} + {NUDGE}, {digits})"


def _z(c: str, source: str = "panel") -> str:
    return _r(f"case when stddev_pop({c}) over w > 1e-12 then ({c} - avg({c}) over w) / stddev_pop({c}) over w end", 7)


_WEDGE = _FITS + ", w as (select date, avg(rmse) filter (venue = 'DER') as der, avg(rmse) filter (venue = 'CME') as cme from fits group by 1), wedge as (select *, der - cme as wedge from w where der is not null and cme is not null)"
_PAIRS = [(a, b) for i, a in enumerate(("rv", "vix", "dvol", "fng")) for b in ("rv", "vix", "dvol", "fng")[i + 1 :]]
_EVENTS = {"may2021": ("2021-05-10", "2021-06-10"), "terra": ("2022-05-05", "2022-06-05"), "ftx": ("2022-11-05", "2022-12-05")}

SQL = {
    "q_ffill": _PANEL
    + " select source, date, "
    + ", ".join(f"{_r(f'last_value({c} ignore nulls) over w')} as {c}" for c in FIELDS[2:])
    + " from panel window w as (partition by source order by date rows between unbounded preceding and current row)",
    "q_logret_rv": f"{_VAR} select source, date, {_r('r')} as r, {_r('variance')} as variance from va",
    "q_roll_var252": f"""{_RET} select source, date, {_r("case when count(r) over w >= 60 then var_samp(r) over w * 27 end")} as var_p,
        {_r("case when count(r) over v >= 10 then avg(r) over v end")} as mean27 from ret window w as (partition by source order by date rows between 251 preceding and current row),
        v as (partition by source order by date rows between 26 preceding and current row)""",
    "q_overlap_ret": f"{_RET} select source, date, {_r('x')} as gross from (select source, date, lead(btc_spot, 27) over (partition by source order by date) / btc_spot as x from ret) where x is not null",
    "q_qcut": f"{_TER} select source, date, regime from ter",
    "q_tercile_edges": f"{_TER} select source, regime, count(*) as n, {_r('min(variance)')} as least, {_r('max(variance)')} as most from ter group by all",
    "q_decile_bins": f"""{_PANEL}, c as (select source, vix, dvol from panel where vix is not null and dvol is not null),
        e as (select source, quantile_cont(vix, [{", ".join(f"{i}/10.0" for i in range(1, 10))}]) as e from c group by 1),
        b as (select c.*, len(list_filter(e.e, lambda x: x < c.vix)) as bin from c join e on e.source = c.source)
        select source, bin::int as bin, count(*) as n, {_r("avg(vix)")} as mean_by, {_r("avg(dvol)")} as mean_value from b group by all""",
    "q_islands": f"{_RUNS} select * from runs",
    "q_sessions60": f"{_MERGED} select * from merged",
    "q_topk_runs": f"{_MERGED} select * from (select *, row_number() over (partition by source order by n_rows desc, first_day) as rank from merged where n_rows >= 15) where rank <= 3",
    "q_zscore": _PANEL + " select source, date, " + ", ".join(f"{_z(c)} as {c}" for c in ("vix", "baa_spread", "dgs2", "dxy", "fng")) + " from panel window w as (partition by source)",
    "q_conditioning": _PANEL
    + ", c as (select source, date, rv, fng, vix from panel where rv is not null and fng is not null and vix is not null) select source, date, "
    + ", ".join(f"{_z(c)} as {c}" for c in ("rv", "fng", "vix"))
    + ", "
    + ", ".join(f"{_r(c, 7)} as {c}_raw" for c in ("rv", "fng", "vix"))
    + " from c window w as (partition by source)",
    "q_coverage": _PANEL
    + " union all ".join(
        f"""{'' if i else ''} select source, '{name}' as field, count(*) filter ({ok}) as n_valid, {_r(f"count(*) filter ({ok}) * 100.0::double / count(*)", 6)} as pct_valid,
        min(date) filter ({ok}) as first_valid, max(date) filter ({ok}) as last_valid from panel group by source"""
        for i, (name, ok) in enumerate([*[(c, f"{c} is not null") for c in FIELDS], ("complete case", " and ".join(f"{c} is not null" for c in FIELDS))])
    ),
    "q_corr": _PANEL
    + " union all ".join(
        f""" select source, '{a}' as field_a, '{b}' as field_b, count(*) filter ({a} is not null and {b} is not null) as n,
        {_r(f"corr({a}, {b})", 7)} as correlation from panel group by source"""
        for a, b in _PAIRS
    ),
    "q_pivot_wedge": f"{_WEDGE} select date, {_r('der')} as der, {_r('cme')} as cme, {_r('wedge')} as wedge from wedge",
    "q_date_intersect": f"""{_FITS} select * from (select date, count(*) filter (venue = 'CME') as n_cme, count(*) filter (venue = 'DER') as n_der from fits
        where rmse is not null group by 1) where n_cme > 0 and n_der > 0""",
    "q_regime_table": f"""{_TER} select source, case when grouping(regime) = 1 then 'all' else regime end as regime, count(*) as n, {_r("avg(variance)", 6)} as variance,
        {_r("avg(rv)", 6)} as rv, {_r("avg(btc_spot)", 6)} as btc_spot from ter group by grouping sets ((source, regime), (source))""",
    "q_year_rollup": f"""{_FITS}, y as (select venue, year(date)::varchar as year, rmse from fits where rmse is not null and venue is not null)
        select venue, case when grouping(year) = 1 then 'all' else year end as year, count(*) as n, {_r("avg(rmse)")} as mean, {_r("median(rmse)")} as median
        from y group by grouping sets ((venue, year), (venue))""",
    "q_moment_summary": f"{_FITS} select venue, "
    + ", ".join(f"{_r(f'{f}({c})')} as {c}_{n}" for c in ("rmse", "n_slices", "n_options") for n, f in (("mean", "avg"), ("std", "stddev_samp")))
    + " from fits where venue is not null group by 1",
    "q_quantiles": f"{_FITS} select venue, "
    + ", ".join(f"{_r(f'quantile_cont(rmse, {a})')} as p{int(a * 100):02d}" for a in (0.05, 0.25, 0.5, 0.75, 0.95))
    + " from fits where venue is not null and rmse is not null group by 1",
    "q_share": f"""{_FITS} select venue, {_r("100 * avg((rmse > 0.03)::int::double)")} as pct_poor, {_r("100 * avg((n_slices < 4)::int::double)")} as pct_few
        from fits where venue is not null and rmse is not null group by 1""",
    "q_band": f"""{_WEDGE} select year(date) as year, count(*) as n, {_r("avg(wedge)")} as mean, {_r("median(wedge)")} as median,
        {_r("avg((abs(wedge) <= 0.01::double)::int::double)")} as share_inside, {_r("avg((abs(wedge) > 2 * 0.01::double)::int::double)")} as share_beyond_double from wedge group by 1""",
    "q_slice_errors": f"""with o as (select fit_id, any_value(upper(trim(venue))) as venue, any_value(slice_rmses) as m from ssvi_diagnostics group by 1),
        e as (select venue, unnest(map_entries(m)) as x from o where venue is not null), v as (select venue, x.key as d, x.value as e from e where x.value is not null and not isnan(x.value) and x.value <> -99.99)
        select venue, case when d <= 14 then 'short' when d <= 60 then 'middle' else 'long' end as bucket, count(*) as n, {_r("avg(e)")} as mean, {_r("sqrt(avg(e * e))")} as rms from v group by all""",
    "q_worst_fits": f"{_FITS} select * from (select venue, row_number() over (partition by venue order by rmse desc, fit_id) as rank, fit_id, date, rmse from fits where rmse is not null and venue is not null) where rank <= 5",
    "q_commonest_slices": f"""{_FITS}, c as (select venue, n_slices, count(*) as n from fits where venue is not null and n_slices is not null group by all)
        select venue, n_slices, n from (select *, row_number() over (partition by venue order by n desc, n_slices) as k from c) where k = 1""",
    "q_skew_agreement": """with r as (select run_id, year, max(rho_median) filter (upper(trim(venue)) = 'CME') as c, max(rho_median) filter (upper(trim(venue)) = 'DER') as d
        from ssvi_skew_summary where rho_median <> -99.99 and not isnan(rho_median) group by all) select year, count(*) as n_runs, count(*) filter (sign(c) = sign(d)) as n_agree
        from r where c is not null and d is not null group by 1""",
    "q_event_dummies": f"{_PANEL} select source, {_r('avg(rv)')} as rv_all, "
    + ", ".join(
        f"count(*) filter (date between date '{a}' and date '{b}') as n_{n}, {_r(f'''avg(rv) filter (date between date '{a}' and date '{b}')''')} as rv_{n}" for n, (a, b) in _EVENTS.items()
    )
    + " from panel where rv is not null group by 1",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
