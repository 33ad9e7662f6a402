"""Queries across venues and feeds: kernels, mass wedges, bands, tensors, joined panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.functions import curves as C
from skewline.operators import ordered, panel
from skewline.plans.curve_queries import _BOTH, _DEN, _map, _pairs, _r, _trapezoid, _upto, _against_average, densities
from skewline.plans.panels import _FITS, _PANEL, _TER, _VAR, _terciles, _variances, daily, fits
from skewline.plans.trades import _rounded

B0, C0, D0 = -0.8, 0.35, -0.05


def q_kernel_eval(spark: SparkSession, folder: str) -> DataFrame:
    """A cubic log-kernel at stated coefficients, scaled to mean one under p: its value at the grid's middle, its mean, the model's mean return."""
    rows = _against_average(spark, folder)
    e = F.transform("x", lambda r: F.exp(F.lit(B0) * r + F.lit(C0) * r * r + F.lit(D0) * r * r * r))
    rows = rows.withColumn("e", e).withColumn("mp", F.zip_with("e", "p", lambda a, b: a * b))
    rows = rows.withColumn("scale", C.trapezoid(F.col("mp"), F.col("x")))
    mean = C.moment(F.col("mp"), F.col("x"), lambda r: r) / F.col("scale")
    entropy = -(C.trapezoid(F.zip_with("q", F.transform("e", lambda v: F.log(v)), lambda a, b: a * b), F.col("x")) - F.log("scale"))
    return _rounded(rows.select("date", "venue", (F.col("e")[31] / F.col("scale")).alias("middle"), mean.alias("model_mean"), entropy.alias("cross_entropy")))


def q_mass_wedge(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of the venues' probability mass by region, CME less DER."""
    rows = _pairs(spark, folder)
    cme, der = C.regions_by_edge(F.col("c"), F.col("x")), C.regions_by_edge(F.col("d"), F.col("x"))
    return _rounded(rows.select("date", *[(a - b).alias(n) for n, a, b in zip(("down", "mid", "up"), cme, der, strict=True)]))


def q_range_across(spark: SparkSession, folder: str) -> DataFrame:
    """Point by point range of the densities of each venue, and the greatest of them."""
    points = densities(spark, folder).select("venue", F.posexplode("q").alias("i", "v")).groupBy("venue", "i").agg((F.max("v") - F.min("v")).alias("range"))
    return _rounded(points.groupBy("venue").agg(F.max("range").alias("greatest"), F.avg("range").alias("mean")))


def q_no_trade(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference in fit error against bands of three widths, once and doubled: shares inside."""
    wedge = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse").select("date", "wedge")
    grid = F.array(*[F.struct(F.lit(s).alias("spread"), F.lit(k).alias("kappa"), F.lit(0.01 * s * k).alias("band")) for s in (0.5, 1.0, 2.0) for k in (1.0, 2.0)])
    return _rounded(panel.band_table(wedge.select("wedge", F.inline(grid)), ["spread", "kappa"], "wedge", "band"))


def q_vrp_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Implied less realised variance per feed: mean, deviation, median, share above zero."""
    rows = _variances(spark, folder).join(daily(spark, folder).select("source", "date", "dvol"), ["source", "date"])
    rows = rows.withColumn("vrp", F.pow(F.col("dvol") / 100, F.lit(2.0)) - F.col("variance")).where("vrp is not null")
    return _rounded(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("vrp").alias("mean"), F.stddev_samp("vrp").alias("deviation"), F.percentile("vrp", F.lit(0.5)).alias("median"), F.avg((F.col("vrp") > 0).cast("double")).alias("share_positive")), 7)


def q_box(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of realised volatility by feed and regime."""
    rows = _terciles(spark, folder).where("rv is not null").groupBy("source", "regime").agg(F.percentile("rv", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return _rounded(rows.select("source", "regime", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "q2", "q3"))]))


def q_scatter_corr(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of the venues' daily fit errors, per year."""
    both = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse")
    return _rounded(both.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.corr("DER", "CME").alias("correlation")), 7)


def q_panel_build(spark: SparkSession, folder: str) -> DataFrame:
    """Days of feed fields and venue errors joined: feeds left, venues where known."""
    sides = fits(spark, folder).where("venue in ('CME', 'DER')").groupBy("date").pivot("venue", ["CME", "DER"]).agg(F.avg("rmse"))
    rows = daily(spark, folder).select("source", "date", "btc_spot", "vix").join(sides, "date", "left")
    return _rounded(rows.select("source", "date", "btc_spot", "vix", F.col("CME").alias("cme"), F.col("DER").alias("der")))


def q_tensor_std(spark: SparkSession, folder: str) -> DataFrame:
    """Densities as cells (venue, grid point) standardised over days; a constant cell is divided by one, a missing one is 0."""
    cells = densities(spark, folder).select("date", "venue", F.posexplode("q").alias("i", "v"))
    # one row per venue and grid point
    moments = cells.groupBy("venue", "i").agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_deviation"))
    z = F.coalesce((F.col("v") - F.col("_mean")) / F.when(F.col("_deviation") < 1e-12, 1.0).otherwise(F.col("_deviation")), F.lit(0.0))
    return _rounded(cells.join(F.broadcast(moments), ["venue", "i"]).select("date", "venue", "i", z.alias("z")), 6)


def q_digitise(spark: SparkSession, folder: str) -> DataFrame:
    """Days per third of realised variance by strict percentile edges."""
    rows = _variances(spark, folder).where("variance is not null")
    edges = rows.groupBy("source").agg(F.percentile("variance", F.array(F.lit(0.3333), F.lit(0.6667))).alias("_e"))
    label = F.when(F.col("variance") < F.col("_e")[0], "low").when(F.col("variance") < F.col("_e")[1], "mid").otherwise("high")
    return rows.join(edges, "source").groupBy("source", label.alias("third")).agg(F.count(F.lit(1)).alias("n_days"))


def q_first_per_run(spark: SparkSession, folder: str) -> DataFrame:
    """The first fit of each venue and day, by (fitted_at, fit_id)."""
    order = Window.partitionBy("venue", "date").orderBy("fitted_at", "fit_id")
    rows = fits(spark, folder).where("venue is not null").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return rows.select("venue", "date", "fit_id", "rmse")


def q_fit_success(spark: SparkSession, folder: str) -> DataFrame:
    """Fits per venue that have an error and that haven't, and mean slices and options of those that have."""
    ok = F.col("rmse").isNotNull()
    out = fits(spark, folder).where("venue is not null").groupBy("venue").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.avg(F.when(ok, F.col("n_slices"))).alias("slices"), F.avg(F.when(ok, F.col("n_options"))).alias("options")
    )
    return _rounded(out)


def q_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """Weights and widths of the strip over each feed's distinct price levels of a month (unequal steps)."""
    rows = daily(spark, folder).where("btc_spot is not null").select("source", F.date_format("date", "yyyy-MM").alias("month"), "btc_spot").distinct()
    month = Window.partitionBy("source", "month")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(month), "_f": F.avg("btc_spot").over(month)}).where("_n >= 5")
    rows = rows.withColumns(ordered.strip_weights(F.col("btc_spot"), F.col("_f"), month.orderBy("btc_spot")))
    return _rounded(rows.groupBy("source", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("width"), (F.sum(F.col("weight") * F.col("width")) * 1e4).alias("weight")), 6)


_E = f"exp(({B0})::double * x[j] + {C0}::double * x[j] * x[j] + ({D0})::double * x[j] * x[j] * x[j])"
_WEDGE2 = _FITS + ", w as (select date, avg(rmse) filter (venue = 'DER') as der, avg(rmse) filter (venue = 'CME') as cme from fits group by 1), wedge as (select *, der - cme as wedge from w where der is not null and cme is not null)"

SQL = {
    "q_kernel_eval": f"""{_BOTH}, e1 as (select *, {_map(_E)} as e from both_), e2 as (select *, {_map("e[j] * p[j]")} as mp, {_map("q[j] * ln(e[j])")} as qe, {_map("e[j] * p[j] * x[j]")} as mr from e1),
        e3 as (select *, {_trapezoid("mp")} as scale from e2) select date, venue, {_r("e[32] / scale")} as middle, {_r(f"{_trapezoid('mr')} / scale")} as model_mean,
        {_r(f"-({_trapezoid('qe')} - ln(scale))")} as cross_entropy from e3""",
    "q_mass_wedge": f"""{_DEN}, r as (select date, venue, {_upto("q", 0.9)} as d, {_upto("q", 1.1)} - {_upto("q", 0.9)} as m, {_trapezoid("q")} - {_upto("q", 1.1)} as u from den)
        select a.date, {_r("a.d - b.d")} as down, {_r("a.m - b.m")} as mid, {_r("a.u - b.u")} as up from r a join r b on a.date = b.date and a.venue = 'CME' and b.venue = 'DER'""",
    "q_range_across": f"{_DEN}, p as (select venue, i, max(q[i]) - min(q[i]) as r from den, (select unnest(range(1, 65)) as i) group by all) select venue, {_r('max(r)')} as greatest, {_r('avg(r)')} as mean from p group by 1",
    "q_no_trade": f"""{_WEDGE2}, g as (select unnest([0.5::double, 1.0::double, 2.0::double]) as spread), k as (select unnest([1.0::double, 2.0::double]) as kappa)
        select spread, kappa, count(*) as n, {_r("avg(wedge)")} as mean, {_r("median(wedge)")} as median, {_r("avg((abs(wedge) <= 0.01::double * spread * kappa)::int::double)")} as share_inside,
        {_r("avg((abs(wedge) > 2 * (0.01::double * spread * kappa))::int::double)")} as share_beyond_double from wedge, g, k group by all""",
    "q_vrp_summary": f"""{_VAR}, v as (select va.source, pow(p.dvol / 100, 2) - variance as vrp from va join panel p on p.source = va.source and p.date = va.date)
        select source, count(*) as n, {_r("avg(vrp)", 7)} as mean, {_r("stddev_samp(vrp)", 7)} as deviation, {_r("median(vrp)", 7)} as median, {_r("avg((vrp > 0)::int::double)", 7)} as share_positive from v where vrp is not null group by 1""",
    "q_box": f"{_TER} select source, regime, " + ", ".join(f"{_r(f'quantile_cont(rv, {p})')} as q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " from ter where rv is not null group by all",
    "q_scatter_corr": f"{_WEDGE2} select year(date) as year, count(*) as n, {_r('corr(der, cme)', 7)} as correlation from wedge group by 1",
    "q_panel_build": f"""{_PANEL}, f as (select date, avg(rmse) filter (venue = 'CME') as cme, avg(rmse) filter (venue = 'DER') as der from ({_FITS.strip()} select * from fits where venue in ('CME', 'DER')) group by 1)
        select p.source, p.date, {_r("btc_spot")} as btc_spot, {_r("vix")} as vix, {_r("cme")} as cme, {_r("der")} as der from panel p left join f on f.date = p.date""",
    "q_tensor_std": f"""{_DEN}, c as (select date, venue, (i - 1)::int as i, q[i] as v from den, (select unnest(range(1, 65)) as i))
        select date, venue, i, {_r("(v - avg(v) over w) / case when stddev_pop(v) over w < 1e-12 then 1.0::double else stddev_pop(v) over w end", 6)} as z from c window w as (partition by venue, i)""",
    "q_digitise": f"""{_VAR}, e as (select source, quantile_cont(variance, 0.3333) as a, quantile_cont(variance, 0.6667) as b from va where variance is not null group by 1)
        select va.source, case when variance < a then 'low' when variance < b then 'mid' else 'high' end as third, count(*) as n_days from va join e on e.source = va.source where variance is not null group by all""",
    "q_first_per_run": f"""with fits as (select fit_id, date, upper(trim(venue)) as venue, case when not isnan(rmse) and rmse <> -99.99 then rmse end as rmse, fitted_at
        from (select *, row_number() over (partition by fit_id order by fitted_at desc) as nth from ssvi_diagnostics) where nth = 1)
        select venue, date, fit_id, rmse from (select *, row_number() over (partition by venue, date order by fitted_at, fit_id) as k from fits where venue is not null) where k = 1""",
    "q_fit_success": f"""{_FITS} select venue, count(rmse) as n_ok, count(*) - count(rmse) as n_failed, {_r("avg(n_slices) filter (rmse is not null)")} as slices,
        {_r("avg(n_options) filter (rmse is not null)")} as options from fits where venue is not null group by 1""",
    "q_gradient": f"""{_PANEL}, d as (select distinct source, strftime(date, '%Y-%m') as month, btc_spot as k from panel where btc_spot is not null),
        c as (select *, count(*) over m as n, avg(k) over m as f from d window m as (partition by source, month)),
        g as (select *, lag(k) over m as lo, lead(k) over m as hi from c where n >= 5 window m as (partition by source, month order by k)),
        z as (select *, abs(2.0::double * (1 - ln(k / f)) / (k * k)) as weight, case when lo is null then hi - k when hi is null then k - lo else (hi - lo) / 2 end as width from g)
        select source, month, count(*) as n, {_r("sum(width)", 6)} as width, {_r("sum(weight * width) * 1e4", 6)} as weight from z group by all""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
