"""Intervals of premia, humps and variance premia, joint tests of regimes, term structures of the venues' difference; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.functions import curves as C
from skewline.operators import inference, ordered, panel
from skewline.plans.curve_queries import _BOTH, POINTS, _against_average, _map, _mask, _pairs, _r, _trapezoid, _upto, grid
from skewline.plans.inference_queries import BLOCK, DRAWS, LAGS, _boot_sql, _draws_sql
from skewline.plans.panels import _PANEL, _RET, _VAR, _WEDGE, LABELS, _returns, _variances, daily, fits
from skewline.plans.regression_queries import _PSI, CURVE_DRAWS, _ols, _state
from skewline.plans.trades import _FORWARD, _TAPE, NUDGE, _rounded, cross_section, tape
from skewline.sources.tables import table

PARTS = ("total", "down", "mid", "up")
#: Target maturities in days, and what is borne outside those of the day.
TARGETS, SHORTEST, LONGEST = (14, 27, 60), 0.8, 1.2
#: Days a sample of the term structure needs.
LEAST_DAYS = 50
#: Inner edges of the histogram of returns; its outer bins are open.
EDGES = (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)


def _premia(spark: SparkSession, folder: str) -> DataFrame:
    """(date, venue, total, down, mid, up): the premium of each day and its regions."""
    rows = _against_average(spark, folder).withColumn("ep", C.premium_curve(F.col("q"), F.col("p"), F.col("x")))
    down, mid, up = C.regions_by_edge(F.col("ep"), F.col("x"))
    return rows.select("date", "venue", C.trapezoid(F.col("ep"), F.col("x")).alias("total"), down.alias("down"), mid.alias("mid"), up.alias("up"))


def q_boot_premium(spark: SparkSession, folder: str) -> DataFrame:
    """Premium by venue and region with bands; the regions' shares of the total come from each draw's own ratio."""
    rows = _premia(spark, folder)
    each = rows.select("date", F.inline(F.array(*[F.struct(F.concat_ws(" ", "venue", F.lit(p)).alias("key"), F.col(p).alias("v")) for p in PARTS])))
    draws = inference.bootstrap_draws(each, "key", "date", "v", BLOCK, CURVE_DRAWS)
    draws = draws.select(F.split("key", " ")[0].alias("venue"), F.split("key", " ")[1].alias("part"), "draw", "mean")
    whole = F.max(F.when(F.col("part") == "total", F.col("mean"))).over(Window.partitionBy("venue", "draw"))
    draws = draws.withColumn("share", F.try_divide(F.col("mean"), whole))
    level, share = (inference.statistic_bands(draws, ["venue", "part"], F.col(c)) for c in ("mean", "share"))
    share = share.select("venue", "part", F.col("estimate").alias("share"), F.col("low").alias("low_of_share"), F.col("high").alias("high_of_share"))
    return _rounded(level.select("venue", "part", "estimate", "low", "high", "n_failed").join(share, ["venue", "part"]), 6)


def q_boot_premium_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' premia of the same days, CME less DER, by region: band and two-sided p of the draws."""
    rows = _premia(spark, folder)
    sides = [(F.max(F.when(F.col("venue") == "CME", F.col(p))) - F.max(F.when(F.col("venue") == "DER", F.col(p)))).alias(p) for p in PARTS]
    each = rows.groupBy("date").agg(*sides).select("date", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("v")) for p in PARTS]))).where("v is not null")
    out = inference.statistic_bands(inference.bootstrap_draws(each, "part", "date", "v", BLOCK, CURVE_DRAWS), ["part"], F.col("mean"))
    return _rounded(out.select("part", "estimate", "low", "high", "error", "p"), 6)


def q_boot_hump(spark: SparkSession, folder: str) -> DataFrame:
    """Height of the hump of each venue's mean kernel, its band, and the share of draws without a hump; days are drawn for all points at once."""
    kernel = _against_average(spark, folder).withColumn("m", C.kernel_curve(F.col("q"), F.col("p")))
    points = kernel.select("date", "venue", F.posexplode("m").alias("i", "m")).withColumn("key", F.concat_ws(" ", "venue", "i"))
    draws = inference.bootstrap_draws(points, "key", "date", "m", BLOCK, CURVE_DRAWS)
    one = F.struct(F.split("key", " ")[1].cast("int").alias("i"), "mean")
    curves = draws.groupBy(F.split("key", " ")[0].alias("venue"), "draw").agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["mean"]).alias("m"))
    # a curve that lacks a point has failed
    height = F.when(F.size("m") == POINTS, C.hump(F.col("m"), grid())["height"])
    out = inference.statistic_bands(curves, ["venue"], height)
    return _rounded(out.select("venue", F.col("estimate").alias("height"), "low", "high", "share_low", "n_failed"), 6)


def q_boot_variance_premium(spark: SparkSession, folder: str) -> DataFrame:
    """Band of each feed's mean implied less realised variance."""
    rows = _variances(spark, folder).join(daily(spark, folder).select("source", "date", "dvol"), ["source", "date"])
    rows = rows.withColumn("vrp", F.pow(F.col("dvol") / 100, F.lit(2.0)) - F.col("variance"))
    return _rounded(inference.bootstrap_means(rows, "source", "date", "vrp", BLOCK, DRAWS), 7)


def _regimes(spark: SparkSession, folder: str) -> DataFrame:
    """(date, regime): thirds of the days with both densities by their mean volatility index."""
    days = _pairs(spark, folder).select("date")
    state = _state(spark, folder).where("vix is not null").join(days, "date").withColumn("all", F.lit(0))
    return ordered.quantile_bins(state, "vix", "regime", LABELS, ["all"]).select("date", "regime")


def q_joint_wald(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the venues' mean log ratio differs between high and low volatility in any of the three regions: a joint test by draws."""
    psi = _pairs(spark, folder).select("date", "x", C.log_ratio(F.col("d"), F.col("c")).alias("psi"))
    regions = C.regions_by_mask(F.col("psi"), F.col("x"))
    each = psi.join(_regimes(spark, folder), "date").select(
        "date", "regime", F.inline(F.array(*[F.struct(F.lit(n).alias("region"), r.alias("v")) for n, r in zip(PARTS[1:], regions, strict=True)]))
    )
    draws = inference.bootstrap_draws(each, "region", "date", "v", BLOCK, CURVE_DRAWS, "regime")
    mean = lambda region, regime: F.max(F.when((F.col("region") == region) & (F.col("regime") == regime), F.col("mean")))
    wide = draws.groupBy("draw").agg(*[(mean(p, "high") - mean(p, "low")).alias(p) for p in PARTS[1:]])
    return _rounded(inference.joint_wald(wide, PARTS[1:]), 5)


def q_regional_regimes(spark: SparkSession, folder: str) -> DataFrame:
    """Mean premium of each region by regime, its share of the sum over the regions, and the order of the regimes."""
    rows = panel.by_regime(_premia(spark, folder).join(_regimes(spark, folder), "date"), ["venue"], "regime", list(PARTS[1:]))
    each = rows.select("venue", "regime", "n", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("mean")) for p in PARTS[1:]])))
    share = F.try_divide(F.col("mean"), F.sum("mean").over(Window.partitionBy("venue", "regime")))
    rank = F.array_position(F.array(*[F.lit(x) for x in (*LABELS, "all")]), F.col("regime")).cast("int")
    return _rounded(each.select("venue", "regime", rank.alias("rank"), "part", "n", "mean", share.alias("share")), 6)


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """(date, bucket, vix, wedge): the venues' difference in the error of single maturities by bucket of days."""
    rows = table(spark, folder, "ssvi_diagnostics").select("fit_id", "date", F.upper(F.trim("venue")).alias("venue"), "slice_rmses", "fitted_at")
    once = rows.groupBy("fit_id").agg(*[F.min_by(c, "fitted_at").alias(c) for c in ("date", "venue", "slice_rmses")])
    each = once.where("venue is not null").select("date", "venue", F.explode("slice_rmses").alias("days", "error")).where(F.col("error").isNotNull() & ~F.isnan("error") & (F.col("error") != -99.99))
    bucket = F.when(F.col("days") <= 14, "short").when(F.col("days") <= 60, "middle").otherwise("long")
    means = [F.avg(F.when(F.col("venue") == v, F.col("error"))) for v in ("DER", "CME")]
    wedges = each.groupBy("date", bucket.alias("bucket")).agg((means[0] - means[1]).alias("wedge")).where("wedge is not null")
    return wedges.join(_state(spark, folder).where("vix is not null").select("date", "vix"), "date")


def q_term_structure(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference in fit error on the volatility index by maturity bucket: on its own days and on days all buckets have.

    Samples of fewer than LEAST_DAYS days are skipped.
    """
    rows = _bucketed(spark, folder)
    rows = rows.withColumn("n_buckets", F.count(F.lit(1)).over(Window.partitionBy("date")))
    samples = F.when(F.col("n_buckets") == 3, F.array(F.lit("own"), F.lit("common"))).otherwise(F.array(F.lit("own")))
    keyed = rows.select("date", "vix", "wedge", "bucket", F.explode(samples).alias("sample")).withColumn("key", F.concat_ws(" ", "bucket", "sample"))
    keyed = keyed.withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy("key"))).where(F.col("n_days") >= LEAST_DAYS)
    out = inference.robust_ols(keyed, "key", "date", "wedge", {"vix": F.col("vix")}, LAGS)
    return _rounded(out.select("key", "term", "n", "estimate", "error", "t", "r2"), 6)


def _proxies(spark: SparkSession, folder: str) -> DataFrame:
    """(date, wedge, late, busy): the venues' difference beside the day's volume-weighted hour less noon and the logarithm of its trades, less their means."""
    rows = tape(spark, folder, ("date", "timestamp", "amount")).where("amount > 0")
    hour = (F.col("timestamp") % 86_400_000) / 3_600_000.0 - 12
    days = rows.groupBy("date").agg((F.sum(F.col("amount") * hour) / F.sum("amount")).alias("late"), F.log(F.count(F.lit(1)).cast("double")).alias("busy"))
    both = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse").select("date", "wedge").join(days, "date")
    means = both.agg(F.avg("late").alias("_late"), F.avg("busy").alias("_busy"))
    return both.crossJoin(F.broadcast(means)).select("date", "wedge", (F.col("late") - F.col("_late")).alias("late"), (F.col("busy") - F.col("_busy")).alias("busy"))  # one row


def q_async(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference on when and how much was traded (less their means), so that its constant compares with the mean alone."""
    rows = _proxies(spark, folder)
    out = None
    for name, regressors in (("adjusted", ("late", "busy")), ("constant", ())):
        one = inference.robust_ols(rows.withColumn("spec", F.lit(name)), "spec", "date", "wedge", {r: F.col(r) for r in regressors}, LAGS)
        one = _rounded(one.select("spec", "term", "n", "estimate", "error", "t"), 6)
        out = one if out is None else out.unionByName(one)
    return out


def q_maturity_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a target maturity lies within the day's own maturities, a fifth beyond them at most."""
    days = cross_section(spark, folder).where("tau > 0").groupBy("date").agg(F.min("tau").alias("low"), F.max("tau").alias("high"))
    target = F.explode(F.array(*[F.lit(t) for t in TARGETS]))
    rows = days.withColumn("days", target).withColumn("target", F.col("days") / 365.25)
    inside = (F.col("target") >= SHORTEST * F.col("low")) & (F.col("target") <= LONGEST * F.col("high"))
    return rows.groupBy("days").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(inside).alias("n_inside"))


def q_periodic_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Annualised mean of each day's hourly changes of the index, on the last value of each hour."""
    rows = tape(spark, folder, ("timestamp", "index_price_usd")).where("index_price_usd > 0")
    hours = rows.groupBy(F.floor(F.col("timestamp") / 3_600_000).alias("hour")).agg(F.max(F.struct("timestamp", "trade_id", "index_price_usd"))["index_price_usd"].alias("x"))
    hours = hours.withColumn("day", F.floor(F.col("hour") / 24))
    hours = hours.withColumn("r", ordered.log_return(F.col("x"), Window.partitionBy("day").orderBy("hour")))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date")
    return _rounded(hours.where("r is not null").groupBy(day).agg(F.count(F.lit(1)).alias("n"), (F.avg("r") * (24 * 365.25)).alias("rate")), 6)


def q_open_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping 27-row returns by bins of a tenth, the outer two open: counts, shares and mean return per feed."""
    rows = _returns(spark, folder)
    r = F.log(ordered.overlapping_return(F.col("btc_spot"), Window.partitionBy("source").orderBy("date"), 27))
    rows = rows.select("source", r.alias("r")).where("r is not null")
    bin_ = sum(((F.col("r") >= e).cast("int") for e in EDGES), F.lit(0))
    out = rows.groupBy("source", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))
    return _rounded(out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source"))))


# --- the same in SQL ---------------------------------------------------------------------------------------------

_EP = f"""{_BOTH}, ep0 as (select date, venue, x, {_map("(p[j] - q[j]) * (x[j] - 1)")} as ep from both_), ep as (select date, venue, {_trapezoid("ep")} as total, {_upto("ep", 0.9)} as down,
    {_upto("ep", 1.1)} - {_upto("ep", 0.9)} as mid, {_trapezoid("ep")} - {_upto("ep", 1.1)} as up from ep0)"""
_ALL_DRAWS = ", al as (select k, -1 as draw, mean from ob union all select k, draw, mean from me)"
_FILTER = "filter (draw >= 0)"


def _bands(s: str, names: tuple[str, str, str], digits: int = 6) -> str:
    a, b, c = names
    low, high = (_r(f"quantile_cont({s}, {p}) {_FILTER}", digits) for p in (0.025, 0.975))
    return f"{_r(f'max({s}) filter (draw < 0)', digits)} as {a}, {low} as {b}, {high} as {c}"


def _adjugate() -> tuple[str, list[list[str]]]:
    s = lambda i, j: f"s{min(i % 3, j % 3)}{max(i % 3, j % 3)}"
    minor = [[f"({s(i + 1, j + 1)} * {s(i + 2, j + 2)} - {s(i + 1, j + 2)} * {s(i + 2, j + 1)})" for j in range(3)] for i in range(3)]
    return " + ".join(f"s0{j} * {minor[0][j]}" for j in range(3)), minor


_DETERMINANT, _MINOR = _adjugate()
_VRP = ", vp as (select va.source, va.date, pow(p.dvol / 100, 2) - variance as vrp from va join panel p on p.source = va.source and p.date = va.date)"
_REGIME_DAYS = """, vd as (select date, avg(vix) as vix from panel where date in (select date from den group by 1 having count(*) = 2) group by 1 having avg(vix) is not null), ve as (select quantile_cont(vix, 1.0/3) as e1, quantile_cont(vix, 2.0/3) as e2 from vd),
    vr as (select date, case when vix <= e1 then 'low' when vix <= e2 then 'mid' else 'high' end as regime from vd, ve)"""
_BUCKETS = _PANEL + """, st as (select date, avg(vix) as vix from panel group by 1 having avg(vix) is not null),
    o1 as (select date, upper(trim(venue)) as venue, slice_rmses as m from (select *, row_number() over (partition by fit_id order by fitted_at) as nth from ssvi_diagnostics) where nth = 1),
    e1 as (select date, venue, unnest(map_entries(m)) as z from o1 where venue is not null), v1 as (select date, venue, z.key as d, z.value as e from e1 where z.value is not null and not isnan(z.value) and z.value <> -99.99),
    w1 as (select date, case when d <= 14 then 'short' when d <= 60 then 'middle' else 'long' end as bucket, avg(e) filter (venue = 'DER') - avg(e) filter (venue = 'CME') as wedge from v1 group by all),
    w2 as (select w1.date, bucket, wedge, vix from w1 join st on st.date = w1.date where wedge is not null), w3 as (select *, count(*) over (partition by date) as n_buckets from w2)"""
_ASYNC = _WEDGE.replace("\nwith fits", _TAPE.rstrip() + ", fits", 1) + """, dy as (select date, sum(amount * ((timestamp % 86400000) / 3600000.0::double - 12)) / sum(amount) as late, ln(count(*)::double) as busy from tape where amount > 0 group by 1),
    bo as (select wedge.date, wedge, late, busy from wedge join dy on dy.date = wedge.date), pr as (select date, wedge, late - avg(late) over () as late, busy - avg(busy) over () as busy from bo)"""
_SPEC = "select spec, term, n, " + ", ".join(f"round({c} + {NUDGE}, 6) as {c}" for c in ("estimate", "error", "t")) + " from tm"
_TERMS = "select key, term, n, " + ", ".join(f"round({c} + {NUDGE}, 6) as {c}" for c in ("estimate", "error", "t", "r2")) + " from tm"
_BIN = " + ".join(f"(r >= {e}::double)::int" for e in EDGES)

SQL = {
    "q_boot_premium": _draws_sql(_EP, " union all ".join(f"select venue || ' {p}' as k, date as o, {p} as v from ep" for p in PARTS), draws=CURVE_DRAWS)
    + _ALL_DRAWS
    + f""", sp as (select split_part(k, ' ', 1) as venue, split_part(k, ' ', 2) as part, draw, mean from al), sh as (select *, mean / nullif(max(case when part = 'total' then mean end) over (partition by venue, draw), 0) as share from sp)
    select venue, part, {_bands("mean", ("estimate", "low", "high"))}, {_bands("share", ("share", "low_of_share", "high_of_share"))}, count(*) filter (draw >= 0 and mean is null) as n_failed from sh group by all""",
    "q_boot_premium_difference": _draws_sql(
        _EP + f", di as (select a.date, {', '.join(f'a.{p} - b.{p} as {p}' for p in PARTS)} from ep a join ep b on a.date = b.date and a.venue = 'CME' and b.venue = 'DER')",
        " union all ".join(f"select '{p}' as k, date as o, {p} as v from di" for p in PARTS),
        draws=CURVE_DRAWS,
    )
    + _ALL_DRAWS
    + f""" select k as part, {_bands("mean", ("estimate", "low", "high"))}, {_r(f"stddev_samp(mean) {_FILTER}", 6)} as error,
    {_r(f"least(1.0, 2 * least(avg((mean <= 0)::int::double) {_FILTER}, avg((mean >= 0)::int::double) {_FILTER}))", 6)} as p from al group by 1""",
    "q_boot_hump": _draws_sql(
        f"{_BOTH}, kp as (select date, venue, i, q[i] / p[i] as m from both_, (select unnest(range(1, {POINTS + 1})) as i) where p[i] >= 1e-15)",
        "select venue || ' ' || i as k, date as o, m as v from kp where m is not null",
        draws=CURVE_DRAWS,
    )
    + _ALL_DRAWS
    + f""", cu as (select split_part(k, ' ', 1) as venue, split_part(k, ' ', 2)::int as i, draw, mean as m, 0.4::double + 1.6::double * (split_part(k, ' ', 2)::int - 1) / {POINTS - 1} as r from al),
    pk as (select venue, draw, arg_max(r, (m, -i)) as peak, max(m) as top from cu where r between 0.9::double and 1.1::double group by all),
    tr as (select cu.venue, cu.draw, min(m) as low from cu join pk on pk.venue = cu.venue and pk.draw = cu.draw where r >= 0.7::double and r < peak group by all),
    hu as (select pk.venue, pk.draw, top - low as h from pk left join tr on tr.venue = pk.venue and tr.draw = pk.draw)
    select venue, {_bands("h", ("height", "low", "high"))}, {_r(f"avg((h <= 0)::int::double) {_FILTER}", 6)} as share_low, count(*) filter (draw >= 0 and h is null) as n_failed from hu group by 1""",
    "q_boot_variance_premium": _boot_sql(_VAR + _VRP, "vrp as v from vp where vrp is not null", None),
    "q_joint_wald": _draws_sql(
        _PSI.replace("with raw", _PANEL.rstrip() + ", raw", 1) + _REGIME_DAYS + ", rg as (select psi.date, regime, " + ", ".join(f"{_mask(k)} as {p}" for p, k in zip(PARTS[1:], ("{} < 0.9::double", "{} between 0.9::double and 1.1::double", "{} > 1.1::double"), strict=True)) + " from psi join vr on vr.date = psi.date)",
        " union all ".join(f"select '{p}' as k, date as o, {p} as v, regime as label from rg" for p in PARTS[1:]),
        True,
        CURVE_DRAWS,
    )
    + ", al as (select k, label, -1 as draw, mean from ob union all select k, label, draw, mean from me), wi as (select draw, "
    + ", ".join(f"max(mean) filter (k = '{p}' and label = 'high') - max(mean) filter (k = '{p}' and label = 'low') as d{i}" for i, p in enumerate(PARTS[1:]))
    + f""" from al group by 1), mo as (select {", ".join(f"covar_samp(d{i}, d{j}) {_FILTER} as s{i}{j}" for i in range(3) for j in range(i, 3))}, {", ".join(f"max(d{i}) filter (draw < 0) as e{i}" for i in range(3))} from wi),
    fo as (select draw, d0, ({" + ".join(f"e{i} * e{j} * {_MINOR[i][j]}" for i in range(3) for j in range(3))}) / ({_DETERMINANT}) as wald,
        ({" + ".join(f"(d{i} - e{i}) * (d{j} - e{j}) * {_MINOR[i][j]}" for i in range(3) for j in range(3))}) / ({_DETERMINANT}) as own from wi, mo where draw >= 0)
    select {_r("max(wald)", 5)} as wald, count(d0) as n_ok, count(*) - count(d0) as n_failed, {_r("(count(*) filter (own >= wald) + 1) / (count(d0) + 1)::double", 5)} as p from fo having count(d0) > 0""",
    "q_regional_regimes": _EP.replace("with raw", _PANEL.rstrip() + ", raw", 1)
    + _REGIME_DAYS
    + f""", by_ as (select venue, case when grouping(regime) = 1 then 'all' else regime end as regime, count(*) as n, {", ".join(f"avg({p}) as {p}" for p in PARTS[1:])}
        from ep join vr on vr.date = ep.date group by grouping sets ((venue, regime), (venue))), un as ({" union all ".join(f"select venue, regime, n, '{p}' as part, {p} as mean from by_" for p in PARTS[1:])})
    select venue, regime, list_position(['low', 'mid', 'high', 'all'], regime)::int as rank, part, n, {_r("mean", 6)} as mean, {_r("mean / sum(mean) over (partition by venue, regime)", 6)} as share from un""",
    "q_term_structure": _ols(
        _BUCKETS,
        f"""select * from (select bucket || ' own' as k, date as o, wedge as y, vix as x1 from w3 union all select bucket || ' common', date, wedge, vix from w3 where n_buckets = 3)
        qualify count(*) over (partition by k) >= {LEAST_DAYS}""",
        "key",
        ["vix"],
        tail=_TERMS,
    ),
    "q_async": " union all ".join(
        "select * from (" + _ols(_ASYNC, f"select '{name}' as k, date as o, wedge as y{''.join(f', {c} as x{i}' for i, c in enumerate(fields, 1))} from pr", "spec", list(fields), tail=_SPEC) + ")"
        for name, fields in (("adjusted", ("late", "busy")), ("constant", ()))
    ),
    "q_maturity_guard": f"""{_FORWARD}, d as (select date, min(tau) as low, max(tau) as high from x where tau > 0 group by 1), t as (select unnest([{", ".join(map(str, TARGETS))}])::int as days)
        select days, count(*) as n_days, count(*) filter (days / 365.25::double >= {SHORTEST}::double * low and days / 365.25::double <= {LONGEST}::double * high) as n_inside from d, t group by 1""",
    "q_periodic_rate": f"""{_TAPE}, h as (select timestamp // 3600000 as hour, arg_max(index_price_usd, (timestamp, trade_id)) as x from tape where index_price_usd > 0 group by 1),
        g as (select *, hour // 24 as day, ln(x / lag(x) over (partition by hour // 24 order by hour)) as r from h)
        select date '1970-01-01' + day::int as date, count(*) as n, {_r("avg(r) * (24 * 365.25::double)", 6)} as rate from g where r is not null group by 1""",
    "q_open_histogram": f"""{_RET}, g as (select source, ln(lead(btc_spot, 27) over (partition by source order by date) / btc_spot) as r from ret), b as (select source, {_BIN} as bin, count(*) as n, avg(r) as mean from g where r is not null group by all)
        select source, bin, n, {_r("mean")} as mean, {_r("n / sum(n) over (partition by source)")} as share from b""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
