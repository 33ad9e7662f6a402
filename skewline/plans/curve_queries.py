"""Queries over density curves and smiles: integrals, regions, premia, moments, surfaces.

The curves are densities on a 64-point grid of gross returns, one per day and venue, made by Spark from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions import curves as C
from skewline.functions import special as S
from skewline.plans.panels import _returns
from skewline.plans.trades import NUDGE, _rounded, cross_section
from skewline.sources.tables import table, without_nan

POINTS, LOW, HIGH = 64, 0.4, 2.0
KAPPAS = (1.0, 0.5)


def grid() -> F.Column:
    return C.linspace(LOW, HIGH, POINTS)


def densities(spark: SparkSession, folder: str, normal: bool = True) -> DataFrame:
    """(date, venue, x, q): q = exp(2 e) of each embedding, normalised to unit mass."""
    rows = table(spark, folder, "embeddings").where("embedding is not null").select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("vec_id") / 2).cast("int")).alias("date"),
        F.when(F.col("vec_id") % 2 == 0, "CME").otherwise("DER").alias("venue"),
        F.transform("embedding", lambda e: F.exp(e.cast("double") * 2)).alias("q"),
        grid().alias("x"),
    )
    return rows.withColumn("q", C.normalised(F.col("q"), F.col("x"))) if normal else rows


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(date, x, c, d): both venues' densities of a day side by side; one aggregate, no join."""
    rows = densities(spark, folder)
    sides = rows.groupBy("date").agg(F.max(F.when(F.col("venue") == "CME", F.col("q"))).alias("c"), F.max(F.when(F.col("venue") == "DER", F.col("q"))).alias("d"))
    return sides.where("c is not null and d is not null").withColumn("x", grid())


def average_density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q): point by point mean of the curves of each key, normalised. Combines by grid point on the map side."""
    points = rows.select(*keys, F.posexplode("q").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    curve = points.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))
    return curve.withColumn("q", C.normalised(F.col("q"), grid()))


def q_trapz(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder, False)
    return _rounded(rows.select("date", "venue", C.trapezoid(F.col("q"), F.col("x")).alias("mass")))


def q_norm_moments(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder)
    q, x = F.col("q"), F.col("x")
    mean, variance = C.mean_variance(q, x)
    logs = [C.moment(q, x, lambda r, k=k: F.pow(F.log(r), F.lit(float(k)))).alias(f"log{k}") for k in (2, 3, 4)]
    return _rounded(rows.select("date", "venue", C.trapezoid(q, x).alias("mass"), mean.alias("mean"), variance.alias("variance"), *logs))


def q_interp(spark: SparkSession, folder: str) -> DataFrame:
    """Densities on a coarse grid of nine points that reaches beyond theirs."""
    rows = densities(spark, folder)
    on = C.interpolated(F.col("q"), F.col("x"), C.linspace(0.3, 2.1, 9))
    return _rounded(rows.select("date", "venue", F.posexplode(on).alias("i", "value")))


def q_cumtrapz(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder)
    return _rounded(rows.select("date", "venue", *[C.cumulative_at(F.col("q"), F.col("x"), e).alias(n) for e, n in ((0.9, "below_090"), (1.0, "below_100"), (1.1, "below_110"))]))


def q_cdf_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder)
    return rows.select("date", "venue", *[C.quantile_index(F.col("q"), F.col("x"), p).alias(f"i{int(100 * p):02d}") for p in (0.05, 0.1, 0.9, 0.95)])


def q_log_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log ratio of the venues' densities at each grid point."""
    psi = _pairs(spark, folder).select(F.posexplode(C.log_ratio(F.col("d"), F.col("c"))).alias("i", "psi"))
    return _rounded(psi.groupBy("i").agg(F.count(F.lit(1)).alias("n_days"), F.avg("psi").alias("psi")))


def q_region_edge(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder)
    down, mid, up = C.regions_by_edge(F.col("q"), F.col("x"))
    return _rounded(rows.select("date", "venue", down.alias("down"), mid.alias("mid"), up.alias("up")))


def q_region_mask(spark: SparkSession, folder: str) -> DataFrame:
    psi = _pairs(spark, folder).select("date", "x", C.log_ratio(F.col("d"), F.col("c")).alias("psi"))
    down, mid, up = C.regions_by_mask(F.col("psi"), F.col("x"))
    return _rounded(psi.select("date", down.alias("psi_down"), mid.alias("psi_mid"), up.alias("psi_up")))


def q_avg_density(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(average_density(densities(spark, folder), ["venue"]).select("venue", F.posexplode("q").alias("i", "q")))


def _against_average(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's density q beside the average p of the other venue's."""
    average = average_density(densities(spark, folder), ["venue"]).select(F.when(F.col("venue") == "CME", "DER").otherwise("CME").alias("venue"), F.col("q").alias("p"))
    return densities(spark, folder).join(F.broadcast(average), "venue")  # two rows


def q_ep_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Premium in total and by region: (R - 1)(p - q)."""
    rows = _against_average(spark, folder).withColumn("ep", C.premium_curve(F.col("q"), F.col("p"), F.col("x")))
    down, mid, up = C.regions_by_edge(F.col("ep"), F.col("x"))
    total = C.trapezoid(F.col("ep"), F.col("x"))
    out = rows.select("date", "venue", total.alias("total"), down.alias("down"), mid.alias("mid"), up.alias("up"))
    return _rounded(out.withColumn("share_down", F.when(F.abs("total") > 1e-10, F.col("down") / F.col("total"))), 6)


def q_bvrp(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of variances under q and p, in total and by region of the integrand."""
    rows = _against_average(spark, folder)
    x, q, p = F.col("x"), F.col("q"), F.col("p")
    rows = rows.withColumns({"mq": C.moment(q, x, lambda r: r), "mp": C.moment(p, x, lambda r: r)})
    i = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda k: (x[k] - F.col("mq")) * (x[k] - F.col("mq")) * q[k] - (x[k] - F.col("mp")) * (x[k] - F.col("mp")) * p[k])
    rows = rows.withColumn("g", i)
    down, mid, up = C.regions_by_edge(F.col("g"), x)
    return _rounded(rows.select("date", "venue", C.trapezoid(F.col("g"), x).alias("total"), down.alias("down"), mid.alias("mid"), up.alias("up")))


def q_hump(spark: SparkSession, folder: str) -> DataFrame:
    rows = _against_average(spark, folder).withColumn("m", C.kernel_curve(F.col("q"), F.col("p")))
    return _rounded(rows.select("date", "venue", C.hump(F.col("m"), F.col("x")).alias("h")).select("date", "venue", "h.*"))


def q_tilt(spark: SparkSession, folder: str) -> DataFrame:
    rows = densities(spark, folder).withColumn("t", C.tilted(F.col("q"), F.col("x")))
    x = F.col("x")
    return _rounded(rows.select("date", "venue", C.trapezoid(F.col("t"), x).alias("mass"), C.moment(F.col("t"), x, lambda r: r).alias("mean")))


def _contracts(spark: SparkSession, folder: str, bound: float) -> DataFrame:
    rows = densities(spark, folder)
    return rows.select("date", "venue", *[c.alias(n) for n, c in C.bounded_contracts(F.col("q"), F.col("x"), bound).items()])


def q_density_moments(spark: SparkSession, folder: str) -> DataFrame:
    """V, W and X of each density at two bounds of |ln R|."""
    parts = [_contracts(spark, folder, b).withColumn("bound", F.lit(b)) for b in KAPPAS]
    return _rounded(parts[0].unionByName(parts[1]))


def q_inverse_wedge(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts under the tilted density less those under the density itself: the predicted side of the wedge."""
    rows = densities(spark, folder).withColumn("t", C.tilted(F.col("q"), F.col("x")))
    own, other = C.bounded_contracts(F.col("q"), F.col("x"), 1.0), C.bounded_contracts(F.col("t"), F.col("x"), 1.0)
    return _rounded(rows.select("date", "venue", *[(other[n] - own[n]).alias(f"d{n}") for n in own]))


def q_premia(spark: SparkSession, folder: str) -> DataFrame:
    """Premia of order two to four and their sum, weighted for a risk aversion of two."""
    w = C.premium_weights(2.0)
    rows = _contracts(spark, folder, 1.0)
    out = rows.select("date", "venue", *[(F.col(c) * k).alias(f"pi{n}") for c, k, n in zip("vwx", w, (2, 3, 4), strict=True)])
    return _rounded(out.withColumn("total", F.col("pi2") + F.col("pi3") + F.col("pi4")))


def q_theta_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Mean annual bound per venue for risk aversions of one to three."""
    rows = _contracts(spark, folder, 1.0)
    each = F.array(*[F.struct(F.lit(t).alias("theta"), sum((F.col(c) * k for c, k in zip("vwx", C.premium_weights(t), strict=True)), F.lit(0.0)).alias("bound")) for t in (1.0, 2.0, 3.0)])
    return _rounded(rows.select("venue", F.inline(each)).groupBy("venue", "theta").agg((F.avg("bound") * (365.0 / 27)).alias("annual")))


def _log_power(k: int):
    return lambda v, r: v * F.pow(F.log(r), F.lit(float(k)))


def q_regional_premia(spark: SparkSession, folder: str) -> DataFrame:
    """Premia by region and order: weighted integrals of (ln R)^k q, cut at the edges."""
    rows, w = densities(spark, folder), C.premium_weights(2.0)
    columns = []
    for k, weight in zip((2, 3, 4), w, strict=True):
        y = F.zip_with("q", "x", _log_power(k))
        columns += [(c * weight).alias(f"{n}{k}") for n, c in zip(("down", "mid", "up"), C.regions_by_edge(y, F.col("x")), strict=True)]
    return _rounded(rows.select("date", "venue", *columns))


def q_validate_density(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of each raw curve: mass within 2 % of one, nothing below zero, mean within 10 % of one."""
    rows = densities(spark, folder, False)
    q, x = F.col("q"), F.col("x")
    mean = C.moment(q, x, lambda r: r) / C.trapezoid(q, x)
    return rows.select(
        "date", "venue", (F.abs(C.trapezoid(q, x) - 1) <= 0.02).alias("unit_mass"), F.forall(q, lambda v: v >= -1e-10).alias("nonnegative"), (F.abs(mean - 1) < 0.10).alias("centred")
    )


def q_hist_density(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram density of each feed's overlapping 27-row returns in twelve equal bins; the last is closed."""
    from skewline.operators import ordered
    from skewline.plans.panels import by_day

    r = _returns(spark, folder).withColumn("g", ordered.overlapping_return(F.col("btc_spot"), by_day(), 27)).where("g is not null").select("source", "g")
    ends = r.groupBy("source").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.count(F.lit(1)).alias("n"))
    place = F.least(F.floor((F.col("g") - F.col("a")) * 12 / (F.col("b") - F.col("a"))), F.lit(11)).cast("int")
    bins = r.join(ends, "source").where("b > a").groupBy("source", "a", "b", "n", place.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    return _rounded(bins.select("source", "bin", F.col("k").alias("n_in"), (F.col("k") * 12 / (F.col("n") * (F.col("b") - F.col("a")))).alias("density")), 7)


def _surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, venue, year, theta, rho, eta, gamma, phi): parameters of each block, theta from its maturity at 60 %."""
    rows = without_nan(table(spark, folder, "ssvi_skew_summary").select("run_id", F.upper(F.trim("venue")).alias("venue"), "year", "rho_median", "eta_median", "gamma_median", "median_days_to_expiry"))
    rows = rows.groupBy("run_id", "venue", "year").agg(*[F.max(c).alias(c) for c in rows.columns[3:]])
    rows = rows.where("venue is not null and abs(rho_median) < 1 and eta_median > 0 and gamma_median between 0 and 1 and median_days_to_expiry > 0")
    rows = rows.select("run_id", "venue", "year", (F.col("median_days_to_expiry") / 365.25 * 0.36).alias("theta"), F.col("rho_median").alias("rho"), F.col("eta_median").alias("eta"), F.col("gamma_median").alias("gamma"))
    return rows.withColumn("phi", S.ssvi_phi(F.col("theta"), F.col("eta"), F.col("gamma")))


def q_ssvi_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Total variance at five log-moneynesses of every parameter block."""
    ks = (-0.4, -0.2, 0.0, 0.2, 0.4)
    rows = _surfaces(spark, folder)
    return _rounded(rows.select("run_id", "venue", "year", *[S.ssvi_variance(F.lit(k), F.col("theta"), F.col("rho"), F.col("phi")).alias(f"w{i}") for i, k in enumerate(ks)]))


def q_arb_slack(spark: SparkSession, folder: str) -> DataFrame:
    rows = _surfaces(spark, folder)
    return _rounded(rows.select("run_id", "venue", "year", S.butterfly_slack(F.col("theta"), F.col("rho"), F.col("phi")).alias("butterfly"), S.calendar_slack(F.col("rho"), F.col("gamma")).alias("calendar")))


def _options(spark: SparkSession, folder: str) -> DataFrame:
    rows = cross_section(spark, folder).where("iv > 0 and tau > 0 and forward_price > 0 and strike > 0")
    return rows.withColumn("model", S.black_price(F.col("forward_price"), F.col("strike"), F.col("tau"), F.col("iv"), F.col("callput") == "C"))


def q_bs_price(spark: SparkSession, folder: str) -> DataFrame:
    """Model price of each daily contract at its volume-weighted volatility."""
    return _rounded(_options(spark, folder).select("date", "expiration", "strike", "callput", "model"), 6)


def q_price_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and root-mean-square gap between traded and model prices over spot, per side and month."""
    rows = _options(spark, folder).where("price_usd > 0 and spot_price > 0").withColumn("gap", (F.col("price_usd") - F.col("model")) / F.col("spot_price"))
    out = rows.groupBy("callput", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rms"))
    return _rounded(out, 7)


def bkm_contracts(forward: F.Column, sigma: F.Column, tau: F.Column, k: F.Column) -> dict[str, F.Column]:
    """V, W and X by trapezoid over the strikes F exp(k) of out-of-the-money prices at one volatility."""
    strikes = F.transform(k, lambda z: forward * F.exp(z))
    price = F.transform(k, lambda z: S.black_price(forward, forward * F.exp(z), tau, sigma, z >= 0))
    out = {}
    for name, kernel in (("v", lambda z: 2 * (1 - z)), ("w", lambda z: 6 * z - 3 * z * z), ("x", lambda z: 12 * z * z - 4 * z * z * z)):
        out[name] = C.trapezoid(F.zip_with(k, price, _over_squared_strike(kernel, forward)), strikes)
    return out


def _over_squared_strike(kernel, forward: F.Column):
    return lambda z, p: kernel(z) / (forward * F.exp(z) * forward * F.exp(z)) * p


def q_bkm(spark: SparkSession, folder: str) -> DataFrame:
    """Moment contracts of each day's expiry nearest 27 days at its strike-averaged volatility, on 500 strikes within 1.5 of log-moneyness."""
    from skewline.operators import options

    rows = cross_section(spark, folder).where("iv > 0 and tau > 0 and forward_price > 0")
    near = options.nearest_maturity(rows).select("date", "expiration")
    day = rows.join(near, ["date", "expiration"], "left_semi").groupBy("date").agg(F.avg("iv").alias("sigma"), F.min("tau").alias("tau"), F.avg("forward_price").alias("f"))
    day = day.withColumn("k", C.linspace(-1.5, 1.5, 500))
    out = day.select("date", *[c.alias(n) for n, c in bkm_contracts(F.col("f"), F.col("sigma"), F.col("tau"), F.col("k")).items()])
    mu = -(F.col("v") / 2 + F.col("w") / 6 + F.col("x") / 24)
    return _rounded(out.withColumn("mu", mu).withColumn("variance", F.col("v") - F.col("mu") * F.col("mu")), 7)


# --- the same in SQL ---------------------------------------------------------------------------------------------

_X = f"list_transform(range(0, {POINTS}), lambda i: {LOW}::double + {HIGH - LOW}::double * i / {POINTS - 1})"


def _trapezoid(y: str, n: int = POINTS, x: str = "x") -> str:
    return f"list_sum(list_transform(range(1, {n}), lambda i: ({x}[i + 1] - {x}[i]) * ({y}[i] + {y}[i + 1]) / 2))"


def _upto(y: str, edge: float) -> str:
    return f"list_sum(list_transform(range(1, {POINTS}), lambda i: (x[i + 1] - x[i]) * ({y}[i] + {y}[i + 1]) / 2 * greatest(0.0::double, least(1.0::double, ({edge}::double - x[i]) / (x[i + 1] - x[i])))))"


def _map(expression: str, n: int = POINTS) -> str:
    return f"list_transform(range(1, {n + 1}), lambda j: {expression})"


def _r(x: str, digits: int = 8) -> str:
    return f"round({x} + {NUDGE}, {digits})"


_RAW = f"""with raw as (select date '2020-01-01' + (vec_id // 2)::int as date, case when vec_id % 2 = 0 then 'CME' else 'DER' end as venue,
    list_transform(embedding, lambda e: exp(e::double * 2)) as q, {_X} as x from embeddings where embedding is not null)"""
_DEN = f"""{_RAW}, m as (select *, {_trapezoid("q")} as mass from raw), den as (select date, venue, list_transform(q, lambda v: v / mass) as q, x from m)"""
_SIDES = f"""{_DEN}, sides as (select a.date, a.x, a.q as c, b.q as d from den a join den b on a.date = b.date and a.venue = 'CME' and b.venue = 'DER'),
    psi as (select date, x, {_map("ln(d[j] / c[j])")} as psi from sides)"""
_AVG = f"""{_DEN}, pt as (select venue, i, avg(q[i]) as v from den, (select unnest(range(1, {POINTS + 1})) as i) group by all),
    av0 as (select venue, list(v order by i) as q, {_X} as x from pt group by venue), av1 as (select *, {_trapezoid("q")} as mass from av0),
    av as (select venue, list_transform(q, lambda v: v / mass) as q from av1)"""
_BOTH = f"""{_AVG}, both_ as (select den.date, den.venue, den.q, den.x, av.q as p from den join av on av.venue <> den.venue)"""


def _contract_sql(bound: float, source: str = "den", y: str = "q") -> str:
    return f"""cut{int(bound * 10)} as (select date, venue, x, {_map(f"case when abs(ln(x[j])) <= {bound} then {y}[j] else 0.0::double end")} as c from {source}),
        cm{int(bound * 10)} as (select *, {_trapezoid("c")} as mass from cut{int(bound * 10)}),
        con{int(bound * 10)} as (select date, venue, {", ".join(f"{_trapezoid(f'z{k}')} as {n}" for n, k in (("v", 2), ("w", 3), ("x_", 4)))} from
            (select date, venue, x, {", ".join(f"{_map(f'c[j] / mass * pow(ln(x[j]), {k})')} as z{k}" for k in (2, 3, 4))} from cm{int(bound * 10)}))"""


def _mask(keep: str) -> str:
    return f"list_sum(list_transform(list_filter(range(1, {POINTS}), lambda i: {keep.format('x[i]')} and {keep.format('x[i + 1]')}), lambda i: (x[i + 1] - x[i]) * (psi[i] + psi[i + 1]) / 2))"


def _index(p: float) -> str:
    cum = f"list_sum(list_transform(range(1, k + 1), lambda i: (x[i + 1] - x[i]) * (q[i] + q[i + 1]) / 2))"
    return f"greatest(1, least(len(list_filter(range(1, {POINTS}), lambda k: {cum} < {p} * tot)) + 1, {POINTS - 2}))::int"


from skewline.plans.panels import _RET  # noqa: E402
from skewline.plans.trades import _FORWARD, _NEAR  # noqa: E402

_W = C.premium_weights(2.0)
_SURF = """with s0 as (select run_id, upper(trim(venue)) as venue, year, max(case when not isnan(rho_median) then rho_median end) as rho,
    max(case when not isnan(eta_median) then eta_median end) as eta, max(case when not isnan(gamma_median) then gamma_median end) as gamma,
    max(case when not isnan(median_days_to_expiry) then median_days_to_expiry end) as days from ssvi_skew_summary group by all),
    s1 as (select *, days / 365.25::double * 0.36::double as theta from s0 where venue is not null and abs(rho) < 1 and eta > 0 and gamma between 0 and 1 and days > 0),
    surf as (select *, eta / (pow(greatest(theta, 1e-8), gamma) * pow(1 + greatest(theta, 1e-8), 1 - gamma)) as phi from s1)"""
_D1 = "(ln(forward_price / strike) / (iv * sqrt(tau)) + iv * sqrt(tau) / 2)"
_D2 = f"({_D1} - iv * sqrt(tau))"
_CALL = f"(forward_price * {S.normal_cdf_sql('d1')} - strike * {S.normal_cdf_sql('d2')})"
_PUT = f"(strike * {S.normal_cdf_sql('(-d2)')} - forward_price * {S.normal_cdf_sql('(-d1)')})"
_OPT = f"""{_FORWARD}, o1 as (select *, {_D1} as d1, {_D2} as d2 from x where iv > 0 and tau > 0 and forward_price > 0 and strike > 0),
    opt as (select *, case when callput = 'C' then {_CALL} else {_PUT} end as model from o1)"""
_BK_PRICE = f"case when z >= 0 then f * {S.normal_cdf_sql('d1')} - kk * {S.normal_cdf_sql('d2')} else kk * {S.normal_cdf_sql('(-d2)')} - f * {S.normal_cdf_sql('(-d1)')} end"

SQL = {
    "q_trapz": f"{_RAW} select date, venue, {_r(_trapezoid('q'))} as mass from raw",
    "q_norm_moments": f"""{_DEN}, z as (select *, {_map("q[j] * x[j]")} as y1, {_map("q[j] * x[j] * x[j]")} as y2, {", ".join(f"{_map(f'q[j] * pow(ln(x[j]), {k})')} as l{k}" for k in (2, 3, 4))} from den)
        select date, venue, {_r(_trapezoid("q"))} as mass, {_r(_trapezoid("y1"))} as mean, {_r(f"{_trapezoid('y2')} - {_trapezoid('y1')} * {_trapezoid('y1')}")} as variance,
        {", ".join(f"{_r(_trapezoid(f'l{k}'))} as log{k}" for k in (2, 3, 4))} from z""",
    "q_interp": f"""{_DEN}, g as (select unnest(range(0, 9)) as i), e as (select date, venue, q, x, i::int as i, 0.3::double + 1.8::double * i / 8 as g from den, g),
        k as (select *, greatest(least(len(list_filter(x, lambda v: v < g)) - 1, {POINTS - 2}), 0) + 1 as k from e)
        select date, venue, i, {_r(f"case when g < x[1] or g > x[{POINTS}] then 0.0 else q[k] * (1 - (g - x[k]) / (x[k + 1] - x[k])) + q[k + 1] * ((g - x[k]) / (x[k + 1] - x[k])) end")} as value from k""",
    "q_cumtrapz": f"{_DEN} select date, venue, " + ", ".join(f"{_r(_upto('q', e))} as {n}" for e, n in ((0.9, "below_090"), (1.0, "below_100"), (1.1, "below_110"))) + " from den",
    "q_cdf_index": f"{_DEN}, t as (select *, {_trapezoid('q')} as tot from den) select date, venue, " + ", ".join(f"{_index(p)} as i{int(100 * p):02d}" for p in (0.05, 0.1, 0.9, 0.95)) + " from t",
    "q_log_ratio": f"{_SIDES} select (i - 1)::int as i, count(*) as n_days, {_r('avg(psi[i])')} as psi from psi, (select unnest(range(1, {POINTS + 1})) as i) group by i",
    "q_region_edge": f"{_DEN} select date, venue, {_r(_upto('q', 0.9))} as down, {_r(f'{_upto(chr(113), 1.1)} - {_upto(chr(113), 0.9)}')} as mid, {_r(f'{_trapezoid(chr(113))} - {_upto(chr(113), 1.1)}')} as up from den",
    "q_region_mask": f"{_SIDES} select date, {_r(_mask('{} < 0.9::double'))} as psi_down, {_r(_mask('{} between 0.9::double and 1.1::double'))} as psi_mid, {_r(_mask('{} > 1.1::double'))} as psi_up from psi",
    "q_avg_density": f"{_AVG} select venue, (i - 1)::int as i, {_r('q[i]')} as q from av, (select unnest(range(1, {POINTS + 1})) as i)",
    "q_ep_curve": f"""{_BOTH}, e as (select date, venue, x, {_map("(p[j] - q[j]) * (x[j] - 1)")} as ep from both_), t as (select date, venue, {_trapezoid("ep")} as total, {_upto("ep", 0.9)} as down,
        {_upto("ep", 1.1)} - {_upto("ep", 0.9)} as mid, {_trapezoid("ep")} - {_upto("ep", 1.1)} as up from e)
        select date, venue, {", ".join(f"{_r(c, 6)} as {c}" for c in ("total", "down", "mid", "up"))}, {_r("case when abs(total) > 1e-10 then down / total end", 6)} as share_down from t""",
    "q_bvrp": f"""{_BOTH}, y as (select *, {_map("q[j] * x[j]")} as yq, {_map("p[j] * x[j]")} as yp from both_), mm as (select *, {_trapezoid("yq")} as mq, {_trapezoid("yp")} as mp from y),
        g as (select date, venue, x, {_map("(x[j] - mq) * (x[j] - mq) * q[j] - (x[j] - mp) * (x[j] - mp) * p[j]")} as g from mm)
        select date, venue, {_r(_trapezoid("g"))} as total, {_r(_upto("g", 0.9))} as down, {_r(f"{_upto('g', 1.1)} - {_upto('g', 0.9)}")} as mid, {_r(f"{_trapezoid('g')} - {_upto('g', 1.1)}")} as up from g""",
    "q_hump": f"""{_BOTH}, k as (select date, venue, i, x[i] as r, q[i] / p[i] as m from both_, (select unnest(range(1, {POINTS + 1})) as i) where p[i] >= 1e-15),
        pk as (select date, venue, arg_max(r, (m, -i)) as peak, max(m) as top from k where r between 0.9::double and 1.1::double group by all),
        tr as (select k.date, k.venue, arg_min(r, (m, i)) as trough, min(m) as low from k join pk on pk.date = k.date and pk.venue = k.venue where r >= 0.7::double and r < peak group by all)
        select pk.date, pk.venue, {_r("top - low")} as height, {_r("peak")} as peak, {_r("trough")} as trough from pk left join tr on tr.date = pk.date and tr.venue = pk.venue""",
    "q_tilt": f"""{_DEN}, a as (select *, {_map("q[j] * x[j]")} as t from den), b as (select *, {_trapezoid("t")} as mass from a), c as (select date, venue, x, list_transform(t, lambda v: v / mass) as t from b),
        d as (select *, {_map("t[j] * x[j]")} as y from c) select date, venue, {_r(_trapezoid("t"))} as mass, {_r(_trapezoid("y"))} as mean from d""",
    "q_density_moments": f"""{_DEN}, {_contract_sql(1.0)}, {_contract_sql(0.5)} select date, venue, {_r("v")} as v, {_r("w")} as w, {_r("x_")} as x, 1.0::double as bound from con10
        union all select date, venue, {_r("v")}, {_r("w")}, {_r("x_")}, 0.5::double from con5""",
    "q_inverse_wedge": f"""{_DEN}, a as (select *, {_map("q[j] * x[j]")} as t0 from den), b as (select *, {_trapezoid("t0")} as mass from a), til as (select date, venue, x, list_transform(t0, lambda v: v / mass) as q from b),
        {_contract_sql(1.0)}, {_contract_sql(1.0, "til").replace("cut10", "cutt").replace("cm10", "cmt").replace("con10", "cont")}
        select a.date, a.venue, {_r("b.v - a.v")} as dv, {_r("b.w - a.w")} as dw, {_r("b.x_ - a.x_")} as dx from con10 a join cont b on a.date = b.date and a.venue = b.venue""",
    "q_premia": f"""{_DEN}, {_contract_sql(1.0)} select date, venue, {_r(f"v * {_W[0]}::double")} as pi2, {_r(f"w * ({_W[1]})::double")} as pi3, {_r(f"x_ * {_W[2]}::double")} as pi4,
        {_r(f"v * {_W[0]}::double + w * ({_W[1]})::double + x_ * {_W[2]}::double")} as total from con10""",
    "q_theta_sweep": f"{_DEN}, {_contract_sql(1.0)}, t as ("
    + " union all ".join(f"select venue, {t}::double as theta, v * {C.premium_weights(t)[0]}::double + w * ({C.premium_weights(t)[1]!r})::double + x_ * {C.premium_weights(t)[2]!r}::double as bound from con10" for t in (1.0, 2.0, 3.0))
    + f") select venue, theta, {_r('avg(bound) * (365.0 / 27)::double')} as annual from t group by all",
    "q_regional_premia": f"{_DEN}, z as (select date, venue, x, "
    + ", ".join(f"{_map(f'q[j] * pow(ln(x[j]), {k})')} as y{k}" for k in (2, 3, 4))
    + " from den) select date, venue, "
    + ", ".join(
        f"{_r(f'{_upto(f'y{k}', 0.9)} * ({w!r})::double')} as down{k}, {_r(f'({_upto(f'y{k}', 1.1)} - {_upto(f'y{k}', 0.9)}) * ({w!r})::double')} as mid{k}, {_r(f'({_trapezoid(f'y{k}')} - {_upto(f'y{k}', 1.1)}) * ({w!r})::double')} as up{k}"
        for k, w in zip((2, 3, 4), _W, strict=True)
    )
    + " from z",
    "q_validate_density": f"""{_RAW}, z as (select *, {_map("q[j] * x[j]")} as y from raw) select date, venue, abs({_trapezoid("q")} - 1) <= 0.02 as unit_mass,
        list_min(q) >= -1e-10 as nonnegative, abs({_trapezoid("y")} / {_trapezoid("q")} - 1) < 0.10 as centred from z""",
    "q_hist_density": f"""{_RET}, g as (select * from (select source, lead(btc_spot, 27) over (partition by source order by date) / btc_spot as g from ret) where g is not null),
        e as (select source, min(g) as a, max(g) as b, count(*) as n from g group by 1),
        h as (select g.source, a, b, n, least(floor((g - a) * 12 / (b - a)), 11)::int as bin, count(*) as n_in from g join e on e.source = g.source where b > a group by all)
        select source, bin, n_in, {_r("n_in * 12 / (n * (b - a))", 7)} as density from h""",
    "q_ssvi_eval": f"{_SURF} select run_id, venue, year, "
    + ", ".join(
        f"{_r(f'theta / 2 * (1 + rho * phi * ({k})::double + sqrt((phi * ({k})::double + rho) * (phi * ({k})::double + rho) + 1 - rho * rho))')} as w{i}" for i, k in enumerate((-0.4, -0.2, 0.0, 0.2, 0.4))
    )
    + " from surf",
    "q_arb_slack": f"""{_SURF} select run_id, venue, year, {_r("4 - greatest(theta * phi * (1 + abs(rho)), theta * phi * phi * (1 + abs(rho)))")} as butterfly,
        {_r("1 + sqrt(1 - rho * rho) - rho * rho * (1 - gamma)")} as calendar from surf""",
    "q_bs_price": f"{_OPT} select date, expiration, strike, callput, {_r('model', 6)} as model from opt",
    "q_price_gap": f"""{_OPT}, g as (select *, (price_usd - model) / spot_price as gap from opt where price_usd > 0 and spot_price > 0)
        select callput, strftime(date, '%Y-%m') as month, count(*) as n, {_r("avg(gap)", 7)} as mean, {_r("sqrt(avg(gap * gap))", 7)} as rms from g group by all""",
    "q_bkm": f"""{_FORWARD}, o as (select * from x where iv > 0 and tau > 0 and forward_price > 0){_NEAR.format(t="o")},
        dd as (select o.date, avg(iv) as sigma, min(o.tau) as tau, avg(o.forward_price) as f from o join near n on n.date = o.date and n.expiration = o.expiration group by 1),
        g as (select date, sigma, tau, f, i, -1.5::double + 3.0::double * i / 499 as z from dd, (select unnest(range(0, 500)) as i)),
        h as (select *, f * exp(z) as kk, -z / (sigma * sqrt(tau)) + sigma * sqrt(tau) / 2 as d1, -z / (sigma * sqrt(tau)) - sigma * sqrt(tau) / 2 as d2 from g),
        p as (select *, {_BK_PRICE} as price from h),
        y as (select date, i, kk, 2 * (1 - z) / (kk * kk) * price as yv, (6 * z - 3 * z * z) / (kk * kk) * price as yw, (12 * z * z - 4 * z * z * z) / (kk * kk) * price as yx from p),
        l as (select *, lag(kk) over w as k0, lag(yv) over w as v0, lag(yw) over w as w0, lag(yx) over w as x0 from y window w as (partition by date order by i)),
        s as (select date, sum((kk - k0) * (yv + v0) / 2) as v, sum((kk - k0) * (yw + w0) / 2) as w, sum((kk - k0) * (yx + x0) / 2) as xx from l group by 1)
        select date, {_r("v", 7)} as v, {_r("w", 7)} as w, {_r("xx", 7)} as x, {_r("-(v / 2 + w / 6 + xx / 24)", 7)} as mu,
        {_r("v - (v / 2 + w / 6 + xx / 24) * (v / 2 + w / 6 + xx / 24)", 7)} as variance from s""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
