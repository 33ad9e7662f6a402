"""Queries of smiles fitted to trades, densities implied by smiles, and the conditional kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions import curves as C
from skewline.operators import kernel, ordered, panel, surface
from skewline.plans.curve_queries import HIGH, LOW, POINTS, _against_average, _surfaces
from skewline.plans.panels import fits
from skewline.plans.trades import NUDGE, _FORWARD, _rounded, cross_section

SLICE = ["date", "expiration"]


def q_atm_variance(spark: SparkSession, folder: str) -> DataFrame:
    """Total variance at the forward of each slice with two options or more."""
    return _rounded(surface.atm_variance(cross_section(spark, folder), SLICE, 2))


def q_monotone_variance(spark: SparkSession, folder: str) -> DataFrame:
    """The same, made non-decreasing in maturity on each day."""
    theta = surface.atm_variance(cross_section(spark, folder), SLICE, 2)
    return _rounded(surface.monotone(theta, ["date"]).select("date", "expiration", "theta"), 7)


def q_smile_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Smile parameters of each slice with four options or more."""
    return surface.calibrated(cross_section(spark, folder), SLICE)


def q_smile_density(spark: SparkSession, folder: str) -> DataFrame:
    """Mass, mean and deviation of the density implied by each parameter block, and whether it is valid."""
    rows = _surfaces(spark, folder).withColumn("d", surface.smile_density(F.col("theta"), F.col("rho"), F.col("phi")))
    rows = rows.select("run_id", "venue", "year", F.transform("d", lambda s: s["q"]).alias("q"), F.transform("d", lambda s: s["r"]).alias("x"))
    mean, variance = C.mean_variance(F.col("q"), F.col("x"))
    out = rows.select("run_id", "venue", "year", C.trapezoid(F.col("q"), F.col("x")).alias("mass"), mean.alias("mean"), variance.alias("variance"))
    return out.withColumn("valid", (F.abs(F.col("mass") - 1) <= 0.02) & (F.abs(F.col("mean") - 1) < 0.10))


def _kernel_days(spark: SparkSession, folder: str) -> DataFrame:
    state = panel.venue_difference(fits(spark, folder), "date", "venue", "rmse").select("date", ((F.col("DER") + F.col("CME")) * 25 - 1).alias("z"))
    return _against_average(spark, folder).join(state, "date", "left").na.fill({"z": 0.0})


def _kernels(spark: SparkSession, days: DataFrame) -> DataFrame:
    x = [LOW + (HIGH - LOW) * i / (POINTS - 1) for i in range(POINTS)]
    rows = []
    for venue in ("CME", "DER"):
        theta, value, n = kernel.fit_kernel(days.where(F.col("venue") == venue), "q", "p", ["z"], x)
        rows += [(venue, f"s{i + 1}", float(theta[i, 0]), float(theta[i, 1]), value, n) for i in range(3)]
    return spark.createDataFrame(rows, "venue string, term string, constant double, slope double, objective double, n_days bigint")


def q_kernel_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel coefficients per venue, affine in the day's mean fit error of that venue (standardised)."""
    return _kernels(spark, _kernel_days(spark, folder))


def _coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """(venue, date, z, x, p, s1, s2, s3): the days with the kernel's coefficients at their states."""
    days = _kernel_days(spark, folder)
    terms = _kernels(spark, days).groupBy("venue").pivot("term", ["s1", "s2", "s3"]).agg(F.first(F.struct("constant", "slope")))
    # two rows
    return days.join(F.broadcast(terms), "venue").withColumns({t: F.col(t)["constant"] + F.col(t)["slope"] * F.col("z") for t in ("s1", "s2", "s3")})


def q_kernel_series(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of the kernel day by day."""
    return _coefficients(spark, folder).select("venue", "date", "z", "s1", "s2", "s3")


def q_kernel_regimes(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel at each third's mean state: its coefficients, where it is greatest, its value there, and its mean under p, which is one."""
    rows = ordered.quantile_bins(_coefficients(spark, folder), "z", "regime", ["low", "mid", "high"], ["venue"])
    means = rows.groupBy("venue", "regime").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("z", "s1", "s2", "s3")], F.any_value("p").alias("p"), F.any_value("x").alias("x"))
    exponent = lambda r: F.exp(F.col("s1") * ((r - 1.2) / 0.8) + F.col("s2") * F.pow((r - 1.2) / 0.8, F.lit(2.0)) + F.col("s3") * F.pow((r - 1.2) / 0.8, F.lit(3.0)))
    means = means.withColumn("e", F.transform("x", exponent))
    means = means.withColumn("scale", C.trapezoid(F.zip_with("e", "p", lambda a, b: a * b), F.col("x")))
    means = means.withColumn("m", F.transform("e", lambda v: v / F.col("scale")))
    top = F.array_max("m")
    return means.select(
        "venue", "regime", "n", "z", "s1", "s2", "s3", F.col("x")[F.array_position("m", top).cast("int") - 1].alias("greatest_at"), top.alias("greatest"),
        C.trapezoid(F.zip_with("m", "p", lambda a, b: a * b), F.col("x")).alias("mean"),
    )


SQL = {
    "q_atm_variance": f"""{_FORWARD}, o as (select date, expiration, tau, log_moneyness as k, iv * iv * tau as w from x where iv > 0 and tau > 0 and log_moneyness is not null),
        g as (select date, expiration, min(tau) as tau, count(*) as n_options, max(case when k <= 0 then k end) as ka, min(case when k >= 0 then k end) as kb,
            arg_max(w, (k, w)) filter (k <= 0) as wa, arg_min(w, (k, w)) filter (k >= 0) as wb from o group by all)
        select date, expiration, round(tau + {NUDGE}, 8) as tau, n_options,
            round(case when ka is null then wb when kb is null or ka = kb then wa else wa + (wb - wa) * (-ka / (kb - ka)) end + {NUDGE}, 8) as theta from g where n_options >= 2""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
