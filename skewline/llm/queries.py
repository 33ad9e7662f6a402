"""Queries of the problems 2 and 6 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.llm import digests, leakage, packing, truncation
from skewline.sources.tables import table

#: Rank file of the tokenizer where the session's ``spark.skewline.tokenizer`` names none.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
MISSING = -99.99


def _once(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the latest by ``order``. Combines on the map side; rows repeated have the same content."""
    rest = [c for c in df.columns if c not in key]
    latest = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_latest")
    return df.groupBy(*key).agg(latest).select(*key, *[F.col("_latest")[c].alias(c) for c in rest])


def _venue() -> F.Column:
    return F.upper(F.trim("venue"))


def _rmse(spark: SparkSession, folder: str) -> DataFrame:
    fits = table(spark, folder, "ssvi_diagnostics").select("fit_id", "date", "venue", "rmse", "fitted_at")
    return _once(fits, ["fit_id"], "fitted_at").where(F.col("rmse") != MISSING)


def _rho(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "ssvi_skew_summary").select("run_id", _venue().alias("venue"), "year", "run_date", "rho_median")
    return _once(runs, ["run_id", "venue", "year"], "run_date").where(F.col("rho_median") != MISSING)


def p2_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Certified percentiles of the fit error per venue and year, merged from one digest per venue and day."""
    rows = _rmse(spark, folder)
    days = digests.digests(rows, {"venue": _venue(), "date": F.col("date")}, F.col("rmse"))
    years = digests.merged(days.withColumn("year", F.year("date")).withColumn("_salt", F.dayofyear("date").cast("bigint")), ["venue", "year"])
    estimates = digests.digest_percentiles(years, ["venue", "year"], PROBABILITIES)
    return digests.certified(rows, {"venue": _venue(), "year": F.year("date")}, F.col("rmse"), estimates, PROBABILITIES)


def p2_days(spark: SparkSession, folder: str) -> DataFrame:
    """The table of digests of the fit error, one per venue and day, as it is kept to be merged: values, clusters, extremes."""
    days = digests.digests(_rmse(spark, folder), {"venue": _venue(), "date": F.col("date")}, F.col("rmse"))
    weight = F.round(F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w)).cast("bigint")
    return days.select("venue", "date", weight.alias("n"), F.col("_min").alias("minimum"), F.col("_max").alias("maximum"))


def p2_rho(spark: SparkSession, folder: str) -> DataFrame:
    """Certified percentiles of the median skew per venue and year block."""
    rows, keys = _rho(spark, folder), {"venue": F.col("venue"), "year": F.col("year")}
    estimates = digests.digest_percentiles(digests.digests(rows, keys, F.col("rho_median")), list(keys), PROBABILITIES)
    return digests.certified(rows, keys, F.col("rho_median"), estimates, PROBABILITIES)


def p2_rmse_certified(spark: SparkSession, folder: str) -> DataFrame:
    """Values counted and whether each percentile is certified; SQL has the same counts and expects all to be."""
    return p2_rmse(spark, folder).select("venue", "year", "p", "n", "certified")


def p2_rho_certified(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p2_rmse_certified``, of the median skew."""
    return p2_rho(spark, folder).select("venue", "year", "p", "n", "certified")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each stated capacity."""
    counts = packing.token_counts(table(spark, folder, "documents"), "doc_id", "text", spark.conf.get("spark.skewline.tokenizer", RANKS))
    return packing.packed(counts, table(spark, folder, "pack_budgets"))


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and fill per capacity."""
    return packing.packing_summary(p6_packed(spark, folder), table(spark, folder, "pack_budgets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a passage of an evaluation item."""
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.truncated_texts(table(spark, folder, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut documents per source, of those with a text."""
    return truncation.truncation_by_source(truncation.truncated_texts(table(spark, folder, "documents")))


QUERIES = {
    "p2_rmse": p2_rmse,
    "p2_rho": p2_rho,
    "p2_days": p2_days,
    "p2_rmse_certified": p2_rmse_certified,
    "p2_rho_certified": p2_rho_certified,
    "p6_packed": p6_packed,
    "p6_summary": p6_summary,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}
_P = ", ".join(f"{p}::double" for p in PROBABILITIES)

SQL: dict[str, str] = {
    "p2_rmse_certified": f"""with f as (select fit_id, any_value(upper(trim(venue))) as venue, any_value(year(date)) as year, any_value(rmse) as rmse from ssvi_diagnostics group by fit_id),
        c as (select venue, year, count(*) as n from f where rmse is not null and not isnan(rmse) and rmse <> -99.99 group by all)
        select venue, year, n, unnest([{_P}]) as p, true as certified from c""",
    "p2_rho_certified": f"""with f as (select run_id, upper(trim(venue)) as venue, year, any_value(rho_median) as rho from ssvi_skew_summary group by all),
        c as (select venue, year, count(*) as n from f where rho is not null and not isnan(rho) and rho <> -99.99 group by all)
        select venue, year, n, unnest([{_P}]) as p, true as certified from c""",
    "p2_days": """with f as (select fit_id, any_value(upper(trim(venue))) as venue, any_value(date) as date, any_value(rmse) as rmse from ssvi_diagnostics group by fit_id)
        select venue, date, count(*) as n, min(rmse) as minimum, max(rmse) as maximum from f where rmse is not null and not isnan(rmse) and rmse <> -99.99 group by all""",
}
