"""Queries of the inference operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.operators import inference
from skewline.plans.panels import _PANEL, _TER, _terciles, daily
from skewline.plans.trades import NUDGE, _rounded

DRAWS, BLOCK, LAGS = 1000, 27, 27


def q_boot_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Band of each feed's mean realised volatility."""
    return _rounded(inference.bootstrap_means(daily(spark, folder), "source", "date", "rv", BLOCK, DRAWS), 7)


def q_boot_group(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of the mean log price by variance regime; labels are drawn with their rows."""
    rows = _terciles(spark, folder).withColumn("level", F.log("btc_spot"))
    return _rounded(inference.bootstrap_means(rows, "source", "date", "level", BLOCK, DRAWS, "regime"), 7)


def q_ols_hac(spark: SparkSession, folder: str) -> DataFrame:
    """Implied on realised volatility per feed, Newey-West errors."""
    out = inference.robust_ols(daily(spark, folder), "source", "date", "dvol", {"rv": F.col("rv")}, LAGS)
    return _rounded(out.select("source", "term", "n", "estimate", "error"), 6)


def q_dk(spark: SparkSession, folder: str) -> DataFrame:
    """The pooled panel of all feeds: errors robust to what moves them together on a day."""
    rows = daily(spark, folder).select("date", "dvol", "rv", F.lit("pooled").alias("panel"))
    out = inference.robust_ols(rows, "panel", "date", "dvol", {"rv": F.col("rv")}, LAGS, by_date=True)
    return _rounded(out.select("panel", "term", "n", "estimate", "error"), 6)


def _draws_sql(base: str, rows: str, label: bool = False, draws: int = DRAWS) -> str:
    """Means of rows_ (k, o, v[, label]) by key and draw (me), and over all rows (ob)."""
    lab = ", label" if label else ""
    return f"""{base}, rows_ as ({rows}), nn as (select k, count(*) as n, ceil(count(*) / {BLOCK}.0)::bigint as nb from rows_ group by 1),
        ind as (select k, v, row_number() over (partition by k order by o) - 1 as i{', label' if label else ''} from rows_),
        mx as (select max(nb) as m from nn), dr as (select unnest(range(0, {draws})) as draw),
        bl as (select k, n, draw, b, (1103515245::bigint * (draw * m + b) + 12345) % 2147483648 % n as a, least({BLOCK}, n - b * {BLOCK}) as len
            from (select k, n, draw, m, unnest(range(0, nb)) as b from nn, mx, dr)),
        px as (select k, draw, unnest(range(a, a + len)) % n as i from bl),
        me as (select ind.k, draw{lab}, avg(v) as mean from px join ind on ind.k = px.k and ind.i = px.i group by all),
        ob as (select k{lab}, count(*) as n, avg(v) as mean from ind group by all)"""


def _boot_sql(base: str, rows: str, label: str | None, draws: int = DRAWS) -> str:
    return f"""{_draws_sql(base, f"select source as k, date as o, {rows}", bool(label), draws)}
        select ob.k as source{', ob.label as ' + label if label else ''}, ob.n, round(ob.mean + {NUDGE}, 7) as mean, round(quantile_cont(me.mean, 0.025) + {NUDGE}, 7) as low,
        round(quantile_cont(me.mean, 0.975) + {NUDGE}, 7) as high, round(stddev_samp(me.mean) + {NUDGE}, 7) as error
        from ob join me on me.k = ob.k{' and me.label = ob.label' if label else ''} group by all"""


def _ols_sql(base: str, rows: str, key: str, by_date: bool) -> str:
    step = "sc as (select k, o, sum(h0) as h0, sum(h1) as h1 from s0 group by all)" if by_date else "sc as (select k, o, h0, h1 from s0)"
    lags = ", ".join(f"lag(h{i}, {m}) over w as l{m}_{i}" for m in range(1, LAGS + 1) for i in (0, 1))

    def cell(i: int, j: int) -> str:
        both = " + ".join(f"(1 - {m}.0::double / {LAGS + 1}) * coalesce(sum(h{i} * l{m}_{j} + l{m}_{i} * h{j}), 0)" for m in range(1, LAGS + 1))
        return f"sum(h{i} * h{j}) + {both}"

    return f"""{base}, rows_ as ({rows}), mo as (select k, count(*)::double as n, sum(x) as sx, sum(x * x) as sxx, sum(y) as sy, sum(x * y) as sxy from rows_ group by 1),
        co as (select *, n * sxx - sx * sx as det from mo), be as (select *, (sxx * sy - sx * sxy) / det as b0, (n * sxy - sx * sy) / det as b1 from co),
        s0 as (select r.k, o, y - b0 - b1 * x as h0, x * (y - b0 - b1 * x) as h1 from rows_ r join be on be.k = r.k), {step},
        lg as (select *, {lags} from sc window w as (partition by k order by o)),
        me as (select k, {cell(0, 0)} as s00, {cell(0, 1)} as s01, {cell(1, 1)} as s11 from lg group by 1)
        select be.k as {key}, 'const' as term, n::bigint as n, round(b0 + {NUDGE}, 6) as estimate, round(sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11)) / abs(det) + {NUDGE}, 6) as error from be join me on me.k = be.k
        union all select be.k, 'rv', n::bigint, round(b1 + {NUDGE}, 6), round(sqrt((sx * sx * s00 - 2 * sx * n * s01 + n * n * s11)) / abs(det) + {NUDGE}, 6) from be join me on me.k = be.k"""


SQL = {
    "q_boot_mean": _boot_sql(_PANEL, "rv as v from panel where rv is not null", None),
    "q_boot_group": _boot_sql(_TER, "ln(btc_spot) as v, regime as label from ter", "regime"),
    "q_ols_hac": _ols_sql(_PANEL, "select source as k, date as o, dvol as y, rv as x from panel where dvol is not null and rv is not null", "source", False),
    "q_dk": _ols_sql(_PANEL, "select 'pooled' as k, date as o, dvol as y, rv as x from panel where dvol is not null and rv is not null", "panel", True),
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
