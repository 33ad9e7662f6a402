"""Regressions of the venues' difference and of the pooled panel, bands of curves; all with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions import curves as C
from skewline.operators import inference, options, ordered, panel
from skewline.plans.curve_queries import _SIDES, _pairs
from skewline.plans.inference_queries import BLOCK, LAGS, _boot_sql
from skewline.plans.panels import _EVENTS, _PANEL, _WEDGE, LABELS, daily, fits
from skewline.plans.trades import _FORWARD, _NEAR, NUDGE, _rounded, cross_section

#: Draws of the bands of curves, one band per grid point.
CURVE_DRAWS = 200


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """Means over the feeds per day."""
    return daily(spark, folder).groupBy("date").agg(*[F.avg(c).alias(c) for c in ("vix", "fng", "dgs2")])


def _wedge(spark: SparkSession, folder: str) -> DataFrame:
    return panel.venue_difference(fits(spark, folder), "date", "venue", "rmse").withColumn("pair", F.lit("DER - CME"))


def _table(out: DataFrame, key: str) -> DataFrame:
    return _rounded(out.select(key, "term", "n", "estimate", "error", "t", "r2"), 6)


def q_matched_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference in fit error on the days' mean volatility index and sentiment, 27 lags, with p-values and stars."""
    rows = _wedge(spark, folder).join(_state(spark, folder), "date")
    out = inference.robust_ols(rows, "pair", "date", "wedge", {"vix": F.col("vix"), "fng": F.col("fng")}, LAGS)
    return _rounded(out.select("pair", "term", "n", "estimate", "error", "t", "p", "r2", panel.stars(F.col("p")).alias("stars")), 6)


def q_event_regression(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference in fit error on event-window dummies."""
    dummies = {n: F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")).cast("double") for n, (a, b) in _EVENTS.items()}
    return _table(inference.robust_ols(_wedge(spark, folder), "pair", "date", "wedge", dummies, LAGS), "pair")


def q_pooled_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Both venues' daily fit errors pooled: venue dummy, state, and their product; errors robust to what moves both on a day."""
    wide = _wedge(spark, folder).join(_state(spark, folder), "date")
    sides = F.array(*[F.struct(F.lit(float(v == "DER")).alias("der"), F.col(v).alias("error_")) for v in ("CME", "DER")])
    rows = wide.select("date", "vix", F.lit("pooled").alias("panel"), F.inline(sides))
    regressors = {"der": F.col("der"), "vix": F.col("vix"), "der_vix": F.col("der") * F.col("vix")}
    return _table(inference.robust_ols(rows, "panel", "date", "error_", regressors, LAGS, by_date=True), "panel")


_SPECS: dict[str, tuple[str, ...]] = {"basis_only": ("vix",), "funding_only": ("dgs2",), "joint": ("vix", "dgs2")}


def q_friction(spark: SparkSession, folder: str) -> DataFrame:
    """The venues' difference on each friction alone and on both, with the share explained."""
    rows = _wedge(spark, folder).join(_state(spark, folder), "date").where("vix is not null and dgs2 is not null")
    out = None
    for name, fields in _SPECS.items():
        one = _table(inference.robust_ols(rows.withColumn("spec", F.lit(name)), "spec", "date", "wedge", {f: F.col(f) for f in fields}, LAGS), "spec")
        out = one if out is None else out.unionByName(one)
    return out


def _log_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """(i, date, psi): the log ratio of the venues' densities at each grid point and day."""
    return _pairs(spark, folder).select("date", F.posexplode(C.log_ratio(F.col("d"), F.col("c"))).alias("i", "psi"))


def q_boot_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Band of the mean log-ratio curve at each grid point; the same days are drawn for all points."""
    return _rounded(inference.bootstrap_means(_log_ratios(spark, folder), "i", "date", "psi", BLOCK, CURVE_DRAWS), 7)


def q_boot_curve_regime(spark: SparkSession, folder: str) -> DataFrame:
    """The same by regime of the day's volatility index; labels are drawn with their days."""
    state = _state(spark, folder).where("vix is not null").withColumn("all", F.lit(0))
    regimes = ordered.quantile_bins(state, "vix", "regime", LABELS, ["all"]).select("date", "regime")
    rows = _log_ratios(spark, folder).join(regimes, "date")
    return _rounded(inference.bootstrap_means(rows, "i", "date", "psi", BLOCK, CURVE_DRAWS, "regime"), 7)


def q_near_target(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's expiry nearest 27 days, if within 7 of that."""
    near = options.nearest_maturity(cross_section(spark, folder)).where(F.abs(F.col("days_to_expiry") - 27) <= 7)
    return _rounded(near.select("date", "expiration", "days_to_expiry", "forward_price"))


# --- the same in SQL ---------------------------------------------------------------------------------------------


def _det(m: list[list[str]]) -> str:
    if not m:
        return "1.0::double"
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {_det([[*r[:j], *r[j + 1 :]] for r in m[1:]])}" for j in range(len(m))) + ")"


def _ols(base: str, rows: str, key: str, names: list[str], by_date: bool = False, tail: str = "") -> str:
    """Least squares with Bartlett-weighted errors: rows_ (k, o, y, x1, ...); a term's variance is that of its influence series."""
    k = len(names) + 1
    x = ["1.0::double", *[f"x{i}" for i in range(1, k)]]
    cell = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    # a regressor that is 0 throughout has the coefficient 0
    sums = [f"coalesce(nullif(sum({x[i]} * {x[j]}), 0), {float(i == j)})::double as m{i}{j}" for i in range(k) for j in range(i, k)] + [f"sum({x[i]} * y) as v{i}" for i in range(k)]
    matrix = [[cell(i, j) for j in range(k)] for i in range(k)]

    def minor(i: int, j: int) -> str:
        rest = [[c for b, c in enumerate(r) if b != j] for a, r in enumerate(matrix) if a != i]
        return f"{'-' if (i + j) % 2 else ''}{_det(rest)}"

    inverse = ", ".join(f"{minor(i, j)} / det as c{i}{j}" for i in range(k) for j in range(k))
    estimates = ", ".join("(" + " + ".join(f"c{i}{j} * v{j}" for j in range(k)) + f") as b{i}" for i in range(k))
    fitted = " + ".join(f"b{i} * {x[i]}" for i in range(k))
    influence = ", ".join("(" + " + ".join(f"c{i}{j} * {x[j]}" for j in range(k)) + f") * u as p{i}" for i in range(k))
    series = f"select k, o, {', '.join(f'sum(p{i}) as p{i}' for i in range(k))} from inf group by all" if by_date else "select * from inf"
    weight = f"case when a.i = b.i then 1.0::double else 2 * (1 - (a.i - b.i) / (least({LAGS}, a.n - 1) + 1.0::double)) end"
    terms = " union all ".join(
        f"select be.k as {key}, '{name}' as term, be.n as n, b{i} as estimate, sqrt(greatest(s{i}, 0)) as error, b{i} / nullif(sqrt(greatest(s{i}, 0)), 0) as t, 1 - rss / tss as r2 from be join va on va.k = be.k join rs on rs.k = be.k"
        for i, name in enumerate(["const", *names])
    )
    return f"""{base}, rows_ as ({rows}), mo as (select k, count(*) as n, var_pop(y) * count(*) as tss, {', '.join(sums)} from rows_ group by 1),
        de as (select *, {_det(matrix)} as det from mo), iv as (select *, {inverse} from de), be as (select *, {estimates} from iv),
        re as (select r.*, be.* exclude (k), y - ({fitted}) as u from rows_ r join be on be.k = r.k), rs as (select k, sum(u * u) as rss from re group by 1),
        inf as (select k, o, {influence} from re), se as ({series}),
        nu as (select *, row_number() over (partition by k order by o) as i, count(*) over (partition by k) as n from se),
        va as (select a.k, {', '.join(f'sum({weight} * a.p{i} * b.p{i}) as s{i}' for i in range(k))} from nu a join nu b on a.k = b.k and b.i between a.i - least({LAGS}, a.n - 1) and a.i group by 1),
        tm as ({terms}) {tail or f"select {key}, term, n, {', '.join(f'round({c} + {NUDGE}, 6) as {c}' for c in ('estimate', 'error', 't', 'r2'))} from tm"}"""


#: Two-sided normal tail by the series of the error function with positive terms; beyond 8 deviations it is 0 here.
_P = """case when abs(t) > 8 then 0.0::double else 1 - 2 / sqrt(pi()) * exp(-t * t / 2) * list_sum(list_transform(range(0, 200),
    lambda j: exp(2 * j * ln(2.0::double) + lgamma(j + 1.0::double) - lgamma(2 * j + 2.0::double) + (2 * j + 1) * ln(abs(t) / sqrt(2.0::double))))) end"""
_STATE = _WEDGE.replace("\nwith fits", _PANEL.rstrip() + ", fits", 1) + ", st as (select date, avg(vix) as vix, avg(fng) as fng, avg(dgs2) as dgs2 from panel group by 1), j as (select wedge.*, vix, fng, dgs2 from wedge join st on st.date = wedge.date)"
_PSI = f"{_SIDES}, ps as (select date, unnest(range(0, 64))::int as i, unnest(psi) as v from psi)"
_REGIMES = _PSI.replace("with raw", _PANEL.rstrip() + ", raw", 1) + """, vd as (select date, avg(vix) as vix from panel group by 1 having avg(vix) is not null),
    ve as (select quantile_cont(vix, 1.0/3) as e1, quantile_cont(vix, 2.0/3) as e2 from vd),
    vr as (select date, case when vix <= e1 then 'low' when vix <= e2 then 'mid' else 'high' end as regime from vd, ve),
    pr as (select ps.*, regime from ps join vr on vr.date = ps.date)"""


def _curve_sql(base: str, rows: str, label: str | None) -> str:
    return _boot_sql(base, rows, label, CURVE_DRAWS).replace("source as k, date as o", "i as k, date as o").replace("ob.k as source", "ob.k as i")


SQL = {
    "q_matched_difference": _ols(
        _STATE, "select 'DER - CME' as k, date as o, wedge as y, vix as x1, fng as x2 from j where vix is not null and fng is not null", "pair", ["vix", "fng"],
        tail=f"""select pair, term, n, {', '.join(f'round({c} + {NUDGE}, 6) as {c}' for c in ('estimate', 'error', 't', 'p', 'r2'))},
            case when p < 0.01 then '***' when p < 0.05 then '**' when p < 0.1 then '*' else '' end as stars from (select *, {_P} as p from tm)""",
    ),
    "q_event_regression": _ols(
        _WEDGE,
        "select 'DER - CME' as k, date as o, wedge as y, " + ", ".join(f"(date between date '{a}' and date '{b}')::int::double as x{i}" for i, (a, b) in enumerate(_EVENTS.values(), 1)) + " from wedge",
        "pair",
        list(_EVENTS),
    ),
    "q_pooled_panel": _ols(
        _STATE,
        """select 'pooled' as k, date as o, cme as y, 0.0::double as x1, vix as x2, 0.0::double as x3 from j where vix is not null
        union all select 'pooled', date, der, 1.0::double, vix, vix from j where vix is not null""",
        "panel",
        ["der", "vix", "der_vix"],
        by_date=True,
    ),
    "q_friction": " union all ".join(
        "select * from ("
        + _ols(_STATE, f"select '{name}' as k, date as o, wedge as y, {', '.join(f'{c} as x{i}' for i, c in enumerate(fields, 1))} from j where vix is not null and dgs2 is not null", "spec", list(fields))
        + ")"
        for name, fields in _SPECS.items()
    ),
    "q_boot_curve": _curve_sql(_PSI, "v from ps where v is not null", None),
    "q_boot_curve_regime": _curve_sql(_REGIMES, "v, regime as label from pr where v is not null", "regime"),
    "q_near_target": f"""{_FORWARD}{_NEAR.format(t="x")} select date, expiration, days_to_expiry, round(forward_price + {NUDGE}, 8) as forward_price from near where abs(days_to_expiry - 27) <= 7""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
