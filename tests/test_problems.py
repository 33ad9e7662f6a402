"""The general training-data operators against plain Python on small, awkward inputs."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.operators import plausibility, regular, rolling, skew

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


# --- rolling totals ----------------------------------------------------------------------------------------------


def test_rolling_totals_count_inactive_days_and_use_fixed_denominators(spark):
    stamp = dt.datetime(2024, 2, 1)
    rows = [
        ("a", day(0), 10.0, stamp, "x"),
        ("a", day(0), 12.0, stamp + dt.timedelta(hours=1), "x"),  # loaded again: the later one stands
        ("a", day(0), float("nan"), stamp + dt.timedelta(hours=2), "x"),  # unusable: doesn't replace it
        ("a", day(3), 0.0, stamp, "x"),
        ("a", day(5), 1.0, stamp, "x"),
        ("a", day(9), None, stamp, "x"),
        ("b", day(2), 5.0, stamp, "x"),
        (None, day(2), 5.0, stamp, "x"),
        ("b", None, 5.0, stamp, "x"),
    ]
    df = spark.createDataFrame(rows, "source string, date date, v double, loaded_at timestamp, _entity string")
    out = rolling.rolling_totals(df, "source", "date", ["v"], (1, 7), "loaded_at")
    got = {(r["source"], r["date"]): r for r in out.collect()}
    assert sorted(got) == [("a", day(n)) for n in range(10)] + [("b", day(2))]
    assert got["a", day(0)]["v"] == 12.0 and got["a", day(3)]["v"] is None
    assert got["a", day(6)]["v_total_7d"] == 13.0 and got["a", day(7)]["v_total_7d"] == 1.0
    assert got["a", day(6)]["v_avg_7d"] == pytest.approx(13 / 7) and got["a", day(6)]["v_days_7d"] == 2
    gaps = {(r["source"], r["date"]) for r in rolling.inactive_days(out, "source", "date", ["v"]).collect()}
    assert gaps == {("a", day(n)) for n in range(10) if n not in (0, 5)}


def test_rolling_totals_of_nothing(spark):
    df = spark.createDataFrame([], "source string, date date, v double")
    assert rolling.rolling_totals(df, "source", "date", ["v"]).count() == 0


# --- keys with most records --------------------------------------------------------------------------------------


def test_key_results_equal_plain_python(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.0, 2.0, 2.5, 0.0, -3.0]), 1.0) for _ in range(500)] + [(f"k{i % 40}", rng.gauss(0, 10), rng.random()) for i in range(300)]
    rows += [("hot", None, 1.0), ("hot", float("nan"), 1.0), (None, 1.0, 1.0), ("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    f = skew.value_frequencies(df, {"k": F.col("k")}, F.col("v"), F.col("w"))
    totals = {r["k"]: r for r in skew.key_totals(f, ["k"]).collect()}
    shares = {(r["k"], r["p"]): r["percentile"] for r in skew.key_percentiles(f, ["k"], (0.0, 0.1, 0.5, 1.0)).collect()}
    for k in {r[0] for r in rows if r[0]}:
        v = sorted(r[1] for r in rows if r[0] == k and r[1] is not None and not math.isnan(r[1]))
        assert totals[k]["n_values"] == len(v) and totals[k]["n_distinct"] == len(set(v))
        assert totals[k]["n_rows"] == sum(r[0] == k for r in rows)
        if v:
            assert totals[k]["mode"] == min(set(v), key=lambda x: (-v.count(x), x))
            for p in (0.0, 0.1, 0.5, 1.0):
                assert shares[k, p] == v[max(math.ceil(p * len(v)), 1) - 1]
    assert totals["empty"]["mode"] is None and totals["empty"]["weighted_mean"] is None


def test_heavy_keys_count_null_keys_in_the_total(spark):
    df = spark.createDataFrame([("a", 1.0)] * 2 + [("b", 1.0)] + [(None, 1.0)] * 7, "k string, v double")
    f = skew.value_frequencies(df, {"k": F.col("k")}, F.col("v"))
    assert {r["k"] for r in skew.heavy_keys(f, ["k"], 0.2).collect()} == {"a"}
    none = skew.value_frequencies(df.limit(0), {"k": F.col("k")}, F.col("v"))
    assert skew.heavy_keys(none, ["k"], 0.2).count() == 0


# --- regular grid ------------------------------------------------------------------------------------------------


def pchip(x, y, at):
    """Monotone cubic with weighted harmonic slopes."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    s = np.zeros(n)
    if n == 2:
        s[:] = d[0]
    else:
        for i in range(1, n - 1):
            if d[i - 1] * d[i] > 0:
                a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                s[i] = (a + b) / (a / d[i - 1] + b / d[i])

        def end(h0, h1, d0, d1):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if np.sign(v) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v

        s[0], s[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = min(max(np.searchsorted(x, at, "right") - 1, 0), n - 2)
    t = (at - x[i]) / h[i]
    return y[i] * (2 * t**3 - 3 * t**2 + 1) + s[i] * h[i] * (t**3 - 2 * t**2 + t) + y[i + 1] * (3 * t**2 - 2 * t**3) + s[i + 1] * h[i] * (t**3 - t**2)


def plain_series(readings, longest):
    """{period: (value, status)} of a list of (t, v), t in periods."""
    at = {t: float(np.mean([v for u, v in readings if u == t])) for t, _ in readings}
    periods = {}
    for t, v in readings:
        periods.setdefault(int(t), []).append(v)
    out, xs, ts = {}, sorted(periods), sorted(at)
    part, parts = [xs[0]], []
    for a, b in zip(xs, xs[1:], strict=False):
        if b - a > longest + 1:
            parts.append(part)
            part = []
        part.append(b)
    parts.append(part)
    for k, part in enumerate(parts):
        knots = [t for t in ts if part[0] <= t < part[-1] + 1]
        for p in range(part[0], part[-1] + 1):
            if p in periods:
                out[p] = (float(np.mean(periods[p])), "observed")
            else:
                out[p] = (pchip(np.array(knots), np.array([at[t] for t in knots]), p + 0.5), "filled")
        if k + 1 < len(parts):
            out |= {p: (None, "gap") for p in range(part[-1] + 1, parts[k + 1][0])}
    return out


@pytest.mark.parametrize("shard", [3, 7, 512])
def test_regular_series_equals_whole_series_interpolation_in_any_shards(spark, shard):
    rng = random.Random(7)
    sources = {s: [] for s in ("a", "b", "c")}
    rows = []
    for s, readings in sources.items():
        p = 0
        for _ in range(1 if s == "c" else 40):
            p += rng.choice([1, 1, 2, 3, 5, 9])
            for _ in range(rng.choice([1, 1, 2, 3])):
                t = p * 100 + rng.choice([0, 50, 99, rng.randrange(100)])
                v = round(rng.uniform(-5, 5), 3)
                readings.append((t / 100, v))
                rows += [(s, t, v, f"{s}{len(rows)}")] * rng.choice([1, 1, 2])  # some arrive twice
    rows += [("a", 100, None, "n1"), ("a", None, 1.0, "n2"), (None, 100, 1.0, "n3"), ("b", 5, float("nan"), "n4"), ("b", 5, None, "n4")]
    rows += [("d", 100, 2.0, None), ("d", 100, 4.0, None), ("d", 101, 6.0, None)]  # without a key each counts
    sources["d"] = [(1.0, 2.0), (1.0, 4.0), (1.01, 6.0)]
    df = spark.createDataFrame(rows, "s string, t bigint, v double, id string").withColumn("value", F.lit("clash"))
    out = regular.regular_series(df, "s", "t", ["v"], 100, 4, shard, "id").collect()
    got = {(r["s"], r["period_start_ms"] // 100): (r["value"], r["status"]) for r in out}
    want = {(s, p): v for s, readings in sources.items() for p, v in plain_series(readings, 4).items()}
    assert len(out) == len(got) and set(got) == set(want)
    for k, (value, status) in want.items():
        assert got[k][1] == status
        assert got[k][0] == (pytest.approx(value, abs=1e-9) if value is not None else None)
    assert regular.regular_series(df.limit(0), "s", "t", ["v"], 100).count() == 0


# --- implausible readings ----------------------------------------------------------------------------------------

RULES = [plausibility.Rule("x", "neighbours", 3.0, 1 / 3, stuck=8), plausibility.Rule("m", "median", 30.0, upper="1000.0")]


def readings():
    rng = random.Random(5)
    rows, bad = [], set()
    for s, n in (("busy", 3000), ("calm", 40), ("few", 29)):
        level = 1.0
        for i in range(n):
            level *= math.exp(rng.gauss(0, 0.01))
            x, m = level, rng.choice([0.5, 1.0, 2.0])
            key = f"{s}{i:05d}"
            if i % 97 == 50:
                x *= rng.choice([3.5, 8, 1 / 4])
                bad.add((key, "x"))
            if i % 131 == 60:
                m = rng.choice([100.0, -1.0, 0.0, 2000.0])
                bad.add((key, "m"))
            if 200 <= i < 209 or 2000 <= i < 2300:
                x = 7.0 if i < 300 else 9.0
                bad.add((key, "x"))
            if 1000 <= i < 1500:  # a stuck run hidden by hundreds of missing readings
                x = level if i in (1000, 1499) else None if i % 50 else 5.0
                bad.discard((key, "x"))
                if x == 5.0:
                    bad.add((key, "x"))
            if i % 53 == 5:
                x = rng.choice([None, float("nan")])
                bad.discard((key, "x"))
            rows.append((s, i * 10, key, x, m))
            if i % 17 == 0:
                rows.append(rows[-1])
    return rows, {b for b in bad if not b[0].startswith("few")}


@pytest.mark.parametrize("per_shard", [100_000, 700, 90])
def test_implausible_readings_are_found_in_any_shards(spark, per_shard):
    rows, bad = readings()
    random.Random(2).shuffle(rows)
    rows += [(None, 1, "n1", -1.0, 1.0), ("calm", None, "n2", -1.0, 1.0), ("calm", 1, None, -1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, t bigint, id string, x double, m double").withColumn("kind", F.lit("clash"))
    out = plausibility.implausible_readings(df, "s", "t", "id", RULES, 30, None, per_shard).collect()
    got = {(r["id"], r["field_name"]) for r in out}
    assert len(out) == len(got)
    # the ends of the stuck stretches lie beside a level they are off by a factor: they may count as far off as well
    assert got == bad


def series(x, name="x"):
    rule = plausibility.Rule("x", "neighbours", 3.0, 1 / 3)
    x = np.asarray(x, float)
    return plausibility.Readings(rule, np.zeros(len(x), int), x, np.full(len(x), np.nan), np.full(len(x), np.nan))


def found(x):
    r = series(x)
    return set(np.flatnonzero(r.implausible(r.fit(1))))


def test_the_autoregression_decides_what_is_normal_for_a_source(monkeypatch):
    rng = np.random.default_rng(4)
    at = set(range(50, 4000, 171))
    # a level that wanders over a factor of hundreds by steps of 2 %
    level = np.exp(1.5 * np.sin(np.arange(4000) / 60) + rng.normal(0, 0.02, 4000))
    spiky = level * np.where([i in at for i in range(4000)], 3.5, 1.0)
    assert found(spiky) == at
    # readings that differ by such factors all the time are normal for their source
    wild = np.exp(rng.normal(0, 1.0, 4000))
    assert len(found(wild)) < 60 and (np.abs(np.diff(np.log(wild))) > math.log(3)).sum() > 1000
    # a level that shifts for good, and one that shifts back
    assert found(np.concatenate([level[:100], level[100:200] * 6])) == set()
    monkeypatch.setattr(plausibility, "MOST", 0.0)
    assert len(found(spiky) & at) < len(at) / 2
    monkeypatch.setattr(plausibility, "CRITICAL", 1e9)
    assert found(spiky) == set()


def test_the_fit_recovers_an_autoregression_with_outliers():
    rng = np.random.default_rng(9)
    d, e = np.zeros(20_000), rng.normal(0, 0.1, 20_000)
    for i in range(1, len(d)):
        d[i] = 0.8 * d[i - 1] + e[i]
    d[rng.choice(len(d), 1000, replace=False)] += 5
    fit = series(np.exp(2 + d)).fit(1)
    assert abs(fit.phi[0] - 0.8) < 0.06 and abs(fit.scale[0] - 0.1) < 0.02 and abs(fit.centre[0] - 2) < 0.05


def test_implausible_readings_of_nothing(spark):
    df = spark.createDataFrame([], "s string, t bigint, id string, x double, m double")
    assert plausibility.implausible_readings(df, "s", "t", "id", RULES).count() == 0


def test_time_reference_resists_a_burst(spark):
    hour = 3_600_000
    rows = [(h * hour + i, 100.0 + h) for h in range(20) for i in range(3)] + [(10 * hour + i, 900.0) for i in range(50)] + [(10 * hour, None), (None, 5.0), (3, -4.0)]
    df = spark.createDataFrame(rows, "t bigint, v double")
    got = {r["_step"]: r["_reference"] for r in plausibility.time_reference(df, "t", "v").collect()}
    assert len(got) == 20 and all(abs(v - 100 - h) <= 3 for h, v in got.items())
