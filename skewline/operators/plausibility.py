"""Implausible spikes in measurements (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.operators.skew import key_percentiles
from skewline.session import written

#: Readings on either side that show what a source does around a reading.
NEIGHBOURS = 4
#: Robust standard deviations from which a residual, or a shift in level, is out of a source's normal behaviour.
CRITICAL = 2.5
#: Rounds of tests: test, put what is expected in the place of outliers, test again.
ROUNDS = 4
#: Largest coefficient of the autoregression, least residual scale, and steps in which distributions are counted (logarithms).
MOST, LEAST_SCALE, STEP = 0.98, 1e-3, 1e-3
#: Readings of a field that shards of a hot source exchange.
HALO = 32
#: Milliseconds of a cell, by which hot sources are cut into shards.
CELL = 6 * 3_600_000
#: Deviations of a normal distribution between its quartiles.
_QUARTILES = 1.349


@dataclass(frozen=True)
class Rule:
    """What is implausible of one field.

    against: ``neighbours`` (the source's readings before and after), ``median`` (the source's median), or the name
    of a column. up, down: a reading at least ``up`` times or at most ``down`` times of that is far off (0: no bound).
    stuck: shortest run of the very same value (0: none). upper: readings above it are impossible; a SQL expression.
    """

    name: str
    against: str
    up: float
    down: float = 0.0
    stuck: int = 0
    upper: str | None = None


@dataclass(frozen=True)
class Fit:
    """First-order autoregressions, one per group: centre, coefficient, scale of the residuals and of the deviations."""

    centre: np.ndarray
    phi: np.ndarray
    scale: np.ndarray
    spread: np.ndarray


def time_reference(df: DataFrame, millis: str, value: str, step_ms: int = 3_600_000, least: int = 9) -> DataFrame:
    """(``_step``, ``_reference``): what all sources show around each hour with rows.

    Hourly medians (approximate in rank by 1/1000, combined on the map side) are put in order; the median of the
    hours around stands, from the narrowest of 2, 6 and 24 hours either way that hold ``least`` readings (else 24).
    Every hour weighs the same there, so a burst of one source's bad readings doesn't. One row per hour with
    readings: at most 8,784 a year, whatever the input; the window runs over those.
    """
    v = F.col(f"`{value}`").cast("double")
    hours = (
        df.select(F.floor(F.col(f"`{millis}`") / step_ms).alias("_step"), F.when(v > 0, F.when(~F.isnan(v), v)).alias("_v"))
        .where("_v is not null and _step is not null")
        .groupBy("_step")
        .agg(F.percentile_approx("_v", 0.5, 1000).alias("_m"), F.count("_v").alias("_n"))
    )
    order = Window.orderBy("_step")
    spans = (2, 6, 24)
    wide = hours.select(
        "_step",
        *[F.percentile("_m", F.lit(0.5)).over(order.rangeBetween(-s, s)).alias(f"_m{s}") for s in spans],
        *[F.sum("_n").over(order.rangeBetween(-s, s)).alias(f"_n{s}") for s in spans],
    )
    chosen = F.coalesce(*[F.when(F.col(f"_n{s}") >= least, F.col(f"_m{s}")) for s in spans], F.col(f"_m{spans[-1]}"))
    return wide.select("_step", chosen.alias("_reference"))


# --- one task: whole (source, shard) groups, all at once ---------------------------------------------------------


def _group_median(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Median of x by group (0..n-1); NaN for a group without readings."""
    out = np.full(n, np.nan)
    if len(x):
        order = np.lexsort((x, group))
        g, s = group[order], x[order]
        size = np.bincount(g, minlength=n)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        there = size > 0
        out[there] = (s[(start + (size - 1) // 2)[there]] + s[(start + size // 2)[there]]) / 2
    return out


def _sides(group: np.ndarray, x: np.ndarray, clean: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, 2 NEIGHBOURS): the up to NEIGHBOURS clean readings before and after each position of ``at``, else NaN."""
    place = np.flatnonzero(clean)
    before = np.searchsorted(place, at, "left")
    after = np.searchsorted(place, at, "right")
    steps = np.arange(1, NEIGHBOURS + 1)
    i = np.concatenate([before[:, None] - steps, after[:, None] + steps - 1], axis=1)
    inside = (i >= 0) & (i < len(place))
    j = place[np.where(inside, i, 0)] if len(place) else np.zeros_like(i)
    inside &= group[j] == group[at][:, None]
    return np.where(inside, x[j], np.nan)


def _middle(near: np.ndarray) -> np.ndarray:
    """Median of each row, NaN left out; NaN of a row without any."""
    near = np.sort(near, axis=1)
    m = np.isfinite(near).sum(axis=1)
    row = np.arange(len(near))
    return np.where(m > 0, (near[row, np.maximum((m - 1) // 2, 0)] + near[row, np.minimum(m // 2, near.shape[1] - 1)]) / 2, np.nan)


def _steps(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, sum, difference) of successive readings of a group, in whole steps of STEP."""
    same = group[1:] == group[:-1]
    a, b = x[1:][same], x[:-1][same]
    return group[1:][same], np.rint((a + b) / STEP).astype(np.int64), np.rint((a - b) / STEP).astype(np.int64)


def _ranked(group: np.ndarray, code: np.ndarray, n: int, shares: tuple[float, ...]) -> np.ndarray:
    """(shares, n): the code of each group at the rank ceil(share * count), NaN for a group without any."""
    out = np.full((len(shares), n), np.nan)
    size = np.bincount(group, minlength=n)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    ordered, there = code[np.lexsort((code, group))], size > 0
    for k, share in enumerate(shares):
        out[k, there] = ordered[(start + np.maximum(np.ceil(share * size), 1).astype(int) - 1)[there]]
    return out


def fit_of(plus: np.ndarray, minus: np.ndarray) -> Fit:
    """The autoregression from the quartiles of sums and differences of successive readings (each (3, n), in steps).

    Robust autocovariance: a series' sums and differences of successive readings have the variances 2 v (1 + r) and
    2 v (1 - r), where v is its variance and r its first autocorrelation. Scales are taken from the distance between
    quartiles, so a quarter of the readings may be outliers. Groups without two readings have a zero coefficient.
    """
    plus, minus = np.nan_to_num(plus * STEP), np.nan_to_num(minus * STEP)
    p, m = ((q[2] - q[0]) / _QUARTILES for q in (plus, minus))
    total = p * p + m * m
    phi = np.clip((p * p - m * m) / np.where(total > 0, total, 1), 0, MOST)
    scale = np.sqrt((p * (1 - phi)) ** 2 + (m * (1 + phi)) ** 2) / 2
    return Fit(plus[1] / 2, phi, np.maximum(scale, LEAST_SCALE), np.maximum(np.sqrt(total) / 2, LEAST_SCALE))


def outliers(group: np.ndarray, x: np.ndarray, fit: Fit, wanders: bool) -> np.ndarray:
    """Readings that the autoregression of their group takes for additive outliers or shifted in level.

    x: logarithms of the readings, ordered in time within a group. Each round tests every reading against the series as
    cleaned so far: as an additive outlier by its own residual and the next one, against CRITICAL residual deviations;
    then for a shift in level. Where the level wanders, a reading at whose level the following ones stay starts a
    shift and isn't an outlier; else one CRITICAL deviations off the centre is shifted and counts. What is found is
    set to what its neighbours lead one to expect, and the next round tests again.
    """
    flagged = np.zeros(len(x), bool)
    if not len(x):
        return flagged
    centre, phi, scale, spread = (a[group] for a in (fit.centre, fit.phi, fit.scale, fit.spread))
    first = np.concatenate(([True], group[1:] != group[:-1]))
    last = np.roll(first, -1)
    own, y = x - centre, x.copy()
    gain = np.where(first | last, 1.0, 1 + phi * phi)
    for _ in range(ROUNDS):
        d = y - centre
        before, after = np.roll(d, 1), np.roll(d, -1)
        residual = np.where(first, np.where(last, own, own - phi * after), own - phi * before)
        following = np.where(first | last, 0.0, after - phi * own)
        found = np.abs(residual - phi * following) >= CRITICAL * scale * np.sqrt(gain)
        if wanders:
            at = np.flatnonzero(found)
            sides = _sides(group, y, ~flagged, at)
            old, new = _middle(sides[:, :NEIGHBOURS]), _middle(sides[:, NEIGHBOURS:])
            shifted = (np.abs(new - old) >= CRITICAL * scale[at]) & (np.abs(x[at] - new) <= np.abs(new - old) / 2)
            found[at[shifted]] = False
        else:
            found |= np.abs(own) >= CRITICAL * spread
        if (found == flagged).all():
            break
        flagged, y = found, x.copy()
        at = np.flatnonzero(flagged)
        expected = _middle(_sides(group, x, ~flagged, at))
        y[at] = np.where(np.isnan(expected), centre[at], expected)
    return flagged


def _stuck(group: np.ndarray, v: np.ndarray, least: int) -> np.ndarray:
    """Readings in a run of at least ``least`` successive ones of the very same value."""
    if not len(v):
        return np.zeros(0, bool)
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (group[1:] != group[:-1])))
    run = np.cumsum(new) - 1
    return (np.bincount(run) >= least)[run]


@dataclass(frozen=True)
class Readings:
    """Readings of one rule in order of time within their groups (NaN: none), what they are held against, their limit."""

    rule: Rule
    group: np.ndarray
    v: np.ndarray
    base: np.ndarray
    upper: np.ndarray

    def tested(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stuck, places, x): the readings in stuck runs; those that are tested for spikes, and their logarithms.

        Stuck runs stand apart: they neither are tested nor show what is normal.
        """
        v, there = self.v, np.isfinite(self.v)
        stuck = np.zeros(len(v), bool)
        if self.rule.stuck:
            place = np.flatnonzero(there)
            stuck[place] = _stuck(self.group[place], v[place], self.rule.stuck)
        known = there & (v > 0) & ~stuck
        if self.rule.against not in ("neighbours", "median"):
            known &= np.isfinite(self.base) & (self.base > 0)
            place = np.flatnonzero(known)
            return stuck, place, np.log(v[place] / self.base[place])
        place = np.flatnonzero(known)
        return stuck, place, np.log(v[place])

    def fit(self, n: int) -> Fit:
        _, place, x = self.tested()
        group, plus, minus = _steps(self.group[place], x)
        return fit_of(*(_ranked(group, code, n, (0.25, 0.5, 0.75)) for code in (plus, minus)))

    def implausible(self, fit: Fit, medians: np.ndarray | None = None) -> np.ndarray:
        """Mask over all readings; ``medians``: of each group, for a rule against the median."""
        r, v = self.rule, self.v
        stuck, place, x = self.tested()
        bad = (np.isfinite(v) & ((v <= 0) | (v > self.upper))) | stuck
        g = self.group[place]
        found = np.flatnonzero(outliers(g, x, fit, r.against == "neighbours"))
        if len(found):
            if r.against == "neighbours":
                clean = np.ones(len(x), bool)
                clean[found] = False
                base = np.exp(_middle(_sides(g, x, clean, found)))
            else:
                base = medians[g[found]] if r.against == "median" else self.base[place[found]]
            ratio = v[place[found]] / np.where(base > 0, base, np.nan)
            bad[place[found]] |= ((r.up > 0) & (ratio >= r.up)) | (ratio <= r.down)
        return bad


def _changes(a: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.not_equal(a[1:], a[:-1]), True).to_numpy(zero_copy_only=False)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups of the sorted batches, of ``least`` rows or one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = [np.flatnonzero(_changes(t[k].combine_chunks()))[-1:] for k in keys]
            cut = max((int(c[0]) + 1 for c in cut if len(c)), default=0)
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
            least = max(200_000, rows + 100_000)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t[name].cast(pa.float64()), float("nan")).combine_chunks().to_numpy(zero_copy_only=False)



_FOUND = pa.schema([("kind", pa.string()), ("source", pa.string()), ("shard", pa.int64()), ("field_name", pa.string()), ("id", pa.string()), ("n_keys", pa.int64())])
_LISTS = {"ids": pa.string(), "v": pa.float64(), "base": pa.float64(), "upper": pa.float64()}
_COUNTS = {"plus": pa.int64(), "plus_n": pa.int64(), "minus": pa.int64(), "minus_n": pa.int64()}
_PARTS = pa.schema([*_FOUND, *[(n, pa.list_(t)) for n, t in (_LISTS | _COUNTS).items()]])
_SPARK_PARTS = "kind string, source string, shard bigint, field_name string, id string, n_keys bigint, ids array<string>, v array<double>, base array<double>, upper array<double>, plus array<bigint>, plus_n array<bigint>, minus array<bigint>, minus_n array<bigint>"


def _batch(rows: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.get(f.name, pa.nulls(n, f.type)) for f in _PARTS], schema=_PARTS)


def _judge_shards(rules: tuple[Rule, ...], least: int):
    """Task: rows sorted by source, shard, time and id. Gives verdicts on whole sources; of a shard of a hot source the readings
    per rule, and how often each sum and difference of successive ones occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["_source", "_shard"]):
            new = np.ones(t.num_rows, bool)
            again = np.zeros(t.num_rows, bool)
            if t.num_rows > 1:
                new[1:] = _changes(t["_source"].combine_chunks()) | _changes(t["_shard"].combine_chunks())
                again[1:] = ~new[1:] & ~_changes(t["_id"].combine_chunks())
            # a key that arrives again stands beside itself
            starts = new[~again]
            t = t.filter(pa.array(~again))
            group = np.cumsum(starts) - 1
            n = int(group[-1]) + 1
            size = np.bincount(group, minlength=n)
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            hot = t["_hot"].combine_chunks().to_numpy(zero_copy_only=False)[begin]
            judged = ((size >= least) & ~hot)[group]
            source, ids = t["_source"].combine_chunks(), t["_id"].combine_chunks()
            for r in rules:
                nothing = np.full(len(group), np.nan)
                v = _numbers(t, r.name)
                readings = Readings(
                    r, group, v, _numbers(t, r.against) if r.against not in ("neighbours", "median") else nothing, _numbers(t, f"{r.name}__upper") if r.upper else nothing
                )
                there = np.isfinite(v)
                medians = _group_median(group[there], v[there], n) if r.against == "median" else None
                at = np.flatnonzero(readings.implausible(readings.fit(n), medians) & judged)
                if len(at):
                    yield _batch({"kind": pa.array(["verdict"] * len(at)), "source": source.take(pa.array(at)).cast(pa.string()), "field_name": pa.array([r.name] * len(at)), "id": ids.take(pa.array(at)).cast(pa.string())}, len(at))
                for k in np.flatnonzero(hot):
                    rows = slice(begin[k], begin[k] + size[k])
                    yield _part(Readings(r, np.zeros(size[k], int), v[rows], readings.base[rows], readings.upper[rows]), source[begin[k]], t["_shard"][begin[k]], ids[rows])

    return run


def _part(readings: Readings, source: pa.Scalar, shard: pa.Scalar, ids: pa.Array) -> pa.RecordBatch:
    there = np.flatnonzero(np.isfinite(readings.v))
    _, place, x = readings.tested()
    _, plus, minus = _steps(readings.group[place], x)
    lists = {"ids": ids.take(pa.array(there)).cast(pa.string()), "v": pa.array(readings.v[there])}
    # what a rule doesn't have isn't carried along
    lists |= {n: pa.array(a[there] if np.isfinite(a).any() else a[:0]) for n, a in (("base", readings.base), ("upper", readings.upper))}
    for name, code in (("plus", plus), ("minus", minus)):
        lists[name], lists[f"{name}_n"] = (pa.array(a) for a in np.unique(code, return_counts=True))
    one = {n: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for n, a in lists.items()}
    return _batch({"kind": pa.array(["part"]), "source": pa.array([source.as_py()]), "shard": pa.array([shard.as_py()]), "field_name": pa.array([readings.rule.name]), "n_keys": pa.array([len(ids)])} | one, 1)


def _judge_parts(rules: tuple[Rule, ...]):
    """Task: the parts of hot sources, each with the readings beside it, its source's quartiles and median; gives verdicts."""
    named = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b[c][i] for c in b.schema.names}
                before, after, own = row["before"].as_py() or [], row["after"].as_py() or [], len(row["ids"])
                lists, skipped = [], len(before)
                for name in ("v", "base", "upper"):
                    inner = row[name].values.to_numpy(zero_copy_only=False) if len(row[name]) else np.full(own, np.nan)
                    lists.append(np.concatenate([np.array([x[name] for x in before], float), inner, np.array([x[name] for x in after], float)]))
                readings = Readings(named[row["field_name"].as_py()], np.zeros(len(lists[0]), int), *lists)
                fit = fit_of(*(np.array([[np.nan if q is None else q] for q in row[c].as_py()], float) for c in ("plus_q", "minus_q")))
                median = row["median"].as_py()
                bad = readings.implausible(fit, np.array([np.nan if median is None else median], float))[skipped : skipped + own]
                ids = row["ids"].values.take(pa.array(np.flatnonzero(bad)))
                yield pa.RecordBatch.from_arrays([pa.array([row["source"].as_py()] * len(ids), pa.string()), pa.array([row["field_name"].as_py()] * len(ids), pa.string()), ids], names=["source", "field_name", "id"])

    return run


# --- hot sources ------------------------------------------------------------------------------------------------


def hot_cells(rows: DataFrame, per_shard: int) -> DataFrame:
    """(_source, _cell, _first, _pieces) of the sources with more than ``per_shard`` rows: which shards a cell of time falls into.

    Cells are put together until ``per_shard`` rows are reached, so shards hold about as many rows each however the source's rows
    are spread over time; a cell with more is cut into pieces of time. A source has at most one row per cell here.
    """
    cells = rows.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_source")
    upto = F.sum("_n").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"_all": F.sum("_n").over(by), "_upto": upto}).where(F.col("_all") > per_shard)
    return cells.select("_source", "_cell", F.floor((F.col("_upto") - F.col("_n")) / per_shard).alias("_first"), F.ceil(F.col("_n") / per_shard).alias("_pieces"))


def _quartiles(parts: DataFrame, name: str) -> DataFrame:
    """(source, field_name, {name}_q): the three quartiles of what the parts counted; a source has as many rows here as steps occur."""
    each = parts.select("source", "field_name", F.inline(F.arrays_zip(F.col(name).alias("code"), F.col(f"{name}_n").alias("n"))))
    counts = each.groupBy("source", "field_name", "code").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("source", "field_name")
    ranked = counts.withColumns({"upto": F.sum("n").over(by.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(by)})
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1)), F.col("code"))) for q in (0.25, 0.5, 0.75)]
    return ranked.groupBy("source", "field_name").agg(F.array(*at).alias(f"{name}_q"))


def _beside(parts: DataFrame) -> DataFrame:
    """(source, field_name, shard, before, after): the HALO readings before and after each part, from the parts beside it.

    No part is without a reading, so as many parts as readings suffice on either side.
    """
    readings = F.arrays_zip("v", "base", "upper")
    last = F.slice(readings, F.greatest(F.size("v") - HALO + 1, F.lit(1)), HALO)
    edges = parts.select("source", "field_name", "shard", F.slice(readings, 1, HALO).alias("_first"), last.alias("_last"))
    order = Window.partitionBy("source", "field_name").orderBy("shard")
    before = F.flatten(F.collect_list("_last").over(order.rowsBetween(-HALO, -1)))
    after = F.flatten(F.collect_list("_first").over(order.rowsBetween(1, HALO)))
    both = edges.select("source", "field_name", "shard", before.alias("before"), F.slice(after, 1, HALO).alias("after"))
    return both.withColumn("before", F.slice("before", F.greatest(F.size("before") - HALO + 1, F.lit(1)), HALO))


def _hot_verdicts(judged: DataFrame, rules: list[Rule], least: int) -> DataFrame:
    """(source, field_name, id): the implausible readings of hot sources, from their parts."""
    parts = judged.where("kind = 'part'")
    keys = ["source", "field_name"]
    enough = parts.groupBy(*keys).agg(F.sum("n_keys").alias("_keys")).where(F.col("_keys") >= least).drop("_keys")
    own = enough.join(_quartiles(parts, "plus"), keys, "left").join(_quartiles(parts, "minus"), keys, "left")
    medians = [r.name for r in rules if r.against == "median"]
    values = parts.where(F.col("field_name").isin(medians)).select(*keys, F.explode("v").alias("_value"))
    own = own.join(_exact_median(values.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_rows")), keys), keys, "left")
    nothing = F.array(*[F.lit(None).cast("bigint")] * 3)
    own = own.withColumns({c: F.coalesce(c, nothing) for c in ("plus_q", "minus_q")})
    some = parts.where(F.size("v") > 0)
    light = _beside(some).join(own, keys)
    heavy = some.select(*keys, "shard", *_LISTS)
    return heavy.join(light, [*keys, "shard"]).mapInArrow(_judge_parts(tuple(rules)), "source string, field_name string, id string")


def implausible_readings(
    df: DataFrame,
    source: str,
    millis: str,
    key: str,
    rules: list[Rule],
    least: int = 30,
    reference: tuple[str, DataFrame] | None = None,
    rows_per_shard: int = 100_000,
) -> DataFrame:
    """(``key``, ``field_name``, ``source``): each implausible reading once.

    A reading is implausible if it is zero or below or above its physical limit, if the robust autoregression of its
    source takes it for an outlier (see ``outliers``) and it is as far off as its rule says, or if it belongs to a stuck
    run. ``key`` counts once: rows that arrive again have the same content and stand side by side once sorted. Sources with
    fewer than ``least`` keys aren't judged. Successive means ordered by ``millis``, then ``key``.

    reference: (name, table of ``_step``, ``_reference``) of ``time_reference``; a rule may be ``against`` that name.

    Method and scale: rows are shuffled once, by source, and sorted; each task fits and judges whole sources with array
    code. Sources of more than ``rows_per_shard`` rows are cut into time shards of about that many (``hot_cells``; that table is
    written first, so the optimizer knows its size and broadcasts it only below its threshold). A shard hands on its readings per rule
    as one row, how often sums and differences of successive readings occur, and its end readings: from those come
    one fit and one exact median per source and the readings beside each shard, with which its own are judged. The pairs of readings
    that shards divide are missing from the fit, nothing else depends on the shards. Broadcast is the reference (one row per hour).

    Nulls: rows without source, time or key are left out; null and NaN readings aren't judged and don't interrupt a
    run. Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    named = {r.name: F.col(f"`{r.name}`").cast("double") for r in rules}
    for r in rules:
        if r.upper:
            named[f"{r.name}__upper"] = F.expr(r.upper).cast("double")
        if r.against not in ("neighbours", "median") and not (reference and r.against == reference[0]):
            named[r.against] = F.col(f"`{r.against}`").cast("double")
    rows = df.select(
        F.col(f"`{source}`").cast("string").alias("_source"),
        F.col(f"`{millis}`").cast("bigint").alias("_millis"),
        F.col(f"`{key}`").cast("string").alias("_id"),
        *[c.alias(n) for n, c in named.items()],
    ).where("_source is not null and _millis is not null and _id is not null")
    rows = rows.withColumn("_cell", F.floor(F.col("_millis") / CELL))
    hot = written(hot_cells(rows, rows_per_shard), "hot-cells")
    within = (F.col("_millis") - F.col("_cell") * CELL) / CELL
    rows = rows.join(hot, ["_source", "_cell"], "left").withColumns(
        {"_shard": F.coalesce(F.col("_first") + F.floor(within * F.col("_pieces")), F.lit(0)).cast("bigint"), "_hot": F.col("_first").isNotNull()}
    ).drop("_first", "_pieces", "_cell")
    if reference:
        name, steps = reference
        rows = rows.withColumn("_step", F.floor(F.col("_millis") / 3_600_000)).join(F.broadcast(steps), "_step", "left").withColumnRenamed("_reference", name).drop("_step")
    judged = written(
        rows.repartition("_source", "_shard").sortWithinPartitions("_source", "_shard", "_millis", "_id").mapInArrow(_judge_shards(tuple(rules), least), _SPARK_PARTS),
        "implausible",
    )
    verdicts = judged.where("kind = 'verdict'").select("source", "field_name", "id").unionByName(_hot_verdicts(judged, rules, least))
    return verdicts.select(F.col("id").alias(key), "field_name", F.col("source").alias(source)).dropDuplicates([key, "field_name"])


def _exact_median(frequencies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median): the mean of the two middle values, from value frequencies."""
    low = key_percentiles(frequencies, keys, (0.5,)).select(*keys, F.col("percentile").alias("_low"))
    negated = frequencies.withColumn("_value", -F.col("_value"))
    high = key_percentiles(negated, keys, (0.5,)).select(*keys, (-F.col("percentile")).alias("_high"))
    return low.join(high, keys).select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))
