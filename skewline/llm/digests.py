"""Percentiles of very large numeric columns by merging centroid digests (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters of a digest, about; a cluster spans at most pi / CLUSTERS of the ranks at the median, less at the ends.
CLUSTERS = 1000
#: Digests merged by one task and step, and steps: enough for FAN_IN ** STEPS (16.7 million) tasks, files or days.
FAN_IN, STEPS = 64, 4
#: Rows a task holds before it clusters them.
HELD = 500_000


def cluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, ...]:
    """(group, mean, weight, least, greatest) of the clusters of weighted values, group by group.

    Values are sorted within each group. The size function k(q) = clusters / (2 pi) * arcsin(2 q - 1) of a value's middle
    quantile q gives the cluster it falls into: clusters are wide at the median and narrow at both ends.
    """
    order = np.lexsort((value, group))
    g, v, w = group[order], value[order], weight[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    part = np.cumsum(new) - 1
    total = np.bincount(part, w) if len(g) else np.zeros(0)
    cum = np.cumsum(w)
    begin = np.concatenate(([0.0], np.cumsum(total)[:-1])) if len(total) else np.zeros(0)
    q = np.clip((cum - w / 2 - begin[part]) / total[part], 0, 1) if len(g) else cum
    k = np.floor(clusters / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2))
    at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | new[1:]))) if len(g) else np.zeros(0, int)
    if not len(at):
        return g, v, w, v, v
    sums = np.add.reduceat(w, at)
    return g[at], np.add.reduceat(v * w, at) / sums, sums, np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)


def _coded(columns: list[pd.Series]) -> tuple[np.ndarray, pd.DataFrame]:
    frame = pd.concat(columns, axis=1)
    code = frame.groupby(list(frame.columns), dropna=False, sort=False).ngroup().to_numpy()
    return code, frame.loc[~pd.Series(code).duplicated().to_numpy()].reset_index(drop=True)


def _packed(keys: pd.DataFrame, g, mean, weight, least, greatest, salt: int) -> pd.DataFrame:
    cut = np.flatnonzero(np.diff(g)) + 1
    out = keys.iloc[g[np.concatenate(([0], cut))]].reset_index(drop=True) if len(g) else keys.iloc[:0].copy()
    out["_salt"] = np.int64(salt)
    out["_means"] = np.split(mean, cut) if len(g) else []
    out["_weights"] = np.split(weight, cut) if len(g) else []
    starts = np.concatenate(([0], cut)).astype(int) if len(g) else np.zeros(0, int)
    out["_n"] = np.add.reduceat(weight, starts) if len(g) else []
    out["_min"] = np.minimum.reduceat(least, starts) if len(g) else []
    out["_max"] = np.maximum.reduceat(greatest, starts) if len(g) else []
    return out


_DIGEST = "_salt bigint, _means array<double>, _weights array<double>, _n double, _min double, _max double"


def digests(df: DataFrame, keys: dict[str, Column], value: Column, clusters: int = CLUSTERS) -> DataFrame:
    """One digest per key: keys, ``_means``, ``_weights`` (of its clusters, in order), ``_n``, ``_min``, ``_max``.

    Each task clusters the rows it reads, batch by batch, and hands on one digest per key; nothing is shuffled but
    digests, and those are merged in steps (``merged``). Digests of separate runs, days or files may be put into one
    table and merged later in the same way.

    Null and NaN values are left out; null keys stay, as keys of their own. Empty input gives no digests.
    """
    value = value.cast("double")
    rows = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    names = list(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows_held, most = 0, HELD

        for f in frames:
            held.append(f.assign(_w=1.0, _a=f["_value"], _b=f["_value"]))
            rows_held += len(f)
            if rows_held > most:
                held = [_press(held, names, clusters)]
                rows_held = len(held[0])
                # many keys leave many clusters: wait until as many rows again have come
                most = max(HELD, 2 * rows_held)
        if rows_held:
            f = _press(held, names, clusters)
            code, unique = _coded([f[k] for k in names])
            order = np.argsort(code, kind="stable")
            yield _packed(unique, code[order], *(f[c].to_numpy()[order] for c in ("_value", "_w", "_a", "_b")), salt=TaskContext.get().partitionId())

    return merged(rows.mapInPandas(run, f"{fields}, {_DIGEST}"), names, clusters)


def _press(parts: list[pd.DataFrame], names: list[str], clusters: int) -> pd.DataFrame:
    f = pd.concat(parts, ignore_index=True)
    code, unique = _coded([f[k] for k in names])
    order = np.lexsort((f["_value"].to_numpy(), code))
    g, mean, weight, least, greatest = cluster(code[order], f["_value"].to_numpy()[order], f["_w"].to_numpy()[order], clusters)
    out = unique.iloc[g].reset_index(drop=True).assign(_value=mean, _w=weight)
    # clusters keep the extremes of what went into them
    out["_a"], out["_b"] = least, greatest
    low, high = f.groupby(code)["_a"].min().to_numpy(), f.groupby(code)["_b"].max().to_numpy()
    first, last = np.concatenate(([True], g[1:] != g[:-1])), np.concatenate((g[1:] != g[:-1], [True]))
    out.loc[first, "_a"], out.loc[last, "_b"] = low[g[first]], high[g[last]]
    return out


def merged(parts: DataFrame, keys: list[str], clusters: int = CLUSTERS) -> DataFrame:
    """Digests of the same key merged by clustering their clusters again.

    A tree of ``STEPS`` steps: digests of one key are merged in groups of about ``FAN_IN`` by their salt (the task that made them), then
    the results, until one is left; so no task gets more than ``FAN_IN`` digests of a key, whatever the number of tasks.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in keys)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            code, unique = _coded([f[k] for k in keys])
            sizes = f["_means"].map(len).to_numpy()
            g = np.repeat(code, sizes)
            mean, weight = np.concatenate(f["_means"].to_list()), np.concatenate(f["_weights"].to_list())
            g2, m2, w2, _, _ = cluster(g, mean, weight, clusters)
            low, high = f.groupby(code)["_min"].min().to_numpy(), f.groupby(code)["_max"].max().to_numpy()
            out = _packed(unique, g2, m2, w2, low[g2], high[g2], 0)
            yield out.assign(_salt=f.groupby(code)["_salt"].first().reindex(range(len(unique))).to_numpy()[g2[np.concatenate(([0], np.flatnonzero(np.diff(g2)) + 1))]])

    schema = f"{fields}, {_DIGEST}"
    for step in range(STEPS):
        bundle = F.floor(F.col("_salt") / FAN_IN) if step < STEPS - 1 else F.lit(0).cast("bigint")
        grouped = parts.withColumn("_salt", bundle).groupBy(*keys, "_salt").agg(
            F.collect_list("_means").alias("_means"), F.collect_list("_weights").alias("_weights"), F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("_n").alias("_n")
        )
        flat = grouped.withColumns({"_means": F.flatten("_means"), "_weights": F.flatten("_weights")})
        parts = flat.select(*keys, *[c.split()[0] for c in _DIGEST.split(", ")]).mapInPandas(merge, schema)
    return parts.drop("_salt")


def digest_percentiles(digest: DataFrame, keys: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """(keys, ``n``, ``p``, ``estimate``): percentiles read off each digest, linear between cluster middles."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digest.schema.fields if f.name in keys)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for means, weights, n, low, high in zip(f["_means"], f["_weights"], f["_n"], f["_min"], f["_max"], strict=True):
                middle = (np.cumsum(weights) - weights / 2) / n
                out.append(np.interp(probabilities, np.concatenate(([0.0], middle, [1.0])), np.concatenate(([low], means, [high]))))
            rows = f.loc[f.index.repeat(len(probabilities)), keys].reset_index(drop=True)
            rows["n"] = np.repeat(f["_n"].to_numpy(), len(probabilities)).astype("int64")
            rows["p"] = np.tile(np.array(probabilities, float), len(f))
            rows["estimate"] = np.concatenate(out) if out else np.zeros(0)
            yield rows

    return digest.mapInPandas(read, f"{fields}, n bigint, p double, estimate double")


def certified(df: DataFrame, keys: dict[str, Column], value: Column, estimates: DataFrame, probabilities: tuple[float, ...], bound: float = 0.04) -> DataFrame:
    """``estimates`` with ``rank_error`` and ``certified``: a second pass counts the values below and up to each estimate.

    The rank error is the distance of p from the ranks the estimate takes up, as a share of n; it is certified within
    ``bound`` p (1 - p), as clusters narrow to both ends (1 % of the ranks at the median, 0.04 % at p = 0.99), or one rank. A key's estimates sit in one row, joined to its values on the key: a small side is broadcast by
    its measured size, else the optimizer splits skewed keys. Counts combine on the map side.
    """
    names = list(keys)
    value = value.cast("double")
    rows = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    points = estimates.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("p", "estimate")))["estimate"].alias("_points"), F.max("n").alias("_n"))
    right = points.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], "_points", "_n")
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ordered = sorted(probabilities)
    at = [F.col("_points")[i] for i in range(len(ordered))]
    counts = rows.join(right, same).groupBy(*names).agg(
        F.max("_n").alias("n"),
        F.any_value("_points").alias("_points"),
        *[F.count_if(F.col("_value") < e).alias(f"_below{i}") for i, e in enumerate(at)],
        *[F.count_if(F.col("_value") <= e).alias(f"_upto{i}") for i, e in enumerate(at)],
    )
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), at[i].alias("estimate"), F.col(f"_below{i}").alias("_below"), F.col(f"_upto{i}").alias("_upto")) for i, p in enumerate(ordered)])
    error = F.greatest(F.col("_below") / F.col("n") - F.col("p"), F.col("p") - F.col("_upto") / F.col("n"), F.lit(0.0))
    out = counts.select(*names, "n", F.inline(each)).withColumn("rank_error", error)
    return out.select(*names, "n", "p", "estimate", "rank_error", (F.col("rank_error") <= F.greatest(F.lit(bound) * F.col("p") * (1 - F.col("p")), 1 / F.col("n"))).alias("certified"))
