"""Centroid digests against exact ranks on small, awkward inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.llm import digests


def test_digests_are_within_their_bound_and_merge(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_cauchy(20_000), np.full(5_000, 1.5), -rng.random(10)])
    rows = [("hot", i % 9, float(v)) for i, v in enumerate(values)] + [("one", 0, 4.0), ("hot", 0, None), ("hot", 0, float("nan")), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double").repartition(13)
    p = (0.01, 0.5, 0.9, 0.999)
    parts = digests.digests(df, {"k": F.col("k"), "d": F.col("d")}, F.col("v"))
    merged = digests.merged(parts.withColumn("_salt", F.col("d").cast("bigint")), ["k"])
    for digest in (merged, digests.digests(df, {"k": F.col("k")}, F.col("v"))):
        estimates = digests.digest_percentiles(digest, ["k"], p)
        checked = digests.certified(df, {"k": F.col("k")}, F.col("v"), estimates, p).collect()
        assert len(checked) == 3 * len(p) and all(r["certified"] for r in checked)
        for r in checked:
            if r["k"] == "hot":
                assert r["n"] == len(values)
                below, upto = (values < r["estimate"]).mean(), (values <= r["estimate"]).mean()
                assert r["rank_error"] == pytest.approx(max(below - r["p"], r["p"] - upto, 0), abs=1e-12) and r["rank_error"] <= max(0.04 * r["p"] * (1 - r["p"]), 1 / r["n"])
    assert digests.digests(df.limit(0), {"k": F.col("k")}, F.col("v")).count() == 0


def test_digests_of_many_tasks_are_merged_to_one(spark, monkeypatch):
    monkeypatch.setattr(digests, "FAN_IN", 3)
    values = np.random.default_rng(1).lognormal(0, 2, 6_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(40)
    (digest,) = digests.digests(df, {"k": F.lit("a")}, F.col("v")).collect()
    assert digest["_n"] == len(values) and digest["_min"] == values.min() and digest["_max"] == values.max()
    assert sum(digest["_weights"]) == pytest.approx(len(values)) and len(digest["_means"]) < 1_100


def test_a_task_with_many_keys_keeps_all_values(spark, monkeypatch):
    monkeypatch.setattr(digests, "HELD", 50)
    df = spark.createDataFrame([(i % 90, float(i)) for i in range(2_000)], "k int, v double").coalesce(1)
    got = {r["k"]: r["_n"] for r in digests.digests(df, {"k": F.col("k")}, F.col("v")).collect()}
    assert got == {k: sum(i % 90 == k for i in range(2_000)) for k in range(90)}
