"""Exact quantiles by selection against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import quantiles
from relata.operators.quantiles import exact_quantiles


def linear(values, q):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    at = (len(values) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high or values[low] == values[high] else values[low] + (at - low) * (values[high] - values[low])


def groups():
    rng = random.Random(6)
    yield "even", [rng.random() for _ in range(4000)]
    yield "ties", [float(rng.randrange(3)) for _ in range(2500)]
    yield "one", [2.5] * 1500
    yield "wide", [rng.choice((-1, 1)) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(1200)]
    yield "close", [1.0 + k * 2.0**-52 for k in range(900)]
    yield "ends", [math.inf] * 300 + [-math.inf] * 290 + [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]
    yield "few", [3.0, 1.0, 2.0]
    yield "single", [7.0]
    yield None, [float(k) for k in range(600)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, v, 1) for k, own in groups() for v in own] + [("even", None, 1), ("void", None, 1)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "k string, v double, w int").repartition(8).cache()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.999, 1.0])
@pytest.mark.parametrize("few, parts, broadcast", [(100_000, 1024, 10_000), (20, 8, 10_000), (1, 1024, 10_000), (50, 64, 2)])
def test_groups(spark, rows, monkeypatch, q, few, parts, broadcast):
    for name, v in (("FEW", few), ("PARTS", parts), ("BROADCAST_GROUPS", broadcast)):
        monkeypatch.setattr(quantiles, name, v)
    found = {r["k"]: (r["x"], r["n"]) for r in exact_quantiles(rows, ["k"], "v", q, "x", [F.count("*").alias("n")]).collect()}
    expected = {k: own for k, own in groups()}
    assert set(found) == {*expected, "void"} and found["void"] == (None, 1)
    for k, own in expected.items():
        want = linear(own, q)
        assert found[k][0] == want or math.isclose(found[k][0], want, rel_tol=1e-12), (k, found[k], want)


@pytest.mark.parametrize("few", [100_000, 30])
def test_whole_table(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    values = np.random.default_rng(2).lognormal(0, 3, 5001).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles.exact_median(df, "v").collect()[0]["median"] == sorted(values)[2500]
    assert quantiles.exact_median(df.limit(0), "v").collect()[0]["median"] is None
    assert math.isclose(exact_quantiles(df, [], "v", 0.9, "x").collect()[0]["x"], linear(values, 0.9), rel_tol=1e-12)


def test_no_task_holds_a_share_of_the_values(spark, monkeypatch):
    """The plan of a large selection orders buckets, never values."""
    monkeypatch.setattr(quantiles, "FEW", 30)
    df = spark.range(20_000).selectExpr("cast(id as double) as v")
    plans = []
    real = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda d, label, **k: (plans.append((label, d._jdf.queryExecution().executedPlan().toString())), real(d, label, **k))[1])
    assert quantiles.exact_median(df, "v").collect()[0]["median"] == 9999.5
    assert all("percentile" not in p for _, p in plans) and {label for label, _ in plans} >= {"selection", "quantiles"}
