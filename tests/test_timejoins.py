"""As-of and interval joins against loops, stored sketches against exact figures, gain on all levels."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import metrics, sketches, timejoins
from relata.plans.queries import ORACLES, QUERIES


def brute_asof(left, right, strict):
    out = []
    for i, k, t in left:
        own = [(u, v) for c, u, v in right if k is not None and c == k and t is not None and u is not None and (u < t or u == t and not strict)]
        out.append((i, max(own, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1] if own else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_last_earlier_row(spark, strict, partitions):
    rng = random.Random(partitions)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only left", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(rng.choice(["hot"] * 6 + ["a", "b", "only right", None]), rng.choice([None, *range(60)]), rng.randrange(1000)) for _ in range(120)] + [("hot", 7, 5)] * 30
    a = spark.createDataFrame(left, "i int, capture string, t int")
    b = spark.createDataFrame(right, "capture string, seen int, frame int")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = timejoins.asof_join(a, b, ["capture"], "t", "seen", ["frame"], strict)
        assert found.columns == ["i", "capture", "t", "frame"]
        assert sorted((r["i"], r["frame"]) for r in found.collect()) == brute_asof(left, right, strict)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_hot_capture_spreads_over_ranges(spark, monkeypatch):
    a = spark.range(8000).selectExpr("id as i", "'hot' as capture", "id * 10 + 5 as t")
    b = spark.range(8000).selectExpr("'hot' as capture", "id * 10 as seen", "id as frame").filter("frame % 1000 = 0")
    written = {}
    real = timejoins.materialize
    with monkeypatch.context() as m:
        m.setattr(timejoins, "materialize", lambda df, label, **k: written.setdefault(label, real(df, label, **k)))
        found = timejoins.asof_join(a, b, ["capture"], "t", "seen", ["frame"])
    assert found.filter("frame = i - i % 1000").count() == 8000
    sizes = [r["count"] for r in written["asof-ranges"].groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 3000
    with pytest.raises(ValueError, match="both sides"):
        timejoins.asof_join(a, b, ["capture"], "t", "seen", ["capture"])
    assert timejoins.asof_join(a.limit(0), b, ["capture"], "t", "seen", ["frame"]).count() == 0
    assert timejoins.asof_join(a, b.limit(0), ["capture"], "t", "seen", ["frame"]).filter("frame is null").count() == 8000


def intervals(rng, n, whole):
    out = []
    for i in range(n):
        start = rng.uniform(-500, 500)
        length = rng.choice([0, 0, 1, 3, rng.uniform(0, 5), rng.uniform(0, 60), 900 if i % 40 == 0 else 2])
        start, length = (int(start), int(length)) if whole else (start, length)
        out.append((i, rng.choice("xy"), start, start + length))
    return out + [(n, "x", None, 3), (n + 1, "x", 9, 2), (n + 2, None, 1, 2)] if whole else out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlapping_intervals(spark, whole, keys):
    rng = random.Random(11)
    one, two = intervals(rng, 300, whole), intervals(rng, 200, whole)
    kind = "int" if whole else "double"
    k1, k2 = ("k", "k") if keys else ("k1", "k2")
    a = spark.createDataFrame(one, f"i int, {k1} string, a0 {kind}, a1 {kind}")
    b = spark.createDataFrame(two, f"j int, {k2} string, b0 {kind}, b1 {kind}")
    found = timejoins.interval_join(a, b, "a0", "a1", "b0", "b1", keys)
    meets = lambda x, y: None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and (not keys or x[1] == y[1] is not None)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == sorted((x[0], y[0]) for x in one for y in two if meets(x, y))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_points_and_empty_sides(spark):
    a = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "i int, a0 int, a1 int")
    b = spark.createDataFrame([(1, 5, 5), (2, 7, 7)], "j int, b0 int, b1 int")
    join = lambda x, y: sorted((r["i"], r["j"]) for r in timejoins.interval_join(x, y, "a0", "a1", "b0", "b1").collect())
    assert join(a, b) == [(1, 1)] and join(a.limit(0), b) == [] and join(a, b.limit(0)) == [] and join(a.limit(0), b.limit(0)) == []
    with pytest.raises(ValueError, match="both sides"):
        timejoins.interval_join(a, a, "a0", "a1", "a0", "a1")


def test_long_intervals_are_not_cut_into_many_bins(spark):
    """One interval of ten million times the others' length has two rows a level, and short ones do not meet on its level."""
    rows = [(k, 10.0 * k, 10.0 * k + 1) for k in range(2000)]
    a = spark.createDataFrame([*rows, (9999, 0.0, 1e7)], "i int, a0 double, a1 double")
    b = spark.createDataFrame(rows, "j int, b0 double, b1 double")
    found = timejoins.interval_join(a, b, "a0", "a1", "b0", "b1")
    assert found.count() == 4000


def test_sketches_keep_their_errors(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=40_000), rng.integers(0, 5, 20_000)])
    rows = [(k % 7, k % 3, float(v)) for k, v in enumerate(values)] + [(8, 0, None), (9, 0, float("nan"))]
    df = spark.createDataFrame(rows, "scene int, part int, v double").repartition(6)
    stored = sketches.sketch(df, ["scene", "part"], "v")
    by_scene = {r["scene"]: r for r in sketches.estimates(sketches.combine(stored, ["scene"]), {"low": 0.05, "median": 0.5, "high": 0.95}).collect()}
    for s in range(7):
        own = np.sort(values[np.arange(len(values)) % 7 == s])
        r = by_scene[s]
        assert r["n"] == len(own) and abs(r["n_distinct"] / len(set(own)) - 1) < sketches.DISTINCT_ERROR
        for name, q in (("low", 0.05), ("median", 0.5), ("high", 0.95)):
            low, high = np.searchsorted(own, r[name], "left") / len(own), np.searchsorted(own, r[name], "right") / len(own)
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR
    assert by_scene[8]["n"] == 0 and by_scene[8]["median"] is None and by_scene[9]["median"] is None
    whole = sketches.estimates(sketches.combine(stored, []), {"median": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["n"] == len(values) + 1


def test_gain_on_all_levels(spark):
    rng = random.Random(2)
    rows = [(s, "AB"[k % 2], s % 2, s % 3, rng.gauss(0.2, 0.1)) for s in range(9) for k in range(6)]
    df = spark.createDataFrame(rows, "scene int, fold string, site int, kind int, log_error double")
    found = {(r["site"], r["kind"], r["test_fold"], r["level"]): r for r in metrics.gain_levels(df, ["site", "kind"]).collect()}
    folds = metrics.fold_metrics(df).collect()
    names = ["site", "kind", "test_fold"]
    of = lambda r: {"site": r["scene"] % 2, "kind": r["scene"] % 3, "test_fold": r["test_fold"]}
    expected = {}
    for n in range(4):
        for kept in combinations(names, n):
            for r in folds:
                key = tuple(of(r)[x] if x in kept else None for x in names) + (sum(1 << (2 - i) for i, x in enumerate(names) if x not in kept),)
                raw, cor, m, scenes = expected.get(key, (0, 0, 0, set()))
                expected[key] = (raw + r["raw_sse"], cor + r["corrected_sse"], m + r["n"], scenes | {r["scene"]})
    assert set(found) == set(expected)
    for key, (raw, cor, m, scenes) in expected.items():
        assert found[key]["g_cv"] == pytest.approx(1 - cor / raw) and found[key]["n"] == m and found[key]["scenes"] == len(scenes) and found[key]["raw_rmse"] == pytest.approx((raw / m) ** 0.5)
    assert metrics.gain_levels(df, ["site", "kind"], sets=[["site"], []]).count() == 3
    assert {r["level"] for r in metrics.gain_levels(df, ["site"], sets=[["site", "test_fold"]]).select(F.col("level")).collect()} == {0}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_milliseconds_are_rounded_as_in_sql(spark, tmp_path, zone):
    """A start and an end that only meet once both are rounded; hours that the session's zone leaves out; times before 1970."""
    con = duckdb.connect()
    times = ["2024-01-01 00:00:00.000600", "2024-01-01 00:00:00.501400", "2024-03-10 02:30:00.0005", "2024-03-10 03:30:00.4", "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.998499", "1999-12-31 23:59:59.9995"]
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint)")
    con.executemany("insert into events values (?, ?::timestamp, 3)", list(enumerate(times, 1)))
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = spark.read.parquet(f"{tmp_path}/events.parquet")
        found = {r[0]: r[1] for r in events.select("event_id", timejoins.epoch_millis(events, "ts")).collect()}
        pairs = sorted(map(tuple, QUERIES["overlapping_sessions"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == dict(con.sql("select event_id, epoch_ms(ts) from events").fetchall())
    assert pairs == sorted(con.sql(ORACLES["overlapping_sessions"]).fetchall()) and (2, 1) in pairs
