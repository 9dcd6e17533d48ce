import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions import geometry as G
from relata.functions import predicates as P
from relata.functions import responses as R
from relata.functions import text as X
from relata.params import AuditRules


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("value, expected", [(1.0, True), (None, False), (math.nan, False), (math.inf, False), (-math.inf, False), (0.0, True)])
def test_finite_number(spark, value, expected):
    assert one(spark, value, "double", P.finite_number) is expected


@pytest.mark.parametrize("value, expected", [([1.0, 2.0, 3.0], True), ([1.0, 2.0], False), (None, False), ([1.0, None, 3.0], False), ([1.0, math.nan, 3.0], False)])
def test_finite_vector(spark, value, expected):
    assert one(spark, value, "array<double>", lambda c: P.finite_vector(c, 3)) is expected


@pytest.mark.parametrize("value, expected", [("  Chair\t\n", "chair"), (None, ""), ("", ""), ("A  B", "a  b")])
def test_category(spark, value, expected):
    assert one(spark, value, "string", P.normalized_category) == expected


def test_written_null_category_is_named(spark):
    row = spark.createDataFrame([(None, True), (None, False)], "c string, p boolean").select(P.normalized_category(F.col("c"), F.col("p")).alias("x")).collect()
    assert [r.x for r in row] == ["none", ""]


def test_geometric_valid(spark):
    good = ([1.0, 2.0, 3.0], [1.0, 1.0, 1.0], [[0.0, 0.0, 0.0]] * 8)
    rows = [good, (good[0], [1.0, 0.0, 1.0], good[2]), (good[0], good[1], good[2][:7]), ([math.nan, 0.0, 0.0], good[1], good[2]), (None, None, None)]
    df = spark.createDataFrame(rows, "p array<double>, s array<double>, c array<array<double>>")
    assert [r.x for r in df.select(P.geometric_valid(F.col("p"), F.col("s"), F.col("c")).alias("x")).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("box, expected", [([0.0, 0.0, 50.0, 20.0], True), ([0.0, 0.0, 19.0, 100.0], False), ([0.0, 0.0, 30.0, 30.0], False), ([0.0, 0.0, 100.0, 50.0], True), ([0.0, 0.0, 100.0, 51.0], False), (None, False)])
def test_oracle_valid(spark, box, expected):
    assert one(spark, box, "array<double>", lambda b: P.oracle_valid(F.lit(True), b, F.lit(100), F.lit(100), AuditRules())) is expected


@pytest.mark.parametrize("box, expected", [([5.0, 5.0, 95.0, 95.0], True), ([4.9, 5.0, 95.0, 95.0], False), ([5.0, 5.0, 95.1, 95.0], False)])
def test_interior(spark, box, expected):
    assert one(spark, box, "array<double>", lambda b: P.interior_valid(b, F.lit(100), F.lit(100), 5.0)) is expected


def test_boxes(spark):
    a, b, c = [0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0], [20.0, 20.0, 20.0, 30.0]
    row = spark.createDataFrame([(a, b, c)], "a array<double>, b array<double>, c array<double>").select(
        G.iou(F.col("a"), F.col("b")).alias("iou"), G.intersection_over_smaller(F.col("a"), F.col("b")).alias("ios"), G.iou(F.col("a"), F.col("c")).alias("none"), G.intersection_over_smaller(F.col("a"), F.col("c")).alias("flat"),
        G.center_distance(F.col("a"), F.col("b")).alias("d"), G.visible_fraction(F.col("b"), F.lit(10), F.lit(10)).alias("v"), G.visible_fraction(F.col("c"), F.lit(10), F.lit(10)).alias("v0"), G.border_margin(F.col("a"), F.lit(30), F.lit(12)).alias("m"),
    ).first()
    assert (row.iou, row.ios, row.none, row.flat, row.d, row.v, row.v0, row.m) == (pytest.approx(1 / 3), 0.5, 0.0, 0.0, 5.0, 0.5, 0.0, 0.0)


# Full-precision distances and overlaps of two objects, worked out by hand.
def test_distance(spark):
    row = spark.createDataFrame([([0.0, 3.0, 0.0], [4.0, 0.0, 0.0]), ([0.0, math.inf, 0.0], [4.0, 0.0, 0.0])], "a array<double>, b array<double>").select(G.euclidean(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in row] == [5.0, None]


@pytest.mark.parametrize("raw, expected", [
    ('{"distance_m": 1.5}', 1.5), ('```json\n{"distance_m": 2}\n```', 2.0), ("```\n{\"distance_m\": 2}```", 2.0), ('It is {"distance_m": 0.7} or so', 0.7), ('{"distance_m":\n 3}', 3.0), ('{"distance_m": "1"}', None),
    ('{"distance_m": true}', None), ('{"distance_m": 0}', None), ('{"distance_m": -1}', None), ('{"d": 1}', None), ("[1]", None), ('{"distance_m": 1', None), ('{"a": {}, "distance_m": 3} tail', None), ('{"a": {}, "distance_m": 3}', 3.0), ("", None), (None, None), ('{"a": 1} {"distance_m": 2}', None),
])
def test_parse_distance(spark, raw, expected):
    assert one(spark, raw, "string", R.parse_distance) == expected


@pytest.mark.parametrize("value", [0.22, 0.5, 1.0, 123456.0, 1234567.0, 0.00001234, 12.3456789, 0.0, 100000.0, 0.0001])
def test_six_digits(spark, value):
    assert one(spark, value, "double", X.six_digits) == f"{value:.6g}"


@pytest.mark.parametrize("value, number, whole", [("7", 7.0, 7), ("7.5", 7.5, None), ("x", None, None), ("NaN", None, None), (None, None, None), ("-3", -3.0, -3)])
def test_strict_casts(spark, value, number, whole):
    assert one(spark, value, "string", P.strict_double) == number
    assert one(spark, value, "string", P.strict_long) == whole


def test_canonical_json(spark):
    rows = spark.createDataFrame([({"b": 1, "a": 2},), ({"a": 2, "b": 1},)], T.StructType().add("m", T.MapType(T.StringType(), T.IntegerType()))).select(X.canonical_json(F.col("m")).alias("j")).collect()
    assert rows[0].j == rows[1].j == '{"a":2,"b":1}'
