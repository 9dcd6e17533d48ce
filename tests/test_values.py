"""Values as they were written, crowded frames, stimuli against hashes, orders and row counts of runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from relata.functions import variants
from relata.operators import compare, ledger, pairs
from relata.sources import readers, sinks

VALUES = {
    '{"x": 1}': ("number", 1.0, 1.0, 1.0, 1), '{"x": 2.50}': ("number", 2.5, 2.5, 2.5, None), '{"x": 3.0}': ("number", 3.0, 3.0, 3.0, 3), '{"x": true}': ("boolean", None, 1.0, 1.0, None), '{"x": false}': ("boolean", None, 0.0, 0.0, None),
    '{"x": null}': ("null", None, None, None, None), '{"y": 1}': ("missing", None, None, None, None), '{"x": " 4.5 "}': ("string", None, None, 4.5, None), '{"x": "7"}': ("string", None, None, 7.0, 7), '{"x": "true"}': ("string", None, None, None, None), '{"x": ""}': ("string", None, None, None, None),
    '{"x": "NaN"}': ("string", None, None, None, None), '{"x": {"a": 1}}': ("object", None, None, None, None), '{"x": [1]}': ("array", None, None, None, None), '{"x": 9007199254740993}': ("number", 9007199254740992.0, 9007199254740992.0, 9007199254740992.0, 9007199254740993), '{"x": 1e300}': ("number", 1e300, 1e300, 1e300, None),
    "[1]": ("missing", None, None, None, None), "no json": ("missing", None, None, None, None), "": ("missing", None, None, None, None),
}


def test_kinds_and_numbers(spark):
    df = variants.with_variant(spark.createDataFrame([(t,) for t in [*VALUES, None]], "line string"))
    v = F.col("value")
    found = {r[0]: tuple(r)[1:] for r in df.select("line", variants.kind(v, "x"), variants.finite_number(v, "x"), variants.finite_number(v, "x", booleans=True), variants.finite_float(v, "x"), variants.finite_int(v, "x")).collect()}
    assert found.pop(None) == ("missing", None, None, None, None)
    assert found == VALUES
    roots = {r[0]: r[1] for r in df.select("line", variants.is_object(v)).collect()}
    assert roots["[1]"] is False and roots["no json"] is False and roots['{"y": 1}'] is True


def test_categories(spark):
    lines = {'{"category": "  Chair\\u00a0"}': "chair", "{}": "", '{"category": null}': "none", '{"category": true}': "true", '{"category": 3}': "3"}
    df = variants.with_variant(spark.createDataFrame([(t,) for t in lines], "line string"))
    assert {r[0]: r[1] for r in df.select("line", variants.category(F.col("value"))).collect()} == lines


def test_lines_pass_unchanged(spark, tmp_path):
    lines = ['{"b":  1.50, "a": true}', '  {"a": "ü\\u00fc", "z": null} ', '{"a":1e3}']
    (tmp_path / "in.jsonl").write_bytes("\r\n\n".join(lines).encode())
    rows = readers.json_variant_lines(spark, str(tmp_path / "in.jsonl"), expected_rows=3)
    digest = sinks.publish_lines(rows, str(tmp_path / "out.jsonl"), ["line_number"])
    text = "\n".join(lines) + "\n"
    assert (tmp_path / "out.jsonl").read_bytes() == text.encode() and digest == hashlib.sha256(text.encode()).hexdigest()
    assert [json.loads(x) for x in text.splitlines()][2]["a"] == 1000
    with pytest.raises(ValueError, match="has 3 rows; expected 4"):
        readers.json_variant_lines(spark, str(tmp_path / "in.jsonl"), expected_rows=4)
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(ValueError, match="line 2: no object"):
        readers.json_variant_lines(spark, str(tmp_path / "bad.jsonl"), expected_rows=2)


def crowd(spark, sizes):
    rows = [(f"c{c}", 0, k, f"i{k}", "x", [float(k % 7), float(k % 11), float(k)], [0.0, 0.0, 10.0 + k, 10.0], 10.0 * (10 + k), 1.0, True, 0.01, 10.0, 5.0) for c, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "capture_id string, frame_index int, instance_index int, instance_id string, category string, position array<double>, box_2d_rend array<double>, box_area_px2 double, visible_fraction double, interior boolean, area_fraction double, side_px double, margin_px double")


@pytest.mark.parametrize("crowded, block", [(10, 4), (50, 7), (2, 1), (10_000, 256)])
def test_pairs_of_crowded_frames(spark, crowded, block):
    objects = crowd(spark, [60, 3, 1, 20, 11])
    plain = {tuple(r) for r in pairs.build_pairs(objects).select("capture_id", "first_instance_index", "second_instance_index", "distance_m").collect()}
    tiled = pairs.build_pairs(objects, crowded=crowded, block=block).select("capture_id", "first_instance_index", "second_instance_index", "distance_m").collect()
    assert len(tiled) == len(plain) == sum(n * (n - 1) // 2 for n in (60, 3, 1, 20, 11)) and {tuple(r) for r in tiled} == plain


def test_a_crowded_frame_spreads_over_the_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = pairs.build_pairs(crowd(spark, [600]), crowded=100, block=60).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in found) == 600 * 599 // 2 and len(found) >= 12 and max(r["count"] for r in found) < 0.25 * 600 * 599 / 2


def test_stimuli_against_hashes(spark):
    manifest = spark.createDataFrame([("a", "a.png"), ("b", "b.png"), ("c", "c.png"), ("d", "d.png"), ("e", "e.png"), (None, "f.png")], "pair_id string, stimulus string")
    reference = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", ""), ("z", "9")], "pair_id string, stimulus_sha256 string")
    found = spark.createDataFrame([("a.png", "1"), ("b.png", "other"), ("d.png", "4"), ("e.png", "5"), ("f.png", "6")], "path string, sha256 string")
    told = lambda **k: sorted(map(tuple, ledger.stimulus_violations(manifest, reference, found, **k).collect()), key=repr)
    assert told() == sorted([("b", "differs"), ("c", "missing"), ("d", "without_hash"), ("e", "not_in_reference"), (None, "not_in_reference"), ("z", "not_in_manifest")], key=repr)
    assert ("c", "missing") not in told(allow_missing=True) and len(told(allow_missing=True)) == 5


def test_orders_and_row_counts(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "run_index long, pair_id string, p double")
    b = spark.createDataFrame([(1, "a", 1.0), (2, "x", 2.0)], "run_index long, pair_id string, p double")
    assert sorted(map(tuple, compare.order_differences(a, b).collect())) == [(2, "differs", "b", "x"), (3, "missing", "c", None)]
    assert sorted(map(tuple, compare.order_differences(b, a).collect())) == [(2, "differs", "x", "b"), (3, "extra", None, "c")]
    counted = {r["category"]: r["n"] for r in compare.difference_counts(compare.diff_runs(a, b, "pair_id", numbers=("p",))).collect()}
    assert counted == {"order": 1, "row_count": 1}
    row = compare.diff_runs(a, b, "pair_id").filter("category = 'row_count'").first()
    assert (row["run_index"], row["field"], row["reference"], row["candidate"]) == (None, "number_of_rows", "3", "2")
    assert compare.diff_runs(a, a, "pair_id", numbers=("p",)).count() == 0
