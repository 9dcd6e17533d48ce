import hashlib
import json
import random
import tarfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata import schemas
from relata.operators import audit, compare, ledger, metrics, ordering, pairs, ranking, selection, validate
from relata.params import AuditRules, PairRules, RankRules, SceneRules, rule_contradictions
from relata.sources import files, images, readers, sinks
from relata.streaming import logs


def instance(k, category="chair", box=(10.0, 10.0, 60.0, 60.0), **more):
    return {"id": str(k), "category": category, "caption": None, "position": [float(k), 0.0, 0.0], "scale": [1.0, 1.0, 1.0], "R": None, "corners": [[0.0, 0.0, 0.0]] * 8, "box_2d_rend": list(box), "box_2d_proj": list(box)} | more


@pytest.fixture(scope="module")
def frames(spark):
    rows = [
        ("c1", 0, 640, 480, [instance(1), instance(2, "Chair "), instance(3, "lamp"), instance(4, "table", scale=[0.0, 1.0, 1.0]), instance(5, "vase", box=(3.0, 10.0, 60.0, 60.0))]),
        ("c1", 1, 640, 480, []),
    ]
    schema = schemas.T.StructType.fromDDL("capture_id string, frame_index int, width int, height int").add("instances", schemas.instances())
    return spark.createDataFrame(rows, schema)


def test_audit_counts(frames):
    found = {r.frame_index: (r.total, r.geometric, r.oracle, r.natural, r.natural_interior) for r in audit.audit_frames(frames).collect()}
    assert found == {0: (5, 4, 4, 2, 1), 1: (0, 0, 0, 0, 0)}


def test_uniqueness_counts_invalid_instances(spark, frames):
    doubled = frames.filter("frame_index = 0").withColumn("instances", F.expr("transform(instances, i -> struct(i.id, case when i.category = 'table' then 'lamp' else i.category end as category, i.caption, i.position, i.scale, i.R, i.corners, i.box_2d_rend, i.box_2d_proj))"))
    assert audit.audit_frames(doubled).first().natural == 1
    assert audit.audit_frames(doubled, AuditRules(uniqueness_scope="oracle")).first().natural == 2


def test_shortlist_and_summary(spark):
    rows = [("a", k, 1 + k % 5, 10, 8, 5, float(k), f"m{k}") for k in range(10)] + [("b", 0, 1, 0, 0, 0, 1.0, "m")] + [("c", 0, 1, 10, 8, 5, 2.0, "m")]
    df = spark.createDataFrame(rows, "capture_id string, frame_index int, temporal_bin int, oracle int, natural int, natural_interior int, sharpness double, image_member string")
    found = ranking.shortlist(df).orderBy("capture_id", "candidate_rank").collect()
    assert [(r.capture_id, r.frame_index) for r in found] == [("a", 9), ("a", 8), ("a", 7), ("c", 0)]
    summary = {r.capture_id: r for r in ranking.capture_summary(df).collect()}
    assert summary["a"].sharpness_cutoff == 6.75 and summary["b"].sharpness_cutoff is None and summary["b"].temporal_bins_represented == []
    assert ranking.shortlist(df, RankRules(per_bin=None, per_capture=None, sharpness_quantile=0.0)).count() == 11


def test_pairs_and_selection(spark):
    rng = random.Random(1)
    objects = [("c", 0, k, f"i{k}", f"n{k}", [rng.random() * 3 for _ in range(3)], [50.0 + 90 * k, 100.0, 120.0 + 90 * k, 180.0], True) for k in range(1, 8)]
    df = spark.createDataFrame(objects, "capture_id string, frame_index int, instance_index int, instance_id string, category string, position array<double>, box_2d_rend array<double>, interior boolean").withColumns({"width": F.lit(1024), "height": F.lit(768), "natural": F.lit(True)})
    built = pairs.build_pairs(pairs.object_records(df))
    assert built.count() == 21
    selected = selection.select_balanced(built.filter(pairs.hard_filter(PairRules())))
    rows = selected.orderBy("pair_index").collect()
    assert [r.pair_index for r in rows] == list(range(1, 13)) and [r.fold for r in rows] == ["A", "B"] * 6
    assert [r.distance_stratum for r in rows] == ["short"] * 4 + ["medium"] * 4 + ["long"] * 4
    assert [r.distance_m for r in rows] == sorted(r.distance_m for r in rows) and rows[0].pair_id == "c-P01"
    assert selection.select_balanced(built.limit(11)).count() == 0
    summary = selection.scene_summary(selected).withColumn("why", selection.rejection_reasons(SceneRules(minimum_unique_objects=8))).first()
    assert "minimum_unique_objects" in summary.why and summary.selected_interior_pairs == 12


def test_equal_parts_give_the_rest_to_the_first(spark):
    df = spark.range(8).select(F.lit("c").alias("capture_id"), F.lit(0).alias("frame_index"), F.col("id").cast("double").alias("distance_m"), F.lit(1).alias("first_instance_index"), F.col("id").alias("second_instance_index"))
    counts = selection.stratify(df, SceneRules(pairs_per_scene=6)).groupBy("distance_stratum_index").count().orderBy("distance_stratum_index").collect()
    assert [r["count"] for r in counts] == [3, 3, 2]


def test_gain_is_one_for_a_pure_scale(spark):
    rows = spark.createDataFrame([("s", "AB"[k % 2], 1.0 + k, 2.0 * (1.0 + k)) for k in range(6)] + [("z", "AB"[k % 2], 1.0, 1.0) for k in range(4)], "scene string, fold string, truth double, prediction double")
    found = {r.scene: r for r in metrics.scene_metrics(metrics.with_log_error(rows)).collect()}
    assert found["s"].g_cv == pytest.approx(1.0) and found["s"].scale_fraction == pytest.approx(1.0) and found["s"].descriptive_alpha == pytest.approx(0.5)
    assert found["z"].g_cv is None and found["z"].scale_fraction == 0.0


def test_gain_against_plain_python(spark):
    import math

    rng = random.Random(5)
    data = [("s", "AB"[k % 2], rng.random() + 0.5, rng.random() + 0.5) for k in range(12)]
    e = {f: [math.log(p / t) for _, g, t, p in data if g == f] for f in "AB"}
    raw = sum(x * x for v in e.values() for x in v)
    corrected = sum((x - sum(e[o]) / 6) ** 2 for f, o in (("A", "B"), ("B", "A")) for x in e[f])
    rows = metrics.with_log_error(spark.createDataFrame(data, "scene string, fold string, truth double, prediction double"))
    assert metrics.scene_gain(rows).first().g_cv == pytest.approx(1 - corrected / raw)


RELATION = "scene string, pair_id string, pair_index long, fold string, distance_stratum string, ground_truth_m double, object_a string, object_b string, both_interior boolean, minimum_visible_fraction double, minimum_box_area_fraction double, minimum_box_side_px double, minimum_border_margin_px double, box_iou double, intersection_over_smaller_box double"


def manifest():
    objects = [("1", "2"), ("3", "4"), ("5", "6"), ("1", "3"), ("2", "4"), ("1", "5"), ("2", "6"), ("3", "5"), ("4", "6"), ("1", "6"), ("2", "5"), ("3", "6")]
    return [["s", f"p{k}", k, "A" if k % 2 else "B", ("short", "medium", "long")[(k - 1) // 4], 0.5 + 0.2 * k, *objects[k - 1], True, 1.0, 0.01, 40.0, 25.0, 0.1, 0.1] for k in range(1, 13)]


@pytest.mark.parametrize("change, rule", [
    (lambda m: m.pop(), "pair_count"), (lambda m: m[1].__setitem__(1, "p1"), "duplicate_pair_id"), (lambda m: m[3].__setitem__(2, 40), "index_gap"), (lambda m: m[0].__setitem__(3, "B"), "wrong_fold"), (lambda m: m[0].__setitem__(3, "C"), "invalid_fold"),
    (lambda m: m[0].__setitem__(4, "long"), "wrong_stratum"), (lambda m: m[0].__setitem__(4, "far"), "invalid_stratum"), (lambda m: m[1].__setitem__(slice(6, 8), ["2", "1"]), "duplicate_object_pair"), (lambda m: m[0].__setitem__(7, "1"), "identical_objects"),
    (lambda m: m[5].__setitem__(5, 0.6), "decreasing_distance"), (lambda m: [r.__setitem__(5, 1.0) for r in m], "distance_ratio"), (lambda m: m[0].__setitem__(5, 0.2), "minimum_distance"), (lambda m: m[0].__setitem__(5, -1.0), "invalid_ground_truth"),
    (lambda m: m[0].__setitem__(9, 0.9), "minimum_visible_fraction"), (lambda m: m[0].__setitem__(10, 0.001), "minimum_box_area_fraction"), (lambda m: m[0].__setitem__(11, 29.0), "minimum_box_side_px"), (lambda m: m[0].__setitem__(12, None), "missing_minimum_border_margin_px"),
    (lambda m: m[0].__setitem__(13, 0.6), "box_iou"), (lambda m: m[0].__setitem__(14, 0.9), "intersection_over_smaller_box"), (lambda m: m[0].__setitem__(8, None), "not_interior"), (lambda m: [r.__setitem__(6, "9") for r in m], "object_uses"),
])
def test_manifest_mutations(spark, change, rule):
    rows = manifest()
    change(rows)
    found = {r.rule for r in validate.manifest_violations(spark.createDataFrame([tuple(r) for r in rows], RELATION)).collect()}
    assert rule in found


def test_good_manifest_has_no_violation(spark):
    assert validate.manifest_violations(spark.createDataFrame([tuple(r) for r in manifest()], RELATION)).count() == 0


def test_numbers_equal(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, None, True), (1.0, None, False), (nan, nan, False), (inf, inf, True), (inf, 1.0, False), (1.0, 1.001, False), (1.0, 1.0000001, True)]
    df = spark.createDataFrame(rows, "a double, b double, e boolean").select(compare.numbers_equal(F.col("a"), F.col("b"), 1e-6).alias("x"), "e")
    assert all(r.x == r.e for r in df.collect())


def test_positional_difference_stops_at_another_key(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)], "run_index int, pair_id string, p double")
    b = spark.createDataFrame([(1, "x", 1.001), (2, "q", 9.0)], "run_index int, pair_id string, p double")
    found = [(r.run_index, r.category) for r in compare.diff_positional(a, b, "pair_id", numbers=("p",)).orderBy("run_index").collect()]
    assert found == [(1, "numeric_output"), (2, "order")]


def test_orders(spark):
    ids = [str(k) for k in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    expected = sorted(ids, key=lambda i: (hashlib.sha256(f"salt:{i}".encode()).hexdigest(), i))
    assert [r.id for r in ordering.salted_order(df, "id", "salt").orderBy("order_index").collect()] == expected
    shuffled = sorted(ids)
    random.Random(7).shuffle(shuffled)
    assert [r.id for r in ordering.seeded_shuffle(df, "id", 7).orderBy("run_index").collect()] == shuffled


def test_stop_rule(spark):
    log = spark.createDataFrame([(k, k % 3 == 0) for k in range(1, 20)], "i int, ok boolean")
    assert [r.i for r in ordering.until_target(log, "i", "ok", 2).orderBy("i").collect()] == [1, 2, 3, 4, 5, 6]
    assert ordering.until_target(log, "i", "ok", 99).count() == 19


def test_ledger(spark):
    rows = [("a", True, 12, "pass", None, ["validation_report", "rendered_manifest", "render_protocol", "contact_sheet"], True), ("b", False, 3, "pass", True, None, None), ("c", True, 12, "fail", False, [], False)]
    df = spark.createDataFrame(rows, "capture_id string, selection_accepted boolean, selection_pair_count int, visual_qc string, capture_accepted boolean, artifact_names array<string>, validation_passed boolean")
    found = {(r.capture_id, r.rule) for r in ledger.evidence_violations(df).collect()}
    assert found == {("b", "rejected_pair_count"), ("b", "rejected_with_check"), ("b", "stored_verdict_differs"), ("c", "missing_artifacts"), ("c", "validation_not_passed")}
    assert [r.capture_decision for r in ledger.with_status(df).orderBy("capture_id").collect()] == ["accepted", "rejected_numerical", "rejected_visual"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n[3]\n')
    numbered = readers.json_lines_with_numbers(spark, str(tmp_path / "rows.jsonl"), "a int").orderBy("line_number").collect()
    assert [(r.line_number, r.valid, r.a) for r in numbered] == [(1, True, 1), (3, True, 2), (4, False, None)]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0
    (tmp_path / "ids.txt").write_text("12\n\n 34 \n")
    assert sorted(r.capture_id for r in readers.digit_list(spark, str(tmp_path / "ids.txt")).collect()) == ["12", "34"]
    (tmp_path / "bad.txt").write_text("12\n12\n")
    with pytest.raises(ValueError):
        readers.digit_list(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "urls.txt").write_text("https://host/set-7.tar\n")
    assert readers.url_list(spark, str(tmp_path / "urls.txt"), r"https://host/set-(\d+)\.tar").first().capture_id == "7"
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    digest = sinks.publish_json_lines(df, str(tmp_path / "out.jsonl"), ["k"])
    text = (tmp_path / "out.jsonl").read_text()
    assert text == '{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n' and digest == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(FileExistsError):
        sinks.publish_json_lines(df, str(tmp_path / "out.jsonl"), ["k"])
    sinks.publish_csv(df, str(tmp_path / "out.csv"), ["v", "k"], ["k"])
    assert (tmp_path / "out.csv").read_text() == "v,k\na,1\nb,2\n"
    sinks.publish_folder(spark, str(tmp_path / "folder"), {"x.txt": b"1", "sub/y.txt": b"2"})
    listed = readers.checksum_list(spark, str(tmp_path / "folder/SHA256SUMS"))
    assert readers.checksum_violations(listed, readers.file_table(spark, str(tmp_path / "folder")), str(tmp_path / "folder")).count() == 0
    (tmp_path / "folder/.x.txt.crc").unlink()
    (tmp_path / "folder/x.txt").write_text("changed")
    assert [r.rule for r in readers.checksum_violations(listed, readers.file_table(spark, str(tmp_path / "folder")), str(tmp_path / "folder")).collect()] == ["differs"]
    with pytest.raises(ValueError):
        sinks.refuse_inside("/a/b/c", "/a/b")


def test_archives_and_images(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    with tarfile.open(tmp_path / "set-42.tar", "w") as tar:
        for name, data in (("42/b/instances.json", json.dumps([instance(1)]).encode()), ("42/b/image.png", images.encode_png(px)), ("42/a/instances.json", b"[]"), ("42/c/image.png", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, BytesIO(data))
    frames = readers.archive_frames(files.archive_members(spark, str(tmp_path)), schemas.instances())
    measured = images.image_measures(frames).collect()
    assert [(r.capture_id, r.frame_index, r.width, r.height, len(r.instances)) for r in measured] == [("42", 0, 30, 20, 1)]
    assert measured[0].sharpness == pytest.approx(images.sharpness(px)) and images.sharpness(np.full((5, 5, 3), 9, np.uint8)) == 0
    sheet = images.contact_sheet([px, px, px, px], columns=3, cell_width=15)
    assert sheet.shape == (20, 45, 3)
    boxed = images.draw_box(px, (2, 3, 20, 15), (1, 2, 3))
    assert tuple(boxed[3, 10]) == (1, 2, 3) and (boxed[10, 10] == px[10, 10]).all()


def test_streaming(spark, tmp_path):
    schema = "ledger string, order_index long, accepted boolean"
    for k, rows in enumerate(([("l", 1, True), ("l", 2, False)], [("l", 2, False), ("l", 3, True), ("l", 4, True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(logs.append_once(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        q = logs.until_target(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "until")).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.order_index for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3, 4]
    assert [(r.order_index, r.accepted_so_far) for r in spark.read.parquet(str(tmp_path / "until")).orderBy("order_index").collect()] == [(1, 1), (2, 1), (3, 2)]


def test_late_rows_wait_for_their_predecessors(spark, tmp_path):
    schema = "ledger string, order_index long, accepted boolean"
    batches = ([("l", 3, True), ("l", 1, True)], [("l", 5, True), ("l", 1, False)], [("l", 2, False)], [("l", 4, False), ("l", 6, True)])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        logs.until_target(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.order_index, r.accepted_so_far) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("order_index").collect()] == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


def test_overwriting_keeps_the_old_file_until_the_new_one_stands(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f.txt")
    sinks.publish_text(spark, path, "old")
    with pytest.raises(FileExistsError):
        sinks.publish_text(spark, path, "new")

    def broken(self, p, data):
        raise OSError("full")

    with monkeypatch.context() as m:
        m.setattr(sinks.Store, "write", broken)
        with pytest.raises(OSError):
            sinks.publish_text(spark, path, "new", overwrite=True)
    assert (tmp_path / "f.txt").read_text() == "old"
    assert sinks.publish_text(spark, path, "new", overwrite=True) == hashlib.sha256(b"new").hexdigest()
    assert (tmp_path / "f.txt").read_text() == "new" and not list(tmp_path.glob("*.old")) and not list(tmp_path.glob("*.part"))
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "k int, t string")
    sinks.publish_json_lines(df, str(tmp_path / "rows.jsonl"), ["k"])
    assert [json.loads(x)["k"] for x in (tmp_path / "rows.jsonl").read_text().splitlines()] == list(range(50))
    sinks.publish_csv(df, str(tmp_path / "rows.csv"), ["k", "t"], ["k"])
    assert (tmp_path / "rows.csv").read_text().splitlines()[:2] == ["k,t", "0,t0"]
    sums = sinks.publish_folder(spark, str(tmp_path / "set"), {"a.txt": b"x"})
    assert sums == {"a.txt": hashlib.sha256(b"x").hexdigest()} and (tmp_path / "set" / "SHA256SUMS").exists()


def test_exact_median_equals_sorted_middle(spark):
    rng = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 7 + [1.0], [rng.random() for _ in range(4001)], [float(rng.randrange(9)) for _ in range(5000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        found = metrics.exact_median(df, "x").first().median
        assert found == (pytest.approx(float(np.median(values))) if values else None)


def test_frozen_rules_and_protocols(spark):
    assert rule_contradictions(PairRules(), SceneRules(), True, 12, 4) == []
    assert rule_contradictions(PairRules(minimum_distance_m=float("nan")), SceneRules(), False, 10, 5) == ["both_objects_interior", "minimum_eligible_pairs", "pairs_per_stratum", "not_finite"]
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "scene string")
    assert validate.protocol_violations(rows, {"selected_scenes": 2, "number_of_pairs": 3, "manifest_sha256": "h"}, "h").count() == 0
    assert validate.protocol_violations(rows, {}, "h").count() == 0
    assert {r.rule for r in validate.protocol_violations(rows, {"number_of_scenes": 9, "output_sha256": "x"}, "h").collect()} == {"number_of_scenes", "output_sha256"}


def test_generic_categories_name_nothing(spark, frames):
    walls = frames.filter("frame_index = 0").withColumn("instances", F.expr("transform(instances, i -> struct(i.id, case when i.category = 'lamp' then ' WALL' else i.category end as category, i.caption, i.position, i.scale, i.R, i.corners, i.box_2d_rend, i.box_2d_proj))"))
    assert audit.audit_frames(walls).first().natural == 1
    assert audit.audit_frames(walls, AuditRules(generic_categories=())).first().natural == 2


def test_members_without_their_sibling(spark):
    members = spark.createDataFrame([("t.tar", f"{f}/{n}") for f, n in (("a", "instances.json"), ("a", "image.png"), ("b", "image.png"), ("c", "instances.json"), ("d", "other"))], "archive string, member string")
    assert {(r.folder, r.rule) for r in readers.member_violations(members).collect()} == {("b", "missing instances.json"), ("c", "missing image.png")}


def test_grids_have_the_published_sizes(spark):
    from relata.operators import sweep

    assert sweep.legibility_grid(spark).count() == 64
    empty = spark.createDataFrame([], "capture_id string, frame_index int, minimum_box_area_fraction double, minimum_box_side_px double, minimum_border_margin_px double")
    candidates = spark.createDataFrame([("a", 3, 2), ("a", 7, 1)], "capture_id string, frame_index int, candidate_rank int")
    best = sweep.sweep_best(sweep.sweep_counts(empty, sweep.legibility_grid(spark), candidates))
    assert {(r.frame_index, r.pair_count) for r in best.collect()} == {(7, 0)}
    assert {(r.feasible_captures, r.minimum_best_pair_count) for r in sweep.sweep_summary(best).collect()} == {(0, 0)}


def test_a_cluster_without_a_shared_folder_is_refused():
    from relata.storage import shared_dir

    class Nowhere:
        isDefined = staticmethod(lambda: False)

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: Nowhere)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_seeded_order_is_the_generators(spark):
    df = spark.createDataFrame([(k,) for k in range(30)], "k int")
    expected = list(range(30))
    random.Random(7).shuffle(expected)
    assert [r.k for r in ordering.seeded_shuffle(df, "k", 7).orderBy("run_index").collect()] == expected


def filtered_png(px, kinds):
    """A PNG whose rows are stored by the given filters, written out byte by byte."""
    import struct
    import zlib

    height, width, n = px.shape
    flat, body = px.reshape(height, -1).astype(int), b""
    for y in range(height):
        kind = kinds[y % len(kinds)]
        row = []
        for x in range(width * n):
            a, b, c = (flat[y, x - n] if x >= n else 0), (flat[y - 1, x] if y else 0), (flat[y - 1, x - n] if y and x >= n else 0)
            near = sorted(((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c))))[0][2]
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        body += bytes([kind, *row])
    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_filters():
    px = np.random.default_rng(1).integers(0, 256, (10, 7, 3)).astype(np.uint8)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
        assert (images.decode_png(filtered_png(px, kinds)) == px).all()


def test_labels_headings_and_sheets(spark):
    blank = np.full((60, 80, 3), 200, np.uint8)
    drawn = images.draw_label(blank, (10, 40, 60, 55), "A", (220, 40, 40), 16)
    field = (drawn == (220, 40, 40)).all(axis=2)
    assert (drawn == 255).all(axis=2).sum() > 20 and field.any() and np.nonzero(field)[0].max() <= 40 and np.nonzero(field)[1].min() == 10 and (blank == 200).all()
    assert (images.draw_text(blank, -500, 0, "x") == blank).all()
    glyphs = {images.draw_text(blank, 2, 2, c, height=28).tobytes() for c in images.STROKES if images.STROKES[c]}
    assert len(glyphs) >= len([c for c in images.STROKES if images.STROKES[c]]) - 2
    sheet = images.contact_sheet([blank] * 4, 3, 40, headings=[("P01", "1.25 M")] * 4)
    assert sheet.shape == (2 * (48 + 30), 120, 3) and (sheet[48:78, :40] == 200).all() and (sheet[:48, :40] == 0).any()
    assert images.cells(4, 3, 10, 20) == [(0, 0), (10, 0), (20, 0), (0, 20)]
    master = images.master_sheet([("7", sheet), ("8", sheet), ("9", sheet)], cell_width=90, preview_height=100)
    assert master.shape == (260, 180, 3)
    with pytest.raises(ValueError):
        images.contact_sheet([])
    rows = [(s, k, images.encode_png(np.full((6, 8, 3), 10 * k, np.uint8)), [f"{s} {k}"]) for s in "ab" for k in (3, 1, 2)]
    sheets = images.scene_sheets(spark.createDataFrame(rows, "scene string, pair_index int, stimulus binary, lines array<string>"), headings="lines", cell_width=8).collect()
    px = images.decode_png({r.scene: r.sheet for r in sheets}["a"])
    assert len(sheets) == 2 and [int(px[-1, 8 * k + 4, 0]) for k in range(3)] == [10, 20, 30]


def test_pages_and_image_files(spark, tmp_path):
    import re
    import zlib

    sheets = [(7, "c7", images.encode_png(np.full((15, 30, 3), 9, np.uint8))), (9, "c9", images.encode_png(np.full((30, 15, 3), 8, np.uint8)))]
    data = images.pdf([images.decode_png(d) for _, _, d in sheets])
    assert data.startswith(b"%PDF-") and b"/Count 2" in data
    table = int(re.search(rb"startxref\n(\d+)", data)[1])
    for k, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data[table:]), 1):
        assert data[int(place) :].startswith(f"{k} 0 obj".encode())
    first = re.search(rb"/Width 30 /Height 15.*?/Length (\d+) >>\nstream\n", data, re.S)
    assert zlib.decompress(data[first.end() : first.end() + int(first[1])]) == bytes([9]) * 15 * 30 * 3
    written = images.write_images(spark.createDataFrame([(f"{k}.png", d) for k, _, d in sheets], "name string, content binary"), str(tmp_path / "images")).collect()
    assert {r.name: r.sha256 for r in written} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "images").iterdir()}
    again = lambda rows, **k: images.write_images(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "images"), **k).count()
    assert again([("7.png", sheets[0][2])]) == 1
    with pytest.raises(Exception, match="FileExistsError"):
        again([("7.png", b"other")])
    assert again([("7.png", b"other")], overwrite=True) == 1 and (tmp_path / "images/7.png").read_bytes() == b"other"
    for bad in (None, "", "../x.png", "/x.png", "a/../../x.png"):
        with pytest.raises(Exception, match="no name of a file"):
            again([(bad, b"x")])


def test_commands_environment_and_gate(tmp_path):
    import io
    import sys

    echo = io.StringIO()
    assert sinks.run_logged([sys.executable, "-c", "print('one'); print('two'); raise SystemExit(3)"], str(tmp_path / "log"), echo) == 3
    assert (tmp_path / "log").read_text() == echo.getvalue() == "one\ntwo\n"
    own = validate.environment(("numpy", "no-such-package"))
    assert own["no-such-package"] == "not installed" and own["numpy"] == np.__version__
    assert validate.environment_violations({"numpy": np.__version__, "architecture": ""}) == []
    assert [v[0] for v in validate.environment_violations({"numpy": "0", "python": "2.7"})] == ["numpy", "python"]
    seen = []
    assert ledger.until_gate(lambda k: seen.append(k) or k == 5, 3, 9) == 5 and seen == [3, 4, 5]
    assert ledger.until_gate(lambda k: False, 1, 2) is None
