"""Dataset checks: every rule that fails is a row (scene, pair, rule, observed, expected)."""

from __future__ import annotations

import platform
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions.predicates import finite_number
from relata.functions.text import unordered_pair
from relata.operators.compare import number_rows
from relata.params import EPSILON, STRATUM_NAMES

COLUMNS = ("scene", "pair_id", "rule", "observed", "expected")


@dataclass(frozen=True)
class ManifestRules:
    pairs_per_scene: int = 12
    minimum_distance_m: float = 0.25
    minimum_distance_ratio: float = 2.5
    minimum_unique_objects: int = 6
    maximum_object_uses: int = 5
    minimums: tuple[tuple[str, float], ...] = (("minimum_visible_fraction", 1.0), ("minimum_box_area_fraction", 0.00375), ("minimum_box_side_px", 30.0), ("minimum_border_margin_px", 20.0))
    maximums: tuple[tuple[str, float], ...] = (("box_iou", 0.5), ("intersection_over_smaller_box", 0.8))


def _text(c) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast("string")


def _row(failed: Column, rule: str, observed, expected) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit(rule).alias("rule"), _text(observed).alias("observed"), _text(expected).alias("expected")))


def _explode(df: DataFrame, pair: Column, checks: list[Column], scene: str) -> DataFrame:
    return df.select(F.col(scene).alias("scene"), pair.alias("pair_id"), F.inline(F.array_compact(F.array(*checks)))).select(*COLUMNS)


def pair_violations(manifest: DataFrame, rules: ManifestRules = ManifestRules(), scene: str = "scene") -> DataFrame:
    """Checks on each relation alone and in its place within the scene.

    manifest: scene, pair_id, pair_index, fold, distance_stratum, ground_truth_m,
    object_a, object_b, and the quality measures.
    """
    order = Window.partitionBy(scene).orderBy(F.col("pair_index").asc_nulls_last(), "pair_id")
    c, index = F.col, F.col("pair_index")
    placed = manifest.withColumns({"__place": F.row_number().over(order), "__before": F.last(F.when(c("ground_truth_m") > 0, c("ground_truth_m")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    truth = finite_number(c("ground_truth_m")) & (c("ground_truth_m") > 0)
    fold = F.when(index % 2 == 1, "A").otherwise("B")
    size = rules.pairs_per_scene // len(STRATUM_NAMES)
    names = F.array(*map(F.lit, STRATUM_NAMES))
    stratum = F.when(index.between(1, rules.pairs_per_scene), F.get(names, F.least(F.floor((index - 1) / size).cast("int"), F.lit(2))))
    folds, strata = c("fold").isin("A", "B"), c("distance_stratum").isin(*STRATUM_NAMES)
    known_fold, known_stratum = F.coalesce(folds, F.lit(False)), F.coalesce(strata, F.lit(False))
    checks = [
        _row(~c("pair_index").eqNullSafe(c("__place")), "index_gap", index, c("__place")),
        _row(~truth, "invalid_ground_truth", c("ground_truth_m"), "> 0"),
        _row(truth & (c("ground_truth_m") + EPSILON < rules.minimum_distance_m), "minimum_distance", c("ground_truth_m"), rules.minimum_distance_m),
        _row(~known_fold, "invalid_fold", c("fold"), "A or B"),
        _row(known_fold & (c("fold") != fold), "wrong_fold", c("fold"), fold),
        _row(~known_stratum, "invalid_stratum", c("distance_stratum"), ", ".join(STRATUM_NAMES)),
        _row(known_stratum & (c("distance_stratum") != stratum), "wrong_stratum", c("distance_stratum"), stratum),
        _row(c("object_a").eqNullSafe(c("object_b")), "identical_objects", c("object_a"), "two objects"),
        _row(truth & (c("__before") > c("ground_truth_m")), "decreasing_distance", c("ground_truth_m"), c("__before")),
        _row(~c("both_interior").eqNullSafe(F.lit(True)), "not_interior", c("both_interior"), "true"),
    ]
    for name, least in rules.minimums:
        checks += [_row(~finite_number(c(name)), f"missing_{name}", c(name), "a number"), _row(finite_number(c(name)) & (c(name) + EPSILON < least), name, c(name), least)]
    for name, most in rules.maximums:
        checks += [_row(~finite_number(c(name)), f"missing_{name}", c(name), "a number"), _row(finite_number(c(name)) & (c(name) - EPSILON > most), name, c(name), most)]
    return _explode(placed, c("pair_id"), checks, scene)


def scene_violations(manifest: DataFrame, rules: ManifestRules = ManifestRules(), scene: str = "scene") -> DataFrame:
    """Checks on a scene's counts, ratio and objects."""
    c, n = F.col, rules.pairs_per_scene
    truth = F.when(finite_number(c("ground_truth_m")) & (c("ground_truth_m") > 0), c("ground_truth_m"))
    per_stratum, per_fold = n // len(STRATUM_NAMES), n // 2
    is_in = {s: F.coalesce(c("distance_stratum") == s, F.lit(False)) for s in STRATUM_NAMES}
    of_fold = {f: F.coalesce(c("fold") == f, F.lit(False)) for f in "AB"}
    counts = {s: F.count_if(is_in[s]) for s in STRATUM_NAMES} | {f: F.count_if(of_fold[f]) for f in "AB"} | {f"{s}_{f}": F.count_if(is_in[s] & of_fold[f]) for s in STRATUM_NAMES for f in "AB"}
    sums = manifest.groupBy(scene).agg(F.count("*").alias("pairs"), F.min(truth).alias("low"), F.max(truth).alias("high"), *(v.alias(f"n_{k}") for k, v in counts.items()))
    uses = manifest.select(scene, F.explode(F.array("object_a", "object_b")).alias("object")).groupBy(scene, "object").agg(F.count("*").alias("uses")).groupBy(scene).agg(F.count("*").alias("objects"), F.max("uses").alias("uses"))
    joined = sums.join(uses, scene)
    expected = {s: per_stratum for s in STRATUM_NAMES} | {f: per_fold for f in "AB"} | {f"{s}_{f}": per_stratum // 2 for s in STRATUM_NAMES for f in "AB"}
    checks = [_row(c("pairs") != n, "pair_count", c("pairs"), n), _row(c("high") / c("low") + EPSILON < rules.minimum_distance_ratio, "distance_ratio", c("high") / c("low"), rules.minimum_distance_ratio)]
    checks += [_row(c(f"n_{k}") != v, f"count_{k}", c(f"n_{k}"), v) for k, v in expected.items()]
    checks += [_row(c("objects") < rules.minimum_unique_objects, "unique_objects", c("objects"), rules.minimum_unique_objects), _row(c("uses") > rules.maximum_object_uses, "object_uses", c("uses"), rules.maximum_object_uses)]
    return _explode(joined, F.lit(None).cast("string"), checks, scene)


def duplicate_violations(manifest: DataFrame, scene: str = "scene") -> DataFrame:
    """Repeated pair ids and repeated unordered pairs of objects within a scene."""
    ids = manifest.groupBy(F.col(scene).alias("scene"), "pair_id").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = manifest.groupBy(F.col(scene).alias("scene"), unordered_pair(F.col("object_a"), F.col("object_b")).alias("pair")).agg(F.count("*").alias("n")).filter("n > 1")
    relations = pairs.groupBy("scene").agg(F.count("*").alias("n"))
    return ids.select("scene", "pair_id", F.lit("duplicate_pair_id").alias("rule"), _text(F.col("n")).alias("observed"), F.lit("1").alias("expected")).unionByName(
        relations.select("scene", F.lit(None).cast("string").alias("pair_id"), F.lit("duplicate_object_pair").alias("rule"), _text(F.col("n")).alias("observed"), F.lit("0").alias("expected")))


def manifest_violations(manifest: DataFrame, rules: ManifestRules = ManifestRules(), scene: str = "scene") -> DataFrame:
    return reduce(DataFrame.unionByName, (pair_violations(manifest, rules, scene), scene_violations(manifest, rules, scene), duplicate_violations(manifest, scene)))


def query_manifest_violations(manifest: DataFrame, pairs: int | None = None) -> DataFrame:
    """pair_id, scene_id, fold, stimulus, ground_truth_m and prompt are there, in range and unique."""
    c = F.col
    blank = lambda name: ~F.coalesce(c(name).rlike(r"(?U)\S"), F.lit(False))
    checks = [_row(blank(x), f"missing_{x}", c(x), "text") for x in ("pair_id", "scene_id", "stimulus", "prompt")]
    checks += [_row(~F.coalesce(c("fold").isin("A", "B"), F.lit(False)), "invalid_fold", c("fold"), "A or B"), _row(~finite_number(c("ground_truth_m")) | (c("ground_truth_m") <= 0), "invalid_ground_truth", c("ground_truth_m"), "> 0")]
    rows = _explode(manifest, c("pair_id"), checks, "scene_id")
    again = manifest.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("scene_id").alias("scene")).filter("n > 1").select("scene", "pair_id", F.lit("duplicate_pair_id").alias("rule"), _text(c("n")).alias("observed"), F.lit("1").alias("expected"))
    found = rows.unionByName(again)
    if pairs is not None:
        total = manifest.agg(F.count("*").alias("n")).filter(c("n") != pairs).select(F.lit(None).cast("string").alias("scene"), F.lit(None).cast("string").alias("pair_id"), F.lit("pair_count").alias("rule"), _text(c("n")).alias("observed"), _text(pairs).alias("expected"))
        found = found.unionByName(total)
    return found


def missing_required(rows: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, field) for every required field that is null; fields absent from the schema count for all rows."""
    empty = [F.when(F.col(f).isNull(), F.lit(f)) if f in rows.columns else F.lit(f) for f in fields]
    return rows.select(key, F.explode(F.array_compact(F.array(*empty))).alias("field"))


def not_contiguous(rows: DataFrame, index: str, group: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose index is not their place, counted from 1 in order of the index and then ``ties``; without a group over the whole table, by ranges."""
    if group:
        placed = rows.withColumn("expected_index", F.row_number().over(Window.partitionBy(*group).orderBy(index, *ties)))
    else:
        placed = number_rows(rows, [index, *ties]).withColumnRenamed("run_index", "expected_index")
    return placed.filter(~F.col(index).eqNullSafe(F.col("expected_index")))


def protocol_violations(manifest: DataFrame, protocol: dict, sha256: str, scene: str = "scene") -> DataFrame:
    """(rule, observed, expected) where a protocol's digest or counts are not the manifest's; names that it lacks, and counts that are no whole numbers, are not checked."""
    counts = manifest.agg(F.count_distinct(scene).alias("scenes"), F.count("*").alias("pairs"))
    checks = [(k, F.lit(sha256), F.lit(str(protocol[k]))) for k in ("output_sha256", "manifest_sha256") if k in protocol]
    for names, own in ((("number_of_scenes", "selected_scenes"), "scenes"), (("number_of_pairs", "selected_pairs"), "pairs")):
        checks += [(k, F.col(own).cast("string"), F.lit(str(protocol[k]))) for k in names if isinstance(protocol.get(k), int)]
    rows = [F.struct(F.lit(k).alias("rule"), observed.alias("observed"), expected.alias("expected")) for k, observed, expected in checks]
    empty = F.array().cast("array<struct<rule:string,observed:string,expected:string>>")
    return counts.select(F.inline(F.array(*rows) if rows else empty)).filter("observed <> expected")


def metric(rows: DataFrame, *names: str, nested: str = "pair_quality") -> Column:
    """The first of several names under which a value may stand: within the nested record first, then beside it; null if there is none."""
    kind = rows.schema[nested].dataType if nested in rows.columns else None
    inner = [F.col(f"{nested}.{n}") for n in names if kind is not None and n in kind.fieldNames()]
    found = inner + [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None)


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy")) -> dict[str, str]:
    """The driver's versions and machine; 'not installed' for packages that are not there."""
    from importlib.metadata import PackageNotFoundError, version

    def of(package: str) -> str:
        try:
            return version(package)
        except PackageNotFoundError:
            return "not installed"

    return {p: of(p) for p in packages} | {"python": platform.python_version(), "architecture": platform.machine()}


def environment_violations(expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(name, observed, expected) where this environment is not the recorded one; an empty expectation is not checked."""
    own = environment(tuple(k for k in expected if k not in ("python", "architecture")))
    return [(k, own[k], v) for k, v in expected.items() if v and own[k] != v]
