"""Balanced selection of pairs per scene: equal-count distance strata, best pair of each cell, folds, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions.text import pair_id
from relata.operators.pairs import FRAME
from relata.params import STRATUM_NAMES, SceneRules

PAIR_ORDER = ("distance_m", "first_instance_index", "second_instance_index")


def quality_order() -> list[Column]:
    return [F.desc("minimum_box_area_px2"), F.desc("box_center_distance_px"), F.asc("box_iou"), F.asc("intersection_over_smaller_box"), F.desc("both_interior"), F.asc("first_instance_index"), F.asc("second_instance_index")]


def best_frame(counts: DataFrame, capture: str = "capture_id", count: str = "pair_count") -> DataFrame:
    """Per capture the frame with most pairs; ties go to the better rank, then the earlier frame."""
    order = Window.partitionBy(capture).orderBy(F.desc(count), "candidate_rank", "frame_index")
    return counts.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def selection_pool(pairs: DataFrame, rules: SceneRules = SceneRules(), scene: tuple[str, ...] = FRAME) -> DataFrame:
    """Interior pairs where a scene has enough of them, else all; scenes with too few pairs are left out."""
    over = Window.partitionBy(*scene)
    counted = pairs.withColumns({"hard_filter_pairs": F.count("*").over(over), "interior_filter_pairs": F.count_if("both_interior").over(over)})
    enough = F.col("interior_filter_pairs") >= rules.pairs_per_scene
    policy = F.when(enough, "interior_only").otherwise("full_visible_fallback")
    return counted.filter(F.col("hard_filter_pairs") >= rules.pairs_per_scene).withColumn("interior_policy", policy).filter(~enough | F.col("both_interior"))


def stratify(pool: DataFrame, rules: SceneRules = SceneRules(), scene: tuple[str, ...] = FRAME, order: tuple[str, ...] = PAIR_ORDER) -> DataFrame:
    """Adds stratum and cell: equal-count parts by distance (earlier parts take the remainder), and equal-count parts of each."""
    strata = pool.withColumn("distance_stratum_index", F.ntile(rules.distance_strata).over(Window.partitionBy(*scene).orderBy(*order)))
    per = rules.pairs_per_scene // rules.distance_strata
    return strata.withColumn("cell", F.ntile(per).over(Window.partitionBy(*scene, "distance_stratum_index").orderBy(*order)))


def select_balanced(pairs: DataFrame, rules: SceneRules = SceneRules(), scene: tuple[str, ...] = FRAME, order: tuple[str, ...] = PAIR_ORDER, quality: list[Column] | None = None, scene_name: str = "capture_id") -> DataFrame:
    """The selected pairs of every scene with their stratum, positions, fold and pair_id."""
    cells = stratify(selection_pool(pairs, rules, scene), rules, scene, order)
    best = cells.withColumn("__rank", F.row_number().over(Window.partitionBy(*scene, "distance_stratum_index", "cell").orderBy(*(quality or quality_order())))).filter("__rank = 1").drop("__rank")
    placed = best.withColumn("within_stratum_index", F.row_number().over(Window.partitionBy(*scene, "distance_stratum_index").orderBy(*order)))
    placed = placed.withColumn("pair_index", F.row_number().over(Window.partitionBy(*scene).orderBy("distance_stratum_index", *order)))
    names = F.array(*map(F.lit, STRATUM_NAMES[: rules.distance_strata]))
    return placed.withColumns({
        "distance_stratum": F.get(names, F.col("distance_stratum_index") - 1),
        "fold": F.when(F.col("pair_index") % 2 == 1, "A").otherwise("B"),
        "pair_id": pair_id(F.col(scene_name).cast("string"), F.col("pair_index")),
    })


def stratum_summary(cells: DataFrame, selected: DataFrame, scene: tuple[str, ...] = FRAME) -> DataFrame:
    key = [*scene, "distance_stratum_index"]
    given = cells.groupBy(*key).agg(F.count("*").alias("candidate_pairs"), F.min("distance_m").alias("candidate_minimum_m"), F.max("distance_m").alias("candidate_maximum_m"))
    chosen = selected.groupBy(*key).agg(F.min("distance_m").alias("selected_minimum_m"), F.max("distance_m").alias("selected_maximum_m"))
    return given.join(chosen, key)


def object_usage(selected: DataFrame, scene: tuple[str, ...] = FRAME) -> DataFrame:
    """Uses of each object over both sides of the pairs."""
    return selected.select(*scene, F.explode(F.array("first_instance_index", "second_instance_index")).alias("instance_index")).groupBy(*scene, "instance_index").agg(F.count("*").alias("uses"))


def scene_summary(selected: DataFrame, scene: tuple[str, ...] = FRAME) -> DataFrame:
    used = object_usage(selected, scene).groupBy(*scene).agg(F.count("*").alias("unique_objects_used"), F.max("uses").alias("maximum_object_uses"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("instance_index").cast("string"), "uses")))).alias("object_usage"))
    stats = selected.groupBy(*scene).agg(
        F.count("*").alias("selected_pairs"), F.min("distance_m").alias("selected_minimum_m"), F.max("distance_m").alias("selected_maximum_m"), F.count_if("both_interior").alias("selected_interior_pairs"),
        F.max("hard_filter_pairs").alias("hard_filter_pairs"), F.max("interior_filter_pairs").alias("interior_filter_pairs"), F.max("interior_policy").alias("interior_policy"),
    )
    return stats.join(used, list(scene))


def rejection_reasons(rules: SceneRules = SceneRules()) -> Column:
    """Why a scene summary is not accepted; an empty array if it is.  A ratio that is no finite number fails."""
    ratio = F.when(F.col("selected_minimum_m") > 0, F.col("selected_maximum_m") / F.col("selected_minimum_m"))
    return F.array_compact(F.array(
        F.when(F.col("unique_objects_used") < rules.minimum_unique_objects, F.lit("minimum_unique_objects")),
        F.when(F.col("maximum_object_uses") > rules.maximum_uses_per_object, F.lit("maximum_uses_per_object")),
        F.when(~F.coalesce((ratio >= rules.minimum_distance_ratio) & (ratio < float("inf")), F.lit(False)), F.lit("minimum_distance_ratio")),
        F.when(F.col("selected_interior_pairs") != rules.pairs_per_scene, F.lit("both_objects_interior")),
    ))


def decide(captures: DataFrame, counts: DataFrame, summaries: DataFrame, rules: SceneRules = SceneRules(), capture: str = "capture_id") -> DataFrame:
    """One decision per capture: without candidates, with too few pairs, or by the selection's summary."""
    best = best_frame(counts, capture)
    reasons = rejection_reasons(rules)
    summed = summaries.withColumn("__reasons", reasons).select(capture, "__reasons")
    joined = captures.join(counts.groupBy(capture).agg(F.count("*").alias("candidate_frames")), capture, "left").join(best.select(capture, F.col("candidate_rank").alias("best_candidate_rank"), F.col("frame_index").alias("best_frame_index"), F.col("pair_count").alias("best_strict_pair_count")), capture, "left").join(summed, capture, "left")
    why = F.when(F.col("candidate_frames").isNull(), F.array(F.lit("no_frame_candidates"))).when(F.col("best_strict_pair_count") < rules.pairs_per_scene, F.array(F.lit("minimum_eligible_pairs"))).otherwise(F.coalesce("__reasons", F.array().cast("array<string>")))
    return joined.fillna(0, ["candidate_frames", "best_strict_pair_count"]).withColumn("rejection_reasons", why).withColumn("accepted", F.size("rejection_reasons") == 0).drop("__reasons")
