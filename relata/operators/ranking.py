"""Frame ranking: eligibility, sharpness cut, best frames per part of a capture, shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.quantiles import exact_quantiles
from relata.params import RankRules


def rank_order() -> list[Column]:
    return [F.desc("natural_interior"), F.desc("natural"), F.desc("oracle"), F.desc("sharpness"), F.asc("frame_index"), F.asc("image_member")]


def eligible(frames: DataFrame, rules: RankRules = RankRules()) -> DataFrame:
    return frames.filter((F.col("oracle") >= rules.minimum_oracle) & (F.col("natural") >= rules.minimum_natural) & (F.col("natural_interior") >= rules.minimum_natural_interior))


def cutoffs(frames: DataFrame, rules: RankRules = RankRules(), capture: str = "capture_id") -> DataFrame:
    """Per capture: the exact linear quantile of sharpness over its eligible frames, and their number."""
    return exact_quantiles(eligible(frames, rules), [capture], "sharpness", rules.sharpness_quantile, "capture_sharpness_cutoff", [F.count("*").alias("capture_eligible_frames")])


def sharp_frames(frames: DataFrame, rules: RankRules = RankRules(), capture: str = "capture_id") -> DataFrame:
    """Eligible frames at or above their capture's cutoff, with the capture's counts."""
    cut = eligible(frames, rules).join(cutoffs(frames, rules, capture), capture).filter("sharpness >= capture_sharpness_cutoff")
    return cut.withColumn("capture_high_sharpness_frames", F.count("*").over(Window.partitionBy(capture)))


def shortlist(frames: DataFrame, rules: RankRules = RankRules(), capture: str = "capture_id", order: list[Column] | None = None) -> DataFrame:
    """The best ``per_bin`` frames of each temporal bin, of these the best ``per_capture``; adds candidate_rank and selected_by_frame_rule.  None stands for all."""
    order = order or rank_order()
    found = sharp_frames(frames, rules, capture)
    if rules.per_bin is not None:
        found = found.withColumn("__rank", F.row_number().over(Window.partitionBy(capture, "temporal_bin").orderBy(*order))).filter(F.col("__rank") <= rules.per_bin).drop("__rank")
    found = found.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(capture).orderBy(*order)))
    if rules.per_capture is not None:
        found = found.filter(F.col("candidate_rank") <= rules.per_capture)
    return found.withColumn("selected_by_frame_rule", F.col("candidate_rank") == 1)


def capture_summary(frames: DataFrame, rules: RankRules = RankRules(), capture: str = "capture_id") -> DataFrame:
    """One row per capture, also of those without an eligible frame (zeros, a null cutoff and no bins).

    Frames are counted by capture once, and the sharp ones by part of the
    capture once; the shortlist's size follows from the parts' counts.
    """
    good = (F.col("oracle") >= rules.minimum_oracle) & (F.col("natural") >= rules.minimum_natural) & (F.col("natural_interior") >= rules.minimum_natural_interior)
    told = frames.withColumns({"good": good, "good_sharpness": F.when(good, F.col("sharpness"))})
    counted = exact_quantiles(told, [capture], "good_sharpness", rules.sharpness_quantile, "sharpness_cutoff", [F.count("*").alias("audited_frames"), F.count_if("good").alias("eligible_frames")])
    sharp = eligible(frames, rules).join(counted.select(capture, "sharpness_cutoff"), capture).filter("sharpness >= sharpness_cutoff")
    by_bin = sharp.groupBy(capture, "temporal_bin").agg(F.count("*").alias("n"))
    kept = F.col("n") if rules.per_bin is None else F.least("n", F.lit(rules.per_bin))
    listed = F.sum(kept) if rules.per_capture is None else F.least(F.sum(kept), F.lit(rules.per_capture))
    found = by_bin.groupBy(capture).agg(F.sum("n").alias("high_sharpness_frames"), F.sort_array(F.collect_set("temporal_bin")).alias("temporal_bins_represented"), listed.alias("shortlist_size"))
    return counted.join(found, capture, "left").select(
        capture, "audited_frames", "eligible_frames", "sharpness_cutoff",
        F.coalesce("high_sharpness_frames", F.lit(0)).alias("high_sharpness_frames"), F.coalesce("temporal_bins_represented", F.array().cast("array<int>")).alias("temporal_bins_represented"), F.coalesce("shortlist_size", F.lit(0)).alias("shortlist_size"),
    )


def exclude(frames: DataFrame, excluded: DataFrame, capture: str = "capture_id") -> DataFrame:
    return frames.join(excluded, capture, "left_anti")


def unknown_exclusions(frames: DataFrame, excluded: DataFrame, capture: str = "capture_id") -> DataFrame:
    return excluded.join(frames, capture, "left_anti")


def selected_only(frames: DataFrame) -> DataFrame:
    return frames.filter(F.coalesce("selected_by_frame_rule", F.lit(False)))
