"""Object pairs of a frame: construction, geometry, thresholds, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions import geometry as G
from relata.operators.quantiles import exact_quantiles
from relata.params import PairRules
from relata.storage import materialize

FRAME = ("capture_id", "frame_index")
CROWDED, BLOCK = 1024, 256
VISIBILITY_LEVELS = (0.8, 0.9, 1.0)
IOU_LEVELS = (0.25, 0.5)
SMALLER_LEVEL = 0.8


def object_records(flagged: DataFrame, box: str = "box_2d_rend") -> DataFrame:
    """Natural instances with the measures pairs need."""
    b, w, h = F.col(box), F.col("width"), F.col("height")
    return flagged.filter("natural").withColumns({
        "box_area_px2": G.area(b), "visible_fraction": G.visible_fraction(b, w, h), "area_fraction": G.area_fraction(b, w, h),
        "side_px": G.shorter_side(b), "margin_px": G.border_margin(b, w, h),
    })


def _within_frames(a: DataFrame, b: DataFrame, objects: DataFrame, frame: list[str], crowd: int, block: int) -> DataFrame:
    """a joined with b, two forms of ``objects``, where both are of one frame and a's index is the smaller one."""
    ordered = F.col("first_instance_index") < F.col("second_instance_index")
    found = objects.groupBy(*frame).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*frame, F.ceil(F.col("n") / block).cast("int").alias("__blocks"))
    if found.isEmpty():
        return a.join(b, frame).filter(ordered)
    crowded = materialize(found, "crowded-frames", rows=0)
    own = lambda x, index: x.join(crowded, frame).withColumn("__block", F.pmod(F.xxhash64(index), F.col("__blocks")).cast("int"))
    last = F.col("__blocks") - 1
    # Tile (x, y) has the pairs whose first object is of block x and whose second one is of block y.
    first = own(a, "first_instance_index").select(*a.columns, F.col("__block").alias("__x"), F.explode(F.sequence(F.lit(0), last)).alias("__y"))
    second = own(b, "second_instance_index").select(*b.columns, F.explode(F.sequence(F.lit(0), last)).alias("__x"), F.col("__block").alias("__y"))
    tiled = first.join(second, [*frame, "__x", "__y"]).filter(ordered).drop("__x", "__y")
    rest = a.join(crowded, frame, "left_anti").join(b, frame).filter(ordered)
    return rest.unionByName(tiled.select(*rest.columns))


def build_pairs(objects: DataFrame, frame: tuple[str, ...] = FRAME, box: str = "box_2d_rend", crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """All pairs of a frame's objects, the one with the smaller instance_index first.

    The objects' columns are carried through the join, so measures need no
    second lookup.  The join is by frame, with the order as its residual
    condition: only pairs inside one frame are ever formed.  The objects of a
    frame with more than ``crowded`` are dealt to blocks, and each two blocks
    (and each with itself) are a key of their own, so the frame's pairs spread
    over the tasks and no task holds its objects.
    """
    own = ["instance_index", "instance_id", "category", "position", box, "box_area_px2", "visible_fraction", "interior", "area_fraction", "side_px", "margin_px"]
    own = [c for c in own if c in objects.columns]
    a = objects.select(*frame, *(F.col(c).alias(f"first_{c}") for c in own))
    b = objects.select(*frame, *(F.col(c).alias(f"second_{c}") for c in own))
    joined = _within_frames(a, b, objects, list(frame), crowded, block)
    one, two = F.col(f"first_{box}"), F.col(f"second_{box}")
    least = lambda c: G.both(F.col(f"first_{c}"), F.col(f"second_{c}"))
    measures = {
        "distance_m": G.euclidean(F.col("first_position"), F.col("second_position")),
        "minimum_visible_fraction": least("visible_fraction"), "both_interior": F.col("first_interior") & F.col("second_interior"),
        "box_iou": G.iou(one, two), "intersection_over_smaller_box": G.intersection_over_smaller(one, two),
        "minimum_box_area_px2": least("box_area_px2"), "box_center_distance_px": G.center_distance(one, two),
        "minimum_box_area_fraction": least("area_fraction"), "minimum_box_side_px": least("side_px"), "minimum_border_margin_px": least("margin_px"),
    }
    return joined.withColumns(measures)


def hard_filter(rules: PairRules = PairRules()) -> Column:
    """The hard pair filter; thresholds are compared exactly."""
    c = F.col
    tests = [(c("distance_m") >= rules.minimum_distance_m), (c("minimum_visible_fraction") >= rules.minimum_visible_fraction), (c("box_iou") <= rules.maximum_box_iou), (c("intersection_over_smaller_box") <= rules.maximum_intersection_over_smaller)]
    for name in ("minimum_box_area_fraction", "minimum_box_side_px", "minimum_border_margin_px"):
        if (least := getattr(rules, name)) is not None:
            tests.append(c(name) >= least)
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return out


def strict_filter(rules: PairRules = PairRules()) -> Column:
    return hard_filter(rules) & F.col("both_interior")


def threshold_counts(pairs: DataFrame, group: tuple[str, ...] = FRAME, minimum_distance_m: float = 0.25) -> DataFrame:
    """Per frame: pairs at each visibility and overlap level, in long form in two maps."""
    far = pairs.withColumn("eligible", F.col("distance_m") >= minimum_distance_m)
    visible = {f"{v:g}": F.col("minimum_visible_fraction") >= v for v in VISIBILITY_LEVELS}
    overlap = {f"iou<={v:g}": F.col("box_iou") <= v for v in IOU_LEVELS} | {f"smaller<={SMALLER_LEVEL:g}": F.col("intersection_over_smaller_box") <= SMALLER_LEVEL}
    overlap["combined"] = (F.col("minimum_visible_fraction") >= 1) & (F.col("box_iou") <= 0.5) & (F.col("intersection_over_smaller_box") <= SMALLER_LEVEL)
    as_map = lambda tests: F.create_map(*(x for k, t in tests.items() for x in (F.lit(k), F.count_if(F.col("eligible") & t))))
    return far.groupBy(*group).agg(
        F.count("*").alias("number_of_all_natural_pairs"), F.count_if("eligible").alias("number_of_eligible_pairs"), F.count_if(F.col("eligible") & F.col("both_interior")).alias("number_of_interior_eligible_pairs"),
        as_map(visible).alias("eligible_pairs_by_visibility"), as_map(overlap).alias("eligible_pairs_by_overlap"),
    )


def distance_summary(pairs: DataFrame, group: tuple[str, ...] = FRAME) -> DataFrame:
    """min, median and max distance; null where there is no pair."""
    return exact_quantiles(pairs, list(group), "distance_m", 0.5, "median_m", [F.min("distance_m").alias("min_m"), F.max("distance_m").alias("max_m")])


def feasibility(candidates: DataFrame, objects: DataFrame, minimum_distance_m: float = 0.25, minimum_pairs: int = 12, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """Candidates with their objects, counts, distance summary and eligible pairs nested, as one document per frame."""
    pairs = build_pairs(objects, frame)
    counts, far = threshold_counts(pairs, frame, minimum_distance_m), pairs.filter(F.col("distance_m") >= minimum_distance_m)
    summary = far.groupBy(*frame).agg(F.struct(F.min("distance_m").alias("min_m"), F.percentile("distance_m", F.lit(0.5)).alias("median_m"), F.max("distance_m").alias("max_m")).alias("eligible_distance_summary"))
    keep = [c for c in far.columns if c not in frame]
    nested = far.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("first_instance_index", "second_instance_index", *(c for c in keep if c not in ("first_instance_index", "second_instance_index"))))).alias("eligible_pairs"))
    listed = objects.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("instance_index", *(c for c in objects.columns if c not in (*frame, "instance_index"))))).alias("natural_objects"))
    out = candidates
    for part in (listed, counts, summary, nested):
        out = out.join(part, list(frame), "left")
    zero = {c: 0 for c in ("number_of_all_natural_pairs", "number_of_eligible_pairs", "number_of_interior_eligible_pairs")}
    return out.fillna(zero).withColumn("basic_pair_feasible", F.col("number_of_eligible_pairs") >= minimum_pairs)


def count_conflicts(candidates: DataFrame, recomputed: DataFrame, fields: list[str], frame: tuple[str, ...] = FRAME) -> DataFrame:
    """(frame, field, stored, recomputed) where counts stored with a candidate differ from recomputed ones."""
    joined = candidates.alias("a").join(recomputed.alias("b"), list(frame))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("long").alias("stored"), F.col(f"b.{f}").cast("long").alias("recomputed")) for f in fields))
    return joined.select(*frame, F.inline(rows)).filter("not (stored <=> recomputed)")
