"""Threshold grids: legibility sweeps over pairs and rule grids over instances.

Grids are small fixed tables of parameters.  Pairs are counted for all
configurations in one pass over each frame's pairs.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import predicates as P
from relata.operators import audit
from relata.params import AuditRules

# The levels of the legibility grid, 64 configurations.
AREA_LEVELS = (0.00125, 0.0025, 0.00375, 0.005)
SIDE_LEVELS = (20.0, 30.0, 40.0, 50.0)
BORDER_LEVELS = (5.0, 10.0, 15.0, 20.0)
MAX_GRID = 10_000


def legibility_grid(spark, areas=AREA_LEVELS, sides=SIDE_LEVELS, borders=BORDER_LEVELS) -> DataFrame:
    rows = [tuple(map(float, r)) for r in product(areas, sides, borders)]
    if len(rows) > MAX_GRID:
        raise ValueError("a grid is too large to broadcast")
    return spark.createDataFrame(rows, "area double, side double, border double")


def sweep_counts(pairs: DataFrame, grid: DataFrame, candidates: DataFrame, frame: tuple[str, ...] = ("capture_id", "frame_index")) -> DataFrame:
    """Pairs of each candidate frame that pass each configuration, 0 where none does.  The grid (bounded by ``MAX_GRID`` rows) is broadcast.

    candidates: the frame's key and candidate_rank, each once; frames without any pair count too.
    """
    passes = (F.col("minimum_box_area_fraction") >= F.col("area")) & (F.col("minimum_box_side_px") >= F.col("side")) & (F.col("minimum_border_margin_px") >= F.col("border"))
    narrow = candidates.select(*frame, "candidate_rank").join(pairs.select(*frame, "minimum_box_area_fraction", "minimum_box_side_px", "minimum_border_margin_px"), list(frame), "left")
    return narrow.crossJoin(F.broadcast(grid)).groupBy(*frame, "candidate_rank", "area", "side", "border").agg(F.count_if(passes).alias("pair_count"))


def sweep_best(counts: DataFrame, capture: str = "capture_id", order: tuple[str, ...] = ("candidate_rank", "frame_index")) -> DataFrame:
    """Per configuration and capture the frame with most pairs, the better ranked one first."""
    rank = F.row_number().over(Window.partitionBy("area", "side", "border", capture).orderBy(F.desc("pair_count"), *order))
    return counts.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def sweep_summary(best: DataFrame, minimum_pairs: int = 12) -> DataFrame:
    """Per configuration: captures that stay feasible and the smallest best count."""
    return best.groupBy("area", "side", "border").agg(F.count_if(F.col("pair_count") >= minimum_pairs).alias("feasible_captures"), F.min("pair_count").alias("minimum_best_pair_count"), F.sum("pair_count").alias("total_best_pairs"))


def strictest_feasible(summary: DataFrame, top: int = 12) -> DataFrame:
    """Configurations that keep most captures, the strictest first (border, side, area, then support)."""
    most = summary.agg(F.max("feasible_captures").alias("__most"))
    kept = summary.crossJoin(F.broadcast(most)).filter("feasible_captures = __most").drop("__most")  # one row is broadcast
    return kept.orderBy(F.desc("border"), F.desc("side"), F.desc("area"), F.desc("minimum_best_pair_count")).limit(top)


BOX_FIELDS = ("box_2d_rend", "box_2d_proj")
SCOPES = ("all", "geometric", "oracle")
MODES = ("box", "center")
PIPELINES = ("subset", "recompute")
# The margins that are tried, as fractions of the image and in pixels.
FRACTIONS = (0.025, 0.05, 0.075, 0.10, 0.125, 0.15)
PIXELS = (10.0, 20.0, 25.0, 30.0, 40.0, 50.0)


def rule_counts(instances: DataFrame, fractions: tuple[float, ...] = FRACTIONS, pixels: tuple[float, ...] = PIXELS, rules: AuditRules = AuditRules(), frame: tuple[str, ...] = audit.FRAME) -> DataFrame:
    """Frame counts under every rule configuration: box, scope, caption rule, interior mode, pipeline and margin.

    All configurations are read off the counts of one category in one frame, so
    instances are aggregated once for each box and never multiplied by the
    margins.  An instance is alone in its category under a scope if the
    category counts 1 there; where it is recomputed, among the valid instances
    inside the margin.
    """
    margins = [("fraction", float(m)) for m in fractions] + [("pixels", float(m)) for m in pixels]
    inner = [(mode, kind, m) for mode in MODES for kind, m in margins]
    if len(BOX_FIELDS) * len(SCOPES) * 2 * len(PIPELINES) * len(inner) > MAX_GRID:
        raise ValueError("too many configurations")
    size, c = (F.col("width"), F.col("height")), F.col
    flagged = instances.withColumns({"geometric": P.geometric_valid(c("position"), c("scale"), c("corners")), "category_key": P.normalized_category(c("category"))})
    boxes = F.array(*(F.struct(F.lit(b).alias("box_field"), c(b).alias("box")) for b in BOX_FIELDS))
    wide = flagged.select(*frame, "width", "height", "geometric", "category_key", F.coalesce(c("caption").rlike(r"(?U)\S"), F.lit(False)).alias("captioned"), F.inline(boxes)).withColumn("oracle", P.oracle_valid(c("geometric"), c("box"), *size, rules))
    inside = [c("oracle") & P.interior_valid(c("box"), *size, m, mode, kind) for mode, kind, m in inner]
    alone = wide.select("*", F.array(*inside).alias("inside")).groupBy(*frame, "box_field", "category_key").agg(
        F.count("*").alias("all"), F.count_if("geometric").alias("geometric"), F.count_if("oracle").alias("oracle"), F.count_if(c("oracle") & c("captioned")).alias("oracle_captioned"),
        *(F.count_if(c("inside")[k]).alias(f"in_{k}") for k in range(len(inner))), *(F.count_if(c("inside")[k] & c("captioned")).alias(f"in_captioned_{k}") for k in range(len(inner))),
    )
    known = audit.named(rules)
    once = lambda scope, n: F.sum(F.when(known & (c(scope) == 1), c(n)).otherwise(0))
    ways = {f"{s}_{caption}": (s, "_captioned" * caption) for s in SCOPES for caption in (False, True)}
    sums = alone.groupBy(*frame, "box_field").agg(
        *(F.sum(n).alias(f"n_{n}") for n in SCOPES), *(once(s, f"oracle{t}").alias(f"natural_{w}") for w, (s, t) in ways.items()),
        *(F.array(*(once(s, f"in{t}_{k}") for k in range(len(inner)))).alias(f"subset_{w}") for w, (s, t) in ways.items()),
        *(F.array(*(once(f"in_{k}", f"in{t}_{k}") for k in range(len(inner)))).alias(f"recompute_{caption}") for caption, t in ((False, ""), (True, "_captioned"))),
    )
    config = F.array(*(
        F.struct(F.lit(s).alias("scope"), F.lit(caption).alias("caption_required"), F.lit(pipeline).alias("pipeline"), c(f"natural_{s}_{caption}").alias("natural"), c(f"subset_{s}_{caption}" if pipeline == "subset" else f"recompute_{caption}").alias("interior"))
        for s in SCOPES for caption in (False, True) for pipeline in PIPELINES
    ))
    margin = F.array(*(F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("margin_kind"), F.lit(m).alias("margin")) for mode, kind, m in inner))
    per_rule = sums.select(*frame, "box_field", c("n_all").alias("total"), c("n_geometric").alias("geometric"), c("n_oracle").alias("oracle"), F.inline(config))
    found = per_rule.select("*", F.inline(F.arrays_zip(margin.alias("at"), c("interior").alias("natural_interior"))))
    return found.select(*frame, "box_field", "scope", "caption_required", "at.mode", "pipeline", "at.margin_kind", "at.margin", "total", "geometric", "oracle", "natural", "natural_interior")


def config_matches(counts: DataFrame, reference: DataFrame, frame: tuple[str, ...] = audit.FRAME) -> DataFrame:
    """Per configuration: in how many frames each count, and all counts, equal the reference's."""
    names = ("total", "geometric", "oracle", "natural", "natural_interior")
    config = [c for c in counts.columns if c not in (*frame, *names)]
    joined = counts.alias("a").join(reference.select(*frame, *names).alias("b"), list(frame))
    same = {c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names}
    every = same["total"] & same["geometric"] & same["oracle"] & same["natural"] & same["natural_interior"]
    return joined.groupBy(*config).agg(*(F.count_if(v).alias(f"{k}_matches") for k, v in same.items()), F.count_if(every).alias("all_matches"))
