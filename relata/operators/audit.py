"""Instance audits: which annotated objects of a frame are usable, and how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import predicates as P
from relata.params import AuditRules

FRAME = ("capture_id", "frame_index")
TEMPORAL_BINS = 5


def explode_instances(frames: DataFrame, instances: str = "instances") -> DataFrame:
    """One row per instance; instance_index counts array positions from 1.  Frames without instances give none."""
    kept = [c for c in frames.columns if c != instances]
    return frames.select(*kept, F.posexplode(instances).alias("at", "i")).select(*kept, (F.col("at") + 1).alias("instance_index"), "i.*")


def alike(counted: Column | None = None, frame: tuple[str, ...] = FRAME, key: str = "category_key") -> Column:
    """How many instances of the frame have the row's category, or how many of them that count."""
    return F.count_if(F.lit(True) if counted is None else counted).over(Window.partitionBy(*frame, key))


def named(rules: AuditRules = AuditRules()) -> Column:
    """A category that names something: neither empty nor generic."""
    key = F.col("category_key")
    return (key != "") & ~key.isin(*rules.generic_categories) if rules.generic_categories else key != ""


def flag_instances(instances: DataFrame, rules: AuditRules = AuditRules(), frame: tuple[str, ...] = FRAME) -> DataFrame:
    """Adds geometric, oracle, natural, interior and natural_interior.

    Uniqueness of a category is counted over all instances of the frame (or
    those of ``rules.uniqueness_scope``), valid or not, before anything is
    filtered, so all flags come from one shuffle by frame.
    """
    box, width, height = F.col(rules.box_field), F.col("width"), F.col("height")
    geometric = P.geometric_valid(F.col("position"), F.col("scale"), F.col("corners"))
    flagged = instances.withColumns({"geometric": geometric, "category_key": P.normalized_category(F.col("category"))})
    flagged = flagged.withColumn("oracle", P.oracle_valid(F.col("geometric"), box, width, height, rules))
    counted = {"all": F.lit(True), "geometric": F.col("geometric"), "oracle": F.col("oracle")}[rules.uniqueness_scope]
    natural = F.col("oracle") & named(rules) & (alike(counted, frame) == 1)
    if rules.caption_required:
        natural &= F.coalesce(F.col("caption").rlike(r"(?U)\S"), F.lit(False))
    interior = P.interior_valid(box, width, height, rules.border_margin_px, rules.interior_mode, rules.margin_kind)
    return flagged.withColumns({"natural": natural, "interior": interior}).withColumn("natural_interior", F.col("natural") & F.col("interior"))


def audit_counts(flagged: DataFrame, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """total, geometric, oracle, natural and natural_interior per frame."""
    return flagged.groupBy(*frame).agg(F.count("*").alias("total"), *(F.count_if(c).alias(c) for c in ("geometric", "oracle", "natural", "natural_interior")))


def audit_frames(frames: DataFrame, rules: AuditRules = AuditRules(), frame: tuple[str, ...] = FRAME) -> DataFrame:
    """Audit rows of all frames, those without instances counted as zero."""
    counts = audit_counts(flag_instances(explode_instances(frames), rules, frame), frame)
    names = ("total", "geometric", "oracle", "natural", "natural_interior")
    return frames.drop("instances").join(counts, list(frame), "left").fillna(0, list(names))


def frame_index(frames: DataFrame, capture: str = "capture_id", order: tuple[str, ...] = ("image_member",)) -> DataFrame:
    """Adds frame_index, from 0 in order within a capture."""
    return frames.withColumn("frame_index", F.row_number().over(Window.partitionBy(capture).orderBy(*order)) - 1)


def temporal_bin(index: Column, frames: Column, bins: int = TEMPORAL_BINS) -> Column:
    """1 to ``bins``: which part of its capture a frame stands in; ``frames`` is the full number of frames."""
    return F.least(F.lit(bins), F.floor(index * bins / frames).cast("int") + 1)


def add_temporal_bin(frames: DataFrame, capture: str = "capture_id", bins: int = TEMPORAL_BINS, limit: int | None = None) -> DataFrame:
    """Adds temporal_bin; a limit on frames per capture applies after the bins are set."""
    binned = frames.withColumn("temporal_bin", temporal_bin(F.col("frame_index"), F.count("*").over(Window.partitionBy(capture)), bins))
    return binned if limit is None else binned.filter(F.col("frame_index") < limit)


def frames_with_both(members: DataFrame, first: str = "instances.json", second: str = "image.png") -> DataFrame:
    """(capture_id, frame) of the archive folders that hold both files. members: capture_id, path."""
    split = members.select("capture_id", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("frame"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    wanted = split.filter(F.col("name") == first).select("capture_id", "frame")
    return wanted.join(split.filter(F.col("name") == second), ["capture_id", "frame"], "left_semi")


def audit_mismatches(generated: DataFrame, reference: DataFrame, fields: list[str], key: tuple[str, ...] = ("capture_id", "instance_member"), require_complete: bool = True) -> DataFrame:
    """One row per difference: missing in the reference, missing here, or a field that differs (nulls equal nulls)."""
    a, b = generated.alias("a"), reference.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    has_a, has_b = F.col(f"a.{key[0]}").isNotNull(), F.col(f"b.{key[0]}").isNotNull()
    names = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
    differing = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    kinds = F.when(~has_b, F.array(F.lit("unexpected"))).when(~has_a, F.array(F.lit("missing"))).otherwise(differing)
    found = a.join(b, on, "full_outer").select(*names, F.explode(kinds).alias("difference"))
    return found if require_complete else found.filter("difference <> 'missing'")


def capped(differences: DataFrame, order: list[str], keep: int = 10) -> DataFrame:
    """The first ``keep`` differences with n_total, the number of all of them."""
    total = differences.agg(F.count("*").alias("n_total"))
    return differences.orderBy(*order).limit(keep).crossJoin(F.broadcast(total))  # one row is broadcast
