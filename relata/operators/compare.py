"""Differences between two runs, and set comparisons of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.storage import materialize


def numbers_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Null equals only null, infinity itself, NaN nothing; else within an absolute tolerance."""
    a, b = a.cast("double"), b.cast("double")
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(a.isNull() & b.isNull(), True).when(known & (a == b), True).otherwise(F.coalesce(known & finite & (F.abs(a - b) <= tolerance), F.lit(False)))


def _difference(differs: Column, category: str, field: str, a: Column, b: Column) -> Column:
    return F.when(differs, F.struct(F.lit(category).alias("category"), F.lit(field).alias("field"), a.cast("string").alias("reference"), b.cast("string").alias("candidate")))


def _field_checks(inputs, stable, texts, numbers, tolerance) -> list[Column]:
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    checks = []
    if inputs:
        whole = lambda side: F.struct(*(side(f).alias(f) for f in inputs))
        checks.append(_difference(~whole(a).eqNullSafe(whole(b)), "input", "manifest_fields", F.to_json(whole(a)), F.to_json(whole(b))))
    checks += [_difference(~a(f).eqNullSafe(b(f)), "stable_runtime", f, a(f), b(f)) for f in stable]
    checks += [_difference(~a(f).eqNullSafe(b(f)), "raw_response", f, a(f), b(f)) for f in texts]
    checks += [_difference(~numbers_equal(a(f), b(f), tolerance), "numeric_output", f, a(f), b(f)) for f in numbers]
    return checks


def diff_by_key(reference: DataFrame, candidate: DataFrame, key: list[str], inputs=(), stable=(), texts=(), numbers=(), tolerance: float = 0.0) -> DataFrame:
    """One row per difference of rows with equal keys, and per key on one side only."""
    a, b = reference.alias("a"), candidate.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    has_a, has_b = F.col(f"a.{key[0]}").isNotNull(), F.col(f"b.{key[0]}").isNotNull()
    present = [F.when(has_a & has_b, c) for c in _field_checks(inputs, stable, texts, numbers, tolerance)]
    none = F.lit(None).cast("string")
    sides = [_difference(~has_b, "missing", "row", F.lit("present"), none), _difference(~has_a, "extra", "row", none, F.lit("present"))]
    return joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), F.inline(F.array_compact(F.array(*sides, *present))))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds run_index from 1 in a stated order.

    Ranges of the order are numbered apart, so no task holds all rows.  The
    numbered ranges are written before their sizes are added up: computed
    twice, a range could have other bounds the second time.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = materialize(ranged, "numbered").withColumns({"__part": F.shiftright("__at", 33), "__own": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = written.groupBy("__part").agg(F.count("*").alias("n"))  # one row per range
    shift = sizes.select(F.col("__part"), F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return written.join(shift, "__part").withColumn("run_index", F.col("__own") + F.col("__shift") + 1).drop("__at", "__part", "__own", "__shift")


def diff_positional(reference: DataFrame, candidate: DataFrame, key: str, position: str = "run_index", inputs=(), stable=(), texts=(), numbers=(), tolerance: float = 0.0) -> DataFrame:
    """Differences of rows in equal places: another key there is one 'order' difference and ends that row; rows past the shorter run are not looked at."""
    a, b = reference.alias("a"), candidate.alias("b")
    joined = a.join(b, F.col(f"a.{position}") == F.col(f"b.{position}"))
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    order = _difference(~same, "order", key, F.col(f"a.{key}"), F.col(f"b.{key}"))
    checks = [order, *(F.when(same, c) for c in _field_checks(inputs, stable, texts, numbers, tolerance))]
    return joined.select(F.col(f"a.{position}").alias(position), F.inline(F.array_compact(F.array(*checks))))


def diff_runs(reference: DataFrame, candidate: DataFrame, key: str, position: str = "run_index", **fields) -> DataFrame:
    """``diff_positional``, and one 'row_count' difference without a place if one run is longer."""
    sizes = reference.agg(F.count("*").alias("n")).crossJoin(F.broadcast(candidate.agg(F.count("*").alias("m"))))  # one row is broadcast
    longer = F.array_compact(F.array(_difference(F.col("n") != F.col("m"), "row_count", "number_of_rows", F.col("n"), F.col("m"))))
    none = F.lit(None).cast(reference.schema[position].dataType).alias(position)
    return diff_positional(reference, candidate, key, position, **fields).unionByName(sizes.select(none, F.inline(longer)))


def difference_counts(differences: DataFrame) -> DataFrame:
    """Rows per category with the largest numeric difference (-1 where there is none)."""
    gap = F.abs(F.col("reference").try_cast("double") - F.col("candidate").try_cast("double"))
    return differences.groupBy("category").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("category") == "numeric_output", gap)), F.lit(-1.0)).alias("largest"))


def metadata_differences(reference: DataFrame, candidate: DataFrame, fields: list[str]) -> DataFrame:
    """Differing fields of two single-row tables."""
    joined = reference.limit(1).alias("a").crossJoin(candidate.limit(1).alias("b"))
    checks = [_difference(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), "metadata", f, F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields]
    return joined.select(F.inline(F.array_compact(F.array(*checks))))


def order_differences(ordered: DataFrame, reference: DataFrame, key: str = "pair_id", position: str = "run_index") -> DataFrame:
    """(position, rule, expected, found) where a reference run's rows are not in the given order: 'differs', 'missing' past its end, 'extra' past the order's."""
    a, b = ordered.select(F.col(position).alias("p"), F.col(key).cast("string").alias("expected")), reference.select(F.col(position).alias("q"), F.col(key).cast("string").alias("found"))
    rule = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("found")), "differs")
    return a.join(b, F.col("p") == F.col("q"), "full_outer").select(F.coalesce("p", "q").alias(position), rule.alias("rule"), "expected", "found").filter("rule is not null")


def key_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only: side 'missing' (left only) or 'extra' (right only)."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def combine(inputs: list[DataFrame]) -> DataFrame:
    """All inputs under one another, with the input's number."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumn("input", F.lit(k)) for k, x in enumerate(inputs)))


def is_prefix(snapshot: DataFrame, official: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """Places at which a snapshot is not the official log's beginning; no row if it is a prefix."""
    a, b = snapshot.alias("a"), official.alias("b")
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields))
    return a.join(b, F.col(f"a.{position}") == F.col(f"b.{position}"), "left").filter(F.col(f"b.{position}").isNull() | differs).select(F.col(f"a.{position}").alias(position))


# Metadata that a run must share with the output it goes on with.
RESUME_FIELDS = ("condition", "model_id", "model_revision", "temperature", "max_tokens", "generation_seed", "order_seed", "manifest_sha256")


def resume_violations(selected: DataFrame, previous: DataFrame, metadata: DataFrame, previous_metadata: DataFrame | None = None, position: str = "run_index", key: str = "pair_id", fields: tuple[str, ...] = RESUME_FIELDS) -> DataFrame:
    """(position, rule, field): why a run cannot go on with earlier output; no row if it can.

    The earlier rows must be the beginning of the selected ones, in their
    order: 'longer' for a place past the selection, 'order' for another key.
    The metadata, single rows, must agree in ``fields``; without earlier
    metadata they are not compared.
    """
    a, b = previous.select(F.col(position).alias("p"), F.col(key).alias("k")), selected.select(F.col(position).alias("q"), F.col(key).alias("l"))
    rule = F.when(F.col("q").isNull(), "longer").when(~F.col("k").eqNullSafe(F.col("l")), "order")
    rows = a.join(b, F.col("p") == F.col("q"), "left").select(F.col("p").alias(position), rule.alias("rule"), F.lit(key).alias("field")).filter("rule is not null")
    if previous_metadata is None:
        return rows
    differing = metadata_differences(previous_metadata, metadata, [f for f in fields if f in metadata.columns and f in previous_metadata.columns])
    return rows.unionByName(differing.select(F.lit(None).cast(rows.schema[position].dataType).alias(position), F.lit("metadata").alias("rule"), "field"))
