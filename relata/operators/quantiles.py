"""Exact quantiles of whole tables and of groups of any size, by distributed selection.

A group's rank is looked for in a histogram of its values: first by sign and
binary exponent, then, again and again, by equal parts of the bucket that holds
the rank, until that bucket has few values or a single one.  Every pass counts
in all tasks and brings one row per group and bucket together, so no task holds
a share of the values.  The part of the least value of a bucket is never that
of its greatest, so every pass gets on; a pass divides by ``PARTS`` where
values lie evenly, and six passes do for any values of one exponent.

Groups of at most ``FEW`` values are left to one aggregation each.  What is
known of the other groups is one row each: those with more than a ten-thousandth
of all rows, 10,000 groups at most, are broadcast and their rows stay where
they are; the others are joined by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.storage import discard, intermediates, materialize

FEW = 100_000
PARTS = 1024
BROADCAST_GROUPS = 10_000


def _exponent(v: Column) -> Column:
    """Rises with the value: sign and binary exponent; infinities and NaN (the greatest) apart."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 5000).when(v == float("inf"), 4000).when(v == float("-inf"), -4000).otherwise(finite)


def _part(v: Column, low: Column, high: Column) -> Column:
    """Which of ``PARTS`` equal parts from low to high; halves keep the width finite."""
    return F.least(F.lit(PARTS - 1), F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * PARTS).cast("int"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def _with_state(values: DataFrame, state: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Values of the groups in ``state``, with what is known of their group."""
    own = [c for c in state.columns if c not in keys]

    def joined(v: DataFrame, s: DataFrame) -> DataFrame:
        return v.alias("v").join(s.alias("s"), _same("v", "s", keys)).select("v.*", *(F.col(f"s.{c}") for c in own))

    if state.count() <= BROADCAST_GROUPS:
        return joined(values, F.broadcast(state))
    often = F.col("n") > total // BROADCAST_GROUPS
    hot = F.broadcast(state.filter(often))
    rest = values.alias("v").join(hot.alias("s"), _same("v", "s", keys), "left_anti")
    return joined(values, hot).union(joined(rest, state.filter(~often).hint("merge")))


def _select(values: DataFrame, sizes: DataFrame, keys: list[str], q: float, total: int, few: int) -> DataFrame:
    """(keys, lower, upper, fraction): the two values around the rank of each group in ``sizes``."""
    at = (F.col("n") - 1) * F.lit(float(q))
    none = F.lit(None).cast("double")
    todo = sizes.select(*keys, "n", (F.floor(at) + 1).alias("rank"), (at - F.floor(at)).alias("fraction"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), none.alias("low"), none.alias("high"), none.alias("next"))
    columns, done, made = todo.columns, [], []
    while True:
        v = F.col("v")
        inside = F.col("low").isNull() | ((v >= F.col("low")) & (v <= F.col("high")))
        bucket = F.when(F.col("low").isNull(), _exponent(v)).otherwise(_part(v, F.col("low"), F.col("high")))
        # What is known of a group is one value for all of its rows, so any of them will do.
        kept = [F.first(c).alias(c) for c in ("n", "rank", "fraction", "below", "next")]
        counted = _with_state(values, todo, keys, total).filter(inside).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"), *kept)
        order = Window.partitionBy(*keys).orderBy("bucket")  # a few thousand buckets of a group
        running = counted.withColumns({"reach": F.col("below") + F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0)), "following": F.coalesce(F.lead("low").over(order), F.col("next"))})
        found = running.filter((F.col("reach") >= F.col("rank")) & (F.col("reach") - F.col("held") < F.col("rank")))
        state = materialize(found.select(*keys, "n", "rank", "fraction", (F.col("reach") - F.col("held")).alias("below"), "held", "low", "high", F.col("following").alias("next")).select(*columns), "selection", rows=0)
        made.append(state)
        wide = (F.col("held") > few) & (F.col("low") < F.col("high"))
        done.append(state.filter(~wide))
        todo = state.filter(wide)
        if todo.isEmpty():
            break
    ends = reduce(DataFrame.union, done)
    met = F.col("below") + F.col("held") > F.col("rank")  # the next rank is in the same bucket
    single = ends.filter("low = high").select(*keys, F.col("low").alias("lower"), F.when(met, F.col("low")).otherwise(F.col("next")).alias("upper"), "fraction")
    several = ends.filter("low < high")
    listed = _with_state(values, several, keys, total).filter("v >= low and v <= high").groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("list"), *(F.first(c).alias(c) for c in ("rank", "below", "fraction", "next")))
    place = (F.col("rank") - F.col("below")).cast("int")
    pair = listed.select(*keys, F.get("list", place - 1).alias("lower"), F.coalesce(F.get("list", place), F.col("next")).alias("upper"), "fraction")
    return materialize(single.union(pair), "quantiles", rows=0)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile", also: list[Column] | None = None, few: int | None = None) -> DataFrame:
    """One row per group with the exact linear quantile of its values, and the aggregates in ``also``; without keys, one row for the table.

    Nulls are left out, NaN is the greatest value, a group without a value has
    a null quantile.  Sizes are counted first; a table whose groups all have
    at most ``few`` values (``FEW``) is aggregated at once.
    """
    also, few = also or [], few or FEW
    number = F.col(value).cast("double")
    sizes = rows.groupBy(*keys).agg(F.count(number).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= few:
        return rows.groupBy(*keys).agg(F.percentile(number, F.lit(float(q))).alias(name), *also)
    with intermediates() as made:
        group = [F.lit(0).alias("all")] if not keys else [F.col(k) for k in keys]
        names = keys or ["all"]
        values = materialize(rows.select(*group, number.alias("v")).filter("v is not null"), "selection-values")
        counts = materialize(values.groupBy(*names).agg(F.count("*").alias("n")), "selection-sizes")
        big = counts.filter(F.col("n") > few)
        selected = _select(values, big, names, q, total, few)
    discard(*(m for m in made[:-1] if m is not values))
    step = F.when((F.col("fraction") == 0) | (F.col("lower") == F.col("upper")), F.col("lower")).otherwise(F.col("lower") + F.col("fraction") * (F.col("upper") - F.col("lower")))
    large = selected.select(*names, step.alias(name))
    small = values.alias("v").join(large.alias("s"), _same("v", "s", names), "left_anti").groupBy(*names).agg(F.percentile("v", F.lit(float(q))).alias(name))
    found = large.union(small)
    if not keys:
        one = found.select(name)
        return one.crossJoin(F.broadcast(rows.agg(*also))) if also else one  # one row is broadcast
    whole = rows.groupBy(*keys).agg(*also) if also else rows.select(*keys).distinct()
    return whole.alias("w").join(found.alias("f"), _same("w", "f", keys), "left").select(*(F.col(f"w.{k}") for k in keys), F.col(f"f.{name}"), *(F.col(f"w.{c}") for c in whole.columns if c not in keys))


def exact_median(rows: DataFrame, value: str) -> DataFrame:
    """One row, median."""
    return exact_quantiles(rows, [], value, 0.5, "median")
