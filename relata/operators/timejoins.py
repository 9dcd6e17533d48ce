"""Joins by time: the last earlier row of a key, and intervals that overlap.

``asof_join`` sorts both sides together by ranges of key and time, so a key of
any size is spread over as many ranges as its rows fill.  What a range must
know of those before it is one row: the last right row there.  It is put in
front of the range, and a running value inside each range does the rest.

``interval_join`` deals intervals to bins as wide as they are long: an interval
of level k is at most a base width times 2 to the k long and lies in two bins
of that level at most.  Two intervals meet on the higher of their levels, to
which the shorter one is raised; there, too, it lies in two bins at most.  A
pair that meets in two bins counts in the one where the later of its starts
lies.  However unequal the lengths, an interval has two rows a level, and a
bin's candidates are in proportion to pairs that do overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.storage import materialize

MAX_LEVELS = 64


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Every left row with ``columns`` of the right row of its keys that is last at or (``strict``: only) before its time; null where there is none.

    Of right rows of one time the one with the greatest values counts.  Rows
    with a null key or time find nothing and are not found.
    """
    taken = [c for c in columns if c in left.columns]
    if taken:
        raise ValueError(f"both sides have {', '.join(taken)}")
    spark = left.sparkSession
    whole = [F.col(k).isNotNull() for k in keys]
    complete = lambda t: reduce(lambda x, y: x & y, [*whole, F.col(t).isNotNull()])
    key, value = F.struct(*(F.col(k) for k in keys)).alias("key"), F.struct(*columns).alias("found")
    known = right.filter(complete(right_time)).select(key, F.col(right_time).alias("at"), F.lit(1 if strict else 0).alias("side"), value, F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row"))
    asked = left.filter(complete(left_time)).select(key, F.col(left_time).alias("at"), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(known.schema["found"].dataType).alias("found"), F.struct(*left.columns).alias("row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "at", "side", "found", "tie"]
    both = known.unionByName(asked).withColumn("tie", F.monotonically_increasing_id())
    ranged = materialize(both.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "asof-ranges")
    last = ranged.filter("row is null").groupBy("range").agg(F.max(F.struct("key", "at", "side", "found")).alias("last"))  # one row a range
    present = ranged.groupBy("range").agg(F.count("*").alias("rows")).join(last, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # ranges alone are ordered here
    seeds = present.select("range", F.max("last").over(before).alias("seed")).filter("seed is not null")
    seeded = ranged.unionByName(seeds.select(F.col("seed.key").alias("key"), F.col("seed.at").alias("at"), F.col("seed.side").alias("side"), F.col("seed.found").alias("found"), F.lit(None).cast(ranged.schema["row"].dataType).alias("row"), F.lit(-1).cast("long").alias("tie"), "range"))
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("row").isNull(), F.struct("key", "found")), ignorenulls=True).over(running)
    matched = seeded.withColumn("carried", carried).filter("row is not null")
    hit = F.col("carried.key") == F.col("key")
    out = matched.select("row.*", *(F.when(hit, F.col(f"carried.found.{c}")).alias(c) for c in columns))
    rest = left.filter(~complete(left_time))
    return out.unionByName(rest.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns)))


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Milliseconds from 1970 to a time, to the nearest one, halves away from zero; a time without a zone is taken as it stands, whatever the session's zone."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        millis = F.unix_micros(column).cast("decimal(20,0)") / 1000
    else:
        millis = (F.col(column) - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)") * 1000
    return F.round(millis).cast("long")


def _length(start: str, end: str) -> Column:
    return (F.col(end) - F.col(start)).cast("double")


def interval_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, keys: list[str] | None = None) -> DataFrame:
    """Every pair of a left and a right row, of equal keys if there are any, whose closed intervals of numbers share a point.

    Both sides' columns, which must have different names but for the keys.
    Intervals that end before they begin, or have no ends, meet nothing.
    """
    keys = keys or []
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    sides = []
    for df, start, end in ((left, left_start, left_end), (right, right_start, right_end)):
        good = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)) & ~F.isnan(F.col(start).cast("double")) & (_length(start, end) < float("inf"))
        sides.append(df.filter(reduce(lambda x, y: x & y, [good, *(F.col(k).isNotNull() for k in keys)])))
    lengths = sides[0].select(_length(left_start, left_end).alias("d")).union(sides[1].select(_length(right_start, right_end).alias("d"))).filter("d > 0")
    # Any width gives the same pairs; a short length as the base keeps short intervals in narrow bins.
    base, longest = lengths.agg(F.percentile_approx("d", F.lit(0.1), F.lit(100)), F.max("d")).first()
    base = base or 1.0
    level = lambda start, end: F.when(_length(start, end) <= base, 0).otherwise(F.ceil(F.log2(_length(start, end) / F.lit(base)))).cast("int")
    found = [[r[0] for r in df.select(level(s, e).alias("level")).distinct().collect()] for df, s, e in ((sides[0], left_start, left_end), (sides[1], right_start, right_end))]  # one number for each power of two
    levels = sorted({*found[0], *found[1]} or {0})
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"the intervals' lengths span {len(levels)} powers of two")
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("__level"))

    def dealt(df: DataFrame, start: str, end: str, others: list[int], roles: tuple[tuple[int, ...], tuple[int, ...]]) -> DataFrame:
        """A row for each level at or above the interval's own (of the higher ones only those of the other side), each bin it touches there, and each role it has on its own or a higher level."""
        mine = df.withColumn("__own", level(start, end)).withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).filter((F.col("__level") == F.col("__own")) | ((F.col("__level") > F.col("__own")) & F.col("__level").isin(others)))
        role = F.when(F.col("__level") == F.col("__own"), F.array(*map(F.lit, roles[0]))).otherwise(F.array(*map(F.lit, roles[1])))
        bins = [F.floor(F.col(c).cast("double") / width) for c in (start, end)]
        return mine.withColumn("__bin", F.explode(F.sequence(*bins))).withColumn("__role", F.explode(role)).drop("__own")

    # Role 1: both on their own level; 2 and 3: the right or the left one raised.  Two raised ones never meet.
    a = dealt(sides[0], left_start, left_end, found[1], ((1, 2), (3,)))
    b = dealt(sides[1], right_start, right_end, found[0], ((1, 3), (2,)))
    meet = (F.col(left_start) <= F.col(right_end)) & (F.col(right_start) <= F.col(left_end))
    once = F.col("__bin") == F.floor(F.greatest(F.col(left_start).cast("double"), F.col(right_start).cast("double")) / width)
    pairs = a.join(b, [*keys, "__level", "__bin", "__role"])
    return pairs.filter(meet & once).drop("__level", "__bin", "__role")
