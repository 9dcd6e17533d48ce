"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_SHARE = 64, 10_000


def hot_bound(total: int) -> int:
    """A key with more rows than this is hot.  At most ``HOT_SHARE`` keys of ``total`` rows can be."""
    return max(HOT_ROWS, total // HOT_SHARE)


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (inner or left) on keys that are never null.

    ``one`` has every key at most once and, in ``count``, how many rows of
    ``many`` hold it; ``total`` is the number of rows of ``many``.  The rows of
    hot keys stay where they are and meet a broadcast table of at most
    ``HOT_SHARE`` rows; only the others are shuffled.
    """
    hot = F.broadcast(one.filter(F.col(count) > hot_bound(total)))
    cold = one.filter(F.col(count) <= hot_bound(total))
    rest = many.join(hot.select(*keys), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return many.join(hot, keys).select(*rest.columns).union(rest)


FILTER_BITS, SEGMENT_BITS = 1 << 27, 1 << 15


def _bit(mark: Column) -> Column:
    return F.pmod(mark, F.lit(FILTER_BITS))


def bit_filter(marks: DataFrame, mark: str) -> DataFrame:
    """(segment, bits): a filter of 16 MB at most for 64-bit hashes, whatever their number."""
    bit = _bit(F.col(mark))
    return marks.groupBy(F.floor(bit / SEGMENT_BITS).alias("segment")).agg(F.bitmap_construct_agg((bit % SEGMENT_BITS).cast("long")).alias("bits"))


def parted(rows: DataFrame, bits: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash is not in the filter, rows whose hash may be): the filter is broadcast, its size is fixed."""
    bit = _bit(F.col(mark))
    at = (bit % SEGMENT_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce((byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int"))) != 0, F.lit(False))
    told = rows.withColumn("segment", F.floor(bit / SEGMENT_BITS)).join(F.broadcast(bits), "segment", "left").select(*rows.columns, held.alias("may be"))
    return told.filter("not `may be`").drop("may be"), told.filter("`may be`").drop("may be")
