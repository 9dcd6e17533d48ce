"""Deterministic orders: by salted hash, by seeded shuffle; the stop rule on an ordered log."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions.text import salted_key
from relata.operators.compare import number_rows

MAX_SHUFFLED = 1_000_000


def salted_order(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """Adds order_key_sha256 and order_index, from 1 by hash and then key."""
    return number_rows(rows.withColumn("order_key_sha256", salted_key(salt, F.col(key))), ["order_key_sha256", key]).withColumnRenamed("run_index", "order_index")


def seeded_shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds run_index: the keys in ascending order, shuffled by Python's generator.

    The permutation is made on the driver, so the table may have at most
    ``MAX_SHUFFLED`` rows (checked); larger ones take ``salted_order``.
    """
    n = rows.count()
    if n > MAX_SHUFFLED:
        raise ValueError(f"{n} rows are too many to shuffle on the driver")
    places = list(range(1, n + 1))
    random.Random(seed).shuffle(places)
    order = rows.sparkSession.createDataFrame([(place, k + 1) for k, place in enumerate(places)], "place long, run_index long")
    return number_rows(rows, [key]).withColumnRenamed("run_index", "place").join(order, "place").drop("place")


def until_target(log: DataFrame, order: str, accepted: str, target: int) -> DataFrame:
    """The log up to and with the row whose acceptance reaches the target; all of it if none does."""
    numbered = number_rows(log.filter(accepted), [order]).withColumnRenamed("run_index", "__n")
    last = numbered.filter(F.col("__n") == target).agg(F.min(order).alias("__last"))  # one row is broadcast
    return log.crossJoin(F.broadcast(last)).filter(F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).drop("__last")


def running_accepted(log: DataFrame, group: str, order: str, accepted: str) -> DataFrame:
    """Adds accepted_so_far within each group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("accepted_so_far", F.sum(F.col(accepted).cast("long")).over(w))
