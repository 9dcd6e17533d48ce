"""Streaming forms of the sequential log: idempotent appends, a stop rule with state, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.sources.sinks import Store
from relata.streaming.ledgers import RECORDED, record_in_order


def append_once(path: str, key: str = "order_index"):
    """A foreachBatch function for a log with one writer: rows whose key the log holds already are left out, so a repeated batch changes nothing; ``commits.CommitLog`` serves several writers.

    Of the log only the part between the batch's least and greatest key is
    read; of rows of one key in a batch the least stays.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("row")).select("row.*").persist()
        try:
            if Store(spark, path).exists(path):
                low, high = once.agg(F.min(key), F.max(key)).first()
                known = spark.read.schema(batch.schema).parquet(path).filter(F.col(key).between(low, high)).select(key).distinct()
                once.join(known, key, "left_anti").select(*batch.columns).write.mode("append").parquet(path)
            else:
                once.write.mode("append").parquet(path)
        finally:
            once.unpersist()

    return write


def windowed_counts(events: DataFrame, time: str = "ts", by: tuple[str, ...] = ("event_type",), width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean value by event-time window; events later than the watermark are not waited for."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), *by, "n", "mean_value")


def until_target(log: DataFrame, target: int, group: str = "ledger", order: str = "order_index", accepted: str = "accepted", first: int = 1) -> DataFrame:
    """Rows of each ledger up to the one that reaches the target number of acceptances; see ``ledgers.record_in_order`` for those that are not recorded."""
    return record_in_order(log, target, group=group, order=order, accepted=accepted, first=first).filter(F.col("status") == RECORDED).select("ledger", "order_index", "accepted", "accepted_so_far")
