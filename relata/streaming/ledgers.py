"""A sequential ledger as a state machine over a stream.

Each ledger records its rows in a frozen order without gaps, up to a target
number of acceptances.  A row that comes before its predecessors waits in keyed
state, outside the memory of the tasks; how many may wait is bounded, and for
how long: where a gap is not filled in time by the stream's watermark, the gap
and the rows behind it are told and the state is emptied.  Every row that is
not recorded leaves with its reason, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW = 100_000
RECORDED, MISSING, EXPIRED, AHEAD, STOPPED, WRONG, UNKNOWN = "recorded", "missing", "expired", "too_far_ahead", "after_target", "wrong_capture", "unknown_index"
RESULT = "ledger string, order_index long, capture_id string, accepted boolean, accepted_so_far long, status string"
Result = Row("ledger", "order_index", "capture_id", "accepted", "accepted_so_far", "status")


class Ledger(StatefulProcessor):
    """Keyed by ledger; state: the next place with the acceptances so far, and the rows that wait for it."""

    def __init__(self, target: int | None, first: int, window: int, patience_ms: int | None):
        self.target, self.first, self.window, self.patience = target, first, window, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "following long, accepted long, held long, deadline long")
        self.waiting = handle.getMapState("waiting", "order_index long", "capture_id string, accepted boolean")

    def _stopped(self, accepted: int) -> bool:
        return self.target is not None and accepted >= self.target

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        following, accepted, held, deadline = self.place.get() if self.place.exists() else (self.first, 0, 0, None)
        began, latest = following, None
        for r in rows:
            out = lambda status: Result(key[0], r.order_index, r.capture_id, r.accepted, accepted, status)
            if r.problem is not None:
                yield out(r.problem)
                continue
            if r.order_index < following:
                continue  # a repetition
            if self._stopped(accepted):
                yield out(STOPPED)
                continue
            if r.order_index - following >= self.window:
                yield out(AHEAD)
                continue
            if r.at is not None:
                latest = max(latest or r.at, r.at)
            if r.order_index > following:
                if not self.waiting.containsKey((r.order_index,)):
                    self.waiting.updateValue((r.order_index,), (r.capture_id, r.accepted))
                    held += 1
                continue
            accepted, following = accepted + r.accepted, following + 1
            yield out(RECORDED)
            while held and not self._stopped(accepted) and self.waiting.containsKey((following,)):
                capture, verdict = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
                accepted, held = accepted + verdict, held - 1
                yield Result(key[0], following, capture, verdict, accepted, RECORDED)
                following += 1
            if self._stopped(accepted) and held:
                yield from self._empty(key[0], accepted, STOPPED)
                held = 0
        deadline = self._remind(held, deadline, following > began, latest, timerValues)
        self.place.update((following, accepted, held, deadline))

    def _remind(self, held: int, deadline: int | None, moved: bool, latest: datetime | None, timers) -> int | None:
        """One timer a ledger, for the gap that it waits behind."""
        if self.patience is None or (held and deadline is not None and not moved):
            return deadline
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        if not held:
            return None
        seen = int(latest.replace(tzinfo=timezone.utc).timestamp() * 1000) if latest is not None else timers.getCurrentWatermarkInMs()
        deadline = max(seen, timers.getCurrentWatermarkInMs()) + self.patience
        self.handle.registerTimer(deadline)
        return deadline

    def _empty(self, ledger: str, accepted: int, status: str) -> Iterator[Row]:
        for (index,), (capture, verdict) in self.waiting.iterator():
            yield Result(ledger, index, capture, verdict, accepted, status)
        self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.place.exists():
            return
        following, accepted, held, deadline = self.place.get()
        if not held or deadline != expiredTimerInfo.getExpiryTimeInMs():
            return
        yield Result(key[0], following, None, None, accepted, MISSING)
        yield from self._empty(key[0], accepted, EXPIRED)
        self.place.update((following, accepted, 0, None))

    def close(self) -> None:
        pass


def record_in_order(
    log: DataFrame, target: int | None = None, frozen: DataFrame | None = None, group: str = "ledger", order: str = "order_index", capture: str = "capture_id", accepted: str = "accepted", first: int = 1, time: str | None = None, patience_seconds: int | None = None, window: int = WINDOW,
) -> DataFrame:
    """(ledger, order_index, capture_id, accepted, accepted_so_far, status): each row of a stream once it is recorded, or with the reason why it is not.

    Recorded rows come in order, from ``first`` without gaps, up to the one
    that reaches ``target`` acceptances; later ones are 'after_target'.
    Repetitions of a recorded or waiting place are passed over.  At most
    ``window`` - 1 rows of a ledger wait; one that is further ahead is
    'too_far_ahead' and may be sent again.  With ``time``, a column under a
    watermark, and ``patience_seconds``, a gap that the watermark leaves behind
    is told as 'missing' and the rows behind it as 'expired'; they may be sent
    again too, and the ledger goes on once its gap is filled.  ``frozen``, a
    table of (ledger, order_index, capture_id), is the order to keep: another
    capture in a place is 'wrong_capture', a place that it does not have
    'unknown_index'.  A null verdict counts as not accepted, rows without a
    ledger or a place are 'unknown_index'.
    """
    provider = log.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    if (time is None) != (patience_seconds is None):
        raise ValueError("a time column and a patience belong together")
    named = log.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("ledger"), F.col(order).cast("long").alias("order_index"), (F.col(capture).cast("string") if capture in log.columns else F.lit(None).cast("string")).alias("capture_id"),
        F.coalesce(F.col(accepted).cast("boolean"), F.lit(False)).alias("accepted"), (F.col(time) if time else F.lit(None).cast("timestamp")).alias("at"), (F.col(group).isNull() | F.col(order).isNull()).alias("unplaced"),
    )
    problem: Column = F.when(F.col("unplaced"), UNKNOWN)
    if frozen is not None:
        places = frozen.select(F.col(group).cast("string").alias("ledger"), F.col(order).cast("long").alias("order_index"), F.col(capture).cast("string").alias("frozen_id"), F.lit(True).alias("known"))
        named = named.join(places, ["ledger", "order_index"], "left")
        problem = problem.when(F.col("known").isNull(), UNKNOWN).when(~F.col("capture_id").eqNullSafe(F.col("frozen_id")), WRONG)
    rows = named.select("ledger", "order_index", "capture_id", "accepted", "at", problem.alias("problem"))
    machine = Ledger(target, first, window, None if patience_seconds is None else 1000 * patience_seconds)
    return rows.groupBy("ledger").transformWithState(machine, RESULT, "append", "eventTime" if time else "none")
