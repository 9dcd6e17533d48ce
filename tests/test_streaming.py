"""The ledger's state machine over restarts, late and missing rows; commits by several writers and through crashes."""

import threading

import pytest
from pyspark.sql import functions as F

from relata.streaming import ledgers
from relata.streaming.commits import CommitConflict, CommitLog

SCHEMA = "ledger string, order_index long, capture_id string, accepted boolean, ts timestamp"


class Stream:
    """Each step adds a file and runs the query to its end, as a restart from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.seen = spark, folder, options, 0

    def step(self, rows):
        df = self.spark.createDataFrame([(l, k, f"c{k}" if c is None else c, a, t) for l, k, c, a, t in rows], "ledger string, order_index long, capture_id string, accepted boolean, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).json(f"{self.folder}/in")
        if self.options.get("time"):
            stream = stream.withWatermark("ts", "0 seconds")
        out = ledgers.record_in_order(stream, **self.options)
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = [tuple(r) for r in self.spark.read.schema(ledgers.RESULT).parquet(f"{self.folder}/out").collect()]
        new = sorted(found, key=repr)
        fresh, self.last = [r for r in new if r not in getattr(self, "last", [])], new
        return sorted(((l, k, s, n) for l, k, _, _, n, s in fresh), key=lambda r: (r[0], r[1] or 0))


def at(minute):
    return f"2026-01-01 00:{minute:02d}:00"


def test_late_rows_and_restarts(spark, tmp_path):
    s = Stream(spark, str(tmp_path), target=3)
    assert s.step([("l", 3, None, True, at(0)), ("l", 1, None, True, at(0)), ("m", 2, None, True, at(0))]) == [("l", 1, "recorded", 1)]
    assert s.step([("l", 5, None, True, at(1)), ("l", 1, None, False, at(1)), ("m", 1, None, False, at(1))]) == [("m", 1, "recorded", 0), ("m", 2, "recorded", 1)]
    assert s.step([("l", 2, None, False, at(2))]) == [("l", 2, "recorded", 1), ("l", 3, "recorded", 2)]
    assert s.step([("l", 4, None, False, at(3)), ("l", 6, None, True, at(3)), ("l", 7, None, True, at(3))]) == [("l", 4, "recorded", 2), ("l", 5, "recorded", 3), ("l", 6, "after_target", 3), ("l", 7, "after_target", 3)]


def test_a_gap_that_never_fills_expires_and_may_be_filled_later(spark, tmp_path):
    s = Stream(spark, str(tmp_path), time="ts", patience_seconds=600)
    assert s.step([("l", 1, None, True, at(0)), ("l", 3, None, True, at(0)), ("l", 4, None, True, at(1))]) == [("l", 1, "recorded", 1)]
    assert s.step([("other", 1, None, False, at(5))]) == [("other", 1, "recorded", 0)]
    # The watermark passes minute 11 with this row; the timer fires with the next batch at the latest.
    told = s.step([("other", 2, None, False, at(30))]) + s.step([("other", 3, None, False, at(31))])
    assert sorted(told) == [("l", 2, "missing", 1), ("l", 3, "expired", 1), ("l", 4, "expired", 1), ("other", 2, "recorded", 0), ("other", 3, "recorded", 0)]
    assert s.step([("l", 2, None, True, at(32)), ("l", 3, None, True, at(32))]) == [("l", 2, "recorded", 2), ("l", 3, "recorded", 3)]


def test_the_frozen_order_and_the_window_are_kept(spark, tmp_path):
    frozen = spark.createDataFrame([("l", k, f"c{k}") for k in range(1, 9)], "ledger string, order_index long, capture_id string")
    s = Stream(spark, str(tmp_path), frozen=frozen, window=3)
    told = s.step([("l", 1, "c2", True, at(0)), ("l", 5, None, True, at(0)), ("l", 99, None, True, at(0)), ("l", None, "x", True, at(0)), ("l", 3, None, None, at(0))])
    assert [t[1:3] for t in told if t[1]] == [(1, "wrong_capture"), (5, "too_far_ahead"), (99, "unknown_index")] and [t[2] for t in told if t[1] is None] == ["unknown_index"]
    assert s.step([("l", 1, None, True, at(1)), ("l", 2, None, True, at(1))]) == [("l", 1, "recorded", 1), ("l", 2, "recorded", 2), ("l", 3, "recorded", 2)]


def test_another_state_store_is_refused(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="providerClass"):
            ledgers.record_in_order(stream)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledgers.PROVIDER)


# ------------------------------------------------------------ commits


def rows(spark, a, b):
    return spark.range(a, b).selectExpr("id as order_index", "concat('c', id) as capture_id")


def held(log, version=None):
    return sorted(r["order_index"] for r in log.read(version).collect())


def test_commits_are_whole_and_numbered(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), order="order_index")
    with pytest.raises(ValueError, match="no commit"):
        log.read()
    assert log.append(rows(spark, 1, 4)) == 1 and log.append(rows(spark, 4, 6)) == 2 and log.append(rows(spark, 6, 6)) == 3
    assert held(log) == [1, 2, 3, 4, 5] and held(log, 1) == [1, 2, 3] and log.head().last == 5
    for bad in (rows(spark, 7, 9), rows(spark, 5, 7), rows(spark, 6, 8).union(rows(spark, 6, 7))):
        with pytest.raises(ValueError, match="must go on from 6"):
            log.append(bad)
    with pytest.raises(ValueError, match="columns"):
        log.append(spark.range(6, 7).selectExpr("id as order_index"))
    assert held(log) == [1, 2, 3, 4, 5]


def test_of_two_writers_one_gets_the_number(spark, tmp_path):
    one, two = (CommitLog(spark, str(tmp_path / "log"), order="order_index") for _ in range(2))
    a, b = one.prepare(rows(spark, 1, 3)), two.prepare(rows(spark, 1, 4))
    assert two.commit(b) == 1
    with pytest.raises(CommitConflict):
        one.commit(a)
    assert held(one) == [1, 2, 3]
    stale = one.manifest(0)
    with pytest.raises(CommitConflict):
        one.append(rows(spark, 1, 2), against=stale)


def test_many_writers_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("relata.streaming.commits.WHOLE", 3)
    failures = []

    def work(w):
        try:
            log = CommitLog(spark, str(tmp_path / "log"))
            for k in range(3):
                log.append_retrying(rows(spark, 100 * w + 10 * k, 100 * w + 10 * k + 2), f"w{w}", k)
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = CommitLog(spark, str(tmp_path / "log"))
    assert not failures and log.versions() == list(range(1, 13))
    assert held(log) == sorted(100 * w + 10 * k + x for w in range(4) for k in range(3) for x in range(2))
    assert log.head().writers == {f"w{w}": 2 for w in range(4)}


def test_a_crash_between_the_steps_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "log"), order="order_index")
    log.append(rows(spark, 1, 3), writer="w", batch_id=0)
    with monkeypatch.context() as m:
        m.setattr(log, "_claim", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.append(rows(spark, 3, 5), writer="w", batch_id=1)
    with monkeypatch.context() as m:
        m.setattr("os.link", lambda a, b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.append(rows(spark, 3, 5), writer="w", batch_id=1)
    again = CommitLog(spark, str(tmp_path / "log"), order="order_index")
    assert held(again) == [1, 2] and not list((tmp_path / "log/_commits").glob("*.draft"))
    assert again.append(rows(spark, 3, 5), writer="w", batch_id=1) == 2 and again.append(rows(spark, 3, 5), writer="w", batch_id=1) == 2
    assert held(again) == [1, 2, 3, 4]
    assert again.sweep(3600) == [] and len(again.sweep(0)) == 2 and held(again) == [1, 2, 3, 4]


def test_damage_and_gaps_are_told(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    for k in range(3):
        log.append(rows(spark, k, k + 1))
    place = tmp_path / "log/_commits/000000000002.json"
    text = place.read_text()
    place.write_text(text.replace('"rows": 1', '"rows": 2'))
    (tmp_path / "log/_commits/.000000000002.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        log.read()
    place.unlink()
    with pytest.raises(ValueError, match="gaps"):
        log.read()


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    for a in (0, 10):
        rows(spark, a, a + 3).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("order_index long, capture_id string").json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(log.foreach_batch("s")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    log.foreach_batch("s")(rows(spark, 50, 60), 1)  # sent again
    assert held(log) == [0, 1, 2, 10, 11, 12]
