"""Intermediate tables on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without the setting a fresh local folder serves a session whose executors
    run in the driver's own process; any other session is refused, as its
    executors would write where nobody else can read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="relata-shared-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


FILE_ROWS, MIN_FILES = 250_000, 8
_COLLECTING: list[list[DataFrame]] = []


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: the lineage ends there, on storage that outlives executors.

    ``rows``: about how many narrow rows there are; so many files are written at most as hold them at ``FILE_ROWS`` each.
    """
    if rows is not None:
        df = df.coalesce(max(MIN_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for made in _COLLECTING:
        made.append(table)
    return table


@contextmanager
def intermediates() -> Iterator[list[DataFrame]]:
    """Collects the tables that ``materialize`` makes in the block, in order, so that those nobody reads afterwards can be discarded."""
    made: list[DataFrame] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING[:] = [x for x in _COLLECTING if x is not made]


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` once nothing reads them any more; others are left alone."""
    for table in tables:
        path = table.__dict__.get("stored_at")
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
