"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.storage import discard, intermediates, materialize, shared_dir

__all__ = ["bounded_sample", "discard", "free_name", "held_out", "intermediates", "map_arrow", "materialize", "passed", "quoted", "read_table", "sampled", "shared_dir", "slices"]

TRAIN_REMAINDER = 2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves the remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == TRAIN_REMAINDER, F.lit(False))


def sampled(narrow: DataFrame, id_column: str, bound: int, own_column: str | None = None) -> Column:
    """A condition that about ``bound`` rows meet (all, if there are fewer), by a hash of the id, so alike on every run and at every size.

    ``narrow`` is counted; it should hold no wide column.  ``own_column``: the id's name where the condition is used.
    """
    n, cells = narrow.count(), 1 << 30
    drawn = F.pmod(F.xxhash64(F.col(own_column or id_column)), F.lit(cells)) < int(cells * bound / max(1, n))
    return F.lit(True) if n <= bound else drawn


def bounded_sample(narrow: DataFrame, id_column: str, bound: int) -> DataFrame:
    """About ``bound`` rows of a narrow table."""
    return narrow.filter(sampled(narrow, id_column, bound))


def passed(columns: list[str], out: tuple[str, ...]) -> list[str]:
    """The input columns that go through an operator: all but those of a result's name, which the result replaces."""
    taken = {c.lower() for c in out}
    return [c for c in columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    """A column by its name, whatever stands in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: the batches' columns go by their places."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(work, schema)


def free_name(columns: list[str], base: str) -> str:
    """A column name that is not taken yet."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, column: int | None = None, most: int = 0, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python values at a time.

    ``column``: a binary column of which a batch holds about ``most`` bytes, or one longer value.  ``keep``: what the
    worker kept stays until the operator asks for values of its own; else it is freed.
    """
    if not keep:
        workers.release()
    for batch in batches:
        sizes = [] if column is None else [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, batch.num_rows)
            if column is not None:
                held, stop = sizes[at], at + 1
                while stop < end and held + sizes[stop] <= most:
                    held, stop = held + sizes[stop], stop + 1
                end = stop
            yield batch.slice(at, end - at)
            at = end
