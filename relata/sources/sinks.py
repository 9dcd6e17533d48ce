"""Sinks that publish whole files or folders, or nothing.

Small results become single files: written beside their place by Spark, then
renamed through the store's own file system.  Large ones stay folders of parts.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import subprocess
import sys
import uuid
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

MAX_DRIVER_ROWS = 1_000_000
CHUNK_BYTES = 1 << 20


class Store:
    """The file system of a path, through Spark's own connectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def write(self, p: str, data: bytes | Iterable[bytes]) -> str:
        """Write bytes, or pieces one after the other; returns their SHA-256."""
        digest, out = hashlib.sha256(), self.fs.create(self.path(p), True)
        try:
            for part in (data,) if isinstance(data, bytes) else data:
                digest.update(part)
                out.write(bytearray(part))
            out.hsync() if hasattr(out, "hsync") else None
        finally:
            out.close()
        return digest.hexdigest()

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def rename(self, a: str, b: str, overwrite: bool) -> None:
        """Put a in b's place.  What stood there is moved aside first and deleted last, so a crash loses neither."""
        aside = f"{b}.{uuid.uuid4().hex}.old"
        standing = self.exists(b)
        if standing and not overwrite:
            raise FileExistsError(b)
        if standing and not self.fs.rename(self.path(b), self.path(aside)):
            raise OSError(f"{b} could not be moved aside")
        if not self.fs.rename(self.path(a), self.path(b)):
            if standing:
                self.fs.rename(self.path(aside), self.path(b))
            raise OSError(f"{a} could not become {b}")
        if standing:
            self.delete(aside)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def refuse_existing(spark: SparkSession, paths: list[str], overwrite: bool) -> None:
    for p in paths:
        if not overwrite and Store(spark, p).exists(p):
            raise FileExistsError(p)


def refuse_inside(path: str, frozen: str) -> None:
    """No output may stand in a frozen folder."""
    if PurePosixPath(frozen) in (PurePosixPath(path), *PurePosixPath(path).parents):
        raise ValueError(f"{path} is inside {frozen}")


def publish_bytes(spark: SparkSession, path: str, data: bytes | Iterable[bytes], overwrite: bool = False) -> str:
    """All of the file or none of it; returns its SHA-256."""
    refuse_existing(spark, [path], overwrite)
    store, part = Store(spark, path), f"{path}.{uuid.uuid4().hex}.part"
    try:
        digest = store.write(part, data)
        store.rename(part, path, overwrite)
    finally:
        store.delete(part)
    return digest


def publish_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> str:
    return publish_bytes(spark, path, text.encode(), overwrite)


def publish_json(spark: SparkSession, path: str, document: dict, overwrite: bool = False) -> str:
    return publish_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False, default=str) + "\n", overwrite)


def _bounded(df: DataFrame, order: list[str]) -> Iterator[dict]:
    """The rows in order, a partition at a time; their number is checked before the first one comes."""
    if df.limit(MAX_DRIVER_ROWS + 1).count() > MAX_DRIVER_ROWS:
        raise ValueError(f"more than {MAX_DRIVER_ROWS} rows do not go into one file")
    return (r.asDict(recursive=True) for r in df.orderBy(*order).toLocalIterator())


def _chunks(lines: Iterable[str]) -> Iterator[bytes]:
    held, size = [], 0
    for line in lines:
        held.append(line.encode())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def publish_json_lines(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> str:
    """One file with the rows in order (a bounded number, checked); returns its SHA-256."""
    lines = (json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in _bounded(df, order))
    return publish_bytes(df.sparkSession, path, _chunks(lines), overwrite)


def publish_lines(df: DataFrame, path: str, order: list[str], line: str = "line", overwrite: bool = False) -> str:
    """One file with a column's lines as they are, in order (a bounded number, checked); returns its SHA-256."""
    return publish_bytes(df.sparkSession, path, _chunks(r[line] + "\n" for r in _bounded(df.select(*dict.fromkeys([line, *order])), order)), overwrite)


def publish_csv(df: DataFrame, path: str, columns: list[str], order: list[str], overwrite: bool = False) -> str:
    def lines() -> Iterator[str]:
        out = io.StringIO()
        writer = csv.DictWriter(out, columns, lineterminator="\n", extrasaction="ignore")
        writer.writeheader()
        for row in _bounded(df, order):
            writer.writerow(row)
            yield out.getvalue()
            out.seek(0)
            out.truncate()
        yield out.getvalue()

    return publish_bytes(df.sparkSession, path, _chunks(lines()), overwrite)


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of parts, for results of any size."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def publish_folder(spark: SparkSession, path: str, files: dict[str, bytes], overwrite: bool = False) -> dict[str, str]:
    """A folder with all files and a checksum list, read back and verified, or no folder at all."""
    refuse_existing(spark, [path], overwrite)
    store, staging = Store(spark, path), f"{path}.{uuid.uuid4().hex}.staging"
    sums = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(files.items())}
    try:
        for name, data in files.items():
            store.write(f"{staging}/{name}", data)
        store.write(f"{staging}/SHA256SUMS", "".join(f"{h}  {n}\n" for n, h in sums.items()).encode())
        for name, h in sums.items():
            if hashlib.sha256(store.read(f"{staging}/{name}")).hexdigest() != h:
                raise OSError(f"{name} was not written as given")
        store.rename(staging, path, overwrite)
    except BaseException:
        store.delete(staging)
        raise
    return sums


def protocol(inputs: dict[str, str], parameters: dict, counts: dict[str, int], output: dict[str, str], following: str) -> dict:
    """The sidecar that pins a stage's inputs, parameters, counts and output."""
    from datetime import datetime, timezone

    return {"created_at_utc": datetime.now(timezone.utc).isoformat(), "inputs_sha256": inputs, "parameters": parameters, "counts": counts, "output": output, "next_stage": following}


def run_logged(command: list[str], log: str, echo: TextIO = sys.stdout) -> int:
    """Runs a command, its output line by line in a log file and on ``echo`` as it comes; returns its exit code."""
    with open(log, "a", encoding="utf-8") as out, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True) as process:
        for line in process.stdout:
            for stream in (out, echo):
                stream.write(line)
                stream.flush()
        return process.wait()
