"""Files of any size on shared storage, read by ranges of their bytes.

Spark lists the files; their bytes are read in tasks through Arrow's file
systems (local, hdfs, s3, gs), a chunk at a time, so nothing is bound by what a
row can hold but the members and lines that are returned.  Work is dealt by
bytes: small files share tasks, large ones are cut where that is possible (the
members of an archive, the lines of a text) and else have a task of their own
(a digest).
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from relata.storage import materialize

SPLIT_BYTES = 128 << 20
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 32 << 20
MAX_VALUE_BYTES = (1 << 31) - (1 << 20)
MAX_TASKS = 20_000
TASKS_A_CORE, BLOCKS_A_TASK = 4, 16
BEHIND_BYTES = 1 << 12


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the place in it."""
    if re.match("file:|/", path):
        return pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    scheme, rest = path.split("://", 1)
    return pa.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{quote(rest)}")


def opened(path: str) -> pa.NativeFile:
    """A seekable file."""
    system, place = _located(path)
    return system.open_input_file(place)


@contextmanager
def created(path: str) -> Iterator[pa.NativeFile]:
    """A new file, in its place once it is whole; a task that is run again replaces it."""
    system, place = _located(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as f:
            yield f
        system.move(part, place)
    except BaseException:
        if system.get_file_info(part).type == pa.fs.FileType.File:
            system.delete_file(part)
        raise


def digest_of(path: str, algorithm: str = "sha256") -> str | None:
    """A file's digest, read in chunks; None if there is no file."""
    system, place = _located(path)
    if system.get_file_info(place).type != pa.fs.FileType.File:
        return None
    digest = hashlib.new(algorithm)
    with system.open_input_file(place) as f:
        while chunk := f.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def file_sizes(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, size_bytes) of files, from their listing alone; hidden ones are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    listing = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    files = listing.select("path", F.col("length").alias("size_bytes"))
    # Spark lists empty files, but plans no task for them.
    listed = listing._jdf.inputFiles()
    if len(listed) == files.count():
        return files
    named = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in listed], "path string")
    return files.union(named.join(files, "path", "left_anti").select("path", F.lit(0).cast("long")))


def _dealt(files: DataFrame) -> DataFrame:
    """Files over ``SPLIT_BYTES`` apart, the others together, in as many tasks as their bytes ask for."""
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = min(MAX_TASKS, max(1, -(-total // SPLIT_BYTES)))
    key = F.when(F.col("size_bytes") > SPLIT_BYTES, F.xxhash64("path")).otherwise(F.pmod(F.xxhash64("path", F.lit(1)), F.lit(tasks)))
    return files.repartition(int(tasks), key)


def file_hashes(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Adds the digest of each file in (path, size_bytes), in a column named like the algorithm; read in chunks, so files may have any size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(path, algorithm) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "size_bytes", algorithm])

    return _dealt(files.select("path", "size_bytes")).mapInArrow(work, f"path string, size_bytes long, {algorithm} string")


# ------------------------------------------------------------ lines


def _tasks(spark: SparkSession, pieces: int, size: int) -> int:
    """Into how many tasks so many pieces of so many bytes in all are dealt: small pieces share tasks, of which there are a few a core or one for ``SPLIT_BYTES``."""
    return int(max(1, min(MAX_TASKS, pieces, max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES)))))


def _by_file(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[tuple]]]:
    """(path, rows) of neighbouring rows with one path, so that a file is opened once for them."""
    return groupby(zip(*(c.to_pylist() for c in batch.columns)), key=itemgetter(0))


def _count_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path, rows in _by_file(batch):
            with opened(path) as f:
                for _, start, end in rows:
                    n = 0
                    f.seek(start)
                    while start < end and (chunk := f.read(min(CHUNK_BYTES, end - start))):
                        n += chunk.count(b"\n")
                        start += len(chunk)
                    counts.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["path", "start", "end", "breaks"])


def _lines_of(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), without their breaks; the last one may end behind, and no more than it asks for is read there."""
    at, skip, held = max(0, start - 1), start > 0, []  # where the next line begins; whether it began before the range; its parts so far
    place, ahead = at, BEHIND_BYTES
    f.seek(place)
    while chunk := f.read(min(CHUNK_BYTES, end - place) if place < end else ahead):
        if place >= end:
            ahead = min(2 * ahead, CHUNK_BYTES)
        place += len(chunk)
        *whole, rest = chunk.split(b"\n")
        for part in whole:
            line = b"".join([*held, part])
            held.clear()
            if not skip:
                yield line
            skip, at = False, at + len(line) + 1
            if at >= end:
                return
        if skip and place >= end:  # the line that began before ends behind the range: none begins here
            return
        held.append(rest)
    if any(held) and not skip:
        yield b"".join(held)


def numbered_lines(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, line_number, line) of text files, from 1 in each, every line as it stands but for its break.

    Ranges of the files' bytes are read apart: line breaks are counted first,
    then each range numbers the lines that begin in it.  Short ranges share
    tasks, neighbours together.
    """
    files = file_sizes(spark, path).filter("size_bytes > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(split).cast("long"))).alias("start"), "size_bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "size_bytes").alias("end"))
    pieces, size = files.agg(F.sum(F.ceil(F.col("size_bytes") / split)), F.sum("size_bytes")).first()
    n = _tasks(spark, pieces or 1, size or 0)
    block = F.floor(F.col("start") / (split * max(1, (pieces or 1) // (n * BLOCKS_A_TASK))))
    deal = lambda df: df.repartition(n, "path", block).sortWithinPartitions("path", "start")
    counted = materialize(deal(ranges).mapInArrow(_count_breaks, "path string, start long, end long, breaks long"), "line-ranges")
    before = F.coalesce(F.sum("breaks").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    placed = counted.select("path", "start", "end", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in _by_file(batch):
                numbers, held, size = [], [], 0
                with opened(name) as f:
                    for _, start, end, earlier in rows:
                        number = earlier + 1
                        if start:  # a line that began before the range has its number there
                            f.seek(start - 1)
                            number += f.read(1) != b"\n"
                        for number, line in enumerate(_lines_of(f, start, end), number):
                            numbers.append(number)
                            held.append(line.decode("utf-8", "replace"))
                            size += len(line)
                            if size >= BATCH_BYTES or len(held) >= 10_000:
                                yield _numbered(name, numbers, held)
                                numbers, held, size = [], [], 0
                if held:
                    yield _numbered(name, numbers, held)

    return deal(placed).mapInArrow(read, "path string, line_number long, line string")


def _numbered(path: str, numbers: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["path", "line_number", "line"])


# ------------------------------------------------------------ archives


def archive_headers(path: str) -> Iterator[tuple[str, int, int]]:
    """(member, offset, size) of an archive's plain files; only headers are read."""
    with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
        end = f.size()
        for m in tar:
            if m.isfile():
                if m.issparse():
                    raise ValueError(f"{path}: {m.name} is stored with holes")
                if m.offset_data + m.size > end:
                    raise ValueError(f"{path} ends within {m.name}")
                yield m.name, m.offset_data, m.size


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, offset, size) of the members of tar archives; every archive's headers are walked by one task, its contents are not read."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for row in archive_headers(name):
                    held.append((name, *row))
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*held)], names=["archive", "member", "offset", "size"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*held)], names=["archive", "member", "offset", "size"])

    archives = file_sizes(spark, path, pattern="*.tar").select("path")
    n = archives.count()
    return archives.repartition(max(1, min(n, MAX_TASKS)), "path").mapInArrow(walk, "archive string, member string, offset long, size long")


def _contents(archive: str, members: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    """Members by their offsets, some ``BATCH_BYTES`` at a time."""
    names: list[str] = []
    values: list[bytes] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([archive] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["archive", "member", "content"])
        names.clear()
        values.clear()
        return made

    held = 0
    with opened(archive) as f:
        for name, offset, size in members:
            if size > MAX_VALUE_BYTES:
                raise ValueError(f"{archive}: {name} is too large for a row")
            if names and held + size > BATCH_BYTES:
                yield batch()
                held = 0
            f.seek(offset)
            names.append(name)
            values.append(f.read(size))
            held += size
    if names:
        yield batch()


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("instances.json", "image.png"), split: int = SPLIT_BYTES) -> DataFrame:
    """(archive, member, content) of the members of tar archives with these endings.

    The headers are walked first; then only the wanted members' bytes are read,
    those of a large archive in as many tasks as they fill ``split`` bytes.
    """
    wanted = archive_index(spark, path).filter(" or ".join(f"endswith(member, '{s}')" for s in suffixes)) if suffixes else archive_index(spark, path)
    index = materialize(wanted, "archive-index", rows=0)
    reach = F.sum("size").over(Window.partitionBy("archive").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))  # names and offsets of one archive
    placed = index.withColumn("slot", F.floor(F.coalesce(reach, F.lit(0)) / split))
    n = _tasks(spark, MAX_TASKS, index.agg(F.sum("size")).first()[0] or 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[tuple[str, int, int]]] = {}
            for archive, *member in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own.setdefault(archive, []).append(tuple(member))
            for archive, members in own.items():
                yield from _contents(archive, members)

    return placed.repartition(n, "archive", "slot").sortWithinPartitions("archive", "offset").select("archive", "member", "offset", "size").mapInArrow(read, "archive string, member string, content binary")


class TarMembers(DataSource):
    """``spark.read.format("tar_members")``: (archive, member, content) of archives, planned from their headers.

    Options: ``path`` (a folder, an archive, or several parted by commas),
    ``suffixes`` (endings of wanted members, parted by commas; all without),
    ``split`` (bytes of members a task reads).  The headers are walked where
    the query is planned, several archives at once; for very many archives
    ``archive_members`` walks them in tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TarReader(dict(self.options))


class Members(InputPartition):
    def __init__(self, archive: str, members: list[tuple[str, int, int]]):
        self.archive, self.members = archive, members


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s) or ("",)
        self.split = int(options.get("split", SPLIT_BYTES))
        if not self.paths:
            raise ValueError("tar_members needs a path")

    def _archives(self) -> list[str]:
        found = []
        for path in self.paths:
            system, place = _located(path)
            if system.get_file_info(place).type == pa.fs.FileType.File:
                found.append(path)
                continue
            start = path[: len(path) - len(place)] if path.endswith(place) else ""
            found += sorted(start + x.path for x in system.get_file_info(pa.fs.FileSelector(place, recursive=True)) if x.path.endswith(".tar"))
        return found

    def partitions(self) -> list[InputPartition]:
        archives = self._archives()
        with ThreadPoolExecutor(16) as pool:
            headers = pool.map(lambda a: [m for m in archive_headers(a) if m[0].endswith(self.suffixes)], archives)
            parts: list[InputPartition] = []
            for archive, members in zip(archives, headers):
                slots: dict[int, list[tuple[str, int, int]]] = {}
                reach = 0
                for m in members:
                    slots.setdefault(reach // self.split, []).append(m)
                    reach += m[2]
                parts += [Members(archive, own) for own in slots.values()]
        return parts or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return _contents(partition.archive, partition.members) if partition.members else iter(())


# ------------------------------------------------------------ writing


def _write_files(rows: DataFrame, file: str, order: list[str], columns: list[str], begin: Callable[[str], AbstractContextManager]) -> None:
    """Each file's rows pass in order through one task: ``begin`` opens a file and gives a function that takes the columns' values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for own, *values in zip(*(batch.column(k).to_pylist() for k in range(1 + len(columns)))):
                if own != name:
                    if held is not None:
                        held.__exit__(None, None, None)
                    name, held = own, begin(own)
                    put = held.__enter__()
                put(*values)
        if held is not None:
            held.__exit__(None, None, None)
        yield from ()

    dealt = rows.repartition(file).sortWithinPartitions(file, *order).select(file, *columns)
    dealt.mapInArrow(work, "done int").write.format("noop").mode("overwrite").save()


def write_lines(rows: DataFrame, folder: str, file: str, order: list[str], line: str = "line") -> None:
    """Text files in a folder, one for each value of ``file``, with its lines in order."""

    @contextmanager
    def begin(name: str) -> Iterator[Callable[[str], object]]:
        with created(f"{folder}/{name}") as f:
            yield lambda text: f.write(f"{text}\n".encode())

    _write_files(rows, file, order, [line], begin)


def write_archives(rows: DataFrame, folder: str, archive: str = "archive", member: str = "member", content: str = "content") -> None:
    """Tar archives in a folder, one for each value of ``archive``, with their members in the order of their names."""

    @contextmanager
    def begin(name: str) -> Iterator[Callable[[str, bytes], None]]:
        with created(f"{folder}/{name}") as f, tarfile.open(fileobj=f, mode="w|") as tar:

            def put(path: str, data: bytes) -> None:
                info = tarfile.TarInfo(path)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))

            yield put

    _write_files(rows, archive, [member], [member, content], begin)
