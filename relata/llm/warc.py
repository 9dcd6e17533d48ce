"""WARC archives of web pages, and their capture index by external merge.

Writing: pages with equal payloads are found through their digests alone; the
page with the smallest id keeps the payload (response), the others refer to it
(revisit).  A digest that very many pages share is not brought together
(``skew.join_counted``).  Every task writes gzip-member archives of at most
about ``FILE_BYTES`` into the shared folder, and beside each its index entries
as a run: sorted by URL key, time and id, in batches of ``RUN_ROWS`` rows that
can be read one by one.  Only the batches' first and last keys, the fences, are
returned as rows.  Only files named by a finished task's rows are read, so a
lost attempt leaves nothing behind that counts.

Index: the runs are merged as they lie, never sorted again.  A pass merges
groups of about ``FAN_IN`` runs into one run each, until one is left.  In a
pass the fences, and they alone, are numbered in their order, which cuts each
group into ranges of about ``RANGE_FENCES`` fences; so ranges are sized by
rows, a frequent URL's captures are cut too, and a pass has as many tasks as
there are ranges.  A task streams its range out of the runs that reach into it,
one batch of each in memory at a time, through a loser tree.  Positions become
global by adding the sizes of the ranges before.

Defined results: a null html is an empty payload; a null URL has the empty key;
rows equal in id and payload have the same role; ids may have any type that can
be cast from text; a null id is written and read back as null; an empty table
writes nothing.  A page has no capture time, so its id counts seconds from
``FIRST_CAPTURE`` (an id that is no number: its crc32) unless a time column is
named.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from relata.llm import workers
from relata.llm.common import discard, intermediates, materialize, read_table, shared_dir, slices
from relata.llm.skew import bit_filter, join_counted, parted
from relata.operators.compare import number_rows

FILE_BYTES = 32 << 20
MIN_REVISIT_BYTES = 0
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=timezone.utc)
ID_PREFIX, NO_ID = "urn:page:", "urn:page"
RUN_ROWS, FAN_IN, RANGE_FENCES, MAX_TASKS = 1024, 64, 256, 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else "file://" + uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; without scheme, user, port, fragment and letter case of the host."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.strip()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def _urn(page_id) -> str:
    return f"<{NO_ID}>" if page_id is None else f"<{ID_PREFIX}{quote(str(page_id), safe='')}>"


def _page(field: str) -> str | None:
    text = field.strip("<>")
    return None if text == NO_ID else unquote(text.removeprefix(ID_PREFIX))


def record(page_id, url, when: str, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", when)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")))
    head.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, block


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of the gzip members of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(wbits=31)
        content = d.decompress(view[at : at + (1 << 16)])
        taken = at + (1 << 16)
        while not d.eof and taken < len(data):
            content += d.decompress(view[taken : taken + (1 << 20)])
            taken += 1 << 20
        size = min(taken, len(data)) - at - len(d.unused_data)
        if not d.eof:
            raise ValueError("an archive is cut short")
        yield at, size, content
        at += size


KEY = ["url_key", "captured", "no_id", "page_id", "file", "position"]


def _index_schema(id_type: T.DataType) -> pa.Schema:
    return pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", to_arrow_type(id_type)), ("file", pa.string()), ("position", pa.int64()), ("size", pa.int64())])


def _key(row: tuple) -> tuple:
    """Of an index row; unique, as file and position are."""
    return row[0], row[1], row[2] is None, row[2], row[3], row[4]


class RunWriter:
    """A sorted run in batches that can be read one by one, and its fences."""

    def __init__(self, store: pa.fs.FileSystem, root: str, schema: pa.Schema, rows: int = RUN_ROWS):
        self.store, self.root, self.schema, self.rows = store, root, schema, rows
        self.out = self.file = None
        self.held: list[tuple] = []
        self.fences: list[tuple] = []
        self.name = f"{uuid.uuid4().hex}.run"

    def add(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) == self.rows:
            self._write()

    def _write(self) -> None:
        if self.out is None:
            self.file = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.out = pa.ipc.new_file(self.file, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held), self.schema)], schema=self.schema))
        self.fences.append((self.name, len(self.fences), _key(self.held[0]), _key(self.held[-1])))
        self.held = []

    def finish(self) -> list[tuple]:
        """(segment, batch, first key, last key) of every batch."""
        if self.held:
            self._write()
        if self.out is not None:
            self.out.close()
            self.file.close()
        return self.fences


def _fence_schema(id_type: T.DataType) -> T.StructType:
    key = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()), T.StructField("no_id", T.BooleanType()), T.StructField("page_id", id_type), T.StructField("file", T.StringType()), T.StructField("position", T.LongType())])
    return T.StructType([T.StructField("run", T.StringType()), T.StructField("segment_no", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("low", key), T.StructField("high", key)])


def _fence_batch(fences: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """fences: (run, segment_no, segment, batch, first key, last key)."""
    keys = to_arrow_type(schema["low"].dataType)
    columns = list(zip(*fences)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), *(pa.array([dict(zip(KEY, k)) for k in c], keys) for c in columns[4:])], names=schema.names)


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", time_column: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives and their runs; returns the fences of the runs, one per batch of index entries."""
    payload = F.coalesce(html_column, F.lit("")).cast("binary")
    when = F.date_format(F.to_utc_timestamp(time_column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_column else F.lit(None).cast("string")
    id_type = pages.schema[id_column].dataType
    own = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"), when.alias("when"), F.xxhash64(payload).alias("mark"))
    # Only digests are brought together.  Of the payloads those move that repeat, by a filter of fixed size over their marks.
    digests = own.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "mark", F.sha2("payload", 256).alias("same"))
    first = materialize(digests.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.first("mark").alias("mark")).filter("n > 1"), "warc-repeated")
    lone, perhaps = parted(own, bit_filter(first, "mark"), "mark")
    met = join_counted(perhaps.withColumn("same", F.sha2("payload", 256)), first.drop("mark"), ["same"], pages.count(), how="left")
    columns = ("page_id", "url", "payload", "when")
    paired = met.select(*columns, "first").union(lone.select(*columns, F.lit(None).cast(id_type).alias("first")))
    schema, entry = _fence_schema(id_type), _index_schema(id_type)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, path, entries, size = None, "", [], 0

        def finish() -> pa.RecordBatch:
            out.close()
            run = RunWriter(store, root, entry, RUN_ROWS)
            for e in sorted(entries, key=_key):
                run.add(e)
            return _fence_batch([(run.name, 0, *f) for f in run.finish()], schema)

        for batch in slices(batches, 64):
            for page_id, url, data, when, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, entries, size = f"{uuid.uuid4().hex}.warc.gz", [], 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                if not when:
                    seconds = page_id if isinstance(page_id, int) else zlib.crc32(str(page_id or "").encode())
                    when = (FIRST_CAPTURE + timedelta(seconds=seconds % (1 << 30))).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = gzip.compress(record(page_id, url, when, data, original, original is not None and original != page_id), 4, mtime=0)
                out.write(member)
                entries.append((url_key(url), when, page_id, path, size, len(member)))
                size += len(member)
                if size >= FILE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return materialize(paired.mapInArrow(write, schema), "warc-fences")


RECORDS = "file string, position long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in the index; stored payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                rows: list[tuple] = []
                for at, size, content in members(data):
                    fields, block = parse(content)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != length or digest(payload) != own):
                        raise ValueError(f"{name} at {at}: the payload does not match its digest")
                    rows.append((name, at, _page(fields["WARC-Record-ID"]), length, own, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None) + ((None if revisit else payload,) if with_payload else ()))
                    if len(rows) == 1024 or at + size == len(data):
                        yield _records(rows)
                        rows = []

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = [*(x.split()[0] for x in RECORDS.split(", ")), "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[: 7 + with_payload])

    id_type = index.schema["page_id"].dataType
    names = index.select("file").distinct()
    # One archive is a fair piece of work, so small tables of names are dealt to many tasks.
    dealt = names.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.mapInArrow(read, RECORDS + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path only."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._replay(i)


def _ranges(fences: DataFrame, groups: int) -> DataFrame:
    """(grp, slot, low, high, parts): which batches reach into each range of keys from low on and before high."""
    key = [F.col(f"key.{c}").alias(c) for c in KEY]
    grouped = fences.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
    points = grouped.select("grp", "run", "segment_no", "segment", "batch", F.explode(F.array("low", "high")).alias("key")).select("grp", "run", "segment_no", "segment", "batch", *key)
    # Fences alone are numbered; both ends of a batch tell which ranges it reaches into.
    numbered = number_rows(points, ["grp", *KEY]).withColumn("slot", F.floor((F.col("run_index") - 1) / RANGE_FENCES))
    spans = numbered.groupBy("grp", "run", "segment_no", "segment", "batch").agg(F.min("slot").alias("a"), F.max("slot").alias("z"))
    lows = numbered.groupBy("grp", "slot").agg(F.min(F.struct(*KEY)).alias("low"))
    bounds = lows.withColumn("high", F.lead("low").over(Window.partitionBy("grp").orderBy("slot")))
    parts = spans.select("grp", "run", "segment_no", "segment", "batch", F.explode(F.sequence("a", "z")).alias("slot"))
    listed = parts.groupBy("grp", "slot").agg(F.collect_list(F.struct("run", "segment_no", "segment", "batch")).alias("parts"))
    return listed.join(bounds, ["grp", "slot"])


def _stream(store: pa.fs.FileSystem, root: str, parts: list[dict], low: tuple, high: tuple | None) -> Iterator[tuple]:
    """One run's rows from low on and before high; a batch in memory at a time."""
    opened, name = None, None
    for p in sorted(parts, key=lambda p: (p["segment_no"], p["batch"])):
        if p["segment"] != name:
            name, opened = p["segment"], pa.ipc.open_file(store.open_input_file(f"{root}/{p['segment']}"))
        for row in zip(*(c.to_pylist() for c in opened.get_batch(p["batch"]).columns)):
            key = _key(row)
            if high is not None and key >= high:
                return
            if key >= low:
                yield row


def merge_index(fences: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """Every index entry (file, position, size, url_key, captured, page_id) with capture_order, its place in the order of the keys over all archives."""
    id_type = fences.schema["low"].dataType["page_id"].dataType
    schema, entry = _fence_schema(id_type), _index_schema(id_type)

    def merged(row: dict) -> Iterator[tuple]:
        store, root = open_store(folder)
        by_run: dict[str, list[dict]] = {}
        for p in row["parts"]:
            by_run.setdefault(p["run"], []).append(p)
        low, high = (None if row[c] is None else tuple(row[c][k] for k in KEY) for c in ("low", "high"))
        return iter(LoserTree([_stream(store, root, parts, low, high) for _, parts in sorted(by_run.items())], key=_key))

    def to_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        store, root = open_store(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            run = RunWriter(store, root, entry, RUN_ROWS)
            for x in merged(row):
                run.add(x)
            yield _fence_batch([(f"{row['level']}-{row['grp']}", row["slot"], *f) for f in run.finish()], schema)

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        names = [*entry.names, "slot", "own"]
        for row in (r for batch in batches for r in batch.to_pylist()):
            held: list[tuple] = []
            for k, x in enumerate(merged(row)):
                held.append((*x, row["slot"], k))
                if len(held) == 4096:
                    yield _rows(held, names)
                    held = []
            if held:
                yield _rows(held, names)

    def _rows(held: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (*(f.type for f in entry), pa.int64(), pa.int64()))], names=names)

    level = 0
    with intermediates() as made:
        while True:
            runs = fences.select("run").distinct().count()
            groups = 1 if runs <= fan_in else -(-runs // fan_in)
            ranges = materialize(_ranges(fences, groups).withColumn("level", F.lit(level)), "warc-ranges")
            tasks = ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)))
            if groups == 1:
                out = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()), T.StructField("page_id", id_type)]).add("file", "string").add("position", "long").add("size", "long").add("slot", "long").add("own", "long")
                rows = materialize(tasks.mapInArrow(to_rows, out), "warc-merged")
                break
            fences = materialize(tasks.mapInArrow(to_run, schema), "warc-fences")
            level += 1
    discard(*made[:-1])
    # One row per range.
    sizes = rows.groupBy("slot").agg(F.count("*").alias("n"))
    shifts = sizes.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    return rows.join(shifts.hint("merge"), "slot").withColumn("capture_order", F.col("shift") + F.col("own")).drop("slot", "own", "shift")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = merge_index(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)
    history = index.select("file", "position", "url_key", "captured", "capture_order")
    return read_archives(index, folder).join(history.hint("merge"), ["file", "position"]).drop("file", "position")


def oracle() -> str:
    """The same results in DuckDB SQL, for tables whose page ids differ and whose URLs are plain: a scheme, a host in ASCII, path, query, fragment."""
    return f"""
with p as (select page_id, url, encode(coalesce(html, '')) as payload, sha1(encode(coalesce(html, ''))) as h from pages),
r as (select *, min(page_id) over (partition by payload) as first,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]*)', 1)), '.')), ',') || ')'
    || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || case when regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) <> '' then '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) else '' end as url_key,
  strftime(timestamp '{FIRST_CAPTURE:%Y-%m-%d}' + to_seconds(page_id % {1 << 30}), '%Y-%m-%dT%H:%M:%SZ') as captured from p)
select page_id, octet_length(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * (k // 4) + 1)::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to,
  url_key, captured, row_number() over (order by url_key, captured, page_id) - 1 as capture_order from r"""
