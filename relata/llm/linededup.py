"""Line dedup by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last ``WINDOW`` line hashes ends a
chunk where it is smaller than at both neighbouring lines.  So a boundary
depends on the few lines around it only, and an inserted or lost line moves no
others.  Lines of ``LONG_LINE`` words or more are chunks of their own, and a
chunk ends after ``MAX_LINES`` lines at the latest.  Chunks of several lines,
and long lines, that occur again anywhere in the corpus are removed everywhere
but at their first place (least id, then least offset).

A repeated passage seldom starts and ends with a chunk, so a repeated chunk is
extended line by line to both sides as far as the lines there equal those
around its first place.  That never goes beyond the chunk on either side: one
that is equal as a whole repeats by itself.  What a chunk carries of its
neighbours is therefore a short list of line hashes and lengths.  A second step
covers passages of so few lines that no chunk lies in them: every two lines that
follow one another (blank lines between them included, lines of white space not
counted) and have ``FEW_WORDS`` words or more together.

Everything that is removed was compared with the bytes at the first place.  A
removed line always has an equal one at an earlier place, so its first stays.

Only hashes and offsets of passages are shuffled to find repeats; text moves
once to cut the repeated ones out for comparison and once to remove them.
Passages that stand in very many places are never brought together: their
places meet a broadcast table of bounded size (``skew.join_counted``), and their
bytes are made distinct in every task before they move.

Defined results: null texts stay null and empty ones empty; rows equal in id
and text are one document and keep or lose the same passages; a text that loses
everything becomes empty; other columns, of any name, pass through unchanged.
Removed passages that overlap or touch are counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm.common import discard, free_name, map_arrow, materialize, passed, quoted, read_table, slices
from relata.llm.skew import join_counted

WINDOW = 2
LONG_LINE = 50
MAX_LINES = 64
FEW_WORDS = 12
CUT_BYTES = 1 << 25
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def is_long(line: bytes, long_line: int) -> bool:
    return len(line) >= 2 * long_line - 1 and len(line.split(None, long_line)) >= long_line


def chunks(data: bytes, window: int = WINDOW, long_line: int = LONG_LINE) -> list[tuple[int, int, int]]:
    """(start, end, number of lines) of the chunks of a text; the line break after a chunk is not in it."""
    lines = data.split(b"\n")
    n = len(lines)
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    ends = list(accumulate(map(len, lines), lambda a, k: a + k + 1))
    rolled, power = [], pow(_MULTIPLIER, window, 1 << 64)
    r = 0
    for i, h in enumerate(hashes):
        r = (r * _MULTIPLIER + h - (hashes[i - window] * power if i >= window else 0)) & _MASK
        rolled.append(r ^ (r >> 29))
    long = [is_long(x, long_line) for x in lines]
    out, first = [], 0
    for i in range(n - 1):
        if long[i] or long[i + 1] or i + 1 - first >= MAX_LINES or 1 <= i < n - 2 and rolled[i - 1] > rolled[i] <= rolled[i + 1]:
            out.append((ends[first - 1] + 1 if first else 0, ends[i], i + 1 - first))
            first = i + 1
    return [*out, (ends[first - 1] + 1 if first else 0, ends[-1], n - first)]


def few_lines(data: bytes, few_words: int = FEW_WORDS) -> set[tuple[int, int]]:
    """(start, end) of every two lines that follow one another and have so many words together."""
    out, at, before, words = set(), 0, -1, 0
    for line in data.split(b"\n"):
        end = at + len(line)
        own = len(line.split(None, few_words))
        if own:
            if before >= 0 and words + own >= few_words:
                out.add((before, end))
            before, words = at, own
        at = end + 1
    return out


Line = tuple[int, int]
Passage = tuple[int, int, "list[Line] | None", "list[Line] | None"]


def passages(data: bytes, long_line: int = LONG_LINE, few_words: int | None = FEW_WORDS) -> list[Passage]:
    """(start, end, lines before, lines after) of what counts in a text.

    A chunk has the hashes and lengths of the lines of the chunk before it, the
    nearest first, and of the one after it; passages of the second step have
    none.
    """
    cut = chunks(data, long_line=long_line)
    lines = [[(xxhash.xxh3_64_intdigest(x) - (1 << 63), len(x)) for x in data[start:end].split(b"\n")] for start, end, _ in cut]
    out: list[Passage] = []
    for k, (start, end, n) in enumerate(cut):
        if (n > 1 or is_long(data[start:end], long_line)) and data[start:end].strip():
            out.append((start, end, lines[k - 1][::-1] if k else [], lines[k + 1] if k + 1 < len(cut) else []))
    taken = {(start, end) for start, end, _, _ in out}
    return out + [(start, end, None, None) for start, end in sorted(few_lines(data, few_words) if few_words else ()) if (start, end) not in taken]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or follow one another (the line break between them included) as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given passages and the line breaks after them."""
    kept, at = [], 0
    for start, end in merge(spans):
        kept.append(data[at:start])
        at = end + 1
    if at > len(data):  # the last line went, and with it the break before it
        return b"".join(kept).removesuffix(b"\n")
    return b"".join(kept) + data[at:]


PLACE = ("id", "text_key", "start")
CHUNK = ("h1", "h2", "size")


LINES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))


def chunk_table(docs: DataFrame, id_column: str, text_column: str, long_line: int = LONG_LINE, few_words: int | None = FEW_WORDS) -> DataFrame:
    """One row per passage that counts: where it is, a 128-bit hash of its bytes, and the lines beside a chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, starts, sizes, digests, before, after = [], [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode()
                for start, end, left, right in passages(data, long_line, few_words):
                    rows.append(k)
                    before.append(left)
                    after.append(right)
                    starts.append(start)
                    sizes.append(end - start)
                    digests.append(xxhash.xxh3_128_digest(data[start:end]))
            at = pa.array(rows, pa.int64())
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), _line_lists(before), _line_lists(after)], names=["id", "text_key", "start", "size", "h1", "h2", "before", "after"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType)] + T._parse_datatype_string("text_key long, start int, size int, h1 long, h2 long, before array<struct<h:long,n:int>>, after array<struct<h:long,n:int>>").fields)
    return docs.select(quoted(id_column).alias("id"), F.xxhash64(quoted(text_column)).alias("text_key"), quoted(text_column)).mapInArrow(cut, schema)


def _line_lists(lists: list[list[Line] | None]) -> pa.Array:
    flat = [x for own in lists for x in own or ()]
    offsets = pa.array([*accumulate((len(own or ()) for own in lists), initial=0)], pa.int32())
    values = pa.StructArray.from_arrays([pa.array([h for h, _ in flat], pa.int64()), pa.array([n for _, n in flat], pa.int32())], names=["h", "n"])
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([own is None for own in lists], pa.bool_()))


def needed(spans: list) -> list:
    """Without the later places that lie within another one: that one removes them too."""
    out, reach = [], -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["size"])):
        end = s["start"] + s["size"]
        if s["first"]:
            out.append(s)
        elif end > reach:
            out.append(s)
            reach = end
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, parts, spans, held = [], [], [], 0

        def cut() -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            columns = [pa.array([s[c] for s in spans], t) for c, t in (("start", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.bool_()))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns, pa.array(parts, pa.binary())], names=["id", "text_key", "start", "size", "h1", "h2", "first", "bytes"])

        for k, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            data = text.encode()
            for s in needed(own):
                rows.append(k)
                spans.append(s)
                parts.append(data[s["start"] : s["start"] + s["size"]])
                held += s["size"]
            if held > CUT_BYTES:
                yield cut()
                rows, parts, spans, held = [], [], [], 0
        yield cut()


def _extended(met: DataFrame) -> DataFrame:
    """The lines on either side of a later place that equal those beside its first one, as passages of both places."""
    out = []
    for side, sign in (("before", -1), ("after", 1)):
        there = F.col(f"place.{side}")
        equal = F.zip_with(side, there, lambda x, y: x.eqNullSafe(y))  # the shorter list is filled with nulls
        stop = F.array_position(equal, False).cast("int")
        lines = F.slice(F.col(side), F.lit(1), F.when(stop == 0, F.size(equal)).otherwise(stop - 1))
        found = met.filter(~F.col("first") & F.col(side).isNotNull()).withColumn("lines", lines).filter(F.size("lines") > 0)
        own_size = F.aggregate("lines", F.lit(0), lambda total, x: total + x["n"] + 1) - 1
        sized = found.withColumns({"own_size": own_size, "own_h1": F.xxhash64("lines"), "own_h2": F.xxhash64("lines", F.lit(7))}).filter(F.col("own_size") >= F.size("lines"))
        start = lambda at: at - 1 - F.col("own_size") if sign < 0 else at + F.col("size") + 1  # noqa: B023, E731
        both = F.array(
            F.struct(*(F.col(c).alias(c) for c in ("id", "text_key")), start(F.col("start")).alias("start"), F.lit(False).alias("first")),
            F.struct(*(F.col(f"place.{c}").alias(c) for c in ("id", "text_key")), start(F.col("place.start")).alias("start"), F.lit(True).alias("first")),
        )
        each = sized.select(F.col("own_size").alias("size"), F.col("own_h1").alias("h1"), F.col("own_h2").alias("h2"), F.inline(both))
        out.append(each.select(*PLACE, *CHUNK, "first"))
    return out[0].union(out[1])


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", long_line: int = LONG_LINE, few_words: int | None = FEW_WORDS) -> DataFrame:
    """(id, text_key, start, size) of every passage to remove: a later place of bytes that stand at an earlier one."""
    table = materialize(chunk_table(docs, id_column, text_column, long_line, few_words), "line-chunks")
    groups = table.groupBy(*CHUNK).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE, "before", "after")).alias("place"), F.max(F.struct(*PLACE)).alias("last")).filter(F.struct(*(F.col(f"place.{c}") for c in PLACE)) != F.col("last")).drop("last")
    repeated = materialize(groups, "line-groups")
    places = join_counted(table, repeated, list(CHUNK), table.count())
    told = materialize(places.withColumn("first", F.struct(*PLACE).eqNullSafe(F.struct(*(F.col(f"place.{c}").alias(c) for c in PLACE)))), "line-places")
    discard(table, repeated)
    met = told.select(*PLACE, *CHUNK, "first").union(_extended(told))
    wanted = met.groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "size", "h1", "h2", "first")).alias("spans"))
    texts = docs.filter(quoted(text_column).isNotNull()).select(quoted(id_column).alias("i"), F.xxhash64(quoted(text_column)).alias("k"), quoted(text_column).alias("t"))
    both = texts.join(wanted.hint("shuffle_hash"), F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("text_key"))).select("id", "text_key", "t", "spans")
    schema = T.StructType([wanted.schema["id"]] + T._parse_datatype_string("text_key long, start int, size int, h1 long, h2 long, first boolean, bytes binary").fields)
    found = materialize(both.mapInArrow(_cut_out, schema), "line-repeats")
    discard(told)
    # Equal bytes are brought together in every task first, so a passage that is everywhere is a few rows here.
    contents = found.groupBy(*CHUNK, "bytes").agg(F.count("*").alias("n")).groupBy(*CHUNK).agg(F.count("*").alias("contents"), F.sum("n").alias("n"))
    kinds = materialize(contents, "line-contents")
    later = found.select(*PLACE, *CHUNK, "first")
    spans = join_counted(later, kinds, list(CHUNK), found.count()).filter("not first and contents = 1").select(*PLACE, "size")
    if kinds.filter("contents > 1").isEmpty():
        return spans.distinct()
    # Different bytes under one hash: each place is compared with the first.
    mixed = found.join(kinds.filter("contents > 1").select(*CHUNK), list(CHUNK), "left_semi")
    first = mixed.filter("first").select(*CHUNK, F.col("bytes").alias("first_bytes")).dropDuplicates(list(CHUNK))
    return spans.union(mixed.filter("not first").join(first, list(CHUNK)).filter(F.col("bytes") == F.col("first_bytes")).select(*PLACE, "size")).distinct()


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", long_line: int = LONG_LINE, few_words: int | None = FEW_WORDS, out: tuple[str, str] = ("n_removed", "removed_bytes")) -> DataFrame:
    """``docs`` with repeated passages gone from the text, and the number of passages and bytes removed; these replace columns of their names."""
    spans = repeated_spans(docs, id_column, text_column, long_line, few_words).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    names = passed(docs.columns, out)
    place = names.index(text_column)
    own_id, own_key, own_spans = (free_name(docs.columns, x) for x in ("id", "text_key", "spans"))
    spans = spans.toDF(own_id, own_key, own_spans)
    joined = docs.join(spans.hint("shuffle_hash"), quoted(id_column).eqNullSafe(F.col(own_id)) & (F.xxhash64(quoted(text_column)) == F.col(own_key)), "left").select(*map(quoted, names), own_spans)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, sizes = [], [], []
            for text, own in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                after, gone = text, []
                if text is not None and own:
                    gone = merge([(s["start"], s["start"] + s["size"]) for s in own])
                    after = remove(text.encode(), gone).decode()
                texts.append(after)
                counts.append(len(gone))
                sizes.append(sum(end - start for start, end in gone))
            columns = [batch.column(i) if i != place else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=[*names, *out])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out[0], T.LongType()), T.StructField(out[1], T.LongType())])
    return map_arrow(joined, clean, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
