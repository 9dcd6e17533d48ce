"""Sequence packing: best fit, then a local search that exchanges documents between underfull bins.

A document's tokens and a closing id are cut only if they exceed the capacity:
into pieces of the capacity, the first of which may be shorter.  How well
pieces pack depends only on how many there are of each length, so the plan is
made from that histogram (at most ``capacity`` numbers, whatever the input's
size).  Bins with equal contents form one class with a multiplicity; best fit
by decreasing length fills the classes, and the search then moves one piece, or
exchanges one for one or two for one, between underfull classes, always
increasing the sum of squared fills, until bins empty or no exchange helps.

Pieces are numbered within their length without gathering a length in one
task: frequent lengths are split into cells by a hash, cells are numbered
separately and shifted by the counts of the cells before them.  Each worker
finds a piece's sequence and offset from its number in the broadcast plan,
whose size is bounded by the capacity too (it is checked).

Defined results: a null text is empty and gives one piece that holds the
closing id; repeated rows are packed each; ids may be null; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import materialize, read_table, slices

CAPACITY = 1024
CLOSING_ID = 2
CELL_ROWS, CELLS_TOGETHER = 1024, 1024
MAX_PLAN_BLOCKS = 1_000_000
KEPT_BYTES, NEW_BYTES = 72 << 20, 24 << 20
UNIT_BYTES = 180
WHOLE = b""
SPACE_TOKEN = "Ġ"
# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AT_EDGE, OTHER = re.compile(r" \s|\s "), re.compile(r"[^\x00-\u024F]")
BATCH_CHARS = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters as themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def unit_bytes(unit: str, ids: bytes) -> int:
    """About what a kept unit takes: two objects, their place in the table, and what they hold (up to two bytes a character as a rule)."""
    return UNIT_BYTES + 2 * len(unit) + len(ids)


class UnitEncoder:
    """Token ids (little-endian bytes) of texts, put together from those of space-led units, which are kept.

    The tokenizer's own pre-splitting never joins a single space and the
    characters after it with anything before, so the ids of a text are the ids
    of its units in a row as long as no unit is empty or begins or ends with
    white space; texts with such units, and texts that hold one of the
    tokenizer's added tokens, are encoded whole.  The unknown units of many
    texts are encoded in one call and told apart by the tokens that lead with a
    space.  The faster of two public implementations does that, on the
    vocabulary of the same file, for characters up to U+024F, whose classes no
    version of Unicode has changed; all else is the stated library's (tests
    hold both equal).
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        to_byte = byte_of_character()
        ranks = {bytes(map(to_byte.__getitem__, token)): k for token, k in vocabulary.items() if token not in self.special}
        self.plain = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[k for token, k in vocabulary.items() if token.startswith(SPACE_TOKEN)]] = True
        self.units: dict[str, bytes] = {}
        self.held = 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def short(self, text: str) -> bytes:
        """A text without added tokens."""
        return self.whole(text) if OTHER.search(text) else np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode unknown units; WHOLE stands for one whose text must be encoded whole."""
        joined = " " + " ".join(new)
        if "" in new or AT_EDGE.search(joined) or new and new[-1][-1].isspace():
            edged = [u for u in new if not u or u[0].isspace() or u[-1].isspace()]
            self.units.update(dict.fromkeys(edged, WHOLE))
            new = list(set(new).difference(edged))
            joined = " " + " ".join(new)
        if OTHER.search(joined):
            other = [u for u in new if OTHER.search(u)]
            self.units.update((u, self.whole(" " + u)) for u in other)
            new = list(set(new).difference(other))
            joined = " " + " ".join(new)
        if not new:
            return
        ids = np.array(self.plain.encode_ordinary(joined), dtype="<u4")
        heads = np.nonzero(self.leads[ids])[0]
        if len(heads) != len(new) or heads[0]:
            self.units.update((u, self.whole(" " + u)) for u in new)
            return
        data, at = ids.tobytes(), [*(4 * heads).tolist(), 4 * len(ids)]
        self.units.update((u, data[a:b]) for u, a, b in zip(new, at, at[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > KEPT_BYTES + NEW_BYTES:  # what came early, and so often, stays
            for u in reversed(list(self.units)):
                if self.held <= KEPT_BYTES:
                    break
                self.held -= unit_bytes(u, self.units.pop(u))
        get = self.units.get
        split: list[list[str] | None] = [None if any(map(t.__contains__, self.special)) else t.split(" ") for t in texts]
        first = [units.pop(0) if units else "" for units in split]
        known = [list(map(get, units)) if units else [] for units in split]
        unknown = {u for units, own in zip(split, known) if None in own for u, x in zip(units, own) if x is None}
        if unknown:
            self._learn(list(unknown))
            self.held += UNIT_BYTES * len(unknown) + 2 * sum(map(len, unknown)) + sum(map(len, map(get, unknown)))
        out = []
        for text, head, units, own in zip(texts, first, split, known):
            if None in own:
                own = [get(u) if x is None else x for u, x in zip(units, own)]
            if units is None or not head or head[-1].isspace() or WHOLE in own:
                out.append(self.whole(text))
            else:
                out.append(self.short(head) + b"".join(own))
        return out


def by_size(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about BATCH_CHARS characters, or one longer text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    first = n % capacity or capacity
    ends = range(first, n + 1, capacity)
    return [(max(0, e - (first if e == first else capacity)), first if e == first else capacity) for e in ends]


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path, tail = tokenizer or default_tokenizer(), np.array([closing_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = workers.kept(("packing", path), lambda: UnitEncoder(path))
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for k, ids in enumerate(x for part in by_size([t or "" for t in texts]) for x in units.encode(part)):
                ids += tail
                for p, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)]).add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column)).mapInArrow(encode, schema)


Content = tuple[int, ...]


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Content, int]:
    """Contents (lengths, descending) of bins and how many bins hold each."""
    classes: dict[Content, int] = defaultdict(int)
    open_by_room: dict[int, dict[Content, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(content: Content, n: int) -> None:
        room = capacity - sum(content)
        if room == 0:
            classes[content] += n
            return
        if not open_by_room[room]:
            insort(rooms, room)
        open_by_room[room][content] = open_by_room[room].get(content, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                content, n = open_by_room[room].popitem()
                if not open_by_room[room]:
                    rooms.pop(at)
            else:
                room, content, n = capacity, (), left
            each = room // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            part = min(part, each - 1) if part else 0
            if full:
                put(content + (length,) * each, full)
            if part:
                put(content + (length,) * part, 1)
            if content and n - full - bool(part):
                put(content, n - full - bool(part))
            left -= full * each + part
    for group in open_by_room.values():
        for content, n in group.items():
            classes[content] += n
    return {c: n for c, n in classes.items() if n and c}


@lru_cache(maxsize=1 << 16)
def _choices(content: Content) -> tuple[np.ndarray, np.ndarray]:
    """One piece, and two pieces, that a bin can give: rows of lengths, each choice once, by their sum."""
    counts = Counter(content)
    ones = sorted(counts)
    twos = sorted(((x, y) for k, x in enumerate(ones) for y in ones[k:] if x != y or counts[x] > 1), key=sum)
    return np.array([(x, 0) for x in ones], dtype=np.int64), np.array(twos, dtype=np.int64).reshape(-1, 2)


def _best_swap(source: Content, target: Content, room: int) -> tuple[int, Content, Content] | None:
    """(gain, out, back) of the exchange that fills the target most: one piece for none, one or two, or two for one."""
    best: tuple[int, Content, Content] | None = None
    ones, twos = _choices(source)
    own, pairs = _choices(target)
    nothing = np.zeros((1, 2), np.int64)
    for outs, backs in ((ones, nothing), (ones, own), (twos, own), (ones, pairs)):
        if not len(outs) or not len(backs):
            continue
        given, taken = outs.sum(axis=1), backs.sum(axis=1)
        at = np.searchsorted(given, taken + room, side="right") - 1
        gains = np.where(at >= 0, given[at] - taken, 0)
        k = int(gains.argmax())
        if gains[k] > 0 and (best is None or gains[k] > best[0]):
            best = int(gains[k]), tuple(int(x) for x in outs[at[k]] if x), tuple(int(x) for x in backs[k] if x)
    return best


def _replace(content: Content, out: Content, into: Content) -> Content:
    items = list(content)
    for x in out:
        items.remove(x)
    return tuple(sorted([*items, *into], reverse=True))


def local_search(classes: dict[Content, int], capacity: int) -> dict[Content, int]:
    """Empty bins by exchanges that increase the sum of squared fills, from the emptiest bins on; stops at the least possible number of bins, or when nothing helps.

    A class that found no exchange is tried again only with classes that came later.
    """
    classes = dict(classes)
    least = -(-sum(sum(c) * n for c, n in classes.items()) // capacity)
    born, tried, now = dict.fromkeys(classes, 0), {}, 1
    total = sum(classes.values())

    def add(content: Content, n: int) -> None:
        nonlocal total
        if not content:
            return
        total += n
        classes[content] = classes.get(content, 0) + n
        if n > 0 and (classes[content] == n or classes[content] < 2 * n):
            born[content] = now
        if classes[content] <= 0:
            del classes[content]

    while total > least:
        underfull = sorted((c for c in classes if sum(c) < capacity), key=lambda c: (sum(c), c))
        newest = max((born[c] for c in underfull), default=0)
        best = source = None
        for source in (c for c in underfull if tried.get(c, -1) < newest):
            fill, since = sum(source), tried.get(source, -1)
            for target in reversed(underfull):
                if sum(target) < fill:
                    break
                if max(born[target], born[source]) <= since or target == source and classes[source] < 2:
                    continue
                found = _best_swap(source, target, capacity - sum(target))
                if found and (best is None or (sum(target) + found[0], found[0]) > best[:2]):
                    best = (sum(target) + found[0], found[0], target, *found[1:])
                    if best[0] == capacity:
                        break
            if best:
                break
            tried[source] = now
        if best is None:
            break
        _, _, target, out, back = best
        n = classes[source] // 2 if target == source else min(classes[source], classes[target])
        n = max(1, min(n, (total - least) * len(source)))
        now += 1
        for content, change in ((source, -n), (target, -n), (_replace(source, out, back), n), (_replace(target, back, out), n)):
            add(content, change)
    return classes


def plan_blocks(classes: dict[Content, int]) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first sequence, first offset), sorted: pieces of a length take ranks in order."""
    taken: dict[int, int] = defaultdict(int)
    blocks, sequence = [], 0
    for content in sorted(classes, reverse=True):
        n, offset = classes[content], 0
        for length in sorted(set(content), reverse=True):
            copies = content.count(length)
            blocks.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * n
            offset += copies * length
        sequence += n
    if len(blocks) > MAX_PLAN_BLOCKS:
        raise ValueError(f"a plan of {len(blocks)} blocks is too large to broadcast")
    return np.array(sorted(blocks), dtype=np.int64).reshape(-1, 5)


def number_within_length(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, ... within each length.  Rows are dealt to cells by their place in the stored table, so rows that repeat are spread too."""
    longest = max(histogram, default=0)
    cells = F.lit([max(1, -(-histogram.get(n, 0) // CELL_ROWS)) for n in range(longest + 1)])
    celled = pieces.withColumn("place", F.monotonically_increasing_id()).withColumn("cell", F.pmod(F.xxhash64("place"), F.get(cells, F.col("length").cast("int"))))
    sizes = celled.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn("many", F.floor(F.col("cell") / CELLS_TOGETHER))
    earlier = (Window.unboundedPreceding, -1)
    # Cells are numbered in groups, and the groups then, so no task sees all cells of a length.
    groups = sizes.groupBy("length", "many").agg(F.sum("n").alias("n"))
    shifts = groups.select("length", "many", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("many").rowsBetween(*earlier)), F.lit(0)).alias("shift"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("length", "many").orderBy("cell").rowsBetween(*earlier)), F.lit(0))
    before = sizes.withColumn("inside", inside).join(shifts, ["length", "many"]).select("length", "cell", (F.col("shift") + F.col("inside")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("place")) - 1
    return celled.withColumn("own", own).join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("own")).drop("cell", "own", "before", "place")


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece with the sequence and the offset at which it stands there."""
    pieces = materialize(token_pieces(docs, id_column, text_column, tokenizer, capacity, closing_id), "packing-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = plan_blocks(local_search(best_fit(histogram, capacity), capacity))
    plan = docs.sparkSession.sparkContext.broadcast(blocks)
    numbered = number_within_length(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, copies, sequence, offset = plan.value.T
        keys = (length << 44) + first
        for batch in slices(batches, 1 << 14):
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * n)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType(numbered.schema.fields[:5]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return numbered.mapInArrow(place, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
