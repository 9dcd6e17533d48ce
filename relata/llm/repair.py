"""Conversation structure repair: damage, diagnosis, and the cheapest edits that restore alternating turns.

The roles' initials of a repaired conversation read ``(s?(ua)+)?``.  Reading
them takes four states: nothing yet, after s, after u, after a.  The edits of a
row lead from state to state, and the cheapest way to each state is kept with
its letters while a recursive DuckDB query, run in every task over a batch of
whole conversations dealt by a hash of their id, advances one row of all of
them a step.  Two ways to one state over the same rows never have one cost
where one is the beginning of the other, so the least letters of a beginning
stay the least of the whole, and ways may be joined end to end.

That is also how a conversation of any length is repaired: those of more than
``LONG_ROWS`` rows or ``LONG_BYTES`` of text are numbered by ranges of their
rows without their texts, cut into blocks of ``BLOCK_ROWS``, and the ways from
every state to every state through each block are worked out apart and joined
in order afterwards.  The digest of a repaired text reads its rows one after
another, as SHA-256 asks for; they pass through the task, which holds a batch
of them and the letters.

Defined results: a null role or text counts as one space, a null id or turn is
one space where the damage is drawn, and rows with a null id are one
conversation; rows of one turn are taken by role and then by the MD5 of their
text; a role that is empty or starts with another letter cannot be kept;
repeated rows are turns like others; other columns are not read; a
conversation's letters are one value, so its rows are bound by what a value can
hold; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import discard, intermediates, materialize, read_table
from relata.llm.skew import join_counted
from relata.operators.compare import number_rows

LONG_ROWS, LONG_BYTES = 1024, 16 << 20
BLOCK_ROWS = 512
BATCH_ROWS, BATCH_BYTES = 16_384, 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NAMES = {"u": "user", "a": "assistant"}
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
#: How many inserted rows lead from a state to another; more never pay.
INSERTS = {(p, p): 0 for p in range(4)} | {(START, AFTER_U): 1, (START, AFTER_A): 2, (AFTER_S, AFTER_U): 1, (AFTER_S, AFTER_A): 2, (AFTER_U, AFTER_A): 1, (AFTER_A, AFTER_U): 1}
KEEPS = {"s": {START: AFTER_S}, "u": dict.fromkeys((START, AFTER_S, AFTER_A), AFTER_U), "a": {AFTER_U: AFTER_A}}
CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
Way = tuple[int, str]


def moves() -> list[tuple[int, str, bool, bool, int, int, str]]:
    """(state, initial, must go, truncated, next state, cost, letters) of every edit of a row behind the rows inserted before it."""
    found = []
    for (p, q), n in INSERTS.items():
        for initial in ("s", "u", "a", ""):
            for gone in (False, True):
                for cut in (False, True):
                    edits = [(q, DELETE, "D")]
                    if not gone:
                        edits += [(KEEPS[initial][q], TRUNCATED * cut, "K")] if q in KEEPS.get(initial, {}) else []
                        edits.append((AFTER_A if q == AFTER_U else AFTER_U, REROLE + TRUNCATED * cut, "R"))
                    found += [(p, initial, gone, cut, to, INSERT * n + cost, "I" * n + letter) for to, cost, letter in edits]
    return found


# One step of the recursion takes the next row of every group; of the ways to a state the cheapest stays, of those the least in letters.
STEP = """
with recursive ways(g, first, k, state, cost, audit) as (
  select g, state, 0::bigint, state, 0::bigint, '' from starts
  union all
  select g, first, k, state, (best).cost, (best).audit from (
    select w.g, w.first, r.k, m.next as state, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) as best
    from ways w join parts r on r.g = w.g and r.k = w.k + 1 join moves m on m.state = w.state and m.initial = r.initial and m.gone = r.gone and m.cut = r.cut
    group by w.g, w.first, r.k, m.next))
select ways.g, first, state, cost, audit from ways join sizes on sizes.g = ways.g and sizes.n = ways.k"""


def _engine():
    import duckdb

    engine = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    engine.execute("create table moves (state int, initial varchar, gone boolean, cut boolean, next int, cost int, letters varchar)")
    engine.executemany("insert into moves values (?, ?, ?, ?, ?, ?, ?)", moves())
    return engine


@dataclass
class Block:
    """Rows of a conversation in order, and what is counted over them."""

    initials: list[str] = field(default_factory=list)
    gone: list[bool] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> None:
        """Turns come in rising order, nulls first."""
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in ("su", "ua", "au")
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.initials.append(initial)
        self.gone.append(blank or again)
        self.cut.append(cut)


def cheapest(blocks: list[tuple[Block, tuple[int, ...]]]) -> list[dict[tuple[int, int], Way]]:
    """For each block the cheapest way from each of the given states to each state."""
    engine = workers.kept("repair", _engine)
    found: list[dict[tuple[int, int], Way]] = [{(s, s): (0, "") for s in starts} if not block.initials else {} for block, starts in blocks]
    classes: dict[int, list[int]] = {}
    for g, (block, _) in enumerate(blocks):  # a step looks through all rows of its query, so long blocks go apart from short ones
        if block.initials:
            classes.setdefault((len(block.initials) - 1).bit_length() // 2, []).append(g)
    for own in classes.values():
        # Only the named initials are told apart.
        rows = [(g, k, i if i in KEEPS else "", gone, cut) for g in own for k, (i, gone, cut) in enumerate(zip(blocks[g][0].initials, blocks[g][0].gone, blocks[g][0].cut), 1)]
        for name, columns, data in (("parts", "g k initial gone cut", rows), ("starts", "g state", [(g, s) for g in own for s in blocks[g][1]]), ("sizes", "g n", [(g, len(blocks[g][0].initials)) for g in own])):
            engine.register(name, pa.table([pa.array(c) for c in zip(*data)], names=columns.split()))
        for g, first, state, cost, audit in engine.execute(STEP).fetchall():
            found[g][first, state] = (cost, audit)
    return found


@dataclass
class Repair:
    """A conversation's blocks joined in order."""

    ways: dict[int, Way] = field(default_factory=lambda: {START: (0, "")})
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    last: str | None = None

    def add(self, ways: dict[tuple[int, int], Way], first: str, last: str, blank: int, duplicate: int, truncated: int, illegal: int, turns: int, low: int | None, high: int | None) -> None:
        joined: dict[int, Way] = {}
        for (start, end), (cost, letters) in ways.items():
            if start in self.ways:
                whole = (self.ways[start][0] + cost, self.ways[start][1] + letters)
                joined[end] = min(joined.get(end, whole), whole)
        self.ways = joined
        self.illegal += illegal + (self.last is not None and self.last + first not in ("su", "ua", "au"))
        self.blank, self.duplicate, self.truncated, self.last = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def result(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit"""
        cost, audit = min((cost + INSERT * len(CLOSING[s]), letters + CLOSING[s]) for s, (cost, letters) in self.ways.items())
        gaps = 0 if self.low is None or self.high is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _summary(block: Block) -> tuple:
    return block.initials[0], block.initials[-1], block.blank, block.duplicate, block.truncated, block.illegal, block.turns, block.low, block.high


class Lines:
    """The repaired conversation, line by line into a digest: rows are given in order."""

    def __init__(self, audit: str, keep: bool = False):
        self.audit, self.at, self.last, self.n, self.digest = audit, 0, "", 0, hashlib.sha256()
        self.lines: list[str] | None = [] if keep else None

    def _put(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((("\n" if self.n else "") + line).encode())
        self.n, self.last = self.n + 1, role[:1]
        if self.lines is not None:
            self.lines.append(line)

    def _next_role(self) -> str:
        return NAMES["a" if self.last == "u" else "u"]

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._put(role if letter == "K" else self._next_role(), text)

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


# ------------------------------------------------------------ rows


def damaged(turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, dropped) after the drawn damage; dropped rows stay as marks without a text.  ``key`` is a text that is never null."""
    texts = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = texts.withColumn("drawn", F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20)
    text = F.when(F.col("drawn").isin(0, 1), "").when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = drawn.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("drawn") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("drawn") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def _flags() -> list[Column]:
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return [F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.md5(F.col("text").cast("binary")).alias("digest")]


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FOUND = COUNTS + ", repaired_sha256 string"


def _group_ends(keys: list) -> list[int]:
    """Where each run of equal keys ends."""
    return [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)] * bool(keys)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The batches' rows in tables that hold whole runs of equal keys, the first ``keys`` columns, of about ``BATCH_ROWS`` rows and ``BATCH_BYTES``."""
    workers.release()
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        ends = _group_ends(list(zip(*(table.column(k).to_pylist() for k in range(keys)))))
        begin, whole = 0, ends if last else ends[:-1]
        share = max(1, table.nbytes // max(1, table.num_rows))
        for k, end in enumerate(whole):
            if k + 1 == len(whole) or whole[k + 1] - begin > BATCH_ROWS or (whole[k + 1] - begin) * share > BATCH_BYTES:
                yield table.slice(begin, end - begin)
                begin = end
        held[:] = table.slice(begin).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS or sum(b.nbytes for b in held) >= BATCH_BYTES:
                yield from cut(False)
    if held:
        yield from cut(True)


def _short(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Conversations of bounded size, each whole in a task."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            columns = {n: table.column(n).to_pylist() for n in ("key", "turn", "role", "text", "dropped", "initial", "blank", "cut", "digest")}
            ends = _group_ends(columns["key"])
            spans, blocks = list(zip([0, *ends], ends)), []
            for a, b in spans:
                block, seen = Block(), set()
                for k in range(a, b):
                    if not columns["dropped"][k]:
                        same = (columns["role"][k], columns["digest"][k])
                        block.add(columns["turn"][k], columns["initial"][k], columns["blank"][k], same in seen, columns["cut"][k])
                        seen.add(same)
                blocks.append((block, (START,)))
            found = []
            for (a, b), (block, _), ways in zip(spans, blocks, cheapest(blocks)):
                whole = Repair()
                if block.initials:
                    whole.add(ways, *_summary(block))
                *counts, audit = whole.result()
                lines = Lines(audit)
                for k in range(a, b):
                    if not columns["dropped"][k]:
                        lines.row(columns["role"][k], columns["text"][k])
                found.append((*counts, audit, lines.end()))
            firsts = table.column("conv_id").take(pa.array([a for a, _ in spans])).combine_chunks()
            values = [pa.array(list(c), pa.int64()) for c in zip(*(f[:6] for f in found))] + [pa.array([f[k] for f in found]) for k in (6, 7)]
            yield pa.RecordBatch.from_arrays([firsts, *values], names=schema.fieldNames())

    schema = T.StructType([T.StructField("conv_id", kind)] + T._parse_datatype_string(FOUND).fields)
    narrow = rows.select("key", "conv_id", "turn", "role", "text", "dropped", *_flags())
    dealt = narrow.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.mapInArrow(repair, schema)


WAYS = "key string, block long, ways array<struct<first:int,last:int,cost:long,letters:string>>, initials array<string>, counts array<long>, low long, high long"


def _block_ways(rows: DataFrame) -> DataFrame:
    """For each block of numbered rows the ways through it and its counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            columns = {n: table.column(n).to_pylist() for n in ("key", "block", "turn", "initial", "blank", "again", "cut")}
            ends = _group_ends(list(zip(columns["key"], columns["block"])))
            spans, blocks = list(zip([0, *ends], ends)), []
            for a, b in spans:
                block = Block()
                for k in range(a, b):
                    block.add(columns["turn"][k], columns["initial"][k], columns["blank"][k], columns["again"][k], columns["cut"][k])
                blocks.append((block, (START, AFTER_S, AFTER_U, AFTER_A)))
            out = []
            for (a, _), (block, _), ways in zip(spans, blocks, cheapest(blocks)):
                first, last, *counts, low, high = _summary(block)
                listed = [{"first": p, "last": q, "cost": cost, "letters": letters} for (p, q), (cost, letters) in ways.items()]
                out.append({"key": columns["key"][a], "block": columns["block"][a], "ways": listed, "initials": [first, last], "counts": list(map(int, counts)), "low": low, "high": high})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    way = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
    arrow = pa.schema([("key", pa.string()), ("block", pa.int64()), ("ways", pa.list_(way)), ("initials", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())])
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "at").mapInArrow(work, WAYS)


def _joined(ways: DataFrame) -> DataFrame:
    """Each conversation's blocks joined in order: its counts, cost and letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        key, whole = None, Repair()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, (key, *whole.result())))], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if key is not None and r["key"] != key:
                    yield row()
                    whole = Repair()
                key = r["key"]
                whole.add({(w["first"], w["last"]): (w["cost"], w["letters"]) for w in r["ways"]}, *r["initials"], *r["counts"], r["low"], r["high"])
        if key is not None:
            yield row()

    arrow = pa.schema([("key", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    return ways.repartition("key").sortWithinPartitions("key", "block").mapInArrow(work, "key string, " + COUNTS)


def _digests(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256): each conversation's letters, then its rows in order, pass through a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        key, lines = None, Lines("")

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [lines.end()]})

        for batch in batches:
            for own, audit, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own != key:
                    if key is not None:
                        yield row()
                    key, lines = own, Lines(audit)
                else:
                    lines.row(role, text)
        if key is not None:
            yield row()

    none = F.lit(None).cast("string")
    heads = repaired.select("key", "audit", none.alias("role"), none.alias("text"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("digest"))
    body = rows.select("key", none.alias("audit"), "role", "text", F.lit(1).alias("kind"), "turn", F.md5(F.col("text").cast("binary")).alias("digest"))
    dealt = heads.union(body).repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("key", "audit", "role", "text").mapInArrow(work, "key string, repaired_sha256 string")


def _long(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Conversations of any size, block by block."""
    own = rows.filter(~F.col("dropped")).join(long.select("key"), "key", "left_semi")
    with intermediates() as made:
        narrow = own.select("key", "turn", "role", *_flags()).withColumn("tie", F.monotonically_increasing_id())
        numbered = number_rows(narrow.withColumn("unset", F.col("turn").isNotNull()), ["key", "unset", "turn", "role", "digest", "tie"]).withColumnRenamed("run_index", "at")
        firsts = materialize(numbered.groupBy("key", "role", "digest").agg(F.min("at").alias("earliest"), F.count("*").alias("n")), "repair-firsts")
        total = firsts.agg(F.sum("n")).first()[0] or 0
        told = join_counted(numbered, firsts, ["key", "role", "digest"], total).select("key", F.floor(F.col("at") / BLOCK_ROWS).alias("block"), "at", "turn", "initial", "blank", (F.col("at") > F.col("earliest")).alias("again"), "cut")
        ways = materialize(_block_ways(told), "repair-ways")
        repaired = materialize(_joined(ways), "repair-joined")
        found = materialize(repaired.join(_digests(own, repaired), "key"), "repair-long")
    discard(*made[:-1])
    none = Repair().result()
    values = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip((f.name for f in T._parse_datatype_string(FOUND).fields), (*none, hashlib.sha256().hexdigest()))]
    return long.join(found, "key", "left").select("conv_id", *values)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """One row per conversation: what was found after the damage, the cheapest edits, and the digest of the repaired text."""
    rows = damaged(turns)
    kind = turns.schema["conv_id"].dataType
    sizes = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("key", "conv_id"), "long-conversations")
    if long.isEmpty():
        return _short(rows, kind)
    return _short(rows.join(long.select("key"), "key", "left_anti"), kind).union(_long(rows, long))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read_table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The same in DuckDB alone: CRC-32 from its polynomial, one recursion over the whole table."""
    return r"""
with recursive crc as (select list(v order by i) as t from (select i, list_reduce(list_concat([i::ubigint], list_transform(range(8), lambda x: 0::ubigint)),
    lambda c, z: case when (c & 1) = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(i))),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as name from conversations),
drawn as (select *, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(name, lambda x: ascii(x)::ubigint)), lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint])), 4294967295::ubigint) % 20 as d from src, crc),
dam as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when d = 3 then [1, 2] else [1] end) as copy from drawn where d <> 0),
bare as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as k from dam),
told as (select conv_id, turn, role, text, k, left(role, 1) as i, b = '' as blank, row_number() over (partition by conv_id, role, text order by k) > 1 as again, right(b, 1) not in ('.', '!', '?') as cut, lag(left(role, 1)) over (partition by conv_id order by k) as was from bare),
flagged as (select *, blank or again as gone, not blank and not again and cut as short from told),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(again and not blank) as duplicate, count_if(short) as truncated, count_if(was is not null and was || i not in ('su', 'ua', 'au')) as illegal from flagged group by conv_id),
ins(p, q, c, w) as (values ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 3, 'I'), ('s', 'u', 3, 'I'), ('a', 'u', 3, 'I'), ('u', 'a', 3, 'I'), ('', 'a', 6, 'II'), ('s', 'a', 6, 'II')),
ways(conv_id, k, state, cost, audit) as (
  select conv_id, 0::bigint, '', 0::bigint, '' from counts
  union all
  select conv_id, k, state, (best).c, (best).w from (
    select x.conv_id, r.k, e.q as state, min({'c': x.cost + ins.c + e.c + case when r.short and e.w <> 'D' then 3 else 0 end, 'w': x.audit || ins.w || e.w}) as best
    from ways x join flagged r on r.conv_id is not distinct from x.conv_id and r.k = x.k + 1 join ins on ins.p = x.state
    join (values ('', '', 4, 'D'), ('s', 's', 4, 'D'), ('u', 'u', 4, 'D'), ('a', 'a', 4, 'D'), ('', 'u', 3, 'R'), ('s', 'u', 3, 'R'), ('a', 'u', 3, 'R'), ('u', 'a', 3, 'R'), ('', 's', 0, 'K'), ('', 'u', 0, 'K'), ('s', 'u', 0, 'K'), ('a', 'u', 0, 'K'), ('u', 'a', 0, 'K')) e(p, q, c, w)
      on e.p = ins.q and (e.w <> 'K' or e.q = r.i) and (e.w = 'D' or not r.gone)
    group by x.conv_id, r.k, e.q)),
done as (select c.*, min({'c': x.cost + len(f.w) * 3, 'w': x.audit || f.w}) as best from counts c join ways x on x.conv_id is not distinct from c.conv_id and x.k = c.n join (values ('', ''), ('s', 'II'), ('u', 'I'), ('a', '')) f(p, w) on f.p = x.state group by all),
letters as (select conv_id, (best).w as audit, unnest(range(1, len((best).w) + 1)) as j from done),
placed as (select *, audit[j] as letter, len(replace(audit[:j], 'I', '')) as k, len(replace(audit[:j], 'D', '')) as place from letters),
rows as (select l.*, r.role, r.text, r.i, max(case when l.place = 1 and l.letter = 'K' and r.i = 's' then 1 else 0 end) over (partition by l.conv_id) as lead from placed l left join flagged r on r.conv_id is not distinct from l.conv_id and r.k = l.k and l.letter <> 'I'),
said as (select conv_id, string_agg(case when letter = 'K' then role when (place - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by j) as whole from rows where letter <> 'D' group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce((best).c, 0)::bigint as cost, coalesce((best).w, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join done d on d.conv_id is not distinct from o.conv_id left join said s on s.conv_id is not distinct from o.conv_id"""
