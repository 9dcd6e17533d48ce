"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A chat service often logs a conversation again after every turn.  Each turn is
hashed with its position, role and text, and the running exclusive-or over a
conversation gives a hash of each of its prefixes (two independent 64-bit
values).  A conversation whose whole hash is a proper prefix hash of another is
only an earlier snapshot and goes by an anti-join; of equal conversations the
one with the smallest id stays.  The rest are rendered.

Texts are hashed before anything moves: positions and prefixes are worked out
on one narrow table of hashes, which is written once, and the texts move a
single time, to be rendered.  Exclusive-or is associative, so a conversation of
any length is worked on in blocks of ``BLOCK_TURNS`` turn numbers and the
blocks' values are combined afterwards.  Prefix hashes are made distinct before
the join, so a first turn that many conversations share is one row there.

Defined results: rows that repeat exactly count once; turns are ordered by
turn, role and text, nulls first; null roles and texts count as empty; a row
with a null conversation id is a conversation of its own; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.common import discard, intermediates, materialize, read_table

BLOCK_TURNS = 512
TURN = ["conv_id", "block", "turn", "h1", "h2"]


def _hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, block, turn, h1, h2, role, text), roles and texts not null; h1 and h2 are independent hashes of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    block = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS)
    return turns.select("conv_id", block.alias("block"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(text, role, F.lit(7)).alias("h2"), role.alias("role"), text.alias("text"))


def _placed_hashes(position: Column) -> tuple[Column, Column]:
    return F.xxhash64(position, "h1", "h2"), F.xxhash64("h2", "h1", position * 31 + 7)


def _in_order(hashed: DataFrame) -> DataFrame:
    """(conv_id, block, turn, h1, h2, tie) of the distinct turns; tie orders those of one turn number by role and text."""
    narrow = hashed.groupBy(*TURN).agg(F.count("*").alias("n"))
    several = F.count("*").over(Window.partitionBy("conv_id", "block", "turn"))
    counted = materialize(narrow.select(*TURN, several.alias("same")), "chat-turns")
    alone = counted.filter("same = 1").select(*TURN, F.lit(1).alias("tie"))
    tied = counted.filter("same > 1").select("conv_id", "block", "turn").distinct()
    if tied.isEmpty():
        return alone
    # Only where turn numbers repeat do the texts themselves decide.
    on = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    texts = hashed.join(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), on, "left_semi").groupBy(*TURN).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    order = Window.partitionBy("conv_id", "block", "turn").orderBy("role", "text")
    return alone.union(texts.select(*TURN, F.row_number().over(order).alias("tie")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, x1, x2, n_turns): the hash of each prefix of each conversation, and the length of the whole; written to a table."""
    with intermediates() as made:
        hashed = _hashed(turns.filter("conv_id is not null"))
        inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "tie")
        ranked = _in_order(hashed).select("conv_id", "block", "turn", "tie", "h1", "h2", F.row_number().over(inside).alias("own"))
        whole, earlier = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sizes = ranked.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
        shifts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"), F.sum("n").over(whole).alias("n_turns"))
        placed = ranked.join(shifts.hint("merge"), ["conv_id", "block"]).withColumn("position", F.col("shift") + F.col("own"))
        p1, p2 = _placed_hashes(F.col("position"))
        running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
        within = placed.select("conv_id", "block", "position", "n_turns", p1.alias("p1"), p2.alias("p2")).select("*", F.bit_xor("p1").over(running).alias("x1"), F.bit_xor("p2").over(running).alias("x2"))
        blocks = within.groupBy("conv_id", "block").agg(F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2"))
        before = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(p).over(earlier), F.lit(0)).alias(b) for p, b in (("p1", "b1"), ("p2", "b2"))))
        joined = within.join(before.hint("merge"), ["conv_id", "block"])
        found = materialize(joined.select("conv_id", "position", F.col("x1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("x2"), "n_turns"), "chat-prefixes")
    discard(*made[:-1])
    return found


def _alone(turns: DataFrame) -> DataFrame:
    """Rows without a conversation id, each a conversation of one turn: (position, x1, x2, role, text)."""
    p1, p2 = _placed_hashes(F.lit(1).cast("long"))
    return _hashed(turns.filter("conv_id is null")).select(F.lit(1).cast("long").alias("position"), p1.alias("x1"), p2.alias("x2"), "role", "text")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, x1, x2) of the conversations that stay; the hashes tell those without an id apart."""
    prefixes = prefix_hashes(turns)
    key = ["position", "x1", "x2"]
    ends = prefixes.filter("position = n_turns").select("conv_id", *key)
    singles = _alone(turns).select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), *key)
    whole = ends.union(singles).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.filter("position < n_turns").select(*key).distinct()
    return whole.join(proper.hint("merge"), key, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "x1", "x2")


def _said(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each headed by its role."""
    kept = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("c"), "n_turns")
    texts = _hashed(turns.filter("conv_id is not null")).select("conv_id", "turn", "role", "text")
    own = texts.join(kept.hint("merge"), F.col("conv_id") == F.col("c"))
    listed = own.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = listed.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: _said(t["role"], t["text"])), "").alias("rendered"))
    lone = conversations.filter("conv_id is null").select("x1", "x2")
    once = _alone(turns).dropDuplicates(["x1", "x2"]).join(lone, ["x1", "x2"], "left_semi")
    return rendered.union(once.select(F.lit(None).cast(turns.schema["conv_id"].dataType), F.lit(1).cast("long"), _said(F.col("role"), F.col("text"))))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return render(turns, maximal(turns))


def oracle() -> str:
    return """
with t as (select distinct conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
c as (select conv_id, list({'r': r, 'x': x} order by turn nulls first, r, x) as l from t group by conv_id
      union all select null, [{'r': coalesce(role, ''), 'x': coalesce(text, '')}] from conversations where conv_id is null),
k as (select min(conv_id) as conv_id, l from c group by l)
select a.conv_id, len(a.l)::bigint as n_turns,
  array_to_string(list_transform(a.l, lambda s: '<|' || s.r || '|>' || chr(10) || s.x || '<|end|>' || chr(10)), '') as rendered
from k a where not exists (select 1 from k b where len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l)"""
