"""Near-duplicate documents: SimHash fingerprints, matched through Golay-code keys.

Fingerprints are taken once per distinct value, so copies cost nothing more.
A fingerprint is cut into three segments.  Of two fingerprints within two bits
at least one segment agrees exactly, and the segment after it differs in at
most two bits, so it shares a Golay key: (which segment, its bits, a key of the
next) is a join key that loses no link.  Links are verified on the whole
fingerprints.

A key under which at most ``PAIR_ROWS`` fingerprints meet is joined pairwise.
Fingerprints under any more frequent key take an exact way without pairs: each
goes to the 65 words at most one bit away, and two of them are linked if and
only if they meet at such a word, where at most 65 can meet; each is linked to
the least one there.

Components come from distributed star rounds; only counts reach the driver.

Defined results: null and empty texts have fingerprint zero, linked like any
other; repeated rows get equal results; a null id takes part, and a component
of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import golay
from relata.llm.common import discard, free_name, intermediates, materialize, read_table, slices
from relata.llm.components import components
from relata.llm.skew import join_counted

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIR_ROWS = 32
#: A segment has six keys, or one if it lies near its codeword; on average about 5.3.
KEY_ROWS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    h, votes, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 14):
        digests = b"".join([h(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 14))], ends[at + k - 1 :])])
        votes += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every row, the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "text_key", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_key")).mapInArrow(compute, schema)


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints, and the fingerprint's position for each."""
    words, keys, rows = fps.view(np.uint64), [], []
    parts = [(words >> np.uint64(start) & np.uint64((1 << n) - 1)).astype(np.int64) for start, n in SEGMENTS]
    for k in range(3):
        near = golay.keys(parts[(k + 1) % 3])
        row, column = np.nonzero(near >= 0)
        keys.append((k << 40) + (parts[k][row] << 12) + near[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): about sixteen rows per fingerprint."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 15):
            fps = batch.column(0).to_numpy()
            keys, rows = segment_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(expand, "key long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): enough links between fingerprints within ``max_bits`` (at most two) to connect all that are linked."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys are complete for at most two differing bits")
    rows = KEY_ROWS * distinct.count()
    keys = fuzzy_keys(distinct)
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(join_counted(keys, met, ["key"], rows), "simhash-met", rows)
    few = shared.filter(F.col("n") <= PAIR_ROWS)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").filter(near).select("a", "b")
    many = shared.filter(F.col("n") > PAIR_ROWS).select("fp").distinct()
    masks = F.lit([0, *((1 << b) if b < 63 else -(1 << 63) for b in range(64))])
    around = many.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("word"))
    # At most 65 fingerprints lie within one bit of a word, so these groups are small whatever the input.
    meeting = around.groupBy("word").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = meeting.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    stars = stars if max_bits == MAX_BITS else stars.filter(near)
    return pairs.union(stars).distinct()


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) of every row; components are told apart by ``component``, a fingerprint."""
    prints = materialize(fingerprints(docs, id_column, text_column, shingle), "simhash-prints")
    total = prints.count()
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct", total)
    prints_in_all = distinct.count()
    with intermediates() as made:
        nodes = components(links(distinct), KEY_ROWS * prints_in_all)
    discard(*made[:-1])  # the last one holds the components
    labelled = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    owner = join_counted(labelled, least, ["component"], prints_in_all, "members").select("fp", "n", "component", "component_id")
    return join_counted(prints, owner, ["fp"], total).select("doc_id", "text_key", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable by links)."""
    return grouped(docs, id_column, text_column, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for every component: that with the smallest id, nulls last.  Among rows equal in id, a hash of the text and then all other columns decide."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    own_id, own_key, place = (free_name(docs.columns, x) for x in ("id", "text_key", "place"))
    chosen = grouped(docs, id_column, text_column).groupBy("component").agg(first).select(F.col("first.doc_id").alias(own_id), F.col("first.text_key").alias(own_key))
    kept = docs.join(chosen, F.col(id_column).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_column) == F.col(own_key)), "left_semi")
    others = [F.to_json(F.struct(F.col(c).alias("c"))) for c in docs.columns if c not in (id_column, text_column)]
    order = F.row_number().over(Window.partitionBy(F.col(id_column), F.xxhash64(text_column)).orderBy(*(others or [F.lit(1)])))
    return kept.withColumn(place, order).filter(F.col(place) == 1).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
