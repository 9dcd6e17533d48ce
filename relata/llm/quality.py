"""Quality classifier: hashed word n-gram logistic regression, learned by follow-the-regularised-leader updates.

A text's features are hashed one- and two-word grams of its words and of their
shapes (letters folded together, digits folded together, other characters
kept, ``=`` for a word equal to the one before it).  Each gram's value is its
count over the square root of the sum of squared counts of its kind, so long
and short texts weigh alike.  A score is the logistic of a sparse dot product.

Learning uses about ``SAMPLE_ROWS`` labelled rows (documented bound; all of
them if there are fewer), in one task that streams them, ordered by a hash of
the id; the weights (2^HASH_BITS floats, a fixed size) are broadcast for scoring.

Defined results: null and empty texts have no grams and get the bias alone;
with no labelled rows every score is 0.5; labels of a repeated id all count;
null labels are left out; a null id is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import bounded_sample, free_name, held_out, map_arrow, passed, quoted, read_table, slices

SAMPLE_ROWS = 12_000
HASH_BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
KEPT_WORDS, LONG_WORD, SLICE_BYTES = 200_000, 64, 4 << 20
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KINDS = (np.uint64(0x51), np.uint64(0xA7), np.uint64(0xC3), np.uint64(0xE9))


def _hashes(word: str) -> tuple[int, int]:
    shape = _DIGITS.sub("0", _LETTERS.sub("a", word))
    return zlib.crc32(word.lower().encode()), zlib.crc32(shape.encode())


def _slots(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    mixed = (h + kind) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def features(text: str | None, known: dict[str, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: slots, each once, and their values. known: hashes of words met before, added to here."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    known = {} if known is None else known
    if len(known) > KEPT_WORDS:
        known.clear()
    pairs = []
    for w in words:
        pair = known.get(w)
        if pair is None:
            pair = _hashes(w)
            if len(w) <= LONG_WORD:  # longer ones are seldom met again, and their number would not bound their bytes
                known[w] = pair
        pairs.append(pair)
    h = np.array(pairs, dtype=np.uint64)
    word, shape = h[:, 0], h[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = np.uint64(ord("="))
    slots, values = [], []
    for x, single, double in ((word, _KINDS[0], _KINDS[1]), (shape, _KINDS[2], _KINDS[3])):
        for grams in (_slots(x, single), _slots(x[:-1] * _MIX + x[1:], double)):
            if len(grams):
                own, counts = np.unique(grams, return_counts=True)
                slots.append(own)
                values.append(counts / np.sqrt(np.sum(counts.astype(float) ** 2)))
    slots, at = np.unique(np.concatenate(slots), return_inverse=True)
    return slots, np.bincount(at, weights=np.concatenate(values))


def sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


class Learner:
    """Follow-the-regularised-leader, one row after another."""

    def __init__(self):
        self.size = (1 << HASH_BITS) + 1
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, self.size - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g

    def all_weights(self) -> np.ndarray:
        """By slot, the bias last."""
        return self.weights(np.arange(self.size))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot, the bias last."""
    learner = Learner()
    for _ in range(epochs):
        for (slots, values), y in zip(rows, labels):
            learner.learn(slots, values, y)
    return learner.all_weights()


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> np.ndarray:
    """Weights learned from rows with a text and a 0/1 label; their number is the caller's to bound (``training_rows``).

    Texts become sparse vectors in parallel.  The one task that learns gets
    them in order, once for each epoch, and holds a few at a time beside the
    weights, whatever the texts' lengths.
    """
    rows = labelled.filter(F.col(label_column).isin(0, 1)).select(F.xxhash64(id_column).alias("at"), F.col(label_column).cast("int").alias("y"), F.col(text_column).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], names=["at", "y", "slots", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Learner(), 0
        for batch in slices(batches, 512, 2, SLICE_BYTES):
            seen += batch.num_rows
            for slots, values, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 1))):
                learner.learn(np.frombuffer(slots, np.int32).astype(np.int64), np.frombuffer(values, np.float32).astype(float), y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([learner.all_weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    sparse = rows.mapInArrow(vectors, "at long, y int, slots binary, values binary")
    epochs = sparse.select("at", "y", "slots", "values", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
    learned = epochs.repartition(1).sortWithinPartitions("epoch", "at", "y", "slots", "values").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(learned[0].weights, dtype=np.float32) if learned else np.zeros((1 << HASH_BITS) + 1, np.float32)


def predict(docs: DataFrame, weights: np.ndarray, text_column: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in ``keep`` (all by default) of each row of ``docs``, with score and predicted, which replace columns of their names."""
    keep = passed(docs.columns if keep is None else keep, out)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = shared.value.astype(np.float64), workers.kept("quality", dict)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found = []
            for text in batch.column(len(keep)).to_pylist():
                at, x = features(text, known)
                found.append(sigmoid(float(w[at] @ x + w[-1])))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=[*keep, *out])

    # The text is read by its place behind the kept columns, so no name of theirs can take its part.
    return map_arrow(docs.select(*map(quoted, keep), quoted(text_column).alias(free_name(keep, "text"))), score, schema)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` labelled documents at most; the sample is drawn from the narrow label table before any text is read."""
    drawn = bounded_sample(labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality"), "doc_id", sample_rows)
    return docs.select("doc_id", "text").join(drawn, "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = fit(training_rows(docs, read_table(spark, sf_dir, "labels")))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), weights, keep=["doc_id", "held_out"])
