"""Whitening of embeddings: a covariance by streaming rank-one updates, its eigenvectors by the symmetric QR method.

An entry c counts as the whole number floor(256 c).  The fit list holds each
distinct vector of whole numbers once: vectors are packed into as few bytes as
they need and made distinct before and after the shuffle, so copies of one
vector never meet in a task.  Every partition of the list runs Welford's
update: a mean and a matrix of centred products take one vector after another.
The partitions' moments (their size depends on the dimensions alone) are merged
by the parallel update formula, ``FAN_IN`` at a time in tasks until few are
left.  The covariance, one small matrix, is brought to three diagonals by
reflections and then to one by QR steps with implicit shifts.  Counts and sums
are exact: whole numbers of 64 bits, or Python's where those could run over.

Defined results: rows whose vector is null or holds a null or an entry that is
not finite are dropped; vectors of each length are a space of their own, with
their own list and components; vectors without entries have no components and
give no rows; entries beyond a 64-bit whole number take its nearest end; a
component without variance (one of a list of equal vectors, say) has null
whitened values and stands outside ``identity_error``, which is null if no
component is left; ``explained`` is null where the trace is 0, ``deviation``
where the exact sum is over 64 bits; repeated rows and null ids are kept; an
empty table gives no rows; other columns are not read.  A vector may have
``MAX_DIMENSIONS`` entries (an error beyond): the matrix is held in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm.common import discard, intermediates, materialize, read_table

SCALE = 256
COMPONENTS = 4
FAN_IN = 32
MAX_DIMENSIONS = 4096
ENDS = -(2**63), 2**63 - 1024  # the doubles nearest to the ends of 64 bits within them


def _lists(column: pa.Array) -> pa.Array:
    return pc.cast(column, pa.list_(pa.float64()))


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vectors: the rows of a batch that count, and their whole numbers, one row each."""
    lists = _lists(column)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        values = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(-1, size)  # a null entry is not a number here
        good = np.isfinite(values).all(axis=1)
        if good.any():
            yield rows[good], np.clip(np.floor(values[good] * SCALE), *ENDS).astype(np.int64)


WIDTHS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector as its entries' width in bytes, the smallest that holds them, and the entries."""
    low, high = x.min(axis=1), x.max(axis=1)
    fits = [(low >= np.iinfo(k).min) & (high <= np.iinfo(k).max) for k in WIDTHS.values()]
    width = np.select(fits, list(WIDTHS))
    packed: list[bytes] = [b""] * len(x)
    for w, kind in WIDTHS.items():
        rows = np.flatnonzero(width == w)
        data, step = x[rows].astype(kind).tobytes(), w * x.shape[1]
        for k, row in enumerate(rows.tolist()):
            packed[row] = bytes((w,)) + data[k * step : (k + 1) * step]
    return packed


def unpack(vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, WIDTHS[vector[0]], offset=1).astype(np.int64)


@dataclass
class Moments:
    """Of vectors of one length: number, exact sums, mean, and the sums of centred products."""

    n: int
    sums: list[int]
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, size: int) -> Moments:
        if size > MAX_DIMENSIONS:
            raise ValueError(f"vectors of {size} entries; at most {MAX_DIMENSIONS} are whitened")
        return cls(0, [0] * size, np.zeros(size), np.zeros((size, size)))

    def take(self, vectors: Iterable[np.ndarray]) -> None:
        """Welford's update, one vector after another."""
        outer = np.empty_like(self.products)
        partial, room = np.zeros(len(self.mean), np.int64), 0
        for x in vectors:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], x - self.mean, out=outer)
            self.products += outer
            if x.dtype == np.int64:
                reach = int(max(-int(x.min()), int(x.max())))
                if room + reach >= 2**63:
                    self.sums = [a + b for a, b in zip(self.sums, partial.tolist())]
                    partial[:], room = 0, 0
                partial += x
                room += reach
        self.sums = [a + b for a, b in zip(self.sums, partial.tolist())]

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        if not other.n:
            return
        n, gap = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean += gap * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def covariance(self) -> np.ndarray:
        v = self.products / self.n
        return (v + v.T) / 2


MOMENTS = "size int, part long, n long, sums array<string>, mean binary, products binary"


def _moments_batch(found: list[tuple[int, int, Moments]]) -> pa.RecordBatch:
    columns = [
        pa.array([s for s, _, _ in found], pa.int32()), pa.array([p for _, p, _ in found], pa.int64()), pa.array([m.n for _, _, m in found], pa.int64()), pa.array([list(map(str, m.sums)) for _, _, m in found], pa.list_(pa.string())),
        pa.array([m.mean.tobytes() for _, _, m in found], pa.binary()), pa.array([m.products.tobytes() for _, _, m in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["size", "part", "n", "sums", "mean", "products"])


def _read(n: int, sums: list[str], mean: bytes, products: bytes) -> Moments:
    values = np.frombuffer(mean).copy()
    return Moments(n, list(map(int, sums)), values, np.frombuffer(products).reshape(len(values), -1).copy())


def moments(vectors: DataFrame, as_vector=unpack, binary: str = "vector") -> dict[int, Moments]:
    """By length, the moments of all rows of a table of packed vectors."""
    spark = vectors.sparkSession

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Moments] = {}
        for batch in batches:
            by_size: dict[int, list[np.ndarray]] = {}
            for value in batch.column(0).to_pylist():
                x = as_vector(value)
                by_size.setdefault(len(x), []).append(x)
            for size, own in by_size.items():
                held.setdefault(size, Moments.none(size)).take(own)
        for size in sorted(held):
            yield _moments_batch([(size, TaskContext.get().partitionId(), held[size])])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of size and part."""
        last: tuple[int, int] | None = None
        whole = None
        for batch in batches:
            for size, part, n, sums, mean, products in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if last != (size, part // FAN_IN):
                    if last is not None:
                        yield _moments_batch([(*last, whole)])
                    last, whole = (size, part // FAN_IN), Moments.none(size)
                whole.merge(_read(n, sums, mean, products))
        if last is not None:
            yield _moments_batch([(*last, whole)])

    with intermediates() as made:
        parts = materialize(vectors.select(binary).mapInArrow(stream, MOMENTS), "moments")
        while (most := parts.agg(F.max("part")).first()[0] or 0) >= FAN_IN:
            groups = F.col("part") - F.col("part") % FAN_IN
            dealt = parts.repartition(min(200, most // FAN_IN + 1), "size", groups).sortWithinPartitions("size", "part")
            parts = materialize(dealt.mapInArrow(merged, MOMENTS), "moments")
        found: dict[int, Moments] = {}
        for row in parts.orderBy("size", "part").toLocalIterator():  # at most FAN_IN rows of each length
            found.setdefault(row["size"], Moments.none(row["size"])).merge(_read(row["n"], row["sums"], row["mean"], row["products"]))
    discard(*made)
    return found


# ------------------------------------------------------------ eigenvectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0:
            continue
        scale = max(scale, abs(x[0]))
        v = x / scale
        v[0] += math.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix: QR steps with Wilkinson's shift on its tridiagonal form."""
    n = len(a)
    size = float(np.abs(a).max()) if n else 0.0
    if size == 0:
        return np.zeros(n), np.eye(n)
    d, e, q = tridiagonal(a / size)
    q = np.ascontiguousarray(q.T)  # rows are rotated, which lie together
    tiny = np.finfo(float).eps
    high, steps = n - 1, 0
    while high > 0:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high, steps = high - 1, 0
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > sweeps:
            raise ArithmeticError("the QR steps do not end")
        gap = (d[high - 1] - d[high]) / 2
        square = e[high - 1] * e[high - 1]
        shift = d[high] - square / (gap + math.copysign(math.hypot(gap, e[high - 1]), gap))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * q[k] + s * q[k + 1]
            q[k + 1] = c * q[k + 1] - s * q[k]
            q[k] = upper
    order = np.argsort(-d, kind="stable")
    return d[order] * size, q[order].T.copy()


# ------------------------------------------------------------ the model


@dataclass
class Whitening:
    """Of vectors of one length: the fit list's number and sums, and the first components."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a column each
    values: np.ndarray  # their eigenvalues
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components with variance, that is, more than rounding leaves."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values, default=0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components with variance, over their deviations."""
        keep = self.usable
        return (self._deviations(x) / self.n).astype(float) @ (self.vectors[:, keep] / np.sqrt(self.values[keep]))

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        reach = max(int(np.abs(x.astype(float)).max(initial=0)) + 1024, 1) * self.n + max(map(abs, self.sums), default=0)
        if reach < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2; null where it is over 64 bits."""
        gaps = self._deviations(x)
        if gaps.dtype != object and int(np.abs(gaps).max(initial=0)) ** 2 * len(self.sums) >= 2**63:
            gaps = gaps.astype(object)
        return [v if v < 2**63 else None for v in (gaps * gaps).sum(axis=1).tolist()]


def fit(embeddings: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """By length of vectors, the model of all distinct vectors of a table."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(pack(x), pa.binary())], names=["size", "vector"])

    with intermediates() as made:
        distinct = materialize(embeddings.select(F.col(f"`{vector_column}`")).mapInArrow(packed, "size int, vector binary").distinct(), "fit-list")
        models = {}
        for size, own in moments(distinct).items():
            v = own.covariance()
            values, vectors = symmetric_qr(v)
            trace = float(np.trace(v))
            first = min(components, size)
            models[size] = Whitening(own.n, own.sums, vectors[:, :first], values[:first], values[:first] / trace if trace > 0 else np.full(first, np.nan))

        def whitened(vector: bytes) -> np.ndarray:
            x = unpack(vector)
            return models[len(x)].whiten(x[None])[0]

        # A second pass over the list measures what the components give; the results of two lengths may have one number of entries, so they go apart.
        for size, model in models.items():
            if model.usable.any():
                spread = next(iter(moments(distinct.filter(F.col("size") == size), whitened).values())).covariance()
                model.identity_error = float(np.abs(spread - np.eye(len(spread))).max())
    discard(*made)
    return models


def whiten(embeddings: DataFrame, models: dict[int, Whitening], id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1)):
                model = models[x.shape[1]]
                first, usable = len(model.values), model.usable
                values = np.full((len(x), first), np.nan)
                values[:, usable] = model.whiten(x)
                deviations = model.deviation(x)
                rest = [
                    np.tile(np.arange(1, first + 1, dtype=np.int32), len(x)), np.full(len(x) * first, model.n), pa.array([v for v in deviations for _ in range(first)], pa.int64()), pa.array(values.ravel(), mask=np.tile(~usable, len(x))),
                    pa.array(np.tile(model.explained, len(x)), mask=np.tile(np.isnan(model.explained), len(x))), pa.array([model.identity_error] * (len(x) * first), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(rows, first))), *map(pa.array, rest)], names=names)

    own = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField("vec_id", embeddings.schema[id_column].dataType)] + T._parse_datatype_string(own).fields)
    names = schema.fieldNames()
    return embeddings.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`")).mapInArrow(convert, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows, fit(rows))
