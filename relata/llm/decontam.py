"""Benchmark decontamination by latent semantic retrieval.

1. Items go in blocks of about ``BLOCK_BYTES`` (one, for a benchmark of usual
   size).  The vocabulary is a block's own words, so its size is bounded.  One
   pass over the corpus turns every text into the vocabulary positions of its
   words (one small integer each; words outside are one common value); later
   passes read only those.
2. Document frequencies of corpus passages of ``PASSAGE`` words, summed by a
   distributed aggregation, give TF-IDF weights.
3. A randomised SVD of the corpus's TF-IDF passages (with the benchmark's own
   passages stacked on them) gives a latent space: each task multiplies its
   passages with a random matrix and back, the sums of these vocabulary-by-rank
   matrices are reduced in parallel by blocks of rows, and only the final one
   (bounded by vocabulary and rank) comes to the driver, to be orthogonalised.
4. Every corpus window (``PASSAGE`` words, one each ``STRIDE`` words) whose
   cosine with a benchmark passage reaches ``MIN_COSINE`` is a candidate.  The
   benchmark passages are a stated query set, compared in blocks with all rows.
   Items of at most ``STRIDE`` words are compared with windows of ``STRIDE``
   words as well, in which other words dilute them less.
   Of each passage the ``KEEP_WORDS`` rarest words count, with a floor of
   weight, however often they leak.
5. So is every window in which ``GRAM`` words of an item (all of a shorter one)
   stand in one piece, whatever its cosine: no item that is copied word for
   word, or whose answer is, depends on the frequencies of its words.
6. A candidate is a leak if the longest common subsequence of the whole
   benchmark item and the text around the window covers ``MIN_OVERLAP`` of the
   item, or ``MIN_PARAPHRASE`` of it if the item's answer (its last
   ``ANSWER_WORDS`` words) also stands there in one piece.

There is no cap on windows, candidates or partners.

Defined results: null and empty texts leak nothing; an empty benchmark finds
nothing; items without words are left out; repeated rows give repeated links;
null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from relata.llm.common import free_name, materialize, quoted, read_table, slices

PASSAGE, STRIDE = 64, 32
RANK, OVERSAMPLE, SEED = 120, 8, 7
MIN_COSINE = 0.3
MIN_IDF = 1.5
MIN_OVERLAP, MIN_PARAPHRASE, ANSWER_WORDS = 0.8, 0.5, 8
KEEP_WORDS, FLOOR_IDF = 4, 0.1
GRAM = ANSWER_WORDS
BLOCK_BYTES, SUM_BYTES, SLICE_BYTES, TABLE_BYTES = 4 << 20, 64 << 20, 4 << 20, 32 << 20
CHUNK = 32
ROW_BLOCK = 256
MARKS = b".,;:!?\"()[]*#&%$|"
TO_SPACES = bytes.maketrans(MARKS, b" " * len(MARKS))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; punctuation marks part words as white space does."""
    return (text or "").lower().encode().translate(TO_SPACES).split()


@dataclass
class Benchmark:
    """The query set: items, their word ids, and the vocabulary."""

    items: list
    ids: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(benchmark: DataFrame, text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items, dealt by a hash to blocks of about ``block_bytes`` of text; a vocabulary, and all that is broadcast, is one block's."""
    n = benchmark.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    blocks = max(1, -(-n // block_bytes))
    return [benchmark.filter(F.pmod(F.xxhash64(text_column), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [benchmark]


def load_benchmark(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Benchmark:
    """One block of items, on the driver."""
    rows = [(r[0], r[1]) for r in benchmark.filter(F.col(text_column).isNotNull()).select(id_column, text_column).distinct().toLocalIterator()]
    vocabulary: dict[bytes, int] = {}
    items, ids = [], []
    for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])):
        words = words_of(text)
        if words:
            items.append(item)
            ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32))
    return Benchmark(items, ids, vocabulary)


def encode_words(docs: DataFrame, bench: Benchmark, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): every word of every text as a vocabulary position, in the narrowest integers that hold them."""
    small = len(bench.vocabulary) < 1 << 15
    shared = docs.sparkSession.sparkContext.broadcast(bench.vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, kind = shared.value.get, np.int16 if small else np.int32
        for batch in slices(batches):
            found = [np.array([get(w, -1) for w in words_of(t)], dtype=kind).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column)).mapInArrow(encode, schema)


def _decode(batch: pa.RecordBatch, small: bool, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All word ids of a batch in a row, and the documents' lengths."""
    parts = batch.column(column).to_pylist()
    width = 2 if small else 4
    return np.frombuffer(b"".join(parts), np.int16 if small else np.int32).astype(np.int64), np.array([len(p) // width for p in parts], dtype=np.int64)


def _passages(ids: np.ndarray, lengths: np.ndarray, keep: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept words by block of ``step`` words: (word ids, their block), and each document's first block (one more at the end)."""
    blocks = -(-lengths // step)
    first = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at = np.nonzero((ids >= 0) & keep[ids])[0]
    doc = np.searchsorted(starts, at, side="right") - 1
    return ids[at], first[doc] + (at - starts[doc]) // step, first


def _sum_rows(partial: DataFrame, blocks: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' matrices: reduced by blocks of rows in parallel, streaming, then put together."""
    width = shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, np.float32).astype(np.float64)
                sums[b] = sums[b] + part if b in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    out = np.zeros(shape)
    for r in partial.repartition(min(blocks, 64), "block").mapInArrow(add, "block int, data binary").collect():
        part = np.frombuffer(r.data, np.float64).reshape(-1, width)
        out[r.block * ROW_BLOCK : r.block * ROW_BLOCK + len(part)] = part
    return out


def _row_blocks(total: np.ndarray) -> pa.RecordBatch:
    parts = [(k // ROW_BLOCK, total[k : k + ROW_BLOCK]) for k in range(0, len(total), ROW_BLOCK)]
    parts = [(k, p) for k, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p.astype(np.float32).tobytes() for _, p in parts], pa.binary())], names=["block", "data"])


def segment_sums(matrix: np.ndarray, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of ``matrix[rows]`` over the segments that begin at ``heads`` (ascending, none empty).

    Segments are cut into chunks of at most CHUNK rows, the longest first; the
    k-th rows of all chunks are added at once.
    """
    ends = np.append(heads[1:], len(rows))
    pieces = -(-(ends - heads) // CHUNK)
    starts = np.repeat(heads, pieces) + CHUNK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sizes = np.minimum(CHUNK, np.repeat(ends, pieces) - starts)
    order = np.argsort(-sizes.astype(np.int16), kind="stable")
    starts, held = starts[order], np.searchsorted(-sizes[order], -np.arange(CHUNK), side="left")
    sums = matrix[rows[starts]]
    for k in range(1, int(sizes.max())):
        n = held[k]
        sums[:n] += matrix[rows[starts[:n] + k]]
    if len(starts) == len(heads):
        out = np.empty_like(sums)
        out[order] = sums
        return out
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return np.add.reduceat(sums[back], np.cumsum(pieces) - pieces, axis=0)


def _weighted(words: np.ndarray, block: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sums of a matrix's rows over the words of each passage: (passages, columns). Blocks ascend."""
    out = np.zeros((n, matrix.shape[1]), np.float32)
    step = 1 << 16
    for at in range(0, len(words), step):
        w, b = words[at : at + step], block[at : at + step]
        heads = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1])
        out[b[heads]] += segment_sums(matrix, w, heads)
    return out


@dataclass
class LatentSpace:
    idf: np.ndarray
    keep: np.ndarray
    basis: np.ndarray


def latent_space(encoded: DataFrame, bench: Benchmark, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = SEED) -> LatentSpace:
    """IDF over all corpus passages and the leading right singular vectors of their TF-IDF matrix."""
    size, small = len(bench.vocabulary), len(bench.vocabulary) < 1 << 15
    everything = np.ones(size, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 1))
        for batch in slices(batches, 2048, 0, SLICE_BYTES):
            ids, lengths = _decode(batch, small, 0)
            words, block, _ = _passages(ids, lengths, everything, PASSAGE)
            order = _by_word(words, size)
            w, b = words[order], block[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
            total[:, 0] += np.bincount(w[new], minlength=size)
        yield _row_blocks(total)

    blocks = -(-size // ROW_BLOCK)
    df = _sum_rows(encoded.select("ids").mapInArrow(count, "block int, data binary"), blocks, (size, 1))
    passages = encoded.agg(F.sum(F.ceil(F.length("ids") / F.lit((2 if small else 4) * PASSAGE)))).first()[0] or 0
    idf = np.maximum(np.log((passages + 1.0) / (df[:, 0] + 1.0)), FLOOR_IDF).astype(np.float32)
    keep = kept_words(idf, bench)
    columns = min(rank + oversample, size)
    omega = np.random.default_rng(seed).standard_normal((size, columns)).astype(np.float32)

    def gram(matrix: np.ndarray) -> np.ndarray:
        """Sum over all passages a of a times (a times matrix)."""
        shared = encoded.sparkSession.sparkContext.broadcast((idf, keep, matrix))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, keep, matrix = shared.value
            total = np.zeros((size, matrix.shape[1]))
            for batch in slices(batches, 2048, 0, SLICE_BYTES):
                ids, lengths = _decode(batch, small, 0)
                words, block, first = _passages(ids, lengths, keep, PASSAGE)
                _add_gram(total, words, block, idf, matrix, int(first[-1]))
            yield _row_blocks(total)

        return _sum_rows(encoded.select("ids").mapInArrow(multiply, "block int, data binary"), blocks, (size, matrix.shape[1]))

    own = np.zeros((size, columns))
    words, block, n = _query_words(bench, keep)
    _add_gram(own, words, block, idf, omega, n)
    # A task's sums take SUM_BYTES at most; a larger vocabulary is worked on some columns at a time.
    together = max(1, SUM_BYTES // (8 * size))
    z = np.concatenate([gram(omega[:, k : k + together]) for k in range(0, columns, together)], axis=1)
    # The benchmark's rows weigh as much as the corpus's, so the space spans what is looked for.
    z += own * (np.linalg.norm(z) / max(np.linalg.norm(own), 1e-9))
    basis, singular, _ = np.linalg.svd(z, full_matrices=False)
    return LatentSpace(idf, keep, np.ascontiguousarray(basis[:, : min(rank, columns)], dtype=np.float32))


def kept_words(idf: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Which words count: the rare ones, and the rarest of every benchmark passage."""
    keep = idf >= min(MIN_IDF, float(np.median(idf)))
    for ids in bench.ids:
        for at in range(0, len(ids), PASSAGE):
            own = np.unique(ids[at : at + PASSAGE])
            keep[own[np.argsort(-idf[own], kind="stable")[:KEEP_WORDS]]] = True
    return keep


def _gram_hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out + ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def item_grams(bench: Benchmark) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes in order, their items) of all runs of ``GRAM`` words of the items; a shorter item is one run."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for one, ids in enumerate(bench.ids):
        n = min(GRAM, len(ids))
        h = np.unique(_gram_hashes(ids.astype(np.int64), np.arange(len(ids) - n + 1), n))
        found.setdefault(n, []).append((h, np.full(len(h), one)))
    out = []
    for n, parts in found.items():
        hashes, owners = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        out.append((n, hashes[order], owners[order]))
    return out


def gram_hits(ids: np.ndarray, starts: np.ndarray, grams: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) of every run of item words in the texts."""
    outside = np.concatenate([[0], np.cumsum(ids < 0)])
    last = np.repeat(starts[1:], np.diff(starts))
    places, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, hashes, items in grams:
        at = np.arange(max(0, len(ids) - n + 1))
        at = at[(outside[at + n] == outside[at]) & (at + n <= last[at])]
        h = _gram_hashes(ids, at, n)
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        places.append(np.repeat(at, count))
        owners.append(items[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())])
    return np.concatenate(places), np.concatenate(owners)


def _add_gram(total: np.ndarray, words: np.ndarray, block: np.ndarray, idf: np.ndarray, matrix: np.ndarray, n: int) -> None:
    projected = _weighted(words, block, matrix * idf[:, None], n)
    order = _by_word(words, len(idf))
    step = 1 << 16
    for at in range(0, len(order), step):
        part = order[at : at + step]
        w = words[part]
        heads = np.concatenate([[0], np.nonzero(np.diff(w))[0] + 1])
        total[w[heads]] += segment_sums(projected, block[part], heads) * idf[w[heads], None]


def _by_word(words: np.ndarray, size: int) -> np.ndarray:
    """Stable order by word; short integers sort by radix."""
    return np.argsort(words.astype(np.int16) if size < 1 << 15 else words, kind="stable")


def _query_words(bench: Benchmark, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    lengths = np.array([len(x) for x in bench.ids])
    words, block, first = _passages(np.concatenate(bench.ids).astype(np.int64), lengths, keep, PASSAGE)
    return words, block, int(first[-1])


def _places(item: np.ndarray) -> dict[int, int]:
    """Where each word stands in an item, as bits."""
    where: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    return where


def common_subsequence(where: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence of an item, given by its words' places, and a text; bit-parallel over the item."""
    full = (1 << length) - 1
    row = full
    for hit in [where[w] for w in text if w in where]:
        both = row & hit
        row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


def common_subsequences(items: list[dict[int, int]], lengths: np.ndarray, which: np.ndarray, texts: np.ndarray, size: int) -> np.ndarray:
    """``common_subsequence`` of items of at most 64 words and texts, row by row.

    items: the places of each item's words; lengths: of the items; which: the
    item of each row of ``texts``, whose words are below ``size``, with -1 for
    all others.
    """
    table = np.zeros((len(items), size + 1), np.uint64)
    for k, where in enumerate(items):
        table[k, list(where)] = np.array(list(where.values()), np.uint64)
    full = np.array([(1 << int(n)) - 1 for n in lengths], np.uint64)[which]
    row, flat = full.copy(), table.reshape(-1)
    at = np.ascontiguousarray(np.where(texts < 0, size, texts).T) + which * (size + 1)
    for places in at:
        both = row & flat[places]
        # Sums may run over an item's last place; what lies beyond never comes back.
        over = row + both
        row -= both
        row |= over
    return lengths[which] - np.bitwise_count(row & full).astype(np.int64)


def _groups(of_item: np.ndarray, size: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Ranges of candidates, which are in order of their items: at most 4096 of ``items`` short items, or some of one long item."""
    edges = np.concatenate([[0], np.nonzero(np.diff(of_item))[0] + 1, [len(of_item)]]).tolist() if len(of_item) else []
    start, held = 0, 0
    for x, z in zip(edges[:-1], edges[1:]):
        long = size[x] > 64
        if start < x and (long or held == items or z - start > 4096):
            yield start, x
            start, held = x, 0
        held += 1
        while z - start > 4096 or long and start < z:
            yield start, min(z, start + 4096)
            start, held = min(z, start + 4096), 1
    if edges and start < edges[-1]:
        yield start, edges[-1]


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    n = len(text) - len(part) + 1
    at = np.nonzero(text[: max(0, n)] == part[0])[0]
    return any(np.array_equal(text[k : k + len(part)], part) for k in at)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", rank: int = RANK) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, overlap, has_answer.

    A benchmark of more than ``BLOCK_BYTES`` is searched for in blocks, each in all rows.
    """
    parts = [_find_block(docs, block, id_column, text_column, item_column, item_text_column, rank) for block in item_blocks(benchmark, item_text_column)]
    return reduce(DataFrame.union, parts)


def _find_block(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text_column: str, rank: int) -> DataFrame:
    bench = load_benchmark(benchmark, item_column, item_text_column)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("item_id", benchmark.schema[item_column].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("has_answer", T.BooleanType())])
    if not bench.items:
        return docs.sparkSession.createDataFrame([], schema)
    encoded = materialize(encode_words(docs, bench, id_column, text_column), "decontam-words")
    space = latent_space(encoded, bench, rank)
    words, block, n = _query_words(bench, space.keep)
    weighted_basis = space.basis * space.idf[:, None]
    queries = _weighted(words, block, weighted_basis, n)
    norms = np.linalg.norm(queries, axis=1)
    per_item = -(-np.array([len(x) for x in bench.ids]) // PASSAGE)
    owner = np.repeat(np.arange(len(bench.ids)), per_item)
    queries = queries / np.maximum(norms, 1e-9)[:, None]
    small, n_words = len(bench.vocabulary) < 1 << 15, len(bench.vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((bench.items, bench.ids, space.keep, weighted_basis, queries, owner, item_grams(bench)))
    item_type = to_arrow_type(benchmark.schema[item_column].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, item_ids, keep, basis, queries, owner, grams = shared.value
        places = [_places(x) for x in item_ids]
        own_queries = np.searchsorted(owner, np.arange(len(item_ids) + 1))
        short = np.nonzero(np.array([len(x) for x in item_ids])[owner] <= STRIDE)[0]
        for part in slices(batches, 1024, 1, SLICE_BYTES):
            ids, lengths = _decode(part, small, 1)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            words, block, first = _passages(ids, lengths, keep, STRIDE)
            halves = _weighted(words, block, basis, int(first[-1]))
            # A window is a block of STRIDE words and the next one of the same document.
            windows = halves.copy()
            inner = np.ones(len(halves), bool)
            inner[first[1:][lengths > 0] - 1] = False
            windows[:-1][inner[:-1]] += halves[1:][inner[:-1]]
            windows /= np.maximum(np.linalg.norm(windows, axis=1), 1e-9)[:, None]
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}

            at_place, of_item = gram_hits(ids, starts, grams)
            doc = np.searchsorted(starts, at_place, side="right") - 1
            keys = np.unique((first[doc] + (at_place - starts[doc]) // STRIDE) * len(items) + of_item)
            found = [(keys, np.array([(queries[own_queries[k % len(items)] : own_queries[k % len(items) + 1]] @ windows[k // len(items)]).max() for k in keys.tolist()], np.float32))]
            halves /= np.maximum(np.linalg.norm(halves, axis=1), 1e-9)[:, None]
            for vectors, chosen in ((windows, np.arange(len(queries))), (halves, short)):
                for q in range(0, len(chosen), 2048):
                    for w in range(0, len(vectors), 8192):
                        cosines = vectors[w : w + 8192] @ queries[chosen[q : q + 2048]].T
                        where, which = np.nonzero(cosines >= MIN_COSINE)
                        found.append(((w + where) * len(items) + owner[chosen[q + which]], cosines[where, which]))
            keys, cosines = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((cosines, keys))
            order = order[np.append(np.diff(keys[order]) > 0, True)[: len(order)]]
            # Each window and item once, with its highest cosine, by item.
            order = order[np.argsort(keys[order] % len(items), kind="stable")]
            window, of_item, cosines = keys[order] // len(items), keys[order] % len(items), cosines[order]
            doc = np.searchsorted(first, window, side="right") - 1
            begin = starts[doc] + (window - first[doc]) * STRIDE
            size = np.array([len(x) for x in item_ids])[of_item]
            low, high = np.maximum(starts[doc], begin - size), np.minimum(starts[doc + 1], begin + PASSAGE + size)
            common, padded = np.zeros(len(of_item), np.int64), np.append(ids, -1)
            for a, z in _groups(of_item, size, max(1, TABLE_BYTES // (8 * n_words + 8))):
                if size[a] <= 64:
                    own, which = np.unique(of_item[a:z], return_inverse=True)
                    width = PASSAGE + 2 * int(size[a:z].max())
                    at = low[a:z, None] + np.arange(width)
                    texts = padded[np.where(at < high[a:z, None], at, len(ids))]
                    common[a:z] = common_subsequences([places[k] for k in own], np.array([len(item_ids[k]) for k in own]), which, texts, n_words)
                else:
                    one = int(of_item[a])
                    common[a:z] = [common_subsequence(places[one], len(item_ids[one]), ids[i:j].tolist()) for i, j in zip(low[a:z], high[a:z])]
            for k in np.nonzero(common >= MIN_PARAPHRASE * size)[0].tolist():
                one = int(of_item[k])
                item = item_ids[one]
                overlap = int(common[k]) / len(item)
                answer = _contains(ids[low[k] : high[k]], item[-ANSWER_WORDS:])
                if overlap >= MIN_OVERLAP or answer:
                    pair, now = (int(doc[k]), one), (float(cosines[k]), overlap, answer)
                    best[pair] = max(best.get(pair, now), now, key=lambda x: (x[1], x[2], x[0]))
            pairs = sorted(best)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([items[k] for _, k in pairs], item_type), *(pa.array([best[p][c] for p in pairs], t) for c, t in enumerate((pa.float64(), pa.float64(), pa.bool_())))], names=["doc_id", "item_id", "cosine", "overlap", "has_answer"])

    return encoded.mapInArrow(search, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    own = free_name(docs.columns, "leaked")
    leaked = find_leaks(docs, benchmark, id_column, text_column).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaked, quoted(id_column).eqNullSafe(F.col(own)), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
