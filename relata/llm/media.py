"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays.

A text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are
the red, green, blue and alpha samples of consecutive pixels.  The image is
``ROW`` pixels wide (wider only where the format's height limit asks for it).
Everything that is returned besides the two sizes comes from the decoded file.

Bytes of texts seldom gain by a predictor or by cross-colour, so the estimate
chooses them for few files.  One payload in ``VARIED``, by its checksum, has
its file written with all of predictor (its modes by turns, from tile to tile),
cross-colour (multipliers by the checksum) and subtract-green, whatever the
size, so that a table of any size has its share of files that take every
inverse transform to read.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal
files; a null id is kept; a payload over the format's 1 GiB of samples raises
an error rather than being cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import read_table, slices
from relata.llm.webp import CROSS_COLOUR, MAX_SIDE, PREDICTOR, SUBTRACT_GREEN, choose_transforms, decode, encode

BLOCK = 64
ROW = 16
PLANNED_PIXELS = 1 << 14
VARIED, TILE_BITS, MODES = 512, 2, 14
KEPT_ROWS = 20_000


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % BLOCK or (BLOCK if not data else 0))


def as_pixels(payload: bytes) -> tuple[np.ndarray, int, int]:
    """(pixels, width, height) of a payload; the last row is filled with zeros."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    width = ROW * -(-len(px) // (ROW * MAX_SIDE))
    if width > MAX_SIDE:
        raise ValueError("a payload does not fit an image")
    height = -(-len(px) // width)
    if width * height > len(px):
        px = np.concatenate([px, np.zeros((width * height - len(px), 4), np.uint8)])
    return px, width, height


def varied(payload: bytes) -> int | None:
    """The checksum of a payload whose file has all transforms; None for others."""
    sum_ = zlib.crc32(payload)
    return sum_ // VARIED if sum_ % VARIED == 0 else None


def with_all_transforms(payload: bytes, choice: int) -> bytes:
    px, width, height = as_pixels(payload)
    tiles = -(-width >> TILE_BITS) * -(-height >> TILE_BITS)
    modes = [(choice + k) % MODES for k in range(tiles)]
    return encode(px, width, height, transforms=(PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN), tile_bits=TILE_BITS, modes=modes, elements=tuple(choice >> shift & 31 for shift in (4, 9, 14)))


def to_media(payload: bytes) -> bytes:
    choice = varied(payload)
    return encode(*as_pixels(payload)) if choice is None else with_all_transforms(payload, choice)


def to_media_many(payloads: list[bytes]) -> Iterator[bytes]:
    """``to_media`` of each; the transforms of images of the usual width are chosen for many at once."""
    for choice, own in groupby(payloads, varied):
        yield from _planned(own) if choice is None else (with_all_transforms(p, choice) for p in own)


def _planned(payloads: Iterable[bytes]) -> Iterator[bytes]:
    held: list[tuple[np.ndarray, int, int]] = []

    def files() -> Iterator[bytes]:
        usual = [px for px, width, _ in held if width == ROW]
        plans = iter(choose_transforms(usual, ROW) if usual else ())
        for px, width, height in held:
            yield encode(px, width, height, plan=next(plans) if width == ROW else None)
        held.clear()

    pixels = 0
    for payload in payloads:
        image = as_pixels(payload)
        if held and pixels + len(image[0]) > PLANNED_PIXELS:
            yield from files()
            pixels = 0
        held.append(image)
        pixels += len(image[0])
    yield from files()


def from_media(media: bytes, payload_bytes: int) -> bytes:
    return decode(media)[2].reshape(-1).tobytes()[:payload_bytes]


def feature(payload: bytes) -> str:
    """Samples' sum, number of distinct values, most frequent value, and how many fall into each sixteenth of the range."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    return f"{int(counts @ np.arange(256))}:{int((counts > 0).sum())}:{int(counts.argmax())}:" + ",".join(map(str, counts.reshape(16, 16).sum(axis=1)))


FIELDS = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", ", media binary")


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_media: bool = False) -> DataFrame:
    """Per row of ``docs``: sizes, digests and features, and the file itself on request."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few texts at a time where the files themselves are returned.  Copies of a text have the row of the first one that the worker met.
        for part in slices(batches, keep=not with_media):
            known: dict[bytes, tuple] = workers.kept("media", dict) if not with_media else {}
            if len(known) > KEPT_ROWS:
                known.clear()
            texts = [(text or "").encode() for text in part.column(1).to_pylist()]
            keys = [hashlib.sha256(data).digest() for data in texts]
            new = {key: data for key, data in zip(keys, texts) if key not in known}
            payloads = list(map(padded, new.values()))
            for (key, data), payload, media in zip(new.items(), payloads, to_media_many(payloads)):
                back = from_media(media, len(payload))
                known[key] = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)) + ((media,) if with_media else ())
            rows = [known[key] for key in keys]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), own))], names=["doc_id", *(f.name for f in own)])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)] + T._parse_datatype_string(FIELDS[0] + FIELDS[1] * with_media).fields)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    own = [pa.field(n, kinds[t]) for n, t in (f.split() for f in (FIELDS[0] + FIELDS[1] * with_media).split(", "))]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column)).mapInArrow(convert, schema)


def op9_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
