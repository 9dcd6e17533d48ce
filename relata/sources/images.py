"""PNG in and out, sharpness, and drawing on pixel arrays, in NumPy.

``decode_png`` reads 8-bit grey, RGB, palette and alpha images without
interlacing.  Sharpness is the variance of a 3 by 3 Laplacian of the grey image
with mirrored borders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.sources.files import created, digest_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(kind: int, row: list[int], above: list[int], n: int) -> list[int]:
    """A row that was stored by its left and upper neighbours' average (3), or by the nearest of three neighbours (4), as plain numbers."""
    line, up = [0] * n, [0] * n + above
    if kind == 3:
        for x, value in enumerate(row):
            line.append(value + (line[x] + up[x + n] >> 1) & 255)
        return line[n:]
    for x, value in enumerate(row):
        left, upper, corner = line[x], up[x + n], up[x]
        by_left, by_upper, by_corner = abs(upper - corner), abs(left - corner), abs(left + upper - 2 * corner)
        guess = left if by_left <= by_upper and by_left <= by_corner else upper if by_upper <= by_corner else corner
        line.append(value + guess & 255)
    return line[n:]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    body, palette, head = b"", None, None
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += content
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit images without interlacing are read")
    n = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            line = row
        elif kind == 1:
            line = np.cumsum(row.reshape(width, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = row + above
        else:
            line = np.array(_unfiltered(kind, row.tolist(), above.tolist(), n), np.uint8)
        out[y] = above = line
    px = out.reshape(height, width, n)
    if colour == 3:
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if n < 3 else px[:, :, :3]


def encode_png(px: np.ndarray) -> bytes:
    height, width, _ = px.shape
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(px.reshape(height, -1), axis=0, prepend=np.zeros((1, width * 3), np.uint8)).astype(np.uint8)], axis=1)
    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def grey(px: np.ndarray) -> np.ndarray:
    """Luma in fixed-point arithmetic of fourteen bits."""
    weights = np.array([4899, 9617, 1868])
    return ((px.astype(np.int64) @ weights + (1 << 13)) >> 14).astype(np.float64)


def sharpness(px: np.ndarray) -> float:
    g = np.pad(grey(px), 1, mode="reflect")
    laplacian = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(laplacian.var())


def image_measures(frames: DataFrame, image: str = "image") -> DataFrame:
    """Adds width, height and sharpness from PNG bytes; nulls where there is no image."""
    kept = [c for c in frames.columns if c != image]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if d is None else decode_png(d) for d in batch.column(len(kept)).to_pylist()]
            values = [[None if p is None else f(p) for p in rows] for f in (lambda p: p.shape[1], lambda p: p.shape[0], sharpness)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.float64())))], names=[*kept, "width", "height", "sharpness"])

    from pyspark.sql import types as T

    schema = T.StructType([frames.schema[c] for c in kept] + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("sharpness", T.DoubleType())])
    return frames.select(*kept, image).mapInArrow(measure, schema)


def draw_box(px: np.ndarray, box: tuple[float, float, float, float], colour: tuple[int, int, int], thickness: int = 3) -> np.ndarray:
    """A copy with a rectangle's outline, clipped to the image."""
    out = px.copy()
    height, width, _ = out.shape
    x0, y0, x1, y1 = (int(round(v)) for v in box)
    x0, x1, y0, y1 = max(0, x0), min(width, x1 + 1), max(0, y0), min(height, y1 + 1)
    for region in ((slice(y0, min(y1, y0 + thickness)), slice(x0, x1)), (slice(max(y0, y1 - thickness), y1), slice(x0, x1)), (slice(y0, y1), slice(x0, min(x1, x0 + thickness))), (slice(y0, y1), slice(max(x0, x1 - thickness), x1))):
        out[region] = colour
    return out


# Which of fourteen strokes make up a character.  a to f go round from the top; g and h are the middle's
# halves; i, j, k are the upper slanted, upright and slanted strokes, l, m, n the lower ones.
STROKES = {
    "0": "abcdefkl", "1": "bck", "2": "abghed", "3": "abhcd", "4": "fghbc", "5": "afghcd", "6": "afghcde", "7": "abc", "8": "abcdefgh", "9": "abcdfgh",
    "A": "abcefgh", "B": "abcdhjm", "C": "adef", "D": "abcdjm", "E": "adefgh", "F": "aefg", "G": "acdefh", "H": "bcefgh", "I": "adjm", "J": "bcde", "K": "efgkn", "L": "def", "M": "bcefik",
    "N": "bcefin", "O": "abcdef", "P": "abefgh", "Q": "abcdefn", "R": "abefghn", "S": "acdfgh", "T": "ajm", "U": "bcdef", "V": "efkl", "W": "bcefln", "X": "ikln", "Y": "ikm", "Z": "adkl",
    "-": "gh", "_": "d", "=": "dgh", "+": "ghjm", "|": "jm", "/": "kl", ".": "", " ": "",
}
_ENDS = {
    "a": (0, 0, 2, 0), "b": (2, 0, 2, 2), "c": (2, 2, 2, 4), "d": (0, 4, 2, 4), "e": (0, 2, 0, 4), "f": (0, 0, 0, 2), "g": (0, 2, 1, 2), "h": (1, 2, 2, 2),
    "i": (0, 0, 1, 2), "j": (1, 0, 1, 2), "k": (2, 0, 1, 2), "l": (0, 4, 1, 2), "m": (1, 2, 1, 4), "n": (1, 2, 2, 4),
}


def text_size(text: str, height: int = 12) -> tuple[int, int]:
    """(width, height) of a drawn line."""
    return max(0, len(text) * (height // 2 + height // 4) - height // 4), height


def draw_text(px: np.ndarray, x: int, y: int, text: str, colour=(0, 0, 0), height: int = 12) -> np.ndarray:
    """A copy with a line of text in straight strokes, capitals for small letters; other characters are boxes.  What lies outside the image is not drawn."""
    out, wide, weight = px.copy(), height // 2, max(1, height // 8)
    for k, character in enumerate(text.upper()):
        left = x + k * (wide + height // 4)
        for stroke in STROKES.get(character, "abcdef") or ("." if character == "." else ""):
            x0, y0, x1, y1 = _ENDS.get(stroke, (0, 4, 0, 4))
            steps = max(1, height)
            at = np.linspace(0, 1, steps + 1)
            xs = np.rint(left + (x0 + (x1 - x0) * at) * (wide - weight) / 2).astype(int)
            ys = np.rint(y + (y0 + (y1 - y0) * at) * (height - weight) / 4).astype(int)
            for dx in range(weight):
                for dy in range(weight):
                    inside = (xs + dx >= 0) & (xs + dx < out.shape[1]) & (ys + dy >= 0) & (ys + dy < out.shape[0])
                    out[ys[inside] + dy, xs[inside] + dx] = colour
    return out


def draw_label(px: np.ndarray, box: tuple[float, float, float, float], label: str, colour: tuple[int, int, int], height: int | None = None) -> np.ndarray:
    """A copy with a white label on a filled field above the box's upper left corner, or at the image's edge."""
    height = height or max(16, min(px.shape[:2]) // 40)
    width, _ = text_size(label, height)
    x, y = max(0, int(round(box[0]))), max(0, int(round(box[1])) - height - 8)
    out = px.copy()
    out[y : y + height + 9, x : x + width + 11] = colour
    return draw_text(out, x + 5, y + 4, label, (255, 255, 255), height)


def scaled(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image as large as fits, by nearest pixels."""
    factor = min(width / px.shape[1], height / px.shape[0])
    h, w = max(1, round(px.shape[0] * factor)), max(1, round(px.shape[1] * factor))
    return px[np.arange(h) * px.shape[0] // h][:, np.arange(w) * px.shape[1] // w]


def cells(n: int, columns: int, cell_width: int, cell_height: int) -> list[tuple[int, int]]:
    """(x, y) of n cells in a grid, row by row."""
    return [(k % columns * cell_width, k // columns * cell_height) for k in range(n)]


def contact_sheet(images: list[np.ndarray], columns: int = 3, cell_width: int = 360, background: int = 255, headings: list[tuple[str, ...]] | None = None) -> np.ndarray:
    """Images in a grid of cells, all as high as the first image scaled to the cell's width; each below its lines of heading, if there are any."""
    if not images:
        raise ValueError("a sheet without images")
    height = max(1, round(cell_width * images[0].shape[0] / images[0].shape[1]))
    title = 0 if headings is None else 12 + 18 * max(map(len, headings))
    places = cells(len(images), columns, cell_width, title + height)
    sheet = np.full((-(-len(images) // columns) * (title + height), columns * cell_width, 3), background, np.uint8)
    for k, (px, (x, y)) in enumerate(zip(images, places)):
        for line, text in enumerate(headings[k] if headings else ()):
            room = sheet[y : y + title, x : x + cell_width]
            room[:] = draw_text(room, 5, 5 + 18 * line, text)
        small = scaled(px, cell_width, height)
        top, left = y + title + (height - small.shape[0]) // 2, x + (cell_width - small.shape[1]) // 2
        sheet[top : top + small.shape[0], left : left + small.shape[1]] = small
    return sheet


def master_sheet(sheets: list[tuple[str, np.ndarray]], columns: int = 2, cell_width: int = 900, preview_height: int = 1080, background: int = 255) -> np.ndarray:
    """Scenes' sheets in one, each below its name."""
    if not sheets:
        raise ValueError("a sheet without scenes")
    title = 30
    out = np.full((-(-len(sheets) // columns) * (title + preview_height), columns * cell_width, 3), background, np.uint8)
    for (name, px), (x, y) in zip(sheets, cells(len(sheets), columns, cell_width, title + preview_height)):
        room = out[y : y + title, x : x + cell_width]
        room[:] = draw_text(room, 5, 7, f"Scene {name}", height=14)
        small = scaled(px, cell_width, preview_height)
        top, left = y + title + (preview_height - small.shape[0]) // 2, x + (cell_width - small.shape[1]) // 2
        out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def scene_sheets(stimuli: DataFrame, scene: str = "scene", order: str = "pair_index", image: str = "stimulus", headings: str | None = None, columns: int = 3, cell_width: int = 360) -> DataFrame:
    """(scene, sheet): one contact sheet for each scene, its images in order; a scene's images are few and meet in one task.  headings: a column with arrays of lines."""
    from pyspark.sql import types as T

    def lay_out(key, table):
        table = table.sort_by(order)
        lines = table[headings].to_pylist() if headings else None
        sheet = contact_sheet([decode_png(d) for d in table[image].to_pylist()], columns, cell_width, headings=lines)
        return pa.table({scene: table[scene].slice(0, 1), "sheet": pa.array([encode_png(sheet)], pa.binary())})

    wanted = [scene, order, image] + ([headings] if headings else [])
    return stimuli.select(*wanted).groupBy(scene).applyInArrow(lay_out, T.StructType([stimuli.schema[scene], T.StructField("sheet", T.BinaryType())]))


def write_images(images: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = False) -> DataFrame:
    """Writes every image to a file of the folder, in parallel and whole or not at all; returns (name, size_bytes, sha256).

    A name must lead to a place below the folder.  A file that stands there is
    an error unless it is the same image or ``overwrite`` is given.
    """
    import hashlib

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for own, data in zip(*(c.to_pylist() for c in batch.columns)):
                if not own or own.startswith("/") or ".." in own.split("/"):
                    raise ValueError(f"{own!r} is no name of a file below {folder}")
                digest = hashlib.sha256(data).hexdigest()
                if (standing := digest_of(f"{folder}/{own}")) is not None and standing != digest and not overwrite:
                    raise FileExistsError(f"{folder}/{own}")
                if standing != digest:
                    with created(f"{folder}/{own}") as out:
                        out.write(data)
                done.append((own, len(data), digest))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["name", "size_bytes", "sha256"])

    return images.select(F.col(name).cast("string"), content).mapInArrow(write, "name string, size_bytes long, sha256 string")


def pdf(images: list[np.ndarray], resolution: float = 150.0) -> bytes:
    """A PDF file with one image a page."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: str, data: bytes) -> bytes:
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"")
    pages = []
    for px in images:
        height, width, _ = px.shape
        w, h = (round(72 * v / resolution, 2) for v in (width, height))
        picture = add(stream(f"/Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(np.ascontiguousarray(px).tobytes(), 6)))
        drawn = add(stream("", f"q {w} 0 0 {h} 0 0 cm /I Do Q".encode()))
        pages.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Resources << /XObject << /I {picture} 0 R >> >> /Contents {drawn} 0 R >>".encode()))
    objects[1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{p} 0 R' for p in pages)}] >>".encode()
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def render_stimuli(relations: DataFrame, image: str = "image", colours: tuple = ((220, 40, 40), (40, 80, 220))) -> DataFrame:
    """Adds stimulus: the image with both objects' boxes drawn and labelled A and B.  relations: ..., box_a, box_b and the image's bytes."""
    from pyspark.sql import types as T

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image in memory at a time
                row = batch.slice(k, 1)
                px = decode_png(row[image][0].as_py())
                for side, label, colour in zip(("box_a", "box_b"), "AB", colours):
                    box = row[side][0].as_py()
                    px = draw_label(draw_box(px, box, colour, max(3, min(px.shape[:2]) // 180)), box, label, colour)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([encode_png(px)], pa.binary())], names=[*row.schema.names, "stimulus"])

    return relations.mapInArrow(draw, T.StructType([*relations.schema.fields, T.StructField("stimulus", T.BinaryType())]))
