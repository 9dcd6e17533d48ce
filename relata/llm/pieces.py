"""Encoding and decoding with a SentencePiece byte-pair model, by vectorised merge rounds.

A text is cut where no piece of the vocabulary spans two neighbouring
characters, first before the spaces that start a word.  The symbols of many
cuts lie in flat arrays.  Each round takes the best pair of every cut at once
(a segmented minimum over pair ranks), merges its places from the left, and
removes merged symbols and finished cuts from the arrays, until no pair is
left.  The library merges one place at a time, the best and leftmost first; a
round ends in a cut after the first place whose new neighbours make a pair as
good or better, since the library would take that pair before the next place.
Cuts that need more than ``ROUNDS`` rounds (long runs of spaces, whose pieces
all have one score) go on with a heap, in the same order.

Characters outside the vocabulary become their bytes' pieces.  Cuts are encoded
once for all texts of a group, and known ones are kept from group to group
within ``KEPT_BYTES``.

Defined results: a null or empty text has the end id alone and decodes to an
empty text; white space is kept as it is; names of control pieces in a text
are plain characters; a null id is kept; only the two named columns are read,
so others may have any name.  Models with a normaliser that changes more than
spaces, or with pieces of the user, are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import read_table, slices

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
GROUP_BYTES = 2 << 20
KEPT_BYTES = 128 << 20
LONG_UNIT = 128
ROUNDS = 64
NONE = np.iinfo(np.int32).max
EMPTY = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's vocabulary as arrays."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("  Ａ b ") != f"{SPACE * 3}Ａ{SPACE}b{SPACE}":
            raise ValueError(f"{model} changes texts before they are cut")
        size = sp.vocab_size()
        apart = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)) or sp.encode("<s>") == [sp.bos_id()]:
            raise ValueError(f"{model} has pieces that are never used, or pieces of the user")
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not apart[i]}
        self.end, self.width = sp.eos_id(), size
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if (self.bytes == sp.unk_id()).any():
            raise ValueError(f"{model} has no pieces for bytes")
        rank = np.unique([-sp.get_score(i) for i in range(size)], return_inverse=True)[1].astype(np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        bigrams, pairs = set(), []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
                continue
            bigrams.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left * size + right, i))
        keys, made = (np.array(c, np.int64) for c in zip(*pairs))
        # Open addressing, mostly empty: a key is found, or found missing, at its first place as a rule.
        self.shift = 64 - (8 * len(keys)).bit_length()
        self.pair_keys = np.full(1 << (64 - self.shift), EMPTY, np.int64)
        self.pair_ids = np.full(len(self.pair_keys), EMPTY, np.int32)
        places = self._place(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(places, return_index=True)[1]] = True
            own = first & (self.pair_keys[places] == EMPTY)
            self.pair_keys[places[own]], self.pair_ids[places[own]] = keys[own], made[own]
            keys, made, places = keys[~own], made[~own], (places[~own] + 1) % len(self.pair_keys)
        self.pair_ranks = np.where(self.pair_ids == EMPTY, NONE, rank[self.pair_ids])
        # Characters that stand beside others in pieces have a class of their own, the rest class 0.
        inner = sorted({c for pair in bigrams for c in pair})
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for a, b in bigrams:
            self.beside[self.classes[ord(a)], self.classes[ord(b)]] = True
        self.lines_apart = "\n" not in inner
        self.names = list(map(str, range(size)))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols makes, and its rank; ``NONE`` where it makes none."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -2)
        at = self._place(keys)
        other = self.pair_keys[at]
        while len(off := np.flatnonzero((other != keys) & (other != EMPTY))):
            at[off] = (at[off] + 1) % len(self.pair_keys)
            other[off] = self.pair_keys[at[off]]
        return self.pair_ids[at], self.pair_ranks[at]

    def _by_heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """(places, symbols) of one cut, merged place by place."""
        ids, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def pairs(at: list[int]) -> list[tuple[int, int, int, int, int]]:
            at = [a for a in at if a >= 0 and after[a] < n]
            if not at:
                return []
            left, right = [ids[a] for a in at], [ids[after[a]] for a in at]
            made, rank = self.merged(np.array(left), np.array(right))
            return [x for x in zip(rank.tolist(), at, left, right, made.tolist()) if x[0] != NONE]

        heap = pairs(list(range(n)))
        heapify(heap)
        while heap:
            _, a, left, right, made = heappop(heap)
            b = after[a]
            if ids[a] != left or b >= n or ids[b] != right:
                continue
            ids[a], ids[b], after[a] = made, -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            for x in pairs([before[a], a]):
                heappush(heap, x)
        places, a = [], 0
        while a < n:
            places.append(a)
            a = after[a]
        return places, [ids[a] for a in places]

    def merge(self, symbols: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, symbols) left of flat symbols when no pair of a cut can be merged; ``cuts`` numbers the cuts in order."""
        place, done = np.arange(len(symbols)), []

        def made_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of the symbols at ``at`` with their successors."""
            right = np.minimum(at + 1, len(symbols) - 1)
            piece, rank = self.merged(symbols[at], symbols[right])
            return piece, np.where((right > at) & (cuts[right] == cuts[at]), rank, NONE)

        piece, rank = made_at(place)
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            starts = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1]])
            sizes = np.diff(np.r_[starts, len(cuts)])
            best = np.minimum.reduceat(rank, starts)
            if (best == NONE).any():
                over = np.repeat(best == NONE, sizes)
                done.append((place[over], symbols[over]))
                left = ~over
                place, symbols, cuts, piece, rank = place[left], symbols[left], cuts[left], piece[left], rank[left]
                if not len(symbols):
                    break
                sizes, best = sizes[best != NONE], best[best != NONE]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of places that overlap every second one is merged; the last pair of a cut is none, so runs stay in it.
            first = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            new, own, cut = piece[at], rank[at], cuts[at]
            one, two = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
            joined = np.r_[False, at[1:] == at[:-1] + 2]
            before = np.where(joined, np.r_[new[:1], new[:-1]], symbols[one])
            ahead = np.where((at > 0) & (cuts[one] == cut), self.merged(before, new)[1], NONE)
            behind = np.where((at + 2 < len(symbols)) & (cuts[two] == cut), self.merged(new, symbols[two])[1], NONE)
            sooner = np.cumsum((ahead <= own) | (behind <= own))
            prior = np.r_[0, sooner[:-1]]
            head = np.r_[True, cut[1:] != cut[:-1]]
            base = prior[head][np.cumsum(head) - 1]
            keep = prior == base
            at, new = at[keep], new[keep]
            symbols[at] = new
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = (np.cumsum(stay) - 1)[at]
            place, symbols, cuts, piece, rank = place[stay], symbols[stay], cuts[stay], piece[stay], rank[stay]
            changed = np.r_[moved, moved[moved > 0] - 1]
            piece[changed], rank[changed] = made_at(changed)
        else:
            bounds = np.r_[np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1]]), len(cuts)] if len(cuts) else np.zeros(1, int)
            for a, b in zip(bounds[:-1], bounds[1:]):
                kept, own = self._by_heap(symbols[a:b].tolist())
                done.append((place[a:b][kept], np.array(own, np.int32)))
        places = np.concatenate([p for p, _ in done]) if done else np.zeros(0, int)
        order = np.argsort(places)
        return places[order], np.concatenate([s for _, s in done])[order] if done else symbols

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, four bytes each; a unit is text that no piece crosses the edges of."""
        if not units:
            return []
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<i4")
        unit = np.repeat(np.arange(len(units), dtype=np.int32), list(map(len, units)))
        symbols = self.chars[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)
        classes = self.classes[points]
        together = self.beside[classes[:-1], classes[1:]] & (unit[1:] == unit[:-1])
        cuts = np.cumsum(np.r_[False, ~together], dtype=np.int32)
        places, symbols = self.merge(symbols, cuts)
        owner = unit[places]
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            raw = [chr(-1 - s).encode() for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), int)
            times[odd] = list(map(len, raw))
            owner, ids = np.repeat(owner, times), np.repeat(symbols, times)
            ids[ids < 0] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = symbols
        ends = (4 * np.searchsorted(owner, np.arange(len(units) + 1))).tolist()
        data = ids.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _units(self, text: str) -> list[str]:
        """A text's units, each without the space in front; one that begins with a line break has none."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and SPACE not in text:
            return (text.replace("\n", " \n") if self.lines_apart else text).split(" ")
        whole = UNIT.findall(SPACE + text.replace(" ", SPACE))
        if not self.lines_apart or "\n" not in text:
            return [u[1:] for u in whole]
        out = []
        for u in whole:
            first, *rest = u[1:].split("\n")
            out += [first, *("\n" + r for r in rest)]
        return out

    def _learn(self, units: list[str]) -> None:
        for u, ids in zip(units, self.encode_units([u if self.lines_apart and u[:1] == "\n" else SPACE + u for u in units])):
            self.new[u] = ids
            self.held += 200 + 4 * len(u) + len(ids)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Each text's ids with the end id, and the same as decimal numbers between spaces."""
        split = list(map(self._units, texts))
        unknown = set().union(*split).difference(self.new)
        again = unknown.intersection(self.old)
        for u in again:
            self.new[u] = self.old[u]
            self.held += 200 + 4 * len(u) + len(self.old[u])
        unknown -= again
        self._learn(list(unknown))
        for units in split:
            ids = np.frombuffer(b"".join(map(self.new.__getitem__, units)), "<i4").tolist()
            ids.append(self.end)
            yield ids, " ".join(map(self.names.__getitem__, ids))
        for u in unknown:
            if len(u) > LONG_UNIT:  # seldom met again
                self.held -= 200 + 4 * len(u) + len(self.new.pop(u))
        if self.held > KEPT_BYTES // 2:
            self.old, self.new, self.held = self.new, {}, 0


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None, with_values: bool = False) -> DataFrame:
    """Per row: number of ids and digests of ids and decoded text; the ids and the decoded text themselves on request."""
    path = model or default_model()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1, most=GROUP_BYTES, keep=True):
            pieces = workers.kept(("pieces", path), lambda: Pieces(path))
            rows = []
            for ids, written in pieces.encode([t.decode() if t else "" for t in part.column(1).to_pylist()]):
                back = pieces.library.decode(ids)
                rows.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) + ((ids, back) if with_values else ()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)

    own = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)] + T._parse_datatype_string(own).fields)
    names = schema.fieldNames()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("binary")).mapInArrow(convert, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"))
