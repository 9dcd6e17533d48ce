"""Language identification with unigram piece models, marginalised over segmentations.

The vocabulary is fixed: the pieces of a public tokenizer file (its path is a
parameter).  For each language a probability is learned for each piece by
expectation maximisation; a text's likelihood is the product over its words of
the sum over *all* ways to cut the word into pieces, computed by a forward
recursion.  Pieces never cross a word's end, so that product is exact and a
word's value can be kept and used again.

Learning uses about ``SAMPLE_ROWS`` labelled rows (documented bound; all of
them if there are fewer).  What comes to the driver is one number per piece and
language, bounded by the vocabulary.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with nothing to learn from, every text is ``und``; ties go to the language that
sorts first; repeated rows get equal results; a null id is kept.  A word may have
any length, in learning and in scoring: beyond ``BATCHED_LENGTH`` letters the
sums are rescaled at every letter.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm import workers
from relata.llm.common import free_name, held_out, map_arrow, materialize, passed, quoted, read_table, sampled, slices

SAMPLE_ROWS = 20_000
EM_STEPS = 2
SMOOTHING = 200.0
UNKNOWN_CHAR = 1e-9
MAX_PIECE = 16
BATCHED_LENGTH = 40
LETTER_FLOOR = 1e-3
KEPT_BYTES = 64 << 20
WORD_BYTES = 180
WORD_MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces in the order of their ids, which for this file is the order of merges."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 18


class Segmenter:
    """Piece ids of every cut of a word.  Two ids follow the pieces': no piece, and a single unknown character.

    Cuts of many words at once are looked up by 64-bit hashes.  The pieces'
    hashes all differ (checked); those whose slot in a table is taken go to the
    next table, so a lookup goes on only from a slot that holds another piece.
    """

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.longest = min(MAX_PIECE, max(map(len, index), default=1))
        usable = [x for x in index if len(x) <= MAX_PIECE]
        self.hashes = np.zeros(self.size, np.uint64)
        for n in {len(x) for x in usable}:
            same = [x for x in usable if len(x) == n]
            self.hashes[[index[x] for x in same]] = self._rolled(self._characters(same, n), n)[-1][:, 0]
        left = np.array([index[x] for x in usable], dtype=np.int64)
        if len(np.unique(self.hashes[left])) != len(left):
            raise ValueError("two pieces have one hash")
        self.tables: list[np.ndarray] = []
        while len(left):
            table = np.full(1 << _SLOT_BITS, -1, np.int32)
            slots = self._slots(self.hashes[left], len(self.tables))
            table[slots[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slots] != left]

    @property
    def size(self) -> int:
        return len(self.index) + 2

    @staticmethod
    def _characters(words: list[str], n: int) -> np.ndarray:
        return np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _rolled(characters: np.ndarray, longest: int) -> list[np.ndarray]:
        """For m from 1: hashes of the m characters from each place on."""
        out = [characters * _MIX]
        for m in range(2, min(longest, characters.shape[1]) + 1):
            x = (out[-1][:, :-1] + characters[:, m - 1 :]) * _BASE
            out.append(x ^ (x >> np.uint64(29)))
        return out

    @staticmethod
    def _slots(hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes * (_MIX + np.uint64(2 * table))) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def cuts(self, words: list[str]) -> np.ndarray:
        """(words, length, MAX_PIECE): for words of one length, the id of word[i-m:i] at [i-1, m-1]."""
        n, none = len(words[0]), len(self.index)
        ids = np.full((len(words), n, MAX_PIECE), none, np.int32)
        for m, hashes in enumerate(self._rolled(self._characters(words, n), self.longest), 1):
            flat = hashes.reshape(-1)
            found = self.tables[0][self._slots(flat, 0)] if self.tables else np.full(len(flat), -1, np.int32)
            held = np.nonzero(found >= 0)[0]
            wrong = held[self.hashes[found[held]] != flat[held]]
            for k in range(1, len(self.tables)):
                if not len(wrong):
                    break
                found[wrong] = self.tables[k][self._slots(flat[wrong], k)]
                wrong = wrong[found[wrong] >= 0]
                wrong = wrong[self.hashes[found[wrong]] != flat[wrong]]
            found[wrong] = -1
            ids[:, m - 1 :, m - 1] = np.where(found < 0, none + 1 if m == 1 else none, found).reshape(len(words), n - m + 1)
        return ids


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Prefix sums of all segmentations. ids: (words, length, MAX_PIECE); p: (pieces, models). Result: (length + 1, words, models)."""
    n, length, _ = ids.shape
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1.0
    for i in range(1, length + 1):
        for m in range(1, min(i, MAX_PIECE) + 1):
            alpha[i] += alpha[i - m] * p[ids[:, i - 1, m - 1]]
    return alpha


def log_forward_long(word: str, segmenter: Segmenter, p: np.ndarray) -> np.ndarray:
    """The same for one long word, rescaled at each step so that nothing underflows."""
    get, unknown = segmenter.index.get, len(segmenter.index) + 1
    recent, log_scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for i in range(1, len(word) + 1):
        total = recent[-1] * p[get(word[i - 1 : i], unknown)]
        for m in range(2, min(i, MAX_PIECE) + 1):
            k = get(word[i - m : i])
            if k is not None:
                total = total + recent[-m] * p[k]
        recent = [r / total for r in recent[-MAX_PIECE:]] + [np.ones(p.shape[1])]
        log_scale += np.log(total)
    return log_scale


def log_likelihoods(words: list[str], segmenter: Segmenter, p: np.ndarray) -> np.ndarray:
    """(words, models): log of the sum over all segmentations of each word, the word mark put in front."""
    out = np.empty((len(words), p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(k)
    for length, members in by_length.items():
        if length > BATCHED_LENGTH:
            for k in members:
                out[k] = log_forward_long(WORD_MARK + words[k], segmenter, p)
            continue
        for at in range(0, len(members), 4096):
            part = members[at : at + 4096]
            ids = segmenter.cuts([WORD_MARK + words[k] for k in part])
            out[part] = np.log(forward(ids, p)[-1])
    return out


def expected_counts_long(word: str, segmenter: Segmenter, p: np.ndarray) -> dict[int, float]:
    """Expected piece counts of one long word.

    ``last[i][m]`` is the probability that the piece which ends at i has m
    letters, given that one ends there; these shares add up to one at every
    place, whatever the word's length, so nothing underflows on the way back.
    """
    get, unknown = segmenter.index.get, len(segmenter.index) + 1
    last: list[list[tuple[int, int, float]]] = []
    recent = [1.0]
    for i in range(1, len(word) + 1):
        options = [(1, get(word[i - 1 : i], unknown))]
        options += [(m, k) for m in range(2, min(i, MAX_PIECE) + 1) if (k := get(word[i - m : i])) is not None]
        shares = [(m, k, recent[-m] * float(p[k])) for m, k in options]
        total = sum(x for _, _, x in shares)
        last.append([(m, k, x / total) for m, k, x in shares])
        recent = [r / total for r in recent[1 - MAX_PIECE :]] + [1.0]
    ends = [0.0] * len(word) + [1.0]
    counts: dict[int, float] = {}
    for i in range(len(word), 0, -1):
        for m, k, share in last[i - 1]:
            x = ends[i] * share
            ends[i - m] += x
            counts[k] = counts.get(k, 0.0) + x
    return counts


def expected_counts(words: list[str], weights: np.ndarray, segmenter: Segmenter, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one model, by forward and backward sums."""
    total = np.zeros(segmenter.size)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) < BATCHED_LENGTH:
            by_length.setdefault(len(w) + 1, []).append(k)
        else:
            for piece, n in expected_counts_long(WORD_MARK + w, segmenter, p).items():
                total[piece] += weights[k] * n
    for length, members in by_length.items():
        for at in range(0, len(members), 4096):
            part = members[at : at + 4096]
            ids = segmenter.cuts([WORD_MARK + words[k] for k in part])
            alpha = forward(ids, p[:, None])[:, :, 0]
            beta = np.zeros((length + 1, len(part)))
            beta[length] = weights[part] / alpha[length]
            for i in range(length, 0, -1):
                for m in range(1, min(i, segmenter.longest) + 1):
                    share = p[ids[:, i - 1, m - 1]] * beta[i]
                    beta[i - m] += share
                    total += np.bincount(ids[:, i - 1, m - 1], weights=share * alpha[i - m], minlength=segmenter.size)
    return total


class WordValues:
    """Log likelihoods of words met before, about KEPT_BYTES of them; what came early, and so often, stays when there are more."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.segmenter, self.p = Segmenter({x: k for k, x in enumerate(pieces)}), p
        self.rows: dict[str, int] = {}
        self.most = max(1 << 12, KEPT_BYTES // (WORD_BYTES + 8 * p.shape[1]))
        self.values = np.empty((1 << 12, p.shape[1]))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.most:
            for w in list(self.rows)[self.most // 2 :]:
                del self.rows[w]
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            start, end = len(self.rows), len(self.rows) + len(new)
            if end > len(self.values):
                self.values = np.concatenate([self.values[:start], np.empty((max(start, end - start), self.p.shape[1]))])
            self.values[start:end] = log_likelihoods(new, self.segmenter, self.p)
            self.rows.update(zip(new, range(start, end)))
        return self.values[np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray
    log_prior: np.ndarray


def _zipf(segmenter: Segmenter) -> np.ndarray:
    p = 1.0 / (np.arange(segmenter.size) + 10.0)
    p[-2:] = 0.0
    p /= p.sum()
    p[-1] = UNKNOWN_CHAR
    return p


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS, em_steps: int = EM_STEPS) -> LanguageModel:
    """Learn from about ``sample_rows`` rows of ``docs`` that have a language."""
    pieces = load_pieces(vocabulary or default_vocabulary())
    segmenter = Segmenter({x: k for k, x in enumerate(pieces)})
    labelled = docs.filter(F.col(lang_column).isNotNull())
    # Counted by id and language alone; a null text that is drawn has no words and teaches nothing.
    sample = labelled.filter(sampled(labelled.select(F.col(id_column).alias("id")), "id", sample_rows, id_column)).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 12):
            counts: Counter = Counter()
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    counts[lang, w] += n
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": pa.array(list(counts.values()), pa.int64())})

    counted = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = materialize(counted, "langid-words")
    weights = {r.lang: r.n for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(weights)
    background = _zipf(segmenter)
    p = np.repeat(background[:, None], max(1, len(languages)), axis=1)
    for _ in range(em_steps if languages else 0):
        current, position = p.astype(np.float64), {x: k for k, x in enumerate(languages)}

        def expect(batches: Iterator[pa.RecordBatch], current=current, position=position) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1 << 14):
                lang, word, n = (batch[c].to_pylist() for c in ("lang", "word", "n"))
                for one in set(lang):
                    own = [k for k, x in enumerate(lang) if x == one]
                    sums = expected_counts([word[k] for k in own], np.array([n[k] for k in own], dtype=float), segmenter, current[:, position[one]])
                    hit = np.nonzero(sums)[0]
                    yield pa.RecordBatch.from_pydict({"lang": [one] * len(hit), "piece": pa.array(hit.astype(np.int32)), "n": pa.array(sums[hit])})

        sums = np.zeros((segmenter.size, len(languages)))
        for r in table.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            sums[r.piece, position[r.lang]] = r.n
        sums[-2:] = 0.0
        shared = sums.sum(axis=1) + background * 10.0
        shared[-2:] = 0.0
        p = (sums + SMOOTHING * (shared / shared.sum())[:, None]) / (sums.sum(axis=0) + SMOOTHING)
        p[-1] = UNKNOWN_CHAR
    prior = np.array([weights[x] for x in languages], dtype=float)
    return LanguageModel(languages, pieces, p, np.log(prior / prior.sum()) if languages else np.zeros(0))


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text", keep: list[str] | None = None, out: tuple[str, str, str] = ("lang_pred", "score", "letter_log")) -> DataFrame:
    """The columns in ``keep`` (all by default) of each row of ``docs``, with the language, its posterior probability, and the
    natural logarithm of the text's likelihood in it by letter (null if there is none).  These replace columns of their names."""
    keep = passed(docs.columns if keep is None else keep, out)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.DoubleType())])
    languages, prior = model.languages, model.log_prior
    pieces, p = model.pieces, np.ascontiguousarray(model.probabilities, dtype=np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, p))

    token = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = workers.kept(token, lambda: WordValues(*shared.value))
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            langs: list[str] = []
            scores: list[float] = []
            by_letter: list[float | None] = []
            rows = [words_of(t) for t in batch.column(len(keep)).to_pylist()]
            flat = [w for r in rows for w in r]
            lengths = np.array([len(r) for r in rows])
            sums = np.zeros((len(rows), len(languages)))
            if flat and languages:
                starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                sums[lengths > 0] = np.add.reduceat(known.of(flat), starts[lengths > 0], axis=0)
            for row, total in zip(rows, sums):
                if not languages or not any(c.isalpha() for w in row for c in w):
                    langs.append("und")
                    scores.append(0.0)
                    by_letter.append(None)
                    continue
                z = total + prior
                best = int(np.argmax(z))
                langs.append(languages[best])
                scores.append(float(1.0 / np.exp(z - z[best]).sum()))
                by_letter.append(float(total[best]) / sum(map(len, row)))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(by_letter, pa.float64())], names=[*keep, *out])

    # The text is read by its place behind the kept columns, so no name of theirs can take its part.
    return map_arrow(docs.select(*map(quoted, keep), quoted(text_column).alias(free_name(keep, "text"))), score, schema)


def known_language(by_letter: Column, floor: float = LETTER_FLOOR) -> Column:
    """Whether a text is in a learned language at all: it is at least as likely there as letters drawn evenly from 1/floor."""
    return F.coalesce(by_letter >= math.log(floor), F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
