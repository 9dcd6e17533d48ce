"""Vectorised merges against the library whose ids they must equal."""

import hashlib
import random

import pytest

from relata.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
ODD = ["", " ", "  ", "a  b ", "\x00a", "\ta\n", "▁x", "ﬁ", "<s>", "</s> hi", "<0x0A>", "<unk>", "x" * 3000, " " * 700, "　全角", "\r\n", "é", "é", "😀 ok 😀😀", "日本語テキスト" * 40, "=" * 300, "aaaabbbb" * 60, "the" * 300, "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.default_model())


def drawn(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "   ", "x", "th", "er", "\n", "=", "-", "日", "é", "0", "▁", "😀", "  x", ".", "🏳️‍🌈", "́"]
    return ["".join(rng.choices(parts[: rng.randrange(2, len(parts) + 1)], k=rng.randrange(1, 120))) for _ in range(n)]


def test_ids_equal_the_librarys(own, library):
    texts = ODD + drawn(4, 2500)
    assert [ids for ids, _ in own.encode(texts)] == library.encode(texts, add_eos=True)


@pytest.mark.parametrize("rounds", [1, 3])
def test_the_heap_takes_over_at_any_round(own, library, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    fresh = pieces.Pieces(pieces.default_model())
    texts = ODD + drawn(5, 300)
    assert [ids for ids, _ in fresh.encode(texts)] == library.encode(texts, add_eos=True)


def test_known_units_stay_within_their_bytes(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    small = pieces.Pieces(pieces.default_model())
    for seed in range(6):
        texts = drawn(seed, 60)
        assert [ids for ids, _ in small.encode(texts)] == library.encode(texts, add_eos=True)
        assert small.held <= 10_000 and all(len(u) <= pieces.LONG_UNIT for u in small.new | small.old)


def test_documents(spark, library):
    texts = [None, *ODD, *ODD]
    rows = [(k if k else None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string, `a.b` int")
    found = {}
    for r in pieces.encoded(df, with_values=True).collect():
        found[r["doc_id"]] = r
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        ids, r = library.encode(t or "", add_eos=True), found[k if k else None]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    empty = pieces.encoded(df.limit(0))
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0
