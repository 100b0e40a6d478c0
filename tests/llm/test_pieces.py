"""Ids from the table of last pieces against the library, and texts from ids."""

import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from parallaxis.llm import pieces
from parallaxis.llm.queries import piece_bpe


@pytest.fixture(scope="module")
def both():
    return pieces.pieces(piece_bpe()), SentencePieceProcessor(model_file=piece_bpe())


def equal(both, text):
    own, library = both
    ids, want = np.frombuffer(own.encode(text), "<u4"), library.encode(text)
    return ids.tolist() == want and own.decode(ids) == library.decode(want)


def test_every_piece_alone_and_beside_others(both):
    rng, words = random.Random(5), list(both[0].known)
    assert all(equal(both, w) and equal(both, w.replace("▁", " ")) for w in words)
    assert all(equal(both, "".join(rng.choices(words, k=rng.choice([2, 3, 8])))) for _ in range(4000))


def test_odd_texts(both):
    rng = random.Random(6)
    bits = ["a", "th", "e", "in", " ", "  ", "   ", "\n", "\t", "é", "é", "漢", "😀", "\x00", "▁", "1", ".", "’", "　", "﻿", "<s>", "</s>", "<0x0A>", "\U0010ffff"]
    assert all(equal(both, "".join(rng.choices(bits, k=rng.choice([1, 3, 10, 60])))) for _ in range(4000))
    assert all(equal(both, " " * k) and equal(both, "a" + " " * k + "b" + " " * k) for k in range(70))
    assert all(equal(both, "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(12))) for _ in range(1500))
    assert equal(both, "ab" * 50_000) and equal(both, "".join(rng.choices("etaoinshrdlu", k=100_000)))


def test_rows(spark, both):
    rows = [(1, None), (1, ""), (2, "the same"), (2, "the same"), (None, "a\nb"), (3, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, b"x", 5) for r in rows], "doc_id long, text string, ids binary, n_tokens int")
    out = pieces.decode_ids(pieces.encode_texts(docs, piece_bpe()), piece_bpe()).collect()
    library = both[1]
    for (doc_id, text), r in zip(sorted(rows, key=repr), sorted(out, key=lambda r: repr((r.doc_id, None if r.doc_id == 1 and r.n_tokens == 2 else r.decoded)))):
        assert r.doc_id == doc_id and r.decoded == (text or "") and np.frombuffer(r.ids, "<u4").tolist() == library.encode(text or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) // 4
    plain = pieces.encode_texts(docs.where("doc_id = 1"), piece_bpe(), begin=False, end=False).collect()
    assert [(r.n_tokens, bytes(r.ids)) for r in plain] == [(0, b"")] * 2
    assert pieces.encode_texts(docs.where("false"), piece_bpe()).count() == 0


def test_a_model_of_another_kind_is_refused(tmp_path):
    """An unknown id in place of byte fallback, or text that a normaliser changes, can't be encoded exactly."""
    raw = open(piece_bpe(), "rb").read()
    other = raw.replace(b"<0x41>", b"<0xZZ>", 1)
    (tmp_path / "m.model").write_bytes(other)
    with pytest.raises((ValueError, RuntimeError)):
        pieces.Pieces(str(tmp_path / "m.model"))
