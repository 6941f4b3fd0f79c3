"""SentencePiece encoding against the library itself."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


CODEC = pieces.Codec(open(PATH, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def both(text: str) -> None:
    words = CODEC.model.words(text)
    CODEC.learn([words])
    ids = [j for w in words for j in CODEC.ids[w]]
    expected = LIBRARY.encode(text)
    assert ids == expected
    assert CODEC.decode(words) == LIBRARY.decode(expected)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a  b\n\tc▁d  ", "\0x", "▁", "aaaaaaaaaaa", "the  the", "éèê日本語🙂", "\r\n \x0b", "mississippi" * 50, "a" * 3001, "\n\n x \n"])
def test_cases(text):
    both(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeiounrtshldmc  \n▁.,é日🙂\t0123")), max_size=80))
def test_random(text):
    both(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    both(text.encode("utf-8", "ignore").decode())


def test_long_runs():
    r = random.Random(5)
    both("".join(r.choice("etaoinshrdlu") for _ in range(20_000)))
    both("".join(r.choice("aàb =-_/*#") for _ in range(20_000)))


def test_very_long_words():
    """Stretches without blanks in nearly linear time, cut and uncut, beside common words."""
    r = random.Random(6)
    both("the quick " + "".join(r.choice("etaoinshrdlu") for _ in range(200_000)) + " fox " + "ab" * 3000)
    both("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000)) + "▁x日本" * 300)


def test_table(spark, library):
    rows = [(1, None), (2, ""), (3, "The quick  brown fox"), (3, "The quick  brown fox"), (None, "x")]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens"), open(PATH, "rb").read()).collect()
    for row, (i, text) in zip(sorted(got, key=lambda x: (x.doc_id or 0, x.n_tokens)), sorted(rows, key=lambda x: (x[0] or 0)), strict=True):
        ids = library.encode(text or "")
        assert (row.doc_id, row.ids, row.n_tokens, row.decoded) == (i, ids, len(ids), library.decode(ids))
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), open(PATH, "rb").read()).count() == 0


def test_words_are_held_as_flat_arrays():
    model = open(PATH, "rb").read()
    codec = pieces.Codec(model)
    assert pieces.Codec(bytes(bytearray(model))).model is codec.model  # built once in each process
    words = ["the", "", "naïve", "☃☃x", "日本語🙂", "a" * 3000]
    codec.learn([words])
    for w in words:
        ids, named, text = codec.known[w]
        assert ids.itemsize == 4 and (not w or ids.tolist() == LIBRARY.encode(w))
        assert named == "".join(f"{i}," for i in ids) and text == " " + w
