import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm.tokens import Encoder, vocabulary_path

ENCODER = Encoder(vocabulary_path())
ODD = ["", " ", "a  b", " a", "a ", "a\n\nb", "a \n b", "it's, ok.", "x.,", "\0a b", "a\0 b", "1. 2, 3",
       "a \0b c", "日本 語。", "a\x1cb", "don't. we'", "<|endoftext|> x", "a b", "é. ü,"]


def same(texts):
    ids, counts = ENCODER.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == ENCODER.library.encode(text, add_special_tokens=False).ids, text


def test_equals_the_library_on_odd_spacing():
    same(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'\n\t1%s", max_size=20), min_size=1, max_size=8))
def test_equals_the_library_on_any_text(texts):
    same(texts)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("loanweave.llm.tokens.CACHED_CUTS", 3)
    same(["a b c d e", "b c d", "x y z a"])
    same(["a b c d e", "q"])
