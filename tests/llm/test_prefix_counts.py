import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm import prefix_counts as pc
from loanweave.llm.tokens import vocabulary_path
from tests.llm import cases

COUNTER = pc.PrefixCounter(vocabulary_path())
PARTS = [
    " ", "  ", "\n", "\t", "a", "the", "don't", "'re", "é", "日本", "1234", "!!", "<|endoftext|>", "<|endo",
    " ", "\x1c", "\x00", "word,", "\r\n", "abc.", "😀", "Ġ",
]


def counts_of(text):
    """Brute force: the library on every prefix."""
    encode = COUNTER.library.encode
    return [len(encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), st.text(max_size=20)))
def test_every_prefix_has_the_librarys_count(text):
    steps = COUNTER.steps(text)
    assert pc.unpack(*pc.pack(steps), len(text)).tolist() == counts_of(text)


def test_prose_long_words_and_pieces():
    for text in (cases.prose(3), "ab" * 400, "0" * 500, ("lorem ipsum, " * 40)[:-1]):
        assert pc.unpack(*pc.pack(COUNTER.steps(text)), len(text)).tolist() == counts_of(text)
    text = cases.prose(6, 3000)
    cut = list(pc.pieces(text, 1000))
    assert "".join(cut) == text and len(cut) > 5
    whole = np.cumsum(COUNTER.steps(text))
    assert whole[-1] == len(COUNTER.library.encode(text, add_special_tokens=False).ids)
    assert np.array_equal(np.concatenate([COUNTER.steps(p) for p in cut]), np.diff(whole, prepend=0))


def test_cache_starts_anew_without_changing_counts(monkeypatch):
    monkeypatch.setattr(pc, "KEPT_CHARS", 100)
    small = pc.PrefixCounter(vocabulary_path())
    for i in range(5):
        text = cases.prose(i)
        assert np.array_equal(small.steps(text), COUNTER.steps(text))


@given(st.lists(st.integers(-70_000, 70_000), max_size=9), st.sampled_from([1, 100, 10_000]))
def test_steps_round_trip(steps, divisor):
    steps = np.array(steps, np.int64) // divisor
    assert pc.unpack(*pc.pack(steps), len(steps)).tolist() == [0, *np.cumsum(steps)]


def test_table_and_answers(spark):
    table = pc.prefix_table(cases.with_clashes(cases.documents(spark)))
    rows = pc.answers(table, [-1, 0, 7, 512], [0, 5, 10**9]).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(
        ((i, len((t or "").encode()), (t or "")) for i, t, *_ in cases.ROWS), key=key
    )
    assert len(rows) == len(want)
    for r, (doc_id, n_bytes, text) in zip(sorted(rows, key=key), want):
        encoding = COUNTER.library.encode(text, add_special_tokens=False)
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (doc_id, n_bytes, len(encoding.ids))
        assert r.counts[0] == 0 and r.counts[2] == r.n_tokens
        assert r.counts[1] == len(COUNTER.library.encode(text[:5], add_special_tokens=False).ids)
        assert r.fits[:2] == [None, 0]
        for budget, chars in zip((7, 512), r.fits[2:]):
            near = range(max(chars - 3, 0), min(chars + 40, len(text)) + 1)
            fitting = [i for i in near if len(COUNTER.library.encode(text[:i], add_special_tokens=False).ids) <= budget]
            assert fitting[-1] == chars


def test_empty_table(spark):
    assert pc.answers(pc.prefix_table(cases.empty(spark)), [5]).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abtheingoré ß,.\n'Ü", max_size=60), max_size=6))
def test_words_learned_together_have_the_counts_of_single_ones(texts):
    together, alone = pc.PrefixCounter.__new__(pc.PrefixCounter), COUNTER
    together.__dict__.update(COUNTER.__dict__)
    together._start_anew()
    together.learn(texts)
    alone._start_anew()
    for text in texts:
        assert together.steps(text).tolist() == alone.steps(text).tolist()
        assert np.cumsum([0, *together.steps(text)]).tolist() == counts_of(text)
    counts, order = together.counts_of([b" there", b"a", b" nothingness"])
    assert [counts[list(order).index(i)][n] for i, n in ((0, 6), (1, 1), (2, 12))] == [
        counts_of(w)[-1] for w in (" there", "a", " nothingness")
    ]
