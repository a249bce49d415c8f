import zlib

import numpy as np
import pytest

from loanweave.llm import packing
from loanweave.llm.tokens import Encoder, vocabulary_path
from tests.llm import cases

LIBRARY = Encoder(vocabulary_path()).library


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(pieces, rows):
    """Every id of every row in exactly one piece, windows without gaps, exactly full."""
    got = sorted((p.doc_id is None, p.doc_id or 0, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    by_doc = {}
    for none, doc, start, length, crc, tokens in got:
        by_doc.setdefault((none, doc), []).append((start, length, crc, tokens))
    expected = {}
    for row in rows:
        expected.setdefault((row[0] is None, row[0] or 0), []).append(ids_of(row[1]))
    assert set(by_doc) == set(expected)
    for key, texts in expected.items():
        assert sum(p[1] for p in by_doc[key]) == sum(map(len, texts))
        for start, length, crc, tokens in by_doc[key]:
            assert any(
                len(ids) == tokens and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
                for ids in texts
            )
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _, _ in parts] == list(np.cumsum([0] + [n for _, n, _ in parts])[:-1])
        total = sum(n for _, n, _ in parts)
        assert total == parts[0][2] <= 1024 and total & (total - 1) == 0


def test_odd_rows(spark):
    check(packing.pack(cases.with_clashes(cases.documents(spark))).collect(), cases.ROWS)


def test_small_buffers_give_the_same_guarantees(spark):
    pieces = packing.pack(cases.documents(spark).coalesce(1), buffer_tokens=50).collect()
    check(pieces, cases.ROWS)


def test_many_short_documents_fill_windows(spark):
    rows = [(i, cases.prose(i, i % 90), "en", "a", None) for i in range(300)]
    pieces = packing.pack(cases.documents(spark, rows).coalesce(1)).collect()
    check(pieces, rows)
    sizes = {p.sequence_id: p.tier for p in pieces}
    assert sum(s < packing.TIERS[-1] for s in sizes.values()) <= 7  # the end of the one partition
    per_step = {}
    for p in pieces:
        per_step.setdefault((p.tier, p.step_group), set()).add(p.sequence_id)
    assert all(len(s) <= packing.STEP_TOKENS // tier for (tier, _), s in per_step.items())


def test_ids_can_be_kept(spark):
    row = packing.pack(cases.documents(spark, [(1, "a b c", "en", "a", 5)]), with_ids=True).collect()
    assert [i for p in sorted(row, key=lambda p: p.start) for i in p.ids] == ids_of("a b c")


def test_empty_table_and_wrong_tiers(spark):
    assert packing.pack(cases.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(cases.empty(spark), tiers=(100,))
