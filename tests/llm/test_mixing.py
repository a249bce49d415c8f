import hashlib
import math

import pytest

from loanweave.llm import mixing
from tests.llm import cases


def poisson(doc_id, rate):
    """The number of copies by the definition."""
    parts = max(1, math.ceil(rate / mixing.CHUNK))
    total = 0
    for part in range(1, parts + 1):
        key = f"{mixing.SEED}:{'~' if doc_id is None else doc_id}:{part}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2.0**52
        mean = rate / parts
        term = done = math.exp(-mean)
        k = 0
        while done <= u and k < mixing.TABLE - 1:
            k += 1
            term *= mean / k
            done += term
        total += k if done > u else k + 1
    return total


def test_equals_brute_force(spark):
    rows = [(i, cases.prose(i, 5 + i % 7), "en", f"s{i % 3}" if i % 11 else None, None) for i in range(300)]
    frame = cases.documents(spark, rows)
    rates = {r["_source"]: r["rate"] for r in mixing.source_rates(frame, epochs=5.0).collect()}
    assert max(rates.values()) > mixing.CHUNK  # the sum of several draws is exercised
    found = mixing.mix(frame, epochs=5.0).collect()
    expected = {r[0]: poisson(r[0], rates[r[3]]) for r in rows}
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.copy)
        assert r.copies == expected[r.doc_id]
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(1, n + 1)) for k, n in expected.items() if n}


def test_rows_come_in_hash_order_and_shares_near_targets(spark):
    rows = [(i, cases.prose(i, 10), "en", "big" if i % 4 else "small", None) for i in range(2000)]
    found = mixing.mix(cases.documents(spark, rows), targets={"big": 1.0, "small": 3.0}, epochs=2.0).collect()
    keys = [r.shuffle_key for r in found]
    assert keys == sorted(keys)
    share = sum(r.source == "small" for r in found) / len(found)
    assert abs(share - 0.75) < 0.03


def test_unnamed_sources_get_nothing(spark):
    found = mixing.mix(cases.documents(spark), targets={"a": 1.0}).collect()
    assert {r.source for r in found} == {"a"}


@pytest.mark.parametrize("wide", [False, True])
def test_odd_rows(spark, wide):
    frame = cases.documents(spark)
    found = mixing.mix(cases.with_clashes(frame) if wide else frame, epochs=4.0)
    expected = {c for c in (cases.with_clashes(frame) if wide else frame).columns}
    assert set(found.columns) == expected | {"copies", "copy", "shuffle_key"}
    rows = found.collect()
    assert len(rows) == sum(1 for r in rows if 1 <= int(r["copy"]) <= int(r["copies"])) and rows
    assert mixing.mix(cases.empty(spark)).collect() == []
