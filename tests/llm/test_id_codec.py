import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm import id_codec
from loanweave.llm.tokens import Encoder, vocabulary_path
from loanweave import storage
from loanweave.storage import fresh_path
from tests.llm import cases

LIBRARY = Encoder(vocabulary_path()).library


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_numbers_round_trip(numbers):
    control, data = id_codec.encode_numbers(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert id_codec.decode_numbers(control, data, len(numbers)).tolist() == numbers


def test_files_hold_all_ids_in_order(spark):
    folder = fresh_path(spark, "codec-test")
    id_codec.write(cases.with_clashes(cases.documents(spark)), folder)
    rows = id_codec.read(spark, folder).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    order = [r.doc_id for r in rows]
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(rows) == len(cases.ROWS)
    texts = {r[0]: r[1] for r in cases.ROWS}
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    counts = {}
    for r in rows:
        for i in r.ids:
            counts[i] = counts.get(i, 0) + 1
    assert [r.id for r in ranks] == sorted(counts, key=lambda i: (-counts[i], i))


def test_empty_table(spark):
    assert id_codec.round_trip(cases.empty(spark)).collect() == []


def test_files_in_name_order_have_ascending_ids(spark):
    """Ranges of very different sizes, which a scan would deal by size."""
    rows = [(i, cases.prose(i, 4 + 3000 * (i % 40 == 39)), "en", "a", None) for i in range(200)]
    folder = fresh_path(spark, "codec-order")
    with storage.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        id_codec.write(cases.documents(spark, rows), folder)
    files = sorted(Path(f"{folder}/documents".removeprefix("file:")).glob("part-*.parquet"))
    tables = [pq.read_table(f, columns=["doc_id", "start", "n_tokens"]).to_pylist() for f in files]
    found = [r for t in tables for r in t]
    assert [r["doc_id"] for r in found] == list(range(200)) and sum(map(bool, tables)) > 1
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])
