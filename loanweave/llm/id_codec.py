"""Token ids as files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank of frequency over the whole corpus, so common ids get small
numbers. A rank is written in one to four bytes; its length minus one goes as two bits into a
control byte shared by four ranks, apart from the data bytes. A reader finds all lengths of a
control byte, and so all places, by numpy table lookup, without looking at the data.

A file set is a folder with two Parquet tables: ``ranks`` (rank, id) and ``documents`` (doc_id,
start, n_tokens, control, data) in ascending doc_id order, one row per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.llm.common import for_tasks
from loanweave.llm.tokens import encoder, spans, vocabulary_path
from loanweave.storage import fresh_path

END_ID = 2
TEXTS_PER_CALL = 400
# Lengths of the four numbers of every control byte, lowest bits first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-len(numbers) % 4 + len(numbers), np.uint8)
    codes[: len(numbers)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), numbers.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: lengths from the table, places as their running sum."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    wide = np.zeros((count, 4), np.uint8)
    owner = np.repeat(np.arange(count), size)
    wide[owner, spans(np.zeros(count, np.int64), size)] = np.frombuffer(data, np.uint8)
    return wide.view("<u4").reshape(-1)


def write(documents: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the file set.

    A null or empty text is its end id alone. Rows with equal doc_id (or none: they come first)
    keep their own entries, in order of their text's hash. An empty table gives empty tables. Only
    doc_id and text are read.
    """
    path, spark = vocabulary or vocabulary_path(), documents.sparkSession
    stored, kind = f"{folder}-ids", _id_type(path, end_id)
    rows = for_tasks(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    # The order of the files: by range of doc_id, equal ids split by the hash of the text.
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.drop("tie").mapInArrow(_tokenizer(path, end_id, kind), _STORED).write.parquet(stored)
    ids = spark.read.schema(_STORED).parquet(stored)
    counts = ids.mapInArrow(_counter(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary at most.
    ranked = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    by_rank = np.array([r.id for r in ranked], np.int64)
    totals = ids.groupBy("part").agg(F.max("part_end").alias("n")).collect()  # one per partition
    before, running = {}, 0
    for part, n in sorted(totals):
        before[part], running = running, running + n
    ranks = spark.createDataFrame(
        pa.table({"rank": np.arange(len(by_rank)), "id": by_rank}).to_pandas(), "rank long, id long"
    )
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    coded = ids.mapInArrow(_ranker(by_rank, before, kind), f"part int, {_FILES}")
    # A scan deals files by size: the coded rows go back to the ranges they came from, in order.
    placed = coded.repartitionById(max(before, default=0) + 1, F.col("part")).sortWithinPartitions("start")
    placed.drop("part").write.parquet(f"{folder}/documents")


_STORED = "doc_id long, part int, start long, part_end long, ids binary"
_FILES = "doc_id long, start long, n_tokens long, control binary, data binary"


def _batch(columns: list, types: list, schema: str) -> pa.RecordBatch:
    names = [p.split()[0] for p in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _id_type(path: str, end_id: int) -> str:
    """The narrowest type for stored ids: two bytes if the vocabulary allows."""
    return "<u2" if max(encoder(path).library.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def _tokenizer(path: str, end_id: int, kind: str):
    """Ids of each document, and the running count of ids within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                rows = batch.slice(at, TEXTS_PER_CALL)
                ids, counts = encode(rows.column(1).to_pylist())
                ends = np.cumsum(counts)
                blobs = [np.append(ids[b:e], end_id).astype(kind).tobytes()
                         for b, e in zip(ends - counts, ends)]
                after = done + np.cumsum(counts + 1)
                yield _batch(
                    [rows.column(0), np.full(len(blobs), part, np.int32), after - counts - 1,
                     after, blobs],
                    [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], _STORED,
                )
                done = int(after[-1])

    return run


def _counter(kind: str):
    """How often each id occurs in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                found = np.bincount(np.frombuffer(blob, kind))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield _batch([used, total[used]], [pa.int64(), pa.int64()], "id long, n long")

    return run


def _ranker(by_rank: np.ndarray, before: dict[int, int], kind: str):
    """Coded documents, with the ids of all documents before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        for batch in batches:
            ids = [np.frombuffer(b, kind) for b in batch.column("ids").to_pylist()]
            coded = [encode_numbers(rank[x]) for x in ids]
            base = [before[p] for p in batch.column("part").to_pylist()]
            start = np.asarray(base, np.int64) + batch.column("start").to_numpy()
            yield _batch(
                [batch.column("part"), batch.column("doc_id"), start, [len(x) for x in ids],
                 [c for c, _ in coded], [d for _, d in coded]],
                [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()],
                f"part int, {_FILES}",
            )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set with their ids: doc_id, start, n_tokens, ids, and ids_crc32 of the
    ids as little-endian unsigned 32-bit integers."""
    by_rank = _rank_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _decoded(batch, by_rank)
            yield _batch(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), [_crc(x) for x in ids],
                 [x.tolist() for x in ids]],
                [pa.int64()] * 4 + [pa.list_(pa.int64())], schema,
            )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"
    return for_tasks(spark.read.schema(_FILES).parquet(f"{folder}/documents")).mapInArrow(run, schema)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, decoding all ids in the tasks but handing on their checksum only."""
    by_rank = _rank_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [_crc(x) for x in _decoded(batch, by_rank)]
            yield _batch(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), crc],
                [pa.int64()] * 4, schema,
            )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return for_tasks(spark.read.schema(_FILES).parquet(f"{folder}/documents")).mapInArrow(run, schema)


def _rank_table(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").collect()
    table = np.zeros(len(rows), np.uint32)
    for rank, id_ in rows:
        table[rank] = id_
    return table


def _decoded(batch: pa.RecordBatch, by_rank: np.ndarray) -> list[np.ndarray]:
    columns = (batch.column(c).to_pylist() for c in ("control", "data", "n_tokens"))
    return [by_rank[decode_numbers(c, d, n)] for c, d, n in zip(*columns)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the file set to the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(documents.sparkSession, "id-files")
    write(documents, folder, vocabulary)
    return checksums(documents.sparkSession, folder)
