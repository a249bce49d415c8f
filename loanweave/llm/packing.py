"""Hierarchical multi-length packing of tokenized documents.

Every document becomes its ids plus one end id. What fills whole windows of the largest context
size is cut off first; the rest of each document goes to the smallest context tier that holds it.
Tiers are packed from the longest down: a window opens with the longest rest of its tier, its gap
is filled with the longest rests of shorter tiers that fit, and what is then still open by cutting
from the shortest rest left. So every window is exactly full; only what is left at the end of a
partition is cut into windows of smaller powers of two. Windows of one tier are dealt to step
groups of equal token counts, but for the last group of each tier in each partition; groups are not
balanced over tiers or partitions, and tiers share their numbers.

Packing is local to a partition: no shuffle, memory bounded by ``BUFFER_TOKENS`` and the longest
document, and a lost task is packed again from its own input. Feed it stored rows (a file scan),
so that a repeated task sees the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import for_tasks
from loanweave.llm.tokens import encoder, vocabulary_path

TIERS = (1024, 512, 256, 128)
END_ID = 0
STEP_TOKENS = 65_536
BUFFER_TOKENS = 2_000_000
TEXTS_PER_CALL = 400
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


class _Packer:
    """Packs the documents of one partition; holds at most one buffer of ids."""

    def __init__(self, unit: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool) -> None:
        self.unit, self.tiers, self.step_tokens, self.with_ids = unit, tiers, step_tokens, with_ids
        self.sequences, self.windows = 0, dict.fromkeys(tiers, 0)
        self.docs: list[tuple[object, np.ndarray]] = []
        self.rests: list[list[tuple[int, int]]] = [[] for _ in range(tiers[0])]
        self.lengths = 0  # bit n is set while a rest of n ids is left
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        number, top = len(self.docs), self.tiers[0]
        self.docs.append((doc_id, ids))
        whole = len(ids) // top * top
        for start in range(0, whole, top):
            self._emit([(number, start, top)], top)
        self._leave(number, whole, len(ids) - whole)

    def _leave(self, number: int, start: int, length: int) -> None:
        if length:
            self.rests[length].append((number, start))
            self.lengths |= 1 << length

    def _take(self, length: int) -> tuple[int, int]:
        number, start = self.rests[length].pop()
        if not self.rests[length]:
            self.lengths &= ~(1 << length)
        return number, start

    def _longest(self, most: int) -> int:
        """Length of the longest rest of at most ``most`` ids; 0 if there is none."""
        return max(0, (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def _fill(self, room: int) -> tuple[list[tuple[int, int, int]], int]:
        """Pieces for a window of ``room`` ids, and the room that is left if rests run out."""
        pieces = []
        while room and self.lengths:
            if length := self._longest(room):
                number, start = self._take(length)
            else:
                shortest = (self.lengths & -self.lengths).bit_length() - 1
                number, start = self._take(shortest)
                length = room
                self._leave(number, start + room, shortest - room)
            pieces.append((number, start, length))
            room -= length
        return pieces, room

    def pack(self, last: bool) -> None:
        """Pack the buffer; what fills no window stays for the next buffer, or, at the last one,
        is cut into smaller powers of two."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self._longest(tier) > below:
                pieces, room = self._fill(tier)
                if room:
                    for number, start, length in pieces:
                        self._leave(number, start, length)
                    break
                self._emit(pieces, tier)
        if last:
            total = sum(n * len(self.rests[n]) for n in range(len(self.rests)))
            while total:
                size = min(self.tiers[0], 1 << (total.bit_length() - 1))
                pieces, _ = self._fill(size)
                self._emit(pieces, size)
                total -= size
        else:
            self._keep_rests()

    def _keep_rests(self) -> None:
        """Forget the documents that are packed; cut the others down to nothing but their rest."""
        kept: dict[int, int] = {}
        docs = []
        for bucket in self.rests:
            for i, (number, start) in enumerate(bucket):
                if number not in kept:
                    kept[number] = len(docs)
                    docs.append(self.docs[number])
                bucket[i] = (kept[number], start)
        self.docs = docs

    def _emit(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        sequence = (self.unit << 32) + self.sequences
        self.sequences += 1
        done = self.windows.get(tier, 0)
        self.windows[tier] = done + 1
        step = (self.unit << 32) + done * tier // self.step_tokens
        offset = 0
        for number, start, length in pieces:
            doc_id, ids = self.docs[number]
            cut = ids[start : start + length]
            row = (
                doc_id, start, length, zlib.crc32(cut.astype("<u4").tobytes()), len(ids), sequence,
                offset, tier, step,
            )
            self.out.append((*row, cut.tolist()) if self.with_ids else row)
            offset += length

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.out:
            columns = list(zip(*self.out))
            self.out = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )


def pack(
    documents: DataFrame,
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Pieces of all documents in full windows: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (the window's size), step_group, and with ``with_ids`` the ids.

    A null or empty text is its end id alone. Repeated rows and repeated ids are packed each on
    their own. A null doc_id stays null. Columns other than doc_id and text are not read; an empty
    table gives no pieces. ``tiers`` are powers of two, largest first.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
        raise ValueError("tiers are powers of two, largest first")
    path = vocabulary or vocabulary_path()
    fields = [pa.field(p.split()[0], pa.int32() if p.split()[1] == "int" else pa.int64())
              for p in PIECES.split(", ")]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int64())))
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), tuple(tiers), step_tokens, with_ids)
        held, encode = 0, encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(at, TEXTS_PER_CALL)
                ids, counts = encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                for doc_id, begin, end in zip(part.column(0).to_pylist(), ends - counts, ends):
                    packer.add(doc_id, np.append(ids[begin:end], np.uint32(end_id)))
                held += int(ends[-1]) + len(ends)
                if held >= buffer_tokens:
                    packer.pack(last=False)
                    held = 0
                    yield from packer.rows(arrow)
        packer.pack(last=True)
        yield from packer.rows(arrow)
        encoder.cache_clear()  # an idle worker keeps no words

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return for_tasks(rows).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))
