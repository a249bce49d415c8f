"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded twice: by a byte-level vocabulary (side A, with a space put before it) and by a
piece vocabulary (side B, which puts that space itself). Every token covers a range of bytes. Two
``merge_asof`` joins per batch, keyed by document, find for each token start the token of the other
side that covers it; the later start of any two overlapping tokens lies in the earlier one, so the
union of both directions holds all overlaps. Offsets where tokens of both sides end together cut a
text into groups, and the two tokens that end there are a link.

How often each pair of ids is linked in the whole corpus comes from per-task dictionaries: links
are stored as places in a dictionary of at most ``CHUNK`` pairs, a new one being begun when it is
full; only dictionaries are grouped by pair, and their totals go back to the documents by chunk. So
neither a frequent pair nor a long document makes a large task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.llm.prefix_counts import pieces
from loanweave.llm.tokens import LETTERS, Encoder, vocabulary_path
from loanweave.storage import written

CHUNK = 1 << 16  # pairs in a dictionary: places fit two bytes
SLICE = 1 << 15  # links of a document stored as one row
BATCH_CHARS = 200_000
PIECE = 1 << 16
SPACE = "▁"  # fixed value: stands for a space in pieces
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
OVERLAPS = (
    "doc_id long, a_id long, b_id long, a_start long, b_start long, shared_bytes long, end_together boolean"
)


class Sides:
    """Both tokenizers, with the bytes and lengths of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.library.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.library.get_vocab()
        byte_of = {letter: byte for byte, letter in LETTERS.items()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(byte_of[ord(c)] for c in token if ord(c) in byte_of)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError("long texts are cut before spaces, which a piece of side B spans")
        self.b_bytes = [
            bytes([int(found[1], 16)]) if (found := _BYTE.fullmatch(name)) else name.replace(SPACE, " ").encode()
            for name in names
        ]
        self.a_size = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        # A token in a group's text: its id and what follows it; the last of a side ends the side.
        self.text = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"]
        self.text += [f"{i}{mark}" for i in range(len(names)) for mark in ",;"]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per text the ids of both sides, or none where their bytes are not those of the text."""
        # The letter and the space after it are a boundary of the pattern: its one id comes off.
        flat, counts = self.a.encode(["a " + t for t in texts])
        ends = np.cumsum(counts)
        found = []
        for text, begin, end, b in zip(texts, ends - counts, ends, self.b.encode(texts, num_threads=1)):
            a, whole = flat[begin + 1 : end].astype(np.int64), (" " + text).encode()
            same = (
                b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole
                and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            )
            found.append((a, np.array(b, np.int64)) if same else None)
        return found


@lru_cache(maxsize=1)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def overlaps(tools: Sides, units: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(A tokens, B tokens, all overlapping pairs) of a batch of texts. Tokens: unit, start, end,
    id, in order; starts are counted on from text to text. Pairs hold places ``a`` and ``b``."""

    def tokens(side: int, size: np.ndarray) -> pd.DataFrame:
        ids = np.concatenate([u[side] for u in units]) if units else np.zeros(0, np.int64)
        end = np.cumsum(size[ids])
        unit = np.repeat(np.arange(len(units)), [len(u[side]) for u in units])
        return pd.DataFrame({"unit": unit, "start": end - size[ids], "end": end, "id": ids})

    a, b = tokens(0, tools.a_size), tokens(1, tools.b_size)
    left = a[["unit", "start"]].assign(a=np.arange(len(a)))
    right = b[["unit", "start"]].assign(b=np.arange(len(b)))
    covered = [
        pd.merge_asof(left, right, on="start", by="unit")[["a", "b"]],
        pd.merge_asof(right, left, on="start", by="unit")[["a", "b"]],
    ]
    pairs = pd.concat(covered, ignore_index=True)
    both = pairs["a"].to_numpy() * max(len(b), 1) + pairs["b"].to_numpy()
    kept = ~pd.Series(both).duplicated()  # starts that meet are found by both directions
    return a, b, pairs[kept.to_numpy()]


class _Document:
    """What one document's batch pieces add up to."""

    def __init__(self) -> None:
        self.n_a = self.n_b = 0
        self.keys: list[np.ndarray] = []
        self.digest, self.open = hashlib.sha256(), False

    def add(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray, groups: str) -> None:
        self.n_a, self.n_b = self.n_a + len(a), self.n_b + len(b)
        self.keys.append(keys)
        self.digest.update((";" + groups if self.open else groups).encode())
        self.open = True


def _aligned(tools: Sides, units: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, str]]:
    """Per text of a batch its links (A id << 16 | B id, in order) and the text of its groups."""
    a, b, pairs = overlaps(tools, units)
    at_a, at_b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    end_a, end_b = a["end"].to_numpy(), b["end"].to_numpy()
    together = end_a[at_a] == end_b[at_b]
    at_a, at_b = at_a[together], at_b[together]
    order = np.argsort(at_a, kind="stable")
    at_a, at_b = at_a[order], at_b[order]
    id_a, id_b = a["id"].to_numpy(), b["id"].to_numpy()
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[at_a] = last_b[at_b] = 1
    keys = id_a[at_a] << 16 | id_b[at_b]
    # Each group's A tokens come before its B tokens.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    mixed = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    codes = np.concatenate([2 * id_a + last_a, 2 * (len(tools.a_bytes) + id_b) + last_b])[mixed]
    unit = np.concatenate([a["unit"].to_numpy(), b["unit"].to_numpy()])[mixed]
    cut = np.searchsorted(unit, np.arange(len(units) + 1))
    link_cut = np.searchsorted(a["unit"].to_numpy()[at_a], np.arange(len(units) + 1))
    for i in range(len(units)):
        groups = "".join(map(tools.text.__getitem__, codes[cut[i] : cut[i + 1]].tolist()))
        yield keys[link_cut[i] : link_cut[i + 1]], groups[:-1]


_LINKS = (
    "chunk long, row long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, "
    "places binary, a array<int>, b array<int>, n array<long>"
)


def _linker(a_path: str, b_path: str):
    """Rows of documents, whose links are places in their chunk's dictionary, and of dictionaries."""
    schema = arrow_schema(_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sides(a_path, b_path)
        base = TaskContext.get().partitionId() << 32
        chunk, row = base, base
        place: dict[int, int] = {}
        total = np.zeros(CHUNK, np.int64)

        def dictionary() -> list:
            keys = np.fromiter(place, np.int64, len(place))
            return [chunk, None, None, None, None, None, None, None,
                    (keys >> 16).tolist(), (keys & 0xFFFF).tolist(), total[: len(place)].tolist()]

        def documents(rows: list[tuple[int | None, str | None]]) -> Iterator[list]:
            nonlocal chunk, row, place
            for doc_id, found in _documents(tools, rows):
                keys = np.concatenate(found.keys) if found and found.keys else np.zeros(0, np.int64)
                facts = (
                    [found.n_a, found.n_b, len(keys), found.digest.hexdigest()] if found else [0, 0, 0, ""]
                )
                for at in range(0, max(len(keys), 1), SLICE):
                    codes, names = pd.factorize(keys[at : at + SLICE])
                    fresh = sum(k not in place for k in names.tolist())
                    if len(place) + fresh > CHUNK:
                        yield dictionary()
                        chunk, place = chunk + 1, {}
                        total[:] = 0
                    local = np.array([place.setdefault(k, len(place)) for k in names.tolist()], np.int64)
                    places = local[codes]
                    np.add.at(total, places, 1)
                    yield [chunk, row, doc_id, *facts, places.astype("<u2").tobytes(), None, None, None]
                    facts = [0, 0, 0, None]
                row += 1

        for batch in batches:
            out = list(documents(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))))
            if out:
                yield record_batch([list(c) for c in zip(*out)], schema)
        if place:
            yield record_batch([[x] for x in dictionary()], schema)

    return run


def _documents(tools: Sides, rows: list) -> Iterator[tuple[int | None, _Document | None]]:
    """Each row's alignment, texts being taken in batches of ``BATCH_CHARS``, long ones in pieces;
    nothing for a text that is null or empty or whose tokens do not give its bytes."""
    whole, size = [], 0
    for doc_id, text in rows:
        parts = [p.removeprefix(" ") if i else p for i, p in enumerate(pieces(text, PIECE))] if text else []
        whole.append((doc_id, parts))
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield from _batch(tools, whole)
            whole, size = [], 0
    yield from _batch(tools, whole)


def _batch(tools: Sides, whole: list) -> Iterator[tuple[int | None, _Document | None]]:
    encoded = tools.encode([p for _, parts in whole for p in parts])
    at, kept = 0, []
    for doc_id, parts in whole:
        units = encoded[at : at + len(parts)]
        at += len(parts)
        kept.append((doc_id, units if units and all(u is not None for u in units) else None))
    # A long document's pieces are aligned a few at a time.
    waiting: list = []
    found = [(doc_id, _Document() if units else None) for doc_id, units in kept]

    def align() -> None:
        for (document, (a, b)), (keys, groups) in zip(waiting, _aligned(tools, [u for _, u in waiting])):
            document.add(a, b, keys, groups)
        waiting.clear()

    size = 0
    for (_, document), (_, units) in zip(found, kept):
        for unit in units or ():
            waiting.append((document, unit))
            size += len(unit[0])
            if size >= BATCH_CHARS:
                align()
                size = 0
    if waiting:
        align()
    return iter(found)


def overlap_rows(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """All overlapping pairs of tokens: doc_id, the ids, both byte offsets in the text with its
    space, the bytes shared and whether the two end together. Rows as for ``alignment``."""
    paths, schema = _paths(a_path, b_path), arrow_schema(OVERLAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sides(*paths)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                parts = [p.removeprefix(" ") if i else p for i, p in enumerate(pieces(text, PIECE))] if text else []
                units = [tools.encode([p])[0] for p in parts]
                if not units or any(u is None for u in units):
                    continue
                for unit in units:
                    a, b, pairs = overlaps(tools, [unit])
                    x, y = a.iloc[pairs["a"]].reset_index(), b.iloc[pairs["b"]].reset_index()
                    shared = np.minimum(x["end"], y["end"]) - np.maximum(x["start"], y["start"])
                    yield record_batch(
                        [[doc_id] * len(x), x["id"], y["id"], x["start"] + start, y["start"] + start,
                         shared, x["end"] == y["end"]], schema,
                    )
                    start += int(a["end"].iloc[-1])

    return _rows(documents).mapInArrow(run, OVERLAPS)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path(), b_path or vocabulary_path("piece_bpe_32k.model")


def _rows(documents: DataFrame) -> DataFrame:
    return for_tasks(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def alignment(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is linked as often in the corpus as any of its B id, ties included), count_sum (of the
    corpus counts of all its links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    A text that is null or empty, or whose tokens do not give its bytes back, has no tokens: zeros
    and ''. Repeated rows count and are returned each; null ids are kept. Only doc_id and text are
    read; no rows give none.
    """
    stored = written(_rows(documents).mapInArrow(_linker(*_paths(a_path, b_path)), _LINKS), "alignment")
    pairs = stored.where("a is not null").select("chunk", F.posexplode(F.arrays_zip("a", "b", "n"))).select(
        "chunk", F.col("pos").alias("place"), "col.a", "col.b", "col.n"
    )
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # At most as many pairs per B id as side A has ids.
    highest = F.max("total").over(Window.partitionBy("b"))
    totals = totals.select("a", "b", "total", (F.col("total") == highest).alias("best"))
    words = pairs.join(totals, ["a", "b"]).select(
        "chunk", "place", "total", "best", *[F.lit(None).cast(t).alias(c) for c, t in _FACTS]
    )
    rows = stored.where("a is null").select(
        "chunk", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("total"),
        F.lit(None).cast("boolean").alias("best"), *[c for c, _ in _FACTS],
    )
    # A chunk's dictionary comes before its documents.
    placed = words.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.col("row").isNotNull())
    counted = placed.mapInArrow(_counted, _COUNTED)
    return counted.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b")],
        F.sum("n_links").alias("n_groups"), F.sum("n_links").alias("n_links"),
        *[F.sum(c).alias(c) for c in ("n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"),
    ).drop("row")


_FACTS = (
    ("row", "long"), ("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_links", "long"),
    ("groups_sha256", "string"), ("places", "binary"),
)
_COUNTED = (
    "row long, doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of documents over the totals of their chunk's dictionary."""
    schema, chunk = arrow_schema(_COUNTED), None
    total, best = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    for batch in batches:
        chunks, known = batch.column("chunk").to_numpy(), batch.column("row").is_null().to_numpy(False)
        for begin, end in _stretches(chunks, known):
            if chunks[begin] != chunk:
                chunk = chunks[begin]
                total[:], best[:] = 0, 0
            part = batch.slice(begin, end - begin)
            if known[begin]:
                place = part.column("place").to_numpy()
                total[place] = part.column("total").to_numpy()
                best[place] = part.column("best").to_numpy(False)
                continue
            places = [np.frombuffer(p, "<u2") for p in part.column("places").to_pylist()]
            columns = [part.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_links")]
            sums = [[int(t[p].sum()) for p in places] for t in (best, total)]
            yield record_batch([*columns, *sums, part.column("groups_sha256")], schema)


def _stretches(chunks: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of one chunk and kind."""
    turn = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(known.astype(np.int8)) != 0)) + 1
    cuts = [0, *turn.tolist(), len(chunks)]
    return [(b, e) for b, e in zip(cuts, cuts[1:]) if e > b]
