"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: weight = count in the text times a smoothed,
bounded inverse document frequency, idf = 1 + SPAN * ln((1 + N) / (1 + df)) / ln(1 + N), between 1
and 2. It is bounded because copies make their own shingles frequent: an unbounded idf would weigh
the few edited words of a copy far above all that it shares.
Document frequencies come from all texts, in a count sketch of fixed size whose mean noise is
taken off, so common shingles are resolved to the same relative precision at any corpus size.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each set; two sets agree
on a sample with a chance equal to their weighted Jaccard similarity. Texts that agree on all rows
of a band share a bucket. In each bucket one pivot is first compared with all members. Buckets
whose members are then in more than one component are settled whole: their members meet in a task,
large buckets as pairs of blocks of bounded size, where all pairs in different components are
compared at once and only links that join components are handed on. Every link is verified by the
exact weighted Jaccard similarity of the whole texts, and no pair of a common bucket in different
classes is left uncompared, though pairs are never made as rows. Classes are the connected
components.

Equal texts are one node of the graph from the start. Nothing but the fixed-size sketch reaches
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.llm.shingles import mixed, shingles_of
from loanweave.storage import written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5  # a pair at similarity 0.8 shares a bucket with a chance of 0.998, at 0.9 1 - 3e-7
SPAN = 1.0
WIDTH, SEGMENT = 1 << 18, 1 << 13  # counters per sketch row, and counters per shuffled piece
DRAW_ROWS = 1 << 15
MEMBERS = 1024  # in a block of a bucket that is settled; a task holds two
COLUMNS = 2048  # elements compared at once
TEXTS_PER_CALL = 256
BLOCK = 2048  # shingles sampled at once, so that a very long text needs little memory


def node_of(text: Column) -> Column:
    """What stands for all rows of an equal text; null for a null text."""
    return F.unhex(F.md5(text))


def _tables(rows: int, samples: int, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Random numbers of the sampler per (row of a shingle's hash, sample): r, 1/r, beta and
    ln c - r + r * beta, with r and c from Gamma(2, 1) and beta uniform."""
    draw = np.random.default_rng(seed)
    r = draw.gamma(2.0, 1.0, (rows, samples)).astype(np.float32)
    c = draw.gamma(2.0, 1.0, (rows, samples)).astype(np.float32)
    beta = draw.random((rows, samples), np.float32)
    return r, 1 / r, beta, np.log(c) - r + r * beta


_cache: dict[tuple, tuple[np.ndarray, ...]] = {}


def _draws(samples: int) -> tuple[np.ndarray, ...]:
    key = (DRAW_ROWS, samples)
    if key not in _cache:
        _cache[key] = _tables(*key)
    return _cache[key]


def sample(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """One 64-bit consistent sample per draw of a weighted set (distinct hashes, in order)."""
    r, inverse, beta, offset = _draws(samples)
    least = np.full(samples, np.inf, np.float32)
    chosen, level = np.zeros(samples, np.int64), np.zeros(samples, np.int64)
    log_weight = np.log(weights).astype(np.float32)[:, None]
    for at in range(0, len(hashes), BLOCK):
        row = ((hashes[at : at + BLOCK] >> np.uint64(23)) % np.uint64(DRAW_ROWS)).astype(np.int64)
        t = np.floor(log_weight[at : at + BLOCK] * inverse[row] + beta[row])
        a = offset[row] - r[row] * t
        best = a.argmin(0)
        value = a[best, np.arange(samples)]
        better = value < least
        least = np.where(better, value, least)
        chosen = np.where(better, best + at, chosen)
        level = np.where(better, t[best, np.arange(samples)].astype(np.int64), level)
    return mixed(hashes[chosen] + mixed(level.astype(np.uint64)))


class Weights:
    """Document frequencies of shingles, and the weights they give."""

    def __init__(self, counts: np.ndarray, documents: int) -> None:
        noise = (counts.sum(1, keepdims=True) - counts) / (counts.shape[1] - 1)
        frequency = np.maximum(counts - noise, 1.0)
        scale = math.log(1 + max(documents, 1))
        rarity = (scale - np.log1p(np.minimum(frequency, max(documents, 1)))) / scale
        self.idf = (1 + SPAN * rarity).astype(np.float32)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The less frequent of two counters is the less disturbed one."""
        first, second = places(hashes)
        return counts * np.maximum(self.idf[0, first], self.idf[1, second]).astype(np.float64)

    def set_of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.unique(shingles, return_counts=True)
        return hashes, self.of(hashes, counts)


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(WIDTH - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(40) & mask).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets; 0 if both are empty."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def document_frequencies(documents: DataFrame) -> Weights:
    """Count, over all rows with words, in how many each shingle occurs. What comes to the driver
    are two rows of ``WIDTH`` counters, whatever the corpus."""
    piece, step = arrow_schema("segment int, counts binary"), "segment int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, WIDTH), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                sets = [np.unique(s) for s in shingles_of(batch.column(0).slice(at, TEXTS_PER_CALL).to_pylist(), WORDS)]
                seen += sum(len(s) > 0 for s in sets)
                for row, place in enumerate(places(np.concatenate(sets))):
                    total[row] += np.bincount(place, minlength=WIDTH)
        if seen:
            pieces = [p.astype("<i8").tobytes() for p in total.reshape(-1, SEGMENT)]
            yield record_batch([[-1, *range(len(pieces))], [np.int64(seen).tobytes(), *pieces]], piece)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(counts, "<i8")
                total[segment] = total[segment] + values if segment in total else values
        if total:
            yield record_batch([list(total), [v.tobytes() for v in total.values()]], piece)

    partial = for_tasks(documents).select("text").mapInArrow(count, step)
    segments = 2 * WIDTH // SEGMENT
    rows = partial.repartition(segments, "segment").mapInArrow(add, step).collect()
    counts, seen = np.zeros((2 * WIDTH // SEGMENT, SEGMENT), np.int64), 0
    for segment, values in rows:
        if segment < 0:
            seen = int(np.frombuffer(values, "<i8")[0])
        else:
            counts[segment] = np.frombuffer(values, "<i8")
    return Weights(counts.reshape(2, WIDTH).astype(np.float64), seen)


def _signatures(documents: DataFrame, shared, bands: int, rows: int) -> DataFrame:
    """doc_id, node and bucket keys (one per band; none without words) of every row."""
    schema = arrow_schema("doc_id long, node binary, buckets array<long>")
    salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(at, TEXTS_PER_CALL)
                keys = []
                for shingles in shingles_of(part.column(2).to_pylist(), WORDS):
                    if not len(shingles):
                        keys.append([])
                        continue
                    drawn = sample(*weights.set_of(shingles), bands * rows).reshape(bands, rows)
                    key = salts
                    for j in range(rows):
                        key = mixed(key * np.uint64(31) + drawn[:, j])
                    keys.append(key.view(np.int64))
                yield record_batch([part.column(0), part.column(1), keys], schema)
        _cache.clear()  # an idle worker keeps no tables

    whole = for_tasks(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text"
    )
    return whole.mapInArrow(run, "doc_id long, node binary, buckets array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """The pairs (a, b) with their similarity and whether it reaches ``least``."""
    schema = arrow_schema("a binary, b binary, similarity double, link boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, last, pivot = shared.value, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                a, b, text_a, text_b = (c.to_pylist() for c in batch.slice(at, TEXTS_PER_CALL).columns)
                found = []
                for i, shingles in enumerate(shingles_of(text_b, WORDS)):
                    if a[i] != last:  # rows of one pivot mostly come together
                        last, pivot = a[i], weights.set_of(shingles_of([text_a[i]], WORDS)[0])
                    found.append(similarity(pivot, weights.set_of(shingles)))
                yield record_batch([a, b, found, [s >= least for s in found]], schema)

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a binary, b binary, similarity double, link boolean"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges (a, b).

    Labels spread to neighbours and jump to their label's label until none changes; each step is
    one job, whose result is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    labels = both.groupBy("node").agg(F.min("other").alias("least")).select(
        "node", F.least("node", "least").alias("label")
    )
    changed = True
    while changed:
        near = both.join(labels, "node").groupBy(F.col("other").alias("node")).agg(
            F.min("label").alias("least")
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "least").alias("label")
        )
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = lower.join(jump, "label").select(
            "node", F.col("further").alias("label"), (F.col("further") != F.col("before")).alias("changed")
        )
        stored = written(step, "dedup-labels")
        labels, changed = stored.select("node", "label"), not stored.where("changed").isEmpty()
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links (a, b): components of components, which are few."""
    at = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = written(
        links.join(at, "a", "left").join(to, "b", "left").select(
            F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")
        ).where("a != b").distinct(),
        "dedup-between",
    )
    if between.isEmpty():
        return labels
    merged = components(between)
    known = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    known = known.select("node", F.coalesce("top", "label").alias("label"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return written(known.unionByName(fresh.select("node", "label")), "dedup-labels")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """In each bucket, its first member with all others; pairs (a, b) once."""
    pivots = members.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = members.withColumnRenamed("node", "b").join(pivots, "bucket").where("a != b")
    return pairs.select("a", "b").distinct()


def elements(weights: Weights, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's weighted set with its counts written out: the second occurrence of a shingle is an
    element of its own. The common weight of two such sets is that of the elements in both."""
    hashes, counts = np.unique(shingles, return_counts=True)
    idf = weights.of(hashes, np.ones(len(hashes)))
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(hashes, counts) + nth.astype(np.uint64)), np.repeat(idf, counts)


def linked(weights: Weights, texts: list[str], components_: list, least: float) -> list[tuple[int, int]]:
    """Links between members in different components, as many as join them and no more."""
    sets = [elements(weights, s) for s in shingles_of(texts, WORDS)]
    n, totals = len(sets), np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    names, column, shared = np.unique(
        np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True
    )
    value = np.zeros(len(names))
    value[column] = np.concatenate([w for _, w in sets])
    number = np.cumsum(shared > 1) - 1
    kept = shared[column] > 1
    owner, column, value = owner[kept], number[column[kept]], value[shared > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n))
    for at in range(0, len(value), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, len(value) - at)))
        part[owner[low:high], column[low:high] - at] = 1.0
        common += part @ (part * value[at : at + COLUMNS]).T
    alike = common >= least * (totals[:, None] + totals[None, :] - common)
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    first: dict[object, int] = {}
    for i, component in enumerate(components_):
        top[find(i)] = find(first.setdefault(component, i))
    out = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        x, y = find(i), find(j)
        if x != y:
            top[x] = y
            out.append((int(i), int(j)))
    return out


def _settled(unsettled: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """Links (a, b) that join components of a bucket: all its pairs in different components are
    compared. A bucket of more than ``MEMBERS`` members is split into blocks by hash, and every
    pair of blocks is compared by itself."""
    schema = arrow_schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def found():
            nodes, known, texts_ = zip(*rows)
            pairs = linked(shared.value, list(texts_), list(known), least) if len(set(known)) > 1 else []
            return record_batch([[nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs]], schema)

        for batch in batches:
            for bucket, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, x, y) != last:
                    if rows:
                        yield found()
                    last, rows = (bucket, x, y), []
                rows.append(row)
        if rows:
            yield found()

    sizes = unsettled.groupBy("bucket").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")),
    )
    placed = unsettled.join(sizes, "bucket").withColumn("own", own).select(
        "bucket", "node", "component", F.explode(pairs).alias("p")
    )
    rows = placed.join(texts, "node").select("bucket", "p.x", "p.y", "node", "component", "text")
    ordered = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")
    return ordered.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    documents: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``documents``: doc_id, node (of its text), class_id (the smallest doc_id
    of its class), keep (true for one row of each class, but for repeated rows of one doc_id and
    text, which all get the same).

    Texts are in one class if equal or linked, directly or in turn, by similarity >= ``least``. A
    null text is in no class but its own, as is a text without words unless equal to another.
    Null ids sort last; a class of null ids has a null class_id, and keeps its row. Only doc_id
    and text are read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(document_frequencies(documents))  # 2 * WIDTH floats
    signed = written(_signatures(documents, shared, bands, rows), "dedup-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("buckets").alias("buckets"))
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared_buckets = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(placed.join(shared_buckets, "bucket"), "dedup-members")
    wanted = members.select("node").distinct()
    texts = documents.select(node_of(F.col("text")).alias("node"), "text").join(wanted, "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "dedup-texts")

    pairs = written(_verified(_pivot_pairs(members), texts, shared, least), "dedup-pairs")
    labels = components(pairs.where("link").select("a", "b"))
    known = members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("component")
    )
    split = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    unsettled = known.join(split.where("x != y").select("bucket"), "bucket", "left_semi")
    unsettled = written(unsettled, "dedup-open")
    labels = _joined(labels, written(_settled(unsettled, texts, shared, least), "dedup-links"))
    shared.destroy()  # all that needs the weights is stored
    return _classes(signed.select("doc_id", "node"), labels)


def _classes(signed: DataFrame, labels: DataFrame) -> DataFrame:
    known = signed.join(labels, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("component")
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = known.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    joined = known.join(first, "component", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    alone = F.col("component").isNull()
    return joined.select(
        "doc_id", "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, True).otherwise(kept).alias("keep"),
    )


def deduplicated(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` that stay, one of each class, with all their columns: the one
    with the smallest doc_id. Of rows with that doc_id and an equal text one stays, any of them;
    rows with null texts all stay."""
    found = written(near_duplicates(documents, least), "dedup-classes")
    kept = found.where("keep and node is not null")
    counts = kept.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    kept_keys = written(counts, "dedup-kept")
    rows = documents.withColumn("_lw_node", node_of(F.col("text")))
    keys = kept_keys.select(F.col("doc_id").alias("_lw_doc"), F.col("node").alias("_lw_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_lw_doc")) & (F.col("_lw_node") == F.col("_lw_key"))
    stay = rows.where("text is not null").join(keys, same, "left_semi")
    if not kept_keys.where("n > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "_lw_node"])
    return stay.unionByName(rows.where("text is null")).drop("_lw_node")
