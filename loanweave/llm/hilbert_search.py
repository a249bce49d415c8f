"""Nearest neighbours by largest inner product over shifted Hilbert curves.

Vectors are lifted to one sphere (a further coordinate makes all norms equal, which turns largest
inner product into nearest point), projected by several random rotations to a few coordinates,
shifted, and put in order along a Hilbert curve for each. Spark range-partitions every ordering
into blocks. A query goes to its own block and a window of neighbouring blocks on every curve; in
each, its best candidates by exact inner product are kept, and all are merged per query.

The window is not a constant: it is the smallest that holds ``recall`` of the exact neighbours of
a bounded sample of queries, so data without structure gets wide windows (the search is then close
to comparing all) and clustered data narrow ones. Every vector is indexed on every curve. Of equal
vectors only the k + 1 smallest ids can be an answer, so no more are kept as candidates: a hot
vector fills no window. No block is larger than its range of the ordering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.llm.hilbert import positions
from loanweave.storage import written

NEAREST = 20
CURVES, AXES, BITS = 8, 6, 10
RECALL = 0.955  # of the sample's neighbours that the window has to hold
SAMPLE = 256  # queries of the sample that the window is fitted on
BLOCKS, LARGEST_BLOCK = 48, 4096  # blocks per curve at least; vectors in a block at most


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: no null, non-finite or missing components, not zero.
    Of rows with one id the one with the smallest vector stands; a null id takes no part."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(~bad & F.exists("v", lambda x: x != 0))
        .groupBy("id").agg(F.min("v").alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _curve_keys(points: DataFrame, radius: float, size: int, curves: int) -> DataFrame:
    """(curve, key, id, query, v) of every point on every curve. Candidates are lifted to the
    sphere of ``radius``, queries stretched to it."""
    schema = arrow_schema("curve int, key long, id long, query boolean, v array<double>")
    spread = radius / np.sqrt(size + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = []
        for curve in range(curves):
            draw = np.random.default_rng([size, curve])
            rotation, _ = np.linalg.qr(draw.normal(size=(size + 1, size + 1)))
            axes = min(AXES, size + 1)
            frames.append((rotation[:, :axes], draw.uniform(-0.05, 0.05, axes)))
        for batch in batches:
            if not batch.num_rows:
                continue
            v, query = _matrix(batch.column(1)), np.array(batch.column(2).to_pylist(), bool)
            square = (v * v).sum(1)
            last = np.sqrt(np.maximum(0.0, radius * radius - square))
            lifted = np.column_stack([v, last])
            lifted[query, :-1] *= (radius / np.sqrt(square[query]))[:, None]
            lifted[query, -1] = 0.0
            for curve, (rotation, shift) in enumerate(frames):
                cells = (lifted @ rotation / (8 * spread) + 0.5 + shift) * (1 << BITS)
                cells = np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)
                yield record_batch(
                    [np.full(len(v), curve, np.int32), positions(cells, BITS), batch.column(0),
                     batch.column(2), batch.column(1)], schema,
                )

    return for_tasks(points).mapInArrow(
        keys, "curve int, key long, id long, query boolean, v array<double>"
    )


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge)))
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with one fixed order of summing, so that equal vectors tie exactly."""
    return (v * q).sum(1)


def _answers(query: int, q: np.ndarray, ids: np.ndarray, v: np.ndarray, rough: np.ndarray, k: int):
    """The k best of a block for one query, rough scores replaced by exact ones."""
    keep = ids != query
    ids, v, rough = (ids, v, rough) if keep.all() else (ids[keep], v[keep], rough[keep])
    if len(ids) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
        ids, v = ids[near], v[near]
    scores = _exact(v, q)
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Per query and block: the best ids and scores. Rows come by block, candidates first."""
    schema = arrow_schema("query_id long, ids array<long>, scores array<double>")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, v = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            target, query = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), bool)
            number, vectors = batch.column(2).to_numpy(), _matrix(batch.column(3))
            cuts = np.flatnonzero((np.diff(target) != 0) | (np.diff(query) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(target)]):
                if target[begin] != block:
                    block, ids, parts, v = target[begin], [], [], None
                if not query[begin]:
                    ids.append(number[begin:end])
                    parts.append(vectors[begin:end])
                    continue
                if not parts:
                    continue
                if v is None:
                    v, all_ids = np.concatenate(parts), np.concatenate(ids)
                rough = vectors[begin:end] @ v.T
                found = [_answers(number[begin + i], vectors[begin + i], all_ids, v, rough[i], k)
                         for i in range(end - begin)]
                yield record_batch([number[begin:end], [f[0] for f in found], [f[1] for f in found]], schema)

    return rows.mapInArrow(search, "query_id long, ids array<long>, scores array<double>")


def _merged(parts: DataFrame, k: int, partitions: int) -> DataFrame:
    """The k best of each query over all its blocks."""
    schema = arrow_schema("query_id long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, {}

        def done():
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            return record_batch([[last], [[i for i, _ in ranked]], [[s for _, s in ranked]]], schema)

        for batch in batches:
            for query, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if query != last:
                    if last is not None:
                        yield done()
                    last, best = query, {}
                best.update(zip(ids, scores))
                if len(best) > 50 * k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
        if last is not None:
            yield done()

    placed = parts.repartition(partitions, "query_id").sortWithinPartitions("query_id")
    return placed.mapInArrow(merge, "query_id long, ids array<long>, scores array<double>")


def _exact_neighbours(vectors: DataFrame, sample: list, k: int) -> DataFrame:
    """The true nearest of a bounded sample of queries, compared with all vectors."""
    schema = arrow_schema("query_id long, ids array<long>, scores array<double>")
    numbers = np.array([r["id"] for r in sample], np.int64)
    queries = np.array([r["v"] for r in sample], float)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            rough = queries @ v.T
            found = [_answers(n, queries[i], ids, v, rough[i], k) for i, n in enumerate(numbers)]
            yield record_batch([numbers, [f[0] for f in found], [f[1] for f in found]], schema)

    parts = for_tasks(vectors).select("id", "v").mapInArrow(
        compare, "query_id long, ids array<long>, scores array<double>"
    )
    return _merged(parts, k, 8)


def _window(placed: DataFrame, vectors: DataFrame, queries: DataFrame, blocks: int, k: int, recall: float,
            sample: int) -> int:
    """Blocks on either side that hold ``recall`` of the sample's true neighbours. Collects at most
    ``sample`` queries, their neighbours and the places of both."""
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    truth = {r["query_id"]: r["ids"] for r in _exact_neighbours(vectors, picked, k).collect()}
    ids = sorted({i for found in truth.values() for i in found} | set(truth))
    spark = placed.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "id long") if ids else None
    if wanted is None:
        return 0
    places: dict[tuple[bool, int], dict[int, int]] = {}
    rows = placed.join(F.broadcast(wanted), "id")  # sample * (k + 1) ids at most
    for r in rows.select("id", "query", "curve", "block").collect():
        places.setdefault((r["query"], r["id"]), {})[r["curve"]] = r["block"]
    far = [
        min(abs(places[True, q][c] - b) for c, b in places[False, i].items())
        for q, found in truth.items() for i in found
    ]
    return int(np.quantile(far, recall, method="higher")) if far else 0


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    curves: int = CURVES,
    recall: float = RECALL,
    sample: int = SAMPLE,
    largest_block: int = LARGEST_BLOCK,
) -> DataFrame:
    """Each query's k nearest found, of every vector but its own: query_id, rank (from 1), vec_id,
    score (the inner product in double precision); nearest first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have id and v, as ``usable`` gives them. Vectors of another length
    than a query's are no candidates for it. A query without candidates has no rows; empty tables
    give none.
    """
    spark = vectors.sparkSession
    vectors, queries = written(vectors, "ann-vectors"), written(queries, "ann-queries")
    sizes = vectors.groupBy(F.size("v").alias("size")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)).alias("square")
    ).collect()  # one row per length of vector
    results = []
    for size, n, square in sizes:
        here, asked = vectors.where(F.size("v") == size), queries.where(F.size("v") == size)
        results.append(_one_length(here, asked, size, n, square**0.5, k, curves, recall, sample, largest_block))
    schema = "query_id long, rank int, vec_id long, score double"
    if not results:
        return spark.createDataFrame([], schema)
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found.select(
        "query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "a")
    ).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("a.ids").alias("vec_id"),
             F.col("a.scores").alias("score"))


def _one_length(vectors, queries, size, n, radius, k, curves, recall, sample, largest_block) -> DataFrame:
    order = Window.partitionBy("h", "v").orderBy("id")
    candidates = (
        vectors.withColumn("h", F.xxhash64("v")).withColumn("copy", F.row_number().over(order))
        .where(F.col("copy") <= k + 1).select("id", "v")
    )
    points = candidates.withColumn("query", F.lit(False)).unionByName(
        queries.select("id", "v").withColumn("query", F.lit(True))
    )
    blocks = curves * max(-(-n // largest_block), min(BLOCKS, -(-n // (4 * k))))
    keyed = written(_curve_keys(points, radius, size, curves), "ann-keys")
    placed = written(
        keyed.repartitionByRange(blocks, "curve", "key", "query", "id").withColumn("block", F.spark_partition_id()),
        "ann-blocks",
    )
    last = placed.agg(F.max("block")).first()[0] or 0
    everything = n <= 16 * k
    window = last if everything else _window(placed, candidates, queries, blocks, k, recall, sample)
    reach = F.sequence(
        F.greatest(F.col("block") - window, F.lit(0)), F.least(F.col("block") + window, F.lit(last))
    )
    rows = placed.where("not query").select(F.col("block").alias("target"), "query", "id", "v").unionByName(
        placed.where("query").select(F.explode(reach).alias("target"), "query", "id", "v")
    )
    ordered = rows.repartition(last + 1, "target").sortWithinPartitions("target", "query")
    return _merged(_searched(ordered, k), k, max(8, blocks // 4))
