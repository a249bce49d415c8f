"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree: at each level every child draws -ln(u) / weight from a hash u of (key,
child), and the smallest draw wins. A child's weight is the sum of its shards', so shards get rows
in proportion to weight, and a row leaves its subtree only if weights at that level change: other
subtrees keep theirs. A shard that is added as a new region can only win rows, never move them
between others.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 16
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Leaf:
    """A shard's place in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int = SHARDS, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """Equal shards over ``regions`` x ``racks``."""
    per_rack = math.ceil(shards / (regions * racks))
    return [Leaf(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: rows move into it only."""
    region = max((leaf.region for leaf in tree), default=-1) + 1
    shard = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(region, 0, shard, weight)]


def _uniform(key: Column, label: str) -> Column:
    """In (0, 1], from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", key, F.lit(label)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)


def _choice(key: Column, options: list[tuple[float, str, Column]]) -> Column:
    """What the option with the smallest weighted draw leads to; the first on a tie."""
    if len(options) == 1:
        return options[0][2]
    draws = [
        F.struct((-F.log(_uniform(key, label)) / weight).alias("d"), F.lit(i).alias("i"))
        for i, (weight, label, _) in enumerate(options)
    ]
    picked = F.least(*draws)["i"]
    out = F.when(picked == 0, options[0][2])
    for i, option in enumerate(options[1:], 1):
        out = out.when(picked == i, option[2])
    return out


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard that a key's draws lead to; a null key has its own draws. Leaves of weight zero
    or less take nothing."""
    text = F.coalesce(key.cast("string"), F.lit("~"))
    racks: dict[int, dict[int, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in tree:
        if leaf.weight > 0:
            racks[leaf.region][leaf.rack].append(leaf)
    if not racks:
        raise ValueError("the tree has no shard of positive weight")
    regions = []
    for region, inside in sorted(racks.items()):
        options = []
        for rack, leaves in sorted(inside.items()):
            shards = [(x.weight, f"s{x.shard}", F.lit(x.shard)) for x in leaves]
            total = sum(x.weight for x in leaves)
            options.append((total, f"r{region}/{rack}", _choice(text, shards)))
        total = sum(o[0] for o in options)
        regions.append((total, f"g{region}", _choice(text, options)))
    return _choice(text, regions).cast("int")


def assign(documents: DataFrame, tree: Sequence[Leaf] | None = None) -> DataFrame:
    """Every document's place: doc_id, size (UTF-8 bytes plus one; 1 for a null text), text_crc32
    (null: of no bytes), law, shard, slot (gapless from 0 in each shard), grown_shard (with one
    more shard).

    The law is ``key``: doc_id and the tree decide. Rows of equal doc_id, a null one included,
    share a shard and take slots in order of their text's checksum. No other columns are read. An
    empty table gives no rows.
    """
    tree = list(tree or layout())
    text = F.coalesce("text", F.lit(""))
    placed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )
    return _with_slots(placed)


def _with_slots(placed: DataFrame) -> DataFrame:
    """Slots by (bucket, doc_id, checksum) in each shard: rows are numbered within a bucket, and
    the buckets before it are counted, so that no task holds a shard."""
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")
    rows = placed.withColumn("bucket", bucket)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # One row per shard and bucket, whatever the table's size.
    before = F.sum("n").over(
        Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(
        Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    )
    return (
        rows.withColumn("place", inside - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard",
                (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )
