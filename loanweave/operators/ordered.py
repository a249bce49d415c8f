"""Ordered computations that stay distributed when one key, or everything, is huge.

A window without a partition key, or over one very large key, runs in a single task. The
functions here range-partition the rows instead, number the ranges, and add each range's
starting offset to a window that never crosses a range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loanweave.storage import written

# Rows of one key that a plain per-key window may take. Longer histories use blocks.
MAX_HISTORY = 50_000
BLOCK_ROWS = 4_096
# Column of a stored table that marks the rows of such longer histories.
LONG = "_long_history"


def ranges(df: DataFrame) -> int:
    """Number of ranges to split into: the session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    within: Sequence[str] = (),
    label: str = "ordered",
) -> DataFrame:
    """Add inclusive running totals in ``order``, over all rows or ``within`` each group.

    Equal order keys are summed one after the other in an unspecified order. The ranges are
    written once, since range bounds come from a sample and must not change between the pass
    that totals them and the pass that uses the totals.
    """
    within = list(within)
    keys = [F.col(c) for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    staged = {f"__v{i}": value for i, value in enumerate(sums.values())}
    base = df.withColumns({**staged, "__tie": F.monotonically_increasing_id()})
    placed = written(
        base.repartitionByRange(ranges(df), *keys, F.col("__tie")).withColumn(
            "__range", F.spark_partition_id()
        ),
        label,
    )
    # One row per range and group: its total, then the total of all ranges before it.
    totals = placed.groupBy("__range", *within).agg(
        *[F.sum(v).alias(f"{v}_t") for v in staged]
    )
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        "__range",
        *within,
        *[F.coalesce(F.sum(f"{v}_t").over(before), F.lit(0)).alias(f"{v}_s") for v in staged],
    )
    inside = (
        Window.partitionBy("__range", *within)
        .orderBy(*keys[len(within):], F.col("__tie"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = placed.withColumns({f"{v}_r": F.sum(v).over(inside) for v in staged})
    matched = [F.col("p.__range") == F.col("s.__range")] + [
        F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in within
    ]
    joined = local.alias("p").join(starts.alias("s"), matched, "inner")
    return joined.select(
        *[F.col(f"p.{c}") for c in df.columns],
        *[
            (F.col(f"p.__v{i}_r") + F.col(f"s.__v{i}_s")).alias(name)
            for i, name in enumerate(sums)
        ],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles, one ``q0, q1, ...`` row per group.

    Rows are reduced to counts per distinct value before anything is ordered, so repeated values
    cost nothing; the distinct values are then counted up range by range.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    upto = running_sums(counts, ["__x"], {"__upto": F.col("__n")}, within=by, label="quantiles")
    size = (
        upto.groupBy(*by).agg(F.max("__upto").alias("__size"))
        if by
        else upto.agg(F.max("__upto").alias("__size"))
    )
    if by:
        same = [F.col(f"u.{c}").eqNullSafe(F.col(f"z.{c}")) for c in by]
        sized = upto.alias("u").join(size.alias("z"), same, "inner").select(
            *[F.col(f"u.{c}") for c in by], "__x", "__n", "__upto", "__size"
        )
    else:
        sized = upto.withColumn("__size", size.scalar())

    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__size") - 1)
        low, high = F.floor(at), F.ceil(at)
        start = F.col("__upto") - F.col("__n")
        lower = F.max(F.when((start <= low) & (low < F.col("__upto")), F.col("__x")))
        upper = F.max(F.when((start <= high) & (high < F.col("__upto")), F.col("__x")))
        weight = F.max(at - low)
        picks.append((lower + (upper - lower) * weight).alias(f"q{i}"))
    return sized.groupBy(*by).agg(*picks) if by else sized.agg(*picks)


def longest_history(df: DataFrame, key: str) -> int:
    """Rows of the largest key (partially aggregated, so a huge key costs no more to count)."""
    row = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def narrowed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df``, and the mark of long histories if the table carries it."""
    return df.select(*columns, *[c for c in df.columns if c == LONG])


def _tie(df: DataFrame, *keys: str) -> list[Column]:
    """What orders rows of equal keys: a hash of all other columns, so that only equal rows tie."""
    others = [
        f.name
        for f in df.schema.fields
        if f.name not in (*keys, LONG)
        and not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    ]
    return [F.xxhash64(*others)] if others else []


def over_history(
    df: DataFrame,
    key: str,
    order: str,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    history: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows back and ``ahead`` rows ahead per key.

    ``build`` receives the ordered window and returns the columns; equal values of ``order`` are
    ordered by the other columns of ``df``. ``history`` is the row count of the largest key,
    measured when not given. Keys of up to ``MAX_HISTORY`` rows use one ordinary window per key
    (one shuffle, none on a table bucketed by ``key``). Only longer ones are cut into blocks which
    carry copies of their neighbours' edge rows, so a key holding any share of the table is spread
    over many tasks; the results are the same. A boolean column ``LONG`` says which rows belong to
    such keys; where ``df`` has none, the keys are counted. It is not returned.
    """
    columns = [c for c in df.columns if c != LONG]
    if history is None:
        history = longest_history(df, key)
    in_order = [F.col(order), *_tie(df, key, order)]
    plain = Window.partitionBy(key).orderBy(*in_order)
    if history <= MAX_HISTORY:
        return df.select(*columns).withColumns(build(plain))
    if LONG in df.columns:
        short, long = df.where(~F.col(LONG)), df.where(F.col(LONG))
    else:
        counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        keys = written(counted.where(F.col("n") > MAX_HISTORY).select(F.col(key).alias("__key")), "keys")
        same = F.col(key).eqNullSafe(F.col("__key"))
        short, long = df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")
    block = max(BLOCK_ROWS, back, ahead)
    ranked = running_sums(
        long.select(*columns), in_order, {"__pos": F.lit(1)}, within=[key], label="history"
    )
    place = F.col("__pos") - 1
    home = F.floor(place / block)
    within_block = place % block
    homes = F.array_compact(
        F.array(
            home,
            F.when((within_block < ahead) & (home > 0), home - 1),
            F.when(within_block >= block - back, home + 1),
        )
    )
    spread = ranked.withColumn("__home", home).withColumn("__block", F.explode(homes))
    built = spread.withColumns(build(Window.partitionBy(key, "__block").orderBy("__pos")))
    return short.select(*columns).withColumns(build(plain)).unionByName(
        built.where(F.col("__block") == F.col("__home")).drop("__pos", "__home", "__block")
    )
