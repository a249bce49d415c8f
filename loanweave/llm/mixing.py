"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target weight's share of the budget over its size.
A document's number of copies is a Poisson draw with that mean, got by inverting the distribution
at a hash of (seed, doc_id), so it depends on nothing but the document and its source's rate and is
the same in every run. Copies are exploded and put into a global order by the hash of each copy.
A mean above ``CHUNK`` is the sum of several independent draws of equal smaller means, so the
distribution table stays short whatever the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPERATURE = 0.5
SEED = "mix-1"
CHUNK = 8.0
TABLE = 64  # the chance of more than 64 at a mean of 8 is below 1e-30


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_rates(
    documents: DataFrame,
    source: str = "source",
    targets: dict | DataFrame | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
) -> DataFrame:
    """One row per source: size (characters plus one per document), weight, rate.

    ``targets`` gives weights per source (a dict, or a table of source and weight); a source that
    is not named gets none and so no copies. Without targets the weight is size ** temperature.
    ``epochs`` is the size of the mix over that of the corpus.
    """
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1)
    sizes = documents.groupBy(F.col(source).cast("string").alias("_source")).agg(size.alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        if isinstance(targets, dict):
            rows = [(k, float(v)) for k, v in targets.items()]
            targets = documents.sparkSession.createDataFrame(rows, "source string, weight double")
        wanted = targets.select(F.col("source").alias("_wanted"), F.col("weight").cast("double"))
        weighted = sizes.join(wanted, F.col("_source").eqNullSafe(F.col("_wanted")), "left").select(
            "_source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    totals = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not totals or not totals["weight"]:
        return weighted.withColumn("rate", F.lit(0.0))
    budget = F.lit(float(totals["size"])) * epochs
    return weighted.withColumn(
        "rate", F.col("weight") / F.lit(totals["weight"]) * budget / F.col("size")
    )


def _distribution(mean: Column) -> Column:
    """Chances of at most 0, 1, ... TABLE - 1 events."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def step(done: Column, k: Column) -> Column:
        term = done["term"] * mean / k
        return F.struct(
            term.alias("term"),
            F.concat(done["sums"], F.array(F.element_at(done["sums"], -1) + term)).alias("sums"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step)["sums"]


def mix(
    documents: DataFrame,
    source: str = "source",
    targets: dict | DataFrame | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """Copies of the documents in a global random order: all columns of the input, and copies (of
    the document), copy (from 1), shuffle_key, by which the rows are ordered.

    Columns of these names in the input are replaced. A null source is a source of its own. Null
    and empty texts count as one character of size. Rows of equal doc_id share their draw; a null
    doc_id draws like any other value. An empty table gives none.
    """
    rates = source_rates(documents, source, targets, temperature, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    table = rates.select(
        F.col("_source").alias("_lw_source"), parts.alias("_lw_parts"),
        _distribution(F.col("rate") / parts).alias("_lw_sums"),
    ).where(F.col("rate") > 0)
    kept = [c for c in documents.columns if c not in ("copies", "copy", "shuffle_key")]
    rows = documents.select(*kept).withColumn("_lw_tie", F.monotonically_increasing_id())
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_lw_parts")),
        F.lit(0),
        lambda total, part: total
        + F.size(F.filter("_lw_sums", lambda s: s <= uniform(F.lit(seed), F.col("doc_id"), part))),
    )
    # The rates are one row per source; Spark broadcasts them if their measured size allows.
    counted = rows.join(table, F.col(source).cast("string").eqNullSafe(F.col("_lw_source"))).withColumn(
        "copies", drawn
    )
    copies = counted.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "copy"))
    ordered = copies.withColumn("shuffle_key", key)
    return ordered.repartitionByRange("shuffle_key", "_lw_tie").sortWithinPartitions(
        "shuffle_key", "_lw_tie"
    ).select(*kept, "copies", "copy", "shuffle_key")


#: The query's rows in DuckDB: the same sizes, rates, distribution table and draws.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT source, SUM(COALESCE(LENGTH(text), 0) + 1) AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, POWER(CAST(size AS DOUBLE), {TEMPERATURE}) AS weight FROM sized
), rates AS (
  SELECT source, weight / SUM(weight) OVER () * CAST(SUM(size) OVER () AS DOUBLE) / size AS rate
  FROM weighted
), parted AS (
  SELECT source, rate, CAST(GREATEST(CEIL(rate / {CHUNK}), 1) AS INTEGER) AS parts FROM rates
), chances(source, parts, mean, k, term, total) AS (
  SELECT source, parts, rate / parts, 0, EXP(-(rate / parts)), EXP(-(rate / parts)) FROM parted
  UNION ALL
  SELECT source, parts, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1)
  FROM chances WHERE k < {TABLE - 1}
), drawn AS (
  SELECT d.doc_id, p.part, d.source,
    CAST(('0x' || SUBSTR(MD5('{SEED}:' || d.doc_id || ':' || p.part), 1, 13)) AS BIGINT)
      / 4503599627370496.0 AS u
  FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source,
    LATERAL (SELECT UNNEST(RANGE(1, r.parts + 1)) AS part) p
), counted AS (
  SELECT w.doc_id, CAST(COUNT(*) AS INTEGER) AS copies
  FROM drawn w JOIN chances c ON w.source IS NOT DISTINCT FROM c.source AND c.total <= w.u
  GROUP BY w.doc_id
)
SELECT d.doc_id, d.source, d.n_chars, d.text, c.copies, CAST(x.copy AS INTEGER) AS copy,
  MD5('{SEED}:order:' || d.doc_id || ':' || x.copy) AS shuffle_key
FROM documents d JOIN counted c USING (doc_id),
  LATERAL (SELECT UNNEST(RANGE(1, c.copies + 1)) AS copy) x
"""
