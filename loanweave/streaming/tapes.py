"""Incremental ingestion: new tape files go to Bronze once each, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanweave.sources.tape import TAPES, read_tapes, with_source, write_bronze


def ingest_stream(
    spark: SparkSession, raw: str, bronze: str, checkpoint: str, files_per_batch: int = 1_000
) -> StreamingQuery:
    """Process the tape files not yet seen by this checkpoint, then stop.

    The file source remembers each path in the checkpoint, so a restart or a second run reads
    only what is new. Rows go to the folders that batch ingestion writes, so both can feed one
    Bronze; a repeated batch replaces its own sources. Here a source is one file: one in parts,
    which may come in several batches, is refused. Content copies under other names are the
    checksum log's business; the log lacks streamed tapes until the next batch run adds them.
    """
    text = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", TAPES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(raw)
    )
    lines = with_source(text, part=True).withColumn(
        "_ingested_at", F.current_timestamp().cast("string")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        if not batch.where(F.col("_source_part").startswith("part-")).isEmpty():
            raise ValueError("sources in parts cannot be streamed; ingest them as a batch")
        for kind in ("origination", "performance"):
            write_bronze(
                read_tapes(batch, kind, keep=("_ingested_at",)), bronze, kind, replace_sources=True
            )

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
