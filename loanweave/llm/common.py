"""What several operators share."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_PER_BATCH = 512  # whole texts are long rows: batches of the default size could be gigabytes
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def for_tasks(df: DataFrame) -> DataFrame:
    """``df``, whose session's Python workers can now import this package even if it is not
    installed but only on the driver's path (a checkout on a folder that all machines see), and
    get at most ``ROWS_PER_BATCH`` rows at once."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCHES)) <= ROWS_PER_BATCH:
        conf.set(BATCHES, str(ROWS_PER_BATCH))
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    return df


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a plain ``name type, ...`` schema."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(),
    }
    pairs = [part.split() for part in ddl.split(", ")]
    return pa.schema([
        (name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind])
        for name, kind in pairs
    ])


def record_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch from plain columns, typed by ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
