"""Where intermediate results live.

Lineage is cut by writing a table to the folder named by ``spark.checkpoint.dir`` (shared by
all executors on a cluster) and reading it back, so the loss of an executor costs nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

# The JVM never compiles a method above 8000 bytes of code to machine code, and large ones late. A
# projection of many derived columns fuses into such a method; above this limit it is split.
WIDE_PROJECTIONS = {"spark.sql.codegen.hugeMethodLimit": "2000"}
# A task keeps this many files open before it sorts its rows by file.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "32"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the duration of one eager write."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates; a temporary one only in local mode with none set."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="loanweave-")
    spark.conf.set(SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/loanweave/{app}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
