"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to a Python worker: with texts of a few kB, a few MB.
ROWS_PER_BATCH = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none and runs on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            found = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder, and a lost executor does not lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As settle(), in Parquet, which is smaller for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of so many bytes of text, or of a single row: what a task holds does not follow the batch's size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def learnable(text: Column, key: Column, most: int) -> Column:
    """What a model learns of a text: all of it, or of a longer one so many characters from a place that the key's hash draws."""
    n = F.length(text)
    start = F.pmod(F.xxhash64(key, F.lit(most)), n - most + 1).cast("int") + 1
    return F.when(n > most, F.substring(text, start, F.lit(most))).otherwise(text)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and leaves every other letter alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = "_"
    while any(c.lower().startswith(taken) for c in df.columns):
        taken += "_"
    return [taken + name for name in names]
