"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own; a
    cluster has to name one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackline-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor does not repeat the work before it, and several later
    readers do not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trackline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text, so that working arrays stay small.

    Rows are never cut: one row longer than the limit is a run of its own. After each batch free memory goes back to the
    system, as a worker that keeps it stands beside the executor's own heap.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
        run = (np.cumsum(lengths) - 1).clip(0) // max_bytes
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)
        release()


def release() -> None:
    """Give free memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
