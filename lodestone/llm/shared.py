"""What the training-data operators have in common: lineage cuts and Arrow text helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a Python worker takes into its vectorised steps at once.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch: batches have no limit in bytes, and rows are whole texts.
BATCH_ROWS = 2500


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session without one gets a temporary folder; a cluster
    must name it, since its executors don't see the driver's disk."""
    sc = spark.sparkContext
    if (at := sc.getCheckpointDir()) is None:
        if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        sc.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; later steps survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, for what is read by columns; the folder's owner empties it."""
    at = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes; a longer single text is a run of its own."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < len(size):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _free() -> None:
    """Gives back what allocators keep although it is free."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow, with bounded memory: workers give free memory back now and then and after each partition (they stay
    on, idle, between tasks), and a session that has Spark's own default for rows of an Arrow batch gets BATCH_ROWS."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, batch in enumerate(run(batches)):
                yield batch
                if i % 16 == 15:
                    _free()
        finally:
            _free()

    return df.mapInArrow(whole, schema)


def strings(column: pa.Array) -> pa.Array:
    """Texts with large offsets and no nulls (null: empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in one array, and each text's number of them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.concatenate([[0], np.cumsum(per)])
    return ends[bounds[1:]] - ends[bounds[:-1]], flat.filter(full)


def widened(schema: StructType, **kinds) -> StructType:
    """The schema with further fields; a StructType's own add() would change the frame's."""
    return StructType([*schema.fields, *(StructField(k, v) for k, v in kinds.items())])
