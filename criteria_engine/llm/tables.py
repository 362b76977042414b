"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from criteria_engine.session import ship_package
from criteria_engine.storage import shared_folder

# Rows that travel to a Python worker at once, beside Spark's bound on their number.
BATCH_BYTES = 6 << 20
# Text that a Python worker unpacks at once; one longer text makes a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package; bound the Arrow batches by bytes too, unless the session does."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(BATCH_BYTES))
    return ship_package(spark)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return shared_folder(spark)


def stored(frame: DataFrame, folder: str) -> DataFrame:
    """Written to a folder below `folder` and read back, which cuts the lineage."""
    path = f"{folder}/{uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def slices(batches: Iterator[pa.RecordBatch], columns: str | list[str], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `size` bytes of `columns` together."""
    columns = [columns] if isinstance(columns, str) else columns
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0) for c in columns]
        part = np.cumsum(sum(n.to_numpy(zero_copy_only=False).astype(np.int64) for n in lengths)) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words start.

    Returns the words as one dictionary array and row offsets (one more than rows);
    null texts have no words.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
    if not full.all():
        flat = flat.filter(pa.array(full))
    return flat.dictionary_encode(), offsets


def codes(flat: pa.DictionaryArray) -> np.ndarray:
    return flat.indices.to_numpy(zero_copy_only=False)


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run: [2, 3] gives 0 1 0 1 2."""
    counts = np.asarray(counts, np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over.

    It does so when the driver's JVM finds that their plans are garbage, which may be
    late, and in the background.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
