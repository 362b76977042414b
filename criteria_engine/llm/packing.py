"""Packing by powers of two: documents are cut into pieces of binary lengths.

A document of n tokens becomes n // 1024 pieces of 1024 tokens and one piece for each bit
of the rest, longest first. Every piece is a sequence of its own, so no sequence crosses
documents and none is padded; sequences of equal length share a bucket, and batches are
drawn from one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import slices
from criteria_engine.llm.token_ids import encoder, with_end

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
LONGEST = 1024
PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def binary_pieces(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of all documents in order, and how many each document has."""
    top = longest.bit_length() - 1
    sizes = longest >> np.arange(top + 1)
    times = (tokens[:, None] % longest & sizes) > 0
    times = np.where(sizes == longest, (tokens // longest)[:, None], times)
    return np.repeat(np.tile(sizes, len(tokens)), times.ravel()), times.sum(1)


def pack(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, longest: int = LONGEST
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    `ids` holds little-endian unsigned 32-bit token ids; `bucket` is the binary logarithm
    of the length; `offset` is 0, as a piece fills its sequence. Null and empty texts have
    the end id only. A null doc_id stays null, repeated rows are packed each on their own,
    columns other than doc_id and text are ignored. `longest` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, lead=True)
        for batch in slices(batches, "text"):
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            tokens = np.diff(offsets)
            lengths, per_doc = binary_pieces(tokens, longest)
            ends = np.cumsum(lengths)
            row = np.repeat(np.arange(len(tokens)), per_doc)
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            places = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(ends - lengths - offsets[row]),
                    pa.array(lengths),
                    pa.array(tokens[row]),
                    pa.array(np.log2(lengths).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(lengths), [None, places, data]),
                ],
                ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(cut, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of files for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
