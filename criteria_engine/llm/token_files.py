"""Token ids in files: frequency ranks in byte-aligned variable-length code.

Documents are tokenized once, into shards that hold plain ids; their counts rename the
ids by falling frequency, so that common ones take one byte, and each shard is rewritten. A rank takes 1 to 4 little-endian bytes;
its length less one stands in two bits of a separate control byte that serves four ranks.

A folder holds `vocabulary.u32`, the ids by rank, and one `shard-*.ids` for each
partition of a range partitioning by doc_id, documents ascending. A shard is a list of
blocks: five little-endian unsigned 64-bit numbers (documents, ids, control bytes, data
bytes, MAGIC), then doc ids (signed 64 bits), a byte each that is 0 for a null doc id,
token counts (unsigned 64 bits), control bytes, data bytes.

Files are written under a name of their own and renamed, so a repeated task replaces its
shard by the same one. The folder must be one that pyarrow can open (local or shared
paths, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from criteria_engine.llm.tables import slices, stored
from criteria_engine.llm.token_ids import encoder, with_end

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = 0x31736469
HEAD = np.dtype("<u8")
# Lengths of the four ranks that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8), data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    place = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[place].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[place[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _write_block(out, doc_id: pa.Array, ids: np.ndarray, tokens: np.ndarray) -> None:
    control, data = encode_ranks(ids)
    known = np.asarray(doc_id.is_valid())
    head = np.array([len(doc_id), len(ids), len(control), len(data), MAGIC], HEAD)
    parts = [np.asarray(doc_id.fill_null(0), dtype="<i8"), known.astype(np.uint8), tokens.astype("<u8"), control, data]
    for part in (head, *parts):
        out.write(part.tobytes())


def _blocks(source, name: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Doc ids, ids as they stand in the file, and tokens of each document."""
    while head := source.read(5 * HEAD.itemsize):
        n_docs, n_ids, n_control, n_data, magic = map(int, np.frombuffer(head, HEAD))
        if magic != MAGIC:
            raise ValueError(f"{name} is damaged")
        doc_id = np.frombuffer(source.read(8 * n_docs), "<i8")
        known = np.frombuffer(source.read(n_docs), np.uint8)
        tokens = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)
        control = np.frombuffer(source.read(n_control), np.uint8)
        data = np.frombuffer(source.read(n_data), np.uint8)
        yield pa.array(doc_id, mask=known == 0), decode_ranks(control, data, n_ids), tokens


def _raw_shards(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Write shards that hold ids as the tokenizer gives them.

    Returns a row per shard (shard, name, n) and, with name null, rows per shard and id
    (token_id, n).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, shard = encoder(path, lead=False), 0, TaskContext.get().partitionId()
        total = np.zeros(0, np.int64)
        files, base = fs.FileSystem.from_uri(folder)
        name, own = f"shard-{shard:06d}", f"{base}/{uuid4().hex}.tmp"
        with files.open_output_stream(own) as out:
            for batch in slices(batches, "text"):
                ids, offsets = with_end(*encode(batch.column("text")), end_id)
                _write_block(out, batch.column("doc_id"), ids, np.diff(offsets))
                n += len(ids)
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    seen, total = total, seen
                total[: len(seen)] += seen
        files.move(own, f"{base}/{name}.raw")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(used) + 1, shard)), pa.array([name] + [None] * len(used), pa.string()),
                pa.array(np.append(-1, used)), pa.array(np.append(n, total[used])),
            ],
            ["shard", "name", "token_id", "n"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(write, "shard long, name string, token_id long, n long")


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Write all documents; returns (shard file, ids in it) in the order of the shards.

    Null texts are empty and have the end id only. Rows with a null doc_id come first.
    Rows that share a doc_id are all written, ordered by a hash of their text. Columns
    other than doc_id and text are ignored. An empty table gives no document.
    """
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    written = stored(_raw_shards(docs, folder, path, end_id), folder)
    counted = written.where("name is null").groupBy("token_id").agg(F.sum("n").alias("n"))
    counted = counted.collect()  # bounded by the vocabulary
    by_rank = np.array([r[0] for r in sorted(counted, key=lambda r: (-r[1], r[0]))], "<u4")
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    with store.open_output_stream(f"{root}/vocabulary.u32") as out:
        out.write(by_rank.tobytes())

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                raw, final, own = f"{base}/{name}.raw", f"{base}/{name}.ids", f"{base}/{uuid4().hex}.tmp"
                # a repeated task may find its work done
                if files.get_file_info(final).type == fs.FileType.NotFound:
                    with files.open_input_stream(raw) as source, files.open_output_stream(own) as out:
                        for doc_id, ids, tokens in _blocks(source, name):
                            _write_block(out, doc_id, rank[ids], tokens)
                    files.move(own, final)
                if files.get_file_info(raw).type != fs.FileType.NotFound:
                    files.delete_file(raw)
            yield batch

    shards = sorted(written.where("name is not null").select("shard", "name", "n").collect())  # one row a shard
    if shards:
        names = spark.createDataFrame(shards, "shard long, name string, n long")
        names.repartition(len(shards), "shard").mapInArrow(rename, names.schema).count()
    return [(f"{s.name}.ids", s.n) for s in shards]


def read_shard(folder: str, name: str, start: int) -> Iterator[pa.RecordBatch]:
    """Documents of one shard, block after block, as ROWS."""
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/vocabulary.u32") as source:
        by_rank = np.frombuffer(source.read(), "<u4")
    with files.open_input_stream(f"{base}/{name}") as source:
        for doc_id, ranks, tokens in _blocks(source, name):
            ends = np.cumsum(tokens)
            places = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
            ids = pa.Array.from_buffers(
                pa.binary(), len(doc_id), [None, places, pa.py_buffer(by_rank[ranks].tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(start + ends - tokens), pa.array(tokens), ids],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            start += len(ranks)


def read_ids(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document."""
    ends = np.cumsum([0, *(n for _, n in shards)])
    listed = [(name, int(start)) for (name, _), start in zip(shards, ends)]
    listed = spark.createDataFrame(listed, "name string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_shard(folder, row["name"], row["start"])

    return listed.repartition(max(1, len(shards)), "name").mapInArrow(read, ROWS)
