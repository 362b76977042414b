"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact verification.

A document is a bag of five-word shingles with counts. Each shingle owns independent
Poisson processes on the weight intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on, each at a rate of
its interval's width for every signature slot; a point carries a slot and the unit cell
of its interval, so a shingle of count w uses the points whose cell is at most w. A slot's
value is its earliest point, and two documents agree in a slot with the probability of
their weighted Jaccard similarity. Points come in order of time, so a process stops once
it has passed the latest slot. Bands of slots give candidates, whose bags are compared exactly.

In each bucket every member is compared with one head. Where that leaves a bucket with
members of more than one component, members outside the head's component are compared
with all others of the bucket, in cells of bounded size; a cell compares the bags that
share one of their rarest shingles, without which they cannot be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.components import components
from criteria_engine.llm.tables import release, scratch, slices, spans, stored
from criteria_engine.llm.token_ids import take_runs
from criteria_engine.llm.windows import Runs, mixed, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_SLOTS = 32, 4
SLOTS = BANDS * BAND_SLOTS
# Buckets choose their heads by this many different orders of the documents.
ORDERS = 4
# Text whose bags a worker holds at once, of both sides of pairs together; they take some fifty times as much.
BAG_BYTES = 1 << 20
CELL_BYTES = 1 << 20  # of text on each side of a cell
ODD = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of every distinct shingle; shorter texts are one shingle."""
    hashed, offsets = word_hashes(texts)
    n = np.diff(offsets)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(n)), counts)
    runs = Runs(hashed)
    shingle = runs.at(offsets[row] + spans(counts), SHINGLE)
    for length in range(1, SHINGLE):
        short = np.flatnonzero(n == length)
        row = np.concatenate([row, short])
        shingle = np.concatenate([shingle, runs.at(offsets[short], length) + np.uint64(length)])
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return row[first], shingle[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The earliest point of each slot of each of n bags (infinite for an empty bag)."""
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    at = np.repeat(np.arange(len(row)), levels)
    level = spans(levels)
    doc, weight = row[at], count[at]
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    state = mixed(shingle[at] ^ mixed((level.astype(np.uint64) + np.uint64(1)) * ODD))
    time = np.zeros(len(doc))
    best = np.full(n * slots, np.inf)
    latest = np.full(n, np.inf)
    while len(doc):
        state = mixed(state + ODD)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / (slots * width)
        early = time <= latest[doc]
        doc, weight, low, width, state, time = (x[early] for x in (doc, weight, low, width, state, time))
        other = mixed(state ^ ODD)
        slot = (other % np.uint64(slots)).astype(np.int64)
        cell = low + 1 + ((other >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        fits = cell <= weight
        np.minimum.at(best, doc[fits] * slots + slot[fits], time[fits])
        changed = np.unique(doc)
        latest[changed] = best.reshape(n, slots)[changed].max(1)
    return best.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, BAND_SLOTS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD), bits.shape[:2]).copy()
    for k in range(BAND_SLOTS):
        key = mixed(key * np.uint64(31) + mixed(bits[..., k]))
    return key.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of the texts that have a word."""
    for batch in slices(batches, "text", BAG_BYTES):
        bag = bags(batch.column("text"))
        full = np.unique(bag[0])
        row = np.searchsorted(full, bag[0])
        keys = band_keys(signatures(row, *bag[1:], len(full)))
        ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
        rows = batch.select(["doc_id", "first_hash", "second_hash", "size"]).take(pa.array(full))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
            ["doc_id", "first_hash", "second_hash", "size", "keys"],
        )


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of each pair of texts."""
    n = len(left)
    sides = [bags(left), bags(right)]
    sizes = [np.bincount(row, count, n) for row, _, count in sides]
    row, shingle, count = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((shingle, row))
    row, shingle, count = row[order], shingle[order], count[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1]))
    common = np.bincount(row[same], np.minimum(count[same], count[same + 1]), n)
    return common / np.maximum(sizes[0] + sizes[1] - common, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ["text_a", "text_b"], BAG_BYTES):
        same = similarities(batch.column("text_a"), batch.column("text_b")) >= SIMILAR
        yield batch.select(["a", "b"]).filter(pa.array(same))


def _prefixes(row: np.ndarray, code: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingles of the rarest part of each bag that similar bags cannot both lack.

    Only shingles that several bags have are returned.
    """
    have = np.bincount(code)
    order = np.lexsort((code, have[code], row))
    row, code, count = row[order], code[order], count[order]
    total = np.cumsum(count) - count
    first = np.searchsorted(row, row)
    spare = size[row] - np.ceil(SIMILAR * size[row] - 1e-9)
    kept = (total - total[first] <= spare) & (have[code] > 1)
    return row[kept], code[kept]


def _linked_in_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """One link from each asking row to each other component that it has a similar document in."""
    row, shingle, count = bags(pa.array(cell["text"], pa.string()))
    _, code = np.unique(shingle, return_inverse=True)
    size = np.bincount(row, count, len(cell))
    label, doc, asks = (cell[c].to_numpy() for c in ("label", "doc_id", "asks"))
    starts = np.searchsorted(row, np.arange(len(cell) + 1))
    own_row, own_code = _prefixes(row, code, count, size)
    by_code = np.argsort(own_code, kind="stable")
    low, high = (np.searchsorted(own_code[by_code], own_code, side=s) for s in ("left", "right"))
    bounds = np.searchsorted(own_row, np.arange(len(cell) + 1))
    have = np.zeros(code.max(initial=0) + 1, np.int64)
    a, b = [], []
    for i in np.flatnonzero(asks & (np.diff(bounds) > 0)):
        mine = slice(bounds[i], bounds[i + 1])
        met = np.unique(own_row[take_runs(by_code, low[mine], high[mine] - low[mine])])
        met = met[label[met] != label[i]]
        if not len(met):
            continue
        own = slice(starts[i], starts[i + 1])
        have[code[own]] = count[own]
        lengths = starts[met + 1] - starts[met]
        at = take_runs(np.arange(len(row)), starts[met], lengths)
        part = np.minimum(have[code[at]], count[at])
        common = np.bincount(np.repeat(np.arange(len(met)), lengths), part, len(met))
        have[code[own]] = 0
        near = met[common >= SIMILAR * (size[i] + size[met] - common)]
        near = near[np.unique(label[near], return_index=True)[1]]
        a += [doc[i]] * len(near)
        b += doc[near].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _pairs_of_heads(placed: DataFrame) -> DataFrame:
    pairs = placed.where("doc_id <> head")
    return pairs.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct()


def _links_in_mixed_buckets(placed: DataFrame, labels: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Links between different components of a bucket that its head does not show.

    placed: key, doc_id, size, and the bucket's head and number of members n.
    """
    own = labels.select(F.col("node").alias("doc_id"), "label")
    other = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    wide = placed.where("n > 2").join(own, "doc_id", "left").join(other, "head", "left")
    label, head_label = F.coalesce("label", "doc_id"), F.coalesce("head_label", "head")
    asks = (label != head_label).alias("asks")
    wide = stored(wide.select("key", "doc_id", "size", label.alias("label"), asks), folder)
    mixed_up = wide.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("bucket_size"),
        F.sum(F.when(F.col("asks"), F.col("size"))).alias("asking"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members"),
    )
    # buckets of the same members are looked at once
    one = F.min(F.struct("key", "asking")).alias("one")
    mixed_up = mixed_up.where("low < high").groupBy("members", "bucket_size").agg(one)
    mixed_up = stored(mixed_up.select("one.*", "bucket_size"), folder)
    rows = wide.join(mixed_up, "key")
    parts = F.ceil(F.col("bucket_size") / CELL_BYTES).cast("int")
    blocks = F.ceil(F.col("asking") / CELL_BYTES).cast("int")
    rows = rows.select(
        "key", "doc_id", "label", "asks", parts.alias("parts"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), parts).cast("int").alias("own_part"),
        F.pmod(F.xxhash64("doc_id", F.lit(2)), blocks).cast("int").alias("own_block"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["key", "doc_id", "label"]
    asked = rows.select(*keep, F.lit(False).alias("asks"), F.col("own_part").alias("part"), every("blocks").alias("block"))
    asks = rows.where("asks").select(*keep, "asks", every("parts").alias("part"), F.col("own_block").alias("block"))
    cells = asks.union(asked).join(texts, "doc_id")
    return cells.groupBy("key", "part", "block").applyInPandas(lambda cell: _linked_in_cell(cell), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the documents that similarity joins to this one.

    Documents are joined if their bags of five-word shingles (words `[^\\x20\\x09-\\x0D]+`,
    unchanged) have a weighted Jaccard similarity of 0.8 or more, or their texts are equal.
    Texts of one to four words are one shingle. Null, empty and blank texts are each a
    class of their own. Null doc_ids have a null class and join nothing. Rows that share
    a doc_id count as one document, whose links are those of all its texts. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = {"first_hash": F.xxhash64("text"), "second_hash": F.xxhash64(F.lit("second"), "text")}
    rows = rows.withColumns(hashes)
    used = rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    same = ["first_hash", "second_hash"]
    copies = used.groupBy(*same).agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last"))
    copies = stored(copies.where("original < last").drop("last"), folder)
    sized = used.withColumn("size", F.octet_length("text") + 1)
    banded = sized.mapInArrow(_banded, "doc_id long, first_hash long, second_hash long, size int, keys array<long>")
    banded = banded.join(copies, same, "left").where("original is null or original = doc_id")
    banded = stored(banded.select("doc_id", "size", "keys").dropDuplicates(["doc_id", "keys"]), folder)

    members = banded.select("doc_id", "size", F.posexplode("keys").alias("band", "key"))
    order = F.xxhash64("doc_id", F.col("band") % ORDERS)
    buckets = members.groupBy("key").agg(F.min(F.struct(order.alias("order"), "doc_id")).alias("head"), F.count("*").alias("n"))
    buckets = stored(buckets.where("n > 1").select("key", F.col("head.doc_id").alias("head"), "n"), folder)
    placed = stored(members.drop("band").join(buckets, "key"), folder)
    pairs = stored(_pairs_of_heads(placed), folder)
    release(spark)

    texts = used.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long").distinct(), folder)
    release(spark)
    labels = components(links, folder)
    more = stored(_links_in_mixed_buckets(placed, labels, texts, folder), folder)
    same_text = used.join(copies, same).where("doc_id > original")
    same_text = same_text.select(F.col("original").alias("a"), F.col("doc_id").alias("b"))
    found = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    links = stored(found.unionByName(more).unionByName(same_text), folder)
    release(spark)
    labels = components(links, folder)
    found = rows.select("doc_id").join(labels, rows["doc_id"] == labels["node"], "left")
    return found.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))
