"""Exact removal of repeated passages, found by anchors at difference-cover positions.

Two equal windows of 50 words, wherever they stand in their documents, have a common
shift below PERIOD that brings both starts to positions whose remainder modulo PERIOD is
in COVER. So hashing the ANCHOR words from each such position on finds every match; the
windows round anchors that more than one document has are then extended to their 50
words and compared by hashes of 96 bits. Both comparisons reduce each hash to its
smallest and largest document before the shuffle, and hot hashes are split in the joins,
so a passage that a third of all documents share makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import release, scratch, slices, spans, stored, words
from criteria_engine.llm.windows import BASES, Runs, word_hashes

WINDOW = 50
# Every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
KEY = ["doc_id", "text_hash"]


def _anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of the anchors of texts that have a window at all."""
    hashed, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    counts = np.where(counts < WINDOW, 0, counts)
    row, place = np.repeat(np.arange(len(counts)), counts), spans(counts)
    kept = np.isin(place % PERIOD, COVER) & (place + ANCHOR <= counts[row])
    row, place = row[kept], place[kept]
    return row, place, Runs(hashed).at(offsets[row] + place, ANCHOR).view(np.int64)


def _anchor_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, _, hashed = _anchors(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashed), batch.column("doc_id").take(pa.array(row))], ["anchor", "doc_id"]
        )


def _anchor_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, place, hashed = _anchors(batch.column("text"))
        keys = [batch.column(c).take(pa.array(row)) for c in KEY]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashed), *keys, pa.array(place.astype(np.int32))], ["anchor", *KEY, "place"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows that hold an anchor of `places`."""
    for batch in slices(batches, "text"):
        hashed, offsets = word_hashes(batch.column("text"))
        counts = np.diff(offsets)
        lists = batch.column("places")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        anchor = lists.flatten().to_numpy(zero_copy_only=False)
        low, high = np.maximum(anchor - (PERIOD - 1), 0), np.minimum(anchor, counts[row] - WINDOW)
        fits = high >= low
        steps = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(steps, (offsets[row] + low)[fits], 1)
        np.add.at(steps, (offsets[row] + high + 1)[fits], -1)
        start = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
        row = np.searchsorted(offsets, start, side="right") - 1
        first, second = (Runs(hashed, base).at(start, WINDOW) for base in BASES)
        keys = [batch.column(c).take(pa.array(row)) for c in KEY]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                *keys, pa.array((start - offsets[row]).astype(np.int32)),
            ],
            ["first", "second", *KEY, "place"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the words of the windows that start at `places`."""
    for batch in slices(batches, "text"):
        flat, offsets = words(batch.column("text"))
        lists = batch.column("places")
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        start = offsets[row] + lists.flatten().to_numpy(zero_copy_only=False)
        steps = np.zeros(len(flat) + WINDOW + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + WINDOW, -1)
        gone = np.cumsum(steps)[: len(flat)] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(lost[offsets])
        kept = flat.filter(pa.array(~gone)).dictionary_decode()
        places = pa.array((offsets - lost[offsets]).astype(np.int32))
        text = pc.binary_join(pa.ListArray.from_arrays(places, kept), " ")
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        # a removed run that goes on into the next text is one run of each
        edges = np.sort(np.concatenate([edges, np.repeat(offsets[1:-1][_inside(gone, offsets[1:-1])], 2)]))
        begin, end = edges[::2], edges[1::2]
        begin, end = begin[end > begin], end[end > begin]
        of = np.searchsorted(offsets, begin, side="right") - 1
        runs = pa.StructArray.from_arrays(
            [pa.array((begin - offsets[of]).astype(np.int32)), pa.array((end - offsets[of]).astype(np.int32))],
            ["start", "end"],
        )
        ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), text,
                pa.ListArray.from_arrays(pa.array(ends), runs),
            ],
            ["doc_id", "n_words", "n_removed", "text", "removed"],
        )


def _inside(gone: np.ndarray, borders: np.ndarray) -> np.ndarray:
    if not len(gone):
        return np.zeros(len(borders), bool)
    left, right = np.maximum(borders - 1, 0), np.minimum(borders, len(gone) - 1)
    return (borders > 0) & (borders < len(gone)) & gone[left] & gone[right]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, one blank between), removed (runs of words).

    A word goes if a window of 50 words that covers it also starts in a document with a
    smaller doc_id. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null texts have none.
    Rows with a null doc_id neither lose words nor make others lose any. Rows that share
    a doc_id are each judged against smaller ids only. Columns other than doc_id and text
    are ignored. Intermediate tables go to the shared folder.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    used = rows.where("doc_id is not null and text is not null")
    between = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]

    seen = used.select("doc_id", "text").mapInArrow(_anchor_docs, "anchor long, doc_id long")
    shared = stored(seen.groupBy("anchor").agg(*between).where("low < high").select("anchor"), folder)
    places = used.mapInArrow(_anchor_places, "anchor long, doc_id long, text_hash long, place int")
    places = places.join(shared, "anchor", "left_semi").groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    places = stored(places, folder)
    release(spark)

    # a repeated row has the same windows each time
    involved = stored(used.join(places, KEY), folder)
    release(spark)
    windows = involved.mapInArrow(_windows, "first long, second int, doc_id long, text_hash long, place int")
    repeated = windows.groupBy("first", "second").agg(*between).where("low < high")
    repeated = stored(repeated.select("first", "second", "low"), folder)
    release(spark)

    later = windows.join(repeated, ["first", "second"]).where("doc_id > low")
    later = stored(later.groupBy(*KEY).agg(F.collect_set("place").alias("places")), folder)
    release(spark)
    return rows.join(later, KEY, "left").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, text string, removed array<struct<start: int, end: int>>"
    )
