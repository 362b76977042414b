"""Line deduplication by pairwise alignment.

A passage is a line of MIN_CHARS characters or more, or a run of shorter lines that reaches
MIN_CHARS with its last line. Each document is paired with the earliest document that has
one of its passages, for every passage that it shares, however many documents have it. A
pair's lines are aligned by patience diff; aligned common blocks of MIN_CHARS characters
or more go from the later document. A document has as many pairs as it has shared passages
at most, a passage in n documents makes at most n pairs, and pairs carry hashes of lines,
no texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import release, scratch, slices, stored

MIN_CHARS = 20
KEY = ["doc_id", "text_hash"]
ROWS_AT_ONCE = 256
# A common subsequence's table that is held as a whole: 4 MB. Of larger ones some rows are made twice.
TABLE_BITS = 1 << 25
BASE = 0x9E3779B97F4A7C15
Line = tuple[int, int]  # hash and length


def patience(a: list[Line], b: list[Line]) -> list[tuple[int, int]]:
    """Matched places in a and b, ascending.

    Equal lines at both ends match; of the rest, lines that both sides have exactly once
    match along the longest ascending chain (of several the one whose lines stand earliest in a,
    from the last one on), and the gaps between are aligned likewise. A gap without such lines is
    aligned by a longest common subsequence of the lines that both sides have.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once: dict[Line, int] = {}
        for x in range(i, i_end):
            once[a[x]] = -1 if a[x] in once else x
        places: dict[Line, int] = {}
        for y in range(j, j_end):
            if once.get(b[y], -1) >= 0:
                places[b[y]] = -1 if b[y] in places else y
        chain = _ascending([(once[line], y) for line, y in places.items() if y >= 0])
        if not chain:
            both = set(a[i:i_end]) & set(b[j:j_end])
            xs, ys = ([k for k in range(*r) if side[k] in both] for side, r in ((a, (i, i_end)), (b, (j, j_end))))
            out += [(xs[k], ys[m]) for k, m in longest_common([a[k] for k in xs], [b[m] for m in ys])]
            continue
        x, y = i, j
        for place in [*chain, (i_end, j_end)]:
            todo.append((x, place[0], y, place[1]))
            x, y = place[0] + 1, place[1] + 1
        out += chain
    return sorted(out)


def _lengths(a: list[Line], b: list[Line], row: int) -> Iterator[int]:
    """After each line of a, bits of b: up to each place, unset ones count the common subsequence.

    `row` holds the bits before a's first line.
    """
    at: dict[Line, list[int]] = {}
    for y, line in enumerate(b):
        at.setdefault(line, []).append(y)
    # kept for repeated lines only: a row of bits for each line would be too much
    bits = {line: sum(1 << y for y in places) for line, places in at.items() if len(places) > 16}
    full = (1 << len(b)) - 1
    for line in a:
        same = row & (bits[line] if line in bits else sum(1 << y for y in at.get(line, ())))
        row = (row + same | row - same) & full
        yield row


def longest_common(a: list[Line], b: list[Line]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, ascending.

    Of several it is the one that is found from the ends on: equal last lines match, else b's
    last line goes if nothing is lost by it, else a's. Bits of a table row stand for b
    (Hyyrö). A large table is not held: of n rows every isqrt(n)-th is kept and the rows behind
    it are made again when the way back comes to them, which changes nothing in the result.
    """
    step = len(a) if len(a) * len(b) <= TABLE_BITS else isqrt(len(a))
    row = (1 << len(b)) - 1
    kept = [row]
    for x, row in enumerate(_lengths(a, b, row), 1):
        if x % step == 0:
            kept.append(row)
    out, x, y = [], len(a), len(b)
    while x and y:
        first = (x - 1) // step
        start = first * step
        rows = [kept[first], *_lengths(a[start:x], b, kept[first])]
        while x > start and y:
            if a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
                out.append((x, y))
            elif rows[x - start] >> (y - 1) & 1:
                y -= 1  # the last line of b adds nothing
            else:
                x -= 1
    return out[::-1]


def _ascending(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of places that ascends on both sides."""
    places.sort(key=lambda p: p[1])
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for k, (x, _) in enumerate(places):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[at], ends[at] = x, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


def common_blocks(a: list[Line], b: list[Line], min_chars: int = MIN_CHARS) -> list[int]:
    """Places in b of the lines in aligned blocks of at least min_chars characters."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-2, -2)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(b[k][1] for k in block) >= min_chars:
                out += block
            block = []
        block.append(j)
        last = i, j
    return out


def passages(hashes: np.ndarray, sizes: np.ndarray, min_chars: int = MIN_CHARS) -> np.ndarray:
    """Distinct keys of a document's passages; every common block of min_chars holds one.

    A long line's key is its hash. From each shorter line that is not empty on, the shortest
    run of lines that reaches min_chars is a key, unless a long line comes first.
    """
    hashes, sizes = hashes.astype(np.int64).view(np.uint64), sizes.astype(np.int64)
    long_ones = sizes >= min_chars
    first = np.flatnonzero((sizes > 0) & ~long_ones)
    chars = np.concatenate([[0], np.cumsum(sizes)])
    end = np.searchsorted(chars, chars[first] + min_chars)
    reached = end <= len(sizes)
    first, end = first[reached], end[reached]
    before = np.concatenate([[0], np.cumsum(long_ones)])
    short = before[end] == before[first]
    first, end = first[short], end[short]
    # hash of the lines before each place; of two, the difference is that of a run, but for its place
    power, back = (np.cumprod(np.full(len(sizes), b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    runs = (upto[end] - upto[first]) * back[first] + (end - first).astype(np.uint64)
    return np.unique(np.concatenate([hashes[long_ones], runs]).view(np.int64))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        hashes, sizes = (batch.column(c) for c in ("hashes", "sizes"))
        rows = [(hashes[k].values.to_numpy(), sizes[k].values.to_numpy()) for k in range(batch.num_rows)]
        found = [passages(*row) for row in rows]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        keys = [batch.column(c).take(at) for c in KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(found))], [*KEY, "line"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        rows = [batch.column(c).to_pylist() for c in ("early", "early_sizes", "late", "late_sizes")]
        gone = [common_blocks(list(zip(a, n)), list(zip(b, m))) for a, n, b, m in zip(*rows)]
        keys = [batch.column(c) for c in KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(gone, pa.list_(pa.int32()))], [*KEY, "gone"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, counts, removed = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines = text.split("\n") if text else []
            out = set(gone or ())
            counts.append(len(lines))
            removed.append(len(out))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
        new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *new], ["row", "n_lines", "n_removed", "text"])


def shared_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, gone: places of the lines that each document loses, if any."""
    spark = docs.sparkSession
    folder = scratch(spark)
    rows = docs.where("doc_id is not null and text is not null and text <> ''")
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))
    hashes = F.transform(trimmed, lambda x: F.xxhash64(x)).alias("hashes")
    sizes = F.transform(trimmed, lambda x: F.length(x)).alias("sizes")
    lined = rows.select(*KEY, hashes, sizes)
    lines = lined.mapInArrow(_keyed, "doc_id long, text_hash long, line long")
    holders = lines.groupBy("line").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
    holders = stored(holders.where("last > holder").drop("last"), folder)

    partners = lines.join(holders, "line").where("doc_id > holder").select(*KEY, "holder").distinct()
    partners = stored(partners, folder)
    late = partners.join(lined.select(*KEY, F.col("hashes").alias("late"), F.col("sizes").alias("late_sizes")), KEY)
    early = lined.select(F.col("doc_id").alias("holder"), F.col("hashes").alias("early"), F.col("sizes").alias("early_sizes"))
    pairs = late.join(early, "holder").select(*KEY, "early", "early_sizes", "late", "late_sizes")
    gone = pairs.mapInArrow(_aligned, "doc_id long, text_hash long, gone array<int>").where(F.size("gone") > 0)
    gone = gone.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = stored(gone, folder)
    release(spark)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of the documents, text without the shared lines, then n_lines, n_removed.

    Lines end at \\n; they are compared without blanks at their ends, by a 64-bit hash and
    their length. What goes is what a document shares with an earlier one in the same order:
    of blocks that two documents hold in different orders, those on the longest common
    alignment go from the one with the greater doc_id and the others stay in both. Rows that
    share a doc_id lose nothing to each other. Null texts stay null; rows with a null doc_id
    stay as they are. If the documents have columns n_lines or n_removed, these are replaced.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    found = keyed.join(shared_lines(keyed.select(*KEY, "text")), KEY, "left").select("row", "text", "gone")
    kind = keyed.schema["row"].dataType.simpleString()
    out = found.mapInArrow(_cut, f"row {kind}, n_lines long, n_removed long, text string")
    new = ("n_lines", "n_removed")
    kept = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    return out.select(*kept, *new)
