"""Benchmark items in documents, within an edit distance, by exact pieces.

An item with an error budget of k edits is cut into k + 1 pieces; any passage within k
edits holds one of them unchanged. All pieces of a block of items stand in one automaton
that reads each document once; round each hit, Myers' bit-parallel algorithm measures
the edit distance of the item to the best passage. Items are sent to the tasks in blocks
of bounded size, one pass over the documents for each, so the benchmark may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import slices

# Edits per character that a passage may differ by.
ERRORS = 0.08
# Characters of the items that one pass over the documents searches for.
BLOCK_CHARS = 500_000
MATCH = "array<struct<item_id: long, distance: int, start: long, end: long>>"


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case; what is neither letter, mark nor digit is one blank; no blank at the ends."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM\pN]+", " "), characters=" ")


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length that make up the item, with their places."""
    n = min(k + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a passage of the text, and where the first such one ends."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        x = equal | minus
        d = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (every & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up, down = up << 1, down << 1
        plus, minus = (down | (every & ~(x | up))) & every, up & x
    return best, end


@dataclass
class Items:
    """The items of a block, ready to be looked for."""

    texts: list[tuple[int | None, str]]
    errors: float = ERRORS
    found: ahocorasick.Automaton = field(init=False)

    def __post_init__(self):
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(self.texts):
            for at, piece in pieces(text, budget(len(text), self.errors)):
                places.setdefault(piece, []).append((i, at + len(piece)))
        self.found = ahocorasick.Automaton()
        for piece, where in places.items():
            self.found.add_word(piece, where)
        if places:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the best passage for every item within its budget."""
        if not self.texts:
            return []
        starts: dict[int, list[int]] = {}
        for last, where in self.found.iter(text):
            for i, done in where:
                starts.setdefault(i, []).append(last + 1 - done)
        best: dict[int | None, tuple[int, int, int]] = {}
        for i, at in starts.items():
            item_id, item = self.texts[i]
            k = budget(len(item), self.errors)
            same = text.find(item)
            if same >= 0:
                hit = (0, same, same + len(item))
            else:
                hit = min(self._near(item, text, at, k), default=None)
            if hit and (item_id not in best or hit < best[item_id]):
                best[item_id] = hit
        return sorted(((i, *hit) for i, hit in best.items()), key=lambda m: (m[0] is None, m[0] or 0))

    @staticmethod
    def _near(item: str, text: str, starts: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        """Best passage of each stretch of the text in which the pieces were hit."""
        stretches: list[list[int]] = []
        for s in sorted(set(starts)):
            low, high = max(0, s - k), s + len(item) + k
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = high
            else:
                stretches.append([low, high])
        for low, high in stretches:
            part = text[low:high]
            distance, end = myers(item, part)
            if distance <= k:
                back = part[max(0, end - len(item) - k) : end][::-1]
                _, length = myers(item[::-1], back)
                yield distance, low + end - length, low + end


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in lists of about BLOCK_CHARS; items without a letter or digit are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        some = rows.where(block == b).collect() if n > 1 else rows.collect()
        texts = normalised(pa.array([r["text"] for r in some], pa.string())).to_pylist()
        yield sorted(((r["item_id"], t) for r, t in zip(some, texts) if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_items(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, column: str = "matches") -> DataFrame:
    """The documents with a column of matches: item_id, distance, start and end in the normalised text.

    An item matches where a passage is within int(errors * characters) edits of it, both
    normalised; each item has its best passage, the earliest end among equals. Null and empty texts and
    items match nothing; an item id that stands for several texts has the best of them.
    Other columns are kept; the name of the new one must be free.
    """
    spark = docs.sparkSession
    if column in docs.columns:
        raise ValueError(f"the documents have a column {column}")
    out = docs.withColumn(column, F.array().cast(MATCH))
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS bounds it

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, errors)
            for batch in slices(batches, "text"):
                text = batch.column("text").cast(pa.string())
                found = [
                    [dict(zip(("item_id", "distance", "start", "end"), m)) for m in items.matches(t)]
                    for t in normalised(text).to_pylist()
                ]
                before = batch.column(column)
                kind = before.type
                if any(pc.list_value_length(before).to_pylist()):
                    found = [_best_of(b + f) for b, f in zip(before.to_pylist(), found)]
                at = batch.schema.get_field_index(column)
                columns = [*batch.columns[:at], pa.array(found, kind), *batch.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(search, out.schema)
    return out


def _best_of(matches: list[dict]) -> list[dict]:
    """One match for each item."""
    best: dict[int | None, dict] = {}
    for m in matches:
        other = best.get(m["item_id"])
        if other is None or (m["distance"], m["start"]) < (other["distance"], other["start"]):
            best[m["item_id"]] = m
    return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, distance, start, end: a row for every item found in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_items(rows, benchmark, errors).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")
