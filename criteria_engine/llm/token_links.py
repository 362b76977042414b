"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes. Places where a token
of both ends are found by galloping intersection of the two lists of ends: each end of the
shorter list is looked for in the longer one by steps that double and a binary search within
the last step. The common places cut the text into groups; differences of the ranks of
neighbouring common places say which tokens of A and of B a group holds, and every token of A
in a group is linked to every one of B there.

Both vocabularies begin a new token at a blank or line break between other characters, so
a word's groups are found once per worker and numpy repeats them; texts with other white space
are aligned whole. Links are counted per pair of ids, never listed by occurrence.

For the counts over all documents, texts are handled in chunks of bounded size. A chunk's row
holds its documents' links as numpy arrays over the chunk's distinct pairs. Only distinct
pairs of a chunk are shuffled for the counts, and their counts come back to the chunk.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import scratch, slices, stored
from criteria_engine.llm.token_ids import GLUE, IRREGULAR, take_runs, tokenizer

CHUNK_BYTES = 4 << 20
# Words that a worker remembers.
KEPT_WORDS = 500_000
# Of a unit: whether both vocabularies give its bytes, tokens of A, tokens of B, groups, links.
NUMBERS = 5
# Texts that are aligned whole, beside those of IRREGULAR: the mark that stands for a blank in B's
# pieces, NUL and the mark that GLUE uses.
WHOLE = IRREGULAR + "|▁|\x00"


def gallop(short: Sequence[int], long: Sequence[int]) -> list[tuple[int, int]]:
    """Ranks (in short, in long) of the values that both ascending lists have."""
    out, low, n = [], 0, len(long)
    for i, value in enumerate(short):
        step, high = 1, low
        while high < n and long[high] < value:
            low, high, step = high + 1, high + step, 2 * step
        low = bisect_left(long, value, low, min(high, n))
        if low == n:
            break
        if long[low] == value:
            out.append((i, low))
    return out


def groups(a_ends: Sequence[int], b_ends: Sequence[int]) -> list[tuple[int, int]]:
    """For each group, how many tokens of A and of B up to its end."""
    if len(a_ends) <= len(b_ends):
        return [(i + 1, j + 1) for i, j in gallop(a_ends, b_ends)]
    return [(j + 1, i + 1) for i, j in gallop(b_ends, a_ends)]


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Column:
    """Numbers that grow at the end, in one array."""

    def __init__(self):
        self.held, self.n = np.empty(1 << 12, np.int64), 0

    def extend(self, values: Sequence[int]) -> None:
        end = self.n + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(end, np.int64)])
        self.held[self.n : end] = values
        self.n = end

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Tokens, groups and links of texts under both vocabularies.

    A unit is a word or a whole text. Of unit u, `numbers` has the NUMBERS from NUMBERS * u on,
    `texts` the groups in figures, and `pairs` and `times` its links from starts[u] to starts[u + 1].
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = tokenizer(a_path, special_as_text=True)
        self.b = SentencePieceProcessor(model_file=b_path)
        table = byte_table()
        self.a_bytes: dict[int, bytes] = {}
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.shown = [str(i) for i in range(1 + max(len(pieces), *self.a_bytes))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers, self.pairs, self.times, self.starts = Column(), Column(), Column(), Column()
        self.starts.extend([0])

    def cut_back(self, units: int) -> None:
        """Forget the units behind the first ones."""
        del self.texts[units:]
        self.numbers.n, self.starts.n = NUMBERS * units, units + 1
        self.pairs.n = self.times.n = int(self.starts.all()[-1])

    def align(self, a_ids: Sequence[int], b_ids: Sequence[int], expected: bytes) -> list[tuple] | None:
        """The groups as (ids of A, ids of B), or None if the tokens' bytes are not those expected."""
        a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if b"".join(a_parts) != expected or b"".join(b_parts) != expected:
            return None
        out, i, j = [], 0, 0
        for i_end, j_end in groups(list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts)))):
            out.append((a_ids[i:i_end], b_ids[j:j_end]))
            i, j = i_end, j_end
        return out

    def _keep(self, units: Iterator[tuple[list[int], list[int], bytes]]) -> None:
        """Align (ids of A, ids of B, bytes) and remember the results as the next units."""
        numbers, pairs, times, starts = [], [], [], []
        shown, before = self.shown.__getitem__, self.pairs.n
        for a_ids, b_ids, expected in units:
            found = self.align(a_ids, b_ids, expected)
            links: dict[int, int] = {}
            figures = []
            for left, right in found or ():
                if len(left) == 1 and len(right) == 1:
                    link = left[0] << 32 | right[0]
                    links[link] = links.get(link, 0) + 1
                    figures.append(f"{left[0]}|{right[0]}")
                    continue
                for a, n in Counter(left).items():
                    for b, m in Counter(right).items():
                        links[a << 32 | b] = links.get(a << 32 | b, 0) + n * m
                figures.append(f"{','.join(map(shown, left))}|{','.join(map(shown, right))}")
            numbers += (found is not None, len(a_ids), len(b_ids), len(figures), sum(links.values()))
            self.texts.append(";".join(figures))
            pairs += links
            times += links.values()
            starts.append(before + len(pairs))
        for column, values in ((self.numbers, numbers), (self.pairs, pairs), (self.times, times), (self.starts, starts)):
            column.extend(values)

    def _learn(self, names: list[str]) -> None:
        new = [w for w in names if w not in self.known]
        if not new:
            return
        glued = [w[:1] == GLUE for w in new]
        plain = [w[1:] if g else " " + w for w, g in zip(new, glued)]
        coded = self.a.encode(plain, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(new) + 1)).tolist()
        ids = coded.ids
        # B puts a blank before every text; behind a line break there is none, and its two tokens are dropped
        rows = self.b.encode(["\n" + w[1:].removeprefix("\n") if g else w for w, g in zip(new, glued)], num_threads=1)
        first = [0 if not g else 1 if text == "\n" else 2 for g, text in zip(glued, plain)]
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self._keep((ids[ends[k] : ends[k + 1]], rows[k][first[k] :], plain[k].encode()) for k in range(len(new)))

    def _whole(self, texts: list[str]) -> range:
        """Units of texts that are aligned whole; they go with `cut_back`."""
        first = len(self.texts)
        a_rows = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        rows = self.b.encode(texts, num_threads=1)
        self._keep((a.ids, b, (" " + text).encode()) for text, a, b in zip(texts, a_rows, rows))
        return range(first, len(self.texts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Units of all texts in one array, and offsets of the texts."""
        self.cut_back(len(self.known))
        if len(self.known) > KEPT_WORDS:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, WHOLE)
        # an added mark before each line break makes it a word of its own, and what follows another
        marked = pc.replace_substring(pc.if_else(odd, "", texts), "\n", f" {GLUE}\n {GLUE}")
        parts = pc.split_pattern(marked, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(pc.binary_length(marked), 0).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        self._learn(names := coded.dictionary.to_pylist())
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        units = at[coded.indices.to_numpy(zero_copy_only=False)]
        units = units[~np.repeat(empty, counts)]
        counts[empty] = 0
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            held = self._whole(texts.take(pa.array(rows)).to_pylist())
            starts = np.cumsum(counts) - counts
            units = np.insert(units, starts[rows], held)
            counts[rows] = 1
        return units, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, so that tasks share the words it remembers."""
    return Aligner(a_path, b_path)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same in the smallest unsigned kind."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


CHUNK = pa.schema(
    [
        ("chunk", pa.string()), ("docs", pa.binary()), ("doc_ids", pa.binary()), ("has_id", pa.binary()),
        ("hashes", pa.list_(pa.string())), ("sizes", pa.binary()), ("at", pa.binary()), ("times", pa.binary()), ("kinds", pa.list_(pa.string())),
        ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())),
    ]
)
CHUNK_DDL = (
    "chunk string, docs binary, doc_ids binary, has_id binary, hashes array<string>, sizes binary, at binary, "
    "times binary, kinds array<string>, a array<int>, b array<int>, n array<int>"
)


def chunk_row(align: Aligner, doc_ids: pa.Array, texts: pa.Array) -> dict:
    """A chunk's documents and their links, as numpy bytes over the chunk's distinct pairs."""
    units, offsets = align(texts)
    starts = align.starts.all()
    sums = _sums(align.numbers.all().reshape(-1, NUMBERS)[units], offsets)
    n_units = np.diff(offsets)
    # a document whose bytes differ in one unit has no tokens, like one without text
    good = (sums[:, 0] == n_units) & (n_units > 0)
    sums[~good] = 0
    at = units.tolist()
    hashes = [
        sha256(";".join([align.texts[u] for u in at[start:end]]).encode()).hexdigest() if ok else ""
        for start, end, ok in zip(offsets[:-1], offsets[1:], good)
    ]
    doc = np.repeat(np.arange(len(good)), n_units)
    keep = good[doc]
    # each unit once per document, then each pair once per document
    n = max(len(align.texts), 1)
    held, n_held = np.unique(doc[keep] * n + units[keep], return_counts=True)
    doc, unit = held // n, held % n
    sizes = starts[unit + 1] - starts[unit]
    pair = take_runs(align.pairs.all(), starts[unit], sizes)
    weight = take_runs(align.times.all(), starts[unit], sizes) * np.repeat(n_held, sizes)
    doc = np.repeat(doc, sizes)
    distinct, place = np.unique(pair, return_inverse=True)
    by_doc = doc * max(len(distinct), 1) + place
    order = np.argsort(by_doc, kind="stable")
    first = np.flatnonzero(np.diff(by_doc[order], prepend=-1))
    times = _narrow(np.add.reduceat(weight[order], first)) if len(first) else np.empty(0, np.uint8)
    doc, place = doc[order][first], _narrow(place[order][first])
    per_doc = np.bincount(doc, minlength=len(good)).astype(np.int64)
    ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "chunk": uuid4().hex,
        "docs": np.ascontiguousarray(sums[:, 1:]).tobytes(),
        "doc_ids": ids.tobytes(),
        "has_id": doc_ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
        "hashes": hashes,
        "sizes": per_doc.tobytes(),
        "at": place.tobytes(),
        "times": times.tobytes(),
        "kinds": [place.dtype.str, times.dtype.str],
        "a": (distinct >> 32).astype(np.int32),
        "b": (distinct & 0xFFFFFFFF).astype(np.int32),
        "n": np.bincount(place, minlength=len(distinct)).astype(np.int32),
    }


def _chunks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in slices(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_pylist([chunk_row(align, batch.column("doc_id"), batch.column("text"))], CHUNK)

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            kinds = row["kinds"]
            at, times = np.frombuffer(row["at"], kinds[0]).astype(np.int64), np.frombuffer(row["times"], kinds[1]).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
            counts, best = np.zeros(len(row["a"]), np.int64), np.zeros(len(row["a"]), np.int64)
            for found in row["found"] or ():
                counts[found["place"]], best[found["place"]] = found["count"], found["best"]
            n_best, count_sum = (_sums(times * x[at], offsets) for x in (best, counts))
            ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=~np.frombuffer(row["has_id"], bool))
            docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 4)
            columns = [ids, *map(pa.array, docs.T.copy()), pa.array(n_best), pa.array(count_sum), pa.array(row["hashes"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in RESULT.split(", ")])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count: how many documents hold the pair linked."""
    return _pairs(chunks).groupBy("a", "b").agg(F.sum("n").alias("count"))


def _pairs(chunks: DataFrame) -> DataFrame:
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "pair"))
    return each.select("chunk", "place", "pair.*")


def link_chunks(docs: DataFrame, a_path: str, b_path: str, folder: str) -> DataFrame:
    """The stored links of all documents, a row per chunk of about CHUNK_BYTES of text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_chunks(a_path, b_path), CHUNK_DDL), folder)


def link_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A links' count is how many rows of `docs` hold its pair of ids linked; n_best are the links whose
    count is the highest of their A id's, count_sum adds the counts of all links. Texts that are
    null, empty, or that one vocabulary does not give back byte for byte have no tokens: zeros and
    an empty digest. Repeated rows count each; rows may share a doc_id or have none; other
    columns are ignored.
    """
    folder = scratch(docs.sparkSession)
    chunks = link_chunks(docs, a_path, b_path, folder)
    counts = stored(pair_counts(chunks), folder)
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    marked = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    # a pair has a row per chunk; one of very many chunks is split here, as both sides are plain tables
    found = _pairs(chunks).drop("n").join(stored(marked, folder), ["a", "b"])
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    return chunks.drop("b", "n").join(found, "chunk", "left").mapInArrow(_graded, RESULT)
