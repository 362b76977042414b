"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed: the pieces of a public tokenizer. For each language a word's
probability is the sum, over all ways to cut it into pieces, of the products of piece
probabilities; a forward pass over the word computes it. Piece probabilities are fitted
per language by expectation maximisation on word counts of a bounded sample: about
SAMPLE_DOCS documents and at most SAMPLE_WORDS distinct words of each language, and fewer
where there are so many languages that this would be more than TOTAL_WORDS. Every `lang`
value is learned; the model has a number per piece and language. Learning reads words of more than
LONGEST_WORD letters in parts; scores sum over the whole word. A text's score sums its words;
distinct words of a batch are computed once, for some languages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from criteria_engine.llm.tables import codes, held_out, slices, words

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # before a word's first piece
# A longer word is summed letter by letter, and learned from in parts of this many letters.
LONGEST_WORD = 30
SAMPLE_DOCS, SAMPLE_WORDS, TOTAL_WORDS = 1500, 15_000, 3_000_000
ROUNDS = 4
SMOOTHING = 0.01
UNKNOWN = 1e-8
UNDECIDED = "und"
WORDS_AT_ONCE, LANGUAGES_AT_ONCE = 30_000, 8
# Long words at once, and their letters in the lattice at once.
LONG_AT_ONCE, LETTERS_AT_ONCE = 1000, 100_000
RESCALE = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def _hashes(units: np.ndarray, k: int, before: np.ndarray | None) -> np.ndarray:
    """Hash of the k characters from each place on, from the hashes for k - 1."""
    if before is None:
        return (units + np.uint64(1)) * BASE
    return (before[: len(units) - k + 1] + units[k - 1 :] + np.uint64(1)) * BASE


class Pieces:
    """Finds a fixed list of pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.near = np.zeros(1 << 18, bool)
        self.near[keys >> np.uint64(46)] = True

    @staticmethod
    def _key(piece: str) -> np.uint64:
        units = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        found = None
        for k in range(1, len(units) + 1):
            found = _hashes(units, k, found)
        return found[0]

    def lattice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Lengths and starts of the words, and for each piece length the piece from each place on.

        Words must come longest first. The number of pieces stands for none, one more for
        a character that is no piece.
        """
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        none, found, out = len(self.pieces), None, []
        for k in range(1, self.longest + 1):
            if len(units) < k:
                out.append(np.full(len(units), none))
                continue
            found = _hashes(units, k, found)
            piece = np.full(len(units), none if k > 1 else none + 1, np.int64)
            maybe = np.flatnonzero(self.near[found >> np.uint64(46)])
            at = np.minimum(np.searchsorted(self.keys, found[maybe]), len(self.keys) - 1)
            same = self.keys[at] == found[maybe]
            piece[maybe[same]] = self.order[at[same]]
            out.append(piece)
        return lengths, np.cumsum(lengths) - lengths, out


def forward(lattice, chances: np.ndarray, backward: bool = False) -> np.ndarray:
    """Summed chance of the letters before (backward: from) each place: words, places, languages."""
    lengths, starts, pieces = lattice
    longest = int(lengths.max(initial=0))
    reach = np.searchsorted(-lengths, -np.arange(longest + 2), side="right")  # words that have so many letters
    total = np.zeros((len(lengths), longest + 1, chances.shape[1]))
    if backward:
        total[np.arange(len(lengths)), lengths] = 1
        for i in range(longest - 1, -1, -1):
            for k in range(1, min(len(pieces), longest - i) + 1):
                n = reach[i + k]
                total[:n, i] += chances[pieces[k - 1][starts[:n] + i]] * total[:n, i + k]
        return total
    total[:, 0] = 1
    for i in range(longest):
        for k in range(1, min(len(pieces), longest - i) + 1):
            n = reach[i + k]
            total[:n, i + k] += chances[pieces[k - 1][starts[:n] + i]] * total[:n, i]
    return total


def long_logs(texts: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log of the summed chance of words of any length, which must come longest first.

    Only the sums for the next places, as many as a piece has letters, are held; they are
    brought back to 1 every RESCALE letters, so that no product is too small for a double.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ahead = np.zeros((len(texts), pieces.longest + 1, chances.shape[1]))
    ahead[:, 0] = 1
    logs = np.zeros((len(texts), chances.shape[1]))
    out = np.empty_like(logs)
    width = max(RESCALE, LETTERS_AT_ONCE // max(1, len(texts)))
    for first in range(0, int(lengths.max(initial=0)), width):
        n = int((lengths > first).sum())
        _, starts, found = pieces.lattice([t[first : first + width + pieces.longest] for t in texts[:n]])
        # longer pieces have fewer places to begin at
        by_length = np.full((pieces.longest, len(found[0])), len(pieces.pieces))
        for k, part in enumerate(found):
            by_length[k, : len(part)] = part
        for i in range(first, min(first + width, int(lengths[0]))):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # words of more letters
            met = chances[by_length[:, starts[:n] + (i - first)].T]
            ahead[:n, 1:] += met * ahead[:n, :1]
            ahead[:n, :-1] = ahead[:n, 1:]
            ahead[:n, -1] = 0
            done = int(np.searchsorted(-lengths, -(i + 1), side="left"))  # words that go on
            out[done:n] = np.log(np.maximum(ahead[done:n, 0], 1e-300)) + logs[done:n]
            if (i + 1) % RESCALE == 0:
                top = np.maximum(ahead[:done].max(1), 1e-300)
                ahead[:done] /= top[:, None]
                logs[:done] += np.log(top)
    return out


def _units(word: str) -> list[str]:
    word = MARK + word
    return [word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    chances: np.ndarray  # by piece and language, then a row for no piece, one for unknown characters

    def word_logs(self, vocabulary: list[str], some: slice = slice(None)) -> np.ndarray:
        """Log probability of each word in each language, or some; 0 for words without a letter."""
        chances = self.chances[:, some]
        out = np.zeros((len(vocabulary), chances.shape[1]))
        whole = [(MARK + w, i) for i, w in enumerate(vocabulary) if any(map(str.isalpha, w))]
        whole.sort(key=lambda p: -len(p[0]))
        n_long = sum(len(w) > LONGEST_WORD for w, _ in whole)
        for at in range(0, n_long, LONG_AT_ONCE):
            block = whole[at : min(at + LONG_AT_ONCE, n_long)]
            out[[i for _, i in block]] = long_logs([w for w, _ in block], self.pieces, chances)
        for at in range(n_long, len(whole), WORDS_AT_ONCE):
            block = whole[at : at + WORDS_AT_ONCE]
            lattice = self.pieces.lattice([w for w, _ in block])
            total = forward(lattice, chances)
            out[[i for _, i in block]] = np.log(np.maximum(total[np.arange(len(block)), lattice[0]], 1e-300))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        flat, offsets = words(pc.utf8_lower(pc.fill_null(texts, "")))
        vocabulary = pc.utf8_trim(flat.dictionary, characters=".,;:!?\"'()[]{}<>|*").to_pylist()
        letters = np.array([any(map(str.isalpha, w)) for w in vocabulary], bool)
        order = codes(flat)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        known = np.zeros(len(texts), bool)
        if len(full):
            for at in range(0, len(self.languages), LANGUAGES_AT_ONCE):
                some = slice(at, at + LANGUAGES_AT_ONCE)
                sums[full, some] = np.add.reduceat(self.word_logs(vocabulary, some)[order], offsets[full])
            known[full] = np.logical_or.reduceat(letters[order], offsets[full])
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = sums.argmax(1)
        chance = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        names = [self.languages[b] if k else UNDECIDED for b, k in zip(best, known)]
        return names, np.where(known, chance, 0.0)


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of letters and the marks that combine with them, with or without the mark of a word before them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(
        {p for p in found if p and all(category(c)[0] in "LM" for c in p.removeprefix(MARK))} | {MARK}
    )


def train(counts: dict[str, dict[str, int]], pieces: Pieces) -> Model:
    """counts: for each language, how often each word occurs."""
    languages, size = sorted(counts), len(pieces.pieces)
    chances = np.zeros((size + 2, len(languages)))
    for column, lang in enumerate(languages):
        units: dict[str, int] = {}
        for word, n in counts[lang].items():
            for unit in _units(word):
                units[unit] = units.get(unit, 0) + n
        listed = sorted(units, key=lambda u: (-len(u), u))
        own = np.full((size + 2, 1), 1 / size)
        own[size:, 0] = 0, UNKNOWN
        for _ in range(ROUNDS):
            expected = np.zeros(size + 2)
            for at in range(0, len(listed), WORDS_AT_ONCE):
                some = listed[at : at + WORDS_AT_ONCE]
                lattice = pieces.lattice(some)
                lengths, starts, found = lattice
                before, behind = forward(lattice, own)[..., 0], forward(lattice, own, backward=True)[..., 0]
                weight = np.array([units[u] for u in some]) / np.maximum(behind[:, 0], 1e-300)
                for i in range(int(lengths.max(initial=0))):
                    for k in range(1, pieces.longest + 1):
                        n = int((lengths >= i + k).sum())
                        ids = found[k - 1][starts[:n] + i] if n else np.empty(0, np.int64)
                        part = before[:n, i] * own[ids, 0] * behind[:n, i + k] * weight[:n] if n else 0.0
                        expected += np.bincount(ids, weights=part, minlength=size + 2) if n else 0
            own[:size, 0] = (expected[:size] + SMOOTHING) / (expected[:size].sum() + SMOOTHING * size)
        chances[:, column] = own[:, 0]
    return Model(languages, pieces, chances)


def word_counts(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Words of the sample, by language; rows that are held out or lack a language are not in it."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return {}
    most = max(1, min(SAMPLE_WORDS, TOTAL_WORDS // len(sizes)))
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_DOCS / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(drawn < part[F.col("lang")])
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")
    counted = chosen.select("lang", word).where("word <> ''").groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    out: dict[str, dict[str, int]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= most).collect():
        out.setdefault(r["lang"], {})[r["word"]] = r["count"]
    return out


def fit(docs: DataFrame, vocabulary: str | None = None) -> Model:
    pieces = Pieces(vocabulary_pieces(vocabulary or public_tokenizers.path(VOCABULARY)))
    return train(word_counts(docs), pieces)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the likeliest language and its share of the chances.

    `und` with score 0 where a text is null, empty or has no letter, and everywhere if
    the model knows no language. Equal chances go to the first language by name. Repeated
    rows are each predicted; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, chance = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(chance)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, RESULT)
