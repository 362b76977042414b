"""Token ids of whole texts, with each distinct word of a batch tokenized once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts with white space at an end, with two white-space characters side by side, or with
# other separators and combining marks are encoded whole: there a blank or a line break
# need not be where a piece begins.
IRREGULAR = r"\x01|^[\s\pZ]|[\s\pZ]$|[\s\pZ\x1c-\x1f\x85]{2}|[\t\r\f\x0b\x1c-\x1f\x85]|[^\P{Z} ]|\pM"


# Stands before a word that has no blank before it.
GLUE = "\x01"
KEPT_WORDS = 1_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = False):
    """The library's tokenizer; it finds special tokens in a text by their strings unless told otherwise."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = special_as_text
    return loaded


def take_runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] of all (s, n), one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


class Encoder:
    """Ids of texts by a tokenizers file; the same as encoding each text in one call.

    A blank or a line break between other characters, and a full stop or comma behind a
    letter, always begin a new piece of the pre-tokenizers used here. So texts are cut
    there, each distinct word (with the blank before it, where the vocabulary keeps it:
    `lead`) is encoded once and numpy repeats its ids. Words are remembered between
    batches, up to KEPT_WORDS of them. Strings of the file's added tokens become their ids.
    """

    def __init__(self, path: str, lead: bool):
        self.tokenizer, self.lead = tokenizer(path), lead
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # such strings become one id wherever they stand, so texts with one, in any case, are encoded whole
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        # how they begin, as far as case has no say; few texts hold that
        self.hints = {re.match(r"[^\w]*", content)[0] for content in added}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        plain = [w[1:] if w[:1] == GLUE else " " + w if self.lead else w for w in new]
        coded = self.tokenizer.encode(plain, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(1, len(new) + 1))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        need = self.n_ids + len(coded.ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(need, np.uint32)])
        self.ids[self.n_ids : need] = coded.ids
        self.starts = np.concatenate([self.starts, self.n_ids + ends])
        self.n_ids = need

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and offsets of the texts (null: no ids)."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, IRREGULAR)
        for hint in self.hints:
            if pc.any(pc.match_substring(texts, hint)).as_py():
                whole = pc.or_(whole, pc.match_substring_regex(texts, self.added))
                break
        whole = whole.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts)
        if not self.lead:
            plain = pc.ascii_lower(plain)  # as the normalizer does
        marked = pc.replace_substring(plain, "\n", f" {GLUE}\n")
        marked = pc.replace_substring_regex(marked, r"(\pL)([.,])", f"\\1 {GLUE}\\2")
        parts = pc.split_pattern(pc.binary_join_element_wise(GLUE, marked, ""), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        starts = self.starts[at]
        sizes = self.starts[at + 1] - starts
        ids = take_runs(self.ids, starts, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        odd = np.flatnonzero(whole)
        if not len(odd):
            return ids, offsets
        rows = np.split(ids, offsets[1:-1])
        found = self.tokenizer.encode_batch(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
        for i, row in zip(odd, found):
            rows[i] = np.array(row.ids, np.uint32)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.concatenate(rows), np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(maxsize=2)
def encoder(path: str, lead: bool) -> Encoder:
    """One per Python worker, so that tasks share the words it remembers."""
    return Encoder(path, lead)
