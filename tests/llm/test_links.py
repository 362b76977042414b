"""Token links against plain calls of both libraries and a count of every pair of tokens."""

from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from criteria_engine.llm import token_links
from criteria_engine.llm.queries import QUERIES
from criteria_engine.llm.token_links import Aligner, gallop, link_tokens
from llm.llm_helpers import prose

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", None, " ", " lead", "trail ", "a  b", "x\n y", "tab\tz", "don't stop. It's 3.5, I'LL\nGo..on", "<|endoftext|> a <s> <unk> <0x0A>",
    "é ́a", "one\x01two", "中文 字,", "line\n\nline", "l1\nl2\nl3", "▁ a", "a\x00b", "ﬁ ½ Å", "\n", "aaaa" * 900, "🙂🙂 x", "A B", prose(1, 3000),
]


@cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def shown_byte(c):
    """The byte behind a character of a byte-level entry."""
    code, odd = ord(c), [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return odd[code - 256] if code >= 256 else code


def tokens(text):
    """(id, start, end) under both vocabularies, or none."""
    a, b = libraries()
    if not text:
        return [], []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(map(shown_byte, a.id_to_token(i))) for i in a_ids]
    b_parts = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, map(b.id_to_piece, b_ids))]
    if not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
        return [], []
    out = []
    for ids, parts in ((a_ids, a_parts), (b_ids, b_parts)):
        ends = list(accumulate(map(len, parts)))
        out.append([(i, end - len(part), end) for i, end, part in zip(ids, ends, parts)])
    return tuple(out)


def brute(rows):
    per = []
    for doc_id, text in rows:
        a, b = tokens(text)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        parts, links, start = [], [], 0
        for end in cuts:
            left = [i for i, s, e in a if start <= s and e <= end]
            right = [i for i, s, e in b if start <= s and e <= end]
            parts.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            links += [(x, y) for x in left for y in right]
            start = end
        digest = sha256(";".join(parts).encode()).hexdigest() if parts else ""
        per.append((doc_id, len(a), len(b), len(parts), links, digest))
    count = Counter(pair for row in per for pair in set(row[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (i, n_a, n_b, n, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest)
            for i, n_a, n_b, n, links, digest in per
        ),
        key=str,
    )


def found(frame):
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, frame.collect()), key=str)


def test_odd_texts_repeated_rows_and_null_ids(documents):
    rows = [*((i, t) for i, t in enumerate(ODD) if t is None or len(t) < 3000), (None, "line one"), (3, " lead"), (None, None)]
    assert found(link_tokens(documents(*rows).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "a"), A, B)) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # a brute-force group is found by looking at all tokens, so very long texts are left to the next test
    short = [r for r in rows if len(r[1] or "") < 4000]
    assert len(short) > 150
    assert found(link_tokens(docs.where("coalesce(length(text), 0) < 4000"), A, B)) == brute(short)
    assert QUERIES["op13_token_links"](spark, "/root/testdata/sf0.001").count() == len(rows)


@cache
def aligner():
    return Aligner(A, B)


def check_units(texts):
    """Groups of units put together are those of the whole text, and so are numbers and links."""
    align = aligner()
    units, offsets = align(pa.array(texts, pa.string()))
    numbers = align.numbers.all().reshape(-1, 5)
    starts, pairs, times = (c.all() for c in (align.starts, align.pairs, align.times))
    for k, text in enumerate(texts):
        own = units[offsets[k] : offsets[k + 1]]
        a, b = tokens(text)
        fits = len(own) > 0 and numbers[own, 0].all()
        assert fits == bool(a)
        if not fits:
            continue
        whole = align.align([x[0] for x in a], [x[0] for x in b], (" " + text).encode())
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in whole)
        assert ";".join(align.texts[u] for u in own) == shown
        assert numbers[own, 1:4].sum(0).tolist() == [len(a), len(b), len(whole)]
        links = Counter()
        for u in own:
            links.update({p: n for p, n in zip(pairs[starts[u] : starts[u + 1]].tolist(), times[starts[u] : starts[u + 1]].tolist())})
        expected = Counter(x << 32 | y for left, right in whole for x in left for y in right)
        assert links == expected and numbers[own, 4].sum() == sum(expected.values())


def test_units_of_odd_and_long_texts(spark):
    check_units([t if t is None or len(t) < 30000 else t for t in ODD])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check_units([r.text for r in docs])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab.,' \n\t\x01é́　ß1▁中\x00<>s", max_size=30), max_size=6))
def test_units_of_any_text(texts):
    check_units(texts)


@settings(max_examples=200, deadline=None)
@given(a=st.sets(st.integers(0, 300)), b=st.sets(st.integers(0, 300)))
def test_galloping_intersection(a, b):
    left, right = sorted(a), sorted(b)
    assert gallop(left, right) == [(left.index(x), right.index(x)) for x in left if x in b]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_links, "KEPT_WORDS", 50)
    align = Aligner(A, B)
    for seed in range(4):
        align(pa.array([prose(seed, 100), "whole  text"]))
    assert len(align.known) <= 100 and len(align.texts) == len(align.known) + 1


def test_groups_of_very_many_tokens(documents):
    # no occurrence of a pair is listed
    rows = [(1, "͸" * 3000), (2, "=" * 5000)]
    assert found(link_tokens(documents(*rows), A, B)) == brute(rows)


def test_small_chunks_and_empty_table(documents, monkeypatch):
    rows = [(i, prose(i % 3, 40)) for i in range(40)]
    whole = found(link_tokens(documents(*rows).coalesce(1), A, B))
    assert whole == found(link_tokens(documents(*rows).repartition(13), A, B)) == brute(rows)
    assert link_tokens(documents(*rows).where("false"), A, B).count() == 0
