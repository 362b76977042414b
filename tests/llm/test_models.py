"""Toxicity, language and page extraction: held-out accuracy, odd inputs."""

import random
import zlib
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from conftest import TESTDATA
from criteria_engine.llm import boosting, html_extract, language, toxicity
from criteria_engine.llm.dom import decode, parse
from criteria_engine.llm.page_samples import Drawer
from criteria_engine.llm.queries import QUERIES
from llm.llm_helpers import prose

ODD = [(9001, None, None), (9002, "", "en"), (9003, " \n ", "xx"), (None, "no id", "en"), (9004, "12 34!", None), (9005, prose(1, 30000), "en"), (9005, "twice", "en")]


def is_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark, documents):
    draw, rows, labels = random.Random(4), [], []
    for i in range(500):
        words, bad = prose(i, draw.randint(5, 120)).split(), i % 3 == 0
        if bad:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randint(0, len(words)), draw.choice(["grobnar", "Grobnarit", "vlexhund,", "VLEXOR"]))
        rows.append((i, " ".join(words), draw.choice(["en", "fr"])))
        labels.append((i, 1 - bad, int(bad)))
    labels += [(9001, 0, 1), (9002, 0, 0), (None, 0, 1), (3, 0, None), (9005, 0, 0), (4, 1, 0)]
    return documents(*rows, *ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity(labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 250)
    docs, labels, rows = labelled
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == is_held_out(r.doc_id) and r.rejected == (r.score >= r.threshold) for r in found)
    tested = [r for r in found if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in tested]) > 0.95
    blank = {r.score for r in found if r.doc_id in (9001, 9002, 9003)}
    assert len(blank) == 1
    kept = toxicity.score(docs.withColumnRenamed("source", "score"), model, keep=("score", "n_chars"))
    assert {r.kept_score for r in kept.collect()} == {"src"}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(labelled):
    docs, labels, _ = labelled
    found = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert {r.predicted for r in found.collect()} == {0}


def test_toxicity_learns_from_all_rows_in_many_tasks(spark, documents, monkeypatch):
    # only texts of 5,000 words are toxic, and no row and no text is too many or too long
    monkeypatch.setattr(toxicity, "STEPS", 100)
    monkeypatch.setattr(toxicity, "TASK_ROWS", 100)
    rows = [(i, f"vlexor {prose(i % 7, 4999)}" if i % 10 == 0 else prose(i, 20)) for i in range(400)]
    docs, labels = documents(*rows), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    learned, parts = toxicity.learned_rows(docs, labels)
    wanted = [(i, text) for i, text in rows if not is_held_out(i)]
    assert sorted((r.doc_id, r.text) for r in learned.collect()) == wanted and parts == 4
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    toxic, clean = ([r.score for r in found if (r.doc_id % 10 == 0) == t] for t in (True, False))
    assert min(toxic) > np.mean(clean) + 0.2


def test_thresholds_count_every_tested_row(spark, documents):
    model = toxicity.new_model(2)
    model.shift[:] = -1
    rows = [(i, prose(i, 3 + i % 40), "en" if i % 2 else "fr", i % 5 < 2) for i in range(400)]
    scores = model.scores(pa.array([r[1] for r in rows]))
    tested = spark.createDataFrame([(*r[:3], int(r[3])) for r in rows] + [(1, "a", None, 1), (2, "b", "xx", 0)], "doc_id long, text string, lang string, toxic int")
    found = {r.lang: r.threshold for r in toxicity._cells(tested, model).collect()}
    assert set(found) == {"en", "fr"}
    for lang, cut in found.items():
        at = np.array([r[2] == lang for r in rows])
        toxic = np.array([int(r[3]) for r in rows])[at]

        def f1(t):
            return 2 * ((scores[at] >= t) & (toxic == 1)).sum() / ((scores[at] >= t).sum() + toxic.sum())

        # cells of odds may hide a little of what single scores give
        assert f1(cut) >= max(f1(t) for t in [*scores[at], 0.3]) - 0.01


def test_pooling_is_the_same_for_batches_and_single_texts():
    model = toxicity.new_model(1)
    model.out[:] = np.random.default_rng(0).normal(size=len(model.out))
    texts = ["", "one", "two words", prose(1, 50), None, "x y z"]
    together = model.scores(pa.array(texts))
    assert np.allclose(together, [model.scores(pa.array([t], pa.string()))[0] for t in texts], atol=1e-6)


def test_threshold():
    assert toxicity.best_threshold(np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])) == 0.3
    assert 0.5 < toxicity.best_threshold(np.array([0.1, 0.5, 0.6, 0.9]), np.array([0, 0, 1, 1])) < 0.6


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "aba", "ba"])
    chances = np.array([[0.3], [0.2], [0.1], [0.25], [0.15], [0.0], [language.UNKNOWN]])

    def total(word):
        if not word:
            return 1.0
        whole = sum(p * total(word[len(x) :]) for x, p in zip(pieces.pieces, chances[:, 0]) if word.startswith(x))
        return whole if word[0] in "ab" else whole + language.UNKNOWN * total(word[1:])

    texts = sorted(["abab", "aba", "b", "abxba", "bbbabaab"], key=lambda w: -len(w))
    lattice = pieces.lattice(texts)
    found = language.forward(lattice, chances)
    behind = language.forward(lattice, chances, backward=True)
    for i, word in enumerate(texts):
        assert np.isclose(found[i, len(word), 0], total(word))
        assert np.isclose(behind[i, 0, 0], total(word))


def test_language(documents):
    draw = random.Random(2)
    sounds = {"aa": ["ka", "ko", "tuk"], "bb": ["el", "ien", "sor"], "cc": ["ñu", "xa", "mim"]}
    rows = [
        (i, " ".join("".join(draw.choices(sounds[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(3, 40))), lang)
        for i, lang in enumerate(draw.choices(list(sounds), k=300))
    ]
    odd = [(i, t, lang) for i, t, lang in ODD if lang is None or i is None] + [(9002, "", "aa"), (9003, " \n1 ", "bb"), (9006, "Kako!!! " * 9000, None)]
    docs = documents(*rows, *odd).withColumnRenamed("source", "lang_pred")
    model = language.fit(docs)
    found = {(r.doc_id, r.held_out): r for r in language.identify(docs, model).collect()}
    assert all(h == is_held_out(i) and 0 <= r.score <= 1 for (i, h), r in found.items())
    right = [found[i, True].lang_pred == lang for i, _, lang in rows if is_held_out(i)]
    assert np.mean(right) > 0.97
    for i in (9001, 9002, 9003, 9004):
        assert (found[i, is_held_out(i)].lang_pred, found[i, is_held_out(i)].score) == ("und", 0.0)
    assert found[9006, is_held_out(9006)].lang_pred == "aa"
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>"</p>"</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>A  long &amp; winding&nbsp;title</h1><p>First para, with <b>bold</b> text and more of it here.
<p>Second&#33; para<br>goes on for a while, as it should.</p><div class="ad">Buy now.</div><p>The end of it all, in the last one.</p></article>
<section id="comments"><div class=comment>I disagree with this. Strongly.</div></section>
<form><label>Name</label><input></form><footer>&copy; 2020 <p>All rights.</footer>"""


def test_page():
    assert html_extract.texts([PAGE, ""], html_extract.model()) == [
        "A long & winding title\nFirst para, with bold text and more of it here.\n"
        "Second! para goes on for a while, as it should.\nThe end of it all, in the last one.",
        "",
    ]


def test_built_pages_it_has_not_seen():
    trees, drawer, right = html_extract.model(), Drawer(1234), 0
    for _ in range(100):
        html = drawer.page()
        page, wanted = html_extract.labelled(html)
        kept = decode(page, trees.log_odds(html_extract.features(page)))
        right += all(kept[n] == wanted[n] for n, _, _ in page.blocks)
    assert right >= 80


def test_decoding_is_the_best_consistent_choice():
    draw = np.random.default_rng(1)
    page = parse("<div><p>a<p>b<div><p>c</div></div><ul><li>d<li>e</ul>")
    n = len(page.tags)
    for _ in range(40):
        gain = draw.normal(size=n)
        best = max(
            (sum(g if k >> i & 1 else -g for i, g in enumerate(gain)), k)
            for k in range(2**n)
            if all(page.parents[i] < 0 or not k >> i & 1 or k >> page.parents[i] & 1 for i in range(n))
        )[1]
        assert decode(page, gain).tolist() == [bool(best >> i & 1) for i in range(n)]


@pytest.mark.parametrize("html", ["<", "<a", "a<b", "<p", "<!--", "<script>x", "</p>", "<p>&am", "<table><td>x<tr>y", "<li>a<ul><li>b</ul>c", "<x y='", "<" * 9999, "<div>" * 3000])
def test_damaged_pages_do_not_break(html):
    html_extract.texts([html], html_extract.model())


def test_boosting_learns_a_rule():
    rows = np.random.default_rng(0).normal(size=(2000, 4)).astype(np.float32)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] > 0)).astype(float)
    trees = boosting.fit(rows[:1500], labels[:1500], np.ones(1500), trees=20)
    assert ((trees.log_odds(rows[1500:]) > 0) == labels[1500:]).mean() > 0.95


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    found = sorted(html_extract.extract(pages).collect(), key=str)
    assert [r.n_chars for r in found if r.page_id == 1] == [len(r.text) for r in found if r.page_id == 1] != []
    assert [r.text for r in found if r.page_id != 1] == ["", ""]
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.skipif(not (TESTDATA / "sf0.01").exists(), reason="no test tables")
def test_pages_of_the_tables(spark):
    import re
    from html import unescape

    sf_dir = str(TESTDATA / "sf0.01")
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    right = 0
    for r in QUERIES["op3_html"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        right += r.text == "\n".join(b for b in blocks if b)
    assert right >= 0.98 * len(html)


def test_many_languages_are_all_learned(spark):
    """More languages than are scored at a time, each with words of its own."""
    n, rows = 300, []
    for i in range(n):
        draw = np.random.default_rng(i)
        own = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)]
        rows += [(i * 4 + j, f"l{i:03}", " ".join(draw.permutation(own))) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(docs)
    learned = {r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model.languages) == learned and len(learned) > 290
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(found[i] == lang for i, lang, _ in rows if lang in learned)


def test_long_pieces_and_combining_marks():
    pieces = language.vocabulary_pieces(public_tokenizers.path(language.VOCABULARY))
    assert max(map(len, pieces)) > 8 and any(category(c)[0] == "M" for p in pieces for c in p)
    marked = next(c for p in pieces for c in p if category(c)[0] == "M")
    found = language.Pieces(pieces)
    assert found.longest == max(map(len, pieces))
    # one language writes the sign after each letter, the other does not
    model = language.train({"bare": {"abab": 9, "ba": 5}, "signs": {f"a{marked}b{marked}": 9, f"b{marked}a": 5}}, found)
    assert model.predict(pa.array([f"ba{marked}", "baab"]))[0] == ["signs", "bare"]


def test_languages_in_blocks_give_the_same(monkeypatch):
    draw = np.random.default_rng(0)
    pieces = language.Pieces(["a", "b", "ab", "▁", "▁a"])
    counts = {f"l{i}": {"".join(draw.choice(["a", "b"], 5)): int(draw.integers(1, 9)) for _ in range(8)} for i in range(11)}
    model = language.train(counts, pieces)
    texts = pa.array(["abba ab", "", "bbbb aab ba", None])
    want = model.predict(texts)
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 3)
    got = model.predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_long_words_are_summed_whole(monkeypatch):
    """A letter-by-letter sum with exact fractions, whatever is read at once."""
    from fractions import Fraction
    from math import log

    draw = random.Random(8)
    names = ["a", "b", "ab", "aba", "ba", "▁", "▁a", "bbbbbbb"]
    pieces = language.Pieces(names)
    chances = np.array([[draw.random() / 9 for _ in range(3)] for _ in names] + [[0.0] * 3, [language.UNKNOWN] * 3])
    found = ["".join(draw.choices("abx", [5, 5, 1], k=n)) for n in (3, 29, 30, 31, 40, 41, 64, 200, 203, 1500)]
    found.append("b" * 500)

    def total(word, lang):
        sums = [Fraction(1)] + [Fraction(0)] * len(word)
        for i, letter in enumerate(word):
            for name, p in zip(names, chances[:, lang]):
                if word.startswith(name, i):
                    sums[i + len(name)] += Fraction(p) * sums[i]
            if letter not in "ab▁":
                sums[i + 1] += Fraction(language.UNKNOWN) * sums[i]
        top = sums[-1]
        return log(top.numerator) - log(top.denominator)

    want = np.array([[total("▁" + w, lang) for lang in range(3)] for w in found])
    model = language.Model(["x", "y", "z"], pieces, chances)
    for letters, words in ((100_000, 1000), (300, 4), (10, 1)):
        monkeypatch.setattr(language, "LETTERS_AT_ONCE", letters)
        monkeypatch.setattr(language, "LONG_AT_ONCE", words)
        assert np.allclose(model.word_logs(found), want)
    for longest in (0, 10_000):  # both ways for every word
        monkeypatch.setattr(language, "LONGEST_WORD", longest)
        assert np.allclose(model.word_logs(found[:7]), want[:7])


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p title=it's>one</p><p>it's two</p>", "one\nit's two"),
        ("<p title = it's class='x y'>one</p>", "one"),
        ("<p 'odd'>one</p>'", "one\n'"),
        ("<p data-x=\"a > b\" y='c > d'>one</p>", "one"),
        ("<p a= >one</p><p a=b=c>two</p><p =x>three</p>", "one\ntwo\nthree"),
        ("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds</p>", "so x=2 holds"),
    ],
)
def test_quotes_and_formulas(html, text):
    assert "\n".join(block for _, block, _ in parse(html).blocks) == text


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>deep</p>" + "</span></div>" * n
        start = time.process_time()
        assert [b[1] for b in parse(page).blocks] == ["deep"]
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.02)


def test_toxicity_looks_up_little_text_at_once(monkeypatch):
    """The words of the texts a task mixes, and of those it scores, are looked up about 1 MB at a time."""
    held, words = [], toxicity.words
    long = prose(1, 4000)
    texts = [f"{long} {i}" for i in range(150)]

    def seen(found):
        held.append(sum(map(len, found.to_pylist())))
        return words(found)

    rows = pa.RecordBatch.from_pydict({"text": texts, "toxic": [i % 2 for i in range(150)]})
    flat, offsets = words(pa.array(texts))
    whole = toxicity.features(flat.dictionary)[toxicity.codes(flat)]
    monkeypatch.setattr(toxicity, "words", seen)
    mixes = list(toxicity._mixes(iter([rows])))
    assert np.array_equal(np.concatenate([t for mixed, _ in mixes for t in mixed]), whole) and len(offsets) == 151
    assert np.concatenate([label for _, label in mixes]).tolist() == [i % 2 for i in range(150)]
    assert max(held) <= (1 << 20) + len(long) + 10
