"""License scan against a scan of word lists, altered notices, and its own SQL in DuckDB."""

import re

import duckdb
import pytest

from criteria_engine.llm import license_scan
from criteria_engine.llm.license_scan import GRAM, NOTICES, PHRASES, scan
from criteria_engine.llm.queries import QUERIES
from llm.llm_helpers import prose

MIT = NOTICES["mit"][1]
ODD = [
    "", None, "   ", "cc", "CC BY-NC", "cc by nc cc by nc", "Under the MIT License, under THE mit license.",
    "apache license, version 2 apache license version 3", "ünder the mit license", "cc\x00by\x7fnc", "cc by ncé",
    "İ Under the MIT licenſe", "x " * 3000 + "cc by nc", "cc by\nnc\n" * 400, MIT, MIT + " " + MIT, prose(5, 2000),
]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    """Places and labels of phrases."""
    own, found = words(text), []
    for label, phrases in PHRASES.items():
        for phrase in map(words, phrases):
            found += [(i, label) for i in range(len(own)) if own[i : i + len(phrase)] == phrase]
    return found


def check_base(rows, found):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in found) == sorted(
        (i is None, i or 0, len(words(t))) for i, t in rows
    )
    texts = dict(rows)
    for r in found:
        expected = base(texts[r.doc_id])
        assert r.n_base == len(expected)
        assert (r.first_word, r.last_word) == ((min(expected)[0], max(expected)[0]) if expected else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in expected}))
        assert {label for _, label in expected} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_phrases_like_a_scan_of_word_lists(documents):
    rows = list(enumerate(ODD))
    check_base(rows, scan(documents(*rows)).collect())


def test_whole_table_like_a_scan_of_word_lists(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_license_scan"](spark, "/root/testdata/sf0.01").collect()
    check_base([(r.doc_id, r.text) for r in given], found)
    assert any(r.labels != r.base_labels for r in found)


def altered(text, every):
    return " ".join(f"changed{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def test_altered_notices_are_found_and_prose_is_not(documents):
    before, after = prose(1, 300), prose(2, 300)
    longer = MIT.replace("without restriction", "and we mean it, without any restriction")
    shorter = MIT.replace(" free of charge,", "")
    rows = [
        (1, f"{before} {MIT} {after}"), (2, f"{before}\n{longer}\n{after}"), (3, f"{shorter} {after}"), (4, altered(MIT, 12)),
        (5, altered(MIT, 2)), (6, before), (7, " ".join(MIT.split()[:20])), (8, f"{MIT} {before} {MIT}"),
    ]
    found = {r.doc_id: r for r in scan(documents(*rows)).collect()}
    assert {i for i in found if found[i].labels == "mit"} == {1, 2, 3, 4, 8}
    assert all(found[i].labels == "" and found[i].score == 0 for i in (5, 6, 7))
    n = len(words(MIT))
    assert [tuple(s) for s in found[1].spans] == [(300, 300 + n - 1, "mit", 1.0)]
    assert [s.first_word for s in found[8].spans] == [0, n + 300]
    assert found[2].spans[0].last_word - found[2].spans[0].first_word + 1 == len(words(longer))
    assert MIT.count(" ") and found[4].score < 1


def test_the_closest_of_like_notices_is_taken(documents):
    rows = [(i, text) for i, text in enumerate(text for label in sorted(NOTICES) for text in NOTICES[label])]
    labels = [label for label in sorted(NOTICES) for _ in NOTICES[label]]
    found = {r.doc_id: r for r in scan(documents(*rows)).collect()}
    assert [found[i].labels for i in range(len(rows))] == labels
    assert all(r.score == 1 for r in found.values())


def test_repeated_rows_ids_and_null_ids(documents):
    rows = [(1, MIT), (1, MIT), (1, "cc by nc"), (None, MIT), (None, None), (2, None)]
    found = sorted((r.doc_id or 0, r.labels, r.n_base) for r in scan(documents(*rows)).collect())
    assert found == [(0, "", 0), (0, "mit", 0), (1, "cc-by-nc", 1), (1, "mit", 0), (1, "mit", 0), (2, "", 0)]


def test_no_rows_clashing_columns_and_own_templates(documents):
    assert scan(documents().where("false")).count() == 0
    clash = documents((1, "some words of ours")).withColumnRenamed("lang", "labels").withColumnRenamed("source", "hash")
    own = scan(clash, phrases={"ours": ["words of ours"]}, notices={}).first()
    assert (own.labels, own.n_base, own.first_word, own.spans) == ("ours", 1, 1, [])
    notice = scan(clash, phrases={}, notices={"ours": ["some words of ours"]}).first()
    assert (notice.labels, notice.base_labels, notice.n_base) == ("ours", "", 0)
    with pytest.raises(ValueError):
        scan(clash, phrases={}, notices={"none": []})
    with pytest.raises(Exception, match="fewer than"):
        scan(clash, phrases={"short": ["two words"]}).collect()


def test_no_python_in_the_plan(documents):
    plan = scan(documents((1, MIT)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_many_templates_are_not_broadcast(documents, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_CHARS", 10)
    found = scan(documents((1, MIT), (2, "cc by nc")))
    assert {r.doc_id: r.labels for r in found.collect()} == {1: "mit", 2: "cc-by-nc"}


def test_sql(documents):
    rows = [*enumerate(ODD), (50, f"{prose(1, 40)} {altered(MIT, 12)}"), (51, MIT.replace("without restriction", "with none"))]
    rows += [(60 + i, f"{text} {prose(i, 9)}") for i, text in enumerate(t for x in NOTICES.values() for t in x)]
    table = documents(*rows)
    found = scan(table).drop("spans").toPandas().sort_values("doc_id", ignore_index=True)
    with duckdb.connect() as db:
        db.register("documents", table.toPandas())
        expected = db.sql(license_scan.oracle()).df().sort_values("doc_id", ignore_index=True)[list(found.columns)]
    assert GRAM == 3 and len(found) == len(rows)
    plain = [t.astype(object).where(t.notna(), None).values.tolist() for t in (found, expected)]
    assert plain[0] == plain[1]
