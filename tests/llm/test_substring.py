import hashlib
import re

from criteria_engine.llm import substring
from criteria_engine.llm.queries import QUERIES
from llm.llm_helpers import edited, prose


def brute(rows):
    """(words, removed, kept text) of each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    out = []
    for (doc_id, _), own in zip(rows, words):
        gone = [False] * len(own)
        if doc_id is not None:
            earlier = {
                tuple(w[p : p + 50]) for (i, _), w in zip(rows, words) if i is not None and i < doc_id for p in range(len(w) - 49)
            }
            for p in range(len(own) - 49):
                if tuple(own[p : p + 50]) in earlier:
                    gone[p : p + 50] = [True] * 50
        out.append((doc_id, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return out


def cases():
    base, part = prose(1, 400), prose(2, 50)
    rows = [(5, base), (6, f"{prose(3, 77)} {part} {prose(4, 31)}"), (7, f"{prose(5, 8)}\t{part}\n\n{prose(6, 3)}")]
    rows += [(8, prose(7, 20) + " " + " ".join(part.split()[1:])), (9, base), (10, edited(base, 1, 0.02)), (11, edited(base, 2, 0.05))]
    rows += [(12, None), (13, ""), (14, " \n "), (None, base), (5, base + " " + part), (15, " ".join(["again"] * 200)), (16, " ".join(["again"] * 130))]
    rows += [(17, " ".join(base.split()[shift : shift + 60]) + f" tail{shift}") for shift in (0, 13)]
    rows += [(20 + s, prose(90 + s, s) + " " + " ".join(base.split()[100 + s : 150 + s])) for s in range(1, 33)]
    rows += [(60, part + " " + part + " " + prose(61, 9)), (60, part + " " + part + " " + prose(61, 9)), (61, "é " + part.upper())]
    return rows


def test_same_as_brute_force(spark, documents):
    rows = cases()
    table = documents(*rows).withColumnRenamed("source", "text_hash").withColumnRenamed("lang", "places").repartition(3)
    found = substring.remove_repeats(table).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found], key=key) == sorted(brute(rows), key=key)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_empty_table_and_query(spark, documents, tmp_path):
    assert substring.remove_repeats(documents((1, "x")).limit(0)).count() == 0
    rows = [r for r in cases() if r[0] is not None]
    documents(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op10_substring"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows))


def test_cover_has_every_difference():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))
